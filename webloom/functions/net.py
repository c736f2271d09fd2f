"""IPv4 rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.kernel.net import REFUSED_V4


def ipv4_to_long(ip: Column) -> Column:
    """The number of a dotted address; null if it is none."""
    part = lambda i: F.regexp_extract(ip, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\z", i).try_cast("long")
    parts = [part(i) for i in range(1, 5)]
    value = reduce(lambda a, b: a * 256 + b, parts)
    return F.when(reduce(lambda a, b: a & b, [p <= 255 for p in parts]), value)


def ipv4_refused(ip: Column) -> Column:
    """Whether a dotted address lies in a refused range; null if it is none."""
    n = ipv4_to_long(ip)
    inside = [n.between(int(r.network_address), int(r.broadcast_address)) for r in REFUSED_V4]
    return reduce(lambda a, b: a | b, inside)
