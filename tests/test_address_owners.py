"""Addresses and the narrowest ranges that hold them, against all ranges one by one."""

import ipaddress
import random

import pytest
from oracle import assert_same, connection

from webloom.kernel import net as kernel
from webloom.operators import net
from webloom.plans import catalog


def span(text):
    """family, low, high of a range; None if it is none."""
    try:
        if "/" in text:
            n = ipaddress.ip_network(text, strict=False)
            return n.version, int(n[0]), int(n[-1])
        ends = [ipaddress.ip_address(x) for x in text.split("-")]
        return (ends[0].version, int(ends[0]), int(ends[-1])) if len({e.version for e in ends}) == 1 and ends[0] <= ends[-1] else None
    except ValueError:
        return None


def owner(ip, ranges):
    try:
        a = ipaddress.ip_address(ip)
    except (ValueError, TypeError):
        return None
    a = getattr(a, "ipv4_mapped", None) or a
    fits = [(s[2] - s[1], r) for r in ranges if (s := span(r)) and s[0] == a.version and s[1] <= int(a) <= s[2]]
    return min(fits)[1] if fits else None


def test_against_all_ranges(spark):
    r = random.Random(3)
    four = lambda: str(ipaddress.IPv4Address((10 << 24) + r.getrandbits(12)))
    six = lambda: str(ipaddress.IPv6Address((0x20010DB8 << 96) + (r.getrandbits(4) << 60) + r.getrandbits(5)))
    ranges = ["0.0.0.0/0", "::/0", "10.0.0.0/8", "255.255.255.255", "128.0.0.0/1", "8000::/1", "ffff::/16", "10.0.0.7-10.0.0.3", "10.0.0.1-::1", "no", "", "300.0.0.0/8", "10.0.0.0/40"]
    ranges += [f"{four()}/{r.randint(18, 32)}" for _ in range(60)] + [f"{six()}/{r.randint(60, 128)}" for _ in range(60)]
    for make in (four, six):
        for _ in range(40):
            a, b = sorted((make(), make()), key=lambda x: int(ipaddress.ip_address(x)))
            ranges.append(f"{a}-{b}")
    ranges += ranges[20:30]
    ips = [four() for _ in range(80)] + [six() for _ in range(80)] + [f"::ffff:{four()}" for _ in range(9)] + ["255.255.255.255", "255.255.255.254", "::", "ffff::1", "1.2.3.999", "x", "", None, "128.0.0.1", "127.0.0.1"]
    found = net.address_owners(spark.createDataFrame([(i, "x") for i in ips], "ip string, low string"), spark.createDataFrame([(x,) for x in ranges], "range string")).collect()
    assert len(found) == len(ips) and found[0].low == "x"
    for row in found:
        assert row.range == owner(row.ip, ranges), row.ip


def test_no_ranges(spark):
    ips = spark.createDataFrame([("1.2.3.4",), ("::1",)], "ip string")
    assert [r.range for r in net.address_owners(ips, spark.createDataFrame([], "range string")).collect()] == [None, None]
    assert net.address_owners(ips.limit(0), spark.createDataFrame([("::/0",)], "range string")).count() == 0


def test_found_by_equality(spark):
    """No table is compared with another by bounds."""
    ips, ranges = spark.range(100).selectExpr("concat('10.0.0.', id) as ip"), spark.range(100).selectExpr("concat('10.0.', id, '.0/24') as range")
    plan = net.address_owners(ips, ranges)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join [family" in plan


@pytest.mark.parametrize(("text", "n"), [("10.0.0.0/8", 1), ("10.0.0.1-10.0.0.14", 6), ("::1", 1), ("::-ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", 1)])
def test_pieces(text, n):
    pieces = kernel.range_pieces(text)
    assert len(pieces) == n and len({p["width"] for p in pieces}) == 1 and len(pieces[0]["width"]) == 33


def test_named_ranges(spark):
    """Names are given for ranges, order equally wide ones, and need not be addresses."""
    ranges = spark.createDataFrame([("10.0.0.0/8", "wide"), ("10.1.0.0/16", "b"), ("10.1.0.0-10.1.255.255", "a"), ("no", "none")], "range string, name string")
    found = net.address_owners(spark.createDataFrame([("10.1.2.3",), ("10.2.0.0",), ("11.0.0.0",)], "ip string"), ranges).collect()
    assert {r.ip: r.range for r in found} == {"10.1.2.3": "a", "10.2.0.0": "wide", "11.0.0.0": None}


def test_customers_beyond_one_group(spark, tmp_path):
    """Customers' keys of more than 16 bits: their addresses have two groups for them, their names one number."""
    con = connection()
    con.sql(f"copy (select c.* replace (c_custkey + 65530 as c_custkey) from customer c order by c_custkey limit 40) to '{tmp_path}/customer.parquet' (format parquet)")
    con.sql(f"copy documents to '{tmp_path}/documents.parquet' (format parquet)")
    con.sql(f"create or replace view customer as select * from '{tmp_path}/customer.parquet'")
    got = catalog.address_owners(spark, str(tmp_path)).toPandas()
    assert sum(ip.partition("::")[2] > "1" and len(ip.partition("::")[2]) == 5 and r is not None for ip, r in zip(got["ip"], got["range"], strict=True)) > 2
    assert_same(got, con.sql(catalog.ORACLES["address_owners"]).df())
