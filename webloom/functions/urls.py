"""Parts of plain URLs as Column expressions: most of what is found on the web needs no parser, and so no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import kernels as K

#: An http URL in lower case up to its path, of a host whose last label begins with a letter (no address), with characters alone that stay as they are.
PLAIN = (
    r"^https?://(?:[a-z0-9_][a-z0-9_-]*\.)+[a-z][a-z0-9-]*(?::[1-9][0-9]{0,4})?"
    r"(?:/[!$%&'()*+,\-./0-9:;=@A-Z\[\]_a-z|~]*)?"
    r"(?:\?[!$%&()*+,\-./0-9:;=?@A-Z\[\\\]^_`a-z{|}~]*)?"
    r"(?:#[!#$%&'()*+,\-./0-9:;=?@A-Z\[\\\]^_a-z{|}~]*)?\z"
)
_PARTS = r"^(https?)://([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
#: Segments that mean this folder or the one above.
_DOTS = r"(?i)/(?:\.|%2e){1,2}(?:[/?#]|\z)"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def is_plain(url: Column) -> Column:
    """Whether plain_parts holds for a URL; never null."""
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    port = _part(url, 3)
    return F.coalesce(url.rlike(PLAIN) & ~path.rlike(_DOTS) & ((port == "") | (port.cast("int") <= 65_535)), F.lit(False))


def plain_parts(url: Column) -> Column:
    """scheme, host, origin, pathname, search, href of a plain URL, as the parser gives them."""
    scheme, host, port, path, query, fragment = (_part(url, i) for i in range(1, 7))
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    netloc = F.when(own, host).otherwise(F.concat(host, F.lit(":"), port))
    origin = F.concat(scheme, F.lit("://"), netloc)
    pathname = F.when(path == "", "/").otherwise(path)
    return F.struct(
        scheme.alias("scheme"), netloc.alias("host"), origin.alias("origin"), pathname.alias("pathname"), F.when(query == "?", "").otherwise(query).alias("search"), F.concat(origin, pathname, query, fragment).alias("href")
    )


def with_url_parts(rows: DataFrame, url: str, into: str) -> DataFrame:
    """All columns of rows and the parts of a URL (null: it is none) in the column ``into``. Only rows whose URL isn't plain go to Python."""
    c = F.col(f"`{url}`")
    plain = is_plain(c)
    kind = "struct<scheme:string,host:string,origin:string,pathname:string,search:string,href:string>"
    simple = rows.where(plain).withColumn(into, plain_parts(c).cast(kind))
    return simple.unionByName(rows.where(~plain).withColumn(into, K.url_parts(c)["value"].cast(kind)))
