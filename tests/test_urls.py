"""Plain URLs in generated code against the parser, on random and awkward URLs."""

import random

from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.kernel import url as kernel
from webloom.kernel.net import url_refusal
from webloom.operators import net

AWKWARD = [
    "http://a.example", "https://a.example:443/x", "http://a.example:443/x", "http://a.example:80", "http://a.example:080/", "http://a.example:99999/", "http://a.example:65535?", "http://A.example/", "HTTP://a.example/", "http://a.example/../b",
    "http://a.example/a/./b", "http://a.example/a/%2E%2e/b", "http://a.example/a/.%2e", "http://a.example/...", "http://a.example/.b", "http://a.example/a?x/../y", "http://a.example/?", "http://a.example/#", "http://a.example?#", "http://a.example/?a#b#c",
    "http://a.example/ä", "http://a.example/a b", "http://a.example/'", "http://a.example/?'", "http://a.example/?`{}|^\\", "http://a.example/`", "http://a.example/\\x", "http://u:p@a.example/", "http://localhost/", "http://x.localhost/", "http://x.localhost:8/y",
    "http://x.localhost.example/", "http://127.0.0.1/", "http://0x7f.1/", "http://a.0x7/", "http://a.1/", "http://1.2.3.4.a/", "http://[::1]/", "http://a..b/", "http://.a.b/", "http://a.b./", "http://a_b.c/", "http://-a.b/", "http://a-.b/", "http://xn--a.b/", "//a.b/c", "a.b",
    "", " http://a.b/", "http://a.b/ ", "http://a.b/\n", "http://a.b/\tc", "ftp://a.b/", "http:a.b", "http:///a.b", "http://a.b:/", "http://a.b/%", "http://a.b/%zz|[]", None, "http://a.b/x;y=z,w!$&()*+:@~", "https://a.b/" + "x" * 5000,
]


def made(n):
    r = random.Random(4)
    any_letters, plain = "ab.A%2e/?#:@-_~'`{}|\\^ \"<>ä[]0189\t", "ab.A%2e/?#:-_~19&="

    def one(i):
        start = r.choice(["http://", "https://", "http:/", "HTTP://"]) + r.choice(["a.b", "x.y.example", "a.b:8080", "A.b", "a.1", "localhost"]) if i % 2 else "https://a.example/"
        return start + "".join(r.choice(any_letters if i % 2 else plain) for _ in range(r.randint(0, 14)))

    return [one(i) for i in range(n)]


def parsed(text):
    try:
        u = kernel.parse(text)
    except (kernel.UrlError, AttributeError):
        return None
    return u.scheme, u.netloc, u.origin, u.pathname, u.search, str(u)


def test_parts(spark):
    rows = [(i, u, 1) for i, u in enumerate(AWKWARD + made(3000))]
    df = spark.createDataFrame(rows, "i long, url string, u int")
    n = 0
    for r in df.select("url", U.is_plain(F.col("url")).alias("plain"), U.plain_parts(F.col("url")).alias("p")).collect():
        if r.plain:
            n += 1
            assert tuple(r.p) == parsed(r.url), r.url
    assert n > 300
    both = U.with_url_parts(df, "url", "parts").collect()
    assert len(both) == len(rows)
    assert all((tuple(r.parts) if r.parts else None) == (parsed(r.url) if r.url is not None else None) for r in both)


def test_verdicts(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(AWKWARD + made(500))], "page_id long, url string, reason2 string")
    for r in net.url_verdicts(df).collect():
        why = url_refusal(r.url) if r.url is not None else None
        assert (r.ok, r.reason) == ((why is None, why) if r.url is not None else (None, None)), r.url


def test_plain_rows_need_no_python(spark):
    """The branch of plain URLs runs in generated code; the other one has no rows here, so that no worker is started for it."""
    df = spark.createDataFrame([(i, f"https://a{i}.example/x?y={i}") for i in range(50)], "page_id long, url string")
    plan = net.url_verdicts(df)._jdf.queryExecution().executedPlan().toString()
    first, second = plan.split("Union", 1)[1].split("ArrowEvalPython", 1)[0], plan.count("ArrowEvalPython")
    assert second == 1 and "RLIKE" in first
    assert df.where(~U.is_plain(F.col("url"))).count() == 0
