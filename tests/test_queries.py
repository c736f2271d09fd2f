"""Every registered query of the library against its SQL, and the entry points."""

import pytest
from oracle import SMALL, assert_same, connection

from webloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        assert_same(got, connection().sql(catalog.ORACLES[name]).df())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_native_text_equals_kernel(spark):
    from pyspark.sql import functions as F

    from webloom.functions import text as X
    from webloom.kernel.text import strip_html
    from webloom.tables import table

    for r in table(spark, SMALL, "pages").select("html", X.strip_html(F.col("html")).alias("text")).collect():
        assert r.text == strip_html(r.html)


def test_text_runs_in_generated_code(spark):
    plan = catalog.html_to_text(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Project" in plan and "Python" not in plan and "ReadSchema: struct<page_id:bigint,html:string>" in plan
