"""Every registered query against its DuckDB twin on sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from check_oracle import compare
from sslspark.plans import catalog
from tests.conftest import SF01

E.queries()  # fills the catalog; the training-data operators have their own tests
QUERIES, SQL = catalog.QUERIES, catalog.ORACLE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck01, name):
    s_pdf = QUERIES[name](spark, SF01).toPandas()
    if name not in SQL:
        assert len(s_pdf) > 0
        return
    d_pdf = duck01.sql(SQL[name]).df()
    ok, msg = compare(s_pdf, d_pdf)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["stage", "label", "n"]
