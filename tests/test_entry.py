import duckdb
import pytest

import __spark_entry__ as entry
from cloudgauge.plans import queries as plans

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS FROM '{D}/orders.parquet'")
    want, got = con.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, D).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    want, got = (x[columns].sort_values(columns).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got) and ((want == got) | (want.isna() & got.isna())).all().all()


def test_flagship(spark):
    assert entry.entry(spark).count() == 6
