"""Loader queries over whole tables, against their SQL."""
import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from marketlens.sources.fixtures import TABLES

SF001 = "/root/testdata/sf0.001"


def both(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    df = queries()[name](spark, SF001)
    want = con.execute(f"select {', '.join(df.columns)} from ({oracle_sql()[name]}) o").fetchall()
    return sorted(map(tuple, df.collect())), sorted(want)


@pytest.mark.parametrize("name", ["wide_to_long_all", "statement_unpivot_all"])
def test_whole_table(spark, name):
    got, want = both(spark, name)
    assert got == want and len(got) > 0


def test_wide_to_long_all_has_every_ticker(spark):
    got, _ = both(spark, "wide_to_long_all")
    assert len({t for _, t, _ in got}) > 3


def test_statement_unpivot_all_has_every_type_and_date(spark):
    got, _ = both(spark, "statement_unpivot_all")
    assert len({k for _, _, k, _, _ in got}) == 6 and len({d for _, d, *_ in got}) == 27
