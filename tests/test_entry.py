import duckdb
import pytest

import __spark_entry__ as entry_module
from gaugeworks import plans

SMALL = ("o01_read_delimited", "o12_pivot_long", "o18_quarantine", "o55_score_fleet", "o67_mass_errors", "o78_split_headings", "o91_rrf", "o98_ir_summary")


def test_names():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(plans.queries()) > 90


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", SMALL)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("events", "customer", "nation", "region", "documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = plans.queries()[name](spark, data)
    columns = sorted(df.columns)
    expected = con.sql(plans.oracle_sql()[name])
    simple = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    got = sorted((tuple(simple(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [expected.columns.index(c) for c in columns]
    assert got == sorted((tuple(simple(r[i]) for i in at) for r in expected.fetchall()), key=repr)
