"""Driver contract: entry() and a few registered queries against the oracle."""
import duckdb

import __spark_entry__ as E
from bookspark.sources.tables import TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and "revenue" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_some_queries_match_oracle(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ["revenue_summary", "top_products", "monthly_trend", "clean_report", "resolve_attempts"]:
        s = E.queries()[name](spark, sf)
        o = con.execute(E.oracle_sql()[name])
        assert sorted(s.columns) == sorted(d[0] for d in o.description), name
        assert s.count() == len(o.fetchall()), name
