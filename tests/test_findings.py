"""Fact sentences use Python's number formatting; context layout."""
import datetime as dt

from pyspark.sql import functions as F

from bookspark.operators import analyses as A
from bookspark.operators import findings as FD
from bookspark.sources import tables as T


def test_revenue_facts_match_python_formatting(spark, sf):
    s = T.sales(spark, sf)
    r = A.revenue_summary(s).first()
    facts = {x["key"]: x["text"] for x in FD.revenue_facts(s).collect()}
    assert facts["total revenue"] == f"NGN {float(r['total_revenue']):,.0f}"
    assert facts["orders"] == f"{r['orders']:,}"
    assert facts["average order value"] == f"NGN {r['avg_order_value']:,.0f}"
    assert facts["period"] == f"{r['first_date']:%d %b %Y} to {r['last_date']:%d %b %Y}"
    h = A.half_period_change(s).first()
    assert facts["note"].endswith(f"({h['change_pct']:+.0f}%).")


def test_all_fact_tables_run(spark, sf):
    s = T.sales(spark, sf)
    keys = set()
    for df in (FD.top_product_facts(s), FD.bottom_product_facts(s), FD.monthly_facts(s),
               FD.dimension_facts(s, "channel"), FD.weekday_facts(s)):
        keys |= {r["key"] for r in df.collect()}
    assert {"concentration", "ranking", "share", "range", "spread"} <= keys


def test_context_text_layout(spark):
    t = spark.createDataFrame([("a", "1,000", 3), ("bb", "20", 12)], "product string, revenue string, orders int")
    facts = spark.createDataFrame([("x", 0, "note", "hello")], "finding string, ord int, key string, text string")
    ctx = FD.context_text("Top 2 products by revenue", facts, t, [F.col("orders").asc()], "Read it well.").first()[0]
    assert ctx == ("Top 2 products by revenue\nnote: hello\nproduct revenue orders\n"
                   "      a   1,000      3\n     bb      20     12\nHow to interpret this: Read it well.")


def test_facts_keep_their_order_in_json_and_rows(spark):
    import json
    from bookspark.sinks import reports as K
    facts = spark.createDataFrame([("f", 2, "alpha", "z"), ("f", 0, "zeta", "x"), ("f", 1, "mid", "y")], "finding string, ord int, key string, text string")
    table = spark.createDataFrame([("a", 1.0)], "value string, revenue double")
    head = json.loads(next(r["json"] for r in K.finding_json(table, "q", "r", "h", facts).collect() if r["ord"] == 0))
    assert list(head["facts"].items()) == [("zeta", "x"), ("mid", "y"), ("alpha", "z")]
    rows = sorted((r["pos"], r["label"]) for r in K.finding_rows(table, "q", "h", facts=facts).collect() if r["section"] == "facts")
    assert [label for _, label in rows] == ["Zeta", "Mid", "Alpha"]


def test_queries_that_read_the_sales_often_join_the_tables_once(spark, sf):
    from bookspark.plans.catalog import QUERIES
    for name in ("finding_facts", "answer_figures", "answer_log", "retrieval_summary"):
        files = QUERIES[name](spark, sf).inputFiles()
        assert not [f for f in files if "lineitem" in f or "orders" in f], name


def test_raw_rows_and_their_copies_come_from_one_join(spark, sf):
    import contextlib
    import io

    from bookspark.sources import tables as T
    raw = T.sales_raw(spark, sf)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        raw.explain()
    assert out.getvalue().count("lineitem.parquet") == 1
    k = F.floor(F.col("_row") / 2)
    copies = raw.groupBy(k.alias("k")).agg(F.count_if(F.col("_row") % 2 == 0).alias("own"), F.count_if(F.col("_row") % 2 == 1).alias("copies"))
    assert copies.filter("copies <> if(k % 401 = 0, own, 0)").count() == 0
