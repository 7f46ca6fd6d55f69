"""Routing (Q1-Q6) and sinks (K1-K4) on literal fixtures and derived tables."""
import json

from pyspark.sql import functions as F

from bookspark.operators import analyses as A
from bookspark.operators import cleaning as C
from bookspark.operators import routing as Q
from bookspark.sinks import reports as K
from bookspark.sources import tables as T


def test_dimension_hint_order_and_substrings(spark):
    qs = ["Which branch sells most?", "Is the app better than walk-in?", "cash or card?",
          "happy customers", "how is revenue?", "paid via POS at the outlet"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    got = [r[0] for r in df.select(Q.dimension_hint(F.col("q"))).collect()]
    # substring semantics: "happy" contains "app"; vendor keywords are checked first
    assert got == ["ranking_by_vendor", "ranking_by_channel", "ranking_by_payment",
                   "ranking_by_channel", None, "ranking_by_vendor"]


def test_parse_label(spark):
    outs = ["<think>hmm</think> monthly_trend.", "Quiet_days: because", "none", "", "ranking_by_product"]
    df = spark.createDataFrame([(o,) for o in outs], "o string")
    assert [r[0] for r in df.select(Q.parse_label(F.col("o"))).collect()] == [
        "monthly_trend", "quiet_days", None, None, "ranking_by_product"]


def test_routing_eval_and_stability(spark):
    rows = [(1, "q1", "monthly_trend", "monthly_trend", 1.0), (1, "q2", "quiet_days", None, 3.0),
            (2, "q1", "monthly_trend", "monthly_trend", 2.0), (2, "q2", "quiet_days", "quiet_days", 2.0),
            (3, "q1", "monthly_trend", "revenue_summary", 1.0), (3, "q2", "quiet_days", "quiet_days", 1.0)]
    df = spark.createDataFrame(rows, "run int, question string, expected string, got string, seconds double")
    per, overall, misses = Q.routing_eval(df)
    o = overall.first()
    assert (o["correct"], o["total"]) == (4, 6) and abs(o["mean_seconds"] - 10 / 6) < 1e-9
    assert {r["question"] for r in misses.collect()} == {"q1", "q2"}
    st = Q.routing_stability(df).first()
    assert st["median_score"] == 1.0 and st["flaky_questions"] == 2 and st["runs"] == 3


def test_categories_and_dispatch(spark, sf):
    assert [r["label"] for r in Q.categories(spark).orderBy("ord").collect()] == Q.LABELS
    s = T.sales(spark, sf)
    qs = spark.createDataFrame([(1, "best sellers?", "ranking_by_product"), (2, "??", None)],
                               "question_id int, question string, label string")
    out = Q.dispatch(s, qs)
    assert list(out) == ["ranking_by_product"] and out["ranking_by_product"].count() == 5


def test_finding_json_excludes_guidance(spark, sf):
    t = A.top_products(T.sales(spark, sf), 3).orderBy("rank").select("product", "revenue")
    lines = [json.loads(r["json"]) for r in K.finding_json(t, "top?", "ranking_by_product", "Top 3 products")
             .orderBy("ord").collect()]
    head, recs = lines[0], lines[1:]
    assert head["route"] == "ranking_by_product" and "guidance" not in head and len(recs) == 3
    assert recs[0]["record"]["product"] == t.first()["product"]


def test_cleaning_rows_and_load_report(spark, sf):
    r = C.clean(T.sales_raw(spark, sf), n_files=25)
    rows = K.cleaning_rows(r.report, r.mismatches)
    labels = {x["label"] for x in rows.collect()}
    assert "Rows in file" in labels and "Rows kept" in labels
    js = K.load_report_json(r.report, r.mismatches).collect()
    first = json.loads(js[0]["json"])
    assert "rows_in" in first and len(first.get("first_mismatches") or []) <= 5


def test_answer_questions_routes(spark, sf):
    from bookspark.operators import retrieval as R
    s = T.sales(spark, sf)
    idx = R.build_index(R.row_documents(s, id_col="line_id"))
    qs = spark.createDataFrame([(1, "what sells?", "ranking_by_product"), (2, "small ring in January", None),
                                (3, "zzzz qqqq", None)], "question_id bigint, text string, label string")
    out = {r["question_id"]: r for r in Q.answer_questions(s, idx, qs, id_col="line_id").collect()}
    assert out[1]["route"] == "analysis" and out[1]["headline"] == "Top 5 products by revenue"
    assert out[2]["route"] == "retrieval" and out[2]["headline"].startswith("Summary of the ")
    assert out[3]["headline"] == "Overall sales performance" and out[3]["orders"] == s.count()
    best = Q.HANDLERS["ranking_by_product"](s).filter("rank = 1").first()
    assert (out[1]["lead"], out[1]["lead_revenue"]) == (best["product"], best["revenue"])
    assert out[2]["total_revenue"] == out[2]["first_half"] + out[2]["second_half"] and out[2]["avg_order_value"] > 0
    whole, half = A.revenue_summary(s).first(), A.half_period_change(s).first()
    for r in (out[1], out[3]):
        assert r["avg_order_value"] == whole["avg_order_value"] and (r["first_half"], r["change_pct"]) == (half["first_half"], half["change_pct"])


def test_the_store_has_the_whole_finding_of_every_label(spark, sf):
    from bookspark.operators import findings as FD
    s = T.sales(spark, sf).drop("vendor")
    store = FD.finding_store(s, Q.LABELS).collect()
    by = lambda label, section: sorted((r["ord"], r["key"], r["text"], r["number"]) for r in store if r["label"] == label and r["section"] == section)
    for label in Q.LABELS:
        assert len(by(label, "headline")) == len(by(label, "guidance")) == 1
    assert by("ranking_by_vendor", "fact") == by("ranking_by_vendor", "table") == []
    assert [f[1] for f in by("revenue_summary", "fact")][:4] == ["total revenue", "orders", "average order value", "period"]
    assert {r[0] for r in by("monthly_trend", "table")} == set(range(1, 11)) and len(by("quiet_days", "table")) == 7 * 3
    asked = spark.createDataFrame([(1, "quiet_days"), (2, "quiet_days"), (3, None), (4, "nonsense")], "question_id int, label string")
    got = Q.answer_figures(s, asked).groupBy("question_id").count().collect()
    assert {r["question_id"]: r["count"] for r in got} == {i: sum(r["label"] == "quiet_days" for r in store) for i in (1, 2)}
    assert Q.answer_figures(s, asked.filter("question_id > 2")).count() == 0


def test_a_missing_dimension_is_an_empty_finding(spark, sf):
    from bookspark.operators import routing as Q
    sales = T.sales(spark, sf).drop("vendor")
    asked = spark.createDataFrame([(1, "q", "ranking_by_vendor"), (2, "q", "quiet_days"), (3, "q", "nonsense")], "question_id int, question string, label string")
    found = Q.dispatch(sales, asked)
    assert set(found) == {"ranking_by_vendor", "quiet_days"}
    assert found["ranking_by_vendor"].count() == 0 and found["quiet_days"].count() == 7


def test_answers_to_odd_questions(spark, sf):
    """Null texts and ids are answered over all rows, repeated questions each once, no question gives no row."""
    from bookspark.operators import retrieval as R
    s = T.sales(spark, sf)
    idx = R.build_index(R.row_documents(s, id_col="line_id"))
    asked = spark.createDataFrame([(1, None, None), (None, "", None), (2, None, "quiet_days"), (2, None, "quiet_days")], "question_id bigint, text string, label string")
    got = Q.answer_questions(s, idx, asked, id_col="line_id").collect()
    assert sorted((r["question_id"] or 0, r["route"]) for r in got) == [(0, "retrieval"), (1, "retrieval"), (2, "analysis"), (2, "analysis")]
    assert {r["orders"] for r in got} == {s.count()} and len({r["lead"] for r in got if r["route"] == "analysis"}) == 1
    assert Q.answer_questions(s, idx, asked.limit(0), id_col="line_id").count() == 0
