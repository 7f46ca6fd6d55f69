"""V1-V9 on literal answer/context pairs (the checker is pure expressions)."""
from pyspark.sql import functions as F

from bookspark.operators import verify as V

CONTEXT = "Top 5 products\ntotal revenue: NGN 3,400,197\norders: 1,815\nshare: 14%\nunits: 221.0"


def _u(spark, answer, context=CONTEXT):
    df = spark.createDataFrame([(answer, context)], "a string, c string")
    return df.select(V.unsupported_numbers(F.col("a"), F.col("c")).alias("u")).first()["u"]


def test_supported_numbers_pass(spark):
    assert _u(spark, "You made NGN 3,400,197 over 1,815 orders (14%), 221 units.") == []


def test_single_digit_exempt_but_trailing_comma_checked(spark):
    assert _u(spark, "Here are 3 things.") == []
    assert _u(spark, "Here are 7, things") == ["7,"]


def test_unsupported_in_order_with_duplicates(spark):
    assert _u(spark, "Revenue 155,804 and 10 and 10.") == ["155,804", "10", "10"]


def test_resolve_attempts(spark):
    rows = [("ok", "Revenue NGN 3,400,197.", None),
            ("fixed", "Revenue 99.", "<think>x</think> Revenue NGN 3,400,197."),
            ("flag", "Revenue 99.", "Still 42 and 17."),
            ("wait", "Revenue 99.", None)]
    df = spark.createDataFrame([(i, a1, a2, CONTEXT) for i, a1, a2 in rows],
                               "id string, answer1 string, answer2 string, context string")
    out = {r["id"]: r for r in V.resolve_attempts(df).collect()}
    assert out["ok"]["state"] == "verified" and out["ok"]["verified"] and not out["ok"]["retried"]
    assert out["fixed"]["state"] == "verified_after_retry" and out["fixed"]["text"] == "Revenue NGN 3,400,197."
    assert out["flag"]["state"] == "flagged" and out["flag"]["unsupported"] == ["42", "17"]
    assert "(17, 42)" in out["flag"]["text"] and out["flag"]["retried"]
    assert out["wait"]["state"] == "needs_retry" and out["wait"]["unsupported"] == ["99"]


def test_strip_reasoning(spark):
    df = spark.createDataFrame([("<think>a\nb</think>  hi ",), ("plain ",)], "t string")
    assert [r[0] for r in df.select(V.strip_reasoning(F.col("t"))).collect()] == ["hi", "plain"]


def test_model_comparison(spark):
    rows = [("m1", "q1", 1, "abc", True, [], False, 2.0), ("m1", "q2", 1, "abcd", False, ["10"], True, 4.0),
            ("m2", "q1", 1, "x", True, [], True, 1.0), ("m2", "q2", 1, "xy", True, [], False, 3.0)]
    df = spark.createDataFrame(rows, "model string, question string, run int, text string, verified boolean, "
                                     "unsupported array<string>, retried boolean, seconds double")
    per, side = V.model_comparison(df)
    m = {r["model"]: r for r in per.collect()}
    assert m["m1"]["unsupported_total"] == 1 and m["m1"]["unverified"] == 1 and m["m1"]["mean_length"] == 3.5
    assert m["m2"]["fixed_by_retry"] == 1 and m["m2"]["retried"] == 1
    assert sorted(side.columns) == ["model", "question", "run", "text"] and side.count() == side.select("question", "run", "model").distinct().count()
