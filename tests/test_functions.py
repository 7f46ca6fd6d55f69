"""Column expressions against Python's own string/number behaviour."""
import pytest
from pyspark.sql import functions as F

from bookspark.functions import numbers as N
from bookspark.functions import text as X

TITLE_CASES = ["puff puff (6pcs)", "o'neil", "  SMALL   RING  ", "jollof-rice", "ABC123def", "ñandú azul", ""]
STRIP_CASES = ["  a ", "\ta\n", "\xa0x　", "x", "   "]
NUMBER_CASES = ["NGN1,800", "", "-", ".", "1.2.3", "(500)", "1.800,50", "6 x 200", "12", "-5.5", "abc"]


def _py_number(v):
    import re
    cleaned = re.sub(r"[^0-9.\-]", "", v)
    if cleaned in ("", "-", "."):
        return None
    try:
        return float(cleaned)
    except ValueError:
        return None


def _col(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_title_matches_python(spark):
    rows = _col(spark, TITLE_CASES).select("v", X.collapse_ws(X.py_title(X.py_strip(F.col("v")))).alias("t")).collect()
    import re
    for r in rows:
        assert r["t"] == re.sub(r"\s+", " ", r["v"].strip().title()), r


def test_strip_matches_python(spark):
    rows = _col(spark, STRIP_CASES).select("v", X.py_strip(F.col("v")).alias("s")).collect()
    for r in rows:
        assert r["s"] == r["v"].strip()


def test_to_number_matches_reference_rule(spark):
    rows = _col(spark, NUMBER_CASES).select("v", N.to_number(F.col("v")).alias("n")).collect()
    for r in rows:
        assert r["n"] == _py_number(r["v"]), r


def test_snake_and_match_key():
    assert X.snake("Unit Price (NGN)") == "unit_price"
    assert X.snake("  Qty (pcs) ") == "qty"
    assert X.match_key("order id") == "orderid"
    assert X.snake("2026") == "2026"


def test_normalise_category(spark):
    rows = _col(spark, ["Walk_In", " APP ", "walk-in"]).select(X.normalise_category(F.col("v")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["walk in", "app", "walk in"]


@pytest.mark.parametrize("token,norm", [("14%", "14"), ("223.0", "223"), ("3,600", "3600"), ("1.00", "1.00")])
def test_normalise_number(spark, token, norm):
    r = _col(spark, [token]).select(N.normalise_number(F.col("v")).alias("n")).first()
    assert r["n"] == norm
