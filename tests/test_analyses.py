"""Analyses: every breakdown sums to the summary; ties; empty months."""
import datetime as dt

from pyspark.sql import functions as F

from bookspark.operators import analyses as A
from bookspark.sources import tables as T


def test_breakdowns_add_up(spark, sf):
    s = T.sales(spark, sf)
    total = A.revenue_summary(s).first()
    for df in (A.monthly_trend(s), A.quiet_days(s), A.by_dimension(s, "payment_method"),
               A.by_dimension(s, "vendor")):
        agg = df.agg(F.sum("revenue").alias("r"), F.sum("orders").alias("o")).first()
        assert agg["r"] == total["total_revenue"] and agg["o"] == total["orders"]


def _fixture(spark):
    rows = [("a", dt.date(2026, 1, 5), 1.0, 100.0), ("b", dt.date(2026, 1, 6), 5.0, 100.0),
            ("c", dt.date(2026, 4, 7), 2.0, 10.0), ("c", dt.date(2026, 4, 8), 2.0, 10.0)]
    return spark.createDataFrame(rows, "product string, date date, qty double, total double")


def test_empty_months_present_as_zero(spark):
    t = A.monthly_trend(_fixture(spark)).orderBy("month").collect()
    assert [r["month_label"] for r in t] == ["Jan 2026", "Feb 2026", "Mar 2026", "Apr 2026"]
    assert [float(r["revenue"]) for r in t] == [200.0, 0.0, 0.0, 20.0]
    ext = A.month_extremes(A.monthly_trend(_fixture(spark))).first()
    assert ext["worst_month"] == dt.date(2026, 2, 1)


def test_ties_break_by_name_and_volume_note(spark):
    top = A.top_products(_fixture(spark), 2).collect()
    assert [r["product"] for r in top] == ["a", "b"]
    vv = A.volume_vs_value(_fixture(spark)).first()
    assert vv["revenue_leader"] == "a" and vv["units_leader"] == "b" and vv["differs"]


def test_weekend_effect_fixed_divisors(spark):
    rows = [(dt.date(2026, 1, 3), 100.0), (dt.date(2026, 1, 5), 50.0)]  # Saturday, Monday
    df = spark.createDataFrame(rows, "date date, total double")
    r = A.weekend_effect(df).first()
    assert r["weekend_avg"] == 50.0 and r["weekday_avg"] == 10.0 and r["reported"] and r["higher"] == "weekend"


def test_scoped_top_products_match_unscoped(spark, sf):
    s = T.sales(spark, sf)
    v = s.select("vendor").first()[0]
    scoped = A.top_products(s, 3, scope=["vendor"]).filter(F.col("vendor") == v).orderBy("rank").collect()
    single = A.top_products(s.filter(F.col("vendor") == v), 3).orderBy("rank").collect()
    assert [r["product"] for r in scoped] == [r["product"] for r in single]
