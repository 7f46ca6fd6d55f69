"""The eight business analyses (A1-A23) as grouped DataFrame jobs.

Every analysis first collapses the sales rows with one partially aggregated
``groupBy`` (by product, month, weekday, dimension value or date), then
ranks/shares/compares on that small grouped table.  A hot product or shop
therefore costs nothing extra: map-side partial aggregation folds it before
the shuffle.  Optional ``scope`` columns (e.g. ``_file``) run the same
analysis per shop in the same job.

Input: a clean sales DataFrame with ``date`` (DATE), ``product``, ``qty``,
``total`` and, for A13-A17, the dimension column.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.operators.common import money_sum, reuse, safe_ratio, top_n_per_group

WEEKEND = ["Saturday", "Sunday"]


def _scope(scope: Sequence[str] | None) -> list[str]:
    return list(scope or [])


def _join_scope(a: DataFrame, b: DataFrame, scope: list[str]) -> DataFrame:
    return a.join(b, scope) if scope else a.crossJoin(b)


# ------------------------------------------------------------------ A1, A2

def daily(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """Revenue and orders per (scope, date): the one big aggregation behind
    the summary and the half-period split.  Distinct dates are bounded by the
    calendar, not by the number of rows."""
    s = _scope(scope)
    return df.groupBy(*s, "date").agg(money_sum("total").alias("revenue"),
                                      F.count(F.lit(1)).alias("orders"))


def revenue_summary(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """A1: total revenue, orders, average order value, first and last date."""
    s = _scope(scope)
    d = daily(df, s)
    out = d.groupBy(*s).agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(38,2)").alias("total_revenue"),
        F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint").alias("orders"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    return out.withColumn(
        "avg_order_value",
        F.col("total_revenue").cast("double") / F.greatest(F.col("orders"), F.lit(1)).cast("double"))


def half_period_change(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """A2: revenue up to the midpoint of the period vs after it.

    ``date <= min + (max-min)/2``  <=>  ``2*date <= min + max`` in days, exact.
    Reported only for more than 20 orders and a non-zero first half."""
    s = _scope(scope)
    d = reuse(daily(df, s))
    bounds = d.groupBy(*s).agg(F.min("date").alias("_min"), F.max("date").alias("_max"),
                               F.sum("orders").alias("_orders"))
    j = _join_scope(d, bounds, s)
    first = 2 * F.unix_date("date") <= F.unix_date("_min") + F.unix_date("_max")
    out = j.groupBy(*s).agg(
        F.first("_orders").cast("bigint").alias("orders"),
        F.coalesce(F.sum(F.when(first, F.col("revenue"))), F.lit(0)).cast("decimal(38,2)").alias("first_half"),
        F.coalesce(F.sum(F.when(~first, F.col("revenue"))), F.lit(0)).cast("decimal(38,2)").alias("second_half"),
    )
    change = safe_ratio(F.col("second_half").cast("double") - F.col("first_half").cast("double"),
                        F.col("first_half")) * 100
    reported = (F.col("orders") > 20) & (F.col("first_half") != 0)
    return (out.withColumn("change_pct", F.when(reported, change))
               .withColumn("reported", reported))


def full_summary(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """A1 with A2: one row per scope, from one daily aggregation."""
    s = _scope(scope)
    d = reuse(daily(df, s))
    bounds = d.groupBy(*s).agg(F.min("date").alias("_min"), F.max("date").alias("_max"))
    j = _join_scope(d, bounds, s)
    first = 2 * F.unix_date("date") <= F.unix_date("_min") + F.unix_date("_max")
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")
    out = j.groupBy(*s).agg(
        money(F.col("revenue")).alias("total_revenue"),
        F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint").alias("orders"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        money(F.when(first, F.col("revenue"))).alias("first_half"), money(F.when(~first, F.col("revenue"))).alias("second_half"))
    change = safe_ratio(F.col("second_half").cast("double") - F.col("first_half").cast("double"), F.col("first_half")) * 100
    return (out.withColumn("avg_order_value", F.col("total_revenue").cast("double") / F.greatest("orders", F.lit(1)).cast("double"))
               .withColumn("change_pct", F.when((F.col("orders") > 20) & (F.col("first_half") != 0), change)))


# ------------------------------------------------------------ A3-A5, A10-A12

def product_totals(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """revenue, units, orders per product (orders counts rows, even null totals)."""
    s = _scope(scope)
    return df.groupBy(*s, "product").agg(
        money_sum("total").alias("revenue"),
        F.coalesce(F.sum("qty"), F.lit(0.0)).cast("double").alias("units"),
        F.count(F.lit(1)).alias("orders"))


def _ranked_products(df: DataFrame, n: int, ascending: bool,
                     scope: Sequence[str] | None, totals: DataFrame | None = None) -> DataFrame:
    s = _scope(scope)
    p = totals if totals is not None else product_totals(df, s)
    rev = F.col("revenue").asc() if ascending else F.col("revenue").desc()
    order = [rev, F.col("product").asc()]
    if not s:
        ranked = p.orderBy(*order).limit(n)
        w = Window.orderBy(*order)  # over at most n rows
        return ranked.withColumn("rank", F.row_number().over(w))
    return top_n_per_group(p, s, order, n).withColumnRenamed("_rn", "rank")


def top_products(df: DataFrame, n: int = 5, scope: Sequence[str] | None = None) -> DataFrame:
    """A3: the n products with the highest revenue (ties by product name)."""
    return _ranked_products(df, n, False, scope)


def bottom_products(df: DataFrame, n: int = 5, scope: Sequence[str] | None = None) -> DataFrame:
    """A10: the n products with the lowest revenue (ties by product name)."""
    return _ranked_products(df, n, True, scope)


def volume_vs_value(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """A4: product with the most revenue vs product with the most units
    (ties -> smallest product, like ``idxmax`` on a sorted index)."""
    s = _scope(scope)
    p = product_totals(df, s)
    return p.groupBy(*s).agg(
        F.min_by("product", F.struct(-F.col("revenue"), F.col("product"))).alias("revenue_leader"),
        F.max("revenue").alias("leader_revenue"),
        F.min_by("product", F.struct(-F.col("units"), F.col("product"))).alias("units_leader"),
        F.max("units").alias("leader_units"),
    ).withColumn("differs", F.col("revenue_leader") != F.col("units_leader"))


def _n_share(df: DataFrame, n: int, ascending: bool, scope: Sequence[str] | None,
             name: str) -> DataFrame:
    s = _scope(scope)
    p = reuse(product_totals(df, s))
    ranked = _ranked_products(df, n, ascending, s, totals=p)
    part = ranked.groupBy(*s).agg(F.sum("revenue").cast("decimal(38,2)").alias(f"{name}_revenue"))
    whole = p.groupBy(*s).agg(F.sum("revenue").cast("decimal(38,2)").alias("total_revenue"),
                              F.count(F.lit(1)).alias("products"))
    out = _join_scope(part, whole, s)
    return out.withColumn(f"{name}_share_pct",
                          safe_ratio(F.col(f"{name}_revenue"), F.col("total_revenue")) * 100)


def top_concentration(df: DataFrame, n: int = 5, scope: Sequence[str] | None = None) -> DataFrame:
    """A5: share of revenue held by the top n products, and the product count."""
    return _n_share(df, n, False, scope, "top")


def tail_share(df: DataFrame, n: int = 5, scope: Sequence[str] | None = None) -> DataFrame:
    """Share of revenue held by the bottom n products."""
    return _n_share(df, n, True, scope, "bottom")


def volume_warning(df: DataFrame, n: int = 5, scope: Sequence[str] | None = None) -> DataFrame:
    """Bottom-n revenue products that are also top-5 by units."""
    s = _scope(scope)
    p = reuse(product_totals(df, s))
    bottom = _ranked_products(df, n, True, s, totals=p)
    order = [F.col("units").desc(), F.col("product").asc()]
    if s:
        by_units = top_n_per_group(p, s, order, 5)
    else:
        by_units = p.orderBy(*order).limit(5)
    return bottom.join(by_units.select(*s, "product"), [*s, "product"], "left_semi")


# ---------------------------------------------------------------- A6-A9

def monthly_trend(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """Revenue and orders per calendar month, months without sales as 0,
    labelled ``MMM yyyy``, in calendar order (per scope: from its own first to
    its own last month)."""
    s = _scope(scope)
    m = reuse(df.groupBy(*s, F.trunc("date", "month").alias("month"))
                .agg(money_sum("total").alias("revenue"), F.count(F.lit(1)).alias("orders")))
    span = m.groupBy(*s).agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    cal = span.select(*s, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    out = cal.join(m, [*s, "month"], "left")
    return out.select(
        *s, "month", F.date_format("month", "MMM yyyy").alias("month_label"),
        F.coalesce("revenue", F.lit(0).cast("decimal(38,2)")).alias("revenue"),
        F.coalesce("orders", F.lit(0).cast("bigint")).alias("orders"))


def monthly_change(trend: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """Last month vs the one before, in percent (needs >= 2 months and a
    non-zero previous month).  Works on the small monthly table."""
    s = _scope(scope)
    agg = trend.groupBy(*s).agg(
        F.count(F.lit(1)).alias("months"),
        F.max("month").alias("last_month"),
        F.max_by("revenue", "month").alias("last_revenue"))
    prev = _join_scope(trend, agg.select(*s, "last_month"), s)
    prev = (prev.filter(F.col("month") < F.col("last_month"))
                .groupBy(*s).agg(F.max_by("revenue", "month").alias("previous_revenue")))
    # a 1-month scope has no previous month: keep it with a NULL previous
    out = agg.join(prev, s, "left") if s else agg.crossJoin(prev)
    ok = (F.col("months") >= 2) & (F.col("previous_revenue") != 0)
    change = safe_ratio(F.col("last_revenue").cast("double") - F.col("previous_revenue").cast("double"),
                        F.col("previous_revenue")) * 100
    return out.withColumn("change_pct", F.when(ok, change)).withColumn("reported", F.coalesce(ok, F.lit(False)))


def month_extremes(trend: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """Best and weakest month (first in calendar order on ties)."""
    s = _scope(scope)
    return trend.groupBy(*s).agg(
        F.min_by("month", F.struct(-F.col("revenue"), F.col("month"))).alias("best_month"),
        F.max("revenue").alias("best_revenue"),
        F.min_by("month", F.struct(F.col("revenue"), F.col("month"))).alias("worst_month"),
        F.min("revenue").alias("worst_revenue"),
        F.count(F.lit(1)).alias("months"))


def basket_drift(trend: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """Average order of the first vs the last month (orders floored at 1);
    reported when the relative change exceeds 10 % (denominator floored at 1)."""
    s = _scope(scope)
    a = trend.groupBy(*s).agg(
        F.min_by(F.struct("revenue", "orders"), "month").alias("f"),
        F.max_by(F.struct("revenue", "orders"), "month").alias("l"),
        F.count(F.lit(1)).alias("months"))
    aov_first = F.col("f.revenue").cast("double") / F.greatest(F.col("f.orders"), F.lit(1)).cast("double")
    aov_last = F.col("l.revenue").cast("double") / F.greatest(F.col("l.orders"), F.lit(1)).cast("double")
    out = a.select(*s, "months", aov_first.alias("aov_first"), aov_last.alias("aov_last"))
    rel = F.abs(F.col("aov_last") - F.col("aov_first")) / F.greatest(F.col("aov_first"), F.lit(1.0))
    return (out.withColumn("reported", (F.col("months") >= 2) & (rel > 0.10))
               .withColumn("direction", F.when(F.col("aov_last") > F.col("aov_first"), "spending more")
                           .otherwise("spending less")))


# --------------------------------------------------------------- A13-A17

def by_dimension(df: DataFrame, column: str, scope: Sequence[str] | None = None) -> DataFrame:
    """Revenue, orders and share of revenue per value, ranked."""
    s = _scope(scope)
    g = reuse(df.groupBy(*s, F.col(column).alias("value")).agg(
        money_sum("total").alias("revenue"), F.count(F.lit(1)).alias("orders")))
    tot = g.groupBy(*s).agg(F.sum("revenue").alias("_total"))
    out = _join_scope(g, tot, s)
    return out.select(*s, "value", "revenue", "orders",
                      (safe_ratio(F.col("revenue"), F.col("_total")) * 100).alias("share_pct"))


def dimension_flags(df: DataFrame, column: str, scope: Sequence[str] | None = None) -> DataFrame:
    """A15-A17 on the grouped table: leader share (> 50 = concentration risk),
    highest vs lowest average order (> 1.2x with >= 2 values), and the share
    of revenue whose value is ``unknown`` (> 2 = data gap)."""
    s = _scope(scope)
    g = by_dimension(df, column, s).withColumn(
        "aov", F.col("revenue").cast("double") / F.col("orders").cast("double"))
    out = g.groupBy(*s).agg(
        F.min_by("value", F.struct(-F.col("revenue"), F.col("value"))).alias("leader"),
        F.max("share_pct").alias("leader_share_pct"),
        F.min_by("value", F.struct(-F.col("aov"), F.col("value"))).alias("high_aov_value"),
        F.max("aov").alias("high_aov"),
        F.min_by("value", F.struct(F.col("aov"), F.col("value"))).alias("low_aov_value"),
        F.min("aov").alias("low_aov"),
        F.count(F.lit(1)).alias("values"),
        F.coalesce(F.max(F.when(F.col("value") == "unknown", F.col("share_pct"))), F.lit(0.0)).alias("unknown_share_pct"),
    )
    return (out.withColumn("concentration_risk", F.col("leader_share_pct") > 50)
               .withColumn("basket_gap", (F.col("values") >= 2) & (F.col("high_aov") > F.col("low_aov") * 1.2))
               .withColumn("data_gap", F.col("unknown_share_pct") > 2))


# --------------------------------------------------------------- A18-A20

def weekday_totals(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """Revenue and orders per weekday name (only weekdays present)."""
    s = _scope(scope)
    return df.groupBy(*s, F.date_format("date", "EEEE").alias("weekday")).agg(
        money_sum("total").alias("revenue"), F.count(F.lit(1)).alias("orders"))


def quiet_days(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """A18 ranked quietest first (ties by weekday name)."""
    s = _scope(scope)
    w = Window.partitionBy(*s).orderBy(F.col("revenue").asc(), F.col("weekday").asc()) if s \
        else Window.orderBy(F.col("revenue").asc(), F.col("weekday").asc())  # <= 7 rows per scope
    return weekday_totals(df, s).withColumn("rank", F.row_number().over(w))


def weekday_spread(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """Quietest and busiest weekday, busiest / max(quietest, 1)."""
    s = _scope(scope)
    t = weekday_totals(df, s)
    out = t.groupBy(*s).agg(
        F.min_by("weekday", F.struct(F.col("revenue"), F.col("weekday"))).alias("quietest_day"),
        F.min("revenue").alias("quietest_revenue"),
        F.max_by("weekday", F.struct(F.col("revenue"), F.col("weekday"))).alias("busiest_day"),
        F.max("revenue").alias("busiest_revenue"))
    return out.withColumn("ratio", F.col("busiest_revenue").cast("double")
                          / F.greatest(F.col("quietest_revenue").cast("double"), F.lit(1.0)))


def weekend_effect(df: DataFrame, scope: Sequence[str] | None = None) -> DataFrame:
    """Weekend revenue / 2 vs weekday revenue / 5 (fixed divisors, as the
    reference), reported above a 15 % relative difference; ``*_dates`` count the
    calendar dates present."""
    s = _scope(scope)
    d = daily(df, s)
    is_we = F.date_format("date", "EEEE").isin(WEEKEND)
    out = d.groupBy(*s).agg(
        (F.coalesce(F.sum(F.when(is_we, F.col("revenue"))), F.lit(0)).cast("double") / 2).alias("weekend_avg"),
        (F.coalesce(F.sum(F.when(~is_we, F.col("revenue"))), F.lit(0)).cast("double") / 5).alias("weekday_avg"),
        F.count_if(is_we).alias("weekend_dates"),
        F.count_if(~is_we).alias("weekday_dates"))
    rel = F.abs(F.col("weekend_avg") - F.col("weekday_avg")) / F.col("weekday_avg")
    reported = (F.col("weekday_avg") != 0) & (rel > 0.15)
    return (out.withColumn("reported", F.coalesce(reported, F.lit(False)))
               .withColumn("higher", F.when(F.col("weekend_avg") > F.col("weekday_avg"), "weekend")
                           .otherwise("weekday")))


# ------------------------------------------------------------- A21-A23

# Guidance text per finding, as the reference states it.
GUIDANCE = {
    "revenue_summary": (
        "This is the overall snapshot, not a single product or day. If a "
        "second-half-vs-first-half note is present, a positive percentage means "
        "business grew; a negative percentage means it shrank. Do not describe "
        "growth as decline or vice versa."),
    "top_products": (
        "These are the STRONGEST performers, ranked highest revenue first. They "
        "are what is working: candidates to protect stock of, promote further, or "
        "use as an anchor. Do NOT describe them as underperforming or as a risk."),
    "monthly_trend": (
        "The table is in calendar order, not ranked. A rising revenue figure "
        "month over month is good news; a falling one is a warning sign. The "
        "'weakest' month in the range note is a low point, not the norm — do not "
        "generalise a single weak month into 'the business is dead'."),
    "bottom_products": (
        "These are the WEAKEST performers by revenue. They are candidates to drop, "
        "reprice or promote — not products the business depends on. Do NOT describe "
        "them as a concentration risk, as important to the business, or advise "
        "'reducing dependence' on them; low revenue means the opposite of dependence. "
        "EXCEPTION: if a 'volume warning' fact is present, the products it names sell "
        "in high volume at a low price — they are not low-demand and should NOT be "
        "described as candidates to drop or discontinue. For those specific products, "
        "recommend repricing instead."),
    "by_dimension": (
        "Rows are ranked highest revenue first, lowest last. The top row is the "
        "strongest {label}; the bottom row is the weakest. If a 'concentration "
        "risk' fact is present, that describes over-reliance on the TOP row, "
        "which is a fragility to flag, not an achievement to praise."),
    "quiet_days": (
        "The table is sorted weakest day first, busiest day last — and the 'spread' "
        "fact labels each end explicitly with the words QUIETEST and BUSIEST. The "
        "quietest day has the LOWEST revenue, fewest customers, and is the closest "
        "thing to 'when is the shop dead' — a candidate for shorter hours, a "
        "promotion, or closing altogether. The busiest day has the HIGHEST revenue. "
        "Do NOT swap these two: whichever day is named 'QUIETEST' in the spread fact "
        "is the weak one, not the strong one, no matter which day it appears next to "
        "in the sentence."),
}


def guidance_for(finding: str, column: str | None = None) -> str:
    if finding == "by_dimension":
        return GUIDANCE["by_dimension"].format(label=(column or "").replace("_", " "))
    return GUIDANCE[finding]
