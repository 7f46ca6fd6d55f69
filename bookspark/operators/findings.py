"""Finding text (A21-A23): the facts of each analysis as sentences, and the
context text a narrator is given (headline, ``key: value`` facts, the first
10 table rows right-aligned, guidance).

Facts are built with column expressions from the small result tables of
``analyses`` (one row per finding, or per scope), so they run wherever the
analysis ran.  Output: a long table ``(finding, ord, key, text)``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.operators import analyses as A
from bookspark.session import local_df

# Headlines of the findings, as the reference states them.
HEADLINES = {
    "revenue_summary": "Overall sales performance",
    "top_products": "Top {n} products by revenue",
    "bottom_products": "{n} weakest-selling products by revenue (lowest earners)",
    "monthly_trend": "Revenue by month",
    "by_dimension": "Revenue by {label}",
    "quiet_days": "Revenue by day of week, weakest first",
}

# The finding that answers a label, and the column of those about a dimension.
FINDINGS = {"ranking_by_product": "top_products", "worst_by_product": "bottom_products", "monthly_trend": "monthly_trend",
            "ranking_by_vendor": "by_dimension", "ranking_by_channel": "by_dimension", "ranking_by_payment": "by_dimension",
            "quiet_days": "quiet_days", "revenue_summary": "revenue_summary"}
DIMENSIONS = {"ranking_by_vendor": "vendor", "ranking_by_channel": "channel", "ranking_by_payment": "payment_method"}


def ngn(c: Column) -> Column:
    """``f"NGN {x:,.0f}"``."""
    return F.concat(F.lit("NGN "), F.format_number(c.cast("double"), 0))


def plain(c: Column, digits: int) -> Column:
    """``f"{x:.Nf}"`` (no thousands separators)."""
    return F.regexp_replace(F.format_number(c.cast("double"), digits), ",", "")


def signed(c: Column, digits: int) -> Column:
    """``f"{x:+.Nf}"``."""
    return F.concat(F.when(c < 0, "-").otherwise("+"), plain(F.abs(c), digits))


def day(c: Column) -> Column:
    """``f"{d:%d %b %Y}"``."""
    return F.date_format(c, "dd MMM yyyy")


def _long(df: DataFrame, finding: str, items: list[tuple[str, Column, Column | None]]) -> DataFrame:
    """One row per (key, text) whose condition holds; ``ord`` keeps fact order."""
    arr = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"),
                             (F.when(cond, text) if cond is not None else text).alias("text"))
                    for i, (k, text, cond) in enumerate(items)])
    return (df.select(F.lit(finding).alias("finding"), F.explode(arr).alias("f"))
              .select("finding", "f.ord", "f.key", "f.text").filter(F.col("text").isNotNull()))


def revenue_facts(sales: DataFrame) -> DataFrame:
    s = A.revenue_summary(sales).crossJoin(
        A.half_period_change(sales).select("first_half", "second_half", "change_pct", "reported"))
    note = F.concat(F.lit("Second half of the period earned "), ngn(F.col("second_half")),
                    F.lit(" vs "), ngn(F.col("first_half")), F.lit(" in the first half ("),
                    signed(F.col("change_pct"), 0), F.lit("%)."))
    return _long(s, "revenue_summary", [
        ("total revenue", ngn(F.col("total_revenue")), None),
        ("orders", F.format_number(F.col("orders"), 0), None),
        ("average order value", ngn(F.col("avg_order_value")), None),
        ("period", F.concat(day(F.col("first_date")), F.lit(" to "), day(F.col("last_date"))), None),
        ("note", note, F.col("reported")),
    ])


def top_product_facts(sales: DataFrame, n: int = 5) -> DataFrame:
    vv = A.volume_vs_value(sales).crossJoin(A.top_concentration(sales, n).select("top_share_pct", "products"))
    note = F.concat(F.col("units_leader"), F.lit(" sells the most units ("), plain(F.col("leader_units"), 0),
                    F.lit(") but "), F.col("revenue_leader"), F.lit(" earns the most revenue ("),
                    ngn(F.col("leader_revenue")),
                    F.lit("). Different margin profiles — one is volume, the other is value."))
    conc = F.concat(F.lit(f"These {n} products are "), plain(F.col("top_share_pct"), 0),
                    F.lit("% of total revenue across "), F.col("products").cast("string"),
                    F.lit(" products sold."))
    return _long(vv, "top_products", [("note", note, F.col("differs")), ("concentration", conc, None)])


def bottom_product_facts(sales: DataFrame, n: int = 5) -> DataFrame:
    t = A.tail_share(sales, n)
    warn = (A.volume_warning(sales, n).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "product"))),
                                 lambda x: x["product"]), ", ").alias("overlap"),
        F.count(F.lit(1)).alias("_k")))
    t = t.crossJoin(warn)
    ranking = F.concat(F.lit(f"These are the {n} LOWEST-earning products out of "),
                       F.col("products").cast("string"),
                       F.lit(" total products sold, ordered worst-earner first. "
                             "They are the bottom of the list, not the top."))
    share = F.concat(F.lit(f"Combined, these {n} weakest products brought in only "),
                     plain(F.col("bottom_share_pct"), 0),
                     F.lit("% of total revenue — a small, not a large, slice of the business."))
    vw = F.concat(F.col("overlap"), F.lit(" rank low on revenue but are also among the top 5 products by "
                                          "units sold — low price, not low demand. Repricing is more "
                                          "appropriate than discontinuing for these."))
    return _long(t, "bottom_products", [("ranking", ranking, None), ("share", share, None),
                                        ("volume warning", vw, F.col("_k") > 0)])


def monthly_facts(sales: DataFrame) -> DataFrame:
    trend = A.monthly_trend(sales)
    x = (A.monthly_change(trend).select("months", "change_pct", "reported")
          .crossJoin(A.month_extremes(trend).drop("months"))
          .crossJoin(A.basket_drift(trend).select("aov_first", "aov_last",
                                                 F.col("reported").alias("drift"), "direction")))
    label = lambda c: F.date_format(c, "MMM yyyy")
    rng = F.concat(F.lit("Best month "), label(F.col("best_month")), F.lit(" ("), ngn(F.col("best_revenue")),
                   F.lit("), weakest "), label(F.col("worst_month")), F.lit(" ("), ngn(F.col("worst_revenue")),
                   F.lit(")."))
    basket = F.concat(F.lit("Average order moved from "), ngn(F.col("aov_first")), F.lit(" to "),
                      ngn(F.col("aov_last")), F.lit(" — customers are "), F.col("direction"),
                      F.lit(" per order, separate from how many are buying."))
    return _long(x, "monthly_trend", [
        ("latest change", F.concat(signed(F.col("change_pct"), 1), F.lit("% vs previous month")),
         F.col("reported")),
        ("range", rng, F.col("months") >= 2),
        ("basket size", basket, F.col("drift")),
    ])


def dimension_facts(sales: DataFrame, column: str) -> DataFrame:
    label = column.replace("_", " ")
    f = A.dimension_flags(sales, column)
    conc = F.concat(F.col("leader"), F.lit(" alone is "), plain(F.col("leader_share_pct"), 0),
                    F.lit(f"% of revenue — heavy dependence on a single {label}."))
    basket = F.concat(F.lit("Orders via "), F.col("high_aov_value"), F.lit(" average "), ngn(F.col("high_aov")),
                      F.lit(" versus "), ngn(F.col("low_aov")), F.lit(" via "), F.col("low_aov_value"), F.lit("."))
    gap = F.concat(plain(F.col("unknown_share_pct"), 0), F.lit(f"% of revenue has no {label} recorded."))
    return _long(f, f"by_{column}", [("concentration risk", conc, F.col("concentration_risk")),
                                     ("basket size", basket, F.col("basket_gap")),
                                     ("data gap", gap, F.col("data_gap"))])


def weekday_facts(sales: DataFrame) -> DataFrame:
    x = A.weekday_spread(sales).crossJoin(A.weekend_effect(sales))
    spread = F.concat(F.lit("QUIETEST day: "), F.col("quietest_day"), F.lit(", "), ngn(F.col("quietest_revenue")),
                      F.lit(". BUSIEST day: "), F.col("busiest_day"), F.lit(", "), ngn(F.col("busiest_revenue")),
                      F.lit(". Busiest earns "), plain(F.col("ratio"), 1), F.lit("x what quietest does."))
    we = F.col("higher") == "weekend"
    hi_v = F.when(we, F.col("weekend_avg")).otherwise(F.col("weekday_avg"))
    lo_v = F.when(we, F.col("weekday_avg")).otherwise(F.col("weekend_avg"))
    lo_l = F.when(we, F.lit("weekday")).otherwise(F.lit("weekend"))
    effect = F.concat(F.lit("HIGHER-earning: "), F.col("higher"), F.lit("s average "), ngn(hi_v),
                      F.lit(" per day. LOWER-earning: "), lo_l, F.lit("s average "), ngn(lo_v), F.lit(" per day."))
    return _long(x, "quiet_days", [("spread", spread, None), ("weekend effect", effect, F.col("reported"))])


CONTEXT_ROWS = 10  # rows of a finding's table that its context shows


def _cells(table: DataFrame, label: str, order: list[Column], rows: int) -> DataFrame:
    """The first ``rows`` rows of a finding's table, one row per cell."""
    w = Window.orderBy(*order)  # over at most ``rows`` rows
    head = table.orderBy(*order).limit(rows).withColumn("_ord", F.row_number().over(w))
    kinds = dict(table.dtypes)
    numeric = lambda c: kinds[c].startswith(("decimal", "double", "bigint", "int"))
    cells = F.array(*[F.struct(
        F.lit(c).alias("key"),
        (F.lit(None) if numeric(c) else F.col(c)).cast("string").alias("text"),
        (F.col(c) if numeric(c) else F.lit(None)).cast("double").alias("number")) for c in table.columns if c != "rank"])
    return (head.select("_ord", F.explode(cells).alias("c"))
            .select(F.lit(label).alias("label"), F.lit("table").alias("section"), F.col("_ord").alias("ord"), "c.key", "c.text", "c.number"))


def finding_store(sales: DataFrame, labels: list[str], n: int = 5, rows: int = CONTEXT_ROWS) -> DataFrame:
    """``(label, section, ord, key, text, number)``: headline, facts, the first ``rows``
    rows of the table, and guidance of every label's finding, in order.

    Each analysis runs once, however many questions ask for it.  The store has a
    bounded number of rows per label whatever the size of ``sales``, so questions
    meet it by a broadcast join.  A dimension that ``sales`` lacks has a headline
    and guidance only."""
    heads, facts, tables = [], [], []
    for label in labels:
        column = DIMENSIONS.get(label)
        finding = FINDINGS[label]
        heads += [(label, "headline", 0, None, HEADLINES[finding].format(n=n, label=(column or "").replace("_", " ")), None),
                  (label, "guidance", 0, None, A.guidance_for(finding, column), None)]
        if column and column not in sales.columns:
            continue
        if column:
            f, t, order = dimension_facts(sales, column), A.by_dimension(sales, column), [F.col("revenue").desc(), F.col("value").asc()]
        elif finding == "top_products":
            f, t, order = top_product_facts(sales, n), A.top_products(sales, n), [F.col("rank").asc()]
        elif finding == "bottom_products":
            f, t, order = bottom_product_facts(sales, n), A.bottom_products(sales, n), [F.col("rank").asc()]
        elif finding == "monthly_trend":
            f, t, order = monthly_facts(sales), A.monthly_trend(sales), [F.col("month").asc()]
        elif finding == "quiet_days":
            f, t, order = weekday_facts(sales), A.quiet_days(sales), [F.col("rank").asc()]
        else:  # the summary has facts alone
            f, t, order = revenue_facts(sales), None, []
        facts.append(f.select(F.lit(label).alias("label"), F.lit("fact").alias("section"), "ord", "key", "text",
                              F.lit(None).cast("double").alias("number")))
        if t is not None:
            tables.append(_cells(t, label, order, rows))
    out = local_df(sales.sparkSession, heads, "label string, section string, ord int, key string, text string, number double")
    for part in [*facts, *tables]:
        out = out.unionByName(part)
    return out


def table_text(table: DataFrame, order: list[Column], rows: int = 10) -> DataFrame:
    """The first ``rows`` rows as right-aligned text, one space between
    columns (``to_string(index=False)`` layout).  Works on a finding table,
    which is small; only ``rows`` rows are gathered."""
    cols = [c for c in table.columns if not c.startswith("_")]  # "_" columns: sort keys only
    head = table.orderBy(*order).limit(rows).withColumn("_i", F.monotonically_increasing_id())
    cells = head.select("_i", *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    widths = cells.agg(*[F.greatest(F.max(F.length(F.col(f"`{c}`"))), F.lit(len(c))).alias(c) for c in cols])
    j = cells.crossJoin(F.broadcast(widths.select(*[F.col(f"`{c}`").alias(f"_w{i}") for i, c in enumerate(cols)])))
    line = F.concat_ws(" ", *[F.lpad(F.coalesce(F.col(f"`{c}`"), F.lit("NaN")), F.col(f"_w{i}"), " ")
                             for i, c in enumerate(cols)])
    header = F.concat_ws(" ", *[F.lpad(F.lit(c), F.col(f"_w{i}"), " ") for i, c in enumerate(cols)])
    body = j.agg(F.first(header).alias("h"),
                 F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("l")))),
                             lambda x: x["l"]).alias("ls"))
    return body.select(F.concat_ws("\n", F.array_prepend("ls", F.col("h"))).alias("table_text"))


def context_text(headline: str, facts: DataFrame, table: DataFrame | None, order: list[Column] | None,
                 guidance: str | None) -> DataFrame:
    """Headline, ``key: value`` facts in order, table text, guidance line."""
    f = facts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key", "text"))),
                                           lambda x: F.concat(x["key"], F.lit(": "), x["text"])), "\n")
                  .alias("facts_text"))
    out = f
    if table is not None:
        out = out.crossJoin(table_text(table, order or []))
    else:
        out = out.withColumn("table_text", F.lit(None).cast("string"))
    parts = [F.lit(headline), F.when(F.col("facts_text") != "", F.col("facts_text")), F.col("table_text")]
    if guidance:
        parts.append(F.lit(f"How to interpret this: {guidance}"))
    return out.select(F.concat_ws("\n", *parts).alias("context"))
