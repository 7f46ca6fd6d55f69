"""Routing on the data side (Q1-Q6): tables of questions, model outputs and
evaluation runs instead of one question at a time."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.functions.text import py_strip
from bookspark.operators import analyses as A
from bookspark.operators import findings as FD
from bookspark.operators.common import reuse

# The eight categories with their descriptions (Q6) and the
# keywords of the dimension hint (Q2), in the reference's order.
CATEGORIES = [
    ("ranking_by_product", "which products earn the most or sell the most, and which to "
     "stock up on"),
    ("worst_by_product", "which products earn the least or barely sell, and which to "
     "drop, discount, or stop carrying"),
    ("monthly_trend", "how revenue is changing over time — growing, shrinking, or "
     "following a seasonal pattern"),
    ("ranking_by_vendor", "comparing vendors, suppliers, branches, or outlets against "
     "each other"),
    ("ranking_by_channel", "comparing sales channels against each other — app, "
     "walk-in, phone, online, in-store, delivery"),
    ("ranking_by_payment", "comparing payment methods against each other — cash, "
     "transfer, card, POS"),
    ("quiet_days", "which day of the week does best or worst — including when the "
     "shop is emptiest, or when to close early or cut staff hours"),
    ("revenue_summary", "the overall totals and general performance of the business, "
     "the big picture rather than any one slice of it"),
]
LABELS = [k for k, _ in CATEGORIES]
HINT_WORDS = [
    ("ranking_by_vendor", ["vendor", "vendors", "branch", "branches", "outlet", "outlets",
                           "supplier", "suppliers"]),
    ("ranking_by_channel", ["channel", "channels", "app", "walk-in", "walk in", "walkin",
                            "online", "in-store", "in store", "delivery"]),
    ("ranking_by_payment", ["payment", "payments", "paying", "paid", "cash", "transfer",
                            "card", "pos"]),
]


def categories(spark) -> DataFrame:
    """Q6: the category reference table."""
    from bookspark.session import local_df
    return local_df(spark, [(i, k, d) for i, (k, d) in enumerate(CATEGORIES)],
                    "ord int, label string, description string")


def dimension_hint(question: Column) -> Column:
    """Q2: first dimension whose keyword is a substring of the lower-cased question."""
    q = F.lower(question)
    out = F.lit(None).cast("string")
    for label, words in reversed(HINT_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def parse_label(output: Column) -> Column:
    """Q3: text after ``</think>``, lower-cased, first word stripped of
    ``:.,``; NULL unless one of the eight labels."""
    text = F.lower(py_strip(F.when(output.contains("</think>"),
                                   F.regexp_replace(output, r"(?s)^.*?</think>", "")).otherwise(output)))
    first = F.regexp_replace(F.regexp_extract(text, r"^(\S+)", 1), r"^[:.,]+|[:.,]+$", "")
    return F.when(first.isin(LABELS), first)


def routing_eval(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q4 over ``(question, expected, got, seconds[, run])``: per-category
    correct/total/accuracy, overall accuracy with latency, and the misses."""
    ok = F.coalesce(F.col("got") == F.col("expected"), F.lit(False))
    per = results.groupBy("expected").agg(
        F.count_if(ok).alias("correct"), F.count(F.lit(1)).alias("total"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("accuracy"))
    overall = results.agg(
        F.count_if(ok).alias("correct"), F.count(F.lit(1)).alias("total"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("accuracy"),
        F.avg("seconds").alias("mean_seconds"), F.sum("seconds").alias("total_seconds"))
    misses = results.filter(~ok).select("question", "expected", "got")
    return per, overall, misses


def routing_stability(results: DataFrame) -> DataFrame:
    """Q5 over ``(run, question, expected, got)``: median run score and the
    number of questions whose answer changes between runs."""
    ok = F.coalesce(F.col("got") == F.col("expected"), F.lit(False))
    runs = results.groupBy("run").agg(F.count_if(ok).alias("score"))
    med = runs.agg(F.percentile("score", 0.5).alias("median_score"), F.count(F.lit(1)).alias("runs"))
    flaky = (results.groupBy("question").agg(F.count_distinct(F.coalesce("got", F.lit("<none>"))).alias("_n"))
                    .agg(F.count_if(F.col("_n") > 1).alias("flaky_questions")))
    return med.crossJoin(flaky)


# Q1: label -> analysis on a clean sales DataFrame (vendor/channel/payment use A13).
HANDLERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ranking_by_product": lambda df: A.top_products(df, 5),
    "worst_by_product": lambda df: A.bottom_products(df, 5),
    "monthly_trend": A.monthly_trend,
    "ranking_by_vendor": lambda df: A.by_dimension(df, "vendor"),
    "ranking_by_channel": lambda df: A.by_dimension(df, "channel"),
    "ranking_by_payment": lambda df: A.by_dimension(df, "payment_method"),
    "quiet_days": A.quiet_days,
    "revenue_summary": A.revenue_summary,
}


def dispatch(sales: DataFrame, questions: DataFrame) -> dict[str, DataFrame]:
    """Q1 for a table of ``(question_id, question, label)``: each analysis
    runs once for all questions carrying its label (the label set is the
    eight fixed names, collected as metadata); questions whose label is NULL
    or unknown go to retrieval (R5).  A dimension that the sales table lacks gives
    an empty finding and leaves the other answers alone."""
    labels = [r[0] for r in questions.filter(F.col("label").isin(LABELS)).select("label").distinct().collect()]
    return {lab: HANDLERS[lab](sales) if FD.DIMENSIONS.get(lab, "date") in sales.columns
            else HANDLERS[lab](sales.withColumn(FD.DIMENSIONS[lab], F.lit(None).cast("string")).limit(0)) for lab in labels}


def asked_labels(questions: DataFrame) -> list[str]:
    """The labels that questions carry, among the eight (at most eight rows)."""
    asked = {r[0] for r in questions.filter(F.col("label").isin(LABELS)).select("label").distinct().collect()}
    return [label for label in LABELS if label in asked]


def answer_figures(sales: DataFrame, questions: DataFrame) -> DataFrame:
    """Q1 in full: every labelled question of ``(question_id, label)`` with the whole of
    its finding, one row per fact and table cell.  The store is bounded and broadcast."""
    store = reuse(FD.finding_store(sales, asked_labels(questions)))
    return questions.select("question_id", "label").join(F.broadcast(store), "label")


def answer_questions(sales: DataFrame, index, questions: DataFrame, top_k: int = 50,
                     id_col: str = "_row") -> DataFrame:
    """Entry 2 in batch: ``questions(question_id, text, label)``, one row per question.
    Questions with one of the eight labels get the headline of their finding, the
    summary of the rows it rests on (all), and the leading row of its table; each
    analysis runs once (:func:`answer_figures` has the whole findings).  The others are
    answered by retrieval: the summary of their ``top_k`` BM25 rows, or of all rows
    when nothing matches (R5).  Equal texts are searched once."""
    from bookspark.operators.retrieval import SUMMARY, retrieval_summary
    known = F.col("label").isin(LABELS)
    store = reuse(FD.finding_store(sales, asked_labels(questions)))
    cell = lambda key, what: F.max(F.when((F.col("section") == "table") & (F.col("ord") == 1) & F.col("key").isin(key), F.col(what)))
    leads = store.groupBy("label").agg(
        F.max(F.when(F.col("section") == "headline", F.col("text"))).alias("headline"),
        cell(["product", "value", "month_label", "weekday"], "text").alias("lead"),
        cell(["revenue"], "number").cast("decimal(38,2)").alias("lead_revenue"))
    whole = reuse(A.full_summary(sales))
    routed = (questions.filter(known).select("question_id", "label").join(F.broadcast(leads), "label").crossJoin(F.broadcast(whole))
              .select("question_id", "label", F.lit("analysis").alias("route"), "headline", *SUMMARY, "lead", "lead_revenue"))
    rest = reuse(questions.filter(~F.coalesce(known, F.lit(False))).select("question_id", F.coalesce("text", F.lit("")).alias("query_id")))
    asked = rest.select("query_id").distinct().withColumn("text", F.col("query_id"))
    summary = retrieval_summary(sales, index, asked, top_k=top_k, id_col=id_col)
    retrieved = rest.join(summary, "query_id").select(
        "question_id", F.lit(None).cast("string").alias("label"), F.lit("retrieval").alias("route"), "headline", *SUMMARY,
        F.lit(None).cast("string").alias("lead"), F.lit(None).cast("decimal(38,2)").alias("lead_revenue"))
    return routed.unionByName(retrieved)
