"""Outputs (K1-K5): findings and cleaning reports as JSON and as long
report-row tables, written with Spark's writers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.operators.cleaning import MISMATCH_SAMPLE


def finding_json(table: DataFrame, question: str, route: str, headline: str,
                 facts: DataFrame | None = None) -> DataFrame:
    """K1 as JSON lines: one header document (question, route, headline,
    facts; guidance is not included) followed by one document per table
    record, in table order (``ord``).  Records stay distributed: a breakdown
    with millions of values is never gathered into one row or one task."""
    if facts is not None:
        # a finding's few facts, in their own order
        inner = F.transform(F.array_sort(F.collect_list(F.struct("ord", "key", "text"))), lambda x: F.struct(x["key"].alias("key"), x["text"].alias("value")))
        f = facts.agg(F.map_from_entries(inner).alias("facts"))
    else:
        f = table.sparkSession.range(1).select(F.create_map().cast("map<string,string>").alias("facts"))
    head = f.select(F.lit(0).cast("bigint").alias("ord"), F.to_json(F.struct(
        F.lit(question).alias("question"), F.lit(route).alias("route"),
        F.lit(headline).alias("headline"), F.col("facts"))).alias("json"))
    recs = table.select((F.monotonically_increasing_id() + 1).alias("ord"),
                        F.to_json(F.struct(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("record")))
                        .alias("json"))
    return head.unionByName(recs)


def load_report_json(report: DataFrame, mismatches: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """K2: per file: counters, first 5 mismatches, the full mismatch count and
    the mapping, as JSON (the first-5 sample is a map-side limited window)."""
    from pyspark.sql import Window
    w = Window.partitionBy("_file").orderBy("_row", "order_id")
    first5 = (mismatches.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= 5)
                        .groupBy("_file").agg(F.transform(
                            F.array_sort(F.collect_list(F.struct("_k", "order_id", "recorded_total", "expected_total"))),
                            lambda s: F.struct(s["order_id"].alias("order_id"),
                                               s["recorded_total"].alias("recorded_total"),
                                               s["expected_total"].alias("expected_total"))).alias("total_mismatches")))
    r = report.join(first5.withColumnRenamed("total_mismatches", "first_mismatches"), "_file", "left")
    if mapping is not None:
        r = r.join(mapping.groupBy("_file").agg(
            F.map_from_entries(F.collect_list(F.struct("target", "source"))).alias("mapping")), "_file", "left")
    cols = [c for c in r.columns if c != "_file"]
    return r.select("_file", F.to_json(F.struct(*[F.col(c) for c in cols])).alias("json"))


def finding_rows(table: DataFrame, question: str, headline: str, label_col: str | None = None,
                 facts: DataFrame | None = None, narration: str | None = None) -> DataFrame:
    """K3: long report rows (ord, pos, section, label, value): question, headline,
    one row per table record (value = revenue if present, else the second
    column; ``pos`` ascends in the table's order), facts in order, narration."""
    cols = table.columns
    label_col = label_col or cols[0]
    value_col = "revenue" if "revenue" in cols else cols[1]
    spark = table.sparkSession
    head = spark.createDataFrame([(0, 0, "question", "Question", question), (1, 0, "headline", "Headline", headline)],
                                 "ord int, pos bigint, section string, label string, value string")
    body = table.select(F.lit(2).alias("ord"), F.monotonically_increasing_id().alias("pos"), F.lit("table").alias("section"),
                        F.col(label_col).cast("string").alias("label"),
                        F.col(value_col).cast("string").alias("value"))
    out = head.unionByName(body)
    if facts is not None:
        out = out.unionByName(facts.select(F.lit(3).alias("ord"), F.col("ord").cast("bigint").alias("pos"), F.lit("facts").alias("section"),
                                           F.initcap(F.regexp_replace("key", "_", " ")).alias("label"),
                                           F.col("text").alias("value")))
    if narration is not None:
        out = out.unionByName(spark.createDataFrame([(4, 0, "narration", "Narration", narration)], out.schema))
    return out


def cleaning_rows(report: DataFrame, mismatches: DataFrame) -> DataFrame:
    """K4: per file the non-zero counters, blanks per column and the mismatch
    list (first MISMATCH_SAMPLE) or 'No arithmetic mismatches were found.'."""
    def kv(i, label, value):
        return F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), value.cast("string").alias("value"))

    def nz(c):
        return F.when(F.col(c) > 0, F.col(c))

    counters = report.select("_file", F.explode(F.array(
        kv(0, "Rows in file", F.col("rows_in")), kv(1, "Rows kept", F.col("rows_out")),
        kv(2, "Duplicate rows removed", nz("duplicates_removed")),
        kv(3, "Currency text cleaned", nz("currency_stripped")),
        kv(4, "Dates that could not be read", nz("dates_failed")),
    )).alias("r")).select("_file", "r.*").filter(F.col("value").isNotNull())
    blanks = report.select("_file", F.explode("blanks_filled").alias("k", "v")).select(
        "_file", F.lit(5).alias("ord"),
        F.concat(F.lit("Missing "), F.regexp_replace("k", "_", " "), F.lit(" filled")).alias("label"),
        F.col("v").cast("string").alias("value"))
    from pyspark.sql import Window
    w = Window.partitionBy("_file").orderBy("_row", "order_id")
    lines = (mismatches.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= MISMATCH_SAMPLE)
             .select("_file", F.lit(7).alias("ord"), F.col("order_id").alias("label"),
                     F.concat(F.lit("recorded NGN "), F.format_number("recorded_total", 0),
                              F.lit("  should be NGN "), F.format_number("expected_total", 0)).alias("value")))
    header = report.select("_file", F.lit(6).alias("ord"),
                           F.when(F.col("total_mismatches") > 0, F.lit("Entries that don't add up"))
                            .otherwise(F.lit("No arithmetic mismatches were found.")).alias("label"),
                           F.when(F.col("total_mismatches") > 0, F.col("total_mismatches").cast("string")).alias("value"))
    return counters.unionByName(blanks).unionByName(header).unionByName(lines)
