"""Named queries: each takes (spark, sf_dir) and returns a lazy DataFrame over
the whole driver tables (or tables Spark derives from them)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.operators import analyses as A
from bookspark.session import write_and_reload
from bookspark.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ----------------------------------------------------------------- analyses

@register("revenue_summary")
def q_revenue_summary(spark, sf):
    return A.revenue_summary(T.sales(spark, sf))


@register("half_period_change")
def q_half_period_change(spark, sf):
    return A.half_period_change(T.sales(spark, sf))


@register("top_products")
def q_top_products(spark, sf):
    return A.top_products(T.sales(spark, sf), 5)


@register("bottom_products")
def q_bottom_products(spark, sf):
    return A.bottom_products(T.sales(spark, sf), 5)


@register("top_concentration")
def q_top_concentration(spark, sf):
    return A.top_concentration(T.sales(spark, sf), 5)


@register("tail_share")
def q_tail_share(spark, sf):
    return A.tail_share(T.sales(spark, sf), 5)


@register("volume_vs_value")
def q_volume_vs_value(spark, sf):
    return A.volume_vs_value(T.sales(spark, sf))


@register("volume_warning")
def q_volume_warning(spark, sf):
    return A.volume_warning(T.sales(spark, sf), 5)


@register("top_products_by_vendor")
def q_top_products_by_vendor(spark, sf):
    """A3 per scope: top 3 products of every vendor (two-phase top-n)."""
    return A.top_products(T.sales(spark, sf), 3, scope=["vendor"])


@register("monthly_trend")
def q_monthly_trend(spark, sf):
    return A.monthly_trend(T.sales(spark, sf))


@register("monthly_trend_by_vendor")
def q_monthly_trend_by_vendor(spark, sf):
    """A6 per vendor: each vendor's own calendar, so months without sales occur."""
    return A.monthly_trend(T.sales(spark, sf), scope=["vendor"])


@register("monthly_change")
def q_monthly_change(spark, sf):
    return A.monthly_change(A.monthly_trend(T.sales(spark, sf)))


@register("month_extremes")
def q_month_extremes(spark, sf):
    return A.month_extremes(A.monthly_trend(T.sales(spark, sf)))


@register("basket_drift")
def q_basket_drift(spark, sf):
    return A.basket_drift(A.monthly_trend(T.sales(spark, sf)))


@register("by_vendor")
def q_by_vendor(spark, sf):
    return A.by_dimension(T.sales(spark, sf), "vendor")


@register("by_channel")
def q_by_channel(spark, sf):
    return A.by_dimension(T.sales(spark, sf), "channel")


@register("by_payment")
def q_by_payment(spark, sf):
    return A.by_dimension(T.sales(spark, sf), "payment_method")


@register("dimension_flags")
def q_dimension_flags(spark, sf):
    return A.dimension_flags(T.sales(spark, sf), "channel")


@register("quiet_days")
def q_quiet_days(spark, sf):
    return A.quiet_days(T.sales(spark, sf))


@register("weekday_spread")
def q_weekday_spread(spark, sf):
    return A.weekday_spread(T.sales(spark, sf))


@register("weekend_effect")
def q_weekend_effect(spark, sf):
    return A.weekend_effect(T.sales(spark, sf))


# ----------------------------------------------------------------- cleaning

def _clean(spark, sf):
    """sales_raw -> inferred mapping -> clean.  25 nations bound the files."""
    from bookspark.operators import cleaning as C
    return C.clean(T.sales_raw(spark, sf), n_files=25)


@register("clean_rows")
def q_clean_rows(spark, sf):
    return _clean(spark, sf).clean


@register("clean_report")
def q_clean_report(spark, sf):
    return _clean(spark, sf).report.drop("blanks_filled", "columns_renamed")


@register("dedupe_exact")
def q_dedupe_exact(spark, sf):
    from bookspark.operators import cleaning as C
    from bookspark.operators import mapping as M
    raw = T.sales_raw(spark, sf)
    d = C.dedupe(raw.select("_file", "_row", *[F.col(f"`{c}`") for c in M.data_columns(raw)]))
    return d.groupBy("_file").agg(F.sum("_copies").cast("bigint").alias("rows_in"),
                                  F.count(F.lit(1)).alias("distinct_rows"),
                                  F.sum(F.col("_copies") - 1).cast("bigint").alias("duplicates_removed"))


@register("date_order_by_file")
def q_date_order_by_file(spark, sf):
    from bookspark.operators import cleaning as C
    raw = T.sales_raw(spark, sf)
    d = C.dedupe(raw.withColumnRenamed("Date", "date"))
    return C.date_order_stats(d)


@register("parse_mixed_dates")
def q_parse_mixed_dates(spark, sf):
    f = _clean(spark, sf).flagged
    return f.select("_file", "_row", "order_id", "date")


@register("parse_numbers")
def q_parse_numbers(spark, sf):
    return _clean(spark, sf).clean.select("_file", "_row", "qty", "unit_price", "total")


@register("currency_count")
def q_currency_count(spark, sf):
    return _clean(spark, sf).report.select("_file", "currency_stripped")


@register("fill_blanks")
def q_fill_blanks(spark, sf):
    return _clean(spark, sf).report.select(
        "_file", "blanks_product", "blanks_vendor", "blanks_channel", "blanks_payment_method")


@register("normalise_categories")
def q_normalise_categories(spark, sf):
    raw = T.sales_raw(spark, sf)
    from bookspark.functions.text import normalise_category
    from bookspark.operators.cleaning import CHANNEL_ALIASES, PAYMENT_ALIASES, _aliases
    from bookspark.functions.text import py_strip
    parts = []
    for src, name, aliases in (("channel", "channel", CHANNEL_ALIASES),
                               ("Payment Method", "payment_method", PAYMENT_ALIASES)):
        v = F.col(f"`{src}`")
        parts.append(raw.groupBy(v.alias("raw_value")).agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(name).alias("column"), "raw_value",
                             _aliases(normalise_category(py_strip(F.coalesce(F.col("raw_value"), F.lit("unknown")))),
                                      aliases).alias("value"), "rows"))
    return parts[0].unionByName(parts[1])


@register("title_products")
def q_title_products(spark, sf):
    from bookspark.functions.text import collapse_ws, py_strip, py_title
    raw = T.sales_raw(spark, sf)
    g = raw.groupBy(F.col("`Product `").alias("raw_value")).agg(F.count(F.lit(1)).alias("rows"))
    return g.select("raw_value",
                    collapse_ws(py_title(py_strip(F.coalesce("raw_value", F.lit("unknown"))))).alias("product"),
                    "rows")


@register("arithmetic_mismatches")
def q_arithmetic_mismatches(spark, sf):
    return _clean(spark, sf).mismatches


@register("mismatch_sample")
def q_mismatch_sample(spark, sf):
    from bookspark.operators.cleaning import MISMATCH_SAMPLE
    from pyspark.sql import Window
    m = _clean(spark, sf).mismatches
    w = Window.partitionBy("_file").orderBy("_row", "order_id", "recorded_total", "expected_total")
    return m.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= MISMATCH_SAMPLE).drop("_k")


@register("summary_lines")
def q_summary_lines(spark, sf):
    from bookspark.operators import cleaning as C
    return C.summary_lines(_clean(spark, sf).report)


@register("clean_status")
def q_clean_status(spark, sf):
    from bookspark.operators import cleaning as C
    return C.status(_clean(spark, sf).report)


# ---------------------------------------------------------------- retrieval

# Fixed literal questions run against the index (one repeats a term).
SEARCH_QUERIES = [
    (1, "small ring sales in January"),
    (2, "urgent orders paid F on a Friday"),
    (3, "blue bolt blue bolt from Supplier#000000001"),
    (4, "nothing matches zzzz"),
]
DOCUMENT_QUERIES = [
    (1, "the and of"),
    (2, "der die und"),
    (3, "license copyright"),
]


def _queries_df(spark, rows):
    return spark.createDataFrame(rows, "query_id int, text string")


def _sales_docs(spark, sf):
    from bookspark.operators import retrieval as R
    return R.row_documents(T.sales(spark, sf), id_col="line_id")


@register("row_documents")
def q_row_documents(spark, sf):
    return _sales_docs(spark, sf)


@register("bm25_terms")
def q_bm25_terms(spark, sf):
    from bookspark.operators import retrieval as R
    return R.build_index(_sales_docs(spark, sf)).terms


@register("bm25_search")
def q_bm25_search(spark, sf):
    from bookspark.operators import retrieval as R
    idx = R.build_index(write_and_reload(_sales_docs(spark, sf), "documents"))
    return R.search(idx, _queries_df(spark, SEARCH_QUERIES), top_k=20)


@register("bm25_documents")
def q_bm25_documents(spark, sf):
    """BM25 over the whole ``documents`` table (real multi-language text)."""
    from bookspark.operators import retrieval as R
    docs = T.load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    idx = R.build_index(docs)
    return R.search(idx, _queries_df(spark, DOCUMENT_QUERIES), top_k=10)


@register("retrieval_summary")
def q_retrieval_summary(spark, sf):
    from bookspark.operators import retrieval as R
    s = T.sales_once(spark, sf)
    idx = R.build_index(R.row_documents(s, id_col="line_id"))
    return R.retrieval_summary(s, idx, _queries_df(spark, SEARCH_QUERIES), top_k=50, id_col="line_id")


# ------------------------------------------------------------- verification

@register("extract_numbers")
def q_extract_numbers(spark, sf):
    from bookspark.functions.numbers import extract_numbers
    n = T.narrations(spark, sf)
    return n.select("id", F.posexplode(extract_numbers(F.col("answer1"))).alias("pos", "token"))


@register("unsupported_numbers")
def q_unsupported_numbers(spark, sf):
    from bookspark.operators import verify as V
    n = T.narrations(spark, sf)
    return n.select("id", V.unsupported_numbers(F.col("answer1"), F.col("context")).alias("unsupported"))


@register("resolve_attempts")
def q_resolve_attempts(spark, sf):
    from bookspark.operators import verify as V
    r = V.resolve_attempts(T.narrations(spark, sf))
    return r.select("id", "state", "verified", "retried", "unsupported")


@register("flag_text")
def q_flag_text(spark, sf):
    from bookspark.operators import verify as V
    r = V.resolve_attempts(T.narrations(spark, sf))
    return r.filter(F.col("state") == "flagged").select("id", "text")


# ------------------------------------------------------------ sources/sheets

@register("row_profile")
def q_row_profile(spark, sf):
    from bookspark.sources import sheets as S
    return S.row_profile(T.cells(spark, sf))


@register("header_scores")
def q_header_scores(spark, sf):
    from bookspark.sources import sheets as S
    return S.header_scores(T.cells(spark, sf))


@register("sheet_listing")
def q_sheet_listing(spark, sf):
    from bookspark.sources import sheets as S
    return S.sheets(T.cells(spark, sf))


# ------------------------------------------------------------------ mapping

@register("column_profile")
def q_column_profile(spark, sf):
    from bookspark.operators import mapping as M
    return M.column_profile(T.sales_raw(spark, sf)).drop("samples")


@register("column_samples")
def q_column_samples(spark, sf):
    from bookspark.operators import mapping as M
    return M.column_profile(T.sales_raw(spark, sf)).select("_file", "column", "samples")


@register("column_mapping")
def q_column_mapping(spark, sf):
    from bookspark.operators import mapping as M
    raw, headers = M.packed_once(T.sales_raw(spark, sf))
    return M.infer_mapping(raw, headers=headers)


@register("apply_mapping")
def q_apply_mapping(spark, sf):
    from bookspark.operators import mapping as M
    raw, headers = M.packed_once(T.sales_raw(spark, sf))
    return M.apply_mapping(raw, M.selected_mapping(M.infer_mapping(raw, headers=headers)), headers=headers).drop("_present")


def _clean_mixed(spark, sf):
    from bookspark.operators import cleaning as C
    return C.clean(T.sales_mixed(spark, sf))


@register("mixed_mapping")
def q_mixed_mapping(spark, sf):
    """M5-M7 for shops with different headers in one load."""
    from bookspark.operators import mapping as M
    return M.selected_mapping(M.infer_mapping(T.sales_mixed(spark, sf)))


@register("mixed_clean_rows")
def q_mixed_clean_rows(spark, sf):
    return _clean_mixed(spark, sf).clean


@register("mixed_clean_report")
def q_mixed_clean_report(spark, sf):
    return _clean_mixed(spark, sf).report.drop("blanks_filled", "columns_renamed")


@register("file_outcomes")
def q_file_outcomes(spark, sf):
    """Every input file of the mixed load, loaded or rejected, and why."""
    return _clean_mixed(spark, sf).outcomes


# ------------------------------------------------------------------ routing

@register("dimension_hint")
def q_dimension_hint(spark, sf):
    """Q2 over every user turn of ``conversations`` (whole texts)."""
    from bookspark.operators import routing as Q
    c = T.load(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", Q.dimension_hint(F.col("text")).alias("hint"))


@register("parse_label")
def q_parse_label(spark, sf):
    """Q3 over every assistant turn of ``conversations`` (model outputs)."""
    from bookspark.operators import routing as Q
    c = T.load(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", Q.parse_label(F.col("text")).alias("label"))


def _routed(spark, sf):
    from bookspark.operators import routing as Q
    return T.routing_log(spark, sf).withColumn("got", Q.parse_label(F.col("output")))


@register("routed_log")
def q_routed_log(spark, sf):
    """Q2 + Q3 on a routing log whose texts hit every hint and every kind of output."""
    from bookspark.operators import routing as Q
    return _routed(spark, sf).select("id", Q.dimension_hint(F.col("question")).alias("hint"), "got")


@register("routing_by_label")
def q_routing_by_label(spark, sf):
    """Q4 per category."""
    from bookspark.operators import routing as Q
    return Q.routing_eval(_routed(spark, sf))[0]


@register("routing_overall")
def q_routing_overall(spark, sf):
    """Q4 overall."""
    from bookspark.operators import routing as Q
    return Q.routing_eval(_routed(spark, sf))[1]


@register("routing_stability")
def q_routing_stability(spark, sf):
    """Q5."""
    from bookspark.operators import routing as Q
    return Q.routing_stability(_routed(spark, sf))


# -------------------------------------------------------------------- sinks

@register("report_rows")
def q_report_rows(spark, sf):
    from bookspark.sinks import reports as K
    t = A.top_products(T.sales(spark, sf), 5).select("product", "revenue", "units", "orders")
    return K.finding_rows(t, "top products", "Top 5 products by revenue")


@register("cleaning_rows")
def q_cleaning_rows(spark, sf):
    from bookspark.operators import cleaning as C
    from bookspark.sinks import reports as K
    r = C.written_once(_clean(spark, sf))
    return K.cleaning_rows(r.report, r.mismatches)


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """S1-S4, S12 on real files: the messy export is written as CSV folders
    per shop with different delimiters, then profiled (encoding, delimiter,
    container) and read back; rows per shop and delimiter."""
    from bookspark.session import scratch_path
    from bookspark.sources import files as FS
    folder = scratch_path(spark, "exports")
    FS.write_exports(T.sales_raw(spark, sf), folder)
    prof = FS.file_profile(spark, f"{folder}/*/*.csv")
    back = FS.read_csv_files(spark, prof)
    shop = F.regexp_extract("_file", r"shop=([^/]+)/", 1)
    per_file = back.groupBy("_file").agg(F.count(F.lit(1)).alias("rows"))
    j = per_file.join(prof.select(F.col("path").alias("_file"), "delimiter", "encoding", "container"), "_file")
    return j.groupBy(shop.alias("shop"), "delimiter", "encoding", "container").agg(
        F.sum("rows").cast("bigint").alias("rows"))


# ------------------------------------------------------------- files as loaded

CLEAN_COLUMNS = ["order_id", "date", "product", "qty", "unit_price", "total", "vendor", "channel", "payment_method"]


def _raw_cells():
    return [F.col(f"`{c}`") for c in T.RAW_COLUMNS]


@register("mixed_case_load")
def q_mixed_case_load(spark, sf):
    """S1, M8, C15 over files whose headers differ in letter case, one of them holding
    both ``total`` and ``TOTAL``: every file loads as it would alone."""
    from bookspark.plans.load import load_files
    from bookspark.session import scratch_path
    from bookspark.sources import exports as X
    folder = scratch_path(spark, "cases")
    note = F.concat(F.lit("note "), (F.floor(F.col("_row") / 2) % 3).cast("string"))
    X.write_csvs(T.sales_raw(spark, sf), [
        X.Layout(T.RAW_COLUMNS, _raw_cells()), X.Layout([c.upper() for c in T.RAW_COLUMNS], _raw_cells(), ";"),
        X.Layout([*(c.lower() for c in T.RAW_COLUMNS), "TOTAL"], [*_raw_cells(), note], "\t")], folder)
    clean = load_files(spark, f"{folder}/*/*.txt").loaded.clean
    return clean.select(F.regexp_extract("_file", r"shop=([^/]+)/", 1).alias("shop"), *CLEAN_COLUMNS)


@register("xlsx_load")
def q_xlsx_load(spark, sf):
    """S4-S11, C15 over workbooks with typed dates and numbers, a title and a blank row
    above the header, named as if they were text files."""
    from bookspark.operators import cleaning as C
    from bookspark.plans.load import load_files
    from bookspark.session import scratch_path
    from bookspark.sources import exports as X
    folder = scratch_path(spark, "workbooks")
    raw = T.sales_raw(spark, sf)
    day = C.parse_dates(F.col("Date"), X.shop_number(F.col("_file")) % 2 == 0)
    X.write_workbooks(raw, T.RAW_COLUMNS, day, "order id", ["order id", "Qty", "Unit Price (NGN)", "Total"], folder)
    clean = load_files(spark, f"{folder}/*/*.txt").loaded.clean
    order = F.regexp_replace("order_id", r"\.0$", "").alias("order_id")
    return clean.select(F.regexp_extract("_file", r"book=(.+)_\d+/", 1).alias("shop"), order, *CLEAN_COLUMNS[1:])


@register("csv_values")
def q_csv_values(spark, sf):
    """S1-S3 by value: line ends, delimiters and doubled quotes in quoted fields, in
    UTF-8, Windows-1252 and UTF-8 with a byte order mark."""
    from bookspark.session import scratch_path
    from bookspark.sources import exports as X
    from bookspark.sources import files as FS
    folder = scratch_path(spark, "values")
    key = F.concat_ws("-", "`order id`", F.col("_row").cast("string"))
    text = F.concat(F.col("`Product `"), F.lit('\n"x, y; z"\t\u20ac \u201c\u00e9\u201d \u2013\r\n'), F.col("Vendor"))
    cells = [key, text, F.col("Qty")]
    X.write_csvs(T.sales_raw(spark, sf), [X.Layout(["key", "text", "qty"], cells), X.Layout(["key", "text", "qty"], cells, ";", "windows-1252"),
                                          X.Layout(["key", "text", "qty"], cells, "\t", "utf-8-sig")], folder)
    prof = write_and_reload(FS.file_profile(spark, f"{folder}/*/*.txt"), "profile")  # read twice
    kinds = prof.select(F.col("path").alias("_file"), "encoding", "delimiter")
    return FS.read_csv_cells(spark, prof).join(kinds, "_file").select(
        F.regexp_extract("_file", r"shop=([^/]+)/", 1).alias("shop"), F.get("_cells", F.lit(0)).alias("key"), F.get("_cells", F.lit(1)).alias("text"),
        F.get("_cells", F.lit(2)).alias("qty"), "delimiter", "encoding")


@register("load_outcomes")
def q_load_outcomes(spark, sf):
    """Files that load, hold only a header, have no readable date, lack
    columns, have a row too long, or a quoted field that never closes, in one load."""
    from bookspark.plans.load import load_files
    from bookspark.session import scratch_path
    from bookspark.sources import exports as X
    folder = scratch_path(spark, "outcomes")
    names, cells = T.RAW_COLUMNS, _raw_cells()
    X.write_csvs(T.sales_raw(spark, sf), [
        X.Layout(names, cells), X.Layout(names, cells, rows=False), X.Layout(names, [F.lit("never"), *cells[1:]]),
        X.Layout(["Date", "Qty", "Total"], [F.col("Date"), F.col("Qty"), F.col("Total")]),
        X.Layout(names, cells, tail=["1,2,3,4,5,6,7,8,9,10,11"]), X.Layout(names, cells, tail=['1,"2', "3,4"])], folder)
    out = load_files(spark, f"{folder}/*/*.txt").outcomes
    return out.select(F.regexp_extract("_file", r"shop=([^/]+)/", 1).alias("shop"), "status", "error")


def _typed_rows(spark, sf):
    """Ids and numbers in many spellings, by file: 17-digit ids and 1 / 1.0 / 1e0; ids like
    ``12D`` and a text column; ids like ``0x1p3`` and 007 / 7; ids near 2^64 and truth values."""
    li = T.load(spark, sf, "lineitem")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    n, kind = F.floor(F.col("l_orderkey") / 8), F.col("l_partkey") % 4
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % 3 + 1).cast("int"))
    text = lambda c: c.cast("string")
    return li.select(
        F.concat(F.lit("f"), text(kind)).alias("_file"), k.alias("_row"),
        F.when(kind == 0, text(F.lit(12345678901200000) + n)).when(kind == 1, F.concat(text(n), pick(["D", "F", "L"])))
         .when(kind == 2, F.concat(F.lit("0x1p"), text(n % 500))).otherwise(F.concat(F.lit("184467440737095"), F.lpad(text(n % 50000), 5, "0"))).alias("id"),
        F.when(kind == 0, pick(["1", "1.0", "1e0"])).when(kind == 1, F.when(k % 7 == 0, "x").otherwise(pick(["1", "1.0", "2"])))
         .when(kind == 2, pick(["007", "7", "+7"])).otherwise(pick(["TRUE", "true", "False"])).alias("num"))


@register("dedupe_typed")
def q_dedupe_typed(spark, sf):
    """C1, S12 on typed columns: equal numbers are duplicates, ids are never rounded, and
    the first row's own spelling stays."""
    from bookspark.operators import cleaning as C
    return C.dedupe(C.typed_columns(_typed_rows(spark, sf))).select("_file", "_row", "id", "num", F.col("_copies").alias("copies"))


# ----------------------------------------------------------------- findings

@register("finding_facts")
def q_finding_facts(spark, sf):
    """Every analysis's fact sentences over ``sales``."""
    from bookspark.operators import findings as FD
    s = T.sales_once(spark, sf, ["date", "product", "qty", "total", "vendor", "channel", "payment_method"])
    parts = [FD.revenue_facts(s), FD.top_product_facts(s), FD.bottom_product_facts(s),
             FD.monthly_facts(s), FD.dimension_facts(s, "vendor"), FD.dimension_facts(s, "channel"),
             FD.dimension_facts(s, "payment_method"), FD.weekday_facts(s)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("finding_context")
def q_finding_context(spark, sf):
    """The context text of the top-products finding (headline, facts,
    first 10 table rows, guidance) - the grounding handed to a narrator."""
    from bookspark.operators import findings as FD
    s = T.sales(spark, sf)
    t = A.top_products(s, 5).select(
        F.col("rank").alias("_ord"), "product", F.format_number(F.col("revenue").cast("double"), 0).alias("revenue"),
        "units", "orders")
    return FD.context_text("Top 5 products by revenue", FD.top_product_facts(s), t,
                           [F.col("_ord").asc()], A.guidance_for("top_products"))


@register("finding_json")
def q_finding_json(spark, sf):
    """K1: the revenue-by-vendor finding as JSON lines (header + one per record)."""
    from bookspark.operators import findings as FD
    from bookspark.sinks import reports as K
    s = T.sales(spark, sf)
    table = A.by_dimension(s, "vendor").orderBy(F.col("revenue").desc(), F.col("value"))
    return K.finding_json(table, "which vendor sells most?", "ranking_by_vendor", "Revenue by vendor",
                          FD.dimension_facts(s, "vendor"))


@register("answer_questions")
def q_answer_questions(spark, sf):
    """Q1 + Q3 + R5 over ``conversations``: each user turn is a question, the
    next assistant turn is read as a model's label; labelled questions go to
    their analysis, the rest to BM25 retrieval over the sales rows."""
    from bookspark.operators import retrieval as R
    from bookspark.operators import routing as Q
    c = T.load(spark, sf, "conversations")
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    reply = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), Q.parse_label(F.col("text")).alias("label"))
    questions = user.join(reply, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text", "label")
    s = T.sales_once(spark, sf)
    idx = R.build_index(R.row_documents(s, id_col="line_id"))
    return Q.answer_questions(s, idx, questions, top_k=50, id_col="line_id")


def _logged(spark, sf):
    return _routed(spark, sf).select(F.col("id").alias("question_id"), F.col("question").alias("text"), F.col("got").alias("label"))


@register("answer_log")
def q_answer_log(spark, sf):
    """Q1 + Q3 + R5 over the routing log: all eight labels occur, and questions without one."""
    from bookspark.operators import retrieval as R
    from bookspark.operators import routing as Q
    s = T.sales_once(spark, sf)
    idx = R.build_index(R.row_documents(s, id_col="line_id"))
    return Q.answer_questions(s, idx, _logged(spark, sf), top_k=50, id_col="line_id")


@register("answer_figures")
def q_answer_figures(spark, sf):
    """Q1: the table figures of every labelled question of the routing log."""
    from bookspark.operators import routing as Q
    return Q.answer_figures(T.sales_once(spark, sf, ["date", "product", "qty", "total", "vendor", "channel", "payment_method"]), _logged(spark, sf)).filter("section = 'table'").drop("section")


@register("volume_warning_by_year")
def q_volume_warning_by_year(spark, sf):
    """A12 per vendor and year, where low earners that sell many units occur."""
    s = T.sales(spark, sf).withColumn("year", F.year("date"))
    return A.volume_warning(s, 5, scope=["vendor", "year"])


@register("data_gaps")
def q_data_gaps(spark, sf):
    """A15-A17 per file over cleaned rows, whose blank channels count as ``unknown``."""
    return A.dimension_flags(_clean(spark, sf).clean, "channel", scope=["_file"])
