"""Driver tables and the sales tables we derive from them.

Every derived table is a lazy DataFrame over the Parquet inputs, so column
pruning and filters reach the scans and its size grows with the inputs.

``sales``      canonical typed sales rows (one per lineitem).
``sales_raw``  the same rows as a messy multi-shop export: all text, mixed
               date formats, currency text, padded upper-case products,
               category variants, blanks, wrong totals and exact duplicates,
               chosen deterministically from the row key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.session import ensure_parallel, write_and_reload

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the messy export (the variants the reference's sample
# generator writes for channel and payment method).
CHANNEL_VARIANTS = ["app", "App", "APP", "walk-in", "Walk In", "walkin", "phone", "Phone"]
PAYMENT_VARIANTS = ["transfer", "Transfer", "cash", "Cash", "card", "POS", "pos"]

# Header of the messy export, as a shop's spreadsheet would have it.
RAW_COLUMNS = ["Date", "order id", "Product ", "Qty", "Unit Price (NGN)", "Total",
               "Vendor", "channel", "Payment Method"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def _unit_cents(total_cents: Column, qty: Column) -> Column:
    """round-half-up(total / qty) in cents with integer arithmetic only, so
    every engine produces the same digits."""
    q = qty.cast("bigint")
    return F.floor((total_cents * 2 + q) / (q * 2)).cast("bigint")


def _decimal_text(cents: Column) -> Column:
    """cents -> '1234.50'."""
    return F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def _grouped_text(cents: Column) -> Column:
    """cents -> '1,234.50'."""
    return F.concat(F.format_number((cents / 100).cast("bigint"), 0), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the order, part and supplier columns the sales tables use.

    No join hints: part/supplier/orders grow with the scale factor, so the
    planner (and AQE at runtime) picks broadcast only from measured sizes."""
    li = ensure_parallel(load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey)
              .join(s, li.l_suppkey == s.s_suppkey))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical sales rows: order_id, date, product, qty, unit_price, total,
    vendor, channel, payment_method."""
    j = _joined(spark, sf_dir)
    total_cents = _cents(F.col("l_extendedprice"))
    return j.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("p_name").alias("product"),
        F.col("l_quantity").alias("qty"),
        (_unit_cents(total_cents, F.col("l_quantity")) / 100.0).alias("unit_price"),
        F.col("l_extendedprice").alias("total"),
        F.col("s_name").alias("vendor"),
        F.col("o_orderpriority").alias("channel"),
        F.col("o_orderstatus").alias("payment_method"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"),
    )


def sales_once(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """``sales`` (or some of its columns) written to the shared folder: queries that read the
    rows several times join the driver tables once."""
    rows = sales(spark, sf_dir)
    return write_and_reload(rows.select(*columns) if columns else rows, "sales")


def sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy export: ``_file``, ``_row`` and the text columns of RAW_COLUMNS."""
    j = _joined(spark, sf_dir)
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    d = F.to_date("l_shipdate")
    slash = F.when(F.col("s_nationkey") % 2 == 1, F.date_format(d, "MM/dd/yyyy")) \
             .otherwise(F.date_format(d, "dd/MM/yyyy"))
    date_text = (F.when(k % 211 == 0, F.lit("not a date"))
                  .when(k % 100 < 80, slash)
                  .when(k % 100 < 92, F.date_format(d, "dd-MMM-yyyy"))
                  .otherwise(F.date_format(d, "yyyy-MM-dd")))
    total_cents = _cents(F.col("l_extendedprice"))
    unit_cents = _unit_cents(total_cents, F.col("l_quantity"))
    unit_text = F.when(k % 25 == 0, F.concat(F.lit("NGN"), _grouped_text(unit_cents))) \
                 .otherwise(_decimal_text(unit_cents))
    total_text = _decimal_text(F.when(k % 997 == 0, total_cents * 2).otherwise(total_cents))
    channel = F.when(k % 37 == 0, F.lit(None).cast("string")).otherwise(
        F.element_at(F.array(*[F.lit(v) for v in CHANNEL_VARIANTS]), (k % 8 + 1).cast("int")))
    payment = F.when(k % 33 == 0, F.lit(None).cast("string")).otherwise(
        F.element_at(F.array(*[F.lit(v) for v in PAYMENT_VARIANTS]), (k % 7 + 1).cast("int")))
    product = F.when(k % 10 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit("  "))) \
               .otherwise(F.col("p_name"))
    base = j.select(
        F.concat(F.lit("shop_"), F.col("s_nationkey").cast("string")).alias("_file"),
        k.alias("_k"),
        date_text.alias("Date"),
        F.col("l_orderkey").cast("string").alias("order id"),
        product.alias("Product "),
        F.col("l_quantity").cast("bigint").cast("string").alias("Qty"),
        unit_text.alias("Unit Price (NGN)"),
        total_text.alias("Total"),
        F.col("s_name").alias("Vendor"),
        channel.alias("channel"),
        payment.alias("Payment Method"),
    )
    # Exact copies of some rows, appended after the originals (later _row); made from the
    # joined row, so the joins run once.
    rows = F.when(F.col("_k") % 401 == 0, F.array(F.col("_k") * 2, F.col("_k") * 2 + 1)).otherwise(F.array(F.col("_k") * 2))
    return base.select("_file", F.explode(rows).alias("_row"), *[F.col(f"`{c}`") for c in RAW_COLUMNS])


# Headers of the mixed export by shop number modulo 4: header name -> column of sales_raw.
MIXED_HEADERS = [
    {c: c for c in RAW_COLUMNS},
    {"Day": "Date", "Receipt No": "order id", "Goods": "Product ", "Pieces": "Qty", "Price": "Unit Price (NGN)",
     "Amount": "Total", "Vendor": "Vendor", "channel": "channel", "Payment Method": "Payment Method"},
    {"Rate": "Unit Price (NGN)", "Item": "Product ", "Date": "Date", "Amount": "Total", "Quantity": "Qty", "channel": "channel"},
    {"Date": "Date", "Qty": "Qty", "Total": "Total"},
]


def sales_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales_raw`` as shops with headers of their own, in one frame: other names
    and orders, shops without order id or vendor (which keep a ``_note``), and shops
    that lack required columns."""
    raw = sales_raw(spark, sf_dir)
    kind = F.regexp_extract("_file", r"(\d+)$", 1).cast("int") % len(MIXED_HEADERS)
    names = list(dict.fromkeys(c for h in MIXED_HEADERS for c in h))
    def value(name):
        return F.coalesce(*[F.when(kind == i, F.col(f"`{h[name]}`")) for i, h in enumerate(MIXED_HEADERS) if name in h]).alias(name)
    note = F.when(kind == 2, F.concat(F.lit("note-"), (F.floor(F.col("_row") / 2) % 3).cast("string")))
    return raw.select("_file", "_row", *[value(n) for n in names], note.alias("_note"))


def narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrations over the canonical ``sales`` table (see narrations_from)."""
    return narrations_from(sales(spark, sf_dir))


def narrations_from(s: DataFrame) -> DataFrame:
    """(id, context, answer1, answer2) per (vendor, product): a finding context
    with real figures and two generated-looking answers, some of whose
    figures are altered by a rule on the key (the answers a model might give).
    ``answer2`` is missing for some rows (no retry generated yet)."""
    from bookspark.operators.common import money_sum
    g = s.groupBy("vendor", "product").agg(
        money_sum("total").alias("revenue"), F.count(F.lit(1)).alias("orders"),
        F.sum("qty").alias("units"))
    rev = F.floor("revenue").cast("bigint")
    key = F.col("orders")
    context = F.concat(
        F.lit("Sales of "), F.col("product"), F.lit(" via "), F.col("vendor"),
        F.lit("\nrevenue: NGN "), F.format_number(rev, 0),
        F.lit("\norders: "), F.format_number(F.col("orders"), 0),
        F.lit("\nunits: "), F.format_string("%.1f", F.col("units")))
    rev1 = F.when(key % 3 == 0, rev + 1000).otherwise(rev)
    answer1 = F.concat(
        F.lit("You earned NGN "), F.format_number(rev1, 0), F.lit(" from "), F.col("product"),
        F.lit(" across "), F.col("orders").cast("string"), F.lit(" orders."))
    units2 = F.when(key % 5 == 0, F.col("units") + 7).otherwise(F.col("units"))
    answer2 = F.when(key % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(
        F.lit("<think>checking</think> Your "), F.col("product"), F.lit(" sales reached NGN "),
        F.format_number(rev, 0), F.lit(" over "), F.col("orders").cast("string"),
        F.lit(" orders, "), F.format_string("%.1f", units2), F.lit(" units in 3 years.")))
    return g.select(F.concat_ws(" | ", "vendor", "product").alias("id"), context.alias("context"),
                    answer1.alias("answer1"), answer2.alias("answer2"))


# Question patterns of the derived routing log, by expected label (alphabetical).
LOG_LABELS = ["monthly_trend", "quiet_days", "ranking_by_channel", "ranking_by_payment",
              "ranking_by_product", "ranking_by_vendor", "revenue_summary", "worst_by_product"]
LOG_QUESTIONS = ["How are we growing?", "When is the shop emptiest?", "Is the App ahead of walk-in?", "Do people pay by CASH?",
                 "What sells best?", "Which branch earns most?", "How are we doing?", "What should I drop?"]


def routing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, run, question, expected, output, seconds): a routing log with one entry per
    turn of ``conversations``; the question, the right label and what a model might
    have written (reasoning, other case, wrong label, prose) follow from the key."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    expected, other = pick(LOG_LABELS, key % 8), pick(LOG_LABELS, (key + 3) % 8)
    output = (F.when(key % 5 == 0, F.concat(F.lit("<think>maybe ranking_by_vendor</think>  "), F.upper(expected), F.lit(":")))
              .when(key % 5 == 1, F.concat(expected, F.lit(".")))
              .when(key % 5 == 2, F.concat(F.lit("I think it is "), expected))
              .when(key % 5 == 3, other).otherwise(F.concat(F.lit(" "), expected, F.lit(" because"))))
    return load(spark, sf_dir, "conversations").select(
        key.alias("id"), (key % 3).cast("int").alias("run"), pick(LOG_QUESTIONS, key % 8).alias("question"),
        expected.alias("expected"), output.alias("output"), ((key % 7) / 2).cast("double").alias("seconds"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales_raw`` as a spreadsheet cell table (_file, sheet, row, col, type,
    value): a title row and a blank-ish note row above the header row, data
    rows after it (row numbers ordered, not dense)."""
    raw = sales_raw(spark, sf_dir)
    packed = F.explode(F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(RAW_COLUMNS)]))
    data = raw.select("_file", (F.col("_row") + 10).cast("int").alias("row"), packed.alias("c")) \
              .select("_file", "row", "c.col", "c.value").filter(F.col("value").isNotNull())
    data = data.withColumn("type", F.when(F.col("value").try_cast("double").isNotNull(), "number")
                                    .otherwise("text"))
    files = raw.select("_file").distinct()
    top = [(0, 0, "text", "Sales export"), (1, 0, "text", "Generated by the till"), (1, 1, "number", "2026")]
    top += [(2, i, "text", c) for i, c in enumerate(RAW_COLUMNS)]
    head = files.crossJoin(F.broadcast(spark.createDataFrame(
        top, "row int, col int, type string, value string")))
    out = head.unionByName(data.select("_file", "row", "col", "type", "value"))
    return out.withColumn("sheet", F.lit("Sales")).select("_file", "sheet", "row", "col", "type", "value")
