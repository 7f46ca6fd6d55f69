"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

Method.  An interpolated modified Kneser-Ney model of n-grams of UTF-8 bytes is
trained on trusted documents: every script is told apart, none shares a symbol, and
no language's letters depend on how frequent others are.  Counts, continuation counts, discounts and backoff weights come from joins
of count tables that are sharded by n-gram.  Every document's distinct n-grams,
with their counts, are joined to the same table, first whole, then shorter
wherever the longer one is unseen; the sum gives the document's perplexity.  The
threshold of a language is a quantile of the perplexity of those trusted documents
(one of ``FOLDS``, by hash, and those beyond the bound) that training does not see, and a margin that shrinks with the root of
their number, so that few documents set no tight bound; documents above it are
rejected.

Scale.  Training reads every trusted document that thresholds do not hold out (a caller may
bound them by ``max_trusted``: smallest hash first, the others then serve the thresholds).
Thresholds rest on all other trusted documents, however many; all ids are joined.  The model
grows with the distinct n-grams of the trusted text; it is broadcast when its counted rows are
at most ``BROADCAST_ROWS``, and joined by shuffle beyond; so are the ids that training reads
(``BROADCAST_IDS``) and the rejected ids (``BROADCAST_REJECTED``), so that texts are shuffled only beyond these.  A document's n-grams are
summed in the task that scans it; one row per document is shuffled.  Quantiles
come from counts per language and perplexity bin, not from sorted documents.

Cases.  Null and empty texts have no perplexity and are kept, as are documents
of a null language or one without trusted documents, and all documents if there
is no trusted text; null labels are not trusted; repeated rows are judged alike;
an empty table gives an empty result; other columns pass through or are not read.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.llm.text import to_bytes
from bookspark.session import write_and_reload

ORDER = 4
SYMBOLS = 256
PAD = 0xFF  # no UTF-8 text holds this byte
BROADCAST_ROWS = 4_000_000
BROADCAST_IDS, BROADCAST_REJECTED = 4_000_000, 2_000_000  # ids alone; ids with language and text hash
QUANTILE = 0.99
FOLDS = 4
MARGIN = 1.0  # nats, divided by the root of the number of documents a threshold rests on
BIN = 1e-3  # width of a bin of log-perplexity
GRAM_BITS = 0xFFFFFFFF  # four bytes
GRAMS_AT_ONCE, DOCUMENTS_AT_ONCE = 1_000_000, 500


# --- n-grams --------------------------------------------------------------------

def _codes(text: str | None, order: int) -> np.ndarray:
    """The n-gram that ends at each byte of the text, in base ``SYMBOLS``."""
    symbols = np.frombuffer(bytes([PAD]) * (order - 1) + to_bytes(text), np.uint8).astype(np.int64)
    n = len(symbols) - order + 1
    code = symbols[:n]
    for i in range(1, order):
        code = code * SYMBOLS + symbols[i:i + n]
    return code


def _count_grams(batches, order: int):
    codes, held = [], 0

    def folded():
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["gram", "c"])

    for batch in batches:
        for text in batch.column(0):
            if text.as_py():
                codes.append(_codes(text.as_py(), order))
                held += len(codes[-1])
            if held > GRAMS_AT_ONCE:
                yield folded()
                codes, held = [], 0
    if codes:
        yield folded()


# --- model ----------------------------------------------------------------------

def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    ratio = [(2 * n2 / n1) if n1 else 0.0, (3 * n3 / n2) if n2 else 0.0, (4 * n4 / n3) if n3 else 0.0]
    return tuple(min(max(k - y * r if r else k * 0.5, 0.1), k - 0.05) for k, r in zip((1, 2, 3), ratio))


def _key(order: int, gram: Column) -> Column:
    """N-grams of all orders in one column."""
    return gram + F.lit(order << 40)


def kneser_ney(counts: DataFrame, order: int = ORDER, symbols: int = SYMBOLS) -> DataFrame:
    """``(key, logp, back)`` from counts ``(gram, c)`` of the highest order: the
    interpolated log-probability of each seen n-gram of every order, and the log
    weight with which it, as a context, passes on to the next shorter one."""
    spark = counts.sparkSession
    tables = {order: counts.select("gram", "c")}
    for k in range(order - 1, 0, -1):  # continuation counts
        tables[k] = write_and_reload(tables[k + 1].groupBy((F.col("gram") % symbols**k).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "kn-counts")
    model = spark.range(1).select(_key(0, F.col("id")).alias("key"), F.lit(-float(np.log(symbols))).alias("logp"), F.lit(None).cast("double").alias("back"))
    lower = spark.range(1).select(F.col("id").alias("short"), F.lit(1.0 / symbols).alias("low"))
    for k in range(1, order + 1):
        table = tables[k]
        seen = table.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first()
        d1, d2, d3 = discounts(*seen)
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        table = table.withColumn("d", d).withColumn("context", F.floor(F.col("gram") / symbols)).withColumn("short", F.col("gram") % symbols ** (k - 1))
        contexts = table.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        p = write_and_reload(
            table.join(contexts, "context").join(lower, "short")
            .select("gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("low")).alias("p")), "kn-order")
        grams = p.select(_key(k, F.col("gram")).alias("key"), F.log("p").alias("logp"))
        backs = contexts.select(_key(k - 1, F.col("context")).alias("key"), F.log("gamma").alias("back_"))
        model = (model.unionByName(grams.withColumn("back", F.lit(None).cast("double")))
                 .join(backs, "key", "full").select("key", "logp", F.coalesce("back", "back_").alias("back")))
        lower = p.select(F.col("gram").alias("short"), F.col("p").alias("low"))
    return write_and_reload(model, "kn-model")


# --- perplexity -----------------------------------------------------------------

def _document_grams(batches, order: int):
    for whole in batches:
        for start in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
            batch = whole.slice(start, DOCUMENTS_AT_ONCE)
            grams, counts = [], []
            for text in batch.column(3):
                gram, n = np.unique(_codes(text.as_py(), order), return_counts=True)
                grams.append(gram.astype(np.uint32).view(np.int32))  # the low 32 bits; GRAM_BITS undoes the sign
                counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(grams, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                ["_id", "_lang", "_hash", "_grams", "_counts"])


def _joined(rows: DataFrame, model: DataFrame, order: int, idle: Column) -> DataFrame:
    """Adds ``lp``: the log-probability of ``_gram``, by joins from the whole n-gram
    down to the first suffix that was seen.  A found row joins on with the key
    ``idle``, which no n-gram has."""
    rows = rows.withColumn("lp", F.lit(None).cast("double")).withColumn("weight", F.lit(0.0))
    for k in range(order, -1, -1):
        gram = F.col("_gram") % SYMBOLS**k
        open_ = F.col("lp").isNull()
        found = model.filter("logp IS NOT NULL").select(F.col("key").alias("k1"), "logp")
        rows = (rows.withColumn("k1_", F.when(open_, _key(k, gram)).otherwise(idle))
                .join(found, F.col("k1_") == F.col("k1"), "left")
                .withColumn("lp", F.coalesce("lp", F.col("weight") + F.col("logp"))).drop("k1", "k1_", "logp"))
        if k:
            back = model.filter("back IS NOT NULL").select(F.col("key").alias("k2"), "back")
            rows = (rows.withColumn("k2_", F.when(F.col("lp").isNull(), _key(k - 1, F.floor(gram / SYMBOLS))).otherwise(idle))
                    .join(back, F.col("k2_") == F.col("k2"), "left")
                    .withColumn("weight", F.col("weight") + F.coalesce("back", F.lit(0.0))).drop("k2", "k2_", "back"))
    return rows


class QualityModel:
    """The n-gram table; None without trusted text."""

    def __init__(self, table: DataFrame | None, order: int):
        self.table, self.order = table, order


def train(trusted: DataFrame, text_col: str = "text", order: int = ORDER) -> QualityModel:
    if not 1 <= order <= ORDER:
        raise ValueError(f"n-grams of 1 to {ORDER} bytes")
    texts = trusted.select(trusted[text_col].cast("string").alias("_text"))
    counts = write_and_reload(texts.mapInArrow(partial(_count_grams, order=order), "gram bigint, c bigint")
                              .groupBy("gram").agg(F.sum("c").alias("c")), "kn-counts")
    return QualityModel(None if counts.isEmpty() else kneser_ney(counts, order), order)


def perplexity(docs: DataFrame, model: QualityModel, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang",
               broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(_id, _lang, _hash, log_perplexity)`` of every distinct id, language and text;
    rows that repeat all three are summed together, which leaves the mean as it is."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("_id"), docs[lang_col].cast("string").alias("_lang"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    keys = ["_id", "_lang", "_hash"]
    if model.table is None:
        return rows.select(*keys).distinct().withColumn("log_perplexity", F.lit(None).cast("double"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _lang string, _hash bigint, _grams array<int>, _counts array<int>"
    grams = (rows.mapInArrow(partial(_document_grams, order=model.order), schema)
             .select(*keys, F.explode_outer(F.arrays_zip("_grams", "_counts")).alias("_g"))
             .select(*keys, F.col("_g._grams").cast("long").bitwiseAND(F.lit(GRAM_BITS)).alias("_gram"), F.col("_g._counts").cast("long").alias("_n")))
    if model.table.count() <= broadcast_rows:
        joined = _joined(grams, F.broadcast(model.table), model.order, F.lit(None).cast("bigint"))
    else:  # found rows spread over the shuffle instead of meeting under one null
        joined = _joined(grams, model.table, model.order, -1 - F.pmod(F.xxhash64("_hash", "_gram"), F.lit(1 << 40)))
    return (joined.groupBy(*keys)
            .agg((-F.sum(F.col("_n") * F.col("lp")) / F.sum("_n")).alias("log_perplexity")))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(_lang, threshold)``: the upper edge of the bin in which the quantile of each
    language lies, plus ``MARGIN`` over the root of the number of documents."""
    bins = (scored.filter("log_perplexity IS NOT NULL AND _lang IS NOT NULL")
            .groupBy("_lang", F.floor(F.col("log_perplexity") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    up_to = Window.partitionBy("_lang").orderBy("bin")
    return (bins.withColumn("below", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(Window.partitionBy("_lang")))
            .filter(F.col("below") >= F.ceil(F.col("all") * quantile))
            .groupBy("_lang").agg(((F.min("bin") + 1) * F.lit(BIN) + F.lit(MARGIN) / F.sqrt(F.max("all"))).alias("threshold")))


def _small(ids: DataFrame, broadcast_rows: int = BROADCAST_IDS) -> DataFrame:
    """A written or counted table of ids, broadcast up to a bound on its rows, so that texts need no shuffle."""
    return F.broadcast(ids) if ids.count() <= broadcast_rows else ids


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang",
             order: int = ORDER, quantile: float = QUANTILE, max_trusted: int | None = None) -> DataFrame:
    """``(_id, _lang, _hash, perplexity, threshold, keep)`` of every distinct id, language and text.
    Trusted are the documents with quality 1 that are not toxic."""
    trusted_ids = write_and_reload(
        labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_trusted")).distinct(), "trusted")
    unseen = F.pmod(F.xxhash64("_trusted", F.lit("unseen by training")), F.lit(FOLDS)) == 0
    learnt = trusted_ids.filter(~unseen)
    if max_trusted is not None:
        learnt = write_and_reload(learnt.orderBy(F.xxhash64("_trusted"), "_trusted").limit(max_trusted), "learnt")
    model = train(docs.join(_small(learnt), docs[id_col] == F.col("_trusted"), "left_semi"), text_col, order)
    scored = write_and_reload(perplexity(docs, model, text_col, id_col, lang_col), "perplexity")
    judged = trusted_ids.join(learnt, "_trusted", "left_anti")
    limits = thresholds(scored.join(judged, F.col("_id") == F.col("_trusted"), "left_semi"), quantile)
    keep = F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True))
    return (scored.join(limits, "_lang", "left")
            .select("_id", "_lang", "_hash", F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("threshold"), keep.alias("keep")))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", **settings) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    rejected = _small(write_and_reload(classify(docs, labels, text_col, id_col, lang_col, **settings).filter("NOT keep").select("_id", "_lang", "_hash"), "rejected"),
                      BROADCAST_REJECTED)
    text = docs[text_col].cast("string")
    same = (docs[id_col].eqNullSafe(rejected["_id"]) & docs[lang_col].cast("string").eqNullSafe(rejected["_lang"])
            & (F.xxhash64(text) == rejected["_hash"]))
    return docs.join(rejected, same, "left_anti")
