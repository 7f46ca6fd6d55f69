"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Method.  A text is the bag of its word shingles, weighted by how often they occur.
For each of ``samples`` samples and each term, hashes of the two give r and c from
Gamma(2, 1) and b from U(0, 1).  With weight w, t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1); the term of the least a is the sample, written as a hash
of term and t.  Two texts share a sample with the probability of their generalised
Jaccard similarity, the sum of the lesser weights over the sum of the greater.

Scale.  Weights come from one sort of each text's term hashes inside its row; then
terms are exploded and folded to ``samples`` minima per text in the same task, so
one short row per text is shuffled.  Documents meet their neighbours in id order
through range buckets whose first rows are also sent to the bucket before; texts are
shuffled once, and no bucket, and no order over all rows, lies in one task.

Cases.  A null text is empty; a text without words has the all-zero fingerprint and
is like another such text; a text shorter than a shingle is one term; a null id
sorts last; rows that repeat an id follow one another in the order of their text's
hash; a single document is its own neighbour; an empty table gives an empty result;
other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.session import write_and_reload

SAMPLES = 16
SHINGLE_WORDS = 2
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
FIXED = 1 << 23  # ln a in fixed point, so that value and name of a sample fit one long
LOW = (1 << 32) - 1


def _once(c: Column, name: str) -> Column:
    """A generated column: later expressions read it instead of repeating it."""
    return F.explode(F.array(c)).alias(name)


def weighted_terms(bodies: DataFrame, body: str, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """All columns but the text, and ``term`` (a hash) and ``weight`` of each distinct
    shingle of the text; one row of nulls for a text without words."""
    keep = [F.col(c) for c in bodies.columns if c != body]
    words = F.array_remove(F.split(F.col(body), SPACE), "")
    hashed = bodies.select(*keep, _once(F.transform(words, lambda w: F.xxhash64(w)), "_w"))
    if shingle_words > 1:
        follow = lambda i: F.xxhash64(*(F.coalesce(F.get("_w", i + k), F.lit(0)) for k in range(shingle_words)))
        last = F.greatest(F.size("_w") - shingle_words, F.lit(0))
        shingles = F.when(F.size("_w") > 0, F.transform(F.sequence(F.lit(0), last), follow))
    else:
        shingles = F.col("_w")
    ordered = hashed.select(*keep, _once(F.sort_array(F.coalesce(shingles, F.array().cast("array<bigint>"))), "_s"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    runs = ordered.select(*keep, "_s", _once(F.when(F.size("_s") > 0, starts), "_at"))
    pairs = F.transform("_at", lambda a, j: F.struct(F.get("_s", a).alias("term"), (F.coalesce(F.get("_at", j + 1), F.size("_s")) - a).alias("weight")))
    return runs.select(*keep, F.explode_outer(pairs).alias("_p")).select(*keep, F.col("_p.term").alias("term"), F.col("_p.weight").alias("weight"))


def _unit(h: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1) from a 64-bit hash."""
    scale = 2.0 ** -32
    return ((F.shiftrightunsigned(h, 32) + 0.5) * scale, (h.bitwiseAND(F.lit(LOW)) + 0.5) * scale)


def sample(k: int) -> Column:
    """The k-th sample of a row ``(term, ln_weight)``: ln a in fixed point above a 32-bit name."""
    h1 = F.xxhash64("term", F.lit(3 * k))
    h2, h3 = F.xxhash64("term", F.lit(3 * k + 1)), F.xxhash64("term", F.lit(3 * k + 2))
    (u1, u2), (u3, u4), (b, _) = _unit(h1), _unit(h2), _unit(h3)
    r = -F.log(u1 * u2)
    t = F.floor(F.col("ln_weight") / r + b)
    ln_a = F.log(-F.log(u3 * u4)) - r * (t - b + 1)
    name = F.xxhash64(h3, t).bitwiseAND(F.lit(LOW))
    return F.shiftleft(((F.least(F.greatest(ln_a, F.lit(-100.0)), F.lit(100.0)) + 128) * FIXED).cast("long"), 32).bitwiseOR(name)


def fingerprints(bodies: DataFrame, body: str, samples: int = SAMPLES, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """All columns but the text, which together must tell the rows apart, and
    ``s0 .. s{samples-1}``: the names of the samples (0 for a text without words)."""
    keys = [c for c in bodies.columns if c != body]
    terms = weighted_terms(bodies, body, shingle_words).withColumn("ln_weight", F.log(F.col("weight").cast("double")))
    least = terms.groupBy(*keys).agg(*(F.min(F.when(F.col("term").isNotNull(), sample(k))).alias(f"s{k}") for k in range(samples)))
    return least.select(*keys, *(F.coalesce(F.col(f"s{k}").bitwiseAND(F.lit(LOW)), F.lit(0)).alias(f"s{k}") for k in range(samples)))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples."""
    return sum((F.col(f"{a}.s{k}") == F.col(f"{b}.s{k}")).cast("int") for k in range(samples)) / F.lit(float(samples))


def written(side: str, samples: int = SAMPLES) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(f"{side}.s{k}"), 8, "0")) for k in range(samples)))


def _position(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNotNull().alias("has"), F.col(id_col).alias("id"), F.xxhash64("text").alias("th"))


def _bucket(pos: Column, bounds: list[Column]) -> Column:
    """How many bounds lie at or above the position, less one; bounds descend.  Two
    levels, so that a row is compared with about twice the root of their number."""
    step = max(int(len(bounds) ** 0.5), 1)
    coarse = F.array(*bounds[::step])
    groups = F.array(*(F.array(*bounds[i:i + step]) for i in range(0, len(bounds), step)))
    group = F.size(F.filter(coarse, lambda b: b >= pos)) - 1
    return group * step + F.size(F.filter(F.get(groups, group), lambda b: b >= pos)) - 1


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rid, next_rid, id, text, next_text)``: every row with the text of the next one
    by descending id (after the last, the first)."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("pos", _position("id"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = (rows.select("pos").repartitionByRange(n, F.desc("pos"))
              .groupBy(F.spark_partition_id().alias("p")).agg(F.max("pos").alias("first")).orderBy(F.desc("first")).collect())  # n rows
    if not firsts:
        return spark.createDataFrame([], f"rid long, next_rid long, id {rows.schema['id'].dataType.simpleString()}, text string, next_text string")
    kind = rows.schema["pos"].dataType
    bounds = list(dict.fromkeys(r["first"] for r in firsts))
    literal = [F.struct(F.lit(b["has"]).alias("has"), F.lit(b["id"]).cast(kind["id"].dataType).alias("id"), F.lit(b["th"]).alias("th")) for b in bounds]
    p = len(bounds)
    placed = rows.withColumn("bucket", _bucket(F.col("pos"), literal))
    is_first = F.get(F.array(*literal), F.col("bucket")) == F.col("pos")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("extra"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(p)).alias("bucket"), F.lit(True).alias("extra"))
    sent = (placed.withColumn("to", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own))))
            .select("to.bucket", "to.extra", "id", "text", "pos"))
    order = Window.partitionBy("bucket").orderBy("extra", F.desc("pos"))
    last = F.coalesce(F.lead("extra").over(order), F.lit(True))
    first_of_next = F.shiftleft(F.pmod(F.col("bucket") + 1, F.lit(p)).cast("long"), 32) + 1
    return (sent.select("bucket", "extra", "id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"), last.alias("last"))
            .filter("NOT extra").withColumn("rid", F.shiftleft(F.col("bucket").cast("long"), 32) + F.col("rn"))
            .select("rid", F.when(F.col("last"), first_of_next).otherwise(F.col("rid") + 1).alias("next_rid"), "id", "text", "next_text"))


def edit_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", samples: int = SAMPLES, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is replaced by
    as much of the start of the next document, and how like the text is to both."""
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    body = F.struct(F.lit(0).alias("which"), n.alias("n"), F.lit("").alias("sha"), F.col("text").alias("body"))
    other = F.struct(F.lit(1).alias("which"), n.alias("n"), F.sha2(F.col("edited"), 256).alias("sha"), F.col("edited").alias("body"))
    bodies = (with_next(docs, id_col, text_col).withColumn("edited", edited)
              .select("rid", "next_rid", "id", F.explode(F.array(body, other)).alias("b")).select("rid", "next_rid", "id", "b.*"))
    prints = write_and_reload(fingerprints(bodies, "body", samples, shingle_words), "fingerprints")
    own, changed = prints.filter("which = 0"), prints.filter("which = 1")
    return (own.alias("a").join(changed.alias("e"), F.col("a.rid") == F.col("e.rid")).join(own.alias("x"), F.col("a.next_rid") == F.col("x.rid"))
            .select(F.col("a.id").alias(id_col), F.col("a.n").cast("long").alias("n_chars"), F.col("e.sha").alias("edited_sha256"),
                    written("a", samples).alias("fingerprint"), written("e", samples).alias("edited_fingerprint"),
                    likeness("a", "e", samples).alias("near_edited"), likeness("a", "x", samples).alias("near_next")))
