"""Line dedup by an exact set-similarity join, in DataFrame functions only.

Method.  A line is the set of its words.  The words of each line are ordered by
rarity; two lines of Jaccard similarity ``t`` or more share a word among the first
``n - ceil(t * n) + 1`` of each (prefix filter).  Of lines that meet on such a word,
those pass whose lengths fit, whose positions leave room for the overlap, and whose
256-bit word parities do not already differ in more bits than words may differ.  The
rest are verified on the words themselves.  A line goes if it is like an earlier one
(by id, text hash, line number); the earliest stays.

Rarity is measured over all lines: words are hashed to 65,536 buckets, and the tokens
of each are counted.  A word's place is its bucket's power of two, longer words first
within it.  That is one bounded table, and every word's place follows from the word
alone.  Any order gives the same result; one that puts rare words first keeps the list
of a word short.

Scale.  Equal lines are folded first, by partial aggregation, so a line that a third
of all documents share is one row.  Near copies meet the likeliest of the earliest lines
of each of their first words before all others (the very first are often a copy's own);
only lines that this leaves open are joined with the rest of the list, so a large group
of near copies makes about as many pairs as it has lines.
The rest is a self-join on words: each line leaves its prefix once, and both sides
read that one shuffle; a hot word is split by the skew join.  Line texts are read again
for candidates only.  Shuffle files go as soon as the table they served is written.

Cases.  Null and empty texts and lines without words are never removed or matched;
a null id sorts last; rows that repeat id and text are one document and lose the
same lines; an empty table gives an empty result; other columns pass through
``dedup`` unchanged.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.session import write_and_free

THRESHOLD = 0.8
BUCKETS, CLASSES, LENGTHS = 65_536, 16, 64
BROADCAST_LINES = 500_000
LEAD_WORDS, LEADERS = 5, 4
SPACE = "[ \\t\\x0B\\f\\r]+"
EPS = 1e-9


def words(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def _documents(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _lines(documents: DataFrame) -> DataFrame:
    return documents.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _position() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "line_no")


def _bucket(w: Column) -> Column:
    return F.xxhash64(w).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(documents: DataFrame) -> Column:
    """A constant array: the class of each bucket of words by its tokens, rarest first."""
    seen = (documents.select(F.explode(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")).alias("w"))
            .groupBy(_bucket(F.col("w")).alias("bucket")).count().collect())  # at most BUCKETS rows
    size = {r["bucket"]: r["count"].bit_length() for r in seen}
    usual = sorted(size.values())[len(size) // 2] if size else 0
    classes = (min(max(size.get(k, 0) - usual + 2, 0), CLASSES - 1) for k in range(BUCKETS))
    return F.split(F.lit(",".join(map(str, classes))), ",").cast("array<int>")


def place(w: Column, rank: Column) -> Column:
    """The place of a word in the order, below CLASSES * LENGTHS; longer words first within a class."""
    return F.get(rank, _bucket(w)) * LENGTHS + (LENGTHS - F.least(F.octet_length(w), F.lit(LENGTHS)))


def _once(c: Column, name: str) -> Column:
    """A generated column: later expressions read it instead of repeating it."""
    return F.explode(F.array(c)).alias(name)


PARITIES = ["a", "b", "c", "d"]
WIDE_WORDS = 32


def _parity(tokens: str, quarter: int) -> Column:
    """64 bits, each the parity of the words that are hashed to it; a word counts in one of four quarters."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 2).bitwiseAND(F.lit(63)).cast("int"))
    mine = F.filter(tokens, lambda x: x.bitwiseAND(F.lit(3)) == quarter)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x)))


def _overlap(n: Column, m: Column, t: float) -> Column:
    """Common words that lines of n and m words need."""
    return F.ceil((n + m) * F.lit(t / (1 + t)) - EPS)


def distinct_lines(documents: DataFrame, t: float) -> DataFrame:
    """One row per distinct line with words: ``ord`` (ascending with its first position),
    its hash, that position, the number of words, the prefix and the bitmap."""
    rank = rarity(documents)
    low = F.lit((1 << 53) - 1)
    token = F.transform(words(F.col("line")), lambda w: F.shiftleft(place(w, rank).cast("long"), 53).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 8).bitwiseAND(low)))
    n = F.size("tokens")
    a, b, c, d = (_parity("tokens", i) for i in range(4))
    wide = n > WIDE_WORDS  # a short line needs two of the four; zeros cost little in a shuffle
    none = F.lit(0).cast("long")
    of = F.struct(n.alias("n"), F.when(wide, a).otherwise(a.bitwiseXOR(c)).alias("a"), F.when(wide, b).otherwise(b.bitwiseXOR(d)).alias("b"),
                  F.when(wide, c).otherwise(none).alias("c"), F.when(wide, d).otherwise(none).alias("d"),
                  F.transform(F.slice("tokens", 1, n - F.ceil(n * F.lit(t) - EPS).cast("int") + 1), lambda x: F.hash(x)).alias("prefix"))
    folded = (_lines(documents)
              .select("id", "th", "line_no", F.unhex(F.md5("line")).alias("hash"), _once(F.sort_array(F.array_distinct(token)), "tokens"))
              .filter(n > 0).select("hash", _position().alias("first"), of.alias("of"))
              .groupBy("hash").agg(F.min("first").alias("first"), F.first("of").alias("of")))
    ordered = (folded.select("hash", "first", "of.*").repartitionByRange(F.col("first"))
               .sortWithinPartitions("first").withColumn("ord", F.monotonically_increasing_id()))
    return write_and_free(ordered, "lines")


def _differ(x: str, y: str) -> Column:
    """Parities in which two postings differ; their lines differ in as many words or more."""
    d = {k: F.col(f"{x}.{k}").bitwiseXOR(F.col(f"{y}.{k}")) for k in PARITIES}
    return (F.when((F.col(f"{x}.n") > WIDE_WORDS) & (F.col(f"{y}.n") > WIDE_WORDS), sum(F.bit_count(d[k]) for k in PARITIES))
            .otherwise(F.bit_count(d["a"].bitwiseXOR(d["c"])) + F.bit_count(d["b"].bitwiseXOR(d["d"]))))


def _may_match(x: str, y: str, t: float) -> Column:
    """Length, positional and parity filters of two postings."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    need = _overlap(n, m, t)
    room = 1 + F.least(n - F.col(f"{x}.i") - 1, m - F.col(f"{y}.i") - 1)
    return (F.least(n, m) >= F.greatest(n, m) * F.lit(t) - EPS) & (room >= need) & (_differ(x, y) <= n + m - 2 * need)


def _verified(pairs: DataFrame, lines: DataFrame, documents: DataFrame, t: float) -> DataFrame:
    """Of the pairs ``(x, y)`` of ord, those with similarity ``t`` or more."""
    needed = pairs.select(F.explode(F.array("x", "y")).alias("ord")).distinct()
    needed = write_and_free(lines.select("ord", "hash", "first").join(needed, "ord"), "needed-lines")
    wanted = needed.groupBy("first.id", "first.th").agg(F.collect_list(F.struct("first.line_no", "ord")).alias("want"))
    if needed.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    d, k = documents.alias("d"), wanted.alias("k")
    # Rows that repeat id and text give a line more than once.
    texts = write_and_free(
        d.join(k, F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.th") == F.col("k.th")))
        .select(F.split("text", "\n").alias("parts"), F.explode("want").alias("w"))
        .select("w.ord", F.array_distinct(words(F.get("parts", F.col("w.line_no")))).alias("words")).dropDuplicates(["ord"]), "needed-words")
    both = (pairs.join(texts.select(F.col("ord").alias("x"), F.col("words").alias("xw")), "x")
            .join(texts.select(F.col("ord").alias("y"), F.col("words").alias("yw")), "y"))
    return both.filter(F.size(F.array_intersect("xw", "yw")) >= _overlap(F.size("xw"), F.size("yw"), t)).select("x", "y")


def matched_lines(documents: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """``(ord)`` of every distinct line that is like an earlier one."""
    fields = ["ord", "n", "i", *PARITIES]
    heads = (lines.select("ord", "n", *PARITIES, F.posexplode(F.slice("prefix", 1, LEAD_WORDS)).alias("i", "token"))
             .select("token", F.struct(*fields).alias("p")))
    earlier = Window.partitionBy("token").orderBy("p.ord").rowsBetween(Window.unboundedPreceding, -1)
    met = heads.select("p", *[F.nth_value("p", k + 1).over(earlier).alias(f"lead{k}") for k in range(LEADERS)])
    near = lambda lead: F.struct((_differ(lead, "p") / (F.col(f"{lead}.n") + F.col("p.n"))).alias("far"), F.col(f"{lead}.ord").alias("x"))
    # The likeliest leader of each word is enough: what it does not settle stays open.
    best = F.array_min(F.array(*[F.when(_may_match(f"lead{k}", "p", t), near(f"lead{k}")) for k in range(LEADERS)]))
    first = met.select(best["x"].alias("x"), F.col("p.ord").alias("y")).filter("x IS NOT NULL").distinct()
    done = write_and_free(_verified(write_and_free(first, "pairs"), lines, documents, t).select(F.col("y").alias("ord")).distinct(), "matched")

    settled = done.withColumn("settled", F.lit(True))
    if done.count() <= BROADCAST_LINES:
        settled = F.broadcast(settled)
    rows = lines.join(settled, "ord", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    # Of two lines the shorter meets the other on its first words: the room that _may_match asks for says so.
    posting = rows.select("ord", "n", *PARITIES, "settled", F.posexplode("prefix").alias("i", "token"))
    shorter = (F.col("p.n") < F.col("q.n")) | ((F.col("p.n") == F.col("q.n")) & (F.col("p.ord") < F.col("q.ord")))
    open_ = ~F.when(F.col("p.ord") > F.col("q.ord"), F.col("p.settled")).otherwise(F.col("q.settled"))
    rest = (posting.alias("p").join(posting.alias("q"), (F.col("p.token") == F.col("q.token")) & shorter & open_ & _may_match("p", "q", t))
            .select(F.least("p.ord", "q.ord").alias("x"), F.greatest("p.ord", "q.ord").alias("y")).distinct())
    more = _verified(write_and_free(rest, "pairs"), lines, documents, t).select(F.col("y").alias("ord"))
    return done.unionByName(more).distinct()


def removed_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, th, removed)`` of the documents that lose lines: the sorted line numbers."""
    documents = _documents(docs, text_col, id_col)
    lines = distinct_lines(documents, threshold)
    like = matched_lines(documents, lines, threshold).withColumn("like", F.lit(True))
    decided = lines.select("ord", "hash", "first").join(like, "ord", "left").select("hash", "first", F.coalesce("like", F.lit(False)).alias("like"))
    occurrences = _lines(documents).select("id", "th", "line_no", F.unhex(F.md5("line")).alias("hash"))
    gone = (occurrences.join(decided, "hash").filter(F.col("like") | (_position() != F.col("first")))
            .groupBy("id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("removed")))
    return write_and_free(gone, "removed-lines")


def _with_removed(docs: DataFrame, gone: DataFrame, text_col: str, id_col: str) -> DataFrame:
    same = docs[id_col].eqNullSafe(gone["id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["th"])
    return docs.join(gone, same, "left")


def line_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``(id_col, n_lines, n_removed, removed_lines)`` of every row; line numbers count from 0."""
    gone = removed_lines(docs, text_col, id_col, threshold)
    text = docs[text_col].cast("string")
    sizes = docs.select(docs[id_col].alias("_id"), F.xxhash64(text).alias("_th"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("n_lines"))
    removed = F.coalesce(gone["removed"], F.array().cast("array<int>"))
    return (sizes.join(gone, sizes["_id"].eqNullSafe(gone["id"]) & (sizes["_th"] == gone["th"]), "left")
            .select(F.col("_id").alias(id_col), "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed_lines")))


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, with the removed lines taken out of the text."""
    gone = removed_lines(docs, text_col, id_col, threshold)
    parts = F.split(docs[text_col].cast("string"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone["removed"])
    text = F.when(gone["removed"].isNull(), docs[text_col].cast("string")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    return _with_removed(docs, gone, text_col, id_col).select(*(text.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns))
