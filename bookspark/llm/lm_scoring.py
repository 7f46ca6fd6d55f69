"""Language-model scores by a weighted backoff automaton.

Method.  A bigram model with absolute discounts is an automaton.  Its states are
the histories: the start of a text, every training word, and the empty history.
A state has an arc for every word that followed it in training, weighted with the
discounted log-probability, and one failure arc, weighted so that probabilities
sum to one, to the empty history, whose arcs are the unigrams.  The vocabulary is
that of the base model: all training tokens, and one more for all others.

Scale.  Counts cover all training text and every pair of words.  The arcs between
the ``cache_words`` most frequent words are counted first and broadcast, only as a
cache.  A text is traversed once, left to right; the pairs that the cache lacks leave
the task folded, as sorted and compressed blocks of a chunk of texts, one for each
bucket of pairs, and meet there.  The number of buckets follows the training tokens.
A bucket holds its blocks compressed and the counts of its distinct pairs, and
answers block by block, so a frequent pair costs it no memory for each text.  Answers
go back to their chunk in one more, smaller shuffle.  A pair is dealt by its word if
that is not local (so the word's count is known there), else by both its words.
A score is taken apart so that a pair needs its history's failure weight only where
training lacks the pair:
``log p = -log c(h) + log(c(h, w) - d)`` or ``-log c(h) + failure(h) + log p(w)``.
Failure weights of local words are broadcast; only held-out texts ask for others, by a
join.  Rare words stand as 63 bits of their hash.  Texts are not shuffled.

Cases.  A null or empty text is the end token alone; a null id counts as the
empty text when rows are dealt to training; repeated rows train and score like
any other; a text of any length is read in pieces that carry the state; without
training text every token is unknown with probability one; an empty table gives an
empty result; other columns are not read.
"""
from __future__ import annotations

from collections import Counter
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.llm.text import to_bytes, word_pieces
from bookspark.session import write_and_reload

CACHE_WORDS = 4_096
LOCAL_WORDS = 65_536
KEYS_HELD = 200_000
PAIRS_AT_ONCE = 400_000
DOCS_AT_ONCE = 8_192
BUCKET_TOKENS = 2_000_000
END = b"\n"  # no word holds it
EMPTY = -1
START = 1 << 40  # key of the history at the start of a text


def _log10(x: float) -> float:
    return float(np.log10(x)) if x > 0 else -np.inf


def discount(ones: int, twos: int) -> float:
    """Absolute discount estimated from the numbers of n-grams seen once and twice."""
    return min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5


# --- training -------------------------------------------------------------------

def _count_words(batches):
    for batch in batches:
        counts: Counter[bytes] = Counter()
        for text in batch.column(0):
            for words in word_pieces(to_bytes(text.as_py())):
                counts.update(words)
            counts[END] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])


def _ids(words: list[bytes], rank: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((rank.get(w, EMPTY) for w in words), np.int64, len(words))


def _states(before: int, ids: np.ndarray, n_states: int) -> np.ndarray:
    """The state in which each word is read: the word before it, if that is a state."""
    return np.concatenate([[before], np.where(ids[:-1] < n_states, ids[:-1], EMPTY)])


def _count_arcs(batches, words, n_states: int):
    rank = {w: i for i, w in enumerate(words.value)}

    def folded(codes):
        code, count = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(count.astype(np.int64))], ["code", "c"])

    codes, held = [], 0
    for batch in batches:
        for text in batch.column(0):
            state = n_states  # the start
            for piece in [*word_pieces(to_bytes(text.as_py())), [END]]:
                if piece:
                    ids = _ids(piece, rank)
                    states = _states(state, ids, n_states)
                    arcs = (ids >= 0) & (states >= 0)
                    codes.append(states[arcs] * n_states + ids[arcs])
                    held, state = held + len(codes[-1]), int(ids[-1])
            if held > 1_000_000:
                yield folded(codes)
                codes, held = [], 0
    if codes:
        yield folded(codes)


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


# --- all pairs ------------------------------------------------------------------

class WordKeys(dict):
    """The key of a word: its rank if it is local, else a negative hash."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.refill()

    def refill(self):
        self.clear()
        self.update((w, i) for i, w in enumerate(self.words))

    def __missing__(self, word: bytes) -> int:
        if len(self) >= len(self.words) + KEYS_HELD:
            self.refill()
        key = self[word] = ~(int.from_bytes(blake2b(word, digest_size=8).digest(), "little") >> 1)
        return key


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit values of one length, compressed byte plane by byte plane."""
    planes = np.stack([c.view(np.int64) for c in columns]).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(block: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(columns, -1).view(np.int64)


def _mixed(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64 bits that stand for a pair."""
    x = w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (h.astype(np.uint64) + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _doc_type(id_type: pa.DataType) -> pa.DataType:
    return pa.struct([("id", id_type), ("n_tokens", pa.int64()), ("n_local", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("arcs", pa.binary())])


def _pair_batches(batches, model, id_type: pa.DataType):
    """Blocks of the pairs that are not cached arcs, and a row with the rest of each text:
    tokens, weights of its local words, counts of its cached arcs."""
    m = model.value
    s, buckets, keys, codes, arc_counts, base, history = (m["n_states"], m["buckets"], WordKeys(m["words"]), m["arc_codes"], m["arc_counts"],
                                                          m["base"], m["history"])
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("pairs", pa.binary()), ("row", pa.int64()), ("doc", _doc_type(id_type))])
    chunk, docs, parts, waiting = None, [], [], 0

    def blocks():
        row = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(np.int64)
        h, w = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        parts.clear()
        bucket = (_mixed(w, np.where(w < 0, 0, h)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((h, w, bucket))  # stable: rows ascend
        row, h, w, bucket = row[order], h[order], w[order], bucket[order]
        first = _starts(row, h, w, bucket)
        times = np.diff(np.append(first, len(row)))
        row, h, w, bucket = row[first], h[first], w[first], bucket[first]
        at = _starts(bucket)
        packed = [_pack(np.diff(w[i:j], prepend=0), h[i:j], row[i:j], times[i:j]) for i, j in zip(at, np.append(at[1:], len(w)))]
        k = len(at)
        return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), pa.array([chunk] * k, pa.int64()), pa.array(packed, pa.binary()),
                                           pa.nulls(k, pa.int64()), pa.nulls(k, schema.field("doc").type)], schema=schema)

    def rests():
        k = len(docs)
        return pa.RecordBatch.from_arrays([pa.array([-1 - chunk] * k, pa.int64()), pa.array([chunk] * k, pa.int64()), pa.nulls(k, pa.binary()),
                                           pa.array(range(k), pa.int64()), pa.array(docs, schema.field("doc").type)], schema=schema)

    for batch in batches:
        for id_row, id_, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if chunk is None:
                chunk, met = id_row, 0
            tokens = local = 0
            base_sum, score, state, cached = 0.0, m["start"], START, []
            mine = 2 * len(docs) + bool(held)
            for words in [*word_pieces(to_bytes(text.as_py())), [END]]:
                if not words:
                    continue
                w = np.fromiter(map(keys.__getitem__, words), np.int64, len(words))
                h = np.concatenate([[state], w[:-1]])
                known = w[w >= 0]
                base_sum += float(base[known].sum())
                score += float(history[known].sum())
                tokens, local, state = tokens + len(w), local + len(known), int(w[-1])
                code = np.where((w >= 0) & (w < s) & ((h == START) | (h >= 0) & (h < s)), np.where(h == START, s, h) * s + w, -1)
                at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
                arc = (code >= 0) & (codes[at] == code) if len(codes) else np.zeros(len(code), bool)
                cached.append(arc_counts[at[arc]])
                if not arc.all():
                    parts.append((mine, h[~arc], w[~arc]))
                    waiting, met = waiting + len(parts[-1][1]), met + len(parts[-1][1])
                if waiting > PAIRS_AT_ONCE:  # a text folded in pieces only has more blocks
                    yield blocks()
                    waiting = 0
            arc_c, arc_n = np.unique(np.concatenate(cached), return_counts=True)
            docs.append({"id": id_, "n_tokens": tokens, "n_local": local, "base": base_sum, "score": score, "arcs": _pack(arc_c, arc_n)})
            if met > PAIRS_AT_ONCE or len(docs) >= DOCS_AT_ONCE:
                if parts:
                    yield blocks()
                yield rests()
                chunk, docs, waiting = None, [], 0
    if parts:
        yield blocks()
    if docs:
        yield rests()


# --- where pairs meet -----------------------------------------------------------

def _summed(key: np.ndarray, c: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys with their summed counts; of the others, the first of each key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = _starts(key)
    return [key[first], np.add.reduceat(c[order], first), *(x[order][first] for x in others)]


def _block(block: bytes):
    w, h, row, times = _unpack(block, 4)
    return np.cumsum(w), h, row >> 1, times, (row & 1) == 0


def _pair_counts(blocks: list[bytes]) -> list[np.ndarray]:
    """``key, c, w, h`` of the distinct pairs; only they are held, whatever their copies."""
    table, waiting, size = None, [], 0
    for i, block in enumerate(blocks):
        w, h, _, times, trained = _block(block)
        first = _starts(w, h)
        w1, h1 = w[first], h[first]
        waiting.append([_mixed(w1, h1), np.add.reduceat(np.where(trained, times, 0), first), w1, h1])
        size += len(first)
        if size > max(500_000, 0 if table is None else len(table[0])) or i == len(blocks) - 1:
            table = _summed(*(np.concatenate(x) for x in zip(*waiting, *([table] if table else []))))
            waiting, size = [], 0
    return table


ANSWER = [("chunk", pa.int64()), ("row", pa.int64()), ("sums", pa.binary()), ("entries", pa.binary()), ("ask", pa.int64()), ("times", pa.int64()),
          ("h", pa.int64()), ("kinds", pa.float64()), ("used", pa.float64()), ("once", pa.int64()), ("twice", pa.int64())]


def _answers(table: pa.Table, model, id_type: pa.DataType) -> pa.Table:
    """Of one bucket: for each block what its texts gain, for each history its arcs, and
    how many pairs were seen once and twice.  The rests of texts pass unchanged."""
    schema = pa.schema([*ANSWER, ("doc", _doc_type(id_type))])

    def rows(k: int, **columns) -> pa.Table:
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(k, f.type) for f in schema], schema=schema)

    if table["bucket"][0].as_py() < 0:
        rest = table.select(["chunk", "row", "doc"])
        return pa.Table.from_arrays([rest[f.name].cast(f.type) if f.name in rest.column_names else pa.nulls(len(rest), f.type) for f in schema], schema=schema)
    m = model.value
    n, v, d, counts = m["n"], m["v"], m["d"], m["counts"]
    blocks = [b.as_py() for b in table["pairs"]]
    key, c, w, h = _pair_counts(blocks)
    c_w = np.zeros(len(w), np.int64)
    c_w[w >= 0] = counts[w[w >= 0]]
    rare_words, place = np.unique(w[w < 0], return_inverse=True)
    c_w[w < 0] = np.bincount(place, c[w < 0], len(rare_words)).astype(np.int64)[place]
    p_word = np.where(c_w > 0, np.log10(np.maximum(c_w - d, 1e-300) / max(n, 1)), _log10(d * v / n) if n else 0.0)
    own = np.where((w < 0) & (c_w > 0), -np.log10(np.maximum(c_w, 1)), 0.0)  # as the history of what follows
    base = np.where(w < 0, np.log10((c_w + 1) / (n + v + 1)), 0.0)

    seen = c > 0
    states, place = np.unique(h[seen], return_inverse=True)
    out = [rows(1, once=[int((c == 1).sum())], twice=[int((c == 2).sum())]),
           rows(len(states), h=states, kinds=np.bincount(place, minlength=len(states)).astype(np.float64),
                used=np.bincount(place, (c_w[seen] - d) / max(n, 1), len(states)))]
    answered: dict[str, list] = {"chunk": [], "sums": [], "entries": []}
    for chunk, block in zip(table["chunk"].to_pylist(), blocks):
        bw, bh, row, times, _ = _block(block)
        at = np.searchsorted(key, _mixed(bw, bh))
        is_new, unlearnt = c[at] == 0, (bh < 0)
        size = int(row.max()) + 1
        gain = times * (own[at] + np.where(is_new, p_word[at], 0.0))
        known, based, scored = (np.bincount(row, x, size) for x in (np.where((bw < 0) & (c_w[at] > 0), times, 0), times * base[at], gain))
        some = np.flatnonzero((known != 0) | (based != 0) | (scored != 0))
        value = np.where(is_new, -1 - np.where(bh == START, len(counts), bh), c[at])
        listed = ~(is_new & unlearnt)
        code, inverse = np.unique((row[listed] << 46) + value[listed] + (1 << 20), return_inverse=True)
        answered["chunk"].append(chunk)
        answered["sums"].append(_pack(some, known[some], based[some], scored[some]))
        answered["entries"].append(_pack(np.diff(code, prepend=0), np.bincount(inverse, times[listed], len(code)).astype(np.int64)))
        if not listed.all():
            asks = ~listed
            out.append(rows(int(asks.sum()), chunk=np.full(int(asks.sum()), chunk), row=row[asks], ask=bh[asks], times=times[asks]))
    return pa.concat_tables([*out, rows(len(blocks), **answered)])


def _scores(table: pa.Table, model, id_type: pa.DataType) -> pa.Table:
    """Of one chunk: the texts with all that they gained."""
    m = model.value
    d2, failure = m["d2"], m["failure"]
    rest = table.filter(table["doc"].is_valid())
    docs, row = rest["doc"].combine_chunks(), rest["row"].to_numpy()
    size = len(row)
    known, base, score = np.zeros(size), np.zeros(size), np.zeros(size)
    for block in table["sums"].drop_null():
        at, k, b, x = _unpack(block.as_py(), 4)
        for total, gained in ((known, k), (base, b), (score, x)):
            total[at] += gained.view(np.float64)
    for block in table["entries"].drop_null():
        code, times = _unpack(block.as_py(), 2)
        code = np.cumsum(code)
        at, value = code >> 46, (code & ((1 << 46) - 1)) - (1 << 20)
        weight = np.where(value > 0, np.log10(np.maximum(value - d2, 1e-300)), failure[np.maximum(-1 - value, 0)])
        score += np.bincount(at, times * weight, size)
    extra = table.filter(table["extra"].is_valid())
    score += np.bincount(extra["row"].to_numpy(), extra["extra"].to_numpy(), size)
    arcs = [_unpack(a, 2) for a in docs.field("arcs").to_pylist()]
    score[row] += [float((k * np.log10(c - d2)).sum()) for c, k in arcs]
    got = {name: docs.field(name).to_numpy(zero_copy_only=False) for name in ("n_tokens", "n_local", "base", "score")}
    return pa.Table.from_arrays([docs.field("id"), pa.array(got["n_tokens"]), pa.array(got["n_local"] + known[row].astype(np.int64)),
                                 pa.array(got["base"] + base[row]), pa.array(got["score"] + score[row])], ["id", "n_tokens", "n_known", "base_score", "score"])


def score_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", local_words: int = LOCAL_WORDS,
                    cache_words: int = CACHE_WORDS) -> DataFrame:
    """Trains on the rows that are not held out and scores all, over all pairs of words."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), docs[id_col].alias("_id"), held_out(docs[id_col]).alias("_held"),
                       docs[text_col].cast("string").alias("_text"))
    texts = docs.filter(~held_out(docs[id_col])).select(docs[text_col].cast("string").alias("_text"))
    unigrams = write_and_reload(texts.mapInArrow(_count_words, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "lm-unigrams")
    n, v, ones, twos, ends = unigrams.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2),
                                          F.max(F.when(F.col("word") == F.lit(END), F.col("c")))).first()
    n, ends = n or 0, ends or 0
    d = discount(ones or 0, twos or 0)
    frequent = [(bytes(r["word"]), r["c"]) for r in unigrams.orderBy(F.desc("c"), "word").limit(local_words).collect()]
    if ends and END not in {w for w, _ in frequent}:
        frequent.append((END, ends))
    words, counts = [w for w, _ in frequent], np.array([c for _, c in frequent], np.int64)
    s = min(cache_words, len(words))
    code = count = np.empty(0, np.int64)
    if s:
        arcs = (texts.mapInArrow(partial(_count_arcs, words=share(words[:s]), n_states=s), "code bigint, c bigint")
                .groupBy("code").agg(F.sum("c").alias("c")).toArrow())
        code, count = arcs["code"].to_numpy(), arcs["c"].to_numpy()
        order = np.argsort(code)
        code, count = code[order], count[order]
    history = -np.log10(np.maximum(counts, 1))
    history[[w == END for w in words]] = 0  # the end is no history
    model = share({"n_states": s, "buckets": n // BUCKET_TOKENS + 1, "words": words, "arc_codes": code, "arc_counts": count,
                   "base": np.log10((counts + 1) / (n + v + 1)), "history": history, "start": -_log10(ends) if ends else 0.0})

    id_type, id_name = to_arrow_type(rows.schema["_id"].dataType), rows.schema["_id"].dataType.simpleString()
    doc = f"doc struct<id: {id_name}, n_tokens: bigint, n_local: bigint, base: double, score: double, arcs: binary>"
    blocks = rows.mapInArrow(partial(_pair_batches, model=model, id_type=id_type), f"bucket bigint, chunk bigint, pairs binary, row bigint, {doc}")
    numbers = share({"n": n, "v": v, "d": d, "counts": counts})
    met = write_and_reload(blocks.groupBy("bucket").applyInArrow(
        lambda table: _answers(table, numbers, id_type),
        "chunk bigint, row bigint, sums binary, entries binary, ask bigint, times bigint, h bigint, kinds double, used double, once bigint, twice bigint, " + doc),
        "lm-met")
    once, twice = met.agg(F.sum("once"), F.sum("twice")).first()
    d2 = discount((once or 0) + int((count == 1).sum()), (twice or 0) + int((count == 2).sum()))

    # Failure weights: of local words and the start as an array, of others where they are asked for.
    histories = met.filter("h IS NOT NULL").groupBy("h").agg(F.sum("kinds").alias("kinds"), F.sum("used").alias("used"))
    local = histories.filter("h >= 0").toArrow()  # at most one row for each local word
    state, word = (code // s, code % s) if s else (code, code)
    place = lambda h, start: np.where(h == start, len(words), h)
    kinds, used = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    np.add.at(kinds, place(local["h"].to_numpy(), START), local["kinds"].to_numpy())
    np.add.at(used, place(local["h"].to_numpy(), START), local["used"].to_numpy())
    np.add.at(kinds, place(state, s), 1)
    np.add.at(used, place(state, s), (counts[word] - d) / max(n, 1))
    failure = np.where(kinds > 0, np.log10(np.maximum(d2 * kinds, 1e-300) / np.maximum(1 - used, 1e-300)), 0.0)
    weight = F.log10(F.lit(d2) * F.col("kinds") / F.greatest(1 - F.col("used"), F.lit(1e-300)))
    asked = (met.filter("ask IS NOT NULL").select("chunk", "row", "times", F.col("ask").alias("h"))
             .join(histories.filter("h < 0").select("h", weight.alias("failure")), "h")
             .groupBy("chunk", "row").agg(F.sum(F.col("times") * F.col("failure")).alias("extra")))

    gained = met.filter("doc IS NOT NULL OR entries IS NOT NULL").select("chunk", "row", "doc", "sums", "entries")
    weights = share({"d2": d2, "failure": failure})
    scored = (gained.unionByName(asked, allowMissingColumns=True).groupBy("chunk")
              .applyInArrow(lambda table: _scores(table, weights, id_type),
                            f"id {id_name}, n_tokens bigint, n_known bigint, base_score double, score double"))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
