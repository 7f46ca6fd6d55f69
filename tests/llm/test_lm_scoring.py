import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bookspark.llm import lm_scoring as LM


def _tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return low.encode().split() + [LM.END]


def _brute(rows, s_words, l_words):
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    train = [_tokens(t) for (_, t), h in zip(rows, held) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    d1 = LM.discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    states = set([w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][:min(s_words, l_words)])
    arcs, total = Counter(), Counter()
    for t in train:
        for h, w in zip(["<s>", *t], t):
            if h == "<s>" or h in states:
                total[h] += 1
                if w in states:
                    arcs[h, w] += 1
    d2 = LM.discount(sum(x == 1 for x in arcs.values()), sum(x == 2 for x in arcs.values()))

    def uni(w):
        return (c[w] - d1) / n if c[w] else d1 * v / n

    fail = {}
    for h in [*states, "<s>"]:
        mine = [w for w in states if arcs[h, w]]
        fail[h] = (1 - sum((arcs[h, w] - d2) / total[h] for w in mine)) / (1 - sum(uni(w) for w in mine))

    def p(h, w):
        if arcs[h, w]:
            return (arcs[h, w] - d2) / total[h]
        return fail.get(h, 1) * uni(w)

    for h in [*list(states)[:5], "<s>"]:
        assert sum(p(h, w) for w in c) + p(h, b"no such word") == pytest.approx(1)
    out = []
    for (d, t), h in zip(rows, held):
        toks = _tokens(t)
        out.append((d, h, len(toks), sum(c[w] > 0 for w in toks), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks),
                    sum(math.log10(p(a, w)) for a, w in zip(["<s>", *toks], toks))))
    return out


def _key(r):
    return str(r[:5]) + f"{r[5]:.6f} {r[6]:.6f}"


def _same(got, want):
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("PAIRS_AT_ONCE", 50), ("DOCS_AT_ONCE", 7), ("BUCKET_TOKENS", 200)):
        monkeypatch.setattr(LM, name, value)


def test_state_is_carried_over_pieces_of_a_long_text(spark, monkeypatch, small_blocks):
    from bookspark.llm import text as TX
    long = " ".join(random.Random(1).choice(["a", "b", "c d", "e", "f g h"]) for _ in range(3000))
    monkeypatch.setattr(TX.word_pieces, "__defaults__", (50, True))
    rows = [(1, long), (2, "a b"), (3, "a c d"), (7, "h " + long), (7, "h a"), (200, long + " new"), (None, "e e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for cache_words in (0, 4, 4096):
        _same([tuple(r) for r in LM.score_documents(df, local_words=5, cache_words=cache_words).collect()], _brute(rows, 10**6, 10**6))


def test_no_training_text_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert LM.score_documents(empty).count() == 0
    df = spark.createDataFrame([(i, "a b") for i in range(40)], empty.schema)
    for row in LM.score_documents(df.filter(LM.held_out(df["doc_id"]))).collect():
        assert (row["n_tokens"], row["n_known"], row["base_score"], row["score"]) == (3, 0, 0.0, 0.0)


def test_blocks_come_back_as_they_were():
    import numpy as np
    for size in (0, 1, 1000):
        a, b = np.random.default_rng(size).integers(-2**63, 2**63 - 1, (2, size)), np.linspace(-1, 1, size)
        x, y, z = LM._unpack(LM._pack(*a, b), 3)
        assert (x == a[0]).all() and (y == a[1]).all() and (z.view(np.float64) == b).all()


def test_ids_of_any_type(spark):
    rows = [("x", "a b a"), ("y", "b"), ("y", "b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("chunk", F.lit(1))
    _same([tuple(r) for r in LM.score_documents(df).collect()], _brute(rows, 10**6, 10**6))


def test_held_out_documents_score_better_than_the_base(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base, own = LM.score_documents(docs).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert own > base


@pytest.mark.parametrize("cache_words, l_words", [(0, 0), (3, 5), (6, 40), (4096, 65536)])
def test_all_pairs_are_arcs_whatever_the_cache_holds(spark, small_blocks, cache_words, l_words):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words[:6] if rnd.random() < 0.5 else words) for _ in range(rnd.choice([1, 5, 40])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "w1 w2"), (102, "new w1\x0bwords new"), (7, "w1 w59"), (7, "w1 w59"), (200, "rare pair"), (201, "rare pair"), (205, "rare pair x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    _same([tuple(r) for r in LM.score_documents(df, local_words=l_words, cache_words=cache_words).collect()], _brute(rows, 10**6, 10**6))
    held = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2]
    assert held and LM.score_documents(df.filter(held_out_only(df)), cache_words=cache_words).agg(F.sum("n_known")).first()[0] == 0


def held_out_only(df):
    return LM.held_out(df["doc_id"])
