import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bookspark.llm import quality as Q


def _kn(texts, order):
    """Interpolated modified Kneser-Ney by its definition, as a function of context and symbol."""
    def grams(t, k):
        s = [0xFF] * (order - 1) + list(t.encode())
        return [tuple(s[i:i + k]) for i in range(order - k, len(s) - k + 1)]

    counts = {order: Counter(g for t in texts for g in grams(t or "", order))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = {k: Q.discounts(*(sum(v == i for v in counts[k].values()) for i in (1, 2, 3, 4))) for k in counts}

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / Q.SYMBOLS
        mine = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        total = sum(mine.values())
        if not total:
            return p(g[1:])
        cut = lambda c: disc[k][min(c, 3) - 1] if c else 0
        return (mine.get(g, 0) - cut(mine.get(g, 0))) / total + sum(map(cut, mine.values())) / total * p(g[1:])

    return lambda t: -sum(math.log(p(g)) for g in grams(t, order)) / len(t.encode()) if t else None, p


def _texts(seed=2):
    rnd = random.Random(seed)
    syll = ["an", "the", "ti", "on", "é", "b"]
    return ["".join(rnd.choice(syll) for _ in range(rnd.randint(2, 6))) + "." for _ in range(25)]


@pytest.mark.parametrize("order, broadcast_rows", [(2, 10**6), (3, 10**6), (4, 0)])
def test_perplexity_matches_the_definition(spark, order, broadcast_rows):
    trusted = _texts()
    docs = _texts(9)[:8] + ["XYZ!", "the the the", "\U0001f642", "", None, "an an", "an an"]
    log_ppl, p = _kn(trusted, order)
    for context in (b"n", b"t"):
        assert sum(p(tuple(context * (order - 1)) + (s,)) for s in range(Q.SYMBOLS)) == pytest.approx(1, abs=1e-6)
    df = spark.createDataFrame([(t,) for t in trusted], "text string")
    model = Q.train(df, order=order)
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)], "doc_id long, text string, lang string")
    got = {r["_id"]: r["log_perplexity"] for r in Q.perplexity(rows, model, broadcast_rows=broadcast_rows).collect()}
    for i, t in enumerate(docs):
        want = log_ppl(t) if t else None
        assert got[i] == (None if want is None else pytest.approx(want)), (i, t)


def test_rejects_junk_keeps_clean_and_odd_rows(spark):
    rnd = random.Random(4)
    words = ["the", "and", "tion", "ing", "wh", "en"]
    clean = lambda: " ".join("".join(rnd.choices(words, k=2)) for _ in range(40)) + "."
    rows = [(i, clean(), "en", "x") for i in range(120)]
    rows += [(1000 + i, clean().upper().replace(" ", "!! "), "en", "x") for i in range(10)]
    rows += [(2000, "ÄÖ" * 50, "xx", "no trusted text"), (2001, "ÄÖ" * 50, None, ""), (2002, None, "en", ""), (2003, "", "en", ""),
             (None, clean().upper(), "en", ""), (1000, "THIS!! " * 30, "en", "id again"), (5, clean(), "en", "id again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep string").withColumn("_id", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(1001, 0, 0), (1002, 1, 1), (None, 1, 0), (61, None, None), (2, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not [i for i in ids if i is None or 1000 <= i < 1010]
    assert {2000, 2001, 2002, 2003} <= set(ids) and sum(i < 120 for i in ids) >= 115
    assert Q.keep_good(docs, labels.limit(0)).count() == len(rows)
    assert Q.keep_good(docs.limit(0), labels).count() == 0


def test_quantile_thresholds(spark):
    rows = [(i, "a", 0, 1 + i / 100) for i in range(100)] + [(7, "b", 0, 2.0), (8, None, 0, 3.0), (9, "a", 0, None)]
    got = {r["_lang"]: r["threshold"] for r in Q.thresholds(spark.createDataFrame(rows, "_id long, _lang string, _hash long, log_perplexity double"), 0.95).collect()}
    assert got == {"a": pytest.approx(2.041, abs=2e-3), "b": pytest.approx(3.001)}


def test_held_out_labels_are_separated(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    found = Q.classify(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), F.col("_id") == F.col("doc_id"))
    rates = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.94 and rates[0] < 0.3, rates


def test_thresholds_rest_on_all_trusted_documents_that_training_does_not_read(spark, monkeypatch):
    sizes = []
    plain = Q.thresholds
    monkeypatch.setattr(Q, "thresholds", lambda scored, *a: sizes.append({r["_id"] for r in scored.select("_id").collect()}) or plain(scored, *a))
    texts = _texts(5)
    docs = spark.createDataFrame([(i, texts[i % 25], "rare" if i < 6 else "en") for i in range(120)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    limits = Q.classify(docs, labels, order=2, max_trusted=8).groupBy("_lang").agg(F.max("threshold").alias("t")).collect()
    assert len(sizes[0]) == 92 and sizes[0] <= set(range(100))
    assert {r["_lang"] for r in limits if r["t"] is not None} == {"en", "rare"}
    Q.classify(docs, labels, order=2)
    assert 0 < len(sizes[1]) < 50  # only the unseen part if all others are learnt


def test_rare_scripts_are_told_from_their_junk(spark):
    """A small language with hundreds of letters beside a large one with few."""
    rnd = random.Random(11)
    signs = [chr(0x4E00 + 37 * i) for i in range(300)]
    pairs = [a + b for a, b in zip(signs[::2], signs[1::2])]
    prose = lambda: "".join(rnd.choice(pairs) for _ in range(60))
    junk = lambda: "".join(rnd.choice(signs) for _ in range(120))
    english = lambda: " ".join(rnd.choice(["the", "and", "when", "night"]) for _ in range(80))
    rows = [(i, prose(), "zh") for i in range(150)] + [(1000 + i, junk(), "zh") for i in range(20)] + [(2000 + i, english(), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(100), *range(2000, 2300)]], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in Q.keep_good(docs, labels).collect()}
    assert not [i for i in kept if 1000 <= i < 1020] and sum(i < 150 for i in kept) >= 140 and sum(i >= 2000 for i in kept) >= 390


def test_training_reads_every_trusted_document_not_held_out(spark, monkeypatch):
    read = []
    monkeypatch.setattr(Q, "train", lambda trusted, text_col, order: read.append(trusted.count()) or Q.QualityModel(None, order))
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    Q.classify(docs, labels, order=2)
    assert 220_000 < read[0] < 230_000  # three quarters, no bound


def test_texts_are_not_shuffled_for_ids_within_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "en", f"plain words number {i} in a line") for i in range(40)] + [(99, "en", "#@!~^&*()|zq}{][")], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        within = Q.keep_good(docs, labels)
        assert "SortMergeJoin" not in within._jdf.queryExecution().executedPlan().toString()
        kept = sorted(r["doc_id"] for r in within.collect())
        monkeypatch.setattr(Q, "BROADCAST_REJECTED", 0)
        beyond = Q.keep_good(docs, labels)
        assert "SortMergeJoin" in beyond._jdf.queryExecution().executedPlan().toString()
        assert kept == sorted(r["doc_id"] for r in beyond.collect()) and 99 not in kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
