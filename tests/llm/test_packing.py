import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from bookspark.llm import packing as P


def _padding(hist, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())


def test_boundaries_are_optimal():
    rnd = random.Random(6)
    for _ in range(60):
        hist = Counter({rnd.randint(1, 60): rnd.randint(1, 9) for _ in range(rnd.randint(1, 9))})
        x = np.array(sorted(hist))
        n = np.array([hist[i] for i in x])
        for k in (1, 2, 3, 5, 20):
            bounds, padding = P.boundaries(x, n, x * n, k)
            best = min(_padding(hist, (*c, x[-1])) for size in range(min(k, len(x))) for c in combinations(x[:-1].tolist(), size))
            assert padding == best == _padding(hist, bounds) and len(bounds) <= k, (hist, k, bounds)
    assert P.boundaries(np.empty(0, int), np.empty(0, int), np.empty(0, int), 4) == ([], 0)


def test_length_classes_hold_their_lengths(spark):
    rows = spark.range(1, 5000).select("id", P.length_class(F.col("id")).alias("c")).collect()
    assert all(r["c"] == r["id"] for r in rows if r["id"] <= 512)
    assert all(r["id"] <= r["c"] <= r["id"] * (1 + 1 / 256) for r in rows)
    big = spark.createDataFrame([(2**40 + 1,)], "x long").select(P.length_class(F.col("x"))).first()[0]
    assert 2**40 < big < 2**40 * (1 + 1 / 250)


def test_batches_keep_to_the_budget(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([3, 3, 3, rnd.randint(0, 900)])) for i in range(700)] + [(None, 3), (None, None), (5, 3), (5, 3), (999, 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("bucket", F.lit("x")).withColumn("batch_id", F.lit(3))
    for shard in (50_000, 60):
        got = P.pack(df, "n", buckets=5, budget=4096, order_by=["doc_id"], shard_rows=shard).collect()
        assert len(got) == len(rows) and sorted((r["doc_id"], r["n"]) for r in got if r["doc_id"] is not None and r["n"] is not None) == sorted(r for r in rows if None not in r)
        batches = defaultdict(list)
        for r in got:
            assert r["bucket_tokens"] >= max(r["n"] or 0, 1)
            assert r["batch_id"] == 3  # the input's own
            batches[r["batch_id_1"]].append(r)
        for rs in batches.values():
            assert len({r["bucket_tokens"] for r in rs}) == 1 and len(rs) <= rs[0]["batch_rows"]
            assert len(rs) * rs[0]["bucket_tokens"] <= 4096 or len(rs) == 1
        unfilled = Counter(rs[0]["bucket_tokens"] for rs in batches.values() if len(rs) < rs[0]["batch_rows"])
        assert max(unfilled.values()) <= -(-len(rows) // shard)
    assert P.pack(df.limit(0), "n").count() == 0


def test_padding_is_that_of_the_best_boundaries_at_any_length(spark):
    rnd = random.Random(13)
    for top in (400, 30_000):
        lengths = [rnd.randint(1, top) for _ in range(9)]
        df = spark.createDataFrame([(x,) for x in lengths for _ in range(rnd.randint(1, 4))], "n long")
        hist = Counter(r["n"] for r in df.collect())
        found, padding, n = P.choose_buckets(df, "n", 3)
        best = min(_padding(hist, (*c, max(lengths))) for c in combinations(sorted(set(lengths) - {max(lengths)}), 2))
        assert set(found) <= set(lengths) and n == sum(hist.values())
        assert padding == _padding(hist, found) and best <= padding <= best + (0 if top <= 512 else sum(x * k for x, k in hist.items()) / 256)
        got = P.pack(df, "n", buckets=3, budget=10**6)
        assert got.agg(F.sum(F.col("bucket_tokens") - F.col("n"))).first()[0] == padding
