import math
import random

from pyspark.sql import functions as F

from bookspark.llm import topk

NAN, INF = float("nan"), float("inf")


def _brute(rows, k=5, every=3):
    vecs, seen = [], set()
    for i, v, _ in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(math.floor(256 * x) for x in v)
        if (i, v) not in seen:
            seen.add((i, v))
            vecs.append((i, v))
    out = []
    for q, qv in vecs:
        if q is None or q % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for i, v in vecs if i != q)
        out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def _run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    return sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, **kw).collect()), key=str)


def test_matches_brute_force_over_odd_rows(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(40)], "x") for i in range(150)]
    rows += [(200 + i, list(rows[i % 4][1]), None) for i in range(12)]  # ties
    rows += [rows[3], (3, [0.5] * 40, "z"), (500, None, ""), (501, [0.1, None] + [0.0] * 38, ""), (502, [NAN] * 40, ""),
             (503, [INF] * 40, ""), (504, [0.5] * 7, ""), (None, [0.9] * 40, ""), (507, [], "")]
    want = _brute(rows)
    assert _run(spark, rows) == want
    assert _run(spark, rows, candidate_cell=20, query_cell=10) == want


def test_few_candidates_large_values_and_empty_table(spark):
    rows = [(0, [1e5] * 40, ""), (1, [-2e5] * 40, ""), (3, [3e5 + i for i in range(40)], "")]
    assert _run(spark, rows) == _brute(rows) and len(_brute(rows)) == 4
    assert _run(spark, []) == [] and _run(spark, [(0, [1.0], "")]) == []


def test_pruning_keeps_the_best(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    cand = np.floor(rng.normal(size=(64, 5000)) * np.linspace(300, 1, 64)[:, None])
    ids = np.arange(5000)
    for q in range(0, 5000, 500):
        at, score = topk.search_cell(ids, cand, q, cand[:, q], 5)
        full = cand[:, q] @ cand
        want = [i for i in np.lexsort((ids, -full)) if i != q][:5]
        assert ids[at].tolist() == want and score.tolist() == full[want].tolist()
