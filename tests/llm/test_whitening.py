import math
import random

import numpy as np
import pytest

from bookspark.llm import whitening as W


def _rows(seed, dims=5, n=60):
    rnd = random.Random(seed)
    pool = [[rnd.gauss(1, i + 0.5) for i in range(dims)] for _ in range(n)]
    rows = [(i, rnd.choice(pool), "x") for i in range(2 * n)]
    rows += [(1000 + i, pool[0], "x") for i in range(50)]
    return rows + [(2000, None, None), (2001, [1.0, None, 2.0, 3.0, 4.0], ""), (2002, [math.nan] * dims, ""), (2003, [math.inf] + [0.0] * (dims - 1), ""),
                   (None, pool[1], ""), (7, rows[7][1], "again"), (2004, pool[2][:3], "short"), (2005, [-0.0] * dims, "")]


def _brute(rows, k, weighted):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(len(v) for _, v in good)
    good = [(i, tuple(v + [0] * (dims - len(v)))) for i, v in good]
    fit = sorted({v for _, v in good}) if not weighted else [v for _, v in good]
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array(fit, float) - np.array(s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    return good, n, s, values[order], vectors[:, order], values.sum()


@pytest.mark.parametrize("weighted", [False, True])
def test_matches_numpy(spark, weighted):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    got = W.whiten(df, 4, weighted=weighted).collect()
    good, n, s, values, vectors, trace = _brute(rows, 4, weighted)
    assert len(got) == 4 * len(good)
    white = {}
    for r in got:
        white.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], set()).add(r["whitened"])
        assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / trace) < 1e-9
        assert r["identity_error"] < 1e-8
    sign = {}
    for i, v in good:
        mine = white[i, sum((n * a - b) ** 2 for a, b in zip(v, s))]
        for c in range(4):
            (x,) = mine[c + 1]
            want = float((np.array(v) - np.array(s) / n) @ vectors[:, c]) / math.sqrt(values[c])
            if abs(want) > 1e-6:
                sign.setdefault(c, x / abs(x) * want / abs(want))
            assert abs(x - sign.get(c, 1) * want) < 1e-7


def test_hot_vector_joins_like_any_other(spark, monkeypatch):
    df = spark.createDataFrame(_rows(2), "vec_id long, embedding array<double>, x string")
    key = lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"], abs(r["whitened"]))
    all_hot = sorted(map(key, W.whiten(df).collect()))
    monkeypatch.setattr(W, "HOT_SHARE", 0)
    for a, b in zip(all_hot, sorted(map(key, W.whiten(df).collect())), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(2**40 + i * 3), float(-(2**41) + (i % 7)), 1.0]) for i in range(40)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()
    good, n, s, *_ = _brute([(i, v, "") for i, v in rows], 2, False)
    want = {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in good}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == want and got[0]["identity_error"] < 1e-6


def test_without_variance(spark):
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<float>")).collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: (r["component"], r["vec_id"]))] == [False, False, True, True]


def test_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, extra int"
    for rows in ([], [(1, None, 1)], [(1, [], 1)]):
        out = W.whiten(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
