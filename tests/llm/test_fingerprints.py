import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bookspark.llm import fingerprints as P


def _bag(text, width):
    words = text.replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    return Counter(tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1))))


def _jaccard(a, b, width=2):
    x, y = _bag(a, width), _bag(b, width)
    if not x and not y:
        return 1.0
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def _rows():
    rnd = random.Random(12)
    vocab = ["the", "of", "a", "é", "日本", *(f"w{i}" for i in range(25))]
    rows = [(i * 3, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 4, 30, 80]))), "x") for i in range(60)]
    return rows + [(500, None, ""), (501, "", ""), (502, " \n", ""), (503, rows[5][1], "copy"), (504, "one", ""), (505, "zz " * 20000, "")]


def _next(rows):
    ordered = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(d, t, ordered[(i + 1) % len(ordered)][1]) for i, (d, t) in enumerate(ordered)]


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_edited_text_and_neighbours_match_brute_force(spark, partitions):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, body string").withColumn("pos", F.lit(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["doc_id"]: r for r in P.edit_report(df, samples=16).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    errors = []
    for d, text, following in _next(rows):
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1)
        if edited == text:
            assert r["near_edited"] == 1
        errors += [r["near_edited"] - _jaccard(text, edited), r["near_next"] - _jaccard(text, following)]
    assert got[503]["fingerprint"] == got[15]["fingerprint"] and set(got[501]["fingerprint"]) == {"0"}
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.5


def test_collision_rate_is_the_generalised_jaccard(spark):
    pairs = [("a a a b c", "a b b c c d"), ("x x x x y", "x y y y y"), ("p q r s", "p q r t"), ("m " * 9 + "n", "m n n")]
    rows = [(i, side, t) for i, both in enumerate(pairs) for side, t in enumerate(both)]
    prints = P.fingerprints(spark.createDataFrame(rows, "i int, side int, body string"), "body", samples=64, shingle_words=1)
    got = {(r["i"], r["side"]): r for r in prints.collect()}
    for i, (a, b) in enumerate(pairs):
        same = sum(got[i, 0][f"s{k}"] == got[i, 1][f"s{k}"] for k in range(64)) / 64
        assert same == pytest.approx(_jaccard(a, b, 1), abs=0.2), (a, b)


def test_repeated_null_single_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q r"), (None, "q r"), (2, "z")], "doc_id long, text string")
    out = P.edit_report(df).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in out) == [("1", 11), ("1", 11), ("2", 1), ("None", 3), ("None", 3)]
    (one,) = P.edit_report(df.filter("doc_id = 2")).collect()
    assert one["near_next"] == 1 and one["near_edited"] == 1
    assert P.edit_report(df.limit(0)).count() == 0


def test_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = P.fingerprints(P.with_next(docs, "doc_id", "text").select("rid", "text"), "text", 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
