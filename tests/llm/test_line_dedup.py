import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bookspark.llm import line_dedup as L
from bookspark.session import SHUFFLE_CLEANUP


def _brute(rows, t=0.8):
    """Removed line numbers by comparing every line with every earlier one."""
    import xxhash
    docs = {}
    for d, text, _ in rows:
        if text is not None:
            h = xxhash.xxh64_intdigest(text.encode(), 42)
            docs[d, text] = (d is None, d or 0, h - (1 << 64) if h >> 63 else h)
    lines = sorted((pos, i, set(line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\f", " ").split(" ")) - {""}, key)
                   for key, pos in docs.items() for i, line in enumerate(key[1].split("\n")))
    removed = {}
    for k, (_, i, s, key) in enumerate(lines):
        if s and any(o and len(s & o) >= t * len(s | o) - 1e-12 for _, _, o, _ in lines[:k]):
            removed.setdefault(key, []).append(i)
    return sorted((repr(d), 0 if x is None else len(x.split("\n")), sorted(removed.get((d, x), []))) for d, x, _ in rows)


def _rows(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "é"] * 30
    pool = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 5, 12, 30]))] for _ in range(40)]

    def line():
        if rnd.random() < 0.5:
            return " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 8, 20])))
        base = list(rnd.choice(pool))
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            base[rnd.randrange(len(base))] = rnd.choice(vocab)
        if rnd.random() < 0.2:
            rnd.shuffle(base)
        return rnd.choice(["", " "]) + rnd.choice([" ", "  ", "\t"]).join(base)

    rows = [(i, "\n".join(line() for _ in range(rnd.randint(1, 8))), "x") for i in range(40)]
    return rows + [(500, None, ""), (501, "", ""), (502, "\n\n \n", ""), (None, rows[3][1], ""), (None, "solo line here\nsolo line here", ""),
                   (7, rows[7][1], "repeated"), (7, "other text\nwith two lines", "id again"), (503, "\n".join(["again and again"] * 500), "")]


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_matches_brute_force(spark, seed, monkeypatch):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, line string")
    if seed == 2:
        monkeypatch.setattr(L, "BROADCAST_LINES", 0)
    if seed == 5:  # lines of both parity widths, matched across them
        monkeypatch.setattr(L, "WIDE_WORDS", 16)
    got = sorted((repr(r["doc_id"]), r["n_lines"], r["removed_lines"]) for r in L.line_report(df).collect())
    assert got == _brute(rows)


def test_text_loses_exactly_the_removed_lines(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string").withColumn("hash", F.lit(1)).withColumn("id", F.lit("q"))
    out = L.dedup(df)
    assert out.columns == df.columns
    want = {(d, x): x and "\n".join(t for i, t in enumerate(x.split("\n")) if i not in gone)
            for (d, x, _), gone in ((r, next(g for k, n, g in _brute(rows) if k == repr(r[0]) and n == (0 if r[1] is None else len(r[1].split("\n"))) and True))
                                    for r in rows if r[0] not in (7, None))}
    got = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] not in (7, None)}
    assert got == {d: x for (d, _), x in want.items()}


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(_rows(4), "doc_id long, text string, x string")
    for plan in (L.distinct_lines, ):
        assert plan(L._documents(df, "text", "doc_id"), 0.8).count() > 0
    assert "Python" not in L.line_report(df)._jdf.queryExecution().toString() and "Arrow" not in L.line_report(df)._jdf.queryExecution().toString()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_report(df).count() == 0 and L.dedup(df).count() == 0


def test_shuffle_files_go_with_the_tables_they_served(spark):
    places = [Path(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffles = lambda: {f.name.split("_")[1] for d in places for f in d.rglob("shuffle_*.data")}
    df = spark.createDataFrame(_rows(6), "doc_id long, text string, x string")
    before, setting = shuffles(), spark.conf.get(SHUFFLE_CLEANUP)
    L.removed_lines(df)
    until = time.time() + 10
    while len(shuffles() - before) > 5 and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert len(shuffles() - before) <= 5  # of the word counts, and of counts of rows
    assert spark.conf.get(SHUFFLE_CLEANUP) == setting


def test_a_frequent_long_word_comes_behind_rare_short_ones(spark):
    text = "\n".join(f"internationalisation w{i}" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rank = L.rarity(L._documents(df, "text", "doc_id"))
    words = spark.createDataFrame([("internationalisation",), ("w7",), ("w2999",), ("w",)], "w string")
    got = {r["w"]: r["p"] for r in words.select("w", L.place(F.col("w"), rank).alias("p")).collect()}
    assert got["internationalisation"] > max(got["w7"], got["w2999"]) and max(got.values()) < L.CLASSES * L.LENGTHS


def test_prefixes_are_shuffled_once_for_both_sides(spark, monkeypatch):
    plans, write = [], L.write_and_free
    monkeypatch.setattr(L, "write_and_free", lambda df, name: (plans.append((name, df)), write(df, name))[1])
    df = spark.createDataFrame(_rows(7), "doc_id long, text string, x string")
    L.removed_lines(df)
    rest = [d for name, d in plans if name == "pairs"][-1]
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in fixed}
    try:
        for k, v in fixed.items():
            spark.conf.set(k, v)
        plan = rest.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("+- Exchange hashpartitioning(token") == 1 and "ReusedExchange" in plan


def test_near_copies_meet_one_leader_of_each_word(spark, monkeypatch):
    sizes, write = [], L.write_and_free
    monkeypatch.setattr(L, "write_and_free", lambda df, name: (out := write(df, name), name == "pairs" and sizes.append(out.count()))[0])
    base = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1:])) for i in range(120) for k in [i % 40]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in L.line_report(df).collect()} == {i: int(i > 0) for i in range(120)}
    assert sizes[0] <= L.LEAD_WORDS * 120 and sum(sizes) <= 6 * 120
