import random
import re
from itertools import permutations

import numpy as np

from bookspark.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, text, source, *_ in docs:
        text = text or ""
        words = WORD.findall(text)
        earlier = d is not None and any(o is not None and o < d and (t or "") == text for o, t, *_ in docs)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": earlier}
        rows.append((source or "", fails, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                kept = [r for r in left if not r[1][f]]
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(r[1][f] for r in mine) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[f] += len(gone)
                left = kept
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(total[order[step - 1]])
    return out


def _docs(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "Über", "NASA", "a$b"]
    texts = [" ".join(rnd.choice(vocab[:rnd.choice([20, 60, 400, 404])]) for _ in range(rnd.choice([3, 150, 199, 200, 230, 500]))) for _ in range(30)]
    texts += [None, "", " \t\n\x0b\r", "A", "x\x1cy " * 200, "Same WORDS " * 150]
    rows = [(i, rnd.choice(texts), rnd.choice(["s1", "s2", None, ""]), "clash") for i in range(150)]
    return rows + [(None, texts[0], "s1", ""), (None, texts[0], "s1", ""), (3, rows[3][1], "s2", "again"), (3, "other", "s9", "id again")]


LABELS = [(i, i % 3 and 1, i % 5 == 0 and 1 or 0) for i in range(0, 150, 2)] + [(4, None, None), (4, 1, 1), (None, 1, 1), (9999, 1, 1)]


def test_matches_counting_by_hand(spark):
    docs = _docs(1)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, kept string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = A.audit(df, labels)
    assert out.columns == ["part", "filter_order", "step", *A.FIGURES]
    got = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in A.FIGURES] for r in out.collect()}
    assert got == _brute(docs, LABELS)


def test_long_text_counts_distinct_words(monkeypatch):
    rnd = random.Random(2)
    data = " ".join(f"w{rnd.randrange(700)}" for _ in range(5_000)).encode()
    want = A._distinct_words(data)
    monkeypatch.setattr(A, "PIECE", 1_000)
    assert A._distinct_words(data) == want == (5_000, 700)


def test_contractions_are_plain_sums():
    rnd = np.random.default_rng(3)
    tensor = rnd.integers(0, 1 << 40, (2, 2, 2, 2, 2, 2))
    got = A.contract(tensor, [["pass", "all", "all", "all", "all"], ["pass", "fail", "all", "pass", "all"]])
    assert got.tolist() == [[int(t[0].sum()), int(t[0, 1, :, 0].sum())] for t in tensor]


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(spark.createDataFrame([], "doc_id long, text string, source string"), labels).count() == 0
