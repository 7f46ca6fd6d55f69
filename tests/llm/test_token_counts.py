import random

import public_tokenizers

from bookspark.llm import token_counts as TC

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _greedy(word, starts, more):
    n, at, pieces = 0, 0, starts
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        n, at, pieces = n + 1, end, more
    return n


def test_automaton_equals_plain_greedy_matching():
    rnd = random.Random(4)
    for _ in range(300):
        starts = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))) for _ in range(6)}
        more = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))) for _ in range(6)}
        machine = TC.LongestMatch.build(starts, more)
        for _ in range(30):
            word = "".join(rnd.choice("abc" if rnd.random() < 0.05 else "ab") for _ in range(rnd.randint(1, 14)))
            assert machine.count(word) == _greedy(word, starts, more), (starts, more, word)


def test_documents_with_nulls_unknown_and_long_words(spark):
    starts, more = TC.load_pieces(PATH)
    rows = [(1, "The quick  brown fox.\n jumped", 1), (2, None, 2), (3, "", 3), (4, "été 日本 \U0001f642x qwrtzpsdfg", 4), (5, "a" * 5000, 5),
            (6, "Hello world! " * 100_000, 6), (7, " \t", 7), (1, "The quick", 8), (None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in TC.token_counts(df, PATH).collect()), key=str)
    want = []
    for d, t, _ in rows:
        words = (t or "").encode().split()
        known = {w: _greedy(w.decode(), starts, more) for w in set(words)}
        counts = [known[w] for w in words]
        want.append((d, len(words), sum(1 if c is None else c for c in counts), counts.count(None)))
    assert got == sorted(want, key=str)
    assert TC.token_counts(spark.createDataFrame([], df.schema), PATH).count() == 0


def _covered(word, starts, more):
    """Greedy matching where the bare start mark and bytes stand in."""
    n, at, pieces = 0, 0, starts
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is not None:
            n, at = n + 1, end
        elif pieces is starts:
            n += 1
        else:
            n, at = n + len(word[at].encode()), at + 1
        pieces = more
    return n


def test_covering_automaton_equals_plain_matching():
    rnd = random.Random(5)
    piece = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 5)))
    for _ in range(300):
        starts, more = {piece() for _ in range(4)}, {piece() for _ in range(6)}
        machine = TC.LongestMatch.build(starts, more, cover=True)
        held = {c for p in starts | more for c in p}
        for _ in range(30):
            word = "".join(rnd.choice("abé\U0001f642" if rnd.random() < 0.1 else "abé") for _ in range(rnd.randint(1, 14)))
            assert machine.cover(word) == (_covered(word, starts, more), not set(word) <= held), (starts, more, word)


def test_queries_give_unstartable_words_their_length(spark, tmp_path):
    from bookspark.llm.queries import QUERIES
    words = ["9000426309966109$$$", "170.116.163.254###", "ñciónjaciónciónmentedo", "\U00013000", "The", "", None]
    rows = list(enumerate(words))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in QUERIES["op9_token_counts"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 19, 0), 1: (1, 17, 0), 2: (1, 8, 0), 3: (1, 5, 1), 4: (1, 1, 0), 5: (0, 0, 0), 6: (0, 0, 0)}
    packed = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op5_packing"](spark, str(tmp_path)).select("doc_id", "n_tokens").collect()}
    assert packed[0] == 19
