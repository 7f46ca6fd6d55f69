import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bookspark.llm import token_store as S

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return S.Encoder(file.read())


def _texts(seed, n=150):
    rnd = random.Random(seed)
    marks = [" ", "  ", "\n", " \n ", "\t", "'s", "'", "!?", "12", "é", "中文", "　", "\xa0", "\x85", "\x1c", "᠎", " ", "😀", "word", "Hello", "<|endoftext|>", "​", "́"]
    return ["".join(rnd.choice(marks) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_encoder_equals_the_library(encoder, library, monkeypatch):
    rnd = random.Random(9)
    plain = ["".join(rnd.choice([" ", "  ", "\n", "\t", "'s", "'ll", "'", "'x", "!?", "12", "é", "ñ", "ab", "Word", "$", "ÿ"]) for _ in range(rnd.randrange(30)))
             for _ in range(200)]
    assert not any(S.OTHER.search(t) for t in plain)
    for size in (S.BLOCK_CHARS, 7):
        monkeypatch.setattr(S, "BLOCK_CHARS", size)
        monkeypatch.setattr(S.blocks, "__defaults__", (size,))
        for text in ["", " ", "a ", " a", "a b", "a  b", "  ", "a\n b ", *plain, *_texts(1)]:
            assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == library(text), repr(text)


def test_cache_limit_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(S, "PIECES_HELD", 3)
    monkeypatch.setattr(S, "TOKENS_HELD", 3)
    for text in _texts(2, 40):
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == library(text)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_hash_is_minimal_and_perfect(n):
    keys = [f"key {i}".encode() for i in range(n)]
    index = S.build_hash(keys)
    assert sorted(S.find(index, keys).tolist()) == list(range(n))
    strangers = S.find(index, [f"other {i}".encode() for i in range(2_000)])
    assert (strangers >= 0).sum() <= 1


def _rows(seed):
    texts = _texts(seed, 60)
    rows = [(i * 3 - 20, t, "x") for i, t in enumerate(texts)]
    rows += [(4, "id again", "y"), (4, "id again", "y"), (None, "no id", "z"), (None, None, "z"), (77, None, ""), (78, "", ""), (10**15, "word " * 3000, "")]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_docs", [1 << 20, 9, 1])
def test_store_round_trip(spark, library, shard_docs):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    folder = S.write_store(df, PATH, shard_docs=shard_docs)
    read = S.read_store(spark, folder).collect()
    got = sorted((r["key"] is None, int(r["key"] or 0), tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["n_tokens"], r["ids_crc32"]) for r in read)
    want = []
    for d, text, _ in rows:
        ids = np.array([*library(text), 2], "<u4")
        want.append((d is None, d or 0, tuple(ids.tolist()), len(ids), zlib.crc32(ids.tobytes())))
    assert got == sorted(want)
    order = sorted(read, key=lambda r: (r["shard"], r["position"]))
    keys = [(r["key"] is None, int(r["key"] or 0)) for r in order]
    assert keys == sorted(keys)

    asked = spark.createDataFrame([(4,), (4,), (None,), (78,), (5,), (10**15,), (-10**6,)], "k long")
    found = sorted((r["key"] is None, int(r["key"] or 0), r["n_tokens"]) for r in S.fetch(spark, folder, asked).collect())
    assert found == sorted((a, b, n) for a, b, _, n, _ in want if a or b in (4, 78, 5, 10**15))


def test_payload_is_raw_ids(spark, library):
    df = spark.createDataFrame([(2, "b c"), (1, "a"), (3, None)], "doc_id long, text string")
    (file,) = [r["content"] for r in S._files(spark, S.write_store(df, PATH)).collect()]
    want = [*library("a"), 2, *library("b c"), 2, 2]
    assert np.frombuffer(bytes(file[:2 * len(want)]), "<u2").tolist() == want


def test_report(spark, library):
    rows = _rows(4)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted((r["start"], r["n_tokens"]) for r in S.store_report(df, PATH, shard_docs=10).collect())
    assert got[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))
    unique = [d for d, *_ in rows if d is not None and d != 4]
    by_id = {r["doc_id"]: r for r in S.store_report(df, PATH).collect()}
    for d, text, _ in rows:
        if d in unique:
            before = sum(len(library(t)) + 1 for o, t, _ in rows if o is not None and o < d)
            assert (by_id[d]["start"], by_id[d]["n_tokens"]) == (before, len(library(text)) + 1)


def test_string_keys_and_empty_table(spark, library):
    df = spark.createDataFrame([("b", "x y"), ("a", "z"), ("ü", "")], "doc_id string, text string")
    folder = S.write_store(df, PATH, shard_docs=1)
    assert {r["key"]: r["n_tokens"] for r in S.fetch(spark, folder, df.select("doc_id")).collect()} == {"a": 2, "b": 3, "ü": 1}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.store_report(empty, PATH).count() == 0
    folder = S.write_store(empty, PATH)
    assert S.fetch(spark, folder, spark.createDataFrame([(1,)], "k long")).count() == 0
