import base64
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from bookspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rnd = random.Random(7)
    alphabet = ["the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "日本", "12", "!", "?!", "<|endoftext|>", " ", "　", "x", "🙂", "\x1c", "\x85"]
    out = ["", None, " ", "a", "   b", "ends  ", "\n\n\n"]
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([3, 40, 900]))) for _ in range(40)]
    out += ["z" * 700, " " * 650 + "q", "ab " * 200 + "w" * 500 + " cd" * 100, "'s" * 300, "\n " * 400]
    return out


def test_matches_the_library_and_round_trips(spark):
    enc = _reference()
    texts = _texts()
    rows = [(i, t, "keep") for i, t in enumerate(texts)] + [(0, "w w " * 90, "twice"), (0, "w w " * 90, "twice"), (None, "n n" * 90, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string").withColumn("_ids", F.lit(1)).withColumn("c0", F.lit("c")).withColumn("_text", F.lit("t"))
    for size, overlap in ((64, 16), (100_000, 100), (50, 49)):
        encoded = bpe.encode(df, PATH, chunk_chars=size, overlap_chars=overlap)
        got = bpe.decode(encoded, PATH).collect()
        have = sorted(((r["doc_id"], r["_key"], bytes(r["ids"]), bytes(r["bytes"])) for r in got), key=str)
        want = []
        for i, t, note in rows:
            ids = enc.encode_ordinary(t or "")
            want.append((i, note, b"".join(x.to_bytes(4, "little") for x in ids), (t or "").encode()))
        assert have == sorted(want, key=str), (size, overlap)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH), PATH).count() == 0
