"""Byte-level BPE encoding and decoding by a public rank file.

Method: overlapping chunk encoding.  A text of more than ``chunk_chars`` code
points is cut into chunks that overlap by ``overlap_chars``.  The chunks are
pre-tokenised in parallel, each from its own start.  Two neighbours are stitched
at the first piece end that both have inside their overlap: the pattern looks
only ahead, so from a shared end on both cut the same pieces.  Then every chunk
encodes the pieces between its two stitches.  A text whose neighbours share no
end in an overlap (one endless word) is cut again as a whole from there on.  A
text of one chunk takes the same steps with nothing to stitch.  Decoding
concatenates the raw bytes of the ids.

Scale: a short text is encoded in the task that scans it, without a shuffle;
only long texts move, one copy of each, chunk by chunk.  Nothing is collected;
the vocabulary (one rank file, read by the driver) is broadcast, and a task's
memory of encoded pieces is bounded by ``CACHE_PIECES``.

Cases: null and empty texts encode to no ids; repeated rows stay repeated; an
empty table gives an empty result; other columns pass through unchanged.
"""
from __future__ import annotations

import base64
from functools import partial

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookspark.session import write_and_reload

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
CACHE_PIECES = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PieceIds(dict):
    """Ids of a piece as little-endian 32-bit integers, merged once per piece and task."""

    def __init__(self, ranks: dict[bytes, int]):
        # One pre-token per call: the pattern takes all it is given.
        self.merge = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = np.array(self.merge(piece), "<u4").tobytes()
        self[piece] = ids
        return ids


def piece_ends(text: str, pattern: str) -> np.ndarray:
    """End offset of every match of the pattern, which covers the whole text."""
    return np.cumsum(np.fromiter(map(len, regex.findall(pattern, text)), np.int64))


def _encode_short(batches, ranks, pattern: str, text_at: int):
    ids, cut = PieceIds(ranks.value), regex.compile(pattern)
    for batch in batches:
        texts = batch.column(text_at)
        out = [b"".join(map(ids.__getitem__, cut.findall(t.as_py() or ""))) for t in texts]
        columns = [c for i, c in enumerate(batch.columns) if i != text_at]
        names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], [*names, "_ids"])


def _cut_chunks(batches, size: int, overlap: int):
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            starts = range(0, len(text), size)
            for at, start in enumerate(starts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()]), pa.array([at], pa.int32()), pa.array([at == len(starts) - 1]),
                     pa.array([text[start:start + size + overlap]])], ["_key", "_at", "_last", "_chunk"])


def _pretokenise(batches, pattern: str, size: int, overlap: int):
    """Piece ends of each chunk; ``_head`` and ``_tail`` hold those inside the
    overlaps with the chunk before and after, as offsets in the whole text.  A
    piece that touches the end of an unfinished chunk may go on: not counted."""
    for batch in batches:
        ends, heads, tails = [], [], []
        for at, last, chunk in zip(*(batch.column(c) for c in ("_at", "_last", "_chunk"))):
            chunk = chunk.as_py()
            e = piece_ends(chunk, pattern)
            if not last.as_py():
                e = e[e < len(chunk)]
            ends.append(e.astype(np.int32))
            start = at.as_py() * size
            heads.append(e[e < overlap] + start if at.as_py() else e[:0])
            tails.append(e[e > size] + start if not last.as_py() else e[:0])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(ends, pa.list_(pa.int32())), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
            [*batch.schema.names, "_ends", "_head", "_tail"])


def _encode_runs(batches, ranks, pattern: str, size: int):
    """Encodes the pieces of each run of chunks between its stitches ``_lo`` and ``_hi``."""
    ids = PieceIds(ranks.value)
    for batch in batches:
        out = []
        for run, lo, hi, chunks in zip(*(batch.column(c) for c in ("_run", "_lo", "_hi", "_chunks"))):
            chunks, start = chunks.as_py(), run.as_py() * size
            if len(chunks) == 1:
                text, ends = chunks[0]["_chunk"], np.array(chunks[0]["_ends"], np.int64)
            else:
                text = "".join([c["_chunk"][:size] for c in chunks[:-1]] + [chunks[-1]["_chunk"]])
                ends = piece_ends(text, pattern)
            lo, hi = lo.as_py() - start, hi.as_py() - start if hi.as_py() is not None else len(text)
            bounds = [lo, *ends[(ends > lo) & (ends <= hi)].tolist()]
            out.append(b"".join(ids[text[a:b]] for a, b in zip(bounds, bounds[1:])))
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_run"), pa.array(out, pa.binary())], ["_key", "_run", "_ids"])


def _encode_long(texts: DataFrame, ranks, pattern: str, size: int, overlap: int) -> DataFrame:
    """``(_key, _ids)`` of distinct long texts ``(_key, _text)``."""
    chunks = texts.mapInArrow(partial(_cut_chunks, size=size, overlap=overlap),
                              "_key string, _at int, _last boolean, _chunk string").repartition("_key", "_at")
    cut = write_and_reload(chunks.mapInArrow(
        partial(_pretokenise, pattern=pattern, size=size, overlap=overlap),
        "_key string, _at int, _last boolean, _chunk string, _ends array<int>, _head array<bigint>, _tail array<bigint>"), "bpe-chunks")
    order = Window.partitionBy("_key").orderBy("_at")
    stitch = F.array_min(F.array_intersect(F.lag("_tail").over(order), F.col("_head")))
    stitched = cut.select("_key", "_at", stitch.alias("_cut")).withColumn("_cut", F.when(F.col("_at") == 0, 0).otherwise(F.col("_cut")))
    # From the chunk before the first one that cannot be stitched on, the text is one run.
    loose = F.min(F.when(F.col("_cut").isNull(), F.col("_at") - 1)).over(Window.partitionBy("_key"))
    runs = (stitched.withColumn("_loose", loose)
            .withColumn("_run", F.least("_at", F.coalesce("_loose", "_at")))
            .withColumn("_hi", F.when(F.col("_run") < F.col("_at"), None).otherwise(F.lead("_cut").over(order)))
            .select("_key", "_at", "_run", F.when(F.col("_run") == F.col("_at"), F.col("_cut")).alias("_lo"),
                    F.when(F.col("_run") == F.coalesce(F.col("_loose"), F.lit(-1)), None).otherwise(F.col("_hi")).alias("_hi")))
    whole = (cut.select("_key", "_at", "_chunk", "_ends").join(runs, ["_key", "_at"])
             .groupBy("_key", "_run")
             .agg(F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"),
                  F.sort_array(F.collect_list(F.struct("_at", "_chunk", "_ends"))).alias("_chunks")))
    encoded = whole.mapInArrow(partial(_encode_runs, ranks=ranks, pattern=pattern, size=size), "_key string, _run int, _ids binary")
    return (encoded.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_run", "_ids"))).alias("_parts"))
            .select("_key", F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["_ids"])), "")).alias("_ids")))


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", ids_col: str = "ids",
           chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """All columns but the text, and ``ids_col``: the ids of the whole text as
    little-endian unsigned 32-bit integers in one binary value."""
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("the overlap must be positive and below the chunk")
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]
    held = [f"c{i}" for i in range(len(rest))]  # no name of the input can clash with ours
    rows = docs.select(*(docs[f"`{c}`"].alias(h) for c, h in zip(rest, held)), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema[h] for h in held] + [T.StructField("_ids", T.BinaryType())])
    is_long = F.length("_text") > chunk_chars
    short = rows.filter(~is_long).mapInArrow(partial(_encode_short, ranks=ranks, pattern=pattern, text_at=len(rest)), schema)
    key = F.sha2("_text", 256).alias("_key")
    texts = rows.filter(is_long).select(key, "_text").dropDuplicates(["_key"])
    encoded = _encode_long(texts, ranks, pattern, chunk_chars, overlap_chars)
    long = rows.filter(is_long).select(*held, key).join(encoded, "_key").select(*held, "_ids")
    return short.unionByName(long).select(*(F.col(h).alias(c) for h, c in zip(held, rest)), F.col("_ids").alias(ids_col))


def _decode_batches(batches, tokens, ids_at: int):
    token = tokens.value
    for batch in batches:
        out = [b"".join(map(token.__getitem__, np.frombuffer(i.as_py() or b"", "<u4").tolist())) for i in batch.column(ids_at)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "_raw"])


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """All columns and ``bytes_col``: the raw bytes of the ids, concatenated; a
    null has none.  An id without a token is an error."""
    ranks = load_ranks(ranks_path)
    tokens = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    rest = [c for c in encoded.columns if c != bytes_col]
    held = [f"c{i}" for i in range(len(rest))]
    rows = encoded.select(*(encoded[f"`{c}`"].alias(h) for c, h in zip(rest, held)))
    schema = T.StructType([*rows.schema.fields, T.StructField("_raw", T.BinaryType())])
    out = rows.mapInArrow(partial(_decode_batches, tokens=tokens, ids_at=rest.index(ids_col)), schema)
    return out.select(*(F.col(h).alias(c) for h, c in zip(held, rest)), F.col("_raw").alias(bytes_col))
