"""Token ids as raw binary shards, with a minimal perfect hash index in each.

Format.  A store is a folder of shard files in ascending order of the document key.
A shard starts with its payload: the ids of its documents one after the other, each
document followed by the end id, as little-endian 16-bit numbers (32-bit if the
vocabulary needs them), without any header or padding.  Its index follows, then the
index's length and a mark.  The index is a minimal perfect hash over the distinct
keys of the shard: bit arrays by level, where a key owns a bit that no other key of
its level hashes to, and the rank of that bit is the key's slot.  A slot holds a
32-bit fingerprint of the key, the position of its first document and how many
follow; a table of ends gives offsets.  So a key costs one hash, a few bit probes
and one slice of the payload, at any shard size.  The keys are stored too, in order:
they list a shard's documents and make a lookup exact where a fingerprint is not.

Method.  Documents are dealt to shards by ranges of (key, hash of the text) and
sorted; a task encodes its range, streams the payload out and ends with the index.
Spark's text writer writes the files: its line separator is the end id, so a file
holds exactly the bytes above.  Readers take whole shards through Spark's binary
source and work on them in place; ``fetch`` reads only the shards that keys fall in.

Encoding.  The tokenizers library's model encodes each pre-token once; its ids are
remembered in a bounded cache.  A text of Latin letters, digits, ASCII marks and white
space is cut by the byte-level tokenizer's own rules.  Any other is cut where white
space follows other characters, where every pre-token ends, and the library's
pre-tokeniser cuts the pieces.  Tokenizers of another kind encode whole texts.

Scale.  A shard takes ``shard_bytes`` of text or ``shard_docs`` documents, more only
by one document or by chance of the range sample; texts meet one range shuffle and
ids none.  The driver sees one row per shard (its tokens, first and last key); with
10^14 bytes of text choose shards of 256 MB or more.

Cases.  A null or empty text is the end id alone.  A null key is a key, and the last.
Repeated keys keep all their documents, ordered by the hash of the text; rows that
repeat key and text are each stored.  Special tokens that a text spells are ordinary
text.  An empty table gives a folder without shards, no rows.  Other columns are not
read.  The end id's bytes must be below 128, because the separator is text.
"""
from __future__ import annotations

import io
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.session import BROADCAST_MAX_ROWS, local_df, scratch_path, write_and_reload

SHARD_BYTES = 32 << 20
SHARD_DOCS = 1 << 20
BLOCK_CHARS = 1 << 20
TOKENS_HELD = 100_000
PIECES_HELD = 60_000
HELD_CHARS = 40
MARK = b"IDSHARD1"
# The code points of Unicode's White_Space property.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD_GAP = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"  # Latin letters, whose class never changed
PLAIN = re.compile(f"[!-&(-~{LETTERS}]+")  # these, digits and printable marks, no apostrophe
# The tokenizer's own cuts, for texts of nothing but these characters and white space of ASCII.
CUTS = re.compile(f" ?[{LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}{LETTERS}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
OTHER = re.compile(f"[^!-~{LETTERS}\t\n\x0b\x0c\r ]")
RUNS = re.compile(f"[{LETTERS}]+|[0-9]+|[^0-9{LETTERS}]+")


# --- minimal perfect hash ---------------------------------------------------------

def _key_hashes(keys: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """64 bits to place each key and 32 more as its fingerprint."""
    salt = seed.to_bytes(8, "little")
    raw = b"".join(blake2b(k, digest_size=12, salt=salt).digest() for k in keys)
    parts = np.frombuffer(raw, np.dtype([("place", "<u8"), ("print", "<u4")]))
    return parts["place"].copy(), parts["print"].copy()


def _level_place(place: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key in a level: a mix of its place and the level's number."""
    x = place + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_hash(keys: list[bytes], load: float = 1.5) -> dict[str, np.ndarray]:
    """The minimal perfect hash of distinct keys: bits of all levels, ranks, level sizes, seed, and fingerprints by slot."""
    seed = 0
    place, fingerprint = _key_hashes(keys, seed)
    while len(np.unique(place)) < len(place):
        seed += 1
        place, fingerprint = _key_hashes(keys, seed)
    rest, sizes, bits = np.arange(len(keys)), [], [np.empty(0, np.uint64)]
    while len(rest):
        size = -(-max(64, int(len(rest) * load)) // 64) * 64
        at = _level_place(place[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        rest = rest[~alone[at]]
    words = np.concatenate(bits)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1].astype(np.uint32)
    index = {"bits": words, "ranks": ranks, "sizes": np.array(sizes, np.int64), "seed": np.array([seed])}
    by_slot = np.empty(len(keys), np.uint32)
    by_slot[_slots(index, place)] = fingerprint
    return index | {"fingerprints": by_slot}


def _slots(index: dict[str, np.ndarray], place: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has its bit."""
    slots, todo, start = np.full(len(place), -1, np.int64), np.arange(len(place)), 0
    for level, size in enumerate(index["sizes"]):
        at = _level_place(place[todo], level, int(size))
        word, bit = start + (at >> 6), (at & 63).astype(np.uint64)
        mine = index["bits"][word]
        here = (mine >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(mine & ((np.uint64(1) << bit) - np.uint64(1)))
        slots[todo[here]] = (index["ranks"][word] + below)[here]
        todo, start = todo[~here], start + int(size) // 64
    return slots


def find(index: dict[str, np.ndarray], keys: list[bytes]) -> np.ndarray:
    """Slot of each key; -1 if the shard does not hold it, but for a chance of 2^-32."""
    if not len(index["fingerprints"]):
        return np.full(len(keys), -1, np.int64)
    place, fingerprint = _key_hashes(keys, int(index["seed"][0]))
    slots = _slots(index, place)
    return np.where((slots >= 0) & (index["fingerprints"][slots] == fingerprint), slots, -1)


# --- encoding -----------------------------------------------------------------------

class Held(dict):
    """A bounded cache in two generations, so that what is used again stays."""

    def __init__(self, first=()):
        super().__init__(first)
        self.old = {}

    def limit(self) -> int:
        return PIECES_HELD

    def hold(self, key: str, value: bytes) -> bytes:
        if len(self) >= self.limit():
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds(Held):
    """Id bytes of a pre-token, by the library's model."""

    def __init__(self, tokenizer, dtype: np.dtype, single: dict[str, int]):
        code = "HI"[dtype.itemsize // 4]
        super().__init__()
        self.single = {word: array(code, [i]).tobytes() for word, i in single.items()}
        self.tokenize, self.code = tokenizer.model.tokenize, code

    def encode(self, word: str) -> bytes:
        return self.single.get(word) or array(self.code, [t.id for t in self.tokenize(word)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word) or self.encode(word)
        return self.hold(word, ids) if len(word) <= HELD_CHARS else ids


class CharNames(dict):
    """How the library writes the bytes of a character."""

    def __init__(self, tokenizer):
        super().__init__()
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, char: str) -> str:
        name = self[char] = "".join(word for word, _ in self.cut(char))
        return name


class TokenIds(Held):
    """Id bytes of a pre-token as the text spells it."""

    def __init__(self, words: WordIds, names: CharNames):
        super().__init__()
        self.words, self.names = words, names

    def limit(self) -> int:
        return TOKENS_HELD

    def __missing__(self, token: str) -> bytes:
        ids = self.old.get(token) or self.words.encode("".join(map(self.names.__getitem__, token)))
        return self.hold(token, ids) if len(token) <= HELD_CHARS else ids


class PieceIds(Held):
    """Id bytes of a piece of text between spaces, with ``lead`` before it."""

    def __init__(self, tokenizer, words: WordIds, lead: str = ""):
        super().__init__()
        self.cut, self.words, self.lead = tokenizer.pre_tokenizer.pre_tokenize_str, words, lead
        self.names = CharNames(tokenizer)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if PLAIN.fullmatch(piece):
                # Runs of letters, of digits and of marks are pre-tokens; a space goes with the first.
                runs = RUNS.findall(piece)
                if not piece.isascii():
                    runs = ["".join(map(self.names.__getitem__, run)) for run in runs]
                if self.lead:
                    runs[0] = self.names[self.lead] + runs[0]
            else:
                runs = [word for word, _ in self.cut(self.lead + piece)]
            ids = b"".join([self.words[run] for run in runs])
        return self.hold(piece, ids) if len(piece) <= HELD_CHARS else ids


def single_words(tokenizer) -> dict[str, int]:
    """The vocabulary's words that the model gives their own id."""
    return {w: i for w, i in tokenizer.get_vocab(with_added_tokens=False).items() if [t.id for t in tokenizer.model.tokenize(w)] == [i]}


class Encoder:
    """Id bytes of whole texts, equal to those of ``encode(text, add_special_tokens=False)``."""

    def __init__(self, tokenizer_json: str, single: dict[str, int] | None = None):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        cut = self.tokenizer.pre_tokenizer
        self.by_piece = isinstance(cut, pre_tokenizers.ByteLevel) and not cut.add_prefix_space and self.tokenizer.normalizer is None
        words = WordIds(self.tokenizer, self.dtype, single or {})
        self.tokens = TokenIds(words, CharNames(self.tokenizer))
        self.segments = PieceIds(self.tokenizer, words)
        self.after_space = PieceIds(self.tokenizer, words, " ")

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self._block, blocks(text)))

    def _block(self, text: str) -> bytes:
        if not OTHER.search(text):
            return b"".join(map(self.tokens.__getitem__, CUTS.findall(text)))
        if any(c in text and c + " " in text for c in SPACE):
            return b"".join(map(self.segments.__getitem__, SEGMENT.findall(text)))
        first, *rest = text.split(" ")
        # Only the last may be empty: a space that nothing follows.
        return (self.segments[first] if first else b"") + b"".join(map(self.after_space.__getitem__, rest))


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """A long text in blocks that begin with a space between words, so their ids join to the text's."""
    start = 0
    while len(text) - start > size:
        gap = WORD_GAP.search(text, start + size)
        if not gap:
            break
        yield text[start:gap.start()]
        start = gap.start()
    yield text[start:] if start else text


# --- writing ------------------------------------------------------------------------

def _key_bytes(key: str | None) -> bytes:
    return b"\0" if key is None else b"\1" + key.encode("utf-8", "surrogatepass")


def _key_text(key: bytes) -> str | None:
    return None if key == b"\0" else key[1:].decode("utf-8", "surrogatepass")


def shard_index(shard: int, keys: list[bytes], counts: list[int], width: int) -> bytes:
    """The index of a shard: documents ``counts`` ids long under sorted ``keys``."""
    distinct = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
    own = [keys[i] for i in distinct]
    index = build_hash(own)
    slots = find(index, own)
    first, run = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    first[slots], run[slots] = distinct, np.diff([*distinct, len(keys)])
    out = io.BytesIO()
    np.savez(out, **index, first=first, run=run, ends=np.cumsum(np.array(counts, np.int64)), shard=np.array([shard, width]),
             key_sizes=np.fromiter(map(len, own), np.int64, len(own)), keys=np.frombuffer(b"".join(own), np.uint8))
    return out.getvalue()


def _write_batches(batches, tokenizer):
    encoder, keys, counts = Encoder(*tokenizer.value), [], []
    width = encoder.dtype.itemsize
    for batch in batches:
        out, held = [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encoder.encode(text.as_py())
            keys.append(_key_bytes(key))
            counts.append(len(ids) // width + 1)
            out.append(ids)
            held += len(ids)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
    if keys:
        index = shard_index(TaskContext.get().partitionId(), keys, counts, width)
        yield pa.RecordBatch.from_arrays([pa.array([index + len(index).to_bytes(8, "little") + MARK], pa.binary())], ["value"])


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id",
                shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS, folder: str | None = None) -> str:
    """Encodes all documents into a new store; returns its folder."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = file.read()
    library = Tokenizer.from_str(tokenizer)
    separator = np.array([end_id], id_type(library.get_vocab_size())).tobytes()
    if any(b > 127 for b in separator):
        raise ValueError(f"end id {end_id} has a byte above 127")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("_id"), text.alias("_text"))
    size, count = rows.agg(F.sum(F.octet_length("_text").cast("long")), F.count(F.lit(1))).first()
    shards = max(1, -(-(size or 0) // shard_bytes), -(-count // shard_docs))
    order = [F.asc_nulls_last("_id"), F.asc("_th")]
    shipped = spark.sparkContext.broadcast((tokenizer, single_words(library)))  # the vocabulary: its file bounds it
    payload = (rows.withColumn("_th", F.xxhash64("_text")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
               .select(F.col("_id").cast("string").alias("_key"), "_text")
               .mapInArrow(partial(_write_batches, tokenizer=shipped), "value binary")
               .select(F.col("value").cast("string").alias("value")))
    folder = folder or scratch_path(spark, "token-store")
    payload.write.option("lineSep", separator.decode("ascii")).option("maxRecordsPerFile", 0).option("compression", "none").text(folder)
    return folder


# --- reading ------------------------------------------------------------------------

class Shard:
    """One shard file in memory."""

    def __init__(self, data: bytes):
        width = 4 if data[-12:-4] == MARK else 2
        if data[-width - 8:-width] != MARK:
            raise ValueError("not a shard of token ids")
        stop = len(data) - width - 16
        start = stop - int.from_bytes(data[stop:stop + 8], "little")
        with np.load(io.BytesIO(data[start:stop])) as arrays:
            self.index = dict(arrays)
        self.number = int(self.index["shard"][0])
        self.ids = np.frombuffer(data, f"<u{width}", start // width)
        self.ends = self.index["ends"]
        stops = np.cumsum(self.index["key_sizes"])
        raw = self.index["keys"].tobytes()
        self.keys = [raw[e - n:e] for n, e in zip(self.index["key_sizes"], stops)]
        self.key_at = {}

    def documents(self, keys: list[bytes]) -> Iterator[tuple[int, int]]:
        """``(which of the keys, position of the document)`` for each document that a key has here."""
        slots = find(self.index, keys)
        found = np.flatnonzero(slots >= 0)
        for k, first, run in zip(found, self.index["first"][slots[found]], self.index["run"][slots[found]]):
            if self._key_of(int(first)) == keys[k]:
                yield from ((int(k), at) for at in range(int(first), int(first + run)))

    def _key_of(self, position: int) -> bytes:
        if not self.key_at:
            firsts = np.sort(self.index["first"])
            self.key_at = dict(zip(firsts.tolist(), self.keys))
        return self.key_at[position]

    def span(self, position: int) -> tuple[int, int]:
        return int(self.ends[position - 1]) if position else 0, int(self.ends[position])


FIELDS = {"shard": pa.int32(), "position": pa.int64(), "key": pa.string(), "offset": pa.int64(), "n_tokens": pa.int64(),
          "ids_crc32": pa.int64(), "ids": pa.binary()}
SCHEMA = "shard int, position bigint, key string, offset bigint, n_tokens bigint, ids_crc32 bigint, ids binary"


def _read_keys(data: bytes, keys: list[bytes] | None, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The documents of a shard under the keys (all of its own, if none are given)."""
    shard = Shard(data)
    asked = shard.keys if keys is None else keys
    rows, held = {name: [] for name in FIELDS}, 0
    for k, position in shard.documents(asked):
        start, stop = shard.span(position)
        ids = shard.ids[start:stop].astype("<u4").tobytes()
        for name, value in zip(FIELDS, (shard.number, position, _key_text(asked[k]), start, stop - start, zlib.crc32(ids), ids if with_ids else None)):
            rows[name].append(value)
        held += len(ids) if with_ids else 16
        if held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in FIELDS.items()], list(FIELDS))
            rows, held = {name: [] for name in FIELDS}, 0
    yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in FIELDS.items()], list(FIELDS))


def _read_batches(batches, with_ids: bool):
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_py()
            if data:
                yield from _read_keys(data, None, with_ids)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def read_store(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Every document of a store, found through the index of its shard: ``shard``, ``position`` in it, ``key``
    as text, ``offset`` in ids, ``n_tokens`` and ``ids_crc32`` (of 32-bit ids) with the end id, and the ``ids``."""
    return _files(spark, folder).mapInArrow(partial(_read_batches, with_ids=with_ids), SCHEMA)


def _describe_batches(batches):
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            data = content.as_py()
            if data:
                shard = Shard(data)
                yield pa.RecordBatch.from_pylist([{
                    "path": path.as_py(), "shard": shard.number, "first": _key_text(shard.keys[0]), "last": _key_text(shard.keys[-1]),
                    "n_docs": len(shard.ends), "n_tokens": int(shard.ends[-1])}], DIRECTORY_ARROW)


DIRECTORY_ARROW = pa.schema([("path", pa.string()), ("shard", pa.int32()), ("first", pa.string()), ("last", pa.string()),
                             ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard: its file, first and last key, documents and tokens."""
    schema = "path string, shard int, first string, last string, n_docs bigint, n_tokens bigint"
    return write_and_reload(_files(spark, folder).mapInArrow(_describe_batches, schema), "token-directory")


def _deal_batches(batches, firsts, lasts, paths):
    """Each key to every shard whose range holds it; ranges are in order, a null key is the last."""
    order = lambda key: (key is None, key if not isinstance(key, str) else key.encode("utf-8", "surrogatepass"))
    lows, highs = [order(k) for k in firsts], [order(k) for k in lasts]
    for batch in batches:
        dealt = [(paths[s], key) for id_, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                 for s in range(bisect_left(highs, order(id_)), bisect_right(lows, order(id_)))]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in dealt], pa.string()), pa.array([k for _, k in dealt], pa.string())], ["path", "key"])


def _fetch_group(files: pa.Table, keys: pa.Table, with_ids: bool) -> pa.Table:
    asked = [_key_bytes(k) for k in keys["key"].to_pylist()]
    found = [b for content in files["content"] if asked for b in _read_keys(content.as_py(), asked, with_ids)]
    return pa.Table.from_batches(found, pa.schema(list(FIELDS.items())))


def fetch(spark: SparkSession, folder: str, keys: DataFrame, shards: DataFrame | None = None, with_ids: bool = True) -> DataFrame:
    """The documents under the keys (first column of ``keys``; their type orders the shards), as ``read_store`` gives them.
    Only shards in whose range a key falls are read.  ``shards`` is the store's ``directory``."""
    shards = directory(spark, folder) if shards is None else shards
    kind = keys.schema[0].dataType
    listed = shards.select("path", "shard", F.col("first").cast(kind).alias("first"), F.col("last").cast(kind).alias("last")).orderBy("shard").collect()
    paths = [r["path"] for r in listed]
    key = F.col(f"`{keys.columns[0]}`")
    dealt = write_and_reload(
        keys.select(key.alias("id")).distinct().select("id", F.col("id").cast("string").alias("key"))
        .mapInArrow(partial(_deal_batches, firsts=[r["first"] for r in listed], lasts=[r["last"] for r in listed], paths=paths), "path string, key string"),
        "token-keys")
    touched = [r["path"] for r in dealt.select("path").distinct().collect()]
    if not touched:
        return local_df(spark, [], SCHEMA)
    return (_files(spark, touched).groupBy("path").cogroup(dealt.groupBy("path"))
            .applyInArrow(partial(_fetch_group, with_ids=with_ids), SCHEMA))


def store_report(docs: DataFrame, tokenizer_path: str, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id",
                 shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes a store and reads it back: ``id_col``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``, ``shard``."""
    spark = docs.sparkSession
    folder = write_store(docs, tokenizer_path, end_id, text_col, id_col, shard_bytes, shard_docs)
    read = write_and_reload(read_store(spark, folder, with_ids=False).drop("ids"), "token-documents")
    base, bases = 0, []
    for shard, total in read.groupBy("shard").agg(F.sum("n_tokens")).orderBy("shard").collect():  # one row per shard
        bases.append((shard, base))
        base += total
    before = local_df(spark, bases, "shard int, base bigint")
    before = F.broadcast(before) if len(bases) <= BROADCAST_MAX_ROWS else before
    return read.join(before, "shard").select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col),
                                             (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard")
