"""SimHash near-dedup: fingerprints, links within a bit distance, components.

Method.  A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit
segments.  One differing bit moves one count by one, so the Manhattan distance
of two embeddings is a lower bound of the bit distance.  Candidates come from a
range join on that grid: of ``BLOCKS`` blocks of segments, two points within
distance ``d`` agree exactly in at least ``BLOCKS - d`` blocks, so each point is
filed under every choice of that many blocks (a grid cell), and only points of
one cell are compared: Manhattan distance first, exact bit distance last.

Scale.  Only distinct fingerprints are joined (copies are folded before the
shuffle).  A cell of more than ``CELL_ROWS`` fingerprints is cut into row blocks
that meet pair by pair in tasks of their own; a task never holds more than two
blocks.  Comparison runs inside the task and returns only the edges of a
spanning forest, never all pairs.  Components are found by alternating star
joins over written tables; no link is collected to the driver.

Cases.  Null and empty texts have fingerprint zero and are linked like any
other; a null id keeps its row and is ignored when the smallest id is taken
(a component of null ids alone has a null component_id); repeated rows stay
repeated; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookspark.llm.text import to_bytes, word_pieces
from bookspark.session import write_and_reload

SEED = 42
BLOCKS = 5
CELL_ROWS = 2048
LOW = 0x5555555555555555


# --- fingerprints ---------------------------------------------------------------

def _shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Hashes of the space-joined word shingles, one array per piece of the text;
    a text shorter than a shingle is hashed whole, a text without words gives none."""
    carry: list[bytes] = []
    any_shingle = False
    for words in word_pieces(to_bytes(text)):
        words = carry + words
        n = len(words) - width + 1
        if n > 0:
            any_shingle = True
            joined = map(b" ".join, zip(*(words[i:] for i in range(width))))
            yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64, n)
        carry = words[-(width - 1):] if width > 1 else []
    if not any_shingle and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint_of(text: str | None, width: int) -> int:
    """SimHash of one text: a bit is 1 if it is set in over half the hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes(text, width):
        for part in np.split(hashes, range(65536, len(hashes), 65536)):
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(part)
    set_bits = np.packbits(ones * 2 > total, bitorder="little") if total else np.zeros(8, np.uint8)
    return int(set_bits.view("<i8")[0])


def _fingerprint_batches(batches, width: int, text_at: int):
    for batch in batches:
        values = [fingerprint_of(t.as_py(), width) for t in batch.column(text_at)]
        columns = [c for i, c in enumerate(batch.columns) if i != text_at]
        names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.int64())], [*names, "_fp"])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle_words: int = 3) -> DataFrame:
    """``(_id, _fp)``: the 64-bit SimHash of every row as a signed long."""
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _fp bigint"
    return rows.mapInArrow(partial(_fingerprint_batches, width=shingle_words, text_at=1), schema)


# --- candidate search -----------------------------------------------------------

def _block_masks(blocks: int) -> list[int]:
    """Bit masks that share the 32 two-bit segments out over the blocks."""
    edges = [round(i * 32 / blocks) for i in range(blocks + 1)]
    return [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def segment_counts(fp):
    """Bit counts of the two-bit segments, written in unary (0, 1 or 2 ones), so
    that the Manhattan distance of two embeddings is the bit count of their XOR."""
    one = F.shiftrightunsigned(fp, 1)
    return (fp.bitwiseOR(one).bitwiseAND(F.lit(LOW))).bitwiseOR(
        F.shiftleft(fp.bitwiseAND(one).bitwiseAND(F.lit(LOW)), 1))


def _cells(fps: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """One row for each fingerprint and each choice of ``blocks - max_bits`` blocks."""
    masks = _block_masks(blocks)
    keep = list(combinations(range(blocks), blocks - max_bits))
    keys = [F.struct(F.lit(i).alias("_kind"), F.col("_emb").bitwiseAND(F.lit(_signed(sum(masks[b] for b in chosen)))).alias("_cell"))
            for i, chosen in enumerate(keep)]
    return (fps.select("_fp", segment_counts(F.col("_fp")).alias("_emb"))
            .select("_fp", F.explode(F.array(*keys)).alias("_key"))
            .select("_fp", "_key.*"))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the smallest row known of each row's component) after the links (a, b)."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    while (label != label[label]).any():
        label = label[label]
    return label


def _forest(fps: np.ndarray, run: np.ndarray, side: np.ndarray, max_bits: int) -> np.ndarray:
    """For each of the rows, sorted by run, the smallest row that its links reach.
    ``side`` is 0 for rows that meet all rows of their run, else 1 or 2 for rows
    that meet only the other side.  Rows already together are not compared again,
    and links are merged as they come, so memory follows the rows, not the pairs."""
    one, low = fps >> np.uint64(1), np.uint64(LOW)
    emb = ((fps | one) & low) | ((fps & one & low) << np.uint64(1))
    label, held, n_held = np.arange(len(fps)), [], 0
    step, rows = 1, np.arange(len(fps) - 1)
    while len(rows):
        rows = rows[:np.searchsorted(rows, len(fps) - step)]
        rows = rows[run[rows] == run[rows + step]]
        near = rows[(label[rows] != label[rows + step]) & ((side[rows] == 0) | (side[rows] != side[rows + step]))]
        near = near[np.bitwise_count(emb[near] ^ emb[near + step]) <= max_bits]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= max_bits]
        held.append((near, near + step))
        n_held += len(near)
        if n_held > len(fps):
            label, held, n_held = _merge(label, *map(np.concatenate, zip(*held))), [], 0
        step += 1
    return _merge(label, *map(np.concatenate, zip(*held))) if held else label


def _edges_of(table: pa.Table, max_bits: int) -> pa.RecordBatch:
    fps = table["_fp"].to_numpy().astype(np.int64).view(np.uint64)
    key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("_kind", "_cell", "_pair")])
    run = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))]) if len(fps) else np.empty(0, int)
    root = _forest(fps, run, table["_side"].to_numpy(), max_bits)
    child = np.flatnonzero(root != np.arange(len(fps)))
    signed = fps.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[root[child]])], ["_a", "_b"])


def _edge_batches(batches, max_bits: int):
    """Rows arrive sorted by cell.  Whole cells are compared together; the last,
    perhaps unfinished cell of a batch waits for the next batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        n = table.num_rows
        if not n:
            continue
        same = np.ones(n, bool)
        for c in ("_kind", "_cell", "_pair"):
            values = table[c].to_numpy()
            same &= values == values[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = table.slice(cut).combine_chunks()
        if cut:
            yield _edges_of(table.slice(0, cut).combine_chunks(), max_bits)
    if held is not None and held.num_rows:
        yield _edges_of(held, max_bits)


def links(fps: DataFrame, max_bits: int = 3, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges ``(_a, _b)`` of a spanning forest of the fingerprints (distinct longs in
    ``_fp``) that differ in at most ``max_bits`` bits."""
    if not 0 <= max_bits < blocks <= 32:
        raise ValueError("max_bits must be below the number of blocks, and that at most 32")
    cells = _cells(fps, max_bits, blocks)
    large = (cells.groupBy("_kind", "_cell").count().filter(F.col("count") > cell_rows)
             .select("_kind", "_cell", F.ceil(F.col("count") / (cell_rows / 2)).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64("_fp"), F.col("_parts")).cast("int")
    mine = F.struct(F.least("_part", "_other").alias("lo"), F.greatest("_part", "_other").alias("hi"))
    cut = (cells.join(large, ["_kind", "_cell"]).withColumn("_part", part)
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
           .withColumn("_mine", mine)
           .select("_fp", "_kind", "_cell", (F.col("_mine.lo") * F.col("_parts") + F.col("_mine.hi")).cast("long").alias("_pair"),
                   F.when(F.col("_part") == F.col("_other"), 0).when(F.col("_part") < F.col("_other"), 1).otherwise(2).alias("_side")))
    small = (cells.join(large, ["_kind", "_cell"], "left_anti")
             .select("_fp", "_kind", "_cell", F.lit(-1).cast("long").alias("_pair"), F.lit(0).alias("_side")))
    dealt = small.unionByName(cut)
    sorted_cells = (dealt.repartition("_kind", "_cell", "_pair")
                    .sortWithinPartitions("_kind", "_cell", "_pair"))
    return sorted_cells.mapInArrow(partial(_edge_batches, max_bits=max_bits), "_a bigint, _b bigint").distinct()


# --- components -----------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """``(_node, _label)`` for every node of the edges ``(_a, _b)``: the smallest
    node of its component, by alternating large-star and small-star rounds.  Each
    round is written to the shared folder, so lineage stays short and a lost
    executor repeats one round at most."""
    edges = write_and_reload(
        edges.filter("_a != _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        low = both.groupBy("_a").agg(F.min("_b").alias("_m")).withColumn("_m", F.least("_a", "_m"))
        large = both.join(low, "_a").filter("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).distinct()
        low = large.groupBy("_a").agg(F.min("_b").alias("_m"))
        small = (large.join(low, "_a").select(F.explode(F.array(
            F.struct(F.col("_a"), F.col("_m").alias("_b")), F.struct(F.col("_b").alias("_a"), F.col("_m").alias("_b")))).alias("_e"))
            .select("_e.*").filter("_a != _b").distinct())
        edges = write_and_reload(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("_a", "_b"))).first())
        if now == seen:
            nodes = edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_label"))
            return nodes.unionByName(edges.select(F.col("_b").alias("_node"), F.col("_b").alias("_label")).distinct())
        seen = now


# --- the operator ---------------------------------------------------------------

def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle_words: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """Every row's ``(id_col, fingerprint, component_id)``: 16 lower-case hex digits,
    and the smallest id reachable over links of at most ``max_bits`` differing bits."""
    fps = write_and_reload(fingerprints(docs, text_col, id_col, shingle_words), "simhash")
    distinct = fps.groupBy("_fp").agg(F.min("_id").alias("_min"))
    found = components(links(distinct.select("_fp"), max_bits))
    labelled = (distinct.join(found, distinct["_fp"] == found["_node"], "left")
                .select("_fp", "_min", F.coalesce("_label", "_fp").alias("_label")))
    labelled = write_and_reload(labelled, "simhash-labels")
    smallest = labelled.groupBy("_label").agg(F.min("_min").alias("component_id"))
    by_fp = labelled.join(smallest, "_label").select("_fp", "component_id")
    return fps.join(by_fp, "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each near-duplicate component, with all columns: the row whose id
    is the component's smallest.  Rows with a null id are kept only where their
    component has no other id (and then all of them, as nothing tells them apart);
    of rows that repeat the smallest id one is kept."""
    found = write_and_reload(near_duplicates(docs, text_col, id_col, shingle_words, max_bits).select(F.col(id_col).alias("_keep"), "component_id"), "simhash-found")
    keep = found.filter(F.col("_keep").eqNullSafe(F.col("component_id"))).groupBy("_keep").agg(F.count(F.lit(1)).alias("_n"))
    n, kept = keep["_n"], keep["_keep"]
    place = "_place"
    while place in docs.columns:
        place += "_"
    order = Window.partitionBy(docs[id_col]).orderBy(F.xxhash64(*[docs[f"`{c}`"].cast("string") for c in docs.columns]))
    rows = docs.join(keep, docs[id_col].eqNullSafe(kept))  # texts are shuffled once; both branches read that exchange
    own = [docs[f"`{c}`"] for c in docs.columns]
    single = rows.filter((n == 1) | kept.isNull()).select(*own)
    first = rows.filter((n > 1) & kept.isNotNull()).select(*own, F.row_number().over(order).alias(place)).filter(F.col(place) == 1).drop(place)
    return single.unionByName(first)
