"""Filter interaction audit by contingency tensor contractions.

Method.  A document is reduced to five bits, one per filter, set where it fails.
Documents are counted per part and pattern of bits; a part's counts are a tensor of
shape 2x2x2x2x2 whose axes are the filters (0 passes, 1 fails), one tensor for all
documents, one for good and one for toxic ones.  Every figure of every order and
step is one contraction: along each axis a selector takes what passes, what fails,
or all of it, and ``einsum`` sums the rest.  So 120 orders cost nothing over the data.

Scale.  Texts are read once, in their tasks, and leave them as a digest, four bits
and counts.  Equal texts are found by that digest: the smallest id per digest is a
partial aggregate, and rows meet it under (digest, id), so a text that a third of all
documents hold is no hot key.  Counts are at most 32 rows per part.

Cases.  A null text is empty; a null part is the empty string; a null id has no smaller
id and is smaller than none, so it never fails E and makes no other fail.  Rows that
repeat an id are documents of their own and fail E only for a smaller id.  A document
is good (toxic) if any of its labels says so; null labels and labels of unknown
documents count for nothing.  A text longer than a piece keeps digests of its words
instead of the words.  An empty table has no parts, so no rows.  Other columns are
not read.
"""
from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookspark.llm.text import PIECE, word_pieces
from bookspark.session import write_and_reload

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
CAPITALS = bytes(range(65, 91))
CONTINUATION = bytes(range(128, 192))  # bytes of a code point after its first
MARKUP = re.compile(rb"[#$%&*|]")
SELECTORS = {"pass": (1, 0), "fail": (0, 1), "all": (1, 1)}


# --- the five bits ------------------------------------------------------------------

def _distinct_words(data: bytes) -> tuple[int, int]:
    """Words and distinct words of a text."""
    if len(data) <= PIECE:
        words = data.split()
        return len(words), len(set(words))
    kind = np.dtype([("a", "<u8"), ("b", "<u8")])
    total, kept = 0, np.empty(0, kind)
    for words in word_pieces(data, lower=False):
        total += len(words)
        digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in set(words))
        kept = np.unique(np.concatenate([kept, np.frombuffer(digests, kind)]))
    return total, len(kept)


def failed_bits(data: bytes) -> int:
    """Bits 0 to 3: whether the text fails A, B, C, D."""
    words, distinct = _distinct_words(data)
    points = len(data.translate(None, CONTINUATION))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return ((words < MIN_WORDS) | (100 * distinct < MIN_DISTINCT_PERCENT * words) << 1
            | (100 * capitals > MAX_CAPITAL_PERCENT * points) << 2 | (MARKUP.search(data) is not None) << 3)


def _bit_batches(batches):
    for batch in batches:
        bits, digests = [], []
        for text in batch.column("_text"):
            data = text.as_py()
            bits.append(int(failed_bits(data)))
            digests.append(hashlib.blake2b(data, digest_size=16).digest())
        kept = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(digests, pa.binary()), pa.array(bits, pa.int32())],
                                         [*(batch.schema.names[i] for i in kept), "_digest", "_bits"])


def failures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """``(_id, _part, _bits)`` of every row: bit i is set where it fails filter i of ABCDE."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("_part"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("_text"))
    read = write_and_reload(rows.mapInArrow(_bit_batches, f"_id {id_type}, _part string, _digest binary, _bits int"), "audit-bits")
    first = read.groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    later = F.col("_first").isNull() & F.col("_id").isNotNull()
    return (read.join(first, ["_digest", "_id"], "left")
            .select("_id", "_part", (F.col("_bits") + F.when(later, F.lit(16)).otherwise(F.lit(0))).alias("_bits")))


# --- contractions -------------------------------------------------------------------

def steps() -> list[tuple[str, int, dict[str, list[str]]]]:
    """Every order and step with the selection along each axis that each figure makes."""
    out = []
    for order in permutations(FILTERS):
        for at, mine in enumerate(order):
            before = set(order[:at])
            out.append(("".join(order), at + 1, {
                "kept": ["pass" if f in before or f == mine else "all" for f in FILTERS],
                "removed": ["pass" if f in before else "fail" if f == mine else "all" for f in FILTERS],
                "failing": ["fail" if f == mine else "all" for f in FILTERS],
                "unique_fails": ["fail" if f == mine else "pass" for f in FILTERS]}))
    return out


def contract(tensors: np.ndarray, selections: list[list[str]]) -> np.ndarray:
    """``[part, selection]``: the sum of each part's tensor over each selection."""
    chosen = np.array([[SELECTORS[s] for s in axes] for axes in selections], np.int64)
    # One axis at a time: what is left of a tensor after each selector.
    left = np.einsum("pabcde,sa->psbcde", tensors, chosen[:, 0])
    for axis, rest in ((1, "cde"), (2, "de"), (3, "e"), (4, "")):
        first = "bcde"[axis - 1]
        left = np.einsum(f"ps{first}{rest},s{first}->ps{rest}", left, chosen[:, axis])
    return left


def audit_tensors(tensors: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Figures ``[part, order and step]`` from the tensors ``all``, ``good`` and ``toxic`` ``[part, 2, 2, 2, 2, 2]``."""
    plan = steps()
    pick = {name: [axes[name] for _, _, axes in plan] for name in plan[0][2]}
    out = {name: contract(tensors["all"], pick[name]) for name in ("kept", "removed", "unique_fails")}
    out["redundant"] = contract(tensors["all"], pick["failing"]) - out["removed"]
    out["good_lost"], out["toxic_lost"] = (contract(tensors[t], pick["removed"]) for t in ("good", "toxic"))
    letters = np.array([FILTERS.index(order[step - 1]) for order, step, _ in plan])
    by_filter = np.stack([out["removed"][:, letters == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    out["shapley"] = by_filter[:, letters]
    return out


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _audit_batches(batches):
    plan = steps()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            parts, cells = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            tensors = {n: np.zeros((len(parts), 32), np.int64) for n in ("all", "good", "toxic")}
            for p, rows in enumerate(cells):
                for row in rows:
                    for name, tensor in tensors.items():
                        tensor[p, row["_bits"]] = row[name]
            # Bit 0 is filter A, the first axis, so the last axis counts fastest: reverse the axes.
            shaped = {n: t.reshape(-1, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1) for n, t in tensors.items()}
            figures = audit_tensors(shaped)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(parts, object), len(plan)), pa.string()), pa.array([o for o, _, _ in plan] * len(parts)),
                 pa.array([s for _, s, _ in plan] * len(parts), pa.int32()), *(pa.array(figures[n].reshape(-1)) for n in FIGURES)],
                ["part", "filter_order", "step", *FIGURES])


def audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step, with the counts of documents."""
    judged = (labels.filter(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("_id"))
              .agg(F.max((F.coalesce(labels["quality"], F.lit(0)) == 1).cast("int")).alias("_good"),
                   F.max((F.coalesce(labels["toxic"], F.lit(0)) == 1).cast("int")).alias("_toxic")))
    marked = failures(docs, text_col, id_col, part_col).join(judged, "_id", "left")
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long"))
    cells = (marked.groupBy("_part", "_bits")
             .agg(F.count(F.lit(1)).alias("all"), count("_good").alias("good"), count("_toxic").alias("toxic"))
             .groupBy("_part").agg(F.collect_list(F.struct("_bits", "all", "good", "toxic")).alias("cells")))  # at most 32 per part
    schema = "part string, filter_order string, step int, " + ", ".join(f"{n} bigint" for n in FIGURES)
    return cells.mapInArrow(_audit_batches, schema)
