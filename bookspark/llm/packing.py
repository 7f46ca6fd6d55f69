"""Packing into optimal length buckets.

Method.  Documents are counted by length into one global histogram.  Dynamic
programming over it chooses the bucket boundaries that minimise the padding
when every document is padded to its bucket's boundary.  Inside each bucket
batches of equal row count are formed such that rows times boundary stay within
the token budget; a document longer than the budget is a batch of its own.

Scale.  The histogram has one row per length class: each length up to 512, and
256 classes per doubling above, so at most some thousand rows at any size reach
the driver.  Sums of tokens are exact and a class stands for its longest document, so
a boundary is always a document's length.  Up to 512 tokens the padding is the least
possible; above, cuts inside a class are not tried, so no document's padding can
exceed that of the best cuts by more than 1/256 of its length.  A bucket may hold a third of all
documents: it is cut into shards of about ``SHARD_ROWS`` documents that are
numbered side by side, each with at most one unfilled batch.

Cases.  Null and empty texts have length 0, which counts as one padded token so
that every batch is finite; null ids and repeated rows are packed like any other;
an empty table gives an empty result; with fewer length classes than buckets
there are fewer buckets; other columns pass through ``pack`` unchanged, and an added
column whose name is taken gets a number behind it (:func:`added_names`).
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.llm.text import free_names

BUCKETS = 16
TOKEN_BUDGET = 65_536
SHARD_ROWS = 50_000
FINE = 256


def length_class(length: Column) -> Column:
    """Upper end of the length's class: itself up to ``2 * FINE``, then multiples of
    a step that doubles with the length."""
    length = F.greatest(length, F.lit(1)).cast("long")
    bits = F.greatest(F.floor(F.log2(length.cast("double"))) - int(np.log2(FINE)), F.lit(0)).cast("int")
    step = F.pow(F.lit(2.0), bits).cast("long")
    return F.ceil(length / step).cast("long") * step


def boundaries(lengths: np.ndarray, rows: np.ndarray, tokens: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Boundaries (some of the sorted ``lengths``) of at most ``buckets`` buckets with
    the least padding, and that padding.  ``rows`` and ``tokens`` are the sums of each length."""
    n = len(lengths)
    if not n:
        return [], 0
    c, t = np.concatenate([[0], np.cumsum(rows)]), np.concatenate([[0], np.cumsum(tokens)])
    cost = lengths * c[1:] - t[1:]  # one bucket up to each length
    cuts = []
    for _ in range(1, min(buckets, n)):
        best, cut = np.empty(n, np.int64), np.empty(n, np.int64)
        # The best last cut moves right with the end, so halves can be solved apart.
        spans = [(0, n - 1, 0, n - 1)]
        while spans:
            lo, hi, from_, to = spans.pop()
            if lo > hi:
                continue
            end = (lo + hi) // 2
            at = np.arange(from_, min(to, end) + 1)
            # Cut after ``at``: what is up to it is solved, the rest is one bucket; at == end adds none.
            with_cut = cost[at] + lengths[end] * (c[end + 1] - c[at + 1]) - (t[end + 1] - t[at + 1])
            k = int(np.argmin(with_cut))
            best[end], cut[end] = with_cut[k], at[k]
            spans += [(lo, end - 1, from_, int(at[k])), (end + 1, hi, int(at[k]), to)]
        cuts.append(cut)
        cost = best
    chosen, end = [], n - 1
    for cut in reversed(cuts):
        chosen.append(end)
        if cut[end] == end:
            chosen.pop()
        end = int(cut[end])
    return [int(lengths[i]) for i in sorted({*chosen, end})], int(cost[n - 1])


def choose_buckets(lengths: DataFrame, length_col: str, buckets: int = BUCKETS) -> tuple[list[int], int, int]:
    """Boundaries over the whole table, their padding, and the number of rows."""
    length = F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(1)).cast("long")
    histogram = (lengths.groupBy(length_class(length).alias("class"))
                 .agg(F.max(length).alias("longest"), F.count(F.lit(1)).alias("rows"), F.sum(length).alias("tokens"))
                 .orderBy("class").toPandas())
    found, padding = boundaries(*(histogram[c].to_numpy(np.int64) for c in ("longest", "rows", "tokens")), buckets)
    return found, padding, int(histogram["rows"].sum())


def added_names(columns: list[str]) -> dict[str, str]:
    """The names that ``pack`` gives its columns beside ``columns``."""
    return free_names(columns, ["bucket_tokens", "batch_id", "batch_rows"])


def assign(rows: DataFrame, length_col: str, found: list[int], n_rows: int, budget: int = TOKEN_BUDGET, order_by: list[str] | None = None,
           shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds ``bucket_tokens`` (the boundary), ``batch_id`` and ``batch_rows`` (the batch's room)."""
    bucket, batch, room = added_names(rows.columns).values()
    if not found:
        return rows.select("*", F.lit(None).cast("long").alias(bucket), F.lit(None).cast("string").alias(batch), F.lit(None).cast("long").alias(room))
    shards = -(-n_rows // shard_rows)
    length = F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(1)).cast("long")
    boundary = F.array_min(F.filter(F.array(*(F.lit(b).cast("long") for b in found)), lambda b: b >= length))
    order_by = order_by or []
    dealt = (rows.withColumn(bucket, boundary)
             .withColumn(room, F.greatest(F.floor(F.lit(budget) / F.col(bucket)), F.lit(1)).cast("long"))
             .withColumn(batch, F.pmod(F.xxhash64(F.monotonically_increasing_id(), length, *order_by), F.lit(shards))))
    place = Window.partitionBy(bucket, batch).orderBy(length, *order_by)
    number = F.floor((F.row_number().over(place) - 1) / F.col(room))
    return dealt.withColumn(batch, F.concat_ws("-", bucket, batch, number))


def pack(rows: DataFrame, length_col: str, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, order_by: list[str] | None = None,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All columns and the batch of each row."""
    found, _, n = choose_buckets(rows, length_col, buckets)
    return assign(rows, length_col, found, n, budget, order_by, shard_rows)
