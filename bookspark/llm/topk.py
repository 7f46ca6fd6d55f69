"""Exact top-k search by inner product, columnar branch and bound.

Method.  Vectors lie in vertical layout, one array per dimension.  For a query,
the inner products with all candidates of a cell grow block of dimensions by
block.  What the remaining dimensions can add is bounded by the remaining mass
of both sides (Cauchy-Schwarz), so after each block every candidate whose upper
bound is below the k-th best lower bound is dropped and the survivors are
compacted.  Ties survive, hence the result is exact.

Scale.  Candidates and queries are hashed into cells of bounded size, each cell
of queries meets each cell of candidates in a task group of its own, and a group
returns k rows per query; the last step keeps the k best of those.  Nothing is
collected; the only figures that reach the driver are two counts.

Cases.  A vector that is null or holds a null or non-finite component takes no
part; vectors of different lengths meet as if the shorter were padded with
zeros; a null id is a candidate that sorts last among ties and is no query;
a row that repeats another's id and vector counts once; a candidate with the
query's id is the query's own.  Fewer than k candidates give fewer rows, an
empty table none.  A score that no long can hold is an error.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_CELL = 8_192
QUERY_CELL = 16_384
DIM_BLOCK = 16
NO_ID = np.iinfo(np.int64).max


def scaled(vec: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component as a long; null unless all are finite."""
    fine = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vertical layout: one row per dimension."""
    out = np.zeros((dims, len(column)), np.int64)
    for i, row in enumerate(column):
        values = row.values.to_numpy()
        out[:len(values), i] = values
    return out


def search_cell(ids: np.ndarray, cand: np.ndarray, query_id: int | None, query: np.ndarray, k: int, block: int = DIM_BLOCK,
                rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best candidates (columns of ``cand``) of one query: their positions and scores."""
    dims = len(query)
    rest = remaining_mass(cand, block) if rest is None else rest
    alive = np.flatnonzero(ids != query_id)
    score = np.zeros(len(alive), cand.dtype)
    columns, at = cand, alive  # survivors are the columns ``at`` of ``columns``
    for b, start in enumerate(range(0, dims, block)):
        stop = min(start + block, dims)
        score = score + (query[start:stop] @ columns[start:stop])[at]
        if len(alive) <= k or stop == dims:
            continue
        more = np.sqrt(float((query[stop:].astype(np.float64) ** 2).sum()) * rest[b + 1][alive])
        known = score.astype(np.float64)
        more = more * (1 + 1e-9) + abs(known) * 1e-12 + 1e-6  # rounding never drops a candidate
        kth = np.partition(known - more, len(alive) - k)[len(alive) - k]
        keep = known + more >= kth
        alive, at, score = alive[keep], at[keep], score[keep]
        if len(at) < columns.shape[1] // 2:
            columns, at = columns[:, at], np.arange(len(at))
    best = sorted(range(len(alive)), key=lambda i: (-score[i], ids[alive[i]]))[:k] if score.dtype == object else np.lexsort((ids[alive], -score))[:k]
    return alive[best], score[best]


def remaining_mass(cand: np.ndarray, block: int = DIM_BLOCK) -> np.ndarray:
    """Squared length of every candidate from each block of dimensions on."""
    starts = range(0, max(len(cand), 1), block)
    mass = [(cand[s:s + block].astype(np.float64) ** 2).sum(axis=0) for s in starts]
    return np.concatenate([np.cumsum(mass[::-1], axis=0)[::-1], np.zeros((1, cand.shape[1]))])


def _search_group(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out = {"query_id": [], "_qkey": [], "vec_id": [], "score": []}
    if candidates.num_rows and queries.num_rows:
        dims = max(max(len(v) for v in t["_vec"]) for t in (candidates, queries))
        cand, asked = _matrix(candidates["_vec"], dims), _matrix(queries["_vec"], dims)
        if dims * float(abs(cand).max(initial=0)) * float(abs(asked).max(initial=0)) < 2**53:
            cand, asked = cand.astype(np.float64), asked.astype(np.float64)  # exact, and fast
        else:
            cand, asked = cand.astype(object), asked.astype(object)
        ids = candidates["_id"].fill_null(NO_ID).to_numpy().astype(np.int64)
        null = candidates["_id"].is_null().to_numpy()
        rest = remaining_mass(cand)
        for q, (query_id, key) in enumerate(zip(queries["_id"].to_pylist(), queries["_qkey"].to_pylist())):
            at, score = search_cell(ids, cand, query_id, asked[:, q], k, rest=rest)
            out["query_id"] += [query_id] * len(at)
            out["_qkey"] += [key] * len(at)
            out["vec_id"] += [None if null[i] else int(ids[i]) for i in at]
            out["score"] += [int(s) for s in score]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
          candidate_cell: int = CANDIDATE_CELL, query_cell: int = QUERY_CELL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of the largest integer inner
    product with each row for which ``is_query`` holds, ties to the smaller id."""
    rows = (vectors.select(vectors[id_col].cast("long").alias("_id"), scaled(vectors[vec_col], scale).alias("_vec"),
                           F.coalesce(is_query, F.lit(False)).alias("_query"))
            .filter(F.col("_vec").isNotNull())
            .withColumn("_qkey", F.xxhash64("_id", "_vec")))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("_query")).first()
    cells, query_cells = -(-n // candidate_cell) or 1, -(-n_queries // query_cell) or 1
    rows = rows.dropDuplicates(["_id", "_vec"])
    candidates = (rows.select("_id", "_vec", F.pmod("_qkey", F.lit(cells)).alias("_cell"))
                  .withColumn("_qcell", F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1)))))
    queries = (rows.filter(F.col("_query") & F.col("_id").isNotNull())
               .select("_id", "_vec", "_qkey", F.pmod(F.shiftright("_qkey", 20), F.lit(query_cells)).cast("int").alias("_qcell"))
               .withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))))
    found = (candidates.groupBy("_cell", "_qcell").cogroup(queries.groupBy("_cell", "_qcell"))
             .applyInArrow(partial(_search_group, k=k), "query_id bigint, _qkey bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id", "_qkey").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
