"""Embedding whitening by a covariance weighted with multiplicities.

Method.  Entries become integers, equal vectors are grouped and counted.  The model
is fitted on the distinct vectors, each with weight one or with its count: the
weighted sums per dimension are exact integers, and the covariance is a sum of
weighted products of centred blocks, one matrix product per batch.  Its unit
eigenvectors, by falling eigenvalue, are the components.  Each distinct vector is
centred, projected and scaled once, and the results are joined back to the rows.

Scale.  A vector that a third of all rows hold is one row after the partial
aggregation.  Tasks return one partial sum of d numbers and one of d x d, which Spark
adds up; the driver holds d x d numbers (d dimensions), never vectors.  Rows and
whitened vectors meet on a 128-bit digest of the vector.  A vector that more than one
row in ``HOT_SHARE`` holds is joined by broadcast: there are at most ``HOT_SHARE`` of
those, whatever the table's size; all others by shuffle, where no key has more rows.

Cases.  Vectors that are null or hold null or non-finite entries take no part.
Shorter vectors are filled up with zeros.  Repeated rows each get their result; a null
id is kept.  A component without variance (its eigenvalue is within rounding of zero)
has a null ``whitened``, and ``identity_error`` covers the others; with no variance at
all, as for a single vector, ``explained`` and ``identity_error`` are null.  With fewer dimensions than
components there are as many as dimensions.  An empty table gives no rows; other columns are not read.
``deviation`` is a decimal of 38 digits; what does not fit is an error, as is an entry
that no long can hold.
"""
from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookspark.session import write_and_reload

HOT_SHARE = 4_096
BLOCK_ROWS = 4_096


def integers(vec: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every entry as a long; null unless all are finite."""
    fine = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")))


def distinct_vectors(vectors: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """``(x, rows)``: every distinct vector of integers, all of one length, and how many rows hold it."""
    x = vectors.select(integers(vectors[vec_col], scale).alias("x")).filter(F.col("x").isNotNull())
    return x.groupBy("x").agg(F.count(F.lit(1)).alias("rows"))


def _padded(x: Column, dims: int) -> Column:
    return F.when(F.size(x) < dims, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size(x)))).otherwise(x)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers; an Arrow list column whose lists are all ``dims`` long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _blocks(batches, dims: int, weighted: bool):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x = _matrix(part.column("x"), dims)
            yield part, x, part.column("rows").to_numpy() if weighted else np.ones(len(x), np.int64)


def _sum_batches(batches, dims: int, weighted: bool):
    """Exact weighted sums per dimension and the sum of weights (as dimension -1)."""
    sums, total = [0] * dims, 0
    for _, x, w in _blocks(batches, dims, weighted):
        total += int(w.sum())
        for half, shift in ((x >> 32, 32), (x & 0xFFFFFFFF, 0)):
            exact = half.astype(object) if int(w.max()) * len(x) >= 1 << 31 else half
            for i, s in enumerate((w[:, None] * exact).sum(axis=0)):
                sums[i] += int(s) << shift
    yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()),
                                      pa.array([Decimal(v) for v in (total, *sums)], pa.decimal128(38, 0))], ["i", "s"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` in double precision, from the exact difference where 64 bits hold it."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0) < 1 << 62:
        return (n * x - np.array(sums, np.int64)) / n
    return np.array([[float(n * int(v) - s) / n for v, s in zip(row, sums)] for row in x]).reshape(x.shape)


def _product_batches(batches, dims: int, weighted: bool, n: int, sums: list[int]):
    """The upper triangle of the sum of weighted products of centred vectors."""
    product = np.zeros((dims, dims))
    for _, x, w in _blocks(batches, dims, weighted):
        c = _centred(x, n, sums)
        product += (c * w[:, None]).T @ c
    i, j = np.triu_indices(dims)
    yield pa.RecordBatch.from_arrays([pa.array((i * dims + j).astype(np.int64)), pa.array(product[i, j])], ["cell", "v"])


@dataclass
class Model:
    """``n`` weights in all, ``sums`` per dimension, ``components`` as columns, their eigenvalues, the trace."""
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def sound(self) -> np.ndarray:
        """Which components have variance."""
        return self.eigenvalues > self.trace * len(self.sums) * np.finfo(float).eps


def fit(distinct: DataFrame, dims: int, components: int, weighted: bool) -> Model | None:
    """The model of distinct vectors of one length; None if there are none."""
    sums = {r["i"]: int(r["s"]) for r in distinct.mapInArrow(partial(_sum_batches, dims=dims, weighted=weighted), "i int, s decimal(38,0)")
            .groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}  # dims + 1 rows
    n = sums.pop(-1, 0)
    if not n:
        return None
    s = [sums[i] for i in range(dims)]
    cells = (distinct.mapInArrow(partial(_product_batches, dims=dims, weighted=weighted, n=n, sums=s), "cell bigint, v double")
             .groupBy("cell").agg(F.sum("v").alias("v")).toArrow())  # dims * (dims + 1) / 2 rows
    covariance = np.zeros((dims, dims))
    covariance.reshape(-1)[cells["cell"].to_numpy()] = cells["v"].to_numpy() / n
    covariance = covariance + np.triu(covariance, 1).T
    values, vectors = np.linalg.eigh(covariance)
    best = np.argsort(-values, kind="stable")[:components]
    return Model(n, s, vectors[:, best], np.maximum(values[best], 0.0), float(np.trace(covariance)))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal]:
    """``sum((n * x - sums) ** 2)`` of every row, exact."""
    far = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums), default=0)
    if far * far * max(len(sums), 1) < 1 << 63:
        return [Decimal(int(v)) for v in ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)]
    return [Decimal(sum((n * int(v) - s) ** 2 for v, s in zip(row, sums))) for row in x]


def _whiten_batches(batches, dims: int, model: Model):
    sound = model.sound()
    scale = np.where(sound, 1 / np.sqrt(np.where(sound, model.eigenvalues, 1.0)), np.nan)
    for part, x, _ in _blocks(batches, dims, False):
        w = _centred(x, model.n, model.sums) @ model.components * scale
        values = pa.array([[None if np.isnan(v) else v for v in row] for row in w.tolist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([part.column("key"), part.column("rows"), values,
                                          pa.array(_deviation(x, model.n, model.sums), pa.decimal128(38, 0))], ["key", "rows", "white", "deviation"])


def _identity_error(white: DataFrame, model: Model, weighted: bool) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, centred before multiplying."""
    sound = [i for i, s in enumerate(model.sound()) if s]
    if not sound:
        return None
    w, n = F.col("rows") if weighted else F.lit(1), float(model.n)
    at = lambda i: F.get("white", F.lit(i))
    means = white.agg(*(F.sum(w * at(i)) / n for i in sound)).first()
    off = {i: at(i) - F.lit(m) for i, m in zip(sound, means)}
    pairs = [(i, j) for i in sound for j in sound if i <= j]
    found = white.agg(*(F.sum(w * off[i] * off[j]) / n for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
           weighted: bool = False) -> DataFrame:
    """One row per usable row and component: ``id_col``, ``component`` (from 1), ``n`` (sum of weights), ``deviation``,
    ``whitened``, ``explained``, ``identity_error``.  ``weighted``: fit weights are the counts of equal rows instead of one."""
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = (f"{_quoted(id_col)} {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    grouped = write_and_reload(distinct_vectors(vectors, vec_col, scale), "vectors")
    dims, total = grouped.agg(F.max(F.size("x")), F.sum("rows")).first()
    if not dims:
        return spark.createDataFrame([], schema)
    # Filling up may make vectors equal that were not.
    if grouped.filter(F.size("x") < dims).limit(1).count():
        grouped = write_and_reload(grouped.select(_padded(F.col("x"), dims).alias("x"), "rows").groupBy("x").agg(F.sum("rows").alias("rows")), "vectors")
    model = fit(grouped, dims, components, weighted)
    key = lambda x: F.unhex(F.md5(F.concat_ws(",", x.cast("array<string>"))))
    white = write_and_reload(
        grouped.withColumn("key", key(F.col("x"))).mapInArrow(partial(_whiten_batches, dims=dims, model=model),
                                                             "key binary, rows bigint, white array<double>, deviation decimal(38,0)"), "whitened")
    error = _identity_error(white, model, weighted)
    rows = (vectors.select(vectors[id_col].alias("_id"), integers(vectors[vec_col], scale).alias("x")).filter(F.col("x").isNotNull())
            .select("_id", key(_padded(F.col("x"), dims)).alias("key")))
    hot = F.broadcast(white.filter(F.col("rows") * HOT_SHARE > total))
    cold = rows.join(hot.select("key"), "key", "left_anti").join(white, "key")
    joined = rows.join(hot, "key").unionByName(cold)
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.eigenvalues]
    return (joined.select("_id", "deviation", F.posexplode("white").alias("_at", "whitened"))
            .select(F.col("_id").alias(id_col), (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(F.array(*(F.lit(e).cast("double") for e in explained)), F.col("_at")).alias("explained"),
                    F.lit(error).cast("double").alias("identity_error")))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
