"""Plan-shape helpers shared by the operators."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookspark.session import BROADCAST_MAX_ROWS, ensure_checkpoint_dir

MONEY = "decimal(38,2)"


def money_sum(c: Column | str) -> Column:
    """Sum of money as an exact decimal (order-independent), 0 when empty.

    pandas' sum of nothing is 0; Spark's is NULL.  Six decimals are summed and
    rounded once; 22 digits before the point hold any amount a file can mean."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.try_cast("decimal(28,6)")), F.lit(0)).cast(MONEY)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL when den is 0 (ANSI mode raises on /0)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def bounded_broadcast(small: DataFrame, bound_rows: int | None) -> DataFrame:
    """Broadcast ``small`` only when its row count has a proven bound below
    BROADCAST_MAX_ROWS (1-row totals, per-file decisions with a known number of
    files, constant tables).  Otherwise leave the choice to the planner and AQE,
    which measure the side at runtime."""
    if bound_rows is not None and bound_rows <= BROADCAST_MAX_ROWS:
        return F.broadcast(small)
    return small


def top_n_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                    n: int, salt_buckets: int = 64, salt_col: Column | None = None) -> DataFrame:
    """Exact top-n rows per group without putting a whole group in one task.

    Phase 1 ranks inside (group, salt bucket) and keeps n per bucket, so a hot
    group is spread over ``salt_buckets`` tasks; phase 2 ranks the at most
    ``salt_buckets * n`` survivors per group.  ``order`` must be a total order
    (end it with a unique key) for a deterministic result."""
    group_cols = list(group_cols)
    salt = salt_col if salt_col is not None else F.xxhash64(*df.columns)
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= n)
    if group_cols:
        w2 = Window.partitionBy(*group_cols).orderBy(*order)
        out = stage1.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= n)
    else:
        out = stage1.orderBy(*order).limit(n).withColumn("_rn", F.lit(None))
    return out.drop("_salt")


def reuse(grouped: DataFrame) -> DataFrame:
    """A grouped table used by two branches (rows and their total, top-n and
    the whole): computed once and kept as a reliable checkpoint in the shared
    folder (``spark.checkpoint.dir``), so the fact table is not scanned and
    joined twice.  Survives executor loss; never a local checkpoint."""
    ensure_checkpoint_dir(grouped.sparkSession)
    return grouped.checkpoint(eager=True)
