"""Benchmark: the load step (read + map + clean + index, the reference's
"load") and the headline analyses, retrieval and verification on the loaded
tables.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from bookspark.operators import analyses as A  # noqa: E402
from bookspark.operators import retrieval as R  # noqa: E402
from bookspark.operators import verify as V  # noqa: E402
from bookspark.plans.catalog import SEARCH_QUERIES  # noqa: E402
from bookspark.plans.load import load_sales  # noqa: E402
from bookspark.session import get_session  # noqa: E402
from bookspark.sources import tables as T  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    timings: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        timings[name] = round(time.perf_counter() - t, 3)
        return out

    raw = T.sales_raw(spark, sf_dir)
    loaded = timed("load", lambda: load_sales(raw, n_files=25))
    rows_out = loaded.report.agg(F.sum("rows_in")).first()[0]
    clean = loaded.clean

    def run(df):
        return df.collect()

    timed("revenue_summary", lambda: run(A.revenue_summary(clean)))
    timed("half_period_change", lambda: run(A.half_period_change(clean)))
    timed("top_products", lambda: run(A.top_products(clean, 5)))
    timed("bottom_products", lambda: run(A.bottom_products(clean, 5)))
    timed("volume_warning", lambda: run(A.volume_warning(clean, 5)))
    timed("monthly_trend", lambda: run(A.monthly_trend(clean)))
    timed("month_extremes", lambda: run(A.month_extremes(A.monthly_trend(clean))))
    timed("by_vendor", lambda: run(A.by_dimension(clean, "vendor")))
    timed("by_channel", lambda: run(A.by_dimension(clean, "channel")))
    timed("by_payment", lambda: run(A.by_dimension(clean, "payment_method")))
    timed("quiet_days", lambda: run(A.quiet_days(clean)))
    timed("weekend_effect", lambda: run(A.weekend_effect(clean)))
    timed("top_products_by_shop", lambda: run(A.top_products(clean, 5, scope=["_file"])))
    q = spark.createDataFrame(SEARCH_QUERIES, "query_id int, text string")
    timed("bm25_search", lambda: run(R.search(loaded.index, q, top_k=20)))
    timed("verify_narrations", lambda: run(V.resolve_attempts(T.narrations_from(clean))
                                           .groupBy("state").count()))
    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "load_plus_queries_total", "value": total, "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir).replace("sf", ""),
        "load_rows": int(rows_out or 0),
        "load_rows_per_sec": round((rows_out or 0) / max(timings["load"], 1e-9), 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
