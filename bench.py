"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and three times for its median. Results are
counted in full through the no-op sink. What a run keeps is dropped before the next.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from biotally.operators import alpha, beta, nulls, relational, statistics as stats
from biotally.plans import fixtures as fx


def headline(s: SparkSession, d: str) -> dict:
    wide, small = (lambda: fx.tab_wide(s, d)), (lambda: fx.tab_small(s, d))
    return {
        "alpha_profile_41": lambda: alpha.alpha_profile(wide()),
        "phyl_alpha_q1": lambda: alpha.phyl_alpha(wide(), fx.tree_large(s, d), fx.leaves_large(s, d), 1),
        "naive_beta_q1": lambda: beta.naive_beta(wide(), 1),
        "bray": lambda: beta.bray(wide()),
        "phyl_beta_q1": lambda: beta.phyl_beta(wide(), fx.tree_large(s, d), fx.leaves_large(s, d), 1),
        "func_alpha_q1": lambda: alpha.func_alpha(small(), fx.distmat(s, d), 1),
        "naive_multi_beta_q1": lambda: beta.naive_multi_beta(wide(), fx.regions(fx.supplier_meta(s, d)), 1),
        "rarefy_min": lambda: relational.rarefy(wide(), "min", 7),
        "rarefy_counts_min": lambda: relational.rarefy(wide(), "min", 7, method="counts"),
        "nri_99": lambda: nulls.nri(small(), fx.distmat(s, d), 1, 99, seed=5),
        "nri_999_arrays": lambda: nulls.nri(small(), fx.distmat(s, d), 1, 999, seed=5, arrays=True),
        "gower": lambda: stats.gower(fx.supplier_meta(s, d)),
        "merge_samples": lambda: relational.merge_samples(wide(), fx.supplier_meta(s, d), "region"),
    }


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(max(8, 2 * int(cpus)) if cpus.isdigit() else 16))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name, build in headline(spark, d).items():
        each = []
        for k in range(4):
            spark.catalog.clearCache()  # else a run finds what the one before it has kept
            t = time.perf_counter()
            build().withColumn("_one", F.lit(1)).write.format("noop").mode("overwrite").save()
            if k:
                each.append(time.perf_counter() - t)
        times[name] = round(statistics.median(each), 3)
    sf = re.search(r"sf([0-9.]+)", d)
    print(json.dumps({"metric": "headline queries, sum of medians of three warm runs", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
