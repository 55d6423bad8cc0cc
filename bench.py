"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path
from uuid import uuid4

sys.path.insert(0, str(Path(__file__).resolve().parent))

from specmill.plans import registry  # noqa: E402
from specmill.session import get_spark, shared_dir  # noqa: E402

HEADLINE = {
    "process_catalog": "f01_process_catalog", "filter_catalog": "f02_filter_catalog", "vendor_stats": "a01_vendor_stats",
    "facet_counts": "a06_facet_counts", "release_gates": "a15_release_gates", "dedupe_fold": "d01_dedupe_fold",
    "merge_catalogs": "j08_merge_catalogs", "upsert": "j09_upsert", "navigate": "w01_navigate", "paginate": "w02_sort_paginate",
    "rank_matches": "j06_rank_matches", "extract_links": "x01_extract_links", "mine_documents": "s44_mine_documents",
    "rate_windows": "t03_rate_sliding", "latency_summary": "a31_latency_summary",
}


#: Run again over a catalogue with a row per line item, to show how the time grows.
LARGE = ("process_catalog", "filter_catalog", "vendor_stats", "facet_counts", "release_gates", "dedupe_fold", "merge_catalogs", "upsert", "navigate", "paginate")


def large_tables(spark, sf: str) -> tuple[str, int, int]:
    """Folder with ``part`` made from ``lineitem`` (a part per line item), its rows, and those of the given ``part``."""
    path = f"{shared_dir(spark)}/large-{uuid4().hex}"
    part, lines = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("part", "lineitem"))
    rows = lines.selectExpr("l_partkey AS k", "l_orderkey * 8 + l_linenumber AS own").join(part.withColumnRenamed("p_partkey", "k"), "k")
    rows.select("own", "p_name", "p_brand", "p_type", "p_size", "p_retailprice").withColumnRenamed("own", "p_partkey").write.parquet(f"{path}/part.parquet")
    lines.write.parquet(f"{path}/lineitem.parquet")
    return path, spark.read.parquet(f"{path}/part.parquet").count(), part.count()


def timed(spark, name: str, sf: str, runs: int) -> float:
    times = []
    for _ in range(runs + 1):  # the first run warms up
        t = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times.append(time.time() - t)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = get_spark(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    took = {}
    for label, name in HEADLINE.items():
        took[label] = timed(spark, name, sf, runs)
        print(label, took[label], file=sys.stderr, flush=True)
    path, rows, small = large_tables(spark, sf)
    large = {}
    for label in LARGE:
        large[label] = timed(spark, HEADLINE[label], path, 1)
        print("large", label, large[label], file=sys.stderr, flush=True)
    growth = {"rows": round(rows / small, 1), **{k: round(v / took[k], 2) for k, v in large.items()}}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": sf, "cpus": int(cpus), "spark": spark.version,
                      "large": {"rows": rows, "queries": large}, "growth": growth}))


if __name__ == "__main__":
    main()
