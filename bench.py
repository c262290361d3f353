"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sparkloom.plans.queries import QUERIES
from sparkloom.plans.workload import JoinWorkload

NAMES = [f"join_{x}_{y}" for y in ("count", "many") for x in ("hash_shared", "index_loop", "radix_histogram", "radix_sort_merge", "multiway_merge", "sort_expand_align")] + ["join_concise_checksum", "join_carry_last_rows", "join_padded_output", "join_blocked_pairs", "join_radix_split_hot", "three_way_join", "seal_roundtrip_join", "deterministic_join", "radix_prefix_sum"]

#: Generated workloads, by data set; they are no part of the total.
WORKLOADS = {"cache-fit": ("RHO", "PHT", "PSM"), "cache-exceed": ("RHO",)}


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    workloads = {}
    for dataset, algorithms in WORKLOADS.items():  # the published sizes; generated while they are joined
        for name in algorithms:
            workload = JoinWorkload.of_options(dataset=dataset, algorithm=name)
            best = max((workload.run(spark) for _ in range(1 if dataset == "cache-exceed" else 2)), key=lambda m: m.mrec_per_s)
            workloads[f"{dataset} {name}"] = {"seconds": best.seconds, "mrec_per_s": best.mrec_per_s, "matches": best.matches}
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "lineitem")}
    print(json.dumps({"metric": "headline join queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "radix_histogram_mrec_per_s": round(sum(rows.values()) / took["join_radix_histogram_count"] / 1e6, 3), "workloads": workloads}))


if __name__ == "__main__":
    main()
