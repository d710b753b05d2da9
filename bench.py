"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from cohortloom.plans import load_all
from cohortloom.session import make_session

HEADLINE = (
    "e07_subgroup_audit_large",
    "e06_binary_metrics_large",
    "j03_join_many_to_one",
    "a01_group_profile",
    "a06_state_counts",
    "a20_percentile_profile",
    "w01_best_so_far",
    "w08_diagnose_curves",
    "w11_drop_duplicates_keep",
    "w14_share_of_total",
    "t10_pareto_front",
    "e13_bootstrap_mean_ci",
    "f01_stratified_folds",
    "f03_best_fold_assignment",
    "m03_harmonize",
    "m11_knn",
    "v01_scan_qc",
    "v10_region_stats",
    "v13_glcm",
    "r02_upsert_latest",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = make_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("count(distinct l_orderkey)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
