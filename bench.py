"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ["retain_counts", "dsl_when", "full_bounds", "morton_rank", "block_bounds", "depth_axial", "project_cov2d", "edit_chain", "composite_over", "quantize_hist", "pps_sample", "kmeans_step", "kd_bins", "merge_moments", "nn_assign", "tree_rollup", "stream_sliding", "stream_sessions"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from anisoframe.plans import queries

    known, times = queries.queries(), {}
    known[HEADLINE[0]](spark, sf_dir).count()  # starts the session's threads
    for name in HEADLINE:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
