"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) has the tables, BENCH_CPUS (default
8) the threads. Each query's whole result is produced and thrown away. One
query over the smallest tables comes first, uncounted, so that starting the
session and its Python workers is nobody's time.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "pipeline_yaml", "pos_region_weighted_mean", "pos_region_median", "pos_region_value_count", "pos_gap_mean_replacement", "pos_point", "allele_exact", "allele_region_filter", "fragment_count", "fragment_filter_agg",
    "simple_effect", "full_effects", "gene_score_join", "gene_set_intersect", "region_intersection", "hist_number_lin", "minmax", "stream_region_mean", "normalize_substitution_row", "liftover_positions",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lociweave.queries import QUERIES

    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        QUERIES["full_effects"](spark, small).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
