"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the local threads, BENCH_QUERIES an
optional comma-separated list of query names. Each query runs once to warm up on the
smallest tables, then once timed, its result written to nowhere.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from contract import load_all
from contract.registry import QUERIES

HEADLINE = [
    "a01_parquet_scan",
    "a09_partitioned_sink",
    "a14_clustering",
    "c02_with_dwelling",
    "c05_lookup_join",
    "d10_operation_statistics",
    "e01_e04_geographic_aggregates",
    "e05_e10_household_aggregates",
    "g01_null_profile",
    "g03_duplicate_profile",
    "g17_wide_table_metrics",
    "g20_skew_report",
    "h08_recode_by_join",
    "h10_recoded_persons",
    "i13_development_category",
    "i21_person_features",
    "j00_flagship",
    "j01_census_master",
    "j02_survey_master",
    "j04_silver_census",
    "k07_random_forest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    load_all()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    seconds = {}
    for name in names:
        if os.path.isdir(warm):
            try:
                QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
            except ValueError:  # too few rows to train on
                pass
        start = time.monotonic()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
