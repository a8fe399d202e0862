"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from gatewise import catalogue

NAMES = (
    "recon", "bgp_q3", "bgp_q5", "bgp_q9", "bgp_q10", "star", "hierarchy", "minus_guarded", "optional_match",
    "gates_times", "edges_recon", "union_shared", "recon_circuit", "text_recon_flat", "text_recon_factored", "text_q3", "text_minus",
)


def main() -> None:
    cpus, where = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["atom_scan"](spark, where).collect()  # starts the engine
    took = {}
    for name in NAMES:
        began = time.time()
        catalogue.QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": where}))
    spark.stop()


if __name__ == "__main__":
    main()
