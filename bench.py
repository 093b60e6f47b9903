"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. A query is
built, planned and fully evaluated into Spark's no-op sink; each runs once after
a warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "lev_supplier", "lev_part_min80", "lev_customer_min94", "weighted_lev_part", "metaphone_part", "fuzzy_part",
    "composite_orders", "composite_customer", "band_orders", "lsh_documents", "lsh_documents_exact",
    "embedding_cosine", "embedding_euclidean", "embedding_manhattan", "embedding_chebyshev", "embedding_customer",
    "dbscan_embeddings", "kmeans_embeddings", "project_embeddings", "pair_features_documents", "classifier_documents",
    "histogram_orders", "degrees_part", "term_counts_documents",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from twinfold.plans.settings import drop_tables
    from twinfold.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("twinfold-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["lev_supplier"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
        drop_tables(spark)
    print(json.dumps({
        "metric": "record_matching_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
