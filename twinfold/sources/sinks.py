"""Writing pair tables and vector artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_pairs_csv(report: DataFrame, path: str, single_file: bool = False) -> None:
    """Write a report as CSV with a header and no index.

    ``single_file`` funnels the rows through one task, so it is only for
    results known to be small.
    """
    if single_file:
        report = report.coalesce(1)
    report.write.mode("overwrite").option("header", True).csv(path)


def write_artifacts(vectors: DataFrame, labels: DataFrame, path: str) -> None:
    """Keep combined vectors and cluster labels beside a result, as Parquet."""
    vectors.write.mode("overwrite").parquet(f"{path.rstrip('/')}/vectors")
    labels.write.mode("overwrite").parquet(f"{path.rstrip('/')}/labels")
