"""Tallies of a run: outcomes, endpoints, access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(runs: DataFrame, *counters: str) -> DataFrame:
    """outcome, repos and the summed counters."""
    return runs.groupBy("outcome").agg(F.count("*").alias("repos"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def endpoint_totals(requests: DataFrame) -> DataFrame:
    """endpoint (`all` for the total), records, requests, failures, retries."""
    out = requests.rollup("endpoint").agg(
        F.sum("records").alias("records"), F.count("*").alias("requests"), F.count_if("failed").alias("failures"), F.sum("retries").alias("retries"), F.grouping("endpoint").alias("g")
    )
    return out.withColumn("endpoint", F.when(F.col("g") == 1, "all").otherwise(F.col("endpoint"))).drop("g")


def metadata_access(repos: DataFrame) -> DataFrame:
    """One row: processed, failed, protection readable or not."""
    return repos.agg(
        F.count_if(~F.col("failed")).alias("processed"), F.count_if("failed").alias("failed"),
        F.count_if(~F.col("failed") & F.col("protection").isNotNull()).alias("protection_readable"), F.count_if(~F.col("failed") & F.col("protection").isNull()).alias("protection_hidden"),
    )


def files_checked(presence: DataFrame) -> DataFrame:
    """repo_id (null for the total) and the number of paths checked."""
    return presence.rollup("repo_id").agg(F.count("*").alias("files_checked"))


def write_manifest(stats: DataFrame, path: str) -> None:
    """Append an audit row to the manifest table."""
    stats.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)
