"""Vantage-point statistics and checks of estimated paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.scalars import array_edit_distance


def monitor_counts(announcements: DataFrame) -> DataFrame:
    return announcements.groupBy("monitor_asn").agg(F.count_distinct("prefix").alias("distinct_prefixes"), F.count(F.lit(1)).alias("total_ann"))


def with_rank(monitors: DataFrame, rank: DataFrame) -> DataFrame:
    """Adds the AS rank; an AS without one gets the number of ranks plus 1."""
    last = rank.agg((F.count(F.lit(1)) + 1).alias("_last"))
    joined = monitors.join(rank.select(F.col("asn").alias("monitor_asn"), "as_rank"), "monitor_asn", "left").crossJoin(F.broadcast(last))  # one row
    return joined.withColumn("as_rank", F.coalesce("as_rank", "_last")).drop("_last")


def monitor_stats(announcements: DataFrame, rank: DataFrame) -> DataFrame:
    return with_rank(monitor_counts(announcements), rank).withColumn("extra_ann", F.col("total_ann") - F.col("distinct_prefixes"))


def control_monitors(stats: DataFrame, min_ann: int = 800_000, n: int = 10) -> DataFrame:
    return stats.where((F.col("extra_ann") == 0) & (F.col("total_ann") >= min_ann)).orderBy("as_rank", "monitor_asn").limit(n)


def top_monitors(stats: DataFrame, n: int | None = None) -> DataFrame:
    ordered = stats.orderBy("as_rank", "monitor_asn")
    return ordered if n is None else ordered.limit(n)


def block_sample(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("block_id") <= n)


def monitor_rows(df: DataFrame, asn: int) -> DataFrame:
    return df.where(F.col("monitor_asn") == asn)


def truth_vs_estimate(control: DataFrame, estimate: DataFrame) -> DataFrame:
    """Observed paths with the estimated ones, null where there is none: ``monitor_asn, prefix_id, mode, as_path, estimated``."""
    return control.join(estimate.withColumnRenamed("as_path", "estimated"), ["monitor_asn", "prefix_id"], "left")


def path_distance(df: DataFrame) -> DataFrame:
    """Edit distance of each estimate; a missing one is as far as the truth is long."""
    return df.withColumn("distance", F.coalesce(array_edit_distance(F.col("as_path"), F.col("estimated")), F.size("as_path")))


def mean_path_distance(df: DataFrame) -> DataFrame:
    """Mean over monitors of each monitor's mean distance, by mode."""
    per_monitor = path_distance(df).groupBy("mode", "monitor_asn").agg(F.avg("distance").alias("d"))
    return per_monitor.groupBy("mode").agg(F.avg("d").alias("mean_distance"))
