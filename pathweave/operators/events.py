"""Event tables: newest rows, changes, and cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.operators.metadata import last_per_key


def latest_by_event(df: DataFrame, order: str = "id") -> DataFrame:
    """The row with the highest id of each event number."""
    return last_per_key(df, ["event_number"], order)


def known_events(df: DataFrame) -> DataFrame:
    return df.groupBy("event_number").agg(F.max_by("start_time", "id").alias("start_time"), F.max_by("end_time", "id").alias("end_time"))


def changed_events(events: DataFrame, known: DataFrame, refresh: bool = False) -> DataFrame:
    """Events that are new, or whose start or end differs from the known one; all of them on refresh."""
    old = known.select("event_number", F.col("start_time").alias("_s"), F.col("end_time").alias("_e"), F.lit(True).alias("_known"))
    joined = events.join(old, "event_number", "left")
    changed = F.col("_known").isNull() | ~F.col("start_time").eqNullSafe(F.col("_s")) | ~F.col("end_time").eqNullSafe(F.col("_e")) | F.lit(refresh)
    return joined.where(changed).select(*events.columns)


def clean_text(df: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """Quotes go, empty texts become null, and columns stand in a fixed order."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.col(c), '"', "")), F.lit(""))
    return df.withColumns({c: clean(c) for c in cols}).select(*order)


def subintervals(df: DataFrame, start: Column, end: Column, rate: int) -> DataFrame:
    """Rows cut into intervals of ``rate``; the last one is shortened to the end."""
    pieces = F.explode(F.filter(F.sequence(start, end, F.lit(rate).cast("long")), lambda s: s < end))
    cut = df.withColumn("interval_start", pieces)
    return cut.withColumn("interval_end", F.least(F.col("interval_start") + rate, end))


def tag_intervals(updates: DataFrame, start: Column, rate: int) -> DataFrame:
    """Adds the interval that each update's time falls into."""
    begin = (F.col("time") - F.pmod(F.col("time") - start, F.lit(rate))).cast("long")
    return updates.withColumn("interval_start", begin).withColumn("interval_end", begin + rate)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
