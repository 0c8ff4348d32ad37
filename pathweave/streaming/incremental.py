"""Incremental loads, as batch operators and as structured streams over the same functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pathweave.functions.stored import stored
from pathweave.operators.events import changed_events, known_events, latest_by_event
from pathweave.sources import commits


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger does not hold yet."""
    return files.join(ledger.select("file").distinct(), "file", "left_anti")


def load_new_lines(spark: SparkSession, folder: str, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Parse the files of a folder that no earlier run has seen and append their rows; the checkpoint is the ledger."""
    source = spark.readStream.format("text").option("recursiveFileLookup", True).load(folder).withColumn("file", F.col("_metadata.file_path"))
    return parse(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def interval_counts(updates: DataFrame, rate_seconds: int, late_seconds: int = 600) -> DataFrame:
    """Updates per interval and type, of a batch or a stream; a stream closes an interval when the watermark has passed it."""
    timed = updates.withColumn("at", F.timestamp_seconds("time"))
    if updates.isStreaming:
        timed = timed.withWatermark("at", f"{late_seconds} seconds")
    counts = timed.groupBy(F.window("at", f"{rate_seconds} seconds").alias("w"), "update_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.unix_timestamp("w.start").alias("interval_start"), F.unix_timestamp("w.end").alias("interval_end"), "update_type", "n")


#: One row an interval and type: ``kind`` is ``interval`` for what was counted in time, ``late`` for rows that came behind it.
INTERVAL_ROWS = "interval_start long, interval_end long, update_type string, kind string, n long"


def closed_intervals(updates: DataFrame, rate_seconds: int, late_seconds: int = 600, horizon_seconds: int = 86_400) -> DataFrame:
    """Updates of a stream per interval and type, each interval given out once, and late updates counted beside it.

    ``updates`` has ``time`` in seconds and ``update_type``; equal rows count once. An interval closes when an update has come whose
    time is ``late_seconds`` past its end, and gives one row of kind ``interval``. Updates that come later give rows of kind ``late``,
    one a batch, interval and type. Beyond the horizon, which is what state is kept for, rows are dropped and only Spark's own
    metric counts them. Rows without a time or type are left out. State is the counts of open intervals, and a hash of each row
    inside the horizon. Of a batch, all intervals are given at once, as none is late.
    """
    known = updates.where("time is not null and update_type is not null")
    begin = F.col("time") - F.pmod(F.col("time"), F.lit(rate_seconds))
    if not updates.isStreaming:
        counts = known.distinct().groupBy(begin.alias("interval_start"), "update_type").agg(F.count(F.lit(1)).alias("n"))
        return counts.select("interval_start", (F.col("interval_start") + rate_seconds).alias("interval_end"), "update_type", F.lit("interval").alias("kind"), "n")
    horizon = max(horizon_seconds, late_seconds + rate_seconds)
    hashed = known.withColumn("_row", F.xxhash64(*known.columns)).withColumn("_at", F.timestamp_seconds("time"))
    fresh = hashed.withWatermark("_at", f"{horizon} seconds").dropDuplicatesWithinWatermark(["_row"])

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, kind = int(key[0]), key[1]
        end = start + rate_seconds

        def row(name: str, n: int) -> pd.DataFrame:
            return pd.DataFrame({"interval_start": [start], "interval_end": [end], "update_type": [kind], "kind": [name], "n": [n]})

        # The watermark is the horizon behind the newest update, so this point of it is late_seconds past the interval's end.
        closes = (end + late_seconds - horizon) * 1000
        if state.hasTimedOut:
            yield row("interval", state.get[0])
            state.remove()
            return
        n = sum(len(p) for p in parts)
        if closes <= state.getCurrentWatermarkMs():
            yield row("late", n)
            return
        state.update(((state.get[0] if state.exists else 0) + n,))
        state.setTimeoutTimestamp(max(closes, 1))

    keyed = fresh.select(begin.alias("interval_start"), "update_type", "_at").groupBy("interval_start", "update_type")
    return keyed.applyInPandasWithState(count, INTERVAL_ROWS, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def merged_events(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The events table after a batch: one row per event number, that with the highest id. Equal rows do no harm, so a batch that
    runs again after a failure changes nothing."""
    return latest_by_event(stored.unionByName(changed_events(batch, latest_by_event(stored))))


#: Buckets of an events table.
BUCKETS = 64


def events_table(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest version of an events table, or only some of its buckets; None before the first batch."""
    _, table = commits.latest(spark, path)
    if not table:
        return None
    schema = T.StructType.fromJson(table["schema"])
    wanted = [f"{path}/{folder}/bucket={b}" for b, folder in table["buckets"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def upsert_events(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into an events table: one row per event number, that with the highest id.

    The table lies in hash buckets by event number. Only buckets in which a row of the batch is new or differs are read
    and written again, into a new folder; the manifest that is committed last names a folder for each bucket. A batch that runs
    again after its commit is known by its number and left out; one that failed before it starts anew on the old version.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version, table = commits.latest(spark, path)
        if table and table["batch"] >= batch_id:
            return
        n = table.get("buckets_in_all", buckets)
        keyed = latest_by_event(batch).withColumn("bucket", F.pmod(F.xxhash64("event_number"), F.lit(n)).cast("int"))
        named = dict(table.get("buckets", {}))
        touched = [r.bucket for r in keyed.select("bucket").distinct().collect()]  # at most the number of buckets
        current = events_table(spark, path, touched)
        if current is None:
            current = keyed.drop("bucket").limit(0)
        changed = stored(changed_events(keyed, known_events(current)))
        rewritten = sorted(r.bucket for r in changed.select("bucket").distinct().collect())
        if rewritten:
            folder = commits.data_folder()
            old = current.withColumn("bucket", F.pmod(F.xxhash64("event_number"), F.lit(n)).cast("int")).where(F.col("bucket").isin(rewritten))
            merged = latest_by_event(old.unionByName(changed))
            merged.repartition(len(rewritten), "bucket").sortWithinPartitions("bucket", "event_number").write.partitionBy("bucket").parquet(f"{path}/{folder}")
            named |= {str(b): folder for b in rewritten}
        content = {"batch": batch_id, "buckets_in_all": n, "buckets": named, "folders": sorted(set(named.values())), "schema": batch.schema.jsonValue()}
        commits.commit(spark, path, content, version)

    return merge
