"""Served tables: results stored once in buckets by AS, looked up by reading only the buckets that are asked for.

A table's bucket is its key modulo the number of buckets, so a request knows the folders to read before it starts a job, and
inside a bucket rows are sorted by key, which lets Parquet skip what isn't asked. A table is made anew when one of its
input files has changed. Versions are manifests, so a request reads one whole version while the next is being written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.sources import commits

BUCKETS = 64


def publish(df: DataFrame, path: str, key: str | None = None, buckets: int = BUCKETS, inputs: dict[str, str] | None = None) -> None:
    """Store ``df`` as the new version: in buckets of ``key``, a whole number, or in one piece without a key. Rows without a key go into bucket -1."""
    spark = df.sparkSession
    based_on, _ = commits.latest(spark, path)
    folder = commits.data_folder()
    content: dict = {"folders": [folder], "schema": df.schema.jsonValue(), "inputs": inputs or {}, "key": key}
    if key is None:
        df.write.parquet(f"{path}/{folder}")
    else:
        bucketed = df.withColumn("bucket", F.coalesce(F.pmod(F.col(key), F.lit(buckets)), F.lit(-1)).cast("int"))
        # Rebalancing splits a bucket that a key with very many rows has swollen, and joins small ones into one task.
        bucketed.hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}/{folder}")
        content |= {"buckets_in_all": buckets, "buckets": commits.listed_buckets(spark, f"{path}/{folder}")}
    commits.commit(spark, path, content, based_on)


def lookup(spark: SparkSession, path: str, keys: Iterable[int] | None = None) -> DataFrame:
    """Rows of the newest version: all, or those of the given keys, of which only the buckets are read."""
    _, table = commits.latest(spark, path)
    if not table:
        raise FileNotFoundError(f"nothing has been published at {path}")
    schema, folder = T.StructType.fromJson(table["schema"]), f"{path}/{table['folders'][0]}"
    if table["key"] is None:
        if keys is not None:
            raise ValueError(f"{path} has no key")
        return spark.read.schema(schema).parquet(folder)
    wanted = None if keys is None else sorted(set(keys))
    asked = {k % table["buckets_in_all"] for k in wanted} if wanted is not None else None
    names = [f"{folder}/bucket={b}" for b in table["buckets"] if asked is None or b in asked]
    found = spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
    return found if wanted is None else found.where(F.col(table["key"]).isin(wanted))


def fingerprint(spark: SparkSession, inputs: dict[str, list[str]]) -> dict[str, str]:
    """Names, lengths and times of all files at the paths of each input; starts no job."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for name, paths in sorted(inputs.items()):
        files = []
        for path in paths:
            at = hadoop.Path(path)
            found = at.getFileSystem(conf).listFiles(at, True)
            while found.hasNext():
                status = found.next()
                files.append(f"{status.getPath()}:{status.getLen()}:{status.getModificationTime()}")
        out[name] = hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()
    return out


def refresh(spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: dict[str, str], key: str | None = None, buckets: int = BUCKETS) -> bool:
    """Publish what ``build`` gives unless the newest version was made from files of the same ``fingerprint``; tells whether it was made anew."""
    if commits.latest(spark, path)[1].get("inputs") == inputs:
        return False
    publish(build(), path, key, buckets, inputs)
    return True
