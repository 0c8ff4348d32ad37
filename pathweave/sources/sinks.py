"""Writers: tables, tab-separated exports, guarded snapshots, and result envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.functions import prefix as px
from pathweave.sources import commits


def flat(df: DataFrame) -> DataFrame:
    """Prefix structs as text and arrays as ``{a,b}``, for text formats."""
    out = []
    for field in df.schema:
        kind = field.dataType
        if isinstance(kind, T.StructType) and kind.names == ["family", "hi", "lo", "len"]:
            out.append(px.to_text(F.col(field.name)).alias(field.name))
        elif isinstance(kind, T.ArrayType):
            out.append(F.concat(F.lit("{"), F.array_join(F.col(field.name).cast("array<string>"), ","), F.lit("}")).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def materialise(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def export_tsv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("sep", "\t").option("nullValue", "").csv(path)


def export_pairs_gz(pairs: DataFrame, path: str, placeholder: int = 100) -> None:
    rows = pairs.select("origin", "prefix").distinct().withColumn("placeholder", F.lit(placeholder))
    flat(rows).write.mode("overwrite").option("sep", "\t").option("compression", "gzip").csv(path)


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored snapshot, or None: that of the newest whole manifest."""
    _, found = commits.latest(spark, path)
    return spark.read.schema(T.StructType.fromJson(found["schema"])).parquet(f"{path}/{found['folders'][0]}") if found else None


def promote_if_not_smaller(df: DataFrame, path: str) -> None:
    """Store ``df`` as the new snapshot unless it has fewer rows than the stored one, which raises a ValueError with both counts.

    Readers see the old snapshot until the new one's manifest is whole; a failure at any step leaves the old one in place.
    """
    spark = df.sparkSession
    based_on, old = commits.latest(spark, path)
    folder = commits.data_folder()
    df.write.parquet(f"{path}/{folder}")
    rows = spark.read.parquet(f"{path}/{folder}").count()
    if old and rows < old["rows"]:
        raise ValueError(f"the new snapshot has {rows} rows, the stored one {old['rows']}")
    commits.commit(spark, path, {"folders": [folder], "rows": rows, "schema": df.schema.jsonValue()}, based_on)


def restore_if_empty(df: DataFrame, path: str) -> DataFrame:
    """``df``, or the stored snapshot where ``df`` has no rows."""
    if not df.isEmpty():
        return df
    stored = snapshot(df.sparkSession, path)
    return df if stored is None else stored


def envelope(df: DataFrame, meta: dict[str, str], site: str = "") -> DataFrame:
    """Rows as JSON ``{data, metadata}``: decimals become doubles, and ``url`` gets the site in front. One row per input row."""
    columns = []
    for f in flat(df).schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        if f.name == "url" and site:
            c = F.concat(F.lit(site), c)
        columns.append(c.alias(f.name))
    info = F.struct(*[F.lit(v).alias(k) for k, v in sorted(meta.items())])
    return flat(df).select(F.to_json(F.struct(F.struct(*columns).alias("data"), info.alias("metadata"))).alias("json"))
