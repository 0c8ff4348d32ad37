"""URL filter rules by a sort-merge range join on reversed-host keys. DataFrame functions only.

A host's canonical key is its labels in reverse order, each followed by a dot, so a host and all its subdomains fill
one interval of keys: from ``com.example.`` up to, but without, ``com.example/``. Rule hosts are nested or apart, so
their starts and ends cut the key space into segments, each with one stack of active rules. URLs and segment starts
are sorted together, and the last start at or before a URL holds its stack; the longest rule in it whose path begins
the URL's path wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: URLs of one salted part of the sweep. Each part also gets all segment starts.
PART_ROWS = 100_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def rule_segments(rules: DataFrame) -> DataFrame:
    """Segment starts of rules (``host``, ``path``, ``verdict``): ``key`` and the ``stack`` of rules active from there on.

    A start's stack holds the rules of its host and of the hosts above it, found by an equi-join on all ancestors; an
    end brings back the stack below. Rules with a null field are dropped; of equal rules with both verdicts, block stays.
    """
    clean = rules.where("host is not null and path is not null and verdict is not null").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    clean = clean.withColumn("rule", F.concat("host", "path"))
    hosts = clean.select("host").distinct().withColumn("labels", F.split("host", "[.]", -1))
    above = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.array_join(F.slice("labels", k, F.size("labels")), "."))).alias("up", "parent"))
    stacks = (
        above.join(clean.withColumnRenamed("host", "parent"), "parent")
        .groupBy("host")
        .agg(
            F.collect_list(F.struct(F.length("rule").alias("len"), "path", "rule", "verdict")).alias("inside"),
            F.collect_list(F.when(F.col("up") > 0, F.struct(F.length("rule").alias("len"), "path", "rule", "verdict"))).alias("below"),
        )
        .withColumn("key", host_key(F.col("host")))
    )
    ends = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    return stacks.select("key", F.col("inside").alias("stack")).unionByName(stacks.select(ends.alias("key"), F.col("below").alias("stack")))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", part_rows: int = PART_ROWS) -> DataFrame:
    """Verdict on every URL: ``page_id, host, path, rule, verdict``, one row per input row.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and all subdomains where the
    URL's path starts with the rule's; the longest rule text wins. Without a fitting rule, ``rule`` is null and the verdict
    is ``default``. Null URLs, and those without ``://``, have empty host and path. Repeated rows and ids stay as they are;
    an empty table gives an empty result; other columns are not read. The sweep is cut into parts of about ``part_rows``
    URLs by a hash of the row, so no host is too hot for it.
    """
    n = pages.count()
    parts = max(1, -(-n // part_rows), pages.sparkSession.sparkContext.defaultParallelism if n > 10_000 else 1)
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u"))
    urls = urls.withColumns({"host": url_host(F.col("u")), "path": url_path(F.col("u"))})
    urls = urls.select("page_id", "host", "path", host_key(F.col("host")).alias("key"), F.pmod(F.xxhash64("page_id", "u"), F.lit(parts)).alias("part"))
    segments = rule_segments(rules).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    events = segments.select("part", "key", F.lit(0).alias("is_url"), "stack").unionByName(urls.withColumn("is_url", F.lit(1)), allowMissingColumns=True)
    sweep = Window.partitionBy("part").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    best = F.array_max(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])))
    return swept.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rules table from (host, path, verdict) tuples."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))
