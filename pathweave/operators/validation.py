"""Route-origin validation and other prefix containment operators.

Tables of announcements have ``prefix, as_path or monitor_asn, origin, time``; ROAs have ``asn, prefix, max_length``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions import nesting
from pathweave.functions import prefix as px
from pathweave.functions.scalars import INVALID_BY_ALL, INVALID_BY_LENGTH, INVALID_BY_ORIGIN, UNKNOWN, VALID


def filter_family(df: DataFrame, ipv4: bool = True, ipv6: bool = False, col: str = "prefix") -> DataFrame:
    return df.where(F.col(f"{col}.family").isin([f for f, on in ((4, ipv4), (6, ipv6)) if on]))


def monitor_asn(as_path: Column) -> Column:
    return F.get(as_path, F.lit(0))


def latest_snapshot(df: DataFrame, col: str = "created_at") -> DataFrame:
    newest = df.agg(F.max(col).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(col) == F.col("_newest")).drop("_newest")  # one row


def only_prefix(df: DataFrame, prefix: Column, col: str = "prefix") -> DataFrame:
    return df.where(F.col(col) == prefix)


def require_rows(**tables: DataFrame) -> None:
    """Raise if one of the tables is empty; looks at one row of each."""
    empty = [name for name, df in tables.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"no rows in {', '.join(empty)}")


def sort_by_prefix(df: DataFrame, col: str = "prefix") -> DataFrame:
    return df.orderBy(px.order_key(F.col(col)))


def distinct_pairs(announcements: DataFrame) -> DataFrame:
    return announcements.select("prefix", "origin").distinct()


def unique_prefix_origins(announcements: DataFrame, placeholder: int = 100) -> DataFrame:
    """Distinct pairs with the constant that stands for a peer count, by prefix."""
    return sort_by_prefix(distinct_pairs(announcements).withColumn("placeholder", F.lit(placeholder)))


def prefix_counts(announcements: DataFrame) -> DataFrame:
    return announcements.groupBy("prefix").agg(F.count(F.lit(1)).alias("ann_count"))


def covering_join(df: DataFrame, roas: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of ``df`` with each ROA (``asn, roa_prefix, max_length``) whose prefix contains theirs."""
    right = roas.select("asn", "prefix", "max_length")
    return px.containment_join(df, right, strict=strict).withColumnRenamed("covering_prefix_", "roa_prefix")


def covered_announcements(announcements: DataFrame, roas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Announcements that some ROA covers, the earliest of each combination of keys."""
    covered = px.containment_join(announcements.select(*keys, "time"), roas.select("prefix"), how="left_semi")
    return covered.groupBy(*keys).agg(F.min("time").alias("time"))


def roa_code(joined_origin: Column, prefix: Column, asn: Column, max_length: Column) -> Column:
    wrong_origin, too_long = joined_origin != asn, prefix["len"] > max_length
    return F.when(wrong_origin & too_long, INVALID_BY_ALL).when(wrong_origin, INVALID_BY_ORIGIN).when(too_long, INVALID_BY_LENGTH).otherwise(VALID).cast("short")


def known_validity(pairs: DataFrame, roas: DataFrame) -> DataFrame:
    """A code for each pair and covering ROA."""
    joined = covering_join(pairs, roas)
    return joined.select("prefix", "origin", roa_code(F.col("origin"), F.col("prefix"), F.col("asn"), F.col("max_length")).alias("validity"))


def best_validity(codes: DataFrame) -> DataFrame:
    return codes.groupBy("prefix", "origin").agg(F.min("validity").alias("validity"))


def worst_validity(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """VALID if any ROA says so, else the largest code; UNKNOWN where none covers the pair."""
    worst = codes.groupBy("prefix", "origin").agg(F.when(F.min("validity") == VALID, VALID).otherwise(F.max("validity")).cast("short").alias("validity"))
    return pairs.join(worst, ["prefix", "origin"], "left").withColumn("validity", F.coalesce("validity", F.lit(UNKNOWN).cast("short")))


def all_validity(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Known codes, and UNKNOWN for the pairs that no ROA covers."""
    rest = pairs.join(known.select("prefix", "origin"), ["prefix", "origin"], "left_anti").withColumn("validity", F.lit(UNKNOWN).cast("short"))
    return known.select("prefix", "origin", "validity").unionByName(rest.select("prefix", "origin", "validity"))


def validated_pairs(announcements: DataFrame, roas: DataFrame) -> DataFrame:
    """Each distinct pair with the least code that a covering ROA gives it, UNKNOWN without one or without an origin.

    The code follows from three lengths: the longest that ROAs of the origin permit, that ROAs without an AS permit (they fit
    every origin), and that any ROA permits. So ROAs meet the pairs as one row for each prefix and AS, and one for each prefix,
    however many there are; a ROA without a length permits all.
    """
    permitted = F.coalesce("max_length", F.lit(2**31 - 1))
    given = roas.where("prefix is not null").groupBy(F.col("prefix").alias("ancestor"), "asn").agg(F.max(permitted).alias("own"))
    at_prefix = given.groupBy("ancestor").agg(F.max("own").alias("any"), F.max(F.when(F.col("asn").isNull(), F.col("own"))).alias("free"))
    of = px.lengths(at_prefix, "ancestor")
    above = px.with_ancestors(distinct_pairs(announcements), of, outer=True)
    met = above.join(at_prefix, "ancestor", "left").join(given.withColumnRenamed("asn", "origin"), ["ancestor", "origin"], "left")
    longest = met.groupBy("prefix", "origin").agg(F.max("any").alias("any"), F.max(F.greatest("own", "free")).alias("own"))
    n = F.col("prefix.len")
    code = F.when(F.col("any").isNull() | F.col("origin").isNull(), UNKNOWN).when(F.col("own") >= n, VALID).when(F.col("own").isNotNull(), INVALID_BY_LENGTH).when(F.col("any") >= n, INVALID_BY_ORIGIN).otherwise(INVALID_BY_ALL)
    return longest.select("prefix", "origin", code.cast("short").alias("validity"))


def top_level_prefixes(df: DataFrame) -> DataFrame:
    """Distinct prefixes that no other one strictly contains."""
    return nesting.outermost(df).where("top = prefix").select("prefix")


def non_top_prefixes(df: DataFrame, tops: DataFrame) -> DataFrame:
    return df.select("prefix").distinct().join(tops, "prefix", "left_anti")


def prefix_groups(df: DataFrame) -> DataFrame:
    """Each prefix with the top-level prefix that contains it: ``prefix, group_prefix``."""
    return nesting.outermost(df).withColumnRenamed("top", "group_prefix")


def most_specific_per_as(forwarding: DataFrame) -> DataFrame:
    """Rows of (asn, prefix) without those that a strictly more specific prefix of the same AS overrules."""
    return forwarding.join(nesting.overruled(forwarding, "asn"), ["asn", "prefix"], "left_anti")


def best_historical_roa(prefixes: DataFrame, roas: DataFrame) -> DataFrame:
    """Per prefix the covering ROA that expires last, then the most specific one, with the number of addresses of the prefix.

    ``roas`` has ``asn, prefix, maxlen, notafter``.
    """
    joined = px.containment_join(prefixes.select("prefix"), roas.select("asn", "prefix", "maxlen", "notafter")).withColumnRenamed("covering_prefix_", "roa_prefix")
    best = first_per_key(joined, ["prefix"], [F.col("notafter").desc(), F.col("roa_prefix.len").desc(), F.col("asn"), F.col("maxlen")])
    width = F.when(F.col("prefix.family") == 4, 32).otherwise(128)
    return best.withColumn("addresses", F.pow(F.lit(2.0), width - F.col("prefix.len")))


def earliest_roa(roas: DataFrame) -> DataFrame:
    """Equal ROAs of several days as one, with the earliest day."""
    keys = [c for c in roas.columns if c != "date_added"]
    return roas.groupBy(*keys).agg(F.min("date_added").alias("date_added"))


def longest_prefix_match(ips: DataFrame, pairs: DataFrame, value: str = "origin") -> DataFrame:
    """The value of the longest prefix that contains each address; of equally long ones the smallest value; null if none does.

    Each distinct address is looked up once, and the rows of ``ips`` are shuffled once, to get its value.
    """
    values = pairs.groupBy("prefix").agg(F.min(value).alias(value))
    found = nesting.innermost(ips, values).join(values.withColumnRenamed("prefix", "cover"), "cover", "left").select("prefix", value)
    return ips.join(found, "prefix", "left")


def collapsed_paths(hops: DataFrame, keys: list[str], order: str, value: str = "origin") -> DataFrame:
    """Value paths of traces in hop order, nulls left out and repeats in a row as one."""
    gathered = hops.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("h"))
    values = F.transform("h", lambda x: x[value])
    return gathered.select(*keys, F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1))).alias("path"))


def as_geo(asns: DataFrame, pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Place of an AS through the first of its prefixes (in prefix order): the longest geo block around it; none, no row.

    ``blocks`` has ``prefix`` and further columns of the place; of several rows of one prefix the least counts.
    """
    rest = [c for c in blocks.columns if c != "prefix"]
    blocks = blocks.groupBy("prefix").agg(F.min(F.struct(*rest)).alias("_place")).select("prefix", "_place.*")
    first = pairs.groupBy(F.col("origin").alias("asn")).agg(F.min_by("prefix", px.order_key(F.col("prefix"))).alias("prefix"))
    asked = asns.select("asn").distinct().join(first, "asn")
    around = nesting.innermost(asked, blocks).where("cover is not null").withColumnRenamed("cover", "block_prefix")
    return asked.join(around, "prefix").join(blocks.withColumnRenamed("prefix", "block_prefix"), "block_prefix")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
