"""Nesting of prefixes by one ordered pass: which prefix stands around another, without expanding any to its ancestors.

Two prefixes are nested or apart, so in the order of their first address, then length, they are like brackets: a prefix opens
at its first address and closes behind its last one. Rows are dealt out by ranges of that order. Each range gets copies of the
prefixes that are open where it begins (a chain of at most 33 or 129, found from one row a range), after which it is complete
in itself, and window functions read off what stands around each row. Nothing is gathered, and no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.functions.stored import stored


def last_address(prefix: Column) -> Column:
    """The last address of a prefix, as a host route."""
    low_bits = F.when(prefix["family"] == 4, prefix["len"] + 32).otherwise(prefix["len"] - 64)
    hi = F.when(prefix["family"] == 4, F.lit(0)).otherwise(prefix["hi"].bitwiseOR(F.bitwise_not(px._mask(prefix["len"]))))
    tail = F.bitwise_not(px._mask(low_bits))
    lo = prefix["lo"].bitwiseOR(F.when(prefix["family"] == 4, tail.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).otherwise(tail))
    return F.struct(prefix["family"].alias("family"), hi.cast("long").alias("hi"), lo.cast("long").alias("lo"), F.when(prefix["family"] == 4, 32).otherwise(128).cast("int").alias("len"))


def _place(at: Column, closes: bool, length: Column, asks: bool) -> Column:
    """Order of events: by address; what opens before what asks before what closes, but shorter prefixes first among the former two."""
    unsigned = lambda half: at[half].bitwiseXOR(F.lit(-(2**63)).cast("long")).alias(half)
    return F.struct(at["family"].alias("family"), unsigned("hi"), unsigned("lo"), F.lit(closes).alias("closes"), length.alias("len"), F.lit(asks).alias("asks"))


def _opening(prefixes: DataFrame) -> DataFrame:
    p = F.col("prefix")
    return prefixes.select(_place(p, False, p["len"], False).alias("place"), "prefix", p.alias("at"), F.lit(1).alias("step"))


def _asking(prefixes: DataFrame) -> DataFrame:
    p = F.col("prefix")
    return prefixes.select(_place(p, False, p["len"], True).alias("place"), "prefix", p.alias("at"), F.lit(0).alias("step"))


def _closing(prefixes: DataFrame) -> DataFrame:
    p = F.col("prefix")
    return prefixes.select(_place(last_address(p), True, p["len"], False).alias("place"), "prefix", last_address(p).alias("at"), F.lit(-1).alias("step"))


def dealt(events: DataFrame) -> DataFrame:
    """Events in ranges (``part``), with copies (``copy``) of the opening events that are not closed where a range begins."""
    ranged = stored(events.repartitionByRange("place").withColumn("part", F.spark_partition_id()))
    opened = ranged.where("step = 1").select("place", "prefix", "at", "step")
    first = ranged.groupBy("part").agg(F.min("place").alias("first"), F.min_by("at", "place").alias("at"))
    first = first.select("part", "first", px.make(F.col("at.family"), F.col("at.hi"), F.col("at.lo"), last_address(F.col("at"))["len"]).alias("address"))
    # A row for each length that occurs and each range: what stands around a range's first address.
    around = px.with_ancestors(first, px.lengths(opened), "address").select("part", "first", F.col("ancestor").alias("prefix"))
    copies = opened.join(F.broadcast(around), "prefix")  # at most 129 rows a range
    p = F.col("prefix")
    copies = copies.where((F.col("place") < F.col("first")) & (_place(last_address(p), True, p["len"], False) >= F.col("first")))
    return ranged.withColumn("copy", F.lit(False)).unionByName(copies.select("place", "prefix", "at", "step", "part", F.lit(True).alias("copy")))


def outermost(prefixes: DataFrame) -> DataFrame:
    """Each distinct prefix with the outermost one around it: ``prefix, top``, itself where none stands around it. Nulls drop out."""
    own = prefixes.select("prefix").where("prefix is not null").distinct()
    order = Window.partitionBy("part").orderBy("place")
    # Of all prefixes before, that which reaches furthest; of those with one end the shortest: an outermost one itself.
    end = _place(last_address(F.col("prefix")), True, F.lit(0), False)
    reach = F.struct(end.alias("end"), (-F.col("prefix.len")).alias("width"), F.col("prefix").alias("prefix"))
    furthest = F.max(reach).over(order.rowsBetween(Window.unboundedPreceding, -1))
    swept = dealt(_opening(own)).withColumn("furthest", furthest).where("not copy")
    inside = F.col("furthest.end") > F.col("place").withField("closes", F.lit(False)).withField("len", F.lit(0)).withField("asks", F.lit(False))
    return swept.select("prefix", F.when(inside, F.col("furthest.prefix")).otherwise(F.col("prefix")).alias("top"))


def innermost(asked: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Each distinct prefix of ``asked`` with the longest of ``prefixes`` that contains or equals it: ``prefix, cover``, null if none. Nulls drop out.

    The number of open brackets tells the depth, and the bracket of that depth that was opened last is the one around a row.
    """
    known = prefixes.select("prefix").where("prefix is not null").distinct()
    wanted = asked.select("prefix").where("prefix is not null").distinct()
    order = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = _opening(known).unionByName(_closing(known)).unionByName(_asking(wanted))
    deep = dealt(events).withColumn("depth", F.sum("step").over(order))
    # Rows of one range and depth lie in one partition already, so only their order changes.
    level = Window.partitionBy("part", "depth").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = F.last(F.when(F.col("step") == 1, F.col("prefix")), ignorenulls=True).over(level)
    return deep.withColumn("cover", around).where("step = 0").select("prefix", F.when(F.col("depth") > 0, F.col("cover")).alias("cover"))


def overruled(rows: DataFrame, key: str, prefix: str = "prefix") -> DataFrame:
    """Distinct (key, prefix) of ``rows`` inside which a strictly more specific prefix of the same key lies.

    In order, what lies inside a prefix follows it directly, so the next row tells. A key with many rows is cut into ranges
    like all others, and the last row of a range looks at the first one of the next range.
    """
    own = rows.select(F.col(key).alias("key"), F.col(prefix).alias("prefix")).where("key is not null and prefix is not null").distinct()
    keyed = own.withColumn("place", F.struct("key", px.order_key(F.col("prefix")).alias("order")))
    ranged = stored(keyed.repartitionByRange("place").withColumn("part", F.spark_partition_id()))
    first = ranged.groupBy("part").agg(F.min_by(F.struct("key", "prefix"), "place").alias("first"))
    following = first.select("part", F.lead("first").over(Window.orderBy("part")).alias("beyond"))  # one row a range
    following_row = F.lead(F.struct("key", "prefix")).over(Window.partitionBy("part").orderBy("place"))
    ahead = ranged.join(following, "part").withColumn("ahead", F.coalesce(following_row, "beyond"))
    inside = (F.col("ahead.key") == F.col("key")) & px.strictly_covered_by(F.col("ahead.prefix"), F.col("prefix"))
    return ahead.where(inside).select(F.col("key").alias(key), F.col("prefix").alias(prefix))
