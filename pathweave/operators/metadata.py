"""Ids, blocks and the announcement metadata chain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions import prefix as px
from pathweave.functions.stored import stored


def dense_id(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Numbers rows from 0 without gaps in the given order, without putting all rows into one task.

    Rows are dealt out by ranges of the order and numbered inside each; the rows of the ranges before are added. Only one
    count per range is gathered. Ties must be equal rows for the numbers to be the same in each run.
    """
    # A range of the order is one partition, and both readers below must see the same ranges.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged.withColumn("_at", F.monotonically_increasing_id() - F.col("_part").cast("long") * (1 << 33)))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")  # one row a partition


def attach_ids(pairs: DataFrame, prefix_ids: DataFrame, origin_ids: DataFrame) -> DataFrame:
    return pairs.join(prefix_ids.select("prefix", "prefix_id"), "prefix").join(origin_ids.select("origin", "origin_id"), "origin")


def water_filling(histogram: list[tuple[int, int]], n_blocks: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each (count, prefixes) in falling order of count, how many of these prefixes each block gets.

    The greedy puts each prefix into the lightest block with room, of equally light ones the first. Among prefixes of one count a
    block's weight rises by steps of that count, so the greedy takes the least of all steps: those below a level, found
    by halving, and of the steps at the level those of the first blocks. No prefix is looked at one by one.
    """
    weight, room = np.zeros(n_blocks, np.int64), np.full(n_blocks, most, np.int64)
    for count, n in histogram:

        def steps(level: int, count: int = count) -> np.ndarray:
            """Prefixes that a block takes before its weight is ``level`` or more; with count 0 the weight never rises."""
            if count == 0:
                return np.where(weight < level, room, 0)
            return np.clip(-((weight - level) // count), 0, room)

        low, high = int(weight.min()), int(weight.max()) + count * (n // n_blocks + most + 1) + 1
        while high - low > 1:
            middle = (low + high) // 2
            if int(steps(middle).sum()) <= n:
                low = middle
            else:
                high = middle
        given = steps(low)
        rest = n - int(given.sum())
        # Those left stand exactly at the level: one each, or with count 0 as many as there is room for, first blocks first.
        at_level = np.where(weight + given * count == low, np.minimum(room - given, 1 if count else most), 0)
        given = given + np.clip(rest - (np.cumsum(at_level) - at_level), 0, at_level)
        weight, room = weight + given * count, room - given
        yield count, given


def balanced_blocks(counts: DataFrame, max_block_size: int) -> DataFrame:
    """Blocks of at most ``max_block_size`` prefixes with about equal announcements: ``prefix, ann_count, block_id``.

    There are n // max_block_size + 1 blocks. The greedy choice (largest count first, into the lightest block with room)
    depends only on how many prefixes have each count, so ``water_filling`` plans it on that histogram. Prefixes get a rank
    by falling count, then in prefix order, and a count's ranks are given out to its blocks, those with most prefixes first:
    blocks with equally many are a group, so a rank's block is a division. The plan has a row per count, with at most as many
    blocks as the count has prefixes. An empty table has no blocks. Null counts are not permitted.
    """
    spark = counts.sparkSession
    histogram = sorted(((r.ann_count, r.n) for r in counts.groupBy("ann_count").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    n_blocks = sum(n for _, n in histogram) // max_block_size + 1
    plan, first = [], 0
    for count, given in water_filling(histogram, n_blocks, max_block_size):
        groups, at = [], first
        for each in sorted({int(k) for k in given if k}, reverse=True):
            blocks = np.flatnonzero(given == each).tolist()
            groups.append((at, each, blocks))
            at += each * len(blocks)
        plan.append((count, groups))
        first = at
    plan_table = spark.createDataFrame(plan, "ann_count long, groups array<struct<first: long, each: long, blocks: array<int>>>")
    ranked = dense_id(counts.select("prefix", F.col("ann_count").cast("long").alias("ann_count")), [F.col("ann_count").desc(), px.order_key(F.col("prefix"))], "_rank")
    # Spark broadcasts the plan while it is small; beyond that a count that most prefixes share is split as a skewed key.
    group = F.element_at(F.filter("groups", lambda g: g["first"] <= F.col("_rank")), -1)
    placed = ranked.join(plan_table, "ann_count").withColumn("_g", group)
    block = F.get(F.col("_g.blocks"), F.expr("cast((_rank - _g.first) div _g.each as int)"))
    return placed.select("prefix", "ann_count", block.alias("block_id"))


def pack_groups(sizes: DataFrame, max_block_size: int) -> DataFrame:
    """Blocks of whole groups (``group_prefix, n``) of ``max_block_size`` at most: adds ``block_id``, from 0 without gaps.

    Groups of which k fit side by side, but not k + 1, make class k; in order of size, each k of them are a block, so no block
    is over-full and all but the last of a class are more than half full. A group larger than a block has its own.
    """
    classed = sizes.withColumn("_fit", F.greatest(F.lit(1), F.floor(F.lit(max_block_size) / F.col("n"))).cast("long"))
    numbered = dense_id(classed, ["_fit", F.col("n").desc(), px.order_key(F.col("group_prefix"))], "_place")
    # One row a class: max_block_size at most.
    classes = classed.groupBy("_fit").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.orderBy("_fit").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.select("_fit", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"), F.coalesce(F.sum(F.ceil(F.col("_k") / F.col("_fit"))).over(before), F.lit(0)).alias("_block"))
    placed = numbered.join(F.broadcast(starts), "_fit")
    return placed.select("group_prefix", "n", (F.col("_block") + F.floor((F.col("_place") - F.col("_start")) / F.col("_fit"))).cast("long").alias("block_id"))


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_prefix").agg(F.count(F.lit(1)).alias("n"))


def block_prefix_id(df: DataFrame) -> DataFrame:
    """Number of a prefix inside its block, from 0 in prefix order."""
    place = F.dense_rank().over(Window.partitionBy("block_id").orderBy(px.order_key(F.col("prefix")))) - 1
    return df.select("prefix", "block_id").distinct().withColumn("block_prefix_id", place)


def attach_blocks(pairs: DataFrame, blocks: DataFrame, validity: DataFrame) -> DataFrame:
    return pairs.join(blocks.select("prefix", "block_id"), "prefix").join(validity.select("prefix", "origin", "validity"), ["prefix", "origin"])


def attach_block_ids(pairs: DataFrame) -> DataFrame:
    return pairs.join(block_prefix_id(pairs), ["prefix", "block_id"])


def announcements_with_metadata(announcements: DataFrame, metadata: DataFrame) -> DataFrame:
    return announcements.join(metadata, ["prefix", "origin"]).withColumn("origin_hijack_asn", F.lit(None).cast("long"))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per combination of keys: the first in the given order."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)) if rest else None
    return df.select(*keys).distinct() if picked is None else df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, "_r.*")


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")
