"""Mix sources to target weights by the cube method of balanced sampling.

Each source gets a target of words. A document's expected number of copies is its source's target over its source's
size; the whole part is taken outright and the fractional part is an inclusion probability. The flight phase moves
these probabilities through the null space of two constraints, the words and the documents taken, so that every step
keeps both totals; blocks of a source fly apart from each other. What is left of them, at most two rows a block, lands
together with a reserve of short documents that doesn't fly: the constraint on documents is dropped, and rows are rounded in
falling size so that the words still expected of the rest stay nearest to the words still missing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.cluster import each_row, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
MAX_COPIES = 3
#: Rows that fly in one block. A block leaves two undecided rows at most.
BLOCK_ROWS = 4096
#: Documents of a source, no longer than its mean, that wait for the landing, about.
RESERVE_ROWS = 1024


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_COPIES) -> DataFrame:
    """Targets of sources: (``source``, ``source_size``) -> those, ``target`` and ``source_no``.

    Sources in code point order, null last, weigh ``weights`` in turn. All sizes are shared by weight; a target stops
    at ``cap`` times its source's size and the excess is shared again among the others by weight. The shares have a
    closed form: with sources ordered by cap over weight, the first k stop and the others get one level times weight.
    Sees one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_no", F.row_number().over(by_name)).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    ranked = ranked.withColumn("limit", F.col("source_size") * float(cap))
    by_level = Window.orderBy(F.col("limit") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    leveled = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(by_level), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(by_level), F.lit(0.0))),
    )
    # The level at the first source that does not reach its cap holds for all later ones.
    final = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), F.col("source_no"), F.col("level").alias("level")))).over(everything)
    leveled = leveled.withColumn("final", final["level"])
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("final") * F.col("w")))
    return leveled.select("source", "source_no", "source_size", target.alias("target"))


def fly(sizes: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Flight phase over one block: at most two entries of the result lie strictly between 0 and 1.

    Three undecided rows at a time are moved along a vector that keeps both the sum of probabilities and the expected
    words, up or down at random with the odds that keep each probability's expectation.
    """
    p = p.astype(float).copy()
    eps = 1e-9
    open_rows = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    rng = np.random.default_rng(seed)
    draws = rng.random(2 * len(p) + 8)
    at = step = 0
    active: list[int] = []
    while True:
        while len(active) < 3 and at < len(open_rows):
            active.append(open_rows[at])
            at += 1
        if len(active) < 3:
            break
        a, b, c = (float(sizes[i]) for i in active)
        u = (b - c, c - a, a - b)
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(active, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(active, u) if v)
        move = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        for i, v in zip(active, u):
            p[i] += move * v
            if p[i] < eps:
                p[i] = 0.0
            elif p[i] > 1 - eps:
                p[i] = 1.0
        active = [i for i in active if 0 < p[i] < 1]
    return p


def land(sizes: np.ndarray, p: np.ndarray, missing: float) -> np.ndarray:
    """Landing: rounds rows in the given order, which is best by falling size, so that the words taken come to ``missing``.

    A row is taken where this brings the words that are then missing nearer to those expected of the rows after it.
    """
    rest = np.concatenate([np.cumsum((p * sizes)[::-1])[::-1][1:], [0.0]])
    out = np.zeros(len(p))
    for i, (size, later) in enumerate(zip(sizes.tolist(), rest.tolist())):
        if size > 0 and 2 * (missing - later) > size or size == 0 and p[i] >= 0.5:
            out[i] = 1
            missing -= size
    return out


def _block_flight(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h", "doc_id", "size"], na_position="last", kind="stable").reset_index(drop=True)
    seed = int(rows["source_no"].iloc[0]) * 1_000_003 + int(rows["block"].iloc[0])
    rows["p"] = fly(rows["size"].to_numpy(), rows["p"].to_numpy(), seed)
    return rows


def _landing(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)
    rows["p"] = land(rows["size"].to_numpy(), rows["p"].to_numpy(), float(rows["missing"].iloc[0]))
    return rows


def drawn_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), block_rows: int = BLOCK_ROWS, reserve_rows: int = RESERVE_ROWS) -> DataFrame:
    """The mix by distinct (``doc_id``, ``source``, ``size``): those, ``m`` rows that are equal in them, ``source_size``, ``target``, and the
    copies taken: each row stands ``whole`` times, and ``more`` of the m rows once more. See ``balanced_mix``."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    base = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    per_source = base.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    per_source = materialize(per_source)
    targets = source_targets(per_source.select("source", "source_size")).withColumnRenamed("source", "s")
    counts = per_source.select(F.col("source").alias("s"), "n")
    plan = targets.join(counts, targets["s"].eqNullSafe(counts["s"])).select(targets["s"], "source_no", "source_size", "target", "n")
    joined = base.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_COPIES)))).otherwise(0.0)
    blocks = F.ceil(F.col("n") / F.greatest(F.lit(float(block_rows)), F.sqrt("n"))).cast("long")
    # Of m equal rows with an expected number e of further copies, floor(e) get one, and one more gets one with probability e - floor(e).
    share = F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)) * F.col("m")
    reserve = F.col("size").between(1, F.col("source_size") / F.col("n")) & (F.pmod(F.xxhash64("h", F.lit(29)), F.lit(1 << 20)) < (1 << 20) * F.lit(2.0 * reserve_rows) / F.col("n"))
    drawn = (
        joined.withColumn("rate", rate)
        .withColumn("whole", F.floor(F.col("rate") + 1e-12))
        .withColumn("more", F.floor(share + 1e-12))
        .withColumn("p", F.greatest(share - F.col("more"), F.lit(0.0)))
        .withColumn("h", F.xxhash64("doc_id", "size", F.lit(17)))
        .withColumn("block", F.when(reserve, -1).otherwise(F.pmod(F.xxhash64("h", F.lit(5)), blocks)))
        .select("doc_id", "source", "size", "m", "source_no", "source_size", "target", "whole", "more", "p", "h", "block")
    )
    undecided = F.col("p").between(1e-12, 1 - 1e-12)
    waits = drawn.where(~undecided | (F.col("block") < 0))
    flown = drawn.where(undecided & (F.col("block") >= 0)).groupBy("source_no", "block").applyInPandas(_block_flight, drawn.schema)
    flown = materialize(waits.unionByName(flown))
    settled = flown.where(~undecided)
    copies = F.col("m") * F.col("whole") + F.col("more")
    taken = flown.groupBy("source_no").agg((F.max("target") - F.sum(F.col("size") * (copies + F.when(undecided, 0).otherwise(F.round("p"))))).alias("missing"))
    rest = flown.where(undecided).join(F.broadcast(taken), "source_no").select(*drawn.columns, "missing")  # a row a source
    landed = rest.groupBy("source_no").applyInPandas(_landing, rest.schema).drop("missing")
    out = settled.unionByName(landed).withColumn("more", (F.col("more") + F.round("p")).cast("long"))
    return out.select("doc_id", "source", "size", "m", "source_size", "target", "whole", "more")


def balanced_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), block_rows: int = BLOCK_ROWS, reserve_rows: int = RESERVE_ROWS) -> DataFrame:
    """Copies of every document in the mix: ``doc_id, size, source_size, target, taken, copies``, one row per input row.

    ``taken`` is ``size`` times ``copies``, which never exceeds ``MAX_COPIES``. Null and empty texts have size 0 and take
    part with no words; a null source is a source of its own, last in order; rows with equal ids are drawn each for
    itself. Rows with equal id, source and size are interchangeable: they are drawn as one with a count, of which the
    expected number is taken, rounded by the draw. An empty table gives an empty result. Reruns give the same rows,
    whatever the partitioning. Other columns of ``docs`` are not read.
    """
    out = each_row(drawn_mix(docs, id_col, text_col, source_col, weights, block_rows, reserve_rows))
    out = out.withColumn("copies", (F.col("whole") + (F.col("nth") <= F.col("more")).cast("int")).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
