"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces of documents go, longest first, into the open bin with the least room that still holds them. Where none does, a
new bin opens. For every permitted length it is tried how far the pieces that remain would fill it, and the length with the
least cost per token held is opened, so lengths are chosen jointly with what is still to be packed. At last each bin shrinks
to the shortest permitted length that holds its contents. Hash groups of bounded size are packed apart from each other; the loss is at most a few bins a group.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.cluster import each_row, materialize
from pathweave.llm.mixing import word_count

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Tokens' worth of cost that a sequence has besides its length, and the share of attention that grows with the square: full
#: sequences of 2,048 cost least per token, shorter ones pay more for each sequence, longer ones for attention.
SEQUENCE_COST = 64.0
ATTENTION = 0.1
#: Documents of one packing group.
GROUP_ROWS = 8192


def bin_cost(length: float, longest: int = LENGTHS[-1]) -> float:
    """Cost of a sequence: its length, a fixed part, and a part that grows with the square of the length."""
    return SEQUENCE_COST + length + ATTENTION * length * length / longest


class Remaining:
    """Sizes still to be placed, counted; finds the largest one up to a bound by the bits of one number."""

    def __init__(self, sizes: np.ndarray):
        self.count = np.bincount(sizes, minlength=1).tolist()
        self.bits = sum(1 << size for size in np.unique(sizes).tolist())

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.bits ^= 1 << size

    def fill(self, room: int) -> int:
        """Words that largest-first filling puts into ``room``."""
        left, bits = room, self.bits
        while left:
            bits &= (1 << (left + 1)) - 1
            if not bits:
                break
            size = bits.bit_length() - 1
            left -= size * min(self.count[size], left // size)
            bits ^= 1 << size
        return room - left


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pack sizes (each from 1 to the longest length): (bin of each, offset in it, length of each bin after downsizing).

    Deterministic: longest first, ties by position; among bins of equal room the oldest; of lengths at equal cost the shortest.
    """
    lengths = tuple(sorted(lengths))
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    remaining = Remaining(sizes.astype(np.int64))
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (free words, bin), sorted
    for i in order:
        size = int(sizes[i])
        remaining.take(size)
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            b = len(used)
            free = min((c for c in lengths if c >= size), key=lambda c: (bin_cost(c, lengths[-1]) / (size + remaining.fill(c - size)), c))
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if free > size:
            insort(room, (free - size, b))
    return bins, offsets, [min(c for c in lengths if c >= u) for u in used]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Place every word of every document: ``doc_id, piece, start, n_words, bin_id, bin_length, bin_offset``.

    A document longer than the longest length is cut into pieces of that length and a rest; piece ``piece`` holds words
    ``start`` to ``start + n_words``. ``bin_id`` is unique in the result. Null and empty texts have no words and give one
    row with ``n_words`` 0 and null bin, so no input row is lost. Ids are of any type. Rows with equal ids or texts are packed
    each for itself; equal rows are interchangeable and are dealt to groups one by one; an empty table gives an empty result; other columns are not read.
    """
    longest = max(lengths)
    sized = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"))
    base = materialize(sized.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("m")))
    total = base.where("size > 0").agg(F.sum("m")).first()[0] or 0
    groups = max(1, -(-total // group_rows))
    grouped = each_row(base).withColumn("group", F.pmod(F.xxhash64("doc_id", "size", "nth"), F.lit(groups))).select("doc_id", "size", "group")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, n_words long, bin_id long, bin_length int, bin_offset int"
    empty = grouped.where("size = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words"), *[F.lit(None).cast(t).alias(n) for n, t in (("bin_id", "long"), ("bin_length", "int"), ("bin_offset", "int"))])

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], na_position="last", kind="stable").reset_index(drop=True)
        size = rows["size"].to_numpy(np.int64)
        pieces = -(-size // longest)
        row = np.repeat(np.arange(len(rows)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * longest
        n = np.minimum(longest, size[row] - start)
        bins, offsets, shrunk = best_fit(n, lengths)
        out = pd.DataFrame({"doc_id": rows["doc_id"].iloc[row].array, "piece": piece.astype(np.int32), "start": start, "n_words": n})
        group = int(rows["group"].iloc[0]) << 32
        return out.assign(bin_id=bins + group, bin_length=np.asarray(shrunk, np.int32)[bins], bin_offset=offsets.astype(np.int32))

    return grouped.where("size > 0").groupBy("group").applyInPandas(pack_group, schema).unionByName(empty)
