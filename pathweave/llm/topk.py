"""Exact top-k inner products by impact-ordered indexes that are read score at a time.

Components are quantised to integer impacts. Each shard of rows has postings by (dimension, impact); a segment holds the
rows with that impact in that dimension. Queries go to every shard in blocks. A block reads the segments in levels of
descending impact, adding each level to all scores at once; after a level, what is left of a row can change a score by
the product of the norms of the query and of the row's rest at most. Reading stops only when this proves all but a few
rows of each query out, which are then rescored exactly, or when the index is read to its end, where scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.cluster import materialize

#: Rows of an index shard, and queries of a block.
SHARD_ROWS = 4096
BLOCK_QUERIES = 4096
#: Queries that are scored at once, which bounds a task's memory.
_AT_ONCE = 256
#: A level holds the impacts from a power of two up to twice that.
_SEGMENT = np.dtype([("dim", "<i4"), ("impact", "<i8"), ("begin", "<i4"), ("end", "<i4")])


def usable(vector: Column | str) -> Column:
    """Not null, and without null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as float64, short ones filled with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.asarray(column.value_lengths())
    out = np.zeros((len(length), dims))
    out[np.arange(dims) < length[:, None]] = np.asarray(column.flatten(), np.float64)
    return out


def build_index(rows: DataFrame, scale: float, dims: int, shards: int) -> DataFrame:
    """Index shards of (``vec_id``, ``embedding``): ``shard, ids, segments, postings``, the arrays as bytes.

    ``ids`` ascend; postings are positions in it. Segments come in descending order of absolute impact; impact 0 needs none.
    """

    def build(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["vec_id"])
        order = np.argsort(ids, kind="stable")
        impact = np.floor(scale * _matrix(table["embedding"], dims)).astype(np.int64)[order]
        row, dim = np.nonzero(impact)
        value = impact[row, dim]
        by = np.lexsort((row, value, dim, -np.abs(value)))
        row, dim, value = row[by].astype("<i4"), dim[by], value[by]
        first = np.flatnonzero(np.concatenate([[True], (dim[1:] != dim[:-1]) | (value[1:] != value[:-1])])) if len(row) else np.zeros(0, np.int64)
        segments = np.zeros(len(first), _SEGMENT)
        segments["dim"], segments["impact"], segments["begin"] = dim[first], value[first], first
        segments["end"] = np.append(first[1:], len(row))
        return pa.table({"shard": table["shard"][:1], "ids": [ids[order].astype("<i8").tobytes()], "segments": [segments.tobytes()], "postings": [row.tobytes()]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(build, "shard long, ids binary, segments binary, postings binary")


def _levels(segments: np.ndarray, postings: np.ndarray, rows: int, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level of impact, from the highest: its impacts as a rows x dims matrix, and the norm of what each row has below it."""
    impact = np.repeat(segments["impact"], segments["end"] - segments["begin"])
    dim = np.repeat(segments["dim"], segments["end"] - segments["begin"])
    level = np.frexp(np.abs(impact).astype(float))[1]
    rest = np.bincount(postings, impact.astype(float) ** 2, minlength=rows)
    out = []
    for value in np.unique(level)[::-1]:
        at = level == value
        part = np.zeros((rows, dims))
        part[postings[at], dim[at]] = impact[at]
        rest = rest - np.bincount(postings[at], impact[at].astype(float) ** 2, minlength=rows)
        out.append((part, np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9)))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best (query, row, score) by score, then smaller id; ``scores`` is -inf where a row is out."""
    scores[ids[None, :] == own[:, None]] = -np.inf
    n = scores.shape[1]
    place = scores * n - np.arange(n)  # a total order: rows stand by ascending id
    if n > k:
        chosen = np.argpartition(-place, k - 1, axis=1)[:, :k]
    else:
        chosen = np.broadcast_to(np.arange(n), scores.shape)
    value = np.take_along_axis(scores, chosen, 1)
    query, column = np.nonzero(np.isfinite(value))
    return query, chosen[query, column], value[query, column].astype(np.int64)


def search_shard(ids: np.ndarray, segments: np.ndarray, postings: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k rows of one shard for each query: (query id, row id, score). All scores are exact."""
    rows, dims = len(ids), queries.shape[1]
    levels = _levels(segments, postings, rows, dims)
    most = sum(float(np.abs(part).max(initial=0)) for part, _ in levels) * float(np.abs(queries).max(initial=0)) * dims
    kind = np.float32 if most < 2**24 else np.float64  # sums of integers stay exact
    levels = [(part.astype(kind), rest.astype(np.float64)) for part, rest in levels]
    whole = sum((part for part, _ in levels), np.zeros((rows, dims), kind))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), _AT_ONCE):
        q, own = queries[a : a + _AT_ONCE].astype(kind), query_ids[a : a + _AT_ONCE]
        norm = np.sqrt((queries[a : a + _AT_ONCE] ** 2).sum(axis=1))
        scores = np.zeros((len(q), rows), kind)
        result = None
        for part, rest in levels:
            scores += q @ part.T
            if rows <= k + 1 or not rest.any():
                continue
            # The first query tells whether a proof is near; k + 1 leave room for the query's own row.
            slack = norm[0] * rest
            if (scores[0] + slack >= np.partition(scores[0] - slack, rows - k - 1)[rows - k - 1]).sum() > rows // 8:
                continue
            slack = norm[:, None] * rest[None, :]
            least = np.partition(scores - slack, rows - k - 1, axis=1)[:, rows - k - 1]
            possible = scores + slack >= least[:, None]
            at, row = np.nonzero(possible)
            exact = np.full(scores.shape, -np.inf)
            exact[at, row] = (q[at].astype(np.float64) * whole[row]).sum(axis=1)
            result = _best(exact, ids, own, k)
            break
        if result is None:
            result = _best(scores.astype(np.float64), ids, own, k)
        query, row, score = result
        found.append((own[query], ids[row], score))
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found))  # type: ignore[return-value]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest integer inner product, for each of ``queries``: ``query_id, rank, vec_id, score``.

    Components become floor(scale * x). Ties go to the smaller id; all rows are returned where fewer than ``k`` exist. Rows
    with the query's own id are no candidates. Vectors that are null or hold null or non-finite components, and rows with a
    null id take no part, as query or as candidate; empty and shorter vectors count as filled with 0. A repeated row
    is a candidate each time; a repeated query is answered once, and of queries with one id that with the least vector. Empty tables give an empty result; other columns are
    not read.
    """
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null")
    asked = queries.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    m, query_dims = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    dims = max(dims or 1, query_dims or 1)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_queries))
    index = materialize(build_index(rows, scale, dims, shards))

    def block(table: pa.Table) -> pa.Table:
        impact = np.floor(scale * _matrix(table["embedding"], dims)).astype("<i8")
        return pa.table({"block": table["block"][:1], "query_ids": [np.asarray(table["vec_id"]).astype("<i8").tobytes()], "queries": [impact.tobytes()]})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
    query_blocks = dealt.groupBy("block").applyInArrow(block, "block long, query_ids binary, queries binary")
    # Both sides are dealt by (shard, block), so neither the index nor the queries meet in one task.
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    pairs = index.withColumn("block", numbers(blocks)).join(query_blocks.withColumn("shard", numbers(shards)), ["shard", "block"])
    pairs = pairs.repartition(shards * blocks, "shard", "block").select("ids", "segments", "postings", "query_ids", "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                ids, segments, postings, query_ids, flat = (x.as_py() for x in row)
                found = search_shard(
                    np.frombuffer(ids, "<i8"), np.frombuffer(segments, _SEGMENT), np.frombuffer(postings, "<i4"), np.frombuffer(query_ids, "<i8"), np.frombuffer(flat, "<i8").reshape(-1, dims).astype(float), k
                )
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
