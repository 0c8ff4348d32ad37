"""Shared helpers: materialised tables in the cluster's checkpoint folder, joins that bear hot keys, groups of sorted rows, and
connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets one of its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back, which cuts its lineage.

    The table survives the loss of any executor, and later readers prune its columns. Shuffle files of the write go when
    it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` has written, when nothing reads it any more."""
    spark = df.sparkSession
    root = shared_folder(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("table-") and root.split(":", 1)[-1].strip("/") in folder:
            path.getFileSystem(conf).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], copies: str, total: int, how: str = "inner", share: int = 10_000, least: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``copies`` the rows of ``left`` with it.

    Keys with more than a ``share``-th of the ``total`` rows are at most ``share``; these are broadcast, so their rows stay where they
    are. No partition of the other join gets more than that, or ``least``, rows of one key.
    """
    bound = max(least, total // share)
    if total <= bound:
        return left.join(right, keys, how)
    hot = right.where(F.col(copies) > bound)
    here = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(copies) <= bound), keys, how)
    return here.unionByName(rest)


#: Equal rows that are written in one piece.
PIECE_ROWS = 100_000


def each_row(counted: DataFrame) -> DataFrame:
    """Every row ``m`` times, with ``nth`` from 1; a row with a large number is written in pieces by several tasks."""
    one = counted.where("m = 1").withColumn("nth", F.lit(1).cast("long"))
    pieces = counted.where("m > 1").withColumn("piece", F.explode(F.expr(f"sequence(0L, (m - 1) div {PIECE_ROWS}L)")))
    pieces = pieces.repartition(F.xxhash64("doc_id", "piece"))
    many = pieces.withColumn("nth", F.explode(F.expr(f"sequence(piece * {PIECE_ROWS}L + 1, least(m, (piece + 1) * {PIECE_ROWS}L))")))
    return one.unionByName(many.drop("piece"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by ``keys`` as batches of whole groups: (rows, first row of each group and the end)."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(batch.num_rows, bool)
        for name in keys:
            key = np.asarray(batch.column(name))
            change[1:] |= key[1:] != key[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change)])
        if len(bounds) > 1:
            yield batch.slice(0, int(bounds[-1])), bounds
        held = batch.slice(int(bounds[-1]))  # the last group may go on in the next batch
    if held is not None and held.num_rows:
        yield pa.Table.from_batches([held]).combine_chunks().to_batches()[0], np.array([0, held.num_rows])


#: Edges that one task joins into components at once: 16 MB, and a few times that while it works.
LOCAL_EDGES = 1_000_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of some edges, and the smallest vertex of each one's component among these edges."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = where[: len(u)], where[len(u) :]
    root = np.arange(len(nodes))
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        apart = low != high
        left, right, low, high = left[apart], right[apart], low[apart], high[apart]
        # Every root that has an edge to a smaller one hangs itself on the smallest; then all point at roots again.
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
    return nodes, nodes[root]


def _contracted(edges: DataFrame, n: int) -> DataFrame:
    """In each of ``n`` partitions an edge from every vertex to the smallest one that its partition's edges lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            node, root = roots(rows.column("u").to_numpy(), rows.column("v").to_numpy())
            other = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], ["u", "v"])

    return edges.coalesce(n).mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Smallest reachable id of every vertex in ``edges`` (columns ``src``, ``dst``, both long): a stored table of (``node``, ``component``).

    Each task first joins its ``local_edges`` edges by itself, which leaves fewer edges than it has vertices. As soon as one task
    has them all, that is the result. Until then large-star and small-star steps alternate. Each is one partial
    aggregation per vertex and one join in which vertices with very many neighbours are broadcast, so their edges are never
    gathered. Holds each vertex that has an edge to another one; self-loops and null ends are dropped.
    """
    edges = materialize(
        edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    )
    seen, total = None, edges.count()
    tasks = -(-total // local_edges)
    if tasks:
        edges = _replaced(edges, _contracted(edges, tasks))
        total = edges.count() if tasks > 1 else total
    for _ in range(max_rounds):
        if total <= local_edges:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        large = join_hot(both, lowest, ["u"], "d", total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        small = join_hot(large, lowest, ["u"], "d", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        swapped = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = _replaced(edges, swapped.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        discard(large)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        total = max(1, state.n)
        if seen == (state.n, state.s):
            break
        seen = (state.n, state.s)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    if tasks > 1 and total <= local_edges:
        edges = _replaced(edges, _contracted(edges, 1))
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = materialize(nodes)
    discard(edges)
    return out


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` as a stored table; the table ``old``, from which it was made, is deleted."""
    new = materialize(new)
    discard(old)
    return new
