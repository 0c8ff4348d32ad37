"""Embedding near duplicates by spherical-cap filters from structured random product codes.

A rotated vector is cut into blocks, and each block has a small random code of unit directions. One direction from each
block's code makes a filter direction, so a few codes make very many filters. A vector passes every filter whose direction
it exceeds a threshold on; the list is decoded by sorting the sums of half of the blocks and meeting in the middle, without
looking at filters that can't exceed. Vectors of a label that pass a filter together are compared exactly. With few
dimensions a cap that keeps near vectors together is a large part of the sphere, so these have one filter that all pass.

Equal vectors are first reduced to one with a count. They are sent once for all filters that share the direction of the
first half, and apart for each filter where those are many. A pair that meets in several filters is counted in the smallest
of them. Comparisons are made in blocks inside tasks, which send sums of links and spanning edges, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pathweave.llm.cluster import connected_components, join_hot, materialize, roots
from pathweave.llm.topk import usable

BLOCKS = 2
CODE = 256
#: Filters that a random vector exceeds on average, and the least number that a vector gets: its best ones, if fewer exceed.
EXPECTED = 4
LEAST = 48
#: With fewer dimensions all vectors of a label are compared with each other.
FEW_DIMS = 16
#: Vectors of a filter that one task compares with each other; a larger filter is cut into parts that meet pair by pair.
PART_ROWS = 2048
#: A cosine from unit vectors that is as near to the bound is computed anew, in one division, as rounding may have moved it.
_DOUBT = 1e-9
_SEED = 7
_FAR = np.iinfo(np.int64).max


class ProductCode:
    """Filters for vectors of one dimension, the same in every task."""

    def __init__(self, dims: int, blocks: int = BLOCKS, code: int = CODE, expected: float = EXPECTED):
        self.blocks, self.code = min(blocks, max(1, dims)), code
        rng = np.random.default_rng(_SEED)
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.cuts = np.linspace(0, dims, self.blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            c = rng.standard_normal((code, b - a))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        # The threshold is where random directions exceed `expected` filters on average.
        probe = rng.standard_normal((200, dims))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        share = expected / code**self.blocks
        self.threshold = float(np.mean([np.quantile(self._all(p), 1 - share) for p in self._parts(probe)]))

    def _parts(self, vectors: np.ndarray) -> np.ndarray:
        """Inner products of each block with its code: rows x blocks x code."""
        turned = vectors @ self.rotation
        return np.stack([turned[:, a:b] @ c.T for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes)], axis=1)

    @staticmethod
    def _outer(parts: np.ndarray) -> np.ndarray:
        out = parts[0]
        for p in parts[1:]:
            out = (out[:, None] + p[None, :]).ravel()
        return out

    def _all(self, parts: np.ndarray) -> np.ndarray:
        return self._outer(parts)

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Filters that each unit vector passes, ascending: all that exceed the threshold, and its best ``LEAST``."""
        half = self.blocks // 2
        size = self.code ** (self.blocks - half)
        out = []
        for parts in self._parts(vectors):
            left = self._outer(parts[:half]) if half else np.zeros(1)
            right = self._outer(parts[half:])
            by_left, by_right = np.argsort(-left), np.argsort(-right)
            a, b = left[by_left], right[by_right]
            threshold = self.threshold
            a = a[: np.searchsorted(-a, b[0] - threshold, side="right")]
            reach = np.searchsorted(-b, a - threshold, side="right")
            if reach.sum() < LEAST:
                # The best sums lie among the first LEAST of each side.
                top = np.add.outer(left[by_left[:LEAST]], b[:LEAST])
                i, j = np.unravel_index(np.argsort(-top, axis=None)[:LEAST], top.shape)
            else:
                i = np.repeat(np.arange(len(a)), reach)
                j = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
            out.append(np.sort(by_left[i].astype(np.int64) * size + by_right[j]))
        return out


def _scaled(column: pa.Array) -> np.ndarray:
    """Vectors times a power of two each, which changes no digit, so that squares neither vanish nor overflow."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(scaled: np.ndarray) -> np.ndarray:
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _with_filters(vectors: DataFrame, kind: str) -> DataFrame:
    """Adds the filters that each vector passes, and for each direction of the first half its first and last place among them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            dims = np.asarray(batch.column(4))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                if d >= FEW_DIMS and d not in codes:
                    codes[d] = ProductCode(int(d))
                for a in range(0, part.num_rows, 512):
                    rows = part.slice(a, 512)
                    lists = codes[d].decode(_unit(_scaled(rows.column(3)))) if d >= FEW_DIMS else [np.zeros(1, np.int64)] * rows.num_rows
                    ends = np.cumsum([len(x) for x in lists])
                    values = np.concatenate(lists)
                    code, owner = values // CODE, np.repeat(np.arange(len(lists)), np.diff(ends, prepend=0))
                    first = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(owner, prepend=-1))
                    start = np.append(0, ends)[owner[first]]
                    halves = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (code[first], first - start + 1, np.append(first[1:], len(code)) - start)], ["code", "first", "last"])
                    filters = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values.astype(np.int32)))
                    halves = pa.ListArray.from_arrays(pa.array(np.append(0, np.searchsorted(first, ends)), pa.int32()), halves)
                    yield pa.RecordBatch.from_arrays([*rows.columns, filters, halves], [*batch.schema.names, "filters", "codes"])

    return vectors.mapInArrow(emit, f"id long, copies long, label long, embedding array<{kind}>, dims int, vec_id long, filters array<int>, codes array<struct<code:int,first:int,last:int>>")


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges begin:end, one range after the other, and which range each is of."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + (begin - (np.cumsum(size) - size))[which], which


def _by_filter(lists: pa.Array, codes: np.ndarray, cuts: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of the cells begin:end once for each of their filters, sorted by cell and filter: rows, filters, bounds of equal filters."""
    offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
    row, cell = _ranges(begin, end)
    place, which = _ranges(offsets[row], offsets[row + 1])
    row, cell, value = row[which], cell[which], values[place]
    inside = np.where(cuts[row] < 0, value // CODE == codes[row], value == cuts[row])
    row, cell, value = row[inside], cell[inside], value[inside]
    order = np.lexsort((row, value, cell))
    row, cell, value = row[order], cell[order], value[order]
    change = np.flatnonzero(np.diff(cell, prepend=-1) | np.diff(value, prepend=-1))
    return row, value, change, np.append(change[1:], len(row))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of scaled vectors, summed from left to right."""
    dot, xx, yy = (np.add.accumulate(p, axis=1)[:, -1] for p in (x * y, x * x, y * y))
    return dot / np.sqrt(xx * yy)


def _reaches(cosine: np.ndarray, scaled: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether rows x and y, whose unit vectors have this inner product, are at cosine >= least."""
    out = cosine >= least
    doubt = np.flatnonzero(np.abs(cosine - least) < _DOUBT)
    for a in range(0, len(doubt), 1 << 15):
        at = doubt[a : a + (1 << 15)]
        out[at] = _cosine(scaled[x[at]], scaled[y[at]]) >= least
    return out


#: Cells of up to this many vectors are compared pair by pair, larger ones as matrices.
_SMALL = 24


def _first_meeting(lists: pa.Array, i: np.ndarray, j: np.ndarray, current: np.ndarray) -> np.ndarray:
    """Whether ``current`` is the smallest filter that rows i and j share."""
    offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
    size = np.diff(offsets)
    out = np.ones(len(i), bool)
    step = max(1, 4_000_000 // int(size.max(initial=1)) ** 2)
    for a in range(0, len(i), step):
        x, y, c = i[a : a + step], j[a : a + step], current[a : a + step, None]
        place = np.arange(max(size[x].max(), size[y].max()))
        u = np.where(place < size[x][:, None], values[np.minimum(offsets[x][:, None] + place, len(values) - 1)], -1)
        v = np.where(place < size[y][:, None], values[np.minimum(offsets[y][:, None] + place, len(values) - 1)], -2)
        u = np.where(u < c, u, -1)
        out[a : a + step] = ~(u[:, :, None] == v[:, None, :]).any(axis=(1, 2))
    return out


def _small_cells(unit: np.ndarray, scaled: np.ndarray, rows: np.ndarray, begin: np.ndarray, end: np.ndarray, sides: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``rows`` of pairs at cosine >= least inside small cells begin:end of it, all cells at once."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    place, cell = _ranges(begin, end)
    cell_end = end[cell]
    for k in range(1, int((end - begin).max(initial=0))):
        i = place[place + k < cell_end]
        j = i + k
        met = (sides[rows[i]] == 0) | (sides[rows[i]] != sides[rows[j]])
        i, j = i[met], j[met]
        for a in range(0, len(i), 1 << 15):
            p, q = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            x, y = rows[p], rows[q]
            close = _reaches(np.einsum("ij,ij->i", unit[x], unit[y]), scaled, x, y, least)
            left.append(p[close])
            right.append(q[close])
    return np.concatenate(left), np.concatenate(right)


def _spanning(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges that join all ids of rows (left) and columns (right) that ``close`` joins."""
    u, v, a, b = left[:0], left[:0], left, right
    while True:
        low_a = np.where(close, b, _FAR).min(axis=1, initial=_FAR)
        low_b = np.where(close, a[:, None], _FAR).min(axis=0, initial=_FAR)
        if not ((low_a < a).any() or (low_b < b).any()):
            return u, v
        u = np.concatenate([u, a[low_a < a], b[low_b < b]])
        v = np.concatenate([v, low_a[low_a < a], low_b[low_b < b]])
        joined = roots(u, v)
        a, b = _root_of(a, *joined), _root_of(b, *joined)


def _root_of(ids: np.ndarray, node: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The roots of ids, where they are nodes; else the ids."""
    if not len(node):
        return ids
    at = np.minimum(np.searchsorted(node, ids), len(node) - 1)
    return np.where(node[at] == ids, root[at], ids)


def _large_cell(x: np.ndarray, y: np.ndarray, unit: np.ndarray, scaled: np.ndarray, lists: pa.Array, current: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows x and y are close, and which of those meet here first, as matrices; x is y for a whole cell."""
    cosine = unit[x] @ unit[y].T
    close = cosine >= least
    i, j = np.nonzero(np.abs(cosine - least) < _DOUBT)  # too near to the bound for a product of matrices
    close[i, j] = _reaches(cosine[i, j], scaled, x[i], y[j], least)
    if x is y:
        np.fill_diagonal(close, False)
    if not close.any():
        return close, close
    offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)

    def earlier(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = offsets[rows + 1] - offsets[rows]
        at = np.repeat(offsets[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner, value = np.repeat(np.arange(len(rows)), size), values[at]
        return owner[value < current], value[value < current]

    (ox, vx), (oy, vy) = earlier(x), earlier(y)
    known, number = np.unique(np.concatenate([vx, vy]), return_inverse=True)
    bx, by = np.zeros((len(x), len(known)), np.float32), np.zeros((len(y), len(known)), np.float32)
    bx[ox, number[: len(vx)]] = 1
    by[oy, number[len(vx) :]] = 1
    shared = (bx.sum(axis=0) > 0) & (by.sum(axis=0) > 0)
    return close, close & (bx[:, shared] @ by[:, shared].T == 0)


def _compare(rows: DataFrame, least: float) -> DataFrame:
    """Compare the vectors of each cell (label, dims, code, cut, part of left, part of right), sorted: ``id, links, root``.

    A cell holds all filters of a direction of the first half, or the one filter ``cut``. ``links`` are the copies linked in
    pairs that are counted here, ``root`` the smallest id reachable by the links found at once, those counted elsewhere included.
    """
    names = ["label", "dims", "code", "cut", "p", "q"]

    def compared(batch: pa.RecordBatch, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, copies, sides, codes, cuts, dims = (np.asarray(batch.column(n)) for n in ("id", "copies", "side", "code", "cut", "dims"))
        lists = batch.column("filters")
        lists = pa.ListArray.from_arrays(lists.offsets, lists.values)  # offsets count from the values' start
        for d in np.unique(dims[begin]):
            own = dims[begin] == d
            rows_of = dims == d
            scaled, unit = np.zeros((2, len(ids), int(d)))
            scaled[rows_of] = _scaled(batch.column("embedding").filter(pa.array(rows_of)))
            unit[rows_of] = _unit(scaled[rows_of])
            at, filters, first, last = _by_filter(lists, codes, cuts, begin[own], end[own])
            links = np.zeros(len(ids), np.int64)
            small = last - first <= _SMALL
            i, j = _small_cells(unit, scaled, at, first[small], last[small], sides, least)
            current, i, j = filters[i], at[i], at[j]
            counted = _first_meeting(lists, i, j, current)
            np.add.at(links, i[counted], copies[j[counted]])
            np.add.at(links, j[counted], copies[i[counted]])
            u, v = [ids[i]], [ids[j]]
            for a, b in zip(first[~small].tolist(), last[~small].tolist()):
                x = y = at[a:b]
                parted = sides[x[0]] != 0
                if parted:
                    x, y = x[sides[x] == 1], x[sides[x] == 2]
                close, counted = _large_cell(x, y, unit, scaled, lists, int(filters[a]), least)
                links[x] += counted @ copies[y]
                if parted:
                    links[y] += counted.T @ copies[x]
                for edges, ends in zip((u, v), _spanning(close, ids[x], ids[y])):
                    edges.append(ends)
            root = _root_of(ids, *roots(np.concatenate(u), np.concatenate(v)))
            hit = np.flatnonzero((links > 0) | (root < ids))
            if not len(hit):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c[hit], pa.int64()) for c in (ids, links, root)], ["id", "links", "root"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def cells(batch: pa.RecordBatch) -> np.ndarray:
            change = np.zeros(batch.num_rows, bool)
            for name in names:
                k = np.asarray(batch.column(name))
                change[1:] |= k[1:] != k[:-1]
            return np.concatenate([[0], np.flatnonzero(change), [batch.num_rows]])

        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            bounds = cells(batch)
            many = np.diff(bounds[:-1]) > 1  # the last cell may go on in the next batch
            yield from compared(batch, bounds[:-2][many], bounds[1:-1][many])
            held = batch.slice(int(bounds[-2]))
        if held is not None and held.num_rows > 1:
            held = pa.Table.from_batches([held]).take(pa.array(np.arange(held.num_rows))).combine_chunks().to_batches()[0]
            yield from compared(held, np.array([0]), np.array([held.num_rows]))

    return rows.select("id", "copies", "label", "embedding", "dims", "code", "cut", "filters", "p", "q", "side").mapInArrow(emit, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, part_rows: int = PART_ROWS) -> DataFrame:
    """Links of every vector with those of its label at cosine >= ``least``: ``vec_id, n_links, component_id, kept``, a row each.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable by links, the own one
    included, and ``kept`` tells whether that is the own id. Cosines are in double precision, of components as the table has
    them; no link is below ``least``. Links are missed only where two vectors of ``FEW_DIMS`` dimensions or more share no filter.
    Rows with a null label, or whose vector is null, empty, zero
    or holds null or non-finite components, link with nothing; nor do vectors of different length. A null id has no links
    and null component. Rows that share an id are separate rows, each with the links and the component of its own vector, and
    linked only if their vectors are. An empty table gives an empty result; other columns are not read.
    """
    given = vectors.select(vector_col).schema[0].dataType
    kind = "float" if given == ArrayType(FloatType(), given.containsNull) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    good = usable("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    # Minus zero equals zero, and so do vectors that differ in it.
    clean = rows.withColumn("embedding", F.when(good, F.transform("embedding", lambda x: x + F.lit(0.0).cast(kind))))
    groups = clean.where("embedding is not null").groupBy("label", "embedding").agg(F.min("id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    # Different vectors may share an id, so a vector gets a number of its own, which is drawn once, as the table is stored.
    groups = materialize(_with_filters(groups.select(F.monotonically_increasing_id().alias("id"), "copies", "label", "embedding", F.size("embedding").alias("dims"), "vec_id"), kind))
    # A direction of the first half with more than part_rows vectors is cut into its filters, and a filter with more by a hash
    # of the id into parts, of which every two meet once.
    own = F.expr("slice(filters, first, last - first + 1)").alias("own")
    coded = groups.select("id", "label", "dims", "filters", F.inline("codes")).select("id", "label", "dims", "code", "last", own)
    wide = coded.groupBy("label", "dims", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows).drop("n")
    passed = coded.join(wide, ["label", "dims", "code"]).select("id", "label", "dims", "code", "last", F.explode("own").alias("cut"))
    large = passed.groupBy("label", "dims", "cut").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows)
    cut = F.struct("code", "cut", "last", F.coalesce(F.ceil(F.col("n") / part_rows), F.lit(1)).cast("int").alias("parts"))
    cuts = passed.join(large, ["label", "dims", "cut"], "left").groupBy("id").agg(F.collect_list(cut).alias("cuts"), F.collect_set("code").alias("wide"))
    whole = F.filter("codes", lambda c: ~F.coalesce(F.array_contains("wide", c["code"]), F.lit(False)))
    whole = F.transform(whole, lambda c: F.struct(c["code"].alias("code"), F.lit(-1).alias("cut"), c["last"].alias("last"), F.lit(1).alias("parts")))
    sized = groups.join(cuts, "id", "left").select("id", "copies", "label", "embedding", "dims", "filters", F.inline(F.concat(whole, F.coalesce("cuts", F.array()))))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(part, o).alias("p"), F.greatest(part, o).alias("q"), F.when(part == o, 0).when(part < o, 1).otherwise(2).alias("side")))
    # Whether a pair has met before is told by the filters up to the cell's own.
    dealt = sized.select("id", "copies", "label", "embedding", "dims", "code", "cut", F.expr("slice(filters, 1, last)").alias("filters"), F.inline(meets))
    keys = ["label", "dims", "code", "cut", "p", "q"]
    found = materialize(_compare(dealt.repartition(*keys).sortWithinPartitions(*keys, "id"), least).groupBy("id", "root").agg(F.sum("links").alias("links")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "id")
    members = groups.select("id", "vec_id").join(components, "id").select("id", "vec_id", "component")
    least_ids = members.groupBy("component").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("m"))
    named = join_hot(members, least_ids, ["component"], "m", groups.count()).select("id", F.col("least_id").alias("component"))
    of_group = groups.select("label", "embedding", "id", "vec_id", "copies").join(links, "id", "left").join(named, "id", "left")
    of_group = of_group.select("label", "embedding", "copies", F.coalesce("component", "vec_id").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # A vector that very many rows have is sent to them.
    out = join_hot(clean, of_group, ["label", "embedding"], "copies", clean.count(), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
