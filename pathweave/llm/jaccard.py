"""Jaccard join of shingle sets by token-combination prefixes, and the classes of near duplicates that its links make.

A text's set holds its distinct word shingles. Two sets link when 100 * intersection >= percent * union. Tokens
(shingles) have one global order: rare ones first, then by hash. Sets that link share all but a few tokens, so
prefixes of each, in that order, must meet: in one rare token, or in a combination of k frequent tokens, where the prefix
is extended until no permitted number of differing tokens can prevent it. Rare tokens are indexed alone, frequent ones
by combinations within small hash groups. Candidates pass a histogram bound and are then verified on whole texts.

Frequencies come from all documents: hashed counters of fixed size, so that what is broadcast is a bitmap of fixed size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.cluster import connected_components, discard, join_hot, materialize, sorted_groups
from pathweave.llm.words import grams, mix, shingle_set, texts, whole

#: Hashed counters of token frequencies; a bit of the broadcast bitmap for each.
COUNTERS = 1 << 24
_RANGE = 1 << 16
#: The histogram that bounds how far two sets differ has a cell for so many tokens, and no fewer or more cells than these.
CELL_TOKENS = 8
CELLS = (64, 1 << 16)
#: A token is frequent from this many occurrences, and from this many times the mean counter.
FREQUENT = 96
FREQUENT_MEANS = 6
#: A frequent token of class k is indexed in combinations of k tokens; the last class starts at that many times the first's bound.
CLASS_SIZES = (2, 3)
CLASS_STEP = 32
#: Members of an index entry that one task compares with each other by histograms.
PART_ROWS = 2048
#: Members of a cluster, and tokens of their sets, that one task compares with each other in full.
CLUSTER_ROWS = 1024
PART_TOKENS = 1 << 22


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64)


def frequent_tokens(docs: DataFrame, shingle: int) -> tuple[bytes, bytes]:
    """Two bitmaps over ``COUNTERS`` hashed counters: the tokens of the first frequent class or above, and of the last.

    Every task counts all its documents in one array and sends it by ranges, compressed; ranges are summed by key.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        some = False
        for batch in batches:
            for _, _, w in texts(batch.column(0)):
                words = w.hashes(lower=True)
                size = np.diff(w.bounds)
                text = np.repeat(np.arange(len(size)), size)
                tokens = grams(words, shingle)
                tokens = tokens[text[: len(tokens)] == text[shingle - 1 :][: len(tokens)]]
                short = [whole(words[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:]) if 0 < b - a < shingle]
                tokens = np.concatenate([tokens, np.array(short, np.uint64)])
                if len(tokens):
                    some = True
                    np.add.at(total, _counter(tokens), np.uint32(1))
        if some:
            part = total.reshape(-1, _RANGE)
            for i in range(len(part)):
                packed = zlib.compress(part[i].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
                sums[part] = sums[part] + counts if part in sums else counts.astype(np.int64)
        for part, counts in sums.items():
            high = np.flatnonzero(counts >= FREQUENT)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([int(counts.sum())], pa.int64()), pa.array([high.astype(np.uint16).tobytes()], pa.binary()), pa.array([counts[high].tobytes()], pa.binary())],
                ["part", "total", "cells", "counts"],
            )

    parts = docs.mapInArrow(count, "part int, counts binary")
    summed = parts.repartition(F.col("part")).mapInArrow(add, "part int, total long, cells binary, counts binary")
    first, last = np.zeros(COUNTERS, bool), np.zeros(COUNTERS, bool)
    rows = summed.collect()  # at most COUNTERS cells in all, whatever the input
    bound = max(FREQUENT, FREQUENT_MEANS * sum(r.total for r in rows) // COUNTERS)
    for r in rows:
        cells = np.frombuffer(r.cells, np.uint16).astype(np.int64) + r.part * _RANGE
        counts = np.frombuffer(r.counts, np.int64)
        first[cells[counts >= bound]] = True
        last[cells[counts >= bound * CLASS_STEP]] = True
    return np.packbits(first).tobytes(), np.packbits(last).tobytes()


class Scheme:
    """Which signatures a set has, for one shingle length and one threshold in percent."""

    def __init__(self, percent: int, first: np.ndarray, last: np.ndarray):
        self.percent = percent
        self.first, self.last = first, last
        self.base = math.log(100 / percent) * 1.001

    def errors(self, n: int) -> int:
        """Tokens of a set of size n that a linking set may lack: both share at least percent of the larger one."""
        return n - -(-self.percent * n // 100)

    def size_class(self, n: int) -> int:
        """Sets that link are in the same class or in adjacent ones."""
        return int(math.log(n) / self.base)

    def groups(self, size_class: int) -> int:
        """Hash groups of a size class, so that a group holds about eight prefix tokens at most."""
        return max(1, self.errors(int(math.exp(size_class * self.base))) // 8)

    def signatures(self, tokens: np.ndarray) -> list[np.ndarray]:
        """Signatures of a set given as sorted distinct hashes. Empty where only an equal set can link."""
        n = len(tokens)
        errors = self.errors(n)
        if errors == 0 and 100 * n < self.percent * (n + 1):
            return []  # neither a smaller set nor one with one more token reaches the threshold
        cell = _counter(tokens)
        frequent = self.first[cell]
        rare = tokens[~frequent]
        if len(rare) > errors:
            return [rare[: errors + 1]]
        out = [rare]
        common = tokens[frequent]
        top = self.last[cell[frequent]]
        own = self.size_class(n)
        for scheme in (own, own + 1):
            out.extend(self._combined(rare, common, top, errors, scheme))
        return out

    def _combined(self, rare: np.ndarray, common: np.ndarray, top: np.ndarray, errors: int, scheme: int) -> list[np.ndarray]:
        groups = np.uint64(self.groups(scheme))
        ordered = np.concatenate([common[~top], common[top]])
        size = np.concatenate([np.full((~top).sum(), CLASS_SIZES[0]), np.full(top.sum(), CLASS_SIZES[1])])
        key = (mix(ordered) % groups).astype(np.int64) * len(CLASS_SIZES) + (size == CLASS_SIZES[1])
        members: dict[int, list[int]] = {}
        sure = len(rare)  # errors that the prefix bears before its last signature is lost, plus one
        for token, group, k in zip(ordered.tolist(), key.tolist(), size.tolist()):
            held = members.setdefault(group, [])
            held.append(token)
            sure += len(held) >= k
            if sure > errors:
                break
        else:
            raise ValueError("the threshold is too low for combinations: prefixes can't be long enough")
        out = []
        for group, held in members.items():
            k = CLASS_SIZES[group % len(CLASS_SIZES)]
            if len(held) >= k:
                pick = np.array(list(combinations(held, k)), np.uint64)
                total = np.full(len(pick), (scheme * 64 + k) * 0x2545F4914F6CDD1D % 2**64, np.uint64)
                for j in range(k):
                    total = mix(total + pick[:, j])
                out.append(total)
        return out


def histogram(tokens: np.ndarray) -> np.ndarray:
    """Tokens by their low bits, up to 255 a cell; the number of cells is a power of two that grows with the set."""
    size = min(CELLS[1], max(CELLS[0], 1 << (len(tokens) // CELL_TOKENS).bit_length()))
    return np.minimum(np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def folded(cells: np.ndarray, size: int) -> np.ndarray:
    """Histograms (in the last dimension) as they are with ``size`` cells."""
    out = cells.astype(np.int16)
    while out.shape[-1] > size:
        half = out.shape[-1] // 2
        out = np.minimum(out[..., :half] + out[..., half:], 255)
    return out


def _set_rows(docs: DataFrame, shingle: int, percent: int, maps: tuple[bytes, bytes]) -> DataFrame:
    """Per row: id, set size, a 128-bit fingerprint of the set, the histogram, and the signatures."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)  # two bitmaps of COUNTERS bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent, *(np.unpackbits(np.frombuffer(m, np.uint8)).astype(bool) for m in shared.value))
        for batch in batches:
            ids = batch.column(0)
            for a, b, w in texts(batch.column(1)):
                words = w.hashes(lower=True)
                size, f1, f2, cells, signatures = [], [], [], [], []
                for i in range(b - a):
                    tokens = shingle_set(words[w.bounds[i] : w.bounds[i + 1]], shingle)
                    size.append(len(tokens))
                    f1.append(int(mix(tokens).sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(np.bitwise_xor.reduce(mix(tokens + np.uint64(77))).view(np.int64)) if len(tokens) else 0)
                    cells.append(histogram(tokens).tobytes())
                    found = scheme.signatures(tokens) if len(tokens) else []
                    signatures.append(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in signatures])])
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(cells, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(signatures)))],
                    ["id", "n", "f1", "f2", "cells", "signatures"],
                )

    return docs.mapInArrow(rows, "id long, n long, f1 long, f2 long, cells binary, signatures array<long>")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and histograms don't rule a link out. The histograms' distance is at most that of the sets."""
    info = sets.select("id", "n", "cells")
    both = pairs.join(info.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca")), "a").where("na > 0")
    both = both.join(info.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb")), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def apart_of(x: bytes, y: bytes) -> int:
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            size = min(len(x), len(y))
            return int(np.abs(folded(x, size) - folded(y, size)).sum(dtype=np.int64))

        for batch in batches:
            n = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            apart = np.array([apart_of(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            # 100 * I >= p * U with I = (n - apart) / 2 and U = (n + apart) / 2
            keep = pa.array(100 * (n - apart) >= percent * (n + apart))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(bound, "a long, b long")


def _dealt(frame: DataFrame, group: str, part_rows: int, weight: str | None = None, part_weight: int = 1) -> DataFrame:
    """Rows (``group``, ``id``, ``k``, ...) dealt to cells (``group``, ``p``, ``q``) with a ``side``, so that all members of different classes ``k`` meet.

    A group of more than ``part_rows`` members, or of more ``weight`` than ``part_weight``, is cut by a hash of the id into parts, and
    every two parts meet in a cell of their own; parts of the group's largest class don't meet each other, as they need not.
    """
    heavy = F.sum(weight) / part_weight if weight else F.lit(0.0)
    classes = frame.groupBy(group, "k").agg(F.greatest(F.count(F.lit(1)) / part_rows, heavy).alias("x"))
    total = classes.groupBy(group).agg(F.sum("x").alias("x"), F.max("x").alias("top"), F.max_by("k", "x").alias("big")).where("x > 1")
    cut = total.select(group, "big", F.ceil("top").cast("int").alias("pb"), F.greatest(F.lit(1), F.ceil(F.col("x") - F.col("top"))).cast("int").alias("po"))
    placed = frame.join(cut, group, "left").withColumn("pb", F.coalesce("pb", F.lit(0))).withColumn("po", F.coalesce("po", F.lit(1)))
    deal = F.xxhash64("id", F.lit(23))
    own = F.when(F.col("k") == F.col("big"), F.pmod(deal, F.col("pb"))).otherwise(F.col("pb") + F.pmod(deal, F.col("po"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("pb") + F.col("po") - 1), lambda o: (F.col("own") >= F.col("pb")) | (o >= F.col("pb")))
    own_col = F.col("own")
    meets = F.transform(others, lambda o: F.struct(F.least(own_col, o).alias("p"), F.greatest(own_col, o).alias("q"), F.when(own_col == o, 0).when(own_col < o, 1).otherwise(2).alias("side")))
    return placed.withColumn("own", own).select(*frame.columns, F.inline(meets))


def _joined_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unites the labels of rows x and y in place; returns those of the pairs that did so, a spanning forest."""
    edges_x, edges_y = [], []
    for i, j in zip(x.tolist(), y.tolist()):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        while label[j] != j:
            label[j] = label[label[j]]
            j = label[j]
        if i != j:
            label[max(i, j)] = min(i, j)
            edges_x.append(i)
            edges_y.append(j)
    return np.array(edges_x, np.int64), np.array(edges_y, np.int64)


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return up
        label = up


def _candidates(entries: DataFrame, sets: DataFrame, percent: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Edges (``src``, ``dst``) that connect all members of an entry whose sizes and histograms don't rule a link out.

    Members of different classes are compared in blocks inside tasks. Each block sends a spanning forest of what passes, so
    at most one edge a member, and compares no two members that it has connected already.
    """

    class Histograms:
        """Histograms of rows; two rows are compared with as many cells as both have."""

        def __init__(self, cells: list[bytes]):
            self.size = np.array([len(c) for c in cells])
            self.cells = cells
            self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def table(self, size: int) -> tuple[np.ndarray, np.ndarray]:
            if size not in self.tables:
                place = np.full(len(self.cells), -1)
                parts, at = [], 0
                for wide in np.unique(self.size[self.size >= size]).tolist():
                    rows = np.flatnonzero(self.size == wide)
                    place[rows] = at + np.arange(len(rows))
                    at += len(rows)
                    parts.append(folded(np.frombuffer(b"".join(self.cells[i] for i in rows), np.uint8).reshape(len(rows), wide), size))
                self.tables[size] = place, np.concatenate(parts)
            return self.tables[size]

        def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x), np.int64)
            size = np.minimum(self.size[x], self.size[y])
            for s in np.unique(size).tolist():
                place, table = self.table(s)
                which = np.flatnonzero(size == s)
                step = max(64, (1 << 21) // s)
                for at in range(0, len(which), step):
                    w = which[at : at + step]
                    out[w] = np.abs(table[place[x[w]]] - table[place[y[w]]]).sum(axis=1, dtype=np.int64)
            return out

    def passing(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: np.ndarray, n: np.ndarray, cells: Histograms) -> tuple[np.ndarray, np.ndarray]:
        keep = (k[x] != k[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (ids[x] != ids[y])
        x, y = x[keep], y[keep]
        apart = cells.apart(x, y)
        near = 100 * (n[x] + n[y] - apart) >= percent * (n[x] + n[y] + apart)
        return x[near], y[near]

    def compared(batch: pa.RecordBatch, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, k, n, side = (np.asarray(batch.column(c)) for c in ("id", "k", "n", "side"))
        cells = Histograms(batch.column("cells").to_pylist())
        size = np.diff(bounds)
        small = size <= 32
        begin, length = bounds[:-1][small], size[small]
        end = np.repeat(begin + length, length)
        row = np.arange(len(end)) + np.repeat(begin - (np.cumsum(length) - length), length)
        label = np.arange(len(ids))
        for step in range(1, int(length.max(initial=0))):
            x = row[row + step < end]
            met = (side[x] == 0) | (side[x] != side[x + step])
            x, y = passing(x[met], x[met] + step, ids, k, n, cells)
            yield tuple(ids[e] for e in _joined_labels(label, x, y))
        for a, b in zip(bounds[:-1][~small].tolist(), bounds[1:][~small].tolist()):
            rows = np.arange(a, b)
            left, right = (rows[side[a:b] == 1], rows[side[a:b] == 2]) if side[a] else (rows, rows)
            for at in range(0, len(left), 64):
                label[a:b] = _roots(label[a:b] - a) + a
                i, j = np.meshgrid(left[at : at + 64], right, indexing="ij")
                i, j = i.ravel(), j.ravel()
                new = label[i] != label[j] if side[a] else (i < j) & (label[i] != label[j])
                x, y = passing(i[new], j[new], ids, k, n, cells)
                yield tuple(ids[e] for e in _joined_labels(label, x, y))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in sorted_groups(batches, ["s", "p", "q"]):
            edges = [np.stack([np.maximum(x, y), np.minimum(x, y)]) for x, y in compared(batch, bounds)]
            both = np.concatenate([np.zeros((2, 0), np.int64), *edges], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["src", "dst"])

    dealt = _dealt(entries.select("s", "id", "k"), "s", part_rows).join(sets.select("id", "n", "cells"), "id")
    keys = ["s", "p", "q"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(emit, "src long, dst long").distinct()


def block_links(tokens: list[np.ndarray], k: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between members of different classes, each found on the whole sets ``tokens``.

    Members of side 1 meet those of side 2, or all each other where the side is 0. Connected members are not compared again.
    """
    n = np.array([len(t) for t in tokens])
    _, code = np.unique(np.concatenate(tokens), return_inverse=True)
    start = np.cumsum(n) - n
    mark = np.zeros(int(code.max()) + 1, np.uint8)
    label = np.arange(len(n))
    out_x, out_y = [], []
    place = np.arange(len(n))
    for i in range(len(n)):
        if side[i] == 2:
            continue
        meets = place[i + 1 :] if side[i] == 0 else place[side == 2]
        label = _roots(label)
        meets = meets[(k[meets] != k[i]) & (label[meets] != label[i]) & (100 * np.minimum(n[meets], n[i]) >= percent * np.maximum(n[meets], n[i]))]
        if not len(meets):
            continue
        own = code[start[i] : start[i] + n[i]]
        mark[own] = 1
        if 4 * len(meets) > len(n):
            both = np.add.reduceat(mark[code], start, dtype=np.int64)[meets]
        else:
            at = np.arange(int(n[meets].sum())) + np.repeat(start[meets] - (np.cumsum(n[meets]) - n[meets]), n[meets])
            both = np.add.reduceat(mark[code[at]], np.cumsum(n[meets]) - n[meets], dtype=np.int64)
        mark[own] = 0
        linked = meets[100 * both >= percent * (n[i] + n[meets] - both)]
        x, y = _joined_labels(label, np.full(len(linked), i), linked)
        out_x.append(x)
        out_y.append(y)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_x]), np.concatenate([none, *out_y])


def _cluster_links(clusters: DataFrame, docs: DataFrame, shingle: int, percent: int, part_rows: int = CLUSTER_ROWS) -> DataFrame:
    """Links (``src``, ``dst``) that connect all members of a cluster (``g``, ``id``, ``k``, ``n``) that links connect, judged on the sets of whole texts.

    A set is sent once, or once a part that it meets where the cluster is large.
    """
    cells = _dealt(clusters, "g", part_rows, "n", PART_TOKENS)
    asked = cells.groupBy("id").agg(F.collect_list(F.struct("g", "p", "q", "side", "k")).alias("cells"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "p", "q", "side", "k"]
        for batch in batches:
            lists = batch.column(1)
            for a, b, w in texts(batch.column(2)):
                words = w.hashes(lower=True)
                sets = [shingle_set(words[lo:hi], shingle).tobytes() for lo, hi in zip(w.bounds[:-1], w.bounds[1:])]
                part = lists.slice(a, b - a)
                own = part.flatten()
                row = pa.array(np.repeat(np.arange(b - a), np.asarray(part.value_lengths())))
                yield pa.RecordBatch.from_arrays([*(own.field(x) for x in names), batch.column(0).slice(a, b - a).take(row), pa.array(sets, pa.binary()).take(row)], [*names, "id", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in sorted_groups(batches, ["g", "p", "q"]):
            ids, k, side = (np.asarray(batch.column(c)) for c in ("id", "k", "side"))
            tokens = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
            src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a > 1:
                    x, y = block_links(tokens[a:b], k[a:b], side[a:b], percent)
                    src.append(ids[a + x])
                    dst.append(ids[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    keys = ["g", "p", "q"]
    shipped = docs.join(asked, "id").select("id", "cells", "text").mapInArrow(cut, "g long, p int, q int, side int, k long, id long, tokens binary")
    return shipped.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(compare, "src long, dst long")


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link, judged on the sets of the whole texts of both."""
    # Both joins read the same table by the same key, so its texts are shuffled once.
    one = pairs.join(docs, F.col("b") == F.col("id")).select("a", "b", F.col("text").alias("tb"))
    two = one.join(docs, F.col("a") == F.col("id")).select("a", "b", F.col("text").alias("ta"), "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column: pa.Array) -> Iterator[np.ndarray]:
            for _, _, w in texts(column):
                words = w.hashes(lower=True)
                for a, b in zip(w.bounds[:-1], w.bounds[1:]):
                    yield shingle_set(words[a:b], shingle)

        for batch in batches:
            keep = []
            for x, y in zip(sets(batch.column(2)), sets(batch.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return two.mapInArrow(verify, "a long, b long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Class of every document: ``doc_id, n_shingles, component_id``, one row per input row.

    Words are runs of other than space and \\x09-\\x0D, with A-Z lower-cased; a set holds the distinct ``shingle``-word
    shingles, or the whole sequence where that is shorter. Documents link when 100 * intersection >= ``percent`` * union;
    ``component_id`` is the smallest id reachable by links, the document's own included. Texts that are null, empty or
    without words have size 0 and link with nothing. Rows with a null id link with nothing and have a null class. Each
    repeated row is treated by its own text; rows that share an id with different texts are separate sets under one id.
    An empty table gives an empty result; other columns are not read.

    Equal sets are first reduced to the one with the smallest id. Each set is compared with at most two leaders of the index
    entries that it is in, so a large group of copies of one text takes about as many comparisons as it has members. Members
    of an entry that are in different classes after that are compared by histograms, and what passes makes clusters, in which
    whole sets are compared. Every step sends spanning edges, at most one a member, never pairs.

    Thresholds so low that prefixes can't hold enough combinations (below about 70 percent) raise a ValueError where a set
    needs them. Tokens are 64-bit hashes: among n different ones about n * n / 2**65 pairs are taken for equal, and a link is
    wrong only if several tokens of the same two sets are.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    maps = frequent_tokens(source.select("text"), shingle)
    rows = materialize(_set_rows(source, shingle, percent, maps))
    same = rows.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("copies"))
    leaders = materialize(same)
    unique = rows.where("n > 0").join(leaders.select("n", "f1", "f2", F.col("leader").alias("id")), ["id", "n", "f1", "f2"]).dropDuplicates(["id", "n", "f1", "f2"])
    sets = materialize(unique.select("id", "n", "cells", "signatures"))
    # Entries with the same members are one.
    step = math.log(100 / percent) * 1.001
    every = sets.select("id", F.explode("signatures").alias("s"))
    members = every.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x")).where("m > 1")
    entries = materialize(members.groupBy("m", "h", "x").agg(F.min("s").alias("s")).select("s"))
    sized = sets.select("id", F.floor(F.log("n") / step).cast("int").alias("c"), F.explode("signatures").alias("s"))
    postings = materialize(sized.join(entries, "s").select("s", "c", "id"))
    # Each set is first compared with two entry leaders at most: the smallest, and the one it shares most entries with.
    stars = materialize(postings.groupBy("s", "c").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("s", "c", "a"))
    shared = postings.join(stars, ["s", "c"]).where("id > a").groupBy("a", F.col("id").alias("b")).count()
    chosen = shared.groupBy("b").agg(F.min("a").alias("first"), F.max(F.struct("count", (-F.col("a")).alias("minus"))).alias("most"))
    chosen = chosen.select("b", F.explode(F.array_distinct(F.array("first", -F.col("most.minus")))).alias("a"))
    tried = materialize(_near(chosen.select("a", "b"), sets, percent))
    links = materialize(_verified(tried, source, shingle, percent).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    classes = connected_components(links)

    # What is left: entries with members in different classes. What may link there makes clusters, whose sets are compared in full.
    placed = postings.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("k", F.coalesce("component", "id")).select("s", "id", "k")
    placed = materialize(placed)
    split = placed.groupBy("s").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("s")
    edges = materialize(_candidates(placed.join(split, "s"), sets, percent))
    found = connected_components(edges).withColumnRenamed("node", "id")
    clusters = found.join(classes.select(F.col("node").alias("id"), F.col("component").alias("k")), "id", "left").join(sets.select("id", "n"), "id")
    clusters = materialize(clusters.select(F.col("component").alias("g"), "id", F.coalesce("k", "id").alias("k"), "n"))
    extra = materialize(_cluster_links(clusters, source, shingle, percent))
    final = connected_components(links.unionByName(extra))

    of_set = leaders.join(final.withColumnRenamed("node", "leader"), "leader", "left").select("n", "f1", "f2", "copies", F.coalesce("component", "leader").alias("component"))
    of_set = materialize(of_set)
    slim = materialize(rows.select("id", "n", "f1", "f2"))
    out = join_hot(slim, of_set, ["n", "f1", "f2"], "copies", slim.count(), "left")
    for table in (rows, leaders, sets, entries, postings, stars, tried, links, classes, placed, edges, found, clusters, extra, final):
        discard(table)
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))
