"""Repeated passages: words covered by windows whose word sequence occurs elsewhere too, by sharded compressed indexes.

A text's windows are dealt to shards by content: a window's anchor is the least hash among its 8-word grams, so windows
with equal words have equal anchors wherever they stand, and neighbouring windows mostly share theirs. A maximal run of
windows with one anchor is a segment. Only segments whose anchor occurs at two places or more can hold a repeated
window. Equal segments are reduced to one with a count. Each shard builds a compressed index of its segments and
streams them through backward search, which yields the windows that occur at least twice.

An anchor whose distinct segments have more words than a shard holds (a phrase common to many texts, with other
neighbours in each) is not indexed: its windows are dealt on by a fingerprint of all their words and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.cluster import materialize
from pathweave.llm.fm_index import DEPTH, FMIndex, repeated_windows
from pathweave.llm.words import _ODD, Words, grams, mix, texts

#: Words of a gram that can be an anchor.
GRAM = 8
#: Words of segments from which an index is closed, and that one anchor's segments in it have at most.
SHARD_WORDS = 1 << 20
#: Windows of a segment that are searched as one query.
LANE_WINDOWS = 128


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    extra = width - size
    return np.minimum(out[: len(out) - extra], out[extra:]) if extra else out


def segments(w: Words, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts: first word, number of windows, anchor, text (by position), and whether the anchor occurs in it more than once."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none.astype(np.uint64), none, none.astype(bool)
    gram = grams(words, GRAM)
    width = window - GRAM + 1
    anchor = _sliding_min(gram, width)
    doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    valid = doc[: len(anchor)] == doc[window - 1 :]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1])
    begin = np.flatnonzero(valid & fresh)
    # A segment ends before the next window that is fresh or not valid.
    stop = np.flatnonzero(np.concatenate([fresh | ~valid, [True]]))
    end = stop[np.searchsorted(stop, begin, side="right")]
    count = end - begin
    places = count + width - 1
    offset = np.cumsum(places) - places
    index = np.arange(int(places.sum())) - np.repeat(offset - begin, places)
    hits = np.add.reduceat((gram[index] == np.repeat(anchor[begin], places)).astype(np.int64), offset) if len(begin) else none
    return begin, count, anchor[begin], doc[begin], hits > 1


def _prints(words: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each run of words; equal runs have equal ones wherever they stand."""
    n = len(words)
    base = int(_ODD[0])
    power = np.full(n + 1, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(n + 1, pow(base, -1, 2**64), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)])
    return mix((total[begin + length] - total[begin]) * inverse[begin] + length.astype(np.uint64))


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Anchors that occur at two places or more: (``anchor``)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, weights = [], []
            for _, _, w in texts(batch.column(0)):
                _, _, anchor, _, many = segments(w, w.hashes(), window)
                keys.append(anchor)
                weights.append(1 + many)
            if keys:
                key, where = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.bincount(where, np.concatenate(weights), minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.minimum(total, 2).astype(np.int8))], ["anchor", "n"])

    return docs.select("text").mapInArrow(emit, "anchor long, n byte").groupBy("anchor").agg(F.sum("n").alias("n")).where("n >= 2").select("anchor")


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """All segments: row key, first word, number of windows, anchor, fingerprint, and whether the anchor repeats in it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, k = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, b, w in texts(batch.column(2)):
                words = w.hashes()
                begin, count, anchor, doc, _ = segments(w, words, window)
                if len(begin):
                    prints = _prints(words, begin, count + window - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d[a:b][doc]), pa.array(k[a:b][doc]), pa.array((begin - w.bounds[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(prints.view(np.int64))],
                        ["d", "k", "start", "n", "anchor", "print"],
                    )

    return docs.select("d", "k", "text").mapInArrow(emit, "d long, k long, start int, n int, anchor long, print long")


def _cut(wanted: DataFrame, window: int) -> DataFrame:
    """Words of wanted segments: joins each text's list of (start, n, anchor, print, copies) and emits the segments' words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for a, b, w in texts(batch.column(0)):
                anchors, prints, copies, pieces = [], [], [], []
                for i, row in zip(range(b - a), lists.slice(a, b - a).to_pylist()):
                    for s in row:
                        lo = w.bounds[i] + s["start"]
                        hi = lo + s["n"] + window - 1
                        anchors.append(s["anchor"])
                        prints.append(s["print"])
                        copies.append(s["copies"])
                        pieces.append(w.data[w.starts[lo] : w.ends[hi - 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(prints, pa.int64()), pa.array(copies, pa.int64()), pa.array(pieces, pa.binary()).cast(pa.string())], ["anchor", "print", "copies", "words"])

    return wanted.mapInArrow(emit, "anchor long, print long, copies long, words string")


def _search(parts: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Repeated windows of every segment: (``anchor``, ``print``, ``runs``), runs as begin and end window in turn."""

    def shard(anchors: list, prints: list, copies: list, pieces: list) -> pa.RecordBatch:
        w_hash, bounds = [], [0]
        for _, _, w in texts(pa.array(pieces, pa.string())):
            words = w.hashes()
            w_hash.append(words)
            bounds.extend((bounds[-1] + w.bounds[1:]).tolist())
        words, bounds = np.concatenate(w_hash), np.asarray(bounds)
        length = np.diff(bounds)
        _, number = np.unique(words, return_inverse=True)
        # Each sequence is followed by a 0.
        text = np.zeros(len(words) + len(length), np.int64)
        place = np.arange(len(words)) + np.repeat(np.arange(len(length)), length)
        text[place] = number + 1
        start = bounds[:-1] + np.arange(len(length))
        count = length - window + 1
        alone = np.asarray(copies) == 1
        runs: list[list[int]] = [[] if one else [0, int(n)] for one, n in zip(alone, count)]
        asked = np.flatnonzero(alone)
        if len(asked):
            lanes = -(-count[asked] // LANE_WINDOWS)
            owner = np.repeat(asked, lanes)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            lane_start = start[owner] + nth * LANE_WINDOWS
            lane_count = np.minimum(LANE_WINDOWS, count[owner] - nth * LANE_WINDOWS)
            flags = repeated_windows(FMIndex(text, max(window, DEPTH)), text, lane_start, lane_count, window)
            edges = np.cumsum(count[asked])
            for i, part in zip(asked, np.split(flags, edges[:-1])):
                if part.any():
                    change = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
                    runs[i] = change.tolist()
        hit = [i for i, r in enumerate(runs) if r]
        return pa.RecordBatch.from_arrays(
            [pa.array([anchors[i] for i in hit], pa.int64()), pa.array([prints[i] for i in hit], pa.int64()), pa.array([runs[i] for i in hit], pa.list_(pa.int32()))], ["anchor", "print", "runs"]
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held[0] and row[0] == held[0][-1] and row[1] == held[1][-1]:
                    continue  # the same segment of a repeated row
                if size >= shard_words and row[0] != held[0][-1]:
                    yield shard(*held)
                    held, size = ([], [], [], []), 0
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[3]) // 6 + 1
        if held[0]:
            yield shard(*held)

    return parts.mapInArrow(emit, "anchor long, print long, runs array<int>")


def _heavy(found: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Anchors whose distinct segments have more words than a shard holds: (``anchor``)."""
    once = found.groupBy("anchor", "print").agg((F.min("n") + window - 1).alias("words"))
    return once.groupBy("anchor").agg(F.sum("words").alias("words")).where(F.col("words") > shard_words).select("anchor")


def _counted(parts: DataFrame, distinct: DataFrame, window: int) -> DataFrame:
    """As ``_search``, by counts of the windows' fingerprints inside each anchor, whatever the number of segments."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in texts(batch.column(3)):
                words = w.hashes()
                count = np.diff(w.bounds) - window + 1
                at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                prints = _prints(words, np.repeat(w.bounds[:-1], count) + at, np.full(len(at), window))
                piece = pa.array(np.repeat(np.arange(a, b), count))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(piece) for c in range(3)), pa.array(at.astype(np.int32)), pa.array(prints.view(np.int64))], ["anchor", "print", "copies", "at", "f"]
                )

    # A piece that comes twice, from a repeated row, has more than one copy; it adds to counts of windows that occur twice anyway.
    windows = parts.mapInArrow(emit, "anchor long, print long, copies long, at int, f long")
    twice = windows.groupBy("anchor", "f").agg(F.count(F.lit(1)).alias("m")).where("m >= 2").select("anchor", "f")
    hits = windows.where("copies = 1").join(twice, ["anchor", "f"]).groupBy("anchor", "print").agg(F.collect_list("at").alias("at"))
    runs = hits.select("anchor", "print", F.flatten(F.transform("at", lambda x: F.array(x, x + 1))).alias("runs"))
    return runs.unionByName(distinct.where("copies > 1").select("anchor", "print", F.array(F.lit(0), F.col("at.n")).alias("runs")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Texts without repeated passages: ``doc_id, n_words, n_removed, kept_sha256, kept_text``, one row per input row.

    A window is ``window`` consecutive words (runs of other than space and \\x09-\\x0D, unchanged) of one text. Each word in
    a window whose words also stand anywhere else, in the same text included, is removed; all windows are judged on the
    input. ``kept_text`` joins the other words by one space and ``kept_sha256`` is its SHA-256 in lowercase hex. Null and
    empty texts have no words. Texts shorter than a window lose nothing. Repeated rows repeat each other's windows, so
    both lose them. An empty table gives an empty result; other columns are not read.
    """
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} words at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    keyed = source.select("doc_id", F.xxhash64("doc_id").alias("d"), F.xxhash64("text", F.length("text")).alias("k"), "text")
    found = materialize(_occurrences(keyed, window).join(_anchors(source, window), "anchor"))
    distinct = found.groupBy("anchor", "print").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("d", "k", "start", "n")).alias("at"))
    lists = distinct.groupBy("at.d", "at.k").agg(F.collect_list(F.struct(F.col("at.start").alias("start"), F.col("at.n").alias("n"), "anchor", "print", "copies")).alias("list"))
    pieces = _cut(keyed.join(lists, ["d", "k"]).select("text", "list"), window)
    heavy = materialize(_heavy(found, window, shard_words))
    counted = None
    if not heavy.isEmpty():
        pieces = materialize(pieces)
        counted = _counted(pieces.join(heavy, "anchor", "left_semi").select(pieces.columns), distinct.join(heavy, "anchor", "left_semi"), window)
        pieces = pieces.join(heavy, "anchor", "left_anti")
    searched = _search(pieces.select("anchor", "print", "copies", "words").repartition("anchor").sortWithinPartitions("anchor", "print"), window, shard_words)
    verdicts = materialize(searched if counted is None else searched.unionByName(counted))
    spans = found.join(verdicts, ["anchor", "print"]).select("d", "k", F.transform("runs", lambda r, i: r + F.col("start") + F.when(i % 2 == 1, window - 1).otherwise(0)).alias("spans"))
    spans = spans.groupBy("d", "k").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in texts(batch.column(1)):
                cover = np.zeros(len(w.starts) + 1, np.int32)
                part = batch.column(2).slice(a, b - a)
                for i, flat in enumerate(part):
                    if flat.is_valid:
                        ends = np.asarray(flat.values) + w.bounds[i]
                        np.add.at(cover, ends[0::2], 1)
                        np.add.at(cover, ends[1::2], -1)
                kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                size = (w.ends - w.starts)[kept] + 1
                to = np.cumsum(size)
                data = np.append(w.data, np.uint8(32))
                source_at = np.arange(int(size.sum())) + np.repeat(w.starts[kept] - (to - size), size)
                joined = data[source_at]
                joined[to - 1] = 32
                edge = np.searchsorted(kept, w.bounds)
                cut = np.concatenate([[0], to])[edge]
                out = [joined[lo : max(lo, hi - 1)].tobytes() for lo, hi in zip(cut[:-1], cut[1:])]
                n_words = np.diff(w.bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(edge), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in out]), pa.array(out, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    joined = keyed.join(spans, ["d", "k"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
