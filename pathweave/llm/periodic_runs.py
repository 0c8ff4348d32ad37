"""Periodic runs: maximal stretches of a text whose words repeat with a period, by seed and extend along diagonals.

A run with period q and length L makes the words of a stretch of L - q places equal to those q further: a diagonal at lag q.
Lags are handled in classes. In each the k words that every permitted run of the class has on its diagonal, and which are
no fewer than its greatest lag, are the seeds: equal k-grams of one text. As k is at least the lag, two equal k-grams of a run
have no third one between them unless the period is smaller, so only neighbouring occurrences have to be paired: at most one
pair a place and class, never all pairs. k-grams are ranked exactly by doubling (a gram's rank comes from the ranks of its
halves), and places whose gram comes once drop out for all longer ones. A pair is extended to both sides to the ends of its
diagonal; a table of the furthest place covered at each lag spares every further pair on it. All is done inside
the text, so rows are handled one by one and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.words import _ODD, mix, texts

#: A run has at least this many words, and this many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3


def lag_classes(longest: int, least_words: int, least_periods: int) -> Iterator[tuple[int, int, int]]:
    """Classes of lags (first, last, words of a seed), up to those of runs of ``longest`` words. ``least_periods`` is 2 or more."""

    def overlap(q: int) -> int:
        return max(least_words, least_periods * q) - q

    lag = 1
    # The overlap falls up to the lag where both bounds on length are equal, and rises from there.
    turn = [q for q in (least_words // least_periods, least_words // least_periods + 1) if q > 0]
    while max(least_words, least_periods * lag) <= longest:
        seed = min([overlap(lag), *[overlap(q) for q in turn if q >= lag]])
        yield lag, seed, seed
        lag = seed + 1


def _repeated_ranks(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Ranks of ``n`` places: equal for equal keys; -1 where a place isn't in ``at`` or its key comes once."""
    rank = np.full(n, -1, np.int64)
    if len(at):
        _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
        again = count[where] > 1
        rank[at[again]] = where[again]
    return rank


def _pair(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of the joined grams, the second of which begins ``shift`` places after the first."""
    n = len(first)
    at = np.flatnonzero((first[: n - shift] >= 0) & (second[shift:] >= 0)) if shift < n else np.zeros(0, np.int64)
    return _repeated_ranks(first[at] * n + second[at + shift], at, n)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the start are equal; looks at blocks of doubling size."""
    at, size, end = 0, 64, min(len(a), len(b))
    while at < end:
        differ = np.flatnonzero(a[at : at + size] != b[at : at + size])
        if len(differ):
            return at + int(differ[0])
        at += size
        size *= 2
    return end


def maximal_runs(words: np.ndarray, longest: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All maximal runs of a sequence of word keys, as (start, length, smallest period), sorted by start, then period.

    Texts may stand behind each other if their keys differ; ``longest`` is then the number of words of the longest one.
    """
    n = len(words)
    runs: list[tuple[int, int, int]] = []
    power = {1: _repeated_ranks(words, np.arange(n), n)}
    size = 1
    for low, high, seed in lag_classes(longest, least_words, least_periods):
        while size * 2 <= seed:
            power[size * 2] = _pair(power[size], power[size], size)
            size *= 2
        rank = power[size] if size == seed else _pair(power[size], power[size], seed - size)
        at = np.flatnonzero(rank >= 0)
        if not len(at):
            break  # no longer gram repeats either
        order = at[np.argsort(rank[at], kind="stable")]
        lag = np.diff(order)
        good = (rank[order[1:]] == rank[order[:-1]]) & (lag >= low) & (lag <= high)
        begin, lag = order[:-1][good], lag[good]
        sort = np.argsort(begin, kind="stable")
        begin, lag = begin[sort], lag[sort]
        # Seeds side by side with one lag are on one diagonal.
        fresh = np.ones(len(begin), bool)
        fresh[1:] = (begin[1:] != begin[:-1] + 1) | (lag[1:] != lag[:-1])
        covered: dict[int, int] = {}
        for place, q in zip(begin[fresh].tolist(), lag[fresh].tolist()):
            if place < covered.get(q, 0):
                continue
            right = place + _agree(words[place : n - q], words[place + q :])
            left = place - _agree(words[:place][::-1], words[q : place + q][::-1])
            covered[q] = right
            if right - left + q >= max(least_words, least_periods * q):
                runs.append((left, right - left + q, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period, compared exactly; of equal ones the first by start, then period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """A row per row of ``docs``: ``doc_id, n_words, runs, best, collapsed``.

    ``runs`` holds every maximal run of ``least_words`` words and ``least_periods`` periods or more as (start, length, period), by
    start, then period; words are numbered from 0 and periods are the smallest. ``best`` is the run with most periods, or null.
    ``collapsed`` is the text's words, joined by one space, without those that stand in a run after its first period. Null
    and empty texts, and texts without words, have no runs and an empty ``collapsed``. Ids may be null, repeated and of any type;
    equal rows have equal results; an empty table gives an empty result; other columns are not read, whatever their names.
    Words are told apart by 64-bit hashes of their bytes, each text by itself.
    """
    if least_periods < 2 or least_words < 2:
        raise ValueError("a run has two words and two periods at least")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in texts(batch.column(1)):
                count = np.diff(w.bounds)
                text = np.repeat(np.arange(b - a), count)
                # Words of two texts never have one key, so no run crosses a border.
                keys = mix(w.hashes() + text.astype(np.uint64) * _ODD[-1])
                per_text: list[list[tuple[int, int, int]]] = [[] for _ in range(b - a)]
                dropped = np.zeros(len(keys) + 1, np.int64)
                for start, length, period in maximal_runs(keys, int(count.max(initial=0)), least_words, least_periods):
                    owner = int(text[start])
                    per_text[owner].append((start - int(w.bounds[owner]), length, period))
                    dropped[start + period] += 1
                    dropped[start + length] -= 1
                kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
                # Kept words with a space behind each, gathered as bytes of the whole run of texts.
                collapsed = _joined(w.data, w.starts[kept], w.ends[kept], np.searchsorted(kept, w.bounds))
                found = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in per_text]
                best = [None if (s := strongest(rs)) is None else dict(zip(("start", "length", "period"), s)) for rs in per_text]
                columns = [pa.array(count.astype(np.int64)), pa.array(found, pa.list_(run_type)), pa.array(best, run_type), collapsed]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "n_words", "runs", "best", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    span = "struct<start:bigint,length:bigint,period:bigint>"
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{span}>, best {span}, collapsed string")


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Words of each text joined by one space; text i has the words from ``bounds[i]`` to ``bounds[i + 1]``."""
    size = ends - starts + 1
    place = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(int(place[-1])) + np.repeat(starts - place[:-1], size)
    out = np.where(index < len(data), data[np.minimum(index, max(0, len(data) - 1))], 32) if len(data) else np.zeros(0, np.uint8)
    out = out.astype(np.uint8)
    out[place[1:] - 1] = 32
    blob = out.tobytes()
    return pa.array([blob[place[a] : max(place[a], place[b] - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()).cast(pa.string())


def summary(found: DataFrame) -> DataFrame:
    """Digest of ``find_runs``: ``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``.

    ``start`` to ``exponent_milli`` describe the best run and are null without one; ``exponent_milli`` is 1000 times length over
    period, cut. ``runs_sha256`` is over ``start,length,period`` and a line end for each run.
    """
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
