"""Repetition coverage: how much of a text stands inside n-grams and lines that it has more than once.

Words and lines are hashed with rolling sums over whole Arrow batches; n-grams of several lengths are combined from the word
hashes and compared within their text by sorting. A longer n-gram can repeat only where both shorter ones inside it do, so
each length looks only at the places that the length before has left. Coverage counts a character once a length, however many
repeated n-grams hold it. Every text is measured whole and by itself: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.words import _ODD, Words, mix, span_hashes, texts

SYMBOLS = "#*$%&|<>"
#: Length of the windows that the base rule counts, the least number of words, and the percentage of repeated words that fails a text.
BASE_WINDOW = 8
LEAST_WORDS = 20
BASE_PERCENT = 30
#: Percentage of characters in repeated n-grams, by length, above which a text goes, and in repeated lines. They are looser than
#: published ones for web text (15 to 10, and 20): those reject short clean texts of which one line comes twice.
DUPLICATE_PERCENT = {5: 25, 6: 24, 7: 23, 8: 22, 9: 21, 10: 20}
LINE_PERCENT = 25

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


def later_equals(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether an equal one stands before it, and whether one stands before or after it."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def _gram_keys(words: np.ndarray, text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that begin at ``at``: equal for equal ones of one text."""
    total = text[at].astype(np.uint64) * _ODD[-1] + _ODD[n]
    for j in range(n):
        total += words[at + j] * _ODD[j]
    return mix(total)


def _covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which words stand in an n-gram that begins at ``at``."""
    opened = np.bincount(at, minlength=n_words + 1) - np.bincount(at + n, minlength=n_words + 1)
    return np.cumsum(opened)[:n_words] > 0


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of all texts, in order."""
    breaks = np.flatnonzero(w.data == 10)
    return np.sort(np.concatenate([w.offsets[:-1], breaks + 1])), np.sort(np.concatenate([w.offsets[1:], breaks]))


def measure(w: Words, lengths: tuple[int, ...], window: int = BASE_WINDOW) -> dict[str, np.ndarray]:
    """Measures of each of the texts of ``w``, as int64 arrays by column name."""
    n_texts, n_words = len(w.bounds) - 1, len(w.starts)
    chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
    size = chars[w.ends] - chars[w.starts]
    text = np.repeat(np.arange(n_texts), np.diff(w.bounds))
    out = {"n_words": np.diff(w.bounds).astype(np.int64), "word_chars": _sums(size, w.bounds), "n_symbols": _sums(_IS_SYMBOL[w.data], w.offsets)}

    start, end = _lines(w)
    first, past = np.searchsorted(w.starts, start), np.searchsorted(w.starts, end)
    held = first < past
    start, end, first, past = start[held], end[held], first[held], past[held]
    owner = text[first]
    later, _ = later_equals(mix(span_hashes(w.data, start, end) + owner.astype(np.uint64) * _ODD[-1]))
    total = np.concatenate([[0], np.cumsum(size)])
    out["n_dup_lines"] = np.bincount(owner[later], minlength=n_texts).astype(np.int64)
    out["dup_line_chars"] = np.bincount(owner[later], (total[past] - total[first])[later], minlength=n_texts).astype(np.int64)

    words = w.hashes()
    repeated, before = np.ones(n_words, bool), 1
    for n in sorted({window, *lengths}):
        # An n-gram repeats only where the shorter ones at its start and at its end do.
        at = np.flatnonzero(repeated[: max(0, n_words - n + 1)])
        at = at[repeated[at + n - before] & (text[at] == text[at + n - 1])]
        later, any_ = later_equals(_gram_keys(words, text, at, n))
        if n == window:
            out["n_repeat_words"] = _sums(_covered(n_words, at[any_], n), w.bounds)
        if n in lengths:
            out[f"dup_chars_{n}"] = _sums(np.where(_covered(n_words, at[later], n), size, 0), w.bounds)
        repeated, before = np.zeros(n_words, bool), n
        repeated[at[any_]] = True
    return out


def columns(lengths: tuple[int, ...]) -> list[str]:
    return ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_chars_{n}" for n in sorted(lengths)]]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = tuple(DUPLICATE_PERCENT), window: int = BASE_WINDOW) -> DataFrame:
    """A row per row of ``docs``: its id as ``doc_id``, and longs.

    ``n_words`` and ``word_chars`` (words and their code points), ``n_symbols``, ``n_dup_lines`` and ``dup_line_chars`` (lines with
    a word that equal an earlier line of the text, and the code points of their words), ``n_repeat_words`` (words in windows of
    ``window`` words that come twice or more, the first included), and for each length n ``dup_chars_n`` (code points of the words
    in n-grams that have stood before in the text). Null and empty texts, and texts without words, have zeros in all. Ids may be
    null, repeated and of any type; equal rows each have their row; an empty table gives an empty result; other columns are not
    read, whatever their names. Words and lines are compared by 64-bit hashes, each text by itself.
    """
    names = columns(lengths)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in texts(batch.column(1)):
                found = measure(w, lengths, window)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(found[n], pa.int64()) for n in names]], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def fails_base(least_words: int = LEAST_WORDS, percent: int = BASE_PERCENT) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > percent * F.col("n_words"))


def too_repetitive(percent: dict[int, int] = DUPLICATE_PERCENT, line_percent: int = LINE_PERCENT) -> Column:
    """Whether repeated n-grams of some length, or repeated lines, hold more than their permitted percentage of a text's characters."""
    out = 100 * F.col("dup_line_chars") > line_percent * F.col("word_chars")
    for n, p in sorted(percent.items()):
        out = out | (100 * F.col(f"dup_chars_{n}") > p * F.col("word_chars"))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: dict[int, int] = DUPLICATE_PERCENT, line_percent: int = LINE_PERCENT) -> DataFrame:
    """``measures`` with ``base_failed`` and ``kept``: a text stays if neither the base rule nor a coverage rule fails it.

    Texts with fewer than ``LEAST_WORDS`` words, null and empty ones among them, fail.
    """
    found = measures(docs, id_col, text_col, tuple(percent)).withColumn("base_failed", fails_base())
    return found.withColumn("kept", ~F.col("base_failed") & ~too_repetitive(percent, line_percent))
