"""Fill-in-the-middle transformation: texts are cut into prefix, middle and suffix at line ends and put into a training form.

A text is cut into chunks where a rolling hash of its last bytes says so, so passages that texts share mostly make the same
chunks. A task keeps a bounded cache from a chunk's content to its summary: lines, code points, where its lines end, whether
it holds a sentinel, and the bytes at its borders, with which sentinels across chunks are found. The cache compares whole
contents, so a hit is proven. Adding the chunks' counts tells in which chunk a cut lies, and the chunk's summary where in it.
Each row is transformed by itself: there is no shuffle, and an evicted chunk is only summarised again.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.words import _BYTE, _power_tables, mix, texts

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes under the rolling hash; chunks have ``MEAN_CHUNK`` bytes more than ``LEAST_CHUNK`` on average, and ``MOST_CHUNK`` at most.
WINDOW = 32
LEAST_CHUNK, MEAN_CHUNK, MOST_CHUNK = 256, 1024, 8192
#: Bytes of contents that a task's cache holds.
CACHE_BYTES = 32 << 20


@dataclass(slots=True)
class Summary:
    """What a chunk adds to its text."""

    lines: int  # line ends
    chars: int  # code points that begin in it
    ends: np.ndarray  # offset behind each line end
    chars_at: np.ndarray  # code points before each of these
    sentinel: bool
    head: bytes
    tail: bytes


def summarise(content: bytes, sentinels: tuple[bytes, ...], border: int) -> Summary:
    data = np.frombuffer(content, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    chars = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)
    found = any(s in content for s in sentinels)
    return Summary(len(ends), int(chars[-1]), ends, chars[ends - 1], found, content[:border], content[-border:])


class Summaries:
    """Summaries by content, the least recently used of which go when there are too many bytes."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS, limit: int = CACHE_BYTES):
        self.sentinels = tuple(s.encode() for s in sentinels)
        self.border = max(map(len, self.sentinels)) - 1
        self.limit, self.held = limit, 0
        self.known: OrderedDict[bytes, Summary] = OrderedDict()
        self.hits = 0

    def of(self, content: bytes) -> Summary:
        summary = self.known.get(content)
        if summary is not None:
            self.hits += 1
            self.known.move_to_end(content)
            return summary
        summary = self.known[content] = summarise(content, self.sentinels, self.border)
        self.held += len(content)
        while self.held > self.limit:
            self.held -= len(self.known.popitem(last=False)[0])
        return summary


def hash_cuts(data: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last ``WINDOW`` bytes would cut, by content alone. Works in blocks, whatever the length."""
    out = []
    for low in range(0, len(data) - WINDOW + 1, 1 << 20):
        block = data[low : low + (1 << 20) + WINDOW - 1]
        power, inverse = _power_tables(len(block) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[block] * power[: len(block)], dtype=np.uint64)])
        rolled = mix((total[WINDOW:] - total[:-WINDOW]) * inverse[: len(total) - WINDOW])
        out.append(np.flatnonzero(rolled % np.uint64(MEAN_CHUNK) == 0) + WINDOW + low)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunk_bounds(cuts: list[int], begin: int, end: int) -> list[int]:
    """Bounds of the chunks of the text from ``begin`` to ``end``, both included; ``cuts`` are those of ``hash_cuts``, sorted."""
    bounds = [begin]
    while (at := bounds[-1]) < end:
        # A window that reaches into the text before says nothing about this one.
        k = bisect_left(cuts, max(at + LEAST_CHUNK, begin + WINDOW))
        bounds.append(min(cuts[k] if k < len(cuts) else end, at + MOST_CHUNK, end))
    return bounds


class ChunkedText:
    """Counts of a text's chunks, added up."""

    def __init__(self, content: bytes, bounds: list[int], summaries: Summaries):
        self.bounds = [b - bounds[0] for b in bounds]
        self.parts = [summaries.of(content[a:b]) for a, b in zip(self.bounds, self.bounds[1:])]
        self.lines = list(accumulate((p.lines for p in self.parts), initial=0))
        self.chars = list(accumulate((p.chars for p in self.parts), initial=0))
        last = self.parts[-1] if self.parts else None
        self.open_line = last is not None and last.tail[-1:] != b"\n"
        self.has_sentinel = any(p.sentinel for p in self.parts) or self._across(summaries)

    def _across(self, summaries: Summaries) -> bool:
        """Whether a sentinel stands across the border of chunks; a chunk may be shorter than a border."""
        before = b""
        for p in self.parts:
            if any(s in before + p.head for s in summaries.sentinels):
                return True
            before = (before + p.tail)[-summaries.border :]
        return False

    @property
    def units(self) -> int:
        return self.lines[-1] + self.open_line

    def end_of(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` lines."""
        if units == 0:
            return 0, 0
        if units > self.lines[-1]:
            return self.bounds[-1], self.chars[-1]
        k = bisect_left(self.lines, units) - 1
        nth = units - self.lines[k] - 1
        return self.bounds[k] + int(self.parts[k].ends[nth]), self.chars[k] + int(self.parts[k].chars_at[nth])


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four reproducible numbers of 32 bits for an id; a null id counts as an empty one."""
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(key[i : i + 8], 16) for i in range(0, 32, 8))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``percent`` of the texts with their middle put last: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A text's units are its lines, each with its line end; ``n`` counts them. Two cuts behind 0 to n units are drawn from the
    id, so copies under other ids are cut elsewhere and each run gives the same. ``form`` is ``psm`` (prefix, suffix, middle, each
    behind its sentinel), or ``spm`` (suffix, prefix, middle) for ``spm_percent``, or ``plain``: the text itself, for those
    not drawn, for empty texts and for texts that hold a sentinel, so each output can be turned back by ``restored``. The lengths
    are in code points, null if plain. A null text counts as empty. Rows are taken one by one: ids may be null (drawn as an empty
    id), repeated and of any integer or string type; equal rows have equal results; an empty table gives an empty result; other
    columns are not read, whatever their names. ``sentinels`` must begin with a character that they hold nowhere else.
    """
    if any(s[0] in other[1:] for s in sentinels for other in sentinels) or len({*sentinels}) < 3:
        raise ValueError("sentinels must differ and begin with a character that they hold nowhere else")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    p, s, m = (x.encode() for x in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries(sentinels)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, w in texts(batch.column(1)):
                cuts, data = hash_cuts(w.data).tolist(), w.data.tobytes()
                units, forms, prefix_chars, middle_chars, outputs = [], [], [], [], []
                for i in range(a, b):
                    begin, end = int(w.offsets[i - a]), int(w.offsets[i - a + 1])
                    content = data[begin:end]
                    text = ChunkedText(content, chunk_bounds(cuts, begin, end), summaries)
                    n = text.units
                    h1, h2, h3, h4 = draws(ids[i], seed)
                    units.append(n)
                    if not content or text.has_sentinel or h3 % 100 >= percent:
                        forms.append("plain")
                        prefix_chars.append(None)
                        middle_chars.append(None)
                        outputs.append(content)
                        continue
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    (low_byte, low_char), (high_byte, high_char) = text.end_of(low), text.end_of(high)
                    prefix, middle, suffix = content[:low_byte], content[low_byte:high_byte], content[high_byte:]
                    spm = h4 % 100 < spm_percent
                    forms.append("spm" if spm else "psm")
                    prefix_chars.append(low_char)
                    middle_chars.append(high_char - low_char)
                    outputs.append(b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)))
                columns = [pa.array(units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``transform`` has put into this form."""
    p, s, m = (F.lit(x) for x in sentinels)
    before, middle = F.split_part(output, m, F.lit(1)), F.split_part(output, m, F.lit(2))
    psm = F.concat(F.substring(F.split_part(before, s, F.lit(1)), F.lit(len(sentinels[0]) + 1), F.length(before)), middle, F.split_part(before, s, F.lit(2)))
    spm = F.concat(F.split_part(before, p, F.lit(2)), middle, F.substring(F.split_part(before, p, F.lit(1)), F.lit(len(sentinels[1]) + 1), F.length(before)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
