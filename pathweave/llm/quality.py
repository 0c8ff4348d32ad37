"""Quality classifier by importance resampling.

Hashed n-grams of a text follow two generative models, one of target text and one of raw text. A text's importance is
the ratio of its likelihoods under them, taken per n-gram, so that long and short texts compare. Documents are resampled by
importance without replacement: the top k of log importance plus scaled Gumbel noise are kept. N-grams are of two families in
buckets of their own: words and pairs of words, and up to three successive shapes of words (classes of their bytes, length,
and whether the word repeats one shortly before), which hold for words that the models have not met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.llm.cluster import materialize
from pathweave.llm.words import Words, grams, mix, texts

#: Buckets; the lower half is of words, the upper one of shapes.
BUCKETS = 1 << 15
#: Labelled rows that the target model is fitted on at most; the smallest hashes of their ids are taken.
MAX_TARGET_ROWS = 200_000
#: Gumbel noise is scaled by this: texts whose log importance per n-gram differs by much more keep their order.
TEMPERATURE = 0.02

# Classes of bytes for word shapes.
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[128:] = 4
_CLASS[[44, 46, 59, 58, 63, 33, 45, 39, 34, 40, 41]] = 5
_CLASS[[124, 35, 36, 37, 38, 42, 60, 61, 62, 64, 94, 95, 123, 125, 126, 43, 92, 47]] = 6


def _shapes(w: Words) -> np.ndarray:
    """A small code per word: classes of its first byte, second byte and last two bytes, and its length up to 15."""
    first = _CLASS[w.data[w.starts]]
    last = _CLASS[w.data[w.ends - 1]]
    length = w.ends - w.starts
    second = np.where(length > 1, _CLASS[w.data[np.minimum(w.starts + 1, w.ends - 1)]], 7)
    before = np.where(length > 1, _CLASS[w.data[np.maximum(w.ends - 2, w.starts)]], 7)
    long = np.minimum(length, 15) // 4
    return (((first.astype(np.uint64) * 8 + second) * 8 + last) * 8 + before) * 4 + long.astype(np.uint64)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of texts: bucket of each, and the text that it is of (by position)."""
    words = w.hashes(lower=True)
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    shape = _shapes(w)
    lag = np.zeros(n, np.uint64)
    for k in (3, 2, 1):  # the nearest repetition counts
        same = np.zeros(n, bool)
        same[k:] = (words[k:] == words[:-k]) & (doc[k:] == doc[:-k])
        lag[same] = k
    shape = mix(shape * np.uint64(4) + lag + np.uint64(0x51ED27))
    half = np.uint64(BUCKETS // 2)
    out, where = [], []
    for family, (tokens, longest) in enumerate(((words, 2), (shape, 3))):
        for size in range(1, min(longest, n) + 1):
            inside = doc[size - 1 :] == doc[: n - size + 1]
            gram = tokens if size == 1 else grams(tokens, size)
            out.append(gram[inside] % half + half * np.uint64(family))
            where.append(doc[size - 1 :][inside])
    return np.concatenate(out).astype(np.int64), np.concatenate(where)


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of hashed n-grams over all texts: (``bucket``, ``n``). Each task sends at most one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, w in texts(batch.column(0)):
                bucket, _ = features(w)
                total += np.bincount(bucket, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def importance_model(docs: DataFrame, target: DataFrame, text_col: str = "text", prior: float = 1.0) -> np.ndarray:
    """Log ratio of the target to the raw model, per bucket. Both are collected: ``BUCKETS`` rows each at most."""
    counts = []
    for frame in (target, docs):
        total = np.full(BUCKETS, prior)
        for row in gram_counts(frame, text_col).collect():
            total[row.bucket] += row.n
        counts.append(np.log(total / total.sum()))
    return counts[0] - counts[1]


def log_importance(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, log_weight, n_grams`` of every row; texts without words have weight 0. ``carry`` keeps all columns instead of the id."""
    frame = docs if carry else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    at = frame.columns.index(text_col if carry else "text")
    kept = frame.schema.fields if carry else frame.schema.fields[:1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, grams_of = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b, w in texts(batch.column(at)):
                bucket, doc = features(w)
                weight[a:b] = np.bincount(doc, model[bucket], minlength=b - a)
                grams_of[a:b] = np.bincount(doc, minlength=b - a)
            columns = batch.columns[: len(kept)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weight), pa.array(grams_of)], [*(f.name for f in kept), "log_weight", "n_grams"])

    schema = T.StructType([*kept, T.StructField("log_weight", T.DoubleType()), T.StructField("n_grams", T.LongType())])
    return frame.mapInArrow(score, schema)


def _keyed(scored: DataFrame, temperature: float, id_col: str = "doc_id") -> DataFrame:
    """Adds log weight per n-gram, the resampling key (that plus Gumbel noise from a hash of id and weight), and a hash that orders ties."""
    uniform = (F.pmod(F.xxhash64(id_col, "log_weight", F.lit(99)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    per_gram = F.when(F.col("n_grams") > 0, F.col("log_weight") / F.col("n_grams")).otherwise(0.0)
    scored = scored.withColumn("per_gram", per_gram)
    return scored.withColumn("key", F.col("per_gram") - temperature * F.log(-F.log(uniform))).withColumn("tie", F.xxhash64(id_col, F.lit(3)))


def kth_largest(scored: DataFrame, col: str, tie: str, k: int) -> tuple[float, int] | None:
    """The k-th row in order of ``col`` descending, then ``tie``: found by halving the range of values, a count each time.

    Only one count and two bounds reach the driver in a step. None where k is 0 or no row exists.
    """
    low, high, n = scored.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    above = 0
    while True:  # rows in [low, high] hold the k-th; `above` rows lie beyond high
        width = (high - low) / 256
        if width <= 0 or low + width == low:
            break
        cell = F.least(F.floor((F.col(col) - low) / width), F.lit(255))
        cells = {int(r.cell): (r.n, r.lo, r.hi) for r in scored.where(F.col(col).between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()}
        for c in sorted(cells, reverse=True):
            size, low, high = cells[c]
            if above + size >= k:
                break
            above += size
        if size <= 10_000 and low < high:
            row = scored.where(F.col(col).between(low, high)).orderBy(F.col(col).desc(), tie).limit(k - above).select(col, tie).collect()[-1]
            return row[0], row[1]
        if low == high:
            break
    tied = scored.where(F.col(col) == low)
    row = tied.orderBy(tie).limit(k - above).agg(F.max(tie)).first() if k - above < tied.count() else tied.agg(F.max(tie)).first()
    return low, row[0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, keep: float | None, temperature: float) -> tuple[np.ndarray, Column, DataFrame]:
    """The model, the condition on ``key`` and ``tie`` under which a row is kept, and the scores of all rows."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").distinct()
    target = marks.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TARGET_ROWS)
    # At most MAX_TARGET_ROWS ids are broadcast, so that no text is shuffled.
    good = source.join(F.broadcast(target.select("doc_id")), "doc_id", "left_semi")
    model = importance_model(source, good)
    scored = materialize(_keyed(log_importance(source, model), temperature))
    if keep is None:
        k = scored.where(F.col("per_gram") >= _level(scored.join(marks, "doc_id"))).count()
    else:
        k = round(keep * scored.count())
    last = kth_largest(scored, "key", "tie", k)
    kept = F.lit(False) if last is None else (F.col("key") > last[0]) | ((F.col("key") == last[0]) & (F.col("tie") <= last[1]))
    return model, kept, scored


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """Importance resampling: ``doc_id, log_weight, key, kept``, one row per input row.

    ``labels`` marks target text with ``label_col`` = 1; at most ``MAX_TARGET_ROWS`` of them fit the target model. The raw
    model counts every row of ``docs``. ``keep`` is the share of rows to take; by default it is the share of rows whose
    importance per n-gram is above the level that parts labelled rows of both kinds best. The k rows with the largest
    log weight plus Gumbel noise (a hash of id and weight, so reruns agree) are kept. Null and empty texts have weight 0, as
    every text that fits both models alike; rows with equal ids and texts get the same key and go or stay together; other
    ties are taken by a hash of the id. An empty table gives an empty result; without labelled rows of both kinds all rows
    are kept by default. Other columns are not read.
    """
    _, kept, scored = fit(docs, labels, id_col, text_col, label_col, keep, temperature)
    return scored.select("doc_id", "log_weight", "key", kept.alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with all their columns. Texts are scored once more instead of being shuffled."""
    model, kept, _ = fit(docs, labels, id_col, text_col, label_col, keep, temperature)
    columns = docs.columns
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*columns).alias("row"))
    return _keyed(log_importance(packed, model, carry=True), temperature).where(kept).select("row.*")


def _level(labelled: DataFrame, step: float = 0.02, most: float = 40.0) -> float:
    """Importance per n-gram that parts labelled rows with the fewest errors, each kind counted by share.

    Works on counts in cells of width ``step``; of equally good levels the middle of the widest run is taken. Without
    rejected rows every level is good and the lowest is taken, so nothing goes.
    """
    cell = F.floor(F.greatest(F.least("per_gram", F.lit(most)), F.lit(-most)) / step).cast("int")
    rows = labelled.groupBy(cell.alias("cell"), "label").count().collect()
    cells = int(2 * most / step) + 2
    counts = np.zeros((2, cells))
    for r in rows:
        counts[r.label, r.cell + cells // 2] += r["count"]
    if not counts[0].sum() or not counts[1].sum():
        return float("-inf")
    share = counts / counts.sum(axis=1, keepdims=True)
    # A level at the lower end of cell c keeps cells c and up.
    wrong = np.concatenate([[0], np.cumsum(share[1])]) + share[0].sum() - np.concatenate([[0], np.cumsum(share[0])])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=len)
    return float((run[0] + run[-1]) / 2 - cells // 2) * step
