"""Toxicity by a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks.

Words are compared by the subsequences of three characters that they share; each occurrence weighs less the longer
the stretch that it spans, so characters put in or left out lower the kernel instead of making it 0. Landmarks
are words that mark labelled toxic texts, found by greedy cover, and words of clean ones; the machine is trained on the
landmarks' kernel columns. Its score of a word is the inner product of the word's subsequences with one weight vector over
all subsequences, so scoring costs a table lookup a subsequence. A text scores by its worst word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.llm.cluster import discard, materialize
from pathweave.llm.words import Words, texts

#: Labelled rows of each kind that the model is fitted on at most; the smallest hashes of their ids are taken.
MAX_TOXIC_ROWS = 6_000
MAX_CLEAN_ROWS = 18_000
#: Candidate words of toxic rows, and words of clean rows, that reach the driver at most.
MAX_CANDIDATES = 1_500
MAX_CLEAN_WORDS = 20_000
#: A word must explain so many different texts, and this share of toxic rows, to count as marking; be this much more common
#: in toxic rows than in clean ones; and have this log-likelihood ratio: chance makes one in a million words as one-sided.
MIN_GAIN = 3
MIN_GAIN_SHARE = 0.005
MIN_LIFT = 60
MIN_EVIDENCE = 14.0
LANDMARKS = (192, 64)  # toxic and clean
#: Weight of a subsequence per character that it spans beyond three.
DECAY = 0.6
#: Longer words are looked at in windows of this many characters, each begun half a window after the one before.
LONGEST = 16
_SYMBOLS = 48

# Characters by class: letters alone, digits and signs that stand for letters with them, all else in a few classes.
_CLASS = np.full(256, 27, np.int64)
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = _i
for _sign, _letter in zip("013457@$", "oleastas"):
    _CLASS[ord(_sign)] = ord(_letter) - 97
_CLASS[128:192] = 28 + np.arange(64) % 16  # second bytes of two-byte letters
_CLASS[192:256] = 44 + np.arange(64) % 4
_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("@"), ord("$")]] = True
_PLACES = {n: np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3) for n in range(LONGEST + 1)}


def spell(words: list[bytes]) -> list[bytes]:
    """Words without signs at their ends; a run of three or more single letters becomes one word, at the end of the list."""
    out, run = [], []
    for w in [*words, b""]:
        inner = _INNER[np.frombuffer(w, np.uint8)]
        at = np.flatnonzero(inner)
        w = w[at[0] : at[-1] + 1] if len(at) else b""
        out.append(w)
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) >= 3:
                out.append(b"".join(run))
            run = []
    return [w for w in out if len(w) >= 3]


def variants(word: bytes) -> list[bytes]:
    """A marking word with one letter put in or doubled at each inner place, as writers do to hide it; short words are left alone."""
    if len(word) < 5:
        return []
    out = [word[:i] + b"x" + word[i:] for i in range(1, len(word), 2)]
    return out + [word[:i] + word[i - 1 : i] + word[i:] for i in range(1, len(word), 2)]


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence number and weight of each choice of three places, for words of one length (rows of ``codes``)."""
    places = _PLACES[codes.shape[1]]
    number = (codes[:, places[:, 0]] * _SYMBOLS + codes[:, places[:, 1]]) * _SYMBOLS + codes[:, places[:, 2]]
    weight = DECAY ** (places[:, 2] - places[:, 0] - 2).astype(float)
    return number, np.broadcast_to(weight, number.shape)


def norms(number: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Norm of each row's feature vector: weights of equal subsequences add up before they are squared."""
    order = np.argsort(number, axis=1, kind="stable")
    n, w = np.take_along_axis(number, order, 1), np.take_along_axis(weight, order, 1)
    total = np.cumsum(w, axis=1)
    last = np.ones(n.shape, bool)
    last[:, :-1] = n[:, 1:] != n[:, :-1]
    square = np.zeros(len(n))
    row, column = np.nonzero(last)
    value = total[row, column]
    value[1:] -= np.where(row[1:] == row[:-1], value[:-1], 0) if len(value) > 1 else 0
    np.add.at(square, row, value**2)
    return np.sqrt(square)


def embed(word: bytes) -> np.ndarray:
    """Normed feature vector of one word (its first window)."""
    codes = _CLASS[np.frombuffer(word[:LONGEST], np.uint8)][None, :]
    number, weight = subsequences(codes)
    out = np.zeros(_SYMBOLS**3)
    np.add.at(out, number[0], weight[0])
    return out / np.linalg.norm(out)


def _trimmed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without the signs at their ends; empty where nothing is left."""
    inner = np.flatnonzero(_INNER[w.data])
    if not len(inner):
        return w.starts, w.starts
    first = np.searchsorted(inner, w.starts)
    last = np.searchsorted(inner, w.ends) - 1
    some = first <= last
    start = np.where(some, inner[np.minimum(first, len(inner) - 1)], w.starts)
    end = np.where(some, inner[np.maximum(last, 0)] + 1, w.starts)
    return start, end


def worst_words(w: Words, weights: np.ndarray, offset: float) -> np.ndarray:
    """The highest margin among each text's words; -inf for texts without a word of three characters."""
    start, end = _trimmed(w)
    doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    size = end - start
    data = w.data
    # Words with signs inside are looked at without them as well.
    inner = np.concatenate([[0], np.cumsum(_INNER[data])])
    pure = inner[end] - inner[start]
    hidden = np.flatnonzero((pure < size) & (pure >= 3))
    if len(hidden):
        at = np.repeat(start[hidden], size[hidden]) + np.arange(int(size[hidden].sum())) - np.repeat(np.cumsum(size[hidden]) - size[hidden], size[hidden])
        at = at[_INNER[data[at]]]
        to = len(data) + np.cumsum(pure[hidden])
        data = np.concatenate([data, data[at]])
        start, end, doc = np.concatenate([start, to - pure[hidden]]), np.concatenate([end, to]), np.concatenate([doc, doc[hidden]])
        size = end - start
    # Runs of single letters are spelled words.
    single = np.flatnonzero(size[: len(w.starts)] == 1)
    if len(single) > 2:
        breaks = np.flatnonzero((np.diff(single) != 1) | (np.diff(doc[single]) != 0)) + 1
        spelled = [r for r in np.split(single, breaks) if len(r) >= 3]
        if spelled:
            joined = np.concatenate([data[start[r]] for r in spelled])
            lengths = np.array([len(r) for r in spelled])
            at = len(data) + np.cumsum(lengths) - lengths
            data = np.concatenate([data, joined])
            start, end, doc = np.concatenate([start, at]), np.concatenate([end, at + lengths]), np.concatenate([doc, doc[[r[0] for r in spelled]]])
            size = end - start
    # Long words as overlapping windows.
    long = np.flatnonzero(size > LONGEST)
    if len(long):
        step = LONGEST // 2
        count = -(-(size[long] - LONGEST) // step) + 1
        owner = np.repeat(long, count)
        shift = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * step
        at = np.minimum(start[owner] + shift, end[owner] - LONGEST)
        start, doc = np.concatenate([start, at]), np.concatenate([doc, doc[owner]])
        size = np.concatenate([np.where(size > LONGEST, 0, size), np.full(len(owner), LONGEST)])
    best = np.full(len(w.bounds) - 1, -np.inf)
    classes = _CLASS[data]
    for n in range(3, LONGEST + 1):
        at = np.flatnonzero(size == n)
        if not len(at):
            continue
        codes = classes[start[at][:, None] + np.arange(n)]
        key = np.zeros(len(at), np.uint64)
        for j in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[:, j].astype(np.uint64) + np.uint64(1)
        _, first, where = np.unique(key, return_index=True, return_inverse=True)
        margin = np.empty(len(first))
        block = max(1, 400_000 // len(_PLACES[n]))
        for a in range(0, len(first), block):
            number, weight = subsequences(codes[first[a : a + block]])
            raw = (weights[number] * weight).sum(axis=1)
            # The norm is at least that of the shares without repetition, so most words are settled without it.
            margin[a : a + block] = raw
            near = np.flatnonzero(raw > 0)
            if len(near):
                margin[a + near] = raw[near] / norms(number[near], weight[near])
        np.maximum.at(best, doc[at], margin[where] + offset)
    return best


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """Weights over subsequences, offset, and the slope and shift of the logistic that turns margins into scores.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``toxic``. What reaches the driver is bounded by the
    row and word limits above.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = marks.where("toxic = 1").orderBy(*by_hash).limit(MAX_TOXIC_ROWS).unionByName(marks.where("toxic = 0").orderBy(*by_hash).limit(MAX_CLEAN_ROWS))
    rows = materialize(rows)
    sample = materialize(docs.join(F.broadcast(rows), "doc_id").select(F.xxhash64("text").alias("text_id"), "toxic", "text"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({w.lower()[:LONGEST] for w in spell((text or "").encode().split())}) for text in batch.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array([w for f in found for w in f], pa.binary())], ["text_id", "toxic", "word"])

    words = materialize(sample.mapInArrow(words_of, "text_id long, toxic int, word binary"))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    n_bad, n_good = (rows.where(f"toxic = {t}").count() for t in (1, 0))
    if not n_bad or not n_good:
        return np.zeros(_SYMBOLS**3), -1.0, 1.0, 0.0
    # Evidence that a word marks toxic rows: log-likelihood ratio of its share of toxic rows to theirs among all rows.
    share, seen = n_bad / (n_bad + n_good), F.col("bad") + F.col("good")
    evidence = F.col("bad") * F.log(F.col("bad") / (seen * share)) + F.col("good") * F.log(F.greatest(F.col("good"), F.lit(1)) / (seen * (1 - share)))
    marking = counts.where((F.col("bad") >= MIN_GAIN) & (F.col("bad") * n_good > (F.col("good") + 0.5) * n_bad * MIN_LIFT) & (evidence >= MIN_EVIDENCE)).orderBy(F.col("bad").desc(), "word").limit(MAX_CANDIDATES)
    candidates = [bytes(r.word) for r in marking.collect()]
    clean = [bytes(r.word) for r in counts.where((F.col("good") >= 1) & (F.col("bad") * n_good <= F.col("good") * n_bad * 3)).orderBy(F.xxhash64("word"), "word").limit(MAX_CLEAN_WORDS).collect()]
    places: dict[bytes, set] = {w: set() for w in candidates}
    for r in words.where("toxic = 1").join(F.broadcast(marking.select("word")), "word").select("word", "text_id").distinct().collect():
        places[bytes(r.word)].add(r.text_id)
    # Greedy cover: the words that explain most rows not explained yet.
    cover, left = [], set().union(*places.values()) if places else set()
    while left:
        word = max(places, key=lambda w: (len(places[w] & left), len(places[w]), w))
        gain = places[word] & left
        if len(gain) < max(MIN_GAIN, MIN_GAIN_SHARE * n_bad):
            break
        cover.append((word, len(places[word])))
        left -= gain
    if not cover or not clean:
        return np.zeros(_SYMBOLS**3), -1.0, 1.0, 0.0
    known = {w for w, _ in cover}
    cover += [(w, len(places[w])) for w in own_words(places, max(5, MIN_GAIN_SHARE * n_bad)) if w not in known]
    bad = [w for w, _ in cover]
    spoiled = sorted({v for w in bad for v in variants(w)} - set(clean))
    landmarks = np.stack([embed(w) for w in [*bad[: LANDMARKS[0]], *clean[: LANDMARKS[1]]]])
    kernel = landmarks @ landmarks.T
    value, vector = np.linalg.eigh(kernel)
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # landmark columns to Nyström features
    features = np.concatenate([_columns(bad, landmarks), _columns(spoiled, landmarks), _columns(clean, landmarks)]) @ root
    sign = np.concatenate([np.ones(len(bad) + len(spoiled)), -np.ones(len(clean))])
    weight = np.concatenate([np.full(len(bad), 0.3 / len(bad)), np.full(len(spoiled), 0.2 / max(1, len(spoiled))), np.full(len(clean), 0.5 / len(clean))])
    plane, offset = support_vectors(features, sign, weight)
    primal = landmarks.T @ (root @ plane)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in texts(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(worst_words(w, primal, offset))], ["toxic", "margin"])

    fitted = sample.mapInArrow(margins, "toxic int, margin double").collect()
    for table in (rows, sample, words):
        discard(table)
    slope, shift = logistic(np.array([max(r.margin, -3.0) for r in fitted]), np.array([r.toxic for r in fitted]))
    return primal, offset, slope, shift


def own_words(places: dict[bytes, set], least: float, alike: float = 0.6, company: int = 3) -> list[bytes]:
    """Candidates that come in many texts, and not always with the same others: words that copies of one text share go together."""
    words = sorted(places)
    number = {t: i for i, t in enumerate(sorted(set().union(*places.values())))}
    held = np.zeros((len(words), len(number)), np.float32)
    for i, w in enumerate(words):
        held[i, [number[t] for t in places[w]]] = 1
    both, size = held @ held.T, held.sum(axis=1)
    share = both / np.maximum(size[:, None] + size[None, :] - both, 1)
    with_it = (share >= alike).sum(axis=1) - 1
    chosen = [i for i in np.argsort(-size, kind="stable") if size[i] >= least and with_it[i] < company]
    return [words[i] for i in chosen]


def _columns(words: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    """Kernel columns of words: a word has few subsequences, so only those of the landmarks are looked up."""
    by_subsequence = np.ascontiguousarray(landmarks.T)
    out = np.zeros((len(words), len(landmarks)))
    for i, word in enumerate(words):
        codes = _CLASS[np.frombuffer(word[:LONGEST], np.uint8)][None, :]
        number, weight = subsequences(codes)
        out[i] = weight[0] @ by_subsequence[number[0]] / norms(number, weight)[0]
    return out


def support_vectors(x: np.ndarray, sign: np.ndarray, weight: np.ndarray, cost: float = 2000.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss: Newton steps on the rows inside the margin, until they no longer change."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    plane, before = np.zeros(z.shape[1]), None
    for _ in range(rounds):
        inside = sign * (z @ plane) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        c = cost * weight[inside]
        step = np.linalg.solve(ridge + (z[inside] * c[:, None]).T @ z[inside], (z[inside] * c[:, None]).T @ sign[inside])
        plane = 0.5 * plane + 0.5 * step if _ > 20 else step
    return plane[:-1], float(plane[-1])


def logistic(margin: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic of label given margin, smoothed so that separable rows keep it finite; classes weigh alike."""
    n_bad, n_good = max(1, label.sum()), max(1, (1 - label).sum())
    target = np.where(label == 1, (n_bad + 1) / (n_bad + 2), 1 / (n_good + 2))
    weight = np.where(label == 1, 1 / n_bad, 1 / n_good)
    z = np.stack([margin, np.ones(len(margin))], axis=1)
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (weight * (target - p)) - 1e-4 * b
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        b = b + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(b[0]), float(b[1])


def score_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """Toxicity of every whole text: ``doc_id, held_out, score, predicted``, one row per input row.

    Labels are learned only from rows that are not held out: those whose crc32 of the id as text leaves other than 1 modulo 3.
    The score lies in 0 to 1, higher where label 1 is likelier; ``predicted`` is 1 from ``threshold`` on. Null and empty texts,
    and those without a word of three characters, score as the cleanest word would. Rows with a null id are not held out
    and have no labels; repeated rows score alike; an empty table gives an empty result, and without labels of both kinds
    all scores are low and equal. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where(~held_out())
    primal, offset, slope, shift = train(source, marks)
    shared = docs.sparkSession.sparkContext.broadcast(primal)  # one number for each of the subsequences

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in texts(batch.column(2)):
                margin = np.maximum(worst_words(w, shared.value, offset), -3.0)
                value = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(value), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return source.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
