"""Repetition coverage, fill-in-the-middle and periodic runs against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.llm import fill_in_middle, periodic_runs, queries, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    line = "one two three four five six seven eight nine ten\n"
    out = [None, "", " \t\n \n", "\n", "word", "no line end", "a\nb\nc", "é ü 😀\n\n\nx", "tab\x0bword\x0cword\rend", "\x85nel is no space", line, line * 2, line * 9, (line + "other words stand here\n") * 4]
    out += ["a " * 400, "x" * 30_000 + " end", "".join(f"line {i} of a long text that goes on\n" for i in range(3000))]
    out += ["has <P> inside", "cut <", "S> begins", "almost <S and <M", "<M>", "## && %% || <> $$ **" * 20, "A a " * 30]
    for _ in range(60):
        vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 3, 8, 400]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 220))]
        if words and rng.random() < 0.6:
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 3))
            words[a:] = [words[a + i % p] for i in range(len(words) - a)]
        out.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\n\n", "\t"]) for w in words))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "an id is missing\n" * 3, None, None, None), (7, "same id, other text\n", None, None, None)]
    rows += [rows[11], rows[11]]
    clash = ["n", "form", "runs", "size", "best", "kept", "n_words", "output"]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in clash}).repartition(3)


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in repetition.SYMBOLS for c in text)}
    seen, lines, chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                lines, chars = lines + 1, chars + len(SPACE.sub("", line))
            seen.add(line)
    out |= {"n_dup_lines": lines, "dup_line_chars": chars}
    for n in (5, 6, 7, 8, 9, 10):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, before, again, twice = Counter(grams), set(), set(), set()
        for i, g in enumerate(grams):
            twice |= set(range(i, i + n)) if count[g] > 1 else set()
            again |= set(range(i, i + n)) if g in before else set()
            before.add(g)
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in again)
        if n == 8:
            out["n_repeat_words"] = len(twice)
    out["base_failed"] = out["n_words"] < 20 or 100 * out["n_repeat_words"] > 30 * out["n_words"]
    limits = {"dup_line_chars": 25, "dup_chars_5": 25, "dup_chars_6": 24, "dup_chars_7": 23, "dup_chars_8": 22, "dup_chars_9": 21, "dup_chars_10": 20}
    out["kept"] = not out["base_failed"] and all(100 * out[c] <= p * out["word_chars"] for c, p in limits.items())
    return out


def test_repetition_equals_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    got = Counter(tuple(sorted(r.asDict().items())) for r in repetition.judge(docs).collect())
    assert got == Counter(tuple(sorted(({"doc_id": r.doc_id} | brute_measures(r.text)).items())) for r in rows)


def test_repetition_of_other_lengths_and_texts_without_rows(spark, docs):
    assert repetition.judge(docs.limit(0)).collect() == []
    found = repetition.measures(docs.where("doc_id = 12"), lengths=(2, 10), window=3).first()
    assert found.dup_chars_2 == found.dup_chars_10 == found.dup_line_chars and found.n_repeat_words == found.n_words == 90


def test_repetition_keeps_clean_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    found = queries.op11_repetition(spark, sf).join(labels, "doc_id").where("not base_failed")
    assert found.count() > 20 and found.where("not kept").count() == 0


def brute_middle(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), out


@pytest.mark.parametrize("percent, spm", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_middle_equals_brute_force_and_turns_back(docs, percent, spm):
    done = fill_in_middle.transform(docs, percent=percent, spm_percent=spm).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form")))
    got = done.collect()
    rows = docs.select("doc_id", "text").collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter(brute_middle(r.doc_id, r.text, 7, percent, spm) for r in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((r.doc_id, r.text or "") for r in rows)


def test_middle_with_other_sentinels(spark, docs):
    sentinels = ("[pre]", "[suf]", "[mid]")
    done = fill_in_middle.transform(docs, sentinels=sentinels).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), sentinels))
    assert Counter((r.doc_id, r.back) for r in done.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert fill_in_middle.transform(docs.limit(0)).collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.transform(docs, sentinels=bad)


def test_chunks_are_shared_and_sentinels_across_them_found():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh \n") for _ in range(40_000)).encode()
    summaries = fill_in_middle.Summaries(limit=60_000)

    def chunked(content):
        cuts = fill_in_middle.hash_cuts(np.frombuffer(content, np.uint8)).tolist()
        bounds = fill_in_middle.chunk_bounds(cuts, 0, len(content))
        sizes = np.diff(bounds)
        assert sizes.max() <= fill_in_middle.MOST_CHUNK and bounds[-1] == len(content)
        return fill_in_middle.ChunkedText(content, bounds, summaries)

    first = chunked(b"one beginning\n" + passage)
    before = summaries.hits
    second = chunked(b"another, longer beginning\n" * 30 + passage)
    assert len(first.parts) > 15 and summaries.hits - before > len(first.parts) - 4 and summaries.held <= 60_000
    for units in range(0, second.units + 1, 37):
        whole = (b"another, longer beginning\n" * 30 + passage).splitlines(keepends=True)
        assert second.end_of(units)[0] == sum(map(len, whole[:units]))
    # Bounds at every place of a text with one sentinel: one byte a chunk at the least.
    for bounds in ([0, 1, 2, 3, 4, 5, 6], [0, 3, 4, 6], [0, 2, 3, 6], [0, 6]):
        assert fill_in_middle.ChunkedText(b"ab<S>c", bounds, summaries).has_sentinel
        assert not fill_in_middle.ChunkedText(b"ab<Sc>", bounds, summaries).has_sentinel
    assert fill_in_middle.hash_cuts(np.zeros(5, np.uint8)).tolist() == []
    long = np.frombuffer(passage * 60, np.uint8)
    assert len(set(fill_in_middle.hash_cuts(long).tolist())) == len(fill_in_middle.hash_cuts(long)) and len(long) > 1 << 21


def brute_runs(words, least_words=24, least_periods=3):
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length, part = j - i + q, words[i : j + q]
            if j > i and length >= max(least_words, least_periods * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        least_words, least_periods = rng.choice([(2, 2), (5, 2), (12, 3), (24, 3), (24, 3), (30, 4), (100, 3)])
        n, letters = rng.randint(0, 140), rng.choice([1, 2, 2, 3, 5, 50])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a = rng.randrange(n)
            p, b = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
            words[a:b] = [words[a + i % p] for i in range(b - a)]
        assert periodic_runs.maximal_runs(np.array(words, np.uint64), n, least_words, least_periods) == brute_runs(words, least_words, least_periods)


def test_runs_of_words_built_to_repeat():
    fibonacci, last = [0, 1], [0]
    while len(fibonacci) < 1200:
        fibonacci, last = fibonacci + last, fibonacci
    # A block in which every word pair comes twice, three times over: its grams recur inside the period.
    block = [x for part in "abcabdacdbcd" for x in [f"{part}{i}" for i in range(20)]]
    ids = {w: i for i, w in enumerate(sorted(set(block)))}
    for words in (fibonacci, [bin(i).count("1") & 1 for i in range(1200)], [0] * 1200, [ids[w] for w in block * 3]):
        assert periodic_runs.maximal_runs(np.array(words, np.uint64), len(words)) == brute_runs(words)
    assert periodic_runs.strongest([(0, 30, 10), (5, 24, 8), (9, 25, 8)]) == (9, 25, 8) and periodic_runs.strongest([]) is None
    classes = list(periodic_runs.lag_classes(1000, 24, 3))
    assert classes[0] == (1, 16, 16) and all(b[0] == a[1] + 1 and b[2] >= b[1] for a, b in zip(classes, classes[1:])) and classes[-1][1] >= 333


def digest(doc_id, text, planted):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if planted and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *row, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.mark.parametrize("planted", [False, True])
def test_run_digests_equal_brute_force(docs, planted):
    small = docs.where("text is null or length(text) < 20000")
    shown = small.withColumn("text", queries.planted_period(F.col("doc_id"), F.col("text"))) if planted else small
    got = Counter(tuple(r) for r in periodic_runs.summary(periodic_runs.find_runs(shown)).collect())
    want = Counter(digest(r.doc_id, r.text, planted) for r in small.select("doc_id", "text").collect())
    assert got == want and sum(r[1] > 0 for r in want) > 20


def test_runs_of_odd_tables(docs):
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []
    found = {r.doc_id: r for r in periodic_runs.find_runs(docs.where("doc_id in (0, 1, 14)")).collect()}
    assert found[0].runs == found[1].runs == [] and found[0].collapsed == found[1].collapsed == "" and found[0].best is None
    assert [tuple(r) for r in found[14].runs] == [(0, 400, 1)] and found[14].collapsed == "a" and found[14].n_words == 400
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, least_periods=1)


def test_query_of_runs_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = {r.doc_id: r.text for r in docs.collect() if len(WORD.findall(r.text or "")) <= 500}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == docs.count() and len(short) > 100
    assert all(got[i] == digest(i, t, True) for i, t in short.items())
