"""Text and embedding operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.llm import cluster, embedding_dedup, fm_index, jaccard, mixing, packing, personal_data, quality, queries, repeats, topk, toxicity, url_rules, words
from pathweave.llm.cluster import connected_components, materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(w):
    return w.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="session")
def docs(spark, sf):
    """The small table with odd rows: null and empty texts, a null id, repeated rows, one very long text, one word repeated."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    some = base.orderBy("doc_id").limit(2).collect()
    odd = [(10**6, None, "en", "odd", None), (10**6 + 1, "", "en", None, 0), (10**6 + 2, " \t\n", None, "odd", 3), (None, "no id here at all", "en", "odd", 1), (10**6 + 3, "a " * 3000, "en", "odd", 6000), (10**6 + 4, "x" * 50_000 + " end", "en", "odd", 1)]
    odd += [(10**6 + 5, some[0].text, "en", "odd", 1), (10**6 + 6, "Ünï çödé 😀 " + (some[1].text or ""), "en", "odd", 1), tuple(some[0]), tuple(some[0])]
    clash = ["key", "size", "component", "spans", "id", "k", "n"]
    return base.unionByName(spark.createDataFrame(odd, DOCS)).withColumns({c: F.lit("clash") for c in clash}).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("local_edges", [1_000_000, 20, 3])
def test_components(spark, local_edges):
    edges = [(1, 2), (2, 3), (9, 9), (5, 7), (7, 6), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = [(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(4), local_edges=local_edges).collect()]
    assert dict(got) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5} | {100 + i: 100 for i in range(41)} and len(got) == len(dict(got))
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long"), local_edges=local_edges).count() == 0


def test_roots_of_edges():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (30, 10), (30, 60), (2000, 1500), (2000, 2300)):
        u, v = rng.integers(-n, n, m), rng.integers(-n, n, m)
        parent = {int(x): int(x) for x in [*u, *v]}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(u.tolist(), v.tolist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        node, root = cluster.roots(u, v)
        assert dict(zip(node.tolist(), root.tolist())) == {x: find(x) for x in parent}
    chain = np.arange(100_000)
    assert (cluster.roots(chain[1:], chain[:-1])[1] == 0).all() and len(cluster.roots(chain[:0], chain[:0])[0]) == 0


def test_words_of_texts():
    import pyarrow as pa

    sample = ["a b", None, "", " \n", "hello\tworld\x0bA B", "é ü", "x" * 10]
    for a, b, w in words.texts(pa.array(sample)):
        for i in range(a, b):
            lo, hi = w.bounds[i - a], w.bounds[i - a + 1]
            assert [bytes(w.data[w.starts[k] : w.ends[k]]).decode() for k in range(lo, hi)] == WORD.findall(sample[i] or "")
        h = w.hashes(lower=True)
        assert h[0] == h[w.bounds[4] + 2] and len(set(h.tolist())) == len({lower(x) for t in sample for x in WORD.findall(t or "")})


# Embedding near duplicates and top-k search


@pytest.fixture(scope="session")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        centre = rng.standard_normal((12, 16))
        for c in centre:
            for spread in (0.0, 0.0, 0.05, 0.1, 0.3, 0.5):
                rows.append((len(rows), (c + spread * rng.standard_normal(16)).astype(np.float32).tolist(), label))
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, rows[0][1], None), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (None, rows[0][1], 0), rows[3]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash")).repartition(3)


def good(e):
    return e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e)


@pytest.mark.parametrize("part_rows", [2048, 4])
def test_embedding_links(spark, vectors, part_rows):
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    use = [i for i, r in enumerate(rows) if r[0] is not None and r[2] is not None and good(r[1])]
    links, parent = Counter(), {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in use:
        for j in use:
            a, b = rows[i], rows[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[i] += 1
                    p, q = find(a[0]), find(b[0])
                    parent[max(p, q)] = min(p, q)
    want = Counter((r[0], links[i], None if r[0] is None else find(r[0])) for i, r in enumerate(rows))
    got = embedding_dedup.near_duplicates(vectors, part_rows=part_rows).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.component_id == r.vec_id) for r in got if r.vec_id is not None)
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_rows_that_share_an_id_have_their_own_vectors(spark):
    rng = np.random.default_rng(2)
    a, b, d = rng.standard_normal((3, 16)).tolist()
    c = (np.array(a) + 0.02 * rng.standard_normal(16)).tolist()
    rows = [(1, a, 0), (1, b, 0), (2, c, 0), (2, c, 0), (1, b, 1), (5, b, 1), (5, None, 0)] + [(7, d, 0)] * 1200
    found = Counter(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert found == {(1, 2, 1, True): 1, (1, 0, 1, True): 1, (2, 2, 1, False): 2, (1, 1, 1, True): 1, (5, 1, 1, False): 1, (5, 0, 5, True): 1, (7, 1199, 7, True): 1200}


def linked(rows, bound=0.93):
    """``vec_id: (n_links, component_id)`` by brute force, of (vec_id, vector, label) with different ids."""
    ids, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    x = np.array([r[1] for r in rows], float)
    square = (x * x).sum(axis=1)
    close = (x @ x.T / np.sqrt(square[:, None] * square) >= bound) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    i, j = np.nonzero(close)
    component = dict(zip(*(z.tolist() for z in cluster.roots(ids[i], ids[j]))))
    return {a: (n, component.get(a, a)) for a, n in zip(ids.tolist(), close.sum(axis=1).tolist())}


def found_links(spark, rows, kind="float", **options):
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors, **options).collect()}


def test_embedding_links_at_the_bound(spark):
    # 93, a, b, c, d has length 100, so its cosine with the first axis is 0.93, which products of unit vectors often miss.
    ends = [(a, b, c, d) for a in range(37) for b in range(a + 1) for c in range(b + 1) for d in range(c + 1) if a * a + b * b + c * c + d * d == 1351]
    rows = [(2 * n + k, v, n) for n, e in enumerate(ends) for k, v in enumerate(([4.0, 0.0, 0.0, 0.0, 0.0], [93.0, *map(float, e)]))]
    got = found_links(spark, rows)
    assert len(ends) == 39 and got == {i: (1, i - i % 2) for i in range(len(rows))}
    together = [(0, [4.0, 0.0, 0.0, 0.0, 0.0], 0)] + [(n, v, 0) for n, v, _ in rows if n % 2]
    got = found_links(spark, together)
    assert got[0] == (39, 0) and got == linked(together)


def test_embedding_links_of_double_vectors(spark):
    rows = [(n, v, n // 2) for n, c in enumerate((0.93 - 1e-10, 0.93 + 1e-10)) for n, v in ((2 * n, [1.0, 0.0]), (2 * n + 1, [c, (1 - c * c) ** 0.5]))]
    assert found_links(spark, rows, "double") == {0: (0, 0), 1: (0, 1), 2: (1, 2), 3: (1, 2)}


def test_embedding_chains_in_one_filter(spark):
    # The middle one is linked with both others, which are not linked with each other.
    angles = {5: 0.0, 10: 20.0, 3: 40.0, 2: 90.0, 12: 110.0, 9: 130.0}
    assert found_links(spark, [(i, [np.cos(np.radians(a)).item(), np.sin(np.radians(a)).item()], 0) for i, a in angles.items()]) == {5: (1, 3), 10: (2, 3), 3: (1, 3), 2: (1, 2), 12: (2, 2), 9: (1, 2)}
    close = np.zeros((40, 40), bool)
    path = np.random.default_rng(4).permutation(40)
    close[path[1:], path[:-1]] = close[path[:-1], path[1:]] = True
    close[path[20], path[21]] = close[path[21], path[20]] = False
    node, root = cluster.roots(*embedding_dedup._spanning(close, np.arange(40), np.arange(40)))
    assert dict(zip(node.tolist(), root.tolist())) == {int(x): int(part.min()) for part in (path[:21], path[21:]) for x in part}


@pytest.mark.parametrize("dims, part_rows", [(1, 2048), (2, 2048), (3, 20), (5, 2048), (8, 2048), (12, 20), (15, 2048), (16, 2048), (16, 12), (64, 2048), (64, 3)])
def test_embedding_links_of_any_dimension(spark, dims, part_rows):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((60, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((60, dims))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    every = np.concatenate([x, 0.935 * x + (1 - 0.935**2) ** 0.5 * z, 0.935 * x - (1 - 0.935**2) ** 0.5 * z]) if dims > 1 else rng.uniform(-1, 1, (180, 1))
    every = every.astype(np.float32)
    rows = [(i, v.tolist(), n % 60 % 3 // 2) for n, (i, v) in enumerate(zip(rng.permutation(180).tolist(), every))]
    assert found_links(spark, rows, part_rows=part_rows) == linked(rows)


def test_filters_miss_no_pair_at_the_threshold():
    rng, code = np.random.default_rng(9), embedding_dedup.ProductCode(64)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((6000, 64))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    missed = [not len(np.intersect1d(a, b)) for a, b in zip(code.decode(x), code.decode(0.93 * x + np.sqrt(1 - 0.93**2) * y))]
    assert sum(missed) <= 1  # about 5 with lists of 24


def test_queries_that_share_an_id(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (20, [9.0, 0.0]), (20, [0.0, 9.0]), (20, [0.0, 9.0])], "vec_id long, embedding array<float>")
    found = topk.exact_top_k(vectors, vectors.where("vec_id = 20").repartition(3), 2, 1.0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(20, 1, 2, 9), (20, 2, 1, 0)]


def test_filters_recall_at_the_threshold():
    rng, code = np.random.default_rng(5), embedding_dedup.ProductCode(64)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((600, 64))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(0.93 * x + np.sqrt(1 - 0.93**2) * y))]
    assert np.mean(met) >= 0.99


def test_decoding_lists_all_exceeding_filters():
    code = embedding_dedup.ProductCode(12, 3, 6, 8)
    x = np.random.default_rng(1).standard_normal((20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for parts, got in zip(code._parts(x), code.decode(x)):
        every = code._outer(parts)
        want = np.flatnonzero(every >= code.threshold)
        assert got.tolist() == (want if len(want) >= embedding_dedup.LEAST else np.sort(np.argsort(-every)[: embedding_dedup.LEAST])).tolist()


@pytest.mark.parametrize("shard_rows", [4096, 17])
def test_top_k(spark, vectors, shard_rows):
    rows = [(r.vec_id, [np.floor(64 * float(x)) for x in r.embedding]) for r in vectors.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    pad = {i: None for i, _ in rows}
    want = Counter()
    for q in sorted(i for i in pad if i % 20 == 0):
        e = next(v for i, v in rows if i == q)
        scores = sorted(((-int(sum(a * b for a, b in zip(e, v))), i) for i, v in rows if i != q))[:20]
        want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scores))
    got = topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, 64.0, shard_rows=shard_rows).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert topk.exact_top_k(vectors.limit(0), vectors, 20).count() == 0


def test_reading_stops_early_on_proof():
    rng = np.random.default_rng(2)
    x = np.zeros((400, 8), np.int64)
    x[np.arange(400), rng.integers(0, 8, 400)] = rng.integers(1, 4, 400)
    x[:25, 0] = 4000 + np.arange(25)
    row, dim = np.nonzero(x)
    value = x[row, dim]
    by = np.lexsort((row, value, dim, -np.abs(value)))
    row, dim, value = row[by].astype("<i4"), dim[by], value[by]
    first = np.flatnonzero(np.concatenate([[True], (dim[1:] != dim[:-1]) | (value[1:] != value[:-1])]))
    seg = np.zeros(len(first), topk._SEGMENT)
    seg["dim"], seg["impact"], seg["begin"], seg["end"] = dim[first], value[first], first, np.append(first[1:], len(row))
    q = np.array([[5.0, 1, 0, 0, 0, 0, 0, 0]])
    _, rows, scores = topk.search_shard(np.arange(400), seg, row, np.array([399]), q, 20)
    assert set(rows.tolist()) == set(range(5, 25)) and sorted(scores.tolist()) == sorted((x[5:25] @ q[0]).astype(int).tolist())


# N-gram Jaccard join


def jaccard_classes(rows, k, percent):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = [lower(x) for x in WORD.findall(t or "")]
        sets[n] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(rows[a][0]), find(rows[b][0])
                    parent[max(p, q)] = min(p, q)
    return Counter((i, len(sets[n]), None if i is None else find(i)) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("frequent", "part_rows", "part_tokens"), [(96, 2048, 1 << 22), (2, 3, 300)])
def test_jaccard_classes(docs, empty, monkeypatch, frequent, part_rows, part_tokens):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "FREQUENT_MEANS", 0)
    monkeypatch.setattr(jaccard, "CLASS_STEP", 3)
    monkeypatch.setattr(jaccard, "PART_TOKENS", part_tokens)
    monkeypatch.setattr(jaccard._candidates, "__defaults__", (part_rows,))
    monkeypatch.setattr(jaccard._cluster_links, "__defaults__", (part_rows,))
    rows = rows_of(docs)
    got = jaccard.near_duplicate_classes(docs, shingle=4, percent=85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_classes(rows, 4, 85)
    assert jaccard.near_duplicate_classes(empty).count() == 0


@pytest.mark.parametrize(("part_rows", "copies"), [(1024, 1), (7, 1), (7, 30)])
def test_jaccard_of_a_group_whose_members_hardly_link(spark, monkeypatch, part_rows, copies):
    """Variants of one text around the threshold: nearly all pairs are candidates, few of them link, and edges stay few."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.choice(120, 1 + i % 3, replace=False):
            words[at] = f"x{i}-{at}"
        rows += [(1000 * i + c, " ".join(words)) for c in range(copies if i == 5 else 1)]
    monkeypatch.setattr(jaccard._candidates, "__defaults__", (part_rows,))
    monkeypatch.setattr(jaccard._cluster_links, "__defaults__", (part_rows,))
    sent = []

    def edges(clusters, docs, shingle, percent, was=jaccard._cluster_links):
        out = was(clusters, docs, shingle, percent)
        sent.append((clusters.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, "_cluster_links", edges)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicate_classes(table, shingle=4, percent=93).collect()
    want = jaccard_classes(rows, 4, 93)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    parts = -(-90 // part_rows) + 1
    assert sent[0][1] <= sent[0][0] * parts


def test_histograms_bound_the_distance_of_sets():
    rng = np.random.default_rng(13)
    for n, m in ((40, 70), (900, 1100), (3000, 9000), (500_000, 520_000)):
        x, y = (np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) for size in (n, m))
        y[: n // 3] = x[: n // 3]
        y = np.unique(y)
        a, b = jaccard.histogram(x), jaccard.histogram(y)
        size = min(len(a), len(b))
        assert np.array_equal(jaccard.folded(b, size), np.minimum(np.bincount((y & np.uint64(size - 1)).astype(np.int64), minlength=size), 255))
        assert np.abs(jaccard.folded(a, size) - jaccard.folded(b, size)).sum() <= len(np.setxor1d(x, y))


def test_block_links_equal_brute_force():
    rng = np.random.default_rng(12)
    for side_of in (0, 1):
        sets = [np.unique(rng.integers(0, 60, rng.integers(20, 60))).astype(np.uint64) for _ in range(40)]
        k = rng.integers(0, 6, 40)
        side = np.array([1 + i % 2 for i in range(40)]) if side_of else np.zeros(40, int)
        x, y = jaccard.block_links(sets, k, side, 60)
        linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))
        pairs = [(a, b) for a in range(40) for b in range(a) if k[a] != k[b] and (side[a] == 0 or side[a] != side[b]) and linked(a, b)]

        def classes(edges):
            at = list(range(40))
            for a, b in edges:
                at = [min(at[a], at[b]) if c in (at[a], at[b]) else c for c in at]
            return at

        assert all(linked(a, b) for a, b in zip(x, y)) and len(x) < 40
        assert classes(zip(x, y)) == classes(pairs)


def test_signatures_of_linking_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(150):
        n = int(rng.integers(7, 200))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = x.copy()
        errors = len(x) * 15 // 200
        y[rng.choice(len(y), errors, replace=False)] = rng.integers(0, 2**63, errors, dtype=np.uint64)
        y = np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both < 85 * (len(x) + len(y) - both) or np.array_equal(x, y):
            continue
        first, last = np.zeros(jaccard.COUNTERS, bool), np.zeros(jaccard.COUNTERS, bool)
        chosen = np.concatenate([x, y])[rng.random(len(x) + len(y)) < rng.random()]
        first[jaccard._counter(chosen)] = True
        last[jaccard._counter(chosen[: len(chosen) // 3])] = True
        scheme = jaccard.Scheme(85, first, last)
        a, b = (np.concatenate(scheme.signatures(s)) for s in (x, y))
        assert len(np.intersect1d(a, b))


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_of_small_sets_inside_larger_ones_meet(percent):
    rng = np.random.default_rng(5)
    pairs = [(n, m) for m in range(2, 13) for n in range(1, m) if 100 * n >= percent * m]
    assert (4, 5) in pairs if percent == 80 else (6, 7) in pairs
    for n, m in pairs * 40:
        y = np.unique(rng.integers(0, 2**63, m, dtype=np.uint64))
        x = np.sort(rng.choice(y, n, replace=False))
        first, last = np.zeros(jaccard.COUNTERS, bool), np.zeros(jaccard.COUNTERS, bool)
        first[jaccard._counter(y[rng.random(m) < rng.choice([0, 0.5, 1])])] = True
        last[jaccard._counter(y[rng.random(m) < rng.choice([0, 0.5, 1])])] = True
        scheme = jaccard.Scheme(percent, first, last & first)
        a, b = (np.concatenate(scheme.signatures(s)) for s in (x, y))
        assert len(np.intersect1d(a, b)), (n, m)


@pytest.mark.parametrize(("shingle", "percent", "size"), [(4, 85, 9), (5, 80, 8)])
def test_jaccard_links_a_small_set_inside_a_larger_one(spark, shingle, percent, size):
    said = [f"w{i}" for i in range(size)]
    rows = [(1, " ".join(said)), (2, " ".join([*said, "more"])), (3, " ".join(said[:5]))]
    got = jaccard.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=shingle, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_classes(rows, shingle, percent)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


# Repeated passages


def without_repeats(rows, window):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[j : j + window]) for _, w in split for j in range(len(w) - window + 1))
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("window", "shard_words"), [(35, 1 << 20), (12, 500)])
def test_repeats(docs, empty, window, shard_words):
    got = repeats.remove_repeats(docs, window=window, shard_words=shard_words).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == without_repeats(rows_of(docs), window)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.remove_repeats(empty).count() == 0


def test_a_common_phrase_does_not_fill_one_index(spark, monkeypatch):
    rng = np.random.default_rng(6)
    made = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    phrase, tail = made(10), made(6)
    rows = [(i, " ".join([*made(15), *phrase, *(tail if i % 7 == 0 else made(6)), *made(9)])) for i in range(80)]
    rows += [(100, rows[1][1]), (101, rows[2][1]), (101, rows[2][1]), (102, " ".join([*made(3), *rows[3][1].split()[10:30], *made(3)]))]
    most = []

    def search(parts, window, shard_words, was=repeats._search):
        most.append(parts.groupBy("anchor").agg(F.sum(F.size(F.split("words", " "))).alias("n")).agg(F.max("n")).first()[0] or 0)
        return was(parts, window, shard_words)

    monkeypatch.setattr(repeats, "_search", search)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=12, shard_words=100).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == without_repeats(rows, 12)
    assert max(most) <= 100


@pytest.mark.parametrize("window", [35, 64, 65, 100])
def test_windows_longer_than_the_depth(window):
    rng = np.random.default_rng(window)
    for _ in range(25):
        parts, bounds = [], [0]
        shared = rng.integers(1, 4, 160)
        for _ in range(5):
            at = rng.integers(0, 60)
            body = np.concatenate([rng.integers(1, 30, rng.integers(0, 40)), shared[at : at + rng.integers(60, 100)], rng.integers(1, 30, rng.integers(window, 120))])
            parts.append(np.append(body, 0))
            bounds.append(bounds[-1] + len(body) + 1)
        text = np.concatenate(parts)
        starts = np.array(bounds[:-1])
        counts = np.diff(bounds) - 1 - window + 1
        keep = counts > 0
        starts, counts = starts[keep], counts[keep]
        got = fm_index.repeated_windows(fm_index.FMIndex(text, max(window, fm_index.DEPTH)), text, starts, counts, window)
        windows = [tuple(text[s + j : s + j + window]) for s, c in zip(starts, counts) for j in range(c)]
        every = Counter(tuple(text[j : j + window]) for j in range(len(text) - window + 1) if 0 not in text[j : j + window])
        assert got.tolist() == [every[w] > 1 for w in windows]


def test_index_counts_patterns():
    rng = np.random.default_rng(0)
    text = np.concatenate([np.append(rng.integers(1, 4, 60), 0) for _ in range(8)])
    index = fm_index.FMIndex(text)
    flat = ",".join(map(str, text.tolist())) + ","
    for n in (1, 3, 6):
        for start in range(0, 50, 7):
            pattern = text[start : start + n]
            low, high = np.array([0]), np.array([index.size])
            for c in pattern[::-1]:
                low, high = index.extend(np.array([c]), low, high)
            want = sum(np.array_equal(text[i : i + n], pattern) for i in range(len(text) - n + 1))
            assert high[0] - low[0] == want and flat


# URLs


def test_url_rules(spark):
    rules = queries.URL_RULES
    urls = ["http://example.com/en/7", "https://a.b.EXAMPLE.com/en/71?x#y", "http://com/en/", "http://xcom/en/", "ftp://example.net/de/8", "http://example.net/de/9", "http://net#/de/", "x", "", None, "http://", "a://b://c/d", "http://notexample.com/en/7", "http://org:80/es/", "http://m.org/es/\n1", "http://m.org/ES/", "http://.com/en/"]
    pages = spark.createDataFrame([(i % 15, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, part string")
    want = Counter()
    for i, u in [*((i % 15, u) for i, u in enumerate(urls)), (0, urls[0])]:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = lower(re.match(r"[^/?#]*", rest).group())
            path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest).group()) :]).group()
        best = max(((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        want[i, host, path, best[1] if best else None, best[2] if best else "allow"] += 1
    for part_rows in (100_000, 3):
        got = url_rules.judge_urls(pages, url_rules.rules_frame(spark, rules), part_rows=part_rows)
        assert Counter(tuple(r) for r in got.collect()) == want
    assert url_rules.judge_urls(pages.limit(0), url_rules.rules_frame(spark, rules)).count() == 0


# Personal data


def luhn(x):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (2 * int(c) > 9)) for i, c in enumerate(reversed(x))) % 10 == 0


def base_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(len(x.lstrip("0")) > 3 or int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, docs, empty):
    extra = ["mail x@y.z@q.com a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 " + "1" * 4000, "é😀 4111-1111 1111 1111 x 4111 1111 1111 1112 +1 (23) 456-7890) @@ a@-.-b +49 " + " " * 500 + "1234567", "a" * 3000 + "@"]
    table = docs.select("doc_id", "text", "id").unionByName(spark.createDataFrame([(2 * 10**6 + i, t, "clash") for i, t in enumerate(extra)], "doc_id long, text string, id string"))
    got = defaultdict(list)
    for r in personal_data.summary(personal_data.find_spans(table)).collect():
        got[r.doc_id].append(r)
    for i, t in rows_of(table):
        want = base_spans(t or "")
        r = next(r for r in got[i] if r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest())
        assert set(want) <= set(r.spans.split(",")) | {""} and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in personal_data.KINDS]
    assert personal_data.summary(personal_data.find_spans(empty)).count() == 0


def test_spans_of_long_lists(spark):
    """Offsets and surroundings across the pieces in which spans are folded."""
    rng = np.random.default_rng(3)
    gaps = ["", "a", "Ünï ", "x y z ", "a gap of more than thirty code points 😀 for sure ", "\n"]
    made = ["".join(gaps[rng.integers(6)] + ["12", "7", "999"][rng.integers(3)] for _ in range(n)) for n in (0, 1, 2, 255, 256, 257, 513, 1200)]
    rows = list(enumerate([*made, "é12", "12é", "12 34 ", None]))
    text = F.coalesce("t", F.lit(""))
    for r in spark.createDataFrame(rows, "i int, t string").select("t", personal_data.match_spans(text, "[0-9]+", F.lit(True)).alias("m")).collect():
        t = r.t or ""
        assert [tuple(x) for x in r.m] == [(m.start(), m.end(), m.group(), t[max(0, m.start() - 30) : m.start()], t[m.end() : m.end() + 1]) for m in re.finditer("[0-9]+", t)]


def test_spans_apart_and_masked_in_pieces(spark):
    rng = np.random.default_rng(4)

    def spans(n, room=5):
        at, out = 0, []
        for _ in range(n):
            start = at + int(rng.integers(0, room))
            at = start + int(rng.integers(1, 6))
            out.append((start, at))
        return out

    pairs = [(spans(a), spans(b)) for a in (0, 3, 300, 700) for b in (0, 3, 300, 700)]
    kind = "array<struct<start:int,end:int>>"
    for r in spark.createDataFrame(pairs, f"a {kind}, b {kind}").select("a", "b", personal_data.apart(F.col("a"), F.col("b")).alias("o")).collect():
        assert [tuple(x) for x in r.o] == [tuple(x) for x in r.a if not any(y.start < x.end and x.start < y.end for y in r.b)]

    text = "".join(chr(int(c)) for c in rng.choice([97, 98, 228, 128512, 32], 9000))
    rows = [(text, *[spans(n, 20) for n in counts]) for counts in ((300, 300, 3, 200), (0, 0, 0, 0), (0, 700, 0, 0), (1, 0, 1, 0))]
    schema = "text string, " + ", ".join(f"{k} {kind}" for k in personal_data.KINDS)
    for r in spark.createDataFrame(rows, schema).select("*", personal_data.masked(F.col("text")).alias("masked")).collect():
        at, out = 0, ""
        for start, back, mark in sorted((s.start, -s.end, f"[{k.upper()}]") for k in personal_data.KINDS for s in r[k]):
            if start >= at:
                at, out = -back, out + r.text[at:start] + mark
        assert r.masked == out + r.text[at:]


def test_time_grows_with_the_spans_of_a_text(spark):
    def seconds(n):
        line = "mail user{0}@host{0}.com from 10.0.{1}.{1} call +49 30 {0}  or user{0} at host dot com"
        frame = spark.createDataFrame([(1, "\n".join(line.format(10_000 + i, i % 250) for i in range(n)))], "doc_id long, text string")
        began = time.time()
        found = personal_data.find_spans(frame, keep=("text",))
        (row,) = found.select(*[F.size(k).alias(k) for k in personal_data.KINDS], personal_data.masked(F.col("row.text")).alias("masked")).collect()
        assert (row.ip, row.phone) == (n, n) and row.email >= n and row.masked.count("[IP]") == n
        return time.time() - began

    seconds(50)
    small, large = seconds(1500), seconds(12_000)  # 36,000 base spans and 12,000 loose ones in a megabyte
    assert large < 8 * max(small, 1.0) * 2.5


def test_votes_tell_obfuscated_spans():
    counts = [("email", (1, 1, -1, 1, 1), 200), ("email", (-1, 1, 1, 1, 1), 9), ("card", (0, 0, -1, 1, 0), 300), ("card", (1, 1, -1, 1, 1), 150), ("email", (-1, 0, 0, 0, 0), 40)]
    belief = personal_data.reliabilities(counts)
    assert belief["email", (-1, 1, 1, 1, 1)] > 0.9 > 0.1 > belief["card", (0, 0, -1, 1, 0)] and belief["email", (-1, 0, 0, 0, 0)] < 0.1


def test_obfuscated_spans_are_added(spark, sf):
    """Spelled and oddly grouped personal data planted beside decoys: recall and precision of what the method adds to the base."""
    rng = np.random.default_rng(8)
    names = ["jane", "omar", "li", "piotr", "ana"]

    def number(valid):
        while True:
            d = "4" + "".join(map(str, rng.integers(0, 10, 15)))
            if luhn(d) == valid:
                return f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}"

    good, bad = [], []
    for i in range(40):
        n = names[i % 5]
        good += [("email", "please write to ", f"{n}{i} (at) host{i} (dot) com"), ("email", "contact ", f"{n}.{i} [at] mail{i}.org"), ("ip", "login from host ", f"10 (dot) {i} (dot) 7 (dot) {i + 1}"), ("card", "paid by credit card ", number(True)), ("phone", "call my phone ", f"(555) 123-4{100 + i}")]
        bad += [("card", "see part ", number(False)), ("ip", "section ", f"4 (dot) {300 + i} (dot) 999 (dot) {400 + i}")]
    rows = [(10**7 + j, f"é {before}{span} , thanks") for j, (_, before, span) in enumerate(good + bad)]
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.spans for r in personal_data.summary(personal_data.find_spans(table)).where("doc_id >= 10000000").collect()}
    want = {10**7 + j: f"{kind}:{2 + len(before)}:{2 + len(before) + len(span)}" for j, (kind, before, span) in enumerate(good)}
    found = sum(want[i] in got[i].split(",") for i in want)
    added = sum(len([x for x in s.split(",") if x]) for s in got.values())
    assert found >= 0.9 * len(want) and found >= 0.9 * added


def test_patterns_bear_long_repeats(spark):
    parts = ["a(at)b" + ".cc" * 30000, "a@b" + ".c" * 30000, "1111-" * 30000, "a at b dot " * 30000, "+1" + " 2" * 30000, "111 " * 30000, "a" * 30000 + "@"]
    table = spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string")
    got = {r.doc_id: [r.n_email, r.n_ip, r.n_card, r.n_phone] for r in personal_data.summary(personal_data.find_spans(table)).collect()}
    assert got == {i: [int(i == 1), 0, 0, 0] for i in range(len(parts))}


# Quality, toxicity


def test_quality_parts_labelled_rows(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.resample(docs, labels)
    assert got.count() == docs.count()
    marked = got.join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in marked]) > 0.97
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality.resample(docs, labels, keep=0.25).where("kept").count() in range(round(0.25 * docs.count()), round(0.25 * docs.count()) + 4)
    assert quality.resample(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_importance_and_resampling_by_brute_force(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    grams = {}
    for i, t in rows:
        word, shape = [lower(x) for x in WORD.findall(t or "")], []
        for _, _, w in words.texts(__import__("pyarrow").array([t])):
            shape = quality._shapes(w).tolist()
        near = [next((k for k in (1, 2, 3) if k <= j and word[j - k] == word[j]), 0) for j in range(len(word))]
        shape = list(zip(shape, near))
        grams[i] = [("w", *word[j : j + n]) for n in (1, 2) for j in range(len(word) - n + 1)] + [("s", *shape[j : j + n]) for n in (1, 2, 3) for j in range(len(word) - n + 1)]
    got = {r.doc_id: r for r in quality.resample(table, labels, keep=0.3).collect()}
    number = {}  # bucket of each n-gram, learned from texts that hold it
    for i, t in rows:
        for a, b, w in words.texts(__import__("pyarrow").array([t])):
            number.update(zip(grams[i], quality.features(w)[0].tolist()))
    raw, target = Counter(number[g] for i in grams for g in grams[i]), Counter(number[g] for i in grams if i in good for g in grams[i])
    log = lambda c, b: np.log((c[b] + 1) / (sum(c.values()) + quality.BUCKETS))
    model = {b: log(target, b) - log(raw, b) for b in raw}
    for i in grams:
        assert got[i].log_weight == pytest.approx(sum(model[number[g]] for g in grams[i]), abs=1e-6)
    k = round(0.3 * len(rows))
    assert {i for i, r in got.items() if r.kept} == set(sorted(got, key=lambda i: -got[i].key)[:k])
    moved = [r.key - r.log_weight / len(grams[i]) for i, r in got.items() if grams[i]]
    assert np.mean(moved) == pytest.approx(0.5772 * quality.TEMPERATURE, abs=0.006)


def test_kth_largest(spark):
    values = [float(v) for v in np.random.default_rng(1).standard_normal(500)] + [1.0] * 40
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, t long")
    order = sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1]))
    for k in (1, 77, 100, 120, 540, 9999):
        assert quality.kth_largest(df, "v", "t", k) == order[min(k, 540) - 1]
    assert quality.kth_largest(df, "v", "t", 0) is None


def test_toxicity(spark, sf, docs):
    rng = np.random.default_rng(0)
    clean = ["the", "and", "of", "table", "green", "house", "window", "letter", "water", "paper"]
    bad = ["moronic", "idiotic", "scumbag"]
    text = lambda extra: " ".join([*rng.choice(clean, 30).tolist(), *extra])
    rows = [(i, text(rng.choice(bad, 2).tolist() if i % 4 == 0 else [])) for i in range(600)]
    probe = [(1001, text(["idi-otic"])), (1002, text(["s.c.u.m.b.a.g"])), (1003, text(["m o r o n i c"])), (1004, text([])), (1005, None), (1006, "")]
    table = spark.createDataFrame(rows + probe, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_texts(table, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i, _ in rows)
    assert [got[i].predicted for i, _ in probe] == [1, 1, 1, 0, 0, 0] and all(0 <= r.score <= 1 for r in got.values())
    held = {r.doc_id for r in table.where("crc32(cast(doc_id as string)) % 3 = 1").collect()}
    assert {i for i, r in got.items() if r.held_out} == held
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score_texts(table, flipped).collect()} == {i: r.score for i, r in got.items()}
    assert toxicity.score_texts(docs, labels.limit(0)).count() == docs.count()


def test_kernel_equals_its_definition():
    def phi(w):
        out = defaultdict(float)
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, len(w)):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    for a, b in (("banana", "bandana"), ("idiot", "idxiot")):
        x, y = phi(a), phi(b)
        want = sum(x[u] * y[u] for u in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        assert toxicity.embed(a.encode()) @ toxicity.embed(b.encode()) == pytest.approx(want)


# Packing, mixing, pipeline


def test_packing_places_every_word_once(docs, empty):
    got = packing.pack(docs, lengths=(64, 256, 1024), group_rows=100).collect()
    placed, bins = defaultdict(int), defaultdict(list)
    for r in got:
        placed[r.doc_id] += r.n_words
        if r.n_words:
            bins[r.bin_id].append((r.bin_offset, r.n_words, r.bin_length))
    want = defaultdict(int)
    for i, t in rows_of(docs):
        want[i] += len(WORD.findall(t or ""))
    assert placed == want
    for parts in bins.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[0][0] == 0
        used, length = parts[-1][0] + parts[-1][1], parts[0][2]
        assert length == min(c for c in (64, 256, 1024) if c >= used)
    assert sum(want.values()) / sum(p[0][2] for p in bins.values()) > 0.9
    assert packing.pack(empty).count() == 0


def test_opened_lengths_follow_what_remains():
    rng = np.random.default_rng(14)
    for _ in range(60):
        sizes = rng.integers(1, 60, rng.integers(1, 40))
        lengths = (16, 32, 64)
        bins, offsets, after = packing.best_fit(sizes, lengths)
        order, left, open_ = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sorted(sizes.tolist()), []
        for i in order:
            left.remove(sizes[i])
            fits = [(free - sizes[i], b) for b, (free, _) in enumerate(open_) if free >= sizes[i]]
            if fits:
                b = min(fits)[1]
            else:
                def cost(c):
                    room = c - sizes[i]
                    for x in sorted(left, reverse=True):
                        room -= x if x <= room else 0
                    return packing.bin_cost(c, 64) / (c - room), c

                b = len(open_)
                open_.append([min((c for c in lengths if c >= sizes[i]), key=cost), 0])
            assert bins[i] == b and offsets[i] == open_[b][1]
            open_[b] = [open_[b][0] - sizes[i], open_[b][1] + sizes[i]]
        assert after == [min(c for c in lengths if c >= used) for _, used in open_]


def test_longer_bins_win_and_shrink(monkeypatch):
    rng = np.random.default_rng(15)
    sizes = np.minimum(1 + rng.geometric(1 / 300, 4000), 8192)
    shrunk = packing.best_fit(sizes)[2]
    assert Counter(shrunk).most_common(1)[0][0] == 2048 and len(set(shrunk)) > 1
    assert max(packing.best_fit(np.array([600, 10]))[2]) == 1024 and packing.best_fit(np.array([8192]))[2] == [8192]


def test_packing_of_other_ids_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PIECE_ROWS", 7)
    rows = [(None, "a b c")] * 40 + [("x", "d"), ("y", None), ("x", "d")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id string, text string"), lengths=(4, 8), group_rows=10).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len((t or "").split())) for i, t in rows)
    assert len({r.bin_id >> 32 for r in got if r.bin_id is not None}) > 2


def test_mixing(docs, empty):
    got = mixing.balanced_mix(docs, block_rows=20).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, active = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    left = float(sum(sizes.values()))
    while active:
        level = left / sum(weight[s] for s in active)
        over = {s for s in active if level * weight[s] > 3 * sizes[s]}
        for s in over or active:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        active = active - over if over else set()
    by_target = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size
        by_target[round(r.target, 3), r.source_size] += r.taken
    half = {sizes[s]: max(len(WORD.findall(r.text or "")) for r in docs.collect() if r.source == s) / 2 for s in names}  # ten documents a source
    wanted = {(round(target[s], 3), sizes[s]) for s in names}
    many = {sizes[s] for s in names if s not in (None, "odd")}
    assert set(by_target) == wanted
    assert not [(t, n, v, half[n]) for (t, n), v in by_target.items() if n in many and abs(v - t) > half[n]]
    again = mixing.balanced_mix(docs.repartition(7), block_rows=20).collect()
    key = lambda rows: Counter((r.doc_id, r["size"], r.taken) for r in rows)
    assert key(got) == key(again)
    assert mixing.balanced_mix(empty).count() == 0


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_sources_end_at_their_targets(spark, sf, table):
    rows = mixing.balanced_mix(spark.read.parquet(f"{sf}/../{table}/documents.parquet"))
    for r in rows.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.expr("percentile(size, 0.5)").alias("middle")).collect():
        assert abs(r.taken - r.target) <= max(0.01 * r.target, r.middle)


def test_equal_rows_are_drawn_by_number(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PIECE_ROWS", 7)
    rows = [(None, "a b c", "x")] * 400 + [(i, "d " * (i % 9), "y") for i in range(50)] + [(7, "e f", "z")] * 3
    got = mixing.balanced_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    hot = [r for r in got if r.doc_id is None]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= 3 and max(r.copies for r in hot) - min(r.copies for r in hot) <= 1


def test_flight_keeps_totals():
    rng = np.random.default_rng(6)
    sizes, p = rng.integers(1, 500, 300), rng.random(300)
    q = mixing.fly(sizes, p, 1)
    assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and (q * sizes).sum() == pytest.approx((p * sizes).sum())


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
        seen[name] = docs
    assert not [r for r in seen["quality"].collect() if labels.get(r.doc_id) == 0]
    rows = [(r.doc_id, r.text) for r in seen["quality"].collect()]
    classes = jaccard_classes(rows, 5, 80)
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == {c for _, _, c in classes}
    for r in seen["personal_data"].collect():
        assert not base_spans(r.text)
    assert set(seen["mixing"].columns) == set(corpus_pipeline.COLUMNS)
    assert seen["packing"].agg(F.sum("n_words")).first()[0] == sum(len(WORD.findall(r.text or "")) for r in seen["mixing"].collect())


def test_pipeline_stages_bear_odd_rows(spark, docs, sf):
    """Nulls, empties, repeats, long texts and clashing columns go through each stage; an empty table stays empty."""
    import corpus_pipeline

    named = list(corpus_pipeline.COLUMNS)
    repeated = docs.unionByName(docs.where("doc_id is null")).unionByName(docs.where("doc_id is null"))
    before = materialize(repeated)
    n = before.count()
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, before, sf))
        assert name == "packing" or out.columns == named
        if name == "near_duplicates":
            assert out.where("doc_id is null").count() == before.where("doc_id is null").count()
            assert out.where("doc_id is not null").count() == out.select("doc_id").where("doc_id is not null").distinct().count()
        if name == "personal_data":
            assert out.count() == n and out.where("text is null").count() == before.where("text is null").count()
        if name == "mixing":
            want = mixing.balanced_mix(before).agg(F.sum("copies"), F.sum("taken")).first()
            got = out.agg(F.count(F.lit(1)), F.sum(mixing.word_count(F.col("text")))).first()
            assert tuple(got) == tuple(want)
        assert stage(spark, none, sf).count() == 0
        before, n = out, out.count()
