from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.llm import ngram_join
from veilmark.llm.ann import ListBlock, lay_shards, lifted, measured_probes, nearest
from veilmark.llm.embedding_dedup import decode, embedding_near_duplicates, encode, lay_cells
from veilmark.llm.ngram_join import index_entries, ngram_jaccard_join
from veilmark.llm.shared import components
from veilmark.llm.texthash import mix, shingle_sets
from veilmark.llm.vectors import centroids, rotation


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    pairs = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    found = roots(sets, pairs)
    return {i: (len(s), found[i]) for i, s in sets.items()}


@pytest.mark.parametrize("options", [{}, {"frequent": 2, "per_posting": 0}, {"frequent": 1, "share": 100}])
def test_join_equals_brute_force(docs, options):
    """With small limits tokens are of the frequent class, and pairs of them are indexed."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs, **options).collect()}
    assert got == brute(rows)


def test_join_of_a_hot_group(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"n{rng.randrange(500)}"
        rows.append((k, " ".join(w)))
    rows += [(500 + k, " ".join(base[:30] + [f"o{k}-{j}" for j in range(40)])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({}, {"frequent": 5, "per_posting": 0}, {"frequent": 1}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, **options).collect()}
        assert got == brute(rows)


def test_join_of_nothing(empty):
    assert ngram_jaccard_join(empty).count() == 0
    with pytest.raises(ValueError):
        ngram_jaccard_join(empty, ratio=(1, 2))


def test_join_of_few_words(spark):
    """Blocks of fewer words in all than a shingle has."""
    for n in range(1, 7):
        assert [len(x) for x in shingle_sets(["a b c d e f"[: 2 * n - 1]])] == [max(1, n - 4)]
    for rows in ([(7, "one two three")], [(7, None), (8, "one  Two three"), (9, "")]):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
        assert got == brute(rows)


def test_linked_sets_share_an_entry():
    """Whatever tokens are frequent, the index loses no link, and it is linear."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        size = int(rng.integers(2, 60))
        base = rng.permutation(400)[:size]
        sets = []
        for _ in range(12):
            keep = base[rng.random(size) < rng.choice([0.8, 0.9, 0.97])]
            sets.append(mix(np.unique(np.concatenate([keep, rng.integers(400, 420, rng.integers(0, 4))])).astype(np.uint64)))
            sets[-1].sort()
        every = np.unique(np.concatenate(sets))
        frequent = every[rng.random(len(every)) < rng.choice([0, 0.3, 0.6, 0.9, 1])]
        entry, owner, rest, mixed = index_entries(sets, frequent, (75, 100))
        own = [set(entry[owner == k].tolist()) for k in range(len(sets))]
        assert all(len(e) <= len(s) for e, s in zip(own, sets, strict=True))
        for a in range(12):
            for b in range(a):
                both, union = len(np.intersect1d(sets[a], sets[b])), len(np.union1d(sets[a], sets[b]))
                if union and 100 * both >= 75 * union and both < union:
                    assert own[a] & own[b]
                    shared = sum(e % 2 == 0 for e in own[a] & own[b])
                    assert shared + (min if mixed[a] and mixed[b] else max)(rest[a], rest[b]) >= both


def test_join_finds_links_between_other_sets_than_leaders(spark):
    """One passage in many sets, of which some are linked with each other only."""
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for k in range(40):
        own = [f"o{k // 2}-{j}" for j in range(40)]
        rows.append((k, " ".join(passage + own[: 40 - k % 2])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"frequent": 3, "per_posting": 0}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, **options).collect()}
        assert got == brute(rows)
        assert len({c for _, c in got.values()}) == 20


def test_words_that_collide_in_polynomial_hashes_are_no_copies(spark):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    rows = [(1, f"{word} one two three four five"), (2, f"{word.translate(str.maketrans('ab', 'ba'))} one two three four five"), (3, word), (4, word.translate(str.maketrans("ab", "ba")))]
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_join_of_rows_without_or_with_repeated_ids(spark):
    """Null doc_ids stay alone; a repeated doc_id joins the classes of its rows."""
    a, b = "a b c d e f g h", "q r s t u v w x"
    rows = [(None, a), (5, a), (7, b), (5, b), (None, None), (9, None), (9, "z"), (2, "z")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_shingles int, token string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_jaccard_join(df).collect())
    assert got == [(0, 0, 0), (0, 4, 0), (2, 1, 2), (5, 4, 5), (5, 4, 5), (7, 4, 5), (9, 0, 9), (9, 1, 2)]


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 380)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == roots({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((6, 16))
    x = centre[rng.integers(0, 6, 150)] + rng.standard_normal((150, 16)) * rng.choice([0.1, 0.35, 1.0], (150, 1))
    rows = [(int(k * 3), [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(1000 + k, rows[0][1]) for k in range(40)]  # copies
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (2006, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit("x")), rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicate_vectors_equal_brute_force(vectors, monkeypatch, small):
    if small:
        for name, value in (("CELL_ROWS", 20), ("HOME_BLOCK", 8), ("POSTED_BLOCK", 16)):
            monkeypatch.setattr(f"veilmark.llm.embedding_dedup.{name}", value)
    df, rows = vectors
    good = {i: np.array(v) for i, v in rows if usable(v)}
    pairs = [
        (a, b) for a in good for b in good
        if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9
    ]
    found = roots([i for i, _ in rows], pairs)
    links = {i: sum(i in p for p in pairs) for i, _ in rows}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(df).collect()}
    assert got == {i: (links[i], found[i], found[i] == i) for i, _ in rows}


@pytest.mark.parametrize("rank", [4, 6])
def test_near_duplicates_near_a_subspace(spark, monkeypatch, rank):
    """Where vectors differ in few dimensions only, links cross cell borders far."""
    for name, value in (("CELL_ROWS", 50), ("HOME_BLOCK", 300), ("POSTED_BLOCK", 700)):
        monkeypatch.setattr(f"veilmark.llm.embedding_dedup.{name}", value)
    rng = np.random.default_rng(rank)
    x = rng.standard_normal((2000, rank)) @ np.linalg.qr(rng.standard_normal((64, rank)))[0].T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    found = roots(range(2000), zip(a.tolist(), b.tolist(), strict=True))
    links = np.bincount(np.concatenate([a, b]), minlength=2000)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_near_duplicates(df).collect()}
    assert got == {k: (links[k], found[k]) for k in range(2000)}


def test_codes_estimate_cosines_without_bias():
    """Over many vectors the errors average out, and none is beyond its bound."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 48))
    y = x + rng.standard_normal((3000, 48)) * rng.choice([0.2, 0.5, 3.0], (3000, 1))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    bits, factor = encode(y)
    assert bits.shape == (3000, 6)  # a bit a dimension
    scaled, bound = decode(bits, factor, 48, 0.9)
    guess, cosine = ((x @ rotation(48).T) * scaled).sum(axis=1), (x * y).sum(axis=1)
    assert abs((guess - cosine).mean()) < 0.01
    assert (guess[cosine >= 0.9] >= bound[cosine >= 0.9]).all() and (guess < bound).any()


def test_vectors_without_a_key(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [2.0, 0.0]), (None, None)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in embedding_near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, None, False)] * 2 + [(4, 1, 2, False), (2, 1, 2, True)], key=str)
    near = nearest(df, F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id) for r in near) == [(2, 4), (4, 2)]


def test_cells_share_shards(monkeypatch):
    monkeypatch.setattr("veilmark.llm.embedding_dedup.HOME_BLOCK", 10)
    monkeypatch.setattr("veilmark.llm.embedding_dedup.POSTED_BLOCK", 20)
    place, sizes = lay_cells({-3: (4, 4), 0: (6, 30), 1: (4, 25), 2: (25, 35), 3: (0, 10), 4: (3, 5)})
    assert place == {-3: -3, 0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
    assert sizes == {-3: (1, 1), 0: (1, 2), 1: (3, 2), 2: (1, 1)}


@pytest.mark.parametrize("small", [False, True])
def test_neighbours(vectors, monkeypatch, small):
    if small:
        for name, value in (("SHARD_ROWS", 30), ("QUERY_BLOCK", 4)):
            monkeypatch.setattr(f"veilmark.llm.ann.{name}", value)
    df, rows = vectors
    got = {}
    for r in nearest(df, F.col("vec_id") % 2 == 0, k=5, probed=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v) for i, v in rows if usable(v)}
    hit = total = 0
    for q in (i for i in good if i % 2 == 0):
        best = sorted(((-(good[q] * v).sum(), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:5]
        own = sorted(got.get(q, []))
        assert [r for r, *_ in own] == list(range(1, len(best) + 1))
        assert all(abs(s - (good[q] * good[i]).sum()) < 1e-12 for _, i, s in own)
        hit += len({i for _, i, _ in own} & {i for _, i in best})
        total += len(best)
    assert set(got) == {i for i in good if i % 2 == 0}
    assert hit / total >= 0.9


def test_neighbours_among_copies(spark):
    """Groups of near and exact copies lift the bound; their members still find all of the best."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1000, 64))
    for g in range(3):
        x[60 * g : 60 * g + 60] = x[999 - g] + rng.standard_normal((60, 64)) * 0.15
    x[180:240] = x[900]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 6 == 0, probed=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score))
    every = x @ x.T
    for q in range(0, 1000, 6):
        want = np.sort(np.delete(every[q], q))[::-1][:20]
        own = sorted(got.get(q, []))
        assert [r for r, _ in own] == list(range(1, 21))
        assert np.allclose([s for _, s in own], want, atol=1e-12, rtol=0)


def test_neighbours_as_shipped(spark):
    """Recall against brute force with the settings of the query, where lists are left out."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((40, 64))[rng.integers(0, 40, 2500)] + rng.standard_normal((2500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    every = x @ x.T
    np.fill_diagonal(every, -2)
    hits = sum(len(set(np.argsort(-every[q])[:20].tolist()) & got[q]) for q in range(0, 2500, 20))
    assert all(len(v) == 20 for v in got.values()) and hits / (125 * 20) >= 0.9


def recall_of(spark, x, step=10, k=20):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % step == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    every = x @ x.T
    np.fill_diagonal(every, -np.inf)
    queries = range(0, len(x), step)
    assert all(len(got[q]) == k for q in queries)
    return sum(len(set(np.argsort(-every[q])[:k].tolist()) & got[q]) for q in queries) / (len(queries) * k)


@pytest.mark.parametrize("kind", ["unit", "log-normal norms", "shifted", "clustered", "one huge"])
def test_recall_of_many_kinds_of_vectors(spark, kind):
    """The settings of the query reach 0.9 whatever norms and places vectors have."""
    rng = np.random.default_rng(31)
    x = rng.standard_normal((3000, 64))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "log-normal norms":
        x *= rng.lognormal(0, 1, (3000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "shifted":
        x += 1.0
    elif kind == "clustered":
        x = x * 0.3 + rng.standard_normal((30, 64))[rng.integers(0, 30, 3000)]
    else:
        x[7] *= 1e150
    assert recall_of(spark, x) >= 0.9


def test_probed_lists_are_few_where_vectors_cluster():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64)) * 0.2 + rng.standard_normal((40, 64))[rng.integers(0, 40, 4000)]
    top = float(np.linalg.norm(x, axis=1).max())
    lists = centroids(lifted(x, top), 40)
    home = (lifted(x, top) @ lists.T).argmax(axis=1)
    assert measured_probes(x, home, lists, 20) <= 10
    alone = x[:1]
    assert measured_probes(alone, np.zeros(1, dtype=int), lists, 20) == 40


def test_hypothesis_tests_abandon_most_candidates():
    """The true best survive; most of the others are abandoned from partial distances."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 256))
    x[:25] = x[100] + rng.standard_normal((25, 256)) * 0.1
    block = ListBlock(np.arange(4000), x)
    score = x @ x[100]
    bound = float(np.sort(score)[-26])
    ids, found = block.search(100, x[100], bound, 4000)
    assert set(range(25)) <= set(ids.tolist()) and len(ids) < 200
    assert np.allclose(found, score[ids])


def test_neighbours_of_nothing(vectors):
    df, _ = vectors
    assert nearest(df.limit(0), F.lit(True)).count() == 0
    assert embedding_near_duplicates(df.limit(0)).count() == 0


def test_shards_hold_all_lists():
    place, blocks = lay_shards({-2: (3, 1), 0: (30_000, 600), 1: (30_000, 10), 2: (5_000, 0), 3: (130_000, 1)})
    assert place[3][1] == 4 and place[1][0] == place[2][0] and place[-2][0] != place[0][0]
    assert len(blocks) == max(f + n for f, n in place.values())


def test_slices_lose_no_pair(spark, monkeypatch):
    """Pairs with leaders, counted in slices: those that share enough entries, each once."""
    monkeypatch.setattr(ngram_join, "LEADERS_AT_ONCE", 2)
    rows = [(2 * e, d, 8, 2, False) for d in range(4) for e in range(6 if d < 3 else 1)]
    members = spark.createDataFrame(rows, "entry long, doc_id long, n int, rest int, mixed boolean")
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], "src long, dst long")
    got = ngram_join.likely_pairs(pairs, members, (75, 100))
    assert sorted(map(tuple, got.collect())) == [(0, 1), (0, 2), (1, 2)]
