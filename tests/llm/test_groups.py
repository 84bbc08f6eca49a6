"""Joins, searches, mixing and licences: against brute force and SQL."""

import itertools
import math
import random

import numpy as np
import pytest
from conftest import SF, comparable
from pyspark.sql import functions as F

from orrery.llm import cover_tree, jaccard, lattice, licences, mixing
from orrery.llm import queries as Q


def union_find(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        up[b] = a
    return [top(i) for i in range(n)]


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def edited(rng, ws, k):
    ws = list(ws)
    for _ in range(k):
        ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
    return ws


def corpus(seed):
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, texts = new(30), [None, "", " \n", "one", "One", "a b c d", "a b c d e f", "a b c d e"]
    for size in (6, 8, 9, 20, 40, 90, 200, 400, 1500):
        for _ in range(3):
            ws = new(size)
            texts.append(" ".join(ws))
            for k in (0, 1, max(1, size // 40), max(1, size // 25)):
                texts.append(" ".join(edited(rng, ws, k)))
            texts.append(" ".join(ws[: size * 4 // 5]))
            texts.append(" ".join(ws + new(size // 4)))
    family = new(60)  # a large group of near copies, and texts that share a passage only
    texts += [" ".join(edited(rng, family, 1)) for _ in range(60)]
    texts += [" ".join(new(12) + passage + new(rng.randrange(1, 20))) for _ in range(50)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "known", "frequent"), [(1, jaccard.KNOWN_IDS, jaccard.FREQUENT), (2, 0, 3)])
def test_jaccard_components_equal_brute_force(spark, seed, known, frequent, monkeypatch):
    monkeypatch.setattr(jaccard, "KNOWN_IDS", known)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    texts = corpus(seed)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, n_shingles int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    want = union_find(len(texts), links)
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def similarity(a, b):
    both = len(np.intersect1d(a, b))
    return both, len(a) + len(b) - both


def test_signatures_of_similar_sets_meet(monkeypatch):
    rng = np.random.default_rng(4)
    for reserve in (False, True):
        if reserve:  # so few partitions that the further levels are needed, too
            monkeypatch.setattr(jaccard, "partitions", lambda band: 1 + 2 ** (band + 1) // 9)
        for n in [*range(1, 70), 100, 127, 128, 250, 600, 2000]:
            for _ in range(6):
                base = np.unique(rng.integers(0, 2**63, n * 2).astype(np.uint64))[:n]
                frequent = np.sort(rng.choice(base, rng.integers(0, len(base) + 1), replace=False))
                drop = rng.integers(0, n // 4 + 1)
                other = np.concatenate((base[drop:], rng.integers(0, 2**63, n // 6).astype(np.uint64)))[: max(1, n - drop + rng.integers(0, n // 6 + 1))]
                other = np.unique(other)
                room = jaccard.slack(base, other)
                both, either = similarity(base, other)
                assert (100 * both >= 75 * either) == (room >= 0)
                own = int(rng.integers(0, room + 1)) if room >= 0 else 0
                if room >= 0:
                    a, b = jaccard.signatures(base, own, frequent), jaccard.signatures(other, room - own, frequent)
                    assert len(np.intersect1d(a, b)), (n, both, either)


def test_enumeration_holds_all_subsets():
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64))
    sig, able = jaccard._enumerated(s, 8, 0)
    n1 = jaccard.partitions(8)
    assert n1 * 2 // 3 < able <= n1 and 2 * n1 < len(sig) <= 3 * n1 and len(np.unique(sig)) == len(sig)
    assert np.isin(sig, jaccard._enumerated(s[1:], 8, 0)[0]).sum() >= len(sig) - 2  # one feature is in two subsets of its partition


def test_overlaps_equal_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9000, k).astype(np.uint64)) for k in (1, 5, 6000, 7000, 300)]
    got = jaccard._overlaps(sets, sets[1:])
    assert [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets] == got.tolist()


def brute(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b)]
    return {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, union_find(len(texts), links), strict=True))}


@pytest.mark.parametrize("tile", [16, 512])
def test_jaccard_on_texts_of_one_passage_and_families_at_the_threshold(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "SHARE", 7)
    monkeypatch.setattr(jaccard, "SALTS", 3)
    rng = random.Random(tile)
    new = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, texts = new(80), []
    for k in range(150):  # a passage and words of one's own, around the threshold
        own = new(rng.choice((0, 5, 10, 14, 18, 22, 26, 30, 40)))
        texts.append(" ".join(own + passage if k % 2 else passage + own))
    for size in (40, 120):  # copies of copies with edits, near and far
        base = new(size)
        for _ in range(120):
            texts.append(" ".join(edited(rng, base, rng.choice((1, 1, 2, 2, 3)))))
        far = edited(rng, base, 2)
        texts += [" ".join(edited(rng, far, rng.choice((0, 1, 2)))) for _ in range(40)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == brute(texts)


def test_jaccard_on_a_large_family(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = [" ".join(edited(rng, base, rng.choice((1, 1, 2, 2, 2, 3, 4)))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == brute(texts)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, "A b c\td e f")], "doc_id int, text string")
    got = sorted(map(tuple, jaccard.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 2, None), (9, 2, 3)], key=repr)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (1, None), (2, "")], "doc_id long, text string").coalesce(1)  # a block without features
    assert sorted(map(tuple, jaccard.near_duplicates(blank).collect())) == [(1, 0, 1), (1, 0, 1), (2, 0, 2)]


def test_e8():
    roots = lattice.roots()
    assert len(roots) == 240 and ((roots**2).sum(axis=1) == 2).all()
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = lattice.nearest(x)
    assert ((((x - p)[:, None] - roots[None]) ** 2).sum(axis=2).min(axis=1) >= ((x - p) ** 2).sum(axis=1) - 1e-12).all()


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    u, w = rng.normal(size=(2, 3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    a, b = lattice.cells(u), lattice.cells(0.93 * u + math.sqrt(1 - 0.93**2) * w)
    assert ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1).mean() > 0.98


def test_lattice_groups(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 64))
    rows = [(b + rng.normal(size=64) * 0.02).tolist() for b in base for _ in range(3)]
    rows += [(base[0] + rng.normal(size=64) * 0.05).tolist() for _ in range(70)] + [base[1].tolist()] * 25
    labels = [int(rng.integers(2)) for _ in rows]
    labels[5] = None
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] * 64]
    table = [(i, v, k, "x") for i, (v, k) in enumerate(zip(rows, labels, strict=True))] + [(1000 + i, v, 0, "x") for i, v in enumerate(odd)] + [(None, rows[0], labels[0], "x")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int, kept string")
    x = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if labels[i] is not None and labels[i] == labels[j] and x[i] @ x[j] >= 0.93]
    count = np.bincount(np.array(links).ravel(), minlength=len(rows))
    want = {i: (int(count[i]), c, c == i) for i, c in enumerate(union_find(len(rows), links))} | {1000 + i: (0, 1000 + i, True) for i in range(len(odd))} | {None: (0, None, True)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect()}
    assert got == want
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_lattice_on_mixed_lengths(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=64), rng.normal(size=5)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate((a, a * 1.01 + 0.001, b, b * 2 + 0.001, np.concatenate((b, np.zeros(59))), [1.0]))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (0, 5)}


def test_cover_tree_invariants():
    x = np.random.default_rng(2).normal(size=(900, 8))

    def check(node):
        if not node.children:
            d = np.sqrt(((x[node.rows] - node.centre) ** 2).sum(axis=1))
            assert d.max() <= node.radius + 1e-9
            return list(node.rows)
        rows = [r for c in node.children for r in check(c)]
        assert np.sqrt(((x[rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        return rows

    assert sorted(check(cover_tree.cover_tree(x))) == list(range(900))


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 100)
    monkeypatch.setattr(cover_tree, "GROUP", 8)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 16)).round(2)
    v[100:200] = v[100]
    table = [(i, r.tolist(), "x") for i, r in enumerate(v)] + [(600, None, "x"), (700, [float("nan")] * 16, "x"), (None, v[0].tolist(), "x")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, score string")
    whole = np.floor(1024 * v.astype(np.float32).astype(float))
    got = {}
    for r in cover_tree.top_k(df, df.where("vec_id % 20 = 0"), k=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 500, 20))
    for q, found in got.items():
        s = whole @ whole[q]
        best = sorted((i for i in range(500) if i != q), key=lambda i: (-s[i], i))[:7]
        assert [found[k] for k in range(1, 8)] == [(i, int(s[i])) for i in best]
    assert cover_tree.top_k(df.limit(0), df.limit(0)).count() == 0
    assert cover_tree.top_k(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


def plain_best(q, q_ids, p, p_ids, k):
    out = []
    for v, i in zip(q, q_ids, strict=True):
        s = [(-int(sum(int(x) * int(y) for x, y in zip(v, w, strict=True))), int(n)) for w, n in zip(p, p_ids, strict=True) if n != i]
        out += [(int(i), n, max(-(2**63), min(2**63 - 1, -x))) for x, n in sorted((max(-(2**63) + 1, min(2**63, x)), n) for x, n in s)[:k]]
    return sorted(out)


def test_dual_tree_prunes_clusters_and_is_no_dearer_than_a_product_elsewhere():
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(40, 32)) * 1000
    p = np.floor(middles[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 20)
    q = p[::10].copy()
    ids = np.arange(4000)
    s = cover_tree.Search(q, ids[::10], p, ids, 5)
    assert s.scored < 0.2 * len(q) * len(p)
    assert sorted(zip(ids[::10][s.who].tolist(), s.row.tolist(), s.top.astype(int).tolist(), strict=True)) == plain_best(q[:], ids[::10], p, ids, 5)
    nothing = cover_tree.Search(q, ids[::10], p, ids, 5, floor=np.full(len(q), 1e15))
    assert nothing.scored == 0 and not len(nothing.who)
    p = np.floor(rng.normal(size=(3000, 32)) * 1000)
    assert cover_tree.Search(p[::10], ids[:3000:10], p, ids[:3000], 5).scored <= 300 * 3000


def test_blocks_are_pruned_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 60)
    sent, meetings = [], cover_tree._meetings
    monkeypatch.setattr(cover_tree, "_meetings", lambda data, asked, k: (sent.append(asked), meetings(data, asked, k))[1])
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(20, 16))
    v = middles[np.arange(1200) % 20] + rng.normal(size=(1200, 16)) * 0.02
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.vec_id, r.score) for r in cover_tree.top_k(df, df.where("vec_id % 10 = 0"), k=4).collect())
    whole = np.floor(1024 * v)
    assert got == plain_best(whole[::10], range(0, 1200, 10), whole, range(1200), 4)
    assert sent[1].count() < 0.3 * 120 * 20  # of the meetings of all queries with all blocks


def test_top_k_of_odd_vectors(spark):
    rows = [(0, []), (1, []), (2, [1.0, 2.0]), (3, [3.0, -1.0]), (4, [1e300, 1.0]), (5, [-1e300, 5.0]), (6, [5e9, 1e10]), (7, [1.0] * 5), (8, [0.5, 1e16]), (9, [2.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in cover_tree.top_k(df, df, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    by_length = {}
    for i, v in rows:
        by_length.setdefault(len(v), []).append((i, [max(-(2**63), min(2**63, math.floor(1024 * x))) for x in v]))
    for part in by_length.values():
        ids, v = zip(*part, strict=True)
        want = {}
        for i, n, x in plain_best(v, ids, v, ids, 3):
            want.setdefault(i, []).append((n, x))
        for i in ids:
            assert sorted((n, x) for _, n, x in got[i]) == sorted(want[i]), i


@pytest.mark.parametrize("name", ["op2_lattice", "op3_mixing", "op4_licences", "op6_cover_tree"])
def test_oracles(spark, duck, name):
    assert comparable(Q.queries()[name](spark, SF).toPandas()) == comparable(duck.execute(Q.oracle_sql()[name]).df())


def test_raking_meets_targets():
    rng = np.random.default_rng(0)
    mass = rng.integers(1, 1000, 60).astype(float)
    codes = [rng.integers(0, 5, 60), rng.integers(0, 3, 60)]
    targets = [mixing._targets(mass, c, 0.5) for c in codes]
    w = mixing.rake(mass, codes, targets, 50)
    for c, t in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(c, w), t, rtol=1e-6)
    p = mixing.probabilities(mass, w, mass.sum() * 0.3)
    assert (p <= 1).all() and np.isclose((p * mass).sum(), mass.sum() * 0.3)


def hot_cells(n=2000):
    """A sparse, skewed table: one hot source, 8 languages, 4 topics, a tenth of the cells filled."""
    rng = np.random.default_rng(3)
    at = np.flatnonzero(rng.random(n * 32) < 0.1)
    mass = np.floor(rng.pareto(0.8, len(at)) * 50) + 1
    mass[at // 32 == at[0] // 32] *= 5000
    codes = [np.unique(c, return_inverse=True)[1] for c in (at // 32, at // 4 % 8, at % 4)]
    return mass, codes


def test_raking_goes_on_until_it_converges(recwarn):
    mass, codes = hot_cells()
    targets = [mixing._targets(mass, c, 0.5) for c in codes]
    w = mixing.rake(mass, codes, targets)
    assert mixing.margin_error(w, codes, targets) <= 1e-12 < mixing.margin_error(mixing.rake(mass, codes, targets, 12), codes, targets)
    assert not recwarn.list
    with pytest.warns(RuntimeWarning, match="off by"):  # two cells on a diagonal can't have different margins
        mixing.rake(np.ones(2), [np.array([0, 1])] * 2, [np.array([1.0, 1.0]), np.array([0.5, 1.5])])


@pytest.mark.parametrize("local", [100_000, 0])
def test_mixing_converges_both_ways(spark, monkeypatch, local):
    monkeypatch.setattr(mixing, "LOCAL_CELLS", local)
    monkeypatch.setattr(mixing, "TOLERANCE", 0.02)
    cells = [("a", "x", 3000), ("a", "y", 1), ("b", "x", 1), ("b", "y", 50), ("c", "y", 3), ("c", "x", 2000)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "doc_id long, source string, lang string, n_tokens long")
    got = {(r.source, r.lang): r.weight * r.n_tokens for r in mixing.mix(df, dims=("source", "lang")).collect()}
    total = sum(c[2] for c in cells)
    for k in (0, 1):
        root = {v: math.sqrt(sum(c[2] for c in cells if c[k] == v)) for v in {c[k] for c in cells}}
        for v, t in root.items():
            assert math.isclose(sum(x for c, x in got.items() if c[k] == v), t / sum(root.values()) * total, rel_tol=0.03)


@pytest.mark.parametrize("local", [100_000, 0])
def test_mixing_to_given_targets(spark, monkeypatch, local):
    monkeypatch.setattr(mixing, "LOCAL_CELLS", local)
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-6)
    cells = [("a", "x", 3000), ("a", "y", 10), ("b", "x", 10), ("b", "y", 50), (None, "y", 30), ("c", "x", 2000), ("d", "x", 0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "doc_id long, source string, lang string, n_tokens long")
    got = {(r.source, r.lang): r.weight * r.n_tokens for r in mixing.mix(df, dims=("source", "lang"), targets={"source": {"a": 3, "b": 2, None: 1}, "lang": {"x": 0.4, "y": 0.6}}).collect()}
    assert len(got) == len(cells) and got["c", "x"] == got["d", "x"] == 0
    for k, want in ((0, {"a": 0.5, "b": 1 / 3, None: 1 / 6}), (1, {"x": 0.4, "y": 0.6})):
        for v, t in want.items():
            assert math.isclose(sum(w for c, w in got.items() if c[k] == v), t * 5100, rel_tol=1e-5)
    with pytest.raises(ValueError, match="above 0"):
        mixing.mix(df, dims=("source", "lang"), targets={"source": {"d": 1.0}}).collect()
    with pytest.raises(ValueError, match="aren't raked"):
        mixing.mix(df, dims=("source", "lang"), targets={"topic": {}})


def test_mixing_both_ways(spark, monkeypatch):
    rows = [(i, f"s{i % 7}" if i % 11 else None, "en" if i % 3 else "de", "t", (i * 37) % 400, "x") for i in range(800)] + [(None, None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long, prob string")
    few = mixing.mix(df, rounds=3).collect()
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    many = mixing.mix(df, rounds=3).collect()
    key = lambda rows: {r.doc_id: (round(r.weight, 9), round(r.prob, 9), r.selected) for r in rows}
    assert key(few) == key(many) and len(few) == 801 and 0 < sum(r.selected for r in few) < 800
    assert mixing.mix(df.limit(0)).count() == 0


def test_licences(spark):
    rows = [
        (1, "code\n// Licensed under the Apache License, Version 2.0.\n" + "more words " * 60, "a/b/x.py"), (2, "Released under the MIT License.", "a/LICENSE"), (3, "nothing here", "a/b/c/y.py"),
        (4, None, "a/z.py"), (5, "", "other/z.py"), (6, "A licence to thrill, and to fill a line with words of no such notice", "a/b/q.py"), (7, "This work is licensed under the GNU General Public License, version 3.", "a/b/c/COPYING"), (8, "x", None),
    ]
    got = {r.doc_id: (r.licence, r.inherited, r.effective) for r in licences.scan(spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, path string, score string")).collect()}
    assert got == {
        1: ("Apache-2.0", None, "Apache-2.0"), 2: ("MIT", None, "MIT"), 3: (None, "GPL-3.0", "GPL-3.0"), 4: (None, "MIT", "MIT"), 5: (None, None, None), 6: (None, "MIT", "MIT"), 7: ("GPL-3.0", None, "GPL-3.0"), 8: (None, None, None)
    }
    plan = licences.op4_licences(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licence_files_cover_by_name_or_share(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, MIT_TEXT, "a/LICENSE.txt"), (2, "code", "a/b/c/x.py"), (3, MIT_TEXT, "m/legal"), (4, "code", "m/x/y/z.py"), (5, f"{apache}\n" + "other words of a page " * 30, "p/readme"), (6, "code", "p/x.py"),
        (None, f"{apache}\nthree more words", "n/o/p"), (9, "code", "n/o/q"), (None, "code", "n/o/r/s"), (None, None, None), (None, "", ""), (10, "x\n" * 5000 + apache, "long/t"), (10, "x", "long/t2"),
    ]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, where string, licence string")
    got = sorted(((r["where"] or "", r.licence, r.effective) for r in licences.scan(df, path="where").collect()), key=str)
    want = [("a/LICENSE.txt", "MIT", "MIT"), ("a/b/c/x.py", None, "MIT"), ("m/legal", "MIT", "MIT"), ("m/x/y/z.py", None, "MIT"), ("p/readme", "Apache-2.0", "Apache-2.0"), ("p/x.py", None, None)]
    want += [("n/o/p", "Apache-2.0", "Apache-2.0"), ("n/o/q", None, "Apache-2.0"), ("n/o/r/s", None, "Apache-2.0"), ("", None, None), ("", None, None), ("long/t", "Apache-2.0", "Apache-2.0"), ("long/t2", None, None)]
    assert got == sorted(want, key=str)
    assert licences.scan(df.limit(0), path="where").count() == 0


def test_licences_in_wrapped_headers_and_paragraphs(spark):
    fill = "some words of a paragraph that goes on for a while about other things and then "
    want = {
        "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 3 of the License, or (at your option) any later version.\ncode": "LGPL-3.0",
        "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */": "MPL-2.0",
        "// SPDX-License-Identifier: MIT\nint x;": "MIT", "Copyright 2021 The Foo Authors. All rights reserved.": "Proprietary",
        "MIT License\n\nCopyright (c) 2021 Foo\n": "MIT", f"{fill}ends. Released under the MIT License. {fill}stops.": "MIT", f"{fill}a licence. {fill}": None,
    }
    df = spark.createDataFrame([(i, t, f"p{i}/x") for i, t in enumerate(want)], "doc_id long, text string, path string")
    got = {r.doc_id: r.licence for r in licences.scan(df).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_reserved_rights_count_only_without_a_licence(spark):
    reserved = "Copyright (c) 2020 Foo Corporation. All rights reserved."
    want = {
        f"MIT License\n\n{reserved}\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software": "MIT", MIT_TEXT.replace("Copyright (c) 2020 Some One", reserved): "MIT",
        f"# {reserved}\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:\n": "BSD-3-Clause",
        f"/* {reserved}\n * Licensed under the Apache License, Version 2.0 (the \"License\"); you may\n * not use this file except in compliance with the License. */": "Apache-2.0",
        "// Copyright 2009 The Go Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage main": "BSD-3-Clause",
        f"{reserved}\nint main": "Proprietary",
    }
    rows = [(2 * i + k, t if k == 0 else "code", f"p{i}/{'LICENSE' if k == 0 else 'a/x.c'}") for i, t in enumerate(want) for k in range(2)]
    rows += [(100, reserved, "p0/COPYRIGHT"), (101, "Licensed under CC BY 4.0.", "p9/LICENSE"), (102, reserved, "p9/COPYING"), (103, "code", "p9/y")]
    got = {r.doc_id: (r.licence, r.effective) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    for i, name in enumerate(want.values()):
        assert got[2 * i] == (name, name) and got[2 * i + 1] == (None, name)
    assert got[102] == ("Proprietary", "Proprietary") and got[103] == (None, "CC-BY-4.0")


def test_plain_words_make_no_match():
    """What a text without key terms shares with a template can't reach the least cosine, whatever else it holds; but for four, of which one word is a plain one in German."""
    import re

    keys, rest = set(licences.key_terms()), []
    for templates in (licences.TEMPLATES, licences.TEMPLATES + licences.HEADERS):
        for (_, body), squares in zip(templates, licences._squares(templates), strict=True):
            assert abs(sum(squares.values()) - 1) < 1e-9
            if sum(x for t, x in squares.items() if t not in keys) >= licences.LEAST**2:
                rest.append(body[:30])
            for term in re.findall(licences.TERM, body.lower()):
                assert term not in keys or all(re.search(licences.TRIGGER, t) for t in (term, f"é{term}", f"x {term}.", f"({term}) y"))
    assert rest == ["MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "The software is provided as is"]
