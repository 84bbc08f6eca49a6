"""Clusters, repeated passages and fill-in-the-middle: against brute force, exact round trips and SQL."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SF, comparable
from pyspark.sql import functions as F

from orrery.llm import elkan, fill_middle, suffix_array
from orrery.llm import queries as Q

# -- k-means --------------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, scale, size):
    """{row number: (cluster, distance)}, centroids: all distances, in Python's integers."""
    kept = {n: [int(np.floor(scale * float(c))) for c in v] for n, (_, v) in enumerate(rows) if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)}
    named = [n for n in kept if rows[n][0] is not None]
    first = sorted(named, key=lambda n: (hashlib.sha256(f"2:{rows[n][0]}".encode()).hexdigest(), kept[n]))[:k]
    centroids = [kept[n] for n in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for r in range(rounds + 1):
        own = {n: nearest(v) for n, v in kept.items()}
        if r < rounds:
            for j in range(len(centroids)):
                mine = [kept[n] for n, (_, c) in own.items() if c == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return {n: (c, d) for n, (d, c) in own.items()}, centroids


def vectors(seed, n, size):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, list(rows[i][1])) for i in range(6)]  # ties
    rows += [(5, [0.5] * size), (None, [0.25] * size), (900, None), (901, [1.0]), (902, [None] * size), (903, [float("nan")] * size), (904, [float("inf")] * size), (905, [])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,k,scale", [(4, 7, 256), (4, 7, 1), (4, 500, 2), (3, 5, 1 << 30)])
def test_kmeans_equals_all_distances(spark, size, k, scale):
    rows = vectors(k, 120, size)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int")
    got = elkan.kmeans(df, k=k, rounds=3, scale=scale, size=size).collect()
    want, centroids = lloyd(rows, k, 3, scale, size)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(((rows[n][0], *x) for n, x in want.items()), key=repr)
    assert {(r.cluster, tuple(r.centroid)) for r in got} == {(c, tuple(centroids[c])) for c, _ in want.values()}
    total = sum(d for _, d in want.values())
    fits = lambda n: n if n < 1 << 63 else None
    assert {r.inertia for r in got} == {fits(total)}
    assert all(r.cluster_inertia == fits(sum(d for c, d in want.values() if c == r.cluster)) for r in got)


def test_bounds_leave_distances_out():
    rng = np.random.default_rng(3)
    x = (rng.normal(0, 20, (3000, 8)) + rng.choice([-900, 0, 900], (3000, 1))).astype(np.int64)
    c = x[:30].copy()
    own, square, upper, lower, computed = elkan.assign(x, None, None, None, elkan.Step(c, None))
    all_squares = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (own == all_squares.argmin(axis=1)).all() and (square == all_squares.min(axis=1)).all()
    assert computed < 0.75 * all_squares.size
    assert (upper.astype(float) ** 2 >= square).all() and (lower.astype(float) ** 2 <= all_squares).all()
    moved = c.copy()
    moved[:3] += 2
    step = elkan.Step(moved, c)
    own, _, upper, lower, computed = elkan.assign(x, own, upper, lower, step)
    all_squares = ((x[:, None] - moved[None]) ** 2).sum(axis=2)
    assert (own == all_squares.argmin(axis=1)).all() and computed < 0.25 * all_squares.size


def test_kmeans_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert elkan.kmeans(df).collect() == []
    assert elkan.kmeans(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")).collect() == []
    assert elkan.kmeans(spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<float>")).collect() == []


def test_kmeans_of_components_beyond_a_long(spark):
    rows = [(1, [2.0**55, 0.0]), (2, [0.0, 2.0**55]), (3, [1.0, 1.0]), (4, [2.0**70, 0.0])]
    got = elkan.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1, rounds=1, scale=1, size=2).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3] and all(r.distance is None and r.inertia is None for r in got if r.vec_id != 3)
    # the mean moved by exact sums
    assert {tuple(r.centroid) for r in got} == {((2**55 + 1) // 3, (2**55 + 1) // 3)}


# -- repeated passages ----------------------------------------------------------------------------------------------


def without_repeats(rows, width):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1) if i is not None else ():
            s = b[p : p + width]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1) if i is not None else ():
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        edges = [p for p in range(len(b) + 1) if (gone[p - 1] if p else 0) != (gone[p] if p < len(b) else 0)]
        out.append((i, len(b), sum(gone), list(zip(edges[::2], edges[1::2])), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    letters = "abcdéß \n"
    new = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, family = new(120), new(400)
    texts = [None, "", "x", new(49), new(50)]
    for _ in range(12):
        t = list(family)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(letters)
        texts.append("".join(t))
    texts += [new(rng.randrange(90)) + passage[rng.randrange(30) :] + new(rng.randrange(90)) for _ in range(12)]
    texts += ["a" * 300, "a" * 170, "ab" * 200, "ab" * 60 + passage + "ab" * 60, family, family, family[10:70], passage[:49], passage[:50], passage[:51]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts), (None, family), (3, family), (3, passage), (2**62, passage)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,width,block,keys", [(0, 50, 1 << 20, 1 << 17), (1, 50, 200, 40), (2, 17, 1000, 40)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, width, block, keys):
    """In one block, and with texts in pieces and buckets so small that groups go on from one to the next."""
    monkeypatch.setattr(suffix_array, "BLOCK", block)
    monkeypatch.setattr(suffix_array, "KEYS", keys)
    rows = passages(seed)
    df = spark.createDataFrame([(i, t, "y", 1) for i, t in rows], "doc_id long, text string, block string, kept int")
    got = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_array.remove_repeats(df, width=width).collect()]
    assert sorted(got, key=repr) == without_repeats(rows, width)


def test_few_messages_are_sent(spark, monkeypatch):
    """They are blocks times buckets, so their number grows with the square of the input: here for eight megabytes."""
    sent, plain = [], suffix_array.written

    def noted(df, *a):
        out = plain(df, *a)
        if "bucket" in df.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(suffix_array, "written", noted)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 64).alias("text"))
    with suffix_array.small_batches(spark, suffix_array.BATCH):
        made = suffix_array.blocks(docs, "doc_id", "text", 50)
        suffix_array.exchange(made.select("block", "state"), *suffix_array._sieve(50, 25), hashed_keys=1)
    assert len(sent) == 1 and 0 < sent[0] <= 3 * suffix_array.LEAST_BUCKETS


def test_repeats_of_nothing(spark):
    assert suffix_array.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = suffix_array.remove_repeats(spark.createDataFrame([(1, None), (None, None)], "doc_id int, text string"))
    assert dict(got.dtypes)["doc_id"] == "int"
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, r.spans, bytes(r.kept)) for r in got.collect()))) == sorted(map(repr, ((1, 0, 0, [], b""), (None, 0, 0, [], b""))))


def test_order_of_suffixes_is_lexicographic(spark):
    """The ranks themselves, not only what is found by them."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(16, 200))).encode() for _ in range(12)] + [b"a" * 90, b"a" * 90]
    states = []
    for n in range(2):
        mine = texts[n::2]
        states.append((n, suffix_array._kept({"text": b"".join(mine), "lens": np.array([len(t) for t in mine]), "ids": np.arange(len(mine)), "offs": np.zeros(len(mine), np.int64), "home": np.zeros(len(mine), np.int64), "homes": np.array([n]), "gone": np.zeros((0, 3), np.int64)})))
    made = suffix_array.suffix_order(spark.createDataFrame(states, "block long, state binary"), 20).collect()
    ranked = []
    for r in made:
        s = suffix_array._state(r["state"])
        order = list(zip(*(c.tolist() for c in suffix_array._order(s, 0)[0]), strict=True))
        at = 0
        for n in s["lens"]:
            ranked += [(order[at + p], s["text"][at + p : at + n]) for p in range(n)]
            at += n
    ranked.sort(key=lambda x: x[0])
    heads = [t[:20] for _, t in ranked]
    assert heads == sorted(heads)


def test_repeats_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(i, n, m, len(s), hashlib.sha256(k).hexdigest()) for i, n, m, s, k in without_repeats([(r.doc_id, r.text) for r in docs.collect()], 50)}
    got = Q.query("op12_suffix_array")[0](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {tuple(r) for r in got.collect()} == want


# -- fill in the middle ---------------------------------------------------------------------------------------------


def plainly(i, text, every=None):
    import re

    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_splitting(spark):
    rng = random.Random(4)
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "a\r\nb c\x0bd\n", "a <P> b\nc", "<", "<S", "x<M\n>y\n", "é\n字\n😀\n" * 400, "no end " * 30000]
    texts += ["".join(rng.choice("aé字😀<\n\n") for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb"), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(i, t, "n", "f") for i, t in rows], "doc_id long, text string, n string, form string")
    made = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert got == sorted(((i, *plainly(i, t), t or "") for i, t in rows), key=repr)
    assert fill_middle.fill_in_middle(df.limit(0)).collect() == []


def test_checkpoints_find_every_unit():
    text = "é字😀x\n\nab\n" * 100 + "end"
    units = text.splitlines(keepends=True)
    for every in (1, 3, 64, 1000):
        index = fill_middle.Checkpoints(text.encode(), every)
        assert index.n == len(units) and len(index.units) <= len(units) // every + 1
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert index.offsets(u) == (len(head.encode()), len(head))


@pytest.mark.parametrize("name", ["op11_elkan", "op13_fill_middle"])
def test_queries_equal_their_sql(spark, duck, name):
    call, sql = Q.query(name)
    got, want = call(spark, SF).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and comparable(got) == comparable(want)
