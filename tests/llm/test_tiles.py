"""Sets that go to many tiles are sent in passes."""

import itertools
import random

from test_groups import shingles, union_find

from orrery.llm import jaccard


def shared_passages(n):
    """Texts of four passages each that others have, too, and one that all have: alike in signatures, rarely in sets."""
    rng = random.Random(7)
    passages = [" ".join(f"p{i}x{k}" for k in range(14)) for i in range(12)]
    common = " ".join(f"c{k}" for k in range(12))
    return [" ".join([*rng.sample(passages, 4), common]) for _ in range(n)]


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_jaccard_tiles_are_sent_in_passes(spark, monkeypatch):
    texts = shared_passages(60)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if 100 * len(a & b) >= 75 * len(a | b)]
    want = {i: (len(s), c) for (i, s), c in zip(enumerate(sets), union_find(len(texts), links), strict=True)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "FREQUENT", 40)
    step = jaccard.written
    most = {}
    for size in (10**9, 1):
        monkeypatch.setattr(jaccard, "PASS_FEATURES", size, raising=False)
        steps = []

        def watched(*args, steps=steps, **kwargs):
            before = shuffled(spark)
            out = step(*args, **kwargs)
            steps.append(shuffled(spark) - before)
            return out

        monkeypatch.setattr(jaccard, "written", watched)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == want
        most[size] = max(steps)
    assert most[1] < most[10**9], most
