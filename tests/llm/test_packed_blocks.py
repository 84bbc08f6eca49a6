"""What the sieves leave is sorted in few blocks of a bounded size."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_passages import passages, without_repeats

from orrery.llm import suffix_array


def test_repeats_equal_brute_force_when_packed(spark, monkeypatch):
    """Stretches are cut and their blocks dealt again, so that several tell what a first block loses."""
    monkeypatch.setattr(suffix_array, "SORTED", 500)
    rows = passages(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = [(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix_array.remove_repeats(df, width=50).collect()]
    assert sorted(got, key=repr) == without_repeats(rows, 50)


def test_few_blocks_are_sorted(spark, monkeypatch):
    """Blocks that hold little are put together, whatever their number: blocks times buckets are sent in each step of the sort."""
    sorted_blocks = []

    def noted(state, width):
        sorted_blocks.append(state.select("block", F.octet_length("state").alias("n")).collect())
        raise StopIteration

    monkeypatch.setattr(suffix_array, "suffix_order", noted)
    monkeypatch.setattr(suffix_array, "BLOCK", 4000)
    line = F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit("the same passage in every document, of over fifty bytes, "), (F.col("id") % 7).cast("string"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40))
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), line.alias("text"))
    with pytest.raises(StopIteration):
        suffix_array.remove_repeats(docs)
    (blocks,) = sorted_blocks
    assert len({r["block"] for r in blocks}) == len(blocks) <= 2 * spark.sparkContext.defaultParallelism


def test_large_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "SORTED", 1000)
    text = np.random.default_rng(3).integers(97, 123, 5000, dtype=np.uint8).tobytes()
    lens = np.array([50, 3950, 1000])
    state = {"text": text, "lens": lens, "ids": np.array([4, 5, 6]), "offs": np.array([7, 0, 9000]), "home": np.array([0, 1, 1]), "homes": np.array([30, 31]), "gone": np.array([[1, 5, 0], [2, 6, 1]])}
    made = [suffix_array._state(r["state"]) for r in suffix_array.packed_again(spark.createDataFrame([(1, suffix_array._kept(state))], "block long, state binary"), 50).collect()]
    assert len(made) >= 4 and max(len(s["text"]) for s in made) <= 2100
    windows = []
    for s in made:
        at = 0
        for n, i, off, home in zip(s["lens"], s["ids"], s["offs"], s["home"], strict=True):
            windows += [(s["homes"][home], i, off + p, s["text"][at + p : at + p + 50]) for p in range(n - 49)]
            at += n
    want, at = [], 0
    for n, i, off, home in zip(lens, state["ids"], state["offs"], state["home"], strict=True):
        want += [(state["homes"][home], i, off + p, text[at + p : at + p + 50]) for p in range(n - 49)]
        at += n
    assert sorted(windows) == sorted(want)  # each window once
    assert sorted((int(s["homes"][h]), int(a), int(b)) for s in made for a, b, h in s["gone"]) == [(30, 1, 5), (31, 2, 6)]


def test_contents_do_not_depend_on_places():
    a = np.frombuffer(bytes(range(200)) * 600, np.uint8)
    start = np.arange(0, 119_000, 50)
    got = suffix_array.contents(a, start, start + 90)
    assert len(set(got.tolist())) == 4 and (got[:-4] == got[4:]).all()
    assert len(suffix_array.contents(a, start[:0], start[:0])) == 0
