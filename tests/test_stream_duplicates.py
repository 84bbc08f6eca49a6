"""Copies among files that arrive in batches, with restarts between them."""

import time

from orrery.operators import dedup
from orrery.streaming import duplicates as SD


def batch(spark, folder, rows):
    spark.createDataFrame(rows, "k long, c string").coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema("k long, c string").parquet(str(folder))


def pairs(spark, folder):
    return sorted((r.keep, r.duplicate, r.sha256, r.size) for r in spark.read.parquet(str(folder)).collect())


def test_later_files_find_earlier_ones(spark, tmp_path):
    SD.use_state_store(spark)
    batches = [[(1, "a"), (2, "b"), (3, "a"), (None, "a"), (4, None), (5, "")], [(6, "b"), (7, "c"), (8, "a"), (9, "")], [(10, "c"), (0, "a"), (11, "new"), (12, "a")]]
    seen = []
    for rows in batches:  # each run starts anew from the checkpoint
        batch(spark, tmp_path / "in", rows)
        SD.run_batches(SD.duplicates(stream(spark, tmp_path / "in"), "k", "c"), f"{tmp_path}/out", f"{tmp_path}/state")
        seen.append({(k, d) for k, d, _, _ in pairs(spark, tmp_path / "out")})
    assert seen[0] == {(1, 3)} and seen[1] == seen[0] | {(2, 6), (1, 8), (5, 9)}
    assert seen[2] == seen[1] | {(7, 10), (1, 0), (1, 12)}  # a smaller key that comes later doesn't take the place
    SD.run_batches(SD.duplicates(stream(spark, tmp_path / "in"), "k", "c"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert len(pairs(spark, tmp_path / "out")) == len(seen[2])


def test_batches_in_order_give_the_pairs_of_one(spark, tmp_path):
    SD.use_state_store(spark)
    rows = [(k, f"{k % 17 if k % 3 else k}") for k in range(120)]
    for at in (0, 40, 80):
        batch(spark, tmp_path / "in", rows[at : at + 40])
        SD.run_batches(SD.duplicates(stream(spark, tmp_path / "in"), "k", "c"), f"{tmp_path}/out", f"{tmp_path}/state")
    want = dedup.exact_duplicates(spark.createDataFrame(rows, "k long, c string"), "k", "c")
    assert pairs(spark, tmp_path / "out") == sorted((r.keep, r.duplicate, r.sha256, r.size) for r in want.collect())


def test_state_ends_with_its_time(spark, tmp_path):
    """With a time to live a stream runs by a clock: a run of what is there would wait for time to pass."""
    SD.use_state_store(spark)
    for k in range(2):
        batch(spark, tmp_path / "in", [(k, "a")])
        query = SD.started(SD.duplicates(stream(spark, tmp_path / "in"), "k", "c", 1000), f"{tmp_path}/out", f"{tmp_path}/state", "1 second")
        try:
            end = time.time() + 40
            while time.time() < end and not any(p["numInputRows"] for p in query.recentProgress):
                time.sleep(0.5)
            assert any(p["numInputRows"] for p in query.recentProgress)
        finally:
            query.stop()
        time.sleep(1.5)
    assert spark.read.schema("keep long").parquet(f"{tmp_path}/out").count() == 0
