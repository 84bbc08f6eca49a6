"""Scans of file trees and the publishing sink."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from orrery.sources import published, tree


@pytest.fixture
def folder(tmp_path):
    """Two large pictures, a tiny one, one in a folder below, and what mustn't be found."""
    top = tmp_path / "src"
    (top / "thumbs").mkdir(parents=True)
    (top / "one.jpg").write_bytes(b"1" * 4000)
    (top / "two.JPG").write_bytes(b"2" * 4000)
    (top / "tiny.png").write_bytes(b"3" * 90)
    (top / "thumbs" / "t.png").write_bytes(b"4" * 80)
    (top / "notes.txt").write_bytes(b"5")
    (top / ".jpg").write_bytes(b"6")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "far.png").write_bytes(b"7" * 10)
    os.symlink(tmp_path / "outside" / "far.png", top / "link.png")
    os.symlink(tmp_path / "outside", top / "linked")
    return top


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_selection_counts(spark, folder):
    find = lambda **more: names(tree.pictures(spark, [str(folder)], recursive=True, **more))
    assert len(find()) == 4
    assert find(include=["*.jpg", "*.JPG"]) == ["one.jpg", "two.JPG"]
    assert len(find(exclude=["*/thumbs/*"])) == 3
    assert find(least=2000) == ["one.jpg", "two.JPG"]
    assert find(most=85) == ["t.png"]
    assert names(tree.pictures(spark, [str(folder)])) == ["one.jpg", "tiny.png", "two.JPG"]
    assert names(tree.pictures(spark, [str(folder)], only="PNG", recursive=True)) == ["t.png", "tiny.png"]
    named = tree.pictures(spark, [str(folder / "one.jpg"), str(folder / "tiny.png")], include=["*.jpg"])
    assert names(named) == ["one.jpg"]


def test_links(spark, folder):
    link = str(folder / "link.png")
    (found,) = tree.pictures(spark, [link]).collect()
    assert found["link"] and found["path"] == os.path.realpath(link) and found["given"] == link
    assert tree.duplicates_of(spark, [link]).count() == 0
    assert tree.duplicates_of(spark, [str(folder / "linked")], True).count() == 0
    assert names(tree.pictures(spark, [str(folder / "linked")])) == ["far.png"]  # a folder that is named itself
    twice = tree.files(spark, [link, str(folder.parent / "outside")], tree.PICTURES)
    assert twice.count() == 2 and tree.distinct_files(twice).count() == 1
    a = folder / "one.jpg"
    os.link(a, folder / "same.jpg")
    rows = tree.pictures(spark, [str(folder)]).where("name IN ('one.jpg', 'same.jpg')").collect()
    assert len({(r["device"], r["inode"]) for r in rows}) == 1


def test_order_of_arguments(spark, folder):
    (folder / "a-b").mkdir()
    (folder / "a").mkdir()
    (folder / "a-b" / "x.pdf").write_bytes(b"x")
    (folder / "a" / "z.pdf").write_bytes(b"z")
    (folder / "a" / "Y.PDF").write_bytes(b"y")
    paths = [str(folder / "tiny.png"), str(folder), str(folder / "one.jpg")]
    got = [r["name"] for r in tree.page_pictures(spark, paths, True).orderBy("position").collect()]
    assert got == ["tiny.png", "one.jpg", "t.png", "two.JPG"]
    got = tree.page_documents(spark, [str(folder), str(folder / "a" / "Y.PDF")], True).orderBy("position").collect()
    assert [(r["position"], r["name"]) for r in got] == [(0, "z.pdf"), (1, "x.pdf"), (2, "Y.PDF")]  # by parts: a before a-b


def test_filters_of_one_frame_stay_apart(spark, folder):
    found = tree.files(spark, [str(folder)], recursive=True, content=True)
    both = found.where("suffix = '.png'").union(found.where("suffix = '.txt'"))
    assert sorted((r["name"], bytes(r["content"])[:1]) for r in both.collect()) == [("notes.txt", b"5"), ("t.png", b"4"), ("tiny.png", b"3")]
    assert "content" not in tree.files(spark, [str(folder)]).columns


def test_files_are_looked_at_only_if_their_names_fit(folder, monkeypatch):
    reader = tree.TreeReader({"paths": f'["{folder}"]', "recursive": "true", "suffixes": '[".png"]', "exclude": '["*/thumbs/*"]', "least": "50", "content": "true"})
    looked, read = [], []
    monkeypatch.setattr(tree.os, "lstat", lambda p, real=os.lstat: looked.append(os.path.basename(p)) or real(p))
    monkeypatch.setattr(tree, "_content", lambda p, n: read.append(os.path.basename(p)) or b"")
    (folder / "small.png").write_bytes(b"s")
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["name"] for r in rows] == ["tiny.png"] == read
    assert {n for n in looked if "." in n} == {"tiny.png", "small.png"}


def test_large_folders_are_shared_and_deep_ones_walked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "SHARE", 10)
    monkeypatch.setattr(tree, "SUBTREES", 3)
    for k in range(45):
        (tmp_path / f"f{k}.png").write_bytes(b"x")
    for k in range(6):
        (tmp_path / f"d{k}" / "e" / "f").mkdir(parents=True)
        (tmp_path / f"d{k}" / "e" / "f" / "y.png").write_bytes(b"y")
    reader = tree.TreeReader({"paths": f'["{tmp_path}"]', "recursive": "true"})
    parts = reader.partitions()
    assert sum(p.kind == "flat" and p.path == str(tmp_path) for p in parts) == 6 and sum(p.kind == "walk" for p in parts) == 6
    found = [r["given"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(found) == len(set(found)) == 51


def test_missing_and_empty(spark, tmp_path):
    assert tree.files(spark, [str(tmp_path / "none"), str(tmp_path)]).count() == 0
    assert tree.in_given_order(tree.files(spark, [])).count() == 0


# -- the sink -------------------------------------------------------------------------------------------------------


def everything(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, found in os.walk(root) for n in found)


def report(df):
    return {r["path"]: (r["outcome"], r["error"], r["bytes"]) for r in df.collect()}


def test_publish_reports_every_row(spark, tmp_path):
    root = str(tmp_path / "out")
    os.makedirs(f"{root}/taken.d")
    (tmp_path / "out" / "taken").write_bytes(b"old")
    os.symlink(tmp_path, f"{root}/away")
    rows = [(f"{root}/a/b/new", b"new"), (f"{root}/taken", b"other"), (f"{root}/taken.d", b"x"), (f"{root}/away/x", b"x"), (f"{root}/../y", b"x"), ("/etc/z", b"x"), (None, b"x"), (f"{root}/none", None), (f"{root}/empty", b"")]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    got = report(published.publish(df, root))
    assert got == {
        f"{root}/a/b/new": ("published", "", 3), f"{root}/taken": ("", "output_exists", 0), f"{root}/taken.d": ("", "output_not_regular_file", 0), f"{root}/away/x": ("", "unsafe_path", 0), f"{root}/../y": ("", "unsafe_path", 0),
        "/etc/z": ("", "unsafe_path", 0), None: ("", "unsafe_path", 0), f"{root}/none": ("", "missing_content", 0), f"{root}/empty": ("", "empty_output", 0),
    }
    assert everything(root) == ["a/b/new", "taken"] and (tmp_path / "out" / "taken").read_bytes() == b"old"
    os.chmod(f"{root}/taken", 0o640)
    assert report(published.publish(df, root, overwrite=True))[f"{root}/taken"] == ("published", "", 5)
    assert (tmp_path / "out" / "taken").read_bytes() == b"other" and os.stat(f"{root}/taken").st_mode & 0o777 == 0o640


def test_one_of_equal_paths_is_published(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([(f"{root}/x", bytes([k]) * 10) for k in range(8)], "path string, content binary").repartition(8)
    got = published.publish(df, root).groupBy("outcome", "error").count().collect()
    assert {tuple(r) for r in got} == {("published", "", 1), ("", "output_exists", 7)}
    assert everything(root) == ["x"]


def test_a_failing_job_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.range(40).repartition(4).select(F.concat(F.lit(f"{root}/"), "id").alias("path"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken"):
        published.publish(df, root)
    assert everything(root) == []


class Task:
    """What a writer asks of the task it runs in."""

    def __init__(self, partition, attempt):
        self.partitionId, self.taskAttemptId = (lambda: partition), (lambda: attempt)


def attempt(writer, monkeypatch, partition, number, rows):
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: Task(partition, number)))
    return writer.write(iter(rows))


def a_writer(root, **options):
    from pyspark.sql import types as T

    return published.PublishingWriter({"root": root, "job": "j"} | options, T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())]))


def test_second_attempts_and_killed_tasks_leave_one_whole_file(tmp_path, monkeypatch):
    root = str(tmp_path)
    writer = a_writer(root)

    def dies():
        yield f"{root}/a", b"first"
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        attempt(writer, monkeypatch, 0, 1, dies())
    assert not os.path.exists(f"{root}/a")
    again = attempt(writer, monkeypatch, 0, 2, [(f"{root}/a", b"first"), (f"{root}/b", b"second")])
    attempt(writer, monkeypatch, 0, 3, [(f"{root}/a", b"first"), (f"{root}/b", b"second")])  # speculative, not committed
    writer.commit([again])
    assert everything(root) == ["a", "b"] and (tmp_path / "a").read_bytes() == b"first"
    writer = a_writer(root)
    attempt(writer, monkeypatch, 0, 1, [(f"{root}/c", b"third")])
    writer.abort([None])
    assert everything(root) == ["a", "b"]


def test_a_driver_that_dies_while_it_commits(tmp_path, monkeypatch):
    root = str(tmp_path)
    writer = a_writer(root)
    message = attempt(writer, monkeypatch, 0, 1, [(f"{root}/{k}", b"%d" % k) for k in range(1, 30)])
    real, calls = published.named, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 12:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(published, "named", dies)
    with pytest.raises(KeyboardInterrupt):
        writer.commit([message])
    monkeypatch.setattr(published, "named", real)
    unfinished = a_writer(root, job="other")
    attempt(unfinished, monkeypatch, 0, 1, [(f"{root}/late", b"x")])
    assert published.recovered(root) == [unfinished.staging]
    unfinished.abort([])
    assert everything(root) == sorted(str(k) for k in range(1, 30))


def test_readers_never_see_half_a_file(spark, tmp_path):
    root, seen, stop = str(tmp_path / "out"), set(), threading.Event()
    os.makedirs(root)
    (tmp_path / "out" / "x").write_bytes(b"a" * 300_000)

    def watch():
        while not stop.is_set():
            seen.add(len((tmp_path / "out" / "x").read_bytes()))

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        published.publish(spark.createDataFrame([(f"{root}/x", b"b" * 700_000)], "path string, content binary"), root, overwrite=True)
    finally:
        stop.set()
        thread.join()
    assert seen <= {300_000, 700_000}


def test_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"a" * 3_000_000)
    os.symlink(tmp_path / "in" / "a", tmp_path / "in" / "link")
    root = str(tmp_path / "out")
    rows = [(str(tmp_path / "in" / n), f"{root}/{n}") for n in ("a", "link", "gone")]
    got = report(published.copied(spark.createDataFrame(rows, "source string, path string"), root, "source", "path"))
    assert got == {f"{root}/a": ("published", "", 3_000_000), f"{root}/link": ("", "source_not_read", 0), f"{root}/gone": ("", "source_not_read", 0)}
    assert everything(root) == ["a"]


def test_nothing_to_publish(spark, tmp_path):
    assert published.publish(spark.createDataFrame([], "path string, content binary"), str(tmp_path / "out")).count() == 0
    with pytest.raises(ValueError):
        published.publish(spark.createDataFrame([], "path string, content binary"), "hdfs://x/out")
