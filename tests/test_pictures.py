"""Batch picture operators and publishing: round trips, plain recursions, and what must not be overwritten."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import dedup as D
from orrery.operators import pictures as PX
from orrery.operators import planning as P
from orrery.operators import pixels as PXL
from orrery.operators import publish as PB
from orrery.sources import files as SRC

RNG = np.random.default_rng(5)


def picture(h, w, c):
    return RNG.integers(0, 256, (h, w, c)).astype(np.uint8)


def test_png_round_trip():
    for c in (1, 2, 3, 4):
        a = picture(7, 11, c)
        assert (PX.read_png(PX.png(a)) == a).all()
    with pytest.raises(ValueError, match="broken_png"):
        PX.read_png(PX.png(a)[:-20] + b"x" + PX.png(a)[-19:])


def plain_lanczos(row, wanted):
    n, out = len(row), []
    scale = n / wanted
    wide = max(1.0, scale)
    for o in range(wanted):
        centre = (o + 0.5) * scale
        first, last = max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5))
        w = []
        for i in range(first, last):
            x = (i - centre + 0.5) / wide
            w.append(0.0 if abs(x) >= 3 else 1.0 if x == 0 else 3 * np.sin(np.pi * x) * np.sin(np.pi * x / 3) / (np.pi * x) ** 2)
        out.append(sum(v * r for v, r in zip(w, row[first:last], strict=True)) / sum(w))
    return out


@pytest.mark.parametrize(("size", "wanted"), [(40, 9), (9, 40), (31, 32), (5, 1)])
def test_lanczos_equals_a_plain_filter(size, wanted):
    a = picture(3, size, 1)
    got = PX.lanczos(a, wanted, 3)
    for line, out in zip(a[..., 0], got[..., 0], strict=True):
        assert abs(np.clip(plain_lanczos(line.tolist(), wanted), 0, 255) - out).max() <= 0.51
    flat = np.full((20, 30, 4), 90, np.uint8)
    assert PX.lanczos(flat, 7, 13).shape == (13, 7, 4) and (PX.lanczos(flat, 7, 13)[..., 3] == 90).all()


def source(spark, rows):
    kind = "origin string, height int, width int, nChannels int, mode int, data binary"
    blue_first = lambda a: np.concatenate((a[..., 2::-1], a[..., 3:]), axis=2) if a.shape[2] >= 3 else a
    made = [(name, a.shape[0], a.shape[1], a.shape[2], 16, blue_first(a).tobytes()) if a is not None else (name, -1, -1, -1, -1, b"") for name, a in rows]
    return spark.createDataFrame(made, kind)


def test_processed_pictures(spark):
    a, b, grey = picture(30, 20, 3), picture(8, 8, 4), picture(5, 9, 1)
    df = source(spark, [("a", a), ("b", b), ("g", grey), ("bad", None)])
    got = {r.origin: r for r in PX.processed(df, [("rotate", 90), ("crop", 1, 1, 7, 5)]).collect()}
    turned = np.rot90(a, -1)[1:5, 1:7]
    assert (PX.read_png(bytes(got["a"].content)) == turned).all() and (got["a"].width, got["a"].height, got["a"].error) == (6, 4, "")
    assert PX.read_png(bytes(got["b"].content)).shape == (4, 6, 4)
    assert got["g"].width == 4 and (got["bad"].content, got["bad"].error) == (None, "unreadable_picture")
    small = {r.origin: r for r in PX.processed(df, [("fit", 10)], "ppm", limit=500).collect()}
    assert small["a"].error == "image_too_large" and bytes(small["b"].content).startswith(b"P6\n8 8\n255\n")
    assert {r.error for r in PX.processed(df, [("resize", 0, 4)]).collect()} == {"invalid_resize", "unreadable_picture"}
    assert {r.error for r in PX.processed(df, [("bend",)]).collect()} == {"unsupported_step:bend", "unreadable_picture"}
    with pytest.raises(ValueError, match="unsupported_target_format"):
        PX.processed(df, [], "jxl")


def test_hashes_of_scaled_pictures_agree(spark):
    big = np.kron(picture(9, 9, 3), np.ones((20, 20, 1), np.uint8))
    df = source(spark, [("a", big), ("b", PX.lanczos(big, 120, 120)), ("other", picture(90, 90, 3)), ("bad", None)])
    rows = {r.origin: r for r in PX.hashed(df).collect()}
    apart = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    for h in ("ahash", "dhash", "phash"):
        assert apart(rows["a"][h], rows["b"][h]) <= 4 < apart(rows["a"][h], rows["other"][h])
    assert rows["bad"].ahash is None and rows["a"].pixels == 180 * 180
    kept = D.similar_groups(PX.hashed(df).withColumn("id", F.ascii("origin")), "id", "phash", "pixels", 4).collect()
    assert {(chr(r.id), chr(r.keep)) for r in kept} == {("a", "a"), ("b", "a")}


def test_png_is_what_the_image_source_reads(spark, tmp_path):
    a = picture(6, 5, 3)
    (tmp_path / "x.png").write_bytes(PX.png(a))
    (tmp_path / "y.bmp").write_bytes(PX.bmp(a))
    for r in SRC.images(spark, f"file://{tmp_path}").collect():
        assert (PX.decoded(r.data, r.width, r.height, r.nChannels) == a).all()


def plain_montage(pictures, cols, cw, ch, gap, border, background, colour):
    rows = -(-len(pictures) // cols)
    out = np.empty((rows * (ch + gap) + gap, cols * (cw + gap) + gap, 3), np.uint8)
    out[:] = background
    for k, a in enumerate(pictures):
        w, h = PX.fitted(a.shape[1], a.shape[0], cw, ch)
        a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a
        a = PX.lanczos(a, w, h) if (w, h) != (a.shape[1], a.shape[0]) else a
        x, y = gap + k % cols * (cw + gap) + (cw - w) // 2, gap + k // cols * (ch + gap) + (ch - h) // 2
        for line in range(max(0, y - border), min(out.shape[0], y + h + border)):
            for at in range(max(0, x - border), min(out.shape[1], x + w + border)):
                inside = y <= line < y + h and x <= at < x + w
                if not inside:
                    out[line, at] = colour
        if a.shape[2] == 4:
            t = a[..., :3].astype(int) * a[..., 3:] + np.array(background) * (255 - a[..., 3:].astype(int)) + 128
            a = ((t >> 8) + t) >> 8
        out[y : y + h, x : x + w] = a
    return out


@pytest.mark.parametrize("strip,border,gap", [(256, 0, 10), (7, 3, 4), (1, 2, 0), (16, 6, 3)])
def test_montages_by_strips(spark, strip, border, gap):
    pictures = {"a": [picture(10, 20, 3), picture(20, 10, 4), picture(5, 5, 1), picture(40, 90, 3)], "b": [picture(20, 20, 3)] * 4, "c": [picture(3, 2, 4)]}
    rows = [(f"{g}{k}", a) for g, ps in pictures.items() for k, a in enumerate(ps)]
    df = source(spark, [*rows, ("c9", None)]).withColumns({"g": F.substring("origin", 1, 1), "n": F.substring("origin", 2, 1)})
    got = {r.g: r for r in PX.montages(df, "g", "n", 2, gap, border, (250, 240, 230), (1, 2, 3), strip=strip).collect()}
    for g, ps in pictures.items():
        cw, ch = (sorted(a.shape[axis] for a in ps)[len(ps) // 2] for axis in (1, 0))
        want = plain_montage(ps, 2, cw, ch, gap, border, (250, 240, 230), (1, 2, 3))
        assert (got[g].pictures, got[g].height, got[g].width, got[g].error) == (len(ps), *want.shape[:2], "")
        assert (PX.read_png(bytes(got[g].content)) == want).all()
    if gap == 10:
        assert (got["b"].width, got["b"].height) == (70, 70)
        assert PX.montages(df.limit(0), "g", "n").count() == 0


def test_sizes_fit_and_stay_in_proportion(monkeypatch):
    assert PX.fitted(10, 5, 20, 20) == (10, 5) and PX.fitted(100, 50, 20, 20) == (20, 10) and PX.fitted(1000, 1, 20, 20) == (20, 1) and PX.fitted(30, 100, 20, 20) == (6, 20)
    a, b = b"abc" * 1000, b"z" * 70000
    assert PX.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_tiles():
    assert PX.tiled(np.zeros((20, 20, 3), np.uint8), np.full((4, 4, 4), 255, np.uint8), 2, 255)[0, 6].tolist() == [255, 255, 255]


def test_bad_rows_stay_rows(spark):
    rows = [("short", 2, 2, 3, 16, b"123"), ("none", 2, 2, 3, 16, None), ("size", None, 2, 3, 16, b"123"), ("odd", 1, 1, 7, 16, b"1234567"), ("good", 1, 1, 3, 16, b"123")]
    df = spark.createDataFrame(rows, "origin string, height int, width int, nChannels int, mode int, data binary")
    assert {r.origin: r.error for r in PX.processed(df, []).collect()} == dict.fromkeys(["short", "none", "size", "odd"], "unreadable_picture") | {"good": ""}
    assert {r.origin: r.pixels for r in PX.hashed(df).collect()} == dict.fromkeys(["short", "none", "size", "odd"]) | {"good": 1}
    pairs = spark.createDataFrame([(1, [1] * 16, [2] * 16), (2, [1] * 16, [2] * 12), (3, [1] * 15, [2] * 15), (4, [], [])], "k int, a array<int>, b array<int>")
    from orrery.operators import compare

    assert {r.k: r.ssim is None for r in compare.block_ssim(pairs, ["k"], "a", "b", 4, 2, 1).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_jpeg_profiles_and_scans_stay():
    part = lambda kind, body: bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body
    icc, exif, other = part(0xE2, b"ICC_PROFILE\0\1\1profile"), part(0xE1, b"Exif\0\0x"), part(0xE2, b"MPF\0")
    scan = part(0xDA, b"\1\0") + b"ab\xff\x00c\xff\xd3d\xff\xff\xff\x00e" * 1000
    tail = part(0xDA, b"\2\0") + b"zz" + b"\xff\xd9"
    assert PXL.strip_jpeg(b"\xff\xd8" + exif + icc + other + part(0xEE, b"Adobe") + part(0xDB, b"q") + part(0xFE, b"hi") + scan + b"\xff" + tail) == b"\xff\xd8" + icc + part(0xEE, b"Adobe") + part(0xDB, b"q") + scan + tail
    for cut in (b"\xff\xd8" + scan, b"\xff\xd8" + icc[:-2]):
        with pytest.raises(ValueError, match="truncated_jpeg"):
            PXL.strip_jpeg(cut)


def test_moves_across_devices_are_copies(tmp_path, monkeypatch):
    source, target = tmp_path / "a", tmp_path / "far" / "b"
    source.write_bytes(b"x" * 3_000_000)
    digest, real = PB.sha256_of(str(source)), os.link
    monkeypatch.setattr(PB.os, "link", lambda a, b, **more: (_ for _ in ()).throw(OSError(18, "cross-device")) if str(a) == str(source) else real(a, b, **more))
    assert PB.moved_to(str(source), str(target), 3_000_000, digest) == "published"
    assert PB.moved_to(str(source), str(target), 3_000_000, digest) == "there"
    assert PB.moved_to(str(source), str(tmp_path / "c"), 3_000_000, "0" * 64) == "source_changed"
    target.write_bytes(b"y")
    assert PB.moved_to(str(source), str(target), 3_000_000, digest) == "output_exists" and target.read_bytes() == b"y"
    assert sorted(os.listdir(tmp_path)) == ["a", "far"] and os.listdir(tmp_path / "far") == ["b"]


def test_duplicates_are_removed_only_if_unchanged(spark, tmp_path):
    names = {"a/x.txt": b"same", "b/x.txt": b"same", "c/x.txt": b"same", "d/x.txt": b"same", "e/y.txt": b"same"}
    for n, data in names.items():
        (tmp_path / n).parent.mkdir()
        (tmp_path / n).write_bytes(data)
    digest = hashlib.sha256(b"same").hexdigest()
    rows = [(f"{tmp_path}/a/x.txt", f"{tmp_path}/{n}", 4, digest) for n in names]
    df = spark.createDataFrame(rows, "keep string, duplicate string, size long, sha256 string").withColumn("name", F.element_at(F.split("duplicate", "/"), -1))
    plan = P.numbered(df, "name", "duplicate").drop("name").cache()
    (tmp_path / "d/x.txt").write_bytes(b"changed")
    backup = tmp_path / "backup"
    for again in (False, True):
        got = {r.duplicate[len(str(tmp_path)) + 1 :]: (r.outcome, r.error) for r in PB.remove_duplicates(plan, str(backup)).collect()}
        done = "gone" if again else "moved"
        assert got == {"a/x.txt": ("", "same_file"), "b/x.txt": (done, ""), "c/x.txt": (done, ""), "d/x.txt": ("", "duplicate_changed"), "e/y.txt": (done, "")}
    assert sorted(os.listdir(backup)) == ["x_1.txt", "x_2.txt", "y.txt"]
    back = spark.createDataFrame([(f"{backup}/x_1.txt", f"{tmp_path}/b/x.txt"), (f"{backup}/x_2.txt", f"{tmp_path}/d/x.txt"), (f"{backup}/no", f"{tmp_path}/n")], "stored string, path string")
    assert [(r.outcome, r.error) for r in PB.restore(back).collect()] == [("restored", ""), ("", "output_exists"), ("", "input_not_found")]
    (tmp_path / "a/x.txt").write_bytes(b"else")
    assert {r.error for r in PB.remove_duplicates(plan.where("duplicate like '%b/x.txt'")).collect()} == {"keep_changed"}
    assert (tmp_path / "b/x.txt").exists()
