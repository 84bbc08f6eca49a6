import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import scalars as S
from orrery.operators import compare as C
from orrery.operators import dedup as D
from orrery.operators import pixels
from orrery.operators import planning as P
from orrery.operators.graph import components
from orrery.plans import arguments as A
from orrery.plans import documents as PD
from orrery.sources import files as SRC
from orrery.streaming import arrivals as ST


def linked(pairs):
    """Groups of what pairs connect."""
    out = []
    for p in pairs:
        near = [g for g in out if g & set(p)]
        out = [g for g in out if g not in near] + [set(p).union(*near)]
    return {frozenset(g) for g in out}


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize(("tile", "threshold"), [(2048, 5), (8, 5), (16, 18), (2048, 0)])
def test_hamming_pairs_equal_brute_force(spark, tile, threshold, monkeypatch):
    monkeypatch.setattr(D, "TILE", tile)
    rng = random.Random(42)
    hashes = [rng.getrandbits(64) for _ in range(120)] + [(1 << 64) - 1, 1 << 63, 0]
    for h in hashes[:30]:  # chains, equal hashes, and distances around the threshold
        a = h ^ sum(1 << b for b in rng.sample(range(64), 3))
        hashes += [a, a ^ sum(1 << b for b in rng.sample(range(64), 3)), h, h ^ sum(1 << b for b in rng.sample(range(64), 5)), h ^ sum(1 << b for b in rng.sample(range(64), 6))]
    df = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)] + [(9999, None)], "k long, h long")
    got = {(r.a, r.b): r.distance for r in D.hamming_pairs(df, "k", "h", threshold).collect()}
    want = {(i, j): (x ^ y).bit_count() for (i, x), (j, y) in itertools.combinations(enumerate(hashes), 2) if (x ^ y).bit_count() <= threshold}
    assert got == want
    groups = {}
    for r in D.similar_groups(df.withColumn("s", F.lit(1)), "k", "h", "s", threshold).collect():
        groups.setdefault(r.component, set()).add(r.k)
    assert all(min(g) == c for c, g in groups.items()) and {frozenset(g) for g in groups.values()} == linked(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 230)] + [(1, 2), (2, 1), (3, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[k] for k in range(200, 230)} == {7} and got[2] == 1 and 3 not in got


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bb"), (4, None), (5, None), (6, ""), (7, "")], "k long, c string")
    got = {(r.keep, r.duplicate) for r in D.exact_duplicates(df, "k", "c").collect()}
    assert got == {(1, 2), (6, 7)}


def test_similar_groups_keep_the_largest(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 1, 9), (3, 3, 9), (4, -1, 1)], "k long, h long, size long")
    assert {tuple(r) for r in D.similar_groups(df, "k", "h", "size", 1).collect()} == {(1, 1, 2), (1, 2, 2), (1, 3, 2)}


@pytest.mark.parametrize(
    ("text", "seconds"), [("90", 90), ("1:30", 90), ("01:02:03.5", 3723.5), ("0:75", 75), ("", None), ("-1", None), ("1:2:3:4", None), ("inf", None), ("nan", None), ("a", None)]
)
def test_timecode(spark, text, seconds):
    assert spark.range(1).select(S.timecode(F.lit(text))).first()[0] == seconds


def test_thumbnail_times(spark):
    rows = [("25%", 30.0), ("0%", 0.0), ("100%", 120.0), ("150%", None), ("x%", None), ("-1%", None), ("1:00", 60.0)]
    df = spark.createDataFrame(rows, "s string, want double").withColumn("got", S.thumbnail_time(F.col("s"), F.lit(120.0)))
    assert all(r.got == r.want for r in df.collect())


def test_psnr_and_sizes(spark):
    r = spark.range(1).select(S.psnr(F.lit(0.0)), S.psnr(F.lit(65025.0)), S.human_size(F.lit(0)), S.human_size(F.lit(1023)), S.human_size(F.lit(1280)), S.dimensions(F.lit("640x480")), S.dimensions(F.lit("0x9")), S.aspect_ratio(F.lit("16:9")), S.crop_box(F.lit("1,2,3,4"))).first()
    assert r[0] == math.inf and r[1] == 0 and list(r[2:5]) == ["0.0 B", "1023.0 B", "1.2 KB"]
    assert tuple(r[5]) == (640, 480) and r[6] is None and tuple(r[7]) == (16, 9) and tuple(r[8]) == (1, 2, 3, 4)


def test_globs():
    import re

    cases = [("*.jpg", "a/b.jpg", True), ("*.jpg", "a/b.jpeg", False), ("*/thumbs/*", "src/thumbs/t.png", True), ("a?c", "abc", True), ("[!a]b", "xb", True), ("[!a]b", "ab", False), ("a.b", "axb", False)]
    for pattern, path, want in cases:
        assert bool(re.search(P.glob_regex(pattern), path)) == want


def test_budget_is_not_monotone(spark):
    rows = [(1, q, 400 if q not in (9, 10) else 325 + (9 if q == 10 else 10)) for q in range(1, 101)]
    got = P.best_under_budget(spark.createDataFrame(rows, "f int, q int, bytes int"), "f", "q", "bytes", F.lit(334)).first()
    assert (got.q, got.bytes, got.error) == (10, 334, "")
    got = P.best_under_budget(spark.createDataFrame(rows, "f int, q int, bytes int"), "f", "q", "bytes", F.lit(3)).first()
    assert got.error == "target_size_unreachable: minimum=334 target=3"


def test_plan_documents(spark):
    step = '{"input":"a","command":"convert","arguments":{"to":"webp"}}'
    docs = [f"[{step}]", f'{{"plans":[{step}]}}', step, '{"results":[{"input":"a","plan":{"command":"convert","arguments":{"to":"webp"}}},{"input":"b","plan":{}}]}', "{}", '[{"command":"convert"}]', "[1]", "nonsense"]
    rows = PD.read_plans(spark.createDataFrame(list(enumerate(docs)), "id int, doc string"), "doc").collect()
    good = {r.id for r in rows if not r.error}
    assert good == {0, 1, 2, 3} and all((r.input, r.command, r.arguments) == ("a", "convert", {"to": "webp"}) for r in rows if not r.error)
    assert {r.id: r.error for r in rows if r.error} == {4: "unrecognized_plan_document", 5: "missing_input", 6: "invalid_plan_step", 7: "unrecognized_plan_document"}


def test_plan_validation(spark):
    rows = [
        ("convert", {"to": "exe"}, "unsupported_target_format"), ("convert", {}, "missing_target_format"), ("convert", {"format": "JPEG", "quality": "odd"}, "unsupported_quality"), ("convert", {"to": "png", "color_space": "lab"}, "unsupported_color_space"),
        ("video.compress", {"crf": "64"}, "invalid_crf"), ("video.compress", {"preset": "small"}, "unsupported_video_preset:small"), ("video.compress", {"codec": "vp8"}, "unsupported_video_codec:vp8"), ("video.compress", {"preset": "tiny"}, ""),
        ("video.convert", {"to": "avi"}, "unsupported_target_container:avi"), ("video.convert", {}, "unsupported_target_container:?"), ("video.convert", {"to": "mp4", "codec": "vp9"}, "unsupported_codec_for_container:vp9:mp4"),
        ("video.convert", {"to": ".MKV", "audio_policy": "Compact"}, ""), ("video.convert", {"to": "mkv", "audio_policy": "drop"}, "unsupported_audio_policy:drop"), ("strip", {"mode": "half"}, "unsupported_strip_mode:half"), ("strip", {}, ""), ("keep", {}, ""),
        ("compress", {"preset": "odd"}, "unsupported_compress_preset"), ("compress", {"quality": "0"}, "invalid_quality"), ("compress", {"quality": "80"}, ""), ("launch", {}, "unsupported_plan_command"),
    ]
    df = spark.createDataFrame([("a", c, a, "", w) for c, a, w in rows], "input string, command string, arguments map<string,string>, error string, want string")
    assert all(r.error == r.want for r in PD.validated(df).collect())


def test_argument_lists(spark):
    r = spark.range(1).select(A.compress(F.lit("a"), F.lit("b")), A.concat_list(F.array(F.lit("it's"), F.lit("b"))), A.concat_list(F.array(F.lit("a\nb")))).first()
    assert r[0] == "-i a -map 0:V:0 -map 0:a:0? -sn -dn -c:v libx264 -crf 23 -preset medium -c:a aac -b:a 192000 -movflags +faststart b".split()
    assert r[1] == "file 'it'\\''s'\nfile 'b'\n" and r[2] is None
    a, b = F.lit("a"), F.lit("b")
    for code, line in {
        "gif_fps_out_of_range": lambda: A.gif(a, b, fps=0), "gif_width_out_of_range": lambda: A.gif(a, b, width=5000), "unsupported_hwaccel:qsv:vp9": lambda: A.compress(a, b, codec="vp9", backend="qsv"), "unsupported_video_preset:small": lambda: A.compress(a, b, "small"),
        "unsupported_codec_for_container:vp9:mp4": lambda: A.convert(a, b, "mp4", "vp9"), "unsupported_target_container:avi": lambda: A.convert(a, b, "avi"), "unsupported_audio_format:ogg": lambda: A.extract_audio(a, b, "ogg"), "unsupported_audio_policy:drop": lambda: A.convert(a, b, "mp4", policy="drop"),
        "trim_end_and_duration_are_mutually_exclusive": lambda: A.trim(a, b, F.lit(0.0), F.lit(1.0), F.lit(1.0)), "unsupported_codec_for_container:h264:webm": lambda: A.concat(a, b, "webm", reencode=True),
    }.items():
        with pytest.raises(ValueError, match=code):
            line()
    bad = spark.range(1).select(A.trim(a, b, F.lit(3.0), end=F.lit(2.0)), A.thumbnail(a, b, F.lit(-1.0)), A.gif(a, b, F.lit(-1.0)), A.bitrate_pass(a, b, "h264", F.lit(0), False, None, a), A.concat_segment(a, b, F.lit(0), F.lit(1), F.lit(25.0), True, True)).first()
    assert list(bad) == [None] * 5
    assert [A.hardware_scale(c) for c in (0, 23, 51, 60)] == [100, 56, 1, 1] and A.video_options("h265", 22, "slow", "videotoolbox") == ["-c:v", "hevc_videotoolbox", "-q:v", "58", "-tag:v", "hvc1"]


def segment(kind, body):
    return bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body


def test_jpeg_strip(spark):
    scan = segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + b"\x12\xff\x00\x34\xff\xd0\x56"
    jpeg = b"\xff\xd8" + segment(0xE0, b"JFIF\x00") + segment(0xE1, b"Exif..secret") + segment(0xFE, b"comment") + segment(0xEE, b"Adobe") + segment(0xDB, b"\x00" * 65) + scan + b"\xff\xd9"
    clean = b"\xff\xd8" + segment(0xE0, b"JFIF\x00") + segment(0xEE, b"Adobe") + segment(0xDB, b"\x00" * 65) + scan + b"\xff\xd9"
    rows = pixels.strip_jpegs(spark.createDataFrame([(jpeg,), (jpeg[:-1],), (b"png",), (None,)], "content binary")).collect()
    assert bytes(rows[0].stripped) == clean and [r.error for r in rows] == ["", "truncated_jpeg", "not_a_jpeg", "missing_input"]


def test_pixel_kernels():
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (pixels.transform(a, 90)[0, 0] == a[1, 0]).all() and (pixels.transform(a, 360) == a).all()
    assert (pixels.oriented(pixels.oriented(a, 6), 8) == a).all() and (pixels.oriented(a, 3) == a[::-1, ::-1]).all()
    mark = np.full((1, 1, 4), 255, np.uint8)
    assert (pixels.overlay(a, mark, 3, 1, 255)[1, 3] == 255).all() and (pixels.overlay(a, mark, 9, 9) == a).all()
    assert (pixels.flatten(np.array([[[10, 20, 30, 0]]], np.uint8)) == 255).all()
    assert (pixels.resized(a, 2, 1)[0, 0] == np.rint(a[:, :2].mean(axis=(0, 1)))).all()


def png(w, h, rgb):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\x00" + bytes(rgb) * w) * h)) + chunk(b"IEND", b"")


def test_scan_decode_and_stream(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.png").write_bytes(png(16, 16, (255, 0, 0)))
    (tmp_path / "in" / "sub" / "b.PNG").write_bytes(png(8, 8, (0, 0, 255)))
    (tmp_path / "in" / "c.png").write_bytes(b"broken")
    (tmp_path / "in" / "d.txt").write_text("text")
    assert SRC.scan(spark, str(tmp_path / "in"), [".png"]).count() == 3
    assert SRC.scan(spark, str(tmp_path / "in"), recursive=False, content=False).columns == ["path", "modificationTime", "length"]
    got = {r.origin.rsplit("/", 1)[1]: r.samples for r in pixels.samples(SRC.images(spark, str(tmp_path / "in"))).collect()}
    assert got["a.png"] == [76] * 64 and got["c.png"] is None
    for _ in range(2):
        ST.run_once(ST.arrivals(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_rake_free_summaries(spark):
    df = spark.createDataFrame([("a", True, 10, 5), ("b", False, 20, 7)], "n string, ok boolean, i long, o long")
    r = P.batch_summary(df, [], F.col("ok"), F.col("i"), F.col("o")).first()
    assert (r.total, r.success, r.failed, r.input_bytes, r.output_bytes) == (2, 1, 1, 30, 5)
    assert P.all_ok(spark.createDataFrame([], "error string"), "error").first().ok is True


def plain_ssim(a, b, ma, mb):
    n = len(a)
    va, vb = sum((x - ma) ** 2 for x in a) / n, sum((y - mb) ** 2 for y in b) / n
    cab = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / n
    return (2 * ma * mb + 6.5025) * (2 * cab + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))


def test_blur_is_a_blur():
    assert (C.blurred(np.full((9, 13), 77)) == 77).all()
    dot = np.zeros((41, 41), int)
    dot[20, 20] = 255
    out = C.blurred(dot * 1)
    assert out.shape == dot.shape and out[20, 20] == out.max() and abs(out - out.T).max() <= 1 and abs(out - out[::-1]).max() <= 1
    ramp = np.repeat(np.arange(0, 240, 4)[None], 30, axis=0)
    assert abs(C.blurred(ramp)[:, 15:-15] - ramp[:, 15:-15]).max() <= 1


def test_compare_pictures(spark):
    rng = np.random.default_rng(3)
    big = rng.integers(0, 256, (96, 130, 3))
    small = rng.integers(0, 256, (20, 30, 4))
    swapped = np.zeros((70, 70, 3), int)
    swapped[..., 0] = 200
    other = np.zeros((70, 70, 3), int)
    other[..., 1], other[..., 2] = 100, 10  # about as bright, another colour
    clear = np.concatenate((big, np.full((96, 130, 1), 255)), axis=2)
    gone = clear.copy()
    gone[:, 60:, 3] = 0
    pack = lambda v: (bytes(v.astype(np.uint8).ravel()), v.shape[1], v.shape[0], v.shape[2])
    noisy = np.clip(big + rng.integers(-20, 21, big.shape), 0, 255)
    rows = [(0, pack(big), pack(big)), (1, pack(big), pack(noisy)), (2, pack(small), pack(np.clip(small + 3, 0, 255))), (3, pack(swapped), pack(other)), (4, pack(clear), pack(gone)), (5, pack(big), pack(small)), (6, None, pack(big)), (7, (b"", -1, -1, -1), pack(big))]
    kind = "struct<data:binary,width:int,height:int,nChannels:int>"
    got = {r.id: r for r in C.compare_pictures(spark.createDataFrame(rows, f"id int, a {kind}, b {kind}"), "a", "b").collect()}
    assert (got[0].mse, got[0].ssim, got[0].block_ssim, got[0].psnr) == (0.0, 1.0, 1.0, math.inf)
    assert math.isclose(got[1].mse, sum(((big[..., k] - noisy[..., k]) ** 2).mean() for k in range(3)) / 4)
    for i, (x, y) in {1: (big, noisy), 2: (small, np.clip(small + 3, 0, 255)), 4: (clear, gone)}.items():
        p, q = C.planes(*pack(x))[1], C.planes(*pack(y))[1]
        whole = min(plain_ssim(u.ravel().tolist(), v.ravel().tolist(), C.blurred(u).mean(), C.blurred(v).mean()) for u, v in zip(p, q, strict=True))
        assert math.isclose(got[i].ssim, max(0.0, whole), rel_tol=1e-9)
        if min(x.shape[:2]) >= 64:
            blocks = [[(u[t : t + 64, s : s + 64].ravel().tolist(), v[t : t + 64, s : s + 64].ravel().tolist()) for t in range(0, x.shape[0] - 63, 32) for s in range(0, x.shape[1] - 63, 32)] for u, v in zip(p, q, strict=True)]
            means = [np.mean([plain_ssim(m, n, sum(m) / 4096, sum(n) / 4096) for m, n in channel]) for channel in blocks]
            assert math.isclose(got[i].block_ssim, max(0.0, min(means)), rel_tol=1e-9, abs_tol=1e-12)
        else:
            assert got[i].block_ssim == got[i].ssim
    assert got[3].block_ssim < 0.95 and got[4].block_ssim < 0.9
    assert [got[i].error for i in (5, 6, 7)] == ["size_mismatch", "unreadable_picture", "unreadable_picture"] and got[6].mse is None


def test_names_under_file_systems(spark):
    from orrery.operators import planning as P

    names = ["Café", "Café", "CAFÉ", "straße", "STRASSE", "cafe", "a/b", "A/B"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, o string")
    groups = lambda s: sorted((r.first, r.n) for r in P.collisions(df, "k", "o", s).select("first", "n").collect())
    assert groups("posix") == [] and groups("windows") == [(0, 2), (6, 2)] and groups("macos") == [(0, 3), (3, 2), (6, 2)]
    pairs = spark.createDataFrame([("/in/Café", "/out/x"), ("/in/y", "/in/CAFÉ"), ("/in/z", "/IN/Z")], "s string, o string")
    assert P.aliases(pairs, "s", "o").count() == 0 and [r.s for r in P.aliases(pairs, "s", "o", "macos").collect()] == ["/in/y"]
    paths = spark.createDataFrame([("/Café/out/x",), ("/café/OUT",), ("/Café/outer/x",), ("/Caf",), (None,)], "p string")
    inside = lambda s: [r[0] for r in paths.select(P.below_root(F.col("p"), "/CAFÉ/out", s)).collect()]
    assert inside("macos") == [True, False, False, False, False] and inside("posix") == [False] * 5
    with pytest.raises(ValueError, match="unsupported_file_system"):
        P.same_name(F.col("p"), "vms")
