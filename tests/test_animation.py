"""Animations: plain decoders, a plain fold, and round trips."""

import io
import random
import struct
import zlib

import numpy as np
import pytest

from orrery.operators import pictures as PX
from orrery.sources import animation as A


def plain_lzw(pixels, low):
    """GIF's codes by a dictionary of strings, cleared when it is full."""
    clear, out, bits, held = 1 << low, bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        bits |= code << held
        held += width
        while held >= 8:
            out.append(bits & 255)
            bits >>= 8
            held -= 8

    table, width = {bytes([k]): k for k in range(clear)}, low + 1
    put(clear, width)
    word = b""
    for p in pixels:
        both = word + bytes([p])
        if both in table:
            word = both
            continue
        put(table[word], width)
        if len(table) + 2 < 4096:
            table[both] = len(table) + 2
            if len(table) + 2 > 1 << width and width < 12:
                width += 1
        else:
            put(clear, width)
            table, width = {bytes([k]): k for k in range(clear)}, low + 1
        word = bytes([p])
    if word:
        put(table[word], width)
    put(clear + 1, width)
    put(0, 7)
    return bytes(out)


@pytest.mark.parametrize("low,n,kinds", [(2, 1, 4), (2, 500, 3), (8, 30000, 256), (8, 60000, 3), (4, 9000, 16), (8, 5000, 1)])
def test_lzw_equals_a_plain_coder(low, n, kinds):
    rng = np.random.default_rng(n)
    pixels = rng.integers(0, kinds, n).astype(np.uint8)
    assert (A.unpacked_lzw(plain_lzw(pixels.tolist(), low), low, n) == pixels).all()
    if low == 8:
        assert (A.unpacked_lzw(A.packed_lzw(pixels), 8, n) == pixels).all()


def test_lzw_of_broken_codes():
    with pytest.raises(A.Broken):
        A.unpacked_lzw(b"\xff" * 40, 8, 100)
    assert (A.unpacked_lzw(plain_lzw([1, 2, 3], 2), 2, 9) == [1, 2, 3, 0, 0, 0, 0, 0, 0]).all()  # cut short


def plain_unfilter(raw, step):
    out, up = [], [0] * (raw.shape[1] - 1)
    for line in raw.tolist():
        kind, now = line[0], []
        for i, x in enumerate(line[1:]):
            a, b, c = now[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now.append((x + [0, a, b, (a + b) // 2, guess][kind]) & 255)
        out.append(now)
        up = now
    return np.array(out, np.uint8)


@pytest.mark.parametrize("height,units,step", [(1, 1, 1), (7, 5, 3), (20, 33, 4), (33, 2, 6)])
def test_filters_equal_a_plain_reader(height, units, step):
    rng = np.random.default_rng(height)
    raw = rng.integers(0, 256, (height, 1 + units * step)).astype(np.uint8)
    raw[:, 0] = rng.integers(0, 5, height)
    assert (A.unfiltered(raw, height, units * step, step) == plain_unfilter(raw, step)).all()


def gif(width, height, frames, loop=None, shared=None, low=8):
    """frames: (left, top, indices, palette or None, delay, disposal, transparent or None, interlaced)."""
    table = lambda c: bytes(c) + bytes(3 * 256 - len(c))
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7 if shared else 0x70, 0, 0) + (table(shared) if shared else b"")
    out += b"\x21\xfe\x05hello\0"
    if loop is not None:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loop) + b"\0"
    for left, top, index, colours, delay, disposal, clear, interlaced in frames:
        if delay is not None:
            out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
        h, w = index.shape
        lines = [y for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(s, h, d)] if interlaced else range(h)
        coded = plain_lzw(index[list(lines)].ravel().tolist(), low)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x87 if colours else 0) | 0x40 * interlaced) + (table(colours) if colours else b"") + bytes([low])
        out += b"".join(bytes([len(coded[k : k + 200])]) + coded[k : k + 200] for k in range(0, len(coded), 200)) + b"\0"
    return out + b"\x3b"


def fold(width, height, frames, shared):
    canvas, out = np.zeros((height, width, 4), np.uint8), []
    for left, top, index, colours, _, disposal, clear, _ in frames:
        before = canvas.copy()
        table = np.array(colours or shared).reshape(-1, 3)
        for y in range(index.shape[0]):
            for x in range(index.shape[1]):
                if index[y, x] != (clear if clear is not None else -1):
                    canvas[top + y, left + x] = [*table[index[y, x]], 255]
        out.append(canvas.copy())
        if disposal == 2:
            canvas[top : top + index.shape[0], left : left + index.shape[1]] = 0
        elif disposal == 3:
            canvas = before
    return out


def some_gif(seed):
    rng = np.random.default_rng(seed)
    width, height, shared = 13, 9, rng.integers(0, 256, 30).tolist()
    frames = []
    for k in range(12):
        whole = rng.random() < 0.4 or k == 0 and rng.random() < 0.5
        w, h = (width, height) if whole else (int(rng.integers(1, width)), int(rng.integers(1, height)))
        left, top = (0, 0) if whole else (int(rng.integers(0, width - w + 1)), int(rng.integers(0, height - h + 1)))
        own = rng.integers(0, 256, 30).tolist() if rng.random() < 0.3 else None
        frames.append((left, top, rng.integers(0, 10, (h, w)), own, int(rng.integers(0, 30)), int(rng.integers(0, 4)), int(rng.integers(0, 10)) if rng.random() < 0.5 else None, bool(rng.random() < 0.4)))
    return width, height, frames, shared


def shown(r):
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 4)[..., [2, 1, 0, 3]]


def test_composition_equals_a_plain_fold(spark):
    files = {f"g{k}": some_gif(k) for k in range(5)}
    df = spark.createDataFrame([(n, gif(w, h, f, 3, c)) for n, (w, h, f, c) in files.items()], "origin string, content binary")
    found = A.frames(df)
    assert found.where("key AND frame > 0").count() > 0  # folds start anew
    rows = A.composed(found).collect()
    for name, (w, h, frames, shared) in files.items():
        mine = sorted((r for r in rows if r.origin == name), key=lambda r: r.frame)
        assert [r.frame for r in mine] == list(range(12)) and {(r.frames, r.loop, r.error) for r in mine} == {(12, 3, "")}
        first = frames[0][4] * 10 or 100
        assert [r.duration_ms for r in mine] == [f[4] * 10 or first for f in frames]
        for r, want in zip(mine, fold(w, h, frames, shared), strict=True):
            assert (shown(r) == want)[want[..., 3] > 0].all() and (shown(r)[..., 3] == want[..., 3]).all()
            assert r.mode == ("RGB" if (want[..., 3] == 255).all() else "RGBA")


def solid(h, w, *colour):
    return np.full((h, w, len(colour)), colour, np.uint8)


def apng(parts, loop, poster=None, size=(24, 24)):
    out = A.PNG + A._chunk(b"IHDR", struct.pack(">IIBBBBB", *size, 8, 6, 0, 0, 0)) + A._chunk(b"acTL", struct.pack(">II", len(parts), loop))
    data = lambda a: zlib.compress(np.concatenate((np.zeros((a.shape[0], 1), np.uint8), a.reshape(a.shape[0], -1)), axis=1).tobytes())
    if poster is not None:
        out += A._chunk(b"IDAT", data(poster))
    n = 0
    for k, (a, left, top, num, den, dispose, blend) in enumerate(parts):
        out += A._chunk(b"fcTL", struct.pack(">IIIIIHHBB", n, a.shape[1], a.shape[0], left, top, num, den, dispose, blend))
        n += 1
        if k == 0 and poster is None:
            body = data(a)
            out += A._chunk(b"IDAT", body[:7]) + A._chunk(b"IDAT", body[7:])
        else:
            out += A._chunk(b"fdAT", struct.pack(">I", n) + data(a))
            n += 1
    return out + A._chunk(b"IEND", b"")


def test_known_rows(spark):
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    plain = [(0, 0, np.full((32, 32), k), None, (k + 1) * 10, 2, None, False) for k in range(3)]
    half = [(solid(24, 24, 255, 0, 0, 255), 0, 0, 120, 1000, 0, 0), (solid(24, 24, 0, 255, 0, 128), 0, 0, 12, 100, 0, 0)]
    over = [(solid(24, 24, 255, 0, 0, 255), 0, 0, 1, 0, 0, 0), (solid(2, 3, 0, 0, 255, 128), 5, 6, 0, 0, 2, 1), (solid(1, 1, 9, 9, 9, 0), 0, 0, 5, 10, 1, 0)]
    still = PX.png(solid(3, 2, 7, 8, 9))
    rows = [
        ("gif", gif(32, 32, plain, 2, [*red, *green, *blue])), ("apng", apng(half, 1)), ("poster", apng(over, 0, solid(24, 24, 1, 2, 3, 255))), ("still", still), ("none", None), ("text", b"not a picture"), ("cut", gif(32, 32, plain, 2, [*red])[:-400]), ("torn", still[:-20] + b"x" * 20),
        ("out", gif(8, 8, plain, 2, [*red])), ("large", b"GIF89a" + struct.pack("<HHBBB", 60000, 60000, 0xF0, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x01\x00\0\x3b"),
    ]
    got = A.composed(A.frames(spark.createDataFrame(rows, "origin string, content binary"))).collect()
    told = {o: [(r.frame, r.duration_ms, r.loop, r.mode, r.poster) for r in sorted((r for r in got if r.origin == o), key=lambda r: r.frame)] for o in ("gif", "apng", "poster", "still")}
    assert told == {
        "gif": [(0, 100, 2, "RGB", False), (1, 200, 2, "RGB", False), (2, 300, 2, "RGB", False)], "apng": [(0, 120, 1, "RGB", False), (1, 120, 1, "RGBA", False)],
        "poster": [(-1, 100, 0, "RGB", True), (0, 10, 0, "RGB", False), (1, 100, 0, "RGB", False), (2, 500, 0, "RGBA", False)], "still": [(0, 100, None, "RGB", False)],
    }
    over = {r.frame: shown(r) for r in got if r.origin == "poster"}
    assert over[1][6, 5].tolist() == [127, 0, 128, 255] and over[2][6, 5].tolist() == [255, 0, 0, 255] and over[2][0, 0, 3] == 0
    assert {r.origin: r.error for r in got if r.error} == {"none": "missing_content", "text": "unsupported_animation", "cut": "broken_gif", "torn": "broken_png", "out": "frame_outside_canvas", "large": "image_too_large"}


def test_kinds_of_png(spark):
    rng = np.random.default_rng(2)

    def png(kind, depth, lines, *chunks):
        h, w = 5, 6
        body = b"".join(b"\0" + np.asarray(x, np.uint8).tobytes() for x in lines)
        return A.PNG + A._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + b"".join(A._chunk(*c) for c in chunks) + A._chunk(b"IDAT", zlib.compress(body)) + A._chunk(b"IEND", b"")

    grey, index, deep = rng.integers(0, 256, (5, 6)), rng.integers(0, 4, (5, 6)), rng.integers(0, 256, (5, 6, 3, 2))
    four = [[(a << 4) | b for a, b in zip(x[::2], x[1::2])] for x in index.tolist()]
    colours = rng.integers(0, 256, 12).astype(np.uint8)
    made = {
        "grey": (png(0, 8, grey), np.dstack([grey] * 3 + [np.full((5, 6), 255)])), "clear": (png(0, 8, grey, (b"tRNS", struct.pack(">H", int(grey[0, 0])))), np.dstack([grey] * 3 + [np.where(grey == grey[0, 0], 0, 255)])),
        "four": (png(0, 4, four), np.dstack([index * 17] * 3 + [np.full((5, 6), 255)])), "palette": (png(3, 4, four, (b"PLTE", colours.tobytes()), (b"tRNS", b"\x05")), np.dstack([colours.reshape(4, 3)[index], np.where(index == 0, 5, 255)])),
        "deep": (png(2, 16, deep.reshape(5, -1)), np.dstack([deep[..., 0], np.full((5, 6), 255)])),
    }
    rows = A.frames(spark.createDataFrame([(k, bytearray(v[0])) for k, v in made.items()], "origin string, content binary")).collect()
    assert {r.origin: r.error for r in rows} == dict.fromkeys(made, "")
    for r in rows:
        assert (np.frombuffer(r.data, np.uint8).reshape(5, 6, 4) == made[r.origin][1]).all(), r.origin


def test_round_trips_and_steps(spark):
    rng = random.Random(1)
    frames = [(0, 0, np.array([[rng.randrange(5) for _ in range(8)] for _ in range(6)]), None, 10 * k + 10, 0, 2 if k % 2 else None, False) for k in range(4)]
    df = spark.createDataFrame([("a", gif(8, 6, frames, 5, list(range(15)))), ("bad", b"x"), ("once", gif(8, 6, frames[:1], None, list(range(15))))], "origin string, content binary")
    whole = A.composed(A.frames(df)).cache()
    want = {(r.origin, r.frame): (r.duration_ms, r.loop, shown(r)) for r in whole.collect() if not r.error}
    for fmt in ("gif", "png"):
        out = A.animated(whole, fmt).cache()
        assert {r.origin: (r.frames, r.error) for r in out.collect()} == {"a": (4, ""), "once": (1, ""), "bad": (None, "unsupported_animation")}
        again = {(r.origin, r.frame): r for r in A.composed(A.frames(out.where("error = ''"))).collect()}
        assert again.keys() == want.keys()
        for k, r in again.items():
            ms, loop, a = want[k]
            assert (r.duration_ms, r.loop) == (ms, loop if loop is not None or fmt == "gif" else 1)
            assert (shown(r)[..., 3] == a[..., 3]).all() and (shown(r) == a)[a[..., 3] > 0].all()
    (small,) = A.composed(A.frames(A.animated(whole.where("origin = 'a'"), "png", [("resize", 4, 3), ("flatten",)]))).where("frame = 2").collect()
    assert (small.width, small.height, small.mode) == (4, 3, "RGB")
    odd = whole.where("origin = 'a'").selectExpr("origin", "frame", "frames", "loop", "poster", "duration_ms + 5 AS duration_ms", "width", "height", "nChannels", "mode", "data", "error")
    assert [r.error for r in A.animated(odd, "gif").collect()] == ["animation_timing_not_representable:gif"]
    assert A.animated(whole.limit(0), "gif").count() == 0


def test_the_jvm_reads_what_is_written(spark, tmp_path):
    index = np.arange(48).reshape(6, 8) % 10
    (r,) = A.animated(A.composed(A.frames(spark.createDataFrame([("a", gif(8, 6, [(0, 0, index, None, 1, 0, None, False)], 0, list(range(30))))], "origin string, content binary"))), "gif").collect()
    (tmp_path / "a.gif").write_bytes(r.content)
    (seen,) = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    a = np.frombuffer(seen.data, np.uint8).reshape(seen.height, seen.width, seen.nChannels)[..., 2::-1]
    assert (a == np.arange(30).reshape(10, 3)[index]).all()
    assert io.BytesIO(r.content).read(6) == b"GIF89a"
