"""Animations as rows: the frames of GIF and PNG files, put together, processed and packed again.

A file is parsed into frames as they are stored: rectangles with a delay and
what becomes of them.  ``composed`` lays them on their canvas.  That is a fold
over a file's frames, but one that can start anew at every key frame (one that
replaces the whole canvas), so the runs between key frames are dealt to tasks
apart.  Frames are encoded apart, too; only their compressed pieces meet.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pictures import decoded, step
from ..operators.tables import written

LIMIT = 120_000_000  # pixels of all frames together
CODES = 8192  # cut out at once, if a clear code comes before
DEFAULT_MS = 100
PNG = b"\x89PNG\r\n\x1a\n"
KEEP, CLEAR, RESTORE = 0, 1, 2  # what becomes of a frame's place before the next one

FRAME = (
    "origin string, frame int, frames int, width int, height int, loop int, poster boolean, duration_ms int, left int, top int, frame_width int, frame_height int, "
    "disposal int, blend boolean, key boolean, data binary, error string"
)


class Broken(ValueError):
    """A file that can't be read; its text is a stable code."""


# -- GIF ------------------------------------------------------------------------------------------------------------


def _bits(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Numbers of the given widths (up to 12 bits) that start at bit positions, lowest bit first."""
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    k = at >> 3
    return ((padded[k] | padded[k + 1] << 8 | padded[k + 2] << 16) >> (at & 7)) & ((1 << width) - 1)


def unpacked_lzw(data: bytes, low: int, wanted: int) -> np.ndarray:
    """Pixels of LZW codes that begin with ``low`` + 1 bits.

    Between two clear codes the width of the n-th code is known beforehand, so
    all codes are cut out at once.  Each code repeats what an earlier one put
    out and the symbol behind it, which is a copy from the output itself:
    where each symbol comes from is found by following those copies back in
    ever doubled steps.
    """
    if not 2 <= low <= 8:
        raise Broken("broken_gif")
    raw, clear, out, bit, got, some = np.frombuffer(data, np.uint8), 1 << low, [], 0, 0, CODES
    number = np.arange(wanted + 3)  # a code puts out a pixel at least
    # before the n-th code after a clear n - 1 entries have been made
    size = np.clip(np.ceil(np.log2(clear + 3 + np.maximum(number - 1, 0))), low + 1, 12).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    while got < wanted:
        n = min(int(np.searchsorted(start, len(raw) * 8 - bit, "right")) - 1, some)
        codes = _bits(raw, bit + start[:n], size[:n])
        ends = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if not len(ends) and n == some:
            some *= 2  # no clear code yet: look further
            continue
        stop = int(ends[0]) if len(ends) else n
        if stop:
            out.append(_spelled(codes[:stop], clear))
            got += len(out[-1])
        if not len(ends) or codes[stop] == clear + 1:
            break
        bit += int(start[stop + 1])
    out = np.concatenate([np.zeros(0, np.uint8), *out])[:wanted]
    return np.concatenate((out, np.zeros(wanted - len(out), np.uint8)))


def _spelled(codes: np.ndarray, clear: int) -> np.ndarray:
    entry = codes - (clear + 2)  # entry k is what code k put out, and the next symbol
    literal = codes < clear
    n = len(codes)
    full = (1 << 12) - (clear + 2)  # entries that the table can hold
    if (~literal & ((entry >= np.arange(n)) | (entry >= full))).any() or n and not literal[0]:
        raise Broken("broken_gif")
    parent = np.where(literal, np.arange(n), entry)
    length, up = np.where(literal, 0, 1), parent.copy()
    while True:
        further = up[up]
        length = length + length[up]
        if (further == up).all():
            break
        up = further
    length = length + 1
    first = np.cumsum(length) - length
    total = int(length.sum())
    owner = np.repeat(np.arange(n), length)
    source = np.where(literal[owner], np.arange(total), first[parent[owner]] + np.arange(total) - first[owner])
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    symbol = np.zeros(total, np.uint8)
    symbol[first[literal]] = codes[literal]
    return symbol[source]


def _gif(data: bytes) -> tuple[int, int, int | None, list[dict]]:
    """(width, height, loop, frames) of a GIF."""
    try:
        width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
        at, shared = 13, None
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        loop, control, frames = None, None, []
        while at < len(data):
            kind = data[at]
            if kind == 0x3B:
                break
            if kind == 0x21:
                label, (body, at) = data[at + 1], _blocks(data, at + 2)
                if label == 0xF9 and len(body) >= 4:
                    control = struct.unpack("<BHB", body[:4])
                elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14 and body[11] == 1:
                    (loop,) = struct.unpack("<H", body[12:14])
                continue
            if kind != 0x2C:
                raise Broken("broken_gif")
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            colours = shared
            if flags & 0x80:
                n = 3 << ((flags & 7) + 1)
                colours, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
            low = data[at]
            body, at = _blocks(data, at + 1)
            if colours is None:
                raise Broken("broken_gif")
            packed, delay, clear = control or (0, 0, 0)
            frames.append({"left": left, "top": top, "w": w, "h": h, "ms": delay * 10, "disposal": {2: CLEAR, 3: RESTORE}.get(packed >> 2 & 7, KEEP), "colours": colours, "clear": clear if packed & 1 else -1, "low": low, "body": body, "interlaced": bool(flags & 0x40)})
            control = None
    except (struct.error, IndexError, ValueError) as error:
        raise Broken("broken_gif") from error
    if not frames or not width or not height:
        raise Broken("broken_gif")
    return width, height, loop, frames


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Joined sub-blocks, and where they end."""
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _gif_pixels(f: dict) -> np.ndarray:
    a = unpacked_lzw(f["body"], f["low"], f["w"] * f["h"]).reshape(f["h"], f["w"])
    if f["interlaced"]:
        lines = np.concatenate([np.arange(s, f["h"], d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
        a, stored = np.empty_like(a), a
        a[lines] = stored
    table = np.zeros((256, 4), np.uint8)
    table[: len(f["colours"]), :3] = f["colours"]
    table[:, 3] = 255
    if f["clear"] >= 0:
        table[f["clear"]] = 0
    return table[a]


# -- PNG ------------------------------------------------------------------------------------------------------------


def unfiltered(raw: np.ndarray, height: int, line: int, step_: int) -> np.ndarray:
    """Bytes of PNG lines without their filters.

    A byte depends on those before it, above it and before that, so all bytes
    of a diagonal (one a line, further left in lower lines) are done at once.
    """
    kinds = raw[:, 0].astype(np.int64)
    if (kinds > 4).any():
        raise Broken("broken_png")
    if not kinds.any():
        return raw[:, 1:]
    units = line // step_
    x = raw[:, 1:].reshape(height, units, step_).astype(np.int16)
    out = np.zeros((height + 1, units + 1, step_), np.int16)  # a line above and a unit before, of zeros
    for d in range(height + units - 1):
        y = np.arange(max(0, d - units + 1), min(height, d + 1))
        k = d - y
        a, b, c, kind = out[y + 1, k], out[y, k + 1], out[y, k], kinds[y][:, None]
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        add = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) >> 1, guess], 0)
        out[y + 1, k + 1] = (x[y, k] + add) & 255
    return out[1:, 1:].reshape(height, line).astype(np.uint8)


def _png(data: bytes) -> tuple[int, int, int | None, list[dict]]:
    """(width, height, loop, frames) of a PNG, animated or not; a picture that is no frame comes first, as poster."""
    try:
        at, head, colours, alpha, loop, frames, control, animated = 8, None, None, None, None, [], None, False
        while at < len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + size]
            if len(body) != size or zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
                raise Broken("broken_png")
            at += 12 + size
            if name == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif name == b"PLTE":
                colours = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif name == b"tRNS":
                alpha = body
            elif name == b"acTL":
                (_, loop), animated = struct.unpack(">II", body), True
            elif name == b"fcTL":
                _, w, h, left, top, num, den, dispose, blend = struct.unpack(">IIIIIHHBB", body)
                control = {"left": left, "top": top, "w": w, "h": h, "ms": int(num * 1000 / (den or 100)), "disposal": dispose if dispose <= 2 else KEEP, "blend": blend == 1, "parts": [], "poster": False}
                frames.append(control)
            elif name == b"IDAT":
                if control is None and not frames:
                    frames.append({"left": 0, "top": 0, "w": head[0], "h": head[1], "ms": 0, "disposal": KEEP, "blend": False, "parts": [], "poster": animated})
                (control or frames[0])["parts"].append(body)
            elif name == b"fdAT":
                control["parts"].append(body[4:])
            elif name == b"IEND":
                break
    except (struct.error, TypeError, IndexError, ValueError) as error:
        raise Broken("broken_png") from error
    if head is None or not frames or not all(f["parts"] for f in frames):
        raise Broken("broken_png")
    width, height, depth, kind, _, _, interlace = head
    if interlace or kind not in (0, 2, 3, 4, 6):
        raise Broken("unsupported_png")
    for f in frames:
        f |= {"depth": depth, "kind": kind, "colours": colours, "alpha": alpha}
    return width, height, loop, frames


def _png_pixels(f: dict) -> np.ndarray:
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[f["kind"]]
    bits, w, h = f["depth"] * channels, f["w"], f["h"]
    line = -(-w * bits // 8)
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(f["parts"])), np.uint8)[: h * (line + 1)].reshape(h, line + 1)
    except (zlib.error, ValueError) as error:
        raise Broken("broken_png") from error
    a = unfiltered(raw, h, line, max(1, bits // 8))
    if f["depth"] == 16:
        deep, a = a.reshape(h, w, channels, 2).astype(np.int64), a.reshape(h, w, channels, 2)[..., 0]
        deep = deep[..., 0] << 8 | deep[..., 1]
    else:
        if f["depth"] < 8:
            each = np.unpackbits(a, axis=1).reshape(h, -1, f["depth"])[:, :w]
            a = (each * (1 << np.arange(f["depth"])[::-1])).sum(axis=2).astype(np.uint8)
        a = a.reshape(h, w, channels)
        deep = a.astype(np.int64)
    solid = np.full((h, w, 1), 255, np.uint8)
    if f["kind"] == 3:
        if f["colours"] is None or a.max(initial=0) >= len(f["colours"]):
            raise Broken("broken_png")
        table = np.full(256, 255, np.uint8)
        table[: len(f["alpha"] or b"")] = np.frombuffer(f["alpha"] or b"", np.uint8)
        return np.concatenate((f["colours"][a[..., 0]], table[a]), axis=2)
    if f["alpha"] and f["kind"] in (0, 2):
        clear = np.array(struct.unpack(f">{channels}H", f["alpha"][: 2 * channels]))
        solid = np.where((deep == clear).all(axis=2, keepdims=True), 0, 255).astype(np.uint8)
    if f["depth"] < 8:
        a = (a.astype(np.int64) * 255 // ((1 << f["depth"]) - 1)).astype(np.uint8)
    if f["kind"] in (0, 4):
        return np.concatenate((np.repeat(a[..., :1], 3, axis=2), a[..., 1:] if f["kind"] == 4 else solid), axis=2)
    return a if f["kind"] == 6 else np.concatenate((a, solid), axis=2)


# -- operators ------------------------------------------------------------------------------------------------------


def _parsed(data: bytes | None):
    """Dicts of a file's frames, one after the other."""
    if data is None:
        raise Broken("missing_content")
    if data[:6] in (b"GIF87a", b"GIF89a"):
        (width, height, loop, found), pixels = _gif(data), _gif_pixels
    elif data[:8] == PNG:
        (width, height, loop, found), pixels = _png(data), _png_pixels
    else:
        raise Broken("unsupported_animation")
    if width * height * len(found) > LIMIT or sum(f["w"] * f["h"] for f in found) > LIMIT:
        raise Broken("image_too_large")
    playing = [f for f in found if not f.get("poster")]
    default = found[0]["ms"] if found[0]["ms"] > 0 else DEFAULT_MS
    number = 0
    for f in found:
        poster = bool(f.get("poster"))
        if f["left"] + f["w"] > width or f["top"] + f["h"] > height:
            raise Broken("frame_outside_canvas")
        a = pixels(f)
        whole = (f["left"], f["top"], f["w"], f["h"]) == (0, 0, width, height)
        blend = f.get("blend", True)
        key = number == 0 or whole and f["disposal"] != RESTORE and (not blend or bool((a[..., 3] == 255).all()))
        yield {
            "frame": -1 if poster else number, "frames": len(playing), "width": width, "height": height, "loop": loop, "poster": poster, "duration_ms": f["ms"] if f["ms"] > 0 else default, "left": f["left"], "top": f["top"],
            "frame_width": f["w"], "frame_height": f["h"], "disposal": f["disposal"], "blend": blend, "key": poster or key, "data": a.tobytes(), "error": "",
        }
        number += not poster


_NAMES = [c.split()[0] for c in FRAME.split(", ")]


def frames(df: DataFrame, origin: str = "origin", content: str = "content") -> DataFrame:
    """One row for each stored frame of GIF and PNG files (see ``FRAME``), ``data`` being its rectangle as RGBA.

    Delays are in milliseconds; where a frame has none it is the first frame's,
    or 100.  ``loop`` is as stored, null if the file doesn't say.  An animated
    PNG's picture that isn't played is a row of its own (``poster``, frame -1).
    A file that can't be read, whose frames leave the canvas, or with more than
    ``LIMIT`` pixels in all frames is one row with an error code; so are
    interlaced PNGs.  Still PNGs are one frame.  Repeated origins are files of
    their own only if their origins differ.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["o"], batch["c"], strict=True):
                try:
                    for row in _parsed(None if data is None else bytes(data)):  # a frame at a time
                        yield _frame_rows([{"origin": name} | row])
                except Broken as error:
                    yield _frame_rows([{"origin": name, "error": str(error)}])

    return df.select(F.col(origin).cast("string").alias("o"), F.col(content).alias("c")).mapInPandas(run, FRAME)


def _frame_rows(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES).astype(object)
    whole = {c: "Int32" for c in ("frame", "frames", "width", "height", "loop", "duration_ms", "left", "top", "frame_width", "frame_height", "disposal")}
    return out.where(out.notna(), None).astype(whole | {c: "boolean" for c in ("poster", "blend", "key")})


COMPOSED = "origin string, frame int, frames int, loop int, poster boolean, duration_ms int, width int, height int, nChannels int, mode string, data binary, error string"


def composed(found: DataFrame) -> DataFrame:
    """Whole pictures of :func:`frames`, in the image source's order of colours (``nChannels`` 4): see ``COMPOSED``.

    ``mode`` is RGBA if the picture has a pixel that isn't opaque, else RGB.
    Files with an error, of which some row has one, keep one row with it.
    """
    found = written(found)  # files are parsed once
    broken = found.where("error <> ''").select("origin", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in COMPOSED.split(", ")[1:-1]), "error").dropDuplicates(["origin"])
    good = found.where("error = ''").join(broken.select("origin"), "origin", "left_anti")
    run_of = F.sum(F.col("key").cast("int")).over(Window.partitionBy("origin").orderBy("frame"))
    # windows of numbers only; the pixels follow
    numbered = good.select("origin", "frame", "key").withColumn("run", run_of).drop("key")

    def fold(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        canvas = None
        for r in rows.sort_values("frame").itertuples(index=False):
            if canvas is None:
                canvas = np.zeros((r.height, r.width, 4), np.uint8)
            place = (slice(r.top, r.top + r.frame_height), slice(r.left, r.left + r.frame_width))
            before = canvas[place].copy()
            canvas[place] = laid(before, np.frombuffer(r.data, np.uint8).reshape(r.frame_height, r.frame_width, 4), r.blend)
            opaque = bool((canvas[..., 3] == 255).all())
            yield r.frame, canvas[..., [2, 1, 0, 3]].tobytes(), "RGB" if opaque else "RGBA"
            if r.disposal == CLEAR:
                canvas[place] = 0
            elif r.disposal == RESTORE:
                canvas[place] = before

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        out = rows[["origin", "frame", "frames", "loop", "poster", "duration_ms", "width", "height"]].copy()
        made = list(fold(rows))
        out["nChannels"], out["mode"], out["data"], out["error"] = 4, [m for _, _, m in made], [d for _, d, _ in made], ""
        out["loop"] = out["loop"].astype("Int32")
        return out

    whole = good.join(numbered, ["origin", "frame"]).groupBy("origin", "run").applyInPandas(run, COMPOSED)
    return whole.unionByName(broken)


def laid(under: np.ndarray, over: np.ndarray, blend: bool) -> np.ndarray:
    """RGBA on RGBA: replaced, or blended by alpha."""
    if not blend:
        return over
    a, b = over[..., 3:].astype(np.int64), under[..., 3:].astype(np.int64)
    alpha = a * 255 + b * (255 - a)  # in 65025ths
    colours = (over[..., :3] * a * 255 + under[..., :3] * b * (255 - a) + alpha // 2) // np.maximum(alpha, 1)
    out = np.concatenate((colours, (alpha + 127) // 255), axis=2).astype(np.uint8)
    return np.where(a == 255, over, np.where(a == 0, under, out))


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def _png_piece(a: np.ndarray, frame: int, ms: int, poster: bool, has_poster: bool) -> bytes:
    """A frame's chunks; which numbers they have follows from the frame's."""
    h, w, _ = a.shape
    lines = np.zeros((h, 1 + w * 4), np.uint8)
    lines[:, 1:] = a.reshape(h, w * 4)
    body = zlib.compress(lines.tobytes())
    if poster:
        return _chunk(b"IDAT", body)
    first = 2 * frame if has_poster else max(0, 2 * frame - 1)
    control = _chunk(b"fcTL", struct.pack(">IIIIIHHBB", first, w, h, 0, 0, ms, 1000, 0, 0))
    return control + (_chunk(b"IDAT", body) if frame == 0 and not has_poster else _chunk(b"fdAT", struct.pack(">I", first + 1) + body))


def _gif_piece(a: np.ndarray, ms: int) -> bytes:
    """A frame's blocks with colours of its own; its place is cleared before the next."""
    h, w, _ = a.shape
    clear = a[..., 3] < 128
    colours, number = np.unique(a[~clear][:, :3], axis=0, return_inverse=True)
    if len(colours) + clear.any() > 256:
        raise Broken("too_many_colours:gif")
    table = np.zeros((256, 3), np.uint8)
    table[: len(colours)] = colours
    index = np.full((h, w), 255, np.int64)
    index[~clear] = number.ravel()
    control = b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2 | int(clear.any()), ms // 10, 255) + b"\0"
    coded = packed_lzw(index.ravel())
    blocks = b"".join(bytes([len(coded[k : k + 255])]) + coded[k : k + 255] for k in range(0, len(coded), 255))
    return control + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0x87) + table.tobytes() + b"\x08" + blocks + b"\0"


def packed_lzw(pixels: np.ndarray) -> bytes:
    """Codes of nine bits for 8-bit symbols, cleared before they would need ten."""
    every = 253
    n = len(pixels)
    codes = np.full(n + -(-n // every) + 1, 256, np.int64)
    at = np.arange(n)
    codes[at + at // every + 1] = pixels
    codes[-1] = 257
    bits = (codes[:, None] >> np.arange(9) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def animated(pictures: DataFrame, fmt: str, steps: list[tuple] = ()) -> DataFrame:
    """(origin, frames, content, error): composed frames, each after the steps of ``pictures.step``, as a GIF or an animated PNG.

    Order, delays and the number of plays stay: without one the file is played
    once.  GIFs have delays in hundredths of a second and 256 colours a frame;
    others give ``animation_timing_not_representable:gif`` and
    ``too_many_colours:gif``.  A poster stays in PNGs.  Frames are encoded
    apart; only their compressed pieces are joined.
    """
    if fmt not in ("gif", "png"):
        raise ValueError(f"unsupported_animated_format:{fmt}")
    posters = pictures.groupBy("origin").agg(F.max(F.coalesce("poster", F.lit(False))).alias("has_poster"))
    rows = pictures.join(posters, "origin")
    if fmt == "gif":
        rows = rows.where("NOT coalesce(poster, false)")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                piece, error, w, h = None, r.error, None, None
                if not error:
                    try:
                        a = decoded(r.data, int(r.width), int(r.height), int(r.nChannels))
                        for s in steps:
                            a = step(a, *s)
                        a = a if a.shape[2] == 4 else np.concatenate((np.repeat(a, 3 // a.shape[2], axis=2), np.full((*a.shape[:2], 1), 255, np.uint8)), axis=2)
                        h, w = a.shape[:2]
                        if fmt == "gif" and r.duration_ms % 10:
                            raise Broken("animation_timing_not_representable:gif")
                        piece = _gif_piece(a, int(r.duration_ms)) if fmt == "gif" else _png_piece(np.ascontiguousarray(a), int(r.frame), int(r.duration_ms), bool(r.poster), bool(r.has_poster))
                    except ValueError as problem:
                        error = str(problem)
                out.append((r.origin, r.frame, r.frames, r.loop, w, h, piece, error))
            made = pd.DataFrame(out, columns=["origin", "frame", "frames", "loop", "w", "h", "piece", "error"])
            yield made.astype({c: "Int32" for c in ("frame", "frames", "loop", "w", "h")})

    pieces = rows.mapInPandas(encode, "origin string, frame int, frames int, loop int, w int, h int, piece binary, error string")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        bad = rows[rows["error"] != ""]
        if len(bad):
            return pd.DataFrame({"origin": [rows["origin"].iloc[0]], "frames": pd.array([None], "Int32"), "content": [None], "error": [bad["error"].iloc[0]]})
        first = rows.iloc[0]
        w, h, plays, n = int(first["w"]), int(first["h"]), None if pd.isna(first["loop"]) else int(first["loop"]), int(first["frames"])
        if fmt == "gif":
            loop = b"" if plays is None else b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", plays) + b"\0"
            content = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x70, 0, 0) + loop + b"".join(rows["piece"]) + b"\x3b"
        else:
            head = _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"acTL", struct.pack(">II", n, 1 if plays is None else plays))
            content = PNG + head + b"".join(rows["piece"]) + _chunk(b"IEND", b"")
        return pd.DataFrame({"origin": [first["origin"]], "frames": pd.array([n], "Int32"), "content": [content], "error": [""]})

    return pieces.groupBy("origin").applyInPandas(join, "origin string, frames int, content binary, error string")
