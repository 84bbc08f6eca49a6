"""Verification of media with many frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import compare, verify
from orrery.operators import pictures as PX

RNG = np.random.default_rng(9)


def frame(h=9, w=12, c=3):
    return RNG.integers(0, 256, (h, w, c)).astype(np.uint8)


def table(spark, media):
    """media: name to (loop, [(picture or None, ms)])."""
    rows = []
    for name, (loop, frames) in media.items():
        for k, (a, ms) in enumerate(frames):
            data = None if a is None else np.ascontiguousarray(np.concatenate((a[..., 2::-1], a[..., 3:]), axis=2) if a.shape[2] >= 3 else a).tobytes()
            h, w, c = (-1, -1, -1) if a is None else a.shape
            rows.append((name, k, loop, ms, h, w, c, data, "kept"))
    return spark.createDataFrame(rows, "origin string, frame int, loop int, duration_ms int, height int, width int, nChannels int, data binary, media string")


def test_media_are_verified(spark):
    base = [(frame(), 100 + 10 * k) for k in range(4)]
    dull = [(np.clip(a.astype(int) + 40 * (k == 2), 0, 255).astype(np.uint8), ms) for k, (a, ms) in enumerate(base)]
    other = [(a, ms + (k == 3)) for k, (a, ms) in enumerate(base)]
    large = [(frame(100, 200), 0)]
    halved = [(PX.lanczos(large[0][0], 100, 50), 0)]
    source = {"same": (2, base), "dull": (2, base), "short": (2, base), "timing": (2, base), "loop": (None, base), "once": (None, base), "gone": (None, base), "bad": (None, base), "half": (None, large), "shape": (None, large)}
    candidate = {"same": (2, base), "dull": (2, dull), "short": (2, base[:3]), "timing": (2, other), "loop": (0, base), "once": (1, base), "new": (None, base), "bad": (None, [*base[:3], (None, 130)]), "half": (None, halved), "shape": (None, [(frame(100, 100), 0)])}
    a, b = table(spark, source), table(spark, candidate)
    got = {r.origin: r for r in verify.verified(a, b, min_psnr=30.0).collect()}
    good = {"frame_count": True, "loop": True, "timing": True, "dimensions": True}
    still = {"frame_count": True, "timing": True, "dimensions": False}
    assert {k: r.checks for k, r in got.items()} == {
        "same": good, "once": good, "dull": good, "short": {"frame_count": False, "loop": True}, "timing": good | {"timing": False}, "loop": good | {"loop": False}, "gone": None, "new": None, "bad": None, "half": still, "shape": still
    }
    assert {k for k, r in got.items() if r.passed} == {"same", "once"}
    assert {k: r.error for k, r in got.items() if not r.passed} == {k: "quality_gate_failed" for k in ("dull", "short", "timing", "loop", "half", "shape")} | {"gone": "input_not_found", "new": "input_not_found", "bad": "verification_failed"}
    mse, _, ssim = compare.picture_scores(*((x[2][0].tobytes(), 12, 9, 3) for x in (base, dull)))
    assert got["dull"].worst_position == 2 and got["dull"].ssim == pytest.approx(ssim) and got["dull"].psnr == pytest.approx(10 * math.log10(255**2 / mse))
    assert (got["same"].ssim, got["same"].worst_position, got["same"].sampled) == (1.0, 0, False) and got["short"].ssim is None and got["short"].worst_position is None
    resized = {r.origin: r for r in verify.verified(a, b, allow_resize=True, min_ssim=0.5).where("origin IN ('half', 'shape')").collect()}
    assert resized["half"].passed and resized["half"].checks["dimensions"] and not resized["shape"].passed and resized["shape"].ssim is None
    pages = {r.origin: r for r in verify.verified(a, b, pages=True, allow_resize=True, min_ssim=0.5, more={"text_layer": F.col("media") != "same"}).collect()}
    assert pages["once"].checks == {"page_count": True, "page_geometry": True, "text_layer": True} and pages["timing"].passed and not pages["same"].passed
    assert verify.verified(a.limit(0), b.limit(0)).count() == 0
    with pytest.raises(ValueError, match="invalid_quality_threshold"):
        verify.verified(a, b, min_ssim=1.5)


def test_large_pictures_are_scaled(monkeypatch):
    from types import SimpleNamespace

    monkeypatch.setattr(verify, "WORKING_PIXELS", 5000)
    row = lambda a: SimpleNamespace(data=a.tobytes(), width=a.shape[1], height=a.shape[0], nChannels=a.shape[2])
    a = np.kron(frame(10, 20, 1), np.ones((10, 10, 1), np.uint8))
    mse, ssim, sampled, same, compatible, error = verify.frame_scores(row(a), row(a), False, False)
    assert (mse, ssim, sampled, same, compatible, error) == (0.0, 1.0, True, True, True, "")
    assert verify.frame_scores(row(a), SimpleNamespace(data=b"1", width=5, height=5, nChannels=1), False, False)[-1] == "unreadable_picture"


def test_positions_without_a_partner(spark):
    a = table(spark, {"x": (None, [(frame(), 1)] * 2)})
    (r,) = verify.verified(a, a.withColumn("frame", F.col("frame") + 1)).collect()
    assert r.error == "verification_failed" and not r.passed


@pytest.mark.parametrize("h,w,c,size", [(150, 203, 3, 64), (64, 64, 1, 32), (300, 70, 4, 96), (40, 500, 3, 128), (5, 7, 3, 64), (129, 129, 2, 64)])
def test_tiles_add_up_to_whole_pictures(spark, h, w, c, size):
    a = np.clip(np.cumsum(RNG.integers(-9, 10, (h, w, c)), axis=1) + 128, 0, 255).astype(np.uint8)
    b = np.clip(a + RNG.integers(-20, 21, a.shape), 0, 255).astype(np.uint8)
    row = lambda k, x: (k, x.shape[0], x.shape[1], x.shape[2], x.tobytes())
    kind = "k int, height int, width int, nChannels int, data binary"
    left = spark.createDataFrame([row(1, a), row(2, a), row(3, a), row(4, a), (5, -1, -1, -1, None)], kind)
    right = spark.createDataFrame([row(1, b), row(2, a), row(3, a[:-1])], kind)
    mine, other = compare.tiles(left, "k", size), compare.tiles(right, "k", size)
    got = {r.k: r for r in compare.compare_tiles(mine, other, "k", size).collect()}
    mse, ssim, block = compare.picture_scores(*((x.tobytes(), w, h, c) for x in (a, b)))
    assert got[1].tiles == -(-h // size) * -(-w // size) and got[1].error == ""
    assert (got[1].mse, got[1].ssim, got[1].block_ssim) == (pytest.approx(mse), pytest.approx(ssim), pytest.approx(block))
    assert (got[2].mse, got[2].ssim, got[2].block_ssim, got[2].rating) == (0.0, pytest.approx(1.0), pytest.approx(1.0), "完美")
    assert {k: r.error for k, r in got.items()} == {1: "", 2: "", 3: got[3].error, 4: "tile_missing"} and got[3].error in ("size_mismatch", "tile_missing") and got[3].mse is None
    assert compare.compare_tiles(mine.limit(0), other.limit(0), "k", size).count() == 0
