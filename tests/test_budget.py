"""Pictures encoded to a budget of bytes."""

import numpy as np

from orrery.operators import budget as B
from orrery.sources import animation as A

RNG = np.random.default_rng(4)


def rows(spark, pictures, budgets, sizes=None):
    out = []
    for k, (a, limit) in enumerate(zip(pictures, budgets, strict=True)):
        data = None if a is None else np.ascontiguousarray(a[..., ::-1] if a.shape[2] == 3 else a).tobytes()
        h, w, c = (-1, -1, -1) if a is None else a.shape
        out.append((k, h, w, c, data, limit, sizes[k] if sizes else 10**9))
    return spark.createDataFrame(out, "k int, height int, width int, nChannels int, data binary, limit long, size long")


def opened(content):
    (f,) = A._png(bytes(content))[3]
    return A._png_pixels(f)[..., :3]


def smooth(h, w, c=3):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([(x * (k + 1) + y * 2 + RNG.integers(0, 9, (h, w))) % 256 for k in range(c)], axis=2).astype(np.uint8)


def test_cut_boxes_hold_what_is_near():
    mean = np.array([[0, 0, 0], [1, 0, 0], [200, 0, 0], [201, 0, 0], [0, 250, 0]], float)
    box = B.median_cut(mean, np.array([5, 5, 5, 5, 9]), 3)
    assert box[0] == box[1] != box[2] == box[3] and len(set(box.tolist())) == 3
    assert len(set(B.median_cut(mean, np.ones(5, int), 99).tolist())) == 5 and set(B.median_cut(mean[:1], np.ones(1, int), 4).tolist()) == {0}


def test_the_best_that_fits_is_kept(spark):
    a = smooth(60, 80)
    grey, alpha, flat = smooth(20, 20, 1), np.dstack([smooth(16, 16), RNG.integers(0, 256, (16, 16), dtype=np.uint8)]), np.full((9, 9, 3), 7, np.uint8)
    whole = len(B.packed_png(a))
    df = rows(spark, [a, a, a, a, a, grey, alpha, flat, None, a], [whole, whole - 1, 3000, 1500, 60, 300, 500, 200, 100, 0], [10**9] * 3 + [1400] + [10**9] * 6)
    got = {r.k: r for r in B.encoded_to_budget(df, "k", "limit", "size").collect()}
    assert (got[0].outcome, got[0].colours, got[0].bytes) == ("lossless", None, whole) and (opened(got[0].content) == a).all()
    assert got[3].outcome == "already_within_target" and got[3].content is None and got[9].error == "target_size_must_be_positive"
    assert got[4].error == "target_size_unreachable" and got[4].attempts == 1 + len(B.RUNGS) and got[4].closest_size > 60 and got[4].content is None
    assert got[8].error == "unreadable_picture" and got[7].outcome == "lossless"
    # every rung by hand
    tried = {}
    for r in B.palettes(B.histograms(df.where("k = 1"), "k"), "k").collect():
        index = np.frombuffer(r.lookup, np.uint8)[B._bins(a)].reshape(60, 80, 1)
        tried[r.colours] = B.packed_png(index, np.frombuffer(r.palette, np.uint8).reshape(-1, 3))
    for k, limit in ((1, whole - 1), (2, 3000)):
        best = max(c for c, x in tried.items() if len(x) <= limit)
        assert (got[k].outcome, got[k].colours, got[k].bytes, bytes(got[k].content)) == (f"image_quality_{best}", best, len(tried[best]), tried[best])
    errors = {c: np.abs(opened(x).astype(int) - a).mean() for c, x in tried.items()}
    assert errors[256] < errors[16] < errors[2] and errors[256] < 8
    for k in (5, 6):
        assert got[k].bytes <= 500 and opened(got[k].content).shape[:2] == ((20, 20) if k == 5 else (16, 16))
    assert B.encoded_to_budget(df.limit(0), "k", "limit").count() == 0


def test_histograms_of_parts_add_up(spark):
    a = smooth(40, 30)
    whole, parts = rows(spark, [a], [1]), rows(spark, [a[:13], a[13:]], [1, 1]).selectExpr("0 AS k", "height", "width", "nChannels", "data")
    read = lambda d: sorted(tuple(r) for r in B.histograms(d, "k").collect())
    assert read(whole) == read(parts)


def test_filters_are_read_back():
    for c in (1, 3, 4):
        a = smooth(23, 31, c)
        assert (A.unfiltered(B.filtered(a.reshape(23, -1), c), 23, 31 * c, c) == a.reshape(23, -1)).all()
    one = smooth(4, 1, 1)
    assert (A.unfiltered(B.filtered(one.reshape(4, -1), 1), 4, 1, 1) == one.reshape(4, -1)).all()
