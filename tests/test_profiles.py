"""Colour profiles: identity, grey axis, known matrices, broken ones."""

import struct

import numpy as np

from orrery.operators import profiles as PF

RNG = np.random.default_rng(3)
fixed = lambda *v: struct.pack(f">{len(v)}i", *(round(x * 65536) for x in v))
SRGB_CURVE = b"para\0\0\0\0" + struct.pack(">HH", 3, 0) + fixed(2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)


def profile(tags, space=b"RGB ", pcs=b"XYZ "):
    out, table = b"", b""
    at = 132 + 12 * len(tags)
    for name, data in tags.items():
        table += name + struct.pack(">II", at + len(out), len(data))
        out += data + b"\0" * (-len(data) % 4)
    head = bytearray(128)
    head[0:4], head[16:20], head[20:24], head[36:40] = struct.pack(">I", at + len(out)), space, pcs, b"acsp"
    return bytes(head) + struct.pack(">I", len(tags)) + table + out


def rgb(matrix, curve):
    return profile({**{c + b"XYZ": b"XYZ \0\0\0\0" + fixed(*matrix[:, k]) for k, c in enumerate((b"r", b"g", b"b"))}, **{c + b"TRC": curve for c in (b"r", b"g", b"b")}})


SRGB = rgb(PF.SRGB_D50, SRGB_CURVE)


def test_identity_grey_axis_and_known_values():
    a = RNG.integers(0, 256, (20, 30, 4)).astype(np.uint8)
    same = PF.to_srgb(a, *PF.compiled(SRGB))
    assert np.abs(same.astype(int) - a).max() <= 1 and (same[..., 3] == a[..., 3]).all()
    grey = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 3, axis=2)
    for curve in (b"curv\0\0\0\0" + struct.pack(">I", 0), b"curv\0\0\0\0" + struct.pack(">IH", 1, 0x0180), b"curv\0\0\0\0" + struct.pack(">I3H", 3, 0, 9000, 65535), b"para\0\0\0\0" + struct.pack(">HH", 0, 0) + fixed(1.8)):
        got = PF.to_srgb(grey, *PF.compiled(rgb(PF.SRGB_D50, curve)))[0].astype(int)
        assert (np.abs(got - got[:, :1]) <= 1).all() and (np.diff(got[:, 0]) >= 0).all() and got[0, 0] == 0 and got[255, 0] == 255
    linear = PF.to_srgb(grey, *PF.compiled(rgb(PF.SRGB_D50, b"curv\0\0\0\0" + struct.pack(">I", 0))))[0, :, 0]
    assert [int(linear[k]) for k in (0, 1, 55, 128, 255)] == [0, 13, 128, 188, 255]  # light itself, as sRGB codes it
    swapped = PF.to_srgb(a, *PF.compiled(rgb(PF.SRGB_D50[:, [2, 1, 0]], SRGB_CURVE)))
    assert np.abs(swapped[..., :3].astype(int) - a[..., 2::-1]).max() <= 1
    tone = PF.to_srgb(a[..., :1], *PF.compiled(profile({b"kTRC": SRGB_CURVE}, b"GRAY")))
    assert tone.shape[2] == 3 and np.abs(tone.astype(int) - a[..., :1]).max() <= 1


def test_pictures_and_their_profiles(spark):
    a = RNG.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    data = a[..., ::-1].tobytes()
    swapped = rgb(PF.SRGB_D50[:, [2, 1, 0]], SRGB_CURVE)
    rows = {
        "plain": (data, None), "srgb": (data, SRGB), "swap": (data, swapped), "swap2": (data, swapped), "text": (data, b"no profile"), "cut": (data, SRGB[:-40]), "empty": (data, b""), "tables": (data, profile({b"A2B0": b"mft2" + bytes(60)}, b"CMYK", b"Lab ")),
        "curves": (data, rgb(PF.SRGB_D50, b"what\0\0\0\0" + bytes(8))), "short": (data[:-1], SRGB), "none": (None, None), "zero": (data, rgb(PF.SRGB_D50, b"para\0\0\0\0" + struct.pack(">HH", 9, 0))),
    }
    df = spark.createDataFrame([(k, 6, 5, 3, d, p, "kept") for k, (d, p) in rows.items()], "origin string, height int, width int, nChannels int, data binary, profile binary, _note string")
    got = {r.origin: r for r in PF.in_srgb(df).collect()}
    bad = {"text": "invalid_icc_profile", "cut": "invalid_icc_profile", "empty": "invalid_icc_profile", "tables": "unsupported_icc_profile", "curves": "invalid_icc_profile", "short": "unreadable_picture", "none": "unreadable_picture", "zero": "invalid_icc_profile"}
    assert {k: r.error for k, r in got.items() if r.error} == bad and {k for k, r in got.items() if r.data is None} == set(bad)
    seen = {k: np.frombuffer(got[k].data, np.uint8).reshape(6, 5, 3)[..., ::-1].astype(int) for k in ("plain", "srgb", "swap", "swap2")}
    assert (seen["plain"] == a).all() and np.abs(seen["srgb"] - a).max() <= 1 and np.abs(seen["swap"] - a[..., ::-1]).max() <= 1 and (seen["swap"] == seen["swap2"]).all()
    assert PF.in_srgb(df.limit(0)).count() == 0 and "profile" not in PF.in_srgb(df).columns
