"""Pictures prepared for delivery, from files to files."""

import hashlib
import os

import numpy as np
import pytest

from orrery.operators import pictures as PX
from orrery.operators import prepare


def test_pictures_are_prepared(spark, tmp_path):
    source, out = tmp_path / "src", tmp_path / "out"
    (source / "deep").mkdir(parents=True)
    rng = np.random.default_rng(1)
    pictures = {"a.png": rng.integers(0, 256, (40, 80, 3)), "deep/b.bmp": rng.integers(0, 256, (10, 12, 3)), "deep/c.png": rng.integers(0, 256, (6, 6, 1))}
    for name, a in pictures.items():
        (source / name).write_bytes((PX.bmp if name.endswith("bmp") else PX.png)(a.astype(np.uint8)))
    (source / "bad.png").write_bytes(b"not a picture")
    (source / "notes.txt").write_bytes(b"x")
    run = lambda **more: {os.path.basename(r.input): r for r in prepare.prepared(spark, [str(source)], str(out), longest=20, recursive=True, **more).collect()}
    got = run()
    assert set(got) == {"a.png", "b.bmp", "c.png", "bad.png"}
    assert (got["bad.png"].success, got["bad.png"].error, got["bad.png"].output_bytes) == (False, "unreadable_picture", 0)
    for name, place in (("a.png", "a.png"), ("b.bmp", "deep/b.png"), ("c.png", "deep/c.png")):
        r, data = got[name], (out / place).read_bytes()
        assert (r.success, r.skipped, r.output, r.output_bytes, r.sha256) == (True, False, str(out / place), len(data), hashlib.sha256(data).hexdigest())
        assert r.input_bytes == os.path.getsize(r.input)
    assert PX.read_png((out / "a.png").read_bytes()).shape == (10, 20, 3) and (PX.read_png((out / "deep/b.png").read_bytes()) == pictures["deep/b.bmp"]).all()
    again = run()
    assert {k: r.skipped for k, r in again.items()} == {"a.png": True, "b.bmp": True, "c.png": True, "bad.png": False} and again["a.png"].sha256 == got["a.png"].sha256
    assert run(overwrite=True, steps=[("grey",)], exclude=["*bad*"])["a.png"].skipped is False and PX.read_png((out / "a.png").read_bytes()).shape == (10, 20, 1)
    before = sorted(os.listdir(out))
    (source / "a.bmp").write_bytes(b"x")
    with pytest.raises(prepare.Collision, match="output_collision"):
        run()
    assert sorted(os.listdir(out)) == before
    inside = prepare.prepared(spark, [str(tmp_path)], str(out), recursive=True, include=["*/out/*"])
    assert inside.count() == 0
