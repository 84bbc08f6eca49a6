"""EXIF: hand-made JPEGs in both byte orders."""

import struct

import pytest

from orrery.sources import exif as X


def tiff(order, main, sub, gps):
    """A TIFF part with three directories of (tag, kind, payload)."""
    mark = b"II*\0" if order == "<" else b"MM\0*"
    size = lambda d: 2 + 12 * len(d) + 4
    main = [*main, (0x8769, 4, None), (0x8825, 4, None)]
    starts = {"main": 8, "exif": 8 + size(main), "gps": 8 + size(main) + size(sub)}
    pool_at, pool, out = 8 + size(main) + size(sub) + size(gps), b"", b""
    for d in (main, sub, gps):
        out += struct.pack(order + "H", len(d))
        for tag, kind, payload in d:
            payload = struct.pack(order + "I", starts[X.NESTED[tag]]) if payload is None else payload
            many = len(payload) // X.SIZES[kind]
            if len(payload) > 4:
                value, pool = struct.pack(order + "I", pool_at + len(pool)), pool + payload
            else:
                value = payload.ljust(4, b"\0")
            out += struct.pack(order + "HHI", tag, kind, many) + value
        out += struct.pack(order + "I", 0)
    return mark + struct.pack(order + "I", 8) + out + pool


def jpeg(part):
    body = b"Exif\0\0" + part
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\x00\x04cd\x12\x34\xff\xd9"


def sample(order):
    s = lambda x: struct.pack(order + "H", x)
    r = lambda *x: struct.pack(order + "I" * len(x), *x)
    return jpeg(tiff(order, [(0x010F, 2, b"Maker Co\0"), (0x0112, 3, s(6)), (0x0132, 2, b"2020:01:02 03:04:05\0"), (0x8298, 2, b"Me\0")], [(0x829A, 5, r(1, 250)), (0xA431, 2, b"SERIAL-1234\0")], [(1, 2, b"N\0"), (2, 5, r(52, 1, 30, 1, 0, 1))]))


@pytest.mark.parametrize("order", ["<", ">"])
def test_tags_are_read_and_taken_out(order):
    data = sample(order)
    tags = X.read(data)
    assert {k: v for k, v in tags.items() if not k.endswith(("Offset", "Info"))} == {
        "Make": "Maker Co", "Orientation": "6", "DateTime": "2020:01:02 03:04:05", "Copyright": "Me", "ExposureTime": "1/250", "BodySerialNumber": "SERIAL-1234", "GPSLatitudeRef": "N", "GPSLatitude": "52/1,30/1,0/1"
    }
    out, removed = X.without(data, X.names_of(["gps", "device"]))
    assert len(out) == len(data) and removed == 5  # two positions and their directory, the maker, the serial number
    left = X.read(out)
    assert set(left) == {"Orientation", "DateTime", "Copyright", "ExposureTime", "ExifOffset"} and left["ExposureTime"] == "1/250"
    assert b"SERIAL" not in out and b"Maker" not in out and struct.pack(order + "I", 52) not in out[: len(out) - 8]
    assert out[-8:] == data[-8:] and X.without(out, X.names_of(["gps", "device"])) == (out, 0)
    assert X.without(data, ["copyright", "DATETIME"])[1] == 2


def test_batches(spark):
    rows = [(1, sample("<")), (2, b"\xff\xd8\xff\xda\x00\x02\xff\xd9"), (3, b"no"), (4, None), (5, jpeg(b"XX*\0" + bytes(20)))]
    df = spark.createDataFrame(rows, "id int, content binary")
    got = {r.id: r for r in X.analysis(X.tags(df)).collect()}
    assert got[1].groups == {"gps": ["GPSInfo", "GPSLatitude", "GPSLatitudeRef"], "device": ["BodySerialNumber", "Make"], "personal": ["Copyright"], "time": ["DateTime"]}
    assert (got[2].tags, got[2].error) == ({}, "") and [got[i].error for i in (3, 4, 5)] == ["not_a_jpeg", "missing_input", "broken_exif"]
    out = {r.id: r for r in X.stripped(df, ["time"]).collect()}
    assert [(out[i].removed, out[i].error) for i in (1, 2, 3, 4, 5)] == [(1, ""), (0, ""), (0, "not_a_jpeg"), (0, "missing_input"), (-1, "")]
    assert b"Exif" not in bytes(out[5].stripped) and bytes(out[2].stripped) == rows[1][1]


def test_broken_offsets_end():
    loop = bytearray(tiff("<", [], [], []))
    struct.pack_into("<I", loop, 8 + 2 + 8, 8)  # the nested directory is the main one again
    assert "ExifOffset" in X.read(jpeg(bytes(loop)))
    with pytest.raises(ValueError, match="broken_exif"):
        X.read(jpeg(b"II*\0" + struct.pack("<I", 4000) + bytes(10)))
