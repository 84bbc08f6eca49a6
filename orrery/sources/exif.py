"""EXIF of JPEG bytes: reading it as a map of names and texts, and taking out groups of tags.

Tags are taken out in place: a directory's remaining entries move together, its
count falls, and the values of what went are zeroed, so no other offset changes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers and names of the position directory's tags, in order from 0.
GPS = """GPSVersionID GPSLatitudeRef GPSLatitude GPSLongitudeRef GPSLongitude GPSAltitudeRef GPSAltitude GPSTimeStamp GPSSatellites GPSStatus GPSMeasureMode GPSDOP GPSSpeedRef GPSSpeed GPSTrackRef
GPSTrack GPSImgDirectionRef GPSImgDirection GPSMapDatum GPSDestLatitudeRef GPSDestLatitude GPSDestLongitudeRef GPSDestLongitude GPSDestBearingRef GPSDestBearing GPSDestDistanceRef GPSDestDistance
GPSProcessingMethod GPSAreaInformation GPSDateStamp GPSDifferential""".split()
#: Numbers of other tags, by what they tell about.
DEVICE = {
    0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x013C: "HostComputer", 0x927C: "MakerNote", 0xA40B: "DeviceSettingDescription", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber",
    0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber", 0xC614: "UniqueCameraModel", 0xC615: "LocalizedCameraModel", 0xC62F: "CameraSerialNumber", 0xC65D: "RawDataUniqueID", 0xC6F3: "CameraCalibrationSignature",
}
PERSONAL = {
    0x010D: "DocumentName", 0x010E: "ImageDescription", 0x011D: "PageName", 0x013B: "Artist", 0x8298: "Copyright", 0x9213: "ImageHistory", 0x9286: "UserComment",
    0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject",
}
TIME = {
    0x0132: "DateTime", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal",
    0x9292: "SubSecTimeDigitized",
}
OTHER = {
    0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x8769: "ExifOffset", 0x8825: "GPSInfo", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x920A: "FocalLength",
    0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight",
}
NAMES = DEVICE | PERSONAL | TIME | OTHER
GROUPS = {"gps": ["GPSInfo", *GPS], "device": list(DEVICE.values()), "personal": list(PERSONAL.values()), "time": list(TIME.values())}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NESTED = {0x8769: "exif", 0x8825: "gps"}
DEPTH = 4  # directories below each other, so that a loop of offsets ends


def names_of(groups: list[str]) -> list[str]:
    """The union of some groups' tag names."""
    return list(dict.fromkeys(n for g in groups for n in GROUPS[g]))


def block(data: bytes) -> tuple[int, int] | None:
    """(start, end) of the EXIF's TIFF part in a JPEG, None without one."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not_a_jpeg")
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and size >= 8 and at + 2 + size <= len(data):
            return at + 10, at + 2 + size
        at += 2 + max(size, 2)
    return None


class Directory:
    """Entries (tag, kind, count, value's place, own place) of one directory of a TIFF part, and its nested ones."""

    def __init__(self, raw: bytes, order: str, at: int, name: str = "main", depth: int = 0):
        self.at, self.name, self.entries, self.nested = at, name, [], []
        if at < 8 or at + 2 > len(raw):
            raise ValueError("broken_exif")
        (self.count,) = struct.unpack_from(order + "H", raw, at)
        if at + 2 + 12 * self.count + 4 > len(raw):
            raise ValueError("broken_exif")
        for k in range(self.count):
            place = at + 2 + 12 * k
            tag, kind, many, value = struct.unpack_from(order + "HHII", raw, place)
            size = SIZES.get(kind, 1) * many
            where = place + 8 if size <= 4 else value
            self.entries.append((tag, kind, many, where, place, size))
            if tag in NESTED and name == "main" and depth < DEPTH:
                self.nested.append((tag, Directory(raw, order, value, NESTED[tag], depth + 1)))

    def name_of(self, tag: int) -> str:
        if self.name == "gps":
            return GPS[tag] if tag < len(GPS) else f"GPS{tag}"
        return NAMES.get(tag, f"Tag{tag:04X}")


def _order(raw: bytes) -> str:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(raw[:4]))
    if order is None:
        raise ValueError("broken_exif")
    return order


def _text(raw: bytes, order: str, kind: int, many: int, where: int, size: int) -> str:
    part = raw[where : where + size]
    if len(part) < size:
        raise ValueError("broken_exif")
    if kind == 2:
        return part.split(b"\0")[0].decode("utf-8", "replace")
    if kind in (3, 4, 8, 9):
        values = struct.unpack(order + {3: "H", 4: "I", 8: "h", 9: "i"}[kind] * many, part)
        return ",".join(map(str, values))
    if kind in (5, 10):
        numbers = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * many, part)
        return ",".join(f"{a}/{b}" for a, b in zip(numbers[::2], numbers[1::2], strict=True))
    return part.hex()


def read(data: bytes) -> dict[str, str]:
    """Names and texts of all tags, nested directories included; empty without EXIF."""
    found = block(data)
    if found is None:
        return {}
    raw = data[found[0] : found[1]]
    order = _order(raw)
    out: dict[str, str] = {}

    def gather(d: Directory) -> None:
        for tag, kind, many, where, _, size in d.entries:
            out.setdefault(d.name_of(tag), _text(raw, order, kind, many, where, size))
        for _, below in d.nested:
            gather(below)

    gather(Directory(raw, order, struct.unpack_from(order + "I", raw, 4)[0]))
    return out


def without(data: bytes, names: list[str]) -> tuple[bytes, int]:
    """A JPEG without the named tags (in any case), and how many went."""
    gone = {n.lower() for n in names}
    found = block(data)
    if found is None:
        return data, 0
    raw = bytearray(data[found[0] : found[1]])
    order = _order(raw)
    removed = 0

    def clear(d: Directory) -> None:
        """A whole directory that nothing points to any more."""
        nonlocal removed
        for _, _, _, where, _, size in d.entries:
            raw[where : where + size] = bytes(min(size, max(0, len(raw) - where)))
            removed += 1
        raw[d.at : d.at + 2 + 12 * d.count + 4] = bytes(2 + 12 * d.count + 4)

    def edit(d: Directory) -> None:
        nonlocal removed
        below = dict(d.nested)
        for tag, sub in d.nested:
            if d.name_of(tag).lower() not in gone:
                edit(sub)
        tail = bytes(raw[d.at + 2 + 12 * d.count : d.at + 6 + 12 * d.count])
        kept = []
        for tag, _, _, where, place, size in d.entries:
            if d.name_of(tag).lower() not in gone:
                kept.append(bytes(raw[place : place + 12]))
                continue
            if tag in below:
                clear(below[tag])
            elif size > 4:
                raw[where : where + size] = bytes(min(size, max(0, len(raw) - where)))
            removed += 1
        body = struct.pack(order + "H", len(kept)) + b"".join(kept) + tail
        whole = 2 + 12 * d.count + 4
        raw[d.at : d.at + whole] = body + bytes(whole - len(body))

    edit(Directory(bytes(raw), order, struct.unpack_from(order + "I", raw, 4)[0]))
    return data[: found[0]] + bytes(raw) + data[found[1] :], removed


def tags(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with ``tags`` (map of names and texts) and an ``error`` code; null content has neither."""

    @F.pandas_udf("tags map<string,string>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b in batch:
                try:
                    out.append((None if b is None else read(bytes(b)), "missing_input" if b is None else ""))
                except (ValueError, struct.error) as e:
                    out.append((None, str(e) if isinstance(e, ValueError) else "broken_exif"))
            yield pd.DataFrame(out, columns=["tags", "error"])

    return df.withColumn("_t", run(F.col(content))).withColumns({"tags": F.col("_t.tags"), "error": F.col("_t.error")}).drop("_t")


def analysis(df: DataFrame, tags: str = "tags") -> DataFrame:
    """``df`` with ``groups``: the sorted names of each group's tags that are there; empty groups are left out."""
    names = F.map_keys(F.col(tags))

    def held(group: str):
        known = F.array(*(F.lit(n.lower()) for n in GROUPS[group]))
        return F.struct(F.lit(group).alias("k"), F.array_sort(F.filter(names, lambda n: F.array_contains(known, F.lower(n)))).alias("v"))

    return df.withColumn("groups", F.map_filter(F.map_from_entries(F.array(*map(held, GROUPS))), lambda _, v: F.size(v) > 0))


def stripped(df: DataFrame, groups: list[str], content: str = "content") -> DataFrame:
    """``df`` with ``stripped`` bytes, ``removed`` and ``error``: JPEGs without some groups' tags.

    EXIF that can't be read is taken out whole (removed is -1), as nothing in
    it can be told apart.
    """
    from ..operators.pixels import strip_jpeg

    names = names_of(groups)

    @F.pandas_udf("stripped binary, removed int, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b in batch:
                if b is None:
                    out.append((None, 0, "missing_input"))
                    continue
                try:
                    out.append((*without(bytes(b), names), ""))
                except (ValueError, struct.error) as e:
                    try:
                        out.append((strip_jpeg(bytes(b)), -1, ""))
                    except ValueError:
                        out.append((None, 0, str(e)))
            yield pd.DataFrame(out, columns=["stripped", "removed", "error"])

    return df.withColumn("_s", run(F.col(content))).withColumns({k: F.col(f"_s.{k}") for k in ("stripped", "removed", "error")}).drop("_s")
