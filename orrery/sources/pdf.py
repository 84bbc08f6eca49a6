"""The object graph of PDF files as tables: objects, references, pages and what they need.

Files are parsed apart, into a row an object and the references it holds.
What needs the graph are joins: pages are found level by level down the page
tree, which hands down what they inherit, and the objects that pages need are
found by following references from a frontier until nothing new is met.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import dropped, written
from .animation import unfiltered

MOST_INFLATED = 64 << 20  # bytes of an inflated stream of objects
MOST_DEPTH = 100  # of arrays and dictionaries within each other

OBJECTS = "origin string, number int, kind string, subtype string, entries map<string,string>, refs array<struct<key: string, position: int, number: int>>, stream_bytes long, root int, info int, error string"

_SPACE = b"\0\t\n\x0c\r "
_TOKEN = re.compile(rb"[\0\t\n\x0c\r ]*(?:%[^\r\n]*[\0\t\n\x0c\r ]*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\0\t\n\x0c\r ]*>|/[^\0\t\n\x0c\r ()<>\[\]{}/%]*|[^\0\t\n\x0c\r ()<>\[\]{}/%]+|[{}])")
_REF = re.compile(rb"[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
_HEAD = re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+obj")


class Broken(ValueError):
    """A file that can't be read; its text is a stable code."""


class Ref(int):
    """Number of an object that is referred to."""


def value(data: bytes, at: int, depth: int = 0):
    """(value, end): a PDF value as numbers, texts (names begin with a slash), lists, dicts and :class:`Ref`."""
    found = _TOKEN.match(data, at)
    if not found or depth > MOST_DEPTH:
        raise Broken("broken_pdf")
    token, end = found.group(1), found.end()
    if token == b"<<":
        out = {}
        while True:
            name = _TOKEN.match(data, end)
            if not name:
                raise Broken("broken_pdf")
            if name.group(1) == b">>":
                return out, name.end()
            if not name.group(1).startswith(b"/"):
                raise Broken("broken_pdf")
            out[_name(name.group(1))], end = value(data, name.end(), depth + 1)
    if token == b"[":
        out = []
        while True:
            close = _TOKEN.match(data, end)
            if close and close.group(1) == b"]":
                return out, close.end()
            item, end = value(data, end, depth + 1)
            out.append(item)
    if token == b"(":
        return _literal(data, end)
    if token.startswith(b"<"):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
        return _text(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())), end
    if token.startswith(b"/"):
        return "/" + _name(token), end
    if token.isdigit() and (ref := _REF.match(data, end)):
        return Ref(int(token)), ref.end()
    for kind in (int, float):
        try:
            return kind(token), end
        except ValueError:
            pass
    return {b"true": True, b"false": False, b"null": None}.get(token, token.decode("latin-1")), end


def _name(token: bytes) -> str:
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m.group(1).decode()), token[1:]).decode("latin-1")


def _literal(data: bytes, at: int) -> tuple[str, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            if octal := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                out.append(int(octal.group(), 8) & 255)
                at += len(octal.group())
                continue
            at += 1
            out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return _text(bytes(out)), at
        out += c
    raise Broken("broken_pdf")


def _text(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


class File:
    """Objects of a file, by its cross-reference tables and streams."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.trailer = data, {}, {}, {}
        if b"%PDF-" not in data[:1024]:
            raise Broken("not_a_pdf")
        marks = list(re.finditer(rb"startxref\s+(\d+)", data))
        if not marks:
            raise Broken("broken_pdf")
        waiting, seen = [int(marks[-1].group(1))], set()
        while waiting:
            at = waiting.pop()
            if at in seen or at >= len(data):
                continue
            seen.add(at)
            trailer = self._table(at) if data[at:].lstrip(_SPACE)[:4] == b"xref" else self._stream(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            waiting += [t for t in (trailer.get("Prev"), trailer.get("XRefStm")) if isinstance(t, int)]
        if "Encrypt" in self.trailer:
            raise Broken("pdf_password_required")
        if not isinstance(self.trailer.get("Root"), Ref):
            raise Broken("broken_pdf")

    def _table(self, at: int) -> dict:
        at = self.data.index(b"xref", at) + 4
        while head := re.compile(rb"\s*(\d+)\s+(\d+)[ \t]*\r?\n?").match(self.data, at):
            first, n = int(head.group(1)), int(head.group(2))
            at = head.end()
            for k in range(n):
                line = re.compile(rb"\s*(\d{1,10})\s+(\d{1,5})\s+([nf])").match(self.data, at)
                if not line:
                    raise Broken("broken_pdf")
                at = line.end()
                if first + k not in self.at and first + k not in self.held:
                    self.at[first + k] = int(line.group(1)) if line.group(3) == b"n" else -1
        mark = re.compile(rb"\s*trailer").match(self.data, at)
        if not mark:
            raise Broken("broken_pdf")
        return value(self.data, mark.end())[0]

    def _stream(self, at: int) -> dict:
        entries, body = self._object(at)
        raw = np.frombuffer(_inflated(entries, body), np.uint8)
        widths = entries["W"]
        rows = raw[: len(raw) // sum(widths) * sum(widths)].reshape(-1, sum(widths)).astype(np.int64)
        ends = np.cumsum([0, *widths])
        fields = [(rows[:, a:b] << (8 * np.arange(b - a)[::-1])).sum(axis=1) for a, b in zip(ends, ends[1:])]
        kinds = fields[0] if widths[0] else np.ones(len(rows), np.int64)
        index, k = entries.get("Index", [0, entries.get("Size", len(rows))]), 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for number in range(first, first + n):
                if k >= len(rows):
                    break
                if number not in self.at and number not in self.held:
                    if kinds[k] == 2:
                        self.held[number] = (int(fields[1][k]), int(fields[2][k]))
                    else:
                        self.at[number] = int(fields[1][k]) if kinds[k] == 1 else -1
                k += 1
        return entries

    def _object(self, at: int) -> tuple:
        """(value, stream's bytes or None) of the object at a place."""
        head = _HEAD.match(self.data, at + len(self.data[at : at + 20]) - len(self.data[at : at + 20].lstrip(_SPACE)))
        if not head:
            raise Broken("broken_pdf")
        got, end = value(self.data, head.end())
        mark = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, end)
        if not mark or not isinstance(got, dict):
            return got, None
        length = got.get("Length")
        if isinstance(length, Ref):
            length = self._object(self.at[length])[0] if self.at.get(length, -1) >= 0 else None
        if not isinstance(length, int) or mark.end() + length > len(self.data):
            stop = self.data.find(b"endstream", mark.end())
            length = (stop if stop >= 0 else len(self.data)) - mark.end()
        return got, self.data[mark.end() : mark.end() + length]

    def objects(self) -> Iterator[tuple[int, object, int | None]]:
        """(number, value, bytes of its stream) of every object in use."""
        for number, at in sorted(self.at.items()):
            if at >= 0:
                got, body = self._object(at)
                yield number, got, None if body is None else len(body)
        streams: dict[int, list] = {}
        for number, (holder, nth) in sorted(self.held.items()):
            if holder not in streams:
                entries, body = self._object(self.at[holder])
                raw = _inflated(entries, body)
                heads = [int(x) for x in raw[: entries["First"]].split()]
                streams[holder] = [raw, entries["First"], heads]
            raw, first, heads = streams[holder]
            if 2 * nth + 1 >= len(heads):
                raise Broken("broken_pdf")
            yield number, value(raw, first + heads[2 * nth + 1])[0], None


def _inflated(entries: dict, body: bytes | None) -> bytes:
    """A stream without Flate and PNG's line filters."""
    kind = entries.get("Filter")
    if body is None or kind not in (None, "/FlateDecode", ["/FlateDecode"]):
        raise Broken("unsupported_pdf_filter")
    if kind is None:
        return body
    try:
        inflate = zlib.decompressobj()
        raw = inflate.decompress(body, MOST_INFLATED)
        if inflate.unconsumed_tail:
            raise Broken("pdf_stream_too_large")
    except zlib.error as error:
        raise Broken("broken_pdf") from error
    how = entries.get("DecodeParms") or {}
    how = how[0] if isinstance(how, list) else how
    if how.get("Predictor", 1) < 10:
        return raw
    line = -(-how.get("Columns", 1) * how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8)
    a = np.frombuffer(raw, np.uint8)[: len(raw) // (line + 1) * (line + 1)].reshape(-1, line + 1)
    return unfiltered(a, len(a), line, max(1, how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8)).tobytes()


def _references(v, key: str, out: list, position: int = 0) -> None:
    """(key, position, number) of all references in a value, by the entry of the object that holds them."""
    if isinstance(v, Ref):
        out.append((key, position, int(v)))
    elif isinstance(v, dict):
        for k, x in v.items():
            _references(x, key or k, out, position)
    elif isinstance(v, list):
        for n, x in enumerate(v):
            _references(x, key, out, n)


def _plain(v):
    return f"{int(v)} R" if isinstance(v, Ref) else {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else [_plain(x) for x in v] if isinstance(v, list) else v


def objects(df: DataFrame, origin: str = "origin", content: str = "content") -> DataFrame:
    """A row for each object of PDF files: see ``OBJECTS``.

    ``entries`` are an object's entries as JSON (references as "n R"), ``refs``
    all references in it with the entry and the place in its list.  ``root``
    and ``info`` are the numbers the file's trailer names.  Of updated files
    the last state counts.  A file that can't be read is one row with a stable
    code (``not_a_pdf``, ``broken_pdf``, ``pdf_password_required``,
    ``unsupported_pdf_filter``, ``pdf_stream_too_large``, ``missing_content``).
    """

    def row(name, number, got, size, trailer) -> tuple:
        entries = got if isinstance(got, dict) else {"": got}
        refs: list = []
        _references(got, "", refs)
        kind, sub = (entries.get(k) if isinstance(entries.get(k), str) else None for k in ("Type", "Subtype"))
        info = trailer.get("Info")
        return (name, number, kind, sub, {k: json.dumps(_plain(v)) for k, v in entries.items()}, [{"key": k, "position": p, "number": n} for k, p, n in refs], size, int(trailer["Root"]), int(info) if isinstance(info, Ref) else None, "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["o"], batch["c"], strict=True):
                try:
                    if data is None:
                        raise Broken("missing_content")
                    file = File(bytes(data))
                    rows = [row(name, number, got, size, file.trailer) for number, got, size in file.objects()]
                except Broken as error:
                    rows = [(name, None, None, None, None, None, None, None, None, str(error))]
                except (KeyError, TypeError, IndexError, ValueError, AttributeError):
                    rows = [(name, None, None, None, None, None, None, None, None, "broken_pdf")]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in ("origin", "number", "kind", "subtype", "entries", "refs", "stream_bytes", "root", "info", "error")])
                yield out.astype({"number": "Int32", "stream_bytes": "Int64", "root": "Int32", "info": "Int32"})

    return df.select(F.col(origin).cast("string").alias("o"), F.col(content).alias("c")).mapInPandas(run, OBJECTS)


INHERITED = ["MediaBox", "CropBox", "Rotate", "Resources"]


def pages(found: DataFrame) -> DataFrame:
    """(origin, page, number, width, height, rotation, resources, entries): the pages of files in order, from 0.

    Levels of the page tree are joined one after the other; each hands down
    media box, crop box, rotation and resources to pages without their own.
    Loops in a tree end where an object comes again.
    """
    good = found.where("error = ''")
    kids = written(good.select("origin", "number", F.explode(F.filter("refs", lambda r: r["key"] == "Kids")).alias("r")).select("origin", F.col("number").alias("parent"), F.col("r.position").alias("nth"), F.col("r.number").alias("child")))
    nodes = written(good.select("origin", "number", "kind", "entries", F.size(F.filter("refs", lambda r: r["key"] == "Kids")).alias("kids")))
    top = good.where("number = root").select("origin", F.get(F.filter("refs", lambda r: r["key"] == "Pages"), F.lit(0))["number"].alias("number"))
    own = lambda k: F.col("entries")[k]
    level = top.join(nodes, ["origin", "number"]).select("origin", "number", "kids", "entries", F.array().cast("array<int>").alias("way"), F.array("number").alias("seen"), *(own(k).alias(k) for k in INHERITED))
    level, leaves = written(level), None
    while True:
        ends = level.where("kids = 0").drop("kids", "seen")
        leaves = ends if leaves is None else leaves.unionByName(ends)
        below = level.where("kids > 0").drop("entries", "kids").withColumnRenamed("number", "parent").join(kids, ["origin", "parent"]).where(~F.array_contains("seen", F.col("child")))
        below = below.withColumnRenamed("child", "number").join(nodes, ["origin", "number"])
        level = written(below.select("origin", "number", "kids", "entries", F.concat("way", F.array("nth")).alias("way"), F.concat("seen", F.array("number")).alias("seen"), *(F.coalesce(own(k), F.col(k)).alias(k) for k in INHERITED)))
        if level.isEmpty():
            break
    from pyspark.sql import Window

    box = F.from_json(F.coalesce("CropBox", "MediaBox"), "array<double>")
    # the order of pages is that of their ways down the tree; a page tree without pages has none
    rows = leaves.where(F.size("way") > 0).withColumn("page", F.row_number().over(Window.partitionBy("origin").orderBy("way")) - 1)
    size = lambda a, b: F.abs(F.get(box, F.lit(b)) - F.get(box, F.lit(a)))
    return rows.select("origin", "page", "number", size(0, 2).alias("width"), size(1, 3).alias("height"), F.coalesce(F.pmod(F.col("Rotate").cast("int"), F.lit(360)), F.lit(0)).alias("rotation"), F.col("Resources").alias("resources"), "entries")


def needed(found: DataFrame, roots: DataFrame) -> DataFrame:
    """(origin, page, number): all objects that a page needs, from ``roots`` (origin, page, number) on, themselves included.

    References back to the page tree (``Parent``) aren't followed; each round
    joins what is new with the references it holds, until nothing is.
    """
    links = written(found.where("error = ''").select("origin", F.col("number").alias("at"), F.explode(F.filter("refs", lambda r: r["key"] != "Parent")).alias("r")).select("origin", "at", F.col("r.number").alias("number")).distinct())
    have = [written(roots.select("origin", "page", "number").distinct())]
    while True:
        new = have[-1].withColumnRenamed("number", "at").join(links, ["origin", "at"]).select("origin", "page", "number").distinct()
        for seen in have:
            new = new.join(seen, ["origin", "page", "number"], "left_anti")
        new = written(new)
        if new.isEmpty():
            dropped(new)
            break
        have.append(new)
    there = found.where("error = ''").select("origin", "number")
    out = have[0]
    for more in have[1:]:
        out = out.union(more)
    return out.join(there, ["origin", "number"], "left_semi").select("origin", "page", "number")


def page_roots(found_pages: DataFrame) -> DataFrame:
    """What pages need to begin with: themselves, and what the resources they inherit refer to."""
    inherited = F.transform(F.regexp_extract_all(F.coalesce("resources", F.lit("")), F.lit("(\\d+) R"), F.lit(1)), lambda n: n.cast("int"))
    return found_pages.select("origin", "page", F.explode(F.concat(F.array("number"), inherited)).alias("number")).distinct()


def page_report(found: DataFrame) -> DataFrame:
    """(origin, page, width, height, rotation, pictures, links, objects): sizes, distinct pictures and annotations of each page, and how many objects it needs."""
    listed = written(pages(found))
    need = needed(found, page_roots(listed))
    kinds = found.where("error = ''").select("origin", "number", "subtype")
    counted = need.join(kinds, ["origin", "number"]).groupBy("origin", "page").agg(F.count_if(F.col("subtype") == "/Image").alias("pictures"), F.count_if(F.col("subtype") == "/Link").alias("links"), F.count("*").alias("objects"))
    return listed.select("origin", "page", "width", "height", "rotation").join(counted, ["origin", "page"])
