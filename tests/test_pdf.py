"""The object graph of PDFs that the tests write."""

import random
import zlib

import pytest

from orrery.sources import pdf


def classic(bodies, root=1, info=None, trailer=b"", before=b"%PDF-1.4\n%\xe2\xe3\n", prev=None, at=0):
    """A file, or an update, with a cross-reference table; bodies: number to the object's bytes."""
    out, places = bytearray(before), {}
    for n, body in bodies.items():
        places[n] = at + len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = at + len(out)
    out += b"xref\n"
    for n in sorted(places):
        out += b"%d 1\n%010d 00000 n \n" % (n, places[n])
    extra = (b" /Info %d 0 R" % info if info else b"") + (b" /Prev %d" % prev if prev else b"") + trailer
    out += b"trailer\n<< /Root %d 0 R /Size 99%s >>\nstartxref\n%d\n%%%%EOF\n" % (root, extra, start)
    return bytes(out)


PICTURE = b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 3 >>\nstream\nabc\nendstream"
BODIES = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /MediaBox [0 0 200 100] /Resources << /XObject << /A 8 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Rotate -90 >>",
    4: b"<< /Type /Pages /Parent 2 0 R /Kids [5 0 R 6 0 R] /Count 2 /Rotate 180 /Resources << /XObject << /B 9 0 R /C 8 0 R >> >> >>",
    5: b"<< /Type /Page /Parent 4 0 R /MediaBox [10 10 60.5 30] /Annots [10 0 R] >>", 6: b"<</Type/Page/Parent 4 0 R/Rotate 0/Contents 11 0 R/Resources 12 0 R/Name(a \\(b\\) \\101\\\n)/Hex<FEFF00e9>>>",
    8: PICTURE, 9: PICTURE, 10: b"<< /Subtype /Link /Dest [3 0 R /Fit] >>", 11: b"<< /Length 14 0 R >> stream\nq Q\nendstream", 12: b"<< /Font << /F 13 0 R >> >>", 13: b"<< /Type /Font /Self 13 0 R >>", 14: b"3", 15: b"<< /Title (unused) >>",
}


def streamed(bodies, root=1, predictor=True):
    """The same objects within an object stream, and a cross-reference stream."""
    inside = {n: b for n, b in bodies.items() if b"stream" not in b}
    out, rows = bytearray(b"%PDF-1.5\n"), {}
    for n, b in bodies.items():
        if n not in inside:
            rows[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    heads, body = [], b""
    for k, (n, b) in enumerate(inside.items()):
        heads += [n, len(body)]
        body += b + b" "
        rows[n] = (2, 90, k)
    head = " ".join(map(str, heads)).encode() + b" "
    packed = zlib.compress(head + body)
    rows[90] = (1, len(out), 0)
    out += b"90 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\r\n%s\nendstream\nendobj\n" % (len(inside), len(head), len(packed), packed)
    start = len(out)
    rows[91] = (1, start, 0)
    lines = [bytes([a]) + b.to_bytes(3, "big") + bytes([c]) for _, (a, b, c) in sorted(rows.items())]
    index = b" ".join(b"%d 1" % n for n in sorted(rows))
    if predictor:  # each line less the one above
        up = [bytes(5), *lines[:-1]]
        data, how = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(a, u)) for a, u in zip(lines, up)), b" /DecodeParms << /Predictor 12 /Columns 5 >>"
    else:
        data, how = b"".join(lines), b""
    data = zlib.compress(data)
    out += b"91 0 obj\n<< /Type /XRef /W [1 3 1] /Index [%s] /Size 92 /Root %d 0 R /Filter /FlateDecode%s /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (index, root, how, len(data), data, start)
    return bytes(out)


REPORT = {(0, 200.0, 100.0, 270, 1, 0, 2), (1, 50.5, 20.0, 180, 2, 1, 5), (2, 200.0, 100.0, 0, 0, 0, 5)}


@pytest.mark.parametrize("make", [classic, streamed, lambda b: streamed(b, predictor=False)])
def test_pages_and_what_they_need(spark, make):
    found = pdf.objects(spark.createDataFrame([("x", make(BODIES))], "origin string, content binary")).cache()
    assert {r.error for r in found.collect()} == {""}
    got = {(r.page, r.width, r.height, r.rotation, r.pictures, r.links) for r in pdf.page_report(found).collect()}
    # the second page's link leads to the first one, whose objects it needs, too
    assert got == {x[:6] for x in REPORT}
    need = {}
    for r in pdf.needed(found, pdf.page_roots(pdf.pages(found))).collect():
        need.setdefault(r.page, set()).add(r.number)
    assert need == {0: {3, 8}, 1: {5, 8, 9, 10, 3}, 2: {6, 11, 12, 13, 14}}
    six = next(r for r in found.collect() if r.number == 6)
    assert six.entries["Name"] == '"a (b) A"' and six.entries["Hex"] == '"\\u00e9"'


def test_updates_count(spark):
    first = classic(BODIES)
    start = int(first.split(b"startxref\n")[1].split()[0])
    second = first + classic({5: b"<< /Type /Page /Parent 4 0 R /MediaBox [0 0 7 8] >>"}, before=b"", prev=start, at=len(first))
    rows = pdf.page_report(pdf.objects(spark.createDataFrame([("x", second)], "origin string, content binary"))).collect()
    assert {(r.page, r.width, r.height) for r in rows} == {(0, 200.0, 100.0), (1, 7.0, 8.0), (2, 200.0, 100.0)}


def test_files_that_cant_be_read(spark):
    loop = dict(BODIES) | {4: b"<< /Type /Pages /Kids [2 0 R 5 0 R] >>"}
    rows = {
        "none": None, "text": b"hello", "empty": b"", "cut": classic(BODIES)[:-60], "locked": classic(BODIES, trailer=b" /Encrypt 15 0 R"), "deep": classic({1: b"[" * 5000}), "odd": b"%PDF-1.4\nstartxref\n9\n", "loop": classic(loop),
        "lzw": streamed(BODIES).replace(b"/FlateDecode", b"/LZWDecode  "),
    }
    found = pdf.objects(spark.createDataFrame(list(rows.items()), "origin string, content binary")).cache()
    assert {r.origin: r.error for r in found.collect()} == {"none": "missing_content", "text": "not_a_pdf", "empty": "not_a_pdf", "cut": "broken_pdf", "locked": "pdf_password_required", "deep": "broken_pdf", "odd": "broken_pdf", "loop": "", "lzw": "unsupported_pdf_filter"}
    assert {(r.origin, r.page) for r in pdf.page_report(found).collect()} == {("loop", 0), ("loop", 1)}
    assert pdf.page_report(found.limit(0)).count() == 0


def test_random_bytes_dont_raise():
    rng = random.Random(6)
    whole = classic(BODIES)
    for _ in range(200):
        data = bytearray(whole)
        for _ in range(6):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            list(pdf.File(bytes(data)).objects())
        except (pdf.Broken, KeyError, TypeError, IndexError, ValueError, AttributeError):
            pass
