"""Named queries over pictures and animations packed from the tables; added to ``queries.QUERIES`` when imported there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .operators import pictures as PX
from .operators import pixels
from .queries import query, t
from .sources import animation as A

#: An embedding's 64 components as grey levels, 8 x 8.
_LEVELS = "list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) * 128)))::BIGINT)"


def _levels():
    return F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 128))).cast("long"))


def _packed(levels):
    """Levels as bytes."""
    return F.unhex(F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def _pictures(spark, sf):
    """Grey pictures of all vectors of 64 components, as rows of the image source."""
    rows = t(spark, sf, "embeddings").where("size(embedding) = 64")
    return rows.select("vec_id", "label", F.col("vec_id").cast("string").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), _packed(_levels()).alias("data"))


@query(f"""WITH p AS (SELECT vec_id, label, unnest({_LEVELS}) AS v, unnest(range(64)) AS i FROM embeddings WHERE len(embedding) = 64),
a AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS nth FROM embeddings WHERE len(embedding) = 64),
g AS (SELECT label, count(*) AS n, 3 * 18 + 10 AS w, (count(*) + 2) // 3 * 18 + 10 AS h FROM embeddings WHERE len(embedding) = 64 GROUP BY label),
q AS (SELECT p.label, sum(v - 255) AS s, sum((v - 255) * (11 + nth % 3 * 18 + i % 8)) AS sx, sum((v - 255) * (11 + nth // 3 * 18 + i // 8)) AS sy FROM p JOIN a USING (vec_id) GROUP BY p.label)
SELECT g.label, n::INTEGER AS pictures, w::INTEGER AS width, h::INTEGER AS height, (3 * (255 * w * h + s))::BIGINT AS total, (3 * (255 * h * w * (w + 1) // 2 + sx))::BIGINT AS by_column, (3 * (255 * w * h * (h + 1) // 2 + sy))::BIGINT AS by_line FROM g JOIN q USING (label)""")
def montage_pictures(spark, sf):
    out = PX.montages(_pictures(spark, sf), "label", "vec_id", 3)

    @F.pandas_udf("total long, by_column long, by_line long")
    def sums(content: pd.Series) -> pd.DataFrame:
        import numpy as np

        rows = []
        for c in content:
            a = PX.read_png(bytes(c)).astype(np.int64).sum(axis=2)
            rows.append((a.sum(), (a.sum(axis=0) * np.arange(1, a.shape[1] + 1)).sum(), (a.sum(axis=1) * np.arange(1, a.shape[0] + 1)).sum()))
        return pd.DataFrame(rows, columns=["total", "by_column", "by_line"])

    return out.withColumn("s", sums("content")).select("label", "pictures", "width", "height", "s.total", "s.by_column", "s.by_line")


_FRAMES = f"""f AS (SELECT label, vec_id // 50 AS part, vec_id, {_LEVELS} AS levels, row_number() OVER (PARTITION BY label, vec_id // 50 ORDER BY vec_id) - 1 AS frame, count(*) OVER (PARTITION BY label, vec_id // 50) AS frames FROM embeddings WHERE len(embedding) = 64)"""


@query(f"""WITH {_FRAMES}, d AS (SELECT *, vec_id % 7 * 10 AS ms, first_value(vec_id % 7 * 10) OVER (PARTITION BY label, part ORDER BY vec_id) AS first FROM f)
SELECT label || '-' || part AS origin, frame::INTEGER AS frame, frames::INTEGER AS frames, (part % 4)::INTEGER AS loop, (CASE WHEN ms > 0 THEN ms WHEN first > 0 THEN first ELSE 100 END)::INTEGER AS duration_ms, 'RGB' AS mode, list_sum(levels)::BIGINT * 3 AS total FROM d""")
def animation_frames(spark, sf):
    """GIFs packed from vectors, a frame each, and read again."""
    from pyspark.sql import Window

    rows = _pictures(spark, sf).withColumn("part", F.expr("vec_id DIV 50"))
    w = Window.partitionBy("label", "part")
    rows = rows.select(
        F.concat_ws("-", "label", "part").alias("origin"), (F.row_number().over(w.orderBy("vec_id")) - 1).alias("frame"), F.count("*").over(w).cast("int").alias("frames"), (F.col("part") % 4).cast("int").alias("loop"), F.lit(False).alias("poster"),
        (F.col("vec_id") % 7 * 10).cast("int").alias("duration_ms"), "width", "height", "nChannels", F.lit("L").alias("mode"), "data", F.lit("").alias("error"),
    )
    read = A.composed(A.frames(A.animated(rows, "gif")))
    total = F.udf(lambda b: sum(b) - sum(b[3::4]), "long")  # without alpha
    return read.select("origin", "frame", "frames", "loop", "duration_ms", "mode", total("data").alias("total"))


@query(f"SELECT vec_id::VARCHAR AS origin, 64 AS pixels, (SELECT list_sum(list_transform(list_zip(l, range(64)), lambda z: CASE WHEN z[1] >= list_avg(l) THEN (CASE WHEN z[2] = 0 THEN -9223372036854775808 ELSE 2::HUGEINT ** (63 - z[2]) END)::HUGEINT ELSE 0 END)) FROM (SELECT {_LEVELS} AS l))::BIGINT AS ahash FROM embeddings WHERE len(embedding) = 64")
def picture_hashes(spark, sf):
    return PX.hashed(_pictures(spark, sf)).select("origin", F.col("pixels").cast("int").alias("pixels"), "ahash")


@query(f"SELECT vec_id::VARCHAR AS origin, 8 AS width, 8 AS height, list_sum(list_transform(list_zip({_LEVELS}, range(64)), lambda z: z[1] * (8 * (z[2] % 8) + 8 - z[2] // 8)))::BIGINT AS total, '' AS error FROM embeddings WHERE len(embedding) = 64")
def rotated_pictures(spark, sf):
    """Each picture turned to the right and packed as a PNG; its levels, weighed by where they are now."""
    out = PX.processed(_pictures(spark, sf), [("rotate", 90)])

    @F.pandas_udf("long")
    def total(content: pd.Series) -> pd.Series:
        return content.map(lambda c: sum((i + 1) * v for i, v in enumerate(PX.read_png(bytes(c)).ravel().tolist())))

    return out.select("origin", "width", "height", total("content").alias("total"), "error")


#: Segments as hexadecimal digits: a marker, the length of a text in two bytes, the text.
_SEGMENT = "'{k}' || lpad(printf('%X', 2 + strlen({t})), 4, '0') || hex(encode({t}))"
_APP1, _ICC, _NOTE, _SCAN = (_SEGMENT.format(k=k, t=x) for k, x in (("FFE1", "'Exif' || page_id"), ("FFE2", "'ICC_PROFILE' || chr(0) || 'x' || page_id"), ("FFFE", "url"), ("FFDA", "'s' || page_id")))


@query(f"""SELECT page_id, upper(sha256(unhex('FFD8' || {_ICC} || {_SCAN} || repeat('41FF0042', (page_id % 50)::INTEGER) || 'FFD9'))) AS stripped, '' AS error FROM pages""".replace("unhex", "from_hex"))
def stripped_jpegs(spark, sf):
    """JPEGs packed from pages: what tells about the picture goes, its profile and its coded data stay."""
    k = F.col("page_id").cast("string")
    part = lambda kind, text: F.concat(F.lit(kind), F.lpad(F.hex(F.octet_length(text) + 2), 4, "0"), F.hex(F.encode(text, "UTF-8")))
    data = F.concat(
        F.lit("FFD8"), part("FFE1", F.concat(F.lit("Exif"), k)), part("FFE2", F.concat(F.lit("ICC_PROFILE"), F.lit("\0"), F.lit("x"), k)), part("FFFE", F.col("url")), part("FFDA", F.concat(F.lit("s"), k)),
        F.repeat(F.lit("41FF0042"), (F.col("page_id") % 50).cast("int")), F.lit("FFD9"),
    )
    rows = t(spark, sf, "pages").select("page_id", F.unhex(data).alias("content"))
    return pixels.strip_jpegs(rows).select("page_id", F.upper(F.sha2("stripped", 256)).alias("stripped"), "error")


#: Each turn of a conversation as a page of 8 x 4 grey levels, from the digest of its text; of the other side some turns are altered (every third conversation's second, by one bit of each level), some lost.
_TURNS = """t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, sha256(coalesce(text, '')) AS h FROM conversations),
x AS (SELECT conv_id, n, conv_id % 3 = 1 AND n = 1 AS altered, conv_id % 3 = 2 AND n = 2 AS lost FROM t)"""


@query(f"""WITH {_TURNS}, c AS (SELECT conv_id, count(*) AS a, count(*) FILTER (NOT lost) AS b, bool_or(altered) AS altered FROM x GROUP BY conv_id)
SELECT conv_id, a AS source_frames, b AS candidate_frames, a = b AS page_count, CASE WHEN a = b THEN true END AS page_geometry, CASE WHEN a = b THEN NOT altered END AS same, CASE WHEN a = b THEN CASE WHEN altered THEN 1 ELSE 0 END END::BIGINT AS worst,
CASE WHEN a = b THEN CASE WHEN altered THEN round(10 * log10(65025 / 0.75), 6) ELSE 1e9 END END AS psnr, a = b AS passed, CASE WHEN a = b THEN '' ELSE 'quality_gate_failed' END AS error FROM c""")
def verify_turns(spark, sf):
    from pyspark.sql import Window

    from .operators import verify

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    turns = t(spark, sf, "conversations").select("conv_id", n.cast("long").alias("n"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("data"))
    page = [F.lit(4).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels")]
    odd = (F.col("conv_id") % 3 == 1) & (F.col("n") == 1)
    # the lowest bit of every level the other way
    turned = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda k: F.lpad(F.hex(F.conv(F.hex(F.substring("data", k, 1)), 16, 10).cast("int").bitwiseXOR(1)), 2, "0")), ""))
    other = turns.where((F.col("conv_id") % 3 != 2) | (F.col("n") != 2)).withColumn("data", F.when(odd, turned).otherwise(F.col("data")))
    out = verify.verified(turns.select("*", *page), other.select("*", *page), "conv_id", "n", pages=True, min_ssim=0.9)
    told = lambda k: F.try_element_at(F.col("checks"), F.lit(k))
    return out.select("conv_id", "source_frames", "candidate_frames", told("page_count").alias("page_count"), told("page_geometry").alias("page_geometry"), (F.col("ssim") == 1).alias("same"), F.col("worst_position").alias("worst"), F.when(F.col("psnr") < 1e9, F.round("psnr", 6)).when(F.col("psnr").isNotNull(), 1e9).alias("psnr"), "passed", "error")


@query(f"""WITH v AS (SELECT label, vec_id, {_LEVELS} AS l FROM embeddings WHERE len(embedding) = 64), p AS (SELECT label, vec_id, unnest(l) AS x FROM v), g AS (SELECT label, count(*) * 8 AS height FROM v GROUP BY label)
SELECT p.label, ((max(height) + 31) // 32)::BIGINT AS tiles, round(avg(CASE WHEN vec_id % 3 = 0 THEN power(least(x + 9, 255) - x, 2) ELSE 0 END) * 0.75, 6) AS mse, '' AS error FROM p JOIN g USING (label) GROUP BY p.label""")
def compare_sheets(spark, sf):
    """A label's pictures below each other as one tall picture, compared by tiles with one in which every third is brighter."""
    from .operators import compare as C

    def sheet(levels):
        rows = t(spark, sf, "embeddings").where("size(embedding) = 64").select("label", "vec_id", F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), "").alias("h"))
        joined = rows.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "h"))), lambda s: s["h"]), "").alias("h"), (F.count("*") * 8).cast("int").alias("height"))
        return C.tiles(joined.select("label", "height", F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.unhex("h").alias("data")), "label", 32)

    brighter = F.transform(_levels(), lambda v: F.when(F.col("vec_id") % 3 == 0, F.least(v + 9, F.lit(255))).otherwise(v))
    return C.compare_tiles(sheet(_levels()), sheet(brighter), "label", 32).select("label", "tiles", F.round("mse", 6).alias("mse"), "error")


def _pdf(ids: list[int]) -> bytes:
    """A file of a page for each id: every second inherits its size, each has as many pictures as the id's remainder by 3, of which all pages share the first."""
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Subtype /Image /Length 1 >>\nstream\nx\nendstream"}
    for i in ids:
        own = [3, *(4 + 10 * i + k for k in range(1, i % 3))][: i % 3]
        bodies |= {n: bodies[3] for n in own}
        size = b" /MediaBox [0 0 %d 200]" % (50 + i % 300) if i % 2 == 0 else b""
        bodies[4 + 10 * i] = b"<< /Type /Page /Parent 2 0 R /Rotate %d%s /Resources << /XObject << %s >> >> >>" % (i % 4 * 90, size, b" ".join(b"/I%d %d 0 R" % (n, n) for n in own))
    bodies[2] = b"<< /Type /Pages /MediaBox [0 0 111 222] /Kids [%s] >>" % b" ".join(b"%d 0 R" % (4 + 10 * i) for i in ids)
    out, table = bytearray(b"%PDF-1.4\n"), b""
    for n, body in bodies.items():
        table += b"%d 1\n%010d 00000 n \n" % (n, len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    return bytes(out) + b"xref\n" + table + b"trailer\n<< /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % len(out)


@query("""SELECT 'f' || page_id // 7 AS origin, (row_number() OVER (PARTITION BY page_id // 7 ORDER BY page_id) - 1)::INTEGER AS page, CASE WHEN page_id % 2 = 0 THEN 50 + page_id % 300 ELSE 111 END::DOUBLE AS width,
CASE WHEN page_id % 2 = 0 THEN 200 ELSE 222 END::DOUBLE AS height, (page_id % 4 * 90)::INTEGER AS rotation, (page_id % 3)::BIGINT AS pictures, 0::BIGINT AS links, (page_id % 3 + 1)::BIGINT AS objects FROM pages""")
def pdf_pages(spark, sf):
    """PDFs packed from pages' ids, a page each, and their object graphs read again."""
    from .sources import pdf

    make = F.udf(lambda ids: bytearray(_pdf(list(ids))), "binary")
    files = t(spark, sf, "pages").groupBy(F.concat(F.lit("f"), F.expr("page_id DIV 7").cast("string")).alias("origin")).agg(F.sort_array(F.collect_list("page_id")).alias("ids"))
    from .operators.tables import written

    return pdf.page_report(written(pdf.objects(files.select("origin", make("ids").alias("content")))))


@query("""SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'already_within_target' WHEN 1 THEN 'lossless' ELSE '' END AS outcome, CASE WHEN vec_id % 3 = 2 THEN 'target_size_unreachable' ELSE '' END AS error, CASE WHEN vec_id % 3 = 2 THEN 16 END::BIGINT AS attempts,
CASE WHEN vec_id % 3 < 2 THEN true END AS fits FROM embeddings WHERE len(embedding) = 64""")
def encoded_to_budget(spark, sf):
    """Every third picture stays, every third has room for a lossless PNG, every third a budget that no PNG meets."""
    from .operators import budget as B

    k = F.col("vec_id") % 3
    rows = _pictures(spark, sf).withColumns({"limit": F.when(k == 0, 60).when(k == 1, 100_000).otherwise(10), "size": F.when(k == 0, 50).otherwise(1_000_000)})
    out = B.encoded_to_budget(rows, "vec_id", "limit", "size")
    limit = F.when(F.col("vec_id") % 3 == 0, 60).otherwise(100_000)
    return out.select("vec_id", "outcome", "error", "attempts", (F.col("bytes") <= limit).alias("fits"))
