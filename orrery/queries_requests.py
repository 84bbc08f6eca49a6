"""Named queries of request checks, plans and result texts; added to ``queries.QUERIES`` when imported there."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import requests as Q
from .functions import scalars as S
from .operators import report as RP
from .queries import query, sql_texts, t, texts


def _pick(names: list, at):
    return F.get(F.array(*(F.lit(n) for n in names)), at.cast("int"))


_PATHS = ["/a/b", "a/../b/./c", "/../x", "//a///b/", "", "/src", "/src/out", "/srcs/x", "/src/../src/deep/er"]
_CLEAN = ["/a/b", "/b/c", "/x", "/a/b", "/", "/src", "/src/out", "/srcs/x", "/src/deep/er"]


@query(f"""WITH t(s, c) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in zip(_PATHS, _CLEAN, strict=True))})
SELECT s, c AS clean, lower(c) AS folded, CASE WHEN starts_with(c, '/src/') THEN c END AS nested FROM t""")
def path_keys(spark, sf):
    s = F.col("s")
    return texts(spark, sf, _PATHS).select("s", Q.collision_key(s).alias("clean"), Q.collision_key(s, folded=True).alias("folded"), Q.nested_root(s, ["/src", "/else"]).alias("nested"))


_NAMES = ["a.png", "sub/b.png", "../c.png", "x/../../d", "/e.png", "con.txt", "bad|name", "sub/..", "", "ok/../fine.jpg"]


@query(f"""WITH t(s) AS ({sql_texts(_NAMES)}) SELECT s, CASE WHEN s = '/e.png' THEN 'output_boundary' WHEN s IN ('con.txt', 'bad|name', 'sub/..', '') THEN 'invalid_filename_component'
WHEN s IN ('../c.png', 'x/../../d') THEN 'output_boundary' ELSE '' END AS planned, CASE WHEN s IN ('', 'a.png') THEN '' ELSE 'invalid_filename_component' END AS affix FROM t""")
def planned_paths(spark, sf):
    return texts(spark, sf, _NAMES).select("s", Q.planned_error(F.lit("/out"), F.col("s")).alias("planned"), Q.affix_error(F.col("s")).alias("affix"))


@query("""SELECT o_orderkey, list_contains(['/in/' || (o_orderkey % 7) || '.mp4', '/in/x.mp4'], '/in/' || (o_custkey % 7) || '.mp4') AS aliased FROM orders""")
def aggregate_alias(spark, sf):
    inputs = F.array(F.concat(F.lit("/in/./"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".mp4")), F.lit("/in/x.mp4"))
    return t(spark, sf, "orders").select("o_orderkey", Q.aggregate_aliases(inputs, F.concat(F.lit("/in//"), (F.col("o_custkey") % 7).cast("string"), F.lit(".mp4"))).alias("aliased"))


_LEAST = ["500KB", "2mb", "junk", "-3", ""]


@query(f"""WITH t(s) AS ({sql_texts(_LEAST)} UNION ALL SELECT NULL) SELECT s, CASE WHEN s IS NULL THEN 0 WHEN s = '500KB' THEN 512000 WHEN s = '2mb' THEN 2097152 END::BIGINT AS bytes,
CASE WHEN s IS NULL OR s IN ('500KB', '2mb') THEN '' ELSE 'invalid_min_file_size' END AS error FROM t""")
def least_sizes(spark, sf):
    rows = texts(spark, sf, _LEAST).union(spark.sql("SELECT CAST(NULL AS STRING) AS s"))
    return rows.select("s", Q.minimum_size(F.col("s"), S.parse_size(F.col("s"))).alias("m")).select("s", "m.*")


@query("""SELECT p_partkey, CASE WHEN p_partkey::BIGINT * 900000 > 120000000 THEN 'image_too_large' WHEN p_size % 4 > 1 THEN 'animated_input_not_supported' ELSE '' END AS error FROM part""")
def still_pictures(spark, sf):
    return t(spark, sf, "part").select("p_partkey", Q.still_error(F.col("p_size") % 4, F.col("p_partkey").cast("long") * 900_000).alias("error"))


_SUFFIXES = [".jpg", ".png", ".webp", ".gif", ".heic"]
_REQUEST = """r AS (SELECT p_partkey, ['.jpg', '.png', '.webp', '.gif', '.heic'][p_partkey % 5 + 1] AS e, ['lossless', 'high', 'odd'][(p_partkey // 5) % 3 + 1] AS preset,
CASE WHEN p_size % 4 = 0 THEN p_size * 3 - 6 END AS q, CASE WHEN p_size % 3 = 0 THEN p_size * 1000 END AS target, CASE WHEN p_size % 5 = 0 THEN p_size - 10 END AS longest, p_partkey % 11 = 0 AS there, p_size * 900 AS bytes, p_size AS w FROM part)"""


def _requests(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    return t(spark, sf, "part").select(
        k, _pick(_SUFFIXES, k % 5).alias("e"), _pick(["lossless", "high", "odd"], F.expr("p_partkey DIV 5") % 3).alias("preset"), F.when(n % 4 == 0, n * 3 - 6).alias("q"),
        F.when(n % 3 == 0, n * 1000).alias("target"), F.when(n % 5 == 0, n - 10).alias("longest"), (k % 11 == 0).alias("there"), (n * 900).alias("bytes"), n.alias("w"),
    )


@query(f"""WITH {_REQUEST} SELECT p_partkey, preset = 'lossless' AND q IS NULL AND target IS NULL AND longest IS NULL AND e IN ('.jpg', '.webp', '.heic') AS copied,
coalesce(bytes <= target AND (longest IS NULL OR w <= longest), false) AS fits,
CASE WHEN there THEN 'output_exists' WHEN e = '.gif' THEN 'unsupported_input_format:.gif' WHEN preset = 'odd' THEN 'unsupported_compress_preset:odd' WHEN longest <= 0 THEN 'max_size_must_be_positive'
WHEN q NOT BETWEEN 1 AND 100 THEN 'quality_must_be_between_1_and_100' WHEN q IS NOT NULL AND target IS NOT NULL THEN 'quality_and_target_size_are_mutually_exclusive' ELSE '' END AS error FROM r""")
def compress_requests(spark, sf):
    c = F.col
    return _requests(spark, sf).select(
        "p_partkey", Q.copied_losslessly(c("e"), c("preset"), c("q"), c("target"), c("longest")).alias("copied"), Q.already_fits(c("bytes"), c("w"), c("w"), c("target"), c("longest")).alias("fits"),
        Q.compress_error(c("e"), c("there"), c("preset"), c("q"), c("target"), c("longest")).alias("error"),
    )


_BOXES = ["0,0,10,10", "5,5,5,9", "-1,0,4,4", "a,b", "1,2,3"]


@query(f"""WITH t(s) AS ({sql_texts(_BOXES)} UNION ALL SELECT NULL), a(r) AS (VALUES ('16:9'), ('0:1'), (NULL)), b(x) AS (VALUES (true), (false))
SELECT s, r, x, CASE WHEN (s IS NOT NULL)::INT + (r IS NOT NULL)::INT + x::INT <> 1 THEN 'select_exactly_one_mode' WHEN s IS NOT NULL AND s <> '0,0,10,10' THEN 'invalid_crop_box' WHEN r = '0:1' THEN 'invalid_aspect_ratio' ELSE '' END AS error FROM t, a, b""")
def crop_requests(spark, sf):
    boxes = texts(spark, sf, _BOXES).union(spark.sql("SELECT CAST(NULL AS STRING) AS s"))
    rows = boxes.withColumn("r", F.explode(F.array(F.lit("16:9"), F.lit("0:1"), F.lit(None).cast("string")))).withColumn("x", F.explode(F.array(F.lit(True), F.lit(False))))
    parts = F.transform(F.split("s", ","), lambda v: v.try_cast("int"))
    parsed = F.when((F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull()), parts)
    return rows.select("s", "r", "x", Q.crop_error(F.col("s"), parsed, F.col("r"), F.col("x")).alias("error"))


@query("""WITH m AS (SELECT p_partkey, ['.png', '.webp', '.gif', ''][p_partkey % 4 + 1] AS e, p_size % 6 - 1 AS cols, p_size % 7 - 1 AS gap, CASE WHEN p_size % 2 = 0 THEN p_size - 4 END AS w FROM part)
SELECT p_partkey, CASE WHEN e = '.gif' THEN 'unsupported_output_format: .gif' WHEN e = '' THEN 'unsupported_output_format: <none>' WHEN cols <= 0 OR gap < 0 THEN 'invalid_montage_layout' WHEN w <= 0 THEN 'invalid_cell_width' ELSE '' END AS error FROM m""")
def montage_requests(spark, sf):
    n, none = F.col("p_size"), F.lit(None).cast("int")
    e = _pick([".png", ".webp", ".gif", ""], F.col("p_partkey") % 4)
    return t(spark, sf, "part").select("p_partkey", Q.montage_error(e, n % 6 - 1, n % 7 - 1, F.lit(0), F.when(n % 2 == 0, n - 4), none).alias("error"))


@query("""WITH v AS (SELECT o_orderkey, ['preserve', 'compatible', 'compact', 'loud'][o_orderkey % 4 + 1] AS policy, o_orderkey % 9 > 0 AS there, o_orderkey % 7 = 0 AS taken, (o_custkey % 50 - 1) * 100000 AS target, (o_orderkey % 13) / 2.0::DOUBLE AS d, o_orderkey % 2 = 0 AS sound FROM orders),
b AS (SELECT *, CASE WHEN target > 0 AND d >= 0.05 THEN greatest(0, target * 8 / d * 0.98::DOUBLE - CASE WHEN sound THEN CASE WHEN policy = 'compact' THEN 96000 ELSE 192000 END ELSE 0 END) ELSE 0 END AS raw FROM v)
SELECT o_orderkey, CASE WHEN policy = 'loud' THEN 'unsupported_audio_policy:loud' WHEN NOT there THEN 'input_not_found' WHEN taken THEN 'output_exists' WHEN target <= 0 THEN 'target_size_must_be_positive' ELSE '' END AS error,
floor(least(raw, 2e9::DOUBLE))::BIGINT AS bps, CASE WHEN target + 5000 > 0 AND o_orderkey % 3 = 0 AND target > 0 THEN greatest(8000, floor(100000 * target / (target + 5000) * 0.95::DOUBLE))::BIGINT END AS again FROM b""")
def target_requests(spark, sf):
    k = F.col("o_orderkey")
    target = (F.col("o_custkey") % 50 - 1) * 100_000
    policy = _pick(["preserve", "compatible", "compact", "loud"], k % 4)
    actual = F.when((k % 3 == 0) & (target > 0), target + 5000).otherwise(target)
    return t(spark, sf, "orders").select(
        "o_orderkey", Q.target_error(policy, k % 9 > 0, k % 7 == 0, target).alias("error"), Q.policy_bitrate(target, (k % 13) / 2.0, k % 2 == 0, policy).alias("bps"), Q.retry_bitrate(F.lit(100_000), target, actual).alias("again"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'concat_requires_two_inputs' WHEN o_orderkey % 5 = 0 THEN 'output_collision' WHEN o_custkey % 6 = 0 THEN 'input_not_found' WHEN o_custkey % 7 = 0 THEN 'output_exists' ELSE '' END AS error,
CASE WHEN o_orderkey % 4 = 0 THEN 'concat_requires_two_inputs' WHEN o_custkey % 6 = 0 THEN 'input_not_found' WHEN o_custkey % 7 = 0 THEN 'output_exists' WHEN o_orderkey % 3 = 1 THEN 'unsupported_codec_for_container:h264:webm' WHEN o_orderkey % 3 = 2 THEN 'unsupported_target_container:avi' ELSE '' END AS recoded FROM orders""")
def concat_requests(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    paths = F.when(k % 4 == 0, F.array(F.lit("/a.mp4"))).otherwise(F.array(F.lit("/a.mp4"), F.when(k % 5 == 0, "/x/../out.mp4").otherwise("/b.mp4")))
    output = F.concat(F.lit("/joined."), _pick(["MOV", "webm", "avi"], k % 3))
    return t(spark, sf, "orders").select("o_orderkey", Q.concat_error(paths, F.lit("/out.mp4"), c % 6 != 0, c % 7 == 0).alias("error"), Q.concat_error(paths, output, c % 6 != 0, c % 7 == 0, reencode=True).alias("recoded"))


@query("""SELECT p_partkey, p_partkey % 3 = 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0 AS replaceable,
CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE greatest(least(1.0, p_size * 2.0 / greatest(600 / (144 / 72.0), 400 / (72 / 72.0))), least(1.0, p_size * 2.0 / greatest(600 / (300 / 72.0), 400 / (300 / 72.0)))) END::DOUBLE AS scale FROM part""")
def embedded_pictures(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    at = lambda w, h: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
    dpi = F.when(k % 4 != 0, n * 2.0)
    scale = Q.placement_scale(F.lit(600), F.lit(400), dpi, F.array(at(144.0, 72.0), at(300.0, 300.0), at(0.0, 5.0)))
    return t(spark, sf, "part").select("p_partkey", Q.replaceable(k % 3, n % 5 == 0, F.lit(None).cast("boolean"), n % 7 == 0).alias("replaceable"), scale.alias("scale"))


_FORMATS = ["png", ".JPG", "webp", "avif", "bmp"]
_ADVICE = ["PNG", "WebP (lossless)", "AVIF", "JPEG", "keep"]
_KINDS = ["photo", "screenshot", "graphic", "text", "animation"]


@query("""WITH r AS (SELECT p_partkey, ['png', '.JPG', 'webp', 'avif', 'bmp'][p_partkey % 5 + 1] AS f, ['PNG', 'WebP (lossless)', 'AVIF', 'JPEG', 'keep'][(p_partkey // 5) % 5 + 1] AS a, ['photo', 'screenshot', 'graphic', 'text', 'animation'][p_size % 5 + 1] AS kind FROM part)
SELECT p_partkey, CASE WHEN a = 'PNG' THEN CASE WHEN f = 'png' THEN 'compress -p lossless' ELSE 'convert -t png -q web' END WHEN a LIKE 'WebP%' THEN CASE WHEN f = 'webp' THEN 'compress --quality 90' ELSE 'convert -t webp -q high' END
WHEN a = 'AVIF' THEN CASE WHEN f = 'avif' THEN 'compress --quality 90' ELSE 'convert -t avif -q high' END WHEN a = 'JPEG' THEN CASE WHEN f = '.JPG' THEN 'compress --quality 95' ELSE 'convert -t jpg -q high' END ELSE 'convert -t png -q web' END AS plan,
CASE WHEN f = 'webp' THEN '保持现状' ELSE 'convert -t webp -q high' END AS moving,
CASE kind WHEN 'photo' THEN '照片类图片，有损压缩效果最佳' WHEN 'screenshot' THEN '截图/UI 类图片，无损压缩保持清晰' WHEN 'graphic' THEN '图形/图标类图片，颜色少适合无损' WHEN 'text' THEN '文字类图片，需要无损保持清晰' ELSE '' END ||
CASE WHEN a LIKE 'WebP%' THEN '，WebP 兼容性好且压缩率高' WHEN a = 'AVIF' THEN '，AVIF 压缩率最高但兼容性稍差' WHEN a = 'PNG' THEN '，PNG 无损且兼容性最好' WHEN a = 'JPEG' THEN '，JPEG 兼容性最广' ELSE '' END AS reason FROM r""")
def picture_plans(spark, sf):
    k = F.col("p_partkey")
    f, a, kind = _pick(_FORMATS, k % 5), _pick(_ADVICE, F.expr("p_partkey DIV 5") % 5), _pick(_KINDS, F.col("p_size") % 5)
    plan, moving = Q.plan_for(f, a), Q.animation_plan(f)
    return t(spark, sf, "part").select("p_partkey", Q.plan_text(plan["command"], plan["arguments"]).alias("plan"), Q.plan_text(moving["command"], moving["arguments"]).alias("moving"), Q.reason(kind, a).alias("reason"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, ['video.compress', 'video.convert', 'keep'][l_linenumber % 3 + 1] AS action, ['h264', 'h265', 'vp9'][l_partkey % 3 + 1] AS codec, (l_quantity * 1000)::BIGINT AS est, (l_suppkey % 5 * 40000)::BIGINT AS bytes FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE action WHEN 'video.compress' THEN 'video compress -p web --codec ' || codec WHEN 'video.convert' THEN 'video convert -t mp4 --codec ' || codec ELSE '保持现状' END AS plan,
CASE WHEN action <> 'keep' AND est > 0 THEN 1 ELSE 0 END AS estimates, CASE WHEN action <> 'keep' AND est > 0 THEN CASE WHEN bytes > 0 THEN round_even(est / bytes, 4) ELSE 0 END END::DOUBLE AS ratio FROM v""")
def video_plans(spark, sf):
    action, codec = _pick(["video.compress", "video.convert", "keep"], F.col("l_linenumber") % 3), _pick(["h264", "h265", "vp9"], F.col("l_partkey") % 3)
    plan = Q.video_plan(action, codec)
    estimated = F.when(action == "keep", F.lit(0).cast("long")).otherwise((F.col("l_quantity") * 1000).cast("long"))
    made = Q.video_estimates(codec, codec, estimated, (F.col("l_suppkey") % 5 * 40_000).cast("long"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", Q.plan_text(plan["command"], plan["arguments"]).alias("plan"), F.size(made).alias("estimates"), F.get(made, 0)["compression_ratio"].alias("ratio"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN '' WHEN n_nationkey <= 12 THEN '  体积比: [green]' || printf('%.1f', n_nationkey * 100.0 / 12) || '%[/green]（节省 ' || printf('%.1f', (12 - n_nationkey) * 1.0) || ' KB）'
ELSE '  体积比: [yellow]' || printf('%.1f', n_nationkey * 100.0 / 12) || '%[/yellow]（增加 ' || printf('%.1f', (n_nationkey - 12) * 1.0) || ' KB）' END AS line FROM nation WHERE n_nationkey <> 12""")
def ratio_lines(spark, sf):
    out = F.col("n_nationkey").cast("long") * 1024
    return t(spark, sf, "nation").where("n_nationkey <> 12").select("n_nationkey", Q.ratio_text(F.lit(12 * 1024), out).alias("line"))


@query("SELECT p_partkey, greatest(1, round_even(p_size * 37.5 * (p_partkey % 3) / 4, 0))::BIGINT AS bytes FROM part")
def scaled_estimates(spark, sf):
    return t(spark, sf, "part").select("p_partkey", Q.estimated_size(F.col("p_size") * 37.5, (F.col("p_partkey") % 3) / 4).alias("bytes"))


_LINES = ["pdf merge a b", "--json convert x", "", "video", "-v watermark --json text", "resize -x 3"]


@query(f"""WITH t(s) AS ({sql_texts(_LINES)}) SELECT s, CASE s WHEN 'pdf merge a b' THEN 'pdf.merge' WHEN '--json convert x' THEN 'convert' WHEN '' THEN 'cli' WHEN 'video' THEN 'video' WHEN 'resize -x 3' THEN 'resize' ELSE 'watermark.text' END AS id FROM t""")
def command_ids(spark, sf):
    return texts(spark, sf, _LINES).select("s", Q.command_id(F.filter(F.split("s", " "), lambda w: w != "")).alias("id"))


_ERRORS = ["NoSuchOption", "MissingParameter", "BadParameter", "UsageError", "FileError"]


@query(f"""WITH t(s) AS ({sql_texts(_ERRORS)}) SELECT s, CASE s WHEN 'NoSuchOption' THEN 'invalid_option' WHEN 'MissingParameter' THEN 'missing_parameter' WHEN 'BadParameter' THEN 'invalid_value' WHEN 'UsageError' THEN 'usage_error' ELSE 'cli_error' END AS code FROM t""")
def usage_codes(spark, sf):
    return texts(spark, sf, _ERRORS).select("s", Q.usage_code(F.col("s")).alias("code"))


@query(f"SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in Q.DEFAULTS.items())}) d(name, value)")
def automation_defaults(spark, sf):
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f"('{k}', '{v}')" for k, v in Q.DEFAULTS.items())} AS d(name, value)")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus <> 'F') AS actionable, count(*) FILTER (o_orderstatus = 'F') AS keep, sum(o_custkey)::DOUBLE / nullif(sum(o_orderkey), 0) AS ratio FROM orders GROUP BY 1""")
def optimize_counts(spark, sf):
    rows = t(spark, sf, "orders").withColumn("command", F.when(F.col("o_orderstatus") == "F", "keep").otherwise("convert"))
    return RP.plan_counts(rows, ["o_orderpriority"], "command", "o_orderkey", "o_custkey")


@query("""SELECT page_id % 50 AS doc, count(DISTINCT page_id // 100) AS processed, count(DISTINCT page_id // 100) FILTER (strlen(html) % 3 = 0) AS any_replaced FROM (SELECT *, row_number() OVER (PARTITION BY page_id % 50, page_id // 100 ORDER BY page_id) AS n FROM pages) WHERE n = 1 GROUP BY 1""")
def embedded_counts(spark, sf):
    rows = t(spark, sf, "pages").select((F.col("page_id") % 50).alias("doc"), F.expr("page_id DIV 100").alias("xref"), F.col("page_id").alias("seq"), (F.octet_length("html") % 3 == 0).alias("replaced"))
    out = RP.embedded_counts(rows, "doc", "xref", "seq", "replaced")
    return out.select("doc", "processed", F.col("replaced").alias("any_replaced"))
