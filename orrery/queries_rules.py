"""Named queries of the remaining rules and reports; added to ``queries.QUERIES`` when imported there."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import rules as R
from .functions import scalars as S
from .operators import planning as P
from .operators import report as RP
from .queries import query, sql_texts, t, texts

_RESIZES = ["50%", "640x480", "0%", "x", "12.5%", "10X20", "0x5", "", "@%", "@x@", "0x@", "@X7"]


@query(f"""WITH t(s) AS ({sql_texts(_RESIZES)})
SELECT s, CASE WHEN regexp_full_match(s, '[0-9.]+%') AND try_cast(replace(s, '%', '') AS DOUBLE) > 0 THEN 'percent' WHEN regexp_full_match(lower(s), '[1-9][0-9]*x[1-9][0-9]*') THEN 'size' END AS kind,
CASE WHEN regexp_full_match(s, '[0-9.]+%') AND try_cast(replace(s, '%', '') AS DOUBLE) > 0 THEN try_cast(replace(s, '%', '') AS DOUBLE) WHEN regexp_full_match(lower(s), '[1-9][0-9]*x[1-9][0-9]*') THEN try_cast(split_part(lower(s), 'x', 1) AS DOUBLE) END AS a FROM t""")
def parse_resizes(spark, sf):
    r = R.resize_request(F.col("s"))
    return texts(spark, sf, _RESIZES).select("s", r["kind"].alias("kind"), r["a"].alias("a"))


_SHARES = ["25%", "0%", "100%", "150%", "x%", "-1%", "1:00", "90", "-5", "@%", "@", "1@%"]


@query(f"""WITH t(s) AS ({sql_texts(_SHARES)})
SELECT s, CASE WHEN ends_with(s, '%') THEN CASE WHEN try_cast(replace(s, '%', '') AS DOUBLE) BETWEEN 0 AND 100 THEN try_cast(replace(s, '%', '') AS DOUBLE) / 100 * 120 END
WHEN s = '1:00' THEN 60 WHEN try_cast(s AS DOUBLE) >= 0 THEN try_cast(s AS DOUBLE) END AS seconds FROM t""")
def thumbnail_times(spark, sf):
    return texts(spark, sf, _SHARES).select("s", S.thumbnail_time(F.col("s"), F.lit(120.0)).alias("seconds"))


_RATIOS = ["16:9", "4:3", "0:1", "a:b", "1:2:3", "1", " 3 : 2 ", "@:9", "@:@", " @ : 2 "]


@query(f"""WITH t(s) AS ({sql_texts(_RATIOS)}), p AS (SELECT s, string_split(s, ':') AS p FROM t), n AS (SELECT s, len(p) AS k, try_cast(trim(p[1]) AS INTEGER) AS w, try_cast(trim(p[2]) AS INTEGER) AS h FROM p)
SELECT s, CASE WHEN k = 2 AND w > 0 AND h > 0 THEN w END AS w, CASE WHEN k = 2 AND w > 0 AND h > 0 THEN h END AS h FROM n""")
def parse_ratios(spark, sf):
    r = S.aspect_ratio(F.col("s"))
    return texts(spark, sf, _RATIOS).select("s", r["w"].alias("w"), r["h"].alias("h"))


_PROBES = ["12.5", "N/A", "", "{}", "-3", "inf", "nan", "1e3", "0", "@.5", "@", "@e2"]


@query(f"""WITH t(s) AS ({sql_texts(_PROBES)}) SELECT s, CASE WHEN isfinite(try_cast(s AS DOUBLE)) AND try_cast(s AS DOUBLE) >= 0 THEN try_cast(s AS DOUBLE) ELSE 0 END AS value,
CASE WHEN isfinite(try_cast(s AS DOUBLE)) AND try_cast(s AS DOUBLE) >= 0 THEN floor(try_cast(s AS DOUBLE)) ELSE 0 END::BIGINT AS whole FROM t""")
def probe_numbers(spark, sf):
    return texts(spark, sf, _PROBES).select("s", R.probe_number(F.col("s")).alias("value"), R.probe_integer(F.col("s")).alias("whole"))


@query("""SELECT p_partkey, greatest(1, round_even(p_size * 37 * least(1.0, 1000.0 / greatest(p_size * 37, p_partkey % 3000 + 1)), 0)::INTEGER)::INTEGER AS width,
greatest(1, round_even((p_partkey % 3000 + 1) * least(1.0, 1000.0 / greatest(p_size * 37, p_partkey % 3000 + 1)), 0)::INTEGER)::INTEGER AS height FROM part""")
def fitted_sizes(spark, sf):
    f = R.fitted(F.col("p_size") * 37, (F.col("p_partkey") % 3000 + 1).cast("int"), F.lit(1000.0))
    return t(spark, sf, "part").select("p_partkey", f.alias("f")).select("p_partkey", "f.*")


@query("""WITH s AS (SELECT p_partkey, (p_size * 200)::INTEGER AS w, (p_partkey % 9000 + 1)::INTEGER AS h FROM part)
SELECT p_partkey, CASE WHEN w::BIGINT * h > 4000000 THEN greatest(1, floor(w * sqrt(4000000 / (w::DOUBLE * h)))) ELSE w END::INTEGER AS width, CASE WHEN w::BIGINT * h > 4000000 THEN greatest(1, floor(h * sqrt(4000000 / (w::DOUBLE * h)))) ELSE h END::INTEGER AS height FROM s""")
def comparison_sizes(spark, sf):
    d = S.downsample((F.col("p_size") * 200).cast("int"), (F.col("p_partkey") % 9000 + 1).cast("int"))
    return t(spark, sf, "part").select("p_partkey", d.alias("d")).select("p_partkey", "d.*")


@query("""SELECT l_orderkey, l_linenumber, abs(l_quantity / 10 - l_linenumber) <= greatest(0.25, l_quantity / 10 * 0.005) AS same_duration, abs(16.0 / 9 - l_quantity / l_linenumber) / (16.0 / 9) > 0.01 AS other_aspect FROM lineitem""")
def media_tolerances(spark, sf):
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", S.duration_matches(F.col("l_quantity") / 10, F.col("l_linenumber")).alias("same_duration"), S.aspect_differs(F.lit(16.0), F.lit(9.0), F.col("l_quantity"), F.col("l_linenumber")).alias("other_aspect")
    )


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'infinity'::DOUBLE WHEN event_id % 5 = 0 THEN '-infinity'::DOUBLE ELSE round(user_id - value, 6) END AS snr,
CASE WHEN event_id % 7 = 0 THEN true WHEN event_id % 5 = 0 THEN false ELSE round(user_id - value, 6) >= 20 END AS passed FROM events""")
def audio_noise(spark, sf):
    low = float("-inf")
    source = F.when(F.col("event_id") % 5 == 0, F.lit(low)).otherwise(F.col("user_id").cast("double"))
    difference = F.when(F.col("event_id") % 7 == 0, F.lit(low)).otherwise(F.col("value"))
    snr = R.rounded(R.signal_to_noise(source, difference), 6)
    return t(spark, sf, "events").select("event_id", snr.alias("snr"), (snr >= 20).alias("passed"))


@query("SELECT p_partkey, greatest(1, least(100, ((51 - p_partkey % 60) * 2)))::INTEGER AS quality, coalesce(nullif(p_partkey % 4, 0), 1) AS loops FROM part")
def encoder_quality(spark, sf):
    k = F.col("p_partkey")
    return t(spark, sf, "part").select("p_partkey", R.hardware_quality(k % 60).alias("quality"), R.loop_count(F.nullif(k % 4, F.lit(0))).alias("loops"))


@query("""WITH c AS (SELECT p_partkey, ['mp4', 'mov', 'mkv', 'webm', 'avi'][p_partkey % 5 + 1] AS box, ['h264', 'vp9', 'av1', 'h265', 'other'][(p_partkey // 5) % 5 + 1] AS codec FROM part)
SELECT p_partkey, CASE WHEN box = 'avi' THEN 'unsupported_target_container:avi' WHEN codec = 'other' THEN 'unsupported_video_codec:other' WHEN (codec IN ('h264', 'h265') AND box = 'webm') OR (codec IN ('vp9', 'av1') AND box IN ('mp4', 'mov')) THEN 'unsupported_codec_for_container:' || codec || ':' || box ELSE '' END AS error FROM c""")
def container_codecs(spark, sf):
    pick = lambda names, i: F.get(F.array(*(F.lit(n) for n in names)), i.cast("int"))
    box, codec = pick(["mp4", "mov", "mkv", "webm", "avi"], F.col("p_partkey") % 5), pick(["h264", "vp9", "av1", "h265", "other"], F.expr("p_partkey DIV 5") % 5)
    return t(spark, sf, "part").select("p_partkey", R.container_error(box, codec).alias("error"))


@query("""SELECT p_partkey, CASE WHEN p_size % 20 = 0 THEN 0 WHEN p_partkey % 7 = 0 THEN 1 ELSE greatest(1, least(16, p_size % 20, 8, CASE WHEN p_partkey % 10 > 0 THEN p_partkey % 10 ELSE 8 END, floor(1073741824 / ((p_partkey % 200) * 100000.0 * 16 + 16)))) END::INTEGER AS workers FROM part""")
def worker_bounds(spark, sf):
    k = F.col("p_partkey")
    return t(spark, sf, "part").select("p_partkey", R.worker_bound(F.lit(16), F.col("p_size") % 20, k % 10, F.when(k % 7 != 0, (k % 200) * 100_000 + 1)).alias("workers"))


@query("""WITH s AS (SELECT p_partkey, p_size * 10.0 AS w, (p_partkey % 500 + 1)::DOUBLE AS h FROM part), c AS (SELECT *, least(555.0 / w, 802.0 / h) AS k FROM s)
SELECT p_partkey, round((595 - w * k) / 2, 4) AS x, round((842 - h * k) / 2, 4) AS y, round(w * k, 4) AS width, round(h * k, 4) AS height FROM c""")
def page_layouts(spark, sf):
    f = R.page_fit(F.col("p_size") * 10.0, (F.col("p_partkey") % 500 + 1).cast("double"), 595.0, 842.0, 20.0)
    return t(spark, sf, "part").select("p_partkey", f.alias("f")).select("p_partkey", "f.*")


@query("""SELECT event_id, CASE WHEN NOT (value / 400 BETWEEN 0 AND 1) OR user_id % 9 IN (0, 1) THEN 'invalid_quality_threshold' WHEN event_id % 50 = 0 THEN 'invalid_max_size' WHEN event_id % 11 = 0 THEN 'input_not_found' WHEN event_type <> 'click' THEN 'unsupported_media_pair' ELSE '' END AS error FROM events""")
def gate_requests(spark, sf):
    psnr = F.when(F.col("user_id") % 9 == 0, -1.0).when(F.col("user_id") % 9 == 1, float("inf")).when(F.col("user_id") % 9 == 2, 1.0)
    found = F.col("event_id") % 11 != 0
    return t(spark, sf, "events").select("event_id", R.gate_request_error(F.col("value") / 400, psnr, F.col("event_id") % 50, F.col("event_type") == "click", found).alias("error"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN [false, true, true, true, false] WHEN 'MACHINERY' THEN [true, false, false, false, false] WHEN 'HOUSEHOLD' THEN [false, false, false, false, true] WHEN 'FURNITURE' THEN [false, true, false, false, false] END AS flags FROM customer""")
def strip_modes(spark, sf):
    mode = S.case(F.col("c_mktsegment"), {"BUILDING": " Privacy", "MACHINERY": "all", "HOUSEHOLD": "time", "FURNITURE": "GPS"}, "other")
    return t(spark, sf, "customer").select("c_custkey", R.strip_flags(mode).alias("flags"))


_METRICS = ["SSIM Y:0.9 All:0.991 (20.4)", "PSNR y:40 average:41.25 min:30", "average:inf", "nothing", "SSIM All:0.@ (1)", "PSNR average:@.25 x"]


@query(f"""WITH t(s) AS ({sql_texts(_METRICS)}) SELECT s, try_cast(nullif(regexp_extract(s, '(?:All|average):[ ]*([0-9.]+|inf)', 1), '') AS DOUBLE) AS value FROM t""")
def metric_texts(spark, sf):
    return texts(spark, sf, _METRICS).select("s", R.metric_value(F.col("s")).alias("value"))


@query("""
WITH v AS (SELECT p_partkey, 'dir' || p_size AS p, p_partkey // 3 AS st, CASE p_partkey % 3 WHEN 0 THEN 'mp4' WHEN 1 THEN 'avi' ELSE 'mov' END AS e FROM part)
SELECT p_partkey, st || CASE WHEN e = 'mp4' THEN '_converted' WHEN EXISTS (SELECT 1 FROM v w WHERE w.p = v.p AND w.st = v.st AND w.e = 'mp4') THEN '_from_' || e ELSE '' END || '.mp4' AS name FROM v""")
def video_names(spark, sf):
    e = F.when(F.col("p_partkey") % 3 == 0, "mp4").when(F.col("p_partkey") % 3 == 1, "avi").otherwise("mov")
    rows = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("dir"), F.col("p_size").cast("string")).alias("p"), F.expr("p_partkey DIV 3").cast("string").alias("st"), e.alias("e"))
    there = rows.where("e = 'mp4'").select("p", "st").distinct().withColumn("_there", F.lit(True))
    mark = F.when(F.col("e") == "mp4", "_converted").when(F.col("_there"), F.concat(F.lit("_from_"), "e")).otherwise("")
    return rows.join(there, ["p", "st"], "left").select("p_partkey", F.concat("st", mark, F.lit(".mp4")).alias("name"))


@query("""SELECT doc_id, '{"schema_version":"1.1","command":"compare","ok":' || (n_chars % 2 = 0) || ',"size":' || n_chars || ',"psnr":' || CASE WHEN n_chars % 3 = 0 THEN 'null' ELSE '1.5' END || '}' AS payload, CASE WHEN n_chars % 5 = 0 THEN 2 WHEN n_chars % 2 = 1 THEN 1 ELSE 0 END AS code FROM documents""")
def report_envelopes(spark, sf):
    n = F.col("n_chars")
    psnr = RP.finite(F.when(n % 3 == 0, F.lit(float("inf"))).otherwise(1.5))
    payload = RP.envelope("compare", n % 2 == 0, size=n, psnr=psnr)
    return t(spark, sf, "documents").select("doc_id", payload.alias("payload"), RP.exit_code(n % 5 == 0, n % 2 == 0).alias("code"))


@query("SELECT p_partkey AS input, p_brand AS output, 'bad_' || p_size AS error FROM part WHERE p_size > 45 ORDER BY p_partkey LIMIT 10")
def failure_list(spark, sf):
    rows = t(spark, sf, "part").withColumn("error", F.when(F.col("p_size") > 45, F.concat(F.lit("bad_"), F.col("p_size").cast("string"))).otherwise(""))
    return RP.failures(rows, "p_partkey", "p_brand", "error")


@query(f"""SELECT name, replace(replace(name, '.', '_'), '-', '_') AS tool, destructive OR NOT read_only AS has_side_effects FROM (VALUES {", ".join(f"('{n}', {r}, {d})" for n, r, d, _ in RP.COMMANDS)}) c(name, read_only, destructive)""")
def command_catalogue(spark, sf):
    return RP.catalogue(spark).select("name", "tool", "has_side_effects")


@query("SELECT coalesce(bool_and(p_size > 3 OR p_partkey % 2 = 1), true) AS ready, count(*) AS checks FROM part")
def readiness(spark, sf):
    rows = t(spark, sf, "part").select((F.col("p_size") > 3).alias("ok"), (F.col("p_partkey") % 2 == 0).alias("required"))
    return RP.media_readiness(rows, "ok", "required")


@query("""SELECT doc_id, CASE WHEN length(source || '-' || lang || '-' || doc_id || '-abcdefghijklmnopqrstuvwxyz') > 30 THEN left(source || '-' || lang || '-' || doc_id || '-abcdefghijklmnopqrstuvwxyz', 27) || '...' ELSE source || '-' || lang || '-' || doc_id || '-abcdefghijklmnopqrstuvwxyz' END AS label FROM documents""")
def montage_labels(spark, sf):
    text = F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string"), F.lit("abcdefghijklmnopqrstuvwxyz"))
    return t(spark, sf, "documents").select("doc_id", S.shortened(text).alias("label"))


@query("SELECT conv_id, array_to_string(roles[1:2], ', ') || CASE WHEN len(roles) > 2 THEN printf(' (+%d)', len(roles) - 2) ELSE '' END AS shown FROM (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1)")
def list_previews(spark, sf):
    rows = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", S.preview(F.transform("r", lambda x: x["role"]), 2).alias("shown"))


@query("SELECT o_orderpriority, list_sort(list_distinct(list(o_orderstatus)))::VARCHAR AS formats, len(list_intersect(list_distinct(list(o_orderstatus)), ['O', 'P'])) AS lossless FROM orders GROUP BY 1")
def format_intersections(spark, sf):
    rows = t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("f"))
    shown = F.concat(F.lit("["), F.array_join("f", ", "), F.lit("]"))
    return rows.select("o_orderpriority", shown.alias("formats"), F.size(F.array_intersect("f", F.array(F.lit("O"), F.lit("P")))).cast("long").alias("lossless"))


@query("""SELECT p_partkey, p_size * 1000 AS bytes FROM part WHERE regexp_matches(p_name, '^[a-m]') OR p_size * 1000 BETWEEN 5000 AND 9000""")
def size_selection(spark, sf):
    rows = t(spark, sf, "part").withColumn("bytes", F.col("p_size") * 1000)
    return rows.where(P.selected(F.col("p_name"), F.col("bytes"), ["[a-m]*"]) | P.selected(F.col("p_name"), F.col("bytes"), least=5000, most=9000)).select("p_partkey", "bytes")
