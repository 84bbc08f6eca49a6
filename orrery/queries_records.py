"""Named queries of records, ladders and request lines; added to ``queries.QUERIES`` when imported there."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import planning as P
from .operators import report as RP
from .queries import query, t
from .sources import files as SRC
from .sources import lines as L


@query("SELECT 'docs/' || doc_id AS path, 'sha1' AS algorithm, sha1(text) AS digest, strlen(text)::BIGINT AS size_bytes, CASE WHEN n_chars % 7 = 0 THEN 'unreadable' ELSE '' END AS error FROM documents")
def hash_records(spark, sf):
    rows = t(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("p"), SRC.digest(F.col("text"), "sha1").alias("d"), F.octet_length("text").alias("n"), F.when(F.col("n_chars") % 7 == 0, "unreadable").alias("e"))
    return RP.hash_records(rows, "p", "sha1", "d", "n", "e")


@query("""SELECT p_partkey::VARCHAR AS path, md5(p_name) AS sha256, p_size::BIGINT AS size_bytes, p_size * 2 AS width, p_size % 2 = 0 AS has_alpha,
array_to_string(CASE WHEN p_partkey % 3 = 0 THEN ['Artist', 'GPSLatitude'] WHEN p_partkey % 3 = 1 THEN ['LensModel'] ELSE [] END, ',') AS told, '' AS error FROM part""")
def inventory_records(spark, sf):
    k = F.col("p_partkey")
    names = F.when(k % 3 == 0, F.array(F.lit("GPSLatitude"), F.lit("Orientation"), F.lit("Artist"))).when(k % 3 == 1, F.array(F.lit("LensModel"), F.lit("ISO")))
    rows = t(spark, sf, "part").select(k.cast("string").alias("p"), F.md5("p_name").alias("d"), F.col("p_size").alias("n"), (F.col("p_size") * 2).alias("width"), (F.col("p_size") % 2 == 0).alias("has_alpha"), F.map_from_arrays(names, names).alias("tags"), F.lit(None).cast("string").alias("e"))
    out = RP.inventory_records(rows, "p", "d", "n", "tags", "e")
    return out.withColumn("told", F.array_join("sensitive_exif_keys", ",")).drop("sensitive_exif_keys")


@query("""SELECT o_orderkey AS input, o_custkey AS output, o_orderstatus IN ('O', 'P') AS ok, o_orderstatus = 'P' AS skipped, o_orderkey::BIGINT AS input_bytes, CASE WHEN o_orderstatus = 'O' THEN o_custkey ELSE 0 END::BIGINT AS output_bytes, '' AS error FROM orders""")
def prepared_records(spark, sf):
    s = F.col("o_orderstatus")
    rows = t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(s == "O", True).alias("good"), F.when(s == "P", True).alias("skip"), F.when(s == "O", F.col("o_custkey")).alias("out"), F.lit(None).cast("string").alias("e"))
    return RP.prepared_records(rows, "o_orderkey", "o_custkey", "good", "skip", "o_orderkey", "out", "e")


_SCHEMA = '{"type":"object","properties":{"args":{"type":"array","items":{"type":"string"}}},"additionalProperties":false}'


@query(f"""SELECT replace(replace(name, '.', '_'), '-', '_') AS name, '{_SCHEMA}' AS "inputSchema", read_only AS reads, destructive AS destroys, idempotent AS repeats
FROM (VALUES {", ".join(f"('{n}', {r}, {d}, {i})" for n, r, d, i in RP.COMMANDS)}) c(name, read_only, destructive, idempotent)""")
def tool_list(spark, sf):
    return RP.tool_list(spark).select("name", "inputSchema", F.col("annotations.readOnlyHint").alias("reads"), F.col("annotations.destructiveHint").alias("destroys"), F.col("annotations.idempotentHint").alias("repeats"))


_LADDER = """d AS (SELECT p_partkey AS k, p_size * 100 AS size, (p_partkey % 40) * 100 AS budget FROM part),
c AS (SELECT p_partkey AS k, CASE WHEN q = 0 THEN NULL ELSE q END AS q, CASE WHEN q = 0 THEN p_size * 90 ELSE p_size * q + CASE WHEN q = 50 THEN p_size * 60 ELSE 0 END END AS b FROM part, (SELECT unnest([0, 10, 20, 50, 80, 95, 99]) AS q))"""


@query(f"""WITH {_LADDER},
f AS (SELECT d.k, size, budget, min(b) FILTER (q IS NULL AND b <= budget) AS plain, min(b) FILTER (q IS NULL OR q BETWEEN 20 AND 95) AS least, count(*) FILTER (q IS NULL OR q BETWEEN 20 AND 95) AS tried, max(q) FILTER (q BETWEEN 20 AND 95 AND b <= budget) AS best, arg_max(b, q) FILTER (q BETWEEN 20 AND 95 AND b <= budget) AS took FROM d JOIN c ON d.k = c.k GROUP BY ALL)
SELECT k, CASE WHEN budget <= 0 THEN '' WHEN size <= budget THEN 'already_within_target' WHEN plain IS NOT NULL THEN 'lossless' WHEN best IS NOT NULL THEN 'image_quality_' || best ELSE '' END AS outcome,
CASE WHEN budget > 0 AND size > budget AND plain IS NULL THEN best END AS q, CASE WHEN budget <= 0 THEN NULL WHEN size <= budget THEN size WHEN plain IS NOT NULL THEN plain ELSE took END AS bytes,
CASE WHEN budget <= 0 THEN 'target_size_must_be_positive' WHEN size <= budget OR plain IS NOT NULL OR best IS NOT NULL THEN '' ELSE 'target_size_unreachable' END AS error,
CASE WHEN budget > 0 AND size > budget AND plain IS NULL AND best IS NULL THEN least END AS closest_size, CASE WHEN budget > 0 AND size > budget AND plain IS NULL AND best IS NULL THEN tried END AS attempts FROM f""")
def budget_ladder(spark, sf):
    part = t(spark, sf, "part")
    documents = part.select(F.col("p_partkey").alias("k"), (F.col("p_size") * 100).alias("size"), (F.col("p_partkey") % 40 * 100).cast("int").alias("budget"))
    q = F.col("q")
    rows = part.withColumn("q", F.explode(F.array(*(F.lit(x) for x in (0, 10, 20, 50, 80, 95, 99)))))
    size = F.when(q == 0, F.col("p_size") * 90).otherwise(F.col("p_size") * q + F.when(q == 50, F.col("p_size") * 60).otherwise(0))
    candidates = rows.select(F.col("p_partkey").alias("k"), F.nullif(q, F.lit(0)).alias("q"), size.alias("b"))
    return P.best_of_ladder(documents, candidates, "k", "size", "budget", "q", "b")


@query("SELECT l_orderkey, l_linenumber, l_shipmode = best AS recommended FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS l_shipmode, l_orderkey % 3 AS best FROM lineitem)")
def recommended_flags(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("name"), (F.col("l_orderkey") % 3).alias("winner"))
    return P.recommended_flags(rows, "l_orderkey", "name", "winner").select("l_orderkey", "l_linenumber", "recommended")


@query("SELECT max(p_size::BIGINT * p_size) FILTER (p_size % 4 > 0) AS pixels FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 64)")
def declared_pixels(spark, sf):
    side = F.when(F.col("p_size") % 4 > 0, F.col("p_size"))
    return P.declared_pixels(t(spark, sf, "part").select("p_partkey", side.alias("w"), F.col("p_size").alias("h")), "p_partkey", "w", "h")


@query("SELECT c_custkey AS n, c_mktsegment AS task, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS result, CASE WHEN c_custkey % 5 > 0 THEN '' ELSE 'result_missing' END AS missing FROM customer")
def positional_results(spark, sf):
    c = t(spark, sf, "customer").withColumnRenamed("c_custkey", "n")
    return P.zipped(c.select("n", F.col("c_mktsegment").alias("task")), c.where("n % 5 > 0").select("n", F.col("c_nationkey").alias("result")), "n")


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 OR p_size % 2 = 0 THEN 'links_changed' END, CASE WHEN p_partkey % 5 = 0 OR p_size % 3 = 0 THEN 'text_changed' END], lambda x: x IS NOT NULL), ',') AS warnings FROM part""")
def semantic_differences(spark, sf):
    part = t(spark, sf, "part")
    links = lambda extra: F.array(F.col("p_name"), extra)
    a = part.select("p_partkey", F.col("p_name").alias("text"), links(F.lit("x")).alias("links"))
    a = a.where("p_partkey % 10 <> 5")  # those and the rows below are on one side only
    b = part.where("p_partkey % 10 <> 0").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("text"), links(F.when(F.col("p_size") % 2 == 0, "y").otherwise("x")).alias("links"))
    return P.differing_semantics(a, b, "p_partkey", ["text", "links"]).select("p_partkey", F.array_join("warnings", ",").alias("warnings"))


#: A line of each kind, with an order's key: good ones, a note, no object, no JSON, no version, blank, too long, no UTF-8.
_LINES = """CASE o_orderkey % 9 WHEN 0 THEN '{"jsonrpc":"2.0","id":' || o_orderkey || ',"method":"tools/list"}' WHEN 1 THEN '{"jsonrpc":"2.0","method":"note","params":{"a":' || o_orderkey || '}}' WHEN 2 THEN '[' || o_orderkey || ']'
WHEN 3 THEN 'nonsense ' || o_orderkey WHEN 4 THEN '{"id":' || o_orderkey || ',"method":"x"}' WHEN 5 THEN ' ' WHEN 6 THEN '{"jsonrpc":"2.0","id":"z' || o_orderkey || '","method":"tools/call","params":{"name":"hash"}}'
WHEN 7 THEN '{"jsonrpc":"2.0","id":1,"method":"tools/list","x":"' || repeat('y', 200) || '"}' ELSE '' END"""


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN o_orderkey::VARCHAR WHEN 4 THEN o_orderkey::VARCHAR WHEN 6 THEN 'z' || o_orderkey END AS id, CASE o_orderkey % 9 WHEN 0 THEN 'tools/list' WHEN 1 THEN 'note' WHEN 6 THEN 'tools/call' END AS method,
CASE o_orderkey % 9 WHEN 1 THEN '{"a":' || o_orderkey || '}' WHEN 6 THEN '{"name":"hash"}' END AS params, CASE WHEN o_orderkey % 9 IN (3, 7, 8) THEN -32700 WHEN o_orderkey % 9 IN (2, 4) THEN -32600 END AS code FROM orders WHERE o_orderkey % 9 <> 5""")
def request_lines(spark, sf):
    line = F.expr(_LINES.replace("ELSE '' END", "ELSE 'x' END"))
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 9 == 8, F.unhex(F.lit("7BFF7D"))).otherwise(line.cast("binary")).alias("line"))
    return L.requests(rows, "line", 200).select("k", "id", "method", "params", "code")
