"""Named queries over files: trees written from the tables, scanned, published, compared; added to ``queries.QUERIES`` when imported there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import files as FO
from .operators.tables import shared_dir, written
from .queries import query, t
from .sources import published, tree

#: A page's file: five folders, one of them deeper, and suffixes of which two are pictures'.
_NAME = "'site' || page_id % 5 || CASE WHEN page_id % 5 = 3 THEN '/deep/er' ELSE '' END || '/p' || page_id || ['.html', '.jpg', '.PNG', '.txt', ''][page_id % 7 % 5 + 1]"


def _page_path():
    k = F.col("page_id")
    suffix = F.element_at(F.array(*(F.lit(s) for s in (".html", ".jpg", ".PNG", ".txt", ""))), (k % 7 % 5 + 1).cast("int"))
    return F.concat(F.lit("site"), (k % 5).cast("string"), F.when(k % 5 == 3, "/deep/er").otherwise(""), F.lit("/p"), k.cast("string"), suffix)


def _page_tree(spark, sf) -> str:
    return published.written_tree(spark, t(spark, sf, "pages"), _page_path(), F.col("html"))


@query(f"""WITH f AS (SELECT {_NAME} AS path, strlen(html)::BIGINT AS length FROM pages WHERE strlen(html) > 0)
SELECT path, CASE WHEN path LIKE '%.jpg' THEN '.jpg' ELSE '.png' END AS suffix, length, false AS link FROM f WHERE (path LIKE '%.jpg' OR path LIKE '%.PNG') AND path NOT LIKE '%/deep/%' AND length BETWEEN 1000 AND 20000""")
def scan_tree(spark, sf):
    root = _page_tree(spark, sf)
    found = tree.pictures(spark, [root], recursive=True, exclude=["*/deep/*"], least=1000, most=20000)
    return found.select(FO.below(F.col("path"), root).alias("path"), "suffix", "length", "link")


@query(f"""WITH f AS (SELECT {_NAME} AS path FROM pages WHERE strlen(html) > 0),
g AS (SELECT path, CASE WHEN path LIKE 'site4/%' THEN 0 ELSE 1 END AS argument, string_split(path, '/') AS parts FROM f WHERE path LIKE '%.jpg' OR path LIKE '%.PNG')
SELECT path, row_number() OVER (ORDER BY argument, parts) - 1 AS position FROM g""")
def scan_in_order(spark, sf):
    root = _page_tree(spark, sf)
    found = tree.page_pictures(spark, [f"{root}/site4", root], recursive=True)
    return found.select(FO.below(F.col("path"), root).alias("path"), "position")


@query(f"SELECT {_NAME} AS path, sha256(html) AS digest, strlen(html)::BIGINT AS length FROM pages WHERE strlen(html) > 0")
def hash_tree(spark, sf):
    root = _page_tree(spark, sf)
    return FO.file_digests(tree.distinct_files(tree.files(spark, [root], recursive=True))).select(FO.below(F.col("path"), root).alias("path"), "digest", "length")


_TARGET = "CASE page_id % 6 WHEN 0 THEN 'same' || page_id % 4 WHEN 1 THEN 'out/../p' || page_id WHEN 2 THEN NULL ELSE 'out/p' || page_id END"


@query(f"""WITH r AS (SELECT {_TARGET} AS path, html, page_id FROM pages),
e AS (SELECT path, CASE WHEN path IS NULL OR path LIKE '%..%' THEN 'unsafe_path' WHEN page_id % 5 = 0 THEN 'missing_content' WHEN html = '' THEN 'empty_output' WHEN row_number() OVER (PARTITION BY path, page_id % 5 = 0 OR html = '') > 1 THEN 'output_exists' ELSE '' END AS error FROM r)
SELECT path, CASE WHEN error = '' THEN 'published' ELSE '' END AS outcome, error, count(*) AS n FROM e GROUP BY ALL""")
def publish_report(spark, sf):
    k = F.col("page_id")
    root = f"{published.local_folder(shared_dir(spark))}/out-{uuid.uuid4().hex}"
    name = lambda s: F.concat(F.lit(f"{root}/{s}"), k.cast("string"))
    path = F.when(k % 6 == 0, F.concat(F.lit(f"{root}/same"), (k % 4).cast("string"))).when(k % 6 == 1, name("out/../p")).when(k % 6 == 2, F.lit(None)).otherwise(name("out/p"))
    rows = t(spark, sf, "pages").select(path.alias("path"), F.when(k % 5 != 0, F.col("html")).alias("content"))
    out = published.publish(rows, root)
    return out.groupBy(FO.below(F.col("path"), root).alias("path"), "outcome", "error").agg(F.count("*").alias("n"))


#: Documents as files, of which every 40th has a second name that is no copy.
_DOCUMENT = "'d' || doc_id % 3 || '/' || doc_id || '.png'"


def _document_tree(spark, sf) -> str:
    k = F.col("doc_id").cast("string")
    return published.written_tree(spark, t(spark, sf, "documents"), F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string"), F.lit("/"), k, F.lit(".png")), F.col("text"))


_COPIES = f"""f AS (SELECT {_DOCUMENT} AS path, text FROM documents WHERE strlen(text) > 0), k AS (SELECT *, min(path) OVER (PARTITION BY text) AS keep FROM f)"""


@query(f"WITH {_COPIES} SELECT keep, path AS duplicate, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM k WHERE path <> keep")
def duplicate_files(spark, sf):
    root = _document_tree(spark, sf)
    out = FO.duplicate_files(tree.duplicates_of(spark, [root], recursive=True))
    return out.select(FO.below(F.col("keep"), root).alias("keep"), FO.below(F.col("duplicate"), root).alias("duplicate"), "sha256", "size")


@query(f"""WITH {_COPIES} SELECT path, CASE WHEN path = keep THEN '' ELSE 'moved' END AS outcome FROM k""")
def remove_copies(spark, sf):
    root = _document_tree(spark, sf)
    before = written(tree.distinct_files(tree.files(spark, [root], recursive=True)).select("path"))
    done = FO.remove_copies(spark, [root], recursive=True, backup=root + "-backup")
    after = tree.distinct_files(tree.files(spark, [root], recursive=True)).select("path", F.lit(True).alias("there"))
    out = before.join(done.withColumnRenamed("duplicate", "path"), "path", "left").join(after, "path", "left")
    outcome = F.when(F.col("there") & F.col("outcome").isNull(), "").when(F.col("there").isNull() & (F.col("error") == ""), F.col("outcome")).otherwise(F.concat(F.lit("wrong: "), F.coalesce("error", F.lit(""))))
    return out.select(FO.below(F.col("path"), root).alias("path"), outcome.alias("outcome"))


#: Names that some file systems tell apart: composed and decomposed, sharp s and ss, upper and lower case; of every tenth customer a name of its own.
_SPELLED = "CASE c_custkey % 10 WHEN 0 THEN 'Caf' || chr(233) WHEN 1 THEN 'Cafe' || chr(769) WHEN 2 THEN 'CAF' || chr(201) WHEN 3 THEN 'stra' || chr(223) || 'e' WHEN 4 THEN 'STRASSE' WHEN 5 THEN 'plain' WHEN 6 THEN 'Plain' WHEN 7 THEN 'cafe' ELSE 'own' || c_custkey END || '-' || c_custkey // 40 || '.webp'"


@query(f"""WITH n AS (SELECT c_custkey AS k, {_SPELLED} AS o FROM customer), f AS (SELECT k, o, replace(lower(nfc_normalize(o)), chr(223), 'ss') AS mac, lower(o) AS win FROM n),
g AS (SELECT 'macos' AS system, min(o) AS o, list_sort(list(k)) AS ks FROM f GROUP BY mac UNION ALL SELECT 'windows', min(o), list_sort(list(k)) FROM f GROUP BY win UNION ALL SELECT 'posix', o, list_sort(list(k)) FROM f GROUP BY o)
SELECT system, hex(encode(o)) AS o, ks[1] AS first, ks[2] AS second, len(ks) AS n FROM g WHERE len(ks) > 1""")
def name_collisions(spark, sf):
    from .operators import planning as P

    k = F.col("c_custkey")
    bits = ["Caf\u00e9", "Cafe\u0301", "CAF\u00c9", "stra\u00dfe", "STRASSE", "plain", "Plain", "cafe"]
    name = F.coalesce(F.get(F.array(*(F.lit(b) for b in bits)), (k % 10).cast("int")), F.concat(F.lit("own"), k.cast("string")))
    tasks = t(spark, sf, "customer").select(k.alias("k"), F.concat(name, F.lit("-"), F.expr("CAST(c_custkey DIV 40 AS STRING)"), F.lit(".webp")).alias("o"))
    out = [P.collisions(tasks, "k", "o", s).select(F.lit(s).alias("system"), F.hex(F.encode("o", "UTF-8")).alias("o"), "first", "second", "n") for s in ("macos", "windows", "posix")]
    return out[0].union(out[1]).union(out[2])


@query("SELECT min(doc_id) OVER (PARTITION BY text) AS keep, doc_id AS duplicate, strlen(text)::BIGINT AS size FROM documents WHERE text IS NOT NULL QUALIFY doc_id > min(doc_id) OVER (PARTITION BY text)")
def stream_duplicates(spark, sf):
    """Documents arrive in three batches of ascending ids, each taken in by a run of its own."""
    from .streaming import duplicates as SD

    SD.use_state_store(spark)
    folder = f"{shared_dir(spark)}/orrery-stream-{uuid.uuid4().hex}"
    docs = t(spark, sf, "documents").select("doc_id", "text")
    (most,) = docs.agg(F.max("doc_id")).first()
    part = F.expr(f"3 * doc_id DIV {(most or 0) + 1}")
    for k in range(3):
        docs.where(part == k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{folder}/in")
        SD.run_batches(SD.duplicates(stream, "doc_id", "text"), f"{folder}/out", f"{folder}/state")
    return spark.read.schema("keep long, duplicate long, size long").parquet(f"{folder}/out")
