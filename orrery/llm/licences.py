"""Licence scan with DataFrame and SQL functions only.

Lines, sentences and windows of sentences (wrapped lines joined, without years,
names and comment marks) that speak of licences or copyright are compared with licence
templates by the cosine of sparse TF-IDF vectors (inverse document frequencies
over the templates).  A text that is named like a licence file, or half of whose
words are in what matched, is a licence file and covers its directory; files
without a licence of their own inherit that of the nearest ancestor directory
which has one, found by joining the directories' ancestors with the covered
directories.  Texts are read once: what is compared later is written down.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD, table, written

#: Licence names and the public notices they are recognised by.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
]
#: Headers and titles as files wrap them: compared with sentences and windows of sentences, after TEMPLATES.
HEADERS = [
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", "SPDX-License-Identifier: MIT"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("Apache-2.0", "Apache License Version 2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "GNU General Public License Version 3"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"), ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"), ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]
SPAN = 3  # sentences of a window at most
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.7  # cosine of a match
RESERVED = "Proprietary"  # rights are reserved beside any licence: it only counts where there is no other
#: Words that any text has (one of them in German); on their own they make no match.
PLAIN = set("a an and are as at be by for from in is it mit no of or that the this to was with".split())
EXPLAINED = 0.5  # share of a licence file's words that are in what matched
FILE_NAME = "(?i)^(un)?licen[cs]e([-_.][^/]*)?$|^copying([-_.][^/]*)?$|^copyright([-_.][^/]*)?$"


def _squares(templates: list[tuple[str, str]]) -> list[dict[str, float]]:
    """Squared weights of each template's terms, of unit length."""
    counts = [Counter(re.findall(TERM, body.lower())) for _, body in templates]
    held = Counter(t for c in counts for t in c)
    out = []
    for c in counts:
        w = {t: (n * (math.log((1 + len(templates)) / (1 + held[t])) + 1)) ** 2 for t, n in c.items()}
        whole = sum(w.values())
        out.append({t: x / whole for t, x in w.items()})
    return out


def key_terms() -> list[str]:
    """Terms of which a line or sentence must have one to be compared: all of the templates but plain words."""
    return sorted({t for _, body in TEMPLATES + HEADERS for t in re.findall(TERM, body.lower())} - PLAIN)


#: What is of interest: texts, lines and sentences with a key term.
TRIGGER = f"(?:^|[^a-z0-9])(?:{'|'.join(re.escape(t) for t in key_terms())})(?:[^a-z0-9]|$)"


def _low(col):
    return F.translate(col, UPPER, UPPER.lower())


def _sentences(text):
    """Sentences of a text: lines joined, without comment marks, years and holders."""
    plain = F.regexp_replace(text, "(?m)^[ \\t]*(?://+|/\\*+|\\*+/?|#+|;+|--+|%+|<!--|>+)[ \\t]*", "")
    plain = F.regexp_replace(plain, "(?m)(copyright)(?: *(?:\\(c\\)|©))?[ ,]*[0-9]{4}(?:[ ,-]+[0-9]{4})*[^.\\n]*?(?=\\.? *all rights reserved|\\.|$)", "$1")
    # a sentence ends before white space and no version number ("v. 2.0"), at blank lines and around SPDX lines
    plain = F.regexp_replace(plain, "(?m)^(.*spdx-license-identifier:.*)$", "\n\n$1\n\n")
    cut = F.filter(F.split(plain, "(?<=[.!?])(?<!\\bv\\.)\\s+|\\n[ \\t]*\\n\\s*"), lambda x: F.trim(x) != "")
    return F.transform(cut, lambda x: F.trim(F.regexp_replace(x, "\\s+", " ")))


def _windows(cut, at):
    """Distinct runs of 1 to SPAN sentences with one of those at the places ``at``; both are columns that are there."""
    run = lambda k, back: F.transform(F.filter(at, lambda i: (i >= back) & (i - back + k <= F.size(cut))), lambda i: F.array_join(F.slice(cut, i - back + 1, F.lit(k)), " "))
    return F.array_distinct(F.concat(*(run(k, back) for k in range(1, SPAN + 1) for back in range(k))))


def _matches(spark, units: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(_slot, no, score, tid, name) of units (_slot, no, line, known) and templates; known ones are compared with HEADERS only."""
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(templates))
    term = spark.sql(f"SELECT * FROM VALUES {values} AS t(tid, name, body)").withColumn("term", F.explode(F.regexp_extract_all(_low(F.col("body")), F.lit(TERM), F.lit(0))))
    n = len(templates)
    tf = term.groupBy("tid", "name", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))
    weights = tf.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weights.groupBy("tid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tn"))
    # a term's row: its frequency's weight and the templates that have it
    weights = weights.join(F.broadcast(norm), "tid").groupBy("term", "idf").agg(F.collect_list(F.struct("tid", "name", (F.col("w") / F.col("tn")).alias("tw"))).alias("held"))
    unseen = F.log(F.lit(1.0 + n)) + 1
    own_term = units.select("_slot", "no", "known", F.explode(F.regexp_extract_all("line", F.lit(TERM), F.lit(0))).alias("term")).groupBy("_slot", "no", "known", "term").agg(F.count("*").alias("tf"))
    # the templates' terms are a fixed list: this broadcast doesn't grow
    own_term = own_term.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    # a unit's squared length is summed beside its products, under no template
    whole = F.array(F.struct(F.lit(-1).alias("tid"), F.lit("").alias("name"), (F.col("w") * F.col("w")).alias("x")))
    least_tid = F.when(F.col("known"), len(TEMPLATES)).otherwise(0)
    products = F.transform(F.filter(F.coalesce("held", F.array().cast("array<struct<tid:int,name:string,tw:double>>")), lambda h: h["tid"] >= least_tid), lambda h: F.struct(h["tid"].alias("tid"), h["name"].alias("name"), (F.col("w") * h["tw"]).alias("x")))
    sums = own_term.select("_slot", "no", F.inline(F.concat(whole, products))).groupBy("_slot", "no", "tid", "name").agg(F.sum("x").alias("x"))
    best = sums.groupBy("_slot", "no").agg(F.max(F.when(F.col("tid") == -1, F.sqrt("x"))).alias("ln"), F.collect_list(F.when(F.col("tid") >= 0, F.struct("tid", "name", "x"))).alias("dots"))  # as many as templates
    scored = best.select("_slot", "no", "ln", F.inline("dots")).withColumn("score", F.round(F.col("x") / F.col("ln"), 6))
    return scored.where(F.col("score") >= least).select("_slot", "no", "score", "tid", "name")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = "path", least: float = LEAST) -> DataFrame:
    """(key, path, licence, score, inherited, effective) for every row of ``df``.

    licence and score (rounded to 6 places) are the text's own best match (ties
    to the earlier template), null below ``least``; that rights are reserved
    counts only where no licence matches, however well it does.  A line or
    sentence of plain words only is no match (templates can't reach ``least``
    by those, but for a few that are hardly more than a name); inherited is what the
    nearest covered ancestor directory has, null for files with a licence of
    their own; effective is one or the other.  Of several licence files in a
    directory one with a licence counts before one that reserves rights, then the
    best score, then the smaller key (null last).  Null
    and empty texts have no licence of their own; a null path inherits nothing.
    Repeated keys, and null ones, are rows of their own.
    """
    spark = df.sparkSession
    name = F.regexp_extract("_path", "([^/]*)$", 1)
    rows = df.select(F.monotonically_increasing_id().alias("_slot"), F.col(key).alias("_key"), F.col(path).alias("_path"), F.col(text).alias("_text"))
    low = rows.withColumn("_low", F.when(_low(F.col("_text")).rlike(TRIGGER), _low(F.col("_text"))))  # null: of no interest
    cut = low.withColumns({"_lines": F.filter(F.split("_low", "\n"), lambda x: x.rlike(TRIGGER)), "_cut": _sentences(F.col("_low"))})
    at = F.filter(F.transform("_cut", lambda x, i: F.when(x.rlike(TRIGGER), i)), lambda i: i.isNotNull())
    cut = cut.withColumns({"_at": at, "_words": F.when(F.col("_low").isNotNull(), F.regexp_count("_text", F.lit(WORD)))})
    windows = _windows(F.col("_cut"), F.col("_at"))
    # the only pass over the texts; slots are fixed by writing them
    base = written(cut.select("_slot", "_key", "_path", "_words", "_lines", windows.alias("_windows")))
    lines = base.select("_slot", F.posexplode("_lines").alias("no", "line")).withColumn("known", F.lit(False))
    trimmed = F.transform("_lines", lambda x: F.trim(F.regexp_replace(x, "\\s+", " ")))
    windows = base.where("size(_windows) > 0").select("_slot", trimmed.alias("lines"), F.posexplode("_windows").alias("no", "line")).select("_slot", "no", "line", F.array_contains("lines", F.col("line")).alias("known"))
    found = written(_matches(spark, lines, TEMPLATES, least).withColumn("kind", F.lit(0)).union(_matches(spark, windows, TEMPLATES + HEADERS, least).withColumn("kind", F.lit(1))))
    own = found.groupBy("_slot").agg(F.max(F.struct((F.col("name") != RESERVED).alias("r"), "score", (-F.col("tid")).alias("t"), "name")).alias("m")).select("_slot", F.col("m.name").alias("licence"), F.col("m.score").alias("score"))

    # words in what matched: of all lines, or of the longest window
    length = lambda c: F.regexp_count(c, F.lit(WORD))
    hits = found.groupBy("_slot").agg(F.collect_set(F.when(F.col("kind") == 0, F.col("no"))).alias("l"), F.collect_set(F.when(F.col("kind") == 1, F.col("no"))).alias("w"))
    counted = base.join(hits, "_slot")
    in_lines = F.aggregate("l", F.lit(0), lambda s, i: s + length(F.get("_lines", i)))
    in_window = F.aggregate("w", F.lit(0), lambda s, i: F.greatest(s, length(F.get("_windows", i))))
    folder = F.regexp_extract("_path", "^(.*)/[^/]*$", 1)
    files = counted.where(F.col("_path").isNotNull() & (name.rlike(FILE_NAME) | (F.greatest(in_lines, in_window) >= EXPLAINED * F.col("_words")))).select("_slot", "_key", folder.alias("folder")).join(own, "_slot")
    order = F.struct((F.col("licence") != RESERVED).alias("r"), "score", F.col("_key").isNotNull(), -F.col("_key"))
    covered = files.groupBy("folder").agg(F.max_by("licence", order).alias("given"))
    # one row a directory, not a file, looks for its ancestors
    folders = base.where("_path IS NOT NULL").select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    ancestors = folders.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("up", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = ancestors.join(covered.withColumnRenamed("folder", "up"), "up").groupBy("folder").agg(F.max_by("given", "depth").alias("given"))

    out = base.select("_slot", "_key", "_path", folder.alias("folder")).join(own, "_slot", "left").join(nearest, "folder", "left")
    inherited = F.when(F.col("licence").isNull(), F.col("given"))
    return out.select(F.col("_key").alias(key), F.col("_path").alias(path), "licence", "score", inherited.alias("inherited"), F.coalesce("licence", inherited).alias("effective"))


def document_path() -> F.Column:
    """Documents have no path: a folder a source, in it one a language, in it one per hundred ids; of ten ids one is right below its source, one below its language."""
    level = F.when(F.col("doc_id") % 10 == 0, F.col("source")).when(F.col("doc_id") % 10 == 1, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", "source", "lang", F.expr("CAST(doc_id DIV 100 AS STRING)")))
    return F.concat_ws("/", level, F.col("doc_id").cast("string"))


def op4_licences(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").withColumn("path", document_path()))


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LENGTH = "len(regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+'))"


def _cosines(kind: int, templates: list[tuple[str, str]]) -> str:
    """Common table expressions from u{kind} (doc_id, no, line, known) to m{kind} (doc_id, no, score, tid, name)."""
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(templates))
    n = 1 + len(templates)
    return f"""
    t{kind}(tid, name, body) AS (VALUES {values}),
    f{kind} AS (SELECT tid, name, term, count(*) tf FROM (SELECT tid, name, unnest(regexp_extract_all({_LOW.replace("text", "body")}, '{TERM}')) term FROM t{kind}) GROUP BY ALL),
    i{kind} AS (SELECT term, ln({n}.0 / (1 + count(*))) + 1 idf FROM f{kind} GROUP BY term),
    w{kind} AS (SELECT tid, name, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY tid)) tw FROM f{kind} JOIN i{kind} USING (term)),
    o{kind} AS (SELECT doc_id, no, known, term, tf * coalesce(idf, ln({n}.0) + 1) w FROM (
      SELECT doc_id, no, known, term, count(*) tf FROM (SELECT doc_id, no, known, unnest(regexp_extract_all(line, '{TERM}')) term FROM u{kind}) GROUP BY ALL) LEFT JOIN i{kind} USING (term)),
    n{kind} AS (SELECT doc_id, no, sqrt(sum(w * w)) ln FROM o{kind} GROUP BY ALL),
    m{kind} AS (SELECT doc_id, no, round(dot / ln, 6) score, tid, name FROM (
      SELECT doc_id, no, tid, name, sum(w * tw) dot FROM o{kind} JOIN w{kind} USING (term) WHERE NOT known OR tid >= {len(TEMPLATES)} GROUP BY ALL) JOIN n{kind} USING (doc_id, no) WHERE round(dot / ln, 6) >= {LEAST}),"""


def _oracle() -> str:
    sep = "chr(1)"
    plain = f"regexp_replace(low, '(?m)^[ \\t]*(?://+|/\\*+|\\*+/?|#+|;+|--+|%+|<!--|>+)[ \\t]*', '', 'g')"
    plain = f"regexp_replace({plain}, '(?m)(copyright)(?: *(?:\\(c\\)|©))?[ ,]*[0-9]{{4}}(?:[ ,-]+[0-9]{{4}})*[^.\\n]*?(\\.? *all rights reserved|\\.|$)', '\\1\\2', 'g')"
    plain = f"regexp_replace({plain}, '(?m)^(.*spdx-license-identifier:.*)$', chr(10) || chr(10) || '\\1' || chr(10) || chr(10), 'g')"
    cut = f"regexp_replace(regexp_replace(regexp_replace({plain}, '([.!?])\\s+', '\\1' || {sep}, 'g'), '\\bv\\.' || {sep}, 'v. ', 'g'), '\\n[ \\t]*\\n\\s*', {sep}, 'g')"
    spaces = "trim(regexp_replace(x, '\\s+', ' ', 'g'))"
    return f"""
    WITH e AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN source WHEN doc_id % 10 = 1 THEN concat_ws('/', source, lang) ELSE concat_ws('/', source, lang, (doc_id // 100)::VARCHAR) END folder FROM documents),
    d AS (SELECT doc_id, text, folder, concat_ws('/', folder, doc_id::VARCHAR) path FROM e),
    b AS (SELECT doc_id, {_LOW} low FROM documents WHERE regexp_matches({_LOW}, '{TRIGGER}')),
    l AS (SELECT doc_id, list_filter(string_split(low, chr(10)), lambda x: regexp_matches(x, '{TRIGGER}')) lines,
      list_transform(list_filter(string_split({cut}, {sep}), lambda x: trim(x) <> ''), lambda x: {spaces}) cut FROM b),
    p AS (SELECT *, list_filter(generate_series(1, len(cut)), lambda i: regexp_matches(cut[i], '{TRIGGER}')) hits FROM l),
    r AS (SELECT doc_id, lines, list_distinct(flatten(list_transform(hits, lambda i: flatten(list_transform(generate_series(1, {SPAN}), lambda k:
      list_transform(list_filter(generate_series(0, k - 1), lambda y: i - y >= 1 AND i - y + k - 1 <= len(cut)), lambda y: array_to_string(cut[i - y : i - y + k - 1], ' '))))))) runs FROM p),
    u0 AS (SELECT doc_id, unnest(lines) line, generate_subscripts(lines, 1) no, false known FROM l),
    u1 AS (SELECT doc_id, line, no, list_contains(list_transform(lines, lambda x: {spaces}), line) known FROM (SELECT doc_id, lines, unnest(runs) line, generate_subscripts(runs, 1) no FROM r)),
    {_cosines(0, TEMPLATES)}
    {_cosines(1, TEMPLATES + HEADERS)}
    own AS (SELECT doc_id, name licence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY name = '{RESERVED}', score DESC, tid) k FROM (SELECT doc_id, score, tid, name FROM m0 UNION ALL SELECT doc_id, score, tid, name FROM m1)) WHERE k = 1),
    x AS (SELECT doc_id, max(words) words FROM (
      SELECT doc_id, sum({_LENGTH.format("line")}) words FROM u0 SEMI JOIN m0 USING (doc_id, no) GROUP BY doc_id UNION ALL SELECT doc_id, max({_LENGTH.format("line")}) FROM u1 SEMI JOIN m1 USING (doc_id, no) GROUP BY doc_id) GROUP BY doc_id),
    c AS (SELECT folder, licence given FROM (
            SELECT folder, licence, row_number() OVER (PARTITION BY folder ORDER BY licence = '{RESERVED}', score DESC, doc_id) k
            FROM d JOIN own USING (doc_id) JOIN x USING (doc_id) WHERE words >= {EXPLAINED} * {_LENGTH.format("text")}) WHERE k = 1),
    n AS (SELECT DISTINCT ON (doc_id) doc_id, given FROM d JOIN c ON d.folder = c.folder OR starts_with(d.folder, c.folder || '/') ORDER BY doc_id, length(c.folder) DESC)
    SELECT doc_id, path, licence, score, CASE WHEN licence IS NULL THEN given END inherited, coalesce(licence, given) effective
    FROM d LEFT JOIN own USING (doc_id) LEFT JOIN n USING (doc_id)"""


ORACLE_SQL = {"op4_licences": _oracle()}
