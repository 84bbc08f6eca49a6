"""Which rows become which outputs: selection, names, collisions, skips, budgets and summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Anchored Java regex of a shell glob; '*' crosses directories."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[:1] == '!' else body}]"
            i = end + 1
        else:
            out += re.sub(r"([^\w])", r"\\\1", c)
    return f"(?s)^{out}$"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")


def selected(path: Column, length: Column, include: list[str] = (), exclude: list[str] = (), least: int = 0, most: int = 0) -> Column:
    """Whether a file is selected: any include glob (if there are some), no exclude glob, on path or bare name; size bounds; unknown sizes are not."""
    hit = lambda globs: [F.coalesce(c.rlike(glob_regex(g)), F.lit(False)) for g in globs for c in (path, file_name(path))]
    out = F.lit(True)
    if include:
        out = hit(include)[0]
        for c in hit(include)[1:]:
            out = out | c
    for c in hit(exclude):
        out = out & ~c
    if least or most:
        out = out & F.coalesce(length >= least, F.lit(False))
    return out & (length <= most) if most else out


def first_occurrences(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Distinct keys in the order in which they first came."""
    return df.groupBy(key).agg(F.min(ordinal).alias(ordinal))


def partition_existing(tasks: DataFrame, existing: DataFrame, output: str, overwrite: bool = False) -> DataFrame:
    """``tasks`` with 'skipped' or 'pending', by whether their output exists."""
    if overwrite:
        return tasks.withColumn("state", F.lit("pending"))
    there = existing.select(F.col(output).alias("_o")).distinct().withColumn("_there", F.lit(True))
    return tasks.join(there, F.col(output) == F.col("_o"), "left").withColumn("state", F.when(F.col("_there"), "skipped").otherwise("pending")).drop("_o", "_there")


#: How file systems tell names apart, as collations of Spark; "posix" compares bytes.
EQUALITY = {"posix": None, "windows": "UTF8_LCASE", "macos": "UNICODE"}


def same_name(path: Column, system: str = "posix") -> Column:
    """A path whose comparisons, groups and joins follow a file system's equality of names.

    ``posix`` compares bytes, ``windows`` ignores case.  ``macos`` ignores how
    characters are composed, and case with full folding (so sharp s is ss).
    """
    if system not in EQUALITY:
        raise ValueError(f"unsupported_file_system:{system}")
    if system == "posix":
        return path
    folded = F.upper(path) if system == "macos" else path  # upper case folds fully, unlike lower case
    return F.collate(folded, EQUALITY[system])


def collisions(tasks: DataFrame, source: str, output: str, system: str = "posix") -> DataFrame:
    """Outputs that several sources would write: (output, first, second, n); under a file system's equality of names the smallest spelling stands for all."""
    keyed = tasks.select(F.col(source).alias("_s"), F.col(output).alias("_o"), same_name(F.col(output), system).alias("_key"))
    by = keyed.groupBy("_key").agg(F.min("_o").alias(output), F.min("_s").alias("first"), F.count_distinct("_s").alias("n")).where("n > 1")
    rest = keyed.select("_key", "_s").join(by.select("_key", "first"), "_key").where("_s > first").groupBy("_key").agg(F.min("_s").alias("second"))
    return by.join(rest, "_key").select(output, "first", "second", "n")


def aliases(tasks: DataFrame, source: str, output: str, system: str = "posix") -> DataFrame:
    """Outputs that are another task's source, under a file system's equality of names."""
    s = tasks.select(same_name(F.col(source), system).alias("other")).distinct()
    return tasks.join(s, same_name(F.col(output), system) == F.col("other")).where(same_name(F.col(source), system) != F.col("other")).select(source, output)


def below_root(path: Column, root: str, system: str = "posix") -> Column:
    """Whether a path is strictly below a root, part by part under a file system's equality of names."""
    parts = [p for p in root.split("/") if p]
    own = F.filter(F.split(path, "/"), lambda p: p != "")
    same = F.lit(True)
    for k, part in enumerate(parts):
        same &= same_name(F.get(own, F.lit(k)), system) == same_name(F.lit(part), system)
    return F.coalesce(same & (F.size(own) > len(parts)), F.lit(False))


def claimed(steps: DataFrame, existing: DataFrame, target: str, order: str) -> DataFrame:
    """State of each step: 'exists' (its target is there; it claims nothing), 'claimed' (an earlier step took it) or 'runs'."""
    marked = partition_existing(steps, existing, target)
    w = Window.partitionBy(target, "state").orderBy(order)
    n = F.row_number().over(w)
    return marked.withColumn("outcome", F.when(F.col("state") == "skipped", "exists").when(n > 1, "claimed").otherwise("runs")).drop("state")


def generated_inputs(files: DataFrame, path: str, suffix: str, root: str | None = None, excluded: list[str] = (), explicit: DataFrame | None = None, extension: str | None = None) -> DataFrame:
    """``files`` with ``verdict``: why a file is taken for an earlier output, or 'kept'.

    In this order: exactly excluded; named explicitly (kept); under the output
    root; a derivative whose original is beside it; of the target extension.
    """
    out = files.withColumns({"_p": parent(F.col(path)), "_s": stem(F.col(path))})
    originals = out.select(F.col("_p").alias("_op"), F.col("_s").alias("_os")).distinct().withColumn("_sibling", F.lit(True))
    of = F.when(F.col("_s").endswith(suffix) & (F.length("_s") > len(suffix)), F.expr(f"left(_s, length(_s) - {len(suffix)})"))
    out = out.withColumn("_of", of).join(originals, (F.col("_p") == F.col("_op")) & (F.col("_of") == F.col("_os")), "left")
    named = F.lit(False)
    if explicit is not None:
        out = out.join(explicit.select(F.col(path).alias("_e")).distinct().withColumn("_named", F.lit(True)), F.col(path) == F.col("_e"), "left").drop("_e")
        named = F.coalesce("_named", F.lit(False))
    verdict = F.when(F.col(path).isin(list(excluded)), "excluded").when(named, "kept")
    if root:
        verdict = verdict.when(F.startswith(F.col(path), F.lit(root.rstrip("/") + "/")), "output_root")
    verdict = verdict.when(F.col("_sibling"), "derivative")
    if extension:
        verdict = verdict.when(F.lower(F.col(path)).endswith(extension), "extension")
    return out.withColumn("verdict", verdict.otherwise("kept")).drop("_p", "_s", "_of", "_op", "_os", "_sibling", "_named")


def closest_root(files: DataFrame, path: str, roots: list[str]) -> DataFrame:
    """``files`` with the longest root that holds them, and the path below it."""
    held = [F.when((F.col(path) == r) | F.startswith(F.col(path), F.lit(r.rstrip("/") + "/")), F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("root"))) for r in roots]
    best = F.array_max(F.filter(F.array(*held), lambda x: x.isNotNull()))
    out = files.withColumn("_best", best).withColumn("root", F.col("_best.root"))
    return out.withColumn("relative", F.when(F.col("root").isNotNull(), F.expr(f"ltrim('/', substring({path}, _best.n + 1))"))).drop("_best")


def output_name(path: Column, suffix: str = "", prefix: str = "", extension: str | None = None) -> Column:
    """Name of a derived file: prefix, stem, suffix, and the target's extension or its own, lower-cased."""
    own = F.lower(F.regexp_extract(file_name(path), "(?<=.)(\\.[^.]*)$", 1))
    return F.concat(F.lit(prefix), stem(path), F.lit(suffix), F.lit(f".{extension}") if extension else own)


def output_path(path: Column, name: Column, root: str | None = None, relative: Column | None = None, flatten: bool = False) -> Column:
    if root is None:
        return F.concat(parent(path), F.lit("/"), name)
    if flatten or relative is None:
        return F.concat(F.lit(root), F.lit("/"), name)
    folder = parent(relative)
    return F.concat(F.lit(root), F.lit("/"), F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), name)


def numbered(df: DataFrame, name: str, order: str) -> DataFrame:
    """``df`` with a name that no other row has: in the order of ``order``, a row gets the first of name, name_1, name_2... not yet given.

    Only names that are equal but for numbers at their end (a, a_1, a_1_2)
    can take each other's.  Where there is one such name its rows are simply
    numbered; where there are several they are gone through in order, batch by
    batch (a task holds the names given so far of one such family).
    """
    base, ext = F.regexp_replace(F.col(name), "(?<=.)\\.[^.]*$", ""), F.regexp_extract(F.col(name), "(?<=.)(\\.[^.]*)$", 1)
    rows = df.withColumns({"_base": base, "_ext": ext, "_root": F.concat(F.regexp_replace(base, "(_[0-9]+)+$", ""), ext)})
    several = rows.groupBy("_root").agg(F.min(name).alias("_lo"), F.max(name).alias("_hi")).where("_lo <> _hi").select("_root")
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    plain = rows.join(several, "_root", "left_anti").withColumn("allocated", F.when(n == 0, F.col(name)).otherwise(F.concat("_base", F.lit("_"), n.cast("string"), "_ext")))
    mixed = rows.join(several, "_root", "left_semi").repartition("_root").sortWithinPartitions("_root", order)
    columns = [*df.columns, "allocated"]

    def give(batches):
        root, given, last = None, set(), {}
        for batch in batches:
            out = []
            for r, wanted, stem_, ext_ in zip(batch["_root"], batch[name], batch["_base"], batch["_ext"], strict=True):
                if r != root:
                    root, given, last = r, set(), {}
                got, k = wanted, last.get(wanted, 0)
                while got in given:
                    k += 1
                    got = f"{stem_}_{k}{ext_}"
                last[wanted] = k
                given.add(got)
                out.append(got)
            yield batch.assign(allocated=out)[columns]

    schema = f"{', '.join(f'`{c}` {kind}' for c, kind in df.dtypes)}, allocated string"
    return plain.select(*columns).union(mixed.mapInPandas(give, schema))


def batch_summary(results: DataFrame, by: list[str], ok: Column, size: Column, out: Column, skipped: Column | None = None, input_of_failures: bool = True) -> DataFrame:
    """Counts and bytes of a batch; outputs count where a row succeeded."""
    skipped = F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(False)
    done = ok & ~skipped
    return results.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(done).alias("success"), F.count_if(~ok & ~skipped).alias("failed"), F.count_if(skipped).alias("skipped"),
        F.sum(size if input_of_failures else F.when(done, size)).alias("input_bytes"), F.coalesce(F.sum(F.when(done, out)), F.lit(0)).alias("output_bytes"),
    )


def all_ok(results: DataFrame, error: str) -> DataFrame:
    """Whether no row has an error; an empty batch is fine."""
    return results.agg(F.coalesce(F.bool_and(F.coalesce(F.col(error), F.lit("")) == ""), F.lit(True)).alias("ok"))


def best_under_budget(candidates: DataFrame, key: str, quality: str, size: str, budget: Column) -> DataFrame:
    """The highest quality whose size fits; sizes need not grow with the quality, so all count.  Else the error with the least size."""
    fits = F.col(size) <= budget
    best = candidates.groupBy(key).agg(F.max(F.when(fits, F.struct(quality, size))).alias("m"), F.min(size).alias("least"), F.max(budget).alias("target"))
    error = F.when(F.col("m").isNull(), F.concat(F.lit("target_size_unreachable: minimum="), F.col("least").cast("string"), F.lit(" target="), F.col("target").cast("string"))).otherwise("")
    return best.select(key, F.col(f"m.{quality}").alias(quality), F.col(f"m.{size}").alias(size), error.alias("error"))


def preferred(estimates: DataFrame, key: str, name: str, size: str, preference: dict[str, list[str]], kind: str) -> DataFrame:
    """The first available format in the kind's order of preference, else the smallest."""
    rank = F.lit(None).cast("int")
    for k, names in preference.items():
        for i, f in enumerate(names):
            rank = F.when((F.col(kind) == k) & (F.col(name) == f), i).otherwise(rank)
    got = estimates.withColumn("_rank", rank).groupBy(key).agg(F.min(F.when(F.col("_rank").isNotNull(), F.struct("_rank", name))).alias("p"), F.min(F.struct(size, name)).alias("s"))
    return got.select(key, F.coalesce(F.col(f"p.{name}"), F.col(f"s.{name}")).alias("recommended"))


def upper_median(values: Column) -> Column:
    s = F.sort_array(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def montage_geometry(df: DataFrame, group: str, w: str, h: str, cols: int = 3, gap: int = 10, widest: int = 800, highest: int = 600) -> DataFrame:
    """Cell (upper median, bounded) and canvas of each group's grid.

    A group's sizes are counted per distinct size, so the median comes from a
    running count over sizes and not from a list of all rows.
    """

    def median(c: str, most: int) -> DataFrame:
        by = df.groupBy(group, c).agg(F.count("*").alias("_n"))
        over = Window.partitionBy(group).orderBy(c)
        run = by.withColumn("_upto", F.sum("_n").over(over)).withColumn("_all", F.sum("_n").over(Window.partitionBy(group)))
        return run.where("_upto > floor(_all / 2)").groupBy(group).agg(F.least(F.min(c), F.lit(most)).cast("int").alias(f"cell_{c}"), F.max("_all").cast("int").alias("items"))

    out = median(w, widest).join(median(h, highest).drop("items"), group)
    rows = F.ceil(F.col("items") / cols).cast("int")
    used = F.lit(cols)  # empty cells of a short row are there, too
    return out.select(group, "items", F.col(f"cell_{w}").alias("cell_width"), F.col(f"cell_{h}").alias("cell_height"), used.alias("cols"), rows.alias("rows"), (used * F.col(f"cell_{w}") + (used + 1) * gap).alias("canvas_width"), (rows * F.col(f"cell_{h}") + (rows + 1) * gap).alias("canvas_height"))


def concat_signature(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, signatures, uniform): whether all clips of a group have the same fields; nulls count as values."""
    same = df.groupBy(group).agg(F.count_distinct(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).alias("signatures"))
    return same.withColumn("uniform", F.col("signatures") == 1)


def concat_normal_form(df: DataFrame, group: str, w: str, h: str, fps: str, audio: str) -> DataFrame:
    """What clips are brought to before they are joined: greatest even size, greatest rate (30 if none), audio if any has it."""
    even = lambda c: F.greatest(F.lit(2), F.max(c) - F.max(c) % 2).cast("int")
    return df.groupBy(group).agg(even(F.col(w)).alias("width"), even(F.col(h)).alias("height"), F.coalesce(F.max(F.when(F.col(fps) > 0, F.col(fps))), F.lit(30.0)).alias("fps"), F.bool_or(audio).alias("has_audio"))


def ordered_concat(df: DataFrame, group: str, order: str, value: str, separator: str = "\n") -> DataFrame:
    """Each group's values joined in order."""
    return df.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), separator).alias("joined"), F.count("*").alias("parts"))


def best_of_ladder(documents: DataFrame, candidates: DataFrame, key: str, size: str, budget: str, quality: str, out: str, highest: int = 95, lowest: int = 20, dpi: int | None = None) -> DataFrame:
    """(key, outcome, quality, bytes, error, closest_size, attempts): a document that fits stays; else the lossless candidate (null quality) if it fits, else the highest quality that does.

    Sizes need not fall with the quality, so every candidate counts.  Where
    none fits, ``closest_size`` is the smallest one and ``attempts`` their
    number; both are null elsewhere.  A ``dpi`` outside 72 to 1200 is every
    row's error, after that of its budget.
    """
    fits = F.col(out) <= F.col(budget)
    tried = candidates.where(F.col(quality).isNull() | F.col(quality).between(lowest, highest)).join(documents.select(key, budget), key)
    got = tried.groupBy(key).agg(
        F.min(F.when(F.col(quality).isNull() & fits, F.col(out))).alias("_plain"), F.max(F.when(F.col(quality).isNotNull() & fits, F.struct(F.col(quality).alias("q"), F.col(out).alias("b")))).alias("_best"), F.min(out).alias("_least"), F.count("*").alias("_n"),
    )
    rows = documents.join(got, key, "left")
    bad = F.lit(dpi is not None and not 72 <= dpi <= 1200)
    stays = F.col(size) <= F.col(budget)
    outcome = F.when((F.col(budget) <= 0) | bad, "").when(stays, "already_within_target").when(F.col("_plain").isNotNull(), "lossless").when(F.col("_best").isNotNull(), F.concat(F.lit("image_quality_"), F.col("_best.q").cast("string"))).otherwise("")
    error = F.when(F.col(budget) <= 0, "target_size_must_be_positive").when(bad, "max_image_dpi_must_be_between_72_and_1200").when(outcome != "", "").otherwise("target_size_unreachable")
    took = F.when(outcome == "already_within_target", F.col(size)).when(outcome == "lossless", F.col("_plain")).when(outcome != "", F.col("_best.b"))
    return rows.select(key, outcome.alias("outcome"), F.when(F.startswith(outcome, F.lit("image")), F.col("_best.q")).alias(quality), took.alias("bytes"), error.alias("error"), *(F.when(error == "target_size_unreachable", F.col(c)).alias(n) for c, n in (("_least", "closest_size"), ("_n", "attempts"))))


def recommended_flags(estimates: DataFrame, key: str, name: str, winner: str) -> DataFrame:
    """``estimates`` with whether a row is its group's winner."""
    return estimates.withColumn("recommended", F.coalesce(F.col(name) == F.col(winner), F.lit(False)))


def declared_pixels(tasks: DataFrame, ordinal: str, w: str, h: str, sampled: int = 64) -> DataFrame:
    """(pixels): the most declared pixels among the first tasks; headers that couldn't be read (null) are passed over, null if all are."""
    first = tasks.orderBy(ordinal).limit(sampled)
    return first.agg(F.max(F.col(w).cast("long") * F.col(h)).alias("pixels"))


def zipped(tasks: DataFrame, results: DataFrame, ordinal: str) -> DataFrame:
    """Tasks with the results of the same position; a task without one has an error, results without a task are left out."""
    out = tasks.join(results.withColumn("_there", F.lit(True)), ordinal, "left")
    return out.withColumn("missing", F.when(F.col("_there").isNull(), "result_missing").otherwise("")).drop("_there")


def differing_semantics(source: DataFrame, candidate: DataFrame, key: str, aspects: list[str]) -> DataFrame:
    """(key, warnings): the sorted aspects in which two documents' snapshots differ; documents without a counterpart differ in all."""
    a = source.select(key, *(F.col(c).alias(f"_a_{c}") for c in aspects), F.lit(True).alias("_here"))
    b = candidate.select(key, *(F.col(c).alias(f"_b_{c}") for c in aspects), F.lit(True).alias("_there"))
    both = a.join(b, key, "full")
    alone = F.col("_here").isNull() | F.col("_there").isNull()
    changed = F.array(*(F.when(alone | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(f"{c}_changed")) for c in aspects))
    return both.select(key, F.array_sort(F.filter(changed, lambda c: c.isNotNull())).alias("warnings"))
