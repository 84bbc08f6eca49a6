"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic).  Raking scales
the cells' token weights until their marginals meet targets in all three
dimensions, to a tolerance; where the cells can't meet them, it stops when the
error no longer falls and warns of the error reached.  A document's sampling probability is its cell's weight over the
cell's tokens, times a factor that makes the expected sample the budget, at
most 1.  Targets are given for a dimension, or follow its tokens to a power.
Only cells are raked, on the driver while they are few (their number
is checked) and as DataFrames beyond.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, dropped, table, written

ORACLE_ROUNDS = 300  # of the fixture's oracle, which can't loop until convergence
TOLERANCE = 1e-13  # largest relative error of a margin
REPORTED = 1e-9  # an error that is worth a warning
STALL = 100  # rounds in which the error has to fall by a thousandth
SALTS = 16  # copies of a cell that its documents are dealt to, beyond LOCAL_CELLS
LOCAL_CELLS = 100_000  # cells raked on the driver and sent to all executors
TEMPERATURE = 0.5  # a target is proportional to a margin's tokens to this power
BUDGET = 0.5  # expected sample, as a share of all tokens


def given_targets(values: list, mass: np.ndarray, wanted: dict) -> np.ndarray:
    """Targets of the values that are there, by their wanted shares; those not wanted get 0."""
    shares = np.array([float(wanted.get(v, 0.0)) for v in values])
    if not np.isfinite(shares).all() or (shares < 0).any():
        raise ValueError("a target share is negative or not finite")
    present = shares * (mass > 0)
    if len(mass) and not present.sum():
        raise ValueError("no value with tokens has a target share above 0")
    if abs(present.sum() - sum(map(float, wanted.values()))) > 1e-9:
        warnings.warn("target shares of values without tokens are spread over the others", RuntimeWarning, stacklevel=3)
    return present / present.sum() * mass.sum() if len(mass) else present


def _targets(mass: np.ndarray, codes: np.ndarray, temperature: float) -> np.ndarray:
    margin = np.bincount(codes, mass)
    t = np.where(margin > 0, np.maximum(margin, 1e-300) ** temperature, 0.0)
    return t / t.sum() * mass.sum() if t.sum() else t


class Progress:
    """Tells when to stop: after ``rounds``, or without them at TOLERANCE or when the error no longer falls."""

    def __init__(self, rounds: int | None):
        self.rounds, self.errors = rounds, []

    def done(self, error: float) -> bool:
        """``error`` is that before the next round."""
        if self.rounds is not None:
            self.errors.append(error)
            return len(self.errors) > self.rounds
        self.errors.append(min([error, *self.errors[-1:]]))  # the least so far
        return error <= TOLERANCE or (len(self.errors) > STALL and self.errors[-1] > 0.999 * self.errors[-1 - STALL])


def margin_error(w: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> float:
    """The largest relative error of a margin; those with target 0 have no weight."""
    found = [np.abs(np.bincount(c, w, len(t))[t > 0] / t[t > 0] - 1) for c, t in zip(codes, targets, strict=True)]
    return max((float(x.max()) for x in found if len(x)), default=0.0)


def _warn(error: float, rounds: int | None) -> None:
    if rounds is None and error > REPORTED:
        warnings.warn(f"raking can't meet its targets: a margin is off by {error:.3g} of its target", RuntimeWarning, stacklevel=3)


def rake(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int | None = None) -> np.ndarray:
    """Cell weights whose marginals meet ``targets``, starting from ``mass``; a warning tells the error if they can't.

    ``rounds`` asks for so many rounds instead.
    """
    w = mass.astype(float)
    progress = Progress(rounds)
    while not progress.done(error := margin_error(w, codes, targets)):
        for c, t in zip(codes, targets, strict=True):
            margin = np.bincount(c, w, len(t))
            w = w * np.divide(t, margin, out=np.zeros(len(t)), where=margin > 0)[c]
    _warn(error, rounds)
    return w


def probabilities(mass: np.ndarray, w: np.ndarray, budget: float) -> np.ndarray:
    """min(1, factor * weight / tokens) a cell, the factor meeting ``budget`` tokens."""
    ratio = np.divide(w, mass, out=np.zeros(len(w)), where=mass > 0)
    factor = budget / w.sum() if w.sum() else 0.0
    while True:  # each step fills at least one more cell, or is the last
        full = factor * ratio >= 1
        rest = w[~full].sum()
        more = (budget - mass[full].sum()) / rest if rest > 0 else factor
        if more <= factor * (1 + 1e-15):
            return np.minimum(1.0, factor * ratio)
        factor = more


def _rake_frames(cells: DataFrame, dims: list[str], temperature: float, share: float, rounds: int | None, wanted: dict) -> DataFrame:
    """The same on DataFrames, for more cells than the driver should hold."""
    cells = written(cells.withColumn("w", F.col("mass").cast("double")))
    total = cells.agg(F.sum("mass")).first()[0] or 0

    def match(a: DataFrame, b: DataFrame, d: str) -> DataFrame:
        return a.join(b.withColumnRenamed(d, "_d"), F.col(d).eqNullSafe(F.col("_d"))).drop("_d")

    targets = []
    for d in dims:
        if d in wanted:  # as many rows as the caller gave
            given = cells.sparkSession.createDataFrame([(v, float(s)) for v, s in wanted[d].items()], f"`_d` {dict(cells.dtypes)[d]}, s double")
            t = cells.groupBy(d).agg(F.sum("mass").alias("m")).join(F.broadcast(given), F.col(d).eqNullSafe(F.col("_d")), "left")
            t = t.select(d, F.when(F.col("m") > 0, F.coalesce("s", F.lit(0.0))).otherwise(0.0).alias("t"))
            if total and not t.agg(F.sum("t")).first()[0]:
                raise ValueError("no value with tokens has a target share above 0")
        else:
            t = cells.groupBy(d).agg(F.when(F.sum("mass") > 0, F.pow(F.sum("mass"), temperature)).otherwise(0.0).alias("t"))
        whole = t.agg(F.sum("t")).first()[0] or 1.0
        targets.append(written(t.withColumn("t", F.col("t") / whole * total)))

    def error() -> float:
        off = 0.0
        for d, t in zip(dims, targets, strict=True):
            margins = match(cells.groupBy(d).agg(F.sum("w").alias("m")), t, d).where("t > 0")
            off = max(off, margins.agg(F.max(F.abs(F.col("m") / F.col("t") - 1))).first()[0] or 0.0)
        return off

    progress = Progress(rounds)
    while not progress.done(off := error() if rounds is None else 0.0):
        for d, t in zip(dims, targets, strict=True):
            margins = match(cells.groupBy(d).agg(F.sum("w").alias("m")), t, d)
            nxt = written(match(cells, margins.select(d, (F.expr("try_divide(t, m)")).alias("s")), d).withColumn("w", F.col("w") * F.coalesce("s", F.lit(0.0))).drop("s"))
            dropped(cells)
            cells = nxt
    _warn(off, rounds)
    cells = cells.withColumn("ratio", F.coalesce(F.expr("try_divide(w, mass)"), F.lit(0.0)))
    weight = cells.agg(F.sum("w")).first()[0] or 0.0
    factor = share * total / weight if weight else 0.0
    while True:
        full = F.lit(factor) * F.col("ratio") >= 1
        rest, held = cells.agg(F.sum(F.when(~full, F.col("w"))), F.sum(F.when(full, F.col("mass")))).first()
        more = (share * total - (held or 0)) / rest if rest else factor
        if more <= factor * (1 + 1e-15):
            break
        factor = more
    return cells.withColumn("prob", F.least(F.lit(1.0), F.lit(factor) * F.col("ratio"))).select(*dims, "mass", "w", "prob")


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text, words) -> F.Column:
    """A stand-in for a topic: the kind of text, by its size and form."""
    return F.when(F.coalesce(F.contains(text, F.lit("|")), F.lit(False)), "table").when(words < 50, "brief").when(words < 500, "article").otherwise("long")


def uniform(key, seed: str = "") -> F.Column:
    """A number in [0, 1) fixed by the key."""
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def mix(
    df: DataFrame, key: str = "doc_id", tokens: str = "n_tokens", dims: tuple[str, ...] = ("source", "lang", "topic"), budget: float = BUDGET, temperature: float = TEMPERATURE, rounds: int | None = None,
    targets: dict[str, dict] | None = None,
) -> DataFrame:
    """All rows and columns of ``df`` plus ``weight``, ``prob`` and ``selected``.

    weight is the raked weight a token of the row's cell; selected holds with
    probability prob, decided by a hash of the key, so repeated rows fare
    alike.  Raking goes on until it converges, or for ``rounds``.  A null in a dimension is a value of its own; null tokens count as
    0; cells without tokens get probability 0.  Existing columns of those
    names are replaced.

    ``targets`` gives, for any of the dimensions, each value's share of the
    sample's tokens (a null value's under None); shares are scaled to 1 over
    the values that have tokens, values that aren't listed get none.  The
    other dimensions' targets are their tokens to the power ``temperature``.
    Targets that contradict each other are met as well as raking can, with a
    warning; shares that are negative, or 0 for all that is there, raise.
    """
    dims, wanted = list(dims), dict(targets or {})
    if unknown := set(wanted) - set(dims):
        raise ValueError(f"targets for columns that aren't raked: {sorted(unknown)}")
    df = df.drop("weight", "prob", "selected")
    cells = written(df.groupBy(*dims).agg(F.sum(F.coalesce(F.col(tokens), F.lit(0))).cast("long").alias("mass")))
    if cells.count() <= LOCAL_CELLS:
        held = cells.orderBy(*dims).toPandas()
        mass = held["mass"].to_numpy(float)
        coded = [held[d].factorize(use_na_sentinel=False) for d in dims]
        codes, goals = [c for c, _ in coded], []
        for d, (c, values) in zip(dims, coded, strict=True):
            plain = [None if v is None or v != v else v for v in values]
            goals.append(given_targets(plain, np.bincount(c, mass, len(plain)), wanted[d]) if d in wanted else _targets(mass, c, temperature))
        w = rake(mass, codes, goals, rounds)
        held["w"], held["prob"] = w, probabilities(mass, w, budget * mass.sum())
        kinds = dict(df.dtypes)
        rows = [tuple(None if x is None or x != x else x for x in r) for r in held[[*dims, "mass", "w", "prob"]].itertuples(index=False)]
        schema = ", ".join([*(f"`{d}` {kinds[d]}" for d in dims), "mass long, w double, prob double"])
        made = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # at most LOCAL_CELLS rows
    else:
        made = _rake_frames(cells, dims, temperature, budget, rounds, wanted)
        # a large cell's documents don't meet in one task
        made = made.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = df.withColumn("_deal", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    salted = "_salt" in made.columns
    made = made.select(*(F.col(d).alias(f"_{d}") for d in dims), F.coalesce(F.expr("try_divide(w, mass)"), F.lit(0.0)).alias("weight"), "prob", *(["_salt"] if salted else []))
    on = reduce(lambda a, b: a & b, (F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dims))
    if salted:
        on &= F.col("_deal") == F.col("_salt")
    return df.join(made, on).drop(*(f"_{d}" for d in dims), "_deal", "_salt").withColumn("selected", uniform(key) < F.col("prob"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and topic."""
    out = docs.withColumn("n_tokens", n_words(F.col(text)))
    return out.withColumn("topic", topic_of(F.col(text), F.col("n_tokens")))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = measured(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens")
    out = mix(docs)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("prob", 9).alias("prob"), "selected")


def _oracle() -> str:
    dims = ("source", "lang", "topic")
    out = [
        """d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(coalesce(text, ''), '|') THEN 'table' WHEN n_tokens < 50 THEN 'brief' WHEN n_tokens < 500 THEN 'article' ELSE 'long' END topic
        FROM (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT n_tokens FROM documents))""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE mass, sum(n_tokens)::DOUBLE w FROM d GROUP BY ALL)",
    ]
    for x in dims:
        out.append(f"t_{x} AS MATERIALIZED (SELECT {x}, pow(sum(mass), {TEMPERATURE}) / sum(pow(sum(mass), {TEMPERATURE})) OVER () * (SELECT sum(mass) FROM w0) t FROM w0 GROUP BY {x})")
    step = "SELECT i, source, lang, topic, mass, w FROM w WHERE i < {n}".format(n=ORACLE_ROUNDS)
    for x in dims:
        step = f"SELECT i, a.source, a.lang, a.topic, mass, coalesce(w * t / nullif(sum(w) OVER (PARTITION BY a.{x}), 0), 0) w FROM ({step}) a JOIN t_{x} t ON a.{x} IS NOT DISTINCT FROM t.{x}"
    out.append(f"w AS (SELECT 0 i, source, lang, topic, mass, w FROM w0 UNION ALL SELECT i + 1, source, lang, topic, mass, w FROM ({step}))")
    out.append(f"r AS MATERIALIZED (SELECT source, lang, topic, mass, w, coalesce(w / nullif(mass, 0), 0) ratio, {BUDGET} * (SELECT sum(mass) FROM w0) budget FROM w WHERE i = {ORACLE_ROUNDS})")
    out.append("""f AS (SELECT 0 i, max(budget) / sum(w) f FROM r UNION ALL
      SELECT i + 1, greatest(max(f), coalesce((max(budget) - coalesce(sum(mass) FILTER (f * ratio >= 1), 0)) / sum(w) FILTER (f * ratio < 1), 0)) FROM r, f WHERE i < 64 GROUP BY i)""")
    out.append("g AS MATERIALIZED (SELECT f FROM f WHERE i = 64)")
    return f"""WITH RECURSIVE {", ".join(out)}
    SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(ratio, 9) weight, round(least(1.0, f * ratio), 9) prob,
      ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < least(1.0, f * ratio) selected
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic, g"""


ORACLE_SQL = {"op3_mixing": _oracle()}
