"""k-means on integer vectors with Elkan's bounds.

Each vector keeps an upper bound of the distance to its own centroid and a
lower bound to every other one.  A centroid is left out if its lower bound, or
half its distance to the own centroid, is above the upper bound.  Bounds are
kept in float32 and rounded away from the truth, and only a strict "above"
leaves out, so that a centroid as near as the own one is always looked at and
ties fall to the smaller number.  Where a distance is needed it is computed in
integers; so are sums, centroids and final distances.

The state of a round is a table of vectors with their bounds; each task adds
its vectors up by cluster on the way, so a round moves as many rows as there
are tasks times clusters, and the driver only holds the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, release, table, written

K, ROUNDS, SCALE, SIZE = 40, 5, 256, 64
EXACT = 1 << 26  # components up to this give squared distances, and half a million of them sums, below 2^63
LARGEST = 1 << 58  # squared distances of 64 such components have 38 digits
BATCH = 4096  # vectors compared at once


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to c; Python's integers where 64 bits might not do."""
    if len(x) and (np.abs(x).max() > EXACT or np.abs(c).max() > EXACT):
        d = x.astype(object) - c.astype(object)
        return (d * d).sum(axis=-1)
    d = x - c
    return np.einsum("...i,...i->...", d, d)


def _above(square: np.ndarray) -> np.ndarray:
    """float32 values not below the root of exact squares."""
    return np.nextafter(np.sqrt(square.astype(np.float64)).astype(np.float32), np.float32(np.inf)) * np.float32(1 + 2e-7)


def _below(square: np.ndarray) -> np.ndarray:
    """float32 values not above the root of exact squares."""
    return np.maximum(np.nextafter(np.sqrt(square.astype(np.float64)).astype(np.float32), np.float32(-np.inf)) * np.float32(1 - 2e-7), np.float32(0))


class Step:
    """What a round knows of its centroids: half the distances between them (rounded down), and how far each has moved (rounded up)."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        k = len(centroids)
        self.centroids = centroids
        self.half = np.stack([_below(_squares(centroids, centroids[j])) for j in range(k)]) / np.float32(2) if k else np.zeros((0, 0), np.float32)
        if k:
            np.fill_diagonal(self.half, np.inf)
            self.half_nearest = self.half.min(axis=1)
        self.moved = _above(np.array([_squares(centroids[j : j + 1], before[j])[0] for j in range(k)])) if before is not None else None
        if before is not None:
            self.moved[(centroids == before).all(axis=1)] = 0


def assign(x: np.ndarray, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None, step: Step) -> tuple:
    """(own centroid, its exact squared distance or -1 where unknown, upper bounds, lower bounds, number of distances computed)."""
    n, k = len(x), len(step.centroids)
    rows = np.arange(n)
    computed = 0
    if own is None:  # the first round starts from centroid 0 and knows nothing of the others
        own, lower = np.zeros(n, np.int64), np.zeros((n, k), np.float32)
        square = _squares(x, step.centroids[0])
        upper, known = _above(square), np.ones(n, bool)
        lower[:, 0] = _below(square)
        computed += n
    else:
        own = own.astype(np.int64)
        upper = np.nextafter(upper + step.moved[own], np.float32(np.inf))
        lower = np.maximum(np.nextafter(lower - step.moved, np.float32(-np.inf)), np.float32(0))
        square, known = np.full(n, -1, np.int64), np.zeros(n, bool)
    if max(np.abs(x).max(initial=0), np.abs(step.centroids).max()) > EXACT:
        square = square.astype(object)
    busy = np.flatnonzero(upper >= step.half_nearest[own])
    for j in range(k):
        near = busy[(own[busy] != j) & (upper[busy] >= lower[busy, j]) & (upper[busy] >= step.half[own[busy], j])]
        new = near[~known[near]]  # their upper bound isn't sharp yet
        if len(new):
            square[new] = _squares(x[new], step.centroids[own[new]])
            computed += len(new)
            upper[new], lower[new, own[new]], known[new] = _above(square[new]), _below(square[new]), True
            near = near[(upper[near] >= lower[near, j]) & (upper[near] >= step.half[own[near], j])]
        if not len(near):
            continue
        other = _squares(x[near], step.centroids[j])
        computed += len(near)
        lower[near, j] = _below(other)
        better = ((other < square[near]) | ((other == square[near]) & (j < own[near]))).astype(bool)
        go = near[better]
        own[go], square[go], upper[go] = j, other[better], _above(other[better])
    return own, square, upper, lower, computed


STATE = "vec_id string, v array<long>, cluster int, upper float, lower array<float>, square decimal(38,0), sums array<decimal(38,0)>, n long, computed long"


def _round(state: DataFrame, step: Step, first: bool, final: bool) -> DataFrame:
    """Assigns all vectors; rows with ``sums`` are a task's sums and counts by cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(step.centroids)
        low, high, count, computed = np.zeros((k, step.centroids.shape[1]), np.int64), np.zeros((k, step.centroids.shape[1]), np.int64), np.zeros(k, np.int64), 0
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.iloc[at : at + BATCH]
                x = np.stack(batch["v"].to_numpy()).astype(np.int64)
                kept = (None, None, None) if first else (batch["cluster"].to_numpy(), batch["upper"].to_numpy(np.float32), np.stack(batch["lower"].to_numpy()).astype(np.float32))
                own, square, upper, lower, some = assign(x, *kept, step)
                computed += some
                if final:
                    rest = np.flatnonzero(square < 0)
                    square[rest] = _squares(x[rest], step.centroids[own[rest]])
                for c in np.unique(own):  # halves of 32 bits: their sums can't overflow
                    mine = x[own == c]
                    low[c] += (mine & 0xFFFFFFFF).sum(axis=0)
                    high[c] += (mine >> 32).sum(axis=0)
                count += np.bincount(own, minlength=k)
                out = pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "v": list(x), "cluster": own.astype(np.int32), "upper": upper, "lower": list(lower)})
                out["square"] = [int(s) for s in square] if final else None
                yield out.assign(sums=None, n=None, computed=None)
            release()
        if count.any():
            some = np.flatnonzero(count)
            sums = [[(int(h) << 32) + int(m) for h, m in zip(high[c], low[c], strict=True)] for c in some]
            out = pd.DataFrame({"vec_id": None, "v": None, "cluster": some.astype(np.int32), "upper": None, "lower": None, "square": None, "sums": sums, "n": count[some]})
            yield out.assign(computed=[computed] + [0] * (len(some) - 1))

    return state.mapInPandas(_decimals(run), STATE)


def _decimals(run):
    """Integers of decimal columns as Decimals, numbers that can be null as such."""
    from decimal import Decimal

    def out(batches):
        for made in run(batches):
            made["square"] = made["square"].map(lambda s: None if s is None else Decimal(s))
            made["sums"] = made["sums"].map(lambda s: None if s is None else [Decimal(x) for x in s])
            for name, kind in (("upper", "Float32"), ("n", "Int64"), ("computed", "Int64")):
                made[name] = made[name].astype(kind)
            yield made

    return out


def integers(vectors: DataFrame, key: str, column: str, scale: int, size: int) -> DataFrame:
    """(vec_id, v): vectors of ``size`` components, all finite, as floor(scale * component)."""
    x = F.col(column)
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    fits = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(LARGEST)))
    return vectors.where(F.coalesce(fits, F.lit(False))).select(F.col(key).cast("string").alias("vec_id"), scaled.cast("array<long>").alias("v"))


def kmeans(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE, seed: int = 2) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid, computed_share) of every vector of ``size`` finite components.

    Components are floor(scale * x).  The first centroids are the ``k`` kept
    vectors with the smallest sha256 of ``seed:key``, in that order (all, if
    fewer; rows of the same key by their components).  Rows with a null key
    are clustered but never a first centroid.  Each round assigns all vectors
    (ties: smaller number) and replaces centroids by exact floors of means;
    those without vectors stay.  After ``rounds`` rounds all are assigned once
    more.  Vectors that are null, of another length, or with null or
    non-finite components, or components of 2^58 and more after scaling, take
    no part; without a first centroid the result is empty.  ``distance``,
    ``cluster_inertia`` and ``inertia`` are null where they don't fit a long.
    ``computed_share`` is the share of all k distances that was computed.
    """
    kind = dict(vectors.dtypes)[key]
    points = integers(vectors, key, column, scale, size)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id")), 256)
    chosen = points.where("vec_id IS NOT NULL").orderBy(hashed, "v").limit(k).collect()
    spark = vectors.sparkSession
    if not chosen:
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, computed_share double")
    centroids = np.array([r["v"] for r in chosen], np.int64)
    step, state, computed, n = Step(centroids, None), points, 0, 0
    for number in range(rounds + 1):
        after = written(_round(state, step, number == 0, number == rounds))
        dropped(state)
        state = after.where("sums IS NULL")
        state._orrery_path = after._orrery_path
        made = after.where("sums IS NOT NULL")
        told = made.agg(F.sum("computed").alias("c"), F.sum("n").alias("n")).first()
        computed, n = computed + (told["c"] or 0), told["n"] or 0
        if number < rounds:
            sums = made.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).collect()
            new = step.centroids.copy()
            for r in sums:
                new[r["cluster"], r["pos"]] = int(r["s"]) // r["n"]
            step = Step(new, step.centroids)
    totals = state.groupBy("cluster").agg(F.try_sum("square").alias("s")).collect()
    whole = None if any(r["s"] is None for r in totals) else sum(int(r["s"]) for r in totals)
    fits = lambda s: int(s) if s is not None and int(s) < 1 << 63 else None
    rows = [(r["cluster"], fits(r["s"]), fits(whole), [int(c) for c in step.centroids[r["cluster"]]]) for r in totals]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")  # k rows
    out = state.select(F.col("vec_id").cast(kind).alias(key), "cluster", F.expr("try_cast(square AS bigint)").alias("distance"))
    share = computed / (n * len(centroids) * (rounds + 1)) if n else 0.0
    return out.join(F.broadcast(told), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid", F.lit(share).alias("computed_share"))


def op11_elkan(spark, sf_dir: str) -> DataFrame:
    out = kmeans(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _oracle() -> str:
    """The same by comparing every vector with every centroid in every round."""
    pairs = "SELECT {c} FROM v CROSS JOIN c{r} AS c"
    square = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1)::INTEGER AS cluster, v FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {K})",
    ]
    for r in range(ROUNDS + 1):
        best = pairs.format(c=f"v.rowid_ AS i, min(({square}, c.cluster)) AS best", r=r).replace("FROM v ", "FROM (SELECT *, row_number() OVER () AS rowid_ FROM v) AS v ") + " GROUP BY ALL"
        near = best.replace("v.rowid_ AS i, ", "v.rowid_ AS i, any_value(v.vec_id) AS vec_id, any_value(v.v) AS v, ").replace("GROUP BY ALL", "GROUP BY v.rowid_")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, best[1] AS distance, best[2] AS cluster FROM ({near}))")
        if r < ROUNDS:
            means = f"SELECT cluster, list(m ORDER BY p) AS v FROM (SELECT cluster, p, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range({SIZE})) AS p FROM a{r}) GROUP BY cluster, p) GROUP BY cluster"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN ({means}) AS m USING (cluster))")
    last = f"SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS c ON a.cluster = c.cluster"
    return f"WITH {', '.join(parts)} {last}"


ORACLE_SQL = {"op11_elkan": _oracle()}

