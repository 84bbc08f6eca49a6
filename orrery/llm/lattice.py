"""Near duplicates of embeddings by lattice hashing.

Each table projects unit vectors with two random orthonormal 8-row maps and
decodes each image to the nearest point of the E8 lattice; the pair of points
is the vector's cell.  A vector also probes the cells made of the nearest few
lattice points.  Vectors that meet in a cell are compared by cosine in double
precision.

A cell's members are dealt to chunks of a bounded size and pairs of chunks are
compared as matrices, so no pair of vectors is ever a row: a tile returns, per
vector, how many links it counted and the smallest member of its piece of the
link graph.  A pair is counted where its tables and cells first bring it
together.  Equal vectors of a label are one vector with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table, written

THRESHOLD = 0.93
TABLES = 8
PROBES = 3  # lattice points tried in each half: 9 cells a table
SCALE = 4.0  # lattice units to a unit of the projections
CHUNK = 256  # members of a cell compared as one block
SEED = 8


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: all (+-1, +-1, 0...) and all (+-1/2)^8 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a, b in product((1, -1), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the rounded sum is odd, the worst coordinate is rounded the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    gap = x[odd] - r[odd]
    worst = np.abs(gap).argmax(axis=1)
    r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] < 0, -1, 1)
    return r


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of D8 and D8 shifted by one half."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


_ROOTS = roots()


def probes(x: np.ndarray, n: int) -> np.ndarray:
    """The nearest point and the next n - 1 among its neighbours: rows x n x 8."""
    own = nearest(x)
    out = [own[:, None, :]]
    if n > 1:
        near = np.argsort(-((x - own) @ _ROOTS.T), axis=1, kind="stable")[:, : n - 1]
        out.append(own[:, None, :] + _ROOTS[near])
    return np.concatenate(out, axis=1)


def _mix(points: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of lattice points (doubled, so integral)."""
    with np.errstate(over="ignore"):
        h = np.full(points.shape[:-1], salt * 2 + 1, np.uint64)
        for k in range(8):
            h = (h ^ (2 * points[..., k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h


@lru_cache(maxsize=16)
def projections(dim: int, tables: int, seed: int) -> tuple[np.ndarray, ...]:
    """Two orthonormal maps a table, the same wherever they are drawn."""
    rng = np.random.default_rng(seed)
    return tuple(np.linalg.qr(rng.normal(size=(dim, min(8, dim))))[0] for _ in range(2 * tables))


def cells(unit: np.ndarray, tables: int = TABLES, n_probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """Cell keys, rows x tables x n_probes**2; the first of a table is the vector's own cell."""
    dim = unit.shape[1]
    maps = projections(dim, tables, seed)
    out = np.empty((len(unit), tables, n_probes**2), np.int64)
    for t in range(tables):
        halves = []
        for half in range(2):
            q = maps[2 * t + half]
            image = np.zeros((len(unit), 8))
            image[:, : q.shape[1]] = unit @ q * scale * np.sqrt(dim / 64)
            halves.append(_mix(probes(image, n_probes), 2 * t + half))
        with np.errstate(over="ignore"):
            pair = halves[0][:, :, None] * np.uint64(0xBF58476D1CE4E5B9) + halves[1][:, None, :]
        out[:, t] = pair.reshape(len(unit), -1).view(np.int64)
    return out


def _clean(v) -> np.ndarray | None:
    """The vector in doubles; None if it is null, empty, zero or has a null or non-finite component."""
    if v is None:
        return None
    x = np.array([np.nan if e is None else e for e in v], float)
    return x if len(x) and np.isfinite(x).all() and x.any() else None


def _place(df: DataFrame) -> DataFrame:
    """(id, label, table, cell, own) of every vector's cells and probes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vec"].map(len), sort=True):
                for a in range(0, len(part), 1000):
                    some = part.iloc[a : a + 1000]
                    x = np.array(some["vec"].tolist(), float)
                    x /= np.abs(x).max(axis=1, keepdims=True)  # huge and tiny components don't overflow
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    keys = cells(x)
                    n, tables, p = keys.shape
                    yield pd.DataFrame({
                        "id": np.repeat(some["id"].to_numpy(np.int64), tables * p), "label": np.repeat(some["label"].to_numpy(), tables * p),
                        "table": np.tile(np.repeat(np.arange(tables), p), n).astype(np.int32), "cell": keys.ravel(), "own": np.tile(np.arange(p) == 0, n * tables),
                    })

    return df.select("id", "label", "vec").mapInPandas(run, f"id long, label {dict(df.dtypes)['label']}, table int, cell long, own boolean")


def _tiles(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, links, low) of the vectors in each tile; rows of a tile are neighbours in sorted order."""

    def compare(x: np.ndarray, ids: np.ndarray, side: np.ndarray, weight: np.ndarray, cell: int, table: int, first: bool) -> pd.DataFrame | None:
        near = x @ x.T >= threshold
        if near.sum() <= len(x):  # each is near itself
            return None
        if first:
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        i, j = np.nonzero(np.triu(near))
        if not len(i):
            return None
        some = np.union1d(i, j)  # only linked vectors' cells are needed again
        tried = np.empty((len(x), TABLES, PROBES**2), np.int64)
        tried[some] = cells(x[some])
        own = tried[:, :, 0]
        met = (own[i][:, :, None] == tried[j]).any(axis=2) | (own[j][:, :, None] == tried[i]).any(axis=2)
        # this pair's first table, and of that table's cells one fixed one
        low = np.where(ids[i] < ids[j], i, j)
        high = i + j - low
        low_home, high_home = own[low, table], own[high, table]
        at_low = (tried[high, table] == low_home[:, None]).any(axis=1)
        home = np.where(at_low, low_home, high_home)
        good = (met.argmax(axis=1) == table) & met[:, table] & (home == cell)
        i, j = i[good], j[good]
        if not len(i):
            return None
        links = np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))
        label = ids.copy()
        while True:
            before = label.copy()
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            if (before == label).all():
                break
        keep = links > 0
        return pd.DataFrame({"id": ids[keep], "links": links[keep].astype(np.int64), "low": label[keep]})

    def units(vectors: list) -> np.ndarray:
        x = np.array(vectors, float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def tiles(batch: pd.DataFrame, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        """The tiles between cuts; columns become arrays once a batch, since most tiles are a few rows."""
        key, ids, side, copies = batch[["table", "cell", "ti", "tj"]].to_numpy(np.int64), *(batch[c].to_numpy(np.int64) for c in ("id", "side", "copies"))
        vectors, length = batch["vec"].tolist(), batch["vec"].map(len).to_numpy()
        alike = len(length) > 0 and (length == length[0]).all()
        unit = units(vectors) if alike else None
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            table, cell, ti, tj = key[a].tolist()
            # vectors of different lengths have no cosine: each length by itself
            for at in [np.arange(a, b)] if alike else [a + np.flatnonzero(length[a:b] == n) for n in np.unique(length[a:b])]:
                if len(at) > 1:
                    x = unit[a:b] if alike else units([vectors[k] for k in at])
                    if (got := compare(x, ids[at], side[at], copies[at], cell, table, tj > ti)) is not None:
                        yield got

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat((held, batch), ignore_index=True)
            at, label = batch[["table", "cell", "ti", "tj"]].to_numpy(np.int64), batch["label"].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1) | (label[1:] != label[:-1])) + 1))
            held = batch.iloc[cuts[-1] :]
            yield from tiles(batch, cuts)
        if held is not None:
            yield from tiles(held, np.array([0, len(held)]))

    return rows.mapInPandas(run, "id long, links long, low long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``.

    Rows link if their labels are equal and not null and the cosine of their
    vectors is at least ``threshold``.  Null, empty and zero vectors and those
    with null or non-finite components, and rows with a null key, link with
    nothing (a null key's component is null, and it counts as kept).  Keys are
    integers and should be distinct; equal vectors link like others.  Vectors
    of different lengths link with nothing of each other's.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    fine = "size(vec) > 0 AND forall(vec, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')) AND exists(vec, v -> v <> 0)"
    able = rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(fine)
    able = able.withColumn("same", F.sha2(F.to_json(F.struct(F.transform("vec", lambda v: v + F.lit(0.0)).alias("v"))), 256))
    classes = written(able.groupBy("label", "same").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    members = written(able.join(classes, ["label", "same"]).select("id", "label", "rep", "copies", "vec"))
    reps = members.where("id = rep").dropDuplicates(["id"]).select("id", "label", "copies", "vec")
    placed = written(_place(reps))
    count = placed.groupBy("label", "table", "cell").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 AND any_own")
    # members of a cell are dealt to chunks, and each chunk meets each
    met = placed.join(count.drop("any_own"), ["label", "table", "cell"])
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("side", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumns({"ti": F.least("side", "with"), "tj": F.greatest("side", "with")})
    met = met.join(reps.select("id", "copies", "vec"), "id").select("label", "table", "cell", "ti", "tj", "id", "side", "copies", "vec")
    tiles = ["table", "cell", "ti", "tj", "label"]
    found = written(_tiles(met.repartition(*tiles).sortWithinPartitions(*tiles), threshold))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    label_of = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    known = members.select("id", "rep", "copies").distinct()
    known = known.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(label_of.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id").join(known, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").cast(kind).alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def op2_lattice(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = {
    "op2_lattice": f"""
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS MATERIALIZED (
      SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
    r AS (SELECT vec_id id, vec_id reached FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON r.reached = p.a),
    c AS (SELECT id, min(reached) component_id FROM r GROUP BY id),
    n AS (SELECT a id, count(*) n FROM p GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT n_links, component_id, vec_id = component_id kept
    FROM embeddings JOIN c ON vec_id = c.id LEFT JOIN n ON vec_id = n.id"""
}
