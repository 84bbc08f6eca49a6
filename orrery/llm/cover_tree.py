"""Exact top-k inner products by a dual-tree search over cover trees.

The centres of the upper levels come from a bounded sample, picked farthest
first; every row belongs to its nearest centre's block, cut into chunks of a
bounded size, and so do the queries.  A query first meets a chunk of its own
block, which gives a lower bound of its k-th best score; it then goes only to
blocks that can hold a better row:

    <q, c> + |q| R  >=  that score

with c the block's centre and R the radius that covers the block.  In a chunk
both sides get a cover tree, and pairs of nodes are searched together: no
product between them exceeds

    <q, p> + |q| R_p + |p| R_q + R_q R_p

with q, p the centres and R the radii that cover the nodes' points, so a pair
is pruned when this is below the worst k-th best score of the queries below
the query node.  Scores are integers, computed exactly.  Rows never move but
to their chunk (once a share of very many queries), queries move to the blocks
that are left.  A query's best rows of all chunks are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, table, written

BLOCK = 4096  # rows of a chunk
GROUP = 512  # queries searched together
LEAF = 48
CLUSTER = 8  # rows of a leaf of its own; fewer are joined with others, while a single query may be a leaf
CENTRES = 1024  # blocks of a vector length at most
SAMPLE = 8192  # rows that centres are picked from; all rows are placed
SHARE = 50_000  # queries that meet one copy of a chunk
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # of a score


class Node:
    __slots__ = ("centre", "children", "norm", "radius", "rows")

    def __init__(self, centre, radius, rows, children):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children
        self.norm = float(np.sqrt((centre * centre).sum()))


def cover_tree(x: np.ndarray, whole: int = LEAF) -> Node:
    """A node's children have centres among its points, more than half its radius apart, and every point is within that of its child's centre.

    Leaves of a node with fewer than ``whole`` points each are joined.
    """

    def build(rows: np.ndarray, centre: int) -> Node:
        gap = np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))
        radius = float(gap.max())
        if len(rows) <= LEAF or radius == 0:
            return Node(x[centre], radius, rows, [])
        reach, children = radius / 2, []
        left, gap = rows, gap
        while len(left):
            # the centre itself comes first, then the farthest of what is left
            c = centre if not children else left[int(gap.argmax())]
            near = np.sqrt(((x[left] - x[c]) ** 2).sum(axis=1))
            taken = near <= reach
            children.append(build(left[taken], c))
            left, gap = left[~taken], gap[~taken]
        # covers of few points are joined so that a leaf is worth a matrix product
        small = [n for n in children if not n.children and len(n.rows) < whole]
        big = [n for n in children if n.children or len(n.rows) >= whole]
        pack, size = [], 0
        for n in small:
            pack.append(n.rows)
            size += len(n.rows)
            if size >= LEAF:
                big.append(leaf(np.concatenate(pack)))
                pack, size = [], 0
        if pack:
            big.append(leaf(np.concatenate(pack)))
        return big[0] if len(big) == 1 else Node(x[centre], radius, rows, big)

    def leaf(rows: np.ndarray) -> Node:
        gap = ((x[rows] - x[rows[0]]) ** 2).sum(axis=1)
        return Node(x[rows[0]], float(np.sqrt(gap.max())), rows, [])

    return build(np.arange(len(x)), 0)


def reached(products, norms_q, norms_p, radii_q=0.0, radii_p=0.0):
    """What no product of points within the radii exceeds, rounding included; scores end at the range of longs."""
    most = products + norms_q * radii_p + norms_p * radii_q + radii_q * radii_p
    return np.clip(most + 1e-9 * np.abs(most) + 1e-6, float(LEAST), None)


class Flat:
    """A cover tree's nodes as arrays."""

    def __init__(self, root: Node):
        nodes, at = [root], 0
        first, many = [], []
        while at < len(nodes):
            first.append(len(nodes))
            many.append(len(nodes[at].children))
            nodes += nodes[at].children
            at += 1
        self.nodes = nodes
        self.centre = np.array([n.centre for n in nodes])
        self.norm, self.radius = np.array([n.norm for n in nodes]), np.array([n.radius for n in nodes])
        self.first, self.many = np.array(first), np.array(many)

    def least(self, values: np.ndarray) -> np.ndarray:
        """Each node's least value, from those of the rows."""
        out = np.array([values[n.rows].min() if not n.children else np.inf for n in self.nodes])
        for k in range(len(out) - 1, -1, -1):  # children come after their parents
            if self.many[k]:
                out[k] = out[self.first[k] : self.first[k] + self.many[k]].min()
        return out


class Search:
    """Best k rows of a chunk for each query, ties to the smaller id; rows that score below the query's ``floor`` aren't looked for.

    ``scored`` counts the pairs whose product was taken.
    """

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, floor: np.ndarray | None = None, tree: Flat | None = None):
        self.q, self.p, self.q_ids, self.p_ids, self.k = q, p, q_ids, p_ids, k
        self.worst = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
        self.who, self.row, self.top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.scored = 0
        self._search(Flat(cover_tree(q, 1)), tree or Flat(cover_tree(p, CLUSTER)))

    def _search(self, a: Flat, b: Flat) -> None:
        worst = a.least(self.worst)
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        leaves = []
        while len(i):
            bound = reached((a.centre[i] * b.centre[j]).sum(axis=1), a.norm[i], b.norm[j], a.radius[i], b.radius[j])
            keep = bound >= worst[i]
            i, j, bound = i[keep], j[keep], bound[keep]
            done = (a.many[i] == 0) & (b.many[j] == 0)
            leaves.append((i[done], j[done], bound[done]))
            i, j = i[~done], j[~done]
            left = (a.many[i] > 0) & ((b.many[j] == 0) | (a.radius[i] >= b.radius[j]))  # the wider node is opened
            many = np.where(left, a.many[i], b.many[j])
            number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            i, j, left = np.repeat(i, many), np.repeat(j, many), np.repeat(left, many)
            i, j = np.where(left, a.first[i] + number, i), np.where(left, j, b.first[j] + number)
        i, j, bound = (np.concatenate(x) for x in zip(*leaves, strict=True))
        if not len(i):  # nothing here reaches the floors
            return
        order = np.lexsort((-bound, i))  # a query leaf's most promising leaves come first
        i, j, bound = i[order], j[order], bound[order]
        cuts = np.flatnonzero(np.concatenate((i[:1] >= 0, i[1:] != i[:-1])))
        ends = np.append(cuts[1:], len(i)).astype(int)
        for s, e in zip(cuts, ends, strict=True):  # the best leaves first, which raise the k-th scores
            self._leaves(a.nodes[i[s]].rows, np.concatenate([b.nodes[n].rows for n in j[s : min(e, s + 2)]]))
        size_a, size_b = (np.array([0 if n.children else len(n.rows) for n in x.nodes]) for x in (a, b))
        left = bound >= a.least(self.worst)[i]
        # where little is pruned, a query leaf meets all that is left to it at once
        wide = len(j) if (size_a[i] * size_b[j])[left].sum() > len(self.q) * len(self.p) / 2 else 4
        for s, e in zip(cuts, ends, strict=True):
            own, at, step = a.nodes[i[s]].rows, s + 2, wide
            while at < e and bound[at] >= self.worst[own].min():
                some = j[at : min(e, at + step)][bound[at : min(e, at + step)] >= self.worst[own].min()]
                self._leaves(own, np.concatenate([b.nodes[n].rows for n in some]))
                at, step = at + step, step * 4

    def _leaves(self, own: np.ndarray, rows: np.ndarray) -> None:
        s = self.q[own] @ self.p[rows].T
        self.scored += s.size
        s[self.q_ids[own][:, None] == self.p_ids[rows][None, :]] = -np.inf
        least = np.partition(s, -self.k, axis=1)[:, -self.k] if s.shape[1] > self.k else np.full(len(own), -np.inf)
        i, j = np.nonzero((s >= np.maximum(least, self.worst[own])[:, None]) & np.isfinite(s))
        mine = np.isin(self.who, own)
        who, row, top = np.concatenate((self.who[mine], own[i])), np.concatenate((self.row[mine], rows[j])), np.concatenate((self.top[mine], s[i, j]))
        order = np.lexsort((self.p_ids[row], -top, who))
        who, row, top = who[order], row[order], top[order]
        start = np.flatnonzero(np.concatenate((who[:1] >= 0, who[1:] != who[:-1])))
        rank = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
        keep = rank < self.k
        full = rank == self.k - 1
        self.worst[who[full]] = np.maximum(self.worst[who[full]], top[full])
        self.who, self.row, self.top = (np.concatenate((x[~mine], y[keep])) for x, y in ((self.who, who), (self.row, row), (self.top, top)))


def best(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int, floor: np.ndarray | None = None, tree: Flat | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of the best rows; products beyond 2**53 are taken in whole numbers and end at the range of longs."""
    if np.linalg.norm(q, axis=1).max() * np.linalg.norm(p, axis=1).max() < EXACT:
        s = Search(q, q_ids, p, p_ids, k, floor, tree)
        return q_ids[s.who], p_ids[s.row], s.top.astype(np.int64)
    out = []
    whole = [[int(x) for x in v] for v in p]
    for v, i in zip(q, q_ids.tolist(), strict=True):
        own = [int(x) for x in v]
        scores = ((max(LEAST, min(MOST, sum(x * y for x, y in zip(own, w, strict=True)))), n) for w, n in zip(whole, p_ids.tolist(), strict=True) if n != i)
        out += [(i, n, x) for x, n in sorted(scores, key=lambda t: (-t[0], t[1]))[:k]]
    return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def centres_of(sample: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` points, each the farthest from those before it: the upper levels of a cover tree."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < most and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _placed(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Rows with their length, nearest centre and distance; a length that isn't in the sample has one centre, zero."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len), sort=True):
                x = np.array(part["v"].tolist(), float).reshape(len(part), dim)
                c = shared.value.get(dim, np.zeros((1, dim)))
                nearest = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
                gap = np.sqrt(((x - c[nearest]) ** 2).sum(axis=1))
                yield pd.DataFrame({"id": part["id"], "dim": dim, "centre": nearest, "gap": gap, "v": part["v"]})

    return rows.mapInPandas(run, "id long, dim int, centre int, gap double, v array<double>")


def _meetings(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the best rows of each chunk for the queries sent there.

    ``data``: (dim, centre, chunk, share, id, v), ``asked``: these and floor.
    """
    key = ["dim", "centre", "chunk", "share"]
    rows = data.select(*key, F.lit(0).alias("turn"), "id", F.lit(None).cast("double").alias("floor"), "v").union(asked.select(*key, F.lit(1).alias("turn"), "id", "floor", "v"))
    rows = rows.repartition(*key).sortWithinPartitions(*key, "turn", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, chunk, held, tree = None, None, [], None

        def answer() -> pd.DataFrame | None:
            nonlocal tree
            if chunk is None or not len(chunk[0]) or not held:
                return None
            if tree is None:
                tree = Flat(cover_tree(chunk[1], CLUSTER))
            ids, floor, v = (np.array(x) for x in zip(*held, strict=True))
            a, b, score = best(v, ids, chunk[1], chunk[0], k, floor, tree)
            return pd.DataFrame({"query_id": a, "id": b, "score": score})

        p_ids, p = [], []
        for batch in batches:
            for *at, turn, i, floor, v in batch[[*key, "turn", "id", "floor", "v"]].itertuples(index=False):
                if at != now:
                    if (got := answer()) is not None:
                        yield got
                    now, chunk, held, tree, p_ids, p = at, None, [], None, [], []
                if turn == 0:
                    p_ids.append(i)
                    p.append(v)
                    continue
                if chunk is None:  # rows come ahead of queries
                    chunk = np.array(p_ids, np.int64), np.array(p, float).reshape(len(p), -1)
                held.append((i, floor, v))
                if len(held) == GROUP:
                    if (got := answer()) is not None:
                        yield got
                    held = []
        if (got := answer()) is not None:
            yield got

    return rows.mapInPandas(run, "query_id long, id long, score long")


def top_k(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, key, score): for each row of ``queries`` its ``k`` best rows of ``df`` with another key.

    Components become floor(scale * x), those beyond the range of longs its
    ends; the score is the integer inner product, beyond that range its ends,
    too; ties go to the smaller key.  Null vectors, those with null or
    non-finite components, and null keys take no part.  Vectors of different
    lengths have no product; empty ones score 0 with each other.  With fewer
    candidates all are returned.  Keys are integers and should be distinct (of
    rows that repeat one, each is a candidate).
    """

    def ready(d: DataFrame) -> DataFrame:
        fine = f"`{key}` IS NOT NULL AND `{vector}` IS NOT NULL AND forall(`{vector}`, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity'))"
        return d.where(fine).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"))

    data, asked = ready(df), ready(queries)
    n = data.count()
    sample: dict[int, list] = {}
    for r in data.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        sample.setdefault(len(r.v), []).append(r.v)
    centres = {dim: centres_of(np.array(v, float).reshape(len(v), dim), min(CENTRES, -(-n // BLOCK))) for dim, v in sample.items()}
    placed, asked = written(_placed(data, centres)), written(_placed(asked, centres))
    data = placed
    # a row a centre: at most CENTRES of each vector length
    blocks = data.groupBy("dim", "centre").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).toPandas()
    blocks["chunks"] = -(-blocks["n"] // BLOCK)
    many = data.sparkSession.createDataFrame(blocks[["dim", "centre", "chunks"]].astype("int64"), "dim int, centre int, chunks int")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk")
    # first a chunk of the own block
    data = data.join(F.broadcast(many), ["dim", "centre"]).select("dim", "centre", chunk, "id", "v")
    home = asked.join(F.broadcast(many), ["dim", "centre"]).select("dim", "centre", chunk, F.lit(0).alias("share"), "id", F.lit(float("-inf")).alias("floor"), "v")
    # its best rows are part of the result, and the last of them a floor for all other chunks
    first = written(_meetings(data.withColumn("share", F.lit(0)), home, k))
    seeds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
    floored = home.drop("floor").join(seeds, "id", "left").select("id", "dim", "v", F.col("centre").alias("own"), F.col("chunk").alias("nth"), F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    by_dim = {}
    for dim, part in blocks.groupby("dim"):
        at = part["centre"].to_numpy(int)
        by_dim[int(dim)] = (at, centres.get(int(dim), np.zeros((1, int(dim))))[at], part["radius"].to_numpy(float), part["chunks"].to_numpy(int))
    shared = data.sparkSession.sparkContext.broadcast(by_dim)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim", sort=True):
                if dim not in shared.value:
                    continue
                number, c, radius, chunks = shared.value[dim]
                for a in range(0, len(part), 200):
                    some = part.iloc[a : a + 200]
                    q = np.array(some["v"].tolist(), float).reshape(len(some), dim)
                    norm = np.sqrt((q * q).sum(axis=1))
                    # a block's farther points are within its radius of the centre
                    able = reached(q @ c.T, norm[:, None], 0.0, 0.0, radius[None, :]) >= some["floor"].to_numpy(float)[:, None]
                    i, j = np.nonzero(able)
                    i, j = np.repeat(i, chunks[j]), np.repeat(j, chunks[j])
                    new = np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])))[: len(i)]
                    start = np.flatnonzero(new)
                    nth = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
                    # the own chunk has answered
                    other = (number[j] != some["own"].to_numpy()[i]) | (nth != some["nth"].to_numpy()[i])
                    i, j, nth = i[other], j[other], nth[other]
                    for b in range(0, len(i), 5000):
                        w = i[b : b + 5000]
                        yield pd.DataFrame({"dim": dim, "centre": number[j[b : b + 5000]], "chunk": nth[b : b + 5000], "id": some["id"].to_numpy()[w], "floor": some["floor"].to_numpy()[w], "v": some["v"].to_numpy()[w]})

    shares = max(1, -(-asked.count() // SHARE))
    sent = written(floored.mapInPandas(send, "dim int, centre int, chunk int, id long, floor double, v array<double>"))
    sent = sent.withColumn("share", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shares)).cast("int"))
    needed = F.broadcast(sent.select("dim", "centre").distinct())  # centres again
    there = data.join(needed, ["dim", "centre"], "left_semi").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    found = written(first.union(_meetings(there, sent, k)))
    for done in (first, placed, asked):
        dropped(done)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def op6_cover_tree(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


ORACLE_SQL = {
    "op6_cover_tree": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) v
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id query_id, p.vec_id vec_id,
        list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * p.v[i]))::BIGINT score
      FROM v q JOIN v p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id)
    SELECT query_id, rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER rank FROM s)
    WHERE rank <= 10"""
}
