"""Near duplicates by word n-gram Jaccard similarity: a PartEnum join.

1. *Sieve.*  A set with a partner of similarity 3/4 shares 3/4 of its features
   with it, so at most a quarter of them may occur nowhere else.  All features
   of a fixed share of the domain are exchanged in packed chunks, a feature of
   a block of documents once; sets of which more than a quarter is found alone
   go.  The features of those left are counted exactly.
2. *Cores.*  A feature that no other set left has is only a unit of distance.
   Sets that agree in all other features form a class; its core is the set
   with the fewest features of its own.  Whatever links with a member links
   with the core, so cores are joined, and a member follows its core if it
   links with the core or with one of the core's partners.
3. *Signatures.*  Sizes fall in bands between powers of two.  A band splits the
   feature domain into n1 partitions of n2 = 3 parts.  Two sets that differ in
   k elements agree, in some partition, in all but k2 = 1 of its parts as soon
   as there are more than k / (k2 + 1) partitions, so the subsets of n2 - k2
   parts are enumerated and a set signs each that holds any of its features.
   Empty subsets sign nothing; a set that has too few partitions with features
   in two parts signs on a further level, and only pairs of such sets need it.
   The levels are: rare features only, all features, single features (the
   prefix of a quarter of them, rare ones first).  What counts as frequent
   changes the work, never the result.
4. *Links.*  Of the sets that share a signature each is compared with one
   centre.  Where the others are still in several components, the components
   are compared: members of the largest with all the rest, then that rest
   within itself, as matrices of bounded size.  Nothing is compared twice
   because it shares several signatures, and pairs of one component aren't
   compared at all.

Identical sets are one set from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dropped, release, small_batches, table, words, written

WORDS = 5
PERCENT = 75  # links: 100 * intersection >= PERCENT * union; the bounds below are those of 75
SIEVE = 0.4  # share of the feature domain that the sieve exchanges
BLOCK = 500_000  # features of a block of documents
SALTS = 32  # shares that a frequent signature's members are dealt to
SHARE = 2000  # members that meet a copy of their centre
TILE = 512  # sets on a side of a matrix
TILE_FEATURES = 500_000  # and their features, if there are several sets
PASS_FEATURES = 64_000_000  # features (8 bytes each) sent to tiles at once, or twice those of all cores if they are more
KNOWN_IDS = 1_000_000  # ids (8 bytes each) sent to all executors; more are joined by a shuffle
FREQUENT = 500_000  # frequent features kept (8 bytes each)
PARTS, MISSES = 3, 1  # n2 and k2
FIRST_BAND = 5  # smaller sets sign single features
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def features(text: str | None, n: int = WORDS) -> np.ndarray:
    """Distinct n-word shingles of a text as sorted 64-bit hashes; a shorter text is one shingle, one without words none."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n = min(n, len(ws))
    with np.errstate(over="ignore"):
        out = np.full(len(ws) - n + 1, n, np.uint64)
        for i in range(n):
            out = mixed(out + _A) ^ h[i : len(h) - n + 1 + i]
    return np.unique(mixed(out))


def within(s: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which elements of ``s`` are in the sorted ``other``."""
    if not len(other):
        return np.zeros(len(s), bool)
    at = np.searchsorted(other, s)
    at[at == len(other)] = 0
    return other[at] == s


# -- signatures ------------------------------------------------------------------


def bands(size: int) -> list[int]:
    """The bands in which a set signs: its own, and the next one's if a partner may lie there."""
    own = size.bit_length() - 1
    return [own, own + 1] if 4 * size >= 3 << (own + 1) else [own]


def partitions(band: int) -> int:
    """n1: more than k / (k2 + 1) for the band's largest sets, with a reserve for partitions too thin to sign."""
    return 2 + (17 * 2 ** (band + 1)) // 100


def _enumerated(s: np.ndarray, band: int, level: int) -> tuple[np.ndarray, int]:
    """Signatures of all part subsets that hold features, and the partitions with features in more parts than may differ."""
    n1 = partitions(band)
    with np.errstate(over="ignore"):
        place, content = mixed(s + _A * np.uint64(band + 2)), mixed(s ^ _C)
        part = ((place >> np.uint64(8)) % np.uint64(n1) * np.uint64(PARTS) + (place & np.uint64(255)) % np.uint64(PARTS)).astype(np.int64)
        count = np.bincount(part, minlength=n1 * PARTS).reshape(n1, PARTS)
        held = np.zeros(n1 * PARTS, np.uint64)
        np.add.at(held, part, content)
        held = held.reshape(n1, PARTS)
        rest, left = held.sum(axis=1, keepdims=True, dtype=np.uint64) - held, count.sum(axis=1, keepdims=True) - count
        number = np.arange(n1 * PARTS, dtype=np.uint64).reshape(n1, PARTS)
        sig = mixed(mixed(number + np.uint64(band * 4 + level) * _A) ^ rest)
    return sig[left > 0], int(((count > 0).sum(axis=1) > MISSES).sum())


def signatures(s: np.ndarray, own: int, frequent: np.ndarray) -> np.ndarray:
    """Signatures of a set that has ``own`` further features no other set has; odd ones are made of frequent features, too."""
    size = len(s)
    most = size // 3 - own  # elements in which a partner may differ
    if not size or most < 0:
        return np.zeros(0, np.int64)
    common = within(s, frequent)
    out = []
    for band in bands(size):
        k = min(most, 2 * (2 ** (band + 1) - 1) // 7)
        met = False
        if band >= FIRST_BAND:
            for level, some in ((0, s[~common]), (1, s)):
                sig, able = _enumerated(some, band, level)
                out.append(sig & ~np.uint64(1) | np.uint64(level))
                if met := able > k // (MISSES + 1):
                    break
        if not met:
            order = np.lexsort((mixed(s ^ _B), common))[: size // 4 + 1]
            with np.errstate(over="ignore"):
                sig = mixed(mixed(s[order] + np.uint64(band * 4 + 2) * _A) ^ _C)
            out.append(sig & ~np.uint64(1) | common[order].astype(np.uint64))
    return np.unique(np.concatenate(out)).view(np.int64)


def slack(a: np.ndarray, b: np.ndarray) -> int:
    """How many features of their own two sets may have together and link; negative: they can't link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both // 3 - (len(a) + len(b) - 2 * both)


# -- the sieve -------------------------------------------------------------------


def _planes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _measure(rows: DataFrame, bits: int) -> DataFrame:
    """Per row (slot, id, n, k1, k2: a 128-bit hash of the set, alone); with a null n, packed chunks (slot, part, load) of blocks' features.

    ``alone`` is how many of a set's features in the sieve's share of the
    domain no other set of its block has; null for a block's further copies.
    """
    limit = np.uint64(int(SIEVE * 2.0**64))
    high, low = np.uint64(64 - bits), np.uint64(32 - bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made = TaskContext.get().partitionId() << 40, 0
        docs: list[tuple] = []
        held: list[np.ndarray] = []
        seen: dict[int, int] = {}
        size = 0

        def block() -> pd.DataFrame:
            first = base + (made << 16)
            f = np.concatenate(held)
            who = np.repeat(np.arange(len(held)), [len(x) for x in held])
            order = np.argsort(f, kind="stable")
            f, who = f[order], who[order]
            new = np.concatenate(([True], f[1:] != f[:-1]))[: len(f)]
            single = new & np.concatenate((new[1:], [True]))[: len(f)]
            alone = np.bincount(who[single], minlength=len(held))
            f, who = f[new], np.where(single, who, 65535)[new]
            part = (f >> high).astype(np.int64)
            value = (f >> low & np.uint64(0xFFFFFFFF)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate((part[:1] >= 0, part[1:] != part[:-1])))
            gaps = np.diff(value, prepend=0)
            gaps[cuts] = value[cuts]
            ends = [*cuts[1:].tolist(), len(part)][: len(cuts)]  # none if no set has a feature in the sieve's share
            loads = [_planes(gaps[a:b], "<u4") + _planes(who[a:b], "<u2") for a, b in zip(cuts.tolist(), ends, strict=True)]
            n = len(docs)
            none = [None] * len(loads)
            return pd.DataFrame({
                "slot": pd.array([None if d[4] is None else first + d[4] for d in docs] + [first] * len(loads), "Int64"), "id": pd.array([d[0] for d in docs] + none, "Int64"), "n": pd.array([d[1] for d in docs] + none, "Int64"),
                "k1": pd.array([d[2] for d in docs] + none, "Int64"), "k2": pd.array([d[3] for d in docs] + none, "Int64"), "alone": pd.array([None if d[4] is None else int(alone[d[4]]) for d in docs] + none, "Int64"),
                "part": pd.array([None] * n + part[cuts].tolist(), "Int64"), "load": [None] * n + loads,
            })

        for batch in batches:
            for i, t in zip(batch["_id"], batch["_text"], strict=True):
                s = features(t)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                here = None
                if d not in seen:
                    here = seen[d] = len(held)
                    place = mixed(s ^ _A)
                    held.append(place[place < limit])
                    size += len(held[-1])
                docs.append((None if pd.isna(i) else int(i), len(s), (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), here))
                if size >= BLOCK or len(docs) >= 60_000:
                    yield block()
                    docs, held, seen, size, made = [], [], {}, 0, made + 1
        if docs:
            yield block()
        del docs, held, seen
        release()

    return rows.mapInPandas(run, "slot long, id long, n long, k1 long, k2 long, alone long, part long, load binary")


def _met(chunks: DataFrame) -> DataFrame:
    """(slot, met): how many of a set's features other blocks have.  ``chunks``: (slot, part, load)."""

    def shared(parts: list[tuple[int, bytes]]) -> np.ndarray:
        values, whose = [], []
        for slot, load in parts:
            m = len(load) // 6
            values.append(np.cumsum(_numbers(load[: 4 * m], "<u4").astype(np.int64)))
            who = _numbers(load[4 * m :], "<u2").astype(np.int64)
            whose.append(np.where(who == 65535, -1, slot + who))
        v, w = np.concatenate(values), np.concatenate(whose)
        order = np.argsort(v, kind="stable")
        v, w = v[order], w[order]
        new = np.concatenate(([True], v[1:] != v[:-1]))[: len(v)]
        single = new & np.concatenate((new[1:], [True]))[: len(v)]
        return w[~single & (w >= 0)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, found, size = None, [], [], 0

        def flush():  # a row a block
            slot, met = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            cuts = np.flatnonzero(np.diff(slot >> 16, prepend=-1))
            packed = [_planes(i & 65535, "<u2") + _planes(n, "<u4") for i, n in zip(np.split(slot, cuts[1:]), np.split(met, cuts[1:]), strict=True)] if len(slot) else []
            return pd.DataFrame({"block": slot[cuts] >> 16, "load": packed})

        for batch in batches:
            for slot, part, load in zip(batch["slot"], batch["part"], batch["load"], strict=True):
                if part != now and parts:
                    found.append(shared(parts))
                    size += len(found[-1])
                    parts = []
                    if size > 2_000_000:
                        yield flush()
                        size = 0
                now = part
                parts.append((int(slot), load))
        if parts:
            found.append(shared(parts))
        if found:
            yield flush()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums = None, np.zeros(65536, np.int64)

        def told() -> pd.DataFrame:
            at = np.flatnonzero(sums)
            return pd.DataFrame({"slot": (now << 16) + at, "met": sums[at]})

        for batch in batches:
            for block, load in zip(batch["block"].tolist(), batch["load"], strict=True):
                if block != now:
                    if now is not None:
                        yield told()
                    now = block
                    sums[:] = 0
                m = len(load) // 6
                sums[_numbers(load[: 2 * m], "<u2")] += _numbers(load[2 * m :], "<u4")
        if now is not None:
            yield told()

    found = chunks.repartition("part").sortWithinPartitions("part").mapInPandas(run, "block long, load binary")
    return found.repartition("block").sortWithinPartitions("block").mapInPandas(add, "slot long, met long")


def sliced(batches: Iterator[pd.DataFrame], column: str, limit: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """The batches in pieces of rows whose texts or bytes in ``column`` have a bounded size together (or of one row)."""
    for batch in batches:
        ends = np.cumsum([len(x) for x in batch[column]])
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
            yield batch.iloc[a:b]
            a = b
    release()


# -- sets left by the sieve --------------------------------------------------------


def _featured(docs: DataFrame) -> DataFrame:
    """(id, feats) of (id, text): features as 8-byte integers in ascending order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sliced(batches, "text"):
            yield pd.DataFrame({"id": part["id"].to_numpy(), "feats": [features(t).tobytes() for t in part["text"]]})

    return docs.mapInPandas(run, "id long, feats binary")


def _exploded(sets: DataFrame) -> DataFrame:
    """(f, id), a row a feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sliced(batches, "feats"):
            each = [np.frombuffer(x, np.int64) for x in part["feats"]]
            yield pd.DataFrame({"f": np.concatenate(each), "id": np.repeat(part["id"].to_numpy(np.int64), [len(x) for x in each])})

    return sets.mapInPandas(run, "f long, id long")


def _kin(sets: DataFrame) -> DataFrame:
    """(id, size, own, h1, h2, feats) of (id, feats, mine): without the features of their own; sets with too many of those go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sliced(batches, "feats"):
            out = []
            for i, raw, mine in zip(part["id"], part["feats"], part["mine"], strict=True):
                s = np.frombuffer(raw, np.uint64)
                lone = 0 if mine is None else len(mine)
                if 4 * lone > len(s):
                    continue
                if lone:
                    s = s[~within(s, np.sort(np.asarray(mine, np.int64).view(np.uint64)))]
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append((i, len(s), lone, (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), s.tobytes()))
            yield pd.DataFrame(out, columns=["id", "size", "own", "h1", "h2", "feats"])

    return sets.select("id", "feats", "mine").mapInPandas(run, "id long, size long, own long, h1 long, h2 long, feats binary")


def _signed(cores: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(sig, id)."""
    shared = cores.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT features

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sliced(batches, "feats"):
            sigs = [signatures(np.frombuffer(x, np.uint64), int(own), shared.value) for x, own in zip(part["feats"], part["own"], strict=True)]
            yield pd.DataFrame({"sig": np.concatenate(sigs), "id": np.repeat(part["id"].to_numpy(np.int64), [len(x) for x in sigs])})

    return cores.select("id", "own", "feats").mapInPandas(run, "sig long, id long")


def _with_centres(pairs: DataFrame, cores: DataFrame) -> DataFrame:
    """(a, b, room): linked ones of the pairs (centre a, b); a member of a's class with at most ``room`` features of its own links with b, too."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(many, "a").withColumn("share", F.pmod(F.hash("b"), F.col("shares"))).select("a", "b", "share")
    one = cores.select("id", "own", "feats")
    left = dealt.select("a", "share").distinct().join(one.withColumnRenamed("id", "a"), "a").select("a", "share", F.lit(0).alias("turn"), F.col("a").alias("b"), "own", "feats")
    right = dealt.join(one.withColumnRenamed("id", "b"), "b").select("a", "share", F.lit(1).alias("turn"), "b", "own", "feats")
    rows = left.union(right).repartition("a", "share").sortWithinPartitions("a", "share", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, mine = np.zeros(0, np.uint64), 0
        for batch in batches:
            out = []
            for a, turn, b, own, raw in zip(*(batch[c] for c in ("a", "turn", "b", "own", "feats")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if turn == 0:  # a centre comes ahead of what is compared with it
                    centre, mine = s, own
                    continue
                room = slack(centre, s)
                if mine + own <= room:
                    out += [(a, b, room - own), (b, a, room - mine)]
            yield pd.DataFrame(out, columns=["a", "b", "room"])

    return rows.mapInPandas(run, "a long, b long, room long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists."""
    x, y = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.float32)
    i, j = np.repeat(np.arange(len(left)), [len(v) for v in left]), np.repeat(np.arange(len(right)), [len(v) for v in right])
    keep_x, keep_y = within(x, shared), within(y, shared)

    def columns(x: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.searchsorted(shared, x)
        order = np.argsort(x, kind="stable")
        return x[order], i[order]

    (x, i), (y, j) = columns(x[keep_x], i[keep_x]), columns(y[keep_y], j[keep_y])
    width = 4096
    for a in range(0, len(shared), width):
        p, q = np.zeros((len(left), min(width, len(shared) - a)), np.float32), np.zeros((len(right), min(width, len(shared) - a)), np.float32)
        for m, at, row in ((p, x, i), (q, y, j)):
            some = slice(*np.searchsorted(at, (a, a + width)))
            m[row[some], at[some] - a] = 1
        out += p @ q.T
    return np.rint(out).astype(np.int64)


def _linked(t: pd.DataFrame, across: bool) -> pd.DataFrame | None:
    """Links of a tile: (a, b) to the least set of each piece of the link graph, and (a, a, room) of flagged sets."""
    i = np.flatnonzero(t["side"] == 0) if across else np.arange(len(t))
    j = np.flatnonzero(t["side"] == 1) if across else i
    if not len(i) or not len(j):
        return None
    sets = [np.frombuffer(x, np.uint64) for x in t["feats"]]
    size, own = t["size"].to_numpy(np.int64), t["own"].to_numpy(np.int64)
    ids, label, flag = t["id"].to_numpy(np.int64), t["label"].to_numpy(np.int64), t["flag"].to_numpy(bool)
    both = _overlaps([sets[k] for k in i], [sets[k] for k in j])
    room = both // 3 - (size[i][:, None] + size[j][None, :] - 2 * both)
    near = (room >= own[i][:, None] + own[j][None, :]) & (ids[i][:, None] != ids[j][None, :])
    near &= (label[i][:, None] != label[j][None, :]) | flag[i][:, None] | flag[j][None, :]
    p, q = np.nonzero(near)
    if not len(p):
        return None
    x, y, room = i[p], j[q], room[p, q]
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        if (before == low).all():
            break
    most = np.full(len(t), -1)
    np.maximum.at(most, x, room - own[y])
    np.maximum.at(most, y, room - own[x])
    at, told = np.flatnonzero(low != ids), np.flatnonzero(flag & (most >= 0))
    return pd.DataFrame({"a": np.concatenate((ids[at], ids[told])), "b": np.concatenate((low[at], ids[told])), "room": np.concatenate((np.full(len(at), -1), most[told]))})


def _tiles(members: DataFrame, cores: DataFrame, across: bool) -> list[DataFrame]:
    """(a, b, room) of the sets (group, id, side, label, flag, size) of each group: one side with the other, or all among themselves.

    A set is sent to every tile of its row, so what is sent may grow with the
    square of a group.  Tiles are dealt to passes, each written before the next
    one starts, so that what lies on disk at once grows with the cores only.
    """
    sides = ["group", "side"] if across else ["group"]
    members = written(members)
    number = members.groupBy(*sides).agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_FEATURES)).cast("int").alias("chunks"), F.sum("size").alias("features"))
    number = written(number)
    dealt = members.join(number.drop("features"), sides).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    if across:
        at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
        n = number.groupBy("group").agg(at(0, "chunks").alias("n0"), at(1, "chunks").alias("n1"), at(0, "features").alias("f0"), at(1, "features").alias("f1")).where("n0 IS NOT NULL AND n1 IS NOT NULL")
        sent = n.agg(F.sum(F.col("f0") * F.col("n1") + F.col("f1") * F.col("n0")))
        other = F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))
        dealt = dealt.join(n.select("group", "n0", "n1"), "group").withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
        dealt = dealt.withColumns({"ti": F.when(F.col("side") == 0, F.col("chunk")).otherwise(F.col("other")), "tj": F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("chunk"))})
    else:
        sent = number.agg(F.sum(F.col("features") * F.col("chunks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = dealt.withColumns({"ti": F.least("chunk", "other"), "tj": F.greatest("chunk", "other"), "side": (F.col("chunk") > F.col("other")).cast("int")})
    most = max(PASS_FEATURES, 2 * (cores.agg(F.sum("size")).first()[0] or 0))
    passes = max(1, -(-(sent.first()[0] or 0) // most))
    key = ["group", "ti", "tj"]

    def rows(turn: int) -> DataFrame:
        mine = dealt if passes == 1 else dealt.where(F.pmod(F.xxhash64(*key), F.lit(passes)) == turn)
        return mine.select(*key, "side", "id", "label", "flag").join(cores.select("id", "size", "own", "feats"), "id").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def tile(t: pd.DataFrame) -> pd.DataFrame | None:
            return _linked(t, across or t["ti"].iat[0] != t["tj"].iat[0]) if len(t) > 1 else None

        for batch in batches:
            batch = batch if held is None else pd.concat((held, batch), ignore_index=True)
            at = batch[key].to_numpy(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1))
            held = batch.iloc[cuts[-1] :]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (got := tile(batch.iloc[a:b])) is not None:
                    yield got
        if held is not None and (got := tile(held)) is not None:
            yield got

    out = [written(rows(turn).mapInPandas(run, "a long, b long, room long")) for turn in range(passes)]
    dropped(members)
    dropped(number)
    return out


def _links(cores: DataFrame, frequent: np.ndarray) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b, room) that connect all cores which links connect, with the room of flagged cores, and what can be dropped later."""
    hot = F.col("sig").bitwiseAND(F.lit(1)) == 1
    salt = F.when(hot, F.pmod(F.hash("id"), F.lit(SALTS))).otherwise(0)
    same = Window.partitionBy("sig", "salt")
    grouped = _signed(cores, frequent).withColumn("salt", salt).withColumns({"centre": F.min("id").over(same), "most": F.max("id").over(same)})
    # shares of a frequent signature that have one member meet through the centres
    shares = written(grouped.where((F.col("most") != F.col("centre")) | hot).select("sig", "id", "centre"))
    middles = shares.where(hot & (F.col("id") == F.col("centre"))).groupBy("sig").agg(F.min("id").alias("middle"), F.count("*").alias("n"))
    upper = shares.where(hot & (F.col("id") == F.col("centre"))).join(middles.where("n > 1"), "sig").where("id <> middle").select(F.col("middle").alias("a"), F.col("id").alias("b"))
    pairs = written(shares.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).union(upper).distinct())
    star = written(_with_centres(pairs, cores))
    dropped(pairs)
    label = components(star)

    # groups in which others than the centre, which has met all, are in several components or flagged
    told = cores.select("id", "flag", "size").join(label.withColumnRenamed("node", "id"), "id", "left").select("id", "flag", "size", F.coalesce("component", "id").alias("label"))
    rest = shares.where(hot | (F.col("id") != F.col("centre"))).select("sig", "id").join(told, "id")
    rest = written(rest)
    dropped(shares)
    per = rest.groupBy("sig", "label").agg(F.count("*").alias("n"), F.max("flag").alias("flagged"))
    opened = per.groupBy("sig").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max("flagged").alias("flagged"), F.max(F.struct("n", "label"))["label"].alias("host"))
    opened = opened.where("n > 1 AND (labels > 1 OR flagged)").select("sig", "host")
    rest_open = written(rest.join(opened, "sig"))
    dropped(rest)
    guest = (F.col("label") != F.col("host")) | F.col("flag")
    hosted = rest_open.select(F.col("host").alias("group"), "id", guest.cast("int").alias("side"), "label", "flag", "size").distinct()
    met = _tiles(hosted, cores, True)
    # the guests of a group among themselves; groups of the same guests once
    left = rest_open.where(guest)
    mark = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(38,0)")).alias(f"m{k}") for k in (0, 1)]
    alike = left.groupBy("sig").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.max("flag").alias("flagged"), *mark)
    alike = alike.where("n > 1 AND (labels > 1 OR flagged)").groupBy("m0", "m1", "n").agg(F.min("sig").alias("sig")).select("sig")
    guests = left.join(alike, "sig").select(F.col("sig").alias("group"), "id", F.lit(0).alias("side"), "label", "flag", "size")
    met += _tiles(guests, cores, False)
    return reduce(DataFrame.union, met, star), [star, *met, rest_open]


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``df``.

    ``key`` is an integer.  Rows link when 100 * intersection >= 75 * union of
    their distinct five-word shingles; component_id is the smallest key
    reachable by links.  Null, empty and wordless texts have no shingles and
    link with nothing.  Rows with a null key link with nothing, their
    component_id is null.  Rows that repeat a key with the same text stay as
    they are; a key should not come with different texts.
    """
    with small_batches(df.sparkSession):
        return _near_duplicates(df, key, text)


def _near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    bits = max(8, (2 * rows.rdd.getNumPartitions() - 1).bit_length())  # parts grow with the input, so that a part stays small
    measured = written(_measure(rows, bits))
    met = _met(measured.where("part IS NOT NULL").select("slot", "part", "load"))
    per_doc = written(measured.where("n IS NOT NULL").select("slot", "id", "n", "k1", "k2", "alone"))
    able = F.col("alone") - F.coalesce("met", F.lit(0)) <= F.floor(F.col("n") / 4)
    kept = per_doc.where("n > 0 AND id IS NOT NULL").join(met, "slot", "left")
    # identical sets are one, whose smallest id stands for it
    classes = written(kept.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max(F.coalesce(able, F.lit(False))).alias("left")))
    dropped(measured)  # its chunks are half as large as the input

    reps = classes.where("left").select(F.col("rep").alias("id"))
    total = reps.count()
    known = F.broadcast(reps) if total <= KNOWN_IDS else reps
    sets = written(_featured(rows.select(F.col("_id").alias("id"), F.col("_text").alias("text")).where("id IS NOT NULL").join(known, "id", "left_semi")))
    counted = _exploded(sets).groupBy("f").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    seen = written(counted.where((F.col("c") == 1) | (F.col("c") >= max(32, total // 1000))))
    frequent = seen.where("c > 1").orderBy(F.desc("c"), "f").limit(FREQUENT).select("f").toPandas().f.to_numpy(np.int64)
    frequent = np.sort(frequent.view(np.uint64))
    mine = seen.where("c = 1").groupBy("id").agg(F.collect_list("f").alias("mine"))  # at most a set's features
    kin = written(_kin(sets.dropDuplicates(["id"]).join(mine, "id", "left")))
    dropped(seen)
    dropped(sets)

    # of the sets that agree in all shared features, the one with the fewest of its own is the core
    least = kin.groupBy("h1", "h2").agg(F.min(F.struct("own", "id")).alias("least"), F.max("own").alias("most"))
    least = least.select("h1", "h2", F.col("least.id").alias("core"), F.col("least.own").alias("fewest"), "most")
    member = written(kin.select("id", "size", "own", "h1", "h2").join(least, ["h1", "h2"]).select("id", "core", "size", "own", "fewest", "most"))
    flags = member.where("id = core").select("id", (F.col("fewest") + F.col("most") > F.floor(F.col("size") / 3)).alias("flag"))
    cores = written(kin.select("id", "size", "own", "feats").join(flags, "id"))
    dropped(kin)
    links, spent = _links(cores, frequent)
    links = written(links.where("a <> b OR room >= 0"))
    label = components(links).withColumnRenamed("node", "core")
    room = links.groupBy("a").agg(F.max("room").alias("room")).withColumnRenamed("a", "core")
    joined = member.join(label, "core", "left").join(room, "core", "left")
    follows = (F.col("id") == F.col("core")) | (F.col("own") + F.col("fewest") <= F.floor(F.col("size") / 3)) | F.coalesce(F.col("own") <= F.col("room"), F.lit(False))
    joined = written(joined.select("id", F.when(follows, F.coalesce("component", "core")).alias("label")).where("label IS NOT NULL"))
    smallest = joined.groupBy("label").agg(F.min("id").alias("component_id"))
    node = joined.join(smallest, "label").select(F.col("id").alias("rep"), "component_id")
    for f in (*spent, cores, member):
        dropped(f)
    of_class = classes.join(node, "rep", "left").select("k1", "k2", F.coalesce("component_id", "rep").alias("component_id"))
    out = per_doc.join(of_class, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").cast(dict(df.dtypes)[key]).alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
