"""Repeated passages by a distributed suffix array (difference cover, DC3).

A byte goes if a ``width``-byte string that covers it also starts in a
document with a smaller id.  The texts are dealt to blocks of about four
megabytes; blocks meet only in ``exchange``: each sends the distinct keys it
has, dealt to buckets by range or hash, a bucket answers every key it was
sent, and the answers go back to the blocks.  No key, however frequent, is
sent more than once a block.

1. Two sieves leave what can repeat.  All windows (strings of ``width``
   bytes) are named by the smallest hash of a gram in them, so equal windows
   have equal names; neighbouring windows of one name are a run.  Runs whose
   name one document has alone end here.  Of equal runs only those of the
   smallest document go on, the others are covered by it; a name whose runs
   are all alike is settled by that.
2. What is left, stretches of text around edits and the ends of passages, is
   put together again, and cut where it is much, to blocks of about two
   megabytes.  They are sorted by DC3: the triples at positions 1 and 2 of every 3 are sorted and
   named, the names make a string of two thirds the length, on which the same
   is done again until a few names span ``width`` bytes and are sorted as
   they are.  Then the remaining third of the suffixes is merged in, level by
   level: a suffix is placed after the last sampled one that isn't larger, by
   its first symbol and the rank of the next suffix, or its first two and the
   rank of the one after those.
3. In the order of all suffixes those that share ``width`` bytes are
   neighbours: adjacent prefixes are compared, and each group of equal ones
   gets its smallest document.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, release, small_batches, table, written

WIDTH = 50
BLOCK = 1 << 22  # bytes of a block; blocks times buckets are sent, so both are as large as memory lets them
SORTED = 1 << 21  # bytes of a block of what the sieves leave
KEYS = 3 << 18  # keys of a bucket
SIEVED = 4  # times as many of the sieve's, which take five bytes
COMPARED = 2  # and of those of runs, which take some twenty
LEAST_BUCKETS = 16
CHUNK = 1 << 15  # bytes hashed at once, so that the numbers stay near the processor
ROWS_A_FILE = 4  # blocks are large rows, and readers hold many
BATCH = 16  # of them that a task is sent at once
LONGEST_RUN = 64
SAMPLED_BLOCKS, SAMPLED_KEYS = 12, 8192  # of which the cuts between buckets are made
BYTE_BITS, TRIPLE_BITS = 9, 25  # of a symbol: a byte or the end, and three of them

U = np.uint64
BASE = 0x9E3779B97F4A7C15


# -- arrays ---------------------------------------------------------------------------------------------------------


def _power(n: int) -> U:
    return U(pow(BASE, n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def grams(a: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings of ``a``, from those of halves."""
    power, have = a.astype(U) + U(1), 1
    out, done = None, 0
    while True:
        if k & have:
            if out is None:
                out = power
            else:
                n = len(a) - (done + have) + 1
                out = power[:n] * _power(done) + out[have : have + n]
            done += have
        if done == k:
            return _mixed(out)
        power = power[:-have] * _power(have) + power[have:]
        have *= 2


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    have = 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def _owners(lens: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.cumsum(lens), at, "right")


def runs(a: np.ndarray, lens: np.ndarray, usable: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, end of starts, name) of the runs of windows in texts that lie behind each other in ``a``."""
    n = len(a) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(U)
    name = np.concatenate([_least(grams(a[at : at + CHUNK + width - 1], k), width - k + 1) for at in range(0, n, CHUNK)])
    ok = _whole(lens, usable, width, n)
    first = ok.copy()
    first[1:] &= (name[1:] != name[:-1]) | ~ok[:-1]
    start = np.flatnonzero(first)
    last = np.flatnonzero(ok & ~np.append(ok[1:], False)) + 1
    if not len(start):
        return none, none, none.astype(U)
    end = np.minimum(np.append(start[1:], n), last[np.searchsorted(last, start, "right")])
    parts = -(-(end - start) // LONGEST_RUN)
    at = np.repeat(start, parts) + LONGEST_RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return at, np.minimum(at + LONGEST_RUN, np.repeat(end, parts)), _mixed(name[at])  # minima are small numbers


def _whole(lens: np.ndarray, usable: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the first n positions start a window within their text."""
    start = (np.cumsum(lens) - lens)[usable]
    some = lens[usable] >= width
    start, end = start[some], (start + lens[usable] - width + 1)[some]
    edge = np.zeros(n + 1, np.int8)
    edge[start] += 1  # no two texts start or end at one place, as each has a byte
    edge[end] -= 1
    return np.cumsum(edge[:n], dtype=np.int8).view(bool)


def contents(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches: differences of running sums of bytes times powers, brought to one place."""
    base, inverse = U(0xD6E8FEB86659FD93), U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    edges = np.append(np.flatnonzero(np.append(True, start[1:] // CHUNK != start[:-1] // CHUNK)[: len(start)]), len(start))
    several = list(zip(edges[:-1], edges[1:], strict=True)) if len(start) else []
    most = max((int(end[i:j].max() - start[i:j].min()) for i, j in several), default=0)
    up, down = np.full(most + 1, base), np.full(most + 1, inverse)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums, out = np.zeros(most + 1, U), np.empty(len(start), U)
    for i, j in several:  # a hash doesn't tell where a stretch is, so they may be taken a few at a time
        low, high = int(start[i:j].min()), int(end[i:j].max())
        np.cumsum((a[low:high].astype(U) + U(1)) * down[: high - low], out=sums[1 : high - low + 1])
        x, y = start[i:j] - low, end[i:j] - low
        out[i:j] = (sums[y] - sums[x]) * up[x] + (y - x).astype(U) * base
    return _mixed(out)


def _small(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in as few bytes as they need."""
    return x.astype(np.min_scalar_type(x.max())) if len(x) and x.dtype.kind == "u" else x


def alike(name: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`distinct` rows of names and contents in the order of contents, if those alone tell (equal ones have equal names)."""
    order, first, number = distinct([content])
    sorted_names = name[order]
    if (sorted_names == sorted_names[first][number[order]]).all():
        return order, first, number
    return distinct([name, content])


def packed(columns: list[np.ndarray], bits: list[int]) -> tuple[list[np.ndarray], int]:
    """Columns put together, in order, as long as they fit 64 bits; and how many bits the first one has."""
    out, room, first = [], 0, None
    for c, b in zip(columns, bits, strict=True):
        if out and b <= room:
            out[-1] = (out[-1] << U(b)) | c.astype(U)
            room -= b
        else:
            if len(out) == 1:
                first = 64 - room
            out.append(c.astype(U))
            room = 64 - b
    return out, first if first is not None else 64 - room


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each distinct row in it, number of the distinct row of each row), rows in their order."""
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def _sampled(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions 1 and 2 of every 3, those of a text by class; and the lengths of the strings so made, two a text."""
    shorter = np.stack(((lens + 1) // 3, lens // 3), 1).ravel()
    first = (np.cumsum(lens) - lens)[:, None] + np.array([1, 2])
    return np.repeat(first.ravel() - 3 * (np.cumsum(shorter) - shorter), shorter) + 3 * np.arange(shorter.sum()), shorter


class Strings:
    """A level's strings, one behind the other: bytes (from 1), or triples of them at sampled positions."""

    def __init__(self, s: dict, level: int):
        text, lens = np.frombuffer(s["text"] + b"\0\0", np.uint8).astype(np.int64) + 1, s["lens"]
        if level == 0:
            self.sym, self.lens, self.wide = text[:-2], lens, BYTE_BITS
        else:
            at, self.lens = _sampled(lens)
            left = np.repeat(np.repeat(np.cumsum(lens), 2), self.lens) - at
            self.sym, self.wide = (text[at] * 257 + text[at + 1] * (left > 1)) * 257 + text[at + 2] * (left > 2), TRIPLE_BITS
        self.left = np.repeat(np.cumsum(self.lens), self.lens) - np.arange(len(self.sym))
        self.at, self.shorter = _sampled(self.lens)

    def later(self, x: np.ndarray, k: int) -> np.ndarray:
        """What comes k places later in the same string, 0 past its end."""
        return _later(x, self.left, k)

    def ranks(self, s: dict) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, classes) of all positions; ranks are 0 where positions aren't sampled."""
        rank, cls = np.zeros(len(self.sym), np.int64), np.zeros(len(self.sym), np.int8)
        rank[self.at] = s["rank"]
        cls[self.at] = np.repeat(np.tile(np.array([1, 2], np.int8), len(self.lens)), self.shorter)
        return rank, cls


def _later(x: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(len(x) - k, 0)] = x[k:]
    out[left <= k] = 0
    return out


# -- blocks and buckets ---------------------------------------------------------------------------------------------


COUNTS = ("lens", "offs", "home", "rank", "place")  # of a state's arrays, those that are never negative


def _kept(state: dict) -> bytes:
    """A block's state, without what a step has only noted for itself."""
    return pickle.dumps({k: _small(v.astype(U)) if k in COUNTS else v for k, v in state.items() if k[0] != "_"}, 5)


def _state(data: bytes) -> dict:
    return {k: v.astype(np.int64) if k in COUNTS else v for k, v in pickle.loads(data).items()}


def _sent(columns: list[np.ndarray]) -> bytes:
    return pickle.dumps([_small(c) for c in columns], 5)


class Given:
    """What the buckets said: a number each, by lane and bucket."""

    def __init__(self, cuts: list[np.ndarray], numbers: list[np.ndarray]):
        self.cuts, self.numbers = cuts, numbers

    def before(self, lane: int, dealt: np.ndarray, how) -> np.ndarray:
        """The numbers of all buckets before each item's one, put together."""
        return np.concatenate(([0], how.accumulate(self.numbers[lane])))[dealt]


def _dealt(prefix: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bucket = np.searchsorted(cuts, prefix, "right")
    return np.argsort(bucket.astype(np.uint16) if len(cuts) < 1 << 16 else bucket, kind="stable"), bucket  # 16 bits are sorted by radix


TOLD = "block long, lane int, bucket int, data binary, number long"


def exchange(state: DataFrame, ask: Callable, settle: Callable, take: Callable, hashed_keys: int = 0) -> DataFrame:
    """A step in which blocks meet.

    ``ask(state)`` gives, per lane, (prefix, columns) of the keys a block has;
    ``settle(lane, columns)`` an answer for each of them and one number for
    the bucket; ``take(state, answers, buckets, given)`` the block's new
    state, after another ``ask`` that may have left notes in the old one.
    ``hashed_keys``: about how many keys there are, where prefixes are hashes
    (fewer, for larger buckets); else the cuts between buckets come from a sample of the blocks.
    The driver holds the cuts and one number a bucket (of ``KEYS`` keys).
    """
    if hashed_keys:
        cuts = [_even(hashed_keys)]
    else:
        cuts = _cuts(state, ask)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, packed in zip(batch["block"], batch["state"], strict=True):
                rows = []
                for lane, (prefix, columns) in enumerate(ask(_state(packed))):
                    order, bucket = _dealt(prefix, cuts[lane])
                    edges = np.searchsorted(bucket[order], np.arange(len(cuts[lane]) + 2))
                    for b in np.flatnonzero(np.diff(edges)):
                        at = order[edges[b] : edges[b + 1]]
                        rows.append((block, lane, int(b), _sent([c[at] for c in columns]), 0))
                if rows:
                    yield pd.DataFrame(rows, columns=["block", "lane", "bucket", "data", "number"])
            release()

    def answer(key, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [pickle.loads(d) for d in rows["data"]]
        got, number = settle(int(key[0]), [np.concatenate(c) for c in zip(*parts, strict=True)])
        ends = np.cumsum([len(p[0]) for p in parts])
        out = rows[["block", "lane", "bucket"]].copy()
        out["data"] = [_sent([x]) for x in np.split(got, ends[:-1])]
        out["number"] = number
        return out

    asked = state.mapInPandas(send, TOLD)
    told = written(asked.groupBy("lane", "bucket").applyInPandas(answer, TOLD), 0, "zstd")
    numbers = [np.zeros(len(c) + 1, np.int64) for c in cuts]
    for r in told.groupBy("lane", "bucket").agg(F.max("number").alias("n")).collect():
        numbers[r["lane"]][r["bucket"]] = r["n"]
    given = Given(cuts, numbers)

    def receive(key, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        block = _state(own["state"].iloc[0])
        answers, buckets = [], []
        for lane, (prefix, _) in enumerate(ask(block)):
            order, bucket = _dealt(prefix, cuts[lane])
            mine = rows[rows["lane"] == lane].sort_values("bucket")
            parts = [pickle.loads(d)[0] for d in mine["data"]]
            got = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            back = np.empty(len(order), np.int64)
            back[order] = got
            answers.append(back)
            buckets.append(bucket)
        out = pd.DataFrame({"block": [key[0]], "state": [_kept(take(block, answers, buckets, given))]})
        release()
        return out

    out = written(state.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(receive, "block long, state binary"), ROWS_A_FILE, "zstd")
    dropped(told)
    return out


def _even(keys: int) -> np.ndarray:
    n = max(LEAST_BUCKETS, keys // KEYS)
    return np.array([(b << 64) // n for b in range(1, n)], U)


def _cuts(state: DataFrame, ask: Callable) -> list[np.ndarray]:
    some_blocks = [r["block"] for r in state.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLED_BLOCKS).collect()]
    share = state.count() / max(1, len(some_blocks))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for packed in batch["state"]:
                for lane, (prefix, _) in enumerate(ask(_state(packed))):
                    some = np.sort(prefix)[:: max(1, len(prefix) // SAMPLED_KEYS)]
                    rows.append((lane, len(prefix), some.tobytes()))
            yield pd.DataFrame(rows, columns=["lane", "n", "some"])

    rows = state.where(F.col("block").isin(some_blocks)).mapInPandas(probe, "lane int, n long, some binary").collect()
    out = []
    for lane in range(1 + max((r["lane"] for r in rows), default=0)):
        mine = [r for r in rows if r["lane"] == lane]
        n = max(LEAST_BUCKETS, int(share * sum(r["n"] for r in mine)) // KEYS)
        seen = np.sort(np.concatenate([np.zeros(0, U), *(np.frombuffer(r["some"], U) for r in mine)]))
        out.append(np.unique(seen[(np.arange(1, n) * len(seen)) // n]) if len(seen) else seen)
    return out


def blocks(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(block, whole, piece, state): texts of about BLOCK bytes together, longer ones in overlapping pieces."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, ids, known, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row(whole: int = -1, piece: int = 0) -> pd.DataFrame:
            nonlocal block, ids, known, texts, size
            state = {"homes": np.array([block]), "ids": np.array(ids, np.int64), "known": np.array(known, bool), "lens": np.array([len(t) for t in texts], np.int64), "text": b"".join(texts)}
            out = pd.DataFrame({"block": [block], "whole": [whole], "piece": [piece], "state": [_kept(state)]})
            block, ids, known, texts, size = block + 1, [], [], [], 0
            return out

        for batch in batches:
            for i, null, t in zip(batch["id"], batch["none"], batch["text"], strict=True):
                if texts and size + len(t) > BLOCK:
                    yield row()
                if len(t) <= BLOCK:
                    ids.append(i)
                    known.append(not null)
                    texts.append(bytes(t))
                    size += len(t) + 64
                    continue
                whole = block
                for piece, at in enumerate(range(0, len(t), BLOCK)):
                    ids, known, texts = [i], [not null], [bytes(t[at : at + BLOCK + width - 1])]
                    yield row(whole, piece)
        if texts:
            yield row()

    own = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.col(key).isNull().alias("none"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    return written(own.mapInPandas(make, "block long, whole long, piece int, state binary"), ROWS_A_FILE, "zstd")


# -- the sieves -----------------------------------------------------------------------------------------------------


def _sieve(width: int, k: int):
    """Runs whose name two documents have: a text of them, and where it was."""

    def own(s: dict):
        a = np.frombuffer(s["text"], np.uint8)
        start, end, name = runs(a, s["lens"], s["known"], width, k)
        ids = s["ids"][_owners(s["lens"], start)]
        order, first, number = distinct([name])
        of = ids[order]
        several = np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first) if len(first) else np.zeros(0, bool)
        return start, end, name[order][first], several, number

    def ask(s: dict):
        s["_own"] = start, end, name, several, back = own(s)
        return [(name, [name.astype(np.uint32), several])]

    def settle(_, columns):
        _, number, count = np.unique(columns[0], return_inverse=True, return_counts=True)
        met = count >= 2
        met[number[columns[1]]] = True
        return met[number].astype(np.uint8), 0

    def take(s: dict, answers, buckets, given):
        start, end, _, _, back = s["_own"]
        live = answers[0][back].astype(bool) if len(start) else np.zeros(0, bool)
        nothing = np.zeros(len(s["lens"]), np.int64)
        out = _cut(s | {"offs": np.cumsum(s["lens"]) - s["lens"], "home": nothing}, start[live], end[live], width)
        return out | {"homes": s["homes"], "gone": np.zeros((0, 3), np.int64)}

    return ask, settle, take


def _cut(s: dict, start: np.ndarray, end: np.ndarray, width: int) -> dict:
    """The stretches of text that runs of windows need, those of neighbouring runs together, and where they were in their first blocks."""
    a, lens = np.frombuffer(s["text"], np.uint8), s["lens"]
    owner = _owners(lens, start)
    new = np.append(True, (start[1:] != end[:-1]) | (owner[1:] != owner[:-1]))[: len(start)]
    lo, hi = start[new], end[np.append(new[1:], True)[: len(end)]] + width - 1
    owner = owner[new]
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return {"text": a[at].tobytes(), "lens": size, "ids": s["ids"][owner], "offs": lo - (np.cumsum(lens) - lens)[owner] + s["offs"][owner], "home": s["home"][owner]}


def _places(s: dict, at: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Positions in a state's texts as rows of positions in their first blocks, and the number of that block."""
    owner = _owners(s["lens"], at)
    shift = s["offs"][owner] - (np.cumsum(s["lens"]) - s["lens"])[owner]
    return np.stack((*(x + shift for x in (at, *more)), s["home"][owner]), 1)


def _joined(gone: np.ndarray) -> np.ndarray:
    """Intervals (start, end, block) in order, those that touch as one."""
    gone = gone[np.lexsort((gone[:, 0], gone[:, 2]))]
    new = np.append(True, (gone[1:, 2] != gone[:-1, 2]) | (gone[1:, 0] > gone[:-1, 1]))[: len(gone)]
    first = np.flatnonzero(new)
    return np.stack((gone[first, 0], np.maximum.reduceat(gone[:, 1], first), gone[first, 2]), 1) if len(first) else gone


def _variants(width: int, k: int):
    """Which runs the smallest document has too, and which stay to be sorted."""

    def own(s: dict):
        a = np.frombuffer(s["text"], np.uint8)
        start, end, name = runs(a, s["lens"], np.ones(len(s["lens"]), bool), width, k)
        content = contents(a, start, end + width - 1)
        order, first, number = alike(name, content)
        ids = s["ids"][_owners(s["lens"], start)]
        least = np.minimum.reduceat(ids[order], first) if len(first) else ids
        return a, start, end, ids, name[order][first], content[order][first], least, number

    def ask(s: dict):
        s["_own"] = own(s)
        _, _, _, _, name, content, least, _ = s["_own"]
        return [(name, [name.astype(np.uint32), content, least])]

    def settle(_, columns):
        name, content, least = columns
        number_of_content = alike(name, content)[2].astype(U)  # fewer bits than a hash has
        order, first, number = distinct([(name.astype(U) << U(32)) | number_of_content])
        by_content = np.minimum.reduceat(least[order], first)
        heads = name[order][first]
        new = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(heads))))
        mixed = (np.minimum.reduceat(by_content, new) < np.maximum.reduceat(by_content, new))[group]
        return ((least == by_content[number]) + 2 * mixed[number]).astype(np.uint8), 0

    def take(s: dict, answers, buckets, given):
        _, start, end, ids, _, _, least, number = s["_own"]
        said = answers[0][number] if len(start) else np.zeros(0, np.uint8)
        mine = (said & 1).astype(bool) & (ids == least[number]) if len(start) else np.zeros(0, bool)
        sort = mine & (said >= 2)
        return _cut(s, start[sort], end[sort], width) | {"homes": s["homes"], "gone": _joined(np.concatenate((s["gone"], _places(s, start, end)[~mine])))}

    return ask, settle, take


def packed_again(state: DataFrame, width: int) -> DataFrame:
    """The same stretches in blocks of about ``SORTED`` bytes each: few blocks send few messages, and none needs much memory."""
    n = max(int(state.agg(F.sum(F.octet_length("state"))).first()[0] or 0) // SORTED, state.sparkSession.sparkContext.defaultParallelism)

    def cut(s: dict) -> list[dict]:
        """Stretches of at most ``SORTED`` windows, and blocks of at most about as many bytes."""
        windows = s["lens"] - width + 1
        parts = -(-windows // SORTED)
        of = np.repeat(np.arange(len(parts)), parts)
        first = SORTED * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.minimum(windows[of] - first, SORTED) + width - 1
        at = (np.cumsum(s["lens"]) - s["lens"])[of] + first
        edges = np.append(np.flatnonzero(np.append(True, np.diff(np.cumsum(size) // SORTED) > 0)[: len(size)]), len(size)) if len(size) else np.array([0, 0])
        out = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            text = b"".join(s["text"][x : x + y] for x, y in zip(at[i:j].tolist(), size[i:j].tolist(), strict=True))
            out.append({"text": text, "lens": size[i:j], "ids": s["ids"][of[i:j]], "offs": s["offs"][of[i:j]] + first[i:j], "home": s["home"][of[i:j]], "homes": s["homes"], "gone": s["gone"][: 0 if out else None]})
        return out

    def together(parts: list[dict]) -> dict:
        out = {"text": b"".join(p["text"] for p in parts)} | {k: np.concatenate([p[k] for p in parts]) for k in ("lens", "ids", "offs", "homes")}
        before = np.cumsum([0, *(len(p["homes"]) for p in parts)])
        out["home"] = np.concatenate([p["home"] + n for p, n in zip(parts, before, strict=False)])
        out["gone"] = np.concatenate([p["gone"] + [0, 0, n] for p, n in zip(parts, before, strict=False)])
        return out

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for packed in batch["state"]:
                for part in cut(_state(packed)):
                    if held and size + len(part["text"]) > SORTED * 3 // 2:
                        yield pd.DataFrame({"block": [block], "state": [_kept(together(held))]})
                        block, held, size = block + 1, [], 0
                    held.append(part)
                    size += len(part["text"])
        if held:
            yield pd.DataFrame({"block": [block], "state": [_kept(together(held))]})
        release()

    return written(state.repartition(n).mapInPandas(pack, "block long, state binary"), ROWS_A_FILE, "zstd")


# -- the suffix array -----------------------------------------------------------------------------------------------


def _named(columns: Callable):
    """Ranks, from 1, of the distinct rows of the packed ``columns(state)``; ``bits`` is what the number of ranks takes."""

    def ask(s: dict):
        c, first_bits = columns(s)
        order, first, s["_number"] = distinct(c)
        c = [x[order][first] for x in c]
        return [(c[0] << U(64 - first_bits), c)]

    def settle(_, c):
        _, first, number = distinct(c)
        return number.astype(np.uint32), len(first)

    def take(s: dict, answers, buckets, given):
        ranks = answers[0] + given.before(0, buckets[0], np.add) + 1
        n = int(given.numbers[0].sum())
        return {k: v for k, v in s.items() if k != "place"} | {"rank": ranks[s["_number"]], "bits": max(n.bit_length(), 1)}

    return ask, settle, take


def _placed(level: int):
    """Of each suffix that isn't sampled, the rank of the last sampled one that isn't larger."""

    def ask(s: dict):
        own = Strings(s, level)
        rank, cls = own.ranks(s)
        out, s["_lanes"] = [], []
        for heads, step, rows in (([own.sym], 1, cls < 2), ([own.sym, own.later(own.sym, 1)], 2, cls != 1)):
            c, first_bits = packed([*(x[rows] for x in heads), own.later(rank, step)[rows]], [own.wide] * step + [s["bits"]])
            order, first, number = distinct(c)
            c = [x[order][first] for x in c]
            most = np.maximum.reduceat(rank[rows][order], first) if len(first) else rank[:0]
            out.append((c[0] << U(64 - first_bits), [*c, most.astype(U)]))
            s["_lanes"].append(number[cls[rows] == 0])
        return out

    def settle(_, columns):
        *c, most = columns
        order, first, number = distinct(c)
        return np.maximum.accumulate(np.maximum.reduceat(most[order], first))[number], int(most.max())

    def take(s: dict, answers, buckets, given):
        got = [np.maximum(answers[n], given.before(n, buckets[n], np.maximum))[s["_lanes"][n]] for n in range(2)]
        return s | {"place": np.maximum(*got)}

    return ask, settle, take


def _order(s: dict, level: int) -> tuple[list[np.ndarray], int]:
    """Packed columns by which all suffixes of a level are in order: sampled ones by rank, the others behind their places."""
    own = Strings(s, level)
    place, cls = own.ranks(s)
    following = own.later(place, 1)
    rest = cls == 0
    place[rest] = s["place"]
    return packed([place, rest, np.where(rest, own.sym, 0), np.where(rest, following, 0)], [s["bits"], 1, own.wide, s["bits"]])


def suffix_order(state: DataFrame, width: int) -> DataFrame:
    """States with ``place`` and ``rank``, by which :func:`_order` puts all suffixes in the order of their first ``width`` bytes at least."""
    names = -(-width // 9)  # a name spans nine bytes

    def triples(s: dict):
        own = Strings(s, 1)
        return packed([own.later(own.sym, k)[own.at] for k in range(3)], [TRIPLE_BITS] * 3)

    def tuples(s: dict):
        shorter = _sampled(_sampled(s["lens"])[1])[1]
        left = np.repeat(np.cumsum(shorter), shorter) - np.arange(len(s["rank"]))
        return packed([_later(s["rank"], left, k) for k in range(names)], [s["bits"]] * names)

    steps = [
        _named(triples),  # names of nine bytes
        _named(tuples),  # ranks of the shortest strings' suffixes
        _placed(1),
        _named(lambda s: _order(s, 1)),  # of the suffixes of the strings of triples
        _placed(0),
    ]
    for step in steps:
        after = exchange(state, *step)
        dropped(state)
        state = after
    return state


def smaller(state: DataFrame, width: int) -> DataFrame:
    """(block, gone): starts of windows that a smaller document has, by comparing neighbours in the order of suffixes."""

    def ask(s: dict):
        text, lens = np.frombuffer(s["text"], np.uint8), s["lens"]
        at = np.flatnonzero(_whole(lens, np.ones(len(lens), bool), width, len(text)))
        c, first_bits = _order(s, 0)
        c = [x[at] for x in c]
        ids = s["ids"][_owners(lens, at)]
        order, first, number = distinct(c)
        least = np.minimum.reduceat(ids[order], first) if len(first) else ids
        some = at[order][first]
        s["_own"] = at, ids, number
        c = [x[order][first] for x in c]
        return [(c[0] << U(64 - first_bits), [*c, least, np.lib.stride_tricks.sliding_window_view(text, width)[some] if len(some) else np.zeros((0, width), np.uint8)])]

    cuts = _cuts(state, ask)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, packed in zip(batch["block"], batch["state"], strict=True):
                prefix, columns = ask(_state(packed))[0]
                order, bucket = _dealt(prefix, cuts[0])
                edges = np.searchsorted(bucket[order], np.arange(len(cuts[0]) + 2))
                rows = [(block, int(b), pickle.dumps([c[order[edges[b] : edges[b + 1]]] for c in columns], 5)) for b in np.flatnonzero(np.diff(edges))]
                if rows:
                    yield pd.DataFrame(rows, columns=["block", "bucket", "data"])
            release()

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [pickle.loads(d) for d in rows["data"]]
        *c, least, head = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = distinct(c)[0]
        new = np.append(True, (head[order[1:]] != head[order[:-1]]).any(1))  # adjacent prefixes
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        low = np.minimum.reduceat(least[order], np.flatnonzero(new))
        # groups at a bucket's ends may go on in the next ones
        answers = np.stack((low[group], group == 0, group == len(low) - 1), 1)
        out = rows[["block", "bucket"]].copy()
        out["data"] = [pickle.dumps(x, 5) for x in np.split(answers, np.cumsum([len(p[0]) for p in parts])[:-1])]
        out["head"], out["low"] = None, 0
        ends = [(order[0], low[0], -1), (order[-1], low[-1], -2)]
        return pd.concat([out, pd.DataFrame([(e, key[0], None, head[at].tobytes(), int(m)) for at, m, e in ends], columns=out.columns)])

    told = written(state.mapInPandas(send, "block long, bucket int, data binary").groupBy("bucket").applyInPandas(compare, "block long, bucket int, data binary, head binary, low long"))
    ends = told.where("block < 0")
    whole = ends.groupBy("head").agg(F.min("low").alias("whole"))
    ends = ends.join(whole, "head").groupBy("bucket").agg(F.min(F.expr("CASE WHEN block = -1 THEN whole END")).alias("first"), F.min(F.expr("CASE WHEN block = -2 THEN whole END")).alias("last"))
    rows = told.where("block >= 0").select("block", "bucket", "data").join(ends, "bucket")

    def receive(key, own_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        s = _state(own_rows["state"].iloc[0])
        gone = s["gone"]
        if len(rows):
            prefix, _ = ask(s)[0]
            at, ids, number = s["_own"]
            order, _ = _dealt(prefix, cuts[0])
            parts = []
            for d, first, last in rows.sort_values("bucket")[["data", "first", "last"]].itertuples(index=False):
                x = pickle.loads(d)
                low = np.where(x[:, 1] > 0, np.minimum(x[:, 0], first), x[:, 0])
                parts.append(np.where(x[:, 2] > 0, np.minimum(low, last), low))
            low = np.empty(len(order), np.int64)
            low[order] = np.concatenate(parts)
            hit = at[low[number] < ids]
            gone = _joined(np.concatenate((gone, _places(s, hit, hit + 1))))
        release()
        return pd.DataFrame({"block": s["homes"], "gone": [gone[gone[:, 2] == n, :2].tobytes() for n in range(len(s["homes"]))]})

    return written(state.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(receive, "block long, gone binary"), ROWS_A_FILE, "zstd")


def _removed(n: int, gone: np.ndarray, width: int) -> np.ndarray:
    """Mask of the bytes that intervals of window starts cover."""
    edge = np.bincount(gone[:, 0], minlength=n + 1)[: n + 1] - np.bincount(np.minimum(gone[:, 1] + width - 1, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def _row(key, text: bytes, mask: np.ndarray) -> tuple:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return key, len(text), int(mask.sum()), [{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)], np.frombuffer(text, np.uint8)[~mask].tobytes()


FIELDS = "n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"


def _gone(all_blocks: DataFrame, width: int) -> DataFrame:
    """(block, gone): starts of the windows of a block that a smaller document has."""
    k, n = (width + 1) // 2, all_blocks.count()
    live = exchange(all_blocks.select("block", "state"), *_sieve(width, k), hashed_keys=max(1, int(n * BLOCK * 2 / (width - k + 2) / SIEVED)))
    for k in (width * 7 // 8, width - 2):  # the second on what the first leaves
        after = exchange(live, *_variants(width, k), hashed_keys=max(1, int(n * BLOCK * 0.04 / COMPARED)))
        dropped(live)
        live = after
    again = packed_again(live, width)
    dropped(live)
    state = suffix_order(again, width)
    gone = smaller(state, width)
    dropped(state)
    return gone


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept): each text without what a document of smaller key has, too.

    ``spans`` are the maximal removed stretches (byte offsets, start and end),
    ``kept`` the remaining bytes.  ``key`` is an integer.  One row a row: a
    null text is an empty one; rows with a null key neither lose bytes nor
    take any from others; rows of the same key take nothing from each other,
    so the same string twice within a document stays.  Texts shorter than
    ``width`` stay.  Equal runs of text are told by more than 100 bits of
    hashes, everything that is sorted by its bytes.
    """
    if width < 16:
        raise ValueError("width: at least 16 bytes")
    kind = dict(docs.dtypes)[key]
    with small_batches(docs.sparkSession):
        all_blocks = blocks(docs, key, text, width)
    with small_batches(docs.sparkSession, BATCH):
        gone = _gone(all_blocks, width)

    def finish(_, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(own):  # a block of the other kind
            return pd.DataFrame(columns=["whole", "piece", "key", "n_bytes", "n_removed", "spans", "kept"])
        s = _state(own["state"].iloc[0])
        cut = np.frombuffer(b"".join(rows["gone"]), np.int64).reshape(-1, 2)  # what was left of a block may have gone to several
        whole, piece = int(own["whole"].iloc[0]), int(own["piece"].iloc[0])
        mask = _removed(len(s["text"]), cut, width)
        out, at = [], 0
        lost = np.diff(np.concatenate(([0], np.cumsum(mask)))[np.concatenate(([0], np.cumsum(s["lens"])))])
        for i, known, n, some in zip(s["ids"].tolist(), s["known"], s["lens"].tolist(), lost.tolist(), strict=True):
            mine = mask[at : at + n]
            if whole < 0 and not some:
                out.append((-1, 0, i if known else None, n, 0, [], s["text"][at : at + n]))
            elif whole < 0:
                out.append((-1, 0, *_row(i if known else None, s["text"][at : at + n], mine)))
            else:  # the stretches of a piece, with those of the others later
                key, size, gone_, where, _ = _row(i if known else None, s["text"], mine)
                out.append((whole, piece, key, size, gone_, where, s["text"]))
            at += n
        made = pd.DataFrame(out, columns=["whole", "piece", "key", "n_bytes", "n_removed", "spans", "kept"])
        made["key"] = pd.array([r[2] for r in out], "Int64")
        return made

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        text = b"".join(t[:BLOCK] for t in rows["kept"])
        mask = np.zeros(len(text), bool)
        for piece, where in zip(rows["piece"], rows["spans"], strict=True):
            for x in where:
                mask[piece * BLOCK + x["start"] : piece * BLOCK + x["end"]] = True
        key = rows["key"].iloc[0]
        made = pd.DataFrame([_row(key, text, mask)], columns=["key", "n_bytes", "n_removed", "spans", "kept"])
        made["key"] = pd.array([None if pd.isna(key) else int(key)], "Int64")
        return made

    def told(some: str) -> DataFrame:
        return all_blocks.where(some).groupBy("block").cogroup(gone.groupBy("block")).applyInPandas(finish, f"whole long, piece int, key long, {FIELDS}")

    short = told("whole < 0").select("key", "n_bytes", "n_removed", "spans", "kept")
    long = told("whole >= 0").groupBy("whole").applyInPandas(join, f"key long, {FIELDS}")
    return short.union(long).select(F.col("key").cast(kind).alias(key), "n_bytes", "n_removed", "spans", "kept")


def op12_suffix_array(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
