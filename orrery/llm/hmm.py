"""A hidden Markov language model: trained by Baum-Welch, scored by the exact forward recursion.

A latent state emits a word class; the class is a fixed function of the word
(short words whole, longer ones by their ending), and a class emits its words
with add-one smoothed shares.  So the model's tables are bounded (states x
classes) while the word counts it rests on stay distributed.

1. ``encode`` packs documents into blocks of a bounded size, each with a
   dictionary of its own, and writes them to the shared folder.
2. Word counts are summed over the blocks' dictionaries and joined back to
   them: one row per block and distinct word moves, not one per token.
3. Each Baum-Welch round is one map over the blocks; tasks return expected
   counts, summed by a combining aggregate.  Long documents are cut into
   segments whose transfer matrices are multiplied, which is exact and lets
   all segments advance together.
4. A last map computes each document's likelihood.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, no_collections, remainder, table, written

END = "\n"  # no word has white space
STATES = 8
CLASSES = 2048
ROUNDS = 4
BLOCK_BYTES = 4_000_000  # text in a block; one longer document is a block of its own
COMMON_WORDS = 100_000  # words (64 bytes at most each) of many blocks whose counts all executors get; the rest are joined by a shuffle
SEGMENT = 512  # tokens; shorter ones mean more transfer matrices, longer ones fewer sequences at a time
_TRIM = b".,;:!?\"'()"


def word_class(w: bytes) -> int:
    """0 is the end; the rest are split between short words and endings."""
    if w == b"\n":
        return 0
    core = w.rstrip(_TRIM) or w
    tail = w[len(core) : len(core) + 1]
    half = CLASSES // 2
    if len(core) <= 4:
        return 1 + zlib.crc32(core + b"|" + tail) % (half - 1)
    return half + zlib.crc32(core[-3:] + b"|" + tail) % half


def packed(ids: np.ndarray) -> bytes:
    """Small integers, byte by byte of their digits, compressed."""
    return zlib.compress(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


class _Ids(dict):
    """Gives each new word the next id."""

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        return n


def encode(df: DataFrame, key: str, text: str, held_out: str) -> DataFrame:
    """Blocks of documents: ids and lengths of their token sequences, and the dictionary with training counts and classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[bool] = []
        ids: list[np.ndarray] = []
        vocab = _Ids({b"\n": 0})
        size = 0

        def block():
            lengths = np.array([len(x) for x in ids], np.int32)
            tokens, ws = np.concatenate(ids), list(vocab)
            # frequent words get small ids, whose bytes pack well
            order = np.argsort(-np.bincount(tokens, minlength=len(ws)), kind="stable")
            place = np.empty(len(ws), np.int32)
            place[order] = np.arange(len(ws))
            tokens, ws = place[tokens], [ws[i] for i in order]
            trained = tokens[np.repeat(~np.array(held, bool), lengths)]
            return pd.DataFrame({
                "block": [(part << 32) + made], "docs": [docs], "held": [np.array(held, np.uint8).tobytes()], "lengths": [lengths.tobytes()], "ids": [packed(tokens)],
                "words": [[w.decode("utf-8", "surrogatepass") for w in ws]], "counts": [np.bincount(trained, minlength=len(ws)).astype(np.int32)],
                "classes": [np.array([word_class(w) for w in ws], np.int16)],
            })

        for batch in batches:
            with no_collections():
                for d, t, h in zip(batch["_key"], batch["_text"], batch["_held"], strict=True):
                    raw = t.encode("utf-8", "surrogatepass").lower() if t else b""
                    if docs and size + len(raw) > BLOCK_BYTES:
                        yield block()
                        made += 1
                        docs, held, ids, vocab, size = [], [], [], _Ids({b"\n": 0}), 0
                    size += len(raw) + 16
                    ids.append(np.array([*map(vocab.__getitem__, raw.split()), 0], np.int32))
                    docs.append(None if pd.isna(d) else int(d))
                    held.append(bool(h))
        if docs:
            yield block()

    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), F.col(held_out).alias("_held"))
    return rows.mapInPandas(run, "block long, docs array<long>, held binary, lengths binary, ids binary, words array<string>, counts array<int>, classes array<short>")


class Params:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # K, K x K, K x C

    @classmethod
    def first(cls, class_counts: np.ndarray, seed: int = 7) -> Params:
        rng = np.random.default_rng(seed)
        emit = (class_counts + 1.0) * np.exp(rng.normal(0, 0.7, (STATES, CLASSES)))
        move = np.full((STATES, STATES), 0.05 / (STATES - 1))
        np.fill_diagonal(move, 0.95)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def of_counts(cls, c: np.ndarray) -> Params:
        k = STATES
        start, move, emit = c[:k] + 0.1, c[k : k + k * k].reshape(k, k) + 0.1, c[k + k * k :].reshape(k, CLASSES) + 0.01
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


class Sweep:
    """Forward (and backward) messages of many sequences at once.

    ``tokens``: classes of all sequences, one after the other; ``lengths``: theirs.
    """

    def __init__(self, params: Params, tokens: np.ndarray, lengths: np.ndarray, kind=np.float64):
        self.move, self.start = params.move.astype(kind), params.start.astype(kind)
        self.emit = np.ascontiguousarray(params.emit.T.astype(kind))
        self.tokens, self.kind = tokens, kind
        n_seg = -(-lengths // SEGMENT)
        self.seq = np.repeat(np.arange(len(lengths)), n_seg)
        number = np.arange(len(self.seq)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        begin = np.repeat(np.cumsum(lengths) - lengths, n_seg) + number * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(lengths, n_seg) - number * SEGMENT)
        order = np.argsort(-size, kind="stable")  # those still running at a step are a prefix
        self.at = np.empty(len(order), np.int64)  # where a segment went
        self.at[order] = np.arange(len(order))
        self.seq, self.number, self.begin, self.size = self.seq[order], number[order], begin[order], size[order]
        self.running = [int(np.searchsorted(-self.size, -t, side="left")) for t in range(SEGMENT)]  # of a size above t
        self.n_seg, self.head = n_seg, np.cumsum(n_seg) - n_seg  # a sequence's first segment, before the sorting
        self.pred = np.tile(self.start, (len(order), 1))  # state distribution ahead of a segment's first token
        self.beyond = np.full((len(order), len(self.start)), 1.0, kind)  # backward message after its last token
        self.cross = None
        if (n_seg > 1).any():
            self._chain()

    def _obs(self, t: int, n: int) -> np.ndarray:
        return self.emit[self.tokens[self.begin[:n] + t]]

    def _chain(self) -> None:
        """Messages at the borders of segments, from products of their transfer matrices."""
        k = len(self.start)
        long = np.flatnonzero(self.n_seg[self.seq] > 1)  # in the sorted order, so still a prefix at each step
        begin, size = self.begin[long], self.size[long]
        m = np.zeros((len(long), k, k), self.kind)
        log = np.zeros(len(long))
        for t in range(SEGMENT):
            n = int(np.searchsorted(-size, -t, side="left"))
            if not n:
                break
            e = self.emit[self.tokens[begin[:n] + t]]
            if t == 0:
                m[:n, np.arange(k), np.arange(k)] = e
            else:
                m[:n] = (m[:n].reshape(n * k, k) @ self.move).reshape(n, k, k) * e[:, None, :]
            if t % 4 == 3:
                top = m[:n].max(axis=(1, 2))
                m[:n] /= top[:, None, None]
                log[:n] += np.log(top)
        place = np.full(len(self.seq), -1)
        place[long] = np.arange(len(long))
        self.out = np.zeros((len(self.seq), k), self.kind)
        longest = int(self.n_seg.max())
        for j in range(longest - 1):  # forwards over the borders
            whose = np.flatnonzero(self.n_seg > j + 1)
            here, there = self.at[self.head[whose] + j], self.at[self.head[whose] + j + 1]
            out = np.einsum("ni,nij->nj", self.pred[here], m[place[here]])
            self.out[here] = out / out.sum(axis=1, keepdims=True)
            self.pred[there] = self.out[here] @ self.move
        self.cross = np.zeros((k, k))
        for j in range(longest - 1, 0, -1):  # backwards
            whose = np.flatnonzero(self.n_seg > j)
            there, here = self.at[self.head[whose] + j], self.at[self.head[whose] + j - 1]
            g = np.einsum("nij,nj->ni", m[place[there]], self.beyond[there])
            g /= g.sum(axis=1, keepdims=True)
            back = g @ self.move.T
            weight = 1 / (self.out[here] * back).sum(axis=1, keepdims=True)
            self.cross += (self.out[here] * weight).T.astype(float) @ g.astype(float)
            self.beyond[here] = back / back.sum(axis=1, keepdims=True)

    def log_likelihood(self, keep: bool = False) -> np.ndarray:
        """Natural log-likelihood of each sequence; ``keep`` stores the scaled forward messages."""
        total = np.zeros(len(self.seq))
        pred, self.fore = self.pred, []
        for t in range(SEGMENT):
            n = self.running[t]
            if not n:
                break
            a = pred[:n] * self._obs(t, n)
            scale = a.sum(axis=1)
            a /= scale[:, None]
            total[:n] += np.log(scale)
            if keep:
                self.fore.append(a)
            pred = a @ self.move
        return np.bincount(self.seq, total, len(self.n_seg))

    def counts(self) -> np.ndarray:
        """Expected starts, moves and emissions, in one array."""
        k = len(self.start)
        self.log_likelihood(keep=True)
        moves = np.zeros((k, k)) if self.cross is None else self.cross.copy()
        shares, classes = [], []
        starts = np.zeros(k)
        ahead = None  # emission times backward message of the step after
        for t in reversed(range(len(self.fore))):
            n, a = self.running[t], self.fore[t]
            b = self.beyond[:n].copy()
            if ahead is not None:
                m = len(ahead)
                b[:m] = ahead @ self.move.T
                weight = 1 / (a[:m] * b[:m]).sum(axis=1, keepdims=True)
                moves += ((a[:m] * weight).T @ ahead).astype(float)
                b[:m] /= b[:m].sum(axis=1, keepdims=True)
            g = a * b
            g /= g.sum(axis=1, keepdims=True)
            shares.append(g)
            classes.append(self.tokens[self.begin[:n] + t])
            if t == 0:
                starts = g[self.number == 0].sum(axis=0, dtype=float)
            self.fore[t] = None
            ahead = self._obs(t, n) * b
        g, c = np.concatenate(shares), np.concatenate(classes)
        emits = np.stack([np.bincount(c, g[:, i], CLASSES) for i in range(k)])
        return np.concatenate((starts, (moves * self.move).ravel(), emits.ravel()))


def _tokens(row, train_only: bool) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.frombuffer(row.lengths, np.int32).astype(np.int64)
    classes = np.asarray(row.classes, np.int32)[unpacked(row.ids)]
    if train_only:
        keep = np.frombuffer(row.held, np.uint8) == 0
        return classes[np.repeat(keep, lengths)], lengths[keep]
    return classes, lengths


def train(blocks: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS) -> Params:
    """Baum-Welch over all training documents of the blocks."""
    spark = blocks.sparkSession
    params = Params.first(class_counts)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(params)  # states x classes, whatever the data

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total = 0.0
            for batch in batches:
                for row in batch.itertuples():
                    tokens, lengths = _tokens(row, True)
                    if len(lengths):
                        total = total + Sweep(shared.value, tokens, lengths, np.float32).counts()
            if np.ndim(total):
                at = np.flatnonzero(total)
                yield pd.DataFrame({"at": at.astype(np.int32), "n": total[at]})

        sums = blocks.select("ids", "lengths", "held", "classes").mapInPandas(run, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(STATES + STATES**2 + STATES * CLASSES)
        counts[sums["at"].to_numpy(int)] = sums["n"]
        shared.unpersist()
        if not len(sums):
            break
        params = Params.of_counts(counts)
    return params


def language_model_scores(df: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: (key, held_out, n_tokens, n_known, train_tokens, base_score, score).

    ``held_out`` is a boolean column: rows where it is true are scored, not
    learned from (null counts as false).  ``key`` is an integer or null.  Null
    and empty texts are the end token alone.  Repeated rows count and score
    each.  Without training rows every count is 0 and the model stays as
    initialised.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.coalesce(held_out, F.lit(False)).alias("h"))
    blocks = written(encode(rows, "k", "t", "h"), rows_a_file=8)
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts", "classes"))).select("block", "pos", "col.*")
    trained = entries.where("counts > 0").groupBy("words").agg(F.sum("counts").alias("c"), F.first("classes").alias("class"), F.count("*").alias("blocks"))
    trained = written(trained)
    by_class = trained.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()  # CLASSES rows at most
    sizes = np.zeros((2, CLASSES))
    sizes[:, by_class["class"].to_numpy(int)] = by_class[["n", "v"]].to_numpy().T
    total, distinct = int(sizes[0].sum()), int(sizes[1].sum())
    params = train(blocks, sizes[0])
    shared = df.sparkSession.sparkContext.broadcast((params, sizes))
    # common words are many blocks' rows: they don't meet in one task
    common = F.broadcast(trained.where("blocks >= 32 AND octet_length(words) <= 64").orderBy(F.desc("blocks"), "words").limit(COMMON_WORDS).select("words", "c"))
    pairs = entries.select("block", "pos", "words", "counts")
    rare = pairs.join(common, "words", "left_anti").join(trained.select("words", "c"), "words")
    # a word of one block only has its whole count there
    known = pairs.join(common, "words").unionByName(rare).where("c <> counts").select(F.col("block").alias("of"), "pos", "c")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        model, (n, v) = shared.value
        for row in left.itertuples():
            ids = unpacked(row.ids)
            classes = np.asarray(row.classes, np.int32)
            tokens, lengths = _tokens(row, False)
            c = np.array(row.counts, float)
            c[right["pos"].to_numpy(int)] = right["c"]
            base = np.log10((c + 1) / (total + (distinct + 1)))
            inner = np.log10((c + 1) / (n[classes] + v[classes] + 1))
            whose = np.repeat(np.arange(len(lengths)), lengths)
            fore = Sweep(model, tokens, lengths).log_likelihood() / np.log(10)
            sums = lambda x: np.bincount(whose, x[ids], len(lengths))
            out.append(pd.DataFrame({
                "k": pd.array(list(row.docs), "Int64"), "held_out": np.frombuffer(row.held, np.uint8) == 1, "n_tokens": lengths, "n_known": sums((c > 0).astype(float)).astype(np.int64),
                "train_tokens": total, "base_score": sums(base), "score": fore + sums(inner),
            }))
        return pd.concat(out) if out else pd.DataFrame({x: [] for x in ("k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    rest = blocks.select("block", "docs", "held", "lengths", "ids", "counts", "classes")
    scored = rest.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(run, "k long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("k", F.col("k").cast(dict(df.dtypes)[key])).withColumnRenamed("k", key)


def op1_hidden_markov(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)
