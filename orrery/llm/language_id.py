"""Language identification by segmentation-marginalised unigrams.

A word's likelihood in a language is the sum over *all* its segmentations
into pieces of a fixed public vocabulary (plus single bytes) of the product of
the language's piece probabilities; a forward pass sums them.  The piece
probabilities are expected piece counts (forward-backward from equal
probabilities) over the words of all training documents.

Words are computed in bulk: one numpy pass finds every piece in a buffer of
distinct words, and one step per offset moves all words' lattices on.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_collections, remainder, table, words

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
SCALE = 300.0  # keeps the products of words of BULK bytes in the range of doubles
BULK = 60  # bytes of a word that the bulk passes take; longer ones go singly, rescaled
MEMO = 60_000  # words remembered by a worker (some 15 MB)
HELD = 100_000  # distinct words that a training task gathers before it counts their pieces
PASS = 100_000  # words of texts scored at once; one longer text goes alone
CHUNK = 8000  # words of a bulk pass, so few that its arrays stay in cache
SMOOTHING = 0.1
EDGE_BITS = 19  # of the places for the edges between the pieces' common beginnings
_SPREAD = 0x9E3779B1


def _log_sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


class Lattice:
    """The vocabulary, and the places of its pieces in words."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        known = {bytes([b]): b for b in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                known.setdefault(sp.id_to_piece(i).replace("▁", " ").encode(), len(known))
        self.known = known
        self.size = len(known)
        self.length = np.zeros(self.size, np.int64)
        nodes: dict[bytes, int] = {b"": 0}  # of the trie of all pieces
        for p, i in known.items():
            self.length[i] = len(p)
            if b" " not in p[1:]:  # no word has runs of white space
                for n in range(1, len(p) + 1):
                    nodes.setdefault(p[:n], len(nodes))
        self.longest = max(map(len, nodes))
        self.piece = np.full(len(nodes), -1)  # of each node
        self.first = np.zeros(256, np.int64)  # node of each byte; all of them are pieces
        self.second = np.full(1 << 16, -1)  # of each two bytes
        self.edges, self.ends = np.full(1 << EDGE_BITS, -1), np.zeros(1 << EDGE_BITS, np.int64)  # hashed, the next free place if one is taken
        for p, node in nodes.items():
            self.piece[node] = known.get(p, -1)
            if len(p) == 1:
                self.first[p[0]] = node
            elif len(p) == 2:
                self.second[p[0] << 8 | p[1]] = node
            elif p:
                edge = nodes[p[:-1]] << 8 | p[-1]
                at = (edge * _SPREAD & 0xFFFFFFFF) >> (32 - EDGE_BITS)
                while self.edges[at] >= 0:
                    at = (at + 1) % len(self.edges)
                self.edges[at], self.ends[at] = edge, node

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Nodes that a byte leads to; -1: none."""
        edge = node << 8 | byte
        at = (edge * _SPREAD & 0xFFFFFFFF) >> (32 - EDGE_BITS)
        met = self.edges.take(at)
        out = np.where(met == edge, self.ends.take(at), -1)
        open_ = np.flatnonzero((met != edge) & (met >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.edges)
            met = self.edges.take(at[open_])
            good = met == edge[open_]
            out[open_[good]] = self.ends.take(at[open_[good]])
            open_ = open_[~good & (met >= 0)]
        return out

    def places(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, piece, offset of the start in its word, first node, last node).

        Node k of a word stands before its byte k; a word of n bytes has n + 1.
        Only places that begin some longer piece are looked at for longer ones.
        """
        size = np.array([len(w) for w in ws], np.int64)
        first = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        raw = np.frombuffer(b"\x00".join(ws) + b"\x00", np.uint8).astype(np.int64)
        offset = np.arange(len(raw)) - np.repeat(first, size + 1)
        left = np.repeat(size, size + 1) - offset
        at, length = np.flatnonzero(left), 1
        node = self.first.take(raw.take(at))
        starts, pieces = [at], [self.piece.take(node)]
        while len(at):
            more = left.take(at) > length
            at, node = at[more], node[more]
            byte = raw.take(at + length)
            node = self.second.take(raw.take(at) << 8 | byte) if length == 1 else self._next(node, byte)
            live = node >= 0
            at, node = at[live], node[live]
            length += 1
            piece = self.piece.take(node)
            good = piece >= 0
            starts.append(at[good])
            pieces.append(piece[good])
        start, piece = np.concatenate(starts), np.concatenate(pieces)
        return start, piece, offset.take(start), first, first + size

    def _sweep(self, node, start, piece, offset, rows, backward=False):
        """Fill ``node`` (nodes x languages) by steps that touch a node once each."""
        length = self.length.take(piece)
        at = (offset + length if backward else offset).astype(np.uint8)  # at most BULK; bytes are sorted by radix
        order = np.argsort(at, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(at))))
        source, piece = start[order], piece[order]
        target = source + length[order]
        if backward:
            source, target = target, source
        steps = range(len(cuts) - 1)
        for t in reversed(steps) if backward else steps:
            k = slice(cuts[t], cuts[t + 1])
            if cuts[t] < cuts[t + 1]:
                reached = target[k]
                got = node.take(source[k], axis=0)
                got *= rows.take(piece[k], axis=0)
                got += node.take(reached, axis=0)
                node[reached] = got

    def log_likelihood(self, ws: list[bytes], prob: np.ndarray) -> np.ndarray:
        """Natural log of the summed segmentations, words x languages.  ``ws`` begin with a space."""
        out = np.empty((len(ws), prob.shape[1]))
        short = [k for k, w in enumerate(ws) if len(w) <= BULK]
        scaled = prob * (SCALE ** np.minimum(self.length, BULK))[:, None]
        for a in range(0, len(short), CHUNK):
            part = short[a : a + CHUNK]
            sub = [ws[k] for k in part]
            start, piece, offset, first, last = self.places(sub)
            node = np.zeros((int(last[-1]) + 1, prob.shape[1]))
            node[first] = 1
            self._sweep(node, start, piece, offset, scaled)
            out[part] = np.log(node[last]) - np.array([len(w) for w in sub])[:, None] * math.log(SCALE)
        for k, w in enumerate(ws):
            if len(w) > BULK:
                out[k] = self._long(w, prob)
        return out

    def _long(self, w: bytes, prob: np.ndarray) -> np.ndarray:
        """The same for one word of any length, rescaled as it goes."""
        known, n = self.known, len(w)
        node = np.zeros((n + 1, prob.shape[1]))
        node[0] = 1
        log = np.zeros(prob.shape[1])
        for t in range(n):
            top = node[t]
            if t and t % 16 == 0:
                ahead = node[t : t + self.longest + 1]
                scale = ahead.max(axis=0)
                log += np.log(scale)
                node[t : t + self.longest + 1] /= scale
                top = node[t]
            for m in range(1, min(self.longest, n - t) + 1):
                i = known.get(w[t : t + m])
                if i is not None:
                    node[t + m] += top * prob[i]
        return np.log(node[n]) + log

    def _long_shares(self, w: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(piece, share of all segmentations that have it there), all pieces being equally likely, of one word of any length; in logarithms."""
        known, n, each = self.known, len(w), -math.log(self.size)
        arcs: list[tuple[int, int, int]] = []  # in the order of their starts
        fore, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        fore[0] = back[n] = 0.0
        into: list[list[float]] = [[] for _ in range(n + 1)]
        for t in range(n):
            if t:
                fore[t] = _log_sum(into[t])
                into[t] = []
            for m in range(1, min(self.longest, n - t) + 1):
                i = known.get(w[t : t + m])
                if i is not None:
                    arcs.append((t, t + m, i))
                    into[t + m].append(fore[t] + each)
        fore[n] = _log_sum(into[n])
        out: list[float] = []
        at = n
        for start, end, _ in reversed(arcs):
            if start != at:
                if out:
                    back[at] = _log_sum(out)
                at, out = start, []
            out.append(back[end] + each)
        start, end, piece = np.array(arcs).T
        return piece, np.exp(fore[start] + each + back[end] - fore[n])

    def expected(self, ws: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected piece counts (languages x pieces) of words with counts (words x languages), all pieces being equally likely."""
        out = np.zeros((counts.shape[1], self.size))
        flat = np.full((self.size, 1), 1.0 / self.size)
        scaled = flat * (SCALE ** np.minimum(self.length, BULK))[:, None]
        short = [k for k, w in enumerate(ws) if len(w) <= BULK]
        for k, w in enumerate(ws):
            if len(w) > BULK:
                piece, share = self._long_shares(w)
                for lang in np.flatnonzero(counts[k]):
                    out[lang] += np.bincount(piece, share * counts[k, lang], self.size)
        for a in range(0, len(short), CHUNK):
            part = short[a : a + CHUNK]
            sub = [ws[k] for k in part]
            weight = counts[part]
            start, piece, offset, first, last = self.places(sub)
            end = start + self.length[piece]
            fore = np.zeros((int(last[-1]) + 1, 1))
            fore[first] = 1
            self._sweep(fore, start, piece, offset, scaled)
            back = np.zeros_like(fore)
            back[last] = 1
            self._sweep(back, start, piece, offset, scaled, backward=True)
            word = np.zeros(len(fore), np.int64)
            word[first[1:]] = 1
            word = np.cumsum(word)[start]
            share = (fore[start] * scaled[piece] * back[end])[:, 0] / fore[last][word, 0]
            for lang in range(counts.shape[1]):
                out[lang] += np.bincount(piece, share * weight[word, lang], self.size)
        return out


_LATTICES: dict[str, Lattice] = {}


def lattice(model_file: str) -> Lattice:
    if model_file not in _LATTICES:
        _LATTICES[model_file] = Lattice(model_file)
    return _LATTICES[model_file]


class Model:
    """Languages, log priors and piece probabilities (pieces x languages)."""

    def __init__(self, model_file: str, langs: list[str], documents: np.ndarray, counts: np.ndarray):
        self.model_file, self.langs = model_file, langs
        self.prior = np.log(documents / documents.sum()) if len(langs) else documents
        counts = counts + SMOOTHING
        self.prob = (counts / counts.sum(axis=1, keepdims=True)).T.copy()
        self.uid = uuid.uuid4().hex


class Memo:
    """Log-likelihoods of the words a worker has met, for one model."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, lattice(model.model_file)
        self.rows: dict[bytes, int] = {}
        self.held = np.zeros((1024, len(model.langs)))
        self.used = np.zeros(1024)  # how often, uses of long ago counting less

    def _forget(self):
        """Leave the half that is used most."""
        names, n = list(self.rows), len(self.rows)  # in the order of their rows
        kept = np.sort(np.argpartition(self.used[:n], n - MEMO // 2)[n - MEMO // 2 :])
        self.rows = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.held[: len(kept)], self.used[: len(kept)] = self.held[kept], self.used[kept] / 2
        self.used[len(kept) :] = 0

    def values(self, ws: list[bytes]) -> np.ndarray:
        """Words x languages."""
        if len(self.rows) > MEMO:
            self._forget()
        at = list(map(self.rows.get, ws))
        missing = [i for i, k in enumerate(at) if k is None]
        if missing:
            new = list(dict.fromkeys([ws[i] for i in missing]))
            first, n = len(self.rows), len(self.rows) + len(new)
            if n > len(self.held):
                more = np.zeros((2 * n, self.held.shape[1]))
                more[:first] = self.held[:first]
                self.held = more
                self.used = np.concatenate((self.used, np.zeros(2 * n - len(self.used))))
            self.held[first:n] = self.lattice.log_likelihood([b" " + w for w in new], self.model.prob)
            self.rows.update(zip(new, range(first, n), strict=True))
            for i in missing:
                at[i] = self.rows[ws[i]]
        rows = np.array(at)
        self.used[: len(self.rows)] += np.bincount(rows, minlength=len(self.rows))
        return self.held.take(rows, axis=0)


_MEMOS: dict[str, Memo] = {}


def remembered(model: Model) -> Memo:
    """The worker's memo for a model; it outlives a task, but only the last model's is kept."""
    if model.uid not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[model.uid] = Memo(model)
    return _MEMOS[model.uid]


def train(df: DataFrame, model_file: str, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows whose lang is not null (null texts count as empty).

    Each task sums expected counts over its rows and emits at most one row per
    language and piece; the driver gets the sums, whose number is bounded by
    languages x vocabulary.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattice(model_file)
        seen: dict[str, Counter] = {}
        docs: Counter = Counter()
        sums: dict[str, np.ndarray] = {}

        def flush():
            langs = list(seen)
            every = list(set().union(*seen.values()))
            for a in range(0, len(every), 4 * CHUNK):
                part = every[a : a + 4 * CHUNK]
                counts = np.array([[seen[k].get(w, 0) for k in langs] for w in part], float)
                got = lat.expected([b" " + w for w in part], counts)
                for k, row in zip(langs, got, strict=True):
                    sums[k] = sums.get(k, 0) + row
            seen.clear()

        for batch in batches:
            with no_collections():
                for t, k in zip(batch[text], batch[lang], strict=True):
                    docs[k] += 1
                    seen.setdefault(k, Counter()).update(words(t))
                    if sum(map(len, seen.values())) > HELD:
                        flush()
        if seen:
            flush()
        for k, row in sums.items():
            at = np.flatnonzero(row)
            yield pd.DataFrame({"lang": k, "piece": at, "n": row[at]})
        if docs:
            yield pd.DataFrame({"lang": list(docs), "piece": -1, "n": [float(v) for v in docs.values()]})

    rows = df.where(F.col(lang).isNotNull()).select(F.col(text).alias(text), F.col(lang).alias(lang))
    got = rows.mapInPandas(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got.lang[got.piece < 0])
    documents, counts = np.zeros(len(langs)), np.zeros((len(langs), lattice(model_file).size))
    for i, k in enumerate(langs):
        own = got[got.lang == k]
        documents[i] = own.n[own.piece < 0].sum()
        own = own[own.piece >= 0]
        counts[i, own.piece] = own.n
    return Model(model_file, langs, documents, counts)


def predict(df: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All rows and columns of ``df`` plus the likeliest language and its posterior probability.

    Null texts, texts without a letter, and every text when no language was
    learned get ``und`` with score 0.  Ties go to the alphabetically first
    language.  Existing columns named ``pred`` / ``score`` are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary, whatever the data

    @F.pandas_udf(f"{pred} string, {score} double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        memo = remembered(m)

        def told(docs: list[list[bytes]]) -> list[tuple[str, float]]:
            sizes = np.array([len(d) for d in docs], np.int64)
            able = np.flatnonzero(sizes)
            logs = np.zeros((len(docs), len(m.langs)))
            if len(able):
                each = memo.values(list(chain.from_iterable(docs)))
                logs[able] = m.prior + np.add.reduceat(each, (np.cumsum(sizes) - sizes)[able], axis=0)
            out = []
            for n, row in zip(sizes, logs, strict=True):
                if n:
                    best = int(np.argmax(row))
                    out.append((m.langs[best], float(1 / np.exp(row - row[best]).sum())))
                else:
                    out.append((UNDETERMINED, 0.0))
            return out

        for texts in parts:
            out, docs, size = [], [], 0
            with no_collections():
                for t in texts:
                    docs.append(words(t) if m.langs and t and LETTER.search(t) else [])
                    size += len(docs[-1])
                    if size >= PASS:
                        out += told(docs)
                        docs, size = [], 0
                out += told(docs)
            yield pd.DataFrame(out, columns=[pred, score])

    told = df.withColumn("_told", run(F.col(text)))
    return told.withColumns({pred: F.col(f"_told.{pred}"), score: F.col(f"_told.{score}")}).drop("_told")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = train(docs.where(~held), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model, score="score").select("doc_id", held.alias("held_out"), "lang_pred", "score")
