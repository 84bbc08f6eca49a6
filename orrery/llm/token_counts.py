"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's trie gets failure links; a link also knows how many pieces
are finished ("popped") when it is followed.  Walking a word through the
automaton adds those counts up, one step a character, without ever building
the pieces.  Pieces that begin a word carry the vocabulary's mark and hang
from one root, the others continue a word and hang from a second one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import no_collections, table

MEMO = 400_000  # words remembered by a worker
LONGEST_MEMO = 64  # bytes of a remembered word
MARK = "▁"


class Automaton:
    """``initial``: pieces that begin a word (their mark removed; "" is the mark alone); ``following``: the others."""

    def __init__(self, initial: set[str], following: set[str]):
        self.step: dict[tuple[int, str], int] = {}
        final = [False, False]  # nodes 0 and 1 are the roots
        for root, pieces in ((0, initial), (1, following)):
            for p in pieces:
                node = root
                for c in p:
                    node = self.step.setdefault((node, c), len(final))
                    if node == len(final):
                        final.append(False)
                final[node] = True
        final[1] = False
        n = len(final)
        self.link, self.popped = [-1] * n, [0] * n
        if final[0]:  # a mark on its own begins any word
            self.link[0], self.popped[0] = 1, 1
        children: dict[int, list[tuple[str, int]]] = {}
        for (u, c), v in self.step.items():
            children.setdefault(u, []).append((c, v))
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in children.get(u, ()):
                queue.append(v)
                if final[v]:
                    self.link[v], self.popped[v] = 1, 1
                    continue
                z, count = self.link[u], self.popped[u]
                while z >= 0 and (z, c) not in self.step:
                    count += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.step[z, c], count

    def pieces(self, word: str) -> int:
        """Number of greedy pieces of a word; -1 if the vocabulary can't cover it so."""
        step, link, popped = self.step, self.link, self.popped
        node, count = 0, 0
        for c in word:
            to = step.get((node, c))
            while to is None:
                count += popped[node]
                node = link[node]
                if node < 0:
                    return -1
                to = step.get((node, c))
            node = to
        while node != 1:
            count += popped[node]
            node = link[node]
            if node < 0:
                return -1
        return count


_AUTOMATA: dict[str, Automaton] = {}


def vocabulary(model_file: str) -> tuple[set[str], set[str]]:
    """Initial and following pieces of a SentencePiece model's normal pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {p[1:] for p in names if p.startswith(MARK)}, {p for p in names if not p.startswith(MARK)}


def automaton(model_file: str) -> Automaton:
    if model_file not in _AUTOMATA:
        _AUTOMATA[model_file] = Automaton(*vocabulary(model_file))
    return _AUTOMATA[model_file]


def count_tokens(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_tokens, n_unknown) for every row of ``df``.

    Words are runs of bytes other than space and 0x09-0x0D, as they stand (no
    lower-casing).  A word that greedy matching can't cover is one unknown
    token.  Null and empty texts have no words; repeated rows stay repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = automaton(model_file).pieces
        memo: dict[bytes, int] = {}
        for batch in batches:
            out = []
            with no_collections():
                for t in batch[text]:
                    ws = t.encode("utf-8", "surrogatepass").split() if t else []
                    counts = []
                    for w in ws:
                        n = memo.get(w)
                        if n is None:
                            n = pieces(w.decode("utf-8", "surrogatepass"))
                            if len(w) <= LONGEST_MEMO:
                                if len(memo) >= MEMO:
                                    memo.clear()
                                memo[w] = n
                        counts.append(n)
                    unknown = counts.count(-1)
                    out.append((len(ws), sum(counts) + 2 * unknown, unknown))
            got = pd.DataFrame(out, columns=["n_words", "n_tokens", "n_unknown"])
            got.insert(0, key, batch[key].to_numpy())
            yield got

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, n_words long, n_tokens long, n_unknown long")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
