"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

The BPE encoding of a string has one last token for each of its prefixes.
The table holds that token: the automaton lists the vocabulary pieces that end
at a position, and a piece is the last one of the prefix when it can stand
right of the last token of what precedes it, i.e. when encoding the pair's
concatenation gives back the pair.  Reading the table from the end recovers
the ids.  The cost is linear in the text (pieces have a bounded length).

No piece of the vocabulary has the white-space mark after another character or
anything but a Latin letter after one, so no merge crosses such places: texts
are cut there and a distinct segment is encoded once per worker (the memo is
bounded).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_collections, table

MARK = "▁"
LETTER = "[A-Za-zÀ-ɏḀ-ỿ]"  # Latin letters
MEMO = 50_000  # segments remembered by a worker, and pairs of pieces (some 15 MB each)
LONGEST_MEMO = 32  # characters of a remembered segment


class Codec:
    """Encoder and decoder for one SentencePiece BPE model file with byte fallback."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score = [sp.get_score(i) for i in range(n)]
        self.unk = sp.unk_id()
        self.unk_surface = sp.decode([self.unk])
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.bytes_at = {}
        self.byte_of = {}
        self.ids = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_of[i] = int(p[1:-1], 16)
                self.bytes_at[self.byte_of[i]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[p] = i
        self.surfaces = [
            bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else self.unk_surface.encode() if i == self.unk else p.replace(MARK, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.names = [str(i) for i in range(n)]
        self.lengths = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        self.chars = set("".join(self.ids))
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces span words: this vocabulary can't be cut at white space")
        if any(re.search(f"{LETTER}(?!{LETTER}).", p) for p in self.ids):
            raise ValueError("pieces go on after a word's last letter: this vocabulary can't be cut there")
        # a character in no piece never merges, so the text can be cut around it as well
        lone = "" if "\n" in self.chars else "\n"
        other = f"[^A-Za-zÀ-ɏḀ-ỿ{MARK}{lone}]"
        self.segment = re.compile(f"{MARK}+{other}*{LETTER}*|{LETTER}+|{other}+{LETTER}*" + (f"|{lone}+" if lone else ""))
        self.fits: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.order: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.memo: dict[str, tuple[str, int, bytes]] = {}

    # -- the vocabulary's merges ---------------------------------------------

    def _merged(self, symbols: list[str], steps: int = 1 << 30) -> list[str]:
        """Plain merging, best score first and leftmost on ties; for short strings only."""
        symbols = list(symbols)
        for _ in range(steps):
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _split(self, i: int) -> tuple[int, int] | None:
        """The last merge that forms a piece: (left, right); None for single characters."""
        if i not in self.splits:
            symbols, text = list(self.pieces[i]), self.pieces[i]
            while len(symbols) > 2:
                before = len(symbols)
                symbols = self._merged(symbols, 1)
                if len(symbols) == before:
                    break
            ids = self.ids
            self.splits[i] = (ids[symbols[0]], ids[symbols[1]]) if len(symbols) == 2 and symbols[0] in ids and symbols[1] in ids and symbols[0] + symbols[1] == text else None
        return self.splits[i]

    def _regular(self, i: int) -> bool:
        """Whether all merges that form a piece come in the order of their scores."""
        out = self.order.get(i)
        if out is None:
            halves = self._split(i) if len(self.pieces[i]) > 1 else ()
            out = halves is not None and all(self.score[h] > self.score[i] and self._regular(h) for h in halves if len(self.pieces[h]) > 1)
            self.order[i] = out
        return out

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two pieces' concatenation is the two pieces.

        It is unless, at some time, the symbols that touch at the boundary form
        a piece which scores better than the next merge of either side.
        """
        key = (left << 20) | right
        out = self.fits.get(key)
        if out is None:
            if not (self._regular(left) and self._regular(right)) or MARK in (self.pieces[left][-1], self.pieces[right][-1]):
                a, b = self.pieces[left], self.pieces[right]
                out = self._merged(list(a + b)) == [a, b]
            else:
                out = self._never_merge(left, right)
            if len(self.fits) >= 4 * MEMO:
                self.fits.clear()
            self.fits[key] = out
        return out

    def _never_merge(self, left: int, right: int) -> bool:
        pieces, score, ids = self.pieces, self.score, self.ids
        lefts, rights = [left], [right]  # the boundary's symbols, from the last to the first
        while len(pieces[lefts[-1]]) > 1:
            lefts.append(self._split(lefts[-1])[1])
        while len(pieces[rights[-1]]) > 1:
            rights.append(self._split(rights[-1])[0])
        i, j = len(lefts) - 1, len(rights) - 1
        while True:
            joint = ids.get(pieces[lefts[i]] + pieces[rights[j]])
            # the next merge on either side; the left one goes first on equal scores
            a = score[lefts[i - 1]] if i else None
            b = score[rights[j - 1]] if j else None
            if joint is not None:
                s = score[joint]
                if (a is None or s > a) and (b is None or s >= b):
                    return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):
                i -= 1
            else:
                j -= 1

    def _reachable(self, i: int) -> bool:
        out = self.whole.get(i)
        if out is None:
            out = self.whole[i] = len(self.pieces[i]) == 1 or self._merged(list(self.pieces[i])) == [self.pieces[i]]
        return out

    # -- the prefix table ----------------------------------------------------

    def encode_segment(self, text: str) -> list[int]:
        """Ids of a stretch of text (the white space already marked)."""
        n = len(text)
        last = [-2] * (n + 1)  # last token of each prefix; -2: a character of no piece
        last[0] = -1
        fits, whole = self.fits, self.whole
        for end, (piece, length) in self.automaton.iter(text):  # the longest first at each end
            if last[end + 1] != -2:
                continue
            before = last[end + 1 - length]
            if before < 0:  # nothing to the left, or a character that merges with nothing
                good = whole.get(piece)
                if good is None:
                    good = self._reachable(piece)
            else:
                good = fits.get((before << 20) | piece)
                if good is None:
                    good = self._compatible(before, piece)
            if good:
                last[end + 1] = piece
        out: list[int] = []
        lengths, i = self.lengths, n
        while i:
            piece = last[i]
            if piece == -2:
                out.extend(self._unknown(text[i - 1]))
                i -= 1
            else:
                out.append(piece)
                i -= lengths[piece]
        return out[::-1]

    def _unknown(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        if all(b in self.bytes_at for b in raw):
            return [self.bytes_at[b] for b in reversed(raw)]
        return [self.unk]

    # -- texts ---------------------------------------------------------------

    def _surface(self, ids: list[int]) -> bytes:
        surfaces = self.surfaces
        return b"".join([surfaces[i] for i in ids])

    def _entry(self, segment: str) -> tuple[str, int, bytes]:
        ids = self.encode_segment(segment)
        names = self.names
        entry = (",".join([names[i] for i in ids]), len(ids), self._surface(ids))
        if len(segment) <= LONGEST_MEMO:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[segment] = entry
        return entry

    def parts(self, text: str) -> list[tuple[str, int, bytes]]:
        if not text:
            return []
        memo, entry = self.memo, self._entry
        return [memo.get(s) or entry(s) for s in self.segment.findall((MARK + text).replace(" ", MARK))]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in self.parts(text or "") for i in part[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: marks become spaces, the one put in front goes, invalid bytes become U+FFFD."""
        return self._text(self._surface(ids))

    @staticmethod
    def _text(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        names, counts, surfaces = zip(*self.parts(text), strict=True) if text else ((), (), ())
        ids = ",".join(names)
        back = self._text(b"".join(surfaces))
        return (
            sum(counts),
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(),
        )


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode_texts(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row of ``df`` with the token ids of its text and their decoding.

    Null counts as empty: no ids, empty decoding.  Row order, repeats and other
    columns are kept; existing columns named ``ids`` / ``decoded`` are replaced.
    """

    @F.pandas_udf(f"{ids} array<int>, {decoded} string")
    def run(texts: pd.Series) -> pd.DataFrame:
        c = codec(model_file)
        out = [c.encode(t) for t in texts]
        return pd.DataFrame({ids: out, decoded: [c.decode(i) for i in out]})

    coded = df.withColumn("_coded", run(F.col(text)))
    return coded.withColumns({ids: F.col(f"_coded.{ids}"), decoded: F.col(f"_coded.{decoded}")}).drop("_coded")


def encode_digests(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) for every row of ``df``.

    Digests of :func:`encode_texts`'s outputs, made without moving the ids out
    of the worker.  Null text counts as empty; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_file)
        for batch in batches:
            with no_collections():  # they would walk the whole memo
                rows = [c.digest(t) for t in batch[text]]
            yield pd.DataFrame({key: batch[key], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
