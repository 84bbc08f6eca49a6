"""Operators on texts: against the library, brute force and held-out labels."""

import fractions
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import public_tokenizers
from orrery.llm import hmm, language_id, quality, token_counts
from orrery.llm.sentencepiece_codec import Codec, encode_digests, encode_texts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "   a", "a\n\nb ", "▁x", "<s> <0x0A>", "梦😀é\x00\t", "Straße l'été", "x" * 3000, "word " * 400, "ﬁn", "»», «ab»."]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def codec():
    return Codec(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_equals_library(codec, library):
    rng = random.Random(5)
    bits = ["a", "e", " ", "  ", "\n", "th", "ing", "▁", "é", "ü", "梦", "😀", "<s>", "0", "1", ".", ",", "»", " the", "   ", "ção", "\t"]
    for text in [*ODD, *("".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(3000))]:
        ids = codec.encode(text)
        assert ids == library.encode(text or "") and codec.decode(ids) == library.decode(ids)


def test_codec_on_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in encode_digests(docs, MODEL).collect()}
    for r in docs.collect():
        ids = library.encode(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encoded_texts_keep_rows_and_columns(spark, library):
    df = spark.createDataFrame([(i % 3, t, "kept") for i, t in enumerate(ODD)], "doc_id long, text string, decoded string")
    rows = encode_texts(df, MODEL).collect()
    assert len(rows) == len(ODD) and all(list(r.ids) == library.encode(r.text or "") for r in rows)
    assert encode_digests(df.limit(0), MODEL).count() == 0


def greedy(word, initial, following):
    at, n = 0, 0
    while at < len(word) or not n:
        pieces = following if n else initial
        longest = max(map(len, pieces), default=0)
        end = next((e for e in range(min(len(word), at + longest), at - (not n), -1) if word[at:e] in pieces), None)
        if end is None or (n and end == at):
            return -1
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(9)
    for _ in range(400):
        draw = lambda least, k: {"".join(rng.choices("abc", k=rng.randint(least, 4))) for _ in range(k)}
        initial, following = draw(0, 5), draw(1, 6)
        a = token_counts.Automaton(initial, following)
        for _ in range(30):
            w = "".join(rng.choices("abc", k=rng.randint(1, 9)))
            assert a.pieces(w) == greedy(w, initial, following)


def test_token_counts(spark):
    vocab = token_counts.vocabulary(MODEL)
    odd = [*ODD, "ing" * 900 + " x", "thequickbrown" * 40, "é梦" * 300 + "the"]
    df = spark.createDataFrame([(i, t, -1, "x") for i, t in enumerate(odd)], "doc_id long, text string, n_words int, n_tokens string")
    for r in token_counts.count_tokens(df, MODEL).join(df.select("doc_id", "text"), "doc_id").collect():
        ws = [w.decode() for w in (r.text or "").encode().split()]
        n = [greedy(w, *vocab) for w in ws]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(ws), sum(1 if k < 0 else k for k in n), n.count(-1))


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.op8_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert docs.count() == quality.op8_quality(spark, "/root/testdata/sf0.01").count()


def test_quality_edges(spark):
    docs = documents(spark, [(i % 4, t, None, None) for i, t in enumerate(ODD)])
    for labels in ([], [(0, 1), (1, 1), (0, 0), (None, 1), (2, None), (3, 7)]):
        forest = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        rows = quality.score(docs.withColumn("score", F.lit("old")), forest).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), forest).count() == 0


def test_flattened_trees_equal_walking():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 4)), (rng.random(300) < 0.5).astype(float)
    f = quality.grow(x, y, trees=5, depth=3)
    for row, s in zip(x, f.scores(x), strict=True):
        total = f.start
        for feature, cut, leaf in zip(f.feature, f.cut, f.leaf, strict=True):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            total += leaf[node - 7]
        assert abs(s - 1 / (1 + math.exp(-total))) < 1e-12


def test_splits_equal_exhaustive_search():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(200, 5)), 1)  # ties in every feature
    y = (x[:, 2] + 0.5 * x[:, 0] * (x[:, 1] > 0) + rng.normal(size=200) * 0.3 > 0).astype(float)
    f = quality.grow(x, y, trees=3, depth=3, rate=0.2, bins=64, penalty=1.0)
    total = np.full(200, f.start)
    assert math.isclose(f.start, math.log((y.sum() + 0.5) / (201 - y.sum() - 0.5)))
    for t in range(3):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(200, int)
        for k in range(7):
            own = node == k
            if not own.any():
                continue
            score = lambda part: g[part].sum() ** 2 / (h[part].sum() + 1.0)
            gains = {(0, math.inf): 0.0}
            for feature in range(5):
                for cut in np.unique(np.quantile(x[:, feature], np.linspace(0, 1, 65)[1:-1])):
                    left, right = own & (x[:, feature] <= cut), own & (x[:, feature] > cut)
                    if h[left].sum() >= 1 and h[right].sum() >= 1:
                        gains[feature, cut] = score(left) + score(right) - score(own)
            chosen = gains.get((int(f.feature[t, k]), float(f.cut[t, k])), None)
            assert chosen is not None and math.isclose(chosen, max(gains.values()), rel_tol=1e-9, abs_tol=1e-6)
            node = np.where(own, 2 * k + 1 + (x[:, f.feature[t, k]] > f.cut[t, k]), node)
        for leaf in range(8):
            own = node == 7 + leaf
            if own.any():
                assert math.isclose(f.leaf[t, leaf], -0.2 * g[own].sum() / (h[own].sum() + 1.0), rel_tol=1e-9, abs_tol=1e-12)
        total += f.leaf[t, node - 7]


def test_marginal_likelihood_equals_enumeration():
    lat = language_id.lattice(MODEL)
    prob = np.random.default_rng(1).dirichlet(np.ones(lat.size), 2).T.copy()

    def every(w):
        if not w:
            return np.ones(2)
        return sum((prob[lat.known[w[:n]]] * every(w[n:]) for n in range(1, len(w) + 1) if w[:n] in lat.known), np.zeros(2))

    ws = [b" the", b" q", " été".encode(), b" tion.", b" abcab"]
    assert np.allclose(lat.log_likelihood(ws, prob), [np.log(every(w)) for w in ws])


def test_places_are_those_of_all_pieces():
    lat = language_id.lattice(MODEL)
    ws = [b" the", b" q", " été".encode(), b" \x00\xff\x00", b" ", b" " + bytes(range(33, 90)), b" internationalisation"]
    start, piece, offset, first, last = lat.places(ws)
    got = sorted(zip(start.tolist(), piece.tolist(), offset.tolist(), strict=True))
    assert got == sorted((int(f) + t, lat.known[w[t:e]], t) for f, w in zip(first, ws, strict=True) for t in range(len(w)) for e in range(t + 1, len(w) + 1) if w[t:e] in lat.known)
    assert (last - first).tolist() == [len(w) for w in ws]


def test_memo_keeps_the_words_used_most(monkeypatch):
    monkeypatch.setattr(language_id, "MEMO", 10)
    lat = language_id.lattice(MODEL)
    memo = language_id.Memo(language_id.Model(MODEL, ["a", "b"], np.ones(2), np.random.default_rng(1).random((2, lat.size))))
    asked, plain = [], lat.log_likelihood
    monkeypatch.setattr(lat, "log_likelihood", lambda ws, prob: asked.extend(ws) or plain(ws, prob))
    for k in range(30):
        ws = [b"the", b"of", b"the", b"of", *(b"x%d" % (7 * k + i) for i in range(7))]
        assert np.array_equal(memo.values(ws), plain([b" " + w for w in ws], memo.model.prob))
        assert len(memo.rows) <= 10 + 9
    assert asked.count(b" the") == asked.count(b" of") == 1 and len(asked) == 2 + 30 * 7


def plain_forward(lat, w, prob):
    """Sums over all segmentations with exact fractions of floats: no rescaling, whatever the length."""
    from decimal import Decimal, getcontext

    getcontext().prec = 40
    out = []
    for lang in range(prob.shape[1]):
        p = [Decimal(float(x)) for x in prob[:, lang]]
        node = [Decimal(0)] * (len(w) + 1)
        node[0] = Decimal(1)
        for t in range(len(w)):
            for m in range(1, min(lat.longest, len(w) - t) + 1):
                i = lat.known.get(w[t : t + m])
                if i is not None:
                    node[t + m] += node[t] * p[i]
        out.append(float(node[-1].ln()))
    return out


LONG = [b" " + b"thing" * 30, b" " + "été".encode() * 40, " 不分词的文字没有空格".encode() * 12, b" " + b"x" * 700, b" (le" + b"chat" * 14 + b").", b" " + b"q" * 59, b" " + b"q" * 60]


def test_long_and_unspaced_words_are_scored_whole():
    lat = language_id.lattice(MODEL)
    prob = np.random.default_rng(1).dirichlet(np.ones(lat.size), 2).T.copy()
    ws = [b" " + w.replace(b" ", b"") for w in LONG]
    assert np.allclose(lat.log_likelihood(ws, prob), [plain_forward(lat, w, prob) for w in ws], rtol=1e-9)


def test_expected_counts_of_long_words_equal_plain_recursions():
    lat = language_id.lattice(MODEL)
    for w in LONG[:3]:
        w = b" " + w.replace(b" ", b"")
        n, want = len(w), np.zeros(lat.size)
        arcs = [(t, t + m, lat.known[w[t : t + m]]) for t in range(n) for m in range(1, min(lat.longest, n - t) + 1) if w[t : t + m] in lat.known]
        fore, back = [0] * (n + 1), [0] * (n + 1)  # numbers of segmentations by their pieces: exact integers
        fore[0], back[n] = {0: 1}, {0: 1}
        for t, e, _ in arcs:
            fore[e] = fore[e] or {}
            for k, v in fore[t].items():
                fore[e][k + 1] = fore[e].get(k + 1, 0) + v
        for t, e, _ in reversed(arcs):
            back[t] = back[t] or {}
            for k, v in back[e].items():
                back[t][k + 1] = back[t].get(k + 1, 0) + v
        weigh = lambda c, extra=0: sum(fractions.Fraction(v, lat.size ** (k + extra)) for k, v in c.items())
        fw, bw = [weigh(c) for c in fore], [weigh(c) for c in back]
        for t, e, i in arcs:
            want[i] += float(fw[t] * bw[e] / lat.size / fw[n])
        assert np.allclose(lat.expected([w], np.array([[1.0, 2.0]])), [want, 2 * want])


def test_expected_counts_equal_enumeration():
    lat = language_id.lattice(MODEL)

    def every(w):
        return [()] if not w else [(w[:n], *rest) for n in range(1, len(w) + 1) if w[:n] in lat.known for rest in every(w[n:])]

    ws, counts = [b" the", b" an"], np.array([[2.0, 0.0], [1.0, 3.0]])
    want = np.zeros((2, lat.size))
    for w, c in zip(ws, counts, strict=True):
        ways = every(w)
        weights = np.array([(1 / lat.size) ** len(way) for way in ways])
        for way, share in zip(ways, weights / weights.sum(), strict=True):
            for piece in way:
                want[:, lat.known[piece]] += share * c
    assert np.allclose(lat.expected(ws, counts), want)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.op10_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_language_edges(spark):
    df = documents(spark, [(i, t, None if i % 2 else "en", None) for i, t in enumerate([*ODD, "123 ++", "the the"])]).withColumn("lang_pred", F.lit(1))
    model = language_id.train(df.repartition(40), MODEL)  # some partitions are empty
    rows = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[len(ODD)].lang_pred == "und" and rows[len(ODD) + 1].lang_pred == "en"
    nobody = language_id.train(df.limit(0), MODEL)
    assert {r.lang_pred for r in language_id.predict(df, nobody).collect()} == {"und"}


def test_language_scores_whole_words(spark):
    rows = [(i, "la, porta, e, " if i % 2 else "la; porta; e; ", "aa" if i % 2 else "bb", None) for i in range(20)] + [(90, "(la, «porta»?) l' e;", None, None)]
    df = documents(spark, rows)
    model = language_id.train(df, MODEL)
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.predict(df, model).collect()}
    assert [got[0][0], got[1][0]] == ["bb", "aa"]
    logs = model.prior + language_id.lattice(MODEL).log_likelihood([b" " + w for w in rows[-1][1].encode().lower().split()], model.prob).sum(axis=0)
    assert math.isclose(got[90][1], 1 / np.exp(logs - logs.max()).sum(), rel_tol=1e-9)


def test_forward_and_baum_welch_equal_plain_recursions():
    rng = np.random.default_rng(1)
    p = hmm.Params.first(rng.integers(0, 100, hmm.CLASSES).astype(float))
    lengths = np.array([1, 2, 127, 128, 129, 300, 700])
    tokens = rng.integers(0, hmm.CLASSES, lengths.sum()).astype(np.int32)
    k = hmm.STATES
    starts, moves, emits, logs, at = np.zeros(k), np.zeros((k, k)), np.zeros((k, hmm.CLASSES)), [], 0
    for n in lengths:
        x, at = tokens[at : at + n], at + n
        alpha, log, fore = p.start, 0.0, []
        for i, o in enumerate(x):
            alpha = (alpha @ p.move if i else alpha) * p.emit[:, o]
            log += np.log(alpha.sum())
            alpha = alpha / alpha.sum()
            fore.append(alpha)
        logs.append(log)
        beta = np.ones(k)
        for t in reversed(range(n)):
            if t < n - 1:
                e = p.emit[:, x[t + 1]] * beta
                xi = fore[t][:, None] * p.move * e
                moves += xi / xi.sum()
                beta = p.move @ e
                beta /= beta.sum()
            g = fore[t] * beta / (fore[t] @ beta)
            emits[:, x[t]] += g
            starts += g if t == 0 else 0
    assert np.allclose(hmm.Sweep(p, tokens, lengths).log_likelihood(), logs)
    assert np.allclose(hmm.Sweep(p, tokens, lengths).counts(), np.concatenate((starts, moves.ravel(), emits.ravel())), atol=1e-8)


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = hmm.op1_hidden_markov(spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b"\n"] for r in docs.collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    counts = {}
    for d, ws in texts.items():
        for w in ws if d not in held else ():
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    assert len(rows) == len(texts)
    for r in rows:
        ws = texts[r.doc_id]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(ws), sum(w in counts for w in ws), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_edges(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "a b", "z"), (1, "a b", "z"), (2, "q " * 5000, "w")], "doc_id long, text string, score string")
    rows = hmm.language_model_scores(df, F.col("doc_id") == 2).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 3, 3, 5001] and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    nothing = hmm.language_model_scores(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)
    assert hmm.language_model_scores(df.limit(0), F.lit(False)).count() == 0
