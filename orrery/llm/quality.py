"""Quality classifier: histogram gradient-boosted trees over document statistics.

The features come from the whole text.  The trees are grown with numpy on the
driver from a bounded sample of labelled rows (``max_rows``, the one bound
here) and flattened into arrays, which a batch of documents descends level by
level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, table

FEATURES = [
    "log_bytes", "log_words", "bytes_a_word", "upper", "lower", "digits", "stops", "marks", "beyond_ascii", "line_ends",
    "distinct_words", "top_word", "distinct_lines", "top_line", "words_a_line", "marked_words", "repeated_pairs", "capital_words", "longest_word", "words_a_stop",
]
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:?'\"")] = True
_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"-"]] = True
_MARK_BYTES = bytes(np.flatnonzero(_MARKS).tolist())


def statistics(text: str | None) -> list[float]:
    """The features of one text; null counts as empty (all zero)."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    ws = raw.split()
    if not ws:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(FEATURES) - 1)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, k = len(raw), len(ws)
    share = lambda a: float(a) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    by_word, by_line = Counter(ws), Counter(lines)
    stops = int(hist[_STOPS].sum())
    return [
        float(np.log1p(n)), float(np.log1p(k)), n / k, share(hist[65:91].sum()), share(hist[97:123].sum()), share(hist[48:58].sum()), share(stops), share(hist[_MARKS].sum()), share(hist[128:].sum()), share(hist[10]),
        len(by_word) / k, max(by_word.values()) / k, len(by_line) / len(lines), max(by_line.values()) / len(lines), k / len(lines),
        sum(v for w, v in by_word.items() if w[-1] in _MARK_BYTES) / k, 1 - len(set(zip(ws, ws[1:]))) / max(k - 1, 1), sum(v for w, v in by_word.items() if 65 <= w[0] <= 90) / k, float(np.log1p(max(map(len, by_word)))), k / (stops + 1),
    ]


@dataclass
class Forest:
    """Complete trees of one depth: node i's children are 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; a value above it goes right
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, penalty: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss on binned features.

    Without rows every score is 0.5; with one class only, near that class.
    """
    n = len(y)
    mean = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(mean / (1 - mean)))
    inner = 2**depth - 1
    out = Forest(start, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not n:
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            low, width = 2**level - 1, 2**level
            at = node - low
            sums = [np.stack([np.bincount(at * bins + binned[:, f], v, width * bins).reshape(width, bins) for v in (g, h)]) for f in range(x.shape[1])]
            hist = np.stack(sums)  # features x (g, h) x nodes x bins
            left = hist.cumsum(axis=3)
            whole = left[..., -1:]
            right = whole - left
            gain = (left[:, 0] ** 2 / (left[:, 1] + penalty) + right[:, 0] ** 2 / (right[:, 1] + penalty) - whole[:, 0] ** 2 / (whole[:, 1] + penalty))
            for f, e in enumerate(edges):
                gain[f, :, len(e) :] = -1
            gain[(left[:, 1] < 1) | (right[:, 1] < 1)] = -1
            best = gain.transpose(1, 0, 2).reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[f, k, b] > 1e-6:
                    out.feature[t, low + k], out.cut[t, low + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.cut[t, node])
        at = node - inner
        out.leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + penalty)
        total += out.leaf[t][at]
    return out


def _features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({k: batch[k] for k in keep} | {"features": [statistics(t) for t in batch[text]]})

    return df.select(*keep, text).mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "features array<double>"]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> Forest:
    """Fit to at most ``max_rows`` labelled documents, those whose ids hash lowest.

    Labels other than 0 and 1 and null keys are not used; a key labelled more
    than once takes its mean, rounded; one with several texts takes one of them.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias(key)).agg(F.round(F.avg(label)).cast("double").alias("_y"))
        .orderBy(F.xxhash64(key), key).limit(max_rows)
    )
    # at most max_rows rows of a key and a number: the bound of this broadcast
    rows = docs.select(key, text).join(F.broadcast(chosen), key)
    got = _features(rows, text, [key, "_y"]).groupBy(key).agg(F.min(F.struct("features", "_y")).alias("r")).orderBy(key).select("r.features", "r._y").toPandas()
    x = np.array(got.features.tolist(), float).reshape(len(got), len(FEATURES))
    return grow(x, got["_y"].to_numpy(float))


def score(df: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``df`` plus the probability that a text is good.

    Null texts count as empty; they get a score as well.  An existing column
    named ``out`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(forest)  # trees x nodes, whatever the data

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(shared.value.scores(x))

    return df.withColumn(out, run(F.col(text)))


THRESHOLD = 0.3


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    forest = train(docs, table(spark, sf_dir, "labels").where(~held))
    scored = score(docs.select("doc_id", "text"), forest)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
