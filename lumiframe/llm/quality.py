"""Quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import drawn, held_out, label_of, texts_of

#: Bound of the fitting sample, in labelled documents.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 80, 5, 0.15, 64
LEAF_ROWS, RIDGE = 10, 1.0
THRESHOLD = 0.3

FEATURES = (
    "bytes", "words", "word_bytes", "longest_word", "upper", "lower", "digit", "mark", "beyond_ascii", "space",
    "exclamation", "symbol", "bar", "stop", "comma", "quote", "bracket", "distinct_words", "top_word", "upper_words",
    "marked_words", "bare_words", "short_words", "lines", "line_bytes", "distinct_lines", "top_line", "repeats",
    "distinct_pairs", "top_pair", "heaviest_byte", "entropy",
)

_BYTES = np.arange(256)
_IS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "beyond_ascii": _BYTES >= 128,
    "space": np.isin(_BYTES, [9, 10, 11, 12, 13, 32]),
    "exclamation": np.isin(_BYTES, list(b"!?")),
    "symbol": np.isin(_BYTES, list(b"#$%&*@^~+=<>\\_")),
    "bar": np.isin(_BYTES, list(b"|/")),
    "stop": np.isin(_BYTES, list(b".;:")),
    "comma": _BYTES == 44,
    "quote": np.isin(_BYTES, list(b"'\"`")),
    "bracket": np.isin(_BYTES, list(b"()[]{}")),
}
_IS["mark"] = (_BYTES > 32) & (_BYTES < 127) & ~_IS["upper"] & ~_IS["lower"] & ~_IS["digit"]
_CLASSES = np.array([_IS[n] for n in FEATURES if n in _IS], dtype=float)


def statistics(text: str) -> list[float]:
    """The FEATURES of one text, shares where the name is no count or length; an empty text gives zeros."""
    data = text.encode()
    if not data:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = _CLASSES @ counts / len(data)
    part = counts[counts > 0] / len(data)
    words = text.split()
    n = max(1, len(words))
    bag = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    rows = Counter(lines)
    lengths = [len(w) for w in words] or [0]
    return [
        float(len(data)), float(len(words)), sum(lengths) / n, float(max(lengths)), *shares,
        len(bag) / n, max(bag.values(), default=0) / n, sum(c for w, c in bag.items() if w.isupper() and len(w) > 1) / n,
        sum(c for w, c in bag.items() if not w[-1].isalnum()) / n, sum(c for w, c in bag.items() if w.isalpha()) / n,
        sum(c for w, c in bag.items() if len(w) <= 2) / n, float(len(lines)), len(data) / m, len(rows) / m,
        max(rows.values(), default=0) / m, sum(c for c in rows.values() if c > 1) / m,
        len(pairs) / max(1, n - 1), max(pairs.values(), default=0) / max(1, n - 1),
        float(counts[33:].max() / len(data)), float(-(part * np.log2(part)).sum()),
    ]


def feature_table(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Forest:
    """Trees as flat arrays: one row a tree, node i has the children 2i+1 and 2i+2, leaves last."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees together, one level a step."""
        inner = self.feature.shape[1]
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boosted trees for the logistic loss, split by histograms of binned features.

    Every tree is grown to full depth; a node without a gainful split sends all
    rows left, so its leaves on the right stay unused.
    """
    n, width = x.shape
    inner = (1 << DEPTH) - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    forest = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, nodes = (1 << level) - 1, 1 << level
            place = node - first
            gain, where = np.zeros(nodes), np.zeros((nodes, 2), np.int64)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                cell = place * BINS + binned[:, j]
                g, h, c = (
                    np.bincount(cell, w, nodes * BINS).reshape(nodes, BINS).cumsum(1) for w in (slope, curve, None)
                )
                left = g**2 / (h + RIDGE)
                right = (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + RIDGE)
                better = left + right - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                better[(c < LEAF_ROWS) | (c[:, -1:] - c < LEAF_ROWS)] = 0
                better = better[:, : len(cuts[j])]
                best = better.argmax(1)
                value = better[np.arange(nodes), best]
                where[value > gain] = np.stack([np.full(nodes, j), best], axis=1)[value > gain]
                gain = np.maximum(gain, value)
            for k in np.flatnonzero(gain > 1e-6):
                forest.feature[t, first + k] = where[k, 0]
                forest.cut[t, first + k] = cuts[where[k, 0]][where[k, 1]]
            rows = np.arange(n)
            node = 2 * node + 1 + (x[rows, forest.feature[t, node]] > forest.cut[t, node])
        at = node - inner
        g, h = np.bincount(at, slope, inner + 1), np.bincount(at, curve, inner + 1)
        forest.leaf[t] = -RATE * g / (h + RIDGE)
        total += forest.leaf[t][at]
    return forest


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Forest | None:
    """Fit on a bounded draw of the labelled (id, text) rows; statistics are computed in tasks.

    None when there is no labelled row.
    """
    n = labels.count()

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": list(feature_table(batch["text"].tolist())), "y": batch["label"]})

    sample = drawn(docs.join(labels, "id"), n, bound, 7).select("text", "label")
    rows = sample.mapInPandas(measured, "x array<double>, y int").limit(2 * bound).toPandas()
    if not len(rows):
        return None
    rows = rows.iloc[np.lexsort(np.stack(rows["x"]).T)]  # the order of arrival must not matter
    return fit(np.stack(rows["x"]), rows["y"].to_numpy(float))


def quality(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    parts: int = 5,
    part: int = 0,
    threshold: float = THRESHOLD,
    bound: int = SAMPLE,
) -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``df``.

    Rows whose crc32(key) mod ``parts`` is ``part`` are held out of fitting. The
    score comes from statistics of the whole text alone. Null and empty texts
    have all statistics zero; null keys are scored and never learned from;
    repeated keys and rows are scored one by one; of several labels for one key
    the larger holds. Without labelled rows all scores are 0.5; an empty table
    gives no rows; other columns play no part, whatever their names.
    """
    docs = texts_of(df, key, text)
    known = label_of(labels, key, label)
    inside = ~held_out("id", parts, part)
    forest = train(docs.where(inside), known.where(inside), bound)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = forest.score(feature_table(batch["text"].tolist())) if forest else np.full(len(batch), 0.5)
            yield pd.DataFrame({"id": batch["id"], "score": score})

    id_type = df.schema[key].dataType.simpleString()
    result = docs.mapInPandas(scored, f"id {id_type}, score double")
    return result.select(
        F.col("id").alias(key),
        held_out("id", parts, part).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
