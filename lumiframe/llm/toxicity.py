"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import give_back
from .samples import distinct_texts, drawn, held_out, label_of, texts_of

#: Bounds of the fitting sample: distinct texts that are confirmed toxic, and texts drawn whatever their label.
POSITIVES, UNLABELLED = 2000, 6000
#: A feature is kept that this share of the confirmed texts has, and at least so many of them.
FEATURE_SHARE, FEATURE_TEXTS = 0.005, 3
MEMBERS = 5
STEPS, RATE, SPARSITY = 200, 0.05, 0.0005
#: A member fits the features whose share among confirmed texts is so many times, and so many standard errors
#: above, their share among unlabelled ones; the clearest ones if there are more than ``CLEAREST``.
LIFT, CLEAR, CLEAREST = 2.0, 4.0, 1000
GRAMS = (4, 5)
THRESHOLD = 0.3
#: Bytes of words that a task remembers with their features, and those that a word takes beside its letters.
WORD_BYTES, WORD_COST = 24 << 20, 160
#: Different features that leave a task together while they are counted, and texts read together in a fit.
COUNTED, TEXTS = 100_000, 256

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def grams(word: str) -> list[str]:
    """The word itself and its character n-grams, with marks at both ends."""
    marked = f"^{word}$"
    found = {marked}
    for n in GRAMS:
        found.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return sorted(found)


@dataclass
class Vocabulary:
    """Feature numbers of texts; the features of a word are looked up once."""

    index: dict[str, int]

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def features(self, text: str) -> list[int]:
        found: set[int] = set()
        for word in words(text):
            own = self.known.get(word)
            if own is None:
                if self.held > WORD_BYTES:
                    self.known.clear()
                    self.held = 0
                own = self.known[word] = tuple(self.index[g] for g in grams(word) if g in self.index)
                self.held += WORD_COST + len(word) + 8 * len(own)
            if own:
                found.update(own)
        return sorted(found)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float) -> tuple[float, np.ndarray]:
    """Bias and weights of a linear classifier over present features.

    Minimises prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) for the
    logistic loss l. Where the second part is negative, the unlabelled texts are
    fitted too closely and the step goes up that part instead. A soft threshold
    after each step keeps the weights sparse.
    """
    lengths = np.array([len(r) for r in rows])
    columns = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    share = np.where(positive, 1 / max(1, positive.sum()), 0.0)
    rest = np.where(positive, 0.0, 1 / max(1, (~positive).sum()))
    weights, first, second = (np.zeros(n_features + 1) for _ in range(3))
    weights[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        score = weights[-1] + np.bincount(owner, weights[columns], len(rows))
        loss_negative = np.logaddexp(0, score)
        slope_negative = sigmoid(score)
        below = (rest - prior * share) @ loss_negative
        slope = (rest - prior * share) * slope_negative
        slope = slope + prior * share * (slope_negative - 1) if below >= 0 else -slope
        gradient = np.append(np.bincount(columns, slope[owner], n_features), slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights[:-1] = np.sign(weights[:-1]) * np.maximum(np.abs(weights[:-1]) - RATE * SPARSITY * step**0.5, 0)
    return float(weights[-1]), weights[:-1]


def clear_features(rows: list[bytes], positive: np.ndarray, n_features: int) -> np.ndarray:
    """Numbers of the features that confirmed texts have clearly more often than unlabelled ones.

    ``rows`` hold the feature numbers of a text as little-endian 32-bit integers.
    """
    counts = [np.zeros(n_features, np.int64), np.zeros(n_features, np.int64)]
    for side, total in zip((True, False), counts):
        own = [r for r, p in zip(rows, positive) if p == side]
        for at in range(0, len(own), TEXTS):
            total += np.bincount(np.frombuffer(b"".join(own[at : at + TEXTS]), "<i4"), minlength=n_features)
    n = [max(1, positive.sum()), max(1, (~positive).sum())]
    share, base = counts[0] / n[0], counts[1] / n[1]
    pooled = (counts[0] + counts[1] + 1) / (n[0] + n[1] + 2)
    clear = (share - base) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    found = np.flatnonzero((share >= LIFT * base) & (clear >= CLEAR))
    return np.sort(found[np.argsort(-clear[found], kind="stable")][:CLEAREST])


@dataclass
class Model:
    """Mean bias and weights of the members; only features with a weight are kept."""

    bias: float
    weights: dict[str, float]

    def score(self, texts: list[str]) -> np.ndarray:
        names = list(self.weights)
        vocabulary = Vocabulary({g: i for i, g in enumerate(names)})
        values = np.array([self.weights[g] for g in names])
        totals = [values[f].sum() if (f := vocabulary.features(t)) else 0.0 for t in texts]
        return sigmoid(self.bias + np.array(totals, dtype=float))


def train(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    prior: float | None = None,
) -> Model:
    """Fit on (id, text) and (id, label) rows, which the caller has cut to those that may be learned from.

    The sample is bounded by ``positives`` and ``unlabelled`` distinct texts; the
    members each leave out another fifth of it and are fitted in tasks of their
    own. ``prior`` is the share of toxic rows among the labelled ones unless given.
    Without any confirmed row the model scores every text zero.
    """
    spark = docs.sparkSession
    labelled, confirmed = labels.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not confirmed:
        return Model(-np.inf, {})
    prior = min(max(prior or confirmed / labelled, 1e-3), 1 - 1e-3)
    toxic = docs.join(labels.where("label = 1"), "id").select("text", F.lit(1).alias("label"))
    others = docs.select("text", F.lit(0).alias("label"))
    toxic = distinct_texts(drawn(toxic, confirmed, positives, 5), positives * 2)
    others = distinct_texts(drawn(others, docs.count(), unlabelled, 6), unlabelled * 2)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                totals.update({g for w in words(text) for g in grams(w)})
                if len(totals) > COUNTED:
                    yield pd.DataFrame(totals.items(), columns=["feature", "n"])
                    totals.clear()
        yield pd.DataFrame(totals.items(), columns=["feature", "n"])

    # Features of a bounded number of texts; the share bounds how many are left.
    counted = toxic.mapInPandas(featured, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("count"))
    least = max(FEATURE_TEXTS, round(FEATURE_SHARE * min(positives, confirmed)))
    index = {r["feature"]: i for i, r in enumerate(counted.where(F.col("count") >= least).orderBy("feature").collect())}

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(index)
        for batch in batches:
            found = [np.array(vocabulary.features(t), "<i4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"features": found, "positive": batch["label"] == 1, "fold": batch["fold"]})

    fold = F.pmod(F.crc32("digest"), F.lit(MEMBERS)).cast("int")
    sample = toxic.unionByName(others).withColumn("fold", fold)
    sample = sample.mapInPandas(numbered, "features binary, positive boolean, fold int")
    members = F.explode(F.array(*[F.lit(i) for i in range(MEMBERS)]))
    sample = sample.withColumn("member", members).where("member != fold")

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        positive, features = rows["positive"].to_numpy(bool), list(rows["features"])
        kept = clear_features(features, positive, len(index))
        place = np.full(len(index) + 1, -1)
        place[kept] = np.arange(len(kept))
        features = [(own := place[np.frombuffer(f, "<i4")])[own >= 0] for f in features]
        weights = np.zeros(len(index))
        bias, weights[kept] = fit_nnpu(features, positive, len(kept), prior)
        return pd.DataFrame({"member": [key[0]], "bias": [bias], "weights": [weights]})

    found = sample.groupBy("member").applyInPandas(fitted, "member int, bias double, weights array<double>").collect()
    if not found:
        return Model(-np.inf, {})
    found.sort(key=lambda r: r["member"])
    mean = np.mean([r["weights"] for r in found], axis=0) if index else np.zeros(0)
    kept = {g: float(mean[i]) for g, i in index.items() if mean[i] != 0}
    return Model(float(np.mean([r["bias"] for r in found])), kept)


def keep_clean(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    parts: int = 4,
    part: int = 2,
    threshold: float = THRESHOLD,
    **bounds,
) -> DataFrame:
    """The rows of ``df`` that ``toxicity`` predicts not to be toxic, with all their columns.

    Rows are judged as ``toxicity`` says for null, empty, very long, equal and
    repeated ones, null keys and clashing columns; a kept row keeps its null text.
    An empty table stays empty.
    """
    docs = texts_of(df, key, text)
    inside = ~held_out("id", parts, part)
    model = train(docs.where(inside), label_of(labels, key, label).where(inside), **bounds)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(batch.fillna("").tolist()))
        give_back()

    return df.where(score(F.col(text)) < threshold)


def toxicity(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    parts: int = 4,
    part: int = 2,
    threshold: float = THRESHOLD,
    **bounds,
) -> DataFrame:
    """(key, held_out, score, predicted) of every row of ``df``.

    Rows whose crc32(key) mod ``parts`` is ``part`` are held out: neither their
    text nor their label is learned from. The score is the mean member's logistic
    output, from the text alone, so equal texts have equal scores. Null and empty
    texts are scored as texts without features; null keys are scored and, as no
    label can name them, only ever unlabelled; repeated keys and rows are scored
    one by one; very long texts are read whole; of several labels for one key the
    larger holds. Without confirmed rows all scores are zero; an empty table gives no rows; other columns play no
    part, whatever their names.
    """
    docs = texts_of(df, key, text)
    known = label_of(labels, key, label)
    inside = ~held_out("id", parts, part)
    model = train(docs.where(inside), known.where(inside), **bounds)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": model.score(batch["text"].tolist())})

    id_type = df.schema[key].dataType.simpleString()
    result = docs.mapInPandas(scored, f"id {id_type}, score double")
    return result.select(
        F.col("id").alias(key),
        held_out("id", parts, part).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
