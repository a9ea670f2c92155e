"""Quality classifier: Bradley-Terry scores learned from preference pairs."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrisk.llm.common import give_back, small_batches
from seqrisk.llm.registry import query, table

#: Labelled documents of each class that the fit uses at most, in expectation.
SAMPLE = 10_000
#: Preference pairs of the fit.
PAIRS = 200_000
RIDGE = 1e-3
SYMBOLS = b"#$%&*+=<>@^_~\\{}[]"


def text_features(data: bytes) -> list[float]:
    """Shape of a whole text: shares of kinds of characters, words and lines, and its size.

    Shares of kinds are drawn towards 0 in short texts, where one sign says little.
    """
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n = max(1, len(words))
    lines = data.split(b"\n")
    upper, lower = kinds[65:91].sum(), kinds[97:123].sum()
    shares = [
        upper / (upper + lower + 50),
        kinds[48:58].sum() / (len(data) + 50),
        kinds[list(SYMBOLS)].sum() / (len(data) + 50),
        kinds[33] / (len(data) + 50),
        kinds[124] / (len(data) + 50),
        (kinds[44] + kinds[46]) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(len(w) <= 3 for w in words) / n,
    ]
    return [
        *np.log1p(100.0 * np.array(shares)).tolist(),
        len(set(words)) / n,
        len(set(lines)) / len(lines),
        (len(data) - kinds[32]) / n / 10,
        float(np.log1p(n)),
        float(np.log1p(n) * len(set(words)) / n),
        float(n == 1),
    ]


N_FEATURES = len(text_features(b""))


def features(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        octets = texts.cast(pa.large_binary())
        made = pa.array([text_features(t.as_py() or b"") for t in octets], pa.list_(pa.float64()))
        give_back()
        return made

    return run(F.coalesce(text.cast("string"), F.lit("")))


@dataclass
class PairwiseModel:
    """Linear score, shifted and scaled so that the chosen quantile is 0."""

    weights: list[float]
    shift: float

    def score(self, x: Column) -> Column:
        """Probability-like score of a feature column, in (0, 1)."""
        terms = [F.lit(float(w)) * F.get(x, F.lit(i)) for i, w in enumerate(self.weights)]
        total = F.lit(float(self.shift))
        for term in terms:
            total = total + term
        total = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 8) -> PairwiseModel:
    """Scores from pairs (better, worse): logistic loss of feature differences, Newton's method.

    The threshold is the quantile of the training scores with the highest balanced accuracy, the
    middle one among equals.
    """
    if len(x) == 0 or y.min() == y.max():
        return PairwiseModel([0.0] * N_FEATURES, 0.0)
    spread = x.std(axis=0)
    spread[spread < 1e-9] = np.inf
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = (x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]) / spread
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w /= spread
    s = x @ w
    order = np.argsort(s, kind="stable")
    passed_bad = np.cumsum(y[order] == 0) / len(bad)
    passed_good = np.cumsum(y[order] == 1) / len(good)
    ranked = s[order]
    cuts = np.flatnonzero(ranked[1:] > ranked[:-1])
    if not len(cuts):
        return PairwiseModel(w.tolist(), float(-ranked[0]))
    value = (passed_bad - passed_good)[cuts]
    best = cuts[value >= value.max() - 1e-12]
    cut = best[len(best) // 2]
    return PairwiseModel(w.tolist(), float(-(ranked[cut] + ranked[cut + 1]) / 2))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> PairwiseModel:
    """Learn from the labelled documents that are not held out.

    A document whose labels disagree or are NULL is not used. At most about ``sample`` of each class are
    taken, by hash of the id; their ids are broadcast and their features (a few numbers each) collected.
    """
    known = (
        labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("quality").alias("_y"), F.max("quality").alias("_top"))
        .where(F.col("_y") == F.col("_top"))
        .drop("_top")
    )
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    part = F.lit(0.0)
    for y, n in counts.items():
        part = F.when(F.col("_y") == y, F.lit(min(1.0, sample / n))).otherwise(part)
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < part * (1 << 20))
    fitted = small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = fitted.select("_id", "_y", features(F.col("text")).alias("_x")).collect()
    # Sorted, so that the fit does not depend on the order of tasks.
    rows = sorted((r["_id"], r["_y"], tuple(r["_x"])) for r in rows)
    x = np.array([r[2] for r in rows]).reshape(-1, N_FEATURES)
    return bradley_terry(x, np.array([r[1] for r in rows], int))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (doc_id, text).

    Only the text makes the score. NULL and empty texts are scored like any other; a NULL id counts as not held
    out; without labels of both classes every score is 0.5; repeated rows stay; other columns are ignored.
    """
    model = fit_quality(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long"), model.score(features(F.col("text"))).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the same columns."""
    model = fit_quality(docs, labels)
    scored = docs.withColumn("_quality_score", model.score(features(F.col("text"))))
    return scored.where(F.col("_quality_score") >= 0.5).select(*docs.columns)


@query("op8_bradley_terry_quality")
def op8_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
