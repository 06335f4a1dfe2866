"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leaguestats.checkpoints import Scratch
from leaguestats.llm.common import small_arrow_batches
from leaguestats.llm.tokens import small_batches

BITS = 18  # of a feature's number
SIZES = (4, 5, 6)  # of the n-grams
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class NGrams:
    """Distinct hashed n-grams of texts; a scratch table finds first occurrences without sorting."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, np.int32)

    def of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        codes[(codes >= 9) & (codes <= 13)] = 32
        found = []
        for n in SIZES:
            if len(codes) >= n:
                key = np.full(len(codes) - n + 1, n, np.uint64)
                for i in range(n):
                    key += codes[i : len(codes) - n + 1 + i] * np.uint64(_MULTIPLIERS[i])
                key ^= key >> np.uint64(31)
                found.append(((key * np.uint64(_MULTIPLIERS[0])) >> np.uint64(64 - BITS)).astype(np.int32))
        if not found:
            return np.zeros(0, np.int32)
        grams = np.concatenate(found)
        place = np.arange(len(grams), dtype=np.int32)
        self.seen[grams] = place
        return grams[self.seen[grams] == place]


def sampled_grams(docs: DataFrame, labels: DataFrame, sample_rows: int, text: str, doc_id: str) -> DataFrame:
    """(label, grams) of up to ``sample_rows`` ids of each label, taken in order of a hash; the n-grams are found in the workers.

    Each task sends the first ``sample_rows`` ids of a label it has, and no text.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_grams = NGrams()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in small_batches(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(a, b - a), pa.array([n_grams.of(t) for t in texts[a:b]], pa.list_(pa.int32()))], ["label", "grams"]
                )

    told = labels.select(F.col("doc_id").alias("_labelled"), F.col("label").cast("int").alias("label"))
    order = [F.xxhash64("_labelled"), F.col("_labelled")]
    none, one = [told.where(F.col("label") == label).orderBy(*order).limit(sample_rows) for label in (0, 1)]
    chosen = none.unionByName(one)
    given = docs.select(F.col(f"`{doc_id}`").alias("_labelled"), F.col(f"`{text}`").alias("text")).where("text is not null")
    # The sample has a bounded number of rows, so it is sent to the texts.
    return given.join(F.broadcast(chosen), "_labelled").select("label", "text").mapInArrow(grams, "label int, grams array<int>")


def log_count_ratios(sample: DataFrame, smoothing: float, least_ratio: float, least_texts: int) -> np.ndarray:
    """For each n-gram, log of its smoothed share among n-grams of label-1 texts over that of label-0 texts.

    0 for n-grams of fewer than ``least_texts`` texts or with a smaller ratio than ``least_ratio`` either way.
    """
    size = 1 << BITS
    counted = sample.select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum("label").alias("one"), F.count(F.lit(1)).alias("all"))
    share = np.full((2, size), smoothing)
    for gram, one, both in counted.collect():  # 2^BITS rows at most
        share[0, gram] += both - one
        share[1, gram] += one
    ratio = np.log(share[1] / share[1].sum()) - np.log(share[0] / share[0].sum())
    rare = share.sum(axis=0) < 2 * smoothing + least_texts
    ratio[rare | (np.abs(ratio) < least_ratio)] = 0.0
    return ratio


def fit(features: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, penalty: float, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Logistic regression with a squared penalty on n-grams scaled by ``ratio``, classes weighing alike: weights, ratio included, and intercept."""
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(len(ratio), np.float32), 5.0 if labels.any() else -5.0
    grams = np.concatenate(features)
    owner = np.repeat(np.arange(len(features), dtype=np.int32), [len(f) for f in features])
    weigh = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    weights, bias = np.zeros(len(ratio)), 0.0
    first, second = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, (weights * ratio)[grams], len(labels)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * weigh
        slope = np.append(np.bincount(grams, off[owner], len(ratio)) * ratio + penalty * weights, off.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return (weights * ratio).astype(np.float32), float(bias)


def decision_point(z: np.ndarray, labels: np.ndarray) -> float:
    """The value that parts label 1 from label 0 best, a wrong 1 counting as five missed ones; midway between its neighbours."""
    order = np.argsort(-z)
    hits, wrong = np.cumsum(labels[order] == 1), np.cumsum(labels[order] == 0)
    best = int(np.argmax(hits - 5 * wrong))
    return float(z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2


def train(
    sample: DataFrame, accept: float, smoothing: float = 1.0, least_ratio: float = 1.5, least_texts: int = 3, penalty: float = 0.01
) -> tuple[np.ndarray, float]:
    """Weights and intercept, set so that the point which parts left-out halves of the sample best scores ``accept``."""
    with Scratch(sample.sparkSession) as scratch:
        sample = scratch.keep(sample)
        ratio = log_count_ratios(sample, smoothing, least_ratio, least_texts)
        telling = ratio != 0

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.asarray(g, np.int32) for g in batch.column("grams").to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([g[telling[g]].tobytes() for g in found], pa.binary())], ["label", "grams"])

        rows = sample.mapInArrow(tell, "label int, grams binary").orderBy(F.xxhash64("grams"), "label").collect()
    features = [np.frombuffer(r["grams"], np.int32) for r in rows]
    labels = np.array([r["label"] for r in rows], float)
    weights, bias = fit(features, labels, ratio, penalty)
    if len(set(labels)) < 2:
        return weights, bias
    z = np.zeros(len(labels))
    for half in (0, 1):
        seen, left = np.arange(half, len(labels), 2), np.arange(1 - half, len(labels), 2)
        w, b = fit([features[i] for i in seen], labels[seen], ratio, penalty)
        z[left] = [float(w[features[i]].sum(dtype=np.float64)) + b for i in left]
    return weights, bias - decision_point(z, labels) + float(np.log(accept / (1 - accept)))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 2_000, accept: float = 0.7, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Score every whole text between 0 and 1, higher where label 1 is likelier.

    The classifier is fitted on the texts of a sample of ``labels`` (doc_id, label
    0 or 1), of ``sample_rows`` ids of each label at most; scores from ``accept`` on are
    meant to be taken for label 1.
    A null or empty text has no n-grams but those of its edges and is scored
    like any other; without labels of both kinds all scores are near 0 (or 1).
    Returns doc_id and ``score``.
    """
    small_arrow_batches(docs.sparkSession)
    weights, bias = train(sampled_grams(docs, labels, sample_rows, text, doc_id), accept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_grams = NGrams()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in small_batches(texts):
                z = np.array([float(weights[n_grams.of(t)].sum(dtype=np.float64)) for t in texts[a:b]]) + bias
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"]
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(score, f"doc_id {kind}, score double")
