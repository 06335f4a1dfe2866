"""Mixing domains towards target weights, with soft membership."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from leaguestats.checkpoints import durable
from leaguestats.llm.common import hashed_stretch, literals, small_arrow_batches
from leaguestats.llm.shingles import word_hashes
from leaguestats.llm.tokens import small_batches

BUCKET_BITS = 16  # of a hashed word


def _buckets(text: str) -> np.ndarray:
    return (word_hashes(text)[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def word_log_shares(labelled: DataFrame, sample_rows: int, sample_chars: int) -> tuple[list[str], np.ndarray]:
    """Domains and, for each, the log of the smoothed share of each hashed word.

    ``labelled``: text, label.  A sample of at most ``sample_rows`` different texts
    of each label in order of a hash, ``sample_chars`` in a row of each from a place
    its hash chooses, is counted in Spark.  Hashes are ranked without their texts,
    in each task before they shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                bucket, n = np.unique(_buckets(text), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(n), pa.string()), pa.array(bucket), pa.array(n)], ["label", "bucket", "n"])

    order = Window.partitionBy("label").orderBy("hash")
    told = labelled.where("label is not null and text is not null").select(F.col("label").cast("string").alias("label"), F.xxhash64("text").alias("hash"), "text")
    first = told.select("label", "hash").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_rows).drop("rank")
    # At most ``sample_rows`` hashes a label go to the texts, and of equal texts each task sends one.
    texts = told.join(F.broadcast(durable(first)), ["label", "hash"]).select("label", "hash", hashed_stretch("text", sample_chars).alias("text"))
    sample = texts.groupBy("label", "hash").agg(F.min("text").alias("text")).select("label", "text")
    counted = sample.mapInArrow(count, "label string, bucket bigint, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    domains = sorted({row["label"] for row in counted})
    counts = np.full((len(domains), 1 << BUCKET_BITS), 0.1)
    for row in counted:
        counts[domains.index(row["label"]), row["bucket"]] += row["n"]
    return domains, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def posteriors(docs: DataFrame, shares: np.ndarray, sharpness: float, text: str, doc_id: str) -> DataFrame:
    """(doc_id, key, tokens, p): words of a text, and the probability of each domain.

    The mean log share of a text's words, times ``sharpness``, is a domain's log
    weight; the mean keeps long texts from being all too sure.  A text without
    words belongs to all domains alike.
    """
    domains = len(shares)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in small_batches(texts):
                tokens, p = [], np.full((b - a, domains), 1 / max(1, domains))
                for i, t in enumerate(texts[a:b]):
                    words = _buckets(t)
                    tokens.append(len(words))
                    if len(words) and domains:
                        z = sharpness * shares[:, words].mean(axis=1, dtype=np.float64)
                        z = np.exp(z - z.max())
                        p[i] = z / z.sum()
                ends = pa.array(np.arange(b - a + 1) * domains, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("key").slice(a, b - a),
                        pa.array(tokens, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(p.reshape(-1))),
                    ],
                    ["doc_id", "key", "tokens", "p"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(predict, f"doc_id {kind}, key bigint, tokens bigint, p array<double>")


def _rate(history: list[np.ndarray], ridge: float, least: float) -> Column:
    """The rate of a row after gradient steps: each residual pulls it by the row's posterior, the ridge back to one."""
    if not history:
        return F.greatest(F.lit(1.0), F.lit(least))
    steps = F.array(*[literals(h.tolist(), "double") for h in history])

    def step(rate: Column, pull: Column) -> Column:
        slope = F.aggregate(F.zip_with("p", pull, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) + F.lit(ridge) * (rate - 1)
        return F.greatest(F.lit(least), rate - slope / F.lit(1 + ridge))

    return F.aggregate(steps, F.greatest(F.lit(1.0), F.lit(least)), step)


def fit_rates(
    docs: DataFrame,
    labelled: DataFrame,
    targets: Mapping[str, float] | None = None,
    temperature: float = 0.7,
    least_rate: float = 0.0,
    keep_largest: bool = False,
    sharpness: float = 4.0,
    ridge: float = 1e-4,
    most_rounds: int = 40,
    tolerance: float = 1e-3,
    sample_rows: int = 256,
    sample_chars: int = 20_000,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Fit a rate for each document so that expected domain token totals match ``targets``.

    A naive Bayes classifier, learned from a bounded sample of ``labelled``
    (text, label), gives each document a probability per domain.  Rates of at
    least ``least_rate`` minimise the squared distance of the domains' expected
    totals (rate times tokens times probability, summed over all rows) from their
    targets, each relative to the domain's size, plus ``ridge`` times that of
    rates from one.  Each round of projected gradient descent sums the totals
    over all rows in Spark; the driver holds one number a domain.  Ends once no
    total is off by more than ``tolerance`` or after ``most_rounds``.

    ``targets``: weights by label, scaled to the tokens there are; a label left
    out has weight 0.  Without any, weights are shares to the power
    ``temperature``.  ``keep_largest`` scales targets up until no domain shrinks.

    Returns doc_id, key (hash of the text), ``tokens`` (words), ``p``, ``domain``,
    ``rate`` and ``copies``: the rate rounded up or down by a hash of id and text,
    so that copies average the rate.  A null or empty text has no tokens, and its
    rate follows from equal probabilities.  Without labels all rates are one.
    """
    small_arrow_batches(docs.sparkSession)
    domains, shares = word_log_shares(labelled, sample_rows, sample_chars)
    rows = durable(posteriors(docs, shares, sharpness, text, doc_id))
    count = len(domains)

    def totals(rate: Column) -> np.ndarray:
        sums = rows.select((rate * F.col("tokens")).alias("w"), "p").agg(
            *[F.coalesce(F.sum(F.col("w") * F.element_at("p", k + 1)), F.lit(0.0)) for k in range(count)]
        )
        return np.array(sums.first(), float)

    history: list[np.ndarray] = []
    now = totals(F.lit(1.0)) if count else np.zeros(0)
    if now.sum() > 0:
        size = np.maximum(now, 1e-9 * now.sum())
        weights = np.array([float((targets or {}).get(d, 0.0)) for d in domains]) if targets else size**temperature
        goal = weights / weights.sum() * now.sum()
        if keep_largest:
            goal = goal * (size / np.maximum(goal, 1e-12)).max()
        now = totals(_rate(history, ridge, least_rate))
        while len(history) < most_rounds and (np.abs(now - goal) / np.maximum(goal, size * 1e-3)).max() > tolerance:
            history.append((now - goal) / size)
            now = totals(_rate(history, ridge, least_rate))
    share = F.shiftrightunsigned(F.xxhash64("doc_id", "key"), 11) / F.lit(float(1 << 53))
    best = F.array_position("p", F.array_max("p")).cast("int")
    named = F.element_at(literals(domains, "string"), best) if domains else F.lit(None).cast("string")
    return rows.withColumn("rate", _rate(history, ridge, least_rate)).select(
        "doc_id", "key", "tokens", "p", named.alias("domain"), "rate", F.floor(F.col("rate") + share).cast("long").alias("copies")
    )
