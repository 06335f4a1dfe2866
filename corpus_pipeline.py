"""A training corpus from documents, stage by stage.

``STAGES`` names the stages in order.  Each takes (spark, docs, sf_dir) and
returns a frame, which ``run`` writes as Parquet and reads back as the docs of
the next; all but the last return the columns of ``documents``, and of whatever
columns more the table has.  Rows are told apart by id and text, either of which
may be null; an empty table goes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leaguestats.checkpoints import durable
from leaguestats.llm import exact, jaccard, mixing
from leaguestats.llm.common import less, only, replicated
from leaguestats.llm.queries import fertility, packed
from leaguestats.shipping import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, empty ones and null texts among them."""
    rejected = fertility(docs).where("not kept").select(F.col("doc_id").alias("_k_id"), F.col("key").alias("_k_text"))
    return less(docs, durable(rejected.distinct()))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical texts, the one with the largest id stays; a null text equals an empty one."""
    return exact.mark_exact_copies(docs).where("kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by 0.8 or more of their 5-word shingles, the one with the smallest id stays, once.

    Documents without words are linked with nothing and stay.
    """
    found = jaccard.near_copies(docs, size=5, part=8, whole=10)
    rows = found.groupBy(F.col("doc_id").alias("_k_id"), F.col("key").alias("_k_text")).agg(F.max("keep").alias("any"), F.min("keep").alias("all"))
    gone = durable(rows.where("not all"))
    kept = less(docs, gone.select("_k_id", "_k_text"))
    again = gone.where(F.col("any")).select("_k_id", "_k_text")
    if again.isEmpty():
        return kept
    # Rows that repeat in id and text: one of them is what stays.
    once = only(docs, durable(again)).groupBy("doc_id", "text").agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in ("doc_id", "text")])
    return kept.unionByName(once.select(*[f"`{c}`" for c in docs.columns]))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small languages are repeated towards shares to the power 0.7; no document goes, also not one without words or language."""
    labelled = docs.select("text", F.col("lang").alias("label"))
    rates = mixing.fit_rates(docs, labelled, temperature=0.7, least_rate=1.0, keep_largest=True)
    times = rates.where("copies <> 1").select(F.col("doc_id").alias("_k_id"), F.col("key").alias("_k_text"), F.col("copies").alias("_k_copies"))
    return replicated(docs, durable(times.distinct()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 token ids along a Hilbert curve, as pieces of documents."""
    return packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_sound),
    ("exact_dedup", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("mixing", mix_languages),
    ("packing", pack),
]

# Token statistics, the similarity join and rates have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
