"""Registered queries of the text operators; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leaguestats.llm import chat, exact, jaccard, kneser, language, mixing, packing, phrases, quality, sharding, spelling, substrings, toxicity
from leaguestats.llm.common import documents, id_hash
from leaguestats.llm.tokens import added_tokens


def packed(docs: DataFrame) -> DataFrame:
    """Packing with the public byte-level vocabulary; pieces with the checksum of their ids."""
    path = public_tokenizers.path
    pieces = packing.pack_along_curve(
        docs, path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, length=1024, end_id=0, specials=added_tokens(path("byte_bpe_50k.json"))
    )
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in sequences of 1024, packed along a Hilbert curve."""
    return packed(documents(spark, sf_dir))


def fertility(docs: DataFrame) -> DataFrame:
    """The quality rules with the public vocabularies."""
    path = public_tokenizers.path
    return quality.judge_fertility(docs, path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))


def op2_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and token bands over every document."""
    return fertility(documents(spark, sf_dir)).drop("key")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    placed = sharding.kd_shards(documents(spark, sf_dir), sharding.document_dims(), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree to 90 % or more."""
    return jaccard.near_copies(documents(spark, sf_dir), size=3, part=9, whole=10).select("doc_id", "n_shingles", "component_id")


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for every document that evens out the languages' expected tokens."""
    docs = documents(spark, sf_dir)
    labelled = docs.select("text", F.col("lang").alias("label"))
    rates = mixing.fit_rates(docs, labelled, temperature=0.0)
    return rates.select("doc_id", "tokens", "domain", F.array_max("p").alias("posterior"), "p", "rate", "copies")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts and the row of each that stays."""
    marked = exact.mark_exact_copies(documents(spark, sf_dir), carry=["doc_id"])
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds that are not held out."""
    docs = documents(spark, sf_dir)
    held_out = id_hash() % 4 == 2
    found = language.identify_languages(docs, docs.where(~held_out).select("lang", "text"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one full of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    trees = chat.conversations_as_trees(rows.unionByName(planted))
    return chat.chat_digests(chat.format_reply_trees(trees))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of passages of 50 words or more that documents share."""
    return substrings.repeated_passages(documents(spark, sf_dir))


def op10_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of the folds that are not held out."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    held_out = id_hash() % 3 == 1
    found = toxicity.score_toxicity(docs, labels.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_phrase_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language, counted over a prefix-free parse of every document."""
    return phrases.collocations(documents(spark, sf_dir), least=100, longest=5, top=2000)


def op12_sorted_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, with typos planted by checksum, and the spelling each belongs to."""
    return spelling.spelling_groups(documents(spark, sf_dir), every=97, least_letters=5, least=3, times=2)


def op13_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document, learned from the folds that are not held out."""
    docs = documents(spark, sf_dir)
    held_out = id_hash() % 7 == 2
    found = kneser.score_texts(docs, docs.where(~held_out), carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), *kneser.ADDED)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_hilbert_packing,
        op2_tokenizer_fertility,
        op3_kd_shards,
        op4_jaccard_join,
        op5_soft_mixing,
        op6_exact_dedup,
        op7_cross_parsing,
        op8_reply_trees,
        op9_compact_windows,
        op10_nb_ngrams,
        op11_phrase_parsing,
        op12_sorted_spelling,
        op13_kneser_ney,
    )
}
