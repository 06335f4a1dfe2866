"""Helpers the text operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leaguestats.checkpoints import is_small


_BATCH_ROWS, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_arrow_batches(spark: SparkSession, rows: int = 500) -> None:
    """Send texts to Python in batches of few rows, unless the session has its own batch size.

    Two tasks of an executor hold several copies of a batch each, and texts are long.
    """
    if spark.conf.get(_BATCH_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_BATCH_ROWS, str(rows))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns an operator is about to add; names compare without case."""
    taken = {name.lower() for name in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def hashed_stretch(name: str, length: int) -> Column:
    """``length`` characters in a row of a text, from a place its hash chooses anywhere in it.

    A text of up to twice as many stays whole.
    """
    room = f"greatest(char_length(`{name}`) - {length} + 1, 1)"
    stretch = f"substring(`{name}`, cast(pmod(xxhash64(`{name}`, 1), {room}) as int) + 1, {length})"
    return F.expr(f"if(char_length(`{name}`) <= {2 * length}, `{name}`, {stretch})")


def literals(values: Sequence, kind: str) -> Column:
    """An array column of plain values."""
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def id_hash(name: str = "doc_id") -> Column:
    """crc32 of an id written as text; the folds of the labelled tables are built on it."""
    return F.crc32(F.encode(F.col(name).cast("string"), "UTF-8"))


def _beside(docs: DataFrame, side: DataFrame, how: str, doc_id: str, text: str) -> DataFrame:
    """``docs`` joined with a written table of rows named by ``_k_id`` and ``_k_text`` (id and hash of the text).

    A table of at most ``SMALL_ROWS`` rows is broadcast; a larger one joins by shuffle.
    """
    named = side.select(*[F.col(c).alias(_free(c, docs)) for c in side.columns])
    named = F.broadcast(named) if is_small(side) else named
    own_id, own_text = _free("_k_own_id", docs), _free("_k_own_text", docs)
    keyed = docs.withColumns({own_id: F.col(f"`{doc_id}`"), own_text: F.xxhash64(F.col(f"`{text}`"))})
    return keyed.join(named, F.col(own_id).eqNullSafe(F.col(_free("_k_id", docs))) & (F.col(own_text) == F.col(_free("_k_text", docs))), how)


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def less(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``dropped`` names."""
    return _beside(docs, dropped, "left_anti", doc_id, text).select(*[f"`{c}`" for c in docs.columns])


def only(docs: DataFrame, named: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``named`` names."""
    return _beside(docs, named, "left_semi", doc_id, text).select(*[f"`{c}`" for c in docs.columns])


def replicated(docs: DataFrame, counted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each row that ``counted`` names ``_k_copies`` times, and all others once."""
    copies, copy = _free("_k_copies", docs), _free("_k_copy", docs)
    times = _beside(docs, counted, "left", doc_id, text).withColumn(copies, F.coalesce(copies, F.lit(1)))
    repeated = times.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return repeated.select(*[f"`{c}`" for c in docs.columns])
