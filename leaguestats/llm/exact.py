"""Exact copies by two-pass Bloom filtering."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from leaguestats.checkpoints import Scratch, durable
from leaguestats.llm.common import text_or_empty, without

BLOCK_BITS = 32_768  # of one bitmap, as Spark's bitmap functions size it
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def _slot(text: str, bits: int) -> Column:
    return F.xxhash64(text_or_empty(text)).bitwiseAND(F.lit((1 << bits) - 1))


def _bit(slot: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(slot, F.lit(k)), F.lit(BLOCK_BITS))


def slot_filter(slots: DataFrame, bits_per_key: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The two filters over a column ``slot``: which slots are set more than once, folded into bitmaps.

    The first is a filter with one hash: each row sets a slot, and only slots are
    counted, partly before they shuffle.  The second holds the slots set twice,
    two bits of one block of ``BLOCK_BITS`` for each.  Returns (block, bitmap) rows
    and the number of blocks.
    """
    twice = scratch.keep(slots.groupBy("slot").count().where("count > 1").select("slot"))
    blocks = max(1, math.ceil(twice.count() * bits_per_key / BLOCK_BITS))
    bits = twice.select(
        F.pmod(F.xxhash64("slot"), F.lit(blocks)).alias("block"),
        F.explode(F.array(_bit(F.col("slot"), 1), _bit(F.col("slot"), 2))).alias("bit"),
    )
    bitmaps = scratch.keep(bits.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")))
    scratch.drop(twice)
    return bitmaps, blocks


def _has_bit(k: int) -> Column:
    bit = f"pmod(xxhash64(slot, {k}), {BLOCK_BITS})"
    byte = f"cast(conv(hex(substring(bitmap, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.expr(f"coalesce((shiftright({byte}, cast({bit} % 8 as int)) & 1) = 1, false)")


def has_bits() -> Column:
    """Whether ``bitmap`` holds both bits of ``slot``."""
    return _has_bit(1) & _has_bit(2)


def mark_exact_copies(
    docs: DataFrame,
    carry: Sequence[str] | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    bits_per_slot: int = 64,
    bits_per_key: int = 16,
    filter_bytes: int = 64 << 20,
) -> DataFrame:
    """Group rows whose texts are identical and mark the one that stays.

    Pass one hashes every text to a slot and keeps the slots set twice as a
    bitmap (``slot_filter``).  Pass two probes the bitmap in the scan: rows
    that miss are alone and pass straight through; only rows that hit (repeats,
    and about one chance hit in ``bits_per_slot``) shuffle, by SHA-256 of the text.
    A bitmap of up to ``filter_bytes`` is broadcast; a larger one is joined by
    block, which shuffles the rows.

    ``carry``: columns that come through (all by default); a carried column
    named like an added one gives way.  Adds ``keep_id`` (id of the row that
    stays), ``group_size``, ``kept``, ``text_sha256``.  A null text counts as
    empty.  Of equal texts the largest id stays; a null id is the smallest, and
    of rows with the same text and id exactly one stays.  An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    carried = without(docs.select(*[f"`{c}`" for c in carry]) if carry else docs, ADDED).columns
    slot_bits = max(15, math.ceil(math.log2(max(1, docs.count()) * bits_per_slot)))
    with Scratch(spark) as scratch:
        bitmaps, blocks = slot_filter(docs.select(_slot(text, slot_bits).alias("slot")), bits_per_key, scratch)
        bitmaps = durable(bitmaps)
    if blocks * BLOCK_BITS // 8 <= filter_bytes:
        bitmaps = F.broadcast(bitmaps)
    names = {c: f"_c{i}" for i, c in enumerate(carried)}
    probed = (
        docs.select(
            *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
            F.col(f"`{doc_id}`").alias("_id"),
            text_or_empty(text).alias("_text"),
            _slot(text, slot_bits).alias("slot"),
        )
        .withColumn("block", F.pmod(F.xxhash64("slot"), F.lit(blocks)))
        .join(bitmaps, "block", "left")
        .withColumn("_maybe", has_bits())
    )
    digest = F.sha2(F.col("_text"), 256).alias("text_sha256")
    given = [F.col(n).alias(c) for c, n in names.items()]
    # Row numbers stay fixed once written: they tell rows with the same id and text apart.
    repeats = durable(
        probed.where("_maybe").select(*names.values(), "_id", digest, F.monotonically_increasing_id().alias("_row"))
    )
    groups = repeats.groupBy("text_sha256").agg(
        F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size")
    )
    grouped = repeats.join(groups, "text_sha256").select(
        *given,
        F.col("_keep._id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        "text_sha256",
    )
    alone = probed.where("not _maybe").select(
        *given, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest
    )
    return alone.unionByName(grouped)
