"""Documents whose sets of word shingles nearly agree: an exact join in the metric space of Jaccard distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leaguestats.checkpoints import Scratch, durable, is_small
from leaguestats.llm.common import small_arrow_batches
from leaguestats.llm.exact import BLOCK_BITS, has_bits, slot_filter
from leaguestats.llm.graph import components
from leaguestats.llm.shingles import mix, shingles, sums, word_hashes
from leaguestats.llm.tokens import small_batches

SKETCH_WORDS = 8  # of 64 bits


def shingle_set(text: str, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted numbers, those of most letters first.

    The top byte falls with the shingle's length, which puts rare shingles first
    without counting any; the rest is a hash.
    """
    words, lengths = word_hashes(text)
    weight = (255 - np.minimum(sums(lengths, size), 255)).astype(np.uint64) << np.uint64(56)
    return np.unique(weight | (shingles(words, size) >> np.uint64(8)))


def _sketch(found: np.ndarray, bits: int) -> np.ndarray:
    """Parities of a set's members by hash class: sets that differ in k members differ in k bits at most.

    A sketch of half as many bits is the exclusive or of the two halves.
    """
    odd = np.bincount((mix(found) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _wide(n: int) -> int:
    """Bits of a sketch that still tells sets of n apart."""
    return 64 * SKETCH_WORDS << max(0, (n // (128 * SKETCH_WORDS)).bit_length())


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view("<i8"), pa.int64()))


def _reach(n: int, part: int, whole: int) -> int:
    """How many pivots of a set of n may be lacking in a set it links with, plus one."""
    return n + -part * n // whole + 1


def described(docs: DataFrame, size: int, part: int, whole: int, text: str, doc_id: str) -> DataFrame:
    """(row, doc_id, key, n, d1, d2, pivots, sketch, wide) of every text.

    ``row`` numbers rows, ``key`` hashes the text, n, d1 and d2 digest the set of
    shingles, ``pivots`` are the first of them, as many as ``_reach`` says;
    ``sketch`` has ``SKETCH_WORDS`` words, ``wide`` more for larger sets.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in small_batches(texts):
                found = [shingle_set(t, size) for t in texts[a:b]]
                with np.errstate(over="ignore"):
                    digests = [(int(f.sum().astype(np.int64)), int(mix(f).sum().astype(np.int64))) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(a, b - a) for c in ("row", "doc_id", "key")],
                        pa.array([len(f) for f in found], pa.int64()),
                        *[pa.array(d, pa.int64()) for d in zip(*digests)],
                        _lists([f[: _reach(len(f), part, whole)] for f in found]),
                        _lists([_sketch(f, 64 * SKETCH_WORDS) for f in found]),
                        _lists([_sketch(f, _wide(len(f))) for f in found]),
                    ],
                    ["row", "doc_id", "key", "n", "d1", "d2", "pivots", "sketch", "wide"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text")
    )
    return given.mapInArrow(describe, f"row bigint, doc_id {kind}, key bigint, n bigint, d1 bigint, d2 bigint, pivots array<bigint>, sketch array<bigint>, wide array<bigint>")


class JaccardJoin:
    """The steps of the join at a threshold of ``part`` / ``whole``; see ``near_copies``."""

    def __init__(self, texts: DataFrame, sets: DataFrame, size: int, part: int, whole: int, crowd: int, scratch: Scratch):
        self.texts, self.sets, self.size, self.part, self.whole = texts, sets, size, part, whole
        self.crowd, self.scratch = crowd, scratch

    def whole_sets(self, rows: DataFrame, moved: np.ndarray | None = None) -> DataFrame:
        """(row, set) of the rows named, found in their texts once more; only few rows need that.

        With ``moved`` the set is cut to its first pivots when those of ``moved``
        come last; ``last`` tells which they are.  At most ``SMALL_ROWS`` rows are
        broadcast to the texts.
        """
        size, part, whole = self.size, self.part, self.whole
        named = self.sets.select("row", F.col("doc_id").alias("_own"), F.col("key").alias("_key"))
        named = self.scratch.keep(named.join(F.broadcast(rows) if is_small(rows) else rows, "row", "left_semi"))
        same = F.col("_own").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.xxhash64("text"))
        given = self.texts.join(F.broadcast(named) if is_small(named) else named, same).select("row", "text")

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for a, b in small_batches(texts):
                    sets, flags = [], []
                    for t in texts[a:b]:
                        found = shingle_set(t, size)
                        last = np.zeros(len(found), bool)
                        if moved is not None:
                            last = np.isin(found, moved)
                            order = np.argsort(last, kind="stable")[: _reach(len(found), part, whole)]
                            found, last = found[order], last[order]
                        sets.append(found)
                        flags.append(last)
                    ends = np.concatenate(([0], np.cumsum([len(f) for f in flags])))
                    flags = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flags)))
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), _lists(sets), flags], ["row", "set", "last"])

        return given.mapInArrow(find, "row bigint, set array<bigint>, last array<boolean>")

    def similar_sizes(self, a: Column, b: Column) -> Column:
        return (self.whole * F.least(a, b) >= self.part * F.greatest(a, b)) & (a > 0) & (b > 0)

    def _few_enough(self, na: Column, nb: Column, differ: Column) -> Column:
        # |A - B| + |B - A| <= (na + nb) * (whole - part) / (whole + part) for linked sets
        return differ * (self.whole + self.part) <= (na + nb) * (self.whole - self.part)

    def close_sketches(self, na: Column, nb: Column, a: Column, b: Column) -> Column:
        """Whether the bits in which two sketches differ are no more than linked sets may differ in."""
        bits = [F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))) for i in range(SKETCH_WORDS)]
        return self._few_enough(na, nb, sum(bits, F.lit(0)))

    def close_wide(self, na: Column, nb: Column, a: Column, b: Column) -> Column:
        """The same for wide sketches; the longer is folded to the length of the shorter, at most half as long for linked sets."""
        length = F.least(F.size(a), F.size(b))

        def folded(x: Column) -> Column:
            halves = F.zip_with(F.slice(x, F.lit(1), length), F.slice(x, length + 1, length), lambda p, q: p.bitwiseXOR(q))
            return F.when(F.size(x) > length, halves).otherwise(x)

        bits = F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        return self._few_enough(na, nb, F.aggregate(bits, F.lit(0), lambda s, x: s + x))

    def postings(self, doubles: DataFrame, rounds: int, most_moved: int = 1_000_000) -> DataFrame:
        """(row, n, s): each set, less ``doubles``, in the regions of its first pivots, as far as more than one set is there.

        Pivots are single shingles.  A set lies at 1 - 1/n from those it holds and
        at 1 from all others; among the nearest, the first in order names its own
        region.  A set within the threshold lacks fewer than ``_reach`` of its
        shingles, so the first shingle both hold is among the first ``_reach`` of
        each, and replicating sets into those regions loses no link.  Any order
        will do, if all share it: crowded pivots, held by over ``crowd`` sets
        (the ``most_moved`` most crowded of them), move to its end in ``rounds``
        rounds, in which only sets that have them among their first change.
        """
        doubles = F.broadcast(doubles) if is_small(doubles) else doubles
        first = self.sets.where("n > 0").select("row", "n", "pivots").join(doubles, "row", "left_anti")
        posts = self.scratch.keep(first.select("row", "n", F.explode("pivots").alias("s"), F.lit(False).alias("last")))
        moved = np.zeros(0, np.int64)
        for _ in range(rounds):
            crowded = posts.where("not last").groupBy("s").count().where(F.col("count") > self.crowd)
            found = crowded.orderBy(F.desc("count"), "s").limit(max(0, most_moved - len(moved))).collect()
            if not found:
                break
            moved = np.append(moved, [r["s"] for r in found])
            listed = F.broadcast(self.sets.sparkSession.createDataFrame([(r["s"],) for r in found], "s bigint"))
            changed = self.scratch.keep(posts.join(listed, "s", "left_semi").select("row").distinct())
            changed_side = F.broadcast(changed) if is_small(changed) else changed
            again = (
                self.whole_sets(changed, moved.view(np.uint64))
                .select("row", F.explode(F.arrays_zip("set", "last")).alias("p"))
                .join(self.sets.select("row", "n").join(changed_side, "row", "left_semi"), "row")
                .select("row", "n", F.col("p.set").alias("s"), F.col("p.last").alias("last"))
            )
            after = self.scratch.keep(posts.join(changed_side, "row", "left_anti").select("row", "n", "s", "last").unionByName(again))
            self.scratch.drop(posts)
            posts = after
        slot_bits = max(15, math.ceil(math.log2(max(1, posts.count()) * 16)))
        slot = F.col("s").bitwiseAND(F.lit((1 << slot_bits) - 1))
        bitmaps, blocks = slot_filter(posts.select(slot.alias("slot")), 16, self.scratch)
        probed = posts.withColumn("slot", slot).withColumn("block", F.pmod(F.xxhash64("slot"), F.lit(blocks)))
        small = blocks * BLOCK_BITS // 8 <= 64 << 20
        return probed.join(F.broadcast(bitmaps) if small else bitmaps, "block").where(has_bits()).select("row", "n", "s")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among candidate pairs (a, b): sizes and sketches first, then whole sets."""
        likely = pairs
        for mark, close in (("sketch", self.close_sketches), ("wide", self.close_wide)):
            marks = self.sets.select("row", "n", mark)
            side = lambda c: marks.select(F.col("row").alias(c), F.col("n").alias(f"n{c}"), F.col(mark).alias(f"k{c}"))  # noqa: B023, E731
            marked = likely.join(side("a"), "a").join(side("b"), "b")
            sizes = [F.col("na"), F.col("nb")]
            likely = self.scratch.keep(marked.where(self.similar_sizes(*sizes) & close(*sizes, F.col("ka"), F.col("kb"))).select("a", "b"))
        rows = self.scratch.keep(likely.select(F.explode(F.array("a", "b")).alias("row")).distinct())
        needed = self.scratch.keep(self.whole_sets(rows).select("row", "set"))
        whole = likely.join(needed.select(F.col("row").alias("a"), F.col("set").alias("sa")), "a").join(
            needed.select(F.col("row").alias("b"), F.col("set").alias("sb")), "b"
        )
        shared = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - shared
        return self.scratch.keep(whole.where(self.whole * shared >= self.part * union).select("a", "b").distinct())

    def open_regions(self, regions: DataFrame, links: DataFrame) -> DataFrame:
        """(s, row, n, held, label) of the regions that hold several of the parts that ``links`` connect."""
        parts = components(links, self.scratch)
        parted = regions.join(parts.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
        parted = self.scratch.keep(parted.select("s", "row", "n", "held", "label"))
        several = parted.groupBy("s").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("s")
        return self.scratch.keep(parted.join(several, "s"))

    def compared(self, x: DataFrame, y: DataFrame, on: list[str], once: Column) -> DataFrame:
        """Candidate pairs (a, b) of two sides that meet in a region: of different parts, sizes and sketches close enough."""
        x, y = (side.select(*on, *[F.col(c).alias(f"{c}_{end}") for c in side.columns if c not in on]) for side, end in ((x, "x"), (y, "y")))
        likely = (
            (F.col("label_x") != F.col("label_y"))
            & once
            & self.similar_sizes(F.col("n_x"), F.col("n_y"))
            & F.coalesce(self.close_sketches(F.col("n_x"), F.col("n_y"), F.col("sketch_x"), F.col("sketch_y")), F.lit(True))
        )
        pairs = x.join(y, on).where(likely)
        return pairs.select(F.least("row_x", "row_y").alias("a"), F.greatest("row_x", "row_y").alias("b")).distinct()

    def links(self, posts: DataFrame) -> DataFrame:
        """Links enough to connect whatever links connect.

        Regions join recursively.  Each takes two of its sets as inner pivots and
        compares all others with them: one pair a member, however large the region.
        What that connects is one part.  Regions of over ``crowd`` sets that still
        hold several parts are dealt out to blocks of about as many by a hash of the
        set, in which all are compared: a group whose sets mostly link hangs
        together by then, and its links need not be found one by one.  Only pairs
        from different parts are left, and regions that hold some, and they are
        compared within windows: by the triangle inequality towards the empty set,
        linked sets are at most one step apart when sizes are cut in steps of the
        threshold.
        """
        sizes = posts.groupBy("s").agg(F.count(F.lit(1)).alias("held"), F.min("row").alias("low"), F.max("row").alias("high")).where("held > 1")
        regions = self.scratch.keep(posts.join(sizes, "s"))
        stars = regions.select(F.explode(F.array("low", "high")).alias("p"), "row").where("p <> row")
        stars = stars.select(F.least("p", "row").alias("a"), F.greatest("p", "row").alias("b")).distinct()
        links = self.verified(stars)
        rest = self.open_regions(regions.select("s", "row", "n", "held"), links)
        sketches = self.sets.select("row", "sketch")
        crowded = rest.where(F.col("held") > self.crowd)
        if not crowded.isEmpty():
            # The same sets share a block in all regions of about one size, so their pairs are the same pairs.
            power = F.ceil(F.log2(F.col("held") / F.lit(float(self.crowd)))).cast("int")
            block = F.xxhash64("row").bitwiseAND(F.expr("shiftleft(1L, power)") - 1)
            blocks = self.scratch.keep(crowded.withColumn("power", power).withColumn("block", block).join(sketches, "row").select("s", "block", "row", "n", "label", "sketch"))
            links = self.scratch.keep(links.unionByName(self.verified(self.compared(blocks, blocks, ["s", "block"], F.col("row_x") < F.col("row_y")))))
            rest = self.open_regions(rest.select("s", "row", "n", "held"), links)
        large = rest.where(F.col("held") > 32).join(sketches, "row")
        small = rest.where(F.col("held") <= 32).withColumn("sketch", F.lit(None).cast("array<bigint>"))
        step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(self.whole / self.part)) + 1e-9)
        rest = large.select("s", "row", "n", "label", "sketch").unionByName(small.select("s", "row", "n", "label", "sketch"))
        rest = self.scratch.keep(rest.withColumn("ring", step).withColumn("own", F.col("ring")))
        inner = rest.withColumn("ring", F.explode(F.array("ring", F.col("ring") - 1)))
        once = (F.col("own_x") != F.col("own_y")) | (F.col("row_x") < F.col("row_y"))
        return links.unionByName(self.verified(self.compared(rest, inner, ["s", "ring"], once)))


def near_copies(
    docs: DataFrame,
    size: int = 5,
    part: int = 8,
    whole: int = 10,
    crowd: int = 128,
    rounds: int = 2,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``part`` / ``whole`` or more, exactly.

    Words lie between ASCII white space, A-Z folded; a set holds the distinct
    runs of ``size`` words, or the whole sequence if it is shorter.  Equal sets
    are one class, and only one row of a class goes on.  Pivots (single
    shingles) make the regions of ``postings``; inside, regions join as told in
    ``links``; every candidate is verified on whole sets.

    Returns one row per document: doc_id, ``key`` (hash of the text), ``n_shingles``, ``component_id`` (the
    smallest doc_id reachable by links; ids that are null count last) and
    ``keep`` (true for one row of each component).  A null text, or one without
    words, is linked with nothing.  Repeated rows are equal sets.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    small_arrow_batches(docs.sparkSession)
    with Scratch(spark) as scratch:
        sets = scratch.keep(described(docs, size, part, whole, text, doc_id))
        texts = docs.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("text"))
        classes = scratch.keep(sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("row").alias("first")))
        join = JaccardJoin(texts, sets, size, part, whole, crowd, scratch)
        doubles = scratch.keep(sets.where("n > 0").select("row").join(classes.select(F.col("first").alias("row")), "row", "left_anti"))
        posts = scratch.keep(join.postings(doubles, rounds))
        labels = components(join.links(posts), scratch)
        rows = sets.select("row", "doc_id", "key", "n", "d1", "d2").join(classes, ["n", "d1", "d2"], "left")
        rows = rows.join(labels.withColumnRenamed("node", "first"), "first", "left")
        rows = scratch.keep(rows.select("row", "doc_id", "key", "n", F.coalesce("label", "first", "row").alias("label")))
        ids = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("keep"))
        result = rows.join(ids, "label").select(
            "doc_id", "key", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("keep.row")).alias("keep")
        )
        return durable(result)
