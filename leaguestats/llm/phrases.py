"""Collocations counted over a prefix-free parse of the texts.

Each piece of text is parsed into chunks: a chunk starts where the hash of the
next few words says so, and reaches to the end of the next such place, so that
neighbours overlap by the words of one place.  Equal passages give equal chunks
wherever they stand, and texts shrink to a dictionary of chunks with frequencies.
Phrases are counted inside the distinct chunks only, times the frequency; one that
starts in the overlap belongs to the later chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from leaguestats.checkpoints import Scratch, durable
from leaguestats.llm.common import small_arrow_batches
from leaguestats.llm.hashfiles import PIECE, SIZED, merging, part_bits, part_sizes, pieces, sorted_parts
from leaguestats.llm.wordarrays import Words, chained, gathered, mix, one_array, word_hashes

BREAKS = r"[.,;:!?\x0A-\x0D]"  # fixed value: what ends a piece
_COUNTED = "lang string, phrase string, size int, n long"
_BATCH = 8 << 20  # bytes that a task counts at once; more of them repeat each other less


def _strings(names: pa.Array, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words ``starts[i]`` to ``starts[i] + lengths[i]`` of coded words, joined by spaces."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(codes[at]))), " ")


def _parse(overlap: int, modulus: int) -> Callable:
    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, _BATCH):
            texts = pc.replace_substring_regex(pc.fill_null(one_array(table["text"]), ""), BREAKS, " . ")
            words = Words(texts)
            mark = words.names.index(".").as_py()
            real = words.codes != mark  # a full stop is no part of any word now
            owner = np.repeat(np.arange(len(texts)), np.diff(words.starts))
            piece = (np.cumsum(~real) + owner)[real]  # rises at each break and each text
            codes, owner = words.codes[real], owner[real]
            if not len(codes):
                continue
            opens = np.concatenate(([True], piece[1:] != piece[:-1]))
            chosen = chained(words.hashes[codes], overlap) % np.uint64(modulus) == 0
            chosen &= piece[: len(chosen)] == piece[overlap - 1 :][: len(chosen)]
            trigger = np.zeros(len(codes), bool)
            trigger[: len(chosen)] = chosen
            starts = np.flatnonzero(opens | trigger)
            ends = np.concatenate((starts[1:], [len(codes)]))
            last = np.concatenate((opens[starts[1:]], [True]))  # of its piece
            chunks = _strings(words.names, codes, starts, ends - starts + np.where(last, 0, overlap))
            made = pa.table({"lang": one_array(table["lang"]).take(pa.array(owner[starts])), "chunk": chunks, "last": last})
            counted = made.group_by(["lang", "chunk", "last"]).aggregate([([], "count_all")])
            yield from counted.rename_columns(["lang", "chunk", "last", "n"]).combine_chunks().to_batches()

    return parse


def parsed(docs: DataFrame, overlap: int, modulus: int) -> DataFrame:
    """(lang, chunk, last, n): the distinct chunks of (lang, text) and how often the parse has them.

    ``last`` chunks end their piece; the others end with ``overlap`` words that
    the next chunk starts with.
    """
    chunks = docs.mapInArrow(_parse(overlap, modulus), "lang string, chunk string, last boolean, n long")
    return chunks.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def _keys(words: Words, langs: pa.Array, owner: np.ndarray, size: int) -> np.ndarray:
    """Hash of language and phrase for each word that a phrase of ``size`` words may start at."""
    tongue = langs.dictionary_encode()
    # Hashed once more than a word: a language may be called like a word of another.
    salt = mix(~mix(word_hashes(tongue.dictionary)))[tongue.indices.to_numpy(zero_copy_only=False)]
    keys = chained(words.hashes[words.codes], size)
    return keys ^ salt[owner[: len(keys)]]


def _count(sizes: Sequence[int], overlap: int, gate: tuple[str, str, int, tuple[int, ...]] | None) -> Callable:
    """Count phrases of the given sizes in chunks.

    ``gate`` names a stored set of phrases of one smaller size (folder, name, size,
    sizes of parts): a phrase counts only if all phrases of that size in it are in
    the set.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, _BATCH):
            words, langs = Words(one_array(table["chunk"])), one_array(table["lang"])
            lengths = np.diff(words.starts)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            # Words from here to the end of the chunk; and whether a phrase that starts here is this chunk's.
            reach = words.starts[1:][owner] - np.arange(len(owner))
            own = (reach > overlap) | one_array(table["last"]).to_numpy(zero_copy_only=False)[owner]
            weight = table["n"].to_numpy()[owner]
            sound = np.ones(len(owner), bool)
            if gate:
                folder, name, part, held = gate
                sound[:] = False
                keys = _keys(words, langs, owner, part)
                whole = reach[: len(keys)] >= part
                sound[: len(keys)][whole] = sorted_parts(folder, name, (), held).find(keys[whole]) >= 0
            for size in sizes:
                fits = own & (reach >= size)
                for k in range(size - gate[2] + 1 if gate else 0):
                    fits[: len(fits) - k] &= sound[k:]
                at = np.flatnonzero(fits)
                if not len(at):
                    continue
                _, first, inverse = np.unique(_keys(words, langs, owner, size)[at], return_index=True, return_inverse=True)
                n = np.zeros(len(first), np.int64)
                np.add.at(n, inverse, weight[at])
                where = at[first]
                phrases = _strings(words.names, words.codes, where, np.full(len(where), size))
                columns = [langs.take(pa.array(owner[where])), phrases, pa.array(np.full(len(where), size, np.int32)), pa.array(n)]
                yield from pa.Table.from_arrays(columns, ["lang", "phrase", "size", "n"]).to_batches(max_chunksize=100_000)

    return count


def _counted(chunks: DataFrame, sizes: Sequence[int], overlap: int, gate: tuple | None = None) -> DataFrame:
    found = chunks.mapInArrow(_count(sizes, overlap, gate), _COUNTED)
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def _deal_phrases(size: int, bits: int) -> Callable:
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, _BATCH):
            words = Words(one_array(table["phrase"]))
            langs = one_array(table["lang"])
            starts = words.starts[:-1]
            keys = np.unique(_keys(words, langs, np.repeat(np.arange(len(langs)), size), size)[starts])
            yield pieces(keys, np.ones(len(keys), np.uint64), bits)

    return deal


def _gate(phrases: DataFrame, size: int, scratch: Scratch) -> tuple[str, str, int, tuple[int, ...]]:
    """Store the hashes of phrases of one size as sorted arrays that workers map."""
    folder, name = f"{scratch.path}/phrases", f"of{size}"
    bits = part_bits(phrases.count())
    dealt = phrases.select("lang", "phrase").mapInArrow(_deal_phrases(size, bits), PIECE)
    rows = dealt.groupBy("part").applyInArrow(merging(folder, name), SIZED).collect()
    return folder, name, size, part_sizes(rows, bits)


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(18,0)")


def _scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words or more with their lowest-scoring cut (the first of equals).

    Products have up to 37 digits and are divided as whole numbers.
    """
    words = F.split("phrase", " ")
    cuts = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("_w"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumns({"_first": F.expr("array_join(slice(_w, 1, k), ' ')"), "_rest": F.expr("array_join(slice(_w, k + 1, size), ' ')")}).drop("_w")
    first = phrases.select("lang", F.col("phrase").alias("_first"), F.col("n").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r"))
    joined = cuts.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"]).join(F.broadcast(totals), "lang")
    joined = joined.withColumn("_a1000", (F.col("a") * 1000)).withColumns({"_top": _whole("_a1000") * _whole("total"), "_bottom": _whole("l") * _whole("r")})
    best = joined.withColumn("score", F.expr("_top div _bottom")).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("size").alias("size"), F.first("total").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score")


def _inside_longer(scored: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a) of all parts of two words or more of candidates, with the candidate's count."""
    places = F.expr(f"filter(flatten(transform(sequence(2, {longest}), s -> transform(sequence(1, {longest}), i -> struct(i, s)))), x -> x.s < size and x.i + x.s <= size + 1)")
    parts = scored.where("size > 2").select("lang", "a", F.split("phrase", " ").alias("_w"), F.explode(places).alias("x"))
    return parts.select("lang", F.expr("array_join(slice(_w, x.i, x.s), ' ')").alias("phrase"), F.col("a").alias("_longer")).groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = 100,
    longest: int = 5,
    top: int | None = 2000,
    modulus: int = 24,
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words per language.

    Texts are lower-cased (A-Z), split into pieces at ``BREAKS`` and those into
    words at spaces and tabs.  A phrase is a candidate with ``least`` occurrences
    or more; its score is that of its lowest-scoring cut in two, floor(1000 * a *
    n / (l * r)).  Candidates inside a longer candidate that is as frequent go.
    Returns (lang, rank, phrase, a, l, r, n, score), the first ``top`` of each
    language by score, then count, then phrase (None: all).

    A chunk has about ``modulus`` words where the text has no break.  A NULL text
    is empty, a NULL language ``und``; repeated rows count each; other columns do
    not matter; no text gives no rows.  All counts cover the whole texts: a set of
    frequent shorter phrases only spares counting phrases that cannot be frequent.
    """
    overlap = longest - 1
    small_arrow_batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        told = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
        chunks = scratch.keep(parsed(told, overlap, modulus))
        singles = scratch.keep(_counted(chunks, [1], overlap))
        totals = scratch.keep(singles.groupBy("lang").agg(F.sum("n").alias("total")))
        frequent = [scratch.keep(singles.where(F.col("n") >= least))]
        scratch.drop(singles)
        frequent.append(scratch.keep(_counted(chunks, [2], overlap, _gate(frequent[0], 1, scratch)).where(F.col("n") >= least)))
        if longest > 2:
            longer = _counted(chunks, range(3, longest + 1), overlap, _gate(frequent[1], 2, scratch))
            frequent.append(scratch.keep(longer.where(F.col("n") >= least)))
        phrases = frequent[0]
        for table in frequent[1:]:
            phrases = phrases.unionByName(table)
        scored = scratch.keep(_scored(phrases, totals))
        kept = scored.join(_inside_longer(scored, longest), ["lang", "phrase"], "left").where("_longer is null or _longer < a")
        order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
        if top is not None:
            # First the best of each of 64 shares of a language, so that no task sorts a whole language.
            share = F.pmod(F.xxhash64("phrase"), F.lit(64))
            kept = kept.withColumn("_share", share).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order)))
            kept = kept.where(F.col("_place") <= top)
        ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
        if top is not None:
            ranked = ranked.where(F.col("rank") <= top)
        return durable(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
