"""Interpolated modified Kneser-Ney language model over words.

The model is counted in Spark: words by name, pairs of neighbouring words as
packed sorted runs that tasks merge part by part.  It is stored as sorted arrays
of hashes in the shared folder, which workers memory-map to score texts; nothing
of it passes the driver but a few totals and the sizes of the parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leaguestats.checkpoints import Scratch, durable
from leaguestats.llm.common import small_arrow_batches, without
from leaguestats.llm.hashfiles import (
    PIECE,
    SIZED,
    arrow_schema,
    merging,
    packed,
    packed_sorted,
    part_bits,
    part_sizes,
    pieces,
    save,
    small_counts,
    sorted_parts,
    summed,
    unpacked,
    unpacked_sorted,
)
from leaguestats.llm.wordarrays import Words, gathered, mix, one_array, unmix, word_hashes

END = "\n"  # the end of a text, counted as a token; no word holds white space
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


@dataclass(frozen=True)
class Model:
    """Totals of the training texts and where the arrays lie.

    ``words``: hash of each word, its count, in how many different words' company
    it comes second (``left``) and how many words follow it once, twice, or more
    often (``after``).  A word's place in that array is its number.  ``pairs``:
    scrambled pairs of numbers and their counts.
    """

    folder: str
    word_sizes: tuple[int, ...]
    pair_sizes: tuple[int, ...]
    texts: int
    tokens: int
    vocabulary: int
    pair_kinds: tuple[int, int, int, int]
    left_kinds: tuple[int, int, int, int]
    left_classes: tuple[int, int, int]
    after_start: tuple[int, int, int]

    @property
    def start(self) -> int:
        """The number that stands before the first word of a text."""
        return sum(self.word_sizes)


def discounts(kinds: tuple[int, int, int, int]) -> np.ndarray:
    """What counts of 0, 1, 2, 3 and more lose, from how many counts are 1, 2, 3 and 4.

    The closed form of the modified smoothing; where it is undefined or leaves
    (0, k) for a count of k, as with few texts, half the count.
    """
    made = [0.0]
    share = kinds[0] / (kinds[0] + 2 * kinds[1]) if kinds[0] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * share * kinds[k] / kinds[k - 1] if kinds[k - 1] else 0.0
        made.append(d if 0 < d < k else k / 2)
    return np.array(made)


def _tokens(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, and the codes of all tokens with an end after each text, and where texts end.

    The end has the code after the last word's.
    """
    words = Words(texts)
    ends = words.starts[1:] + np.arange(1, len(words.starts))
    codes = np.full(len(words.codes) + len(texts), len(words.names), np.int64)
    codes[np.delete(np.arange(len(codes)), ends - 1)] = words.codes
    return words, codes, ends


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches):
        words, codes, _ = _tokens(one_array(table["text"]))
        counts = np.bincount(codes, minlength=len(words.names) + 1)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.names, pa.array([END])]), pa.array(counts)], ["word", "n"])


def _deal_words(bits: int) -> Callable:
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            keys = word_hashes(one_array(table["word"]))
            order = np.argsort(keys)
            yield pieces(keys[order], table["n"].to_numpy()[order], bits)

    return deal


def _places(model: Model, words: Words) -> np.ndarray:
    """Numbers of the distinct words and of the end, -1 for unknown ones."""
    held = sorted_parts(model.folder, "words", ("words_n", "left", "after"), model.word_sizes)
    return held.find(np.concatenate((words.hashes, word_hashes(pa.array([END])))))


def _pairs(places: np.ndarray, codes: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, number) of each token; ``start`` stands before the first of a text."""
    number = places[codes]
    before = np.concatenate(([start], number[:-1]))
    before[ends[:-1]] = start
    return before, number


def _key(before: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix((before.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64))


def _deal_pairs(model: Model, bits: int, most: int = 1 << 20) -> Callable:
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for table in gathered(batches):
            words, codes, ends = _tokens(one_array(table["text"]))
            held.append(_key(*_pairs(_places(model, words), codes, ends, model.start)))
            if sum(map(len, held)) >= most:
                yield pieces(*np.unique(np.concatenate(held), return_counts=True), bits)
                held = []
        if held:
            yield pieces(*np.unique(np.concatenate(held), return_counts=True), bits)

    return deal


def _deal_company(model: Model) -> Callable:
    """From stored pairs: who follows a word and whom it follows, as pieces for the parts of the words.

    Counts come in a column of four: followers once, twice, more often, and
    different words before.
    """
    bases = np.concatenate(([0], np.cumsum(model.word_sizes)))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted_parts(model.folder, "pairs", ("pairs_n",), model.pair_sizes)
        for batch in batches:
            for part in batch.column("part").to_pylist():
                both, n = unmix(pairs._part("pairs", part)), np.asarray(pairs._part("pairs_n", part))
                before, number = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
                after = np.zeros((len(n), 4), np.uint64)
                after[np.arange(len(n)), np.minimum(n, 3).astype(np.int64) - 1] = 1
                behind = np.zeros((len(n), 4), np.uint64)
                behind[:, 3] = 1
                who, sums = summed(np.concatenate((before, number)), np.concatenate((after, behind)))
                cuts = np.searchsorted(who, bases.astype(np.uint64))
                # What stands before the first word has the number after the last word's and goes to a part of its own.
                spans = [*zip(range(len(cuts) - 1), cuts[:-1], cuts[1:]), (len(cuts) - 1, cuts[-1], len(who))]
                rows = [{"part": p, "keys": packed_sorted(who[a:b]), "counts": packed(sums[a:b].reshape(-1))} for p, a, b in spans if b > a]
                yield from pa.Table.from_pylist(rows, arrow_schema(PIECE)).to_batches()

    return deal


_COMPANY = "part int, m1 long, m2 long, m3 long, n1 long, n2 long, n3 long, n4 long, total long"


def _store_company(model: Model) -> Callable:
    bases = np.concatenate(([0], np.cumsum(model.word_sizes)))

    def store(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        who = np.concatenate([unpacked_sorted(x) for x in table["keys"].to_pylist()])
        who, sums = summed(who, np.concatenate([unpacked(x).reshape(-1, 4) for x in table["counts"].to_pylist()]))
        names = [n.split()[0] for n in _COMPANY.split(", ")]
        if part == len(bases) - 1:
            row = [part, *map(int, sums[0, :3]), 0, 0, 0, 0, 0]
            return pa.Table.from_pylist([dict(zip(names, row))], arrow_schema(_COMPANY))
        whole = np.zeros((model.word_sizes[part], 4), np.int64)
        whole[who.astype(np.int64) - bases[part]] = sums
        save(model.folder, f"after-{part}", whole[:, :3].astype(np.uint32))
        save(model.folder, f"left-{part}", whole[:, 3].astype(np.uint32))
        left = whole[:, 3]
        classes = [int((left == 1).sum()), int((left == 2).sum()), int((left >= 3).sum())]
        row = [part, *classes, *small_counts(left), int(left.sum())]
        return pa.Table.from_pylist([dict(zip(names, row))], arrow_schema(_COMPANY))

    return store


def fit(texts: DataFrame, scratch: Scratch, part_rows: int = 1 << 19) -> Model:
    """Count the model of a column ``text``; its files live as long as ``scratch``.

    Counts cover every row.  Words are told apart by 64-bit hashes, and there
    are at most 2**32 - 1 of them.
    """
    folder = f"{scratch.path}/model"
    small_arrow_batches(texts.sparkSession)
    counted = texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.keep(counted.where("n > 0"))
    vocabulary, tokens, ends = words.agg(F.count("*"), F.sum("n"), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    bits = part_bits(vocabulary, part_rows)
    stored = words.mapInArrow(_deal_words(bits), PIECE).groupBy("part").applyInArrow(merging(folder, "words"), SIZED).collect()
    sizes = part_sizes(stored, bits)
    if sum(sizes) >= (1 << 32) - 1:
        raise ValueError("more words than 32-bit numbers")
    model = Model(folder, sizes, (0,), ends or 0, tokens or 0, vocabulary, (0,) * 4, (0,) * 4, (0,) * 3, (0,) * 3)
    if not model.tokens:
        return model
    bits = part_bits(model.tokens, part_rows)
    pieces = texts.mapInArrow(_deal_pairs(model, bits), PIECE)
    merged = scratch.keep(pieces.groupBy("part").applyInArrow(merging(folder, "pairs"), SIZED))
    rows = merged.collect()
    model = Model(**vars(model) | {"pair_sizes": part_sizes(rows, bits), "pair_kinds": tuple(sum(r[f"n{k}"] for r in rows) for k in (1, 2, 3, 4))})
    company = merged.select("part").repartition(len(rows)).mapInArrow(_deal_company(model), PIECE)
    rows = company.groupBy("part").applyInArrow(_store_company(model), _COMPANY).collect()
    own, start = [r for r in rows if r.part < len(sizes)], [r for r in rows if r.part == len(sizes)]
    return Model(
        **vars(model)
        | {
            "left_kinds": tuple(sum(r[f"n{k}"] for r in own) for k in (1, 2, 3, 4)),
            "left_classes": tuple(sum(r[f"m{k}"] for r in own) for k in (1, 2, 3)),
            "after_start": tuple(sum(r[f"m{k}"] for r in start) for k in (1, 2, 3)),
        }
    )


def log_probabilities(model: Model, words: Words, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token by the model, and its count among the training tokens."""
    held = sorted_parts(model.folder, "words", ("words_n", "left", "after"), model.word_sizes)
    places = _places(model, words)
    count = held.take("words_n", places)
    if not model.tokens:
        return np.ones(len(codes)), count[codes]
    pairs = sorted_parts(model.folder, "pairs", ("pairs_n",), model.pair_sizes)
    left, after = held.take("left", places), held.take("after", places).reshape(-1, 3)
    lower, upper = discounts(model.left_kinds), discounts(model.pair_kinds)
    kinds = sum(model.pair_sizes)
    # One share of the mass for each word of the vocabulary and one for all unknown words.
    even = lower[1:] @ np.array(model.left_classes) / kinds / (model.vocabulary + 1)
    single = np.maximum(left - lower[np.minimum(left, 3)], 0) / kinds + even

    before, number = _pairs(places, codes, ends, model.start)
    known = (before >= 0) & (number >= 0)
    seen = np.zeros(len(codes), np.int64)
    at = pairs.find(_key(before[known], number[known]))
    seen[known] = pairs.take("pairs_n", at)
    # Of what stands before: how often it stands there, and the mass its followers leave over.
    code_before = np.concatenate(([0], codes[:-1]))
    total = np.where(before == model.start, model.texts, count[code_before])
    spared = np.where(before == model.start, upper[1:] @ np.array(model.after_start), (after @ upper[1:])[code_before])
    with np.errstate(divide="ignore", invalid="ignore"):
        pair = (np.maximum(seen - upper[np.minimum(seen, 3)], 0) + spared * single[codes]) / total
    return np.where(before >= 0, pair, single[codes]), count[codes]


def _score(model: Model, names: list[str]) -> Callable:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            words, codes, ends = _tokens(one_array(table["_text"]))
            starts = np.concatenate(([0], ends[:-1]))
            p, count = log_probabilities(model, words, codes, ends)
            base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
            made = {
                "n_tokens": ends - starts,
                "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
                "train_tokens": np.full(len(ends), model.tokens),
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(np.log10(p), starts),
            }
            kept = table.drop_columns(["_text"])
            whole = pa.Table.from_arrays([*kept.columns, *[pa.array(made[n]) for n in ADDED]], [*names, *ADDED])
            yield from whole.to_batches()

    return score


def score_texts(docs: DataFrame, training: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the log10 probability of every whole text under a model of ``training``.

    Tokens are words, A-Z lower-cased, and one end a text.  Added: n_tokens,
    n_known (tokens seen in training), train_tokens, base_score (add-one word
    counts) and score (the model).  A NULL or empty text is its end alone.  Rows
    stay as they are: repeated rows and NULL ids are scored each, columns of
    ``docs`` with an added name give way (compared without case).  With no
    training text every score is 0.  ``carry`` names the columns of ``docs`` to
    return (default: all but the text).
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        model = fit(training.select(F.col(f"`{text}`").alias("text")), scratch)
        kept = without(docs.select(*[f"`{c}`" for c in carry]) if carry is not None else docs.drop(text), ADDED)
        # The text goes along under a name of its own; others keep theirs.
        rows = docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"`{text}`").alias("_text"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        added = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return durable(rows.mapInArrow(_score(model, kept.columns), f"{fields}, {added}" if fields else added))
