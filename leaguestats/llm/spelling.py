"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

The vocabulary is dealt into regions: words that share their first letters, or
their last, up to about half of the shorter word's length.  One edit leaves one of
the halves whole, so near words meet in a region.  In a region the rest of the
words is a sorted list, and the edit matrices of all queries run down that list
together: a row of the matrix belongs to a shared prefix, is worked out once for
the whole range of words with that prefix (their neighbours' common prefixes bound
the range) and has three cells, since one edit strays one cell from the diagonal.
A range whose rows all exceed one edit is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leaguestats.checkpoints import Scratch, durable
from leaguestats.llm.wordarrays import one_array

LETTERS = r"[A-Za-zÀ-ÿ]+"  # fixed value: what a run is made of
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FAR = 2  # any distance beyond one


def words_with_typos(docs: DataFrame, text: str, doc_id: str, every: int | None) -> DataFrame:
    """One row (word) per run of letters, A-Z lower-cased.

    With ``every``, a run loses a letter where the checksum of "<doc_id>:<run>" is
    a multiple of it: the letter at the checksum modulo the length.
    """
    runs = docs.select(
        F.col(f"`{doc_id}`").alias("_id") if every else F.lit(0).alias("_id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), _UPPER, _LOWER), F.lit(LETTERS), 0)).alias("word"),
    )
    if not every:
        return runs.select("word")
    named = F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    checked = runs.select("word", F.crc32(F.encode(named, "UTF-8")).alias("_h"))
    shorter = F.expr("concat(substring(word, 1, cast(_h % char_length(word) as int)), substring(word, cast(_h % char_length(word) as int) + 2))")
    return checked.select(F.when(F.col("_h") % every == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of words long and frequent enough."""
    return words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _halves(regions: DataFrame) -> DataFrame:
    """Deal the rows of regions out to two regions each: half of the free letters fixed at the front, or at the back.

    A region (size, front, back, key) holds the queries of ``size`` letters and the
    words of as many or one more that share ``front`` first and ``back`` last letters.
    """
    half = F.expr("(size - front - back) div 2").cast("int")
    both = regions.withColumn("_half", half).withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
    moved = both.withColumns(
        {
            "front": F.when(F.col("_side") == 0, F.col("front") + F.col("_half")).otherwise(F.col("front")),
            "back": F.when(F.col("_side") == 1, F.col("back") + F.col("_half")).otherwise(F.col("back")),
        }
    )
    key = F.concat(F.substring("word", F.lit(1), F.col("front")), F.lit(" "), F.expr("right(word, back)"))
    return moved.select("word", "size", "front", "back", key.alias("key"))


_REGION = ["size", "front", "back", "key"]


def near_pairs(words: DataFrame, scratch: Scratch, most_words: int = 20_000) -> DataFrame:
    """(a, b): pairs of different words with one insertion, deletion or replacement between them, each once, a < b.

    A region of more than ``most_words`` is dealt out again by halves of its free
    letters, until it is smaller or no two free letters are left; so no task gets
    more than it can hold, whatever prefix or ending is common.
    """
    sizes = F.array(F.char_length("word"), F.char_length("word") - 1)
    regions = _halves(words.select("word", F.explode(sizes).alias("size"), F.lit(0).alias("front"), F.lit(0).alias("back")))
    found = None
    while True:
        regions = scratch.keep(regions)
        counted = regions.groupBy(*_REGION).agg(F.count("*").alias("held"), F.max(F.char_length("word") == F.col("size")).alias("asked"))
        splits = F.col("size") - F.col("front") - F.col("back") >= 2
        counted = scratch.keep(counted.where("held > 1 and asked").withColumn("large", splits & (F.col("held") > most_words)).drop("asked"))
        placed = regions.join(counted, _REGION)
        pairs = placed.where("not large").repartition(*_REGION).sortWithinPartitions(*_REGION, "word").select("word", *_REGION)
        near = scratch.keep(pairs.mapInArrow(_find_near, "a string, b string"))
        found = near if found is None else found.unionByName(near)
        if counted.where("large").isEmpty():
            return found.distinct()
        regions = _halves(placed.where("large").select("word", *_REGION))


def _find_near(batches: Iterable[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows sorted by region and word; several whole regions at a time."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held.append(table)
        rows += len(table)
        if rows >= most:
            table = pa.concat_tables(held)
            # The last region may go on in the next batch.
            cut = int(_region_starts(table)[-1])
            if cut:
                yield from _near_in(table.slice(0, cut))
                held, rows = [table.slice(cut)], len(table) - cut
    if rows:
        yield from _near_in(pa.concat_tables(held))


def _region_starts(table: pa.Table) -> np.ndarray:
    changed = np.zeros(len(table), bool)
    changed[0] = True
    for name in ("size", "front", "back"):
        column = table[name].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    codes = one_array(table["key"]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    changed[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(changed)


class _Lists:
    """Sorted lists of letters, one a region: the free middles of its words."""

    def __init__(self, table: pa.Table):
        words = table["word"].to_pylist()
        front, back = table["front"].to_numpy().astype(np.int64), table["back"].to_numpy().astype(np.int64)
        starts = _region_starts(table)
        region = np.zeros(len(words), np.int64)
        region[starts[1:]] = 1
        region = np.cumsum(region)
        middles = [w[f : len(w) - b] for w, f, b in zip(words, front.tolist(), back.tolist())]
        # The words come sorted, but a cut ending can change the order of the middles.
        order = np.array(sorted(range(len(words)), key=list(zip(region.tolist(), middles)).__getitem__), np.int64)
        middles = [middles[i] for i in order]
        self.words = [words[i] for i in order]
        self.region = region[order]
        self.lengths = np.fromiter(map(len, middles), np.int64, len(middles))
        whole = np.fromiter(map(len, self.words), np.int64, len(middles))
        self.asks = whole == table["size"].to_numpy().astype(np.int64)[order]
        self.letters = np.frombuffer("".join(middles).encode("utf-32-le"), np.uint32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bounds = np.concatenate((starts, [len(words)]))

    def letter(self, rows: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """The letter of each row at a place, 0 beyond its ends."""
        inside = (at >= 0) & (at < self.lengths[rows])
        place = np.where(inside, self.starts[rows] + at, 0)
        return np.where(inside, self.letters[place], 0) if len(self.letters) else np.zeros(len(rows), np.uint32)

    def common_prefixes(self) -> np.ndarray:
        """Of each row and the one before it in its region; -1 for a region's first row."""
        common = np.full(len(self.words), -1, np.int64)
        rows = np.flatnonzero(self.region[1:] == self.region[:-1]) + 1
        depth = 0
        while len(rows):
            common[rows] = depth
            here, there = self.letter(rows, depth), self.letter(rows - 1, depth)
            rows = rows[(here == there) & (here > 0)]
            depth += 1
        return common


def _near_in(table: pa.Table, most_pairs: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """All near pairs (a < b) inside the regions of a table."""
    if not len(table):
        return
    lists = _Lists(table)
    common = lists.common_prefixes()
    asking = np.flatnonzero(lists.asks)
    # The first letters multiply by the words of a region; queries go down in groups that bound that.
    width = np.diff(lists.bounds)[lists.region[asking]]
    group = np.cumsum(np.minimum(width, 64)) // (most_pairs // 32)
    for start, end in zip(*_runs(group)):
        query, word = _descend(lists, common, asking[start:end])
        names = [(lists.words[q], lists.words[w]) for q, w in zip(query.tolist(), word.tolist())]
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in names]), pa.array([max(p) for p in names])], ["a", "b"])


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.diff(group)) + 1
    return np.concatenate(([0], cuts)).astype(int), np.concatenate((cuts, [len(group)])).astype(int)


def _descend(lists: _Lists, common: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (query, word) at distance one; all queries run down their lists at once, a letter a step.

    A range low..high has one shared prefix of ``depth`` letters.  Its row of the
    matrix holds the distances of that prefix to the query's first depth - 1, depth
    and depth + 1 letters.
    """
    low, high = lists.bounds[lists.region[query]], lists.bounds[lists.region[query] + 1]
    far = np.full(len(query), _FAR)
    cells = np.stack((far, np.zeros(len(query), np.int64), np.where(lists.lengths[query] > 0, 1, _FAR)), 1)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    depth = 0
    while len(query):
        # A word that ends here is the first of its range.
        ended = lists.lengths[low] == depth
        column = lists.lengths[query] - depth + 1
        inside = ended & (column >= 0) & (column <= 2)
        distance = np.full(len(query), _FAR)
        distance[inside] = cells[inside, column[inside]]
        hits.append((query[distance == 1], low[distance == 1]))
        # Ranges that share one more letter start where neighbours share no more than this many.
        least, most = low.min(), high.max()
        turns = np.flatnonzero(common[least:most] <= depth) + least
        first, last = np.searchsorted(turns, low + ended), np.searchsorted(turns, high)
        first = np.where(low + ended < high, first, last)
        n = np.maximum(last - first, 0)
        if not n.sum():
            break
        parent = np.repeat(np.arange(len(query)), n)
        at = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        low = turns[at]
        high = np.minimum(np.concatenate((turns[1:], [most]))[at], high[parent])
        query, old = query[parent], cells[parent]
        letter = lists.letter(low, depth)
        other = [(lists.letter(query, depth + k) != letter).astype(np.int64) for k in (-1, 0, 1)]
        cells = np.empty_like(old)
        # The new row is for depth + 1: to the query's first depth, depth + 1 and depth + 2 letters.
        cells[:, 0] = np.minimum(old[:, 0] + other[0], old[:, 1] + 1) if depth else 1
        cells[:, 1] = np.minimum(np.minimum(old[:, 1] + other[1], old[:, 2] + 1), cells[:, 0] + 1)
        cells[:, 2] = np.minimum(old[:, 2] + other[2], cells[:, 1] + 1)
        room = lists.lengths[query] - depth
        cells[room < 1, 1] = _FAR
        cells[room < 2, 2] = _FAR
        cells[room < 0, 0] = _FAR
        near = cells.min(1) < _FAR
        query, low, high, cells = query[near], low[near], high[near], cells[near]
        depth += 1
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): forms followed to the end, twice as far each round."""
    known = scratch.keep(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = scratch.keep(known.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        scratch.drop(known)
        known = moved
        if known.where("_moved").isEmpty():
            return known.select("word", "root")
        known = known.drop("_moved")
        known = scratch.keep(known)


def spelling_groups(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    every: int | None = None,
    least_letters: int = 5,
    least: int = 3,
    times: int = 2,
    most_words: int = 20_000,
) -> DataFrame:
    """Words of the texts with the more frequent spelling each belongs to.

    Words are runs of ``LETTERS`` of at least ``least_letters`` and ``least``
    occurrences.  Two are near if one letter is inserted, deleted or replaced
    between them.  A word's form is its near word of largest count (ties: first in
    code-point order) if that is ``times`` the word's count or more.  Returns word,
    form, root (forms followed to the last; the word itself without a form), n,
    n_near and form_n.

    ``every`` plants typos, see ``words_with_typos``.  A NULL or empty text has no
    words, a NULL id reads as empty, repeated rows count each, other columns do not
    matter, and no words give no rows.  Runs of any length count.
    """
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.keep(vocabulary(words_with_typos(docs, text, doc_id, every), least_letters, least))
        pairs = scratch.keep(near_pairs(words.select("word"), scratch, most_words))
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("_n")), "b")
        best: Column = F.min(F.struct((-F.col("_n")).alias("less"), F.col("b").alias("name"))).alias("_best")
        near = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
        large = -F.col("_best.less") >= times * F.col("n")
        forms = scratch.keep(
            words.join(near, "word", "left").select(
                "word",
                "n",
                F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                F.when(large, F.col("_best.name")).alias("form"),
                F.when(large, -F.col("_best.less")).alias("form_n"),
            )
        )
        made = forms.join(_roots(forms, scratch), "word", "left")
        return durable(made.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
