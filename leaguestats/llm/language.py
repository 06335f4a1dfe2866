"""Language by cross-parsing: the language whose text explains another in the fewest phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from leaguestats.llm.common import hashed_stretch, small_arrow_batches
from leaguestats.llm.tokens import small_batches

DENSE = 1 << 23  # cells of a whole table of transitions; a larger one is kept as the list of its edges
CHUNK = 256  # a phrase ends at the latest where a chunk of so many characters does
RUN = 5  # words in a row that sampled texts may share
RANKED = 512  # first rows of a language at a time; Spark limits ranks of up to 1000 before it shuffles
_LETTER = re.compile(r"[^\W\d_]")


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The automaton of all substrings of ``text``: for each state, the next one by symbol.

    From state 0 it follows exactly the strings that occur in ``text``.
    """
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in text.tolist():
        state = len(length)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = following[at][symbol]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                split = len(length)
                following.append(dict(following[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and following[at].get(symbol) == target:
                    following[at][symbol] = split
                    at = link[at]
                link[target] = link[state] = split
        last = state
    return following


class Automaton:
    """The automaton of a sample over its own letters, ready to follow many texts at once.

    Symbols: 0 a gap between words, 1 a letter that the sample has not, then its
    letters, last the padding, which stays where it is.  No state goes on by 1, and
    from the dead state none goes on at all.
    """

    def __init__(self, codes: np.ndarray, symbols: int):
        """``codes``: the sample as numbers that all languages share, of which there are ``symbols``."""
        letters = np.unique(codes[codes > 1])
        self.own = np.ones(symbols + 1, np.int32)
        self.own[0] = 0
        self.own[letters] = np.arange(2, len(letters) + 2)
        self.pad = self.own[symbols] = len(letters) + 2
        self.width = self.pad + 1
        following = suffix_automaton(self.own[codes])
        self.dead = len(following)
        state = np.repeat(np.arange(len(following)), [len(f) for f in following])
        symbol = np.array([c for f in following for c in f], np.int64)
        target = np.array([t for f in following for t in f.values()], np.int32)
        state, symbol, target = (x[symbol != 1] for x in (state, symbol, target))
        self.keys = self.table = None
        if (self.dead + 1) * self.width <= DENSE:
            self.table = np.full((self.dead + 1, self.width), -1, np.int32)
            self.table[state, symbol] = target
            self.table[:, self.pad] = np.arange(self.dead + 1)
            self.table = self.table.ravel()
        else:  # many letters, few of them after any state
            keys = state * self.width + symbol
            order = np.argsort(keys)
            self.keys, self.targets = keys[order], target[order]
        first = self.step(np.zeros(self.width, np.int32), np.arange(self.width))
        self.first = np.where(first < 0, self.dead, first).astype(np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one symbol each, -1 where there is none."""
        if self.table is not None:
            return self.table[state * self.width + symbol]
        wanted = state.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        found = self.keys[at] == wanted if len(self.keys) else np.zeros(len(wanted), bool)
        return np.where(symbol == self.pad, state, np.where(found, self.targets[at] if len(self.keys) else -1, -1))


class Parser:
    """Automata of several languages; it parses batches of texts in step.

    Every letter of any sample has a number, whatever the script; each automaton
    knows its own letters only.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        letters = sorted({c for _, text in samples for c in text.lower() if c.isalpha()})
        # 0 is no letter, 1 a letter of no sample.
        self.symbols = len(letters) + 2
        self.code = np.zeros(0x110000, np.int32)
        self.code[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        self.code[[ord(c) for c in letters]] = np.arange(2, self.symbols)
        normal = [self.normal(text) for _, text in samples]
        self.automata = [Automaton(text, self.symbols) for text in normal]
        # One price for all, that of the longest sample: by its own length a tiny sample's phrases would cost next to nothing.
        self.bits = np.log2(max(2, *map(len, normal))) if normal else 1.0

    def normal(self, text: str) -> np.ndarray:
        """Codes of the letters of a text in lower case, with one gap for whatever lies between words."""
        codes = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        return codes[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by each language (languages, texts), and the texts' normal lengths."""
        normal = [self.normal(t) for t in texts]
        lengths = np.array([len(t) for t in normal])
        owner = np.repeat(np.arange(len(texts)), -(-lengths // CHUNK))
        chunks = np.full((len(owner), CHUNK), self.symbols, np.int32)
        first = np.concatenate(([0], np.cumsum(-(-lengths // CHUNK))))
        for i, text in enumerate(normal):
            chunks[first[i] : first[i + 1]].reshape(-1)[: len(text)] = text
        shared = np.ascontiguousarray(chunks.T)
        counts = np.zeros((len(self.automata), len(texts)), np.int64)
        for k, automaton in enumerate(self.automata):
            columns = automaton.own[shared]
            found = (columns[0] != automaton.pad).astype(np.int32)
            state = automaton.first[columns[0]]
            for column in columns[1:]:
                after = automaton.step(state, column)
                missed = after < 0
                found += missed
                state = np.where(missed, automaton.first[column], after)
            counts[k] = np.bincount(owner, found, len(texts))
        return counts, lengths


@lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def training_samples(labelled: DataFrame, sample_chars: int, sample_docs: int) -> tuple[tuple[str, str], ...]:
    """For each language, up to ``sample_chars`` of the texts of its rows, taken in order of a hash.

    ``labelled``: lang, text.  Of a text ``sample_chars`` // 8 characters in a row
    serve (a text up to twice as long whole), from a place that its hash chooses
    anywhere in it, so that neither one long text nor what texts start with is the
    whole sample.  Runs of words that
    another language's texts have as well go; of runs that texts of one language
    share a copy stays.  ``sample_docs`` different texts a language are read first,
    then, for languages whose sample is not full, more of them down the order, until
    it is or texts end or the last ``RANKED`` add nothing.  Hashes are ranked without their texts, and the
    rank keeps its first rows in each task before it shuffles.
    """
    share = max(1, sample_chars // 8)
    texts = (
        labelled.where("lang is not null and text is not null")
        .select(F.col("lang").cast("string").alias("lang"), hashed_stretch("text", share).alias("text"))
        .select("lang", F.xxhash64("text").alias("hash"), "text")
    )
    order = Window.partitionBy("lang").orderBy("hash")
    taken: dict[str, list[str]] = {}
    samples: dict[str, str] = {}
    left, step = F.lit(True), sample_docs
    while True:
        first = texts.where(left).select("lang", "hash").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= step)
        rows = texts.join(F.broadcast(first), ["lang", "hash"]).dropDuplicates().orderBy("lang", "rank", "text").collect()
        for row in rows:
            taken.setdefault(row["lang"], []).append(row["text"])
        before, samples = samples, _own_words(taken, sample_chars)
        last = {row["lang"]: row for row in rows}
        more = [lang for lang, row in last.items() if row["rank"] == step and len(samples[lang]) < sample_chars and (step < RANKED or samples[lang] != before.get(lang))]
        if not more:
            return tuple((lang, text) for lang, text in sorted(samples.items()) if _LETTER.search(text))
        left = reduce(or_, [(F.col("lang") == lang) & (F.col("hash") > last[lang]["hash"]) for lang in more])
        step = max(step, min(2 * step, RANKED))


def _own_words(taken: dict[str, list[str]], sample_chars: int) -> dict[str, str]:
    """Of each language's texts up to ``sample_chars``, without the runs of another language and with one copy of its own."""
    held: dict[tuple[str, ...], str | None] = {}  # the language that has a run; None for several
    for lang, texts in taken.items():
        for text in texts:
            for run in _word_runs(text):
                held[run] = lang if held.get(run, lang) == lang else None
    samples = {}
    for lang, texts in taken.items():
        had: set[tuple[str, ...]] = set()
        sample = ""
        for text in texts:
            if len(sample) >= sample_chars:
                break
            words, runs = text.split(), _word_runs(text)
            left_out = {j for i, run in enumerate(runs) if run in had or held[run] is None for j in range(i, i + RUN)}
            had.update(runs)
            sample += "".join(w + " " for j, w in enumerate(words) if j not in left_out)
        samples[lang] = sample[:sample_chars]
    return samples


def _word_runs(text: str) -> list[tuple[str, ...]]:
    words = text.split()
    return [tuple(words[i : i + RUN]) for i in range(len(words) - RUN + 1)]


def identify_languages(
    docs: DataFrame,
    labelled: DataFrame,
    sample_chars: int = 24_000,
    sample_docs: int = 64,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Predict the language of every whole text.

    Each language's suffix automaton, over a bounded sample of ``labelled``
    (lang, text), cuts a text into phrases: each the longest match that starts
    where the last ended.  Phrases, times the bits that address the longest sample,
    over the characters estimate the cross entropy; the least wins (ties: the first
    name).  Letters count in lower case; whatever lies between words is one gap.
    Long texts are parsed in chunks of ``CHUNK`` characters side by side.

    Returns doc_id, ``lang_pred`` and ``score`` (the share of the winner when
    each language weighs two to the minus 8 times its bits a character).  A null
    text, one without letters, or no labelled text at all gives ``und`` and 0.
    """
    samples = training_samples(labelled, sample_chars, sample_docs)
    small_arrow_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples) if samples else None
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in small_batches(texts):
                langs, scores = ["und"] * (b - a), np.zeros(b - a)
                if parser:
                    counts, lengths = parser.phrases(texts[a:b])
                    bits = counts * parser.bits / np.maximum(lengths, 1)
                    weight = np.exp2(-8 * (bits - bits.min(axis=0)))
                    best, share = bits.argmin(axis=0), 1 / weight.sum(axis=0)
                    for i in range(b - a):
                        if _LETTER.search(texts[a + i]):
                            langs[i], scores[i] = parser.langs[best[i]], share[i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"]
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
