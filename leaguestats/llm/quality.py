"""Quality rules on how a text splits into words and into tokens of public vocabularies."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from leaguestats.checkpoints import durable, is_small
from leaguestats.llm.common import small_arrow_batches
from leaguestats.llm.tokens import byte_bpe, encode, small_batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
ENTROPY_TOKENS = 320  # beyond so many tokens a text's entropy hardly grows
MEASURES = ("chars_per_token", "entropy", "fallback_share")
# How far below and above the quartiles a measure may lie, in quartile distances; None: any far.
WIDTHS = {"chars_per_token": (5.0, 5.0), "entropy": (2.0, None), "fallback_share": (None, 6.0)}

# What a band of few rows reaches beyond its quartiles at least, for each doubling of its width.
THIN_REACH = {"chars_per_token": 0.25, "entropy": 0.05, "fallback_share": 0.05}

TELLING = 5  # rows whose quartiles one outlier does not move

# First and last code point by script.
SCRIPTS = (
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF),
    ("devanagari", 0x900, 0x97F),
    ("thai", 0xE00, 0xE7F),
    ("hangul", 0xAC00, 0xD7A3),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF),
)


class Fallback:
    """The share of byte pieces among the pieces a vocabulary with byte fallback makes of a text."""

    def __init__(self, path: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.pieces.vocab_size())
        self.is_byte = np.array([self.pieces.is_byte(i) for i in ids])
        # Characters with a piece of their own never come to bytes.
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in map(self.pieces.id_to_piece, ids) if len(p) == 1]] = True
        self.known[[ord(c) for c in SPACES]] = True

    def share(self, text: str, codes: np.ndarray) -> float:
        """``codes``: the code points of the text.  White space counts as spaces; a text of known characters alone need not be cut."""
        if self.known[codes].all():
            return 0.0
        text = text.translate(_BLANKS).encode("utf-8", "replace").decode()  # a lone surrogate is a question mark
        made = np.concatenate([self.pieces.encode(text[i : i + 100_000]) for i in range(0, len(text), 100_000)]).astype(np.int64)
        return float(self.is_byte[made].mean()) if len(made) else 0.0


_BLANKS = {ord(c): " " for c in SPACES}


@lru_cache(maxsize=2)
def fallback(path: str) -> Fallback:
    """A worker loads a vocabulary once."""
    return Fallback(path)


def repeated_windows(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (one[i : i + n] ^ (one[i : i + n] >> np.uint64(29)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[window:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, lines seen before, words in repeated windows."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        again,
        repeated_windows(words),
    )


def script_of(codes: np.ndarray) -> str:
    """The script with most characters, else that of the commonest letter by its Unicode name; ``none`` without letters."""
    counts = [(int(((codes >= low) & (codes <= high)).sum()), name) for name, low, high in SCRIPTS]
    most, name = max(counts, key=lambda c: c[0])
    if most:
        return name
    letters = Counter(c for c in codes.tobytes().decode("utf-32-le", "surrogatepass") if c.isalpha())
    return unicodedata.name(max(letters, key=lambda c: (letters[c], c)), "none").split()[0].lower() if letters else "none"


def token_measures(text: str, bpe, pieces: Fallback) -> tuple[int, float, float, float, np.ndarray]:
    """Tokens, characters per token, token entropy over its bound at this length, byte-fallback share."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ids = encode(bpe, text)
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0, codes
    ids.sort()
    counts = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
    entropy = np.log2(n) - float((counts * np.log2(counts)).sum()) / n
    bound = np.log2(max(2, min(n, ENTROPY_TOKENS)))
    return n, len(codes) / n, entropy / bound, pieces.share(text, codes), codes


def measured(docs: DataFrame, vocabulary: str, pattern: str, pieces: str, text: str, doc_id: str, lang: str) -> DataFrame:
    """Base counts and token measures of every whole text, with the band it is judged by and its script."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, byte_pieces = byte_bpe(vocabulary, pattern), fallback(pieces)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs = batch.column("lang").to_pylist()
            for a, b in small_batches(texts):
                rows, bands, scripts = [], [], []
                for i in range(a, b):
                    *numbers, codes = token_measures(texts[i], bpe, byte_pieces)
                    rows.append((*base_counts(texts[i]), *numbers))
                    scripts.append(script_of(codes))
                    bands.append(langs[i] if langs[i] is not None else "script " + scripts[-1])
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("key").slice(a, b - a),
                        *[pa.array(c, pa.int64()) for c in columns[:6]],
                        *[pa.array(c, pa.float64()) for c in columns[6:]],
                        pa.array(bands, pa.string()),
                        pa.array(scripts, pa.string()),
                    ],
                    ["doc_id", "key", *COUNTS, "n_tokens", *MEASURES, "band", "script"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")
    )
    numbers = ", ".join(f"{c} bigint" for c in (*COUNTS, "n_tokens")) + ", " + ", ".join(f"{c} double" for c in MEASURES)
    return given.mapInArrow(measure, f"doc_id {kind}, key bigint, {numbers}, band string, script string")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge_fertility(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    pieces: str,
    widths: Mapping[str, tuple[float | None, float | None]] = WIDTHS,
    least_rows: int = 50,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
) -> DataFrame:
    """Judge every document by base rules and by how public vocabularies split it.

    Measures: characters per token and token entropy (over its bound at the
    text's length) by a byte-level BPE vocabulary, and the share of characters
    that a vocabulary with byte fallback (``pieces``) has no piece for.  The
    bands are per language, or per script where the language is null: quartiles
    over all rows that pass the base rules, widened below and above by ``widths``
    times the distance between them (characters per token more so in short
    texts, by sqrt(1 + 256 / tokens); at least 0.02 for the fallback share).  Low
    entropy is a fault, high entropy is not; nor is a low fallback share.  A band of n rows, fewer than ``least_rows``, has
    wider limits, by sqrt(least_rows / n) and by ``THIN_REACH``.  Where the script has ``least_rows``
    over all languages, rows of such a band pass by the script's band, or by their language's own if
    it has the ``TELLING`` rows that show an outlier; rows are never judged by other scripts.  Only
    texts without letters, which have no script, are judged by all rows then.

    Returns doc_id, key (hash of the text), the counts, the measures, ``band``,
    ``base_failed`` and ``kept``.  A null or empty text has no words and fails;
    rows that repeat are judged alike; an empty table gives no rows.
    """
    small_arrow_batches(docs.sparkSession)
    rows = durable(measured(docs, vocabulary, pattern, pieces, text, doc_id, lang).withColumn("base_failed", base_failed()))
    sound = rows.where("not base_failed")
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 10_000) for m in MEASURES]

    def bands_of(by: str, named: str) -> DataFrame:
        return sound.groupBy(by).agg(F.count(F.lit(1)).alias(f"{named}_n"), *[q.alias(f"{named}_{m}") for q, m in zip(quartiles, MEASURES)])

    overall = sound.agg(*[q.alias(f"all_{m}") for q, m in zip(quartiles, MEASURES)])
    bands = durable(bands_of("band", "own"))
    scripts = bands_of("script", "script").where(F.col("script_n") >= least_rows)  # one row a script
    bands = F.broadcast(bands) if is_small(bands) else bands
    judged = rows.join(bands, "band", "left").join(F.broadcast(scripts), "script", "left").join(F.broadcast(overall))  # overall has one row
    short = F.sqrt(1 + F.lit(256.0) / F.greatest(F.lit(1), F.col("n_tokens")))
    thin = F.col("own_n") < least_rows
    wide = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(least_rows)) / F.col("own_n")))

    def inside(named: str, measure: str, floor: float = 0.0, wider: Column | float = 1.0) -> Column:
        low, high = (F.col(f"{named}_{measure}")[i] for i in (0, 1))
        grown, least = (wide, F.greatest(F.lit(floor), (wide - 1) * THIN_REACH[measure])) if named == "own" else (F.lit(1.0), F.lit(floor))
        reach = lambda width: F.greatest(least, F.lit(width) * (high - low) * F.lit(wider) * grown)
        below, above = widths[measure]
        sound = F.lit(True)
        if below is not None:
            sound = sound & (F.col(measure) >= low - reach(below))
        if above is not None:
            sound = sound & (F.col(measure) <= high + reach(above))
        return sound

    def passes(named: str) -> Column:
        return inside(named, "chars_per_token", wider=short) & inside(named, "entropy") & inside(named, "fallback_share", floor=0.02)

    by_language = (F.col("own_n") >= TELLING) & ~F.col("band").startswith("script ") & passes("own")
    verdict = (
        F.when(thin & (F.col("script") == "none"), passes("all"))
        .when(thin & F.col("script_n").isNotNull(), passes("script") | by_language)
        .otherwise(passes("own"))
    )
    return judged.select("doc_id", "key", *COUNTS, "n_tokens", *MEASURES, "band", "base_failed", (~F.col("base_failed") & F.coalesce(verdict, F.lit(True))).alias("kept"))
