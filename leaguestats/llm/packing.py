"""Sequences of token ids, packed along a space-filling curve through the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leaguestats.checkpoints import durable
from leaguestats.llm.common import small_arrow_batches
from leaguestats.llm.tokens import byte_bpe, encode, small_batches

DIMS, LEVEL_BITS, FEATURES = 3, 8, 256
PREFIX_BITS = 16  # of the key, by which the curve is cut into parts


def _projection(ids: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and sign of each token id, and the features' random directions."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, FEATURES, ids), draw.choice([-1.0, 1.0], ids), draw.standard_normal((FEATURES, DIMS))


def hilbert_key(levels: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points given as an (n, dims) array of ``bits``-bit levels.

    Bit by bit from the top, each point's cell is turned so that the curve enters
    and leaves neighbouring cells side by side (Skilling's transform), then the
    bits of the dimensions interleave.
    """
    x = levels.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            turn = (x[d] >> bit) & 1 == 1
            swap = np.where(turn, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turn, low, 0) ^ swap
            x[d] ^= swap if d else 0
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> bit) & 1)
    return key


def tokenized(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, specials: tuple[tuple[str, int], ...], text: str, doc_id: str) -> DataFrame:
    """(doc_id, ids, n, x0..x2): 16-bit ids with the end id, and the projected document vector.

    A vector holds signed counts of hashed token ids, has length one, and is
    projected on ``DIMS`` random directions; a text without tokens is at 0.
    """

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary, pattern, specials)
        feature, sign, directions = _projection(1 << 16)
        end = np.asarray([end_id], "<u2").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in small_batches(texts):
                found = [encode(bpe, t) for t in texts[a:b]]
                at = np.zeros((b - a, DIMS))
                for i, ids in enumerate(found):
                    if len(ids):
                        vector = np.bincount(feature[ids], sign[ids], FEATURES)
                        at[i] = vector @ directions / (np.sqrt(vector @ vector) or 1.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([ids.tobytes() + end for ids in found], pa.binary()),
                        pa.array([len(ids) + 1 for ids in found], pa.int64()),
                        *[pa.array(at[:, d]) for d in range(DIMS)],
                    ],
                    ["doc_id", "ids", "n", *[f"x{d}" for d in range(DIMS)]],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        encode_all, f"doc_id {kind}, ids binary, n bigint, " + ", ".join(f"x{d} double" for d in range(DIMS))
    )


def pack_along_curve(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    length: int = 1024,
    end_id: int = 0,
    part_tokens: int = 16_000_000,
    specials: tuple[tuple[str, int], ...] = (),
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Pack the token ids of all documents into sequences of ``length``, neighbours on the curve together.

    ``vocabulary`` is the path of a file of ranks on every worker, ``pattern`` its rule for cutting words,
    ``specials`` the strings that have an id of their own in texts.

    Each document's ids, then ``end_id``, are laid end to end in the order of a
    Hilbert curve through the projected document vectors (each dimension levelled
    at its quantiles), and cut every ``length`` ids.  The curve is cut into parts
    of about ``part_tokens`` (or fewer, to use all shuffle partitions); a stretch
    of the curve heavier than a part, such as copies of one text, is dealt to
    several by hash.  Only the last sequence of a part is short, so padding is
    under one sequence a part.  The driver holds counts by curve prefix (at most
    2^16) and by part.

    Returns one row per piece: doc_id, start (ids of the document before it),
    length, doc_tokens (with the end id), sequence_id, offset, and ``ids``
    (little-endian 32-bit).  A null or empty text has the end id only; a null or
    repeated doc_id is packed like any other row; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_arrow_batches(docs.sparkSession)
    tokens = durable(tokenized(docs, vocabulary, pattern, end_id, specials, text, doc_id))
    fractions = [i / (1 << LEVEL_BITS) for i in range(1, 1 << LEVEL_BITS)]
    found = tokens.agg(*[F.percentile_approx(f"x{d}", fractions, 20_000) for d in range(DIMS)]).first()
    cuts = [np.asarray(found[d] or fractions) for d in range(DIMS)]

    @F.pandas_udf("bigint")
    def key(x0: pd.Series, x1: pd.Series, x2: pd.Series) -> pd.Series:
        levels = np.stack([np.searchsorted(c, x.to_numpy(), "right") for c, x in zip(cuts, (x0, x1, x2))], axis=1)
        return pd.Series(hilbert_key(levels, LEVEL_BITS))

    keyed = tokens.withColumn("key", key("x0", "x1", "x2"))
    prefix = F.shiftright("key", DIMS * LEVEL_BITS - PREFIX_BITS)
    weights = keyed.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n")).orderBy("prefix").collect()
    total = sum(w["n"] for w in weights)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part_size = max(1, length * 32, min(part_tokens, -(-total // wanted)))
    plan, part, held = [], 0, 0
    for w in weights:
        if held and held + w["n"] > part_size:
            part, held = part + 1, 0
        share = max(1, round(w["n"] / part_size))
        plan.append((w["prefix"], part, share))
        part, held = (part + share - 1, held + w["n"]) if share == 1 else (part + share, 0)
    parts = part + 1
    # One row for each prefix of the curve, 2^16 at most.
    plan = F.broadcast(spark.createDataFrame(plan, "prefix bigint, first int, share int"))
    placed = (
        keyed.withColumn("prefix", prefix)
        .join(plan, "prefix")
        .withColumn("part", (F.col("first") + F.pmod(F.xxhash64("doc_id", "key"), F.col("share"))).cast("int"))
    )
    totals = dict(placed.groupBy("part").agg(F.sum("n").alias("n")).collect())
    first = np.zeros(parts + 1, np.int64)
    first[1:] = np.cumsum([-(-totals.get(p, 0) // length) for p in range(parts)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = -1, 0
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for p, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if p != part:
                    part, at = p, 0
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    size = min(length - at % length, len(ids) - start)
                    rows.append((doc, start, size, len(ids), int(first[part]) + at // length, at % length, ids[start : start + size].tobytes()))
                    start, at = start + size, at + size
                held += len(ids)
                if held > 4_000_000:
                    yield _pieces(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _pieces(rows, schema)

    kind = tokens.schema["doc_id"].dataType.simpleString()
    names = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = (kind, names)
    return (
        placed.select("part", "key", "doc_id", "ids")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "key", "doc_id")
        .mapInArrow(pack, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names) + ", ids binary")
    )


def _pieces(rows: list[tuple], schema: tuple[str, tuple[str, ...]]) -> pa.RecordBatch:
    kind, names = schema
    doc, *numbers, ids = zip(*rows)
    docs = pa.array(doc, pa.int64() if kind == "bigint" else None)
    return pa.RecordBatch.from_arrays([docs, *[pa.array(n, pa.int64()) for n in numbers], pa.array(ids, pa.binary())], ["doc_id", *names, "ids"])
