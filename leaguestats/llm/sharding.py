"""Shards of near-equal bytes by k-d tree partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from leaguestats.checkpoints import Scratch, durable
from leaguestats.llm.common import literals, text_or_empty

LEVELS = 1 << 20  # of a dimension
TIE_BITS = 42  # of the hash that orders items alike in a dimension
BINS = 1024
CHUNK_BITS = 16  # rows of a task are numbered in runs of 2^CHUNK_BITS


@dataclass
class Tree:
    """Cuts by heap position: node n has children 2n and 2n+1; dimension 0 marks a leaf."""

    dims: dict[int, int] = field(default_factory=dict)
    cuts: dict[int, int] = field(default_factory=dict)
    leaves: dict[int, int] = field(default_factory=dict)
    depth: int = 0

    def node(self, keys: str = "keys") -> Column:
        """The node an item falls in, by walking the cuts."""
        if not self.depth:
            return F.lit(1)
        size = 2 ** (self.depth + 1)
        dims = literals([self.dims.get(n, 0) for n in range(1, size)], "int")
        cuts = literals([self.cuts.get(n, 0) for n in range(1, size)], "bigint")

        def step(node: Column, _: Column) -> Column:
            dim = F.element_at(dims, node)
            right = F.element_at(F.col(keys), F.greatest(dim, F.lit(1))) >= F.element_at(cuts, node)
            return F.when(dim == 0, node).otherwise(node * 2 + right.cast("int"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(1), step)

    def shard(self, keys: str = "keys") -> Column:
        numbers = [self.leaves.get(n, 0) for n in range(1, 2 ** (self.depth + 1))]
        return F.element_at(literals(numbers, "int"), self.node(keys))


def _level(column: Column, low: float, high: float) -> Column:
    """A value scaled to 0 .. LEVELS-1; null and NaN are 0."""
    span = (high - low) or 1.0
    scaled = F.floor((column - F.lit(float(low))) / F.lit(float(span)) * F.lit(float(LEVELS - 1)))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.nanvl(scaled.cast("double"), F.lit(0.0)).cast("long"))), F.lit(0))


def kd_tree(items: DataFrame, dims: int, shards: int, tolerance: float = 0.0005) -> Tree:
    """Split ``items`` (keys array<long>, weight long) into ``shards`` leaves of near-equal weight.

    Level by level, each node is cut along the dimension in which it is widest,
    at the weighted quantile that gives both sides their share of the leaves.
    The quantile of every node of a level is narrowed down together: weights are
    summed in ``BINS`` bins of the interval still open, until the bin that holds
    the cut weighs at most ``tolerance`` of a leaf or holds one item.  What
    reaches the driver is bounded by shards times bins, whatever the data.
    """
    tree = Tree()
    total = items.agg(F.sum("weight")).first()[0] or 0
    small = max(1.0, tolerance * total / shards)
    open_nodes = {1: shards}
    while open_nodes := {n: k for n, k in open_nodes.items() if k > 1}:
        extents = {
            row["node"]: row
            for row in items.groupBy(tree.node().alias("node"))
            .agg(
                F.sum("weight").alias("weight"),
                *[f(F.shiftright(F.element_at("keys", d), TIE_BITS)).alias(f"{f.__name__}{d}") for d in range(1, dims + 1) for f in (F.min, F.max)],
            )
            .collect()
        }
        cut: dict[int, dict] = {}
        for n, k in open_nodes.items():
            if n in extents:
                e = extents[n]
                widest = max(range(1, dims + 1), key=lambda d: e[f"max{d}"] - e[f"min{d}"])
                cut[n] = {
                    "dim": widest,
                    "low": e[f"min{widest}"] << TIE_BITS,
                    "high": (e[f"max{widest}"] + 1) << TIE_BITS,
                    "below": 0,
                    "goal": e["weight"] * (k // 2) / k,
                    "at": None,
                }
            else:
                cut[n] = {"dim": 1, "low": 0, "high": 0, "below": 0, "goal": 0, "at": 0}
        while todo := {n: c for n, c in cut.items() if c["at"] is None}:
            _narrow(items, tree, todo, small)
        for n, c in cut.items():
            tree.dims[n], tree.cuts[n] = c["dim"], c["at"]
        tree.depth += 1
        open_nodes = {child: k for n, j in open_nodes.items() for child, k in ((2 * n, j // 2), (2 * n + 1, j - j // 2))}
    first = 0
    stack = [(1, shards)]
    while stack:
        n, k = stack.pop()
        if k == 1:
            tree.leaves[n], first = first, first + 1
        else:
            stack += [(2 * n + 1, k - k // 2), (2 * n, k // 2)]
    return tree


def _narrow(items: DataFrame, tree: Tree, todo: dict[int, dict], small: float) -> None:
    """One round: sum weights by bin of each open interval and close in on the goals."""
    size = 2 ** (tree.depth + 1)
    field_of = lambda name, other=0: literals([todo[n][name] if n in todo else other for n in range(1, size)], "bigint")
    step = {n: max(1, -(-(c["high"] - c["low"]) // BINS)) for n, c in todo.items()}
    steps = literals([step.get(n, 1) for n in range(1, size)], "bigint")
    node = F.col("node")
    binned = (
        items.select("keys", "weight", tree.node().alias("node"))
        .where(node.isin(*todo))
        .withColumn("key", F.element_at("keys", F.element_at(field_of("dim", 1).cast("array<int>"), node)))
        .where((F.col("key") >= F.element_at(field_of("low"), node)) & (F.col("key") < F.element_at(field_of("high"), node)))
        .withColumn("bin", F.call_function("div", F.col("key") - F.element_at(field_of("low"), node), F.element_at(steps, node)))
        .groupBy("node", "bin")
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("items"))
        .collect()
    )
    for n, c in todo.items():
        below = c["below"]
        for row in sorted((r for r in binned if r["node"] == n), key=lambda r: r["bin"]):
            start = c["low"] + row["bin"] * step[n]
            if below + row["weight"] >= c["goal"]:
                if row["items"] == 1 or row["weight"] <= small or step[n] == 1:
                    nearer_end = below + row["weight"] - c["goal"] <= c["goal"] - below
                    c["at"] = start + step[n] if nearer_end else start
                else:
                    c["low"], c["high"], c["below"] = start, start + step[n], below
                break
            below += row["weight"]
        else:
            c["at"] = c["high"]


def kd_shards(
    docs: DataFrame,
    dims: Mapping[str, Column],
    shards: int | None = 40,
    target_bytes: int | None = None,
    group_share: float = 0.02,
    text: str = "text",
    doc_id: str = "doc_id",
    row_bytes: int = 16,
) -> DataFrame:
    """Deal all rows into shards of near-equal bytes by a k-d tree over metadata.

    ``dims``: name to numeric column (scaled linearly between its extremes; null
    and NaN count as the lowest).  ``shards`` leaves, or as many as reach
    ``target_bytes``.  A row weighs the UTF-8 bytes of its text plus
    ``row_bytes``; a null text weighs ``row_bytes``.  Rows with equal texts form
    one item and stay together, unless they weigh more than both the heaviest row
    and ``group_share`` of a shard: such a group is dealt, by hash, into items of
    that weight.  Items alike in a dimension are ordered by a hash, so a hot
    value can be cut.

    Returns ``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot``: rows of a
    shard are numbered from 0 without gaps by adding counts of runs of at most
    2^16 rows, never by sorting a shard in one task.  Repeated rows get a slot
    each; a null id stays null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    body = text_or_empty(text)
    names = list(dims)
    with Scratch(spark) as scratch:
        rows = scratch.keep(
            docs.select(
                F.col(f"`{doc_id}`").alias("_id"),
                (F.octet_length(body) + F.lit(row_bytes)).cast("long").alias("_size"),
                F.crc32(F.encode(body, "UTF-8")).alias("_crc"),
                F.xxhash64(body).alias("_text"),
                F.monotonically_increasing_id().alias("_row"),
                *[column.cast("double").alias(f"_d{i}") for i, column in enumerate(dims.values())],
            )
        )
        spans = rows.agg(
            F.sum("_size").alias("total"),
            F.max("_size").alias("heaviest"),
            *[f(F.when(~F.isnan(f"_d{i}"), F.col(f"_d{i}"))).alias(f"{f.__name__}{i}") for i in range(len(names)) for f in (F.min, F.max)],
        ).first()
        total = spans["total"] or 0
        shards = shards or max(1, -(-total // target_bytes))
        limit = max(1.0, spans["heaviest"] or 0, group_share * total / shards)
        # At most shards / group_share groups weigh that much, so they may be broadcast.
        hot = (
            rows.groupBy("_text")
            .agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
            .where((F.col("_bytes") > limit) & (F.col("_n") > 1))
            .select("_text", F.least(F.col("_n"), F.ceil(F.col("_bytes") / limit)).alias("_pieces"))
        )
        rows = scratch.keep(
            rows.join(F.broadcast(hot), "_text", "left")
            .withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("_id", "_row"), F.col("_pieces")), F.lit(0)))
            .drop("_pieces")
        )
        tie = F.shiftrightunsigned(F.xxhash64("_text", "_piece"), 64 - TIE_BITS)
        key = lambda i: F.shiftleft(_level(F.col(f"_d{i}"), spans[f"min{i}"] or 0.0, spans[f"max{i}"] or 0.0), TIE_BITS) + tie
        items = scratch.keep(
            rows.groupBy("_text", "_piece")
            .agg(F.sum("_size").alias("weight"), *[F.min(f"_d{i}").alias(f"_d{i}") for i in range(len(names))])
            .select("_text", "_piece", "weight", F.array(*[key(i) for i in range(len(names))]).alias("keys"))
        )
        tree = kd_tree(items, len(names), shards)
        placed = items.select("_text", "_piece", tree.shard().alias("shard"))
        placed = scratch.keep(
            rows.join(placed, ["_text", "_piece"])
            .withColumn("_chunk", F.shiftright("_row", CHUNK_BITS))
            .select("_id", "_size", "_crc", "_row", "shard", "_chunk")
        )
        before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            placed.groupBy("shard", "_chunk")
            .count()
            .select("shard", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
        )
        run = Window.partitionBy("shard", "_chunk").orderBy("_row")
        numbered = (
            placed.withColumn("_rank", F.row_number().over(run) - 1)
            .join(starts, ["shard", "_chunk"])
            .select(
                F.col("_id").alias("doc_id"),
                F.col("_size").alias("size"),
                F.col("_crc").alias("text_crc32"),
                "shard",
                (F.col("_start") + F.col("_rank")).cast("long").alias("slot"),
            )
        )
        return durable(numbered)


def document_dims(lang: str = "lang", source: str = "source", doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Metadata of a document as numbers: crawl order, log length, and hashes that spread names evenly."""
    return {
        "order": F.col(doc_id).cast("double"),
        "length": F.log2(F.coalesce(F.octet_length(text), F.lit(0)) + 1),
        "lang": F.pmod(F.xxhash64(lang), F.lit(1024)),
        "source": F.pmod(F.xxhash64(source), F.lit(1024)),
    }
