"""Reply trees as conversations: paths by iterative self-joins, formatted with a loss mask."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from leaguestats.checkpoints import Scratch, durable

# A turn is OPEN role \n text CLOSE.  Texts never hold "<" or "[" once escaped.
OPEN, CLOSE = "<s>", "</s>\n"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\i"))


def escape(text: Column) -> Column:
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def root_to_leaf_paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(leaf, node, up) for every node on the path of every leaf; ``up`` counts from the leaf.

    ``nodes`` has unique ``node`` and ``parent`` (null, or absent from the table,
    for a root).  Self-joins double the reach each round: the table of ancestors
    2^k steps up is joined with itself, and with the paths so far, so a tree of
    depth d takes log2(d) rounds.  A chain of parents that runs in a circle has
    no root, and its leaves have no path.
    """
    links = nodes.select("node", "parent")
    known = nodes.select(F.col("node").alias("parent"))
    jumps = scratch.keep(links.join(known, "parent").select("node", F.col("parent").alias("above")))
    leaves = links.join(jumps.select(F.col("above").alias("node")), "node", "left_anti")
    paths = scratch.keep(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    reach, most = 1, max(1, nodes.count())
    while reach <= most and not jumps.isEmpty():
        further = paths.join(jumps, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + reach).alias("up"))
        doubled = jumps.join(jumps.select(F.col("node").alias("above"), F.col("above").alias("top")), "above")
        paths_next = scratch.keep(paths.unionByName(further))
        jumps_next = scratch.keep(doubled.select("node", F.col("top").alias("above")))
        scratch.drop(paths, jumps)
        paths, jumps = paths_next, jumps_next
        reach *= 2
    if not jumps.isEmpty():  # what still has ancestors beyond every node count hangs on a circle
        paths = paths.join(jumps.select(F.col("node").alias("leaf")), "leaf", "left_anti")
    return paths


def format_reply_trees(nodes: DataFrame, best: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """Format root-to-leaf paths of reply trees, each as one conversation.

    ``nodes``: tree, node, parent, role, text, score.  ``node`` is unique; a null
    role or text counts as empty, a null score as 0.  Branches of a tree rank by
    the mean score of their nodes (ties: the smaller leaf); ``best`` of them are
    formatted, or all, ranked alike.  A small ``best`` limits the rows before the
    rank shuffles; without it a tree's leaves and scores sort in one task.  One path becomes one row, and so must fit one.

    Returns tree, leaf, branch_rank, score, ``formatted`` and ``loss_spans``
    (start and end, in characters of ``formatted``, of the texts of
    ``loss_role``).  An empty table gives no rows.
    """
    spark = nodes.sparkSession
    with Scratch(spark) as scratch:
        nodes = scratch.keep(
            nodes.select(
                "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
            )
        )
        paths = root_to_leaf_paths(nodes, scratch)
        placed = scratch.keep(paths.join(nodes.drop("parent"), "node"))
        branches = placed.groupBy("leaf").agg(F.max("tree").alias("tree"), F.avg("score").alias("score"))
        order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        ranked = branches.withColumn("branch_rank", F.row_number().over(order))
        if best is not None:
            ranked = ranked.where(F.col("branch_rank") <= best)
        turn = F.struct((-F.col("up")).alias("place"), _escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == loss_role).alias("loss"))
        turns = placed.groupBy("leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        start = lambda acc, t: acc["at"] + F.lit(len(OPEN) + 1) + F.length(t["role"])
        span = lambda acc, t: F.struct(start(acc, t).alias("start"), (start(acc, t) + F.length(t["text"])).alias("end"))
        spans = F.aggregate(
            "turns",
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
            lambda acc, t: F.struct(
                (start(acc, t) + F.length(t["text"]) + len(CLOSE)).alias("at"),
                F.when(t["loss"], F.concat(acc["spans"], F.array(span(acc, t)))).otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )
        written = F.concat_ws("", F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))))
        result = ranked.join(turns, "leaf").select("tree", "leaf", "branch_rank", "score", written.alias("formatted"), spans.alias("loss_spans"))
        return durable(result)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    pattern = F.lit("<s>([^<\n]*)\n([^<]*)</s>\n")
    pair = F.arrays_zip(
        F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("role"), F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("text")
    )
    return F.transform(pair, lambda t: F.struct(_unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """Rows of conversations, in order of turn, as trees of one branch: each row replies to the one before it.

    Rows with the same turn follow by role and text, so repeated rows each keep a place; a null id is a conversation too.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    key = lambda place: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), place.cast("string"))
    place = F.row_number().over(order)
    return rows.withColumn("_place", place).select(
        F.col("conv_id").alias("tree"),
        key(F.col("_place")).alias("node"),
        F.when(F.col("_place") > 1, key(F.col("_place") - 1)).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """One row per formatted conversation, read back from ``formatted`` and ``loss_spans``."""
    back = formatted.select(
        F.col("tree").alias("conv_id"),
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        unescape(F.concat_ws("", F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))).alias("loss"),
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
