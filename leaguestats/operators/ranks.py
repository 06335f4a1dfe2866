"""League ranks, leader boards and display orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import durable, statistics_side
from ..functions.registry import LEADER_KEYS, LOW_IS_GOOD, MATRIX_DROP, ORDER, ranked_metrics
from .distribution import counted_values, join_by_value, positions
from .frames import relabel, select_existing, to_long, to_wide
from .totals import add_dimension


def rank_long(
    df: DataFrame,
    metrics: Sequence[str],
    low_is_good: Sequence[str],
    ids: Sequence[str] = ("Team",),
    within: Sequence[str] = (),
    top: int | None = None,
) -> DataFrame:
    """Rank every metric: (within..., ids..., Stat, Value, Rank).

    Equal values share the lowest rank; a NULL value has no rank.  ``within``
    restarts the ranks per group, for example per season.  The rank of a value
    is read off its distribution, so no window holds a whole metric; the rows
    then pick it up by an equi join on the value.  With ``top`` only ranks up to
    that, all of equal ones, found without counting the other values.
    """
    long = to_long(df, [*within, *ids], metrics)
    keys = [*within, "Stat"]
    if top is not None:
        return _top_ranks(long, keys, low_is_good, top).select(*within, *ids, "Stat", "Value", "Rank")
    counted = counted_values(long, keys)
    rank = F.when(F.col("Stat").isin(list(low_is_good)), F.col("below") + 1).otherwise(
        F.col("total") - F.col("below") - F.col("n") + 1
    )
    # Kept once: the values are counted, and the frequent and the other ones are joined apart.
    ranks = durable(positions(counted, keys).select(*keys, "Value", "n", rank.alias("Rank")))
    return join_by_value(long, counted, ranks, [*keys, "Value"]).select(*within, *ids, "Stat", "Value", "Rank")


def _top_ranks(long: DataFrame, keys: list[str], low_is_good: Sequence[str], top: int) -> DataFrame:
    """Rows of the ``top`` first ranks of each group, ties at the end kept whole.

    Each task sends at most ``top`` rows a group; the last of a group's best is its
    threshold, and the rows that reach it are ranked among themselves: fewer than
    ``top`` lie before it, however many share it.
    """
    if top < 1:
        raise ValueError("top must be 1 or more")
    place = F.when(F.col("Stat").isin(list(low_is_good)), F.col("Value")).otherwise(-F.col("Value"))
    placed = long.where(F.col("Value").isNotNull()).withColumn("_place", place)
    most = int(long.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if top <= most:
        share, shares = F.lit(0), 1
    else:  # beyond what Spark limits in a task: the best of a share of the values first
        shares = 64
        share = F.pmod(F.xxhash64("Value"), F.lit(shares)).cast("int")
    best = placed.withColumn("_share", share).withColumn(
        "_at", F.row_number().over(Window.partitionBy(*keys, "_share").orderBy("_place"))
    )
    best = best.where(F.col("_at") <= top)
    if shares > 1:
        best = best.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_place"))).where(F.col("_at") <= top)
    limits = best.groupBy(*keys).agg(F.max("_place").alias("_limit"))
    reached = placed.join(statistics_side(limits, keys[:-1]), keys).where(F.col("_place") <= F.col("_limit"))
    reached = durable(reached.drop("_limit"))
    counted = durable(reached.groupBy(*keys, "Value", "_place").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counted.select(*keys, "Value", "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("Rank"))
    return join_by_value(reached, counted.drop("_place"), durable(ranks), [*keys, "Value"], "inner")


def rank_metrics(
    df: DataFrame,
    kind: str,
    ids: Sequence[str] = ("Team",),
    within: Sequence[str] = (),
    low_is_good: Sequence[str] | None = None,
    top: int | None = None,
) -> DataFrame:
    """Ranks in the shape of the team table: ids and one rank column per metric.

    Works at any grain: pass ``ids=("Team", "Name", "No")`` for players.  With
    ``top`` a row for each id among the first ``top`` of a metric, NULL elsewhere.
    """
    metrics = [c for c in ORDER[kind][1:] if c in df.columns]
    low = LOW_IS_GOOD[kind] if low_is_good is None else low_is_good
    ranked = rank_long(df, metrics, low, ids, within, top)
    return to_wide(ranked, [*within, *ids], metrics, "Rank")


def pinned_first(column: str, pinned: str) -> list[Column]:
    """Sort keys: names containing ``pinned`` first, then by name."""
    return [F.contains(F.col(column), F.lit(pinned)).desc(), F.col(column).asc()]


def order_pinned(df: DataFrame, column: str, pinned: str) -> DataFrame:
    """Own team first, the rest by name."""
    return df.orderBy(*pinned_first(column, pinned))


def order_teams(teams: DataFrame, own: str, next_opponent: str | None, column: str = "Team") -> DataFrame:
    """Own team, then the next opponent, then the others by name."""
    place = F.when(F.col(column) == own, 0)
    if next_opponent is not None:
        place = place.when(F.col(column) == next_opponent, 1)
    return teams.orderBy(place.otherwise(2), column)


def leader_order(kind: str) -> list[Column]:
    """Leader-board sort keys; name and number break ties."""
    first, second = LEADER_KEYS[kind]
    return [F.col(first).desc_nulls_last(), F.col(second).desc_nulls_last(), F.col("Name").asc(), F.col("No").asc()]


def leaderboard(
    df: DataFrame,
    kind: str,
    team: str | None = None,
    n: int | None = None,
    by: Sequence[str] = ("Team",),
) -> DataFrame:
    """Players by the leader-board keys; with ``n``, the first n of each group.

    The limit is applied to each input partition before the shuffle, so a group
    with most of the rows still sends at most n rows per partition.
    """
    if team is not None:
        df = df.where(F.col("Team") == team)
    if n is None:
        return df.orderBy(*leader_order(kind))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*leader_order(kind)))
    return df.withColumn("place", place).where(F.col("place") <= n)


def rank_matrix(
    ranks: DataFrame,
    dimension: DataFrame,
    kind: str,
    pinned: str,
    within: Sequence[str] = (),
    short_name: str = "team_eng",
) -> DataFrame:
    """Short team name by metric, own team first, without the volume columns."""
    named = add_dimension(ranks, dimension, "Team", short_name)
    ordered = named.orderBy(*within, *pinned_first("Team", pinned))
    columns = [c for c in ORDER[kind][1:] if c not in MATRIX_DROP[kind]]
    return select_existing(ordered, [*within, short_name, *columns])


def player_table(
    df: DataFrame, kind: str, team: str | None = None, lang: str | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """The player list: keys, number, name and the ordered metrics that exist, in leader order, labelled if asked."""
    listed = select_existing(leaderboard(df, kind, team), [*keys, "No", "Name", *ranked_metrics(kind)])
    return listed if lang is None else relabel(listed, kind, lang)
