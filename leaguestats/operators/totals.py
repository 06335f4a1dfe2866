"""Sums over players and seasons, and the rates derived from them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import repair_innings
from ..functions.registry import CAREER, CAREER_SUMS, METRICS, ORDER, PLAYER, SUMS, TEAM
from ..functions.schemas import PLAYER_KEY
from .frames import select_existing

# Fractional columns are summed as decimals: the total does not depend on the
# order in which partitions arrive.  Nine places hold any notation of thirds.
EXACT_SUMS = {"IP": "decimal(27,9)"}


def in_teams(df: DataFrame, teams: Sequence[str] | DataFrame, column: str = "Team") -> DataFrame:
    """Rows whose team is in a list, or in the ``column`` of a team table."""
    if isinstance(teams, DataFrame):
        return df.join(teams.select(column), column, "left_semi")
    return df.where(F.col(column).isin(list(teams)))


def add_dimension(df: DataFrame, dimension: DataFrame, on: str, wanted: str, keep_unknown: str | None = None) -> DataFrame:
    """Left join one column of a dimension with unique ``on``.

    ``keep_unknown`` names the column to fall back on.  No broadcast is forced:
    Spark picks it by table size, and splits hot keys of a shuffle join.
    """
    joined = df.join(dimension.select(on, wanted), on, "left")
    if keep_unknown is not None:
        joined = joined.withColumn(wanted, F.coalesce(F.col(wanted), F.col(keep_unknown)))
    return joined


def add_metrics(df: DataFrame, kind: str, grain: str) -> DataFrame:
    """Add each metric of the registry whose inputs the frame has."""
    present = set(df.columns)
    for metric in METRICS[kind]:
        if grain in metric.grains and present.issuperset(metric.inputs):
            df = df.withColumn(metric.name, metric.formula())
            present.add(metric.name)
    return df


def player_rates(pitchers_or_hitters: DataFrame, kind: str) -> DataFrame:
    """Per-player rates that are not read from the page."""
    return add_metrics(pitchers_or_hitters, kind, PLAYER)


def _total(name: str) -> Column:
    if name in EXACT_SUMS:
        exact = f"cast(nanvl(`{name}`, null) as {EXACT_SUMS[name]})"
        return F.expr(f"coalesce(cast(sum({exact}) as double), 0d) as `{name}`")
    return F.expr(f"coalesce(sum(`{name}`), 0) as `{name}`")


def sum_by(df: DataFrame, keys: Sequence[str], columns: Iterable[str]) -> DataFrame:
    """Sum the columns that exist; rows with a missing key are left out.

    Missing values are skipped and an all-missing sum is zero.  The aggregation
    is partial before the shuffle, so a key with most of the rows is cheap.
    """
    present = set(df.columns)
    totals = [_total(c) for c in columns if c in present]
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(*totals)


def team_totals(df: DataFrame, kind: str, by: Sequence[str] = ("Team",)) -> DataFrame:
    """Team sums with their rates, in output order.

    ``by=("Year", "Team")`` gives every season at once.
    """
    totals = add_metrics(sum_by(df, by, SUMS[kind]), kind, TEAM)
    return select_existing(totals, [*by, *[c for c in ORDER[kind] if c not in by]])


def career_totals(df: DataFrame, kind: str) -> DataFrame:
    """Totals of each (Team, Name, No) over all seasons, with career rates."""
    return finish_career(sum_by(df, PLAYER_KEY, CAREER_SUMS[kind]), kind)


def finish_career(totals: DataFrame, kind: str) -> DataFrame:
    """Summed seasons to a career: innings repaired, rates added.  The sums may come from partial ones."""
    if "IP" in totals.columns:
        totals = totals.withColumn("IP", repair_innings(F.col("IP")))
    return add_metrics(totals, kind, CAREER)


def roster_counts(df: DataFrame, by: Sequence[str] = ("Team",)) -> DataFrame:
    """Number of records per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
