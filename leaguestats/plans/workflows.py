"""The workflows of the library, each a chain of operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..checkpoints import durable
from ..functions.registry import ranked_metrics
from ..functions.schemas import HITTER, PITCHER, PLAYER_KEY, SCHEDULE, SCHEDULE_HEADERS
from ..operators.frames import to_long
from ..operators.profile import league_profile
from ..operators.ranks import rank_metrics
from ..operators.schedule import game_result, parse_schedule
from ..operators.totals import career_totals, in_teams, player_rates, team_totals
from ..sources.ingest import split_errors, spread_cells, typed_records
from ..sources.pages import extract_tables
from ..sources.quarantine import Quarantine
from ..sources.store import read_season, read_seasons, seasons_stored, stored_seasons, write_season


class Refreshed(NamedTuple):
    """What a load made; ``report`` counts pages, rows and errors by reason."""

    records: DataFrame
    errors: DataFrame
    report: dict[str, int] | None = None


# Reasons of an error row, by a part of its text; a row can have several.
REASONS = {
    "no table": "no table found",
    "no rows": "table without rows",
    "no column": "no column ",
    "column twice": "column twice: ",
    "name cell": "name cell: ",
    "no team": "no team",
    "wrong type": " is not ",
}


class SeasonView(NamedTuple):
    players: DataFrame
    teams: DataFrame
    ranks: DataFrame
    profile: DataFrame


def _counted_errors() -> list[Column]:
    error = F.col("error")
    known = [F.contains(error, F.lit(part)) for part in REASONS.values()]
    other = error.isNotNull()
    for reason in known:
        other = other & ~reason
    counts = [F.count_if(reason).alias(name) for name, reason in zip(REASONS, known)]
    return [F.count_if(error.isNull()).alias("records"), F.count_if(error.isNotNull()).alias("errors"), *counts, F.count_if(other).alias("unreadable")]


def page_records(pages: DataFrame, kind: str, html_col: str = "html") -> Refreshed:
    """Pages (Team, Year, kind, html) of one kind to typed records and errors.

    Pages are parsed once: the checked rows are written out before they are
    split, since both halves are used, and what the report counts is counted on
    the way by that one pass.
    """
    read, made = Observation(), Observation()
    wanted = pages.where(F.col("kind") == kind).observe(read, F.count(F.lit(1)).alias("pages"))
    extracted = extract_tables(wanted, html_col, ["Team", "Year"])
    checked = durable(typed_records(extracted, kind).observe(made, *_counted_errors()))
    return Refreshed(*split_errors(checked), {name: int(n) for name, n in (read.get | made.get).items()})


def report_frame(spark: SparkSession, report: dict[str, int]) -> DataFrame:
    """A load report as rows (measure, n)."""
    return spark.createDataFrame(sorted(report.items()), "measure string, n bigint")


def _failed_teams(made: Refreshed) -> DataFrame:
    """(Year, Team) of the pages with an error, one row each."""
    return made.errors.select("Year", "Team").distinct()


def refresh_pending(pages: DataFrame, root: str, kind: str) -> Refreshed:
    """As ``refresh``, but without the teams' seasons that failed before and whose pages have not changed.

    What fails now goes into quarantine, what reads now leaves it.
    """
    quarantine = Quarantine(pages.sparkSession, root, kind)
    pending = durable(quarantine.pending(pages.where(F.col("kind") == kind)))
    made = refresh(pending, root, kind)
    quarantine.record(pending, made.errors)
    return made


def refresh(pages: DataFrame, root: str, kind: str) -> Refreshed:
    """Parse pages and replace the snapshots of the teams and seasons they cover.

    The rows of a team with a failed page are not replaced: what was stored
    before stays.  So do teams without a page.  The errors are returned.
    """
    made = page_records(pages, kind)
    keys = ["Year", "Team"]
    failed = _failed_teams(made)
    sound = made.records.join(failed, keys, "left_anti")
    years = [row.Year for row in made.records.select("Year").distinct().collect()]
    stored = stored_seasons(pages.sparkSession, root, kind, years)
    if stored is not None:
        covered = sound.select(*keys).distinct()
        sound = sound.unionByName(stored.join(covered, keys, "left_anti"), allowMissingColumns=True)
    write_season(durable(sound), root, kind)
    return made


def load_seasons(spark: SparkSession, root: str, kind: str, years: Sequence[int], pages: DataFrame) -> Refreshed:
    """Seasons from their snapshots; those without one are built from the pages.

    A season with a failed page is returned as far as it could be read but not
    stored, so the next call builds it again.  The errors are returned.
    """
    present = seasons_stored(spark, root, kind, years)
    missing = [year for year in years if year not in present]
    made = page_records(pages.where(F.col("Year").isin(missing)), kind)
    partial = made.errors.select("Year").distinct()
    write_season(made.records.join(partial, "Year", "left_anti"), root, kind)
    unfinished = made.records.join(partial, "Year", "left_semi")
    stored = stored_seasons(spark, root, kind, years)
    records = unfinished if stored is None else stored.unionByName(unfinished, allowMissingColumns=True)
    return Refreshed(records, made.errors, made.report)


def season_teams(records: DataFrame, kind: str, teams: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Team totals of every season in the records, kept for several uses."""
    if teams is not None:
        records = in_teams(records, teams)
    return durable(team_totals(records, kind, by=("Year", "Team")))


def season_view(
    spark: SparkSession, root: str, kind: str, year: int | None, teams: Sequence[str] | DataFrame | None = None
) -> SeasonView:
    """Players, team totals, team ranks and league profile of one season; of each season if ``year`` is None."""
    records = read_seasons(spark, root, kind) if year is None else read_season(spark, root, kind, year)
    players = player_rates(records, kind)
    if teams is not None:
        players = in_teams(players, teams)
    totals = season_teams(players, kind)
    metrics = [c for c in ranked_metrics(kind) if c in players.columns]
    return SeasonView(
        players,
        totals,
        rank_metrics(totals, kind, within=("Year",)),
        league_profile(players, metrics, by=("Year",) if year is None else (), complete_rows=kind == PITCHER),
    )


def view_rows(view: SeasonView, kind: str) -> DataFrame:
    """A view of all seasons as one long table: (Year, part, Team, Name, No, Stat, Value)."""
    metrics = [c for c in ranked_metrics(kind) if c in view.players.columns]
    nobody = {c: F.lit(None).cast("string") for c in ("Team", "Name", "No")}
    names = ["Year", "Team", "Name", "No", "Stat", "Value"]

    def rows(part: str, long: DataFrame) -> DataFrame:
        missing = {c: nobody[c] for c in nobody if c not in long.columns}
        return long.withColumns(missing).select(F.lit(part).alias("part"), *names)

    teams = [c for c in ranked_metrics(kind) if c in view.teams.columns]
    long = rows("player", to_long(view.players, ["Year", *PLAYER_KEY], metrics))
    long = long.unionByName(rows("team", to_long(view.teams, ["Year", "Team"], teams)))
    long = long.unionByName(rows("rank", to_long(view.ranks, ["Year", "Team"], teams)))
    for statistic in ("mean", "median"):
        long = long.unionByName(rows(statistic, view.profile.select("Year", "Stat", F.col(statistic).alias("Value"))))
    return long


def career_view(spark: SparkSession, root: str, kind: str, years: Sequence[int] | None = None) -> DataFrame:
    """Career totals over the snapshots."""
    return career_totals(read_seasons(spark, root, kind, years), kind)


def schedule_games(pages: DataFrame, css_class: str, keep: Sequence[str] = (), html_col: str = "html") -> Refreshed:
    """Schedule pages to games with results, and errors; the first table of the class counts.

    The raw rows are written out, so a later sort does not parse pages again.
    Errors are pages that cannot be read, rows without a declared column, and
    games whose score is not a number; the latter are among the games too,
    without a result.
    """
    extracted = extract_tables(pages.where(F.col("kind") == SCHEDULE), html_col, keep, css_class, collapse_space=False)
    first = extracted.where(F.coalesce(F.col("table_no") == 0, F.lit(True)))
    rows, unread = split_errors(durable(spread_cells(first, SCHEDULE, SCHEDULE_HEADERS)))
    games = game_result(parse_schedule(rows, keep))
    wrong = games.where(F.col("error").isNotNull())
    return Refreshed(games, unread.select(*keep, "error").unionByName(wrong.select(*keep, "error")))


__all__ = [
    "HITTER",
    "PITCHER",
    "Refreshed",
    "SeasonView",
    "career_view",
    "load_seasons",
    "page_records",
    "refresh",
    "refresh_pending",
    "report_frame",
    "schedule_games",
    "season_teams",
    "season_view",
    "view_rows",
]
