"""Reading a game schedule into scores and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Words and labels of the schedule pages.
VENUE_SUFFIX = "야구장"
CALLED_WIN = "콜드승"
WIN_PREFIXES = ("콜드승 ", "기권승 ", "몰수승 ")
WAITING = "게임대기"
NOT_PLAYED, DRAW = "경기전", "무"
WIN, LOSS, CALLED_LOSS = "승", "패", "콜드패"


def _bare_score(token: Column) -> Column:
    """Score token without its win word."""
    for prefix in WIN_PREFIXES:
        token = F.replace(token, F.lit(prefix), F.lit(""))
    return token


def parse_schedule(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Raw schedule rows to typed games.

    The game cell is a newline-separated list: away team first, then its score,
    three fillers, home team, home score.  A short list leaves the tail NULL; a
    blank or missing score is 0.  A score that is not a number is NULL, and
    ``error`` names it.
    """
    tokens = F.split(F.col("게임"), "\n")
    places = {"away": 0, "away_token": 1, "home": 5, "home_token": 6}
    cells = raw.select(
        *keep,
        F.col("일시").alias("date"),
        F.replace(F.col("구장"), F.lit(VENUE_SUFFIX), F.lit("")).alias("venue"),
        F.col("결과").alias("status"),
        *[F.get(tokens, F.lit(i)).alias(name) for name, i in places.items()],
    )

    def read(side: str) -> list[Column]:
        token = F.col(f"{side}_token")
        number = _bare_score(token).try_cast("int")
        unread = F.when(number.isNull() & (F.trim(_bare_score(token)) != ""), F.lit(f"{side} score"))
        return [
            F.when(unread.isNull(), F.coalesce(number, F.lit(0))).alias(f"{side}_score"),
            F.coalesce(F.contains(token, F.lit(CALLED_WIN)), F.lit(False)).alias(f"{side}_called"),
            unread.alias(f"{side}_unread"),
        ]

    scored = cells.select(*keep, "date", "venue", "away", "home", "status", *read("away"), *read("home"))
    problems = F.concat_ws(", ", "away_unread", "home_unread")
    return scored.select(
        *keep,
        "date",
        "venue",
        "away",
        "away_score",
        "home",
        "home_score",
        "status",
        "away_called",
        "home_called",
        F.when(problems != "", problems).alias("error"),
    )


def game_result(games: DataFrame) -> DataFrame:
    """Add ``winner`` (NULL without one), ``called`` and the result label.

    The label is winner and kind of win, a draw once the game is no longer
    waiting, or "not played".  A game with an unread score has no result.
    """
    away_won = F.col("away_score") > F.col("home_score")
    home_won = F.col("away_score") < F.col("home_score")
    winner = F.when(away_won, F.col("away")).when(home_won, F.col("home"))
    called = F.when(away_won, F.col("away_called")).when(home_won, F.col("home_called")).otherwise(False)
    ended = ~F.col("status").eqNullSafe(WAITING)
    label = (
        F.when(away_won | home_won, F.concat(winner, F.lit("_"), F.when(called, CALLED_WIN).otherwise(WIN)))
        .when(ended, F.lit(DRAW))
        .otherwise(F.lit(NOT_PLAYED))
    )
    known = F.col("away_score").isNotNull() & F.col("home_score").isNotNull()
    return games.select("*", winner.alias("winner"), called.alias("called"), F.when(known, label).alias("result"))


def _seen_by(team: Column) -> Column:
    """Result label from the side of one team."""
    return (
        F.when((F.col("winner") == team) & F.col("called"), F.lit(CALLED_WIN))
        .when(F.col("winner") == team, F.lit(WIN))
        .when(F.col("winner").isNotNull() & ~F.col("called"), F.lit(LOSS))
        .when(F.col("winner").isNotNull(), F.lit(CALLED_LOSS))
        .otherwise(F.col("result"))
    )


def result_for(results: DataFrame, team: str) -> DataFrame:
    """The schedule with results as one team sees them."""
    return results.withColumn("result", _seen_by(F.lit(team)))


def results_by_team(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each game from both sides: team, opponent, runs and result.

    A row becomes two without a shuffle.
    """
    sides = F.explode(
        F.array(
            F.struct(
                F.col("away").alias("team"),
                F.col("home").alias("opponent"),
                F.col("away_score").alias("runs_for"),
                F.col("home_score").alias("runs_against"),
            ),
            F.struct(
                F.col("home").alias("team"),
                F.col("away").alias("opponent"),
                F.col("home_score").alias("runs_for"),
                F.col("away_score").alias("runs_against"),
            ),
        )
    )
    return (
        results.withColumn("side", sides)
        .select("*", "side.*")
        .select(*keep, "date", "venue", "team", "opponent", "runs_for", "runs_against", _seen_by(F.col("team")).alias("result"))
    )


def schedule_table(results: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The displayed schedule, by date; games without one come last.  Carries ``error`` where the games have it."""
    problems = ["error"] if "error" in results.columns else []
    return results.select(
        *keep, "date", "venue", "away", "away_score", "home", "home_score", "result", *problems
    ).orderBy(F.asc_nulls_last("date"), "venue", "away", "home")


def not_played() -> Column:
    """Whether a game lies ahead: still waiting and level.

    Says the same as its result label, from the columns the label is made of,
    so a filter on it stays small when it moves below the label.
    """
    return F.col("status").eqNullSafe(WAITING) & (F.col("away_score") == F.col("home_score"))


def next_game(results: DataFrame, team: str) -> DataFrame:
    """First game of a team not played yet, with the opponent; empty if none.  A game without a date comes last."""
    mine = (F.col("away") == team) | (F.col("home") == team)
    return (
        results.where(not_played() & mine)
        .orderBy(F.asc_nulls_last("date"), "venue", "away", "home")
        .limit(1)
        .select(
            "date", "venue", "away", "home", F.when(F.col("away") == team, F.col("home")).otherwise(F.col("away")).alias("opponent")
        )
    )


def next_games(results: DataFrame) -> DataFrame:
    """First game not played yet of every team, by one partial aggregation."""
    waiting = results_by_team(results.where(not_played()), keep=("away", "home"))
    first = F.min(F.struct(F.col("date").isNull().alias("undated"), "date", "venue", "away", "home", "opponent"))
    return waiting.groupBy("team").agg(first.alias("game")).select("team", "game.*").drop("undated")
