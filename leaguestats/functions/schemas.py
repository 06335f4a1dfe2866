"""Column tables of the two record kinds and the schedule."""

from __future__ import annotations

from pyspark.sql import types as T

HITTER = "hitter"
PITCHER = "pitcher"
SCHEDULE = "schedule"

# Page header, column name and type of a hitter record.
HITTER_COLUMNS = (
    ("성명", "Name", "string"),
    ("배번", "No", "string"),
    ("타율", "AVG", "double"),
    ("경기", "G", "bigint"),
    ("타석", "PA", "bigint"),
    ("타수", "AB", "bigint"),
    ("득점", "R", "bigint"),
    ("총안타", "H", "bigint"),
    ("1루타", "1B", "bigint"),
    ("2루타", "2B", "bigint"),
    ("3루타", "3B", "bigint"),
    ("홈런", "HR", "bigint"),
    ("루타", "TB", "bigint"),
    ("타점", "RBI", "bigint"),
    ("도루", "SB", "bigint"),
    ("도실(도루자)", "CS", "bigint"),
    ("희타", "SH", "bigint"),
    ("희비", "SF", "bigint"),
    ("볼넷", "BB", "bigint"),
    ("고의4구", "IBB", "bigint"),
    ("사구", "HBP", "bigint"),
    ("삼진", "SO", "bigint"),
    ("병살", "DP", "bigint"),
    ("장타율", "SLG", "double"),
    ("출루율", "OBP", "double"),
    ("도루성공률", "SB%", "double"),
    ("멀티히트", "MHit", "bigint"),
    ("OPS", "OPS", "double"),
    ("BB/K", "BB/K", "double"),
    ("장타/안타", "XBH/H", "double"),
    ("팀", "Team", "string"),
)

# Page header, column name and type of a pitcher record.
PITCHER_COLUMNS = (
    ("성명", "Name", "string"),
    ("배번", "No", "string"),
    ("방어율", "ERA", "double"),
    ("경기수", "G", "bigint"),
    ("승", "W", "bigint"),
    ("패", "L", "bigint"),
    ("세", "SV", "bigint"),
    ("홀드", "HLD", "bigint"),
    ("승률", "WPCT", "double"),
    ("타자", "BF", "bigint"),
    ("타수", "AB", "bigint"),
    ("투구수", "P", "bigint"),
    ("이닝", "IP", "double"),
    ("피안타", "HA", "bigint"),
    ("피홈런", "HR", "bigint"),
    ("희타", "SH", "bigint"),
    ("희비", "SF", "bigint"),
    ("볼넷", "BB", "bigint"),
    ("고의4구", "IBB", "bigint"),
    ("사구", "HBP", "bigint"),
    ("탈삼진", "SO", "bigint"),
    ("폭투", "WP", "bigint"),
    ("보크", "BK", "bigint"),
    ("실점", "R", "bigint"),
    ("자책점", "ER", "bigint"),
    ("WHIP", "WHIP", "double"),
    ("피안타율", "BAA", "double"),
    ("탈삼진율", "K9", "double"),
    ("팀", "Team", "string"),
)

COLUMNS = {HITTER: HITTER_COLUMNS, PITCHER: PITCHER_COLUMNS}

# Labels that differ from the page header, or belong to a column
# that is computed and never read.
LABEL_CHANGES = {
    HITTER: {"CS": "도실"},
    PITCHER: {"SLG": "피장타율", "OBP": "피출루율", "OPS": "피OPS"},
}

# Page header variants to bring to the declared one.
HEADER_ALIASES = {HITTER: {"게임수": "경기"}, PITCHER: {"게임수": "경기수"}}

PLAYER_KEY = ("Team", "Name", "No")


def header_names(kind: str) -> dict[str, str]:
    """Page header to column name."""
    return {header: name for header, name, _ in COLUMNS[kind]}


def labels(kind: str) -> dict[str, str]:
    """Column name to display label."""
    return {name: header for header, name, _ in COLUMNS[kind]} | LABEL_CHANGES[kind]


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType()}


def season_schema(kind: str, with_year: bool = True) -> T.StructType:
    """Declared schema of a season snapshot; ``Year`` is the partition column."""
    schema = T.StructType([T.StructField(name, _TYPES[type_]) for _, name, type_ in COLUMNS[kind]])
    return schema.add("Year", T.IntegerType()) if with_year else schema


# Header names of the raw schedule table.
SCHEDULE_HEADERS = ("일시", "구장", "분류", "게임", "결과")

SCHEDULE_RESULT = ("date", "venue", "away", "away_score", "home", "home_score", "result")
