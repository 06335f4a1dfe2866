"""Metric registry: formulas, summed columns, rank directions and orders.

A metric names the columns it needs.  ``operators.totals.add_metrics`` adds it
to a frame only when they are all present, so the same registry serves partial
tables.  Rates are always evaluated after summing, never summed themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .exprs import np_round, ratio
from .schemas import HITTER, PITCHER

PLAYER, TEAM, CAREER = "player", "team", "career"


@dataclass(frozen=True)
class Metric:
    name: str
    inputs: tuple[str, ...]
    formula: Callable[[], Column]
    grains: tuple[str, ...]


def _sum(*names: str) -> Column:
    total = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return total


def _rate(top: tuple[str, ...], bottom: tuple[str, ...], digits: int | None = None, times: int = 1) -> Callable[[], Column]:
    def build() -> Column:
        value = ratio(_sum(*top), _sum(*bottom))
        if times != 1:
            value = value * float(times)
        return value if digits is None else np_round(value, digits)

    return build


def _metric(name, top, bottom, grains, digits=None, times=1) -> Metric:
    inputs = tuple(dict.fromkeys(top + bottom))
    return Metric(name, inputs, _rate(top, bottom, digits, times), grains)


# Listed in evaluation order: OPS reads the rounded OBP and SLG, K9 the rounded SO/IP.
HITTER_METRICS = (
    _metric("AVG", ("H",), ("AB",), (TEAM, CAREER), 3),
    _metric("OBP", ("H", "BB", "HBP"), ("AB", "BB", "HBP", "SF"), (TEAM, CAREER), 3),
    _metric("SLG", ("TB",), ("AB",), (TEAM, CAREER), 3),
    Metric("OPS", ("OBP", "SLG"), lambda: np_round(_sum("OBP", "SLG"), 3), (TEAM, CAREER)),
    _metric("SB%", ("SB",), ("SB", "CS"), (CAREER,)),
    _metric("BB/K", ("BB",), ("SO",), (CAREER,)),
    _metric("XBH/H", ("2B", "3B", "HR"), ("H",), (CAREER,)),
)

PITCHER_METRICS = (
    _metric("ERA", ("ER",), ("IP",), (TEAM, CAREER), 2, times=9),
    _metric("SO/IP", ("SO",), ("IP",), (PLAYER, TEAM, CAREER), 2),
    _metric("BB/IP", ("BB",), ("IP",), (PLAYER, TEAM, CAREER), 2),
    _metric("H/IP", ("HA",), ("IP",), (PLAYER, TEAM, CAREER), 2),
    Metric("K9", ("SO/IP",), lambda: F.col("SO/IP") * 9.0, (TEAM, CAREER)),
    _metric("WHIP", ("BB", "HA"), ("IP",), (PLAYER, TEAM, CAREER), 3),
    _metric("BAA", ("HA",), ("AB",), (TEAM, CAREER), 3),
    _metric("OBP", ("HA", "BB", "HBP"), ("AB", "BB", "HBP", "SF"), (PLAYER, TEAM, CAREER)),
)

METRICS = {HITTER: HITTER_METRICS, PITCHER: PITCHER_METRICS}

# Columns that may be summed over players and seasons.
SUMS = {
    HITTER: (
        "PA", "AB", "R", "H", "1B", "2B", "3B", "HR", "TB", "RBI",
        "SB", "CS", "SH", "SF", "BB", "IBB", "HBP", "SO", "DP", "MHit",
    ),
    PITCHER: (
        "G", "W", "L", "SV", "HLD", "BF", "AB", "P", "IP", "HA", "HR",
        "SH", "SF", "BB", "IBB", "HBP", "SO", "WP", "BK", "R", "ER",
    ),
}
CAREER_SUMS = {HITTER: ("G",) + SUMS[HITTER], PITCHER: SUMS[PITCHER]}

# Output order of a team table.
ORDER = {
    HITTER: (
        "Team", "AVG", "PA", "AB", "H", "RBI", "R", "OBP", "SLG", "OPS", "SO", "BB", "SB",
        "MHit", "1B", "2B", "3B", "HR", "TB", "CS", "SH", "SF", "IBB", "HBP", "DP",
    ),
    PITCHER: (
        "Team", "IP", "ERA", "WHIP", "H/IP", "BB/IP", "SO/IP", "BAA", "OBP", "G", "W", "L",
        "SV", "HLD", "SO", "BF", "AB", "P", "HA", "HR", "SH", "SF", "BB", "IBB", "HBP",
        "WP", "BK", "R", "ER", "K9",
    ),
}

# Metrics where a low value is good.  All others rank high-is-good,
# which includes a pitcher's losses.
LOW_IS_GOOD = {
    HITTER: ("SO", "DP", "CS"),
    PITCHER: (
        "ERA", "WHIP", "H/IP", "BB/IP", "BAA", "OBP", "BF", "AB", "P", "HA", "HR",
        "SH", "SF", "BB", "IBB", "HBP", "WP", "BK", "R", "ER",
    ),
}

# Columns left out of the rank matrix, leader-board sort keys and
# the metrics compared by default.
MATRIX_DROP = {HITTER: ("PA", "AB"), PITCHER: ("BF", "AB")}
LEADER_KEYS = {HITTER: ("PA", "AVG"), PITCHER: ("IP", "ERA")}
COMPARE_DEFAULT = {
    HITTER: ("AVG", "OBP", "OPS", "BB", "SO", "SB"),
    PITCHER: ("ERA", "WHIP", "H/IP", "BB/IP", "SO/IP", "BAA"),
}


def ranked_metrics(kind: str) -> tuple[str, ...]:
    """Metrics of a team table in output order."""
    return ORDER[kind][1:]
