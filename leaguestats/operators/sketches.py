"""Mergeable summaries of values: approximate quantiles for groups of any size.

A group's values are kept as one KLL sketch with their count, sum, limits and
spread.  Summaries of seasons, teams or partitions merge into one of the whole, so
a profile over many seasons reads a row per season, group and metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import np_round
from .frames import to_long

# Size of a sketch: about three times as many values are kept at most.
RANK_ERROR_K = 1000


def rank_error(k: int = RANK_ERROR_K) -> float:
    """How far the rank of a returned quantile may lie from the one asked for, as a share of the values.

    Holds for 99 of 100 quantiles.  Up to ``k`` values a sketch keeps all of them
    and only the choice between neighbours is left.
    """
    return 2.296 / k**0.9723  # the published fit for one-sided ranks


def sketch_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = RANK_ERROR_K) -> DataFrame:
    """(by..., Stat, count, total, squares, least, most, sketch), one row per group and metric with a value.

    ``squares`` is the sum of squared distances from the group's mean.  One
    aggregation, partial before the shuffle: a hot group sends a sketch per task.
    """
    value = F.col("Value")
    long = to_long(df, by, columns).where(value.isNotNull())
    return long.groupBy(*by, "Stat").agg(
        F.count(value).alias("count"),
        F.sum(value).alias("total"),
        (F.var_pop(value) * F.count(value)).alias("squares"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``sketch_values`` merged to coarser groups.

    Squares add up with those of the means around the common mean, which a first
    aggregation finds; the rows are few, one per former group.
    """
    keys = [*by, "Stat"]
    around = sketches.groupBy(*keys).agg((F.sum("total") / F.sum("count")).alias("_mean"))
    apart = F.col("total") / F.col("count") - F.col("_mean")
    return (
        sketches.join(around, keys)
        .groupBy(*keys)
        .agg(
            F.sum("count").alias("count"),
            F.sum("total").alias("total"),
            F.sum(F.col("squares") + F.col("count") * apart * apart).alias("squares"),
            F.min("least").alias("least"),
            F.max("most").alias("most"),
            F.kll_merge_agg_double("sketch").alias("sketch"),
        )
    )


def _quantile(q: float) -> Column:
    """The ends of the distribution are known exactly, and no estimate lies beyond them."""
    found = F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))
    return F.least(F.greatest(found, F.col("least")), F.col("most"))


def _keys(sketches: DataFrame) -> list[str]:
    return sketches.columns[: sketches.columns.index("Stat") + 1]


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """(by..., Stat, mean, median), three places; the median within the rank error."""
    return sketches.select(
        *_keys(sketches), np_round(F.col("total") / F.col("count"), 3).alias("mean"), np_round(_quantile(0.5), 3).alias("median")
    )


def sketched_description(sketches: DataFrame) -> DataFrame:
    """(by..., Stat, count, mean, std, min, q25, q50, q75, max); quartiles within the rank error, the rest exact."""
    return sketches.select(
        *_keys(sketches),
        "count",
        (F.col("total") / F.col("count")).alias("mean"),
        F.sqrt(F.try_divide(F.col("squares"), (F.col("count") - 1).cast("double"))).alias("std"),
        F.col("least").alias("min"),
        *[_quantile(q / 100).alias(f"q{q}") for q in (25, 50, 75)],
        F.col("most").alias("max"),
    )


def sketched_quartiles(sketches: DataFrame) -> DataFrame:
    """(by..., Stat, q1, median, q3) within the rank error."""
    return sketches.select(*_keys(sketches), *[_quantile(q).alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
