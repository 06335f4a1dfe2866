"""Ordered distribution of a long frame: the base of ranks and exact quantiles.

Ranks, medians, quartiles and whiskers all ask "how many values lie below this
one".  Sorting each metric in a single window would put a whole metric on one
task, and exact percentile aggregates keep all distinct values of a group in one
buffer.  Here the values are first counted (a value shared by a third of all
rows becomes one row), then range-partitioned, and the running count is built
from a count inside each range plus the total of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import checkpoints
from ..checkpoints import SMALL_ROWS, durable

# A value held by more than one in this many rows counts as frequent.
_SHARE = 10_000


def counted_values(long: DataFrame, keys: Sequence[str], value: str = "Value") -> DataFrame:
    """Distinct values per key group: (keys..., value, n, range).

    ``range`` numbers the range partition the value fell in; ranges do not
    overlap and rise with (keys, value).  NULL values are left out.  Eager: the
    result is written once to the checkpoint folder, because every later use
    must see a value in the same range.
    """
    counted = long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    # No partition number: adaptive execution merges small ranges.
    return durable(counted.repartitionByRange(*keys, value).withColumn("range", F.spark_partition_id()))


def positions(counted: DataFrame, keys: Sequence[str], value: str = "Value") -> DataFrame:
    """Position of each counted value: (keys..., value, n, below, total).

    ``below`` rows of the group hold a lower value, ``total`` rows hold any.
    No window is longer than one range of values or the list of ranges.
    """
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counted.groupBy(*keys, "range")
        .agg(F.sum("n").alias("held"))
        .select(
            *keys,
            "range",
            F.coalesce(F.sum("held").over(before), F.lit(0)).alias("earlier"),
            F.sum("held").over(Window.partitionBy(*keys)).alias("total"),
        )
    )
    lower = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.withColumn("lower", F.coalesce(F.sum("n").over(lower), F.lit(0)))
        .join(offsets, [*keys, "range"])
        .select(*keys, value, "n", (F.col("earlier") + F.col("lower")).alias("below"), "total")
    )


def _between(low: Column, high: Column, weight: Column, q: float) -> Column:
    """Linear interpolation, from the nearer end as NumPy does it."""
    if q == 0.5:
        return (low + high) / 2.0
    return F.when(weight < 0.5, low + (high - low) * weight).otherwise(high - (high - low) * (1.0 - weight))


def order_statistics(
    placed: DataFrame,
    keys: Sequence[str],
    quantiles: dict[str, float],
    value: str = "Value",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles, one column per name, with the ``count`` and ``extra`` aggregates.

    The value at position ``p`` is the one with ``below <= p < below + n``, so
    each quantile is two conditional maxima in one partial aggregation.
    """

    def at(name: str, q: float) -> list[Column]:
        position = F.lit(float(q)) * (F.col("total") - 1).cast("double")
        ends = {"lo": F.floor(position), "hi": F.ceil(position)}
        return [
            F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("n")), F.col(value))).alias(f"{name}_{end}")
            for end, p in ends.items()
        ]

    picks = [pick for name, q in quantiles.items() for pick in at(name, q)]
    picked = placed.groupBy(*keys).agg(F.max("total").alias("count"), *picks, *extra)
    made = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("count") - 1).cast("double")
        weight = position - F.floor(position)
        made.append(_between(F.col(f"{name}_lo"), F.col(f"{name}_hi"), weight, q).alias(name))
    spare = {f"{name}_{end}" for name in quantiles for end in ("lo", "hi")}
    return picked.select(*[c for c in picked.columns if c not in spare], *made)


def with_statistics(counted: DataFrame, stats: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool]:
    """Counted values beside the statistics of their group: (joined, whether groups are spread).

    A statistics table without further groups, or one counted as small, is
    broadcast.  A larger one is first given to each (group, range), of which a
    group has as many as its values fill, and meets the values there: the values
    of a hot group stay dealt over its ranges and no task gets the whole group.
    """
    if len(keys) == 1:
        return counted.join(F.broadcast(stats), list(keys)), False
    stats = durable(stats)
    if checkpoints.is_small(stats):
        return counted.join(F.broadcast(stats), list(keys)), False
    per_range = counted.select(*keys, "range").distinct().join(stats, list(keys))
    # Merged by sorting: the list of ranges must not be broadcast either.
    return counted.join(per_range.hint("merge"), [*keys, "range"]), True


def group_sums(joined: DataFrame, keys: Sequence[str], spread: bool, sums: dict[str, Column], **other: dict[str, Column]) -> DataFrame:
    """Aggregate joined values per group: ``sums`` add up; ``least``, ``most`` and ``same`` hold minima, maxima and constants.

    If groups are spread, first per (keys, range), where the join has left them,
    and then the few rows of a group together.
    """
    merge = {"least": F.min, "most": F.max, "same": F.first}
    kinds = {name: F.sum for name in sums} | {name: merge[kind] for kind, columns in other.items() for name in columns}
    columns = sums | {name: c for made in other.values() for name, c in made.items()}
    first = joined.groupBy(*keys, *(["range"] if spread else [])).agg(*[kinds[name](c).alias(name) for name, c in columns.items()])
    return first.groupBy(*keys).agg(*[kinds[name](name).alias(name) for name in columns]) if spread else first


def join_by_value(long: DataFrame, counted: DataFrame, marks: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join rows with what is known of their value: ``marks`` (on..., n, more columns), some or all of the counted values.

    Few marks are broadcast whole.  Otherwise the values that hold more than a
    ``_SHARE``-th of all rows are broadcast, fewer than ``_SHARE`` by their
    definition, and only the other rows are shuffled to their value: no key of that
    join is hot, and rows without a value are not moved at all.  ``how`` is left or
    inner.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join: {how}")
    rows = counted.agg(F.sum("n")).first()[0] or 0
    if marks.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return long.join(F.broadcast(marks.drop("n")), on, how)
    frequent = F.col("n") * _SHARE > rows
    many = counted.where(frequent).select(*on, F.lit(True).alias("_many"))
    tagged = long.join(F.broadcast(many.join(marks.drop("n"), on, "left")), on, "left")
    open_ = F.col(on[-1]).isNotNull() & F.col("_many").isNull()
    added = [c for c in marks.columns if c not in (*on, "n")]
    rest = tagged.where(open_).drop("_many", *added).join(marks.where(~frequent).drop("n"), on, how)
    placed = tagged.where(~open_)
    if how == "inner":  # a frequent value without a mark, or no value
        placed = placed.where(F.col("_many") & F.coalesce(*[F.col(c).isNotNull() for c in added]))
    return placed.drop("_many").unionByName(rest)
