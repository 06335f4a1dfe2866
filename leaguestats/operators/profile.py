"""League profiles: mean, median, summary statistics, histograms, box plots.

Each function reads its input once, counts the distinct values and derives all
statistics from the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..checkpoints import durable
from ..functions.exprs import np_round
from .distribution import counted_values, group_sums, join_by_value, order_statistics, positions, with_statistics
from .frames import numeric_columns, to_long
from .sketches import RANK_ERROR_K, sketch_values, sketched_description, sketched_profile, sketched_quartiles


def _counted(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keys = [*by, "Stat"]
    return counted_values(to_long(df, by, columns), keys), keys


def _sum_of_billionths() -> Column:
    """Sum of the values in billionths: exact for values below 1e12, whatever order partitions arrive in.

    Larger values are summed apart, in classes of 1e12 and 1e24, each as whole
    numbers of its own unit, and what lies beyond as doubles; no value ends the
    job.
    """
    value, n = F.col("Value"), F.col("n").cast("decimal(15,0)")
    size = F.abs(value)

    def part(low: float, high: float, scale: float) -> Column:
        whole = F.rint(F.when((size >= low) & (size < high), value / scale) * 1e9).cast("decimal(22,0)")
        return F.coalesce(F.sum(whole * n).cast("double"), F.lit(0.0)) * scale

    beyond = F.coalesce(F.sum(F.when(size >= 1e36, value * F.col("n"))), F.lit(0.0)) * 1e9
    return part(-1.0, 1e12, 1.0) + part(1e12, 1e24, 1e12) + part(1e24, 1e36, 1e24) + beyond


def _complete(columns: Sequence[str]) -> Column:
    """Whether a row has all of the columns, none NULL or NaN, as one test over an array.

    A test per column would leave the optimizer a constraint for each, which it
    multiplies through every later projection of the same columns.
    """
    values = ", ".join(f"cast(`{c}` as double)" for c in columns)
    return F.expr(f"not exists(array({values}), x -> x is null or isnan(x))")


def _numbers(df: DataFrame, by: Sequence[str]) -> list[str]:
    return numeric_columns(df, exclude=("No", *by))


def league_profile(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    complete_rows: bool = False,
    approx: bool = False,
    k: int = RANK_ERROR_K,
) -> DataFrame:
    """Mean and median per metric, three places: (by..., Stat, mean, median).

    With ``complete_rows`` a row with any missing metric is left out.  The mean
    adds billionths as whole numbers, so it does not depend on the order in
    which partitions arrive and ties round the same way every time.  With
    ``approx`` one aggregation of sketches of size ``k`` takes the place of counting
    values: the median lies within ``sketches.rank_error(k)``.
    """
    keys = [*by, "Stat"]
    if approx:
        rows = df.withColumn("_complete", _complete(columns)).where("_complete") if complete_rows else df
        return sketched_profile(sketch_values(rows, columns, by, k))
    if complete_rows:
        # The flag goes through the long form beside the values: a filter before it would be pushed under every formula.
        long = to_long(df.withColumn("_complete", _complete(columns)), [*by, "_complete"], columns)
        counted = counted_values(long.where("_complete").drop("_complete"), keys)
    else:
        counted, keys = _counted(df, columns, by)
    profile = order_statistics(
        positions(counted, keys), keys, {"median": 0.5}, extra=[_sum_of_billionths().alias("billionths")]
    )
    return profile.select(
        *keys,
        np_round(F.col("billionths") / 1e9 / F.col("count"), 3).alias("mean"),
        np_round(F.col("median"), 3).alias("median"),
    )


def describe_stats(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), approx: bool = False, k: int = RANK_ERROR_K
) -> DataFrame:
    """(by..., Stat, count, mean, std, min, q25, q50, q75, max), of all numeric columns unless some are named.

    The sample deviation is taken around the mean in a second pass over the
    counts, which loses no digits to cancellation.  With ``approx`` the quartiles
    come from sketches of size ``k``, within ``sketches.rank_error(k)``.
    """
    columns = _numbers(df, by) if columns is None else columns
    if approx:
        return sketched_description(sketch_values(df, columns, by, k))
    counted, keys = _counted(df, columns, by)
    scaled = F.col("Value") * 1e9
    # What the whole billionths leave over; too small for its order to matter.
    rest = F.coalesce(F.sum(F.when(F.abs(F.col("Value")) < 1e12, (scaled - F.rint(scaled)) * F.col("n"))), F.lit(0.0))
    stats = order_statistics(
        positions(counted, keys),
        keys,
        {"q25": 0.25, "q50": 0.5, "q75": 0.75},
        extra=[
            ((_sum_of_billionths() + rest) / 1e9 / F.sum("n")).alias("mean"),
            F.min("Value").alias("min"),
            F.max("Value").alias("max"),
        ],
    )
    squares = F.col("n") * F.pow(F.col("Value") - F.col("mean"), F.lit(2.0))
    names = ["count", "mean", "min", "q25", "q50", "q75", "max"]
    joined, spread = with_statistics(counted, stats, keys)
    return group_sums(joined, keys, spread, {"squares": squares}, same={c: F.col(c) for c in names}).select(
        *keys,
        "count",
        "mean",
        F.sqrt(F.try_divide(F.col("squares"), (F.col("count") - 1).cast("double"))).alias("std"),
        *names[2:],
    )


def _bin_width(whole: Sequence[str]) -> Column:
    """Automatic bin width; see ``histograms``."""
    span = F.col("stop") - F.col("start")
    size = F.col("count").cast("double")
    spread = 2.0 * (F.col("q75") - F.col("q25")) * F.pow(size, F.lit(-1.0 / 3.0))
    width = F.least(F.greatest(spread, span / (2.0 * F.sqrt(size))), span / (F.log2(size) + 1.0))
    return F.when(F.col("Stat").isin(list(whole)), F.greatest(width, F.lit(1.0))).otherwise(width)


def _bin_of(value: Column) -> Column:
    """Bin of a value by the printed edges; the last bin is closed on the right.

    The quotient can miss by one next to an edge, hence the comparison with the
    edges on both sides.
    """
    guess = F.floor((value - F.col("start")) / F.col("width"))
    down = F.when(value < F.col("start") + guess * F.col("width"), 1).otherwise(0)
    up = F.when(value >= F.col("start") + (guess + 1) * F.col("width"), 1).otherwise(0)
    return F.least(guess - down + up, F.col("bins") - 1)


def histograms(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int | str = "auto",
    by: Sequence[str] = (),
    unit_bins: bool = False,
) -> DataFrame:
    """Histogram data: (by..., Stat, bin, lo, hi, n), empty bins included.

    ``auto`` takes the narrower of the Sturges width and the Freedman-Diaconis
    width, the latter floored so that there are at most two bins per square
    root of the count; with ``unit_bins`` a bin of an integer column is at least
    1 wide.  A constant column gets one bin around its value.  All numeric columns
    unless some are named.
    """
    columns = _numbers(df, by) if columns is None else columns
    counted, keys = _counted(df, columns, by)
    limits = [F.min("Value").alias("start"), F.max("Value").alias("stop")]
    if bins == "auto":
        whole = [c for c in columns if unit_bins and isinstance(df.schema[c].dataType, T.IntegralType)]
        edges = order_statistics(positions(counted, keys), keys, {"q25": 0.25, "q75": 0.75}, extra=limits)
        number = F.coalesce(F.ceil(F.try_divide(F.col("stop") - F.col("start"), _bin_width(whole))), F.lit(1))
        number = F.greatest(number, F.lit(1))
    else:
        edges = counted.groupBy(*keys).agg(*limits)
        number = F.lit(int(bins)).cast("bigint")
    half = F.when(F.col("start") == F.col("stop"), 0.5).otherwise(0.0)
    edges = edges.select(
        *keys, number.alias("bins"), (F.col("start") - half).alias("start"), (F.col("stop") + half).alias("stop")
    ).withColumn("width", (F.col("stop") - F.col("start")) / F.col("bins"))
    last = F.col("bins") - 1
    binned, _ = with_statistics(counted, edges, keys)
    # Counts are added up in each task before they meet, so a hot group or bin sends few rows.
    filled = binned.groupBy(*keys, _bin_of(F.col("Value")).alias("bin")).agg(F.sum("n").alias("n"))
    every_bin = edges.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("bin"))
    upper = F.when(F.col("bin") == last, F.col("stop")).otherwise(F.col("start") + (F.col("bin") + 1) * F.col("width"))
    return every_bin.join(filled, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("start") + F.col("bin") * F.col("width")).alias("lo"),
        upper.alias("hi"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
    )


def _boxes(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _boxes_from(counted, order_statistics(positions(counted, keys), keys, {"q1": 0.25, "median": 0.5, "q3": 0.75}), keys)


def _boxes_from(counted: DataFrame, quartiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col("Value").between(F.col("q1") - reach, F.col("q3") + reach)
    joined, spread = with_statistics(counted, quartiles, keys)
    boxes = group_sums(
        joined,
        keys,
        spread,
        {"outliers": F.when(near, 0).otherwise(F.col("n"))},
        same={c: F.col(c) for c in ("q1", "median", "q3")},
        least={"nearest": F.when(near, F.col("Value"))},
        most={"farthest": F.when(near, F.col("Value"))},
    )
    # A whisker never ends inside the box.
    return boxes.select(
        *keys,
        "q1",
        "median",
        "q3",
        F.least(F.col("nearest"), F.col("q1")).alias("whisker_lo"),
        F.greatest(F.col("farthest"), F.col("q3")).alias("whisker_hi"),
        "outliers",
    )


def boxplots(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), approx: bool = False, k: int = RANK_ERROR_K
) -> DataFrame:
    """(by..., Stat, q1, median, q3, whisker_lo, whisker_hi, outliers), of all numeric columns unless some are named.

    Whiskers end at the last value within one and a half box lengths.  With
    ``approx`` the box comes from sketches of size ``k``, within
    ``sketches.rank_error(k)``, and whiskers and outliers are exact for that box.
    """
    columns = _numbers(df, by) if columns is None else columns
    if not approx:
        return _boxes(*_counted(df, columns, by))
    quartiles = durable(sketched_quartiles(sketch_values(df, columns, by, k)))
    # Rows are dealt over ranges of a hash: a group too large for one task meets its box in many.
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = to_long(df, by, columns).where("Value is not null").withColumns({"n": F.lit(1), "range": F.pmod(F.xxhash64("Value"), F.lit(shares))})
    return _boxes_from(values, quartiles, [*by, "Stat"])


def outliers(df: DataFrame, columns: Sequence[str], ids: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the whiskers: (by..., ids..., Stat, Value).

    The outlying values are found among the counted ones; rows then meet their own
    value, not their group, so a hot group does not gather anywhere.
    """
    counted, keys = _counted(df, columns, by)
    boxes = _boxes(counted, keys).select(*keys, "whisker_lo", "whisker_hi")
    beyond = ~F.col("Value").between(F.col("whisker_lo"), F.col("whisker_hi"))
    joined, _ = with_statistics(counted, boxes, keys)
    marks = durable(joined.where(beyond).select(*keys, "Value", "n", F.lit(True).alias("_beyond")))
    rows = join_by_value(to_long(df, [*by, *ids], columns), counted, marks, [*keys, "Value"], "inner")
    return rows.select(*by, *ids, "Stat", "Value")
