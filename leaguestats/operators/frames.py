"""Column selection, naming and reshaping."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.schemas import labels


def select_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    present = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in columns if c in present])


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ("No",)) -> list[str]:
    """Names of the numeric columns, from the declared schema."""
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def relabel(df: DataFrame, kind: str, lang: str = "kr") -> DataFrame:
    """Column names to display labels (``kr``) or back (``en``).

    Columns without a label keep their name.
    """
    names = labels(kind)
    if lang == "en":
        names = {label: name for name, label in names.items()}
    elif lang != "kr":
        raise ValueError(f"unknown label language: {lang}")
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def stack_frames(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column missing from one frame is NULL there."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per id and column: (ids..., Stat, Value), values as double; NaN and infinities are NULL."""
    values = [f"cast(`{c}` as double) as `{c}`" for c in columns]
    long = df.selectExpr(*[f"`{i}`" for i in ids], *values).unpivot(list(ids), list(columns), "Stat", "Value")
    return long.withColumn("Value", F.expr("if(abs(Value) < double('infinity'), Value, null)"))


def _spread(names: Sequence[str], by: str, value: str) -> list[Column]:
    """One conditional maximum per name: the rows of an id collapse before the shuffle."""
    return [F.max(F.when(F.col(f"`{by}`") == name, F.col(value))).alias(name) for name in names]


def to_wide(long: DataFrame, ids: Sequence[str], columns: Sequence[str], value: str = "Value") -> DataFrame:
    """Inverse of ``to_long``; the columns are given, so no pass is needed to find them."""
    return long.groupBy(*ids).agg(*_spread(columns, "Stat", value))


def transpose_stats(
    df: DataFrame,
    name_col: str,
    names: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Metrics as rows and the values of ``name_col`` as columns.

    Meant for a handful of names; without ``names`` Spark looks them up and
    refuses more than ``spark.sql.pivotMaxValues``.
    """
    columns = list(columns or numeric_columns(df, exclude=("No", name_col, *keys)))
    long = to_long(df, [*keys, name_col], columns).groupBy(*keys, "Stat")
    if names is None:
        return long.pivot(name_col).agg(F.max("Value"))
    return long.agg(*_spread(names, name_col, "Value"))
