"""Team comparison, team sheets and the texts built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..checkpoints import statistics_side
from ..functions.exprs import finite, lookup, plain_number
from ..functions.registry import COMPARE_DEFAULT, LOW_IS_GOOD, ORDER
from ..functions.schemas import labels
from .frames import numeric_columns, select_existing, to_long
from .ranks import rank_long
from .totals import in_teams


def minmax_scale(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None, within: Sequence[str] = ()
) -> DataFrame:
    """Every metric scaled to [0, 1] over all rows: (within..., ids..., Stat, Value).

    A constant metric scales to 0, NULL stays NULL and infinities count as NULL.
    The limits are one aggregate row per group, met by an equi join.
    """
    columns = list(columns or numeric_columns(df, exclude=("No", *ids, *within)))
    long = to_long(df, [*within, *ids], columns).withColumn("Value", finite(F.col("Value")))
    keys = [*within, "Stat"]
    limits = long.groupBy(*keys).agg(F.min("Value").alias("least"), F.max("Value").alias("most"))
    span = F.col("most") - F.col("least")
    scaled = F.when(span == 0, F.when(F.col("Value").isNotNull(), 0.0)).otherwise(
        F.try_divide(F.col("Value") - F.col("least"), span)
    )
    return long.join(statistics_side(limits, within), keys).select(*within, *ids, "Stat", scaled.alias("Value"))


def compare_teams(
    values: DataFrame,
    kind: str,
    teams: Sequence[str] | None = None,
    metrics: Sequence[str] | None = None,
    within: Sequence[str] = (),
    most: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Two teams or all of them: the raw table by name and the scaled long table.

    Scaling uses the whole league whichever teams are shown.  ``most`` refuses
    longer lists of metrics, for a selection that must stay readable.
    """
    metrics = list(COMPARE_DEFAULT[kind] if metrics is None else metrics)
    if most is not None and len(metrics) > most:
        raise ValueError(f"at most {most} metrics can be compared")
    raw = select_existing(values, [*within, "Team", *metrics])
    present = [m for m in metrics if m in values.columns]
    scaled = minmax_scale(values, ["Team"], present, within)
    if teams is not None:
        raw, scaled = in_teams(raw, teams), in_teams(scaled, teams)
    return raw.orderBy(*within, "Team"), scaled


def team_sheet(
    values: DataFrame, kind: str, team: str | None = None, within: Sequence[str] = (), low_is_good: Sequence[str] | None = None
) -> DataFrame:
    """Metric by metric, value and league rank: (within..., Team, Stat, Value, Rank).

    All teams at once; the filter on one team comes after ranking.
    """
    metrics = [c for c in ORDER[kind][1:] if c in values.columns]
    low = LOW_IS_GOOD[kind] if low_is_good is None else low_is_good
    sheet = rank_long(values, metrics, low, ("Team",), within)
    return sheet if team is None else sheet.where(F.col("Team") == team)


def value_and_rank_rows(sheet: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """A value row and a rank row per team in one long table: (..., row, Stat, Value)."""
    ids = [*within, "Team", "Stat"]
    values = sheet.select(*ids, F.lit("기록").alias("row"), "Value")
    ranks = sheet.select(*ids, F.lit("순위").alias("row"), F.col("Rank").cast("double").alias("Value"))
    return values.unionByName(ranks)


def team_digest(sheet: DataFrame, kind: str, within: Sequence[str] = ()) -> DataFrame:
    """One line per team, "metric: value [rank위], ...", in output order.

    A group holds one entry per metric, never more.
    """
    order = F.array(*[F.lit(c) for c in ORDER[kind][1:]])
    entry = F.concat(
        lookup(F.col("Stat"), labels(kind), keep_unknown=True),
        F.lit(": "),
        F.coalesce(plain_number(F.col("Value")), F.lit("-")),
        F.lit(" ["),
        F.coalesce(F.col("Rank").cast("string"), F.lit("-")),
        F.lit("위]"),
    )
    placed = sheet.select(*within, "Team", F.struct(F.array_position(order, F.col("Stat")).alias("at"), entry.alias("text")).alias("item"))
    items = F.array_sort(F.collect_list("item"))
    return placed.groupBy(*within, "Team").agg(
        F.array_join(F.transform(items, lambda x: x["text"]), ", ").alias("digest")
    )


def profile_digest(profile: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """League mean and median as two lines, "metric: value, ..."."""
    order = F.array(*[F.lit(c) for c in ORDER[kind][1:]])
    label = lookup(F.col("Stat"), labels(kind), keep_unknown=True)

    def line(column: str) -> Column:
        text = F.concat(label, F.lit(": "), F.coalesce(plain_number(F.col(column)), F.lit("-")))
        item = F.struct(F.array_position(order, F.col("Stat")).alias("at"), text.alias("text"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), ", ")

    return profile.groupBy(*by).agg(line("mean").alias("means"), line("median").alias("medians"))


# pandas-style quoting: doubled quotes, nothing trimmed, empty text left bare.
_CSV = {
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _csv_line(df: DataFrame, columns: Sequence[str]) -> Column:
    """The columns of a row as one CSV line; fractions without an exponent."""
    cells = []
    for c in columns:
        cell = F.col(f"`{c}`")
        cells.append((plain_number(cell) if isinstance(df.schema[c].dataType, T.FractionalType) else cell).alias(c))
    return F.to_csv(F.struct(*cells), _CSV)


def team_context(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    columns: Sequence[str],
    n: int = 30,
) -> DataFrame:
    """CSV text of the first ``n`` rows of each group: (by..., context).

    The row limit is the feature: it bounds the text, and it is applied before
    the shuffle.  With an empty ``by`` the whole table gives one text.
    """
    header = ",".join(columns)
    line = _csv_line(df, columns)
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        top = df.withColumn("place", place).where(F.col("place") <= n)
    else:
        top = df.orderBy(*order).limit(n)
        top = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    lines = top.select(*by, F.struct("place", line.alias("text")).alias("item"))
    ordered = F.transform(F.array_sort(F.collect_list("item")), lambda x: x["text"])
    text = F.concat(F.lit(header + "\n"), F.array_join(ordered, "\n"), F.lit("\n"))
    return lines.groupBy(*by).agg(text.alias("context"))


def profile_context(
    profile: DataFrame, kind: str, columns: Sequence[str], by: Sequence[str] = (), statistic: str = "median"
) -> DataFrame:
    """League means or medians as CSV: a line of labels and a line of values.

    A group holds one value per metric.
    """
    names = labels(kind)
    titles = {c: names.get(c, c) for c in columns}
    wide = profile.groupBy(*by).agg(
        *[F.max(F.when(F.col("Stat") == c, F.col(statistic))).alias(title) for c, title in titles.items()]
    )
    line = _csv_line(wide, list(titles.values()))
    return wide.select(*by, F.concat(F.lit(",".join(titles.values()) + "\n"), line, F.lit("\n")).alias("context"))
