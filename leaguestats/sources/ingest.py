"""Raw page rows to typed records, with a reason on every row that fails.

Nothing is dropped on the way: a row that cannot be typed keeps its ``error``
and ``split_errors`` separates it from the good ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import innings_to_decimal
from ..functions.schemas import COLUMNS, HEADER_ALIASES, PITCHER

# The name cell "name(number)", and the marks for a missing value.
# (?U) makes \w match letters beyond ASCII.
NAME_PATTERN = r"(?U)(\w+)\((\d+)\)"
SENTINELS = ("", "-")
# Header of the name cell and the columns where a dash is allowed.
NAME_HEADER = "이름"
DASHED = {"hitter": (), "pitcher": ("방어율",)}


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) by the ``error`` column.

    Both read the same frame; make it durable first when both are used.
    """
    return df.where(F.col("error").isNull()).drop("error"), df.where(F.col("error").isNotNull())


def _add_error(df: DataFrame, *problems: Column) -> DataFrame:
    """Append problem texts (NULL for none) to ``error``."""
    earlier = [F.col("error")] if "error" in df.columns else []
    return df.withColumn("error", F.nullif(F.concat_ws("; ", *earlier, *problems), F.lit("")))


def normalize_headers(df: DataFrame, kind: str) -> DataFrame:
    """Bring header variants to the declared names and remove spaces."""
    renamed = df.withColumnsRenamed(HEADER_ALIASES[kind])
    return renamed.toDF(*[c.replace(" ", "") for c in renamed.columns])


def spread_cells(df: DataFrame, kind: str, headers: Iterable[str] | None = None) -> DataFrame:
    """Cell maps to columns under normalized headers.

    The columns are the declared ones of the kind unless given, so no pass over
    the data is needed to find them.  A header that a row lacks gives NULL, one
    that two of its columns come to the first of them; ``error`` names both.
    """
    if headers is None:
        declared = [h for h, _, _ in COLUMNS[kind] if h not in ("성명", "배번", "팀")]
        headers = [NAME_HEADER, *declared]
    aliases = HEADER_ALIASES.get(kind, {})

    def name(key: Column) -> Column:
        for old, new in aliases.items():
            key = F.when(key == old, new).otherwise(key)
        return F.replace(key, F.lit(" "), F.lit(""))

    headers = list(headers)
    others = [c for c in df.columns if c not in ("cells", "table_no", "row_no", "error")]
    earlier = ["error"] if "error" in df.columns else []
    named = df.select(*others, *earlier, F.transform(F.map_keys("cells"), name).alias("_names"), F.map_values("cells").alias("_texts"))
    placed = named.select("*", F.array(*[F.array_position("_names", F.lit(h)).cast("int") for h in headers]).alias("_places"))

    # A row with every header once, as most are, needs no look at each header.
    counts = F.transform(literal_list(headers), lambda h: F.size(F.filter("_names", lambda n: n == h)))
    problems = F.zip_with(
        literal_list(headers),
        counts,
        lambda h, n: F.when(n == 0, F.concat(F.lit("no column "), h)).when(n > 1, F.concat(F.lit("column twice: "), h)),
    )
    sound = ~F.array_contains("_places", 0) & (F.size(F.array_distinct("_names")) == F.size("_names"))
    spread = placed.select(
        *others,
        *earlier,
        F.when(F.col("_names").isNotNull() & ~sound, F.nullif(F.array_join(problems, "; "), F.lit(""))).alias("_problems"),
        *[F.get("_texts", F.col("_places")[at] - 1).alias(h) for at, h in enumerate(headers)],
    )
    return _add_error(spread, F.col("_problems")).drop("_problems")


def literal_list(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def split_name_no(df: DataFrame, column: str = NAME_HEADER) -> DataFrame:
    """Split "name(number)" into Name and No; leading zeros of the number go.

    A row without the pattern gets an error.
    """

    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(F.col(column), NAME_PATTERN, i), F.lit(""))

    split = df.select("*", group(1).alias("Name"), group(2).try_cast("int").cast("string").alias("No"))
    unread = F.concat(F.lit("name cell: "), F.coalesce(F.col(column), F.lit("none")))
    return _add_error(split, F.when(F.col("No").isNull(), unread)).drop(column)


def null_sentinels(df: DataFrame, columns: Sequence[str], values: Sequence[str] = SENTINELS) -> DataFrame:
    """Marks for "no value" to NULL in the given string columns."""
    return df.withColumns(
        {c: F.when(F.trim(F.col(f"`{c}`")).isin(list(values)), None).otherwise(F.col(f"`{c}`")) for c in columns if c in df.columns}
    )


def _typed(column: str, type_: str) -> str:
    """Text to number as a table reader would: thousands commas, whole decimals."""
    text = f"replace(`{column}`, ',', '')"
    number = f"nanvl(try_cast({text} as double), null)"
    return number if type_ == "double" else f"coalesce(try_cast({text} as bigint), try_cast({number} as bigint))"


def conform(df: DataFrame, kind: str, keep: Sequence[str] = ()) -> DataFrame:
    """Select the declared columns by page header, rename and type them.

    The input columns are text; the result is (columns of the kind, keep...,
    error).  A value that is present but does not read as its type is an error,
    as is an empty integer cell; an empty fraction is NULL.  A missing header is
    an error on each row.
    """
    present = set(df.columns)
    read, made, problems = [], [], []
    for at, (header, name, type_) in enumerate(COLUMNS[kind]):
        source = next((c for c in (header, name) if c in present), None)
        if source is None:
            made.append(F.lit(None).cast(type_).alias(name))
            problems.append(F.lit(f"no column {header}"))
            continue
        if type_ == "string":
            read.append(F.col(f"`{source}`").alias(f"_value{at}"))
            made.append(F.col(f"_value{at}").alias(name))
            continue
        # The value and its check are two steps, so a cell is read as a number once.
        read += [F.expr(f"{_typed(source, type_)} as _value{at}"), F.col(f"`{source}`").alias(f"_text{at}")]
        made.append(F.col(f"_value{at}").alias(name))
        # An empty cell or NaN is a missing fraction, not a wrong one.
        missing = f"or lower(trim(_text{at})) in ('', 'nan')" if type_ == "double" else ""
        problems.append(
            F.expr(
                f"case when _text{at} is null or _value{at} is not null {missing} then null "
                f"else concat('{header} is not {type_}: ', _text{at}) end"
            )
        )
    earlier = [F.col("error")] if "error" in present else []
    typed = df.select(*read, *keep, *earlier)
    return typed.select(*made, *keep, F.nullif(F.concat_ws("; ", *earlier, *problems), F.lit("")).alias("error"))


def typed_records(extracted: DataFrame, kind: str, team_col: str = "Team", keep: Sequence[str] = ("Year",)) -> DataFrame:
    """Extracted table rows to typed records of one kind, errors included.

    Chains the steps above; pitchers' innings become decimal.
    """
    cells = spread_cells(extracted, kind)
    named = split_name_no(cells.withColumnRenamed(team_col, "팀"))
    named = _add_error(named, F.when(F.col("팀").isNull(), F.lit("no team")))
    records = conform(null_sentinels(named, DASHED[kind]), kind, keep)
    if kind == PITCHER:
        records = records.withColumn("IP", innings_to_decimal(F.col("IP")))
    return records
