"""Season snapshots: Parquet partitioned by ``Year``, one dataset per kind."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.schemas import season_schema


def dataset(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}"


def read_seasons(spark: SparkSession, root: str, kind: str, years: Sequence[int] | None = None) -> DataFrame:
    """All seasons, or the given ones, in one read; other partitions are pruned."""
    seasons = spark.read.schema(season_schema(kind)).parquet(dataset(root, kind))
    return seasons if years is None else seasons.where(F.col("Year").isin(list(years)))


def read_season(spark: SparkSession, root: str, kind: str, year: int) -> DataFrame:
    """One season; only its partition is listed and read."""
    return read_seasons(spark, root, kind).where(F.col("Year") == year)


def write_season(df: DataFrame, root: str, kind: str, year: int | None = None) -> None:
    """Replace the seasons present in ``df``; other seasons stay untouched.

    With ``year`` the frame is one season and gets that tag.  Writing the same
    season twice gives the same snapshot.  The rebalance hint evens out file
    sizes, also when one season holds most of the rows.
    """
    schema = season_schema(kind)
    if year is not None:
        df = df.withColumn("Year", F.lit(int(year)))
    columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]
    (
        df.select(*columns)
        .hint("rebalance", "Year")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("Year")
        .parquet(dataset(root, kind))
    )


def has_season(spark: SparkSession, root: str, kind: str, year: int) -> bool:
    """Whether the partition of a season exists; looks at paths only."""
    try:
        spark.read.schema(season_schema(kind, with_year=False)).parquet(f"{dataset(root, kind)}/Year={int(year)}")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def seasons_stored(spark: SparkSession, root: str, kind: str, years: Sequence[int]) -> list[int]:
    """Those of the given seasons that have a snapshot."""
    return [year for year in years if has_season(spark, root, kind, year)]


def stored_seasons(spark: SparkSession, root: str, kind: str, years: Sequence[int]) -> DataFrame | None:
    """The given seasons as far as they are stored; None if none is."""
    stored = seasons_stored(spark, root, kind, years)
    return read_seasons(spark, root, kind, stored) if stored else None


def seasons_or_build(
    spark: SparkSession, root: str, kind: str, years: Sequence[int], build: Callable[[list[int]], DataFrame]
) -> DataFrame:
    """Snapshots of several seasons; the missing ones are built together first.

    ``build`` gets the missing seasons and returns records with ``Year``.  Only
    a missing partition triggers it; any other problem is raised.
    """
    stored = seasons_stored(spark, root, kind, years)
    missing = [year for year in years if year not in stored]
    if missing:
        write_season(build(missing), root, kind)
    return read_seasons(spark, root, kind, years)


def season_or_build(
    spark: SparkSession, root: str, kind: str, year: int, build: Callable[[], DataFrame]
) -> DataFrame:
    """The snapshot of a season, built and written first if it is missing."""
    return seasons_or_build(spark, root, kind, [year], lambda _: build().withColumn("Year", F.lit(int(year))))
