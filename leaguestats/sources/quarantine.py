"""What could not be read, kept with the content it was read from.

The unit is a team's season, as everywhere in a refresh.  Its mark is a hash of all
its pages: an unchanged season that failed before is not parsed again, one with a
mended page is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..checkpoints import durable

UNIT = ["Team", "Year"]
_STATE = "Team string, Year int, mark string, error string, n bigint"


def content_marks(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(Team, Year, mark): one hash of all pages of a unit, whatever their order."""
    digest = F.xxhash64(F.coalesce(F.col(html_col), F.lit(""))).cast("decimal(20,0)")
    mark = F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(digest).cast("string"))
    return pages.groupBy(*UNIT).agg(mark.alias("mark"))


class Quarantine:
    """The errors of one record kind under a root folder.

    Each load writes the whole state anew, a row per unit and error text, into a
    numbered folder; the newest finished one counts.
    """

    def __init__(self, spark: SparkSession, root: str, kind: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{kind}-quarantine"

    def _finished(self) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return sorted(int(n) for n in names if files.exists(hadoop(f"{self.path}/{n}/_SUCCESS")))

    def errors(self) -> DataFrame:
        """(Team, Year, mark, error, n): what is in quarantine now."""
        finished = self._finished()
        if not finished:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/{finished[-1]}")

    def pending(self, pages: DataFrame) -> DataFrame:
        """The pages to read: all but those of units that failed before and have not changed."""
        held = self.errors().select(*UNIT, "mark").distinct()
        unchanged = content_marks(pages).join(held, [*UNIT, "mark"], "left_semi").select(*UNIT)
        return pages.join(unchanged, UNIT, "left_anti")

    def record(self, read: DataFrame, errors: DataFrame) -> None:
        """Take in a load: units of the ``read`` pages leave the quarantine, those with ``errors`` enter it."""
        marks = durable(content_marks(read))
        failed = errors.groupBy(*UNIT, "error").agg(F.count(F.lit(1)).alias("n")).join(marks, UNIT)
        kept = self.errors().join(marks.select(*UNIT), UNIT, "left_anti")
        state = kept.unionByName(failed.select(kept.columns))
        number = max(self._finished(), default=0) + 1
        state.write.mode("overwrite").parquet(f"{self.path}/{number}")
