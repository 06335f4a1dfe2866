"""Cutting lineage in reliable storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Taken from ``spark.checkpoint.dir``.  A temporary folder stands in only for
    a local master, where driver and executors are the same machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="leaguestats-"))
    return context.getCheckpointDir()


class Scratch:
    """A folder of intermediate tables in the shared folder, with an owner.

    ``keep`` writes a frame once and reads it back; ``drop`` removes one table,
    ``release`` all of them.  As a context manager it releases at the end, so a
    frame that is returned must be kept elsewhere::

        with Scratch(spark) as scratch:
            placed = scratch.keep(rows)
            return durable(report(placed))
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/leaguestats-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once as a table of this folder and read it from there.

        The work is done once, a lost executor costs a re-read, and
        non-deterministic columns stay fixed.  Being Parquet, each branch reads
        its own columns only, a count needs no data, and Spark knows the true
        size when it picks a join.
        """
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables this folder keeps; frames read from them end with them."""
        for table in tables:
            _delete(self.spark, self._paths.pop(id(table))[1])

    def release(self) -> None:
        """Remove the folder."""
        self._paths.clear()
        _delete(self.spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_results: dict[str, Scratch] = {}


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once as a table that lives until ``release`` or the end of the program.

    Used where a frame feeds several branches of a result that is read later.
    """
    application = df.sparkSession.sparkContext.applicationId
    if application not in _results:
        _results[application] = Scratch(df.sparkSession)
    return _results[application].keep(df)


def release(spark: SparkSession) -> None:
    """Remove every table ``durable`` wrote in this application; frames built on them end with them."""
    scratch = _results.pop(spark.sparkContext.applicationId, None)
    if scratch:
        scratch.release()


@atexit.register
def _release_all() -> None:
    """At the end of the program, remove the tables of applications that still run."""
    session = SparkSession.getActiveSession()
    if session and session.sparkContext._jsc and not session.sparkContext._jsc.sc().isStopped():
        release(session)


# Rows of a handful of columns that may be broadcast.
SMALL_ROWS = 200_000


def is_small(frame: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    """Whether a frame from ``durable`` may be broadcast; its count comes from file footers.

    A larger frame joins by shuffle.  Adaptive execution splits the hot keys of that
    join only if nothing above it needs the rows of a key together.
    """
    return frame.count() <= max_rows


def statistics_side(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """A table with one row per metric and ``by`` group, ready to be joined to rows.

    Joining rows on a metric name by shuffle would put a metric on one task, so
    the statistics are broadcast: without groups they have a row per column;
    with groups they are written out, counted and broadcast only when small.  For
    rows that go on as they are; values that are aggregated per group again use
    ``distribution.with_statistics``.
    """
    if not by:
        return F.broadcast(stats)
    stats = durable(stats)
    return F.broadcast(stats) if is_small(stats) else stats
