"""Versioned season snapshots: a manifest names what each season consists of.

A commit writes its files into a folder of its own and then one manifest, the last
thing it does.  Readers take the newest manifest and see one version from end to
end, also while a refresh runs or after one has died half-way.  Beside the records
of a season lie its partial totals and value sketches, so careers and approximate
profiles over many seasons merge a few rows per season and read no records.

Records are bucketed and sorted by player: a total per player needs no shuffle, and
the statistics of row groups let a team filter skip most of a file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..checkpoints import durable
from ..functions.registry import CAREER_SUMS, ORDER
from ..functions.schemas import PLAYER_KEY, season_schema
from ..operators.sketches import RANK_ERROR_K, merge_sketches, sketch_values
from ..operators.totals import finish_career, sum_by

RECORDS, TOTALS, SKETCHES = "records", "totals", "sketches"


@dataclass(frozen=True)
class Manifest:
    """One version: for each season the commit whose files hold it."""

    version: int
    buckets: int
    seasons: dict[int, str]

    def text(self) -> str:
        return json.dumps({"version": self.version, "buckets": self.buckets, "seasons": {str(y): c for y, c in sorted(self.seasons.items())}})

    @staticmethod
    def read(text: str) -> Manifest:
        made = json.loads(text)
        return Manifest(made["version"], made["buckets"], {int(y): c for y, c in made["seasons"].items()})


class SnapshotStore:
    """The snapshots of one record kind under a folder all executors reach."""

    def __init__(self, spark: SparkSession, root: str, kind: str, buckets: int = 8, sketch_k: int = RANK_ERROR_K):
        self.spark, self.kind, self.buckets, self.sketch_k = spark, kind, buckets, sketch_k
        self.path = f"{root.rstrip('/')}/{kind}-snapshots"

    # --- manifests ---------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """All versions there are, oldest first."""
        files, folder = self._fs(f"{self.path}/manifests")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or a given one; without any, an empty version 0."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, self.buckets, {})
        files, path = self._fs(f"{self.path}/manifests/{version:08d}.json")
        stream = files.open(path)
        try:
            return Manifest.read(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: Manifest) -> bool:
        """Write the manifest under a name of its own and rename it; False if that version exists by now."""
        files, target = self._fs(f"{self.path}/manifests/{manifest.version:08d}.json")
        _, own = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}.json")
        out = files.create(own, False)
        out.write(manifest.text().encode())
        out.close()
        try:
            done = not files.exists(target) and files.rename(own, target)
        except Py4JJavaError:  # another writer's manifest is there already
            done = False
        if not done:
            files.delete(own, False)
        return done

    # --- writing -----------------------------------------------------------

    def _write(self, frame: DataFrame, commit: str, part: str) -> None:
        frame.hint("rebalance", "Year").write.partitionBy("Year").parquet(f"{self.path}/data/{commit}/{part}")

    def _write_records(self, records: DataFrame, commit: str) -> None:
        """One file per season and bucket, sorted by player."""
        name = f"leaguestats_write_{commit}"
        dealt = records.repartition(self.buckets, *PLAYER_KEY)
        try:
            (
                dealt.write.partitionBy("Year")
                .bucketBy(self.buckets, *PLAYER_KEY)
                .sortBy(*PLAYER_KEY)
                .option("path", f"{self.path}/data/{commit}/{RECORDS}")
                .option("parquet.block.row.count.limit", 20_000)
                .saveAsTable(name)
            )
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def commit(self, records: DataFrame, replace: Sequence[int] | None = None, attempts: int = 5) -> Manifest:
        """Replace the seasons of ``records`` (with ``replace``, those: one without rows becomes empty).

        Other seasons keep their files.  If another commit publishes first, this one
        goes on from that version; of two commits of one season the later holds.
        Returns the version published.
        """
        schema = season_schema(self.kind)
        made = durable(records.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]))
        years = sorted(r.Year for r in made.select("Year").distinct().collect())
        if replace is not None and set(years) - set(replace):
            raise ValueError(f"records of seasons that are not to be replaced: {sorted(set(years) - set(replace))}")
        commit = uuid.uuid4().hex
        if years:
            self._write_records(made, commit)
            self._write(sum_by(made, ["Year", *PLAYER_KEY], CAREER_SUMS[self.kind]), commit, TOTALS)
            self._write(sketch_values(made, self._sketched(), ["Year", "Team"], self.sketch_k), commit, SKETCHES)
        for _ in range(attempts):
            current = self.manifest()
            if current.version and current.buckets != self.buckets:
                raise ValueError(f"the snapshots have {current.buckets} buckets")
            kept = {y: c for y, c in current.seasons.items() if y not in (replace or ())}
            manifest = Manifest(current.version + 1, self.buckets, kept | dict.fromkeys(years, commit))
            if self._publish(manifest):
                return manifest
        raise RuntimeError("other commits kept publishing first")

    def _sketched(self) -> list[str]:
        stored = {f.name for f in season_schema(self.kind)}
        return [c for c in ORDER[self.kind][1:] if c in stored]

    def expire(self, keep: int = 2) -> list[int]:
        """Remove all but the newest versions and the files only they use; returns the versions removed.

        For when no reader holds an old version and no commit is under way.
        """
        old = self.versions()[:-keep] if keep else self.versions()
        used = {c for v in self.versions() if v not in old for c in self.manifest(v).seasons.values()}
        files, folder = self._fs(f"{self.path}/data")
        for version in old:
            manifest = self._fs(f"{self.path}/manifests/{version:08d}.json")[1]
            files.delete(manifest, False)
        if files.exists(folder):
            for status in files.listStatus(folder):
                if status.getPath().getName() not in used:
                    files.delete(status.getPath(), True)
        return old

    # --- reading -----------------------------------------------------------

    def _chosen(self, years: Sequence[int] | None, version: int | None) -> tuple[Manifest, dict[int, str]]:
        manifest = self.manifest(version)
        return manifest, {y: c for y, c in manifest.seasons.items() if years is None or y in years}

    def _read(self, part: str, empty: Callable[[], DataFrame], years: Sequence[int] | None, version: int | None) -> DataFrame:
        """The files of a part of the chosen seasons; other seasons are not even listed."""
        chosen = self._chosen(years, version)[1]
        if not chosen:
            return empty()
        schema = empty().schema
        frames = []
        for commit in sorted(set(chosen.values())):
            base = f"{self.path}/data/{commit}/{part}"
            paths = [f"{base}/Year={y}" for y, c in sorted(chosen.items()) if c == commit]
            frames.append(self.spark.read.schema(schema).option("basePath", base).parquet(*paths))
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame)
        return whole

    def _no_records(self) -> DataFrame:
        return self.spark.createDataFrame([], season_schema(self.kind))

    def records(self, years: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """Records of one version, bucketed by player.

        They are read as a table of this session that lists the seasons' folders, so
        that Spark knows of the buckets.
        """
        manifest, chosen = self._chosen(years, version)
        if not chosen:
            return self._no_records()
        name = f"leaguestats_{self.kind}_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}_v{manifest.version}"
        if not self.spark.catalog.tableExists(name):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in season_schema(self.kind))
            keys = ", ".join(PLAYER_KEY)
            self.spark.sql(
                f"CREATE TABLE {name} ({fields}) USING parquet PARTITIONED BY (Year) CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                f"INTO {manifest.buckets} BUCKETS LOCATION '{self.path}/none'"
            )
            added = " ".join(f"PARTITION (Year={y}) LOCATION '{self.path}/data/{c}/{RECORDS}/Year={y}'" for y, c in manifest.seasons.items())
            self.spark.sql(f"ALTER TABLE {name} ADD {added}")
        table = self.spark.table(name)
        return table if years is None else table.where(F.col("Year").isin(sorted(chosen)))

    def partial_totals(self, years: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """One row per season and player: sums only, no rates."""
        return self._read(TOTALS, lambda: sum_by(self._no_records(), ["Year", *PLAYER_KEY], CAREER_SUMS[self.kind]), years, version)

    def careers(self, years: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """Career totals and rates merged from the seasons' partial totals."""
        partial = self.partial_totals(years, version)
        return finish_career(sum_by(partial, PLAYER_KEY, CAREER_SUMS[self.kind]), self.kind)

    def sketches(self, by: Sequence[str] = (), years: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """Value sketches merged to groups ``by`` (of Year, Team): see ``operators.sketches``."""
        stored = self._read(SKETCHES, lambda: sketch_values(self._no_records(), self._sketched(), ["Year", "Team"], self.sketch_k), years, version)
        return merge_sketches(stored, by)
