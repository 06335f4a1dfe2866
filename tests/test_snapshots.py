"""Versioned snapshots, partial totals and sketches against the plain computation."""

import re

import pytest
from pyspark.sql import functions as F

from leaguestats import standins
from leaguestats.functions.registry import CAREER, ranked_metrics
from leaguestats.functions.schemas import HITTER, PITCHER, season_schema
from leaguestats.operators import profile, sketches, totals
from leaguestats.sources.snapshots import Manifest, SnapshotStore

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pitchers(spark):
    return totals.add_metrics(standins.pitching(spark, SF_DIR).drop("notation", "outs"), PITCHER, CAREER).withColumn("WPCT", F.lit(None).cast("double")).cache()


@pytest.fixture
def store(spark, tmp_path, pitchers):
    made = SnapshotStore(spark, str(tmp_path), PITCHER, buckets=4)
    made.commit(pitchers)
    return made


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left, right = [sorted(map(repr, df.select(columns).collect())) for df in (a, b)]
    assert left == right and left


def test_records_come_back(store, pitchers):
    same(store.records(), pitchers.select(season_schema(PITCHER).names))
    same(store.records([1996]), pitchers.where("Year = 1996").select(season_schema(PITCHER).names))
    assert store.records([1900]).count() == 0 and store.versions() == [1]


def test_one_season_is_replaced_and_readers_keep_their_version(store, pitchers):
    before = store.records()
    changed = pitchers.where("Year = 1996").withColumn("W", F.col("W") + 5)
    made = store.commit(changed)
    assert made.version == 2 and len(set(made.seasons.values())) == 2
    # A frame made before, and the old version by number, show the old season.
    same(before, pitchers.select(season_schema(PITCHER).names))
    same(store.records(version=1), before)
    now = pitchers.withColumn("W", F.when(F.col("Year") == 1996, F.col("W") + 5).otherwise(F.col("W")))
    same(store.records(), now.select(season_schema(PITCHER).names))


def test_careers_merge_partial_totals(store, pitchers):
    same(store.careers(), totals.career_totals(pitchers, PITCHER))
    first = {y: c for y, c in store.manifest().seasons.items()}
    changed = pitchers.where("Year = 1997").withColumn("ER", F.col("ER") + 1)
    store.commit(changed)
    after = store.manifest().seasons
    # Only the replaced season's partial totals are new ...
    assert [y for y in after if after[y] != first[y]] == [1997]
    # ... and the merged careers equal the whole computation.
    now = pitchers.where("Year <> 1997").unionByName(changed)
    same(store.careers(), totals.career_totals(now, PITCHER))
    same(store.careers([1996, 1997]), totals.career_totals(now.where("Year in (1996, 1997)"), PITCHER))
    assert "records" not in " ".join(store.careers().inputFiles())


def test_seasons_can_become_empty_and_strays_are_refused(store, pitchers):
    store.commit(pitchers.limit(0), replace=[1996])
    assert 1996 not in store.manifest().seasons and store.records([1996]).count() == 0
    with pytest.raises(ValueError):
        store.commit(pitchers, replace=[1996])


def test_two_commits_at_once_both_hold(spark, tmp_path, pitchers):
    one, two = [SnapshotStore(spark, str(tmp_path), PITCHER, buckets=4) for _ in range(2)]
    publish, stale = one._publish, []

    def late(manifest):
        if not stale:  # another commit gets in between reading the version and publishing
            stale.append(two.commit(pitchers.where("Year = 1997")).version)
        return publish(manifest)

    one._publish = late
    assert one.commit(pitchers.where("Year = 1996")).version == 2
    assert sorted(one.manifest().seasons) == [1996, 1997] and one.versions() == [1, 2]


def test_a_dead_commit_leaves_nothing_to_see(store, pitchers, monkeypatch):
    before = store.records().count()
    monkeypatch.setattr(store, "_publish", lambda manifest: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.commit(pitchers.where("Year = 1996").limit(1))
    assert store.versions() == [1] and store.records().count() == before


def test_expire_removes_what_no_version_uses(store, pitchers):
    for wins in (1, 2, 3):
        store.commit(pitchers.where("Year = 1996").withColumn("W", F.lit(wins).cast("long")))
    assert store.expire(keep=1) == [1, 2, 3] and store.versions() == [4]
    assert store.records([1996]).agg(F.min("W"), F.max("W")).first()[:] == (3, 3)
    assert store.careers().count() == pitchers.select("Team", "Name", "No").distinct().count()


def test_careers_of_bucketed_records_need_no_shuffle(store):
    text = plan(totals.career_totals(store.records(), PITCHER))
    assert "Exchange" not in text and "Bucketed: true" in text
    one = plan(store.records([1996]).where("Team = 'NATION_1'").select("Name"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(Team,NATION_1\)", one)
    assert re.search(r"PartitionFilters: \[[^\]]*Year", one) or "Year#" in one


def test_row_groups_are_sorted_by_team(store, spark):
    import pyarrow.parquet as pq

    for file in store.records([1996]).inputFiles():
        teams = pq.read_table(file.removeprefix("file:").replace("//", "/"))["Team"].to_pylist()
        assert teams == sorted(teams)


def test_manifest_reads_back():
    made = Manifest(3, 8, {2024: "a", 2023: "b"})
    assert Manifest.read(made.text()) == made


# --- sketches ---------------------------------------------------------------


def test_sketches_merge_within_the_stated_error(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 5 + 2000).cast("int").alias("Year"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 7).cast("string"))).alias("Team"),
        F.pow(F.col("id") * 7919 % 60_013, F.lit(2.0)).alias("PA"),
    )
    k = 200
    stored = sketches.sketch_values(rows, ["PA"], ["Year", "Team"], k)
    for by in ([], ["Team"], ["Year"]):
        merged = sketches.merge_sketches(stored, by)
        found = sketches.sketched_description(merged).toPandas()
        frame = rows.toPandas()
        for _, row in found.iterrows():
            values = frame
            for key in by:
                values = values[values[key] == row[key]]
            values = values.PA
            exact = values.describe()
            assert (row["count"], row["min"], row["max"]) == (exact["count"], exact["min"], exact["max"])
            assert row["mean"] == pytest.approx(exact["mean"]) and row["std"] == pytest.approx(exact["std"])
            for q in (25, 50, 75):
                assert abs((values <= row[f"q{q}"]).mean() - q / 100) <= 1.5 * sketches.rank_error(k) + 1 / len(values)


def test_small_groups_are_exact_up_to_the_choice_of_neighbour(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(101)] + [("b", None), ("c", 5.0), ("d", float("nan"))], "Team string, PA double")
    exact = profile.describe_stats(rows, ["PA"], by=["Team"]).toPandas().set_index("Team")
    found = profile.describe_stats(rows, ["PA"], by=["Team"], approx=True).toPandas().set_index("Team")
    assert sorted(found.index) == sorted(exact.index) == ["a", "c"]
    for column in ("count", "mean", "min", "max"):
        assert found[column].tolist() == exact[column].tolist()
    for column in ("q25", "q50", "q75"):
        assert (found[column] - exact[column]).abs().max() <= 1


def test_approximate_boxes_are_whole(spark, many_ranges):
    rows = spark.range(30_000).select(F.lit("a").alias("Team"), F.when(F.col("id") % 100 == 0, F.col("id") * 10.0).otherwise(F.col("id") % 1000 + 0.0).alias("PA"))
    box = profile.boxplots(rows, ["PA"], by=["Team"], approx=True).first()
    values = rows.toPandas().PA
    reach = 1.5 * (box.q3 - box.q1)
    inside = values.between(box.q1 - reach, box.q3 + reach)
    assert box.outliers == (~inside).sum() and (box.whisker_lo, box.whisker_hi) == (values[inside].min(), values[inside].max())
    for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
        assert abs((values <= box[name]).mean() - q) <= 0.01
    text = plan(profile.league_profile(rows, ["PA"], by=["Team"], approx=True))
    assert text.count("Exchange") == 1 and "partial_kll" in text.replace("partial_kll_sketch", "partial_kll")


def test_season_sketches_of_the_store_merge(store, pitchers):
    exact = profile.describe_stats(pitchers, ["W", "ERA"]).toPandas().set_index("Stat")
    found = sketches.sketched_description(store.sketches()).toPandas().set_index("Stat")
    stored = [c for c in ranked_metrics(PITCHER) if c in season_schema(PITCHER).names]
    assert sorted(found.index) == sorted(stored)
    for stat in exact.index:
        assert found.loc[stat, ["count", "min", "max"]].tolist() == exact.loc[stat, ["count", "min", "max"]].tolist()
        assert found.loc[stat, "std"] == pytest.approx(exact.loc[stat, "std"])
