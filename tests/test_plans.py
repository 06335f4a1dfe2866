"""Physical plans: what is read, what is shuffled, and what stays bounded."""

import re

import pytest
from pyspark.sql import functions as F

from leaguestats import checkpoints, standins
from leaguestats.functions.schemas import HITTER, PITCHER
from leaguestats.operators import compare, distribution, profile, ranks, totals
from leaguestats.operators.distribution import counted_values, positions

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def players(spark):
    """One team holds a third of the players and one value a third of each metric."""
    return spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("Team"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("Name"),
        F.col("id").cast("string").alias("No"),
        F.when(F.col("id") % 3 == 1, 0).otherwise(F.col("id") % 7919).alias("PA"),
        (F.when(F.col("id") % 3 == 2, 0.0).otherwise((F.col("id") * 7 % 1009) / 1009.0)).alias("AVG"),
    )


def test_team_totals_read_only_what_they_sum(spark):
    text = plan(totals.team_totals(standins.batting(spark, SF_DIR), HITTER).select("Team", "AVG"))
    read = re.search(r"lineitem.parquet.*?ReadSchema: struct<([^>]*)>", text, re.DOTALL).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"l_suppkey", "l_shipdate", "l_linenumber", "l_returnflag"}


def test_totals_aggregate_before_they_shuffle(spark, players):
    text = plan(totals.team_totals(players, HITTER))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_top_n_is_limited_before_the_shuffle(players):
    for df in (ranks.leaderboard(players, HITTER, n=3), compare.team_context(players, ["Team"], ranks.leader_order(HITTER), ["Name"], 3)):
        text = plan(df)
        assert re.search(r"WindowGroupLimit[^\n]*Partial", text)
        assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_no_window_or_sort_holds_a_whole_metric(spark, players):
    sheet = ranks.rank_long(players, ["PA", "AVG"], [], ("Team", "Name", "No"))
    text = plan(sheet)
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    # Value windows run inside a range; the only wider ones run over the list of ranges.
    for window in re.findall(r"Window \[sum\((?:n|held)#[^\n]*", text):
        assert "range#" in window or "held#" in window


def test_distinct_values_are_counted_before_the_shuffle(players):
    counted = counted_values(ranks.to_long(players, ["Team"], ["PA", "AVG"]), ["Stat"])
    assert counted.where("Value = 0").agg(F.sum("n")).first()[0] >= 20_000
    assert counted.count() == counted.select("Stat", "Value").distinct().count()
    placed = positions(counted, ["Stat"])
    assert placed.agg(F.max(F.col("below") + F.col("n"))).first()[0] == 30_000


def test_ranks_of_hot_data_are_exact(players):
    made = ranks.rank_metrics(players, HITTER, ids=("Team", "Name", "No"))
    frame = players.toPandas()
    expected = frame[["PA", "AVG"]].rank(method="min", ascending=False).astype(int)
    got = made.toPandas().set_index("No").loc[frame.No]
    assert (got.PA.to_numpy() == expected.PA.to_numpy()).all() and (got.AVG.to_numpy() == expected.AVG.to_numpy()).all()


def test_statistics_are_broadcast_only_when_bounded(spark, players, monkeypatch):
    assert "BroadcastHashJoin" in plan(compare.minmax_scale(players, ["Name"], ["PA"]))
    monkeypatch.setattr(checkpoints, "is_small", lambda frame: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grouped = compare.minmax_scale(players, ["Name"], ["PA"], within=["Team"])
        assert "SortMergeJoin" in plan(grouped) and "Broadcast" not in plan(grouped)
        assert grouped.count() == 30_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_box_by_team_with_a_hot_team(players):
    made = profile.boxplots(players, ["PA"], by=["Team"]).where("Team = 'hot'").first()
    values = players.where("Team = 'hot'").toPandas().PA
    assert (made.q1, made.median, made.q3) == tuple(values.quantile([0.25, 0.5, 0.75]))


def test_python_runs_only_for_pages(spark):
    text = plan(profile.describe_stats(standins.pitching(spark, SF_DIR), ["IP"]))
    text += plan(totals.career_totals(standins.pitching(spark, SF_DIR), PITCHER))
    assert "Python" not in text and "InArrow" not in text


def test_checkpoint_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = checkpoints.shared_folder(spark)
    assert folder == checkpoints.shared_folder(spark) and (named is None or folder == named)
    made = checkpoints.durable(spark.range(5).withColumn("part", F.spark_partition_id()))
    assert made.count() == 5 and all(folder.removeprefix("file:").strip("/") in f for f in made.inputFiles())


@pytest.fixture
def large_statistics(spark, many_ranges, monkeypatch):
    """Nothing counts as small, so statistics meet values by shuffle."""
    monkeypatch.setattr(checkpoints, "is_small", lambda frame: False)
    monkeypatch.setattr("leaguestats.operators.distribution.SMALL_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def hot_team(spark):
    """One of 40 teams holds nine tenths of the values, nearly all of them different."""
    team = F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 390).cast("string")))
    value = F.when(F.col("id") % 97 == 0, F.col("id") * 1000.0).otherwise((F.col("id") * 7919 % 100_003) / 7.0)
    return spark.range(40_000).select(team.alias("Team"), F.col("id").cast("string").alias("No"), value.alias("PA"))


def test_statistics_of_a_hot_group_meet_its_values_by_range(hot_team, large_statistics):
    counted, keys = profile._counted(hot_team, ["PA"], ["Team"])
    boxes = profile._boxes(counted, keys)
    joined, spread = distribution.with_statistics(counted, boxes, keys)
    assert spread
    for df in (profile.describe_stats(hot_team, ["PA"], by=["Team"]), boxes):
        text = plan(df)
        assert "Broadcast" not in text and "SinglePartition" not in text
        assert re.search(r"SortMergeJoin \[Team#\d+, Stat#\d+, range#\d+\]", text)
        # Values are added up where the join left them, and then a group's few rows together.
        partial = re.findall(r"(?:Hash|Sort|ObjectHash)Aggregate\(keys=\[([^\]]*)\]", text)
        assert any("range#" in keys for keys in partial[:4]) and "range#" not in partial[0]
    # No task of the join holds more than its share of the hot team.
    tasks = [r.n for r in joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) >= 5 and max(tasks) < 0.5 * sum(tasks)


def test_profiles_of_a_hot_group_are_exact(hot_team, large_statistics):
    frame = hot_team.toPandas().groupby("Team").PA
    described = profile.describe_stats(hot_team, ["PA"], by=["Team"]).toPandas().set_index("Team").sort_index()
    expected = frame.describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert described[ours].tolist() == pytest.approx(expected[theirs].tolist(), rel=1e-9)
    found = profile.outliers(hot_team, ["PA"], ids=["No"], by=["Team"]).toPandas()
    low, high = frame.quantile(0.25), frame.quantile(0.75)
    rows = hot_team.toPandas()
    reach = 1.5 * (high - low)
    beyond = rows[(rows.PA < rows.Team.map(low - reach)) | (rows.PA > rows.Team.map(high + reach))]
    assert sorted(found.No) == sorted(beyond.No) and len(found) > 200
    boxes = profile.boxplots(hot_team, ["PA"], by=["Team"]).toPandas().set_index("Team")
    assert boxes.outliers.to_dict() == beyond.groupby("Team").size().reindex(boxes.index, fill_value=0).to_dict()
    bins = profile.histograms(hot_team, ["PA"], bins=7, by=["Team"]).groupBy("Team").agg(F.sum("n").alias("n")).toPandas()
    assert dict(zip(bins.Team, bins.n)) == frame.size().to_dict()


def test_rows_meet_a_hot_outlying_value(spark, large_statistics):
    # A fifth of the rows share one outlying value.
    rows = spark.range(20_000).select(F.lit("a").alias("Team"), F.col("id").alias("No"), F.when(F.col("id") % 5 == 0, 1e6).otherwise(F.col("id") % 1000).alias("PA"))
    found = profile.outliers(rows, ["PA"], ids=["No"], by=["Team"])
    assert found.count() == 4_000 and found.where("Value = 1e6 and No % 5 = 0").count() == 4_000
