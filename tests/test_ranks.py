import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leaguestats.functions.schemas import HITTER, PITCHER
from leaguestats.operators import distribution, ranks
from leaguestats.operators.distribution import counted_values, positions


def _random(seed, size=400):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(
        {
            "Team": [f"t{i}" for i in range(size)],
            "AVG": np.round(rng.random(size), 2),
            "SO": rng.integers(0, 12, size).astype(float),
            "PA": np.where(rng.random(size) < 0.33, 0.0, np.round(rng.normal(size=size), 3)),
        }
    )
    frame.loc[rng.random(size) < 0.1, "AVG"] = np.nan
    return frame


def _expected(frame):
    made = frame[["Team"]].copy()
    made["AVG"] = frame["AVG"].rank(method="min", ascending=False)
    made["PA"] = frame["PA"].rank(method="min", ascending=False)
    made["SO"] = frame["SO"].rank(method="min", ascending=True)
    return made


def _same(made, expected):
    got = made.toPandas().set_index("Team").sort_index()[["AVG", "PA", "SO"]].astype(float)
    pd.testing.assert_frame_equal(got, expected.set_index("Team").sort_index()[["AVG", "PA", "SO"]])


def test_ranks_equal_pandas(spark):
    frame = _random(1)
    _same(ranks.rank_metrics(spark.createDataFrame(frame), HITTER), _expected(frame))


def test_ranks_over_many_value_ranges(spark, many_ranges):
    frame = _random(2, 900)
    df = spark.createDataFrame(frame)
    long = ranks.to_long(df, ["Team"], ["AVG", "PA", "SO"])
    assert counted_values(long, ["Stat"]).select("range").distinct().count() > 4
    _same(ranks.rank_metrics(df, HITTER), _expected(frame))


@pytest.mark.parametrize("share", [1, 5, 10_000])
def test_ranks_by_shuffle_join(spark, monkeypatch, many_ranges, share):
    """Beyond the broadcast size, with no, some and all values counting as frequent."""
    monkeypatch.setattr(distribution, "SMALL_ROWS", 0)
    monkeypatch.setattr(distribution, "_SHARE", share)
    frame = _random(3)
    _same(ranks.rank_metrics(spark.createDataFrame(frame), HITTER), _expected(frame))


def test_hand_worked_ranks(spark):
    df = spark.createDataFrame([("a", 0.3, 4), ("b", 0.3, 2), ("c", 0.25, 9), ("d", None, 2)], "Team string, AVG double, SO long")
    made = {r.Team: (r.AVG, r.SO) for r in ranks.rank_metrics(df, HITTER).collect()}
    assert made == {"a": (1, 3), "b": (1, 1), "c": (3, 4), "d": (None, 1)}


def test_flipped_direction_of_the_negation(spark):
    df = spark.createDataFrame(_random(4)[["Team", "AVG"]])
    up = ranks.rank_metrics(df, HITTER)
    down = ranks.rank_metrics(df.withColumn("AVG", -F.col("AVG")), HITTER, low_is_good=["AVG"])
    assert sorted(up.collect(), key=str) == sorted(down.collect(), key=str)


def test_losses_rank_high_is_good(spark):
    df = spark.createDataFrame([("a", 5, 1.0), ("b", 2, 3.0)], "Team string, L long, ERA double")
    assert {r.Team: (r.L, r.ERA) for r in ranks.rank_metrics(df, PITCHER).collect()} == {"a": (1, 1), "b": (2, 2)}


def test_ranks_restart_within_a_season(spark):
    df = spark.createDataFrame([(1, "a", 0.3), (1, "b", 0.2), (2, "a", 0.1), (2, "b", 0.4)], "Year int, Team string, AVG double")
    made = {(r.Year, r.Team): r.AVG for r in ranks.rank_metrics(df, HITTER, within=["Year"]).collect()}
    assert made == {(1, "a"): 1, (1, "b"): 2, (2, "a"): 2, (2, "b"): 1}


def test_player_grain(spark):
    df = spark.createDataFrame([("a", "x", "1", 5), ("a", "y", "2", 7)], "Team string, Name string, No string, PA long")
    made = ranks.rank_metrics(df, HITTER, ids=["Team", "Name", "No"])
    assert sorted((r.Name, r.PA) for r in made.collect()) == [("x", 2), ("y", 1)]


@pytest.mark.parametrize("rows", [[], [("a", None)], [("a", 0.5)]])
def test_edge_frames(spark, rows):
    df = spark.createDataFrame(rows, "Team string, AVG double")
    made = [r.AVG for r in ranks.rank_metrics(df, HITTER).collect()]
    assert made == ([] if not rows else [None] if rows[0][1] is None else [1])


def test_positions_with_a_hot_value(spark, many_ranges):
    values = [7.0] * 500 + [float(i % 50) for i in range(1000)]
    df = spark.createDataFrame([("m", v) for v in values], "Stat string, Value double")
    made = {r.Value: (r.n, r.below, r.total) for r in positions(counted_values(df, ["Stat"]), ["Stat"]).collect()}
    assert made == {v: (values.count(v), sum(x < v for x in values), 1500) for v in set(values)}


def test_orders(spark):
    teams = spark.createDataFrame([("c",), ("own club",), ("a",), ("b",)], "Team string")
    assert [r.Team for r in ranks.order_pinned(teams, "Team", "own").collect()] == ["own club", "a", "b", "c"]
    assert [r.Team for r in ranks.order_teams(teams, "b", "c").collect()] == ["b", "c", "a", "own club"]
    assert [r.Team for r in ranks.order_teams(teams, "b", None).collect()] == ["b", "a", "c", "own club"]
    assert [r.Team for r in ranks.order_pinned(teams, "Team", "none").collect()] == ["a", "b", "c", "own club"]


def test_pinned_text_is_literal(spark):
    teams = spark.createDataFrame([("a(b)",), ("0",)], "Team string")
    assert [r.Team for r in ranks.order_pinned(teams, "Team", "(b)").collect()] == ["a(b)", "0"]


def test_leaderboard(spark):
    df = spark.createDataFrame(
        [("t", "a", "1", 10, 0.3), ("t", "b", "2", 10, None), ("u", "c", "3", 20, 0.1), ("t", "d", "4", None, 0.9)],
        "Team string, Name string, No string, PA long, AVG double",
    )
    assert [r.Name for r in ranks.leaderboard(df, HITTER).collect()] == ["c", "a", "b", "d"]
    assert [r.Name for r in ranks.leaderboard(df, HITTER, team="t").collect()] == ["a", "b", "d"]
    assert sorted((r.Team, r.place, r.Name) for r in ranks.leaderboard(df, HITTER, n=1).collect()) == [("t", 1, "a"), ("u", 1, "c")]


def test_rank_matrix(spark):
    ranked = spark.createDataFrame([("own", 1, 2, 3), ("abc", 2, 1, 1)], "Team string, AVG int, PA int, SO int")
    dimension = spark.createDataFrame([("own", "OWN")], "Team string, team_eng string")
    made = ranks.rank_matrix(ranked, dimension, HITTER, "own")
    assert made.columns == ["team_eng", "AVG", "SO"]
    assert [tuple(r) for r in made.collect()] == [("OWN", 1, 3), (None, 2, 1)]


@pytest.mark.parametrize("top", [1, 3, 50])
def test_top_ranks_equal_the_first_of_all_ranks(spark, top, many_ranges):
    draw = spark.range(4_000).select(
        F.concat(F.lit("t"), (F.col("id") % 9).cast("string")).alias("Team"),
        F.col("id").cast("string").alias("No"),
        (F.col("id") % 2 + 2000).cast("int").alias("Year"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 == 0, 700.0).otherwise(F.col("id") * 31 % 701 + 0.0).alias("PA"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("SO"),
    )
    ids, low = ("Team", "No"), ["SO"]
    everything = ranks.rank_long(draw, ["PA", "SO"], low, ids, ["Year"])
    expected = sorted(map(tuple, everything.where(F.col("Rank") <= top).collect()))
    found = ranks.rank_long(draw, ["PA", "SO"], low, ids, ["Year"], top=top)
    assert found.columns == everything.columns and sorted(map(tuple, found.collect())) == expected
    # A third of all rows share the best value of a metric, and all of them are first.
    assert sum(r[-1] == 1 for r in expected) > 2_000
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:  # as for a top beyond what a task limits by itself
        assert sorted(map(tuple, ranks.rank_long(draw, ["PA", "SO"], low, ids, ["Year"], top=top).collect())) == expected
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_top_ranks_count_no_whole_metric(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("No"), (F.col("id") * 7919 % 20_011 + 0.0).alias("PA"))
    written = []
    keep = ranks.durable
    monkeypatch.setattr(ranks, "durable", lambda df: written.append(keep(df)) or written[-1])
    found = ranks.rank_long(rows, ["PA"], [], ("No",), top=25)
    assert found.count() == 25 and all(df.count() <= 25 for df in written)
    with pytest.raises(ValueError):
        ranks.rank_long(rows, ["PA"], [], ("No",), top=0)
