import io

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leaguestats.functions.schemas import HITTER, PITCHER
from leaguestats.operators import compare, frames, profile


def test_minmax(spark):
    df = spark.createDataFrame(
        [("a", 2.0, 5, 1.0), ("b", 4.0, 5, float("inf")), ("c", 6.0, 5, None), ("d", None, 5, 3.0)], "Team string, x double, y long, z double"
    )
    made = {(r.Team, r.Stat): r.Value for r in compare.minmax_scale(df, ["Team"]).collect()}
    assert [made[t, "x"] for t in "abcd"] == [0.0, 0.5, 1.0, None]
    assert [made[t, "y"] for t in "abcd"] == [0.0] * 4
    assert [made[t, "z"] for t in "abcd"] == [0.0, None, None, 1.0]


def test_scaling_sees_the_whole_league(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 5.0)], "Team string, AVG double")
    raw, scaled = compare.compare_teams(df, HITTER, ["b", "a", "a"], ["AVG"])
    assert [tuple(r) for r in raw.collect()] == [("a", 1.0), ("b", 2.0)]
    assert sorted((r.Team, r.Value) for r in scaled.collect()) == [("a", 0.0), ("b", 0.25)]
    with pytest.raises(ValueError):
        compare.compare_teams(df, HITTER, metrics=["AVG"] * 13, most=12)


def test_long_and_back(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "Team string, PA long, `SB%` double")
    long = frames.to_long(df, ["Team"], ["PA", "SB%"])
    assert long.count() == 4
    wide = frames.to_wide(long, ["Team"], ["PA", "SB%"])
    assert sorted(map(tuple, wide.collect())) == [("a", 1.0, 0.5), ("b", 2.0, None)]


def test_transpose(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "Team string, PA long, `SB%` double")
    for names in (["a", "b"], None):
        made = frames.transpose_stats(df, "Team", names)
        assert made.columns == ["Stat", "a", "b"]
        assert sorted(map(tuple, made.collect())) == [("PA", 1.0, 2.0), ("SB%", 0.5, None)]


def test_sheet_and_digest(spark):
    df = spark.createDataFrame([("a", 0.3, 10), ("b", None, 12)], "Team string, AVG double, SO long")
    sheet = compare.team_sheet(df, HITTER)
    assert sorted((r.Team, r.Stat, r.Value, r.Rank) for r in sheet.where("Team = 'a'").collect()) == [("a", "AVG", 0.3, 1), ("a", "SO", 10.0, 1)]
    assert compare.team_sheet(df, HITTER, team="b").count() == 2
    texts = {r.Team: r.digest for r in compare.team_digest(sheet, HITTER).collect()}
    assert texts == {"a": "타율: 0.3 [1위], 삼진: 10.0 [1위]", "b": "타율: - [-위], 삼진: 12.0 [2위]"}
    rows = compare.value_and_rank_rows(sheet)
    assert rows.count() == 8 and rows.where("row = '순위' and Value is null").count() == 1


def test_profile_digest(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 4)], "ERA double, SO long")
    made = compare.profile_digest(profile.league_profile(df, ["SO", "ERA"]), PITCHER).first()
    assert tuple(made) == ("방어율: 1.5, 탈삼진: 3.0", "방어율: 1.5, 탈삼진: 3.0")


def test_context_is_the_csv_pandas_writes(spark):
    data = [("t", i, text, None if i == 2 else i / 4) for i, text in enumerate(['plain', 'a,b', 'say "x"', " padded ", "", "두 줄\n끝"])]
    df = spark.createDataFrame(data, "Team string, n int, text string, rate double")
    made = compare.team_context(df, ["Team"], [F.col("n")], ["n", "text", "rate"], n=5).first().context
    expected = pd.DataFrame([d[1:] for d in data[:5]], columns=["n", "text", "rate"]).to_csv(index=False)
    assert made == expected
    last = compare.team_context(df, ["Team"], [F.col("n").desc()], ["n", "text"], n=1).first().context
    assert pd.read_csv(io.StringIO(last)).text[0] == "두 줄\n끝"


def test_context_limits_each_group(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("Team"), F.col("id").alias("n"))
    made = {r.Team: r.context for r in compare.team_context(df, ["Team"], [F.col("n").desc()], ["n"], n=2).collect()}
    assert made == {0: "n\n98\n96\n", 1: "n\n99\n97\n"}
    assert compare.team_context(df, [], [F.col("n")], ["n"], n=3).first().context == "n\n0\n1\n2\n"


def test_relabel(spark):
    df = spark.createDataFrame([(1, 2, 3)], "CS long, `SO/IP` long, OBP long")
    assert frames.relabel(df, HITTER).columns == ["도실", "SO/IP", "출루율"]
    assert frames.relabel(df, PITCHER).columns == ["CS", "SO/IP", "피출루율"]
    assert frames.relabel(frames.relabel(df, HITTER), HITTER, "en").columns == df.columns


def test_columns(spark):
    df = spark.createDataFrame([("a", "7", 1, 0.5)], "Team string, No string, PA long, `SB%` double")
    assert frames.numeric_columns(df) == ["PA", "SB%"]
    assert frames.select_existing(df, ["SB%", "none", "Team"]).columns == ["SB%", "Team"]
    stacked = frames.stack_frames(df.select("Team"), df.select("PA", "Team"))
    assert stacked.columns == ["Team", "PA"] and stacked.count() == 2


def test_profile_context(spark):
    df = spark.createDataFrame([(1.0, 2, 0.25), (2.0, 4, 0.75)], "ERA double, SO long, `SO/IP` double")
    made = profile.league_profile(df, ["SO", "ERA", "SO/IP"])
    text = compare.profile_context(made, PITCHER, ["ERA", "SO", "SO/IP"]).first().context
    assert text == pd.DataFrame([{"방어율": 1.5, "탈삼진": 3.0, "SO/IP": 0.5}]).to_csv(index=False)
