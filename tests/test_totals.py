import pytest
from pyspark.sql import functions as F

from leaguestats.functions.registry import CAREER, TEAM
from leaguestats.functions.schemas import HITTER, PITCHER
from leaguestats.operators import totals


@pytest.fixture
def pitchers(spark):
    return spark.createDataFrame(
        [
            ("A", "x", "1", 2023, 0.33, 1, 2, 0, 3),
            ("A", "x", "1", 2024, 0.33, 1, 1, 1, 4),
            ("A", "x", "1", 2025, 0.33, 0, 0, None, 1),
            ("A", "y", "2", 2025, float("nan"), 5, 1, 1, None),
            ("B", "x", "1", 2025, 0.0, 4, 0, 0, 0),
            (None, "z", "3", 2025, 9.0, 9, 9, 9, 9),
        ],
        "Team string, Name string, No string, Year int, IP double, ER long, SO long, BB long, HA long",
    )


def test_team_totals_skip_missing_and_drop_null_teams(pitchers):
    made = {r.Team: r for r in totals.team_totals(pitchers, PITCHER).collect()}
    assert set(made) == {"A", "B"}
    assert (made["A"].IP, made["A"].ER, made["A"].SO, made["A"].BB, made["A"].HA) == (0.99, 7, 4, 2, 8)
    assert made["A"].ERA == 63.64 and made["A"]["SO/IP"] == 4.04 and made["A"].K9 == pytest.approx(36.36)
    # Runs without an out: undefined, not infinite.
    assert made["B"].ERA is None and made["B"].WHIP is None


def test_all_missing_sums_to_zero(spark):
    df = spark.createDataFrame([("A", None, None)], "Team string, PA long, IP double")
    made = totals.sum_by(df, ["Team"], ["PA", "IP", "absent"]).first()
    assert tuple(made) == ("A", 0, 0.0)


def test_career_repairs_innings_and_keeps_players_apart(pitchers):
    made = {(r.Team, r.Name, r.No): r for r in totals.career_totals(pitchers, PITCHER).collect()}
    assert made[("A", "x", "1")].IP == 1.0 and made[("A", "x", "1")].ERA == 18.0
    assert ("B", "x", "1") in made and len(made) == 3


def test_k9_uses_the_rounded_rate(spark):
    df = spark.createDataFrame([(2, 3.0)], "SO long, IP double")
    made = totals.add_metrics(df, PITCHER, TEAM).first()
    assert made["SO/IP"] == 0.67 and made.K9 == pytest.approx(6.03)


def test_ops_adds_rounded_parts(spark):
    df = spark.createDataFrame([(3, 9, 6, 0, 0, 0)], "H long, AB long, TB long, BB long, HBP long, SF long")
    made = totals.add_metrics(df, HITTER, CAREER).first()
    assert (made.AVG, made.OBP, made.SLG, made.OPS) == (0.333, 0.333, 0.667, 1.0)


def test_metric_guard(spark):
    df = spark.createDataFrame([(3, 9)], "H long, AB long")
    assert totals.add_metrics(df, HITTER, CAREER).columns == ["H", "AB", "AVG"]
    empty = spark.createDataFrame([(0, 0)], "H long, AB long")
    assert totals.add_metrics(empty, HITTER, TEAM).first().AVG is None


def test_team_filters_agree(spark, pitchers):
    listed = totals.in_teams(pitchers, ["A"]).count()
    table = spark.createDataFrame([("A",), ("Z",), ("A",)], "Team string")
    assert listed == totals.in_teams(pitchers, table).count() == 4


def test_totals_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 40).cast("string"))).alias("Team"),
        (F.col("id") % 97).alias("ER"),
        F.round((F.col("id") % 701) / 3.0, 2).alias("IP"),
    )
    one = sorted(totals.team_totals(df.coalesce(1), PITCHER).collect())
    many = sorted(totals.team_totals(df.repartition(31), PITCHER).collect())
    assert one == many


def test_empty_frame_flows_through(spark, pitchers):
    empty = pitchers.where("false")
    assert totals.team_totals(empty, PITCHER).count() == 0
    assert totals.career_totals(empty, PITCHER).count() == 0
    assert totals.roster_counts(empty).count() == 0


def test_career_is_the_sum_of_seasons(pitchers):
    seasons = totals.sum_by(pitchers, ["Team", "Name", "No", "Year"], ["ER", "SO"]).groupBy("Team", "Name", "No").agg(F.sum("ER").alias("ER"))
    careers = totals.career_totals(pitchers, PITCHER).select("Team", "Name", "No", "ER")
    assert sorted(seasons.collect()) == sorted(careers.collect())


def test_dimension(spark):
    facts = spark.createDataFrame([("A", 1), ("B", 2)], "Team string, n int")
    dimension = spark.createDataFrame([("A", "Alpha")], "Team string, short string")
    assert sorted(map(tuple, totals.add_dimension(facts, dimension, "Team", "short").collect())) == [("A", 1, "Alpha"), ("B", 2, None)]
    kept = totals.add_dimension(facts, dimension, "Team", "short", keep_unknown="Team")
    assert sorted(map(tuple, kept.collect())) == [("A", 1, "Alpha"), ("B", 2, "B")]
