"""Empty frames through every operator, and properties that hold for any data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leaguestats.functions.registry import CAREER, ranked_metrics
from leaguestats.functions.schemas import HITTER, PITCHER, season_schema
from leaguestats.operators import compare, frames, profile, ranks, schedule, totals
from leaguestats.sources import ingest, store
from leaguestats.sources.pages import extract_tables


@pytest.mark.parametrize("kind", [HITTER, PITCHER])
def test_empty_season_flows_through_every_operator(spark, kind):
    empty = spark.createDataFrame([], season_schema(kind))
    metrics = list(ranked_metrics(kind))
    values = totals.team_totals(empty, kind, by=("Year", "Team"))
    assert values.columns == ["Year", "Team", *metrics]
    sheet = compare.team_sheet(values, kind, within=["Year"])
    league = profile.league_profile(values, metrics, by=["Year"])
    raw, scaled = compare.compare_teams(values, kind, within=["Year"])
    made = [
        totals.player_rates(empty, kind),
        totals.career_totals(empty, kind),
        totals.roster_counts(empty),
        ranks.rank_metrics(values, kind, within=["Year"]),
        ranks.leaderboard(empty, kind),
        ranks.leaderboard(empty, kind, n=3),
        sheet,
        compare.team_digest(sheet, kind, ["Year"]),
        compare.value_and_rank_rows(sheet, ["Year"]),
        league,
        compare.profile_digest(league, kind, ["Year"]),
        compare.profile_context(league, kind, metrics, ["Year"]),
        raw,
        scaled,
        compare.team_context(empty, ["Team"], ranks.leader_order(kind), ["Name", "No"]),
        profile.describe_stats(values, metrics),
        profile.histograms(values, metrics),
        profile.boxplots(values, metrics, by=["Year"]),
        profile.outliers(values, metrics, ["Team"], by=["Year"]),
        frames.transpose_stats(values.drop("Year"), "Team", ["A"]),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_empty_schedule_and_pages(spark, tmp_path):
    raw = spark.createDataFrame([], "`일시` string, `구장` string, `분류` string, `게임` string, `결과` string")
    results = schedule.game_result(schedule.parse_schedule(raw))
    for df in (results, schedule.results_by_team(results), schedule.next_game(results, "a"), schedule.next_games(results)):
        assert df.count() == 0
    pages = spark.createDataFrame([], "Team string, Year int, html string")
    typed = ingest.typed_records(extract_tables(pages, "html", ["Team", "Year"]), HITTER)
    good, bad = ingest.split_errors(typed)
    assert good.count() == bad.count() == 0
    store.write_season(good, str(tmp_path), HITTER, year=2020)
    assert not store.has_season(spark, str(tmp_path), HITTER, 2020)


@pytest.fixture(scope="module")
def random_frame(spark):
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"Team": [f"t{i % 37}" for i in range(1500)], "PA": rng.integers(0, 60, 1500), "AVG": rng.normal(size=1500)})
    frame.loc[rng.random(1500) < 0.3, "AVG"] = np.nan
    return spark.createDataFrame(frame)


def test_scaled_values_lie_between_zero_and_one(random_frame):
    scaled = compare.minmax_scale(random_frame.withColumn("row", F.monotonically_increasing_id()), ["row"], ["PA", "AVG"])
    least, most, known = scaled.agg(F.min("Value"), F.max("Value"), F.count("Value")).first()
    assert (least, most) == (0.0, 1.0) and known == 1500 + random_frame.where("not isnan(AVG)").count()


@pytest.mark.parametrize("bins", ["auto", 1, 7])
def test_histogram_counts_every_value_once(random_frame, bins):
    made = {r.Stat: r.n for r in profile.histograms(random_frame, ["PA", "AVG"], bins).groupBy("Stat").agg(F.sum("n").alias("n")).collect()}
    assert made == {"PA": 1500, "AVG": random_frame.where("not isnan(AVG)").count()}


def test_outlier_rows_agree_with_the_box_counts(random_frame):
    counts = {r.Stat: r.outliers for r in profile.boxplots(random_frame, ["PA", "AVG"]).collect() if r.outliers}
    rows = profile.outliers(random_frame, ["PA", "AVG"], ["Team"]).groupBy("Stat").count()
    assert counts == {r.Stat: r["count"] for r in rows.collect()} and counts


def test_long_form_pivots_back(random_frame):
    teams = totals.add_metrics(totals.team_totals(random_frame, HITTER), HITTER, CAREER)
    long = frames.to_long(teams, ["Team"], ["PA"])
    assert sorted(frames.to_wide(long, ["Team"], ["PA"]).collect()) == sorted(teams.select("Team", F.col("PA").cast("double")).collect())
