import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from leaguestats.functions.schemas import HITTER, PITCHER, SCHEDULE, season_schema
from leaguestats.plans import workflows
from leaguestats.sources import store
from leaguestats import standins


def records(spark, *rows):
    """(Team, Name, PA, Year); all other columns are NULL."""
    made = spark.createDataFrame(list(rows), "Team string, Name string, PA long, Year int")
    return made.select(*[
        (F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in season_schema(HITTER)
    ])


def content(df):
    return sorted((r.Year, r.Team, r.Name, r.PA) for r in df.collect())


def test_write_and_read(spark, tmp_path):
    root = str(tmp_path)
    store.write_season(records(spark, ("A", "x", 1, 2023), ("A", "x", 2, 2024)), root, HITTER)
    assert content(store.read_seasons(spark, root, HITTER)) == [(2023, "A", "x", 1), (2024, "A", "x", 2)]
    assert content(store.read_season(spark, root, HITTER, 2024)) == [(2024, "A", "x", 2)]
    assert content(store.read_seasons(spark, root, HITTER, [2023, 1999])) == [(2023, "A", "x", 1)]
    assert store.read_seasons(spark, root, HITTER).schema.names == season_schema(HITTER).names


def test_one_season_is_replaced_and_the_others_stay(spark, tmp_path):
    root = str(tmp_path)
    store.write_season(records(spark, ("A", "x", 1, 2023), ("A", "x", 2, 2024)), root, HITTER)
    for _ in range(2):
        store.write_season(records(spark, ("B", "y", 9, 0)), root, HITTER, year=2024)
    assert content(store.read_seasons(spark, root, HITTER)) == [(2023, "A", "x", 1), (2024, "B", "y", 9)]


def test_partition_pruning(spark, tmp_path):
    root = str(tmp_path)
    store.write_season(records(spark, ("A", "x", 1, 2023), ("A", "x", 2, 2024)), root, HITTER)
    plan = store.read_season(spark, root, HITTER, 2024).select("Team")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan and "ReadSchema: struct<Team:string>" in plan


def test_build_only_when_missing(spark, tmp_path):
    root, built = str(tmp_path), []

    def build():
        built.append(1)
        return records(spark, ("A", "x", 5, 0)).drop("Year")

    for _ in range(2):
        made = store.season_or_build(spark, root, HITTER, 2022, build)
        assert content(made) == [(2022, "A", "x", 5)]
    assert built == [1]
    assert store.has_season(spark, root, HITTER, 2022) and not store.has_season(spark, root, HITTER, 2021)
    with pytest.raises(AnalysisException):
        store.read_seasons(spark, root, PITCHER)


def test_refresh_keeps_errors(spark, tmp_path):
    players = spark.createDataFrame([("A", 2024, "7", 4, 2), ("B", 2024, "9", 3, 1)], "Team string, Year int, No string, PA long, H long")
    full = players.select(*[
        (F.col(f.name) if f.name in players.columns else F.lit(0).cast(f.dataType)).alias(f.name) for f in season_schema(HITTER)
    ])
    pages = standins.hitter_pages(full).unionByName(
        spark.createDataFrame([("C", 2024, HITTER, "<p>down</p>")], "Team string, Year int, kind string, html string"),
        allowMissingColumns=True,
    )
    root = str(tmp_path)
    made = workflows.refresh(pages, root, HITTER)
    assert [r.Team for r in made.errors.collect()] == ["C"]
    assert content(store.read_season(spark, root, HITTER, 2024)) == [(2024, "A", "P7", 4), (2024, "B", "P9", 3)]
    view = workflows.season_view(spark, root, HITTER, 2024, ["A", "B"])
    assert view.players.count() == view.teams.count() == view.ranks.count() == 2
    assert {r.Team: r.PA for r in view.ranks.collect()} == {"A": 1, "B": 2}
    assert {r.Stat: r.mean for r in view.profile.collect()}["PA"] == 3.5
    careers = workflows.career_view(spark, root, HITTER)
    assert sorted((r.Team, r.PA) for r in careers.collect()) == [("A", 4), ("B", 3)]


def test_schedule_page_to_results(spark):
    html = (
        "<table><tr><td>menu</td></tr></table><table class='game_table'><tr><th>일시</th><th>구장</th><th>분류</th><th>게임</th><th>결과</th></tr>"
        "<tr><td> 03-01 </td><td>시립야구장</td><td>리그</td><td>\na\n2\nx\nx\nx\nb\n콜드승 12\n</td><td>종료</td></tr></table>"
    )
    pages = spark.createDataFrame([(SCHEDULE, html)], "kind string, html string")
    made = workflows.schedule_games(pages, "game_table").records.first()
    assert (made.date, made.venue, made.away, made.away_score, made.home, made.home_score, made.result) == (
        "03-01", "시립", "a", 2, "b", 12, "b_콜드승",
    )


def test_failed_page_keeps_stored_rows_and_seasons_open(spark, tmp_path):
    full = spark.createDataFrame([(t, 2024, n, 4) for t, n in (("A", "1"), ("B", "2"))], "Team string, Year int, No string, PA long").select(
        *[F.col(f.name) if f.name in ("Team", "Year", "No", "PA") else F.lit(0).cast(f.dataType).alias(f.name) for f in season_schema(HITTER)]
    )
    good = standins.hitter_pages(full)
    bad = good.withColumn("html", F.when(F.col("Team") == "B", F.lit("<p>down</p>")).otherwise(F.col("html")))
    root = str(tmp_path / "a")
    workflows.refresh(good, root, HITTER)
    made = workflows.refresh(bad, root, HITTER)
    assert [r.Team for r in made.errors.collect()] == ["B"]
    assert sorted(r.Team for r in store.read_season(spark, root, HITTER, 2024).collect()) == ["A", "B"]
    root = str(tmp_path / "b")
    made = workflows.load_seasons(spark, root, HITTER, [2024], bad)
    assert [r.Team for r in made.errors.collect()] == ["B"] and [r.Team for r in made.records.collect()] == ["A"]
    assert not store.has_season(spark, root, HITTER, 2024)
    made = workflows.load_seasons(spark, root, HITTER, [2024], good)
    assert made.errors.count() == 0 and made.records.count() == 2 and store.has_season(spark, root, HITTER, 2024)


def test_unreadable_schedule_pages_and_scores_are_errors(spark):
    head = "<tr><th>일시</th><th>구장</th><th>분류</th><th>게임</th><th>결과</th></tr>"
    game = "<tr><td>03-01</td><td>p</td><td>l</td><td>a\nxx5\nx\nx\nx\nb\n3</td><td>종료</td></tr>"
    pages = spark.createDataFrame(
        [(SCHEDULE, "<p>down</p>", 1), (SCHEDULE, f"<table class='game_table'>{head}{game}</table>", 2)], "kind string, html string, page int"
    )
    made = workflows.schedule_games(pages, "game_table", keep=["page"])
    assert sorted((r.page, r.error) for r in made.errors.collect()) == [(1, "no table found"), (2, "away score")]
    game = made.records.first()
    assert (game.away_score, game.home_score, game.result) == (None, 3, None)
