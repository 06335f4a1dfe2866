import pytest

from leaguestats.operators import schedule


def raw(spark, *games):
    rows = [(date, "시립야구장", "리그", game, status) for date, game, status in games]
    return spark.createDataFrame(rows, "`일시` string, `구장` string, `분류` string, `게임` string, `결과` string")


def game(away, away_score, home, home_score=None):
    tokens = [away, away_score, "x", "x", "x", home]
    return "\n".join(tokens if home_score is None else [*tokens, home_score])


CASES = [
    (game("own", "콜드승 11", "other", "1"), "종료", "콜드승"),
    (game("other", "5", "own", "2"), "종료", "패"),
    (game("own", "0", "other", "콜드승 10"), "종료", "콜드패"),
    (game("own", "기권승 7", "other", "0"), "종료", "승"),
    (game("other", "0", "own", "몰수승 7"), "종료", "승"),
    (game("own", "3", "other", "3"), "종료", "무"),
    (game("own", "", "other"), "게임대기", "경기전"),
    (game("own", " ", "other", ""), "게임대기", "경기전"),
    (game("own", "0", "other", "0"), None, "무"),
]


@pytest.mark.parametrize("text, status, expected", CASES)
def test_results(spark, text, status, expected):
    results = schedule.game_result(schedule.parse_schedule(raw(spark, ("d", text, status))))
    assert schedule.result_for(results, "own").first().result == expected


def test_scores_and_venue(spark):
    made = schedule.parse_schedule(raw(spark, ("d", game("a", "콜드승 11", "b", "기권승 7"), "종료"), ("d", "a", "종료"))).collect()
    assert (made[0].away_score, made[0].home_score, made[0].venue) == (11, 7, "시립")
    assert made[0].away_called and not made[0].home_called and made[0].error is None
    assert (made[1].away, made[1].away_score, made[1].home, made[1].home_score) == ("a", 0, None, 0)


def test_unread_score_is_reported(spark):
    made = schedule.parse_schedule(raw(spark, ("d", game("a", "many", "b", "2"), "종료"))).first()
    assert made.error == "away score" and made.away_score is None


def test_names_are_compared_whole(spark):
    results = schedule.game_result(schedule.parse_schedule(raw(spark, ("d", game("own too", "4", "own", "1"), "종료"))))
    assert schedule.result_for(results, "own").first().result == "패"


def test_both_sides(spark):
    results = schedule.game_result(schedule.parse_schedule(raw(spark, ("d", game("a", "4", "b", "1"), "종료"))))
    made = sorted((r.team, r.opponent, r.runs_for, r.runs_against, r.result) for r in schedule.results_by_team(results).collect())
    assert made == [("a", "b", 4, 1, "승"), ("b", "a", 1, 4, "패")]


def test_next_game(spark):
    games = [
        ("2025-03-02", game("own", "", "later"), "게임대기"),
        ("2025-03-01", game("sooner", "", "own"), "게임대기"),
        ("2025-02-01", game("x", "", "y"), "게임대기"),
        ("2025-01-01", game("own", "1", "past", "0"), "종료"),
        ("2025-01-02", game("own", "2", "tie", "2"), "종료"),
    ]
    results = schedule.game_result(schedule.parse_schedule(raw(spark, *games)))
    made = schedule.next_game(results, "own").collect()
    assert [(r.date, r.opponent) for r in made] == [("2025-03-01", "sooner")]
    assert schedule.next_game(results, "past").count() == 0
    assert {r.team: r.opponent for r in schedule.next_games(results).collect()} == {
        "own": "sooner", "sooner": "own", "later": "own", "x": "y", "y": "x",
    }
    assert [r.date for r in schedule.schedule_table(results).collect()] == sorted(g[0] for g in games)


def test_not_played_agrees_with_the_label(spark):
    texts = [(f"d{i}", text, status) for i, (text, status, _) in enumerate(CASES)]
    results = schedule.game_result(schedule.parse_schedule(raw(spark, *texts)))
    ahead = results.where(schedule.not_played()).count()
    assert ahead == results.where("result = '경기전'").count() == 2
