"""One query per operator, each over the whole of the sample tables.

Every query takes (spark, sf_dir) and returns a DataFrame.  All seasons are
computed at once, grouped by ``Year`` where an operator works on one season.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import standins
from ..checkpoints import durable, shared_folder
from ..functions.exprs import format_stat, innings_to_decimal, np_round, repair_innings
from ..functions.registry import CAREER, LOW_IS_GOOD, ranked_metrics
from ..functions.schemas import COLUMNS, HITTER, PITCHER, header_names
from ..operators import compare, distribution, frames, profile, ranks, schedule, sketches, totals
from ..plans import workflows
from ..sources import ingest, store
from ..sources.page_folder import PageFolder
from ..sources.pages import extract_tables
from ..sources.quarantine import Quarantine
from ..sources.snapshots import SnapshotStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PLAYER = ["Team", "Name", "No"]
OWN, OTHER = "NATION_1", "NATION_7"
SHEET_H = [c for c in ranked_metrics(HITTER)]
SHEET_P = [c for c in ranked_metrics(PITCHER)]
PROFILE_H = [*SHEET_H, "SB%", "BB/K", "XBH/H"]
PROFILE_P = SHEET_P
FACTS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def _hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hitter seasons with the rates a page would carry."""
    return totals.add_metrics(standins.batting(spark, sf_dir), HITTER, CAREER)


def _pitchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitcher seasons with page and player rates."""
    return totals.add_metrics(standins.pitching(spark, sf_dir).drop("notation", "outs"), PITCHER, CAREER)


def _team_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.team_totals(standins.batting(spark, sf_dir), HITTER, by=("Year", "Team"))


def _team_pitchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.team_totals(standins.pitching(spark, sf_dir), PITCHER, by=("Year", "Team"))


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Sums of fractions differ in the last bits between engines."""
    return df.withColumns({c: np_round(F.col(c), digits) for c in columns})


# --- totals and rates -------------------------------------------------------


@query
def team_batting(spark, sf_dir):
    return _team_hitters(spark, sf_dir)


@query
def team_pitching(spark, sf_dir):
    return _team_pitchers(spark, sf_dir)


@query
def career_batting(spark, sf_dir):
    return totals.career_totals(standins.batting(spark, sf_dir), HITTER)


@query
def career_pitching(spark, sf_dir):
    return totals.career_totals(standins.pitching(spark, sf_dir), PITCHER)


@query
def pitcher_rates(spark, sf_dir):
    rates = totals.player_rates(standins.pitching(spark, sf_dir), PITCHER)
    return rates.select(*PLAYER, "Year", "IP", "SO/IP", "BB/IP", "H/IP", "WHIP", "OBP")


@query
def innings_decimal(spark, sf_dir):
    pitchers = standins.pitching(spark, sf_dir)
    return pitchers.select(*PLAYER, "Year", "notation", innings_to_decimal(F.col("notation")).alias("decimal"))


@query
def innings_repair(spark, sf_dir):
    summed = totals.sum_by(standins.pitching(spark, sf_dir), PLAYER, ["IP"])
    return summed.select(*PLAYER, F.col("IP").alias("summed"), repair_innings(F.col("IP")).alias("repaired"))


@query
def roster_counts(spark, sf_dir):
    return totals.roster_counts(standins.batting(spark, sf_dir), ["Year", "Team"])


@query
def teams_in_list(spark, sf_dir):
    listed = standins.table(spark, sf_dir, "nation").where(F.col("n_regionkey") == 1).select(F.col("n_name").alias("Team"))
    kept = totals.in_teams(standins.batting(spark, sf_dir), listed)
    return totals.team_totals(kept, HITTER, by=("Year", "Team"))


# --- ranks and orders -------------------------------------------------------


@query
def rank_batting(spark, sf_dir):
    return ranks.rank_metrics(durable(_team_hitters(spark, sf_dir)), HITTER, within=["Year"])


@query
def rank_pitching(spark, sf_dir):
    return ranks.rank_metrics(durable(_team_pitchers(spark, sf_dir)), PITCHER, within=["Year"])


@query
def rank_players_batting(spark, sf_dir):
    return ranks.rank_metrics(durable(_hitters(spark, sf_dir)), HITTER, ids=PLAYER, within=["Year"])


@query
def rank_players_pitching(spark, sf_dir):
    return ranks.rank_metrics(durable(_pitchers(spark, sf_dir)), PITCHER, ids=PLAYER, within=["Year"])


@query
def top_ranks_batting(spark, sf_dir):
    """The first ten players of each metric and season, equal ones included."""
    return ranks.rank_long(_hitters(spark, sf_dir), SHEET_H, LOW_IS_GOOD[HITTER], PLAYER, ["Year"], top=10)


@query
def top_ranks_pitching(spark, sf_dir):
    return ranks.rank_long(_pitchers(spark, sf_dir), SHEET_P, LOW_IS_GOOD[PITCHER], PLAYER, ["Year"], top=10)


def _dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("n_regionkey") != 0, F.concat(F.lit("T"), F.col("n_nationkey").cast("string")))
    return standins.table(spark, sf_dir, "nation").select(F.col("n_name").alias("Team"), short.alias("team_eng"))


@query
def rank_matrix(spark, sf_dir):
    ranked = ranks.rank_metrics(durable(_team_hitters(spark, sf_dir)), HITTER, within=["Year"])
    return ranks.rank_matrix(ranked, _dimension(spark, sf_dir), HITTER, OWN, within=["Year"])


@query
def rank_matrix_pitching(spark, sf_dir):
    ranked = ranks.rank_metrics(durable(_team_pitchers(spark, sf_dir)), PITCHER, within=["Year"])
    return ranks.rank_matrix(ranked, _dimension(spark, sf_dir), PITCHER, OWN, within=["Year"])


@query
def pinned_order(spark, sf_dir):
    teams = totals.team_totals(standins.batting(spark, sf_dir), HITTER)
    pinned = F.contains(F.col("Team"), F.lit(OWN))
    return ranks.order_pinned(teams.select("Team", "AVG", "PA", pinned.alias("pinned")), "Team", OWN)


@query
def team_order(spark, sf_dir):
    teams = standins.table(spark, sf_dir, "nation").select(F.col("n_name").alias("Team"))
    return ranks.order_teams(teams, OWN, OTHER)


@query
def leaderboard_batting(spark, sf_dir):
    board = ranks.leaderboard(_hitters(spark, sf_dir), HITTER)
    return board.select("Year", *PLAYER, "PA", "AVG", "OBP", "SLG", "OPS")


@query
def leaderboard_pitching(spark, sf_dir):
    careers = totals.career_totals(standins.pitching(spark, sf_dir), PITCHER)
    return ranks.leaderboard(careers, PITCHER).select(*PLAYER, "IP", "ERA", "WHIP", "K9")


@query
def player_list_batting(spark, sf_dir):
    return ranks.player_table(_hitters(spark, sf_dir), HITTER, keys=["Year", "Team"])


@query
def player_list_pitching(spark, sf_dir):
    return ranks.player_table(_pitchers(spark, sf_dir), PITCHER, keys=["Year", "Team"])


@query
def player_list_career_batting(spark, sf_dir):
    careers = totals.career_totals(standins.batting(spark, sf_dir), HITTER)
    return ranks.player_table(careers, HITTER, lang="kr", keys=["Team"])


@query
def player_list_career_pitching(spark, sf_dir):
    careers = totals.career_totals(standins.pitching(spark, sf_dir), PITCHER)
    return ranks.player_table(careers, PITCHER, OWN)


@query
def top_n_per_team(spark, sf_dir):
    careers = totals.career_totals(standins.pitching(spark, sf_dir), PITCHER)
    return ranks.leaderboard(careers, PITCHER, n=5).select("Team", "place", "Name", "No", "IP", "ERA")


# --- profiles ---------------------------------------------------------------


@query
def league_mean_median(spark, sf_dir):
    return profile.league_profile(_hitters(spark, sf_dir), PROFILE_H, by=["Year"])


@query
def league_complete_rows(spark, sf_dir):
    return profile.league_profile(_pitchers(spark, sf_dir), PROFILE_P, by=["Year"], complete_rows=True)


def _described(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    made = profile.describe_stats(df, columns, by=by)
    return _rounded(_rounded(made, ["std", "q25", "q50", "q75"]), ["mean"], 8)


@query
def describe_batting(spark, sf_dir):
    return _described(_hitters(spark, sf_dir), PROFILE_H, [])


@query
def describe_pitching(spark, sf_dir):
    return _described(_pitchers(spark, sf_dir), PROFILE_P, ["Year"])


@query
def describe_by_team(spark, sf_dir):
    """All numeric columns of the players, per season and team."""
    players = _hitters(spark, sf_dir).select("Year", "Team", "No", *PROFILE_H)
    made = profile.describe_stats(players, by=["Year", "Team"])
    return _rounded(_rounded(made, ["std", "q25", "q50", "q75"]), ["mean"], 8)


@query
def boxplot_by_team(spark, sf_dir):
    made = profile.boxplots(_hitters(spark, sf_dir), PROFILE_H, by=["Team"])
    return _rounded(made, ["q1", "median", "q3", "whisker_lo", "whisker_hi"])


@query
def histogram_by_team(spark, sf_dir):
    made = profile.histograms(_hitters(spark, sf_dir), ["AVG", "OPS", "PA"], bins=10, by=["Team"])
    return _rounded(made, ["lo", "hi"])


def _near_rank(exact: DataFrame, sketched: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the sketched quartiles lie at their ranks, within the stated error, among the exactly placed values."""
    off = 1.5 * sketches.rank_error()
    placed = exact.join(sketched, keys)
    checks = []
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        below = F.sum(F.when(F.col("Value") < F.col(name), F.col("n")).otherwise(0)) / F.sum("n")
        upto = F.sum(F.when(F.col("Value") <= F.col(name), F.col("n")).otherwise(0)) / F.sum("n")
        slack = off + 1 / F.sum("n")
        checks.append(((below <= q + slack) & (upto >= q - slack)).alias(f"{name}_near"))
    kept = [F.first(c).alias(c) for c in ("count", "min", "max")]
    return placed.groupBy(*keys).agg(*kept, *checks)


@query
def approx_quartiles(spark, sf_dir):
    """Quartiles of each metric over all seasons, merged from sketches per season and team."""
    players = _pitchers(spark, sf_dir)
    merged = sketches.merge_sketches(durable(sketches.sketch_values(players, PROFILE_P, ["Year", "Team"])))
    exact = distribution.counted_values(frames.to_long(players, [], PROFILE_P), ["Stat"])
    return _near_rank(exact, sketches.sketched_description(merged), ["Stat"])


@query
def approx_facts(spark, sf_dir):
    """The same for the table of facts, one sketch a column."""
    facts = standins.table(spark, sf_dir, "lineitem").select(*FACTS)
    exact = distribution.counted_values(frames.to_long(facts, [], FACTS), ["Stat"])
    return _near_rank(exact, profile.describe_stats(facts, approx=True), ["Stat"])


@query
def describe_facts(spark, sf_dir):
    return _described(standins.table(spark, sf_dir, "lineitem"), FACTS, [])


@query
def histogram_fixed(spark, sf_dir):
    made = profile.histograms(standins.table(spark, sf_dir, "lineitem"), FACTS, bins=10)
    return _rounded(made, ["lo", "hi"])


@query
def histogram_auto(spark, sf_dir):
    made = profile.histograms(_hitters(spark, sf_dir), PROFILE_H)
    return _rounded(made, ["lo", "hi"])


@query
def histogram_events(spark, sf_dir):
    made = profile.histograms(standins.table(spark, sf_dir, "events"), ["value"], by=["event_type"])
    return _rounded(made, ["lo", "hi"])


@query
def boxplot(spark, sf_dir):
    made = profile.boxplots(_pitchers(spark, sf_dir), PROFILE_P, by=["Year"])
    return _rounded(made, ["q1", "median", "q3", "whisker_lo", "whisker_hi"])


@query
def outliers(spark, sf_dir):
    return profile.outliers(_pitchers(spark, sf_dir), PROFILE_P, ids=PLAYER, by=["Year"])


# --- reshaping and comparison -----------------------------------------------


@query
def to_long(spark, sf_dir):
    return frames.to_long(_team_hitters(spark, sf_dir), ["Year", "Team"], SHEET_H)


@query
def transpose_stats(spark, sf_dir):
    teams = totals.team_totals(standins.batting(spark, sf_dir), HITTER)
    names = [row.n_name for row in standins.table(spark, sf_dir, "nation").select("n_name").collect()]
    return frames.transpose_stats(teams, "Team", names, SHEET_H)


@query
def minmax_scale(spark, sf_dir):
    return compare.minmax_scale(durable(_team_pitchers(spark, sf_dir)), ["Team"], SHEET_P, within=["Year"])


def _compared(spark: SparkSession, sf_dir: str, teams: list[str] | None) -> tuple[DataFrame, DataFrame]:
    return compare.compare_teams(durable(_team_hitters(spark, sf_dir)), HITTER, teams, within=["Year"])


@query
def compare_two(spark, sf_dir):
    return _compared(spark, sf_dir, [OWN, OTHER])[1]


@query
def compare_two_table(spark, sf_dir):
    return _compared(spark, sf_dir, [OWN, OTHER])[0]


@query
def compare_all(spark, sf_dir):
    return _compared(spark, sf_dir, None)[1]


@query
def compare_two_pitching(spark, sf_dir):
    values = durable(_team_pitchers(spark, sf_dir))
    return compare.compare_teams(values, PITCHER, [OWN, OTHER], within=["Year"])[1]


@query
def compare_two_pitching_table(spark, sf_dir):
    values = durable(_team_pitchers(spark, sf_dir))
    return compare.compare_teams(values, PITCHER, [OWN, OTHER], within=["Year"])[0]


@query
def compare_all_pitching(spark, sf_dir):
    values = durable(_team_pitchers(spark, sf_dir))
    return compare.compare_teams(values, PITCHER, within=["Year"])[1]


def _sheet(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    values = _team_hitters(spark, sf_dir) if kind == HITTER else _team_pitchers(spark, sf_dir)
    return compare.team_sheet(durable(values), kind, within=["Year"])


@query
def team_sheet(spark, sf_dir):
    return _sheet(spark, sf_dir, HITTER)


@query
def team_sheet_pitching(spark, sf_dir):
    return _sheet(spark, sf_dir, PITCHER)


@query
def value_rank_rows(spark, sf_dir):
    return compare.value_and_rank_rows(durable(_sheet(spark, sf_dir, HITTER)), ["Year"])


@query
def team_digest(spark, sf_dir):
    return compare.team_digest(_sheet(spark, sf_dir, HITTER), HITTER, ["Year"])


@query
def team_digest_pitching(spark, sf_dir):
    return compare.team_digest(_sheet(spark, sf_dir, PITCHER), PITCHER, ["Year"])


def _league(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Mean and median of every ordered metric per season."""
    players = _hitters(spark, sf_dir) if kind == HITTER else _pitchers(spark, sf_dir)
    return profile.league_profile(players, ranked_metrics(kind), by=["Year"], complete_rows=kind == PITCHER)


@query
def league_digest(spark, sf_dir):
    return compare.profile_digest(_league(spark, sf_dir, HITTER), HITTER, ["Year"])


@query
def league_digest_pitching(spark, sf_dir):
    return compare.profile_digest(_league(spark, sf_dir, PITCHER), PITCHER, ["Year"])


def _context_order(kind: str) -> list[Column]:
    return [*ranks.leader_order(kind), F.col("Year")]


def _context(spark: SparkSession, sf_dir: str, kind: str, by: list[str]) -> DataFrame:
    players = _hitters(spark, sf_dir) if kind == HITTER else _pitchers(spark, sf_dir)
    return compare.team_context(players, by, _context_order(kind), ["No", "Name", *ranked_metrics(kind)], n=30)


@query
def team_context(spark, sf_dir):
    return _context(spark, sf_dir, HITTER, ["Team"])


@query
def team_context_pitching(spark, sf_dir):
    return _context(spark, sf_dir, PITCHER, ["Team"])


@query
def league_context(spark, sf_dir):
    return _context(spark, sf_dir, HITTER, [])


@query
def league_context_pitching(spark, sf_dir):
    return _context(spark, sf_dir, PITCHER, [])


@query
def median_context(spark, sf_dir):
    return compare.profile_context(_league(spark, sf_dir, HITTER), HITTER, ranked_metrics(HITTER), ["Year"])


@query
def median_context_pitching(spark, sf_dir):
    return compare.profile_context(_league(spark, sf_dir, PITCHER), PITCHER, ranked_metrics(PITCHER), ["Year"])


# --- schedule ---------------------------------------------------------------


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.parse_schedule(standins.raw_schedule(spark, sf_dir), keep=("game_id",))


@query
def schedule_parse(spark, sf_dir):
    return _games(spark, sf_dir)


@query
def schedule_results(spark, sf_dir):
    return schedule.schedule_table(schedule.game_result(_games(spark, sf_dir)), keep=("game_id",))


@query
def schedule_own_results(spark, sf_dir):
    results = schedule.result_for(schedule.game_result(_games(spark, sf_dir)), OWN)
    return schedule.schedule_table(results, keep=("game_id",))


@query
def results_by_team(spark, sf_dir):
    return schedule.results_by_team(schedule.game_result(_games(spark, sf_dir)), keep=("game_id",))


@query
def next_game(spark, sf_dir):
    return schedule.next_game(schedule.game_result(_games(spark, sf_dir)), OWN)


@query
def next_games(spark, sf_dir):
    return schedule.next_games(schedule.game_result(_games(spark, sf_dir)))


@query
def schedule_pages(spark, sf_dir):
    pages = standins.schedule_pages(standins.raw_schedule(spark, sf_dir))
    return schedule.schedule_table(workflows.schedule_games(pages, "game_table").records)


# --- cleaning and naming ----------------------------------------------------


@query
def name_split(spark, sf_dir):
    key = F.col("c_custkey")
    number = F.concat(F.lit("("), F.lpad(key.cast("string"), 7, "0"), F.lit(")"))
    cell = F.concat(F.lit("A 선수"), key.cast("string"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(number))
    return ingest.split_name_no(standins.table(spark, sf_dir, "customer").select("c_custkey", cell.alias("이름")))


def _as_page(records: DataFrame) -> DataFrame:
    """Typed records back to text columns under page headers, with variants."""
    names = {name: header for header, name in header_names(HITTER).items()}
    names |= {"G": "게임수", "2B": "2 루타"}
    return records.select("Year", *[F.col(c).cast("string").alias(names[c]) for c in records.columns if c in names])


@query
def header_normalize(spark, sf_dir):
    return ingest.normalize_headers(_as_page(standins.batting(spark, sf_dir)), HITTER)


@query
def conform(spark, sf_dir):
    records = _as_page(_hitters(spark, sf_dir)).withColumns(
        {
            "총안타": F.when(F.col("타석").cast("int") % 11 == 0, "x").otherwise(F.col("총안타")),
            "타석": F.when(F.col("홈런") == "0", F.concat(F.col("타석"), F.lit(",007"))).otherwise(F.col("타석")),
            "타율": F.when(F.col("볼넷") == "3", "").otherwise(F.col("타율")),
        }
    )
    typed = ingest.conform(ingest.normalize_headers(records, HITTER), HITTER, keep=["Year"])
    return typed.select(*[name for _, name, _ in COLUMNS[HITTER]], "Year", "error")


@query
def null_sentinels(spark, sf_dir):
    careers = totals.career_totals(standins.pitching(spark, sf_dir), PITCHER)
    raw = careers.select(
        *PLAYER,
        F.coalesce(F.col("ERA").cast("string"), F.lit(" - ")).alias("ERA"),
        F.when(F.col("SV") == 0, "").otherwise(F.col("SV").cast("string")).alias("SV"),
    )
    return ingest.null_sentinels(raw, ["ERA", "SV"])


@query
def relabel(spark, sf_dir):
    return frames.relabel(_team_hitters(spark, sf_dir), HITTER)


@query
def relabel_pitching(spark, sf_dir):
    return frames.relabel(_team_pitchers(spark, sf_dir), PITCHER)


@query
def team_lookup(spark, sf_dir):
    rosters = totals.roster_counts(standins.pitching(spark, sf_dir))
    dimension = _dimension(spark, sf_dir)
    known = totals.add_dimension(rosters, dimension, "Team", "team_eng")
    return totals.add_dimension(
        known, dimension.withColumnRenamed("team_eng", "shown"), "Team", "shown", keep_unknown="Team"
    )


@query
def multi_season_union(spark, sf_dir):
    hitters = standins.batting(spark, sf_dir).select("Year", *PLAYER, "PA", "H")
    pitchers = standins.pitching(spark, sf_dir).select("Year", *PLAYER, "IP", "ER")
    return frames.stack_frames(hitters, pitchers)


@query
def format_stat_text(spark, sf_dir):
    careers = totals.career_totals(standins.pitching(spark, sf_dir), PITCHER)
    long = frames.to_long(careers, PLAYER, [c for c in SHEET_P if c in careers.columns])
    return long.select(*PLAYER, "Stat", format_stat(F.col("Value")).alias("text"))


# --- pages and snapshots ----------------------------------------------------


def _hitter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.hitter_pages(_hitters(spark, sf_dir))


@query
def extract_hitter_pages(spark, sf_dir):
    rows = extract_tables(_hitter_pages(spark, sf_dir), "html", ["Team", "Year"])
    shown = ["순위", "이름", *_hitter_headers()]
    return rows.select("Team", "Year", "table_no", *[F.col("cells")[h].alias(h) for h in shown], "error")


def _hitter_headers() -> list[str]:
    """Headers of the rendered pages: the declared ones, two of them in a variant."""
    variants = {"경기": "게임수", "도실(도루자)": "도실 (도루자)"}
    return [variants.get(h, h) for h, _, type_ in COLUMNS[HITTER] if type_ != "string"]


@query
def folder_of_pages(spark, sf_dir):
    """The same pages saved as files and read back by the data source."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    _hitter_pages(spark, sf_dir).select("Year", "Team", "html").write.partitionBy("Year", "Team").text(folder)
    spark.dataSource.register(PageFolder)
    rows = spark.read.format("record_pages").schema("Team string, Year int, cells map<string,string>, error string").load(folder)
    shown = ["순위", "이름", *_hitter_headers()]
    return rows.select("Team", "Year", *[F.col("cells")[h].alias(h) for h in shown], "error")


@query
def extract_raw_pages(spark, sf_dir):
    pages = standins.table(spark, sf_dir, "pages")
    return extract_tables(pages, "html", ["page_id", "url"]).select("page_id", "url", "table_no", "row_no", "error")


@query
def typed_hitter_pages(spark, sf_dir):
    return workflows.page_records(_hitter_pages(spark, sf_dir), HITTER).records


def _snapshot_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"


@query
def snapshot_roundtrip(spark, sf_dir):
    root = _snapshot_root(spark)
    records = _pitchers(spark, sf_dir).withColumns({"WPCT": F.lit(None).cast("double")})
    store.write_season(records, root, PITCHER)
    return store.read_seasons(spark, root, PITCHER)


@query
def season_or_build(spark, sf_dir):
    root = _snapshot_root(spark)
    pages = durable(_hitter_pages(spark, sf_dir))
    years = [row.Year for row in pages.select("Year").distinct().collect()]
    workflows.load_seasons(spark, root, HITTER, years[:1], pages)
    return workflows.load_seasons(spark, root, HITTER, years, pages).records


@query
def career_from_snapshots(spark, sf_dir):
    root = _snapshot_root(spark)
    workflows.refresh(_hitter_pages(spark, sf_dir), root, HITTER)
    return workflows.career_view(spark, root, HITTER)


def _pitcher_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.pitcher_pages(totals.add_metrics(standins.pitching(spark, sf_dir), PITCHER, CAREER))


@query
def typed_pitcher_pages(spark, sf_dir):
    """Dashes for an ERA, innings in notation and the games header on the way."""
    return workflows.page_records(_pitcher_pages(spark, sf_dir), PITCHER).records


@query
def load_errors(spark, sf_dir):
    """What a refresh from damaged pages could not read."""
    pages = standins.damaged_pages(_hitter_pages(spark, sf_dir))
    return workflows.refresh(pages, _snapshot_root(spark), HITTER).errors.select("Team", "Year", "Name", "No", "error")


@query
def load_errors_pitching(spark, sf_dir):
    pages = standins.damaged_pages(_pitcher_pages(spark, sf_dir))
    return workflows.refresh(pages, _snapshot_root(spark), PITCHER).errors.select("Team", "Year", "Name", "No", "error")


@query
def load_report(spark, sf_dir):
    """Pages, rows and errors by reason, counted while the rows are written."""
    pages = standins.damaged_pages(_hitter_pages(spark, sf_dir))
    return workflows.report_frame(spark, workflows.page_records(pages, HITTER).report)


@query
def quarantined_errors(spark, sf_dir):
    """After a load of damaged pages and one in which the lost pages are mended: what stays in quarantine."""
    root = _snapshot_root(spark)
    sound = durable(_hitter_pages(spark, sf_dir))
    damaged = durable(standins.damaged_pages(sound))
    workflows.refresh_pending(damaged, root, HITTER)
    lost = F.startswith(F.col("html"), F.lit("<html><body>moved"))
    mended = sound.join(damaged.where(lost).select("Team", "Year", "block"), ["Team", "Year", "block"], "left_semi")
    workflows.refresh_pending(damaged.where(~lost).unionByName(mended), root, HITTER)
    return Quarantine(spark, root, HITTER).errors().select("Team", "Year", "error", "n")


def _view(spark: SparkSession, pages: DataFrame, kind: str) -> DataFrame:
    root = _snapshot_root(spark)
    workflows.refresh(pages, root, kind)
    return workflows.view_rows(workflows.season_view(spark, root, kind, None), kind)


@query
def season_view_batting(spark, sf_dir):
    """From pages to the players, teams, ranks and league values of every season."""
    return _view(spark, _hitter_pages(spark, sf_dir), HITTER)


@query
def season_view_pitching(spark, sf_dir):
    return _view(spark, _pitcher_pages(spark, sf_dir), PITCHER)


def _stored_pitchers(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """Snapshots of all seasons, one of them then replaced with more wins."""
    stored = SnapshotStore(spark, _snapshot_root(spark), PITCHER)
    records = durable(_pitchers(spark, sf_dir).withColumn("WPCT", F.lit(None).cast("double")))
    stored.commit(records)
    stored.commit(records.where("Year = 1995").withColumn("W", F.col("W") + 1))
    return stored


@query
def snapshot_versions(spark, sf_dir):
    """Records of the version before and after one season was replaced."""
    stored = _stored_pitchers(spark, sf_dir)
    old, new = [stored.records(version=v).select(*PLAYER, "Year", "W", "L", "IP").withColumn("version", F.lit(v)) for v in (1, 2)]
    return old.unionByName(new)


@query
def career_from_partials(spark, sf_dir):
    """Careers merged from the seasons' partial totals after one season was replaced."""
    return _stored_pitchers(spark, sf_dir).careers()


@query
def career_from_buckets(spark, sf_dir):
    """The same from the records, which lie together by player."""
    return totals.career_totals(_stored_pitchers(spark, sf_dir).records(), PITCHER)


@query
def snapshot_sketches(spark, sf_dir):
    """Limits and counts per team over all seasons, merged from the stored sketches."""
    merged = _stored_pitchers(spark, sf_dir).sketches(["Team"])
    return sketches.sketched_description(merged).select("Team", "Stat", "count", "min", "max")
