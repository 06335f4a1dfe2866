"""Independent SQL for the registered queries, in DuckDB's dialect.

The SQL is written from the definitions, not from the Spark plans: plain joins
before aggregation, window ranks and row numbers over whole groups.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _n(condition: str, name: str) -> str:
    return f"CAST(count_if({condition}) AS BIGINT) AS {name}"


def _sum(expression: str, name: str) -> str:
    return f"CAST(sum({expression}) AS BIGINT) AS {name}"


def _div(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0))"


def _round(expression: str, digits: int) -> str:
    return f"round_even({expression}, {digits})"


_AT_BAT = "l_linenumber <= 5"
_HIT = _AT_BAT + " AND l_returnflag = 'R'"

BAT = f"""
bat AS (
  SELECT n_name AS team, s_name AS name, CAST(s_suppkey AS VARCHAR) AS no, CAST(year(l_shipdate) AS INT) AS yr,
    {_n("l_linenumber = 1", "g")}, count(*) AS pa, {_n(_AT_BAT, "ab")},
    {_n("l_linenumber <= 3 AND l_linestatus = 'O'", "r")}, {_n(_HIT, "h")},
    {_n(_HIT + " AND l_quantity <= 30", "b1")},
    {_n(_HIT + " AND l_quantity > 30 AND l_quantity <= 40", "b2")},
    {_n(_HIT + " AND l_quantity > 40 AND l_quantity <= 45", "b3")},
    {_n(_HIT + " AND l_quantity > 45", "hr")},
    {_n(_HIT + " AND l_discount >= 0.05", "rbi")},
    {_n("l_tax >= 0.06", "sb")}, {_n("l_tax < 0.01", "cs")},
    {_n("l_linenumber = 7 AND l_linestatus = 'F'", "sh")}, {_n("l_linenumber = 7 AND l_linestatus = 'O'", "sf")},
    {_n("l_linenumber = 6 AND l_linestatus = 'O'", "bb")},
    {_n("l_linenumber = 6 AND l_linestatus = 'O' AND l_tax >= 0.07", "ibb")},
    {_n("l_linenumber = 6 AND l_linestatus = 'F'", "hbp")},
    {_n(_AT_BAT + " AND l_returnflag = 'N' AND l_discount > 0.05", "so")},
    {_n(_AT_BAT + " AND l_returnflag = 'A' AND l_discount > 0.08", "dp")},
    {_n("l_linenumber = 1 AND l_returnflag = 'R'", "mhit")},
    b1 + 2 * b2 + 3 * b3 + 4 * hr AS tb
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY n_name, s_name, s_suppkey, year(l_shipdate))"""

_PRICE = "CAST(floor(o_totalprice) AS BIGINT)"
_NOTATION = "floor(CAST(outs AS DOUBLE) / 3e0) + CAST(outs % 3 AS DOUBLE) / 10e0"
_INNINGS = "round_even(floor(notation) + (notation % 1e0) * 10e0 / 3e0, 2)"

PIT = f"""
pit0 AS (
  SELECT n_name AS team, c_name AS name, CAST(c_custkey AS VARCHAR) AS no, CAST(year(o_orderdate) AS INT) AS yr,
    count(*) AS g, {_n("o_orderstatus = 'F'", "w")}, {_n("o_orderstatus = 'P'", "l")},
    {_n("o_orderpriority = '1-URGENT'", "sv")}, {_n("o_orderpriority = '2-HIGH'", "hld")},
    {_sum(_PRICE + " % 7", "outs")}, {_sum(_PRICE + " % 7 + o_orderkey % 3", "ab")},
    {_sum("50 + o_orderkey % 23", "p")}, {_sum("o_orderkey % 3", "ha")},
    {_n("o_orderkey % 17 = 0", "hr")}, {_n("o_orderkey % 19 = 0", "sh")}, {_n("o_orderkey % 13 = 0", "sf")},
    {_n("o_orderkey % 5 = 0", "bb")}, {_n("o_orderkey % 23 = 0", "ibb")}, {_n("o_orderkey % 11 = 0", "hbp")},
    {_sum("o_orderkey % 4", "so")}, {_n("o_orderkey % 29 = 0", "wp")}, {_n("o_orderkey % 31 = 0", "bk")},
    {_sum("o_orderkey % 2 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END", "r")},
    {_sum("o_orderkey % 2", "er")}
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, c_name, c_custkey, year(o_orderdate)),
pit1 AS (SELECT *, ab + bb + hbp + sf + sh AS bf, {_NOTATION} AS notation FROM pit0),
pit AS (SELECT *, {_INNINGS} AS ip FROM pit1)"""

# Output name -> lower-case column, in output order.
H_COLS = {
    "AVG": "avg_", "PA": "pa", "AB": "ab", "H": "h", "RBI": "rbi", "R": "r", "OBP": "obp", "SLG": "slg",
    "OPS": "ops", "SO": "so", "BB": "bb", "SB": "sb", "MHit": "mhit", "1B": "b1", "2B": "b2", "3B": "b3",
    "HR": "hr", "TB": "tb", "CS": "cs", "SH": "sh", "SF": "sf", "IBB": "ibb", "HBP": "hbp", "DP": "dp",
}
P_COLS = {
    "IP": "ip", "ERA": "era", "WHIP": "whip", "H/IP": "h_ip", "BB/IP": "bb_ip", "SO/IP": "so_ip", "BAA": "baa",
    "OBP": "obp", "G": "g", "W": "w", "L": "l", "SV": "sv", "HLD": "hld", "SO": "so", "BF": "bf", "AB": "ab",
    "P": "p", "HA": "ha", "HR": "hr", "SH": "sh", "SF": "sf", "BB": "bb", "IBB": "ibb", "HBP": "hbp", "WP": "wp",
    "BK": "bk", "R": "r", "ER": "er", "K9": "k9",
}
_H_EXTRA = {"SB%": "sbp", "BB/K": "bb_k", "XBH/H": "xbh_h"}
_H_COUNTS = ["g", "pa", "ab", "r", "h", "b1", "b2", "b3", "hr", "rbi", "sb", "cs", "sh", "sf", "bb", "ibb", "hbp", "so", "dp", "mhit", "tb"]
_P_COUNTS = ["g", "w", "l", "sv", "hld", "bf", "ab", "p", "ha", "hr", "sh", "sf", "bb", "ibb", "hbp", "so", "wp", "bk", "r", "er"]
_H_LOW = ("SO", "DP", "CS")
_P_LOW = ("ERA", "WHIP", "H/IP", "BB/IP", "BAA", "OBP", "BF", "AB", "P", "HA", "HR", "SH", "SF", "BB", "IBB", "HBP", "WP", "BK", "R", "ER")


def _h_rates(source: str) -> str:
    return f"""(SELECT *, {_round("obp + slg", 3)} AS ops FROM (SELECT *,
      {_round(_div("h", "ab"), 3)} AS avg_, {_round(_div("h + bb + hbp", "ab + bb + hbp + sf"), 3)} AS obp,
      {_round(_div("tb", "ab"), 3)} AS slg, {_div("sb", "sb + cs")} AS sbp, {_div("bb", "so")} AS bb_k,
      {_div("b2 + b3 + hr", "h")} AS xbh_h FROM {source}))"""


def _p_rates(source: str) -> str:
    return f"""(SELECT *, so_ip * 9e0 AS k9 FROM (SELECT *,
      {_round(_div("er", "ip") + " * 9e0", 2)} AS era, {_round(_div("so", "ip"), 2)} AS so_ip,
      {_round(_div("bb", "ip"), 2)} AS bb_ip, {_round(_div("ha", "ip"), 2)} AS h_ip,
      {_round(_div("bb + ha", "ip"), 3)} AS whip, {_round(_div("ha", "ab"), 3)} AS baa,
      {_div("ha + bb + hbp", "ab + bb + hbp + sf")} AS obp FROM {source}))"""


_IP_SUM = "CAST(sum(CAST(ip AS DECIMAL(27,9))) AS DOUBLE) AS ip"
_REPAIRED = "CASE WHEN abs(ip % 1e0 - 0.99e0) <= 0.01e0 + 1e-5 * 0.99e0 THEN ceil(ip) ELSE ip END"


def _h_group(keys: str) -> str:
    return f"(SELECT {keys}, {', '.join(_sum(c, c) for c in _H_COUNTS)} FROM bat GROUP BY {keys})"


def _p_group(keys: str) -> str:
    return f"(SELECT {keys}, {', '.join(_sum(c, c) for c in _P_COUNTS)}, {_IP_SUM} FROM pit GROUP BY {keys})"


# Team and season values, player seasons and careers of both kinds.
TEAM_H = f"WITH {BAT}, v AS {_h_rates(_h_group('yr, team'))}"
TEAM_P = f"WITH {PIT}, v AS {_p_rates(_p_group('yr, team'))}"
PLAYER_H = f"WITH {BAT}, v AS {_h_rates('bat')}"
PLAYER_P = f"WITH {PIT}, v AS {_p_rates('pit')}"
CAREER_H = f"WITH {BAT}, v AS {_h_rates(_h_group('team, name, no'))}"
CAREER_P = f"WITH {PIT}, c AS {_p_group('team, name, no')}, v AS {_p_rates('(SELECT * REPLACE (' + _REPAIRED + ' AS ip) FROM c)')}"

YT = 'yr AS "Year", team AS "Team"'
KEY = 'team AS "Team", name AS "Name", no AS "No"'
YK = f'yr AS "Year", {KEY}'


def _as(cols: dict[str, str]) -> str:
    return ", ".join(f'{c} AS "{name}"' for name, c in cols.items())


def _pick(cols: dict[str, str], names: list[str]) -> dict[str, str]:
    return {name: cols[name] for name in names}


def _long(ids: str, cols: dict[str, str], source: str = "v") -> str:
    """(ids, stat, val) by one SELECT per metric."""
    return "(" + " UNION ALL ".join(
        f"SELECT {ids}, '{name}' AS stat, CAST({c} AS DOUBLE) AS val FROM {source}" for name, c in cols.items()
    ) + ")"


def _ranked(ids: str, cols: dict[str, str], low: tuple[str, ...], by: str = "yr, stat") -> str:
    listed = ", ".join(f"'{c}'" for c in low)
    return f"""(SELECT *, CASE WHEN val IS NOT NULL THEN CAST(rank() OVER (PARTITION BY {by}
      ORDER BY CASE WHEN stat IN ({listed}) THEN val ELSE -val END ASC NULLS LAST) AS BIGINT) END AS rk
      FROM {_long(ids, cols)})"""


def _wide_ranks(cols: dict[str, str]) -> str:
    return ", ".join(f"max(CASE WHEN stat = '{name}' THEN rk END) AS \"{name}\"" for name in cols)


# --- totals and rates -------------------------------------------------------

ORACLES["team_batting"] = f"{TEAM_H} SELECT {YT}, {_as(H_COLS)} FROM v"
ORACLES["team_pitching"] = f"{TEAM_P} SELECT {YT}, {_as(P_COLS)} FROM v"
ORACLES["career_batting"] = f'{CAREER_H} SELECT {KEY}, g AS "G", {_as(H_COLS | _H_EXTRA)} FROM v'
ORACLES["career_pitching"] = f"{CAREER_P} SELECT {KEY}, {_as(P_COLS)} FROM v"
_P_PLAYER = _pick(P_COLS, ["IP", "SO/IP", "BB/IP", "H/IP", "WHIP", "OBP"])
ORACLES["pitcher_rates"] = f"{PLAYER_P} SELECT {YK}, {_as(_P_PLAYER)} FROM v"
ORACLES["innings_decimal"] = f"WITH {PIT} SELECT {YK}, notation, ip AS decimal FROM pit"
ORACLES["innings_repair"] = f"WITH {PIT}, c AS {_p_group('team, name, no')} SELECT {KEY}, ip AS summed, {_REPAIRED} AS repaired FROM c"
ORACLES["roster_counts"] = f"WITH {BAT} SELECT {YT}, count(*) AS n FROM bat GROUP BY yr, team"
ORACLES["teams_in_list"] = (
    f"{TEAM_H} SELECT {YT}, {_as(H_COLS)} FROM v WHERE team IN (SELECT n_name FROM nation WHERE n_regionkey = 1)"
)

# --- ranks and orders -------------------------------------------------------

ORACLES["rank_batting"] = (
    f"{TEAM_H} SELECT {YT}, {_wide_ranks(H_COLS)} FROM {_ranked('yr, team', H_COLS, _H_LOW)} GROUP BY yr, team"
)
ORACLES["rank_pitching"] = (
    f"{TEAM_P} SELECT {YT}, {_wide_ranks(P_COLS)} FROM {_ranked('yr, team', P_COLS, _P_LOW)} GROUP BY yr, team"
)
_PK = "yr, team, name, no"
ORACLES["rank_players_batting"] = (
    f"{PLAYER_H} SELECT {YK}, {_wide_ranks(H_COLS)} FROM {_ranked(_PK, H_COLS, _H_LOW)} GROUP BY {_PK}"
)
ORACLES["rank_players_pitching"] = (
    f"{PLAYER_P} SELECT {YK}, {_wide_ranks(P_COLS)} FROM {_ranked(_PK, P_COLS, _P_LOW)} GROUP BY {_PK}"
)


def _top(head: str, cols: dict[str, str], low: tuple[str, ...]) -> str:
    return f'{head} SELECT {YK}, stat AS "Stat", val AS "Value", rk AS "Rank" FROM {_ranked(_PK, cols, low)} WHERE rk <= 10'


ORACLES["top_ranks_batting"] = _top(PLAYER_H, H_COLS, _H_LOW)
ORACLES["top_ranks_pitching"] = _top(PLAYER_P, P_COLS, _P_LOW)
_SHORT = "(SELECT n_name, CASE WHEN n_regionkey <> 0 THEN concat('T', CAST(n_nationkey AS VARCHAR)) END AS short FROM nation)"


def _matrix(head: str, cols: dict[str, str], low: tuple[str, ...], dropped: tuple[str, ...]) -> str:
    shown = {k: v for k, v in cols.items() if k not in dropped}
    return (
        f'{head}, r AS {_ranked("yr, team", cols, low)} SELECT yr AS "Year", any_value(short) AS team_eng, {_wide_ranks(shown)} '
        f"FROM r LEFT JOIN {_SHORT} d ON r.team = d.n_name GROUP BY yr, team"
    )


ORACLES["rank_matrix"] = _matrix(TEAM_H, H_COLS, _H_LOW, ("PA", "AB"))
ORACLES["rank_matrix_pitching"] = _matrix(TEAM_P, P_COLS, _P_LOW, ("BF", "AB"))
ORACLES["pinned_order"] = (
    f"WITH {BAT}, v AS {_h_rates(_h_group('team'))} "
    "SELECT team AS \"Team\", avg_ AS \"AVG\", pa AS \"PA\", contains(team, 'NATION_1') AS pinned FROM v "
    "ORDER BY pinned DESC, team"
)
ORACLES["team_order"] = (
    "SELECT n_name AS \"Team\" FROM nation ORDER BY CASE n_name WHEN 'NATION_1' THEN 0 WHEN 'NATION_7' THEN 1 ELSE 2 END, n_name"
)
ORACLES["leaderboard_batting"] = (
    f"{PLAYER_H} SELECT {YK}, {_as(_pick(H_COLS, ['PA', 'AVG', 'OBP', 'SLG', 'OPS']))} FROM v "
    "ORDER BY pa DESC NULLS LAST, avg_ DESC NULLS LAST, name, no"
)
ORACLES["leaderboard_pitching"] = (
    f"{CAREER_P} SELECT {KEY}, {_as(_pick(P_COLS, ['IP', 'ERA', 'WHIP', 'K9']))} FROM v "
    "ORDER BY ip DESC NULLS LAST, era DESC NULLS LAST, name, no"
)
ORACLES["top_n_per_team"] = f"""{CAREER_P}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY team
  ORDER BY ip DESC NULLS LAST, era DESC NULLS LAST, name, no) AS INT) AS place FROM v)
SELECT team AS "Team", place, name AS "Name", no AS "No", ip AS "IP", era AS "ERA" FROM p WHERE place <= 5"""

# --- profiles ---------------------------------------------------------------

PROFILE_H = H_COLS | _pick(_H_EXTRA, ["SB%", "BB/K", "XBH/H"])
PROFILE_P = P_COLS


def _placed(by: str, long: str) -> str:
    """Values with their 0-based place and the group size."""
    return (
        f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY val) - 1 AS place, count(*) OVER (PARTITION BY {by}) AS size "
        f"FROM {long} WHERE val IS NOT NULL)"
    )


def _quantile(q: float) -> str:
    """Linear interpolation between the two neighbouring places."""
    at = f"({q}e0 * (size - 1))"
    low, high = f"max(CASE WHEN place = floor({at}) THEN val END)", f"max(CASE WHEN place = ceil({at}) THEN val END)"
    if q == 0.5:
        return f"(({low} + {high}) / 2e0)"
    weight = f"(max({at}) - floor(max({at})))"
    return (
        f"(CASE WHEN {weight} < 0.5e0 THEN {low} + ({high} - {low}) * {weight} "
        f"ELSE {high} - ({high} - {low}) * (1e0 - {weight}) END)"
    )


_MEAN = "sum(CAST(round_even(val * 1e9, 0) AS HUGEINT))::DOUBLE / 1e9 / count(*)"


def _profile(head: str, source_long: str) -> str:
    return f"""{head}, q AS {_placed("yr, stat", source_long)}
SELECT yr AS "Year", stat AS "Stat", {_round(_MEAN, 3)} AS mean, {_round(_quantile(0.5), 3)} AS median FROM q GROUP BY yr, stat"""


ORACLES["league_mean_median"] = _profile(PLAYER_H, _long("yr", PROFILE_H))
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in PROFILE_P.values())
ORACLES["league_complete_rows"] = _profile(
    f"{PLAYER_P}, full_rows AS (SELECT * FROM v WHERE {_COMPLETE})", _long("yr", PROFILE_P, "full_rows")
)


def _describe(head: str, long: str, by: str, ids: str) -> str:
    """Compensated sums, and the deviation around the mean in a second pass."""

    def quartile(q: float) -> str:
        return _round(_quantile(q), 6)

    return f"""{head} q AS {_placed(by, long)},
m AS (SELECT {by}, favg(val) AS mean_ FROM q GROUP BY {by}),
d AS (SELECT q.*, mean_ FROM q JOIN m USING ({by}))
SELECT {ids} stat AS "Stat", count(*) AS count, {_round("any_value(mean_)", 8)} AS mean,
  {_round("sqrt(fsum((val - mean_) * (val - mean_)) / nullif(count(*) - 1, 0))", 6)} AS std,
  min(val) AS min, {quartile(0.25)} AS q25, {quartile(0.5)} AS q50, {quartile(0.75)} AS q75, max(val) AS max
FROM d GROUP BY {by}"""


FACTS = {c: c for c in ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]}
ORACLES["describe_batting"] = _describe(PLAYER_H + ",", _long("1 AS one", PROFILE_H), "stat", "")
ORACLES["describe_pitching"] = _describe(PLAYER_P + ",", _long("yr", PROFILE_P), "yr, stat", 'yr AS "Year",')
ORACLES["describe_by_team"] = _describe(PLAYER_H + ",", _long("yr, team", PROFILE_H), "yr, team, stat", 'yr AS "Year", team AS "Team",')


def _sketched(head: str, long: str) -> str:
    """What is exact of a sketched description; the quartiles lie at their ranks."""
    near = ", ".join(f"true AS q{q}_near" for q in (25, 50, 75))
    return f'{head} SELECT stat AS "Stat", count(*) AS count, min(val) AS min, max(val) AS max, {near} FROM {long} WHERE val IS NOT NULL GROUP BY stat'


ORACLES["approx_quartiles"] = _sketched(PLAYER_P, _long("1 AS one", PROFILE_P))
ORACLES["approx_facts"] = _sketched("", _long("1 AS one", FACTS, "lineitem"))
ORACLES["describe_facts"] = _describe("WITH", _long("1 AS one", FACTS, "lineitem"), "stat", "")


def _histogram(head: str, long: str, by: str, ids: str, bins: str) -> str:
    """Bins by comparing every value with every edge of its metric."""
    joined = " AND ".join(f"q.{k} = b.{k}" for k in by.split(", "))
    return f"""{head} q AS {_placed(by, long)},
s AS (SELECT {by}, count(*) AS size_, min(val) AS mn, max(val) AS mx, {_quantile(0.25)} AS q1, {_quantile(0.75)} AS q3 FROM q GROUP BY {by}),
e AS (SELECT *, CAST(greatest({bins}, 1) AS BIGINT) AS k,
  CASE WHEN mn = mx THEN mn - 0.5e0 ELSE mn END AS a, CASE WHEN mn = mx THEN mx + 0.5e0 ELSE mx END AS z FROM s),
b AS (SELECT *, (z - a) / k AS w, unnest(range(0, k)) AS bin FROM e),
f AS (SELECT *, a + bin * w AS lo, CASE WHEN bin = k - 1 THEN z ELSE a + (bin + 1) * w END AS hi FROM b)
SELECT {ids} b.stat AS "Stat", bin, {_round("any_value(lo)", 6)} AS lo, {_round("any_value(hi)", 6)} AS hi, count(q.val) AS n
FROM f b LEFT JOIN q ON {joined} AND q.val >= b.lo AND (q.val < b.hi OR (bin = k - 1 AND q.val <= b.hi))
GROUP BY {", ".join("b." + k for k in by.split(", "))}, bin"""


def _auto(whole: list[str]) -> str:
    width = (
        "least(greatest(2e0 * (q3 - q1) * pow(CAST(size_ AS DOUBLE), -1e0 / 3e0), (mx - mn) / (2e0 * sqrt(CAST(size_ AS DOUBLE)))), "
        "(mx - mn) / (log2(CAST(size_ AS DOUBLE)) + 1e0))"
    )
    if whole:
        listed = ", ".join(f"'{c}'" for c in whole)
        width = f"(CASE WHEN stat IN ({listed}) THEN greatest({width}, 1e0) ELSE {width} END)"
    return f"coalesce(ceil((mx - mn) / nullif({width}, 0)), 1)"


ORACLES["histogram_fixed"] = _histogram("WITH", _long("1 AS one", FACTS, "lineitem"), "stat", "", "10")
ORACLES["histogram_auto"] = _histogram(
    PLAYER_H + ",", _long("1 AS one", PROFILE_H), "stat", "", _auto([])
)
ORACLES["histogram_by_team"] = _histogram(
    PLAYER_H + ",", _long("team", _pick(PROFILE_H, ["AVG", "OPS", "PA"])), "team, stat", 'b.team AS "Team",', "10"
)
ORACLES["histogram_events"] = _histogram(
    "WITH", "(SELECT event_type, 'value' AS stat, value AS val FROM events)", "event_type, stat", "b.event_type,", _auto([])
)

_NEAR = "val >= q1 - 1.5e0 * (q3 - q1) AND val <= q3 + 1.5e0 * (q3 - q1)"


def _boxed(head: str, long: str, by: str) -> str:
    """One pass over the values: places, then quartiles and whiskers as windows over the group."""
    return f"""{head}, long AS MATERIALIZED {long}, q AS MATERIALIZED {_placed(by, "long")},
s AS MATERIALIZED (SELECT {by}, {_quantile(0.25)} AS q1, {_quantile(0.5)} AS med, {_quantile(0.75)} AS q3 FROM q GROUP BY {by}),
y AS MATERIALIZED (SELECT q.*, q1, med, q3 FROM q JOIN s USING ({by})),
x AS MATERIALIZED (SELECT *,
  least(q1, min(CASE WHEN {_NEAR} THEN val END) OVER g) AS wl,
  greatest(q3, max(CASE WHEN {_NEAR} THEN val END) OVER g) AS wh
  FROM y WINDOW g AS (PARTITION BY {by}))"""


def _box_rows(boxed: str, by: str, ids: str) -> str:
    return f"""{boxed} SELECT {ids}, stat AS "Stat", {_round("q1", 6)} AS q1, {_round("med", 6)} AS median,
  {_round("q3", 6)} AS q3, {_round("wl", 6)} AS whisker_lo, {_round("wh", 6)} AS whisker_hi,
  CAST(count_if(val < wl OR val > wh) AS BIGINT) AS outliers
FROM x GROUP BY {by}, q1, med, q3, wl, wh"""


_BOX = _boxed(PLAYER_P, _long(_PK, PROFILE_P), "yr, stat")
ORACLES["boxplot"] = _box_rows(_BOX, "yr, stat", 'yr AS "Year"')
ORACLES["boxplot_by_team"] = _box_rows(_boxed(PLAYER_H, _long("team", PROFILE_H), "team, stat"), "team, stat", 'team AS "Team"')
ORACLES["outliers"] = f'{_BOX} SELECT {YK}, stat AS "Stat", val AS "Value" FROM x WHERE val < wl OR val > wh'

# --- reshaping and comparison -----------------------------------------------

_YTSV = f'{YT}, stat AS "Stat", val AS "Value"'
ORACLES["to_long"] = f"{TEAM_H} SELECT {_YTSV} FROM {_long('yr, team', H_COLS)}"
_TEAM_COLUMNS = ", ".join(f"max(CASE WHEN team = 'NATION_{i}' THEN val END) AS \"NATION_{i}\"" for i in range(25))
ORACLES["transpose_stats"] = (
    f"WITH {BAT}, v AS {_h_rates(_h_group('team'))} SELECT stat AS \"Stat\", {_TEAM_COLUMNS} FROM {_long('team', H_COLS)} GROUP BY stat"
)


def _scaled(cols: dict[str, str]) -> str:
    return f"""(SELECT yr, team, stat, CASE WHEN mx = mn THEN CASE WHEN val IS NOT NULL THEN 0e0 END ELSE (val - mn) / (mx - mn) END AS val
      FROM (SELECT *, min(val) OVER (PARTITION BY yr, stat) AS mn, max(val) OVER (PARTITION BY yr, stat) AS mx FROM {_long('yr, team', cols)}))"""


_COMPARE_H = _pick(H_COLS, ["AVG", "OBP", "OPS", "BB", "SO", "SB"])
_COMPARE_P = _pick(P_COLS, ["ERA", "WHIP", "H/IP", "BB/IP", "SO/IP", "BAA"])
_TWO = "WHERE team IN ('NATION_1', 'NATION_7')"
ORACLES["minmax_scale"] = f"{TEAM_P} SELECT {_YTSV} FROM {_scaled(P_COLS)}"
ORACLES["compare_two"] = f"{TEAM_H} SELECT {_YTSV} FROM {_scaled(_COMPARE_H)} {_TWO}"
ORACLES["compare_two_table"] = f"{TEAM_H} SELECT {YT}, {_as(_COMPARE_H)} FROM v {_TWO} ORDER BY yr, team"
ORACLES["compare_all"] = f"{TEAM_H} SELECT {_YTSV} FROM {_scaled(_COMPARE_H)}"
ORACLES["compare_two_pitching"] = f"{TEAM_P} SELECT {_YTSV} FROM {_scaled(_COMPARE_P)} {_TWO}"
ORACLES["compare_two_pitching_table"] = f"{TEAM_P} SELECT {YT}, {_as(_COMPARE_P)} FROM v {_TWO} ORDER BY yr, team"
ORACLES["compare_all_pitching"] = f"{TEAM_P} SELECT {_YTSV} FROM {_scaled(_COMPARE_P)}"
_SHEET_H = _ranked("yr, team", H_COLS, _H_LOW)
ORACLES["team_sheet"] = f'{TEAM_H} SELECT {_YTSV}, rk AS "Rank" FROM {_SHEET_H}'
ORACLES["team_sheet_pitching"] = f'{TEAM_P} SELECT {_YTSV}, rk AS "Rank" FROM {_ranked("yr, team", P_COLS, _P_LOW)}'
ORACLES["value_rank_rows"] = f"""{TEAM_H}, r AS {_SHEET_H}
SELECT {YT}, stat AS "Stat", '기록' AS row, val AS "Value" FROM r
UNION ALL SELECT {YT}, stat AS "Stat", '순위' AS row, CAST(rk AS DOUBLE) AS "Value" FROM r"""

H_LABELS = {
    "AVG": "타율", "PA": "타석", "AB": "타수", "H": "총안타", "RBI": "타점", "R": "득점", "OBP": "출루율", "SLG": "장타율",
    "OPS": "OPS", "SO": "삼진", "BB": "볼넷", "SB": "도루", "MHit": "멀티히트", "1B": "1루타", "2B": "2루타", "3B": "3루타",
    "HR": "홈런", "TB": "루타", "CS": "도실", "SH": "희타", "SF": "희비", "IBB": "고의4구", "HBP": "사구", "DP": "병살",
}
P_LABELS = {
    "IP": "이닝", "ERA": "방어율", "WHIP": "WHIP", "H/IP": "H/IP", "BB/IP": "BB/IP", "SO/IP": "SO/IP", "BAA": "피안타율",
    "OBP": "피출루율", "G": "경기수", "W": "승", "L": "패", "SV": "세", "HLD": "홀드", "SO": "탈삼진", "BF": "타자",
    "AB": "타수", "P": "투구수", "HA": "피안타", "HR": "피홈런", "SH": "희타", "SF": "희비", "BB": "볼넷", "IBB": "고의4구",
    "HBP": "사구", "WP": "폭투", "BK": "보크", "R": "실점", "ER": "자책점", "K9": "탈삼진율",
}


def _cases(values: dict[str, object], text: bool) -> str:
    return "CASE stat " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if text else str(v)) for k, v in values.items()) + " END"


def _joined(text: str, cols: dict[str, str]) -> str:
    place = _cases({k: i for i, k in enumerate(cols)}, False)
    return f"string_agg({text}, ', ' ORDER BY {place})"


def _digest(head: str, cols: dict[str, str], low: tuple[str, ...], names: dict[str, str]) -> str:
    entry = f"concat({_cases(names, True)}, ': ', coalesce(CAST(val AS VARCHAR), '-'), ' [', coalesce(CAST(rk AS VARCHAR), '-'), '위]')"
    return f"{head} SELECT {YT}, {_joined(entry, cols)} AS digest FROM {_ranked('yr, team', cols, low)} GROUP BY yr, team"


ORACLES["team_digest"] = _digest(TEAM_H, H_COLS, _H_LOW, H_LABELS)
ORACLES["team_digest_pitching"] = _digest(TEAM_P, P_COLS, _P_LOW, P_LABELS)

_FULL_P = f"{PLAYER_P}, full_rows AS (SELECT * FROM v WHERE {_COMPLETE})"


def _league(head: str, long: str) -> str:
    return f"""{head}, q AS {_placed("yr, stat", long)},
m AS (SELECT yr, stat, {_round(_MEAN, 3)} AS mean, {_round(_quantile(0.5), 3)} AS median FROM q GROUP BY yr, stat)"""


def _league_digest(league: str, cols: dict[str, str], names: dict[str, str]) -> str:
    def line(column: str) -> str:
        return _joined(f"concat({_cases(names, True)}, ': ', CAST({column} AS VARCHAR))", cols) + f" AS {column}s"

    return f'{league} SELECT yr AS "Year", {line("mean")}, {line("median")} FROM m GROUP BY yr'


def _league_context(league: str, cols: dict[str, str], names: dict[str, str]) -> str:
    medians = "concat_ws(',', " + ", ".join(f"CAST(max(CASE WHEN stat = '{k}' THEN median END) AS VARCHAR)" for k in cols) + ")"
    titles = ",".join(names[k] for k in cols)
    return f"{league} SELECT yr AS \"Year\", concat('{titles}', chr(10), {medians}, chr(10)) AS context FROM m GROUP BY yr"


_LEAGUE_H, _LEAGUE_P = _league(PLAYER_H, _long("yr", H_COLS)), _league(_FULL_P, _long("yr", P_COLS, "full_rows"))
ORACLES["league_digest"] = _league_digest(_LEAGUE_H, H_COLS, H_LABELS)
ORACLES["league_digest_pitching"] = _league_digest(_LEAGUE_P, P_COLS, P_LABELS)
ORACLES["median_context"] = _league_context(_LEAGUE_H, H_COLS, H_LABELS)
ORACLES["median_context_pitching"] = _league_context(_LEAGUE_P, P_COLS, P_LABELS)


def _contexts(head: str, cols: dict[str, str], first: str, by: str) -> str:
    shown = {"No": "no", "Name": "name"} | cols
    line = "concat_ws(',', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in shown.values()) + ")"
    text = f"concat('{','.join(shown)}', chr(10), string_agg({line}, chr(10) ORDER BY place), chr(10)) AS context"
    order = f"ORDER BY {first} DESC NULLS LAST, name, no, yr"
    part, ids, group = (f"PARTITION BY {by} ", f'{by} AS "Team", ', f" GROUP BY {by}") if by else ("", "", "")
    return f"{head}, p AS (SELECT *, row_number() OVER ({part}{order}) AS place FROM v) SELECT {ids}{text} FROM p WHERE place <= 30{group}"


_FIRST_H, _FIRST_P = "pa DESC NULLS LAST, avg_", "ip DESC NULLS LAST, era"
ORACLES["team_context"] = _contexts(PLAYER_H, H_COLS, _FIRST_H, "team")
ORACLES["team_context_pitching"] = _contexts(PLAYER_P, P_COLS, _FIRST_P, "team")
ORACLES["league_context"] = _contexts(PLAYER_H, H_COLS, _FIRST_H, "")
ORACLES["league_context_pitching"] = _contexts(PLAYER_P, P_COLS, _FIRST_P, "")

# --- schedule ---------------------------------------------------------------

_AWAY, _HOME = "o_orderkey % 9", f"{_PRICE} % 9"
RAW_SCHEDULE = f"""
raw AS (
  SELECT o_orderkey AS game_id, CAST(o_orderdate AS VARCHAR) AS dt, concat('park', CAST(o_orderkey % 7 AS VARCHAR), '야구장') AS venue,
    CASE WHEN o_orderstatus = 'P' THEN '게임대기' ELSE '종료' END AS status,
    CASE WHEN o_orderstatus = 'P' THEN concat_ws(chr(10), a.n_name, '', 'x', 'x', 'x', b.n_name)
      ELSE concat_ws(chr(10), a.n_name,
        concat(CASE WHEN {_AWAY} - {_HOME} >= 6 THEN '콜드승 ' WHEN o_orderkey % 29 = 0 THEN '기권승 ' ELSE '' END, CAST({_AWAY} AS VARCHAR)),
        'x', 'x', 'x', b.n_name,
        concat(CASE WHEN {_HOME} - {_AWAY} >= 6 THEN '콜드승 ' ELSE '' END, CAST({_HOME} AS VARCHAR))) END AS game
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey
    JOIN nation b ON (c_nationkey + 1 + o_orderkey % 24) % 25 = b.n_nationkey)"""


def _score(at: int) -> str:
    bare = f"replace(replace(replace(t[{at}], '콜드승 ', ''), '기권승 ', ''), '몰수승 ', '')"
    return f"coalesce(CAST(nullif(trim({bare}), '') AS INT), 0)"


GAMES = f"""WITH {RAW_SCHEDULE},
tokens AS (SELECT *, string_split(game, chr(10)) AS t FROM raw),
games AS (SELECT game_id, dt AS date, replace(venue, '야구장', '') AS venue, t[1] AS away, {_score(2)} AS away_score,
  t[6] AS home, {_score(7)} AS home_score, status, coalesce(contains(t[2], '콜드승'), false) AS away_called,
  coalesce(contains(t[7], '콜드승'), false) AS home_called FROM tokens),
won AS (SELECT *, CASE WHEN away_score > home_score THEN away WHEN away_score < home_score THEN home END AS winner,
  CASE WHEN away_score > home_score THEN away_called WHEN away_score < home_score THEN home_called ELSE false END AS called FROM games),
res AS (SELECT *, CASE WHEN winner IS NOT NULL THEN concat(winner, '_', CASE WHEN called THEN '콜드승' ELSE '승' END)
  WHEN status <> '게임대기' THEN '무' ELSE '경기전' END AS result FROM won)"""


def _seen(team: str) -> str:
    return (
        f"CASE WHEN winner = {team} AND called THEN '콜드승' WHEN winner = {team} THEN '승' WHEN winner IS NOT NULL AND NOT called THEN '패' "
        "WHEN winner IS NOT NULL THEN '콜드패' ELSE result END"
    )


_SHOWN = "game_id, date, venue, away, away_score, home, home_score"
ORACLES["schedule_parse"] = f"{GAMES} SELECT {_SHOWN}, status, away_called, home_called, CAST(NULL AS VARCHAR) AS error FROM games"
_FINE = "CAST(NULL AS VARCHAR) AS error"
ORACLES["schedule_results"] = f"{GAMES} SELECT {_SHOWN}, result, {_FINE} FROM res ORDER BY date, venue, away, home"
ORACLES["schedule_own_results"] = f"{GAMES} SELECT {_SHOWN}, {_seen(chr(39) + 'NATION_1' + chr(39))} AS result, {_FINE} FROM res ORDER BY date, venue, away, home"
_SIDES = f"""(SELECT game_id, date, venue, away, home, away AS team, home AS opponent, away_score AS runs_for, home_score AS runs_against, winner, called, result FROM res
  UNION ALL SELECT game_id, date, venue, away, home, home, away, home_score, away_score, winner, called, result FROM res)"""
ORACLES["results_by_team"] = (
    f"{GAMES} SELECT game_id, date, venue, team, opponent, runs_for, runs_against, {_seen('team')} AS result FROM {_SIDES}"
)
ORACLES["next_game"] = f"""{GAMES} SELECT date, venue, away, home, opponent FROM {_SIDES}
WHERE team = 'NATION_1' AND result = '경기전' ORDER BY date, venue, away, home LIMIT 1"""
ORACLES["next_games"] = f"""{GAMES} SELECT team, date, venue, away, home, opponent FROM
(SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, venue, away, home, opponent) AS place FROM {_SIDES} WHERE result = '경기전') WHERE place = 1"""
ORACLES["schedule_pages"] = f"{GAMES} SELECT date, venue, away, away_score, home, home_score, result, {_FINE} FROM res"

# --- cleaning and naming ----------------------------------------------------

_CELL = "concat('A 선수', CAST(c_custkey AS VARCHAR), CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE concat('(', lpad(CAST(c_custkey AS VARCHAR), 7, '0'), ')') END)"
ORACLES["name_split"] = f"""SELECT c_custkey, nullif(regexp_extract(cell, '([\\p{{L}}\\p{{N}}_]+)\\((\\d+)\\)', 1), '') AS "Name",
  CASE WHEN regexp_matches(cell, '[\\p{{L}}\\p{{N}}_]+\\(\\d+\\)') THEN CAST(CAST(regexp_extract(cell, '([\\p{{L}}\\p{{N}}_]+)\\((\\d+)\\)', 2) AS INT) AS VARCHAR) END AS "No",
  CASE WHEN NOT regexp_matches(cell, '[\\p{{L}}\\p{{N}}_]+\\(\\d+\\)') THEN concat('name cell: ', cell) END AS error
FROM (SELECT c_custkey, {_CELL} AS cell FROM customer)"""
_HEADERS = {
    "성명": "name", "배번": "no", "경기": "g", "타석": "pa", "타수": "ab", "득점": "r", "총안타": "h", "1루타": "b1", "2루타": "b2",
    "3루타": "b3", "홈런": "hr", "루타": "tb", "타점": "rbi", "도루": "sb", "도실(도루자)": "cs", "희타": "sh", "희비": "sf",
    "볼넷": "bb", "고의4구": "ibb", "사구": "hbp", "삼진": "so", "병살": "dp", "멀티히트": "mhit", "팀": "team",
}
ORACLES["header_normalize"] = (
    f'WITH {BAT} SELECT yr AS "Year", ' + ", ".join(f'CAST({c} AS VARCHAR) AS "{h}"' for h, c in _HEADERS.items()) + " FROM bat"
)
_TYPED = {"G": "g"} | H_COLS | _H_EXTRA
_CHANGED = {
    "AVG": "CASE WHEN bb = 3 THEN NULL ELSE avg_ END",
    "PA": "CASE WHEN hr = 0 THEN pa * 1000 + 7 ELSE pa END",
    "H": "CASE WHEN pa % 11 = 0 THEN NULL ELSE h END",
}
ORACLES["conform"] = f"""{PLAYER_H} SELECT {YK}, {_as(_TYPED | _CHANGED)},
  CASE WHEN pa % 11 = 0 THEN '총안타 is not bigint: x' END AS error FROM v"""
ORACLES["null_sentinels"] = f"""{CAREER_P} SELECT {KEY}, CAST(era AS VARCHAR) AS "ERA", CASE WHEN sv = 0 THEN NULL ELSE CAST(sv AS VARCHAR) END AS "SV" FROM v"""
ORACLES["relabel"] = (
    f'{TEAM_H} SELECT yr AS "Year", team AS "팀", ' + ", ".join(f'{c} AS "{H_LABELS[n]}"' for n, c in H_COLS.items()) + " FROM v"
)
ORACLES["relabel_pitching"] = (
    f'{TEAM_P} SELECT yr AS "Year", team AS "팀", ' + ", ".join(f'{c} AS "{P_LABELS[n]}"' for n, c in P_COLS.items()) + " FROM v"
)
ORACLES["team_lookup"] = f"""WITH {PIT} SELECT team AS "Team", count(*) AS n, any_value(short) AS team_eng, coalesce(any_value(short), team) AS shown
FROM pit LEFT JOIN {_SHORT} d ON team = n_name GROUP BY team"""
ORACLES["multi_season_union"] = f"""WITH {BAT}, {PIT}
SELECT {YK}, pa AS "PA", h AS "H", CAST(NULL AS DOUBLE) AS "IP", CAST(NULL AS BIGINT) AS "ER" FROM bat
UNION ALL SELECT {YK}, NULL, NULL, ip, er FROM pit"""
ORACLES["format_stat_text"] = f"""{CAREER_P} SELECT {KEY}, stat AS "Stat",
  CASE WHEN val = round(val) THEN CAST(CAST(val AS BIGINT) AS VARCHAR) ELSE format('{{:.3f}}', val) END AS text
FROM {_long('team, name, no', P_COLS)}"""

# --- pages and snapshots ----------------------------------------------------

_CELLS = {
    "타율": "avg_", "게임수": "g", "타석": "pa", "타수": "ab", "득점": "r", "총안타": "h", "1루타": "b1", "2루타": "b2",
    "3루타": "b3", "홈런": "hr", "루타": "tb", "타점": "rbi", "도루": "sb", "도실 (도루자)": "cs", "희타": "sh",
    "희비": "sf", "볼넷": "bb", "고의4구": "ibb", "사구": "hbp", "삼진": "so", "병살": "dp", "장타율": "slg",
    "출루율": "obp", "도루성공률": "sbp", "멀티히트": "mhit", "OPS": "ops", "BB/K": "bb_k", "장타/안타": "xbh_h",
}
_PAGE_CELLS = (
    "'1' AS \"순위\", concat('P', no, '(', no, ')') AS \"이름\", "
    + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS \"{h}\"" for h, c in _CELLS.items())
    + ", CAST(NULL AS VARCHAR) AS error"
)
ORACLES["extract_hitter_pages"] = f"{PLAYER_H} SELECT {YT}, CAST(0 AS INT) AS table_no, {_PAGE_CELLS} FROM v"
ORACLES["folder_of_pages"] = f"{PLAYER_H} SELECT {YT}, {_PAGE_CELLS} FROM v"
ORACLES["extract_raw_pages"] = """SELECT page_id, url, CAST(NULL AS INT) AS table_no, CAST(NULL AS INT) AS row_no, 'no table found' AS error
FROM pages WHERE NOT contains(lower(html), '<table')"""
_RECORD = {"G": "g"} | H_COLS | _H_EXTRA
_FROM_PAGES = f"concat('P', no) AS \"Name\", no AS \"No\", team AS \"Team\", {_as(_RECORD)}"
ORACLES["typed_hitter_pages"] = f'{PLAYER_H} SELECT yr AS "Year", {_FROM_PAGES} FROM v'
ORACLES["season_or_build"] = ORACLES["typed_hitter_pages"]
_CAREER_PAGES = f'team AS "Team", concat(\'P\', no) AS "Name", no AS "No", {_as(_RECORD)}'
ORACLES["career_from_snapshots"] = f"{CAREER_H} SELECT {_CAREER_PAGES} FROM v"
_P_RECORD = {k: v for k, v in P_COLS.items() if k not in ("H/IP", "BB/IP", "SO/IP", "OBP")}
ORACLES["snapshot_roundtrip"] = f'{PLAYER_P} SELECT {YK}, {_as(_P_RECORD)}, CAST(NULL AS DOUBLE) AS "WPCT" FROM v'

# --- player lists -----------------------------------------------------------

ORACLES["player_list_batting"] = f"{PLAYER_H} SELECT {YK}, {_as(H_COLS)} FROM v"
ORACLES["player_list_pitching"] = f"{PLAYER_P} SELECT {YK}, {_as(P_COLS)} FROM v"
_LABELLED = ", ".join(f'{c} AS "{H_LABELS[n]}"' for n, c in H_COLS.items())
ORACLES["player_list_career_batting"] = f'{CAREER_H} SELECT team AS "팀", no AS "배번", name AS "성명", {_LABELLED} FROM v'
ORACLES["player_list_career_pitching"] = f"""{CAREER_P} SELECT no AS "No", name AS "Name", {_as(P_COLS)} FROM v WHERE team = 'NATION_1'"""

# --- loads, views and versions ----------------------------------------------

ORACLES["typed_pitcher_pages"] = f"""{PLAYER_P} SELECT yr AS "Year", concat('P', no) AS "Name", no AS "No", team AS "Team",
  {_as(_P_RECORD)}, CAST(NULL AS DOUBLE) AS "WPCT" FROM v"""
_LOST, _UNREAD = "(team LIKE '%1' AND yr % 3 = 0)", "(no LIKE '%7' OR no LIKE '%3')"
_PAGE = "(team, yr, CAST(no AS INT) // 200)"
# A page without a table has neither a name cell.
_NO_TABLE = "no table found; name cell: none"


def _load_errors(head: str, first: str) -> str:
    """Rows of sound pages whose number ends in 7 or 3, and a row for each lost page."""
    return f"""{head} SELECT {YT}, CASE WHEN no LIKE '%3' THEN concat('P', no) END AS "Name", CASE WHEN no LIKE '%3' THEN no END AS "No",
  CASE WHEN no LIKE '%7' THEN concat('name cell: P', no) ELSE '{first} is not double: x' END AS error FROM v WHERE NOT {_LOST} AND {_UNREAD}
UNION ALL SELECT yr, team, NULL, NULL, '{_NO_TABLE}' FROM (SELECT DISTINCT team, yr, CAST(no AS INT) // 200 AS block FROM v WHERE {_LOST})"""


ORACLES["load_errors"] = _load_errors(PLAYER_H, "타율")
ORACLES["load_errors_pitching"] = _load_errors(PLAYER_P, "방어율")
ORACLES["quarantined_errors"] = f"""{PLAYER_H}, e AS (SELECT *,
  CASE WHEN no LIKE '%7' THEN concat('name cell: P', no) ELSE '타율 is not double: x' END AS error FROM v WHERE NOT {_LOST} AND {_UNREAD})
SELECT team AS "Team", yr AS "Year", error, count(*) AS n FROM e GROUP BY team, yr, error"""
_LOST_PAGES = f"count(DISTINCT CASE WHEN {_LOST} THEN {_PAGE} END)"
_REPORT = {
    "pages": f"count(DISTINCT {_PAGE})",
    "records": f"count_if(NOT {_LOST} AND NOT {_UNREAD})",
    "errors": f"count_if(NOT {_LOST} AND {_UNREAD}) + {_LOST_PAGES}",
    "no table": _LOST_PAGES,
    "name cell": f"count_if(NOT {_LOST} AND no LIKE '%7') + {_LOST_PAGES}",
    "wrong type": f"count_if(NOT {_LOST} AND no LIKE '%3')",
    "no rows": "0", "no column": "0", "column twice": "0", "no team": "0", "unreadable": "0",
}
ORACLES["load_report"] = f"{PLAYER_H} " + " UNION ALL ".join(
    f"SELECT '{name}' AS measure, CAST({n} AS BIGINT) AS n" + (" FROM v" if n != "0" else "")
    for name, n in _REPORT.items()
)


def _season_view(base: str, players: str, teams: str, cols: dict[str, str], low: tuple[str, ...], profiled: str) -> str:
    """Players, teams, ranks and league values of every season in one long table."""
    return f"""WITH {base}, pv AS {players}, v AS {teams}, q AS {_placed("yr, stat", _long("yr", cols, profiled))},
m AS (SELECT yr, stat, {_round(_MEAN, 3)} AS mean, {_round(_quantile(0.5), 3)} AS median FROM q GROUP BY yr, stat),
r AS {_ranked("yr, team", cols, low)}
SELECT 'player' AS part, yr AS "Year", team AS "Team", concat('P', no) AS "Name", no AS "No", stat AS "Stat", val AS "Value"
FROM {_long(_PK, cols, "pv")}
UNION ALL SELECT 'team', yr, team, NULL, NULL, stat, val FROM r
UNION ALL SELECT 'rank', yr, team, NULL, NULL, stat, CAST(rk AS DOUBLE) FROM r
UNION ALL SELECT 'mean', yr, NULL, NULL, NULL, stat, mean FROM m
UNION ALL SELECT 'median', yr, NULL, NULL, NULL, stat, median FROM m"""


ORACLES["season_view_batting"] = _season_view(BAT, _h_rates("bat"), _h_rates(_h_group("yr, team")), H_COLS, _H_LOW, "pv")
ORACLES["season_view_pitching"] = _season_view(
    PIT, _p_rates("pit"), _p_rates(_p_group("yr, team")), P_COLS, _P_LOW, f"(SELECT * FROM pv WHERE {_COMPLETE})"
)
_MORE_WINS = "CASE WHEN yr = 1995 THEN w + 1 ELSE w END"
ORACLES["snapshot_versions"] = f"""{PLAYER_P} SELECT {YK}, w AS "W", l AS "L", ip AS "IP", CAST(1 AS INT) AS version FROM v
UNION ALL SELECT yr, team, name, no, {_MORE_WINS}, l, ip, CAST(2 AS INT) FROM v"""


def _later(sql: str) -> str:
    """The pitchers with one season replaced."""
    return sql.replace("pit AS (SELECT *,", f"pit AS (SELECT * REPLACE ({_MORE_WINS} AS w),")


ORACLES["career_from_partials"] = f"{_later(CAREER_P)} SELECT {KEY}, {_as(P_COLS)} FROM v"
ORACLES["career_from_buckets"] = ORACLES["career_from_partials"]
ORACLES["snapshot_sketches"] = f"""{_later(PLAYER_P)} SELECT team AS "Team", stat AS "Stat", count(*) AS count, min(val) AS min, max(val) AS max
FROM {_long("team", _P_RECORD)} WHERE val IS NOT NULL GROUP BY team, stat"""
