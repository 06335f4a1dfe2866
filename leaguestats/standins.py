"""Player, schedule and page frames derived from the sample star schema.

The sample tables hold no league records, so these mappings stand in for them
in the registered queries and the benchmark: a supplier or customer is a player,
a nation a team, a ship or order year a season.  Each one aggregates the fact
table by its own key first and joins the names to the much smaller result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.exprs import innings_to_decimal
from .functions.schemas import COLUMNS, HITTER, PITCHER, SCHEDULE, labels

# Rows per rendered page at most: players and games are paged by number.
PAGE_SPAN = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def batting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hitter seasons with the summed columns of the declared schema."""
    at_bat = F.col("l_linenumber") <= 5
    hit = at_bat & (F.col("l_returnflag") == "R")
    quantity, sixth, seventh = F.col("l_quantity"), F.col("l_linenumber") == 6, F.col("l_linenumber") == 7
    opened, filled = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
    seasons = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("Year"))
        .agg(
            _count_if(F.col("l_linenumber") == 1, "G"),
            F.count(F.lit(1)).alias("PA"),
            _count_if(at_bat, "AB"),
            _count_if((F.col("l_linenumber") <= 3) & opened, "R"),
            _count_if(hit, "H"),
            _count_if(hit & (quantity <= 30), "1B"),
            _count_if(hit & (quantity > 30) & (quantity <= 40), "2B"),
            _count_if(hit & (quantity > 40) & (quantity <= 45), "3B"),
            _count_if(hit & (quantity > 45), "HR"),
            _count_if(hit & (F.col("l_discount") >= 0.05), "RBI"),
            _count_if(F.col("l_tax") >= 0.06, "SB"),
            _count_if(F.col("l_tax") < 0.01, "CS"),
            _count_if(seventh & filled, "SH"),
            _count_if(seventh & opened, "SF"),
            _count_if(sixth & opened, "BB"),
            _count_if(sixth & opened & (F.col("l_tax") >= 0.07), "IBB"),
            _count_if(sixth & filled, "HBP"),
            _count_if(at_bat & (F.col("l_returnflag") == "N") & (F.col("l_discount") > 0.05), "SO"),
            _count_if(at_bat & (F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.08), "DP"),
            _count_if((F.col("l_linenumber") == 1) & hit, "MHit"),
        )
        .withColumn("TB", F.col("1B") + 2 * F.col("2B") + 3 * F.col("3B") + 4 * F.col("HR"))
    )
    players = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return seasons.join(players, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("n_name").alias("Team"),
        F.col("s_name").alias("Name"),
        F.col("s_suppkey").cast("string").alias("No"),
        "Year",
        *[c for c in seasons.columns if c not in ("l_suppkey", "Year")],
    )


def pitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitcher seasons; ``notation`` holds the innings as a page prints them."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")

    def every(n: int, name: str) -> Column:
        return _count_if(key % n == 0, name)

    seasons = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("Year"))
        .agg(
            F.count(F.lit(1)).alias("G"),
            _count_if(F.col("o_orderstatus") == "F", "W"),
            _count_if(F.col("o_orderstatus") == "P", "L"),
            _count_if(F.col("o_orderpriority") == "1-URGENT", "SV"),
            _count_if(F.col("o_orderpriority") == "2-HIGH", "HLD"),
            F.sum(price % 7).alias("outs"),
            F.sum(price % 7 + key % 3).alias("AB"),
            F.sum(50 + key % 23).alias("P"),
            F.sum(key % 3).alias("HA"),
            every(17, "HR"),
            every(19, "SH"),
            every(13, "SF"),
            every(5, "BB"),
            every(23, "IBB"),
            every(11, "HBP"),
            F.sum(key % 4).alias("SO"),
            every(29, "WP"),
            every(31, "BK"),
            F.sum(key % 2 + F.when(key % 4 == 0, 1).otherwise(0)).alias("R"),
            F.sum(key % 2).alias("ER"),
        )
        .withColumn("BF", F.col("AB") + F.col("BB") + F.col("HBP") + F.col("SF") + F.col("SH"))
        .withColumn("notation", F.floor(F.col("outs").cast("double") / 3.0) + (F.col("outs") % 3).cast("double") / 10.0)
        .withColumn("IP", innings_to_decimal(F.col("notation")))
    )
    players = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return seasons.join(players, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("n_name").alias("Team"),
        F.col("c_name").alias("Name"),
        F.col("c_custkey").cast("string").alias("No"),
        "Year",
        *[c for c in seasons.columns if c not in ("o_custkey", "Year")],
    )


def raw_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw schedule row per order, under the page headers."""
    key, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    away_runs, home_runs = key % 9, price % 9
    waiting = F.col("o_orderstatus") == "P"
    away_word = F.when(away_runs - home_runs >= 6, "콜드승 ").when(key % 29 == 0, "기권승 ").otherwise("")
    home_word = F.when(home_runs - away_runs >= 6, "콜드승 ").otherwise("")
    filler = [F.lit("x")] * 3
    nation = table(spark, sf_dir, "nation")
    away = nation.select(F.col("n_nationkey").alias("away_key"), F.col("n_name").alias("away_team"))
    home = nation.select(F.col("n_nationkey").alias("home_key"), F.col("n_name").alias("home_team"))
    games = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(away, F.col("c_nationkey") == F.col("away_key"))
        .join(home, (F.col("c_nationkey") + 1 + key % 24) % 25 == F.col("home_key"))
    )
    pending = F.concat_ws("\n", F.col("away_team"), F.lit(""), *filler, F.col("home_team"))
    played = F.concat_ws(
        "\n",
        F.col("away_team"),
        F.concat(away_word, away_runs.cast("string")),
        *filler,
        F.col("home_team"),
        F.concat(home_word, home_runs.cast("string")),
    )
    return games.select(
        key.alias("game_id"),
        F.col("o_orderdate").cast("string").alias("일시"),
        F.concat(F.lit("park"), (key % 7).cast("string"), F.lit("야구장")).alias("구장"),
        F.lit("리그").alias("분류"),
        F.when(waiting, pending).otherwise(played).alias("게임"),
        F.when(waiting, "게임대기").otherwise("종료").alias("결과"),
    )


def _row(cells: list[Column], tag: str = "td", escape: bool = True) -> Column:
    """One table row; cells of numbers need no ``escape``."""
    parts = [F.lit("<tr>")]
    for cell in cells:
        text = F.coalesce(cell, F.lit("-"))
        for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) if escape else ():
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        parts += [F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>")]
    return F.concat(*parts, F.lit("</tr>\n"))


def _page(rows: DataFrame, by: list[str], headings: list[str], css_class: str) -> DataFrame:
    """Rows (at, row) to pages; ``by`` holds a number block, so a page is bounded.

    The partition number is given because parsing pages costs far more than
    their bytes suggest: adaptive execution would merge them onto one task.
    """
    spark = rows.sparkSession
    spread = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    head = "".join(f"<th>{h}</th>" for h in headings)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"]), "")
    html = F.concat(
        F.lit(f'<html><body><table class="{css_class}"><thead><tr>{head}</tr></thead><tbody>\n'),
        body,
        F.lit("</tbody></table></body></html>"),
    )
    return spread.groupBy(*by).agg(html.alias("html"))


# Page columns of a rendered hitter row: name cell and rank number come first,
# the header variant for games and a header with a space are on purpose.
_RENDERED = ["AVG", "G", "PA", "AB", "R", "H", "1B", "2B", "3B", "HR", "TB", "RBI", "SB", "CS", "SH", "SF", "BB",
             "IBB", "HBP", "SO", "DP", "SLG", "OBP", "SB%", "MHit", "OPS", "BB/K", "XBH/H"]


def _record_pages(records: DataFrame, kind: str, rendered: list[str], headings: list[str], texts: dict[str, Column]) -> DataFrame:
    """Records to pages (Team, Year, block, kind, html); a page covers one team, season and block of numbers."""
    cells = [F.lit("1"), F.concat(F.lit("P"), F.col("No"), F.lit("("), F.col("No"), F.lit(")"))]
    rows = records.select(
        "Team",
        "Year",
        F.floor(F.col("No").cast("bigint") / PAGE_SPAN).alias("block"),
        F.col("No").cast("bigint").alias("at"),
        _row(cells + [texts.get(c, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rendered], escape=False).alias("row"),
    )
    return _page(rows, ["Team", "Year", "block"], ["순위", "이름", *headings], "record").withColumn("kind", F.lit(kind))


def hitter_pages(records: DataFrame) -> DataFrame:
    """Hitter seasons with rates to pages."""
    names = labels(HITTER) | {"G": "게임수", "CS": "도실 (도루자)"}
    return _record_pages(records, HITTER, _RENDERED, [names[c] for c in _RENDERED], {})


def pitcher_pages(records: DataFrame) -> DataFrame:
    """Pitcher seasons with rates and innings in notation to pages; an ERA without innings is a dash."""
    rendered = [name for _, name, type_ in COLUMNS[PITCHER] if type_ != "string"]
    headings = [header for header, _, type_ in COLUMNS[PITCHER] if type_ != "string"]
    headings = ["게임수" if h == "경기수" else h for h in headings]
    texts = {"ERA": F.col("ERA").cast("string"), "IP": F.col("notation").cast("string"), "WPCT": F.lit("")}
    return _record_pages(records, PITCHER, rendered, headings, texts)


def damaged_pages(pages: DataFrame) -> DataFrame:
    """The pages with what goes wrong on the way: a third of the seasons' teams without a table, names without a number, a rate that is no number."""
    html = F.regexp_replace("html", r"<td>P(\d*7)\(\d+\)</td>", "<td>P$1</td>")
    html = F.regexp_replace(html, r"<td>P(\d*3)\((\d+)\)</td><td>[^<]*</td>", "<td>P$1($2)</td><td>x</td>")
    lost = F.col("Team").endswith("1") & (F.col("Year") % 3 == 0)
    return pages.withColumn("html", F.when(lost, "<html><body>moved</body></html>").otherwise(html))


def schedule_pages(schedule: DataFrame) -> DataFrame:
    """Raw schedule rows to pages (block, kind, html) of the schedule class."""
    names = ["일시", "구장", "분류", "게임", "결과"]
    rows = schedule.select(
        F.floor(F.col("game_id") / PAGE_SPAN).alias("block"),
        F.col("game_id").alias("at"),
        _row([F.col(c) for c in names]).alias("row"),
    )
    return _page(rows, ["block"], names, "game_table").withColumn("kind", F.lit(SCHEDULE))
