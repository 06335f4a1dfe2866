from pyspark.sql import functions as F

from leaguestats.functions.schemas import HITTER, HITTER_COLUMNS, PITCHER, PITCHER_COLUMNS
from leaguestats.sources import ingest
from leaguestats.sources.pages import extract_tables


def test_split_name_no(spark):
    df = spark.createDataFrame([("홍길동(07)",), ("A B(12)",), ("홍길동",), (None,), ("x(1) y(2)",)], "`이름` string")
    made = [tuple(r) for r in ingest.split_name_no(df).collect()]
    assert made[:2] == [("홍길동", "7", None), ("B", "12", None)]
    assert made[2] == (None, None, "name cell: 홍길동")
    assert made[3] == (None, None, "name cell: none")
    assert made[4] == ("x", "1", None)


def test_normalize_headers(spark):
    df = spark.createDataFrame([("1", "2", "3")], "`게임수` string, `도실 (도루자)` string, other string")
    assert ingest.normalize_headers(df, HITTER).columns == ["경기", "도실(도루자)", "other"]
    assert ingest.normalize_headers(df, PITCHER).columns == ["경기수", "도실(도루자)", "other"]
    assert ingest.normalize_headers(df.drop("게임수"), HITTER).columns == ["도실(도루자)", "other"]


def test_null_sentinels(spark):
    df = spark.createDataFrame([("-", " - "), ("", "1"), ("1.5", None)], "a string, b string")
    assert [tuple(r) for r in ingest.null_sentinels(df, ["a", "b", "absent"]).collect()] == [
        (None, None), (None, "1"), ("1.5", None),
    ]


def _pitcher_row(**changes):
    row = {header: "0" for header, _, _ in PITCHER_COLUMNS} | {"성명": "홍", "배번": "7", "팀": "T"}
    return row | changes


def test_conform(spark):
    records = [
        _pitcher_row(방어율="-", 이닝="5.2"),
        _pitcher_row(투구수="1,234", 승="3.0", 이닝="", 승률="NaN"),
        _pitcher_row(승="x"),
        _pitcher_row(승=""),
        _pitcher_row(승률="high"),
    ]
    headers = list(records[0])
    df = spark.createDataFrame([tuple(r[h] for h in headers) for r in records], ", ".join(f"`{h}` string" for h in headers))
    made = ingest.conform(ingest.null_sentinels(df, ingest.DASHED[PITCHER]), PITCHER).collect()
    assert made[0].ERA is None and made[0].IP == 5.2 and made[0].error is None
    assert made[1].P == 1234 and made[1].W == 3 and made[1].IP is None and made[1].WPCT is None and made[1].error is None
    assert made[2].error == "승 is not bigint: x" and made[2].W is None
    assert made[3].error == "승 is not bigint: "
    assert made[4].error == "승률 is not double: high"
    good, bad = ingest.split_errors(ingest.conform(df, PITCHER))
    assert good.count() == 1 and bad.count() == 4  # a dash passes only when it was cleared first


def test_conform_missing_header(spark):
    df = spark.createDataFrame([("홍",)], "`성명` string")
    assert "no column 타율" in ingest.conform(df, HITTER).first().error


def test_typed_records_from_pages(spark):
    headers = ["순위", "이름"] + [h for h, _, _ in PITCHER_COLUMNS if h not in ("성명", "배번", "팀")]
    headers[headers.index("경기수")] = "게임수"

    def page(*rows):
        head = "".join(f"<th>{h}</th>" for h in headers)
        body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows)
        return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"

    def row(name, innings="5.1"):
        return ["1", name] + [innings if h == "이닝" else "-" if h == "방어율" else "2" for h in headers[2:]]

    pages = spark.createDataFrame(
        [("A", 2024, page(row("김(01)"), row("이(2)"))), ("B", 2024, page(row("broken"))), ("C", 2023, "<p>none</p>")],
        "Team string, Year int, html string",
    )
    made = ingest.typed_records(extract_tables(pages, "html", ["Team", "Year"]), PITCHER)
    good, bad = ingest.split_errors(made)
    assert sorted((r.Team, r.Year, r.Name, r.No, r.G, r.IP, r.ERA) for r in good.collect()) == [
        ("A", 2024, "김", "1", 2, 5.33, None), ("A", 2024, "이", "2", 2, 5.33, None),
    ]
    errors = {r.Team: r.error for r in bad.collect()}
    assert errors["B"] == "name cell: broken" and errors["C"].startswith("no table found")


def test_column_tables_have_unique_names():
    for columns in (HITTER_COLUMNS, PITCHER_COLUMNS):
        assert len({h for h, _, _ in columns}) == len({n for _, n, _ in columns}) == len(columns)
    assert (len(HITTER_COLUMNS), len(PITCHER_COLUMNS)) == (31, 29)


def test_spread_cells_names_absent_and_doubled_headers(spark):
    df = spark.sql("select 'T' as Team, 0 as table_no, 0 as row_no, map('타 율', '0.3') as cells, cast(null as string) as error")
    made = ingest.spread_cells(df, HITTER, ["타율", "타석"]).select("타율", F.col("타석"), "error").first()
    assert tuple(made) == ("0.3", None, "no column 타석")
    df = spark.sql("select 0 as table_no, 0 as row_no, map('경기', '3', '게임수', '4') as cells, cast(null as string) as error")
    made = ingest.spread_cells(df, HITTER, ["경기"]).first()
    assert (made["경기"], made["error"]) == ("3", "column twice: 경기")


def test_a_cell_is_typed_once_and_headers_are_placed_once(spark):
    """No look at every entry for every header, and no second reading of a number for its check."""
    raw = spark.createDataFrame([("T", 1, None, None, {"이름": "A(1)", "게임수": "3"}, None)], "Team string, Year int, table_no int, row_no int, cells map<string,string>, error string")
    plan = ingest.typed_records(raw, PITCHER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast(replace(경기수") <= 2
    assert plan.count("lambdafunction") <= 6
