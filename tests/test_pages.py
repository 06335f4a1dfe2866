import pytest
from hypothesis import given, settings, strategies as st

from leaguestats.sources import pages
from leaguestats.sources.pages import NO_TABLE, _records, extract_tables

CASES = {
    "end tags missing": ("<table><tr><th>a<th>b<tr><td>1<td>2<tr><td>3", [{"a": "1", "b": "2"}, {"a": "3"}]),
    "repeated header": ("<table><thead><tr><td>a</td><td>a</td></tr></thead><tr><td>1</td><td>2</td></tr></table>", [{"a": "1", "a.1": "2"}]),
    "entities": ("<table><tr><th>a</th></tr><tr><td>&lt;b&gt; &amp; &#44032;</td></tr></table>", [{"a": "<b> & 가"}]),
    "spans": (
        "<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td rowspan=2>1</td><td colspan='2'>x</td></tr>"
        "<tr><td>y</td><td>z</td></tr></table>",
        [{"a": "1", "b": "x", "c": "x"}, {"a": "1", "b": "y", "c": "z"}],
    ),
    "nested": (
        "<table><tr><th>o</th></tr><tr><td>out<table><tr><th>i</th></tr><tr><td>in</td></tr></table></td></tr></table>",
        [{"o": "outiin"}, {"i": "in"}],
    ),
    "no header": ("<table><tr><td>1</td><td>2</td></tr></table>", [{"0": "1", "1": "2"}]),
    "more cells than headers": ("<TABLE><TR><TH title='a>b'>h</TH></TR><TR><TD>1</TD><TD>2</TD></TR></TABLE>", [{"h": "1", "1": "2"}]),
    "inline tags": ("<table><tr><th>a</th></tr><tr><td><b>x</b> <a href='y'>z</a></td></tr></table>", [{"a": "x z"}]),
    "unclosed at the end": ("<table><tr><th>a</th></tr><tr><td>last", [{"a": "last"}]),
    "empty table": ("<table></table>", []),
}


@pytest.mark.parametrize("name", CASES)
def test_tables(name):
    html, expected = CASES[name]
    assert [cells for _, _, cells, error in _records(html, None, True) if error is None] == expected


@pytest.mark.parametrize(
    "html", [None, "", "<p>text</p>", "<script>var t = '<table><tr><td>1</td></tr></table>'</script>", "<!-- <table> -->"]
)
def test_no_table(html):
    assert list(_records(html, None, True)) == [(None, None, None, NO_TABLE)]


def test_class_and_line_breaks():
    html = "<table><tr><td>other</td></tr></table><table class='wide game_table'><tr><th> a </th></tr><tr><td>\n l1\nl2 </td></tr></table>"
    assert list(_records(html, "game_table", False)) == [(0, 0, {"a": "l1\nl2"}, None)]
    assert list(_records(html, "game_table", True)) == [(0, 0, {"a": "l1 l2"}, None)]
    assert list(_records(html, "absent", True)) == [(None, None, None, NO_TABLE)]


_text = st.text(st.characters(blacklist_categories=("Cs", "Cc", "Zs", "Zl", "Zp")), min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(_text, min_size=3, max_size=3), min_size=1, max_size=5))
def test_round_trip(table):
    def escape(text):
        return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    body = "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in row) + "</tr>" for row in table)
    html = f"<table><tr><th>a</th><th>b</th><th>c</th></tr>{body}</table>"
    assert [list(cells.values()) for _, _, cells, _ in _records(html, None, False)] == table


def test_extract_tables_on_spark(spark):
    good = "<table><tr><th>a</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table>"
    pages = spark.createDataFrame([(1, "x", good), (2, None, "none"), (3, "z", None), (4, "w", good * 2)], "id long, tag string, html string")
    made = extract_tables(pages.repartition(3), "html", ["id", "tag"])
    assert made.dtypes == [
        ("id", "bigint"), ("tag", "string"), ("table_no", "int"), ("row_no", "int"), ("cells", "map<string,string>"), ("error", "string"),
    ]
    rows = sorted((r.id, r.tag, r.table_no, r.row_no, (r.cells or {}).get("a"), r.error) for r in made.where("error is null").collect())
    assert rows == [(1, "x", 0, 0, "1", None), (1, "x", 0, 1, "2", None), (4, "w", 0, 0, "1", None), (4, "w", 0, 1, "2", None),
                    (4, "w", 1, 0, "1", None), (4, "w", 1, 1, "2", None)]
    assert sorted((r.id, r.error) for r in made.where("error is not null").collect()) == [(2, NO_TABLE), (3, NO_TABLE)]


def test_large_page_crosses_output_batches(spark):
    html = "<table><tr><th>a</th></tr>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(9000)) + "</table>"
    pages = spark.createDataFrame([(1, html), (2, html)], "id int, html string").coalesce(1)
    made = extract_tables(pages, "html", ["id"]).selectExpr("id", "row_no", "cast(cells['a'] as int) as a")
    assert made.count() == 18000 and made.where("row_no <> a").count() == 0


def test_plain_cells_read_like_others():
    """Rows of plain cells are cut in one go; attributes, missing ends and nested tables take the long way to the same rows."""
    head = '<table class="record"><tr><th>a</th><th>b &amp; c</th><th>a</th></tr>'
    rows = [["1", " x\n y ", "&lt;2&gt;"], ["", "p  q", "\xa03"], ["only"], ["4", "5", "6", "7"]]
    plain = head + "".join("<tr>" + " ".join(f"<td>{t}</td >" for t in r) + "</TR>\n" for r in rows) + "</table>"
    others = [
        plain.replace("<td>", "<td title='>'>").replace("<th>", "<th id=h>"),
        plain.replace("</td >", "").replace("</th>", ""),
        plain.replace("<td>", "<TD >"),
        plain.replace("</td >", "<!-- <td> --></td >"),
    ]
    for collapse in (True, False):
        wanted = list(pages._records(plain, "record", collapse))
        assert [list(r[2]) for r in wanted] == [["a", "b & c", "a.1"][: len(r)] + ["3"] * (len(r) > 3) for r in rows]
        assert all(list(pages._records(page, "record", collapse)) == wanted for page in others)
        assert wanted[0][2]["b & c"] == ("x  y" if collapse else "x\n y")
    inner = "<table><tr><td>out" + plain + "</td><td>z</td></tr></table>"
    assert [len(rows) for _, rows in pages._tables(inner)] == [1, 5]
    # All of a page of plain cells takes the short way.
    assert {type(c) for row in pages._tables(plain)[0][1] for c in row} == {str, pages._Heading}
