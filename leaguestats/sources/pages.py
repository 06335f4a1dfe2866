"""HTML tables to rows, one Arrow batch of pages at a time.

This is the only place where Python touches rows: Spark has no HTML reader.
Pages are independent, so Spark's input partitions decide the parallelism and
nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

NO_TABLE = "no table found"
NO_ROWS = "table without rows"
# No cell spans more columns or rows than a browser would let it.
_MOST_SPANNED = 1000
_BREAKS = re.compile(r"[\r\n]+|\s{2,}")
# Rows per output batch: bounds the memory of a batch of large pages.
_CHUNK = 4096

_EXTRACTED = T.StructType(
    [
        T.StructField("table_no", T.IntegerType()),
        T.StructField("row_no", T.IntegerType()),
        T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


# Attributes may hold ">" inside quotes.
_INSIDE = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<skip>script|style)\b.*?(?:</(?P=skip)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>table|thead|tbody|tfoot|tr|td|th)\b(?P<attributes>{_INSIDE})>|</?[a-z!?]{_INSIDE}>",
    re.IGNORECASE | re.DOTALL,
)
# Cells of one kind at the start of a row that hold text only, and their texts: most of a page is made of them.
_PLAIN_CELLS = re.compile(r"(?:<td>[^<]*</td\s*>\s*)+|(?P<heading>(?:<th>[^<]*</th\s*>\s*)+)", re.IGNORECASE)
_PLAIN_CELL = re.compile(r"<t[dh]>([^<]*)<", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


class _Heading(str):
    """A plain heading cell."""


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {name.lower(): unescape(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(text)}


def _tables(html: str) -> list[tuple[list[str], list[list[dict | str]]]]:
    """Every table as (classes, rows of cells), nested ones included.

    Text counts for all cells it lies in; end tags may be missing.  A plain cell
    is its text alone.
    """
    found: list[tuple[list[str], list[list[dict | str]]]] = []
    enclosing: list[dict] = []  # innermost last
    position = 0

    def take(text: str) -> None:
        for table in enclosing:
            if table["cell"] is not None:
                table["cell"]["text"].append(text)

    while token := _TOKEN.search(html, position):
        take(html[position : token.start()])
        position = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag, ends = tag.lower(), bool(token["end"])
        if tag == "table":
            if not ends:
                rows: list[list[dict | str]] = []
                found.append((_attributes(token["attributes"]).get("class", "").split(), rows))
                enclosing.append({"rows": rows, "cell": None, "head": False})
            elif enclosing:
                enclosing.pop()
            continue
        if not enclosing:
            continue
        table = enclosing[-1]
        if tag in ("td", "th"):
            table["cell"] = None
            if not ends:
                attributes = _attributes(token["attributes"])
                table["cell"] = {
                    "text": [],
                    "heading": tag == "th" or table["head"],
                    "across": _span(attributes.get("colspan")),
                    "down": _span(attributes.get("rowspan")),
                }
                if not table["rows"]:
                    table["rows"].append([])
                table["rows"][-1].append(table["cell"])
        elif tag == "tr":
            table["cell"] = None
            if not ends:
                table["rows"].append([])
                plain = _PLAIN_CELLS.match(html, position) if len(enclosing) == 1 else None
                if plain:
                    texts = _PLAIN_CELL.findall(html, *plain.span())
                    table["rows"][-1] += map(_Heading, texts) if plain["heading"] or table["head"] else texts
                    position = plain.end()
        else:
            table["cell"] = None
            table["head"] = tag == "thead" and not ends
    take(html[position:])
    return found


def _span(text: str | None) -> int:
    if not (text and text.isascii() and text.isdigit()):
        return 1
    if len(text) > 9 or int(text) > _MOST_SPANNED:
        raise ValueError(f"a cell spans {text[:12]} columns or rows")
    return max(int(text), 1)


def _clean(text: str, collapse: bool) -> str:
    text = unescape(text).strip()
    # Printable text has no white space but blanks.
    return _BREAKS.sub(" ", text) if collapse and ("  " in text or not text.isprintable()) else text


def _grid(rows: list[list[dict | str]], collapse: bool) -> list[tuple[bool, list[str]]]:
    """Rows as (is heading, texts), with spanning cells repeated."""
    carried: dict[int, tuple[int, str]] = {}  # column -> rows left, text
    grid = []
    for row in (r for r in rows if r):
        kinds = set(map(type, row))
        if not carried and dict not in kinds:
            whole = "".join(row)
            easy = whole.isprintable() and "  " not in whole and "&" not in whole
            grid.append((str not in kinds, [text.strip() if easy else _clean(text, collapse) for text in row]))
            continue
        texts: list[str] = []

        def fill_carried():
            while len(texts) in carried:
                left, text = carried.pop(len(texts))
                if left > 1:
                    below[len(texts)] = (left - 1, text)
                texts.append(text)

        below: dict[int, tuple[int, str]] = {}
        for cell in row:
            fill_carried()
            if isinstance(cell, str):
                texts.append(_clean(cell, collapse))
                continue
            text = _clean("".join(cell["text"]), collapse)
            for _ in range(cell["across"]):
                if cell["down"] > 1:
                    below[len(texts)] = (cell["down"] - 1, text)
                texts.append(text)
        fill_carried()
        carried = below
        grid.append((all(c["heading"] if isinstance(c, dict) else isinstance(c, _Heading) for c in row), texts))
    return grid


def _numbered(names: list[str]) -> list[str]:
    """A repeated header gets a numbered name."""
    if len(set(names)) == len(names):
        return names
    return [f"{name}.{names[:at].count(name)}" if name in names[:at] else name for at, name in enumerate(names)]


def _records(html: str | None, css_class: str | None, collapse: bool) -> Iterator[tuple]:
    """(table_no, row_no, cells, error) of one page."""
    if html is None or "<table" not in html.lower():
        yield None, None, None, NO_TABLE
        return
    wanted = [rows for classes, rows in _tables(html) if css_class is None or css_class in classes]
    if not wanted:
        yield None, None, None, NO_TABLE
    for table_no, rows in enumerate(wanted):
        names: list[str] = []
        row_no = 0
        for heading, texts in _grid(rows, collapse):
            if heading and row_no == 0:
                names = _numbered(texts)
                continue
            if len(texts) > len(names):
                names = names + [str(at) for at in range(len(names), len(texts))]
            yield table_no, row_no, dict(zip(names, texts)), None
            row_no += 1
        if row_no == 0:
            yield table_no, None, None, NO_ROWS


def extract_tables(
    pages: DataFrame,
    html_col: str,
    keep_cols: Sequence[str],
    css_class: str | None = None,
    collapse_space: bool = True,
) -> DataFrame:
    """Every row of every HTML table: (keep_cols..., table_no, row_no, cells, error).

    ``cells`` maps header to text.  ``css_class`` restricts to tables of that
    class; ``collapse_space=False`` keeps line breaks inside a cell.  Heading rows
    above the first body row name the columns; one further down is a row like
    any other.  A page without a table, or one that cannot be read (a cell over
    1,000 columns wide, say), gives one row with ``error`` set, as does a table
    without body rows, so no page disappears and each page is parsed once.
    """
    keep = list(keep_cols)
    source = pages.select(*keep, html_col)
    schema = T.StructType([*source.select(*keep).schema.fields, *_EXTRACTED.fields])
    arrow_types = [
        ("table_no", pa.int32()),
        ("row_no", pa.int32()),
        ("cells", pa.map_(pa.string(), pa.string())),
        ("error", pa.string()),
    ]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            kept = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(len(keep))]
            table_no, row_no, cells, error = zip(*rows)
            names, texts, ends = [], [], [0]
            for cell in cells:
                if cell:
                    names += cell
                    texts += cell.values()
                ends.append(len(names))
            none = pa.array([cell is None for cell in cells])
            maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(texts, pa.string()), mask=none)
            made = [maps if name == "cells" else pa.array(values, type_) for (name, type_), values in zip(arrow_types, (table_no, row_no, cells, error))]
            return pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *[n for n, _ in arrow_types]])

        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for index, html in enumerate(batch.column(len(keep))):
                start = len(rows)
                try:
                    for record in _records(html.as_py(), css_class, collapse_space):
                        at.append(index)
                        rows.append(record)
                except Exception as problem:  # noqa: BLE001 - one bad page must not fail the load
                    del at[start:], rows[start:]
                    at.append(index)
                    rows.append((None, None, None, f"{type(problem).__name__}: {problem}"))
                if len(rows) >= _CHUNK:
                    yield emit(batch, at, rows)
                    at, rows = [], []
            if rows:
                yield emit(batch, at, rows)

    return source.mapInArrow(read, schema)
