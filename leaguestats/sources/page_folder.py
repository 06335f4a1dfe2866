"""Folders of saved pages as a data source.

    spark.dataSource.register(PageFolder)
    rows = spark.read.format("record_pages").option("css_class", "record").load("/pages/hitter")

Folders named key=value above a file are columns; a schema given to the reader
picks the columns to make, and cells are built only if they are among them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import types as T

from .pages import _CHUNK, _records

_MADE = ("table_no", "row_no", "cells", "error")
_TYPES = {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "map": pa.map_(pa.string(), pa.string())}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)


class Files(InputPartition):
    """Some files with their sizes, read by one task."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class PageFolderReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.folder = options["path"]
        self.css_class = options.get("css_class")
        self.collapse = options.get("collapse_space", "true").lower() == "true"
        self.most_bytes = int(options.get("partition_bytes", str(4 << 20)))
        self.fields = [(f.name, f.dataType.typeName()) for f in schema.fields]
        unknown = [name for name, kind in self.fields if kind not in _TYPES]
        if unknown:
            raise ValueError(f"columns of a type that pages do not give: {unknown}")

    def partitions(self) -> Sequence[InputPartition]:
        """Files in the order of their paths, put together up to ``partition_bytes``; hidden ones are left out."""
        system, base = _place(self.folder)
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and not re.search(r"/[._]", i.path[len(base) :]))
        groups: list[list[str]] = []
        size = self.most_bytes
        for path, length in files:
            if size + length > self.most_bytes or not groups:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += length
        return [Files(paths) for paths in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.folder)
        rows: list[tuple] = []
        for path in partition.paths:
            named = dict(re.findall(r"/([^/=]+)=([^/]*)", path))
            for record in self._of(system, path):
                rows.append(tuple(self._value(name, kind, record, named, path) for name, kind in self.fields))
            if len(rows) >= _CHUNK:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _of(self, system: fs.FileSystem, path: str) -> list[tuple]:
        """(table_no, row_no, cells, error) of a file; one that cannot be read is one row with the reason."""
        try:
            with system.open_input_file(path) as file:
                html = file.read().decode()
            return list(_records(html, self.css_class, self.collapse))
        except Exception as problem:  # noqa: BLE001 - one bad file must not fail the load
            return [(None, None, None, f"{type(problem).__name__}: {problem}")]

    @staticmethod
    def _value(name: str, kind: str, record: tuple, named: dict[str, str], path: str):
        if name in _MADE:
            value = record[_MADE.index(name)]
            return list(value.items()) if kind == "map" and value is not None else value
        if name == "file":
            return path
        text = named.get(name)
        return text if kind == "string" or text is None else int(text)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([row[i] for row in rows], _TYPES[kind]) for i, (_, kind) in enumerate(self.fields)]
        return pa.RecordBatch.from_arrays(columns, [name for name, _ in self.fields])


class PageFolder(DataSource):
    """Rows of every HTML table of the files under a folder."""

    @classmethod
    def name(cls) -> str:
        return "record_pages"

    def schema(self) -> str:
        return "Team string, Year int, file string, table_no int, row_no int, cells map<string,string>, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PageFolderReader(schema, dict(self.options))
