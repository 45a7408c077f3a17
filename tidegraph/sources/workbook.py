"""Sheets of XLSX workbooks as a Spark data source; only the standard library is needed.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").option("sheet", "tweets").option("columns", "id,text").load("/folder/*.xlsx")

One input partition per workbook; rows are streamed from the compressed XML, so a
sheet never has to fit into memory. All cells are strings, as they are written.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def _sheet_part(z: zipfile.ZipFile, sheet: str | None) -> str:
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for s in book.iter(f"{_MAIN}sheet"):
        if sheet is None or s.get("name") == sheet:
            target = links[s.get(f"{_REL}id")]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {sheet!r}")


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_MAIN}si":
                out.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                e.clear()
    return out


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(path: str, sheet: str | None = None, skip_rows: int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 1, cells) of a sheet, rows up to ``skip_rows`` left out but for the first."""
    with zipfile.ZipFile(path) as z:
        shared = _shared(z)
        with z.open(_sheet_part(z, sheet)) as f:
            number = 0
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{_MAIN}row":
                    continue
                number = int(e.get("r") or number + 1)
                if number == 1 or number > skip_rows:
                    cells: list[str | None] = []
                    for c in e.iter(f"{_MAIN}c"):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        kind, v = c.get("t"), c.find(f"{_MAIN}v")
                        if kind == "inlineStr":
                            cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                        elif v is not None and v.text is not None:
                            cells[at] = shared[int(v.text)] if kind == "s" else v.text
                    yield number, cells
                e.clear()


class _Workbook(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.wanted = [f.name for f in schema.fields if f.name not in ("source_file", "source_sheet", "source_row_number")]
        self.names = [f.name for f in schema.fields]
        self.sheet = options.get("sheet")
        self.skip = int(options.get("skiprows", options.get("skipRows", "0")))
        path = options.get("path", "")
        self.paths = sorted(glob.glob(path)) if any(c in path for c in "*?[") else [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".xlsx")] if os.path.isdir(path) else [path]

    def partitions(self) -> list[InputPartition]:
        return [_Workbook(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        header: dict[str, int] | None = None
        sheet = self.sheet or sheet_names(partition.path)[0]
        for number, cells in rows(partition.path, self.sheet, self.skip):
            if header is None:
                header = {str(c): i for i, c in enumerate(cells) if c is not None}
                missing = [c for c in self.wanted if c not in header]
                if missing:
                    raise ValueError(f"{os.path.basename(partition.path)}: missing columns {missing}")
                continue
            fixed = {"source_file": os.path.basename(partition.path), "source_sheet": sheet, "source_row_number": number}
            yield tuple(fixed[n] if n in fixed else cells[header[n]] if header[n] < len(cells) else None for n in self.names)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        """The columns option, or the first workbook's header; then file, sheet and row number."""
        columns = self.options.get("columns")
        if columns:
            names = [c.strip() for c in columns.split(",")]
        else:
            reader = WorkbookReader(StructType(), dict(self.options))
            names = [str(c) for c in next(rows(reader.paths[0], self.options.get("sheet")))[1] if c is not None]
        return ", ".join([*(f"`{n}` string" for n in names), "source_file string", "source_sheet string", "source_row_number bigint"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(schema, dict(self.options))
