"""Worksheets of .xlsx workbooks: a data source for reading, and cleaning in place of cells.

A workbook is a zip of XML parts; both directions use the standard library alone. A worksheet
has at most 1,048,576 rows by its format, which bounds what a task, or the driver, holds.
Cleaning replaces the text of changed cells and copies every other part byte by byte, so
styles, formulas and other sheets stay.
"""

from __future__ import annotations

import re
import zipfile
from collections import Counter
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..kernels.cleaner import parse_rules
from ..kernels.records import EXAMPLE_CHANGES, parse_fields
from ..operators.clean import cleaning
from .paths import check_output, default_output

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
ROW_NO = "_row"


def column_number(reference: str) -> int:
    """The column of a cell reference, from 0: A1 is 0."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


class Workbook:
    """The cells of a workbook's sheets."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path)
        names = self.zip.namelist()
        self.shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(self.zip.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {s.get("name"): self._part(links[s.get(f"{LINKS}id")]) for s in book.iter(f"{MAIN}sheet")}
        view = next(book.iter(f"{MAIN}workbookView"), None)
        self.active = list(self.sheets)[int(view.get("activeTab", 0)) if view is not None else 0]

    @staticmethod
    def _part(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def root(self, sheet: str | None) -> ET.Element:
        name = sheet or self.active
        if name not in self.sheets:
            raise ValueError(f"no such sheet: {name}")
        return ET.fromstring(self.zip.read(self.sheets[name]))

    def value(self, cell: ET.Element) -> tuple[str | None, bool]:
        """A cell's value as text, and whether the cell holds a string."""
        kind, v = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{MAIN}t")), True
        if v is None or v.text is None:
            return None, False
        if kind == "s":
            return self.shared[int(v.text)], True
        return v.text, kind == "str" and cell.find(f"{MAIN}f") is None

    def rows(self, sheet: str | None) -> Iterator[tuple[int, dict[int, tuple[str | None, bool]]]]:
        """(row number, values by column) of every row that is there."""
        for i, row in enumerate(self.root(sheet).iter(f"{MAIN}row"), 1):
            number = int(row.get("r", i))
            yield number, {column_number(c.get("r")) if c.get("r") else j: self.value(c) for j, c in enumerate(row.iter(f"{MAIN}c"))}

    def headers(self, sheet: str | None) -> dict[str, int]:
        """Columns by what row 1 says; the last of equals."""
        first = next((cells for number, cells in self.rows(sheet) if number == 1), {})
        return {v: c for c, (v, _) in sorted(first.items()) if v is not None}


class XlsxSource(DataSource):
    """format("textloom_xlsx"): _row (the sheet's row number) and one string column for each header; option ``sheet``."""

    @classmethod
    def name(cls) -> str:
        return "textloom_xlsx"

    def schema(self) -> StructType:
        headers = Workbook(self.options["path"]).headers(self.options.get("sheet"))
        return StructType([StructField(ROW_NO, LongType())] + [StructField(h, StringType()) for h in headers])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"], self.options.get("sheet"), schema)


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, schema: StructType):
        self.path, self.sheet, self.fields = path, sheet, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        book = Workbook(partition.value)
        headers = book.headers(self.sheet)
        at = [headers.get(f) for f in self.fields if f != ROW_NO]
        for number, cells in book.rows(self.sheet):
            if number > 1:
                by_name = iter([cells.get(c, (None, False))[0] for c in at])
                yield tuple(number if f == ROW_NO else next(by_name) for f in self.fields)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("textloom_xlsx")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def _rewritten(book: Workbook, sheet: str, new: dict[tuple[int, int], str]) -> bytes:
    """A sheet's XML with new text in some cells, as inline strings."""
    raw = book.zip.read(book.sheets[sheet])
    for prefix, uri in re.findall(rb'xmlns:?([\w]*)="([^"]+)"', raw):
        ET.register_namespace(prefix.decode(), uri.decode())
    root = ET.fromstring(raw)
    for i, row in enumerate(root.iter(f"{MAIN}row"), 1):
        for j, cell in enumerate(row.iter(f"{MAIN}c")):
            column = column_number(cell.get("r")) if cell.get("r") else j
            text = new.get((int(row.get("r", i)), column))
            if text is None:
                continue
            for child in list(cell):
                cell.remove(child)
            cell.set("t", "inlineStr")
            t = ET.SubElement(ET.SubElement(cell, f"{MAIN}is"), f"{MAIN}t")
            t.text = text
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def clean_xlsx(spark: SparkSession, source: str, output: str | None = None, fields: str | Sequence[str] | None = None, rules=None, sheet: str | None = None, dry_run: bool = False, max_examples: int = 20) -> dict:
    """Clean a sheet's string cells in the columns that row 1 names; returns the run's summary."""
    output, fields, rules = output or default_output(source), parse_fields(fields), parse_rules(rules)
    check_output(source, output, dry_run)
    book = Workbook(source)
    sheet = sheet or book.active
    headers = book.headers(sheet)
    if missing := [f for f in fields if f not in headers]:
        raise ValueError(f"field(s) not found in header: {','.join(missing)}")
    strings = [(number, f, value) for number, cells in book.rows(sheet) if number > 1 for f in fields for value, is_text in [cells.get(headers[f], (None, False))] if is_text]
    cells = spark.createDataFrame(strings, "row long, field string, value string")
    # bounded by the format: a sheet's changed cells
    changed = cells.withColumn("c", cleaning(F.col("value"), rules, "chars")).where("c.change_count > 0").orderBy("row").select("row", "field", "c.cleaned", "c.change_count", "c.rule_counts", "c.changes").collect()
    stats: Counter = Counter({"total": max((n for n, _ in book.rows(sheet)), default=1) - 1})
    order = {f: i for i, f in enumerate(fields)}
    by_row: dict[int, list] = {}
    for r in sorted(changed, key=lambda r: (r["row"], order[r["field"]])):
        by_row.setdefault(r["row"], []).append(r)
        stats.update({"changed_fields": 1, "changed_chars": r["change_count"]} | {f"changed_{rule}": n for rule, n in r["rule_counts"].items()})
    if by_row:
        stats["changed_rows"] = len(by_row)
    if not dry_run:
        new = _rewritten(book, sheet, {(r["row"], headers[r["field"]]): r["cleaned"] for r in changed})
        with zipfile.ZipFile(output, "w", zipfile.ZIP_DEFLATED) as out:
            for item in book.zip.infolist():
                out.writestr(item, new if item.filename == book.sheets[sheet] and changed else book.zip.read(item.filename))
    examples = []
    for number, rows in list(by_row.items())[:max_examples]:
        every = [{"field": r["field"], **{k: v for k, v in c.asDict().items() if k != "field"}} for r in rows for c in r["changes"]]
        examples.append({"excel_row": number, "change_count": len(every), "changes": every[:EXAMPLE_CHANGES]})
    return {
        "input": source,
        "output": "" if dry_run else output,
        "format": "xlsx",
        "sheet": sheet,
        "dry_run": dry_run,
        "fields": list(fields),
        "rules": list(rules),
        "stats": dict(stats),
        "issue_rows": list(by_row)[:1000],
        "examples": examples,
    }
