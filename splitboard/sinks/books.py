"""Data source ``workbook``: XLSX files written by tasks, one for each book, without a row on the driver.

Rows are (book, sheet, row, cells, style); ``write_books`` deals a book to one task,
sorted, and the task streams its sheets into the file: what it holds is one row. A
row's style is one name, or several with the cells that each is for ("head:7,sub": the
first seven and the rest). A sheet's layout (widths, frozen panes) and the styles are options of the write. A book
is as large as a file may be; a sheet beyond what the format holds is an error.
"""

from __future__ import annotations

import json
import sys
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that a sheet holds, and letters of its name.
ROWS, NAME = 1_048_576, 31
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
SCHEMA = "book string, sheet string, row long, cells array<string>, style string"


@dataclass
class Style:
    """How a row's cells look: fill and letters as RRGGBB, bold, centred, with a thin border."""

    fill: str | None = None
    colour: str | None = None
    bold: bool = False
    size: float = 11
    centre: bool = False
    border: bool = False


@dataclass
class Layout:
    """A sheet's column widths, the cell below and right of which it scrolls, and its first row's height."""

    widths: list[float] = field(default_factory=list)
    frozen: str | None = None
    height: float | None = None


def letter(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def style_sheet(styles: Mapping[str, dict]) -> str:
    """Cell formats: 0 is plain, then the styles in their order."""
    fonts, fills, formats = ["<font><sz val=\"11\"/></font>"], ['<fill><patternFill patternType="none"/></fill>', '<fill><patternFill patternType="gray125"/></fill>'], ['<xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>']
    for s in styles.values():
        fonts.append(f"<font>{'<b/>' if s['bold'] else ''}<sz val=\"{s['size']}\"/>{'<color rgb="FF' + s['colour'] + '"/>' if s['colour'] else ''}</font>")
        at = 0
        if s["fill"]:
            at = len(fills)
            fills.append(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{s["fill"]}"/></patternFill></fill>')
        place = '<alignment horizontal="center" vertical="center" wrapText="1"/>' if s["centre"] else '<alignment vertical="center"/>'
        formats.append(f'<xf numFmtId="0" fontId="{len(fonts) - 1}" fillId="{at}" borderId="{int(s["border"])}" xfId="0" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1">{place}</xf>')
    side = "".join(f'<{e} style="thin"/>' for e in ("left", "right", "top", "bottom"))
    counted = lambda tag, items: f'<{tag} count="{len(items)}">{"".join(items)}</{tag}>'
    plain = ['<xf numFmtId="0" fontId="0" fillId="0" borderId="0"/>']
    return f'<styleSheet xmlns="{MAIN}">{counted("fonts", fonts)}{counted("fills", fills)}{counted("borders", ["<border/>", f"<border>{side}</border>"])}{counted("cellStyleXfs", plain)}{counted("cellXfs", formats)}</styleSheet>'


class Book:
    """One file, written row by row."""

    def __init__(self, out, styles: Mapping[str, dict], layouts: Mapping[str, dict]):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.styles, self.layouts = styles, layouts
        self.number = {name: i for i, name in enumerate(styles, 1)}
        self.formats: dict[tuple[str | None, int], list[int]] = {}
        self.sheets: list[str] = []
        self.open, self.rows = None, 0

    def begin(self, name: str) -> None:
        self.end()
        self.sheets.append(name)
        self.rows = 0
        self.open = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w")
        self.layout = self.layouts.get(name) or self.layouts.get("") or {"widths": [], "frozen": None, "height": None}
        view, columns = "", ""
        if self.layout["frozen"]:
            cell = self.layout["frozen"]
            across = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(cell.rstrip("0123456789")))) - 1
            down = int(cell.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
            split = (f' xSplit="{across}"' if across else "") + (f' ySplit="{down}"' if down else "")
            view = f'<sheetViews><sheetView workbookViewId="0"><pane{split} topLeftCell="{cell}" state="frozen"/></sheetView></sheetViews>'
        if self.layout["widths"]:
            columns = "<cols>" + "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(self.layout["widths"], 1)) + "</cols>"
        self.open.write(f'<worksheet xmlns="{MAIN}">{view}{columns}<sheetData>'.encode())

    def row(self, cells: list[str | None], style: str | None) -> None:
        self.rows += 1
        if self.rows > ROWS:
            raise ValueError(f"{self.sheets[-1]} has more rows than a sheet holds; write it as a table")
        body = "".join(
            f'<c r="{letter(i)}{self.rows}" s="{s}"' + ("/>" if v is None else f' t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
            for i, (v, s) in enumerate(zip(cells, self._formats(style, len(cells))), 1) if v is not None or s
        )
        tall = f' ht="{self.layout["height"]}" customHeight="1"' if self.rows == 1 and self.layout["height"] else ""
        self.open.write(f'<row r="{self.rows}"{tall}>{body}</row>'.encode())

    def _formats(self, style: str | None, n: int) -> list[int]:
        found = self.formats.get((style, n))
        if found is None:
            found = []
            for part in (style or "").split(","):
                name, _, count = part.partition(":")
                found += [self.number.get(name, 0)] * (int(count) if count else n - len(found))
            self.formats[style, n] = found = found[:n]
        return found

    def end(self) -> None:
        if self.open:
            self.open.write(b"</sheetData></worksheet>")
            self.open.close()
            self.open = None

    def close(self) -> None:
        self.end()
        put, n = self.zip.writestr, len(self.sheets)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{KIND}.worksheet+xml"/>' for i in range(1, n + 1))
        put("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/>{parts}</Types>')
        link = lambda i, kind, target: f'<Relationship Id="r{i}" Type="{REL}/{kind}" Target="{target}"/>'
        wrap = lambda inner: f'<Relationships xmlns="{PACKAGE}/relationships">{inner}</Relationships>'
        put("_rels/.rels", wrap(link(1, "officeDocument", "xl/workbook.xml")))
        names = "".join(f"<sheet name={quoteattr(s[:NAME])} sheetId=\"{i}\" r:id=\"r{i}\"/>" for i, s in enumerate(self.sheets, 1))
        put("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        put("xl/_rels/workbook.xml.rels", wrap("".join(link(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, n + 1)) + link(n + 1, "styles", "styles.xml")))
        put("xl/styles.xml", style_sheet(self.styles))
        self.zip.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class BookWriter(DataSourceWriter):
    """Each task writes its books under names that nobody reads; the commit gives them their own, an abort deletes them."""

    def __init__(self, path: str, styles: Mapping[str, dict], layouts: Mapping[str, dict]):
        self.path, self.styles, self.layouts = path, styles, layouts

    def _place(self) -> tuple[fs.FileSystem, str]:
        where, path = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        where.create_dir(path, recursive=True)
        return where, path

    def write(self, iterator: Iterator) -> Written:
        where, path = self._place()
        made, book, out, current, sheet = [], None, None, None, None
        for name, of, _, cells, style in iterator:
            if name != current:
                if book:
                    book.close()
                    out.close()
                held = f"{path}/_{uuid.uuid4().hex}"
                made.append((held, f"{path}/{name}.xlsx"))
                out = where.open_output_stream(held)
                book, current, sheet = Book(out, self.styles, self.layouts), name, None
            if of != sheet:
                book.begin(of)
                sheet = of
            book.row(list(cells), style)
        if book:
            book.close()
            out.close()
        return Written(made)

    def commit(self, messages: list) -> None:
        where, _ = self._place()
        for message in messages:
            for held, name in message.files if message else ():
                where.move(held, name)

    def abort(self, messages: list) -> None:
        where, _ = self._place()
        for message in messages:
            for held, _ in message.files if message else ():
                where.delete_file(held)


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"], json.loads(self.options.get("styles", "{}")), json.loads(self.options.get("layouts", "{}")))


def write_books(rows: DataFrame, path: str, order: Mapping[str, int] | None = None, styles: Mapping[str, Style] | None = None, layouts: Mapping[str, Layout] | None = None) -> None:
    """Write rows (book, sheet, row, cells, style) as ``<book>.xlsx`` files of the folder ``path``.

    Sheets stand in the order of ``order``, others after them by name; rows by ``row``.
    A layout under "" is that of all sheets without their own.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Workbook)
    place = F.lit(len(order or {}))
    for name, at in (order or {}).items():
        place = F.when(F.col("sheet") == name, at).otherwise(place)
    cells = rows.select("book", "sheet", F.col("row").cast("long").alias("row"), "cells", F.col("style").cast("string").alias("style")).withColumn("_place", place)
    dealt = cells.repartition("book").sortWithinPartitions("book", "_place", "sheet", "row").drop("_place")
    plain = lambda items: json.dumps({k: vars(v) for k, v in (items or {}).items()})
    dealt.write.format("workbook").option("styles", plain(styles)).option("layouts", plain(layouts)).mode("append").save(path)


def sheet_rows(table: DataFrame, book: Column, sheet: Column, order: list[Column], title: Column | None = None, header: str = "header", style: Column | None = None, hidden: tuple[str, ...] = ()) -> DataFrame:
    """A table's rows as those of books: its headings first (after ``title``, if given), then its rows in order.

    ``hidden`` columns are not shown. Rows are numbered in their book and sheet, as many as a sheet holds.
    """
    shown = [c for c in table.columns if c not in hidden]
    text = F.array(*(F.col(c).cast("string") for c in shown))
    keyed = table.select(book.alias("book"), sheet.alias("sheet"), text.alias("cells"), (F.lit(None).cast("string") if style is None else style).alias("style"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("_o"), (F.lit(None).cast("string") if title is None else title).alias("_title"))
    first = 3 if title is not None else 2
    body = keyed.withColumn("row", F.row_number().over(Window.partitionBy("book", "sheet").orderBy("_o")) + first - 1)
    books = keyed.groupBy("book", "sheet").agg(F.max("_title").alias("_title"))
    heads = books.select("book", "sheet", F.lit(first - 1).alias("row"), F.array(*map(F.lit, shown)).alias("cells"), F.lit(header).alias("style"))
    out = body.select("book", "sheet", "row", "cells", "style").unionByName(heads)
    if title is not None:
        out = out.unionByName(books.select("book", "sheet", F.lit(1).alias("row"), F.array("_title").alias("cells"), F.lit("title").alias("style")))
    return out


def write_reports(reports: Mapping[str, DataFrame], path: str, book: str) -> None:
    """A book of report tables, one sheet each, in their order; rows stand as the tables' values sort."""
    rows = None
    for name, table in reports.items():
        own = sheet_rows(table, F.lit(book), F.lit(name), [F.col(c) for c in table.columns])
        rows = own if rows is None else rows.unionByName(own)
    write_books(rows, path, {name: i for i, name in enumerate(reports)}, {"header": Style(bold=True)})
