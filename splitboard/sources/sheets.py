"""XLSX sheets and override files. A sheet is read by the standard library from its ZIP of XML."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The executors get these functions by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a sheet that a task holds.
HELD = 5_000
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _member(z: zipfile.ZipFile, sheet: int | str) -> str | None:
    """The file of a sheet by its number or name."""
    if isinstance(sheet, int):
        return f"xl/worksheets/sheet{sheet}.xml"
    found = [s for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet") if s.get("name") == sheet]
    link = next((v for s in found for k, v in s.attrib.items() if k.endswith("}id")), None)
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    return f"xl/{targets[link].removeprefix('/xl/')}" if link in targets else None


def rows_of(raw: bytes, sheet: int | str = 1) -> Iterator[dict[str, str]]:
    """Rows of a sheet as {column letter: text}, one after another as they are parsed; none if there is no sheet of that name."""
    main = f"{{{_NS['m']}}}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        member = _member(z, sheet)
        if member is None:
            return
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                for _, item in ElementTree.iterparse(part):
                    if item.tag == f"{main}si":
                        shared.append("".join(t.text or "" for t in item.iter(f"{main}t")))
                        item.clear()
        with z.open(member) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{main}row":
                    continue
                cells = {}
                for cell in row.findall("m:c", _NS):
                    value, inline = cell.find("m:v", _NS), cell.find("m:is", _NS)
                    letter = re.match(r"[A-Z]+", cell.get("r", "A"))[0]
                    if inline is not None:
                        cells[letter] = "".join(t.text or "" for t in inline.iter(f"{main}t"))
                    elif value is not None and value.text is not None:
                        cells[letter] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                # What is left of a row in the tree is its empty element.
                row.clear()
                yield cells


def sheet_rows(raw: bytes, sheet: int | str = 1) -> list[dict[str, str]]:
    """All rows of a small sheet, see ``rows_of``."""
    return list(rows_of(raw, sheet))


def read_sheet(spark: SparkSession, path: str, columns: dict[str, str], first_row: int = 2, sheet: int | str = 1, header_row: int | None = None) -> DataFrame:
    """Columns of a sheet from ``first_row`` on, as strings, with ``path`` and ``row_no``. Files go to Python by Arrow, packed as they are; a task holds ``HELD`` rows of a sheet.

    ``columns`` maps letters to names; with ``header_row`` it maps that row's headings
    instead, wherever they stand (the last of equal ones counts, a missing one is null).
    A heading row below ``first_row`` holds for the rows above it too, which are kept until it comes.
    ``sheet`` is a number from 1 or a name; a file without a sheet of that name has no rows.
    """
    names = ["path", "row_no", *columns.values()]
    schema = "path string, row_no int, " + ", ".join(f"`{n}` string" for n in columns.values())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, raw in zip(batch["path"], batch["content"]):
                letters, found = (list(columns) if header_row is None else None), []
                for i, row in enumerate(rows_of(raw, sheet), 1):
                    if i == header_row:
                        place = {str(text).strip(): letter for letter, text in row.items()}
                        letters = [place.get(c) for c in columns]
                    if i >= first_row:
                        found.append((i, row))
                    if letters is not None and len(found) >= HELD:
                        yield pd.DataFrame([(at, n, *(r.get(c) for c in letters)) for n, r in found], columns=names)
                        found = []
                letters = [None] * len(columns) if letters is None else letters
                yield pd.DataFrame([(at, n, *(r.get(c) for c in letters)) for n, r in found], columns=names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(rows, schema)


def club_mapping(sheet: DataFrame, norm) -> DataFrame:
    """Both spellings of each club to (city, region); rows without city, whole region or any name go. The first row of a key wins."""
    region = F.col("region").try_cast("int")
    good = sheet.where(F.col("city").isNotNull() & region.isNotNull() & (F.col("alt").isNotNull() | F.col("canonical").isNotNull()))
    name = F.coalesce("canonical", "alt")
    each = good.select(F.explode(F.array_compact(F.array("alt", "canonical"))).alias("key"), name.alias("club"), "city", region.alias("region"), "row_no")
    keyed = each.withColumn("key", norm(F.col("key")))
    return keyed.groupBy("key").agg(F.min_by(F.struct("club", "city", "region"), "row_no").alias("r")).select("key", "r.*")


def sync_clubs(stored: DataFrame, sheet: DataFrame, norm, shown=lambda c: c) -> tuple[DataFrame, DataFrame]:
    """(clubs, loaded): the stored clubs (key, alt, club, city, region) with the sheet's in their place, and the sheet's rows that count.

    A row of ``sheet`` (alt, canonical, city, region, row_no) needs a city, a whole
    region and a name. It stands under the key of its other spelling, or of its
    canonical one without it, and under that of the canonical one too. Of rows that
    share a key the last wins. ``shown`` gives the canonical name's display form.
    """
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    canonical, alt = shown(text(F.col("canonical"))), text(F.col("alt"))
    rows = sheet.select(alt.alias("alt"), F.when(text(F.col("canonical")).isNotNull(), canonical).alias("club"), text(F.col("city")).alias("city"), F.col("region").try_cast("int").alias("region"), "row_no")
    rows = rows.withColumns({"_name": F.coalesce("alt", "club")}).withColumns({"_key": norm(F.col("_name")), "_own": norm(F.col("club"))})
    loaded = rows.where("city IS NOT NULL AND region IS NOT NULL AND _name IS NOT NULL AND _key <> ''")
    spelled = F.array(F.struct(F.col("_key").alias("key"), F.col("_name").alias("a"), F.lit(0).alias("o")), F.struct(F.col("_own").alias("key"), F.col("club").alias("a"), F.lit(1).alias("o")))
    each = loaded.select(F.explode(spelled).alias("s"), "club", "city", "region", "row_no").where("s.key <> ''")
    newest = each.groupBy("s.key").agg(F.max_by(F.struct(F.col("s.a").alias("alt"), "club", "city", "region"), F.struct("row_no", "s.o")).alias("_r"))
    new = newest.select("key", "_r.*")
    kept = stored.join(new.select("key"), "key", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True), loaded.select("alt", "club", "city", "region", "row_no")


def sync_report(before: DataFrame, loaded: DataFrame, started: Column) -> DataFrame:
    """One log row: rows read, loaded and skipped, and when."""
    return before.agg(F.count(F.lit(1)).alias("read")).crossJoin(loaded.agg(F.count(F.lit(1)).alias("loaded"))).withColumns(  # one row each
        {"skipped": F.col("read") - F.col("loaded"), "started": started, "ended": F.current_timestamp()}
    )


OVERRIDES = "club_aliases array<struct<raw: string, canonical: string, city: string, region: int>>, name_overrides array<struct<name: string, birth_year: int, gender: string, resolution: string, canonical_name: string, canonical_club: string, canonical_city: string, canonical_region: int>>"


def read_overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(club aliases, name overrides) of an override file; example rows and aliases without city or region go."""
    doc = spark.read.schema(OVERRIDES).json(path, multiLine=True)
    aliases = doc.select(F.inline("club_aliases")).where("city IS NOT NULL AND region IS NOT NULL AND NOT raw LIKE '\\\\_ornek%'")
    return aliases, doc.select(F.inline("name_overrides")).where("resolution = 'same'")
