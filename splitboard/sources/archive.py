"""Data source ``meet_archive``: meet files (ZIP of XML, or XML) and text lists, read and written in parallel.

    register(spark)
    spark.read.format("meet_archive").option("rows", "results").load(folder)

Each file is a partition; a parse gives its rows as Arrow batches of the columns that
a given schema asks for (``.schema("club string, time string")``), else all. The option
``names`` (file names with commas between) reads those files alone. Spark's own push-down
of filters is not used: with Spark 4.1 a filter that one query has pushed stays in the
DataFrame, and the next query over it loses rows. Paths are those that Arrow's file
systems open; for others ``parsed`` takes files that Spark has read.
"""

from __future__ import annotations

import io
import sys
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# The executors get these classes by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 5_000
_EVENT = "event_id string, stroke string, distance int, relay boolean"
_PERSON = "path string, club string, name string, gender string, birthdate string"
#: What a file's rows are, by the option ``rows``: elements of a meet with their event's, or a list's lines.
KINDS = {
    "results": f"{_PERSON}, {_EVENT}, status string, time string",
    "entries": f"{_PERSON}, {_EVENT}, time string",
    "meets": "path string, start string, session string",
    "lines": "doc string, page int, line_no int, text string",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def document(raw: bytes) -> ElementTree.Element | None:
    """The root of an archive's first .lef or .xml member, or of plain XML, without name spaces; None if there is none."""
    try:
        if raw[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                name = next((n for n in z.namelist() if n.lower().endswith((".lef", ".xml"))), None)
                raw = z.read(name) if name else b""
        root = ElementTree.fromstring(raw) if raw else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, LookupError, ValueError):
        return None
    for element in root.iter() if root is not None else ():
        element.tag = element.tag.rpartition("}")[2]
    return root


def _events(root: ElementTree.Element) -> dict[str, tuple]:
    out = {}
    for event in root.iter("EVENT"):
        style = event.find("SWIMSTYLE")
        if style is None or not event.get("eventid"):
            continue
        count, distance = style.get("relaycount", "1"), style.get("distance", "")
        relay = event.find("RELAY") is not None or "YES" in (event.get("relay", "").upper(), style.get("relay", "").upper()) or (count.isdigit() and int(count) > 1)
        out[event.get("eventid")] = (style.get("stroke", "").upper(), int(distance) if distance.isdigit() else None, relay)
    return out


def _meet_rows(path: str, root: ElementTree.Element, kind: str) -> Iterator[tuple]:
    if kind == "meets":
        meet, session = next(root.iter("MEET"), None), next(root.iter("SESSION"), None)
        yield path, None if meet is None else meet.get("startdate"), None if session is None else session.get("date")
        return
    events, tag = _events(root), "RESULT" if kind == "results" else "ENTRY"
    for club in root.iter("CLUB"):
        for athlete in club.iter("ATHLETE"):
            name = f"{athlete.get('firstname', '').strip()} {athlete.get('lastname', '').strip()}".strip()
            person = (path, club.get("name", "").strip(), name, athlete.get("gender", ""), athlete.get("birthdate", ""))
            for swim in athlete.iter(tag):
                at = swim.get("eventid", "")
                if at not in events:
                    continue
                own = (swim.get("status", ""), swim.get("swimtime", "")) if kind == "results" else (swim.get("entrytime", ""),)
                yield (*person, at, *events[at], *own)


def rows_of(path: str, raw: bytes, kind: str) -> Iterator[tuple]:
    """All rows of a file, in its order; none of a file that isn't what it should be. A list's pages are parted by form feeds."""
    if kind != "lines":
        root = document(raw)
        if root is not None:
            yield from _meet_rows(path, root, kind)
        return
    doc = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for page, text in enumerate(raw.decode("utf-8", "replace").split("\f"), 1):
        for number, line in enumerate(text.splitlines(), 1):
            yield doc, page, number, line


def _names(kind: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in KINDS[kind].split(", ")]


def _batches(rows: Iterable[tuple], kind: str, wanted: list[str]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the wanted columns only."""
    types = _names(kind)
    at = [next(i for i, (name, _) in enumerate(types) if name == c) for c in wanted]
    schema = pa.schema([(types[i][0], _ARROW[types[i][1]]) for i in at])
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in zip(at, schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in zip(at, schema)], schema=schema)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, kind: str, wanted: list[str], endings: tuple[str, ...], names: frozenset[str]):
        self.path, self.kind, self.wanted, self.endings, self.names = path, kind, wanted, endings, names

    def partitions(self) -> list[Part]:
        where, path = _opened(self.path)
        found = where.get_file_info(fs.FileSelector(path, recursive=True)) if where.get_file_info(path).type == fs.FileType.Directory else [where.get_file_info(path)]
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.endings) and not f.base_name.startswith(("_", ".")))
        if self.names:
            paths = [p for p in paths if p.rsplit("/", 1)[-1] in self.names]
        return [Part(p) for p in paths]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        where, _ = _opened(self.path)
        with where.open_input_stream(partition.path) as file:
            raw = file.read()
        yield from _batches(rows_of(partition.path, raw, self.kind), self.kind, self.wanted)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """One file for each row (name, content): archives of an XML text, or texts as they are.

    A task writes under names that readers skip; the commit gives the files their own,
    an abort deletes them. A row of a task that ran twice is written once.
    """

    def __init__(self, path: str, archive: bool, overwrite: bool):
        self.path, self.archive, self.overwrite = path, archive, overwrite

    def write(self, iterator: Iterator) -> Written:
        where, path = _opened(self.path)
        where.create_dir(path, recursive=True)
        made = []
        for name, content in iterator:
            raw = content.encode() if isinstance(content, str) else bytes(content)
            if self.archive:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{name.rsplit('.', 1)[0]}.lef", raw)
                raw = out.getvalue()
            held = f"{path}/_{uuid.uuid4().hex}"
            with where.open_output_stream(held) as file:
                file.write(raw)
            made.append((held, f"{path}/{name}"))
        return Written(made)

    def commit(self, messages: list) -> None:
        where, path = _opened(self.path)
        where.create_dir(path, recursive=True)
        if self.overwrite:
            for info in where.get_file_info(fs.FileSelector(path)):
                if info.type == fs.FileType.File and not info.base_name.startswith("_"):
                    where.delete_file(info.path)
        for message in messages:
            for held, name in message.files if message else ():
                where.move(held, name)

    def abort(self, messages: list) -> None:
        where, _ = _opened(self.path)
        for message in messages:
            for held, _ in message.files if message else ():
                where.delete_file(held)


class MeetArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "meet_archive"

    @property
    def kind(self) -> str:
        return self.options.get("rows", "results")

    def schema(self) -> str:
        return KINDS[self.kind]

    def reader(self, schema: StructType) -> ArchiveReader:
        endings = (".txt",) if self.kind == "lines" else (".lxf", ".lef", ".xml", ".zip")
        return ArchiveReader(self.options["path"], self.kind, schema.names, endings, frozenset(filter(None, self.options.get("names", "").split(","))))

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if [f.dataType.simpleString() for f in schema] not in (["string", "string"], ["string", "binary"]):
            raise ValueError("a row is a file's name and its content")
        return FileWriter(self.options["path"], self.options.get("archive", "false") == "true", overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MeetArchive)


def parsed(files: DataFrame, kind: str) -> DataFrame:
    """The same rows of files that Spark has read (``binaryFile``: path, content), from any store that it reads."""
    names = [name for name, _ in _names(kind)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                if raw.is_valid:
                    yield from _batches(rows_of(path, raw.as_py(), kind), kind, names)

    return files.select("path", "content").mapInArrow(run, KINDS[kind])
