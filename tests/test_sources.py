"""Sources and sinks on synthetic documents."""

from __future__ import annotations

import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitboard.functions.text import normalize_for_lookup
from splitboard.sinks import books, files
from splitboard.sources import archive, html, lenex, lines, sheets
from splitboard.streaming import live

MEET = """<?xml version="1.0"?><LENEX><MEETS><MEET startdate="2026-01-02"><SESSIONS><SESSION date="2026-01-03"><EVENTS>
<EVENT eventid="1" gender="F"><SWIMSTYLE distance="50" stroke="FREE"/></EVENT>
<EVENT eventid="2" gender="F"><SWIMSTYLE distance="75" stroke="FREE"/></EVENT>
<EVENT eventid="3" gender="M"><SWIMSTYLE distance="100" stroke="BACK" relaycount="4"/></EVENT>
</EVENTS></SESSION></SESSIONS><CLUBS><CLUB name="Test &amp; Kul&#252;p"><ATHLETES>
<ATHLETE firstname="Ada" lastname="Deniz" birthdate="2013-05-05" gender="F"><RESULTS>
<RESULT eventid="1" swimtime="00:00:30.05" status=""/><RESULT eventid="2" swimtime="00:00:40.00"/><RESULT eventid="1" swimtime="00:00:31.00" status="DSQ"/>
<RESULT eventid="9" swimtime="00:00:31.00"/><RESULT eventid="1" swimtime="00:00:00.00"/></RESULTS>
<ENTRIES><ENTRY eventid="1" entrytime="00:00:29.00"/><ENTRY eventid="1" entrytime="NT"/></ENTRIES></ATHLETE>
<ATHLETE firstname="Ege" lastname="Su" birthdate="" gender="M"><RESULTS/><ENTRIES><ENTRY eventid="1" entrytime="00:00:28.00"/></ENTRIES></ATHLETE>
</ATHLETES></CLUB></CLUBS></MEET></MEETS></LENEX>"""


def test_lenex(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "m.lxf", "w") as z:
        z.writestr("m.lef", MEET)
    (tmp_path / "broken.lxf").write_bytes(b"PK\x03\x04nothing")
    rows = lenex.results(lenex.read_meets(spark, str(tmp_path))).collect()
    assert [(r.name, r.birth_year, r.stroke, r.distance, r.cents, r.gender) for r in rows] == [("Ada Deniz", 2013, "Serbest", 50, 3005, "F")]
    assert rows[0].club.startswith("Test & ")
    entered = lenex.entries(lenex.read_meets(spark, str(tmp_path), "entries"))
    assert sorted((r.name, r.entry_cents) for r in entered.collect() if r.entry_cents) == [("Ada Deniz", 2900)]
    assert entered.count() == 2
    assert lenex.meet_dates(lenex.read_meets(spark, str(tmp_path), "meets")).first().race_date == "2026.01.02"


def test_first_accepted(spark):
    rows = [("k", 1, b"short"), ("k", 2, b"x" * 200), ("k", 3, b"PK" + b"y" * 200), ("k", 4, b"<?xml" + b"y" * 200)]
    got = lenex.first_accepted(spark.createDataFrame(rows, "k string, p int, c binary"), "k", "p", "c").collect()
    assert [r.p for r in got] == [3]


PAGE = """<html lang="tr"><head><title>Meet</title></head><table>
<tr><td>1</td><td>Kızlar</td><td>200m Serbest</td><td><a href="x/StartList_5.pdf">s</a></td><td><a href="x/ResultList_5.pdf">r</a></td></tr>
<tr><td>2</td><td>Erkekler 4x100m Serbest</td><td><a href="x/ResultList_6.pdf">r</a></td></tr>
<tr><td>3</td><td>Erkekler</td><td>50m Kelebek</td><td><a href="x/StartList_7.pdf">s</a></td></tr></table></html>"""


def test_html(spark):
    pages = spark.createDataFrame([("p", PAGE)], "url string, html string")
    results = html.event_map(pages, "url", "html")
    assert [(r.file, r.gender, r.distance, r.stroke) for r in results.collect()] == [("ResultList_5.pdf", "F", 200, "Serbest")]
    full = html.propagate_start_lists(html.event_map(pages, "url", "html", "StartList"), results, "url")
    assert {(r.file, r.gender) for r in full.collect()} == {("ResultList_5.pdf", "F"), ("ResultList_7.pdf", "M")}
    found = html.numbered_links(pages, "url", "html", "ResultList", F.lit("http://h/")).orderBy("number").collect()
    assert [(r.number, r.link) for r in found] == [(5, "http://h/x/ResultList_5.pdf"), (6, "http://h/x/ResultList_6.pdf")]
    assert html.page_meta(pages, "url", "html").first().language == "tr"
    hinted = html.file_hints(spark.createDataFrame([("ResultList_5.pdf",)], "file string"), results, "file").first()
    assert (hinted.pdf_seq, hinted.distance) == (5, 200)


@pytest.fixture(scope="module")
def result_lines(spark):
    texts = [
        (1, 1, "Yarış 10, Kızlar, 50m Serbest, 13 yaş"), (1, 2, "SIRA YB KULÜP"), (1, 3, "1. Test Yüzücü 13 Ankara SK 28.51 394"),
        (2, 1, "2. Deneme Kişi 12 Bursa YK 1:06.44 340 32.23"), (2, 2, "Erkekler 100m Kelebek"), (2, 3, "3. Başka Biri 62 14 1:10.00 200"), (2, 4, "no time here 13 x"),
    ]
    return spark.createDataFrame([("d", *t) for t in texts], "doc string, page int, line_no int, text string")


def test_result_lines(result_lines):
    got = [(r.name, r.club, r.birth_year, r.cents, r.gender, r.distance, r.stroke) for r in lines.result_lines(result_lines).orderBy("page", "line_no").collect()]
    assert got == [
        ("Test Yüzücü", "Ankara SK", 2013, 2851, "F", 50, "Serbest"),
        ("Deneme Kişi", "Bursa YK", 2012, 6644, "F", 50, "Serbest"),
        ("Başka Biri", "Bilinmiyor", 2012, 7000, "M", 100, "Kelebek"),
    ]


KEPT = [
    ("1. Sıraç Test 13 Ankara SK 28.51", ("Sıraç Test", "Ankara SK", 2851, None)), ("2. Yerlikaya Ali 13 Bursa 29.00", ("Yerlikaya Ali", "Bursa", 2900, None)),
    ("3. Ali Veli 13 (Tk) Ted Ankara Koleji 28.55", ("Ali Veli", "Ted Ankara Koleji", 2855, "TK")), ("4. (Fd) Can Er 13 Okul Spor 30.00", ("Can Er", "Okul Spor", 3000, "FD")),
    ("5. Su Test 13 Ankara Spoi5:09.45i445 1:10.61", ("Su Test", "Ankara Spoi", 30945, None)), ("6. EceTESTOGLU 13 Enka SK 31.10", ("Ece TESTOGLU", "Enka SK", 3110, None)),
    ("7. BensuTest 13 Yeni Nesil Kulubu3: 28.55", ("Bensu Test", "Yeni Nesil Kulubu", 3 * 6000 + 2855, None)), ("8. CiVELEK Ada 13 Enka 2:40.35", ("CiVELEK Ada", "Enka", 16035, None)),
    ("9. A Alanur Deniz 13 Enka Sp1: 2:40.35", ("Alanur Deniz", "Enka Sp", 10035, None)),
]
SKIPPED = ["Disk. Test Sporcu 13 Enka 28.55", "Test Sporcu DSQ 13 Enka 28.55", "Test Sporcu 13 Enka 28.55 50m: 28.58", "28.55 30.10", "Katılım Barajı 13 x 28.55", "1. - 3. gün 13 x 30.00"]


def test_result_line_rules(spark):
    texts = ["Yarış 100, Kızlar, 50m Serbest", *(t for t, _ in KEPT), *SKIPPED]
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)], "doc string, page int, line_no int, text string")
    got = {texts[r.line_no]: (r.name, r.club, r.cents, r.participant_type) for r in lines.result_lines(df).collect()}
    assert got == dict(KEPT)


def test_event_in_force(spark):
    """A glued header begins its event; a note with a distance and stroke begins none."""
    texts = ["Yarış 7, Erkekler, 50m Serbest", "1. Ali Test 13 Enka 28.51", "Yarış 8, Kızlar, 100mSerbest", "1. Ada Test 13 Enka 1:08.51", "Not: 50m Kelebek barajlı", "2. Ece Test 13 Enka 1:09.00"]
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)], "doc string, page int, line_no int, text string")
    got = [(r.name, r.gender, r.distance, r.stroke) for r in lines.result_lines(df).orderBy("line_no").collect()]
    assert got == [("Ali Test", "M", 50, "Serbest"), ("Ada Test", "F", 100, "Serbest"), ("Ece Test", "F", 100, "Serbest")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Yarış 100, Erkekler, 50m Serbest", ("M", 50, "Serbest")), ("Yarış 50, Kızlar, 200m Serbest, 11 yaş", ("F", 200, "Serbest")), ("Yarış 3, 100 m Kelebek", ("M", 100, "Kelebek")),
        ("Yarış 3, Kızlar, 500m Serbest", None), ("Kızlar 1000 m Serbest", None), ("Ali 13 50m Serbest 28.55", None),
        ("Yarış 8, Kızlar, 100mSerbest", ("F", 100, "Serbest")), ("YARIŞ 8,KIZLAR,200mKurbağalama", ("F", 200, "Kurbağalama")), ("Yarış 12 Bayanlar50mSırtüstü, 11 yaş", ("F", 50, "Sırtüstü")),
        ("Not: 50m Serbest barajlı yarışlar", None), ("Kızlar 50m Serbest baraj 30.00", None), ("Kızlar 200m Serbest", ("F", 200, "Serbest")), ("50m Serbest", None),
        ("Yarış 9, Oğlanlar, 50m Kelebek 12.04.2026", ("M", 50, "Kelebek")), ("Yarış 9, 50m: Kelebek", None),
    ],
)
def test_header(spark, text, want):
    got = spark.range(1).select(lines.header(F.lit(text)).alias("h")).first().h
    assert (tuple(got) if got else None) == want


def test_meet_documents(spark):
    """Single quotes, entities, encodings, comments and name spaces, by a real parser."""
    body = "<LENEX xmlns='urn:x'><MEETS><MEET startdate='2026-01-02'><!-- <CLUB name='gone'/> --><EVENTS><EVENT eventid='1'><SWIMSTYLE distance='50' stroke='FREE'/></EVENT></EVENTS><CLUBS><CLUB name='M&#252;ller &amp; K\u00f6'><ATHLETES><ATHLETE firstname='A' lastname='B' birthdate='2013-01-01' gender='F'><RESULTS><RESULT eventid='1' swimtime='00:00:30.05'/></RESULTS></ATHLETE></ATHLETES></CLUB></CLUBS></MEET></MEETS></LENEX>"
    raw = [f"<?xml version='1.0' encoding='{e}'?>{body}".encode(e) for e in ("utf-8", "iso-8859-9", "utf-16")] + [b"<broken", b"", b"plain"]
    files = spark.createDataFrame([(str(i), bytearray(t)) for i, t in enumerate(raw)] + [("none", None)], "path string, content binary")
    assert sorted((r.path, r.club, r.cents) for r in lenex.results(archive.parsed(files, "results")).collect()) == [(str(i), "M\u00fcller & K\u00f6", 3005) for i in range(3)]
    assert {r.race_date for r in lenex.meet_dates(archive.parsed(files, "meets")).collect()} == {"2026.01.02"}


def test_archive_source(spark, tmp_path):
    """Files are written by tasks and committed, read by columns and filters, and lost ones are not half there."""
    archive.register(spark)
    out = str(tmp_path / "meets")
    texts = [(f"m{i}.lxf", MEET.replace("Ada", f"Ada{i}")) for i in range(6)]
    df = spark.createDataFrame(texts, "name string, content string").repartition(3)
    df.write.format("meet_archive").option("archive", "true").mode("overwrite").save(out)
    read = spark.read.format("meet_archive").load(out)
    assert sorted(p.name for p in (tmp_path / "meets").iterdir()) == [n for n, _ in texts] and read.rdd.getNumPartitions() == 6
    assert {r.path.rsplit("/", 1)[-1] for r in read.where("name = 'Ada3 Deniz' AND distance = 50").collect()} == {"m3.lxf"}
    some = spark.read.format("meet_archive").schema("club string, distance int").option("names", "m2.lxf,m4.lxf").load(out)
    assert some.columns == ["club", "distance"] and some.rdd.getNumPartitions() == 2 and 3 * some.count() == read.count()
    lines_ = spark.createDataFrame([("a.txt", "one\ntwo\n\fthree"), ("b.txt", "")], "name string, content string")
    lines_.write.format("meet_archive").mode("append").save(str(tmp_path / "lists"))
    got = spark.read.format("meet_archive").option("rows", "lines").load(str(tmp_path / "lists")).collect()
    assert [tuple(r) for r in sorted(got)] == [("a", 1, 1, "one"), ("a", 1, 2, "two"), ("a", 2, 1, "three")]
    broken = df.select("name", F.when(F.col("name") == "m5.lxf", F.raise_error(F.lit("lost"))).otherwise(F.col("content")).cast("string").alias("content"))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("meet_archive").mode("append").save(str(tmp_path / "lost"))
    left = list((tmp_path / "lost").iterdir()) if (tmp_path / "lost").exists() else []
    assert all(p.name.startswith("_") for p in left) and spark.read.format("meet_archive").load(out).count() == read.count()


def test_start_lines(spark):
    rows = [("d", 1, 1, "Kızlar 200m Serbest"), ("d", 1, 2, "1 4 Test Yüzücü 13 Ankara SK 2:29.00"), ("d", 1, 3, "1 5 Öbür Kişi 13 Ankara SK NT")]
    df = spark.createDataFrame(rows, "doc string, page int, line_no int, text string")
    got = [(r.name, r.club, r.birth_year, r.entry_cents) for r in lines.start_lines(df).orderBy("line_no").collect()]
    assert got == [("Test Yüzücü", "Ankara SK", 2013, 14900), ("Öbür Kişi", "Ankara SK", 2013, None)]


def test_progression_lines(spark):
    texts = ["Ankara Spor Kulübü", "Test YÜZÜCÜ, 2012 (14 yas), Erkekler", "50m Serbest 128. 28.43 416 28.00 97%", "Bursa Yüzme Kulübü", "50m Serbest 1. 29.00"]
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)], "doc string, page int, line_no int, text string")
    got = [(r.club, r.name, r.birth_year, r.distance, r.cents) for r in lines.progression_lines(df).collect()]
    assert got == [("Ankara Spor Kulübü", "Test YÜZÜCÜ", 2012, 50, 2843)]


def test_progression_gender(spark):
    """The words after the bracket count, not a name."""
    texts = ["Ankara Spor Kulübü", "Ali KIZILTAN, 2012 (14 yas), Erkekler", "50m Serbest 28.43", "Ada BAYANER, 2012 (14 yas), Kızlar", "50m Serbest 29.43"]
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)], "doc string, page int, line_no int, text string")
    assert [(r.name, r.gender) for r in lines.progression_lines(df).orderBy("line_no").collect()] == [("Ali KIZILTAN", "M"), ("Ada BAYANER", "F")]


def test_lines_of_boxes(spark):
    boxes = [("d", 1, 50.0, 10.0, "Yüzücü"), ("d", 1, 0.0, 12.0, "Test"), ("d", 1, 90.0, 27.0, "Kulüp28.51"), ("d", 1, 0.0, 31.0, "1: 06.44")]
    df = spark.createDataFrame(boxes, "doc string, page int, x double, y double, text string")
    assert [r.text for r in lines.lines_of_boxes(df).orderBy("line_no").collect()] == ["Test Yüzücü Kulüp 28.51", "1:06.44"]


@pytest.mark.parametrize("words", [("5", ": 11.49"), ("5:", "11.49"), ("5", ":", "11.49"), ("5 :11.49",)])
def test_parted_minutes(spark, words):
    df = spark.createDataFrame([("d", 1, float(i), 1.0, w) for i, w in enumerate(words)], "doc string, page int, x double, y double, text string")
    assert lines.lines_of_boxes(df).first().text == "5:11.49"


def test_first_source(spark):
    df = spark.createDataFrame([("d", 2, "a"), ("d", 1, "b"), ("e", 3, "c")], "doc string, p int, v string")
    assert sorted(r.v for r in lines.first_source(df, "doc", "p").collect()) == ["b", "c"]


def test_sheets(spark, tmp_path, workbook):
    rows = [("A", None, "C", None, "E", None, "G")] * 3 + [("Ank SK", None, "Ankara SK", None, "Ankara", None, "4"), ("x", None, None, None, None, None, "4"), ("Bursa", None, None, None, "Bursa", None, "iki")]
    (tmp_path / "map.xlsx").write_bytes(workbook({"s": (list("ABCDEFG"), rows)}))
    sheet = sheets.read_sheet(spark, str(tmp_path / "map.xlsx"), {"A": "alt", "C": "canonical", "E": "city", "G": "region"}, first_row=5)
    assert sheet.count() == 3
    mapping = sheets.club_mapping(sheet, normalize_for_lookup).collect()
    assert sorted((r.key, r.club, r.city, r.region) for r in mapping) == [("ank spor kulubu", "Ankara SK", "Ankara", 4), ("ankara spor kulubu", "Ankara SK", "Ankara", 4)]
    assert sheets.sync_report(sheet, sheets.club_mapping(sheet, normalize_for_lookup), F.current_timestamp()).first().read == 3


def test_overrides(spark, tmp_path):
    doc = {"club_aliases": [{"raw": "_ornek", "canonical": "a", "city": "b", "region": 1}, {"raw": "r", "canonical": "c", "city": "d", "region": 2}, {"raw": "q", "canonical": "c"}],
           "name_overrides": [{"name": "n", "birth_year": 2012, "gender": "F", "resolution": "same"}, {"name": "m", "resolution": "different"}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    aliases, names = sheets.read_overrides(spark, str(tmp_path / "o.json"))
    assert [r.raw for r in aliases.collect()] == ["r"] and [r.name for r in names.collect()] == ["n"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", 1, "e1", 5), ("g", 1, "e2", 9), ("g", 2, "e1", 1)], "grp string, athlete int, event string, points int")
    out = files.nested(df, ["grp"], ["athlete"], ["event", "points"], -F.col("points"))
    people = json.loads(out.first().athletes)
    assert [p["athlete"] for p in people] == [1, 2] and [e["event"] for e in people[0]["events"]] == ["e2", "e1"]
    files.write_json(out, str(tmp_path / "j"))
    files.write_script(out, "athletes", str(tmp_path / "s"))
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "s")).first().value.startswith("window.RESULTS = [")
    books.write_reports({"Liste": df, "Özet & mehr": df.groupBy("grp").count()}, str(tmp_path / "b"), "report")
    book = (tmp_path / "b" / "report.xlsx").read_bytes()
    assert [r["C"] for r in sheets.sheet_rows(book)] == ["event", "e1", "e2", "e1"] and sheets.sheet_rows(book, "Özet & mehr")[1] == {"A": "g", "B": "3"}


def test_books(spark, tmp_path, monkeypatch):
    """Many books of one write, each by one task; a write that fails leaves none."""
    rows = [(f"b{b}", f"s{s}", r, [f"{b}.{s}.{r}", None, "<&>"], None) for b in range(5) for s in range(2) for r in range(1, 4)]
    df = spark.createDataFrame(rows, books.SCHEMA).repartition(4)
    books.write_books(df, str(tmp_path / "b"), {"s1": 0})
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == [f"b{i}.xlsx" for i in range(5)]
    for b in range(5):
        raw = (tmp_path / "b" / f"b{b}.xlsx").read_bytes()
        assert [[r["A"] for r in sheets.sheet_rows(raw, n)] for n in (1, 2)] == [[f"{b}.{s}.{r}" for r in range(1, 4)] for s in (1, 0)]
        assert sheets.sheet_rows(raw, "s0")[0] == {"A": f"{b}.0.1", "C": "<&>"}
    lost = df.withColumn("style", F.when(F.col("book") == "b4", F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception, match="lost"):
        books.write_books(lost, str(tmp_path / "lost"))
    assert not list((tmp_path / "lost").glob("*.xlsx"))
    monkeypatch.setattr(books, "ROWS", 2)
    with pytest.raises(Exception, match="more rows than a sheet holds"):
        books.write_books(df, str(tmp_path / "full"))


def test_live_upsert(spark, tmp_path):
    schema = "k int, t int, n int"
    spark.createDataFrame([(1, 10, 1), (2, 20, 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: live.landing(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    target, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    live.upsert_stream(stream(), target, ["k"], "t", "n", progress).awaitTermination()
    spark.createDataFrame([(1, 12, 3), (2, 15, 4), (3, 1, 5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live.upsert_stream(stream(), target, ["k"], "t", "n", progress).awaitTermination()
    got = {(r.k, r.t, r.n) for r in live.newest_version(spark, target).collect()}
    assert got == {(1, 10, 1), (2, 15, 4), (3, 1, 5)}
