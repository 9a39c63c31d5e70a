"""Sheets by name and heading, club sync, overrides, entry points, partitions on storage."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from splitboard.functions import text
from splitboard.operators import meet, state
from splitboard.sinks import tables
from splitboard.sources import sheets


def test_sheet_by_name_and_heading(spark, tmp_path, workbook):
    book = workbook({"Notes": (["x"], [("y",)]), "Kulüp Listesi": (["Şehir", "Ad", "Boş"], [("Ankara", "A SK", None), ("İzmir", None, "z")])})
    (tmp_path / "a.xlsx").write_bytes(book)
    (tmp_path / "b.xlsx").write_bytes(workbook({"Other": (["Ad"], [("q",)])}))
    rows = sheets.read_sheet(spark, str(tmp_path), {"Ad": "name", "Şehir": "city", "Yok": "none"}, sheet="Kulüp Listesi", header_row=1).collect()
    assert [(r.row_no, r.name, r.city, r.none) for r in sorted(rows, key=lambda r: r.row_no)] == [(2, "A SK", "Ankara", None), (3, None, "İzmir", None)]
    by_letter = sheets.read_sheet(spark, str(tmp_path), {"A": "x"}, sheet=1)
    assert sorted(r.x for r in by_letter.collect()) == ["q", "y"]


def test_club_sync(spark):
    stored = spark.createDataFrame([("enka", "Enka", "Enka", "İzmir", 9), ("eski", "Eski", "Eski", "Van", 5)], "key string, alt string, club string, city string, region int")
    rows = [
        ("Enka", "Enka Spor Kulübü", "İstanbul", "1", 5), ("Enka", None, "Bursa", "2", 6), (None, "Yeni SK", "Muş", "4", 7), ("x", "y", None, "1", 8), ("x", "y", "Ordu", "b", 9), (None, " ", "Ordu", "1", 10),
    ]
    sheet = spark.createDataFrame(rows, "alt string, canonical string, city string, region string, row_no int")
    clubs, loaded = sheets.sync_clubs(stored, sheet, text.normalize_for_lookup)
    got = {r.key: (r.alt, r.club, r.city, r.region) for r in clubs.collect()}
    assert got == {
        "enka": ("Enka", None, "Bursa", 2), "enka spor kulubu": ("Enka Spor Kulübü", "Enka Spor Kulübü", "İstanbul", 1), "yeni spor kulubu": ("Yeni SK", "Yeni SK", "Muş", 4), "eski": ("Eski", "Eski", "Van", 5),
    }
    log = sheets.sync_report(sheet, loaded, F.current_timestamp()).first()
    assert (log.read, log.loaded, log.skipped) == (6, 3, 3)
    again, _ = sheets.sync_clubs(clubs, sheet, text.normalize_for_lookup)
    assert sorted(map(str, again.collect())) == sorted(map(str, clubs.select(again.columns).collect()))


def test_override_region(spark, tmp_path):
    own = {"name": "Ada Test", "birth_year": 2012, "gender": "F", "resolution": "same", "canonical_name": "", "canonical_club": "", "canonical_city": "Ankara", "canonical_region": 3}
    (tmp_path / "o.json").write_text(json.dumps({"club_aliases": [], "name_overrides": [own]}))
    _, names = sheets.read_overrides(spark, str(tmp_path / "o.json"))
    rows = spark.createDataFrame([("ada test", 2012, "F", "X", "Y", 1), ("ece", 2012, "F", "X", "Y", 1)], "name string, birth_year int, gender string, club string, city string, region int")
    assert {(r.name, r.city, r.region) for r in meet.manual_overrides(rows, names).collect()} == {("ada test", "Ankara", 3), ("ece", "Y", 1)}


def test_roster_clubs(spark):
    pairs = [
        ("Enka Spor Kulübü", "ENKA", True), ("Ankara Gençlik ve Spor İl Müdürlüğü", "Ankara", True), ("Büyükşehir Belediyesi Bursa", "Bursa A.S.", True), ("Enka", "Galatasaray", False), (None, "x", True), ("", "x", True),
        ("Spor Kulübü", "Belediyesi", False), ("Asya", "Ya", True), ("İzmir Belediyesi", "Ordu Belediyesi", False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r.got for r in df.select(text.roster_club_match(F.col("a"), F.col("b")).alias("got")).collect()] == [w for *_, w in pairs]


def test_entry_points(spark):
    starts = spark.createDataFrame([("free", "F", 2900), ("free", "", 2900), ("free", "F", None), ("free", "M", 9999), ("fly", "F", 100)], "event string, gender string, t long")
    steps = spark.createDataFrame([("free", "F", 5, 3000), ("free", "F", 9, 2900), ("free", "M", 3, 3000)], "event string, gender string, points int, limit long")
    got = [(r.event, r.gender, r.entry_points) for r in state.with_entry_points(starts, steps, ["event"], "gender", "t").collect()]
    assert sorted(got) == sorted([("free", "F", 9), ("free", "", 3), ("free", "F", 0), ("free", "M", 0), ("fly", "F", 0)])


def test_partitions_on_storage(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "n int, k string")
    tables.write_table(rows, path, ["k"])
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "k=b").iterdir()}
    tables.replace_partitions(spark.createDataFrame([("a", 100), ("d", 101)], "k string, n int"), path, ["k"])
    read = lambda: sorted((r.k, r.n) for r in spark.read.parquet(path).collect())
    want = sorted([("bc"[i % 3 - 1], i) for i in range(30) if i % 3] + [("a", 100), ("d", 101)])
    assert read() == want and kept == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "k=b").iterdir()}
    tables.replace_partitions(rows.limit(0), path, ["k"])
    assert read() == want
    lost = spark.range(40, numPartitions=4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("int").alias("n"), F.lit("b").alias("k"))
    with pytest.raises(Exception, match="lost"):
        tables.replace_partitions(lost, path, ["k"])
    assert read() == want
