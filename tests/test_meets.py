"""Whole meets, tables of rules and state, reports and workbooks on hand-made rows."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from splitboard.functions.text import normalize_for_lookup
from splitboard.operators import meet, report, score, state
from splitboard.sinks import layouts
from splitboard.sources import dimensions, html, lines
from splitboard.sources.sheets import sheet_rows
from splitboard.streaming import live

CLUBS = "key string, club string, city string, region int, at long"
OVERRIDES = "name_normalized string, birth_year int, club_override string, city string, region int, display_name string, id long"


def raw(spark, *rows):
    """(meet, line, name, club, year, stroke, distance, cents, source)"""
    made = spark.createDataFrame(list(rows), "meet string, line_no int, name_raw string, club_raw string, birth_year int, stroke string, distance int, cents long, source string")
    return meet.conform(made.withColumn("gender", F.lit("F")))


def test_enrich_results(spark):
    rows = raw(
        spark, ("m", 1, "ADA TEST", "x spor", 2012, "Serbest", 50, 3000, "pdf"), ("m", 2, "ece test", "xspor", 2012, "Serbest", 50, 3100, "pdf"),
        ("m", 3, "Can TEST", "small club", None, "Serbest", 50, 3200, "pdf"), ("m", 4, "Nil TEST", "unknown", 2013, "Serbest", 50, 6543, "pdf"),
        ("m", 5, None, None, None, None, None, None, None),
    )
    stored = spark.createDataFrame([("x spor", "X Old", "A", 1, 1), ("x spor", "X Spor", "Ankara", 2, 2)], CLUBS)
    sheet = spark.createDataFrame([("x spor", "Y", "B", 3, 1), ("small club", "small club", "İzmir", 4, 1)], CLUBS)
    over = spark.createDataFrame([("nil test", None, "", "Bursa", 0, "", 1), ("nil test", 2012, "Other", "", 0, "", 2)], OVERRIDES)
    got = {r["line_no"]: r for r in meet.enrich_results(rows, over, stored, sheet, {"ece": "Eçe"}).collect()}
    assert [got[1][c] for c in ("name", "club", "city", "region", "club_found", "yb", "age", "time_text")] == ["Ada Test", "X Spor", "Ankara", 2, True, "12", 14, "30.00"]
    # Without spaces the sheet comes before the stored clubs.
    assert [got[2][c] for c in ("name", "club", "city")] == ["Eçe Test", "Y", "B"]
    assert [got[3][c] for c in ("club", "city", "club_found", "yb", "age")] == ["Small Club", "İzmir", True, "", None]
    # An override for any year replaces the lookup, its empty texts and region 0 are none.
    assert [got[4][c] for c in ("club", "city", "region", "club_found", "time_text")] == ["Unknown", "Bursa", None, True, "1:05.43"]
    assert got[5]["club_found"] is False and got[5]["name"] == ""


def test_meet_results(spark):
    archive = raw(spark, ("a", 1, "Ada Test", "X", 2012, "Serbest", 50, 3000, "lenex"))
    listed = raw(
        spark, ("a", 1, "Not Taken", "X", 2012, "Serbest", 50, 2000, "pdf"),
        ("b", 1, "Can Deniz Test", "X", 2012, "Serbest", 50, 3100, "pdf"), ("b", 2, "C. Test", "X", 2012, "Serbest", 50, 3000, "pdf"), ("b", 3, "D. Test", "X", 2012, "Serbest", 50, 3300, "pdf"),
        ("b", 4, "Candeniztest", "Q", 2012, "Serbest", 100, 7000, "pdf"), ("b", 5, "Nil Test", "X", None, "Serbest", 50, 3100, "pdf"), ("b", 6, "Nil Test", "X", None, "Serbest", 50, 3000, "pdf"),
        ("b", 7, "Ahmet Ylmaz", "X", 2011, "Serbest", 50, 2900, "ocr"),
    )
    none, over = spark.createDataFrame([], CLUBS), spark.createDataFrame([], OVERRIDES)
    dates = spark.createDataFrame([("a", "2026.01.02")], "meet string, race_date string")
    known = spark.createDataFrame([("Ahmet Yilmaz", 2011, "F"), ("Ahmet Yilmazer", 2012, "F")], "known_name string, birth_year int, gender string")
    got = meet.meet_results(archive, listed, dates, over, none, none, athletes=known).collect()
    assert sorted((r["meet"], r["name"], r["distance"], r["cents"], r["race_date"]) for r in got) == [
        ("a", "Ada Test", 50, 3000, "2026.01.02"), ("b", "Ahmet Yilmaz", 50, 2900, ""), ("b", "Can Deniz Test", 50, 3000, ""), ("b", "Can Deniz Test", 100, 7000, ""),
        ("b", "D Test", 50, 3300, ""), ("b", "Nil Test", 50, 3000, ""),
    ]
    assert meet.meet_results(archive.limit(0), listed.limit(0), dates, over, none, none).count() == 0


def test_manual_overrides(spark):
    rows = spark.createDataFrame([("Ada Test", 2012, "F", "X", "A", 1), ("Ada Test", 2011, "F", "X", "A", 1), (None, None, None, None, None, None)], "name string, birth_year int, gender string, club string, city string, region int")
    over = spark.createDataFrame([(" ADA TEST ", 2012, "F", "same", "", "New", None, 5), ("ada test", 2011, "F", "other", "Z", "Z", "Z", 9)], "name string, birth_year int, gender string, resolution string, canonical_name string, canonical_club string, canonical_city string, canonical_region int")
    got = sorted(meet.manual_overrides(rows, over).collect(), key=lambda r: r["birth_year"] or 0)
    assert [tuple(r) for r in got] == [(None,) * 6, ("Ada Test", 2011, "F", "X", "A", 1), ("Ada Test", 2012, "F", "New", "A", 5)]
    codes = spark.createDataFrame([("Kız",), ("erkek",), ("f",), ("",), (None,)], "g string").select(meet.gender_code(F.col("g"), {"Kız": "F", "erkek": "M"}))
    assert [r[0] for r in codes.collect()] == ["F", "M", "F", None, None]
    assert meet.cohort(rows, "birth_year", None).count() == 3 and meet.cohort(rows, "birth_year", [2012]).count() == 1


def test_dimensions(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("points,max_cs,stroke,distance,gender,birth_year,extra\n5,29.86,Serbest,50,F,2012,x\n4,1:03.42,Serbest,50,F,2012,x\n5,3000,Serbest,50,F,2012,x\n,3000,Serbest,50,F,2012,x\n")
    got = dimensions.load(spark, "thresholds", str(path))
    assert got.columns == dimensions.schema("thresholds").names
    assert sorted((r["points"], r["max_cs"]) for r in got.collect()) == [(4, 6342), (5, 2986)]
    for name in dimensions.SCHEMAS:
        assert dimensions.empty(spark, name).count() == 0 and set(dimensions.key(name)) <= set(dimensions.schema(name).names)
    old = spark.createDataFrame([("2012", 5, "kept")], "birth_year string, tr int, note string")
    assert dimensions.migrated(old, "quotas").columns == ["birth_year", "tr", "region_1", "region_other", "min_points", "note"]
    assert dimensions.migrated(old, "quotas").first()["birth_year"] == 2012


def test_state(spark):
    events = spark.createDataFrame([(1, "pending", 1), (2, "pending", 1), (3, "pending", 1), (3, "same_person", 2)], "id int, status string, at int")
    told = spark.createDataFrame([(1, "same_person", 5), (1, "different_person", 6), (2, "maybe", 5), (3, "different_person", 5), (9, "same_person", 5)], "id int, status string, at int")
    done = state.resolve_conflicts(events, told, "id", "status", "at")
    assert done.count() == 5 and done.where("id = 1 AND status = 'same_person' AND at = 5").count() == 1
    assert [r["id"] for r in state.conflict_status(done, "id", "status", "at").collect()] == [2]
    people = spark.createDataFrame([(4, "A", None), (7, "B", "n")], "id long, name string, notes string")
    more = state.create(people, spark.createDataFrame([("C",), ("D",)], "name string"), "id")
    ids = [r["id"] for r in more.collect()]
    assert len(set(ids)) == 4 and sorted(ids)[:2] == [4, 7] and sorted(ids)[2] > 7
    assert state.create(people.limit(0), spark.createDataFrame([("C",)], "name string"), "id").first()["id"] >= 1
    assert state.find(people, notes=None).first()["id"] == 4 and state.find(people, name="B", id=7).count() == 1
    assert state.find(state.update(people, "id", 4, notes="x"), notes="x").first()["name"] == "A"
    rows = spark.createDataFrame([(1, 30, 1), (None, 30, 2)], "k int, t int, n int")
    new = spark.createDataFrame([(1, 20, 3), (None, 40, 4)], "k int, t int, n int")
    assert sorted(r["n"] for r in state.upsert_unmatched(rows, new, ["k"], "t", "n").collect()) == [2, 3, 4]
    over = spark.createDataFrame([("a", None, 1), ("a", 2012, 2)], "name string, year int, id int")
    assert sorted(r["id"] for r in state.add_override(over, spark.createDataFrame([("a", None, 3)], "name string, year int, id int"), ["name", "year"], "id").collect()) == [2, 3]


def test_sequence_order(spark):
    rows = spark.createDataFrame([("a", "f1", 5), ("a", "f2", 5), ("a", "r1", 5), ("a", "r2", 5), ("a", "f3", 7), ("b", "r1", 9), ("c", "f1", 0)], "who string, event string, points int")
    got = {r["who"]: r["events"] for r in score.event_sequence(rows, ["who"], "event", "points", F.col("event").startswith("r")).collect()}
    assert got == {"a": ["f3", "f2", "f1", "r2"], "b": ["r1"]}


def test_roster_and_page_meta(spark):
    told = ["ignored 1. - 2", "Deniz Spor", "Sayfa 1", "Ada TEST, 2012 (14 yaş), Kızlar", "50m Serbest", "28.43", "Ada Test, 2012 (14 yas), Kız", "Can TEST, 2009 (17 yaş), Erkekler", "Göl Spor", "Nil TEST, 2013 (13 yaş), Bayanlar", "Efe TEST, 2011 (15 yaş), Erkek"]
    rows = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(told)], "doc string, page int, line_no int, text string")
    got = lines.roster_lines(rows, (2011, 2012, 2013)).collect()
    assert sorted((r["name"], r["birth_year"], r["gender"], r["club"]) for r in got) == [
        ("Ada TEST", 2012, "F", "Deniz Spor"), ("Efe TEST", 2011, "M", "Göl Spor"), ("Nil TEST", 2013, "F", "Göl Spor")
    ]
    assert lines.roster_lines(rows).count() == 4
    page = "<html><table class='a'><tr><td><b>Kupa</b></td><td>x</td></tr><tr><td>Ankara</td><td>2 - 4 / 5 / 2026</td></tr></table><table><tr><td>no</td></tr></table></html>"
    pages = spark.createDataFrame([(1, page), (2, "<table><tr><th>Only</th><th>Here</th></tr></table>"), (3, "none"), (4, None)], "id int, html string")
    got = {r["id"]: tuple(r)[1:] for r in html.meet_meta(pages, "id", "html").collect()}
    assert got == {1: ("Kupa", "Ankara", "2 - 4 / 5 / 2026"), 2: ("Only", "Here", ""), 3: ("", "", ""), 4: ("", "", "")}


def test_reports(spark):
    rows = spark.createDataFrame([("a", "S", 50, "F", 5, "", "x", 1), ("a", "S", 50, "O", 7, "C1", "y", 2), ("a", "K", 50, "F", 3, "C2", "z", 3), ("b", "S", 50, "F", 0, "C", "w", 4)], "who string, stroke string, distance int, leg string, points int, city string, club string, at int")
    got = report.event_map(rows, ["who"], ["stroke", "distance"], "points", ["club"]).collect()
    assert [(r["who"], r["club"], {tuple(k): v for k, v in r["scores"].items()}) for r in got] == [("a", "z", {("S", 50): 7, ("K", 50): 3})]
    legs = report.leg_map(rows, ["who"], ["stroke", "distance"], "leg", ["F", "O"], "points", "at", ["club"], ["city"])
    assert sorted((r["stroke"], r["leg_f"], r["leg_o"], r["combined"], r["club"], r["city"]) for r in legs.collect()) == [("K", 3, None, 3, "x", "C2"), ("S", 5, 7, 7, "x", "C2")]
    assert [tuple(r) for r in report.keys_by(rows, "club", "who").collect()] == [("a", 3), ("b", 1)]
    assert [tuple(r) for r in report.names_by(rows.where("who = 'a'"), "club", ["who"]).collect()] == [("a", ["x", "y", "z"])]
    checks = {"digit": ("city", F.col("city").rlike(r"\d")), "empty": ("city", F.col("city") == "")}
    assert [tuple(r) for r in report.quality_report(rows, checks, normalize_for_lookup, "at").collect()] == [("digit", "C1"), ("digit", "C2"), ("empty", "")]


def test_stream_buckets(spark, tmp_path):
    schema = "k int, t int, n int"
    at, progress, landed = str(tmp_path / "t"), str(tmp_path / "p"), str(tmp_path / "in")

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(landed)
        made = live.landing(spark, landed, spark.createDataFrame([], schema).schema)
        live.upsert_stream(made, at, ["k"], "t", "n", progress, buckets=4).awaitTermination()

    land(*((k, 50, k) for k in range(20)), (None, 9, 99))
    whole = len(list((tmp_path / "t").glob("v=0/bucket=*")))
    for n, t in enumerate((40, 30, 60), 1):
        land((7, t, 100 + n))
        # Only the bucket of the one key is written.
        assert len(list((tmp_path / "t").glob(f"v={n}/bucket=*"))) == 1
    got = {(r.k, r.t) for r in live.newest_version(spark, at).collect()}
    assert got == {(k, 30 if k == 7 else 50) for k in range(20)} | {(None, 9)}
    # The newest version of the touched bucket and the one before are kept, the others' only one.
    assert whole == 4 and len(list((tmp_path / "t").glob("v=*/bucket=*"))) == 5
    # A version that was not written to its end is no state.
    (tmp_path / "t" / "v=3" / "_SUCCESS").unlink()
    assert live.newest_version(spark, at).count() == 21
    assert live.newest_version(spark, str(tmp_path / "none"), live.landing(spark, landed, spark.createDataFrame([], schema).schema).schema).count() == 0
    with pytest.raises(ValueError):
        live.newest_version(spark, str(tmp_path / "none"))


def test_workbooks(spark, tmp_path):
    made = raw(spark, ("m", 1, "Ada Test", "X", 2012, "Serbest", 50, 3000, "pdf"), ("m", 2, "ADA TEST", "X", 2012, "Serbest", 50, 2900, "pdf"), ("m", 3, "Can Test", "Y", 2012, "Karışık", 400, 30000, "pdf"), ("m", 4, "Nil Test", "Z", 2012, "Karışık", 100, 7000, "pdf"))
    over = spark.createDataFrame([], OVERRIDES)
    rich = meet.enrich_results(made, over, spark.createDataFrame([("y", "Y", "Bolu", 3, 1)], CLUBS), spark.createDataFrame([], CLUBS))
    # The second row of a person has a city, the first none.
    rich = rich.withColumn("city", F.when(F.col("line_no") == 2, "Ankara").otherwise(F.col("city"))).withColumn("region", F.when(F.col("line_no") == 2, 2).otherwise(F.col("region")))
    sheet = layouts.results_sheet(rich, "line_no")
    assert len(sheet.columns) == 24
    assert [(r["Ad Soyad"], r["Şehir"], r["Bölge"], r["Cinsiyet"], r["Serbest_50m"], r["Karışık_400m"]) for r in sheet.collect()] == [
        ("Ada Test", "Ankara", "2", "Kız", "29.00", None), ("Can Test", "Bolu", "3", "Kız", None, "5:00.00"), ("Nil Test", "", "", "Kız", None, None)
    ]
    layouts.write_results(rich, "line_no", str(tmp_path / "r"), "meet", F.concat(F.lit("book_"), "meet"))
    raw_book = (tmp_path / "r" / "book_m.xlsx").read_bytes()
    read = sheet_rows(raw_book)
    assert read[0]["A"] == "Ad Soyad" and read[1]["A"] == "Ada Test" and len(read) == 4 and [p.name for p in (tmp_path / "r").iterdir()] == ["book_m.xlsx"]
    with zipfile.ZipFile(io.BytesIO(raw_book)) as z:
        body, styles = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/styles.xml").decode()
        ElementTree.fromstring(styles)
    assert 'topLeftCell="H2"' in body and 'width="28"' in body and 'ht="30"' in body and "1F4E79" in styles and "F2F2F2" in styles
    assert '<c r="A1" s="1"' in body and '<c r="H1" s="2"' in body and '<c r="A2" s="5"' in body and '<c r="A3" s="3"' in body
    assert layouts.results_name("2026.01.02", "t").startswith("2026.01.02_") and not layouts.results_name("", "t").startswith("_")
    compared = spark.createDataFrame([("A", "X", 2012, "F", "A", "X", "both"), ("B", "X", 2012, "F", None, None, "only_a"), (None, None, 2011, "M", "C", "Y", "only_b")], "name_a string, value_a string, birth_year int, gender string, name_b string, value_b string, status string")
    layouts.write_roster(compared, ("Bahar", "Güz"), str(tmp_path / "c"), "roster")
    book = (tmp_path / "c" / "roster.xlsx").read_bytes()
    assert sheet_rows(book)[0]["A"] == "Bahar - Sporcu"
    assert [r.get("A") for r in sheet_rows(book)][1:] == ["A", "B", ""] and len(sheet_rows(book, 2)) == 5
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        styles = z.read("xl/styles.xml").decode()
        assert all(c in styles for c in layouts.COLOURS.values()) and 's="1"' in z.read("xl/worksheets/sheet1.xml").decode()
    tally = spark.createDataFrame([("g1", 1, 2), ("g2", 3, 4)], "grp string, n long, m long")
    summary = layouts.summary_sheet(tally, "grp", ["n", "m"])
    assert [tuple(r) for r in summary.collect()] == [("g1", 1, 2), ("g2", 3, 4), ("TOPLAM", 4, 6)]
    ranked = spark.createDataFrame([("p", 1, "P", "X", "A", 1, "TR", False, 5, 6, 7, "7", 1)], "who string, place int, name string, club string, city string, region int, selected_label string, tied boolean, top3_f int, top3_o int, top3 int, seq_display string, region_place int")
    scores = spark.createDataFrame([("p", "Serbest", 50, 5, 6, 6)], "who string, stroke string, distance int, leg_f int, leg_o int, combined int")
    wide = layouts.ranking_sheet(ranked, scores, ("f", "o"), ["who"])
    assert len(wide.columns) == 1 + 12 + 3 * 17 and wide.first()["Serbest_50m o"] == 6
    layouts.write_ranking(wide, F.lit("13 Kadın"), F.lit("TR: 20"), tally, summary, str(tmp_path / "k"), "ranking", ["who"])
    book = (tmp_path / "k" / "ranking.xlsx").read_bytes()
    assert sheet_rows(book)[0] == {"A": "TR: 20"} and sheet_rows(book)[1]["B"] == "Ad Soyad" and sheet_rows(book)[2]["B"] == "P" and sheet_rows(book, "Özet")[-1]["A"] == "TOPLAM"
