"""What the review of round 3 found, on small rows."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from splitboard.llm import licenses, minhash
from splitboard.plans import documents, meets
from splitboard.sources import lines, sheets
from splitboard.streaming import live, stateful


def _swim_zero(spark, path):
    """Orders 0 and 1 are their athletes' only swims of a meet."""
    spark.createDataFrame([(k, "MACHINERY", 3) for k in (0, 1)], "c_custkey long, c_mktsegment string, c_nationkey long").write.parquet(f"{path}/customer.parquet")
    orders = spark.createDataFrame([(0, 0, "2-HIGH"), (1, 1, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string")
    orders.withColumn("o_orderdate", F.lit("2024-01-02").cast("timestamp_ntz")).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_headers_stand_above_swim_zero(spark, tmp_path):
    """A header had the number 0, as the first swim has, so that either could come first."""
    rows = meets.swims(spark, _swim_zero(spark, tmp_path))
    header = F.col("text").contains("Yarış")
    ends = meets.lists(rows).groupBy("doc").agg(F.max(F.when(header, F.col("line_no"))).alias("head"), F.min(F.when(~header, F.col("line_no"))).alias("first"))
    assert [r.head < r.first for r in ends.collect()] == [True, True]
    for query in (documents.start_list, documents.roster_text):
        assert query(spark, str(tmp_path)).count() == 2


def test_words_are_read_without_a_group_a_page(spark):
    """A pandas call for each page took the time; pages of one and two lines over many documents, and what parts them."""
    words = [(f"d{d}", p, float(x), 40.0 * n + x % 3, f"{n}{x}") for d in range(30) for p in (1, 2) for n in (1, 2) for x in (2, 0, 1)]
    df = spark.createDataFrame(words, "doc string, page int, x double, y double, text string").repartition(5)
    got = lines.lines_of_boxes(df)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert {tuple(r) for r in got.collect()} == {(f"d{d}", p, n, f"{n}0 {n}1 {n}2") for d in range(30) for p in (1, 2) for n in (1, 2)}


def test_sheets_are_parsed_row_by_row(spark, tmp_path, workbook, monkeypatch):
    """A book's XML was parsed whole; now no more than a row is, and tasks hold few rows."""
    raw = workbook({"s": (["A", "B"], [(i, None if i % 3 else "x") for i in range(12_000)])})
    monkeypatch.setattr(sheets.ElementTree, "fromstring", None)
    first = next(sheets.rows_of(raw))
    assert first == {"A": "A", "B": "B"}
    monkeypatch.undo()
    (tmp_path / "b.xlsx").write_bytes(raw)
    read = sheets.read_sheet(spark, str(tmp_path / "b.xlsx"), {"B": "b", "A": "a", "C": "c"}, header_row=1)
    assert read.agg(F.count("*"), F.count("b"), F.count("c"), F.min("row_no"), F.max("row_no"), F.sum(F.col("a").cast("long"))).first() == (12_000, 4_000, 0, 2, 12_001, 71_994_000)


def test_an_event_of_many_starts(spark, tmp_path):
    """Every start and result was a call to the state, and a result went through all waiting starts."""
    n = 4_000
    starts, results = str(tmp_path / "starts"), str(tmp_path / "results")
    at = F.col("id").cast("string")
    spark.range(n).select(F.lit("free").alias("event"), F.lit("F").alias("gender"), at.alias("person")).coalesce(1).write.parquet(starts)
    spark.range(0, n, 2).select(F.lit("free").alias("event"), F.lit("F").alias("gender"), at.alias("person"), F.lit(1).cast("long").alias("seq")).coalesce(1).write.parquet(results)
    stream = lambda path: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    began = time.monotonic()
    table = live.run_to_table(stateful.pending_changes(stream(starts), stream(results), ["event"], "gender", "person", "seq"))
    assert time.monotonic() - began < 45
    left = stateful.pending_view(table, ["event"], "gender", "person").select(F.col("person").cast("long") % 2).distinct().collect()
    assert [r[0] for r in left] == [1]


def test_licences_without_directories(spark):
    """No document is a licence file, so the steps over directories had no effect in the query."""
    docs = spark.createDataFrame([(1, "MIT License", "x", "en"), (2, "nothing", "x", "en"), (3, None, None, None)], "doc_id long, text string, source string, lang string")
    got = licenses.scan_licenses(docs, F.concat_ws("/", "source", "doc_id"), F.lit(True), inherit=False)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.declared, r.inherited_from, r.licence) for r in got.collect()) == [(1, "MIT", None, "MIT"), (2, None, None, None), (3, None, None, None)]


def test_copies_post_no_difference_that_links_nothing(spark):
    """Nodes of the leader's label share too little with the one of another label: only that one's differences are posted."""
    extra = lambda a, n: [a * 1000 + i for i in range(n)]
    rows = [(1, 2, 100, 95, 10, 10, extra(1, 5), extra(9, 5), 7), (1, 3, 100, 95, 10, 10, extra(1, 5), extra(9, 5), 7), (1, 4, 100, 60, 4, 10, extra(2, 40), extra(9, 40), 7)]
    made = spark.createDataFrame(rows, "g long, b long, n long, p long, label long, lead_label long, extra array<long>, missing array<long>, centre long")
    kept = []
    minhash._postings(made, 80, lambda df: kept.append(df) or df)
    assert {tuple(r) for r in kept[0].groupBy("b").count().collect()} == {(4, 40)}


def test_a_line_is_looked_at_once(spark):
    """Whether a line is a header was found out twice, and with every pattern; lines that are skipped were sorted too."""
    df = spark.createDataFrame([("d", 1, 1, "Yarış 1, Kızlar, 50m Serbest"), ("d", 1, 2, "1. Ada Test 12 Kulüp 31.00"), ("d", 1, 3, "Sayfa 1")], "doc string, page int, line_no int, text string")
    read = lines.result_lines(df)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("byaris") == 1
    assert [(r.name, r.gender, r.distance, r.stroke, r.cents) for r in read.collect()] == [("Ada Test", "F", 50, "Serbest", 3100)]
