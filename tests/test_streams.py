"""Stateful streams: restarts, late rows, what leaves the state; each against batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from splitboard.operators import state
from splitboard.streaming import live, stateful


def _land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_least_times(spark, tmp_path):
    """Batches, a replay and a restart from the checkpoint: only improvements come out, and their view is the batch result."""
    rng = random.Random(1)
    rows = [(rng.randrange(40), rng.choice("ab"), rng.choice([None, *range(100, 130)]), i, f"w{i}") for i in range(400)]
    schema = "k int, e string, t long, n long, word string"
    landing, target, progress = (str(tmp_path / x) for x in ("landing", "table", "progress"))
    held = 0
    for at in range(0, 400, 100):
        _land(spark.createDataFrame(rows[at : at + 100] + rows[:10], schema), landing)
        changes = stateful.least_times(live.landing(spark, landing, spark.read.parquet(landing).schema, most=1), ["k", "e"], "t", "n")
        table = live.run_to_table(changes, checkpoint=progress, target=target)
        seen = spark.createDataFrame(rows[: at + 100], schema)
        want = state.upsert_min(seen.limit(0), seen, ["k", "e"], "t", "n")
        assert sorted(map(str, stateful.least_view(table, ["k", "e"], "t", "n").collect())) == sorted(map(str, want.collect()))
        assert held <= table.count() < at + 100
        held = table.count()
    again = live.run_to_table(stateful.least_times(live.landing(spark, landing, spark.read.parquet(landing).schema), ["k", "e"], "t", "n"), checkpoint=progress, target=target)
    assert again.count() == held


def test_pending_events(spark, tmp_path):
    """Lists arrive one after another; an event closes when a later list has come."""
    starts, results, target, progress = (str(tmp_path / x) for x in ("starts", "results", "table", "progress"))
    first = [("free", "F", "ada"), ("free", "F", "ece"), ("free", "", "su"), ("back", "M", "ali"), ("back", "M", "can"), ("fly", "F", "ada")]
    lists = [[("free", "F", "ada", 0)], [("back", "M", "ali", 2)], [("fly", "F", "eda", 3)]]
    s_schema, r_schema = "event string, gender string, person string", "event string, gender string, person string, seq long"
    _land(spark.createDataFrame(first, s_schema), starts)
    spark.createDataFrame([], r_schema).write.parquet(results)
    seen = []
    for rows in lists:
        seen += rows
        _land(spark.createDataFrame(rows, r_schema), results)
        stream = lambda p, s: spark.readStream.schema(s).parquet(p)
        changes = stateful.pending_changes(stream(starts, s_schema), stream(results, r_schema), ["event"], "gender", "person", "seq")
        table = live.run_to_table(changes, checkpoint=progress, target=target)
        want = state.pending(spark.read.parquet(starts), spark.createDataFrame(seen, r_schema), ["event"], "gender", ["person"], "seq")
        got = {tuple(r) for r in stateful.pending_view(table, ["event"], "gender", "person").collect()}
        assert got == {(r.event, r.gender, r.person) for r in want.collect()}
    assert got == {("fly", "F", "ada")}
    # A start of an event that is over is over at once.
    _land(spark.createDataFrame([("free", "F", "late"), ("fly", "F", "new")], s_schema), starts)
    table = live.run_to_table(stateful.pending_changes(stream(starts, s_schema), stream(results, r_schema), ["event"], "gender", "person", "seq"), checkpoint=progress, target=target)
    assert {r.person for r in stateful.pending_view(table, ["event"], "gender", "person").collect()} == {"ada", "new"}


def test_starts_join_results(spark, tmp_path):
    """Unmatched starts come out as pending once the watermark has passed them; then they leave the state."""
    rows = [("ada", "start", 0), ("ada", "result", 5), ("ece", "start", 1), ("su", "start", 100), ("su", "result", 111), ("x", "start", 200), ("x", "result", 200)]
    df = spark.createDataFrame(rows, "person string, kind string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    path = str(tmp_path / "rows")
    _land(df, path)
    read = lambda: spark.readStream.schema(df.schema).parquet(path)
    make = lambda: live.started_and_finished(read().where("kind = 'start'").select("person", "ts"), read().where("kind = 'result'").select("person", "ts"), ["person"], "ts", "10 seconds", "0 seconds")
    got = live.run_to_table(make(), checkpoint=str(tmp_path / "p"), target=str(tmp_path / "t"))
    secs = lambda c: (F.unix_timestamp(c) - 1000).alias(c)
    assert {tuple(r) for r in got.select("person", secs("ts"), secs("finished")).collect()} == {("ada", 0, 5), ("ece", 1, None), ("su", 100, None), ("x", 200, 200)}
    _land(spark.createDataFrame([("late", "start", 3), ("y", "start", 400), ("y", "result", 400)], "person string, kind string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000)), path)
    query = make().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start(str(tmp_path / "t"))
    query.awaitTermination()
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress[-1:]) <= 4
    after = {(r.person, r.finished) for r in spark.read.parquet(str(tmp_path / "t")).select("person", secs("finished")).collect()}
    assert after == {("ada", 5), ("ece", None), ("su", None), ("x", 200), ("y", 400)}


def test_sessions(spark, tmp_path):
    df = spark.createDataFrame([("a", s, 1.0) for s in (0, 5, 9, 40, 41)] + [("b", 3, 2.0), ("b", 500, 1.0)], "k string, s long, v double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    _land(df, str(tmp_path / "rows"))
    out = live.run_to_table(live.session_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "rows")), "ts", "10 seconds", "0 seconds", ["k"], "v"))
    got = {(r.k, r.b, r.e, r.n) for r in out.select("k", (F.unix_timestamp("start") - 1000).alias("b"), (F.unix_timestamp("end") - 1000).alias("e"), "n").collect()}
    assert got == {("a", 0, 19, 3), ("a", 40, 51, 2), ("b", 3, 13, 1)}


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_tables(spark, tmp_path, mode):
    df = spark.createDataFrame([(0, 1.0), (70, 2.0), (75, 3.0), (200, 4.0)], "s long, v double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    _land(df, str(tmp_path / "rows"))
    stream = live.tumbling_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "rows")), "ts", "1 minute", "0 seconds", [], "v")
    totals = sorted(r.total for r in live.run_to_table(stream, mode).collect())
    assert totals == ([1.0, 5.0] if mode == "append" else [1.0, 4.0, 5.0])
