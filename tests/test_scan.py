"""Numbers, neighbours and carried values over ranges, against one window over whole groups."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from splitboard.operators import rank, report, scan
from splitboard.sources import lines


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    made = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, None, f"h{i}"])) for i in rng.sample(range(4000), 1500)]
    return spark.createDataFrame(made, "g string, n int, h string").repartition(5)


def _same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, a.select(cols).collect()), key=key) == sorted(map(tuple, b.select(cols).collect()), key=key)


@pytest.mark.parametrize("parts", [1, 13])
def test_scans(rows, parts):
    dealt = scan.ranged(rows, ["g"], ["n"], parts)
    w = Window.partitionBy("g").orderBy("n")
    assert dealt.where("g = 'a'").select("_part").distinct().count() >= min(parts, 6)
    _same(scan.plain(scan.numbered(dealt, ["g"], ["n"], "x")), rows.withColumn("x", F.row_number().over(w)))
    _same(scan.plain(scan.neighbours(dealt, ["g"], ["n"], "h", "x", "y")), rows.withColumns({"x": F.lag("h").over(w), "y": F.lead("h").over(w)}))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    _same(scan.plain(scan.carried(dealt, ["g"], ["n"], F.col("h"), "x", F.lit("seed"))), rows.withColumn("x", F.coalesce(F.last("h", ignorenulls=True).over(run), F.lit("seed"))))
    _same(scan.plain(scan.counted(dealt, ["g"], ["n"], F.col("h").isNotNull(), "x")), rows.withColumn("x", F.count("h").over(run)))
    # Parts of the groups that the rows are ranged by.
    own = scan.numbered(dealt.withColumn("p", F.col("n") % 3), ["g", "p"], ["n"], "x")
    _same(scan.plain(own), rows.withColumn("p", F.col("n") % 3).withColumn("x", F.row_number().over(Window.partitionBy("g", "p").orderBy("n"))))


def test_equal_keys_are_spread(spark):
    """A group whose keys are all 0, and one name many times, are no one task's."""
    df = spark.range(4000).select(F.lit("g").alias("g"), F.when(F.col("id") < 1500, F.lit("same")).otherwise(F.col("id").cast("string")).alias("name"), *(F.lit(0).alias(k) for k in rank.KEYS))
    dealt = scan.ranged(df, ["g", *rank.KEYS], ["name"], 16)
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 1000
    assert sorted(r.x for r in scan.numbered(dealt, ["g", *rank.KEYS], ["name"], "x").collect()) == list(range(1, 4001))


def test_ranked_over_many_ranges(spark):
    rng = random.Random(3)
    made = [(rng.choice("gh"), f"n{i:04}", *(rng.randint(0, 1) for _ in range(4))) for i in range(700)]
    df = spark.createDataFrame(made, "g string, name string, k3 int, k4 int, k5 int, k6 int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rank.ranked(df, ["g"], "name")
        order = [F.desc(k) for k in rank.KEYS]
        _same(got, df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order, "name")).cast("long")))
        odd = report.neighbour_anomalies(df.withColumns({"t": F.crc32("name") % 1000 + 1, "at": F.col("name")}), ["g"], "t", ["t", "at"])
        w = Window.partitionBy("g").orderBy("t", "at")
        timed = df.withColumns({"t": F.crc32("name") % 1000 + 1, "at": F.col("name")})
        near = (F.lag("t").over(w) + F.lead("t").over(w)) / 2
        seen = timed.withColumns({"near": near, "mid": F.median("t").over(Window.partitionBy("g"))})
        far = (F.col("t") < F.col("near") / 1.45) | (F.col("t") > F.col("near") * 1.45) | (F.col("t") < 0.6 * F.col("mid")) | (F.col("t") > 3 * F.col("mid"))
        _same(odd, seen.where(far).drop("near", "mid"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("spread", ["whole", "pages", "ranges"])
def test_header_in_force_over_pages(spark, spread):
    """A document over many tasks: the header of a page holds on those after it."""
    texts = [(1, 0, "Yarış 1, Kızlar, 50m Serbest"), *((p, i + 1, f"{i}. Ada Test{p} 13 Enka 3{i}.51") for p in range(1, 9) for i in range(3)), (5, 9, "Yarış 2, Erkekler, 100m Kelebek")]
    df = spark.createDataFrame([(d, *t) for t in texts for d in "de"], "doc string, page int, line_no int, text string")
    got = {(r.doc, r.page, r.line_no): (r.gender, r.distance) for r in lines.result_lines(df, spread=spread).collect()}
    assert got == {(d, p, i + 1): ("F", 50) if p <= 5 else ("M", 100) for d in "de" for p in range(1, 9) for i in range(3)}
    report_ = ["Ankara Spor Kulübü", "Test YÜZÜCÜ, 2012 (14 yas), Erkekler", "50m Serbest 128. 28.43 416 28.00 97%", "Bursa Yüzme Kulübü", "50m Serbest 1. 29.00"]
    df = spark.createDataFrame([("d", i, i, t) for i, t in enumerate(report_)], "doc string, page int, line_no int, text string")
    assert [(r.name, r.club, r.cents) for r in lines.progression_lines(df, spread=spread).collect()] == [("Test YÜZÜCÜ", "Ankara Spor Kulübü", 2843)]


def test_before_first_gap(spark):
    rows = [("a", n) for n in (1, 2, 4, 9, 10, 40)] + [("b", n) for n in (7, 8)] + [(None, n) for n in (3, 3, 0)] + [("c", 1)]
    got = sorted(map(str, report.before_first_gap(spark.createDataFrame(rows, "g string, n int"), ["g"], "n", 5).collect()))
    want = [("a", n) for n in (1, 2, 4, 9, 10)] + [(None, 3), (None, 3), ("c", 1)]
    assert got == sorted(map(str, spark.createDataFrame(want, "g string, n int").collect()))
