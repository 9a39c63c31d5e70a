"""How the operators are bound to the test tables: orders are marks, customers athletes, segments groups, nations regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score
from ..session import table

#: Points and the limits in cents that they need.
LIMITS = ((1, 25_000_000), (2, 22_000_000), (3, 19_000_000), (4, 16_000_000), (5, 13_000_000), (6, 10_000_000), (7, 7_000_000), (9, 3_000_000))
#: The event class of which one counts at most.
RESTRICTED = "1-URGENT"
EVENTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LEGS = ("F", "O", "P")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(athlete, name, grp, region, event, cents, seq, leg), one row per order."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("athlete"),
        F.col("o_orderpriority").alias("event"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("leg"),
    )
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("athlete"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("n")
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").cast("long").alias("region"))
    # 25 nations; AQE broadcasts customers where they are small enough.
    return orders.join(people.join(F.broadcast(nations), "n").drop("n"), "athlete")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(spark, sf_dir).withColumn("points", score.threshold_points(F.col("cents"), LIMITS))


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = scored(spark, sf_dir).where("points > 0")
    return score.best_marks(paid, ["athlete", "event"], "points", "cents", "seq")


def restricted() -> Column:
    return F.col("event") == RESTRICTED


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Athletes with their sequences' cumulative keys."""
    rows = best(spark, sf_dir)
    return score.cumulative_keys(score.sequences(rows, ["athlete", "grp", "region"], "points", restricted()))


MARKS_SQL = """
marks AS (
  SELECT o_custkey AS athlete, c_name AS name, c_mktsegment AS grp, CAST(n_regionkey AS BIGINT) AS region, o_orderpriority AS event,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey AS seq, o_orderstatus AS leg
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), scored AS (
  SELECT *, CAST(CASE WHEN cents <= 3000000 THEN 9 WHEN cents <= 7000000 THEN 7 WHEN cents <= 10000000 THEN 6 WHEN cents <= 13000000 THEN 5
    WHEN cents <= 16000000 THEN 4 WHEN cents <= 19000000 THEN 3 WHEN cents <= 22000000 THEN 2 WHEN cents <= 25000000 THEN 1 ELSE 0 END AS BIGINT) AS points
  FROM marks
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY athlete, event ORDER BY points DESC, cents, seq) AS rn FROM scored WHERE points > 0) WHERE rn = 1
), usable AS (
  SELECT *, row_number() OVER (PARTITION BY athlete, event = '1-URGENT' ORDER BY points DESC, event) AS rr FROM best
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY athlete ORDER BY points DESC, event) AS rp FROM usable WHERE event <> '1-URGENT' OR rr = 1
), keyed AS (
  SELECT athlete, any_value(grp) AS grp, any_value(region) AS region,
         CAST(sum(CASE WHEN rp <= 3 THEN points ELSE 0 END) AS BIGINT) AS k3, CAST(sum(CASE WHEN rp <= 4 THEN points ELSE 0 END) AS BIGINT) AS k4,
         CAST(sum(CASE WHEN rp <= 5 THEN points ELSE 0 END) AS BIGINT) AS k5, CAST(sum(CASE WHEN rp <= 6 THEN points ELSE 0 END) AS BIGINT) AS k6
  FROM placed GROUP BY athlete
)"""
