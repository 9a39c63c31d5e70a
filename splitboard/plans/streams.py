"""Queries over streams with keyed state, joins and sessions. The tables stand for what has arrived; SQL states what must have come out by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..streaming import live, stateful

QUERIES, ORACLES = {}, {}
GAP, WITHIN = "1 hour", "1 day"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT user_id, event_type, cents, event_id FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY cents, event_id) AS n FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)) WHERE n = 1""")
def stream_least(spark, sf_dir):
    """The least value of each user and kind, kept in the state store."""
    rows = _stream(spark, sf_dir, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "event_id")
    changes = live.run_to_table(stateful.least_times(rows, ["user_id", "event_type"], "cents", "event_id"))
    return stateful.least_view(changes, ["user_id", "event_type"], "cents", "event_id")


@query("""WITH o AS (SELECT CAST(o_orderkey // 500 AS BIGINT) AS ev, CAST(o_custkey AS VARCHAR) AS person, ['', 'F', 'M'][o_custkey % 3 + 1] AS gender, o_orderstatus AS status FROM orders),
r AS (SELECT ev, person, CASE WHEN gender = '' THEN 'F' ELSE gender END AS gender FROM o WHERE status = 'F' AND ev % 2 = 0), s AS (SELECT DISTINCT ev, person, gender FROM o WHERE status = 'O'),
m AS (SELECT max(ev) AS mx FROM r), over_ AS (SELECT DISTINCT ev, gender FROM r, m WHERE ev < mx)
SELECT ev, person, gender FROM s WHERE NOT EXISTS (SELECT 1 FROM over_ o WHERE o.ev = s.ev AND (o.gender = s.gender OR s.gender = ''))
AND NOT EXISTS (SELECT 1 FROM r WHERE r.ev = s.ev AND r.person = s.person)""")
def stream_pending(spark, sf_dir):
    """Events are runs of 500 orders, each with its number; every second one has results. What the lists don't close is pending."""
    ev, k = F.floor(F.col("o_orderkey") / 500).cast("long"), F.col("o_custkey")
    rows = _stream(spark, sf_dir, "orders").select(ev.alias("ev"), k.alias("person"), F.when(k % 3 == 0, "").when(k % 3 == 1, "F").otherwise("M").alias("gender"), "o_orderstatus")
    starts = rows.where("o_orderstatus = 'O'").drop("o_orderstatus")
    results = rows.where("o_orderstatus = 'F' AND ev % 2 = 0").select("ev", "person", F.when(F.col("gender") == "", "F").otherwise(F.col("gender")).alias("gender"), F.col("ev").alias("seq"))
    changes = live.run_to_table(stateful.pending_changes(starts, results, ["ev"], "gender", "person", "seq"))
    return stateful.pending_view(changes, ["ev"], "gender", "person")


@query(f"""WITH w AS (SELECT date_trunc('millisecond', max(ts)) AS mark FROM events), g AS (SELECT *, coalesce(ts > lag(ts) OVER u + INTERVAL {GAP}, true) AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL {GAP} AS "end", count(*) AS n, round(sum(value), 4) AS total FROM n GROUP BY user_id, run HAVING max(ts) + INTERVAL {GAP} <= (SELECT mark FROM w)""")
def stream_sessions(spark, sf_dir):
    """Sessions that are over by the watermark."""
    out = live.run_to_table(live.session_counts(_events(spark, sf_dir), "ts", GAP, "0 seconds", ["user_id"], "value"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"""WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT event_id AS result_id, user_id, ts AS finished FROM events WHERE event_type = 'purchase'),
w AS (SELECT date_trunc('millisecond', least((SELECT max(ts) FROM s), (SELECT max(finished) FROM r))) AS mark)
SELECT event_id, s.user_id, ts, result_id, finished FROM s LEFT JOIN r ON r.user_id = s.user_id AND finished BETWEEN ts AND ts + INTERVAL {WITHIN}
WHERE result_id IS NOT NULL OR ts + INTERVAL {WITHIN} < (SELECT mark FROM w)""")
def stream_starts_results(spark, sf_dir):
    """Signups with the purchases of the day after them; those without any once none can come."""
    rows = _events(spark, sf_dir)
    starts = rows.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    results = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("result_id"), "user_id", "ts")
    out = live.run_to_table(live.started_and_finished(starts, results, ["user_id"], "ts", WITHIN, "0 seconds"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "finished")})
