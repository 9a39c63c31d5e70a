"""Lenex meets: results, entries and dates from the rows that ``archive`` parses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DISTANCES, STROKES
from ..functions.times import lenex_time, parse_birthdate, race_date
from . import archive


def read_meets(spark: SparkSession, path: str, rows: str = "results") -> DataFrame:
    """Rows of the files of a landing folder, by the data source; ``rows`` as there."""
    archive.register(spark)
    return spark.read.format("meet_archive").option("rows", rows).load(path)


def _valid(swims: DataFrame) -> DataFrame:
    """Individual swims of known styles and distances, with the person's columns. A gender other than a woman's counts as M."""
    names = F.create_map(*[F.lit(x) for pair in STROKES.items() for x in pair])
    woman = F.upper("gender").isin("F", "FEMALE", "W")
    out = swims.where(~F.col("relay") & names[F.col("stroke")].isNotNull() & F.col("distance").isin(*DISTANCES))
    return out.withColumns({"stroke": names[F.col("stroke")], "gender": F.when(woman, "F").otherwise("M"), "birth_year": parse_birthdate(F.col("birthdate")), "cents": lenex_time(F.col("time"))})


def results(swims: DataFrame) -> DataFrame:
    """One row per valid individual result of a club; unmatched events, disqualifications and times under a second go."""
    valid = _valid(swims).where((F.col("club") != "") & ~F.upper("status").isin("DSQ", "DQ", "DNS", "DNF") & (F.col("cents") >= 100))
    return valid.select("path", "event_id", "club", "name", "gender", "birth_year", "cents", "stroke", "distance", F.lit("lenex").alias("source"))


def entries(swims: DataFrame) -> DataFrame:
    """One row per individual entry of an athlete with a birth year; the time may be null."""
    valid = _valid(swims).where("birth_year IS NOT NULL")
    return valid.select("path", "event_id", "club", "name", "gender", "birth_year", F.col("cents").alias("entry_cents"), "stroke", "distance")


def meet_dates(meets: DataFrame) -> DataFrame:
    """(path, race_date): the meet's start, else its first session."""
    return meets.select("path", race_date(F.coalesce(F.nullif("start", F.lit("")), "session")).alias("race_date"))


def first_accepted(candidates: DataFrame, key: str, priority: str, content: str) -> DataFrame:
    """Of several downloads for a key, the first by priority that looks like a meet file."""
    raw = F.col(content)
    ok = (F.octet_length(raw) >= 100) & (F.hex(F.substring(raw, 1, 5)).rlike("^(504B|3C3F786D6C|3C4C454E45)"))
    good = candidates.where(ok)
    return good.groupBy(key).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != key]), priority).alias("_r")).select(key, "_r.*")
