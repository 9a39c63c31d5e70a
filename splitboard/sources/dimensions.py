"""Tables that hold rules and state: their schemas, how they are loaded, checked and widened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.times import parse_time

#: Columns of each table; the first ones up to the bar are its key.
SCHEMAS = {
    "thresholds": "birth_year int, gender string, stroke string, distance int, points int | max_cs long",
    "quotas": "birth_year int | tr int, region_1 int, region_other int, min_points int",
    "time_limits": "stroke string, distance int | lo long, hi long",
    "exclusions": "name string, birth_year int, gender string |",
    "clubs": "key string | club string, city string, region int, at long",
    "athlete_overrides": "id long | name_normalized string, birth_year int, club_override string, city string, region int, display_name string",
    "results": "leg string, name string, birth_year int, gender string, stroke string, distance int | id long, race_date string, region int, city string, club string, cents long, points int, pdf_seq long",
    "starts": "leg string, name string, birth_year int, gender string, stroke string, distance int | entry_cents long, pdf_seq long",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name].replace(" |", "," if not SCHEMAS[name].endswith("|") else ""))


def key(name: str) -> list[str]:
    return StructType.fromDDL(SCHEMAS[name].split("|")[0].strip().rstrip(",")).names


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))


def migrated(rows: DataFrame, name: str) -> DataFrame:
    """The rows with the table's columns: missing ones null, types cast, further ones kept at the end."""
    own = schema(name)
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in own), *(c for c in rows.columns if c not in own.names))


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A dimension from CSV files with a header, typed, one row for each key (the least of its values); rows with an empty key column go.

    Columns are found by their names, in any order. Times are hundredths, or texts as M:SS.cc.
    """
    raw = spark.read.option("header", True).csv(path)
    own = schema(name)
    times = {"max_cs", "lo", "hi", "entry_cents"}
    cell = lambda c: F.coalesce(F.when(~F.col(c).rlike(r"[:.,;]"), F.col(c).try_cast("long")), parse_time(F.col(c))) if c in times else F.trim(c)
    typed = raw.select(*((cell(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in own))
    keys = key(name)
    rest = [f for f in own.names if f not in keys]
    good = typed.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    if not rest:
        return good.distinct()
    return good.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")

