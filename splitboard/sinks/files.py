"""Files that reports are published as: nested JSON, a script wrapper and CSV; workbooks are in ``books``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(rows: DataFrame, group: list[str], person: list[str], events: list[str], order: Column) -> DataFrame:
    """One JSON text for each group: persons, each with its events in order."""
    people = rows.groupBy(*group, *person).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), *events))).alias("_e"))
    shown = F.transform("_e", lambda e: F.struct(*(e[c].alias(c) for c in events)))
    each = people.select(*group, F.struct(*person, shown.alias("events")).alias("_p"))
    return each.groupBy(*group).agg(F.to_json(F.sort_array(F.collect_list("_p"))).alias("athletes"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_script(rows: DataFrame, json: str, path: str, variable: str = "RESULTS") -> None:
    """A script that assigns the JSON to a variable."""
    rows.select(F.concat(F.lit(f"window.{variable} = "), F.col(json), F.lit(";")).alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
