"""Tables on storage: whole ones, and single partitions replaced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """The rows as the whole table, in a folder for each value of ``by``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """The rows in place of all rows of the partitions that they belong to; no other folder is touched.

    Without rows nothing changes. What is written lies in a staging folder until all
    tasks have ended, so a write that fails leaves the table as it was. The rows must
    not be read from the partitions that they replace.
    """
    if list(rows.columns)[-len(by) :] != list(by):
        rows = rows.select(*(c for c in rows.columns if c not in by), *by)
    # Rows of a partition are brought together, so that it isn't split into a file a task.
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
