"""Spellings of one person: connected components of name links, and one spelling for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """(name, person): each name of the links (a, b) with the least name that it can reach.

    In turns every name's greater neighbours, then its lesser ones, are linked with the
    least of them: links only move to lesser names, and the number of rounds grows with
    the logarithm of a chain's length, not with its length. Each round is a table, so a
    lost executor costs a round at most; no name's neighbours are gathered.
    """
    edges = written(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    both = links.select(F.explode(F.array("a", "b")).alias("name")).where("name IS NOT NULL").distinct()
    while True:
        # Large step: of all neighbours of a name, those above it are linked with the least.
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        # Small step: those below it, and itself.
        below = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(below, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        seen = Observation()
        new = written(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        before = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        edges = new
        if (seen.get["n"], seen.get["h"]) == (before["n"], before["h"]):
            break
    found = edges.groupBy("u").agg(F.min("v").alias("person")).withColumnRenamed("u", "name")
    return both.join(found, "name", "left").select("name", F.coalesce("person", "name").alias("person"))


def one_spelling(rows: DataFrame, links: DataFrame, name: str, order: str) -> DataFrame:
    """Add ``person`` (the least name of those linked with the row's) and ``canonical``: the person's first spelling to arrive.

    All spellings of a person take the same one, so links that name each other as the
    right one can't swap them, whatever the order in which they are given.
    """
    known = components(links).withColumnRenamed("name", "_name")
    keyed = rows.join(known, rows[name] == F.col("_name"), "left").withColumn("person", F.coalesce("person", name)).drop("_name")
    first = keyed.where(F.col(name).isNotNull()).groupBy("person").agg(F.min_by(name, order).alias("canonical"))
    return keyed.join(first, "person", "left").select(*rows.columns, "person", "canonical")
