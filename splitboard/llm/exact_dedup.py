"""Exact dedup by content sort.

Texts are dealt over partitions by sampled splitters of their normalised bytes and
sorted (Spark's external sort spills), so that equal texts lie side by side, where
neighbours are compared in full.

* The range key is a bounded prefix of the normalised text, its SHA-256 and a salt. The
  prefix keeps the splitter sample small however long the texts are; the digest parts
  texts with one opening. The salt is 0, so all copies of a text are one run in one
  partition, save for a text that alone would fill a good part of a partition: there
  are few of those (fewer than ``HOT`` a partition, whatever the data), and their
  copies are dealt over several partitions by identifier.
* Within a partition the sort has equal texts adjacent, and a run ends where a row's
  text differs from the one before it in any byte. The runs of a salted text, one row
  each with the whole text, are put together by comparing whole texts again. The digest
  is a sort key and an output; it decides nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

#: Code points of the text in the range key.
PREFIX = 48
#: A text is salted if it has more than one HOT-th of a partition's rows.
HOT = 4
#: Rows of one text that are never salted.
LEAST_HOT = 64


def content_sort(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    keep: str = "min",
    normalise: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``normalise`` is the column that is compared (default: the text as it is; a null
    text counts as empty). ``keep`` says whether the smallest or largest identifier
    of a group stays. Ties: of repeated rows with one identifier exactly one stays;
    a null identifier stays only in a group without any other. Very long texts are
    sorted and compared whole. An empty table gives no rows; columns beside the two
    named are not read. Repeated rows of one text and one identifier are one run.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    n = partitions or shuffle_partitions(docs.sparkSession)
    body = F.coalesce(normalise if normalise is not None else F.col(text), F.lit(""))
    digest = F.unhex(F.sha2("body", 256)).alias("digest")
    # Salted texts: at most n * HOT rows, as each has more than that share of all rows.
    share = max(LEAST_HOT, docs.count() / (n * HOT))
    hot = docs.select(body.alias("body")).select(digest).groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > share)
    hot = hot.select("digest", F.ceil(F.col("copies") / F.lit(share)).alias("salts"))
    keyed = docs.select(F.col(id_col).alias("id"), body.alias("body")).select("id", "body", F.substring("body", 1, PREFIX).alias("head"), digest)
    keyed = keyed.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)))
    dealt = keyed.repartitionByRange(n, "head", "digest", "salt")
    order = F.asc_nulls_last("id") if keep == "min" else F.desc_nulls_last("id")
    # The window's groups end where a neighbour in the sort differs: the whole text is part of its key.
    run = Window.partitionBy("head", "digest", "salt", "body").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.min if keep == "min" else F.max
    place = F.row_number().over(run)
    runs = cut(
        dealt.select(
            "id",
            "digest",
            "salt",
            F.xxhash64("body").alias("name"),
            place.alias("place"),
            F.when((place == 1) & F.col("salts").isNotNull(), F.col("body")).alias("salted"),
            best("id").over(whole).alias("best"),
            F.count(F.lit(1)).over(whole).alias("n"),
        )
    )
    heads = runs.where("salted IS NOT NULL")
    totals = heads.groupBy("salted").agg(best("best").alias("keep_id"), F.sum("n").alias("group_size"))
    # One row for each run of a salted text, so no join key holds more rows than a run does.
    spread = heads.select("digest", "salt", "name", "salted").join(totals, "salted").drop("salted")
    return (
        runs.join(spread, ["digest", "salt", "name"], "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("keep_id", "best").alias("keep_id"),
            F.coalesce("group_size", "n").alias("group_size"),
            "place",
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
        .select(
            id_col,
            "keep_id",
            "group_size",
            ((F.col("place") == 1) & F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
        )
    )
