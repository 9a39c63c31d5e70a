"""Filter interaction audit: every order of five filters replayed over every document.

The four filters on a text alone are column expressions over the whole text; the
fifth, a copy of an earlier document, comes from the least identifier of each text.
What is left of a document is a part, five flags and two labels. These narrow rows
are crossed with the 120 orders (broadcast, a fixed number of rows), each gives its
five steps, the first failing step is an expression of the flags, and counts are
combined in every map task before they are shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: Parts that the copies of one text are dealt into.
SALTS = 256


def text_failures(text: Column) -> list[Column]:
    """Failure of filters A to D, from the whole text."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return [
        F.size(found) < 200,
        100 * F.size(F.array_distinct(found)).cast("long") < 50 * F.size(found).cast("long"),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.char_length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def _mask(failures: list[Column]) -> Column:
    mask = F.lit(0)
    for bit, failed in enumerate(failures):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def _with_copies(rows: DataFrame) -> DataFrame:
    """Set the last flag where an equal text has a smaller identifier.

    The least identifier is found per text and salt, then per text, and goes back to
    the salts that the text has, so no task holds a frequent text's rows.
    """
    least = rows.where("id IS NOT NULL").groupBy("digest", "salt").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    first = least.groupBy("digest").agg(F.min("id").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    first = first.where("n > 1").select("digest", F.explode("salts").alias("salt"), "first")
    # The number is given, so few bytes don't become few tasks: each row is replayed 600 times below.
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "digest", "salt")
    return dealt.join(first, ["digest", "salt"], "left").select(
        "part", "good", "toxic", (F.col("mask") + F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0)).alias("mask")
    )


def replay(flags: DataFrame) -> DataFrame:
    """Counts for each part, order and step, from rows (part, mask, good, toxic)."""
    orders = [(n, "".join(FILTERS[i] for i in p), *(1 << i for i in p)) for n, p in enumerate(permutations(range(len(FILTERS))))]
    orders = flags.sparkSession.createDataFrame(orders, "order_no int, filter_order string, b1 int, b2 int, b3 int, b4 int, b5 int")
    crossed = flags.crossJoin(F.broadcast(orders.drop("filter_order")))
    mask, step, bit, first = map(F.col, ("mask", "step", "bit", "first"))
    failing, of_step = F, F
    for s in range(1, 6):
        b = F.col(f"b{s}")
        failing, of_step = failing.when(mask.bitwiseAND(b) != 0, s), of_step.when(step == s, b)
    steps = crossed.withColumn("first", failing.otherwise(6)).withColumn("step", F.explode(F.array(*map(F.lit, range(1, 6)))))
    steps = steps.select("part", "order_no", "step", "mask", "first", "good", "toxic", of_step.alias("bit"))
    removed = first == step
    counts = steps.groupBy("part", "order_no", "step").agg(
        F.count_if(first > step).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if((first < step) & (mask.bitwiseAND(bit) != 0)).alias("redundant"),
        F.count_if(mask == bit).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    named = counts.join(F.broadcast(orders.select("order_no", "filter_order")), "order_no").drop("order_no")
    letter = F.substr("filter_order", "step", F.lit(1))
    # 120 rows for each part and filter.
    return named.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with the counts of ``replay``.

    A null text or part counts as empty. An empty text fails A alone. Rows are
    documents: repeated rows count each, and of rows with one identifier none is an
    earlier copy of the other. A row without identifier is no copy and makes none, and
    has no labels. A document is good or toxic if any of its labels says so. Texts of
    any length are read whole. Other columns, whatever their names, are not looked at.
    An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        _mask(text_failures(body)).alias("mask"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"),
    )
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch(rows)
        # Rows without identifier have no labels, and would all be dealt to one task.
        known = rows.where("id IS NOT NULL").join(marks, "id", "left").fillna(False, ["good", "toxic"])
        unknown = rows.where("id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
        return scratch.keep(replay(_with_copies(known.unionByName(unknown))))
