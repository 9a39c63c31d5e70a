"""Similarity joins of names by signatures: only texts that share one are compared.

``near_pairs`` finds texts within a number of edits by segments, ``best_indel`` the
most similar text by rare pairs of letters. Neither joins on a block alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import indel_ratio, token_sort


def _counted(rows: DataFrame, name: str, low: Column, high: Column) -> DataFrame:
    """One row for each whole number from ``low`` to ``high``."""
    return rows.withColumns({"_lo": low.cast("int"), "_hi": high.cast("int")}).where("_lo <= _hi").withColumn(name, F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def _place(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Where segment ``i`` (from 1) of ``parts`` begins, and how long it is: the last ones are longer where the length doesn't divide."""
    size, short = F.floor(length / parts).cast("int"), parts - length % parts
    return (i - 1) * size + F.greatest(F.lit(0), i - 1 - short) + 1, size + F.when(i > short, 1).otherwise(0)


def segments(rows: DataFrame, text: str, limit: int) -> DataFrame:
    """Rows of at least ``limit + 1`` letters with each of their ``limit + 1`` segments: ``_l`` (length), ``_i``, ``_part``."""
    long = rows.withColumn("_l", F.char_length(text)).where(F.col("_l") > limit)
    each = _counted(long, "_i", F.lit(1), F.lit(limit + 1))
    start, size = _place(F.col("_l"), F.col("_i"), limit + 1)
    return each.withColumn("_part", F.substr(text, start, size))


def probes(rows: DataFrame, text: str, limit: int, low: Column, high: Column, whole: bool) -> DataFrame:
    """Rows with the parts of ``text`` in which a segment of a text of ``_l`` letters, from ``low`` to ``high``, could be found again.

    Segment i has i - 1 edits before it at most if it is the first without an edit, so
    it has moved by no more; if the texts are compared whole, the same holds from the
    end, which leaves fewer places.
    """
    n, length, i = F.char_length(text), F.col("_l"), F.col("_i")
    each = _counted(_counted(rows, "_l", F.greatest(low, F.lit(limit + 1)), high), "_i", F.lit(1), F.lit(limit + 1))
    start, size = _place(length, i, limit + 1)
    least, most = [F.lit(1), start - (i - 1)], [n - size + 1, start + (i - 1)]
    if whole:
        least.append(start + (n - length) - (limit + 1 - i))
        most.append(start + (n - length) + (limit + 1 - i))
    return _counted(each.withColumn("_size", size), "_at", F.greatest(*least), F.least(*most)).withColumn("_part", F.substr(text, F.col("_at"), F.col("_size"))).drop("_at", "_size")


def near_candidates(values: DataFrame, text: str, limit: int, block: Sequence[str] = ()) -> DataFrame:
    """(block, a, b) pairs of different texts that share a signature; every pair within ``limit`` edits is among them.

    Of ``limit + 1`` segments one has no edit, so the longer text has it, little moved.
    A text of no more than ``limit`` letters has no such segments: it shares a letter
    with a longer one that is near, and is near to any other short one.
    """
    own = values.select(*block, F.col(text).alias("a")).distinct()
    n = F.char_length("b")
    other = own.withColumnRenamed("a", "b")
    index, probe = segments(own, "a", limit), probes(other, "b", limit, n - limit, n, True)
    found = index.join(probe, [*block, "_l", "_i", "_part"]).select(*block, "a", "b")
    letters = lambda df, t: df.withColumn("_part", F.explode(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))))
    short = own.where(F.char_length("a") <= limit)
    rest = other.where(n.between(limit + 1, 2 * limit))
    mixed = letters(short, "a").join(letters(rest, "b"), [*block, "_part"]).select(*block, "a", "b")
    # All of these are within the limit, so the join makes nothing but results.
    small = short.withColumn("_short", F.char_length("a") <= limit)
    both = small.join(small.withColumnRenamed("a", "b"), [*block, "_short"]).select(*block, "a", "b")
    return found.unionAll(mixed).unionAll(both).where("a <> b")


def near_pairs(values: DataFrame, text: str, limit: int, block: Sequence[str] = ()) -> DataFrame:
    """(block, a, b, edits): different texts of a block within ``limit`` edits, a < b, each pair once. A null text or block is near to none."""
    near = F.levenshtein("a", "b", limit)
    found = near_candidates(values, text, limit, block).where(near >= 0)
    return found.select(*block, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), near.cast("long").alias("edits")).distinct()


def _needed(own: Column, other: Column, cutoff: float) -> Column:
    """How many pairs of letters two texts of these lengths share at least if their indel ratio reaches the cutoff.

    The common subsequence has cutoff / 200 of both lengths. A letter left out of the
    first text takes two of its pairs, one put in takes one.
    """
    common = F.ceil((own + other) * F.lit(cutoff / 200) - F.lit(1e-9)).cast("int")
    return 3 * common - (own + other) - 1


def _signatures(values: DataFrame, text: str, cutoff: float, order: DataFrame | None) -> DataFrame:
    """Texts with the signatures of which similar ones share one: their rarest pairs of letters, and letters of short texts."""
    n = F.char_length(text)
    low, high = F.ceil(n * F.lit(cutoff / (200 - cutoff)) - F.lit(1e-9)), F.floor(n * F.lit((200 - cutoff) / cutoff) + F.lit(1e-9))
    lengths = F.sequence(low.cast("int"), high.cast("int"))
    needed = F.array_min(F.transform(lengths, lambda m: _needed(n, m, cutoff)))
    rows = values.where(n > 0).withColumns({"_n": n, "_needed": needed})
    paired = _counted(rows, "_at", F.lit(1), F.col("_n") - 1).withColumn("_gram", F.substr(text, F.col("_at"), F.lit(2)))
    # The k-th occurrence of a pair is a signature of its own, so that counts of sets are counts of multisets.
    keys = [c for c in values.columns]
    numbered = paired.groupBy(*keys, "_n", "_needed", "_gram").agg(F.count(F.lit(1)).cast("int").alias("_k")).withColumn("_k", F.explode(F.sequence(F.lit(1), "_k")))
    frequent = (order if order is not None else numbered).groupBy("_gram").agg(F.count(F.lit(1)).alias("_often"))
    ranked = numbered.join(frequent, "_gram", "left").groupBy(*keys, "_n", "_needed").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_often", F.lit(0)).alias("o"), "_gram", "_k"))).alias("_all"))
    first = F.slice("_all", F.lit(1), F.greatest(F.lit(0), F.size("_all") - F.greatest(F.col("_needed"), F.lit(1)) + 1))
    grams = ranked.withColumn("_s", F.explode(first)).select(*keys, F.concat(F.col("_s._gram"), F.col("_s._k").cast("string")).alias("_signature"))
    # Texts so short that none of their pairs need be shared still share a letter.
    letters = rows.where("_needed <= 0").withColumn("_signature", F.explode(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))).select(*keys, "_signature")
    return grams.unionAll(letters)


def similar_candidates(rows: DataFrame, names: DataFrame, block: Sequence[str], cutoff: float) -> DataFrame:
    """(block, a, b): texts a of ``rows`` and b of ``names`` that share a signature; every pair that reaches the cutoff is among them."""
    grams = _counted(names.withColumn("_n", F.char_length("b")), "_at", F.lit(1), F.col("_n") - 1).withColumn("_gram", F.substr("b", F.col("_at"), F.lit(2)))
    left, right = _signatures(rows, "a", cutoff, grams), _signatures(names, "b", cutoff, grams)
    n, m = F.char_length("a"), F.char_length("b")
    near = F.least(n, m) * F.lit(200 - cutoff) >= F.greatest(n, m) * F.lit(cutoff) - F.lit(1e-6)
    return left.join(right, [*block, "_signature"]).where(near).select(*block, "a", "b").distinct()


def best_indel(rows: DataFrame, names: DataFrame, block: Sequence[str], text: str, candidate: str, cutoff: float, allowed: Column | None = None) -> DataFrame:
    """Rows with the candidate of their block whose sorted words are most similar, and the ``similarity`` (at least ``cutoff``, 0 to 100).

    Of equally similar candidates the last by value; rows without one are left out.
    ``allowed`` says which pairs may be taken, by the text, the candidate and the block.
    Each pair of different sorted forms is compared once, whatever the number of rows.
    """
    seen = rows.select(*block, F.col(text).alias("_text"), token_sort(F.col(text)).alias("a")).distinct()
    known = names.select(*block, F.col(candidate).alias("_candidate"), token_sort(F.col(candidate)).alias("b")).distinct()
    pairs = similar_candidates(seen.select(*block, "a").distinct(), known.select(*block, "b").distinct(), block, cutoff)
    pairs = pairs.withColumn("similarity", indel_ratio(F.col("a"), F.col("b"))).where(F.col("similarity") >= cutoff)
    named = pairs.join(seen, [*block, "a"]).join(known, [*block, "b"]).select(*block, F.col("_text").alias(text), F.col("_candidate").alias(candidate), "similarity")
    named = named if allowed is None else named.where(allowed)
    best = named.groupBy(*block, text).agg(F.max_by(F.struct(candidate, "similarity"), F.struct("similarity", candidate)).alias("_b"))
    return rows.join(best, [*block, text]).select(*rows.columns, "_b.*")
