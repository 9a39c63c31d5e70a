"""Document fingerprints by consistent weighted sampling.

For each of K samples every term draws, from its own hash, two gamma(2, 1) variates r
and c and a uniform b; with weight w it gets t = floor(ln w / r + b) and the value
ln c - r (t - b) - r. The term of least value, with its t, is the sample. Two
documents agree in a sample with the probability that their weighted term sets'
generalised Jaccard similarity states. Terms are words, weights their counts.

Everything is DataFrame operations. A document's rows stay in the partition its text
was dealt to, so exploding into terms and grouping again costs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

#: Samples of a fingerprint.
SAMPLES = 32
#: Samples drawn in one row; divides SAMPLES.
TOGETHER = 4
#: Fixed-point scale of ln values; 32 bits below hold the sample's identity.
SCALE = 1 << 19
SPLIT = r"[\x20\x09-\x0D]+"


def term_draws(term: Column, k: Column) -> tuple[Column, Column, Column]:
    """(r, ln c, b) of the term in sample k; ``term`` is a 64-bit hash."""
    one, two = F.xxhash64(term, 2 * k), F.xxhash64(term, 2 * k + 1)

    def part(bits: Column, shift: int, width: int) -> Column:
        return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + 0.5) / float(1 << width)

    r = -F.log(part(one, 43, 21) * part(one, 22, 21))
    log_c = F.log(-F.log(part(two, 32, 32) * part(two, 0, 32)))
    return r, log_c, part(one, 0, 22)


def sample(term: Column, log_weight: Column, draws: tuple[Column, Column, Column]) -> Column:
    """Value and identity of one candidate in a long, ordered by value: the least is the sample."""
    r, log_c, b = draws
    t = F.floor(log_weight / r + b)
    value = log_c - r * (t - b) - r
    # The term is a hash already; an odd multiple of t tells its levels apart.
    identity = term.bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(F.lit(0xFFFFFFFF))
    # With the draws' resolution the value lies between -80 and 60.
    return F.shiftleft(F.floor(value * SCALE), 32).bitwiseOR(identity)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two arrays of K; two empty documents are alike, an empty one and another not."""
    equal = sum((a[k].bitwiseAND(F.lit(0xFFFFFFFF)) == b[k].bitwiseAND(F.lit(0xFFFFFFFF))).cast("int") for k in range(SAMPLES))
    both = F.isnull(a) & F.isnull(b)
    return F.when(both, 1.0).when(F.isnull(a) | F.isnull(b), 0.0).otherwise(equal / F.lit(float(SAMPLES)))


def as_text(samples: Column) -> Column:
    """32 bits of each sample in hex; empty for a text without words."""
    digits = [F.lpad(F.lower(F.hex(samples[k].bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for k in range(SAMPLES)]
    return F.when(F.isnull(samples), "").otherwise(F.concat(*digits))


def _sampled(counted: DataFrame, keys: list[str], weights: dict[str, str]) -> DataFrame:
    """(keys, an array of K samples for each weight column, null where no term has weight).

    A row for each term and ``TOGETHER`` samples keeps the generated code small and the
    aggregate's rows few. A term's draws are computed once for all weights, and a
    weight equal to the first has its candidate.
    """
    rows = counted.select(
        *keys,
        F.xxhash64("word").alias("term"),
        *weights,
        *(F.log(F.col(w)).alias(f"log_{w}") for w in weights),
        F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1), F.lit(TOGETHER))).alias("k"),
    )
    first, each = next(iter(weights)), range(TOGETHER)
    names = ("r", "log_c", "b")
    drawn = rows.select("*", *(d.alias(f"{n}{j}") for j in each for d, n in zip(term_draws(F.col("term"), F.col("k") + j), names)))

    def own(w: str, j: int) -> Column:
        return F.when(F.col(w) > 0, sample(F.col("term"), F.col(f"log_{w}"), tuple(F.col(f"{n}{j}") for n in names))).alias(f"{w}_{j}")

    def other(w: str, j: int) -> Column:
        return F.when(F.col(w) == F.col(first), F.col(f"{first}_{j}")).otherwise(own(w, j)).alias(f"{w}_{j}")

    drawn = drawn.select("*", *(own(first, j) for j in each))
    drawn = drawn.select(*keys, "k", *(F.col(f"{w}_{j}") if w == first else other(w, j) for w in weights for j in each))
    least = drawn.groupBy(*keys, "k").agg(*(F.min(f"{w}_{j}").alias(f"{name}_{j}") for w, name in weights.items() for j in each))
    parts = least.select(*keys, "k", *(F.array(*(f"{name}_{j}" for j in each)).alias(name) for name in weights.values()))
    gathered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", *weights.values()))).alias("all"))
    flat = gathered.select(*keys, *(F.flatten(f"all.{n}").alias(n) for n in weights.values()))
    return flat.select(*keys, *(F.when(F.col(n)[0].isNotNull(), F.col(n)).alias(n) for n in weights.values()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and ``fingerprint`` (hex; null and empty texts: empty).

    For a table by itself. The rows are dealt once by a hash of identifier and text;
    repeated rows are fingerprinted once and all come out. Other columns, whatever their
    names, are not looked at. An empty table gives no rows.
    """
    n = 2 * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("row", F.xxhash64(F.sha2("body", 256))).groupBy("id", "row", "body").count().repartition(n, "row", "id")
    terms = rows.select("row", "id", "count", F.explode(F.split("body", SPLIT)).alias("word"))
    counted = terms.groupBy("row", "id", "count", "word").agg(F.count(F.when(F.col("word") != "", 1)).alias("w"))
    signed = _sampled(counted, ["row", "id", "count"], {"w": "f"})
    each = F.explode(F.sequence(F.lit(1), F.col("count")))
    return signed.select(F.col("id").alias(id_col), as_text(F.col("f")).alias("fingerprint"), each.alias("_")).drop("_")


def successor_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    In descending order of identifier (nulls last, then by text), a document's last
    floor(n_chars / 3) code points are replaced by the first as many, or all, of the
    next document's; the first document follows the last. One row per document: id,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. A null text is empty; an empty text has an empty
    fingerprint, and is like an empty text (1) and unlike any other (0). Repeated rows
    follow one another. A single document follows itself. An empty table gives no rows.

    Identifiers are cut into ranges at quantiles of the identifier column; a range is
    one partition, and only the head of each range (one row) is passed to the range
    before it.
    """
    spark = docs.sparkSession
    n = 2 * shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # Splitters: a fixed number for the partitions, from one pass over the narrow column.
    splits = docs.agg(F.percentile_approx(F.col(id_col), F.lit([i / n for i in range(1, n)]), 100 * n).alias("at")).first()["at"] or []
    splits = sorted(set(splits))
    # Range 0 has the largest identifiers and the last one the null ones.
    part = (len(splits) + 1) - F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s < F.col("id"))) if splits else F.lit(1)
    ranged = rows.withColumn("part", F.when(F.col("id").isNull(), len(splits) + 2).otherwise(part).cast("int"))
    # Each range is a partition of its own, by its number.
    dealt = ranged.repartitionById(n, F.col("part"))
    order = Window.partitionBy("part").orderBy(F.desc_nulls_last("id"), "body")
    ordered = dealt.select("part", F.row_number().over(order).alias("place"), "id", "body", F.lead("body").over(order).alias("follows"))
    return _finish(ordered, ranged, n, id_col)


def _next_part(ranged: DataFrame) -> DataFrame:
    """(part, after): the range that follows each range with rows; ranges are a fixed number."""
    parts = ranged.select("part").distinct()
    every = Window.partitionBy(F.lit(1)).orderBy("part")
    whole = Window.partitionBy(F.lit(1))
    return parts.select("part", F.coalesce(F.lead("part").over(every), F.min("part").over(whole)).alias("after"))


def _finish(ordered: DataFrame, ranged: DataFrame, n: int, id_col: str) -> DataFrame:
    after = cut(_next_part(ranged))
    # The head of a range: its largest (identifier, then least text), by a partial aggregate.
    biggest = ranged.groupBy("part").agg(F.max("id").alias("top"))
    heads = (
        ranged.join(F.broadcast(biggest.withColumnRenamed("part", "p")), (F.col("part") == F.col("p")) & F.col("id").eqNullSafe(F.col("top")))
        .groupBy("part")
        .agg(F.min("body").alias("head"))
    )
    heads = cut(after.join(heads.withColumnRenamed("part", "after"), "after").select(F.col("part").alias("of"), "head"))
    joined = ordered.join(heads, ordered.part == heads.of, "left").withColumn("next", F.coalesce("follows", "head"))
    n_chars = F.char_length("body")
    third = F.floor(n_chars / 3).cast("int")
    edited = F.concat(F.expr("left(body, char_length(body) - cast(floor(char_length(body) / 3) as int))"), F.expr("left(next, cast(floor(char_length(body) / 3) as int))"))
    wide = joined.select("part", "place", "id", n_chars.cast("long").alias("n_chars"), "body", F.when(third > 0, edited).otherwise(F.col("body")).alias("edited"))
    wide = wide.withColumn("edited_sha256", F.sha2("edited", 256))
    # Both texts begin alike: the whole words before the edit are counted once for both.
    stay = F.expr("left(body, char_length(body) - cast(floor(char_length(body) / 3) as int))")
    wide = wide.withColumn("common", F.regexp_extract(stay, r"(?s)^.*[\x20\x09-\x0D]", 0))
    rest = lambda c: F.substr(F.col(c), F.char_length("common") + 1)
    texts = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("common").alias("t")),
        F.struct(F.lit(1).alias("kind"), rest("body").alias("t")),
        F.struct(F.lit(2).alias("kind"), rest("edited").alias("t")),
    )
    keys = ["part", "place"]
    terms = wide.select(*keys, F.explode(texts).alias("x")).select(*keys, F.col("x.kind").alias("kind"), F.explode(F.split("x.t", SPLIT)).alias("word"))
    own = (F.col("word") != "") & (F.col("kind") != 2)
    new = (F.col("word") != "") & (F.col("kind") != 1)
    counted = terms.groupBy(*keys, "word").agg(F.count(F.when(own, 1)).alias("w"), F.count(F.when(new, 1)).alias("v"))
    # Both sides of this join lie in the partitions that the texts were dealt to.
    signed = _sampled(counted, keys, {"w": "f", "v": "e"})
    signed = cut(signed.join(wide.select(*keys, "id", "n_chars", "edited_sha256"), keys))
    order = Window.partitionBy("part").orderBy("place")
    linked = signed.withColumn("follows", F.lead(F.struct("f")).over(order))
    first = signed.where("place = 1").select(F.col("part").alias("after"), F.struct("f").alias("head"))
    heads = after.join(first, "after").select(F.col("part").alias("of"), "head")
    out = linked.join(heads, linked.part == heads.of, "left").withColumn("next", F.coalesce("follows", "head").getField("f"))
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("f")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"),
        likeness(F.col("f"), F.col("next")).alias("near_next"),
    )
