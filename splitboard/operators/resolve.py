"""Entity resolution: fallback lookups, wildcard overrides, canonical names, fuzzy pairs, roster comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fuzzy import near_pairs, probes, segments


def one_per_key(rows: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """The first (or last) row to arrive for each key, so a lookup can't multiply rows."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(pick(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def fallback_lookup(rows: DataFrame, stages: Sequence[tuple[str, DataFrame, str]], found: str = "stage") -> DataFrame:
    """Left joins tried in order: (row's key, dimension with one row for each key, dimension's key).

    The dimensions' other columns are filled from the first stage that has the key;
    ``found`` is its number from 1, null for a miss.
    """
    values = [c for c in stages[0][1].columns if c != stages[0][2]]
    out = rows
    for i, (key, dim, dim_key) in enumerate(stages, 1):
        packed = dim.select(F.col(dim_key).alias(f"_k{i}"), F.struct(F.lit(i).alias("n"), *values).alias(f"_v{i}"))
        out = out.join(packed, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    hit = F.coalesce(*(F.col(f"_v{i}") for i in range(1, len(stages) + 1)))
    return out.select(*rows.columns, hit["n"].cast("long").alias(found), *(hit[v].alias(v) for v in values))


def misses(looked_up: DataFrame, key: str, found: str = "stage") -> DataFrame:
    """Distinct keys that no stage has."""
    return looked_up.where(F.col(found).isNull()).select(key).distinct()


def wildcard_override(rows: DataFrame, overrides: DataFrame, name: str, year: str, order: str, values: Sequence[str]) -> DataFrame:
    """Overrides by (name, year), else by name with a null year; the newest wins within each. Adds ``values``, null without one."""
    newest = lambda df, keys, tag: df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias(tag))
    exact = newest(overrides.where(F.col(year).isNotNull()), [name, year], "_exact")
    anyone = newest(overrides.where(F.col(year).isNull()), [name], "_any")
    hit = F.coalesce("_exact", "_any")
    return rows.join(exact, [name, year], "left").join(anyone, name, "left").select(*rows.columns, *(hit[v].alias(v) for v in values))


def canonical_first(rows: DataFrame, name: str, norm: Column, by: Sequence[str], order: str, out: str = "canonical") -> DataFrame:
    """Add the first spelling to arrive of each normalised name in a group."""
    keyed = rows.withColumn("_norm", norm)
    first = keyed.groupBy("_norm", *by).agg(F.min_by(name, order).alias(out))
    return keyed.join(first, ["_norm", *by]).drop("_norm")


def add_absent(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table and the rows whose key it lacks."""
    return table.unionByName(rows.join(table.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def excluded(rows: DataFrame, names: DataFrame, on: Sequence[str], keep: bool) -> DataFrame:
    """Rows on the list (keep) or off it, by semi or anti join."""
    return rows.join(names.select(*on).distinct(), list(on), "left_semi" if keep else "left_anti")


def fuzzy_pairs(rows: DataFrame, block: str, text: str, id_col: str, limit: int) -> DataFrame:
    """Pairs (a, b) of a block whose texts differ by at most ``limit`` edits; each once, by identifier. Texts are compared once, found by shared segments."""
    own = rows.select(F.col(block), F.col(text).alias("_t"), F.col(id_col).alias("_id"))
    near = near_pairs(own, "_t", limit, [block])
    side = lambda n: own.select(F.col(block), F.col("_t").alias(f"_t{n}"), F.col("_id").alias(f"_id{n}"))
    texts = near.select(F.col(block), F.col("a").alias("_t1"), F.col("b").alias("_t2"), "edits")
    pairs = texts.join(side(1), [block, "_t1"]).join(side(2), [block, "_t2"])
    equal = side(1).join(side(2).withColumnRenamed("_t2", "_t1"), [block, "_t1"]).where("_id1 < _id2").withColumns({"_t2": F.col("_t1"), "edits": F.lit(0).cast("long")})
    first = F.col("_id1") < F.col("_id2")
    out = pairs.where("_id1 <> _id2").unionByName(equal)
    return out.select(
        F.col(block), F.least("_id1", "_id2").alias("a"), F.when(first, F.col("_t1")).otherwise(F.col("_t2")).alias("text_a"),
        F.greatest("_id1", "_id2").alias("b"), F.when(first, F.col("_t2")).otherwise(F.col("_t1")).alias("text_b"), "edits",
    )


def _near_surnames(named: DataFrame) -> DataFrame:
    """(sn1, sn2, ns1, ns2): names of surnames within 2 edits, the earlier surname first, that may be within 3.

    The opening of the first name before its surname is found again in the second
    name, with 3 edits at most, so one of its four segments is there. An opening of
    three letters or less has none: those are compared with names of like length.
    """
    surnames = named.select("_sn", "seen").distinct()
    order = lambda n, c: surnames.select(F.col("_sn").alias(c), F.col("seen").alias(f"seen{n}"))
    close = near_pairs(surnames, "_sn", 2).join(order("a", "a"), "a").join(order("b", "b"), "b")
    first = F.col("seena") < F.col("seenb")
    close = close.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("sn1"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("sn2"))
    one = close.join(named.select(F.col("_sn").alias("sn1"), F.col("_ns").alias("ns1"), F.col("_given").alias("given")), "sn1")
    two = close.join(named.select(F.col("_sn").alias("sn2"), F.col("_ns").alias("ns2")), "sn2")
    length = F.char_length("ns2") - F.char_length("sn1")
    on = ["sn1", "sn2", "_l", "_i", "_part"]
    found = segments(one, "given", 3).join(probes(two, "ns2", 3, length - 3, length + 3, False), on)
    short = one.withColumn("_l", F.char_length("given")).where("_l <= 3")
    like = two.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(3)))).where((F.col("_l") - length).between(-3, 3))
    cols = ["sn1", "sn2", "ns1", "ns2"]
    return found.select(cols).unionAll(short.join(like, ["sn1", "sn2", "_l"]).select(cols)).where("ns1 <> ns2")


def similar_names(rows: DataFrame, name: str, norm: Column, order: str, event: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Pairs of names that may be one person: ``name1``, ``name2``, ``edits``, ``shared_events``, ``likely_same`` and the carried columns of both.

    A name is its normalised form without spaces. Pairs are, in this order, each
    once: of equal surnames (last words) within 3 edits; spaced otherwise (one pair
    for each name, without shared events); of surnames within 2 edits and names
    within 3. Rows
    stand for their name by arrival (``order``, unique): the first, in the third pass
    the last. Names without a common event are likely the same.

    Names of one surname end alike, so only their openings are compared; all passes
    find their pairs by segments (``near_pairs``), none joins on a surname alone.
    """
    keyed = rows.withColumn("_norm", norm).withColumn("_ns", F.replace("_norm", F.lit(" "), F.lit(""))).withColumn("_sn", F.element_at(F.split("_norm", " "), -1))
    row = F.struct(F.col(order).alias("at"), F.col(name).alias("name"), *carried)
    named = keyed.where("_sn <> ''").groupBy("_sn", "_ns").agg(F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))
    seen = named.groupBy("_sn").agg(F.min("first.at").alias("seen"))
    named = named.join(seen, "_sn")
    named = named.withColumn("_given", F.substr("_ns", F.lit(1), F.char_length("_ns") - F.char_length("_sn")))
    side = lambda n, r: named.select(F.col("_sn").alias(f"sn{n}"), F.col("seen").alias(f"seen{n}"), F.col("_ns").alias(f"ns{n}"), F.col("_given").alias(f"given{n}"), F.col("first.at").alias(f"at{n}"), F.col(r).alias(f"r{n}"))

    def near(pairs: DataFrame, step: int) -> DataFrame:
        rank = F.struct(F.lit(step).alias("step"), "seen1", "seen2", "at1", "at2")
        return pairs.select(rank.alias("rank"), "ns1", "ns2", "r1", "r2", "edits")

    given = near_pairs(named, "_given", 3, ["_sn"]).select(F.col("_sn").alias("sn1"), F.col("_sn").alias("sn2"), F.col("a").alias("given1"), F.col("b").alias("given2"), "edits")
    # Each pair of openings both ways: the name that arrived first comes first.
    given = given.unionAll(given.select("sn1", "sn2", F.col("given2").alias("given1"), F.col("given1").alias("given2"), "edits"))
    same = near(given.join(side(1, "first"), ["sn1", "given1"]).join(side(2, "first"), ["sn2", "given2"]).where("at1 < at2"), 1)
    close = _near_surnames(named).withColumn("edits", F.levenshtein("ns1", "ns2", 3).cast("long")).where("edits >= 0").distinct()
    other = near(close.join(side(1, "last"), ["sn1", "ns1"]).join(side(2, "last"), ["sn2", "ns2"]), 3)
    pair = [F.least("ns1", "ns2").alias("ns1"), F.greatest("ns1", "ns2").alias("ns2")]
    best = same.unionAll(other).groupBy(*pair).agg(F.min_by(F.struct("r1", "r2", "edits", F.col("ns1").alias("n1"), F.col("ns2").alias("n2")), "rank").alias("_p")).select("_p.*")
    events = keyed.groupBy(F.col("_ns")).agg(F.collect_set(F.struct(*event)).alias("events"))
    one, two = (events.select(F.col("_ns").alias(f"n{i}"), F.col("events").alias(f"events{i}")) for i in (1, 2))
    shared = F.array_sort(F.array_intersect("events1", "events2")).alias("shared_events")
    best = best.join(one, "n1").join(two, "n2").select("r1", "r2", "edits", shared)
    # The first row of a name, and the first that is spaced otherwise.
    spaced = keyed.groupBy("_ns", "_norm").agg(F.min_by(row, order).alias("r"))
    spaced = spaced.groupBy("_ns").agg(F.array_sort(F.collect_list("r")).alias("r")).where(F.size("r") > 1)
    none = F.array().cast(best.schema["shared_events"].dataType).alias("shared_events")
    spaced = spaced.select(F.col("r")[0].alias("r1"), F.col("r")[1].alias("r2"), F.lit(0).cast("long").alias("edits"), none)
    extra = [F.col(f"r{n}.{c}").alias(f"{c}{n}") for c in carried for n in (1, 2)]
    likely = (F.size("shared_events") == 0).alias("likely_same")
    return best.unionAll(spaced).select(F.col("r1.name").alias("name1"), F.col("r2.name").alias("name2"), "edits", "shared_events", likely, *extra)


def abbreviation_report(rows: DataFrame, name: str, raw: str, norm, club: str, year: str, order: str) -> DataFrame:
    """Every pair of an abbreviated and a full name of one surname and initial, once for each pair of raw names, with ``year_match``. ``norm`` makes a column's lookup form."""
    words = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    first = words[0]
    short = first.rlike(r"^[A-ZÇĞİÖŞÜa-zçğışöüÀ-ÿ]{1,2}\.$")
    initial = F.when(short, norm(F.regexp_replace(first, r"\.+$", ""))).otherwise(norm(F.substring(first, 1, 1)))
    keyed = rows.where(F.size(words) >= 2).select(short.alias("short"), norm(F.element_at(words, -1)).alias("_sn"), initial.alias("_initial"), F.struct(F.col(order).alias("at"), F.col(raw).alias("raw"), F.col(club).alias("club"), F.col(year).alias("year")).alias("r"))
    once = keyed.groupBy("short", "_sn", "_initial", "r.raw").agg(F.min_by("r", "r.at").alias("r"))
    a = once.where("short").select("_sn", "_initial", F.col("r").alias("a"))
    b = once.where("NOT short").select("_sn", "_initial", F.col("r").alias("b"))
    pairs = a.join(b, ["_sn", "_initial"]).groupBy(F.col("a.raw").alias("abbrev_name"), F.col("b.raw").alias("full_name")).agg(F.min_by(F.struct("a", "b"), F.struct("a.at", "b.at")).alias("_p"))
    return pairs.select("abbrev_name", "full_name", F.col("_p.a.club").alias("abbrev_club"), F.col("_p.b.club").alias("full_club"), F.col("_p.a.year").eqNullSafe(F.col("_p.b.year")).alias("year_match"))


def abbreviation_pairs(rows: DataFrame, last: str, first: str, by: Sequence[str], id_col: str) -> DataFrame:
    """A row whose first name is an initial, with the full name (the last to arrive) of the same surname and group that begins with it."""
    initial = rows.where(F.col(first).rlike(r"^\p{L}\.?$"))
    full = rows.where(~F.col(first).rlike(r"^\p{L}\.?$")).groupBy(last, *by).agg(F.max_by(F.struct(F.col(first).alias("full_first"), F.col(id_col).alias("full_id")), F.col(id_col)).alias("_f"))
    joined = initial.join(full, [last, *by]).select(*rows.columns, "_f.*")
    return joined.where(F.upper(F.substring("full_first", 1, 1)) == F.upper(F.substring(first, 1, 1)))


def roster_compare(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, same=None) -> DataFrame:
    """Full outer join with ``status``: both, differs, only_a, only_b."""
    left = a.select(*on, F.col(value).alias("value_a"), F.lit(True).alias("_a"))
    right = b.select(*on, F.col(value).alias("value_b"), F.lit(True).alias("_b"))
    equal = same(F.col("value_a"), F.col("value_b")) if same else F.col("value_a").eqNullSafe(F.col("value_b"))
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(equal, "both").otherwise("differs")
    return left.join(right, list(on), "full_outer").withColumn("status", status).drop("_a", "_b")


def enrich(rows: DataFrame, override: Sequence[str], looked_up: Sequence[str]) -> DataFrame:
    """An override with any value replaces all looked-up ones, even by null; ``found`` says whether either has a value."""
    has = F.coalesce(*(F.col(c).isNotNull() for c in override[:1])) if len(override) == 1 else sum((F.col(c).isNotNull().cast("int") for c in override), F.lit(0)) > 0
    out = {c: F.when(has, F.col(o)).otherwise(F.col(c)) for o, c in zip(override, looked_up)}
    found = has | (sum((F.col(c).isNotNull().cast("int") for c in looked_up), F.lit(0)) > 0)
    return rows.withColumn("found", found).withColumns(out)


def donor_names(rows: DataFrame, keys: Sequence[str], event: Sequence[str], name: str, time: str, order: str, carried: Sequence[str]) -> DataFrame:
    """Best time for each key and event; a fused name is replaced by a good one.

    A name is good with a space or fewer than eight letters. The donor is the first
    good row of the same event, else the row of the key with most words; ``carried``
    columns go with the name.
    """
    good = F.col(name).contains(" ") | (F.char_length(name) < 8)
    what = F.struct(name, *carried)
    words = F.struct((-F.size(F.split(name, " "))).alias("w"), F.col(order).alias("at"))
    rest = [c for c in rows.columns if c not in (*keys, *event)]
    # One pass: an event's best row and donor, and its row with most words; then those of a person's events, which are few.
    each = rows.groupBy(*keys, *event).agg(
        F.min_by(F.struct(*rest), F.struct(F.col(time).isNull(), time, order)).alias("_r"), F.min_by(F.when(good, what), F.when(good, F.col(order))).alias("_local"),
        F.min_by(what, words).alias("_what"), F.min(words).alias("_words"),
    )
    wide = each.withColumn("_wide", F.min_by("_what", "_words").over(Window.partitionBy(*keys)))
    best = wide.select(*keys, *event, "_r.*", "_local", "_wide").select(*rows.columns, "_local", "_wide")
    donor = F.when(good, what).otherwise(F.coalesce("_local", "_wide"))
    out = {c: F.coalesce(donor[c], F.col(c)) for c in (name, *carried)}
    return best.withColumns(out).drop("_local", "_wide")
