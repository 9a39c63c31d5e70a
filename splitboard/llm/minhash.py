"""Near-duplicate grouping by b-bit MinHash.

1. Every document's distinct word shingles give minima under 400 hash functions. The
   low 4 bits of each are kept and packed (200 bytes); of the first 112, runs of four
   whole minima give 28 band keys. Documents of one word sequence are one node, named
   by a hash of its words.
2. Nodes that share a band key are candidates. A bucket is led by its most central
   node, and each node is first compared with the most central of its buckets'
   leaders. A candidate goes on if sizes allow a link and its similarity, estimated
   from the packed bits by bit counts and corrected for chance agreement, is not far
   below the threshold; then both whole sets are compared. Nodes that share an
   identifier are linked too.
3. Buckets that still hold several components are looked at again. In a small one all
   pairs between components are candidates. In a large one every node is compared with
   the leader whole, which leaves the few shingles in which it differs from the leader.
   Two nodes that are not in one component yet can only be linked if they share such a
   difference (see ``_postings``), so the differences are an inverted index, and pairs
   come from its lists. A list that is long itself becomes a group with a leader of its
   own, until none is left. So a group of copies costs a few rows a node, and no link is
   lost to a cap.

At the threshold 0.8 a pair shares no band with probability 4e-7, and an estimate is
low by more than the margin with probability below 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship

#: Band keys, minima in each; all minima, and kept bits of each.
BANDS, ROWS = 28, 4
HASHES, KEPT = 400, 4
LONGS = HASHES * KEPT // 64
#: How far an estimate may lie below the threshold: 5.3 standard deviations at 0.8.
MARGIN = 0.11
#: Shingles hashed at a time; words a worker remembers, and their bytes at most.
CHUNK, REMEMBERED, WORD = 2048, 200_000, 64
#: Columns with hashes of a row's identifier and text, by which it is found again.
HASHED = ("h0", "h1", "h2")
#: Rows up to which the texts to compare are picked by a broadcast; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Nodes of a bucket whose pairs are taken directly, and of a posting list; larger ones get a leader.
SMALL, POSTED = 16, 8192
#: Pairs of one leader that come with one copy of its text.
TOGETHER = 64
#: Nodes of a group up to which all its differences are counted; of a larger one, one node in so many tells which differences are frequent, and so many of these are told apart.
COUNTED, ONE_IN, OFTEN = 256, 8, 512

_seeds = np.random.RandomState(20240229)
_A = (_seeds.randint(0, 1 << 31, HASHES, np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _seeds.randint(0, 1 << 31, HASHES, np.int64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_words = _Words()


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``width`` are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    each = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    # The number of words is part of a shingle, so a short text equals no other's shingle.
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + each[i : len(words) - width + 1 + i])
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), CHUNK):
        np.minimum(least, (short[i : i + CHUNK, None] * _A + _B).min(0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least[: BANDS * ROWS].reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + part)
    return keys.view(np.int64)


def pack(least: np.ndarray) -> np.ndarray:
    """The low bits of the (mixed) minima, 16 in a 64-bit integer."""
    low = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - KEPT)).astype(np.uint64).reshape(LONGS, -1)
    shifts = np.arange(0, 64, KEPT, dtype=np.uint64)
    return (low << shifts).sum(1, dtype=np.uint64).view(np.int64)


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity from packed bits: the share of equal minima less what chance gives."""
    nibbles = 0x1111111111111111
    unequal = None
    for x, y in zip(a, b):
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(nibbles))
        unequal = F.bit_count(d) if unequal is None else unequal + F.bit_count(d)
    equal = 1 - unequal / F.lit(HASHES)
    chance = 1.0 / (1 << KEPT)
    return (equal - chance) / (1 - chance)


def _signed(width: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for body in batch["body"]:
                words = tokens(body)
                found = shingles(words, width)
                if len(found):
                    least = minima(found)
                    rows.append((hashlib.blake2b(b" ".join(words), digest_size=16).digest(), len(found), bands(least), *pack(least).tolist()))
                else:
                    rows.append((b"", 0, [], *[0] * LONGS))
            out = pd.DataFrame(rows, columns=["key", "n", "bands", *(f"s{i}" for i in range(LONGS))])
            for i, name in enumerate(("id", *HASHED)):
                out.insert(i, name, batch[name].values)
            yield out

    return sign


def _compared(width: int, percent: int):
    """linked; with ``whole`` also p (shingles in common) and b's shingles outside a (extra) and a's outside b (missing)."""

    @F.pandas_udf("linked boolean, p long, extra array<long>, missing array<long>")
    def compared(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for left, right, whole in batches:
            out = []
            for a, b, all_ in zip(left, right, whole):
                if a != last:  # the rows of one leader mostly come together
                    last, held = a, shingles(tokens(a), width)
                other = shingles(tokens(b), width)
                both = np.intersect1d(held, other, assume_unique=True)
                linked = 100 * len(both) >= percent * (len(held) + len(other) - len(both)) and len(both) > 0
                if all_:
                    differ = (np.setdiff1d(x, both, assume_unique=True).view(np.int64) for x in (other, held))
                    out.append((linked, len(both), *differ))
                else:
                    out.append((linked, None, None, None))
            yield pd.DataFrame(out, columns=["linked", "p", "extra", "missing"]).astype({"linked": bool, "p": "Int64"})

    return compared


def components(links: DataFrame, cut: Scratch) -> DataFrame:
    """(node, label) of all nodes in links (a, b): the least node that each reaches.

    Each round takes the least label among neighbours, then the label's own label,
    until nothing changes; what is done grows with the links, not with their square.
    """
    edges = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        jumped = moved.join(up, moved.next == up.via, "left").select("node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("label")).alias("less"))
        labels, told = cut.told(jumped, moved=F.count_if("less"))
        labels = labels.drop("less")
        if not told["moved"]:
            return labels


def _label(rows: DataFrame, labels: DataFrame, node: str = "node", out: str = "label") -> DataFrame:
    """``rows`` with the label of a node; a node without links is its own."""
    known = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(known, F.col(node) == F.col("_node"), "left").withColumn(out, F.coalesce("_label", node)).drop("_node", "_label")


def _merged(labels: DataFrame, links: DataFrame, cut: Scratch) -> DataFrame:
    """The labels after further links: components of the links between labels, which are few."""
    ends = _label(_label(links, labels, "a", "la"), labels, "b", "lb").where("la <> lb")
    between, told = cut.told(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")), n=F.count(F.lit(1)))
    if not told["n"]:
        return labels
    roots = components(between, cut)
    moved = _label(labels.withColumnRenamed("label", "old"), roots, "old").select("node", "label")
    return cut(moved.unionAll(roots.join(labels, "node", "left_anti")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents whose shingle sets have 100 * intersection >= ``percent`` * union are
    linked; a component has its least identifier. A text without words (null, empty)
    is linked with nothing. Documents of one word sequence are linked, and so are the
    texts of rows that share an identifier. Rows without identifier link as others do;
    a component without any identifier is null. ``kept`` marks rows that are their
    component. Very long texts are taken whole. An empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    with Scratch(spark) as cut:
        return _grouped(docs, id_col, text, width, percent, cut)


def _grouped(docs: DataFrame, id_col: str, text: str, width: int, percent: int, cut: Scratch) -> DataFrame:
    bodies = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    bodies = bodies.select("id", F.xxhash64("id").alias("h0"), F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"), "body")
    kind = dict(bodies.dtypes)["id"]
    packed = [f"s{i}" for i in range(LONGS)]
    schema = f"id {kind}, h0 long, h1 long, h2 long, key binary, n long, bands array<long>, " + ", ".join(f"{s} long" for s in packed)
    signed = cut.keep(bodies.mapInPandas(_signed(width), schema))
    # A node for each word sequence, and the row that stands for it: of its least identifier, null if it has none.
    row = F.struct(F.col("id").isNull().alias("none"), "id", *HASHED)
    worded = signed.where("n > 0")
    # Names are hashes of the words, the first that are all different.
    seed = 0
    while True:
        name = F.xxhash64(F.lit(seed), "key")
        same = worded.groupBy("key").agg(F.min(row).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in packed))
        full = cut.keep(same.select(name.alias("node"), "r.id", *(f"r.{h}" for h in HASHED), "n", "bands", *packed))
        if full.groupBy("node").count().where("count > 1").isEmpty():
            break
        seed += 1
    signed, worded = signed.withColumn("node", name), worded.withColumn("node", name)
    # Texts that share an identifier: the least node with each other one.
    several = worded.where("id IS NOT NULL").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
    shared_ids = worded.select("id", "node").join(several, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    placed = full.select("node", F.explode("bands").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut(placed.join(sizes, "bucket"))
    # The more nodes share its bands, the nearer a node is to the middle of its copies:
    # what an edited copy is most like. A bucket is led by its most central node.
    central = cut(shared.groupBy("node").agg(F.sum("size").alias("centre")))
    leads = shared.join(central, "node").groupBy("bucket").agg(F.min(F.struct(-F.col("centre"), F.col("node").alias("leader"))).alias("lead"))
    members = cut(shared.join(leads, "bucket"))
    floor = percent / 100 - MARGIN

    def named(side: str) -> DataFrame:
        return full.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), *(F.col(s).alias(f"{s}_{side}") for s in packed))

    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    fits = sized & (estimate([F.col(f"{s}_a") for s in packed], [F.col(f"{s}_b") for s in packed]) >= floor)

    def likely(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sizes and packed bits allow a link."""
        return pairs.join(named("b"), "b").join(named("a"), "a").where(fits).select("a", "b")

    def compared(pairs: DataFrame) -> DataFrame:
        """(a, b, linked, p, extra, missing) from the whole sets of pairs (a, b, whole), see ``_compared``."""
        pairs, told = cut.told(pairs, n=F.count(F.lit(1)))
        wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
        rows = full.select("node", *HASHED).join(wanted, "node")
        # Five longs a row, at most two rows a pair.
        rows = F.broadcast(rows) if 2 * told["n"] <= BROADCAST_IDS else rows
        texts = cut(bodies.drop("id").join(rows, list(HASHED)).dropDuplicates(["node"]).select("node", "body"))
        # The pairs of one leader come in parts, each with one copy of the leader's text.
        parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
        dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
        left = dealt.select("a", "part").distinct().join(texts.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
        both = dealt.join(texts.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b").join(left, ["a", "part"])
        return cut(both.select("a", "b", _compared(width, percent)("body_a", "body_b", "whole").alias("r")).select("a", "b", "r.*"))

    # Each node with its most central leader.
    tops = cut(members.groupBy("node").agg(F.min("lead").alias("lead")).select("node", F.col("lead.leader").alias("top")))
    first = tops.select(F.col("top").alias("a"), F.col("node").alias("b")).where("a <> b")
    first = compared(likely(first).withColumn("whole", F.lit(False))).select("a", "b", "linked")
    labels = components(shared_ids.unionAll(first.where("linked").select("a", "b")), cut)

    # Buckets that still hold several components: in small ones, all pairs that were not compared yet.
    known = _label(members.select("bucket", "node", "size", F.col("lead.leader").alias("leader")), labels)
    open_ = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    known = cut(known.join(open_, "bucket"))
    little = known.where(F.col("size") <= SMALL)
    a = little.select("bucket", F.col("node").alias("a"), F.col("label").alias("label_a"))
    b = little.select("bucket", F.col("node").alias("b"), F.col("label").alias("label_b"))
    pairs = a.join(b, "bucket").where("a < b AND label_a <> label_b").select("a", "b").distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = likely(pairs.join(tried, ["a", "b"], "left_anti")).withColumn("whole", F.lit(False))
    # In large ones, every node with the leader, whole; then what its set differs in says which others it can be linked with.
    # Any node will do as leader of all nodes of a bucket: taking the most central leader of the leader makes few groups of many.
    groups = known.where(F.col("size") > SMALL).select(F.col("leader").alias("of"), F.col("node").alias("b")).distinct()
    groups = groups.join(tops.withColumnRenamed("node", "of"), "of").select(F.col("top").alias("g"), F.col("top").alias("a"), "b").distinct()
    groups = cut(groups.where("a <> b"))
    while True:
        found = compared(pairs.unionAll(groups.select("a", "b").distinct().withColumn("whole", F.lit(True))))
        labels = _merged(labels, found.where("linked").select("a", "b"), cut)
        rows = groups.join(found.where("p IS NOT NULL"), ["a", "b"]).join(full.select(F.col("node").alias("b"), "n").join(central.withColumnRenamed("node", "b"), "b"), "b")
        rows = cut(_label(_label(rows, labels, "b", "label"), labels, "a", "lead_label"))
        posted, told = cut.told(_postings(rows, percent, cut), small=F.count_if(F.col("size") <= POSTED), large=F.count_if(F.col("size") > POSTED))
        if told["small"]:
            links = _posted_links(posted.where(F.col("size") <= POSTED), rows, full, percent)
            labels = _merged(labels, cut(links), cut)
        if not told["large"]:
            break
        # A difference that many nodes share makes a group of its own, led by its most central node.
        # Such groups of one group with one leader are one, as a passage has many shingles.
        large = posted.where(F.col("size") > POSTED)
        leads = large.groupBy("g", "missing", "term").agg(F.max(F.struct("centre", "b")).alias("lead")).select("g", "missing", "term", F.col("lead.b").alias("a"))
        groups = large.select("g", "missing", "term", "b").join(leads, ["g", "missing", "term"]).where("a <> b")
        groups = cut(groups.select(F.xxhash64("g", "a").alias("g"), "a", "b").distinct())
        pairs = pairs.limit(0)

    # A component's least identifier, for linked nodes; the others have their own.
    labels = cut.keep(labels)
    linked = labels.join(full.select("node", "id"), "node")
    least = linked.groupBy("label").agg(F.min("id").alias("component"))
    linked = labels.join(least, "label").select("node", "component", F.lit(True).alias("linked"))
    own = full.select("node", "id").join(linked, "node", "left").select("node", F.when(F.col("linked"), F.col("component")).otherwise(F.col("id")).alias("component"))
    return (
        signed.select("id", "node", "n")
        .join(own, "node", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def _postings(rows: DataFrame, percent: int, cut: Scratch) -> DataFrame:
    """The nodes of each group under their differences (missing, term) from the leader, where a link is still possible.

    Let a group's leader have the set L and a node n shingles, p of them in L. Two nodes
    b and c that are linked share at least t (n_b + n_c) shingles, t = percent / (100 +
    percent), and at most min(p_b, p_c) of them in L, so at least
    e = t (n_b + n_c) - min(p_b, p_c) outside. Sizes may differ by ``percent`` only, and
    of the nodes that b can still be linked with (those of other labels than the leader's,
    if b has that) the group's least n_c and most p_c are known, so e has a lower bound
    for each node: who has fewer shingles outside L posts none, and of the others it is
    enough to post the first n_b - p_b - max(1, that) + 1 in any order that the group's nodes
    have in common, as the first shingle in that order that b and c share is among those of
    both. The rarest in the group should come first, so that lists are short. In a group of
    up to ``COUNTED`` nodes all are counted for that. In a larger one only what is posted
    leaves its node: shingles go by their hash, and after them those that some of the nodes
    show to be frequent. Which nodes these are changes the lengths of the lists, not the
    links. If e <= 0 and they share no shingle outside, then one of them, that is not linked with the
    leader, shares with the other a shingle of L that both lack; those are posted by
    the few nodes whose sizes allow it. Nothing is posted where all have one label.
    """
    t = F.lit(percent / (100.0 + percent))
    # Two nodes can do without a shared shingle outside L if n_c <= reach_b and n_b <= reach_c.
    rows = rows.withColumn("reach", F.floor(F.col("p") / t + 1e-6) - F.col("n"))
    apart = F.col("label") != F.col("lead_label")
    bounds = rows.groupBy("g").agg(
        F.min(F.least("label", "lead_label")).alias("low"),
        F.max(F.greatest("label", "lead_label")).alias("high"),
        F.min("n").alias("least_n"),
        F.min(F.when(apart, F.col("n"))).alias("apart_n"),
        F.max("p").alias("most_p"),
        F.max(F.when(apart, F.col("p"))).alias("apart_p"),
        F.max(F.when(apart, F.col("reach"))).alias("apart_reach"),
        F.count(F.lit(1)).alias("nodes"),
    )
    rows = rows.join(bounds.where("low < high").drop("low", "high"), "g")
    # What the other node of a pair has at least and at most: one of the leader's own label needs another's.
    other_n, other_p = F.when(apart, F.col("least_n")).otherwise(F.col("apart_n")), F.when(apart, F.col("most_p")).otherwise(F.col("apart_p"))
    least = t * (F.col("n") + F.greatest(other_n, F.lit(percent / 100) * F.col("n"))) - F.least("p", other_p)
    need = F.greatest(F.lit(1).cast("long"), F.ceil(least - 1e-6))
    eligible = (apart & (F.col("reach") >= F.col("least_n"))) | ((F.col("n") <= F.col("apart_reach")) & (F.col("reach") >= F.col("apart_n")))
    none = F.array().cast("array<long>")
    rows = rows.withColumn("need", need).withColumn("x", F.size("extra"))
    large, able = F.col("nodes") > COUNTED, F.col("x") >= F.col("need")
    rows = rows.join(_frequent(rows.where(large & able)), "g", "left").withColumn("often", F.coalesce("often", none))
    late = F.transform(F.array_intersect("extra", "often"), lambda x: F.struct(F.array_position("often", x).alias("at"), x.alias("term")))
    order = F.concat(F.array_sort(F.array_except("extra", "often")), F.array_sort(late)["term"])
    first = F.slice(order, F.lit(1), F.greatest(F.col("x") - F.col("need") + 1, F.lit(0)).cast("int"))
    inside = F.when(eligible, F.col("missing")).otherwise(none)
    outside = F.when(~able, none).when(large, first).otherwise(F.col("extra"))
    terms = F.concat(
        F.transform(outside, lambda x, i: F.struct(F.lit(False).alias("missing"), x.alias("term"), F.when(large, i + 1).alias("at"))),
        F.transform(inside, lambda x: F.struct(F.lit(True).alias("missing"), x.alias("term"), F.lit(None).cast("int").alias("at"))),
    )
    each = rows.select("g", "b", "n", "p", "reach", "label", "centre", "need", "x", F.explode(terms).alias("t"))
    each = each.select("g", "t.missing", "t.term", "b", "n", "p", "reach", "label", "centre", "need", "x", "t.at")
    key = ["g", "missing", "term"]
    each = cut(each)
    # Those that one node alone has make no pair. Where all are counted they come first in the order.
    common = each.groupBy(*key).agg(F.count(F.lit(1)).alias("common"), F.min("n").alias("smallest")).where("common > 1")
    own = Window.partitionBy("g", "b", "missing")
    place = F.coalesce("at", F.row_number().over(own.orderBy("common", "term")) + F.col("x") - F.count(F.lit(1)).over(own))
    each = each.join(common, key).withColumn("place", place)
    # From its place on a node has x - place + 1 shingles to share, and must share e with any node of the list.
    least = F.ceil(t * (F.col("n") + F.greatest(F.col("smallest"), F.lit(percent / 100) * F.col("n"))) - F.col("p") - 1e-6)
    posted = cut(each.where(F.col("missing") | (F.col("x") - F.col("place") + 1 >= F.greatest("need", least))).drop("common", "smallest", "need", "at"))
    sizes = posted.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    return posted.join(sizes.where("low < high").drop("low", "high"), key)


def _frequent(rows: DataFrame) -> DataFrame:
    """(g, often): differences that several of the looked-at nodes of a group have, the most frequent last, at most ``OFTEN``."""
    some = rows.where(F.pmod(F.xxhash64("b"), F.lit(ONE_IN)) == 0).select("g", F.explode("extra").alias("term"))
    counts = some.groupBy("g", "term").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    nth = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("times"), "term"))
    most = counts.withColumn("nth", nth).where(F.col("nth") <= OFTEN)
    return most.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("times", "term")))["term"].alias("often"))


def _posted_links(posted: DataFrame, rows: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among nodes that are posted under one difference, exactly: both sets' differences from the leader give their overlap."""
    sides = [
        posted.select("g", "missing", "term", F.col("b").alias(s), F.col("n").alias(f"n_{s}"), F.col("p").alias(f"p_{s}"), F.col("reach").alias(f"reach_{s}"), F.col("label").alias(f"label_{s}"), (F.col("x") - F.col("place") + 1).alias(f"left_{s}"))
        for s in ("x", "y")
    ]
    sized = 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")
    # A pair is made by the first shingle that it shares, from which on it must share enough.
    enough = F.least("left_x", "left_y") >= F.lit(percent / (100.0 + percent)) * (F.col("n_x") + F.col("n_y")) - F.least("p_x", "p_y") - 1e-6
    reached = (F.col("n_x") <= F.col("reach_y")) & (F.col("n_y") <= F.col("reach_x"))
    allowed = F.when(F.col("missing"), reached).otherwise(enough)
    pairs = sides[0].join(sides[1], ["g", "missing", "term"]).where((F.col("x") < F.col("y")) & (F.col("label_x") != F.col("label_y")) & sized & allowed)
    pairs = pairs.select("g", "x", "y").distinct()

    def differences(s: str) -> DataFrame:
        return rows.select("g", "a", F.col("b").alias(s), F.col("n").alias(f"n_{s}"), F.col("p").alias(f"p_{s}"), F.col("extra").alias(f"extra_{s}"), F.col("missing").alias(f"missing_{s}"))

    both = pairs.join(differences("x"), ["g", "x"]).join(differences("y").drop("a"), ["g", "y"])
    leader = F.col("p_x") + F.size("missing_x")
    overlap = F.col("p_x") + F.col("p_y") - leader + F.size(F.array_intersect("missing_x", "missing_y")) + F.size(F.array_intersect("extra_x", "extra_y"))
    linked = (100 * overlap >= percent * (F.col("n_x") + F.col("n_y") - overlap)) & (overlap > 0)
    return both.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
