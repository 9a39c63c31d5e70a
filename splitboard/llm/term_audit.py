"""Source divergence audit with mergeable radix tries.

Every partition counts its terms in byte tries, one for each language, whose leaves
have a counter for each source. The leaves are dealt by ranges of (language, term),
so each task has whole subtrees, and it merges the tries that it gets. A trie that
reaches a bound is emitted and begun anew, as merging is a sum. A traversal in byte
order, which is the order of UTF-8, then gives the kept terms' cells (one for each
source that has the term): sources that share a term add to their pair's sum, and
each group's best terms are held in a list of fixed length.

A pair's sum over all kept terms is taken apart, with 0 for a term that a group
lacks: f(p, q) = f(0, 0) + [f(p, 0) - f(0, 0)] + [f(0, q) - f(0, 0)] + rest. The
first three come from counts of counts; only the rest, which is nothing unless both
have the term, is summed over terms.
"""

from __future__ import annotations

import gc
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship

#: Counters that a partition gathers before they go into tries and out, and that merged tries have before they are emitted.
BUFFERED, HELD = 900_000, 600_000
#: Cells that a traversal takes together, pairs of cells that are computed together, and sums of pairs that are held.
CELLS, PAIRS, SUMS = 20_000, 2_000_000, 200_000
#: What each byte counts as: separators are blanks, A-Z are lower-cased. Bytes from 0x80 on belong to terms.
AS_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000

LEAVES = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
LEAVES_DDL = "lang string, term binary, docs long, sources array<string>, counts array<long>"
FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.binary()), ("value", pa.decimal128(38))])
FOUND_DDL = "part string, lang string, source string, item binary, value decimal(38,0)"


class Node:
    __slots__ = ("label", "below", "docs", "counts")

    def __init__(self, label: bytes):
        self.label, self.below, self.docs, self.counts = label, None, 0, None


class RadixTrie:
    """Terms as paths of byte strings. A term's node has its documents and a count for each source."""

    def __init__(self):
        self.root = Node(b"")

    def leaf(self, term: bytes) -> Node:
        """The term's node, made if there is none."""
        node, at = self.root, 0
        while at < len(term):
            below = node.below
            if below is None:
                below = node.below = {}
            edge = below.get(term[at])
            if edge is None:
                edge = below[term[at]] = Node(term[at:])
                node = edge
                break
            label = edge.label
            if not term.startswith(label, at):
                # The edge ends where the two part; what is left of it hangs below.
                shared = 1
                while at + shared < len(term) and term[at + shared] == label[shared]:
                    shared += 1
                upper = below[term[at]] = Node(label[:shared])
                edge.label = label[shared:]
                upper.below = {edge.label[0]: edge}
                edge = upper
            at += len(edge.label)
            node = edge
        if node.counts is None:
            node.counts = {}
        return node

    def leaves(self) -> Iterator[tuple[bytes, Node]]:
        """All terms in the order of their bytes."""
        stack = [(b"", self.root)]
        while stack:
            above, node = stack.pop()
            term = above + node.label
            if node.counts is not None:
                yield term, node
            if node.below:
                stack += [(term, node.below[b]) for b in sorted(node.below, reverse=True)]


class Tries:
    """One trie for each language, and how many counters they have."""

    def __init__(self):
        self.by_lang: dict[str, RadixTrie] = defaultdict(RadixTrie)
        self.held = 0

    def emit(self, least_docs: int = 0) -> Iterator[pa.RecordBatch]:
        """The leaves, by language and byte order; afterwards there are none."""
        for lang in sorted(self.by_lang):
            terms, docs, sources, counts, ends = [], [], [], [], [0]
            for term, node in self.by_lang[lang].leaves():
                if node.docs < least_docs:
                    continue
                terms.append(term)
                docs.append(node.docs)
                sources += node.counts
                counts += node.counts.values()
                ends.append(len(counts))
                if len(terms) >= CELLS:
                    yield _leaves(lang, terms, docs, sources, counts, ends)
                    terms, docs, sources, counts, ends = [], [], [], [], [0]
            if terms:
                yield _leaves(lang, terms, docs, sources, counts, ends)
        self.__init__()


def _leaves(lang: str, terms: list, docs: list, sources: list, counts: list, ends: list) -> pa.RecordBatch:
    """Leaves of one language; their sources and counts are laid end to end."""
    ends = pa.array(ends, pa.int32())
    lists = (pa.ListArray.from_arrays(ends, pa.array(flat, kind)) for flat, kind in ((sources, pa.string()), (counts, pa.int64())))
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array(docs, pa.int64()), *lists], schema=LEAVES)


@contextmanager
def _without_cycles() -> Iterator[None]:
    """Tries have no cycles; looking for some takes as long as building them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _values(column: pa.Array) -> list:
    """Python values of a flat column without nulls."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def count_terms():
    """Tries of a partition of (lang, source, text), as leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        seen: dict[str, Counter] = defaultdict(Counter)

        def grown() -> Iterator[pa.RecordBatch]:
            tries = Tries()
            with _without_cycles():
                for lang, docs in seen.items():
                    trie, own = tries.by_lang[lang], {}
                    # In order, a term's path was just walked by the one before.
                    for term in sorted(docs):
                        own[term] = node = trie.leaf(term)
                        node.docs = docs[term]
                    for of, source in list(counts):
                        if of == lang:
                            for term, n in counts.pop((of, source)).items():
                                own[term].counts[source] = n
                seen.clear()
                yield from tries.emit()

        for batch in batches:
            for lang, source, text in zip(*(_values(batch.column(c)) for c in ("lang", "source")), batch.column("text").cast(pa.binary())):
                terms = text.as_py().translate(AS_TERM).split()
                counts[lang, source].update(terms)
                seen[lang].update(set(terms))
            if sum(map(len, counts.values())) >= BUFFERED:
                yield from grown()
        yield from grown()

    return run


def merge_tries(least_docs: int):
    """Merge the tries of a range, sorted by (lang, term); only terms of enough documents stay."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, last, node = Tries(), (None, b""), None
        with _without_cycles():
            for batch in batches:
                lang, term, docs, sources, counts = batch.columns
                ends, documents = sources.offsets.to_numpy(), _values(docs)
                ends = (ends - ends[0]).tolist()
                sources, counts = _values(sources.flatten()), _values(counts.flatten())
                for row, own in enumerate(zip(_values(lang), _values(term))):
                    if own != last:
                        # A term's leaves are neighbours, so the tries are whole here.
                        if tries.held >= HELD:
                            yield from tries.emit(least_docs)
                        last, node = own, tries.by_lang[own[0]].leaf(own[1])
                        tries.held += 1
                    node.docs += documents[row]
                    held = node.counts
                    for i in range(ends[row], ends[row + 1]):
                        source = sources[i]
                        if source in held:
                            held[source] += counts[i]
                        else:
                            held[source] = counts[i]
                            tries.held += 1
            yield from tries.emit(least_docs)

    return merge


def divergence(p, q):
    return (p - q) * (p - q) // q


def traverse(top: int):
    """Pairs' sums and groups' best terms of a range of cells, sorted by (lang, term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, int] = defaultdict(int)
        best: dict[tuple, list] = defaultdict(list)

        def visit(table: pa.Table) -> None:
            lang, term, source = (table.column(c).to_numpy().tolist() for c in ("lang", "term", "source"))
            p, zero, whole = (table.column(c).to_numpy() for c in ("p", "zero", "whole"))
            known: dict[tuple, int] = {}
            group = np.array([known.setdefault(g, len(known)) for g in zip(lang, source)])
            names = list(known)
            gain = np.flatnonzero(p > whole)
            value = divergence(p[gain], whole[gain])
            # Cells are in the order of terms, so a stable sort keeps ties in that order.
            order = np.lexsort((-value, group[gain]))
            ends = np.flatnonzero(np.diff(group[gain][order], append=-1)) + 1
            for begin, end in zip([0, *ends[:-1]], ends):
                rows = order[begin : min(end, begin + top)]
                own = best[names[group[gain[rows[0]]]]]
                own += [(-int(value[r]), term[gain[r]]) for r in rows]
                if len(own) > 4 * top:
                    own[:] = heapq.nsmallest(top, own)
            new = np.array([True] + [lang[i] != lang[i - 1] or term[i] != term[i - 1] for i in range(1, len(term))])
            begins = np.flatnonzero(new)
            leaf = np.cumsum(new) - 1
            width = np.diff(begins, append=len(term))[leaf]
            ahead = np.cumsum(width)
            at = 0
            while at < len(term):
                stop = max(at + 1, int(np.searchsorted(ahead, (ahead[at - 1] if at else 0) + PAIRS, "right")))
                cells = np.arange(at, stop)
                left = np.repeat(cells, width[cells])
                offset = np.arange(len(left)) - np.repeat(np.cumsum(width[cells]) - width[cells], width[cells])
                right = begins[leaf[left]] + offset
                left, right = left[left != right], right[left != right]
                at = stop
                if not len(left):
                    continue
                rest = divergence(p[left], p[right]) - divergence(p[left], zero[right]) - divergence(zero[left], p[right]) + divergence(zero[left], zero[right])
                key = group[left] * len(names) + group[right]
                sort = np.argsort(key, kind="stable")
                firsts = np.flatnonzero(np.diff(key[sort], prepend=-1))
                for k, total in zip(key[sort][firsts].tolist(), np.add.reduceat(rest[sort], firsts).tolist()):
                    (of, a), (_, b) = names[k // len(names)], names[k % len(names)]
                    sums[of, a, b] += total

        def pairs() -> Iterator[pa.RecordBatch]:
            rows = [("pair", *key[:2], key[2].encode(), total) for key, total in sums.items()]
            sums.clear()
            for i in range(0, len(rows), CELLS):
                yield _batch(rows[i : i + CELLS], FOUND)

        for table in whole_terms(batches, CELLS):
            visit(table)
            if len(sums) >= SUMS:
                yield from pairs()
        yield from pairs()
        for (lang, source), own in best.items():
            rows = [("term", lang, source, term, -value) for value, term in heapq.nsmallest(top, own)]
            yield _batch(rows, FOUND)

    return run


def whole_terms(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted cells in tables of some ``rows`` rows, each with all cells of its terms."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(waiting)
        lang, term = table.column("lang"), table.column("term")
        cut = n - 1
        while cut and term[cut - 1] == term[n - 1] and lang[cut - 1] == lang[n - 1]:
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        waiting, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(waiting)


def share(count: Column, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + v)), exact for any count."""
    return F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE), F.col(total) + F.col("v")) + 1


def _f(p: str, q: str) -> Column:
    gap = F.col(p) - F.col(q)
    return F.call_function("div", gap * gap, F.col(q)).cast("decimal(20,0)")


def audit_sources(docs: DataFrame, least_docs: int = 3, top: int = 200, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """How sources of a language differ: (lang, source, part, item, value, rank).

    Part ``pair`` has each other source of the language with the sum over all kept
    terms, part ``term`` the ``top`` terms that a source has more of than its language.
    A null text, language or source counts as empty, and so joins the empty ones. Each
    row is a document, repeated rows too. Texts are read whole. Equal values are ranked
    by the item's UTF-8. A language without kept terms has pairs of value 0 and no
    terms; a language of one source has no pairs. Other columns are not looked at,
    whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    with Scratch(spark) as scratch:
        leaves = scratch(rows.mapInArrow(count_terms(), LEAVES_DDL))
        ranged = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
        kept = scratch(ranged.mapInArrow(merge_tries(least_docs), LEAVES_DDL))
        in_lang = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
        sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(in_lang).alias("n_lang"))
        cells = kept.select("lang", "term", in_lang.alias("in_lang"), F.explode(F.arrays_zip("sources", "counts")).alias("c"))
        cells = cells.select("lang", "term", "in_lang", F.col("c.sources").alias("source"), F.col("c.counts").alias("count"))
        own = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v", "n_lang"])
        zero = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), "n")).otherwise(1)
        # One row for each group; Spark broadcasts it below only where its written size allows.
        groups = scratch(groups.withColumn("zero", zero))
        cells = cells.join(groups.where("v > 0"), ["lang", "source"]).select(
            "lang", "term", "source", share(F.col("count"), "n").alias("p"), "zero", share(F.col("in_lang"), "n_lang").alias("whole")
        )

        found = scratch(cells.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(traverse(top), FOUND_DDL))
        by_count = cells.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).cast("decimal(18,0)").alias("times"))
        other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("v").cast("decimal(18,0)").alias("v"))

        def paired(left: DataFrame, value: Column, swap: bool = False) -> DataFrame:
            both = left.join(other, "lang").where(F.col("source") != F.col("item"))
            names = ("item", "source") if swap else ("source", "item")
            return both.select("lang", *(F.col(a).alias(b) for a, b in zip(names, ("source", "item"))), value.cast("decimal(38,0)").alias("value"))

        sums = (
            paired(groups.drop("v"), F.col("v") * _f("zero", "other_zero"))
            .unionAll(paired(by_count, F.col("times") * (_f("p", "other_zero") - _f("zero", "other_zero"))))
            .unionAll(paired(by_count, F.col("times") * (_f("other_zero", "p") - _f("other_zero", "zero")), swap=True))
            .unionAll(found.where("part = 'pair'").select("lang", "source", F.col("item").cast("string").alias("item"), "value"))
        )
        pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
        terms = found.where("part = 'term'").withColumn("item", F.col("item").cast("string"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        # At most ``top`` terms of each range come here, and one pair of each source.
        terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        both = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
        return scratch.keep(both.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"))
