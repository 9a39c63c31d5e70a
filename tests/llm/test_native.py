"""Exact dedup, mixing, sharding and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import xxhash

from splitboard.llm import exact_dedup, oracle, queries
from splitboard.llm.common import cut
from splitboard.llm.exact_dedup import content_sort
from splitboard.llm.fingerprint import fingerprints, successor_fingerprints
from splitboard.llm.mixing import mix_sources
from splitboard.llm.sharding import shard_records


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = queries.ALL[name](spark, sf)
    want = con.sql(oracle.ORACLES[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.select(*cols).collect()), key=key) == sorted(want.select(*cols).fetchall(), key=key)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_content_sort(odd, empty, keep):
    rows = content_sort(odd, keep=keep).collect()
    assert len(rows) == odd.count()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    pick = min if keep == "min" else max
    for r in rows:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (pick(known) if known else None, len(ids))
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert kept == Counter(list(groups))
    assert content_sort(empty).count() == 0


def test_content_sort_normalised(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    rows = {r.doc_id: r for r in content_sort(df, normalise=F.lower("text")).collect()}
    assert [rows[i].keep_id for i in (1, 2, 3)] == [1, 1, 3] and [rows[i].kept for i in (1, 2, 3)] == [True, False, True]


def test_copies_are_decided_by_neighbours(spark, monkeypatch):
    """At 64 partitions every group of copies is one run of the sort; only a very frequent text is dealt over several."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tables = []
    monkeypatch.setattr(exact_dedup, "cut", lambda df: tables.append(cut(df)) or tables[-1])
    for frequent, bound in ((0, 0), (400, 1)):
        extra = spark.range(frequent).selectExpr("id + 1000000 as doc_id", "'one and the same' as text")
        df = docs.select("doc_id", "text").unionAll(extra)
        groups = Counter(r.text or "" for r in df.collect())
        rows = content_sort(df, partitions=64).collect()
        runs = Counter(r.digest for r in tables[-1].where("place = 1").collect())
        assert len(runs) == len(groups) and sum(n > 1 for n in runs.values()) == bound
        assert {r.text_sha256: r.group_size for r in rows} == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in groups.items()}
        assert sum(r.kept for r in rows) == len(groups)


def test_mixing(odd, empty):
    rows = mix_sources(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    order = sorted((s for s in by if s is not None)) + [s for s in by if s is None]
    sizes = {s: sum(r.size for r in by[s]) for s in by}
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    # Reshare until none is above its stop.
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    for s in order:
        want = fixed.get(s, level * weight[s])
        assert by[s][0].target == pytest.approx(want)
        taken = sum(r.taken for r in by[s])
        # The document that the budget ends in, with the rows that share its identifier, is taken or left whole.
        groups = Counter()
        for r in by[s]:
            groups[r.doc_id] += r.size
        assert abs(taken - want) <= max(groups.values(), default=0) / 2 + 1e-6
        assert all(r.taken <= 3 * r.size for r in by[s])
    again = mix_sources(odd).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mix_sources(empty).count() == 0


def test_mixing_salted(odd, monkeypatch):
    want = sorted(map(str, mix_sources(odd).collect()))
    monkeypatch.setattr("splitboard.llm.mixing.BROADCAST_ROWS", 0)
    assert sorted(map(str, mix_sources(odd).collect())) == want


def test_sharding(spark, odd, empty, sf):
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = shard_records(df).collect()
        assert len(rows) == df.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        want = sorted((r.doc_id or -1, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == want
    assert shard_records(empty).count() == 0


def test_sharding_winner(spark):
    """The winning shard, computed apart; a run with nine shards is what was said of growing."""

    def winner(doc: int, shards: int) -> int:
        costs = []
        for k in range(shards):
            first = xxhash.xxh64(doc.to_bytes(8, "little", signed=True), 42).intdigest()
            u = ((xxhash.xxh64(f"shard:{k}", first).intdigest() >> 12) + 0.5) / (1 << 52)
            costs.append((-math.log(u), k))
        return min(costs)[1]

    df = spark.range(-500, 3000).selectExpr("id as doc_id", "'x' as text")
    rows = {r.doc_id: (r.shard, r.grown_shard) for r in shard_records(df).collect()}
    assert rows == {d: (winner(d, 8), winner(d, 9)) for d in range(-500, 3000)}
    assert {r.doc_id: r.shard for r in shard_records(df, weights=(1.0,) * 9).collect()} == {d: g for d, (_, g) in rows.items()}


def test_sharding_weights(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    rows = shard_records(df, weights=(1.0, 3.0, 0.0)).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20_000 for r in rows}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.02
    # A larger weight only draws rows to its own shard.
    moved = shard_records(df, weights=(1.0, 1.0, 1.0), grown=(1.0, 2.0, 1.0)).where("shard <> grown_shard").collect()
    assert moved and all(r.grown_shard == 1 for r in moved)


def _jaccard(a: str, b: str) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    rows = {r.doc_id: r for r in successor_fingerprints(docs).collect()}
    assert len(rows) == len(texts)
    own = {r.doc_id: r.fingerprint for r in fingerprints(docs).collect()}
    off = []
    for i, (doc, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = rows[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == own[doc]
        off.append((r.near_edited - _jaccard(text, edited), r.near_next - _jaccard(text, after)))
    # Unbiased: the mean of many estimates is close, and each is within five deviations of 32 samples.
    assert all(abs(sum(x) / len(off)) < 0.02 for x in zip(*off))
    assert all(abs(x) < 0.45 for pair in off for x in pair)


def test_fingerprints_odd(odd, empty):
    rows = successor_fingerprints(odd).collect()
    assert len(rows) == odd.count() == len(fingerprints(odd).collect())
    by = defaultdict(set)
    for r in rows:
        by[r.n_chars, r.fingerprint].add(r.doc_id)
    assert any(ids >= {3, 4, None} for ids in by.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert successor_fingerprints(empty).count() == 0 and fingerprints(empty).count() == 0
