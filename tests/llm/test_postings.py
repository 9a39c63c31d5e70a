"""Differences of a large group from its leader: what leaves a node, and in which order."""

from __future__ import annotations

import random

import pytest
from test_models import _exact

from splitboard.llm import minhash
from splitboard.llm.minhash import near_duplicates

ROWS = "g long, b long, n long, p long, label long, lead_label long, extra array<long>, missing array<long>, centre long"


def _each(spark, rows):
    kept = []
    minhash._postings(spark.createDataFrame(rows, ROWS), 80, lambda df: kept.append(df) or df)
    return kept[0].where("NOT missing")


def test_a_large_group_posts_only_what_a_link_needs(spark):
    """300 texts share a passage of 60 shingles and have 40 others: two that are linked share 29 of these, so 12 are posted, no frequent one among them."""
    common = [-5, 7]
    rows = [(1, b, 100, 60, b, 0, sorted([*common, *(b * 1000 + i for i in range(38))]), [], 7) for b in range(1, 301)]
    each = _each(spark, rows)
    assert {tuple(r) for r in each.groupBy("b").count().collect()} == {(b, 12) for b in range(1, 301)}
    assert each.where("term IN (-5, 7)").isEmpty()
    assert {r.at for r in each.select("at").distinct().collect()} == set(range(1, 13))


def test_frequent_differences_have_one_order(spark, monkeypatch):
    """Every node that has them posts them in the same order, the rarer first."""
    monkeypatch.setattr(minhash, "COUNTED", 2)
    monkeypatch.setattr(minhash, "ONE_IN", 1)
    rows = [(1, b, 43, 40, b, 0, [t for t, every in ((1, 1), (2, 2), (3, 3)) if b % every == 0] + [b * 1000], [], 7) for b in range(1, 61)]
    got = {r.b: [] for r in _each(spark, rows).select("b").distinct().collect()}
    for r in _each(spark, rows).orderBy("at").collect():
        got[r.b].append(r.term)
    want = {b: [b * 1000] + [t for t in (3, 2, 1) if b % t == 0] for b in got}
    assert len(got) == 60 and got == want


@pytest.mark.parametrize(("posted", "one_in", "often"), [(8192, 8, 512), (8192, 1, 3), (4, 2, 512)])
def test_large_groups_lose_no_link(spark, monkeypatch, posted, one_in, often):
    """Edited copies with edits in common, and texts around one passage, some of them copied in part."""
    for name, value in (("SMALL", 2), ("COUNTED", 2), ("POSTED", posted), ("ONE_IN", one_in), ("OFTEN", often)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(17)
    base, passage, rows = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(40)], []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(words))
            words[at] = f"x{at}" if rng.random() < 0.5 else f"y{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    for i in range(75):
        rest = [f"r{rng.randrange(3)}_{j}" if rng.random() < 0.3 else f"q{i}_{j}" for j in range(rng.randint(20, 60))]
        rows.append((1000 + i, " ".join([*passage, *rest])))
        edited = [w if rng.random() > 0.06 else f"z{rng.randrange(10_000)}" for w in rest]
        rows.append((2000 + i, " ".join([*passage, *edited])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=2).collect()}
    assert got == _exact(rows, 2, 80)
