"""Similarity joins by signatures against comparing all pairs, and how much they compare."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from splitboard.functions import text
from splitboard.operators import fuzzy, meet, resolve


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def varied(rng, word, alphabet):
    out = list(word)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(out) + 1)
        rng.choice([lambda: out.insert(at, rng.choice(alphabet)), lambda: out and out.pop(at - 1), lambda: out and out.__setitem__(at - 1, rng.choice(alphabet))])()
    return "".join(out)


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_near_pairs(spark, limit):
    rng = random.Random(limit)
    words = ["", "a", "abc"]
    for _ in range(30):
        word = "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 14)))
        words += [word, *(varied(rng, word, "abcdé") for _ in range(5))]
    rows = [(rng.choice("xy"), w) for w in words for _ in range(2)] + [("x", None), (None, "abc")]
    df = spark.createDataFrame(rows, "block string, w string")
    got = [tuple(r) for r in fuzzy.near_pairs(df, "w", limit, ["block"]).collect()]
    own = sorted({r for r in rows if None not in r})
    want = {(s, a, b, edits(a, b)) for s, a in own for t, b in own if s == t and a < b and edits(a, b) <= limit}
    assert len(got) == len(set(got)) and set(got) == want
    whole = sorted({w for _, w in rows if w is not None})
    assert {tuple(r) for r in fuzzy.near_pairs(df, "w", limit).collect()} == {(a, b, edits(a, b)) for a in whole for b in whole if a < b and edits(a, b) <= limit}


def test_one_surname(spark):
    """10,000 names of one surname: 50 million pairs, of which few share a signature, and none of the near ones is lost."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvyz") for _ in range(n))
    names = sorted({word(rng.randrange(9, 17)) for _ in range(10_000)})
    near = [varied(rng, n, "aeiou") for n in names[::400]]
    df = spark.createDataFrame([("yilmaz", n) for n in {*names, *near}], "sn string, given string")
    assert fuzzy.near_candidates(df, "given", 3, ["sn"]).distinct().count() < 2_000_000
    found = {(r.a, r.b) for r in fuzzy.near_pairs(df, "given", 3, ["sn"]).collect()}
    assert all((min(a, b), max(a, b)) in found for a, b in zip(names[::400], near) if a != b and edits(a, b) <= 3)


@pytest.mark.parametrize("cutoff", [60.0, 82.0, 95.0])
def test_best_indel(spark, cutoff):
    rng = random.Random(int(cutoff))
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["", "a", "ab", "a b", "é"]
    seen = [(i, rng.choice("xy"), varied(rng, rng.choice(base), "abcdefgh ")) for i in range(300)]
    known = [(rng.choice("xy"), n) for n in base for _ in range(2)]
    rows, names = spark.createDataFrame(seen, "i long, block string, seen string"), spark.createDataFrame(known, "block string, known string")
    forms = {r.w: r.s for r in rows.select(F.col("seen").alias("w")).unionAll(names.select("known")).distinct().select("w", text.token_sort(F.col("w")).alias("s")).collect()}

    def ratio(a, b):
        a, b = forms[a], forms[b]
        return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 0.0

    want = set()
    for i, block, word in seen:
        best = max(((ratio(word, n), n) for s, n in set(known) if s == block and n != word), default=(0, ""))
        if best[0] >= cutoff:
            want.add((i, best[1], round(best[0], 6)))
    got = fuzzy.best_indel(rows, names, ["block"], "seen", "known", cutoff, F.col("seen") != F.col("known")).collect()
    assert {(r.i, r.known, round(r.similarity, 6)) for r in got} == want and len(got) == len(want)
    a, b = rows.select("block", text.token_sort(F.col("seen")).alias("a")).distinct(), names.select("block", text.token_sort(F.col("known")).alias("b")).distinct()
    if cutoff >= 82:
        assert fuzzy.similar_candidates(a, b, ["block"], cutoff).count() < 0.2 * a.join(b, "block").count()


def test_fuzzy_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), varied(rng, "alexandria", "abc")) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, block string, w string")
    got = [(r.block, r.a, r.text_a, r.b, r.text_b, r.edits) for r in resolve.fuzzy_pairs(df, "block", "w", "i", 3).collect()]
    want = {(s, i, a, j, b, edits(a, b)) for i, s, a in rows for j, t, b in rows if s == t and i < j and edits(a, b) <= 3}
    assert len(got) == len(want) and set(got) == want


def test_recognised_names_and_clubs(spark):
    schema = "name_raw string, name string, birth_year int, gender string, source string, club string, city string, region int, club_found boolean"
    rows = [
        ("Ada Civvelek", "Ada Civvelek", 2012, "F", "ocr", "?", None, None, False), ("Ada Civvelek", "Ada Civvelek", 2012, "F", "pdf", "?", None, None, False),
        ("Ada Civvelek", "Ada Civvelek", 2011, "F", "ocr", "?", None, None, False), ("Ali Kaye", "Ali Kaye", 2012, "M", "ocr", "Own", "X", 1, True),
        ("Ali Zort", "Ali Zort", 2012, "M", "ocr", "?", None, None, False), ("ecetest", "Ece Test", 2012, "F", "ocr", "?", None, None, None),
    ]
    athletes = [("Ada Civelek", 2012, "F", "Enka SK"), ("Ali Kaya", 2012, "M", "Enka SK"), ("Ali Zorta", 2012, "M", "Nowhere"), ("ecetest", 2012, "F", "Enka SK")]
    dims = [spark.createDataFrame(r, "key string, club string, city string, region int, at int") for r in ([("enka spor kulubu", "Enka", "İstanbul", 1, 1)], [("x", "X", "X", 9, 1)])]
    df = spark.createDataFrame(rows, schema)
    known = spark.createDataFrame(athletes, "known_name string, birth_year int, gender string, club string")
    got = sorted((r.name_raw, r.source, r.birth_year, r.club, r.region, r.club_found) for r in meet.correct_recognised(df, known, stored=dims[0], sheet=dims[1]).collect())
    assert got == sorted([
        ("Ada Civelek", "ocr", 2012, "Enka", 1, True), ("Ada Civvelek", "pdf", 2012, "?", None, False), ("Ada Civvelek", "ocr", 2011, "?", None, False),
        ("Ali Kaya", "ocr", 2012, "Own", 1, True), ("Ali Zorta", "ocr", 2012, "?", None, False), ("ecetest", "ocr", 2012, "?", None, None),
    ])


def test_persons(spark):
    """Against union-find: a long chain, a star, links both ways, links to itself."""
    from splitboard.operators import persons

    rng = random.Random(8)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)]
    star = [("hub", f"s{i}") for i in range(200)]
    random_ = [(f"r{rng.randrange(150)}", f"r{rng.randrange(150)}") for _ in range(90)]
    links = [*chain, *star, *random_, ("p", "q"), ("q", "p"), ("z", "z"), (None, "n")]
    rng.shuffle(links)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            low, high = sorted((top(a), top(b)))
            up[high] = low
        else:
            top(b)
    df = spark.createDataFrame(links, "a string, b string")
    assert {r.name: r.person for r in persons.components(df).collect()} == {x: top(x) for x in up}
    rows = spark.createDataFrame([(2, "p"), (1, "q"), (3, "c050"), (4, "c000"), (5, "alone"), (6, None)], "n int, name string")
    got = {r.n: r.canonical for r in persons.one_spelling(rows, df, "name", "n").collect()}
    assert got == {1: "q", 2: "q", 3: "c050", 4: "c050", 5: "alone", 6: None}
