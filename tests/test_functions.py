"""Golden pairs of the scalar functions, and small sequential models of ranks and sequences."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from splitboard.functions import text, times
from splitboard.operators import fuzzy, rank, report, resolve, score, state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


LOOKUP = {
    "Şahin": "sahin", "İSMAİL": "ismail", "Kılıç": "kilic", "Hâki": "haki", "Ankara SK": "ankara spor kulubu", "Ankara S.K.": "ankara spor kulubu",
    "Ankara Spor Kul.": "ankara spor kulubu", "Ankara BB": "ankara buyuksehir belediyesi", "Ankara Bel. SK": "ankara belediyesi spor kulubu",
    "İstanbul YK": "istanbul yuzme kulubu", "BÜYÜK ŞEHİR BEL.": "buyuk sehir belediyesi", "Kültür Kulubo": "kultur kulubu", "1.5 a": "1.5 a", "": "",
}


@pytest.mark.parametrize("raw,want", LOOKUP.items())
def test_normalize_for_lookup(spark, raw, want):
    assert one(spark, text.normalize_for_lookup(F.lit(raw))) == want


@pytest.mark.parametrize(
    "column,want",
    [
        (lambda: text.normalize_for_lookup(F.lit(None).cast("string")), ""),
        (lambda: text.names_match(F.lit("AHMET ÇELİK"), F.lit("ahmet celik")), True),
        (lambda: text.names_match(F.lit("Ahmet"), F.lit("Mehmet")), False),
        (lambda: text.names_match(F.lit("Ankara SK"), F.lit("Ankara Spor Kulübü")), True),
        (lambda: text.normalize_display(F.lit("AHMET  ÇELİK")), "Ahmet Çelik"),
        (lambda: text.restore_display(F.lit("!lsmail_CELIK, ATA"), {"ismail": "İsmail", "celik": "Çelik"}), "İsmail Çelik Ata"),
        (lambda: text.restore_club(F.lit("(ankara celik"), {"celik": "Çelik"}), "(Ankara Çelik"),
        (lambda: text.surname(F.lit("Ata Çelik")), "celik"),
        (lambda: text.nospace(F.lit("Ata Çelik")), "atacelik"),
        (lambda: text.parse_gender(F.lit("13 Yaş Kızlar")), "F"),
        (lambda: text.parse_gender(F.lit("Erkekler")), "M"),
        (lambda: text.parse_stroke(F.lit("200m KURBAĞALAMA")), "Kurbağalama"),
        (lambda: text.parse_distance(F.lit("Yarış 10, 1500m Serbest")), 1500),
        (lambda: text.parse_distance(F.lit("Yarış 100, Erkekler, 50m Serbest")), 50),
        (lambda: text.parse_distance(F.lit("Yarış 50, Kızlar, 200m Serbest")), 200),
        (lambda: text.parse_distance(F.lit("500m")), None),
        (lambda: text.parse_distance(F.lit("1000 m")), None),
        (lambda: text.normalize_for_lookup(F.lit("Kovač Žilina Ālija ﬁn Ｘ Ắ ǆ")), "kovac zilina alija fin x a dz"),
        (lambda: text.clean_punctuation(F.lit("S.K. a.b 1.5 x. y .z (q)-r_s 3. a..b")), "SK ab 1.5 x y z q r s 3. a b"),
        (lambda: text.parse_gender(F.lit("Ali Kızıltan")), "M"),
        (lambda: text.is_relay(F.lit("4 x 100m Serbest")), True),
        (lambda: text.label(F.lit("TR"), {"TR": "Türkiye"}), "Türkiye"),
        (lambda: text.label(F.lit("?"), {"TR": "Türkiye"}), "?"),
        (lambda: text.is_fused_name(F.lit("AtaCelikler")), True),
        (lambda: text.has_letter_prefix(F.lit("A Ata")), True),
        (lambda: text.has_edge_punctuation(F.lit("-Ata")), True),
        (lambda: text.token_sort_ratio(F.lit("Çelik Ata"), F.lit("ata celik")), 100.0),
        (lambda: text.strip_diacritics(F.lit("Άδης ᾳ Йогурт ё Ąé")), "Αδης α Иогурт е Ae"),
        (lambda: text.club_match(F.lit("Ankara SK"), F.lit("Ankara Yüzme Kulübü")), True),
        (lambda: text.club_match(F.lit("Ankara SK"), F.lit("Bursa SK")), False),
        (lambda: times.parse_time(F.lit("29.86")), 2986),
        (lambda: times.parse_time(F.lit("1:03.42")), 6342),
        (lambda: times.parse_time(F.lit("21:21,66")), 128166),
        (lambda: times.parse_time(F.lit("01:00:00.50")), 360050),
        (lambda: times.parse_time(F.lit("DNS")), None),
        (lambda: times.lenex_time(F.lit("00:00:00.00")), None),
        (lambda: times.display_time(F.lit(6342)), "1:03.42"),
        (lambda: times.display_time(F.lit(2986)), "29.86"),
        (lambda: times.display_time(F.lit(6005)), "1:00.05"),
        (lambda: times.birth_year(F.lit(13)), 2013),
        (lambda: times.birth_year(F.lit(0)), 2000),
        (lambda: times.birth_year(F.lit(27)), 1927),
        (lambda: times.birth_year(F.lit("99")), 1999),
        (lambda: times.birth_year(F.lit("abc")), None),
        (lambda: times.age(F.lit(2013)), 13),
        (lambda: times.parse_birthdate(F.lit("2013-05-15")), 2013),
        (lambda: times.parse_birthdate(F.lit("hatalı")), None),
        (lambda: times.plausible_year(F.lit(1962)), 2012),
        (lambda: times.plausible_year(F.lit(2025)), None),
        (lambda: times.race_date(F.lit("3 - 5 / 4 / 2026")), "2026.04.03"),
        (lambda: times.race_date(F.lit("2026-01-02T10:00")), "2026.01.02"),
        (lambda: times.fix_ocr_time(F.lit(342), F.lit("03.42"), F.lit(5000)), 6342),
        (lambda: times.fix_ocr_time(F.lit(5342), F.lit("53.42"), F.lit(5000)), 5342),
        (lambda: score.threshold_points(F.lit(100), [(1, 200), (9, 100)]), 9),
        (lambda: score.threshold_points(F.lit(101), [(1, 200), (9, 100)]), 1),
        (lambda: score.threshold_points(F.lit(201), [(1, 200), (9, 100)]), 0),
    ],
)
def test_scalar(spark, column, want):
    assert one(spark, column()) == want


def test_sequences_against_a_greedy_model(spark):
    rng = random.Random(3)
    rows = [(a, f"e{e}", e < 3, rng.randint(1, 9)) for a in range(120) for e in range(8) if rng.random() < 0.4]
    df = spark.createDataFrame(rows, "athlete int, event string, short boolean, points long")
    got = {r.athlete: r.seq for r in score.sequences(df, ["athlete"], "points", F.col("short")).collect()}
    for a in got:
        left = [(p, not s) for x, _, s, p in rows if x == a]
        want, used = [], False
        for p, free in sorted(left, reverse=True):
            if free or not used:
                want.append(p)
                used = used or not free
        if not used:
            want.append(0)
        assert got[a] == sorted(want, reverse=True)


def test_quota_against_a_sequential_model(spark):
    rng = random.Random(4)
    rows = [(g, i, *[rng.randint(0, 2)] * 1, 0, 0, 0) for g in range(12) for i in range(rng.randint(0, 15))]
    df = spark.createDataFrame(rows, "g int, name int, k3 int, k4 int, k5 int, k6 int")
    for quota in (0, 1, 4, 20):
        got = {(r.g, r.name): (r.chosen, r.tied, r.slot) for r in rank.quota_with_ties(df, ["g"], F.lit(quota), "name").collect()}
        for g in range(12):
            own = sorted((-k, n) for x, n, k, *_ in rows if x == g)
            edge = own[quota - 1][0] if 0 < quota <= len(own) else None
            taken = [x for i, x in enumerate(own) if i < quota or x[0] == edge]
            for i, x in enumerate(own):
                chosen = x in taken
                peers = [j for j, y in enumerate(own) if y[0] == x[0]]
                assert got[g, x[1]] == (chosen, chosen and max(peers) >= quota, i + 1 if chosen else None)


def test_upsert_keeps_the_older_row_on_ties_and_ignores_null(spark):
    old = spark.createDataFrame([(1, 100, 1), (2, None, 2), (3, 50, 3)], "k int, t int, n int")
    new = spark.createDataFrame([(1, 100, 4), (2, 70, 5), (3, None, 6), (4, 10, 7)], "k int, t int, n int")
    got = {(r.k, r.t, r.n) for r in state.upsert_min(old, new, ["k"], "t", "n").collect()}
    assert got == {(1, 100, 1), (2, 70, 5), (3, 50, 3), (4, 10, 7)}
    assert {tuple(r) for r in state.upsert_min(state.upsert_min(old, new, ["k"], "t", "n"), new, ["k"], "t", "n").collect()} == got


def test_donor(spark):
    rows = [("a", "e", "ATACELIK", 10, 1, "c1"), ("a", "e", "Ata Çelik", 12, 2, "c2"), ("b", "f", "VELIKAYA", 9, 3, "c3"), ("b", "g", "Veli Can Kaya", 9, 4, "c4")]
    df = spark.createDataFrame(rows, "k string, e string, name string, t int, n int, club string")
    got = {(r.k, r.e): (r.name, r.club, r.t) for r in resolve.donor_names(df, ["k"], ["e"], "name", "t", "n", ["club"]).collect()}
    assert got == {("a", "e"): ("Ata Çelik", "c2", 10), ("b", "f"): ("Veli Can Kaya", "c4", 9), ("b", "g"): ("Veli Can Kaya", "c4", 9)}


def test_pending_without_gender(spark):
    results = spark.createDataFrame([("e1", "F", "p", 1), ("e2", "F", "q", 2)], "event string, gender string, person string, seq int")
    starts = spark.createDataFrame([("e1", "F", "x"), ("e1", "", "y"), ("e2", "F", "q"), ("e2", "F", "r"), ("e3", "M", "s")], "event string, gender string, person string")
    assert {r.person for r in state.pending(starts, results, ["event"], "gender", ["person"], "seq").collect()} == {"r", "s"}


def test_rank_checks(spark):
    rows = [("g", 1, 9, 9, 9, 9), ("g", 2, 5, 5, 5, 5), ("g", 3, 7, 7, 7, 7)]
    df = spark.createDataFrame(rows, "g string, place int, k3 int, k4 int, k5 int, k6 int")
    assert [r.place for r in rank.violations(df, ["g"]).collect()] == [3]


def test_carry_forward_seed(spark):
    df = spark.createDataFrame([("d", 1, None), ("d", 2, "h"), ("d", 3, None)], "doc string, n int, h string")
    out = report.carry_forward(df, ["doc"], ["n"], F.col("h"), "x", F.lit("seed"))
    assert [r.x for r in out.orderBy("n").collect()] == ["seed", "h", "h"]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_similar_names(spark):
    """All three passes against comparing all pairs in order of arrival."""
    rng = random.Random(4)
    names = ["ada civvelek", "ada civelek", "melek caliskan", "melekcaliskan", "mel ekcaliskan", "danil yabanci", "danl yabanci", "x", "ab", "", "a b", "kaya"]
    names += [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(i, rng.choice(names), rng.choice("PQRSTUVW"), f"club{i}") for i in range(150)]
    first, last, groups, events = {}, {}, {}, {}
    want, done = [], set()
    for i, n, e, c in rows:
        ns, sn = n.replace(" ", ""), n.split(" ")[-1]
        events.setdefault(ns, set()).add(e)
        if sn:
            groups.setdefault(sn, [])
            if ns not in groups[sn]:
                groups[sn].append(ns)
            first.setdefault((sn, ns), (n, c))
            last[sn, ns] = (n, c)

    def add(a, b, r1, r2, edits, shared):
        if frozenset((a, b)) not in done:
            done.add(frozenset((a, b)))
            want.append((r1[0], r2[0], edits, tuple(sorted(shared)), not shared, r1[1], r2[1]))

    for sn, own in groups.items():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if _edits(a, b) <= 3:
                    add(a, b, first[sn, a], first[sn, b], _edits(a, b), events[a] & events[b])
    whole = {}
    for _, n, _, c in rows:
        one = whole.setdefault(n.replace(" ", ""), (n, c))
        if one[0] != n:
            add(n.replace(" ", ""), n.replace(" ", "") + "_dup", one, (n, c), 0, set())
    order = list(groups)
    for i, s in enumerate(order):
        for t in order[i + 1 :]:
            if _edits(s, t) <= 2:
                for a in groups[s]:
                    for b in groups[t]:
                        if a != b and _edits(a, b) <= 3:
                            add(a, b, last[s, a], last[t, b], _edits(a, b), events[a] & events[b])
    df = spark.createDataFrame(rows, "i long, name string, event string, club string")
    got = resolve.similar_names(df, "name", F.col("name"), "i", ["event"], ["club"]).collect()
    assert sorted((r.name1, r.name2, r.edits, tuple(e.event for e in r.shared_events), r.likely_same, r.club1, r.club2) for r in got) == sorted(want)
    assert {w[2] for w in want} == {0, 1, 2, 3}


def test_abbreviation_report(spark):
    rows = [(1, "R. Kara", "A", 2010), (2, "Rafet Kara", "B", 2010), (3, "Rana  KARA", "C", None), (4, "R. Kara", "D", None), (5, "Ali Kara", "E", 2010), (6, "R. Kaya", "F", None), (7, "Rıza Kaya", "G", None), (8, "R.", "H", 1)]
    df = spark.createDataFrame(rows, "i long, name string, club string, year int")
    got = {tuple(r) for r in resolve.abbreviation_report(df, "name", "name", text.normalize_for_lookup, "club", "year", "i").collect()}
    assert got == {("R. Kara", "Rafet Kara", "A", "B", True), ("R. Kara", "Rana  KARA", "A", "C", False), ("R. Kaya", "Rıza Kaya", "F", "G", True)}


def test_token_sort_ratio(spark):
    """The indel ratio against the table of common subsequences, and the reference's cutoff."""
    rng = random.Random(8)
    pairs = [("abcd", "abcde"), ("", "abc"), ("", "")] + [tuple("".join(rng.choice("def") for _ in range(rng.randint(0, 80))) for _ in "xy") for _ in range(40)]

    def want(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return 200 * row[-1] / (len(a) + len(b)) if a or b else 0.0

    both = spark.createDataFrame(pairs, "a string, b string")
    assert all(abs(r.r - want(r.a, r.b)) < 1e-9 for r in both.select("a", "b", text.token_sort_ratio(F.col("a"), F.col("b")).alias("r")).collect())
    df = spark.createDataFrame([(1, "x", "ada civlek"), (2, "x", "mehmet oz")], "i long, block string, seen string")
    names = spark.createDataFrame([("x", "civelek ada"), ("x", "ali kaya")], "block string, known string")
    got = fuzzy.best_indel(df, names, ["block"], "seen", "known", 82.0).collect()
    assert [(r.i, r.known, round(r.similarity, 4)) for r in got] == [(1, "civelek ada", round(200 * 10 / 21, 4))]
    one = spark.createDataFrame([("abcd", "abcde")], "a string, b string").select(text.token_sort_ratio(F.col("a"), F.col("b"))).first()[0]
    assert abs(one - 88.8889) < 0.001
