"""Toxicity and quality by held-out accuracy, BPE and near duplicates against exact references."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from splitboard.llm import common, minhash, queries
from splitboard.llm.bpe import Bpe, encode_documents
from splitboard.llm.common import table
from splitboard.llm.minhash import near_duplicates
from splitboard.llm.quality import Terms, quality
from splitboard.llm.quality import fit as fit_quality
from splitboard.llm.toxicity import DOUBLING, RUN, fit, toxicity, windows

MID = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _held_out(spark, rows, label, modulus, fold):
    truth = {r.doc_id: r[label] for r in table(spark, MID, "labels").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == fold)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    return [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


def test_toxicity_held_out(spark):
    rows = queries.op1_toxicity(spark, MID).collect()
    seen = _held_out(spark, rows, "toxic", 4, 2)
    assert len(rows) == 1000
    caught = [p for _, p, y in seen if y == 1]
    clean = [p for _, p, y in seen if y == 0]
    assert sum(caught) / len(caught) > 0.5 and sum(clean) / len(clean) < 0.1


def test_toxic_passage_in_a_long_text():
    """A passage counts by itself, wherever it stands; the document's ordinary windows dilute it little."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    plain = [" ".join(word() for _ in range(150)) for _ in range(200)]
    toxic = [" ".join("scoundrelly" if i % every == 5 else word() for i in range(150)) for every in [12, 24] * 100]
    model = fit([(t, 0) for t in plain] + [(t, 1) for t in toxic])
    long = [word() for _ in range(18_000)]
    assert model.score(" ".join(long)) < 0.3
    for at in (0, 9_000, 18_000):
        assert model.score(" ".join([*long[:at], *toxic[0].split(), *long[at:]])) >= 0.3


def test_quality_held_out(spark):
    rows = queries.op8_quality(spark, MID).collect()
    seen = _held_out(spark, rows, "quality", 5, 0)
    assert len(rows) == 1000 and sum(p == y for _, p, y in seen) / len(seen) > 0.95


def test_windows_hold_the_whole_text():
    for body in (b"", b"x" * 1000, b"ab " * 500, b" " * 300, bytes(range(256)) * 3):
        assert b"".join(windows(body)) == body and all(windows(body))


def test_vote_against_a_sort_of_all_cosines():
    rng = random.Random(2)
    words = [[f"{c}{rng.randrange(60)}" for c in "ab" for _ in range(20)] for _ in range(120)]
    model = fit_quality([(" ".join(w if i % 2 else [x + "!?" for x in w]), i % 2) for i, w in enumerate(words)])
    vectors = model.vectors([" ".join(w[::-1]) for w in words[:30]])
    for vector, got in zip(vectors, model.vote(vectors)):
        near = sorted(((float(vector @ p), float(v)) for p, v in zip(model.points, model.votes)), reverse=True)[:25]
        weights = [max(c, 1e-6) ** 2 for c, _ in near]
        assert abs(got - sum(w * v for w, (_, v) in zip(weights, near)) / sum(weights)) < 1e-4


def test_shape_of_a_long_word():
    """The whole word counts, however long it is."""
    terms = Terms()
    assert terms.of_word("a" * 40 + "9")[1] != terms.of_word("a" * 40)[1] == terms.of_word("b" * 400)[1]
    assert terms.of_word("x" * 100_000 + "Z9")[1] == terms.of_word("xZ9")[1]


def test_saving_against_a_plain_loop():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(" ".join("scoundrelly" if k and i % 9 == 0 else word() for i in range(90)), k) for k in (0, 1) * 60]
    model = fit(rows)
    plain, toxic = model._compressors()
    for text, _ in rows[:20] + [(" ".join(t for t, _ in rows[:30]), 0), ("", 0)]:
        saved = [max(0, len(plain(w)) - len(toxic(w))) for w in windows(text.lower().encode())]
        best = sum(saved) / len(saved) ** 0.5 if saved else 0.0
        length = RUN
        while length < len(saved):
            for i in range(len(saved) - length + 1):
                best = max(best, sum(saved[i : i + length]) / (length**0.5 + DOUBLING * np.log2(len(saved) / length)))
            length *= 2
        assert abs(model.saving(text) - best) < 1e-9


def test_sample_is_bounded_and_chosen_by_rule(spark, monkeypatch):
    """Of several texts under one identifier the least is learned from; a class ends where its bytes do."""
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "d" * 50), (4, "e" * 50), (None, "f"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 0), (4, 0), (None, 1), (5, 1), (9, 1)], "doc_id long, toxic int")
    learn = lambda rows: sorted(rows)
    for df in (docs, docs.orderBy(F.desc("text"))):
        got = common.fitted(df, labels, "toxic", F.lit(True), 10, learn)
        assert got == [("", 1), ("a", 0), ("c", 1), ("d" * 50, 0), ("e" * 50, 0)]
    monkeypatch.setattr(common, "SAMPLE_BYTES", 1)
    assert len([1 for _, k in common.fitted(docs, labels, "toxic", F.lit(True), 10, learn) if k == 0]) in (1, 2)
    assert common.fitted(docs.limit(0), labels, "toxic", F.lit(True), 10, learn) == []


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_odd(spark, odd, empty, operator):
    label = operator.__name__.replace("toxicity", "toxic")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    mixed = spark.createDataFrame([(3, 1), (8, 0), (6, None), (None, 1), (12, 0), (3, 0)], f"doc_id long, {label} int")
    fold = queries.held_out((7, 9))
    for labels in (none, mixed):
        rows = operator(odd, labels, fold).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.held_out is False for r in rows)
        assert operator(empty, labels, fold).count() == 0


def _exact(rows, width, percent):
    """Components by all pairs of whole sets."""
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        w = min(width, len(words))
        sets[doc] = {tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if words else set()
    up = {doc: doc for doc in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for doc, s in sets.items():
        for g in s:
            where[g].append(doc)
    shared = defaultdict(int)
    for docs in where.values():
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {doc: (len(s), top(doc)) for doc, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    docs = table(spark, MID, "documents")
    want = _exact([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], width, 80)
    got = {r.doc_id: r for r in near_duplicates(docs, width=width).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


@pytest.mark.parametrize(("small", "posted"), [(16, 8192), (2, 8192), (2, 4)])
def test_near_duplicates_chain(spark, monkeypatch, small, posted):
    """A large group of near copies, many of them linked only through others; also with groups and lists that are large from a few nodes on."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "POSTED", posted)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(i * 10, i * 10 + 200))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=2).collect()}
    assert got == _exact(rows, 2, 80)


def test_near_duplicates_cut_and_common_passages(spark, monkeypatch):
    """Shortened copies of shortened copies, and texts that share half of their words, in large groups."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    rng = random.Random(11)
    base, passage, rows = [f"w{i}" for i in range(150)], [f"p{i}" for i in range(60)], []
    for i in range(150):
        words = base[rng.randint(0, 15) : 150 - rng.randint(0, 25)]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    for i in range(150):
        rest = [f"r{rng.randrange(40)}_{j}" for j in range(rng.randint(8, 50))]
        rows.append((1000 + i, " ".join([*passage, *rest])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=2).collect()}
    assert got == _exact(rows, 2, 80)


@pytest.mark.parametrize("order", range(3))
def test_one_identifier_with_two_texts(spark, order):
    """Both texts keep their links, whatever the order of the rows."""
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z")]
    rows = [rows[(i * (order + 1) + order) % 4] for i in range(4)] if order != 1 else rows[::-1]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df, width=2).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_near_duplicates_shared_identifiers(spark):
    """Different texts under one identifier, and texts without one, keep their links."""
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10_000)}" for _ in range(150)]
        texts.append((" ".join(words), " ".join([*words[:70], "new", *words[71:]])))
    rows = [(7, a) for a, _ in texts[:20]] + [(100 + i, b) for i, (_, b) in enumerate(texts[:20])]
    rows += [(None, a) for a, _ in texts[20:30]] + [(200 + i, b) for i, (_, b) in enumerate(texts[20:30])]
    rows += [(None, a) for a, _ in texts[30:35]] + [(None, b) for _, b in texts[30:35]] + [(300 + i, a) for i, (a, _) in enumerate(texts[35:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df.withColumn("t", F.col("text")), width=2).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r.component_id)
    assert by_id[7] == [7] * 20 and all(by_id[100 + i] == [7] for i in range(20))
    assert all(by_id[200 + i] == [200 + i] for i in range(10)) and all(by_id[300 + i] == [300 + i] for i in range(5))
    assert sorted(by_id[None], key=str) == sorted([*range(200, 210), *[None] * 10], key=str)


def test_near_duplicates_odd(odd, empty):
    rows = near_duplicates(odd, width=2).collect()
    assert len(rows) == odd.count()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[10] == {(0, 10)}
    assert got[3] == got[4] == got[5] == {(3, 3)} and got[None] == {(3, 3), (0, None)}
    assert got[8] == got[9] == {(1, 8)} and got[7] == {(29_999 + 1, 6)} and got[12] == {(1, 12)}
    assert near_duplicates(empty).count() == 0


def test_estimate_is_unbiased(spark):
    from pyspark.sql import functions as F

    rng, off = random.Random(1), []
    rows = []
    for share in (0.3, 0.6, 0.8, 0.95):
        for _ in range(30):
            words = [f"{rng.random()}" for _ in range(400)]
            n = round(400 * 2 * share / (1 + share))
            a, b = (minhash.shingles([w.encode() for w in part], 1) for part in (words, words[:n] + [f"{rng.random()}" for _ in range(400 - n)]))
            both = len(np.intersect1d(a, b))
            rows.append((both / (len(a) + len(b) - both), *minhash.pack(minhash.minima(a)).tolist(), *minhash.pack(minhash.minima(b)).tolist()))
    n = minhash.LONGS
    df = spark.createDataFrame(rows, ["true", *(f"a{i}" for i in range(n)), *(f"b{i}" for i in range(n))])
    est = minhash.estimate([F.col(f"a{i}") for i in range(n)], [F.col(f"b{i}") for i in range(n)])
    off = [r[0] - r[1] for r in df.select(est, "true").collect()]
    assert abs(sum(off) / len(off)) < 0.015 and max(map(abs, off)) < minhash.MARGIN


LETTERS = ["a", "b", "the", "ing", "THE", " ", "  ", "\n", "\t", " ", "\u0085", "​", "Σ", "ς", "İ", "ß", "é", "é", "한", "1", "²", "½",
           "!", "...", "'s", "'LL", "’s", "<|startoftext|>", "<|endoftext|>", "</w>", "<", "😀", "中文", "x" * 30, "न", "ि", "Ᲊ", "Ꟛ", "ﬁ"]


def test_bpe_equals_the_library():
    own, library = Bpe(open(VOCABULARY, encoding="utf-8").read()), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(7)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0x80, 0x3000), rng.randint(0xE000, 0x1FFFF)])) for _ in range(25)) for _ in range(1000)]
    texts += ["a" * 5000, "!" * 5000, "abc" * 4000, ""]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert list(np.frombuffer(ids, "<u4")) == want, text
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False), text


def test_bpe_query(spark, sf, odd, empty):
    library = Tokenizer.from_file(VOCABULARY)
    for df in (table(spark, sf, "documents"), odd):
        rows = encode_documents(df, VOCABULARY).collect()
        want = defaultdict(list)
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            raw = np.array(ids, "<u4").tobytes()
            decoded = library.decode(ids, skip_special_tokens=False).encode()
            want[r.doc_id].append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        got = defaultdict(list)
        for r in rows:
            got[r.doc_id].append((r.n_tokens, r.ids_sha256, r.decoded_sha256))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert encode_documents(empty, VOCABULARY).count() == 0
