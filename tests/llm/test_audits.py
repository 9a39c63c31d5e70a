"""Filter and source audits against plain models, byte-level BPE against the tiktoken library."""

from __future__ import annotations

import base64
import codecs
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from splitboard.llm import byte_bpe, queries, term_audit
from splitboard.llm.byte_bpe import ByteBpe, ByteDecoder, Ranks, Transducer, Utf8Stream, decode_bytes, encode_bytes, load_ranks
from splitboard.llm.filter_audit import audit_filters
from splitboard.llm.term_audit import RadixTrie, audit_sources

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _audited(rows, labels):
    """The filter audit by plain loops over rows (doc_id, text, source)."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = defaultdict(lambda: [0] * 6)
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        mine = [m for d, *m in labels if d is not None and d == i]
        good, toxic = any(q == 1 for q, _ in mine), any(t == 1 for _, t in mine)
        for order in map("".join, permutations("ABCDE")):
            first = next((s for s, f in enumerate(order, 1) if fails[f]), 6)
            for step, f in enumerate(order, 1):
                row = out[source or "", order, step]
                for at, holds in enumerate(
                    (first > step, first == step, first < step and fails[f], fails[f] and sum(fails.values()) == 1, first == step and good, first == step and toxic)
                ):
                    row[at] += holds
    total = Counter()
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] += row[1]
    return {(*k, *row, total[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


COUNTS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _filters(docs, labels):
    rows = audit_filters(docs, labels).select(COUNTS).collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_filters(spark, odd, empty):
    long = " ".join(f"Word{i % 90}" for i in range(400))
    extra = [(20 + i, t, "hot", s) for i, (t, s) in enumerate([(long, "a"), (long, "b"), (long.lower(), "a"), (long.lower() + " #", "c"), ("A b", None)] * 3)]
    docs = odd.select("doc_id", "text", "lang", "source").unionAll(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"))
    docs = docs.withColumns({c: F.lit("clash") for c in ("part", "mask", "step", "good", "digest", "salt", "id", "quality")})
    marks = [(1, 1, 0), (20, 1, 0), (20, 0, 1), (21, None, None), (22, 0, 1), (23, 1, 1), (None, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame([(*m, "clash") for m in marks], "doc_id long, quality int, toxic int, part string")
    plain = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert _filters(docs, labels) == _audited(plain, marks)
    assert _filters(docs, labels.limit(0)) == _audited(plain, [])
    assert audit_filters(empty, labels).count() == 0


def _divergence(rows, least, top):
    """The source audit by plain loops over rows (lang, source, text)."""
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        seen[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update(counts[g])

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, whole = share(counts[lang, source]), share(total)
        pairs = []
        for other in groups:
            if other[0] == lang and other[1] != source:
                q = share(counts[other])
                pairs.append((other[1], sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
        terms = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(items[:limit], 1)}
    return out


@pytest.mark.parametrize("bound", [None, 5])
def test_divergence(spark, odd, empty, monkeypatch, bound):
    if bound:
        # The nested functions take these values along: tries are emitted and begun anew, terms cut from their batches and sums passed on, all the time.
        for name in ("BUFFERED", "HELD", "CELLS", "PAIRS", "SUMS"):
            monkeypatch.setattr(term_audit, name, bound)
    rng = random.Random(7)
    words = ["Alpha", "alp", "alpine", "beta", "été", "Été", "中文", "中", "x1y", "zeta", "z", "😀"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "ä", None]), " ".join(rng.choices(words, k=rng.randrange(9)))) for _ in range(120)]
    rows += [("fr", "only", "un deux trois"), ("it", "a", "raro"), ("it", "b", None), ("en", "hot", "alpha " * 5000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("term", "docs", "item", "value", "rank", "part", "n", "v", "zero")})
    for df in (docs.repartition(7), odd, docs.limit(1)):
        plain = [(r.lang, r.source, r.text) for r in df.collect()]
        for top in (3, 200):
            got = audit_sources(df, least_docs=3, top=top).collect()
            assert len(got) == len(set(got)) and set(map(tuple, got)) == _divergence(plain, 3, top)
    assert audit_sources(empty).count() == 0


def test_trie():
    rng = random.Random(1)
    words = {bytes(rng.choices(b"abc\xc3\xa9", k=rng.randrange(1, 9))) for _ in range(3000)}
    trie = RadixTrie()
    for w in [*words, *list(words)[:500]]:
        node = trie.leaf(w)
        node.docs += 1
    assert [w for w, _ in trie.leaves()] == sorted(words)
    assert sum(node.docs for _, node in trie.leaves()) == len(words) + 500


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(load_ranks(RANKS), public_tokenizers.PATTERN)


def _ids(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def _texts(seed, n):
    rng = random.Random(seed)
    alphabets = ["ab", "aA bB", "abcdefghijklmnopqrstuvwxyz ", "the ing er on 's't're ", "0123456789 .,;", " \n\t\r 　x", "éüßñ中文字😀👍🏽 ", "-=_*#/\\", "՘⿿1\U0001e6c0\U00011de1 a", "\u0000\u0001\x7f\x80é"]
    for _ in range(n):
        yield "".join(rng.choices(rng.choice(alphabets) + rng.choice(alphabets), k=rng.randrange(60)))


def test_byte_bpe(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 3)
    decoder = ByteDecoder(bpe.ranks)
    for text in [*_texts(5, 4000), "", "a" * 5000, "-" * 3001, " " * 999, "ab" * 1500, "<|endoftext|>", "".join(map(chr, range(0x20, 0x3000)))]:
        ids = bpe.encode(text)
        assert _ids(ids) == library.encode_ordinary(text), text
        raw, shown = zip(*decoder.decode(ids))
        assert b"".join(raw).decode() == "".join(shown) == text


def test_transducer(bpe, library):
    """Whole byte strings, with few states, without the memory of pieces; tokens come out before the end."""
    small = Transducer(bpe.ranks, limit=50)
    rng = random.Random(9)
    for _ in range(800):
        raw = bytes(rng.choices(rng.choice([b"ab", b"etaoin shr", b"\xc3\xa9\xe4\xb8\xad", bytes(range(256))]), k=rng.randrange(1, 80)))
        assert [bpe.ranks.ids[n] for n in small.encode(raw)] == [bpe.ranks.ids[n] for n in small.stream(raw)] == library._encode_single_piece(raw)
        assert len(small.configs) <= 51
    long = ("internationalization" * 500).encode()
    taken = [0]

    def bytes_of():
        for byte in long:
            taken[0] += 1
            yield byte

    length = 0
    for n in bpe.transducer.stream(bytes_of()):
        length += len(bpe.ranks.strings[n])
        assert taken[0] - length < 200
    assert length == len(long)


def test_own_ranks():
    """A token that merging can't come to is only a whole piece."""
    lines = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc", b"abcd", b"xyz"]
    source = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(lines))
    ranks = Ranks(source)
    model = ByteBpe(ranks, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(lines)}, special_tokens={})
    for text in ("abc", "abcd", "abcabcd", "xyz", "xyzxyz", "aabcbc"):
        assert _ids(model.encode(text)) == other.encode_ordinary(text), text


def test_utf8_stream(bpe):
    rng = random.Random(3)
    strings = [bytes([b]) for b in range(256)] + [b"\xe4\xb8", b"\xad\xe4", b"\xf0\x9f", b"\x98\x80a", b"abc", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90"]
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(len(strings)), rng.randrange(256, len(strings)), 97]) for _ in range(rng.randrange(12))]
        stream, text, raw = Utf8Stream(strings), [], []
        for at in range(0, len(ids), 3):
            data, out = stream.feed(ids[at : at + 3])
            raw.append(data)
            text.append(out)
        text.append(stream.finish())
        data = b"".join(strings[i] for i in ids)
        assert b"".join(raw) == data and "".join(text) == codecs.getincrementaldecoder("utf-8")("replace").decode(data, True)


def test_encode_documents(spark, odd, empty, library):
    rows = encode_bytes(odd, RANKS, public_tokenizers.PATTERN)
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    got = decode_bytes(rows, RANKS).collect()
    assert Counter((r.doc_id, r.text) for r in got) == texts
    for r in got:
        assert _ids(r.ids) == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids) // 4
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert encode_bytes(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_op12(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(data).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
