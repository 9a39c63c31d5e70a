"""Byte-level BPE as a lazily determinised transducer, and decoding by a UTF-8 state machine.

The encoder reads a piece byte by byte. It could be at the end of any encoding of an
opening of the piece, with the bytes since then on a path of the trie of tokens: such
a pair (last token, place in the trie) is a configuration. A token may come next if it
can stand after the last one, that is if merging wouldn't have gone across their
border; so each opening has one encoding, and at the end of the piece one
configuration is complete. A state of the transducer is the set of configurations,
each with the tokens that it has and others haven't; what all have in common is
emitted. States and moves are made when a text first needs them, and thrown away when
there are too many.

The decoder has the tokens' bytes end to end in one table. Its states are the ways in
which a character can be incomplete, its moves are whole tokens, and text comes out
up to the last border of a character.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NEW_LETTERS, NEW_NUMBERS, Bpe
from .common import ship

#: States that a transducer holds, and pieces that a worker remembers in each of two generations, at most.
STATES, REMEMBERED = 150_000, 300_000
#: Tokens that the decoder takes together.
CHUNK = 4096


class Ranks:
    """Tokens by rank, with the two halves that each was merged from."""

    can_follow = Bpe._can_follow

    def __init__(self, source: bytes):
        self.tokens: dict[bytes, int] = {}
        for line in source.splitlines():
            if line.strip():
                token, rank = line.split()
                self.tokens[base64.b64decode(token)] = int(rank)
        by_rank = sorted(self.tokens.items(), key=lambda item: item[1])
        self.ids = [rank for _, rank in by_rank]
        self.strings = [token for token, _ in by_rank]
        number = {token: n for n, token in enumerate(self.strings)}
        self.halves: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        #: Tokens that merging can come to; others are only whole pieces.
        self.whole = [True] * len(by_rank)
        for n, token in enumerate(self.strings):
            parts = self._merge(token, number, n)
            self.whole[n] = len(parts) <= 2
            self.halves.append((parts[0], parts[1]) if len(parts) == 2 else (n, n))
            if len(parts) == 2:
                self.merged[parts[0], parts[1]] = n

    @staticmethod
    def _merge(token: bytes, number: dict[bytes, int], below: int) -> list[int]:
        """The token by merges before its own."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [(number.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, at = min(pairs)
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [number[p] for p in parts]


class Transducer:
    """Bytes of a piece to token numbers, by states made when they are needed."""

    def __init__(self, ranks: Ranks, limit: int = STATES):
        self.ranks, self.limit = ranks, limit
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for n, string in enumerate(ranks.strings):
            if not ranks.whole[n]:
                continue
            node = 0
            for byte in string:
                below = self.children[node]
                if byte not in below:
                    below[byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = below[byte]
            self.token[node] = n
        self.configs: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.rest: list[tuple] = []
        self._state(((-1, 0, ()),))

    def _state(self, configs: tuple) -> int:
        found = self.number.get(configs)
        if found is None:
            found = self.number[configs] = len(self.configs)
            self.configs.append(configs)
            self.moves.append({})
            # One configuration is at a border of tokens; what it still has comes out if the piece ends here.
            self.rest.append(next(had for _, node, had in configs if node == 0))
        return found

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        children, token, follow = self.children, self.token, self.ranks.can_follow
        after, whole = [], False
        for last, node, had in self.configs[state]:
            node = children[node].get(byte)
            if node is None:
                continue
            if children[node]:
                after.append((last, node, had))
            # An opening has one encoding, so one token at most ends here.
            if not whole and token[node] >= 0 and (last < 0 or follow(last, token[node])):
                whole = True
                after.append((token[node], 0, (*had, token[node])))
        out = after[0][2]
        for _, _, had in after:
            if out != had[: len(out)]:
                out = tuple(t for t, _ in takewhile(lambda pair: pair[0] == pair[1], zip(out, had)))
            if not out:
                break
        shared = len(out)
        configs = tuple((last, node, had[shared:]) for last, node, had in after) if shared else tuple(after)
        if len(self.configs) >= self.limit and configs not in self.number:
            for table in (self.configs, self.number, self.moves, self.rest):
                table.clear()
            self._state(((-1, 0, ()),))
            return self._state(configs), out
        move = self.moves[state][byte] = (self._state(configs), out)
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Token numbers of a whole piece."""
        state, moves, taken = 0, self.moves, []
        for byte in piece:
            move = moves[state].get(byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                taken += move[1]
        taken += self.rest[state]
        return taken

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """Token numbers as soon as no reading of the bytes so far has another token."""
        state = 0
        for byte in piece:
            state, out = self.moves[state].get(byte) or self._move(state, byte)
            yield from out
        yield from self.rest[state]


def _ways() -> tuple[list[list[int]], list[int]]:
    """The moves of UTF-8 by byte, -1 where there is none, and the bytes held in each state.

    State 0 is the border of a character; the others are named by what may come.
    """
    states: dict[tuple, int] = {(): 0}
    held = [0]
    moves = [[-1] * 256]

    def state(rest: tuple, have: int) -> int:
        if (rest, have) not in states:
            states[rest, have] = len(held)
            held.append(have)
            moves.append([-1] * 256)
            low, high = rest[0]
            n = states[rest, have]
            after = state(rest[1:], have + 1) if rest[1:] else 0
            for byte in range(low, high + 1):
                moves[n][byte] = after
        return states[rest, have]

    more = (0x80, 0xBF)
    # Lead bytes and the continuation bytes that well-formed UTF-8 allows after them.
    for low, high, rest in (
        (0xC2, 0xDF, (more,)), (0xE0, 0xE0, ((0xA0, 0xBF), more)), (0xE1, 0xEC, (more, more)), (0xED, 0xED, ((0x80, 0x9F), more)), (0xEE, 0xEF, (more, more)),
        (0xF0, 0xF0, ((0x90, 0xBF), more, more)), (0xF1, 0xF3, (more, more, more)), (0xF4, 0xF4, ((0x80, 0x8F), more, more)),
    ):
        for byte in range(low, high + 1):
            moves[0][byte] = state(rest, 1)
    moves[0][:128] = [0] * 128
    return moves, held


class Utf8Stream:
    """Tokens in, text out: whole characters only, U+FFFD for each longest part that can't be one."""

    ways, held = _ways()

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.moves: list[dict[int, int]] = [{} for _ in self.held]
        self.state, self.waiting = 0, b""

    def feed(self, tokens: Iterable[int]) -> tuple[bytes, str]:
        """The tokens' bytes, and the text that is complete by now."""
        tokens = list(tokens)
        state, moves = self.state, self.moves
        for token in tokens:
            to = moves[state].get(token)
            if to is None:
                to = self._move(state, token)
            if to < 0:
                state = -1
                break
            state = to
        raw = b"".join([self.strings[t] for t in tokens])
        data = self.waiting + raw
        if state >= 0:
            border = len(data) - self.held[state]
            self.state, self.waiting = state, data[border:]
            return raw, data[:border].decode("utf-8")
        return raw, self._mend(data)

    def _move(self, state: int, token: int) -> int:
        to = state
        for byte in self.strings[token]:
            to = self.ways[to][byte]
            if to < 0:
                break
        self.moves[state][token] = to
        return to

    def _mend(self, data: bytes) -> str:
        """Byte by byte, where something isn't UTF-8."""
        out, state, begin, at = [], 0, 0, 0
        while at < len(data):
            to = self.ways[state][data[at]]
            if to < 0:
                out.append("�")
                # The byte that doesn't fit begins anew, unless it was the first.
                at += state == 0
                begin, state = at, 0
                continue
            at, state = at + 1, to
            if state == 0:
                out.append(data[begin:at].decode("utf-8"))
                begin = at
        self.state, self.waiting = state, data[begin:]
        return "".join(out)

    def finish(self) -> str:
        """What an incomplete last character stands for."""
        left, self.state, self.waiting = self.waiting, 0, b""
        return "�" if left else ""


class ByteBpe:
    """A tokenizer of ranked byte strings over the matches of a pattern."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self._begin()

    def _begin(self) -> None:
        self.transducer = Transducer(self.ranks)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split = regex.compile(self.pattern)
        self.new = re.compile(f"[{NEW_LETTERS}{NEW_NUMBERS}]")

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.ranks, self.pattern = state
        self._begin()

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches, by the letters and numbers of Unicode 16."""
        try:
            text.encode("latin-1")
            return self.split.findall(text)
        except UnicodeEncodeError:
            if not self.new.search(text):
                return self.split.findall(text)
        # Newer letters and numbers are neither to the library, as private characters are.
        return [text[m.start() : m.end()] for m in self.split.finditer(self.new.sub("\ue000", text))]

    def _piece(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.tokens.get(raw)
            ids = [whole] if whole is not None else [self.ranks.ids[n] for n in self.transducer.encode(raw)]
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.known) >= REMEMBERED:
            # What has not been met since the last time goes.
            self.older = dict(self.known)
            self.known.clear()
        self.known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        known = self.known.get
        return b"".join([known(p) or self._piece(p) for p in self.pieces(text)])


class ByteDecoder:
    """Ids, in little-endian unsigned 32-bit integers, to bytes and text."""

    def __init__(self, ranks: Ranks):
        strings = [b""] * (max(ranks.ids, default=-1) + 1)
        for token, rank in ranks.tokens.items():
            strings[rank] = token
        self.stream = Utf8Stream(strings)

    def decode(self, ids: bytes) -> Iterator[tuple[bytes, str]]:
        """Bytes and complete text of every ``CHUNK`` tokens; an id that no token has is an error."""
        numbers = np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), CHUNK):
            yield self.stream.feed(numbers[at : at + CHUNK].tolist())
        yield b"", self.stream.finish()


def load_ranks(path: str) -> Ranks:
    with open(path, "rb") as file:
        return Ranks(file.read())


def encode_bytes(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` (binary, little-endian 32-bit), ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    ``vocabulary`` is the path of a rank file on the driver, ``pattern`` splits a text
    into pieces that are encoded each by itself. The ranks are broadcast (their size is
    the file's). A null text counts as empty and has no tokens. Whole texts are encoded,
    whatever their length; repeated rows alike. Other columns, whatever their names, are
    not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = load_ranks(vocabulary)
    shared = spark.sparkContext.broadcast(ByteBpe(ranks, pattern))

    @F.pandas_udf("ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = shared.value
        decoder = ByteDecoder(bpe.ranks)
        for texts in batches:
            rows = []
            for body in texts:
                ids, decoded = bpe.encode(body), hashlib.sha256()
                for raw, _ in decoder.decode(ids):
                    decoded.update(raw)
                rows.append((ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), run(F.coalesce(F.col(text), F.lit(""))).alias("r")).select(id_col, "r.*")


def decode_bytes(rows: DataFrame, vocabulary: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Add the text of the ids; parts that aren't UTF-8 become U+FFFD. Null ids have no text, ids without token fail."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = ByteDecoder(shared.value)
        for series in batches:
            yield pd.Series([None if i is None else "".join(text for _, text in decoder.decode(i)) for i in series], dtype=object)

    return rows.withColumn(into, run(F.col(ids)))
