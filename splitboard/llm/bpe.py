"""BPE encoding by backtracking, and decoding by an offset table.

A piece of text is a string of symbols: one for each byte, another for each byte that
ends the piece. An Aho-Corasick automaton finds the longest token at every place. The
encoder takes the longest token; if it can't follow the token before (their merges
would have come out otherwise), it tries the next shorter token, and if none is left
it takes back a token. A place that failed is never tried again, so the time is
linear, and what comes out is what merging by rank gives.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Pieces that a worker remembers.
REMEMBERED = 400_000
#: The symbol of a byte that ends a piece is this much higher.
FINAL = 256

#: Fixed values. Letters and numbers of Unicode 17, which the regex module knows and the tokenizers library (Unicode 16) doesn't.
NEW_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEW_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
#: Lower case that Python's Unicode 15 lacks and the library has.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Bpe:
    """A word-end BPE tokenizer read from the JSON text of its vocabulary file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        # Own numbers follow the order of merges: first the 512 symbols, then each merge.
        number, strings, self.ids = {}, [], []
        for base, end in ((0, ""), (FINAL, suffix)):
            for b, letter in enumerate(byte_letters()):
                number[letter + end] = len(strings)
                strings.append(chr(base + b))
                self.ids.append(vocab[letter + end])
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(strings))]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (number[left], number[right])
            number[left + right] = self.merged[pair] = len(strings)
            self.halves.append(pair)
            strings.append(strings[pair[0]] + strings[pair[1]])
            self.ids.append(vocab[left + right])
        self.lengths = [len(s) for s in strings]
        # Only tokens that their own string is encoded as can come out.
        whole = [n < 2 * FINAL or self._can_follow(*self.halves[n], n) for n in range(len(strings))]
        self.tokens = ahocorasick.Automaton()
        for n, s in enumerate(strings):
            if whole[n]:
                self.tokens.add_word(s, n)
        self.tokens.make_automaton()
        self.shorter = [self._opening(s) for s in strings]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.known: dict[str, bytes] = {}
        self._patterns()
        # Decoding: the tokens' text laid end to end, each after a space, and where each begins.
        text = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            text[i] = b" " + token.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.laid_out = np.frombuffer(b"".join(text), np.uint8)

    def _patterns(self) -> None:
        self.piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
        letter, number = rf"[\p{{L}}--[{NEW_LETTERS}]]", rf"[\p{{N}}--[{NEW_NUMBERS}]]"
        other = rf"[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{NEW_LETTERS}{NEW_NUMBERS}]"
        self.new_piece = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|(?:{other})+")
        self.new = regex.compile(f"[{NEW_LETTERS}{NEW_NUMBERS}{''.join(map(chr, NEW_LOWER))}]")
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "piece", "new_piece", "new", "around")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.known = {}
        self._patterns()

    def _opening(self, string: str) -> int:
        """The longest token that is a true opening of the string, or -1."""
        for n in range(len(string) - 1, 0, -1):
            if (found := self.tokens.get(string[:n], -1)) >= 0:
                return found
        return -1

    def _can_follow(self, left: int, right: int, below: int = 1 << 60) -> bool:
        """Whether the two, side by side, stay as they are: no merge across their border comes before theirs.

        Walks down the tokens along the border, the later merge first. A pair that
        merges before the last undone merge would have been merged then. below: only
        merges before that one count.
        """
        merged, halves, limit = self.merged, self.halves, below
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:  # a symbol: undo the other one
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def encode_symbols(self, string: str) -> list[int]:
        """Own numbers of a string of symbols."""
        n = len(string)
        longest = [-1] * (n + 1)
        lengths, shorter = self.lengths, self.shorter
        for end, token in self.tokens.iter(string):
            at = end + 1 - lengths[token]
            if longest[at] < 0 or lengths[token] > lengths[longest[at]]:
                longest[at] = token
        taken: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + lengths[token]
                if not dead[end] and (not taken or self._can_follow(taken[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += lengths[token]
                token = longest[at]
            else:
                dead[at] = 1
                token = taken.pop()
                at -= lengths[token]
                token = shorter[token]
        return taken

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        string = raw[:-1].decode("latin-1") + chr(FINAL + raw[-1])
        out = np.array([self.ids[t] for t in self.encode_symbols(string)], "<u4").tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers. Special tokens in the text are kept whole."""
        known, parts = self.known, []
        for i, run in enumerate(self.around.split(text) if self.around else [text]):
            if i % 2:
                parts.append(self.special[run].to_bytes(4, "little"))
            elif run:
                # Case by code point: a final sigma is no exception.
                run = unicodedata.normalize("NFC", run)
                pattern = self.piece
                if not run.isascii() and self.new.search(run):
                    run, pattern = run.translate(NEW_LOWER), self.new_piece
                run = run.replace("Σ", "σ").lower()
                parts += [known.get(p) or self._piece(p) for p in pattern.findall(run)]
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens, a space between two."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(numbers):
            return b""
        starts = self.offsets[numbers]
        sizes = self.offsets[numbers + 1] - starts
        before = np.cumsum(sizes) - sizes
        return self.laid_out[np.repeat(starts - before, sizes) + np.arange(sizes.sum())].tobytes()[1:]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``ids`` (binary, little-endian 32-bit), ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    ``vocabulary`` is the path of a word-end BPE file on the driver; its tables are
    broadcast (their size is the file's). A null text counts as empty and has no
    tokens. Whole texts are encoded, whatever their length; repeated rows alike. Other
    columns, whatever their names, are not looked at. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Bpe(file.read()))

    @F.pandas_udf("ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = shared.value
        for texts in batches:
            rows = []
            for body in texts:
                ids = bpe.encode(body)
                rows.append((ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), run(F.coalesce(F.col(text), F.lit(""))).alias("r")).select(id_col, "r.*")
