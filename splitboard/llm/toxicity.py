"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled text. The ordinary one holds
the strings that cover ordinary text best. The toxic one holds the same and, before
them, the strings that toxic text repeats and ordinary text does not, found by a
likelihood ratio. Each window of a document is compressed with either; it counts by
the bytes that the toxic dictionary saves. The run of windows that saves most decides,
so that a toxic passage in a long text is not diluted by the rest: its saving, over the
square root of its windows (so that chance savings of long runs weigh no more) and a
share of the doublings from it to the whole document (as a long text has more runs to
save in by chance), is compared with a threshold calibrated on labelled texts that
trained neither dictionary.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitted

#: Bytes of a window, and compression level.
WINDOW, LEVEL = 128, 13
#: Windows of the shortest run (longer ones double, up to the whole document), and what a doubling from a run to the document weighs.
RUN, DOUBLING = 8, 0.5
#: Labelled rows of each class that a model is fitted on at most.
PER_CLASS = 3000
#: Strings of the shared part, strings of the toxic part at most, and the likelihood ratio that those need.
COMMON, DISTINCT, EVIDENCE = 400, 64, 15.0
#: Lengths of the word openings that may become dictionary strings; one document counts a string so often at most.
LENGTHS, PER_DOCUMENT = (6, 7, 8, 9, 10, 12), 4
#: Bytes that a match costs; a string's worth is its evidence times the bytes that it saves beyond.
MATCH = 4
#: Parts that the labelled rows are dealt to for calibration.
FOLDS = 4
#: The score at the calibrated threshold.
AT_THRESHOLD = 0.3


def windows(body: bytes) -> Iterator[bytes]:
    """The whole text in windows, cut at a space where there is one."""
    start, end = 0, len(body)
    while start < end:
        stop = min(end, start + WINDOW)
        if stop < end:
            space = body.rfind(b" ", start, stop)
            stop = space if space > start else stop
        yield body[start:stop]
        start = stop


def _strings(body: bytes) -> Counter:
    found: Counter = Counter()
    for word in body.split():
        word = b" " + word
        found.update(word[:n] for n in LENGTHS if len(word) >= n)
        found[word + b" "] += 1
    return Counter({s: min(n, PER_DOCUMENT) for s, n in found.items()})


def _ratio(a: int, b: int, a_total: int, b_total: int) -> float:
    """Log-likelihood ratio of a's higher rate, 0 if it is not higher."""
    if a * b_total <= b * a_total:
        return 0.0
    rate = (a + b) / (a_total + b_total)
    return a * math.log(a / (a_total * rate)) + (b * math.log(b / (b_total * rate)) if b else 0.0)


def _choose(ranked: list[bytes], most: int) -> list[bytes]:
    """The first strings, without those that open another or are opened by it."""
    chosen: list[bytes] = []
    openings: set[bytes] = set()
    for s in ranked:
        if s in openings or any(s[:n] in chosen for n in range(1, len(s) + 1)):
            continue
        chosen.append(s)
        openings.update(s[:n] for n in range(1, len(s) + 1))
        if len(chosen) == most:
            break
    return chosen


@dataclass
class ToxicModel:
    """Both dictionaries and the threshold; without both classes to learn from, a constant score."""

    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: float = 1.0
    constant: float | None = None
    _made: tuple = field(default=(), repr=False, compare=False)

    def __getstate__(self):
        return (self.ordinary, self.toxic, self.threshold, self.constant)

    def __setstate__(self, state):
        self.ordinary, self.toxic, self.threshold, self.constant = state
        self._made = ()

    def _compressors(self):
        if not self._made:
            made = []
            for raw in (self.ordinary, self.toxic):
                content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.append(
                    zstandard.ZstdCompressor(
                        level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False
                    ).compress
                )
            self._made = tuple(made)
        return self._made

    def saving(self, text: str) -> float:
        """The most that the toxic dictionary saves over a run of windows or all of them, over the root of their number and what the document's length adds."""
        plain, toxic = self._compressors()
        saved = np.array([max(0, len(plain(w)) - len(toxic(w))) for w in windows(text.lower().encode("utf-8", "replace"))], np.int64)
        n = len(saved)
        if not saved.any():
            return 0.0
        sums = np.concatenate(([0], np.cumsum(saved)))
        best, length = float(sums[-1]) / math.sqrt(n), RUN
        while length < n:
            most = float((sums[length:] - sums[:-length]).max())
            best = max(best, most / (math.sqrt(length) + DOUBLING * math.log2(n / length)))
            length *= 2
        return best

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        return 1.0 - (1.0 - AT_THRESHOLD) ** (self.saving(text) / self.threshold)


def train(rows: list[tuple[str, int]]) -> ToxicModel:
    """Both dictionaries of (text, label) rows; the threshold is not set."""
    counts, totals = (Counter(), Counter()), [0, 0]
    for text, label in rows:
        body = text.lower().encode("utf-8", "replace")
        counts[label].update(_strings(body))
        totals[label] += len(body)
    plain, toxic = counts
    evidence = {s: e for s, n in toxic.items() if n >= 5 and (e := _ratio(n, plain[s], totals[1], totals[0])) >= EVIDENCE}
    distinct = _choose(sorted(evidence, key=lambda s: (-evidence[s] * (len(s) - MATCH), s)), DISTINCT)
    common = _choose(sorted(plain, key=lambda s: (-plain[s] * (len(s) - MATCH), s)), COMMON)
    # The best strings stand last, where offsets are short; the shared part has the same offsets in both.
    base = b"".join(reversed(common)).ljust(8)
    return ToxicModel(base, b"".join(reversed(distinct)) + b" " + base)


def fit(rows: list[tuple[str, int]]) -> ToxicModel:
    """A model of (text, label) rows. With one class or none: that class's label, or 0, as constant score.

    The threshold is calibrated on texts that trained neither dictionary: rows are dealt
    to ``FOLDS`` by their text, each fold's savings come from dictionaries of the others,
    and the threshold has the best F1 over all of them. The model has all rows' dictionaries.
    """
    classes = {label for _, label in rows}
    if len(classes) < 2:
        return ToxicModel(constant=float(max(classes, default=0)))
    fold = [zlib.crc32(text.encode("utf-8", "replace")) % FOLDS for text, _ in rows]
    scored = []
    for k in range(FOLDS):
        others = [row for row, own in zip(rows, fold) if own != k]
        if len({label for _, label in others}) == 2:
            part = train(others)
            scored += [(part.saving(text), label) for (text, label), own in zip(rows, fold) if own == k]
    model = train(rows)
    # Too few rows to leave any out.
    scored = sorted(scored or [(model.saving(text), label) for text, label in rows], reverse=True)
    best, hits, wanted = (0.0, 1.0), 0, sum(label for _, label in scored)
    for i, (saving, label) in enumerate(scored):
        hits += label
        if saving > 0 and (i + 1 == len(scored) or scored[i + 1][0] < saving):
            lower = scored[i + 1][0] if i + 1 < len(scored) else 0.0
            best = max(best, (2 * hits / (i + 1 + wanted), (saving + lower) / 2))
    model.threshold = best[1] or 1.0
    return model


def toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.3).

    Only labelled rows outside ``held_out`` are learned from, ``per_class`` of each
    class at most; every document is scored over its whole text. Null and empty
    texts score 0 (nothing is saved). Repeated rows score alike. Other columns, whatever
    their names, are not looked at. An empty table gives no rows; without labels all
    scores are 0.
    """
    model = fitted(docs, labels, label, ~held_out, per_class, fit, id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score)

    scored = docs.select(
        F.col(id_col),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        score(F.coalesce(F.col(text), F.lit(""))).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= AT_THRESHOLD).cast("int"))
