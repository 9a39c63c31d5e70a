"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are words and word shapes (runs of capitals, letters, digits and signs), with
terms for repetition, hashed to fixed dimensions, damped, weighted by inverse
document frequency and projected on the leading singular directions of a labelled
sample. The sample's vectors are broadcast (a fixed bound); every document's cosines
with all of them are computed exactly, in blocks, and its nearest neighbours vote
by similarity.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fitted

#: Dimensions of hashed words and of hashed shapes, and of the latent space.
WORDS, SHAPES, LATENT = 1024, 1024, 64
#: Labelled rows of each class that a model is fitted on at most.
PER_CLASS = 2500
NEIGHBOURS, POWER = 25, 2
#: Documents in a block of the cosine product; words that a worker remembers, and their letters at most.
BLOCK, REMEMBERED, LONG = 256, 100_000, 64
#: The score at the calibrated threshold.
AT_THRESHOLD = 0.3


def _hash(term: str, size: int) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % size


class Terms:
    """Text to sparse hashed counts."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def of_word(self, word: str) -> tuple[int, int]:
        # The hash goes on from run to run, so that a word of any length is taken whole.
        shape, last = 0, ""
        for ch in word:
            kind = "U" if ch.isupper() else "l" if ch.isalpha() else "9" if ch.isdigit() else ch
            if kind != last:
                shape, last = zlib.crc32(kind.encode("utf-8", "replace"), shape), kind
        pair = (_hash(word.strip(".,;:!?").lower(), WORDS), WORDS + shape % SHAPES)
        if len(word) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = pair
        return pair

    def of_text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.split()
        counts = Counter(tokens)
        known, at, weight = self.known, [], []
        for word, n in counts.items():
            at += known.get(word) or self.of_word(word)
            weight += (n, n)
            if n >= 4 and len(word) > 4:
                # A word that takes up much of the text, by octaves of its share.
                at.append(WORDS + _hash(f"<share{int(np.log2(64 * n / len(tokens) + 1))}>", SHAPES))
                weight.append(n)
        again = sum(a == b for a, b in pairwise(tokens))
        if again:
            at.append(WORDS + _hash("<again>", SHAPES))
            weight.append(3 * again)
        return np.array(at, np.int64), np.array(weight, np.float64)

    def matrix(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), WORDS + SHAPES), np.float32)
        for i, text in enumerate(texts):
            at, weight = self.of_text(text)
            rows[i] = np.bincount(at, weight, WORDS + SHAPES)
        return np.log1p(rows, out=rows)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass
class QualityModel:
    """Projection, labelled vectors and threshold; without both classes, a constant score."""

    idf: np.ndarray | None = None
    axes: np.ndarray | None = None
    points: np.ndarray | None = None
    votes: np.ndarray | None = None
    threshold: float = 0.5
    constant: float | None = None
    terms: Terms = field(default_factory=Terms, repr=False)

    def vectors(self, texts: list[str]) -> np.ndarray:
        return _unit(_unit(self.terms.matrix(texts) * self.idf) @ self.axes)

    def vote(self, vectors: np.ndarray, own: int | None = None) -> np.ndarray:
        """Weighted share of label 1 among the nearest; own: the vectors are the points from there on, which don't count."""
        cosines = vectors @ self.points.T
        if own is not None:
            cosines[np.arange(len(vectors)), own + np.arange(len(vectors))] = -1.0
        k = min(NEIGHBOURS, cosines.shape[1] - (own is not None))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(float) ** POWER
        return (weight * self.votes[near]).sum(1) / weight.sum(1)

    def score(self, texts: list[str]) -> np.ndarray:
        """Votes, bent so that the calibrated threshold lies at 0.3."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = []
        for i in range(0, len(texts), BLOCK):
            share, t = np.clip(self.vote(self.vectors(texts[i : i + BLOCK])), 0, 1), self.threshold
            out.append(np.where(share < t, AT_THRESHOLD * share / t, AT_THRESHOLD + (1 - AT_THRESHOLD) * (share - t) / (1 - t)))
        return np.concatenate(out) if out else np.zeros(0)


def fit(rows: list[tuple[str, int]]) -> QualityModel:
    """A model of (text, label) rows. With one class or none: that class's label, or 1, as constant score."""
    labels = np.array([label for _, label in rows], float)
    if len(set(labels)) < 2:
        return QualityModel(constant=float(labels[0]) if len(labels) else 1.0)
    model = QualityModel(votes=labels)
    counts = model.terms.matrix([text for text, _ in rows])
    model.idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32)
    # In place and in single precision: this runs in one task.
    counts *= model.idf
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    weighted = counts
    _, axes = np.linalg.eigh(weighted.T @ weighted)
    model.axes = np.ascontiguousarray(axes[:, -LATENT:], np.float32)
    model.points = _unit(weighted @ model.axes)
    # Each labelled row is judged by the others; the threshold has the best accuracy there.
    shares = np.concatenate([model.vote(model.points[i : i + BLOCK], i) for i in range(0, len(rows), BLOCK)])
    order = np.argsort(shares, kind="stable")
    # Below the threshold lie the first i rows.
    right = np.concatenate([[0], np.cumsum(labels[order] == 0)]) + np.concatenate([np.cumsum((labels[order] == 1)[::-1])[::-1], [0]])
    cuts = np.concatenate([[0.0], (shares[order][1:] + shares[order][:-1]) / 2, [1.0]])
    best = np.flatnonzero(right == right.max())
    model.threshold = float(np.clip(np.median(cuts[best]), 0.02, 0.98))
    model.terms = Terms()
    return model


def quality(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS
) -> DataFrame:
    """Every column of ``docs`` and ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.3).

    Only labelled rows outside ``held_out`` are learned from, ``per_class`` of each
    class at most; every document is scored over its whole text. Null and empty
    texts have no terms and get the votes of arbitrary but fixed neighbours at the
    least weight. Repeated rows score alike. An empty table gives no rows; without
    labels all scores are 1. Columns of ``docs`` named like the three are replaced.
    """
    model = fitted(docs, labels, label, ~held_out, per_class, fit, id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()))

    docs = docs.drop("held_out", "score", "predicted")
    scored = docs.withColumn("score", score(F.coalesce(F.col(text), F.lit(""))))
    return scored.withColumns(
        {"held_out": F.coalesce(held_out, F.lit(False)), "predicted": (F.col("score") >= AT_THRESHOLD).cast("int")}
    )
