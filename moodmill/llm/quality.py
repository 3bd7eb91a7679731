"""Text quality by a generalised additive model with pairwise interactions.

A text is described by ratios of counts (cases, symbols, repeated words and lines, lengths).
Each feature is cut into bins at quantiles of the labelled sample. Boosting goes round the
features: a shallow tree over one feature's bins is added to that feature's lookup table, then
the next feature's turn comes; the same is done for the pairs that explain most of what is
left. A score is the intercept plus one table entry per feature and pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import CHUNK_BYTES, pieces
from moodmill.llm.language_id import held_out

#: Labelled rows that the model may learn from; the one bound on what is learned.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 80, 40, 0.1
#: Weight that holds leaves near zero; least weight of a leaf.
RIDGE, LEAST = 1.0, 2.0
THRESHOLD = 0.7

#: A for upper, a for lower case and other letters, 0 digits, . marks of prose, # other marks.
PROSE_MARKS = b".,;:?'\"()-"
KINDS = bytes(
    65
    if 65 <= c <= 90
    else 97
    if 97 <= c <= 122 or c >= 128
    else 48
    if 48 <= c <= 57
    else 10
    if c in (10, 11, 12, 13)
    else 32
    if c <= 32
    else 46
    if c in PROSE_MARKS
    else 35
    for c in range(256)
)
LINE_END = re.compile(rb"[\n\r\x0b\x0c]+")

FEATURES = (
    "log_bytes", "upper", "digit", "blank", "prose_marks", "marks", "wide", "word_bytes",
    "distinct_words", "distinct_pairs", "capital_words", "marked_words", "lone_marks",
    "long_words", "line_words", "distinct_lines", "sentence_words", "doubled_marks",
)
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def pieces_of(data: bytes, most: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The text in runs of about ``most`` bytes, cut at a space."""
    start = 0
    while start < len(data):
        end = len(data) if start + most >= len(data) else data.find(b" ", start + most)
        end = len(data) if end < 0 else end
        yield data[start:end]
        start = end


def describe(text: str) -> list[float]:
    """The features of a whole text. Repeats are counted within runs of a megabyte, so a long
    text is never held as words."""
    upper = digit = blank = prose = marks = wide = words = distinct = pairs = distinct_pairs = 0
    capital = marked = lone = long = lines = distinct_lines = sentences = doubled = 0
    data = text.encode("utf-8", "surrogatepass")
    for piece in pieces_of(data):
        kinds = piece.translate(KINDS)
        count = np.bincount(np.frombuffer(kinds, np.uint8), minlength=128)
        upper += int(count[65])
        digit += int(count[48])
        blank += int(count[32] + count[10])
        prose += int(count[46])
        marks += int(count[35])
        wide += int(np.count_nonzero(np.frombuffer(piece, np.uint8) >= 128))
        own = piece.split()
        words += len(own)
        distinct += len(set(own))
        pairs += max(len(own) - 1, 0)
        distinct_pairs += len(set(zip(own, own[1:])))
        shape = b" " + kinds.replace(b"\n", b" ") + b" "
        capital += shape.count(b" AA")
        marked += shape.count(b"# ") + shape.count(b"#. ")
        lone += shape.count(b" # ")
        long += sum(len(word) > 12 for word in own)
        doubled += shape.count(b"##")
        sentences += shape.count(b". ")
        rows = [line for line in LINE_END.split(piece) if line.strip()]
        lines += len(rows)
        distinct_lines += len(set(rows))
    size, some = max(len(data), 1), max(words, 1)
    return [
        float(np.log1p(len(data))), upper / size, digit / size, blank / size, prose / size,
        marks / size, wide / size, (size - blank) / some, distinct / some,
        distinct_pairs / max(pairs, 1), capital / some, marked / some, lone / some, long / some,
        words / max(lines, 1), distinct_lines / max(lines, 1), words / max(sentences, 1),
        doubled / some,
    ]


def described(texts) -> np.ndarray:
    return np.array([describe(text) for text in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)  # per feature: BINS - 1 borders
    coarse: list[np.ndarray] = field(default_factory=list)  # per feature: PAIR_BINS - 1 borders
    tables: np.ndarray | None = None  # a row per feature, a column per bin
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: np.ndarray | None = None  # per pair: PAIR_BINS x PAIR_BINS

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of features."""
        total = np.full(len(x), self.intercept)
        if self.tables is not None:
            for f, edges in enumerate(self.edges):
                total += self.tables[f, np.searchsorted(edges, x[:, f], "right")]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[
                    np.searchsorted(self.coarse[i], x[:, i], "right"),
                    np.searchsorted(self.coarse[j], x[:, j], "right"),
                ]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def cut(g: np.ndarray, h: np.ndarray) -> int:
    """Where two leaves explain most of the gradients ``g`` of weights ``h``; 0 for nowhere."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    found = np.where(
        (left_h >= LEAST) & (right_h >= LEAST), gain(left_g, left_h) + gain(right_g, right_h), -1.0
    )
    best = int(found.argmax()) if len(found) else 0
    return best + 1 if len(found) and found[best] > gain(g.sum(), h.sum()) else 0


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Value per bin of a tree of at most four leaves."""
    first = cut(g, h)
    borders = {0, len(g), first}
    if first:
        borders |= {cut(g[:first], h[:first]), first + cut(g[first:], h[first:])}
    at = sorted(borders)[:-1]
    value = np.add.reduceat(g, at) / (np.add.reduceat(h, at) + RIDGE)
    return np.repeat(value, np.diff([*at, len(g)]))


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Value per cell of the better tree that cuts one feature, then the other on either side;
    and what it explains."""
    best, most = np.zeros_like(g), 0.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        first = cut(a.sum(axis=1), b.sum(axis=1)) or len(a)
        value, own = np.zeros_like(a), -gain(a.sum(), b.sum())
        for side in (slice(0, first), slice(first, len(a))):
            if side.start == side.stop:
                continue
            second = cut(a[side].sum(axis=0), b[side].sum(axis=0)) or a.shape[1]
            for part in (slice(0, second), slice(second, a.shape[1])):
                sum_g, sum_h = a[side, part].sum(), b[side, part].sum()
                value[side, part] = sum_g / (sum_h + RIDGE)
                own += gain(sum_g, sum_h)
        if own > most:
            best, most = value.T if turned else value, own
    return best, most


def borders(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit(x: np.ndarray, label: np.ndarray) -> Model:
    """Cyclic boosting of the logistic loss. Without rows the score is a half; with one label
    only it is that label's smoothed share."""
    label = label.astype(np.float64)
    n, ones = len(label), label.sum()
    model = Model(float(np.log((ones + 1) / (n - ones + 1))))
    if n == 0 or ones in (0, n):
        return model
    width = x.shape[1]
    model.edges = [borders(x[:, f], BINS) for f in range(width)]
    model.coarse = [borders(x[:, f], PAIR_BINS) for f in range(width)]
    fine = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.coarse)]
    model.tables = np.zeros((width, BINS))
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return label - p, np.maximum(p * (1 - p), 1e-9)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            step = RATE * tree(np.bincount(fine[f], g, BINS), np.bincount(fine[f], h, BINS))
            model.tables[f] += step
            total += step[fine[f]]

    def cells(i: int, j: int, values: np.ndarray) -> np.ndarray:
        size = PAIR_BINS * PAIR_BINS
        return np.bincount(rough[i] * PAIR_BINS + rough[j], values, size).reshape(PAIR_BINS, -1)

    g, h = slopes()
    explained = {
        pair: pair_tree(cells(*pair, g), cells(*pair, h))[1] for pair in combinations(range(width), 2)
    }
    model.pairs = sorted(sorted(explained, key=explained.get)[-PAIRS:])
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * pair_tree(cells(i, j, g), cells(i, j, h))[0]
            model.pair_tables[k] += step
            total += step[rough[i], rough[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """A model of at most ``most`` labelled rows that are not held out, drawn by a uniform hash
    of the doc_id. Only features and labels of the drawn rows come to the driver."""
    labelled = labels.where(
        F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    ).select(
        F.col("doc_id").cast("long").alias("label_id"),
        (F.col("quality") == 1).alias("label"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("draw"),
    )
    n = labelled.count()
    # about a quarter more than needed meet for the draw, at most
    share = min(1.0, 1.25 * most / max(n, 1))
    low = F.pmod("draw", F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))
    drawn = labelled.where(low).orderBy("draw", "label_id", "label").limit(most)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("label_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).join(F.broadcast(drawn), "label_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, "text"):
            yield pd.DataFrame(
                {"draw": batch["draw"], "label": batch["label"], "x": list(described(batch["text"]))}
            )

    # repeated rows of one doc_id may be more than were drawn
    rows = (
        texts.select("draw", "label", "text")
        .mapInPandas(features, "draw long, label boolean, x array<double>")
        .orderBy("draw", "label", "x")
        .limit(most)
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy(bool))


def assess(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The model learns from text and ``labels.quality`` of documents that are not held out; a
    score sees the whole text alone. A null text is the empty one; a null doc_id or quality is
    never learned from; several labels of a document each count. Without labels every score is
    a half, with one label only its share. Equal texts score alike; empty tables give no row;
    other columns are ignored.
    """
    model = train(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, "text"):
            found = shared.value.scores(described(batch["text"]))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "held_out": batch["held_out"],
                    "score": found,
                    "predicted": (found >= THRESHOLD).astype(np.int32),
                }
            )

    return rows.mapInPandas(score, RESULT)
