"""Fingerprints of Lempel-Ziv phrases.

A text is parsed into the phrases of an incremental dictionary (each phrase is a known one
plus one character). The fingerprint holds the least hashes of the phrase set, and the
likeness of two fingerprints estimates the overlap of their sets, which follows how well
one text compresses with the other's dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import input_bytes

HASHES = 128
#: A phrase ends here at the latest, which keeps the parse linear in the text.
PHRASE_CHARS = 64
BUCKET_BYTES = 8 << 20
FIRST = -(2**63)
BASE = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def phrase_ends(text: str, known: set[str]) -> list[int]:
    """End of each phrase; ``known`` is the dictionary so far and grows."""
    ends: list[int] = []
    phrase = ""
    for i, char in enumerate(text, 1):
        phrase += char
        if phrase not in known:
            known.add(phrase)
            ends.append(i)
            phrase = ""
        elif len(phrase) == PHRASE_CHARS:
            ends.append(i)
            phrase = ""
    if phrase:
        ends.append(len(text))
    return ends


class PhraseHasher:
    """Hashes of phrases from one running polynomial over the text."""

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            for name, base in (("powers", BASE), ("inverse", np.uint64(pow(int(BASE), -1, 2**64)))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def least(self, text: str, ends: list[int]) -> np.ndarray:
        """The HASHES least distinct 32-bit hashes of the phrases, sorted."""
        if not ends:
            return np.zeros(0, np.uint32)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self._grow(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.powers[: len(codes)], out=sums[1:])
        stop = np.array(ends)
        start = np.concatenate([[0], stop[:-1]])
        value = (sums[stop] - sums[start]) * self.inverse[start]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            value = (value ^ (value >> np.uint64(shift))) * np.uint64(factor)
        return np.unique((value >> np.uint64(32)).astype(np.uint32))[:HASHES]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the least of both; 1 for two empty texts."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:HASHES]
    return float(np.isin(both, np.intersect1d(a, b), assume_unique=True).sum() / len(both))


def shown(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half gives way to as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Parsed:
    """A document's phrases, and those of its edited text, which begin alike."""

    def __init__(self, text: str, hasher: PhraseHasher):
        self.text, self.hasher = text, hasher
        self.ends = phrase_ends(text, set())
        self.hashes = hasher.least(text, self.ends)

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        other = edited(self.text, following)
        cut = len(self.text) - len(self.text) // 2
        ends = [end for end in self.ends if end <= cut and end < len(self.text)]
        starts = [0, *ends]
        known = {self.text[a:b] for a, b in zip(starts, ends, strict=False)}
        ends += [starts[-1] + end for end in phrase_ends(other[starts[-1] :], known)]
        return other, self.hasher.least(other, ends)


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint and that of its edited text, compared.

    The next document is the next row by doc_id, then text; the first follows the last. A
    null doc_id comes before all others; a null text is empty, and an empty text has an
    empty fingerprint. Texts are parsed whole; equal texts have equal fingerprints; an
    empty table gives no row; other columns are ignored.

    Rows meet their next one in buckets of neighbouring ids. The first row of each bucket
    is copied to the bucket before, so the text is shuffled once and a task holds two.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    buckets = max(2, input_bytes(docs) // BUCKET_BYTES)
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.agg(
        F.percentile_approx("doc_id", shares, 20 * buckets).alias("borders"),
        F.min("doc_id").alias("first"),
    ).first()
    borders = np.unique(np.array(found["borders"] or [], np.int64))
    first, last = found["first"], len(borders)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(borders, ids.to_numpy(np.int64), side="right").tolist()
        return pd.Series(
            [
                [b, *([b - 1] if starts and b else []), *([last] if i == first else [])]
                for b, i, starts in zip(own, ids, np.isin(ids, borders), strict=True)
            ]
        )

    placed = (
        rows.select("doc_id", "text", F.posexplode(places("doc_id")).alias("copy", "bucket"))
        .withColumn("copy", F.col("copy") > 0)
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "copy", "doc_id", "text")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = PhraseHasher()
        bucket = own = own_id = None
        for batch in batches:
            out = []
            for doc_id, text, copy, place in zip(
                batch["doc_id"], batch["text"], batch["copy"], batch["bucket"], strict=True
            ):
                if place != bucket:
                    bucket, own = place, None
                if own is None and copy:
                    continue  # a further copy, or one in a bucket without rows
                following = Parsed(text, hasher)
                if own is not None:
                    other, hashes = own.edited(text)
                    out.append(
                        (
                            None if own_id == FIRST else own_id,
                            len(own.text),
                            hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
                            shown(own.hashes),
                            shown(hashes),
                            likeness(own.hashes, hashes),
                            likeness(own.hashes, following.hashes),
                        )
                    )
                own, own_id = (None if copy else following), doc_id
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    return placed.mapInPandas(compare, COLUMNS)
