"""Hashes of words and windows in numpy, and the search for signatures in several documents.

Signatures are 64-bit hashes. A map task deals those of a block of documents into ranges
and sends one row per block and range, not one per signature; the task of a range sorts
its numbers and keeps those of two documents or more. A signature that many documents of a
block hold is sent once with its count, and its documents go to a side group per block, so
no task gathers the documents of a frequent signature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import input_bytes, stored

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
NO_ID = -(2**63)
#: White space of the word pattern: the space and \x09 to \x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Signatures a map task holds before it sends them.
BLOCK_SIGNATURES = 500_000
#: Input bytes per range; a range's numbers are sorted in one task.
RANGE_BYTES = 4 << 20
#: Documents of a block from which a signature counts as frequent.
FREQUENT = 8

MAIL = "range int, side long, sigs binary, counts binary, docs binary, per_doc binary"
FOUND = "sig long, doc_id long, df long"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, as long as the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


POWERS = Powers()


class Words:
    """Words of several texts: hash, first and last byte, and each text's first word."""

    def __init__(self, texts: list[str], lower: bool = False):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(encoded)
        if lower:
            data = data.translate(LOWER)
        self.data = data
        codes = np.frombuffer(data, np.uint8)
        space = SPACES[codes]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = POWERS.upto(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        sizes = np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded))
        self.base = np.cumsum(sizes) - sizes
        self.first = np.append(np.searchsorted(self.start, self.base), len(self.start))


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` hashes in a row."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * BASE + hashes[j : j + size]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, in log2(width) passes."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the stretches of equal values."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    bounds = [0, *edges.tolist(), len(values)] if len(values) else []
    return list(zip(bounds, bounds[1:], strict=False))


def numbers(sigs: np.ndarray) -> bytes:
    """The low 48 bits; the range of a row is in the upper ones."""
    return (sigs & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (
        (sigs >> np.uint64(32)) & np.uint64(0xFFFF)
    ).astype("<u2").tobytes()


def from_numbers(data: bytes) -> np.ndarray:
    n = len(data) // 6
    low = np.frombuffer(data, "<u4", n).astype(np.uint64)
    return low | (np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def ranges_for(docs: DataFrame) -> int:
    """A power of two, in proportion to the input."""
    return 1 << max(4, (input_bytes(docs) // RANGE_BYTES).bit_length())


def long_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether two rows share a doc_id."""
    per_id = docs.groupBy(long_id().alias("doc_id")).count()
    return (per_id.agg(F.max("count")).first()[0] or 0) > 1


def rows_of(docs: DataFrame, repeated: bool) -> DataFrame:
    """doc_id, text, and ``row``: a hash of both if ids are repeated, else the doc_id, which
    packs better."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.xxhash64(long_id(), text) if repeated else long_id()
    return docs.select(long_id().alias("doc_id"), row.alias("row"), text.alias("text"))


class Sender:
    """Collects a task's signatures and deals them out in blocks.

    A document counts up to ``per_doc`` times for a signature.
    """

    def __init__(self, ranges: int, per_doc: int = 1):
        self.ranges, self.per_doc = ranges, per_doc
        self.shift = np.uint64(64 - (ranges.bit_length() - 1))
        self.task = TaskContext.get().partitionId()
        self.sigs: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.held = self.blocks = 0

    def add(self, sigs: np.ndarray, docs: np.ndarray) -> Iterator[pd.DataFrame]:
        """``docs`` has the document of each signature."""
        self.sigs.append(key_of(sigs, self.ranges))
        self.docs.append(docs)
        self.held += len(sigs)
        if self.held >= BLOCK_SIGNATURES:
            yield self.send()

    def send(self) -> pd.DataFrame:
        rows: list[tuple] = []
        if self.held:
            sigs, docs = np.concatenate(self.sigs), np.concatenate(self.docs)
            self.sigs, self.docs, self.held = [], [], 0
            order = np.lexsort((docs, sigs))
            sigs, docs = sigs[order], docs[order]
            again = np.zeros(len(sigs), bool)
            k = self.per_doc
            again[k:] = (sigs[k:] == sigs[:-k]) & (docs[k:] == docs[:-k])
            sigs, docs = sigs[~again], docs[~again]
            begin = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
            counts = np.diff(np.append(begin, len(sigs)))
            often = np.repeat(counts >= FREQUENT, counts)
            self.blocks += 1
            rows += self._light(sigs[~often], docs[~often])
            rows += self._frequent(sigs[begin], counts, sigs[often], docs[often])
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MAIL.split(", ")])

    def _light(self, sigs: np.ndarray, docs: np.ndarray) -> Iterator[tuple]:
        """By range, in the order of documents: numbers, documents, numbers per document."""
        parts = (sigs >> self.shift).astype(np.int64)
        order = np.lexsort((docs, parts))
        sigs, docs, parts = sigs[order], docs[order], parts[order]
        for a, b in runs(parts):
            own = docs[a:b]
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            per_doc = np.diff(np.append(begin, b - a)).astype("<u4")
            yield (
                int(parts[a]), -1, numbers(sigs[a:b]), None,
                own[begin].astype("<i8").tobytes(), per_doc.tobytes(),
            )

    def _frequent(self, each, counts, sigs, docs) -> Iterator[tuple]:
        """Counts to the range of the signature, its documents to a side group
        of this block alone, which is only unpacked there."""
        each, counts = each[counts >= FREQUENT], counts[counts >= FREQUENT]
        parts = (each >> self.shift).astype(np.int64)
        for a, b in runs(parts):
            yield (
                int(parts[a]), -1, numbers(each[a:b]), counts[a:b].astype("<u4").tobytes(),
                None, None,
            )
        if len(sigs):
            yield (
                -1, self.task << 32 | self.blocks, sigs.astype("<u8").tobytes(), None,
                docs.astype("<i8").tobytes(), None,
            )


def _frame(sigs: np.ndarray, docs, df) -> pd.DataFrame:
    # numpy arrays with masks: pandas would turn missing longs into floats
    n = len(sigs)
    return pd.DataFrame(
        {
            "sig": sigs.view(np.int64),
            "doc_id": pd.array([pd.NA] * n, "Int64") if docs is None else pd.array(docs, "Int64"),
            "df": pd.array([pd.NA] * n, "Int64") if df is None else pd.array(df, "Int64"),
        }
    )


def _reduce(ranges: int, once: bool) -> Callable:
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def reduce(key: tuple, mail: pd.DataFrame) -> pd.DataFrame:
        part, side = key
        if side >= 0:
            sigs = np.concatenate([np.frombuffer(s, "<u8") for s in mail["sigs"]])
            docs = np.concatenate([np.frombuffer(d, "<i8") for d in mail["docs"]])
            return _frame(sigs, docs, None)
        light = mail[mail["docs"].notna()]
        many = mail[mail["docs"].isna()]
        empty = [np.zeros(0, np.uint64)]
        sigs = np.concatenate([from_numbers(s) for s in light["sigs"]] or empty)
        docs = np.concatenate(
            [
                np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(p, "<u4"))
                for d, p in zip(light["docs"], light["per_doc"], strict=True)
            ]
            or [np.zeros(0, np.int64)]
        )
        order = np.lexsort((docs, sigs)) if once else np.argsort(sigs, kind="stable")
        sigs, docs = sigs[order], docs[order]
        if once and len(sigs):
            fresh = np.append(True, (sigs[1:] != sigs[:-1]) | (docs[1:] != docs[:-1]))
            sigs, docs = sigs[fresh], docs[fresh]
        if len(many):
            often = np.concatenate([from_numbers(s) for s in many["sigs"]])
            extra = np.concatenate([np.frombuffer(c, "<u4") for c in many["counts"]])
            often, back = np.unique(often, return_inverse=True)
            extra = np.bincount(back, extra).astype(np.int64)
        else:
            often, extra = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        each, counts = np.unique(sigs, return_counts=True)
        total = counts.astype(np.int64)
        here = np.searchsorted(often, each)
        if len(often):
            hit = often[np.minimum(here, len(often) - 1)] == each
            total[hit] += extra[here[hit]]
        wide = np.repeat(total, counts)
        shared = wide > 1
        top = np.uint64(part) << shift
        out = [_frame(sigs[shared] | top, docs[shared], wide[shared])]
        if len(often):
            own = np.searchsorted(each, often)
            own_count = np.zeros(len(often), np.int64)
            if len(each):
                hit = each[np.minimum(own, len(each) - 1)] == often
                own_count[hit] = counts[own[hit]]
            out.append(_frame(often | top, None, extra + own_count))
        return pd.concat(out, ignore_index=True)

    return reduce


def key_of(sigs: np.ndarray, ranges: int) -> np.ndarray:
    """What stands for a signature after the search: its range and its low 48 bits."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    return ((sigs >> shift) << shift) | (sigs & np.uint64(0xFFFFFFFFFFFF))


def shared(mail: DataFrame, ranges: int, once: bool = False) -> DataFrame:
    """Signatures in two documents or more: stored rows (sig, doc_id, df).

    ``df`` is the same in all rows of a signature. ``mail`` comes from ``Sender``; ``sig`` is
    what ``key_of`` makes of a signature; a document counts once per block for a signature,
    or, with ``once``, once in all unless it is in a block where the signature is frequent.
    """
    found = mail.groupBy("range", "side").applyInPandas(_reduce(ranges, once), FOUND)
    raw = stored(found, "shared")
    light = raw.where(F.col("doc_id").isNotNull() & F.col("df").isNotNull())
    frequent = raw.where(F.col("df").isNull()).select("sig", "doc_id").distinct()
    counts = raw.where(F.col("doc_id").isNull()).select("sig", "df")
    return light.unionByName(stored(frequent.join(counts, "sig"), "frequent"))
