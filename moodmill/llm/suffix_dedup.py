"""Removal of byte strings that come earlier, by suffix arrays of difference-cover order.

Reference shards are the spans of anchors (see anchors.py), dealt out over the cluster. A
task joins spans to a text and sorts its suffixes with the cover {1, 2} of the residues
modulo 3: triples at covered places are sorted and named, the names' own suffixes are
sorted in the same way, and the other suffixes, a byte and a named rest, are merged in.
Then neighbours in the array that agree in their first bytes are one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.anchors import FIRSTS, Repeats, Symbols, covered
from moodmill.llm.signatures import NO_ID, mix
from moodmill.llm.substring_dedup import shards

WINDOW, GRAM = 100, 32
#: Bytes of spans that a suffix array is built over, so that its numbers stay in a core's
#: cache; more only for one anchor's spans.
ARRAY_BYTES = 1 << 17
COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class ByteSymbols(Symbols):
    def __init__(self, texts: list[str]):
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"".join(encoded)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.hash = BYTE_HASH[np.frombuffer(self.data, np.uint8)]

    def content(self, a: int, b: int) -> bytes:
        return self.data[a:b]


#: Symbols and ranks of one array fit into so many bits, three of them into a number.
BITS = 21


def packed(*keys: np.ndarray) -> np.ndarray:
    out = keys[0]
    for key in keys[1:]:
        out = (out << BITS) | key
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (positive numbers) in their order."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    if n + 3 >= 1 << BITS:
        raise ValueError("a text is too long for one suffix array")
    padded = np.concatenate([text, np.zeros(3, np.int64)])
    ones, twos, rest = (np.arange(r, n + (n % 3 == 1 and r == 1), 3) for r in (1, 2, 0))
    cover = np.concatenate([ones, twos])
    triples = packed(padded[cover], padded[cover + 1], padded[cover + 2])
    order = np.argsort(triples)
    triples = triples[order]
    new = np.ones(len(order), np.int64)
    new[1:] = triples[1:] != triples[:-1]
    if not new.all():
        names = np.empty(len(order), np.int64)
        names[order] = np.cumsum(new)
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[cover[order]] = np.arange(1, len(order) + 1)
    cover = cover[order]
    cover = cover[cover < n]
    rest = rest[np.argsort(packed(padded[rest], rank[rest + 1]))]

    # a suffix outside the cover is compared by one symbol with residue 1, by two with residue 2
    ones, twos = cover[cover % 3 == 1], cover[cover % 3 == 2]
    place = np.arange(len(rest))
    place += np.searchsorted(
        packed(padded[ones], rank[ones + 1]), packed(padded[rest], rank[rest + 1])
    )
    place += np.searchsorted(
        packed(padded[twos], padded[twos + 1], rank[twos + 2]),
        packed(padded[rest], padded[rest + 1], rank[rest + 2]),
    )
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place], out[free] = rest, cover
    return out


def first_places(rows: list[tuple]) -> Iterator[tuple]:
    """Per span the runs of its windows with one first document and start (less the window's
    number) among all spans: (end of the run, first document, first start) as three lists.

    One anchor's spans that do not fit into an array, as a text can hold that stands on one
    anchor throughout, are looked up window by window.
    """
    if sum(len(r[0]) + 1 for r in rows) + 3 >= 1 << BITS:
        seen: dict[bytes, tuple] = {}
        for content, doc, start, _ in rows:
            for j in range(len(content) - WINDOW + 1):
                own = content[j : j + WINDOW]
                seen[own] = min(seen.get(own, (doc, start + j)), (doc, start + j))
        for content, *_ in rows:
            ends, found = [], []
            for j in range(len(content) - WINDOW + 1):
                first_doc, first_start = seen[content[j : j + WINDOW]]
                if found and found[-1] == (first_doc, first_start - j):
                    ends[-1] = j + 1
                else:
                    ends.append(j + 1)
                    found.append((first_doc, first_start - j))
            yield ends, [f[0] for f in found], [f[1] for f in found]
        return
    sizes = np.fromiter((len(r[0]) + 1 for r in rows), np.int64, len(rows))
    data = np.frombuffer(b"\0".join(r[0] for r in rows) + b"\0", np.uint8)
    text = data.astype(np.int64) + 2
    base = np.cumsum(sizes) - sizes
    text[base + sizes - 1] = 1  # between spans
    offset = np.arange(len(text)) - np.repeat(base, sizes)
    full = offset + WINDOW < np.repeat(sizes, sizes)
    doc = np.repeat(np.fromiter((r[1] for r in rows), np.int64, len(rows)), sizes)
    start = np.repeat(np.fromiter((r[2] for r in rows), np.int64, len(rows)), sizes) + offset

    order = suffix_array(text)
    order = order[full[order]]
    new = np.ones(len(order), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    for a in range(1, len(order), 1 << 16):
        b = min(a + (1 << 16), len(order))
        new[a:b] = (view[order[a:b]] != view[order[a - 1 : b - 1]]).any(axis=1)
    group = np.cumsum(new) - 1
    earliest = np.lexsort((start[order], doc[order], group))
    heads = order[earliest[np.flatnonzero(new)]]
    head = np.empty(len(text), np.int64)
    head[order] = heads[group]

    at = np.flatnonzero(full)
    offset, head = offset[at], head[at]
    first_doc, first_start = doc[head], start[head] - offset
    begin = offset == 0
    begin[1:] |= (first_doc[1:] != first_doc[:-1]) | (first_start[1:] != first_start[:-1])
    run = np.flatnonzero(begin)
    ends = offset[np.append(run[1:], len(at)) - 1] + 1
    cuts = np.append(np.flatnonzero(offset[run] == 0), len(run)).tolist()
    ends, first_doc, first_start = ends.tolist(), first_doc[run].tolist(), first_start[run].tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield ends[a:b], first_doc[a:b], first_start[a:b]


def first_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrays over the spans of several anchors; one anchor's spans stay together."""
    names = [c.split()[0] for c in FIRSTS.split(", ")]
    out, held, size = [], [], 0

    def resolve(rows: list[tuple]) -> None:
        for (content, doc, start, last), found in zip(rows, first_places(rows), strict=True):
            # what stands once, and first, is removed nowhere
            if last != (doc, start) or found[1] != [doc] or found[2] != [start]:
                out.append((hashlib.md5(content).digest(), *found))

    for rows in shards(batches):
        if len(rows) == 1:  # alone, a span comes first where its first copy stands
            content, doc, start, last = rows[0]
            if last != (doc, start):
                own = [len(content) - WINDOW + 1], [doc], [start]
                out.append((hashlib.md5(content).digest(), *own))
        else:
            own = sum(len(r[0]) + 1 for r in rows)
            if size + own > ARRAY_BYTES and held:
                resolve(held)
                held, size = [], 0
            held += rows
            size += own
        if len(out) >= 2000:
            yield pd.DataFrame(out, columns=names)
            out = []
    if held:
        resolve(held)
    yield pd.DataFrame(out, columns=names)


def kept_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        columns = [batch[c] for c in ("doc_id", "text", "begins", "ends")]
        for doc_id, text, begins, ends in zip(*columns, strict=True):
            data = text.encode("utf-8", "surrogatepass")
            n, runs, kept = len(data), 0, data
            if begins is not None:
                gone = covered(n, begins, ends, WINDOW)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
            out.append((doc_id, n, n - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte in a string of 100 bytes that starts earlier, in a smaller doc_id or before
    in the same text, is removed; n_spans counts the removed runs. A null text is empty.
    Texts of one doc_id count as one document, each from its own start. A null doc_id
    counts as the least; an empty table gives no row; other columns are ignored.
    """
    found = Repeats(docs, ByteSymbols, first_strings, WINDOW, GRAM, within=True)
    kept = found.kept(kept_bytes, COLUMNS)
    return kept.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
