"""Repeated windows of documents, found by content-defined anchors.

An anchor of a window is its gram with the least hash. Equal windows have equal anchors,
so a window can only be repeated if its anchor stands in two places, and every place where
its content may be found again is among the places of that anchor. A span is a run of
windows with one anchor; equal spans are one, with their first place, and the spans of an
anchor form a reference shard, in which a caller looks up where each window comes first.

A frequent anchor could bring any number of spans together. Its windows are spans of their
own, so only equal windows meet, and those are one after partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import discard, let_go, pieces, stored
from moodmill.llm.signatures import (
    MAIL,
    POWERS,
    Sender,
    combine,
    ids_repeat,
    key_of,
    mix,
    ranges_for,
    rows_of,
    shared,
    sliding_min,
)

#: Places of an anchor from which its windows are spans of their own.
FREQUENT = 5000
#: Contents a task holds before it sends them.
HELD_CONTENTS = 100_000
#: Rows of contents that go to the JVM at once.
SENT_ROWS = 10_000
PLACE_BITS = np.uint64(28)
#: Characters whose symbols are worked on at once, so that their numbers stay in a core's cache.
PIECE = 1 << 18

#: Places of spans (doc_id, start, digest, row), and among them the contents a task has seen,
#: without a digest, with their first and last place in that task.
SPANS = (
    "doc_id long, start long, digest binary, sig long, part long, content binary, "
    "last_doc long, last_start long, row long"
)
SHARD = (
    "sig long, part long, content binary, doc_id long, start long, last_doc long, last_start long"
)
SPANS_ARROW = pa.schema(
    [(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in SPANS.split(", ")]
)
#: Per run of a span's windows, as far as ``ends``, their first document and place there, less
#: the window's number in the span, so that a run is what is found in one place.
FIRSTS = "digest binary, ends array<long>, first_doc array<long>, first_start array<long>"


class Symbols:
    """Texts of a batch as one row of symbols.

    ``hash`` has a symbol's hash, ``first`` the first symbol of each text and the end of
    the last, and ``content(a, b)`` the exact content of symbols a to b.
    """

    hash: np.ndarray
    first: np.ndarray

    def content(self, a: int, b: int) -> bytes:
        raise NotImplementedError


class Anchors:
    """Runs of windows with one anchor: text, first window, number of windows, hash."""

    def __init__(self, symbols: Symbols, window: int, gram: int):
        grams = combine(symbols.hash, gram) if gram <= 16 else rolled(symbols.hash, gram)
        wide = window - gram + 1
        n = max(0, len(symbols.hash) - window + 1)
        places = np.arange(len(grams), dtype=np.uint64)
        ordered = (grams >> PLACE_BITS << PLACE_BITS) | places
        least = sliding_min(ordered, wide)[:n]
        at = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        count = np.diff(symbols.first)
        row = np.repeat(np.arange(len(count)), count)
        inside = np.flatnonzero(row[:n] == row[window - 1 : window - 1 + n])
        at, own = at[inside], row[:n][inside]
        fresh = np.ones(len(inside), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
        begin = np.flatnonzero(fresh)
        self.row = own[begin]
        self.window = inside[begin]  # in the row of symbols of the batch
        self.windows = np.diff(np.append(begin, len(inside)))
        self.hash = grams[at[begin]]


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` hashes in a row, from differences of running sums."""
    size = max(0, len(hashes) - n + 1)
    up, down = POWERS.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n : n + size] - sums[:size]) * down[:size])


class Repeats:
    """The search over one table of documents.

    Anchors, spans and removals belong to a text of a doc_id, so that rows of one doc_id keep
    theirs apart; the doc_id itself only tells which document comes first.
    ``symbols`` makes Symbols of texts, ``lookup`` maps the rows of a shard (SHARD, equal
    anchors together) to the first places of their windows (FIRSTS), and ``within`` tells
    whether a repeat inside a document counts.
    """

    def __init__(
        self,
        docs: DataFrame,
        symbols: Callable[[list[str]], Symbols],
        lookup: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
        window: int,
        gram: int,
        within: bool,
    ):
        self.repeated = ids_repeat(docs)
        self.docs, self.symbols, self.lookup = rows_of(docs, self.repeated), symbols, lookup
        self.window, self.gram, self.within = window, gram, within
        self.ranges = ranges_for(docs)

    def _anchors(self) -> DataFrame:
        ranges, symbols, window, gram = self.ranges, self.symbols, self.window, self.gram
        within = self.within

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sender = Sender(ranges, per_doc=2 if within else 1)
            for batch in pieces(batches, "text", PIECE):
                anchors = Anchors(symbols(batch["text"].tolist()), window, gram)
                ids = batch["row"].to_numpy(np.int64)
                yield from sender.add(anchors.hash, ids[anchors.row])
            yield sender.send()

        return shared(self.docs.mapInPandas(send, MAIL), ranges)

    def _spans(self) -> DataFrame:
        ranges, symbols, window, gram = self.ranges, self.symbols, self.window, self.gram
        found = self._anchors()
        per_doc = stored(
            found.groupBy(F.col("doc_id").alias("row")).agg(
                F.collect_set("sig").alias("sigs"),
                F.collect_set(F.when(F.col("df") >= FREQUENT, F.col("sig"))).alias("frequent"),
            ),
            "anchors",
        )
        discard(found)

        def table(**columns) -> pa.RecordBatch:
            n = len(columns["doc_id"])
            arrays = [
                pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
                for f in SPANS_ARROW
            ]
            return pa.RecordBatch.from_arrays(arrays, schema=SPANS_ARROW)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[bytes, list] = {}

            def contents() -> Iterator[pa.RecordBatch]:
                sig, part, content, first, last = zip(*held.values()) if held else [()] * 5
                doc_id, start = zip(*first) if held else [()] * 2
                last_doc, last_start = zip(*last) if held else [()] * 2
                found = table(
                    doc_id=doc_id, start=start, sig=sig, part=part, content=content,
                    last_doc=last_doc, last_start=last_start,
                )
                held.clear()
                for at in range(0, len(doc_id), SENT_ROWS):
                    yield found.slice(at, SENT_ROWS)

            for batch in pieces((b.to_pandas() for b in batches), "text", PIECE):
                read = symbols(batch["text"].tolist())
                anchors = Anchors(read, window, gram)
                keys = key_of(anchors.hash, ranges).view(np.int64).tolist()
                at, sizes = anchors.window.tolist(), anchors.windows.tolist()
                cuts = np.searchsorted(anchors.row, np.arange(len(batch) + 1)).tolist()
                docs, rows, starts, digests = [], [], [], []
                for i, (doc_id, row, sigs, frequent) in enumerate(
                    zip(
                        batch["doc_id"].tolist(), batch["row"].tolist(),
                        batch["sigs"], batch["frequent"], strict=True,
                    )
                ):
                    known, single = set(sigs.tolist()), set(frequent.tolist())
                    base, before = int(read.first[i]), len(digests)
                    for k in range(cuts[i], cuts[i + 1]):
                        sig = keys[k]
                        if sig not in known:
                            continue
                        a, n = at[k], sizes[k]
                        runs = [(j, 1) for j in range(a, a + n)] if sig in single else [(a, n)]
                        for a, size in runs:
                            content = read.content(a, a + size + window - 1)
                            digest = hashlib.md5(content).digest()
                            place = (doc_id, a - base)
                            seen = held.get(digest)
                            if seen is None:
                                part = 0
                                if sig in single:
                                    part = int.from_bytes(digest[:8], "little", signed=True)
                                held[digest] = [sig, part, content, place, place]
                            elif place < seen[3]:
                                seen[3] = place
                            elif place > seen[4]:
                                seen[4] = place
                            starts.append(a - base)
                            digests.append(digest)
                    docs += [doc_id] * (len(digests) - before)
                    rows += [row] * (len(digests) - before)
                yield table(doc_id=docs, row=rows, start=starts, digest=digests)
                if len(held) >= HELD_CONTENTS:
                    yield from contents()
            yield from contents()

        spans = stored(self.docs.join(per_doc, "row").mapInArrow(cut, SPANS), "spans")
        discard(per_doc)
        return spans

    def removals(self) -> DataFrame:
        """Stored (doc_id, row, begins, ends): runs of windows that come earlier elsewhere."""
        spans = self._spans()
        shards = (
            spans.where(F.col("content").isNotNull())
            .select(*[c.split()[0] for c in SHARD.split(", ")])
            .repartition("sig", "part")
            .sortWithinPartitions("sig", "part")
        )
        firsts = stored(shards.mapInPandas(self.lookup, FIRSTS), "firsts")
        del shards  # or its shuffle stays
        earlier = "first_doc[i] < doc_id"
        if self.within:
            earlier += " OR (first_doc[i] = doc_id AND first_start[i] < start)"
        gone = (
            f"transform(filter(sequence(0, size(ends) - 1), i -> {earlier}), i -> "
            "struct(start + IF(i = 0, 0L, ends[i - 1]) AS begin, start + ends[i] AS end))"
        )
        places = spans.where(F.col("content").isNull()).select("doc_id", "row", "start", "digest")
        if self.repeated:
            places = places.distinct()  # equal rows have equal places
        marked = (
            places.join(firsts, "digest")
            .select("doc_id", "row", F.expr(gone).alias("gone"))
            .where("size(gone) > 0")
        )
        per_doc = marked.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("gone")).alias("gone"))
        found = stored(
            per_doc.select(
                "doc_id", "row", F.col("gone.begin").alias("begins"), F.col("gone.end").alias("ends")
            ),
            "removals",
        )
        discard(spans, firsts)
        return found

    def kept(self, finish: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str):
        """``finish`` gets every document's doc_id and text, and its removals or null."""
        removals = self.removals()
        let_go(self.docs.sparkSession)
        joined = self.docs.join(removals, ["doc_id", "row"], "left")
        return joined.mapInPandas(finish, schema)


def covered(n: int, begins: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` symbols stand in a window from ``begins`` on and before ``ends``."""
    edge = np.bincount(begins, minlength=n + 1) - np.bincount(ends + (window - 1), minlength=n + 1)
    return np.cumsum(edge)[:n] > 0
