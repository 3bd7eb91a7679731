"""Divergence of sources within a language, by stripes folded inside the mappers.

A task folds its whole documents into one stripe per term: in how many documents it stands
and how often in each source. Full stripes are handed to the shuffle and merged by term. From
the merged stripes come the totals of every group, and with those the divergences, in 64-bit
integers throughout.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodmill.llm.common import CHUNK_BYTES, input_bytes, stored

#: Documents of a language that a kept term stands in at least.
LEAST_DOCS = 3
#: Rows of part ``term`` per group.
TERMS = 200
#: Cells of stripes that a mapper holds before it hands them on.
HELD_CELLS = 2_000_000
#: Cells of merged stripes that are scored at once; sums of pairs that a task holds.
BLOCK_CELLS, HELD_SUMS = 100_000, 2_000_000
#: Stored bytes of merged stripes per scoring task.
TASK_BYTES = 4 << 20
SHARE = 1_000_000_000

#: Letters of terms, A-Z as a-z; every other ASCII character parts terms.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)
)
STRIPES = "lang string, term string, docs long, sources array<string>, counts array<long>"
NAMES = [part.split()[0] for part in STRIPES.split(", ")]
PARTS = "lang string, source string, part string, item string, value long"


def terms_of(text: str, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Terms of a text in lists of about ``most`` bytes, so a long text is never held as terms."""
    folded = text.encode("utf-8", "surrogatepass").translate(FOLD)
    start = 0
    while start < len(folded):
        end = len(folded) if start + most >= len(folded) else folded.find(b" ", start + most)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


class Stripes:
    """Hashed terms, and cells (term, group, count) of the documents read so far."""

    def __init__(self):
        self.terms: defaultdict[bytes, int] = defaultdict()
        self.terms.default_factory = self.terms.__len__
        self.none = self.terms[b""]
        self.groups: dict[tuple[str, str], int] = {}
        self.cells: list[np.ndarray] = []
        self.held = 0

    def add(self, lang: str, source: str, text: str) -> None:
        """One cell per term of the document; the empty term, never counted, names its group."""
        group = self.groups.setdefault((lang, source), len(self.groups))
        code, n = np.array([self.none]), np.zeros(1, np.int64)
        for terms in terms_of(text):
            own = np.fromiter(map(self.terms.__getitem__, terms), np.int64, len(terms))
            own, place = np.unique(np.append(own, code), return_inverse=True)
            total = np.bincount(place[: len(terms)], minlength=len(own))
            total[place[len(terms) :]] += n
            code, n = own, total
        self.cells.append(np.stack([code, np.full(len(code), group), n]))
        self.held += len(code)

    def rows(self) -> pa.RecordBatch:
        langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in self.groups))}
        lang_of = np.array([langs[lang] for lang, _ in self.groups])
        code, group, n = np.concatenate(self.cells, axis=1)
        stripe = lang_of[group] * len(self.terms) + code
        order = np.argsort(stripe * len(self.groups) + group, kind="stable")
        stripe, group, n = stripe[order], group[order], n[order]
        first = np.flatnonzero(np.diff(stripe, prepend=-1))
        docs = np.diff(np.append(first, len(stripe)))
        cell = np.flatnonzero((np.diff(stripe, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
        which = stripe[first]
        names = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        return _batch(
            pa.array(list(langs)).take(pa.array(which // len(self.terms))),
            names.take(pa.array(which % len(self.terms))),
            docs,
            np.searchsorted(cell, first),
            pa.array([source for _, source in self.groups]).take(pa.array(group[cell])),
            np.add.reduceat(n, cell),
        )


def _batch(lang, term, docs, begins, sources, counts) -> pa.RecordBatch:
    """Rows of STRIPES; the cells of a stripe start at its place in ``begins``."""
    offsets = pa.array(np.append(begins, len(counts)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [lang, term, pa.array(docs.astype(np.int64)), pa.ListArray.from_arrays(offsets, sources),
         pa.ListArray.from_arrays(offsets, pa.array(counts))],
        names=NAMES,
    )


def fold(batches: Iterator[pa.RecordBatch], held: int = HELD_CELLS) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, text) to stripes, handed on when so many cells are held. The
    stripe of the empty term names the sources of a language."""
    stripes = Stripes()
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(3))):
            stripes.add(*(cell.as_py() for cell in row))
            if stripes.held >= held:
                yield from sliced(stripes.rows())
                stripes = Stripes()
    if stripes.cells:
        yield from sliced(stripes.rows())


def sliced(rows: pa.RecordBatch, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    for start in range(0, rows.num_rows, most):
        yield rows.slice(start, most)


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes sorted by language and term to one stripe each; terms of too few documents go."""
    open_ = None  # the last stripe, which may go on in the next batch
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if open_ is None else pa.concat_tables([open_, table])
        merged = merged_stripes(table.combine_chunks().to_batches()[0])
        yield kept(merged.slice(0, merged.num_rows - 1))
        open_ = pa.Table.from_batches([merged.slice(merged.num_rows - 1)])
    if open_ is not None:
        yield kept(open_.combine_chunks().to_batches()[0])


def merged_stripes(rows: pa.RecordBatch) -> pa.RecordBatch:
    lang, term, docs, sources, counts = (rows.column(i) for i in range(5))
    new = np.ones(rows.num_rows, bool)
    for column in (lang, term):
        same = pc.equal(column.slice(1), column.slice(0, rows.num_rows - 1))
        changed = ~same.to_numpy(zero_copy_only=False)
        new[1:] = changed if column is lang else changed | new[1:]
    first = np.flatnonzero(new)
    stripe = np.repeat(np.cumsum(new) - 1, pc.list_value_length(sources).to_numpy())
    coded = sources.flatten().dictionary_encode()
    source = coded.indices.to_numpy().astype(np.int64)
    n = counts.flatten().to_numpy()
    order = np.argsort(stripe * len(coded.dictionary) + source, kind="stable")
    stripe, source, n = stripe[order], source[order], n[order]
    cell = np.flatnonzero((np.diff(stripe, prepend=-1) != 0) | (np.diff(source, prepend=-1) != 0))
    return _batch(
        lang.take(pa.array(first)),
        term.take(pa.array(first)),
        np.add.reduceat(docs.to_numpy(), first),
        np.searchsorted(stripe[cell], np.arange(len(first))),
        coded.dictionary.take(pa.array(source[cell])),
        np.add.reduceat(n, cell),
    )


def kept(rows: pa.RecordBatch) -> pa.RecordBatch:
    often = pc.greater_equal(rows.column(2), LEAST_DOCS)
    return rows.filter(pc.or_(often, pc.equal(rows.column(1), "")))


def build_stripes(docs: DataFrame) -> DataFrame:
    """Stored stripes of the kept terms, and under the empty term of every group."""
    rows = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    )
    partial = rows.mapInArrow(fold, STRIPES)
    merged = (
        partial.repartition("lang", "term")
        .sortWithinPartitions("lang", "term")
        .mapInArrow(merge, STRIPES)
    )
    return stored(merged, "stripes")


def totals(stripes: DataFrame) -> DataFrame:
    """A row per group: lang, source, n (occurrences of kept terms), v (kept terms)."""
    cells = stripes.select(
        "lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("cell")
    )
    per_group = cells.groupBy("lang", F.col("cell.sources").alias("source")).agg(
        F.sum("cell.counts").alias("n")
    )
    kept = stripes.groupBy("lang").agg(F.sum((F.col("term") != "").cast("long")).alias("v"))
    return per_group.join(kept, "lang")


def share(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole) by long division in steps of a thousand, exact as
    long as ``whole`` stays below 9 * 10^15."""
    rest, out = counts + 1, np.zeros(len(counts), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Language:
    """The groups of one language, and what the scored terms have given so far."""

    def __init__(self, sources: list[str], n: np.ndarray, v: int):
        self.sources, self.v = sources, v
        self.place = {source: i for i, source in enumerate(sources)}
        self.whole = n + v
        self.all = int(n.sum()) + v
        self.none = share(np.zeros(len(n), np.int64), self.whole) if v else np.ones(len(n), np.int64)
        self.sums: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def base(self, a: int) -> np.ndarray:
        """Sums of source ``a`` against every source if no term stood in any of them."""
        return self.v * gap(self.none[a], self.none)

    def add(self, terms: list[str], rows: np.ndarray, places: np.ndarray, counts: np.ndarray):
        """Terms in ascending order; a cell (row, place, count) for each occurring pair."""
        p = share(counts, self.whole[places])
        per_term = np.add.reduceat(counts, np.flatnonzero(np.diff(rows, prepend=-1)))
        q = share(per_term, np.full(len(per_term), self.all))[rows]
        value = gap(p, q)
        by_source = np.argsort(places, kind="stable")
        begins = np.flatnonzero(np.diff(places[by_source], prepend=-1))
        here = places[by_source][begins]
        names = np.array(terms, object)
        ends = np.append(begins[1:], len(by_source))
        cells = {int(a): by_source[x:y] for a, x, y in zip(here, begins, ends)}
        for a, own in cells.items():
            up = own[p[own] > q[own]]
            values, items = self.best.get(a, (np.zeros(0, np.int64), np.zeros(0, object)))
            values, items = np.append(values, value[up]), np.append(items, names[rows[up]])
            # what was held stands before in the order of terms, so a stable sort keeps ties right
            top = np.argsort(-values, kind="stable")[:TERMS]
            self.best[a] = values[top], items[top]
        p_b, row_b, place_b = p[by_source], rows[by_source], places[by_source]
        for a in range(len(self.sources)):
            dense = np.full(len(terms), self.none[a])
            own = cells.get(a, by_source[:0])
            dense[rows[own]] = p[own]
            none = gap(self.none[a], self.none)
            out = self.sums.setdefault(a, np.zeros(len(self.sources), np.int64))
            # where the other source has the term, and where only this one has it
            with_b = dense[row_b]
            mine = np.zeros(len(terms), bool)
            mine[rows[own]] = True
            only = np.where(mine[row_b], gap(with_b, self.none[place_b]), none[place_b])
            out[here] += np.add.reduceat(gap(with_b, p_b) - only, begins)
            step = max(1, BLOCK_CELLS // len(self.sources))
            for at in range(0, len(own), step):
                some = p[own[at : at + step]][:, None]
                out += (gap(some, self.none[None, :]) - none).sum(axis=0)

    def pair_rows(self, lang: str) -> Iterator[pd.DataFrame]:
        for a, sums in self.sums.items():
            yield _parts(lang, self.sources[a], "pair", self.sources, sums, skip=a)
        self.sums.clear()

    def term_rows(self, lang: str) -> Iterator[pd.DataFrame]:
        for a, (values, items) in self.best.items():
            yield _parts(lang, self.sources[a], "term", items, values)
        self.best.clear()


def _parts(lang, source, part, items, values, skip: int | None = None) -> pd.DataFrame:
    frame = pd.DataFrame({"lang": lang, "source": source, "part": part, "item": items, "value": values})
    return frame if skip is None else frame.drop(index=skip)


def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket, language and term; a bucket's totals stand under the empty term.

    A task holds two numbers per group; the result holds the square of that per language.
    """
    bucket, lang, known = None, None, None
    terms, rows, places, counts = [], [], [], []

    def scored():
        nonlocal terms, rows, places, counts
        if terms:
            known.add(
                terms,
                np.repeat(np.arange(len(terms)), rows),
                np.array(places, np.int64),
                np.array(counts, np.int64),
            )
        terms, rows, places, counts = [], [], [], []

    for batch in batches:
        for row in batch.itertuples(index=False):
            if (row.bucket, row.lang) != (bucket, lang):
                scored()
                if known:
                    yield from known.pair_rows(lang)
                    yield from known.term_rows(lang)
                bucket, lang = row.bucket, row.lang
                known = Language(list(row.sources), np.asarray(row.counts, np.int64), int(row.v))
                for a in range(bucket, len(known.sources), row.buckets):
                    known.sums[a] = known.base(a)
                continue
            terms.append(row.term)
            rows.append(len(row.sources))
            places.extend(map(known.place.__getitem__, row.sources))
            counts.extend(row.counts.tolist())
            if len(counts) >= BLOCK_CELLS:
                scored()
                if len(known.sums) * len(known.sources) > HELD_SUMS:
                    yield from known.pair_rows(lang)
    scored()
    if known:
        yield from known.pair_rows(lang)
        yield from known.term_rows(lang)


def audit(docs: DataFrame) -> DataFrame:
    """Rows lang, source, part, item, value, rank.

    Part ``pair``: each other source of the language by the divergence from it, summed over
    the language's kept terms. Part ``term``: the 200 terms that the group has more of than the
    language. A null text, lang or source is the empty one; a text without terms still makes
    its group; a language without kept terms has pairs of value 0. Repeated rows count as
    often as they stand; ties are ranked by the item's bytes; an empty table gives no row;
    other columns are ignored.
    """
    stripes = build_stripes(docs)
    buckets = max(1, -(-input_bytes(stripes) // TASK_BYTES))
    groups = totals(stripes).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"),
        F.first("v").alias("v"),
    )
    heads = groups.select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"),
        "lang",
        F.lit("").alias("term"),
        F.col("groups.source").alias("sources"),
        F.col("groups.n").alias("counts"),
        "v",
    )
    bodies = stripes.where("term <> ''").select(
        F.pmod(F.xxhash64("lang", "term"), F.lit(buckets)).cast("int").alias("bucket"),
        "lang", "term", "sources", "counts", F.lit(0).cast("long").alias("v"),
    )
    found = (
        heads.unionByName(bodies)
        .withColumn("buckets", F.lit(buckets))
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "lang", "term")
        .mapInPandas(score, PARTS)
    )
    parts = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = parts.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TERMS))
