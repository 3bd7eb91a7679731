"""Ranked lexical search by Block-Max MaxScore over shards of documents.

A scan task cuts its documents into shards and writes a shard's posting lists, one row per
term: blocks of gaps and frequencies, coded apart, each with the (frequency, length) pairs
that no other posting of the block beats. From those pairs a block's greatest score is known
for any corpus statistics without decoding it. A query goes through a shard's lists by
falling bound. Lists stay essential while the bounds of the rest could still lift an unseen
document into the top; of the others only blocks are decoded whose greatest scores leave a
candidate a chance. The heaps of the shards are merged by one ranking.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodmill.llm.common import CHUNK_BYTES, input_bytes, placed, stored

#: Rows of the result per item.
TOP = 20
#: Text of one shard, and postings of one block.
SHARD_BYTES = 8 << 20
BLOCK = 128
#: Terms of the items that are searched at once; an item with more is searched alone.
ITEM_TERMS = 200_000
#: Stored bytes of the posting lists per search task.
TASK_BYTES = 16 << 20
#: Essential lists between two looks at the threshold.
LOOK = 4
NO_ID = -(2**63)

#: Letters and digits of terms, A-Z as a-z; every other ASCII character parts terms.
FOLD = bytes(
    c + 32
    if 65 <= c <= 90
    else c
    if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57
    else 32
    for c in range(256)
)
#: A list: ``body`` holds its blocks, ``ends`` where each stops, ``lasts`` its last document;
#: ``imp_*`` are the unbeaten pairs and the block of each. The empty term holds the shard's
#: documents: ids and lengths in ``body``.
LISTS = (
    "shard long, term string, df long, terms long, body binary, ends array<int>, "
    "lasts array<int>, imp_block array<int>, imp_tf array<int>, imp_n array<int>"
)
RESULT = "item_no long, doc_id long, score long"


def terms_of(text: str, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Terms of a text in lists of about ``most`` bytes, so a long text is never held as terms."""
    folded = text.encode("utf-8", "surrogatepass").translate(FOLD)
    start = 0
    while start < len(folded):
        end = len(folded) if start + most >= len(folded) else folded.find(b" ", start + most)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the last byte of a number below 128: the bytes, and bytes per number."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        own = size > k
        digit = (values[own] >> (7 * k)) & 127
        out[(ends - size)[own] + k] = digit | np.where(size[own] > k + 1, 128, 0)
    return out, size


def unvarint(data: np.ndarray) -> np.ndarray:
    last = data < 128
    begins = np.flatnonzero(np.append(True, last[:-1]))
    place = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begins)


class Shard:
    """Postings of the documents read so far."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.codes: defaultdict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.found: list[np.ndarray] = []

    def add(self, doc_id: int, text: str) -> None:
        code, tf = np.zeros((2, 0), np.int64)
        n = 0
        for terms in terms_of(text):
            own = np.fromiter(map(self.codes.__getitem__, terms), np.int64, len(terms))
            own, times = np.unique(own, return_counts=True)
            n += len(terms)
            if len(code):
                own, place = np.unique(np.concatenate([code, own]), return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, place, np.concatenate([tf, times]))
                times = total
            code, tf = own, times
        doc = np.full(len(code), len(self.ids))
        self.found.append(np.stack([code, doc, tf]).astype(np.int32))
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.bytes += len(text)

    def rows(self) -> pa.RecordBatch:
        """The lists by term, after the row of the documents."""
        lengths = np.array(self.lengths, np.int64)
        code, doc, tf = np.concatenate(self.found, axis=1).astype(np.int64)
        names = np.array(list(self.codes), object)
        by_name = np.argsort(names, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        order = np.argsort(rank[code], kind="stable")  # documents ascend within a term
        term, doc, tf = rank[code][order], doc[order], tf[order]
        df = np.bincount(term, minlength=len(names))
        first = np.cumsum(df) - df
        place = np.arange(len(term)) - first[term]
        new = place % BLOCK == 0
        block = np.cumsum(new) - 1
        # gaps within a term, then frequencies; a block is decoded from its own bytes and the
        # last document of the block before
        gaps = np.diff(doc, prepend=0)
        gaps[place == 0] = doc[place == 0]
        data, size = varint(np.stack([gaps, tf], axis=1).ravel())
        size = size.reshape(-1, 2).sum(axis=1)
        starts = np.flatnonzero(new)
        of_block = np.add.reduceat(size, starts) if len(starts) else np.zeros(0, np.int64)
        blocks_of = -(-df // BLOCK)
        block_first = np.cumsum(blocks_of) - blocks_of
        of_list = np.add.reduceat(of_block, block_first) if len(df) else np.zeros(0, np.int64)
        ends = np.cumsum(of_block) - np.repeat(np.cumsum(of_list) - of_list, blocks_of)
        lasts = doc[np.append(starts, len(doc))[1:] - 1]
        # pairs of a block that none with more occurrences and no more words beats
        n = lengths[doc]
        best = np.lexsort((n, -tf, block))
        key = (block[-1] - block[best] if len(block) else best) * (int(lengths.max(initial=0)) + 1) + n[best]
        low = np.minimum.accumulate(key)
        open_ = np.append(True, key[1:] < low[:-1])[: len(key)]
        kept = best[open_]
        in_list = block[kept] - block_first[term[kept]]
        pairs_of = np.bincount(term[kept], minlength=len(names))

        body = np.concatenate(
            [np.array(self.ids, "<i8").view(np.uint8), lengths.astype("<i4").view(np.uint8), data]
        )
        head = 12 * len(self.ids)
        counts = lambda own: np.cumsum(np.concatenate([[0, 0], own])).astype(np.int32)
        lists = lambda values, own: pa.ListArray.from_arrays(
            counts(own), pa.array(values.astype(np.int32))
        )
        offsets = np.cumsum(np.concatenate([[0, head], of_list])).astype(np.int32)
        terms = pa.array([""] + [names[i].decode("utf-8", "replace") for i in by_name], pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(names) + 1, self.number)),
                terms,
                pa.array(np.concatenate([[np.count_nonzero(lengths)], df])),
                pa.array(np.concatenate([[lengths.sum()], np.zeros(len(df), np.int64)])),
                pa.Array.from_buffers(
                    pa.binary(), len(names) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)]
                ),
                lists(ends, blocks_of),
                lists(lasts, blocks_of),
                lists(in_list, pairs_of),
                lists(tf[kept], pairs_of),
                lists(n[kept], pairs_of),
            ],
            names=[part.split()[0] for part in LISTS.split(", ")],
        )


def index_shards(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for number, doc_id, text in zip(*(batch.column(i) for i in range(3))):
                text = text.as_py()
                if shard and shard.bytes + len(text) > shard_bytes:
                    yield from sliced(shard.rows())
                    shard = None
                # the number of a shard's first row, unlike in every task
                shard = shard or Shard(number.as_py())
                shard.add(doc_id.as_py(), text)
        if shard:
            yield from sliced(shard.rows())

    return run


def sliced(rows: pa.RecordBatch, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    for start in range(0, rows.num_rows, most):
        yield rows.slice(start, most)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stored posting lists of every term of every document, made where the documents are read."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("number"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return stored(rows.mapInArrow(index_shards(shard_bytes), LISTS), "lists")


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""
    own = index.where("term = ''").agg(F.sum("df").alias("n"), F.sum("terms").alias("l")).first()
    return own["n"] or 0, own["l"] or 0


class Statistics:
    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        length = 75 + 25 * n * self.docs // self.terms
        return 1_000_000_000 * tf // (1000 * tf + 12 * length)


class List:
    """A posting list; blocks are decoded when asked for."""

    def __init__(self, row, lengths: np.ndarray, stats: Statistics):
        self.stats, self.lengths = stats, lengths
        self.body = np.frombuffer(row["body"], np.uint8)
        self.ends, self.lasts = row["ends"], row["lasts"]
        impacts = stats.impact(row["imp_tf"].astype(np.int64), row["imp_n"].astype(np.int64))
        begins = np.flatnonzero(np.diff(row["imp_block"], prepend=-1))
        self.block_max = np.maximum.reduceat(impacts, begins)
        self.bound = int(self.block_max.max())
        self.whole = None

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the whole list, kept for the next query."""
        if self.whole is None:
            both = unvarint(self.body)
            self.whole = self._impacts(np.cumsum(both[::2]), both[1::2])
        return self.whole

    def caps(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending documents, the block that may hold each and its greatest impact."""
        block = np.searchsorted(self.lasts, docs)
        return block, np.append(self.block_max, 0)[block]

    def some(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks."""
        if self.whole is not None or 2 * len(blocks) > len(self.ends):
            return self.postings()
        docs, tfs = [], []
        for b in blocks:
            both = unvarint(self.body[self.ends[b - 1] if b else 0 : self.ends[b]])
            docs.append(np.cumsum(both[::2]) + (self.lasts[b - 1] if b else 0))
            tfs.append(both[1::2])
        return self._impacts(np.concatenate(docs), np.concatenate(tfs))

    def _impacts(self, docs: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return docs, self.stats.impact(tf, self.lengths[docs])


def kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[-k]) if len(scores) >= k else 0


class Heap:
    """The best of the shards a task has seen: highest score, then smallest doc_id."""

    def __init__(self):
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def push(self, scores: np.ndarray, ids: np.ndarray, top: int) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[:top]
        self.scores, self.ids = scores[best], ids[best]

    def least(self, top: int) -> int:
        return int(self.scores[-1]) if len(self.scores) >= top else 0


def search_shard(heap: Heap, ids: np.ndarray, lists: list[tuple[int, List]], top: int) -> None:
    """``lists``: the query's lists in this shard with the factor of each."""
    lists = sorted(lists, key=lambda own: -own[0] * own[1].bound)
    bounds = np.array([factor * own.bound for factor, own in lists])
    rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # of the lists from here on
    acc = np.zeros(len(ids), np.int64)
    least = heap.least(top)
    at = 0
    while at < len(lists) and rest[at] >= max(least, 1):
        docs, impacts = lists[at][1].postings()
        acc[docs] += lists[at][0] * impacts
        at += 1
        if at % LOOK == 0:
            # partial scores are lower bounds, so the threshold never passes the final one
            least = max(least, kth(np.concatenate([heap.scores, acc]), top))
    if at:
        least = max(least, kth(np.concatenate([heap.scores, acc]), top))
    open_ = np.flatnonzero((acc > 0) & (acc + rest[at] >= least))
    scores, left = acc[open_], np.zeros(len(open_), np.int64)
    for factor, own in lists[at:]:
        left += own.caps(open_)[1] * factor
    for factor, own in lists[at:]:
        alive = scores + left >= least
        open_, scores, left = open_[alive], scores[alive], left[alive]
        if not len(open_):
            break
        block, cap = own.caps(open_)
        left -= cap * factor
        due = np.flatnonzero(cap)
        if len(due):
            docs, impacts = own.some(np.unique(block[due]))
            place = np.minimum(np.searchsorted(docs, open_[due]), len(docs) - 1)
            hit = docs[place] == open_[due]
            scores[due[hit]] += factor * impacts[place[hit]]
        least = max(least, kth(np.concatenate([heap.scores, scores]), top))
    heap.push(scores, ids[open_], top)


def searcher(shared, stats: Statistics, top: int):
    """Lists sorted by shard and term to the best documents of the task's shards per item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights = shared.value
        heaps = {item: Heap() for item in items}
        shard, held, ids, lengths = None, {}, None, None

        def searched():
            for item, counts in items.items():
                own = [(n * weights[t], held[t]) for t, n in counts.items() if t in held and weights[t]]
                if own:
                    search_shard(heaps[item], ids, own, top)

        for batch in batches:
            for row in batch.to_dict("records"):
                if row["shard"] != shard:
                    searched()
                    shard, held = row["shard"], {}
                if row["term"]:
                    held[row["term"]] = List(row, lengths, stats)
                else:
                    body, n = row["body"], len(row["body"]) // 12
                    ids = np.frombuffer(body[: 8 * n], "<i8")
                    lengths = np.frombuffer(body[8 * n :], "<i4").astype(np.int64)
        searched()
        for item, heap in heaps.items():
            yield pd.DataFrame({"item_no": item, "doc_id": heap.ids, "score": heap.scores})

    return run


def read_items(benchmark: DataFrame, item_terms: int) -> tuple[DataFrame, int]:
    """Stored rows item_no, item_id, counts (array of term, n), block; and the number of blocks.
    Only items with a term are kept."""
    schema = "item_no long, counts array<struct<term:string,n:long>>"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                own: Counter[bytes] = Counter()
                for terms in terms_of(text):
                    own.update(terms)
                out.append([{"term": t.decode("utf-8", "replace"), "n": n} for t, n in own.items()])
            yield pd.DataFrame({"item_no": batch["item_no"], "counts": out})

    rows = stored(
        benchmark.select(
            F.monotonically_increasing_id().alias("item_no"),
            "item_id",
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ),
        "items",
    )
    counts = rows.select("item_no", "text").mapInPandas(count, schema).where(F.size("counts") > 0)
    kept = stored(rows.drop("text").join(counts, "item_no"), "item-terms")
    size = kept.agg(F.sum(F.size("counts")).alias("n")).first()["n"] or 0
    blocks = -(-size // item_terms)
    return kept.withColumn("block", F.pmod(F.xxhash64("item_no"), F.lit(max(1, blocks)))), blocks


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    top: int = TOP,
    shard_bytes: int = SHARD_BYTES,
    item_terms: int = ITEM_TERMS,
) -> DataFrame:
    """The ``top`` documents of each row of ``benchmark``: item_id, rank, doc_id, score.

    A null text has no terms; an item without terms, or none of whose terms weighs anything,
    gives no row. Rows of one doc_id are documents of their own, as are rows of one item_id;
    equal scores go by ascending doc_id, a null one first. Empty tables give no row; other
    columns are ignored. Items are searched in blocks of ``item_terms`` terms, each block
    against all shards.
    """
    spark = docs.sparkSession
    index = build_index(docs, shard_bytes)
    items, blocks = read_items(benchmark, item_terms)
    stats = Statistics(*corpus_size(index))
    found = None
    for block in range(blocks):
        part = stored(search_block(spark, index, items, block, stats, top), "heaps")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], RESULT)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(items.select("item_no", "item_id"), "item_no").select(
        "item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"
    )


def search_block(
    spark: SparkSession, index: DataFrame, items: DataFrame, block: int, stats: Statistics, top: int
) -> DataFrame:
    """The best documents of every task's shards for the items of one block."""
    own = items.where(F.col("block") == block)
    # bounded by the size of a block of items
    counts = {
        r["item_no"]: {c["term"]: c["n"] for c in r["counts"]}
        for r in own.select("item_no", "counts").collect()
    }
    terms = stored(
        own.select(F.explode("counts.term").alias("term")).distinct().unionByName(
            spark.range(1).select(F.lit("").alias("term"))
        ),
        "asked",
    )
    lists = index.join(placed(terms, terms.count()), "term")
    seen = lists.where("term <> ''").groupBy("term").agg(F.sum("df").alias("df"))
    weights = {r["term"]: stats.weight(r["df"]) for r in seen.collect()}
    shared = spark.sparkContext.broadcast((counts, weights))
    tasks = max(spark.sparkContext.defaultParallelism, -(-input_bytes(index) // TASK_BYTES))
    columns = [part.split()[0] for part in LISTS.split(", ")]
    return (
        lists.select(*columns)
        .repartition(tasks, "shard")
        .sortWithinPartitions("shard", "term")
        .mapInPandas(searcher(shared, stats, top), RESULT)
    )
