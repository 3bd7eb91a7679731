"""Benchmark decontamination by a positional inverted index, in DataFrame functions alone.

Every run of 13 benchmark words (a shorter item: all its words) is a window. The corpus
frequencies of the benchmark's words pick the rarest words of each window, the index stores
where those occur, and the lists of a window are intersected with their offsets taken off,
from the rarest word on. What is left is compared with the document's words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodmill.llm.common import placed
from moodmill.runtime import materialize

WINDOW = 13
#: Rarest words of a window whose lists are intersected.
RAREST = 4
#: A document is contaminated if one in so many of its words is hit.
HIT_SHARE = 20
#: Candidates up to this count (40 bytes each) are broadcast to the documents.
BROADCAST_CANDIDATES = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_ID = -(2**63)
#: Stands behind the last word of a document; no word can hold a space.
END = " "


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none of a null text."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words, length, digest) and their items (wid, item_id)."""
    item = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        words(F.col("text").cast("string")).alias("w"),
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = item.select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("words")
    )
    grouped = each.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    stored = materialize(
        grouped.select(
            F.monotonically_increasing_id().alias("wid"),
            "words",
            F.size("words").alias("length"),
            F.xxhash64("words").alias("digest"),
            "items",
        ),
        "windows",
    )
    return stored.drop("items"), stored.select("wid", F.explode("items").alias("item_id"))


def digest(text: Column) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(text.cast("string"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text, and the words: rows alike in both are one document."""
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        digest(text).alias("h"),
        words(text).alias("w"),
    )


def rarest_terms(docs: DataFrame, windows: DataFrame, most: int = RAREST) -> DataFrame:
    """The rarest words of each window: wid, rank from 1, off, term, needed (their number)."""
    terms = materialize(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    seen = keyed(docs).select(F.explode("w").alias("term"))
    # no more rows than terms leave a task: partial sums
    counts = seen.join(placed(terms, terms.count()), "term").groupBy("term").count()
    order = Window.partitionBy("wid").orderBy("count", "term", "off")
    whole = Window.partitionBy("wid")
    return (
        windows.select("wid", F.posexplode("words").alias("off", "term"))
        .join(counts, "term", "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("needed", F.least(F.max("rank").over(whole), F.lit(most)))
        .where(F.col("rank") <= most)
        .select("wid", "rank", "off", "term", "needed")
    )


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, h, pos) of ``terms``; under END, pos is the word count."""
    ends = terms.sparkSession.sql(f"SELECT '{END}' AS term")
    kept = materialize(terms.select("term").distinct().unionByName(ends), "indexed-terms")
    each = keyed(docs).select(
        "doc_id", "h", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "term")
    )
    postings = each.join(placed(kept, kept.count()), "term").select("term", "doc_id", "h", "pos")
    return materialize(postings, "postings")


def phrase_candidates(index: DataFrame, pivots: DataFrame) -> DataFrame:
    """Places (wid, doc_id, h, start) where all of a window's rarest words stand in place."""
    n = pivots.count()
    first = placed(pivots.where("rank = 1").select("wid", "off", "term", "needed"), n)
    begun = index.join(first, "term").select(
        "wid", "doc_id", "h", "needed", (F.col("pos") - F.col("off")).alias("start")
    ).where("start >= 0")
    rest = pivots.where("rank > 1").select("wid", "rank", "off", "term")
    due = begun.join(placed(rest, n), "wid").select(
        "wid", "doc_id", "h", "start", "needed", "term",
        (F.col("start") + F.col("off")).alias("pos"),
    )
    found = (
        due.join(index, ["doc_id", "h", "pos", "term"], "left_semi")
        .groupBy("wid", "doc_id", "h", "start", "needed")
        .agg(F.count_distinct("pos").alias("n"))
        .where("n = needed - 1")
    )
    single = begun.where("needed = 1").distinct()
    columns = ("wid", "doc_id", "h", "start")
    return found.select(*columns).unionByName(single.select(*columns))


def proximity_matches(index: DataFrame, pivots: DataFrame, slack: int) -> DataFrame:
    """Places (wid, doc_id, start) where the rarest words stand within ``slack`` words of
    their place: phrases with words put in, left out or exchanged."""
    n = pivots.count()
    first = placed(pivots.where("rank = 1").select("wid", "off", "term", "needed"), n)
    begun = index.join(first, "term").select(
        "wid", "doc_id", "h", "needed", (F.col("pos") - F.col("off")).alias("start")
    )
    rest = pivots.where("rank > 1").select("wid", "rank", "off", "term")
    # one row per place that would do, so the join has equal keys only
    due = begun.join(placed(rest, n), "wid").select(
        "wid", "doc_id", "h", "start", "needed", "rank", "term",
        F.explode(
            F.sequence(F.col("start") + F.col("off") - slack, F.col("start") + F.col("off") + slack)
        ).alias("pos"),
    )
    found = (
        due.join(index, ["doc_id", "h", "pos", "term"], "left_semi")
        .groupBy("wid", "doc_id", "h", "start", "needed")
        .agg(F.count_distinct("rank").alias("n"))
        .where("n = needed - 1")
    )
    columns = ("wid", "doc_id", "h", "start")
    both = found.select(*columns).unionByName(begun.where("needed = 1").select(*columns))
    return both.distinct().select("wid", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "start")


def phrase_matches(docs: DataFrame, index: DataFrame, pivots: DataFrame, windows: DataFrame):
    """Documents with windows in them: doc_id, h, hits (array of start, length, wid)."""
    places = materialize(
        phrase_candidates(index, pivots).join(
            placed(windows.select("wid", "length", "digest"), windows.count()), "wid"
        ),
        "candidates",
    )
    per_doc = places.groupBy("doc_id", "h").agg(
        F.collect_list(F.struct("start", "length", "wid", "digest")).alias("places")
    )
    if places.count() <= BROADCAST_CANDIDATES:
        per_doc = F.broadcast(per_doc)

    def stands(place: Column) -> Column:
        return F.xxhash64(F.slice("w", place.start + 1, place.length)) == place.digest

    return (
        keyed(docs)
        .join(per_doc, ["doc_id", "h"])
        .select("doc_id", "h", F.array_sort(F.filter("places", stands)).alias("hits"))
        .where(F.size("hits") > 0)
        .dropDuplicates(["doc_id", "h"])
    )


def covered(hits: Column) -> Column:
    """Number of words in the union of sorted hits."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(so_far: Column, hit: Column) -> Column:
        end = F.greatest(so_far.end, hit.start + hit.length)
        fresh = F.greatest(end - F.greatest(so_far.end, hit.start), F.lit(0))
        return F.struct(end.alias("end"), (so_far.n + fresh).alias("n"))

    return F.aggregate(hits, start, add, lambda so_far: so_far.n)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Rows with equal doc_id and text are one document. A null text or item has no words, a
    null item_id is the empty string; an item found by several windows counts once. With an
    empty benchmark nothing is hit; without documents there is no row. Texts are indexed
    whole, and other columns are ignored.
    """
    return judged(docs, benchmark).drop("h")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``contamination`` and the digest h of each document's text."""
    windows, items = windows_of(benchmark)
    pivots = materialize(rarest_terms(docs, windows), "pivots")
    index = build_index(docs, pivots)
    hits = materialize(phrase_matches(docs, index, pivots, windows), "hits")
    lengths = index.where(F.col("term") == END).groupBy("doc_id", "h").agg(
        F.max("pos").cast("long").alias("n_words")
    )
    named = (
        hits.select("doc_id", "h", F.explode(F.array_distinct("hits.wid")).alias("wid"))
        .join(items, "wid")
        .groupBy("doc_id", "h")
        .agg(F.array_sort(F.collect_set("item_id")).alias("found"))
    )
    rows = lengths.join(
        hits.select("doc_id", "h", covered(F.col("hits")).alias("n_hit")), ["doc_id", "h"], "left"
    ).join(named, ["doc_id", "h"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return rows.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "h",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * HIT_SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones; of a doc_id, only texts that are contaminated go."""
    found = judged(docs, benchmark).where("contaminated")
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    keys = found.select(id_of.alias("_id"), F.col("h").alias("_h"))
    own = [
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("_id"),
        digest(docs["text"]) == F.col("_h"),
    ]
    return docs.join(keys, own, "left_anti")
