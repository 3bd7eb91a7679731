"""Similarity join of documents on word shingles by parity sketches.

The shingles of a document are dealt by hash into the cells of its size band, and every
cell holds the exclusive or of its shingles' hashes. Two sets that differ in d shingles
differ in d cells at most, so cells that agree are the pigeonholes: a partner shares all
filled cells of a set but d. Cells that no other set has are among the d, and of the others
the most frequent are dropped as far as the same bound allows: a set that shares only a
common passage with others keeps none. What is left joins documents, a folded sketch of
single parity bits tests the pairs, and the sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodmill.llm.common import discard, pieces, placed, stored
from moodmill.llm.components import components
from moodmill.llm.signatures import (
    MAIL,
    NO_ID,
    Sender,
    Words,
    combine,
    ids_repeat,
    long_id,
    mix,
    ranges_for,
    rows_of,
    shared,
)

SHINGLE = 5
#: The link: PER_CENT of the union are common. Bounds below hold for 75.
PER_CENT = 75
#: Sizes below are one band in which every shingle is a cell, then one in which three of four
#: shingles are; then a band per factor of 8, of which four of five cells are looked at.
ALL_BELOW, SINGLE_BELOW, BAND = 64, 256, 8
FIRST_FOLDED = 2
SKETCH_BITS = 2048

NOTE = "doc_id long, row long, n long, fp1 long, fp2 long, key long, spare0 int, spare1 int"
SETS = "row long, n long, sketch array<long>, shingles binary"


class Sets:
    """Distinct shingles of several texts, sorted by text and hash."""

    def __init__(self, texts: list[str]):
        words = Words(texts, lower=True)
        first = words.first
        count = np.diff(first)
        windows = combine(words.hash, SHINGLE)
        row = np.repeat(np.arange(len(texts)), count)
        inside = np.flatnonzero(row[: len(windows)] == row[SHINGLE - 1 :][: len(windows)])
        hashes, rows = [windows[inside]], [row[inside]]
        for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
            # all words of a short text are one shingle
            hashes.append(combine(words.hash[first[i] : first[i + 1]], int(count[i])))
            rows.append(np.array([i]))
        hashes, rows = np.concatenate(hashes), np.concatenate(rows)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        self.hashes, self.rows = hashes[fresh], rows[fresh]
        self.sizes = np.bincount(self.rows, minlength=len(texts))
        self.begin = np.cumsum(self.sizes) - self.sizes

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set; zero for an empty one."""
        out = np.zeros((2, len(self.sizes)), np.uint64)
        full = np.flatnonzero(self.sizes)
        if len(full):
            out[0, full] = np.add.reduceat(mix(self.hashes), self.begin[full])
            out[1, full] = np.bitwise_xor.reduceat(mix(~self.hashes), self.begin[full])
        return out[0], out[1]

    def keys(self) -> np.ndarray:
        """One 64-bit hash of each set, under which its cells are sent."""
        fp1, fp2 = self.prints()
        return mix(fp1 + mix(fp2)).view(np.int64)


def most_missing(n: np.ndarray, band: int) -> np.ndarray:
    """Cells of a set of ``n`` shingles that a partner lacks at most.

    A partner has at least 3/4 of the set's shingles, and at most 4/3 as many; the two differ
    in a seventh of their sum at most. A cell of several shingles may differ by those of
    either side.
    """
    return n // 4 if band < FIRST_FOLDED else (n + n * 4 // 3) // 7


def cells(hashes: np.ndarray, rows: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature and row of every filled cell that the band looks at; the lowest bit tells
    its parity. All sets of a band look at the same cells."""
    salt = np.uint64((band + 1) * 0xD6E8FEB86659FD93 % 2**64)
    values = mix(hashes ^ salt)
    if band == 1:
        seen = (values >> np.uint64(1)) & np.uint64(3) != 0
        values, rows = values[seen], rows[seen]
    elif band >= FIRST_FOLDED:
        n_cells = SINGLE_BELOW * BAND ** (band - 1) * 2 // 3
        cell = (values % np.uint64(n_cells)).astype(np.int64)
        seen = cell < n_cells * 4 // 5
        place = rows[seen] * n_cells + cell[seen]
        order = np.argsort(place)
        place, values = place[order], mix(values[seen][order] + salt)
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        place = place[begin]
        rows, cell = place // n_cells, (place % n_cells).astype(np.uint64)
        if len(begin):
            values = np.bitwise_xor.reduceat(values, begin)
        values = mix(values ^ mix(cell + salt))
    return (values & ~np.uint64(1)) | np.uint64(band & 1), rows


def band_of(n: np.ndarray) -> np.ndarray:
    bands = (n >= ALL_BELOW).astype(np.int64)
    bound = SINGLE_BELOW
    while (above := n >= bound).any():
        bands += above
        bound *= BAND
    return bands


def by_band(sets: Sets, keep: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Band, signatures and rows of the kept rows' cells, and per row how many of its cells
    any partner shares beyond the first: own band, and the next one if a partner may be there."""
    n = sets.sizes
    own = band_of(n)
    reach = band_of(n * 4 // 3)
    for band in np.unique(np.concatenate([own[keep], reach[keep]])):
        here = keep & ((own == band) | (reach == band)) & (n > 0)
        chosen = here[sets.rows]
        if not chosen.any():
            continue
        sigs, rows = cells(sets.hashes[chosen], sets.rows[chosen], int(band))
        spare = np.bincount(rows, minlength=len(n)) - most_missing(n, int(band)) - 1
        if (spare[here] < 0).any():
            # eight standard deviations of the hash away
            raise ArithmeticError("a set fills too few cells of its band")
        spare[~here] = -1
        yield int(band), sigs, rows, spare


def signatures(sets: Sets, keep: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells of the kept rows."""
    for _, sigs, rows, _ in by_band(sets, keep):
        yield sigs, rows


def link_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A-Z are lower-cased; words stand between white space. A null text or one without words
    has no shingles and stays alone; fewer than five words are one shingle. Equal sets are
    linked. Rows may repeat; a null doc_id counts as the least one and is returned as null;
    an empty table gives no row; other columns are ignored.

    Different texts of one doc_id are documents of their own; a component is named by its
    least doc_id.
    """
    return linked(docs, ids_repeat(docs)).select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif("component_id", F.lit(NO_ID)).alias("component_id"),
    )


def linked(docs: DataFrame, repeated: bool) -> DataFrame:
    """One row per row of ``docs``: doc_id, row (see ``rows_of``), n, component_id, and
    ``component``, the least row of the component, null without shingles.

    Of equal sets only the least row is compared. In rounds, documents meet one document of
    each shared cell, the least one first; cells whose documents are then in one component
    are done. When rounds join no more, the rows of the cells left are paired over components.
    """
    rows = rows_of(docs, repeated)
    ranges = ranges_for(docs)
    notes = stored(rows.mapInPandas(_notes, NOTE), "notes")
    # a hot set leaves each task once
    classes = stored(
        notes.where("n > 0").groupBy("key", "fp1", "fp2", "n")
        .agg(
            F.min("row").alias("rep"), F.min("doc_id").alias("least"),
            F.max("spare0").alias("spare0"), F.max("spare1").alias("spare1"),
        ),
        "classes",
    )

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sender = Sender(ranges)
        seen: set[int] = set()
        for batch in pieces(batches, "text"):
            sets = Sets(batch["text"].tolist())
            keys = sets.keys()
            # a copy in the same task sends nothing; copies elsewhere send the same key
            for sigs, own in signatures(sets, _first(keys, seen)):
                yield from sender.add(sigs, keys[own])
            if len(seen) > 50_000:
                seen.clear()
        yield sender.send()

    cells_shared = shared(rows.mapInPandas(send, MAIL), ranges, once=True)
    # the cells of a set are together from here on
    named = (
        cells_shared.withColumnRenamed("doc_id", "key")
        .join(classes.select("key", "rep", "n", "spare0", "spare1"), "key")
        .withColumn("spare", F.expr("if(sig & 1 = 0, spare0, spare1)"))
        .groupBy("key", "rep", "n", "spare", "sig")
        .agg(F.min("df").alias("df"))
    )
    own = Window.partitionBy("key", "rep", "spare", F.col("sig").bitwiseAND(1))
    ranked = named.withColumn("shared", F.count("*").over(own)).withColumn(
        "rank", F.row_number().over(own.orderBy("df", "sig"))
    )
    kept = ranked.where("rank <= shared - spare")
    kept = stored(kept.select("sig", F.col("rep").alias("row"), "n"), "cells")
    discard(cells_shared)

    centres = stored(
        kept.groupBy("sig").agg(F.min("row").alias("centre"), F.count("*").alias("held"))
        .where("held > 1").drop("held"),
        "centres",
    )
    met = stored(kept.join(centres, "sig"), "met")
    discard(kept, centres)
    wanted = stored(met.select("row").distinct(), "wanted")
    found = rows.join(placed(wanted, wanted.count()), "row", "left_semi")
    sets = stored(found.mapInPandas(_sets, SETS).dropDuplicates(["row"]), "sets")

    pairs = stored(
        met.where("row <> centre")
        .select(F.col("centre").alias("a"), F.col("row").alias("b"))
        .distinct(),
        "pairs",
    )
    tested, links = pairs, verified(pairs, sets)
    left, round_, most = met, 0, None
    while True:
        final = components(links)
        before, left = left, still_open(left, final)
        discard(before)
        n_rows, n_pairs = open_pairs(left)
        if not n_rows:
            break
        # another round only as long as rounds join what is apart
        last = n_pairs <= n_rows or (most is not None and n_pairs > most)
        round_, most = round_ + 1, n_pairs * 9 // 10
        apart = pairs_left(left, sets) if last else pairs_with_centres(left, round_)
        pairs = stored(apart.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = verified(pairs, sets)
        tested, links = tested.unionByName(pairs), links.unionByName(more)
        if last:
            final = components(links)
            break

    by_rep = classes.join(
        final.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("fp1", "fp2", "n", F.coalesce("component", "rep").alias("component"), "least")
    by_set = stored(by_rep, "components")
    if repeated:
        names = by_set.groupBy("component").agg(F.min("least").alias("component_id"))
        by_set = by_set.join(names, "component")
    else:
        by_set = by_set.withColumn("component_id", F.col("component"))
    discard(wanted, sets, tested, left)
    return notes.join(by_set, ["fp1", "fp2", "n"], "left").select(
        "doc_id", "row", "n", "component",
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def still_open(cells_left: DataFrame, parts: DataFrame) -> DataFrame:
    """The cells (sig, row, n) whose rows are in several components, with the component."""
    named = stored(
        cells_left.select("sig", "row", "n")
        .join(parts.withColumnRenamed("node", "row"), "row", "left")
        .withColumn("component", F.coalesce("component", "row")),
        "cells-left",
    )
    several = (
        named.groupBy("sig")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("sig")
    )
    out = stored(named.join(several, "sig"), "open-cells")
    discard(named)
    return out


def open_pairs(left: DataFrame) -> tuple[int, int]:
    """Rows of open cells, and pairs of them in different components, cell by cell."""
    per_part = left.groupBy("sig", "component").agg(F.count("*").alias("k"))
    per_sig = per_part.groupBy("sig").agg(F.sum("k").alias("held"), F.sum(F.expr("k * k")).alias("own"))
    got = per_sig.agg(F.sum("held"), F.sum(F.expr("(held * held - own) div 2"))).first()
    return got[0] or 0, got[1] or 0


def pairs_with_centres(left: DataFrame, round_: int) -> DataFrame:
    """Pairs of each open cell's rows with one of them; one hash elects the centres of all
    cells, so rows that share many cells meet the same few."""
    elected = F.struct(F.xxhash64("row", F.lit(round_)), F.col("row"), "n", "component")
    centres = left.groupBy("sig").agg(F.min(elected).alias("c"))
    return (
        left.join(centres, "sig")
        .where("component <> c.component AND 4 * least(n, c.n) >= 3 * greatest(n, c.n)")
        .select(F.expr("least(row, c.row)").alias("a"), F.expr("greatest(row, c.row)").alias("b"))
        .distinct()
    )


def pairs_left(left: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of a cell's rows in different components that their parity bits allow; the
    bits are compared inside the join, which puts out none of the others."""
    words = range(SKETCH_BITS // 64)
    bits = sets.select("row", *[F.col("sketch")[i].alias(f"s{i}") for i in words])
    wide = left.join(bits, "row")
    a, b = wide.alias("a"), wide.alias("b")
    differ = " + ".join(f"bit_count(a.s{i} ^ b.s{i})" for i in words)
    close = F.expr(
        "a.sig = b.sig AND a.row < b.row AND a.component <> b.component "
        "AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) "
        f"AND {differ} <= (a.n + b.n) div 7"
    )
    return a.join(b, close).select(F.col("a.row").alias("a"), F.col("b.row").alias("b")).distinct()


def _first(keys: np.ndarray, seen: set[int]) -> np.ndarray:
    """Marks the keys not yet in ``seen``, and puts them there."""
    keep = np.zeros(len(keys), bool)
    for i, key in enumerate(keys.tolist()):
        keep[i] = key not in seen
        seen.add(key)
    return keep


def _notes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in pieces(batches, "text"):
        sets = Sets(batch["text"].tolist())
        fp1, fp2 = sets.prints()
        keys = sets.keys()
        # the first copy tells the spare cells of all
        spare = np.full((2, len(keys)), -1)
        for band, _, _, own in by_band(sets, _first(keys, set())):
            spare[band & 1] = np.maximum(spare[band & 1], own)
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"].to_numpy(np.int64),
                "row": batch["row"].to_numpy(np.int64),
                "n": sets.sizes.astype(np.int64),
                "fp1": fp1.view(np.int64),
                "fp2": fp2.view(np.int64),
                "key": keys,
                "spare0": spare[0].astype(np.int32),
                "spare1": spare[1].astype(np.int32),
            }
        )


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in pieces(batches, "text"):
        sets = Sets(batch["text"].tolist())
        sketches, shingles = [], []
        for begin, size in zip(sets.begin, sets.sizes, strict=True):
            own = sets.hashes[begin : begin + size]
            bits = np.bincount((own % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
            packed = np.packbits((bits & 1).astype(np.uint8), bitorder="little")
            sketches.append(packed.view(np.int64).tolist())
            shingles.append(own.tobytes())
        yield pd.DataFrame(
            {
                "row": batch["row"].to_numpy(np.int64),
                "n": sets.sizes.astype(np.int64),
                "sketch": sketches,
                "shingles": shingles,
            }
        )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked: sizes and parity bits first, then the sets."""
    small = sets.select("row", "n", "sketch")
    likely = (
        pairs.join(small.toDF("a", "na", "sa"), "a")
        .join(small.toDF("b", "nb", "sb"), "b")
        .where("4 * least(na, nb) >= 3 * greatest(na, nb)")
        .where(
            "aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) "
            "<= (na + nb) div 7"
        )
        .select("a", "b")
    )
    likely = stored(likely, "likely")
    full = sets.select("row", "shingles")
    both = likely.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b")
    return stored(both.mapInPandas(_linked, "a long, b long"), "links")


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= PER_CENT * (len(x) + len(y) - common))
        yield batch.loc[keep, ["a", "b"]]


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, of its least doc_id; rows without words stay.

    Of rows alike in doc_id and text any one stays.
    """
    repeated = ids_repeat(docs)
    groups = linked(docs, repeated)
    if not repeated:
        keys = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
        return docs.join(keys, long_id() == F.col("_kept"), "left_semi")
    groups = stored(groups, "groups")
    first = groups.where("n > 0").groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("k"))
    key = ["_id", "_row"]
    one = first.select(F.col("k.doc_id").alias("_id"), F.col("k.row").alias("_row"))
    wordless = groups.where("n = 0").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"_id": long_id(), "_row": F.xxhash64(long_id(), text)})
    kept = keyed.join(one, key, "left_semi").dropDuplicates(key)
    return kept.unionByName(keyed.join(wordless.distinct(), key, "left_semi")).drop(*key)
