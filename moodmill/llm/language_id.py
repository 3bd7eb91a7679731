"""Language identification by interpolated Kneser-Ney models over characters.

A word is read as its letters between two spaces; each letter and the closing space are
predicted from at most four characters before them, never from another word. A model per
language is fitted on a bounded sample of labelled documents. All languages share one
sorted hash array per order, so a lookup gives the probabilities under every language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodmill.llm.common import pieces, placed
from moodmill.runtime import materialize

ORDER = 5
#: Documents per language that the models may learn from; the one bound on what is learned.
SAMPLE_DOCS = 1000
#: One sampled document in so many is kept from the counts, to calibrate the rejection.
CALIBRATION = 5
#: Rejection: this quantile of the calibration texts' length-scaled excess over the language's
#: usual entropy, times the margin; texts longer than LONG characters spread no less.
QUANTILE, MARGIN, LONG = 0.99, 1.5, 500
#: Characters whose words are held at once.
WORDS_CHARS = 1 << 20
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)

COUNTS = "lang string, gram string, n long"
RESULT = (
    "doc_id long, held_out boolean, lang_pred string, score double, "
    "cross_entropy double, rejected boolean"
)


def held_out():
    """Whether the crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """Stored rows (lang, text, draw): at most ``per_language`` labelled documents of each
    language, by a uniform hash of the doc_id; rows of one doc_id are drawn together.

    Only hashes are ranked, in the scan's tasks before those of a language meet; the texts
    of the drawn documents are read where they are.
    """
    labelled = docs.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(True))
    ).select(
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("draw"),
    )
    order = Window.partitionBy("lang").orderBy("draw")
    ranked = labelled.select("lang", "draw").withColumn("rank", F.row_number().over(order))
    last = ranked.where(F.col("rank") <= per_language).groupBy("lang")
    # a row per language
    bounds = materialize(last.agg(F.max("draw").alias("bound")), "bounds")
    drawn = labelled.join(placed(bounds, bounds.count()), "lang").where("draw <= bound")
    return materialize(drawn.select("lang", "text", "draw"), "sample")


def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Grams of full context: ORDER characters, or fewer from the start of a word."""
    for batch in pieces(batches, "text"):
        for lang, own in batch.groupby("lang", sort=False):
            words = Counter(LETTERS.findall(" ".join(own["text"]).lower()))
            grams: Counter[str] = Counter()
            for word, n in words.items():
                padded = f" {word} "
                for end in range(2, len(padded) + 1):
                    grams[padded[max(0, end - ORDER) : end]] += n
            yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray]  # per order: sorted hashes of the grams of any language
    log_p: list[np.ndarray]  # per order: log probability, a row per gram, a column per language
    context_keys: list[np.ndarray]  # per order: sorted hashes of the contexts
    log_back: list[np.ndarray]  # per order: log of the weight of the next shorter context
    floor: np.ndarray  # log probability of a character that no language has
    #: per language: mean entropy, quantile of the scaled excess, entropy of other languages' texts
    usual: np.ndarray | None = None

    def bounds(self, best: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Entropy above which a text is rejected: what texts of the language and of that length
        may have, or if that is more, half way to what texts of other languages have."""
        mean, excess, other = self.usual[best].T
        own = mean + MARGIN * np.maximum(excess, 0) * length_scale(np.maximum(chars, 1))
        return np.maximum(own, (mean + other) / 2)

    def word_scores(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability per language and the number of predicted characters of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)  # of each word, its closing space included
        begins = ends - lengths + 1
        at = np.arange(len(codes)) - np.repeat(
            np.concatenate([[0], begins - 1]), np.concatenate([[1], lengths])
        )  # distance from the space that opens the word
        hashes = gram_hashes(codes)
        total = np.zeros((len(codes), len(self.languages)), np.float32)
        open_ = np.arange(1, len(codes))
        for k in range(ORDER, 0, -1):
            now = open_[at[open_] + 1 >= k]
            row, hit = find(self.keys[k - 1], hashes[k - 1][now])
            total[now[hit]] += self.log_p[k - 1][row[hit]]
            missed = now[~hit]
            if k > 1:
                row, known = find(self.context_keys[k - 1], hashes[k - 2][missed - 1])
                total[missed[known]] += self.log_back[k - 1][row[known]]
            else:
                total[missed] += self.floor
            open_ = np.concatenate([open_[at[open_] + 1 < k], missed]) if k > 1 else missed
        return np.add.reduceat(total[1:], begins - 1, axis=0), lengths

    def texts(self, column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Log probability per language and number of predicted characters of each text."""
        found = [LETTERS.findall(text.lower()) if text else [] for text in column]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        total = np.zeros((len(found), len(self.languages)))
        chars = np.zeros(len(found), np.int64)
        if counts.sum():
            codes, words = pd.factorize(np.array([w for own in found for w in own], object))
            log_p, lengths = self.word_scores(words)
            full = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[full]
            total[full] = np.add.reduceat(log_p[codes].astype(np.float64), starts, axis=0)
            chars[full] = np.add.reduceat(lengths[codes], starts)
        return total, chars


def length_scale(chars):
    """How the mean entropy of texts of a length spreads, up to a factor."""
    return (1 / chars + 1 / LONG) ** 0.5


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Hash of the 1 to ORDER characters that end at each place."""
    own = codes.astype(np.uint64) + np.uint64(1)
    rolled, out = own, []
    for k in range(ORDER):
        if k:
            shifted = np.concatenate([np.zeros(1, np.uint64), rolled[:-1]])
            rolled = shifted * BASE + own
        out.append(rolled ^ (rolled >> np.uint64(29)))
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return row, keys[row] == wanted


def _hash(grams: pd.Index) -> np.ndarray:
    if not len(grams):
        return np.zeros(0, np.uint64)
    size = len(grams[0])
    if size == 0:
        return np.zeros(len(grams), np.uint64)
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
    return gram_hashes(codes)[size - 1][size - 1 :: size]


def fit(counts: pd.DataFrame) -> Models:
    """Interpolated Kneser-Ney: full contexts by their counts, shorter ones by the number of
    characters seen before them. ``counts`` is bounded by the sample."""
    languages = sorted(counts["lang"].unique())
    full = counts.pivot_table(index="gram", columns="lang", values="n", aggfunc="sum")
    full = full.reindex(columns=languages).fillna(0.0)
    size = full.index.str.len()
    by_order: dict[int, pd.DataFrame] = {}
    longer = None
    for k in range(ORDER, 0, -1):
        own = full[size == k]
        if longer is not None:
            types = (longer > 0).astype(float)
            own = pd.concat([own, types.groupby(longer.index.str[1:]).sum()])
        by_order[k] = longer = own.groupby(level=0).sum()
    characters = len(by_order[1]) + 1
    models = Models(languages, [], [], [], [], np.zeros(0))
    shorter = None
    for k in range(1, ORDER + 1):
        table = by_order[k]
        seen = table.to_numpy()
        once, twice = (seen == 1).sum(axis=0), (seen == 2).sum(axis=0)
        off = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        context = table.index.str[:-1]
        grouped = table.groupby(context)
        sums = grouped.sum()
        types = (table > 0).groupby(context).sum()
        back = np.where(sums > 0, off * types / np.where(sums > 0, sums, 1), 1.0)
        back = pd.DataFrame(back, index=sums.index, columns=languages)
        own_sum, own_back = sums.loc[context].to_numpy(), back.loc[context].to_numpy()
        base = (
            np.full(seen.shape, 1 / characters)
            if shorter is None
            else shorter.loc[table.index.str[1:]].to_numpy()
        )
        main = np.maximum(seen - off, 0) / np.where(own_sum > 0, own_sum, 1)
        shorter = pd.DataFrame(main + own_back * base, index=table.index, columns=languages)
        for frame, keys, values in (
            (shorter, models.keys, models.log_p),
            (back, models.context_keys, models.log_back),
        ):
            hashes = _hash(frame.index)
            order = np.argsort(hashes)
            keys.append(hashes[order])
            values.append(np.log(frame.to_numpy()[order]).astype(np.float32))
        if k == 1:
            models.floor = np.log(back.to_numpy()[0] / characters).astype(np.float32)
    return models


def train(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Models | None:
    """Models of the languages in ``docs``; None if no document is labelled."""
    drawn = sample(docs, per_language)
    counts = (
        drawn.where(F.pmod("draw", F.lit(CALIBRATION)) != 0)
        .select("lang", "text")
        .mapInPandas(gram_counts, COUNTS)
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    if not len(counts):
        return None
    models = fit(counts)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def surprise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = shared.value
        place = {lang: i for i, lang in enumerate(ready.languages)}
        for batch in pieces(batches, "text"):
            batch = batch[batch["lang"].isin(place)]
            log_p, chars = ready.texts(batch["text"])
            rows, at = np.arange(len(batch)), batch["lang"].map(place).to_numpy(np.int64)
            nats = -log_p[rows, at]
            # the text as one of a language that was not learned
            log_p[rows, at] = -np.inf
            nearest = np.array(ready.languages, object)[log_p.argmax(axis=1)]
            frame = pd.DataFrame(
                {"lang": batch["lang"], "nats": nats, "chars": chars,
                 "nearest": nearest, "other": -log_p.max(axis=1)}
            )
            yield frame[frame["chars"] > 0]

    fitted = materialize(
        drawn.where(F.pmod("draw", F.lit(CALIBRATION)) == 0)
        .select("lang", "text")
        .mapInPandas(surprise, "lang string, nats double, chars long, nearest string, other double"),
        "calibration",
    )
    # a row per language
    means = fitted.groupBy("lang").agg((F.sum("nats") / F.sum("chars")).alias("mean"))
    excess = (F.col("nats") / F.col("chars") - F.col("mean")) / length_scale(F.col("chars"))
    own = (
        fitted.join(F.broadcast(means), "lang")
        .groupBy("lang")
        .agg(F.first("mean").alias("mean"), F.percentile_approx(excess, QUANTILE).alias("excess"))
    )
    other = (
        fitted.where(F.col("other") < float("inf"))
        .groupBy(F.col("nearest").alias("lang"))
        .agg(F.percentile_approx(F.col("other") / F.col("chars"), 0.5).alias("other"))
    )
    usual = own.join(other, "lang", "full").toPandas().set_index("lang").reindex(models.languages)
    # a language without calibration texts is taken as the average one
    usual[["mean", "excess"]] = usual[["mean", "excess"]].fillna(usual[["mean", "excess"]].mean())
    # where no other language is near, its texts count as letters in no order
    letters = models.log_p[0].astype(np.float64)
    usual["other"] = usual["other"].fillna(
        pd.Series(-(np.exp(letters) * letters).sum(axis=0), index=models.languages)
    )
    models.usual = np.nan_to_num(usual[["mean", "excess", "other"]].to_numpy(np.float64), nan=np.inf)
    return models


def identify(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    The models learn from text and label of documents that are not held out; a prediction
    sees the whole text alone. ``score`` is the predicted language's share of the
    probabilities per character. A null text and one without a letter give ``und``, score 0
    and rejection, as does everything if no document is labelled. Rejected is also a text
    whose entropy lies far above what calibration texts of its language have at that length,
    as texts of languages do that were not learned. Ties go to the first language by name; an
    empty table gives no row; other columns are ignored.
    """
    models = train(docs, per_language)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = shared.value
        for batch in pieces(batches, "text", WORDS_CHARS):
            yield _predicted(ready, batch)

    return rows.mapInPandas(predict, RESULT)


def _predicted(models: Models | None, batch: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"]})
    n = len(batch)
    if models is None:
        lang, score, entropy = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan)
        rejected = np.ones(n, bool)
    else:
        log_p, chars = models.texts(batch["text"])
        some = chars > 0
        per_char = -log_p / np.maximum(chars, 1)[:, None]
        best = per_char.argmin(axis=1)
        entropy = per_char[np.arange(n), best]
        share = np.exp(entropy[:, None] - per_char)
        score = np.where(some, 1 / share.sum(axis=1), 0.0)
        lang = np.where(some, np.array(models.languages, object)[best], UNKNOWN)
        rejected = ~some | (entropy > models.bounds(best, chars))
        entropy = np.where(some, entropy, np.nan)
    return out.assign(
        lang_pred=lang,
        score=score,
        cross_entropy=pd.Series(entropy, index=out.index).astype("Float64"),
        rejected=rejected,
    )


def accepted(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` without the rejected ones; the decision is made where the row is."""
    models = train(docs, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("boolean")
    def fits(text: pd.Series) -> pd.Series:
        # Arrow batches are cut here again, as the words of a batch are held at once
        frame = pd.DataFrame({"text": text.fillna(""), "doc_id": 0, "held_out": False})
        parts = [~_predicted(shared.value, p)["rejected"] for p in pieces([frame], "text", WORDS_CHARS)]
        return pd.concat(parts) if parts else pd.Series([], dtype=bool)

    return docs.where(fits(F.col("text").cast("string")))
