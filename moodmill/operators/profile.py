"""Profiles of corpora and lexicons: counts, histograms, overlap, correlation, rankings."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodmill import runtime
from moodmill.functions import text as T
from moodmill.operators.lexicon import POLARITY

# ---------------------------------------------------------------- corpus


def label_distribution(messages: DataFrame, label: str = "label") -> DataFrame:
    counts = messages.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # over the few label rows
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(everything))


def term_counts(docs: DataFrame) -> DataFrame:
    """Corpus frequency of every token; equal tokens are added up before they move."""
    toks = docs.select(F.explode_outer("toks").alias("tok"))  # see explode_tokens
    return toks.where("tok IS NOT NULL").groupBy("tok").agg(F.count("*").alias("n"))


def bag_of_words(
    docs: DataFrame,
    binary: bool = False,
    ngram_range: tuple[int, int] = (1, 1),
    min_df: int = 1,
    joiner: str = " ",
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, name, value: counted inside the row, so the corpus is not shuffled.

    Columns to ``keep``, such as the label, ride along and save a join afterwards.

    Only ``min_df`` above 1 moves anything: the document frequencies.
    """
    toks = F.col("toks")
    low, high = ngram_range
    lists = [toks if n == 1 else T.ngram_array(toks, n, joiner) for n in range(low, high + 1)]
    grams = lists[0] if len(lists) == 1 else F.concat(*lists)
    rows = docs.select("doc_id", *keep, F.inline(T.term_runs(grams)))
    bag = rows.select(
        "doc_id",
        *keep,
        F.col("term").alias("name"),
        F.lit(1.0).alias("value") if binary else F.col("n").cast("double").alias("value"),
    )
    if min_df <= 1:
        return bag
    common = bag.groupBy("name").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return bag.join(runtime.small_side(common.select("name")), "name", "left_semi")


def datasets(messages: DataFrame, column: str = "dataset") -> DataFrame:
    return messages.select(column).distinct()


def union_splits(*messages: DataFrame) -> DataFrame:
    out = messages[0]
    for more in messages[1:]:
        out = out.unionByName(more)
    return out


def top_terms(counts: DataFrame, n: int = 300) -> DataFrame:
    return counts.orderBy(F.desc("n"), "tok").limit(n)


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 9000) -> DataFrame:
    """A reproducible sample: the n smallest seeded hashes of the id."""
    key = runtime.shuffle_key(F.col(id_col).cast("string"), F.lit(str(seed)))
    return df.withColumn("_key", key).orderBy("_key", id_col).limit(n).drop("_key")


def pick_rows(df: DataFrame, id_col: str, ids: Sequence) -> DataFrame:
    return df.where(F.col(id_col).isin(list(ids)))


# ---------------------------------------------------------------- lexicons


def widen(lexicon: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Terms by named dims."""
    return lexicon.groupBy("lexicon", "term").pivot("dim", list(dims)).agg(F.first("value"))


def widen_lexicons(lexicon: DataFrame, names: Sequence[str]) -> DataFrame:
    polar = lexicon.where(F.col("dim") == POLARITY)
    return polar.groupBy("term").pivot("lexicon", list(names)).agg(F.first("value"))


def value_counts(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("lexicon", "dim", "value").agg(F.count("*").alias("n"))


def value_histogram(lexicon: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins from the least to the greatest value; the last bin is closed."""
    ranges = lexicon.groupBy("lexicon", "dim").agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )
    rows = lexicon.join(F.broadcast(ranges), ["lexicon", "dim"])  # a row per lexicon and dim
    place = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    bin_no = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(place, F.lit(bins - 1)))
    return (
        rows.withColumn("bin", bin_no.cast("int"))
        .groupBy("lexicon", "dim", "bin")
        .agg(F.count("*").alias("n"))
    )


def category_totals(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("lexicon", "dim").agg(F.sum("value").alias("total"))


def categories_per_term(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("lexicon", "term").agg(F.sum("value").alias("total"))


def category_patterns(lexicon: DataFrame) -> DataFrame:
    """How many terms have exactly this set of categories (value 1)."""
    present = F.when(F.col("value") == 1.0, F.col("dim"))
    per_term = lexicon.groupBy("lexicon", "term").agg(
        F.concat_ws("|", F.array_sort(F.collect_set(present))).alias("pattern")
    )
    return per_term.groupBy("lexicon", "pattern").agg(F.count("*").alias("n"))


def lexicon_profile(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("lexicon").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count("*").alias("rows"),
        F.countDistinct("term").alias("terms"),
    )


def graded_terms(lexicon: DataFrame) -> DataFrame:
    """All values of the terms that have at least one value strictly between 0 and 1."""
    graded = (F.col("value") > 0) & (F.col("value") < 1)
    keep = lexicon.groupBy("lexicon", "term").agg(F.max(graded).alias("g")).where("g")
    return lexicon.join(keep.drop("g"), ["lexicon", "term"], "left_semi")


def lexicon_coverage(matches: DataFrame, messages: DataFrame) -> DataFrame:
    """Share of the messages with at least one match."""
    hit = matches.select("lexicon", "doc_id").distinct()
    covered = hit.groupBy("lexicon").agg(F.count("*").alias("covered"))
    total = messages.agg(F.count("*").alias("messages"))
    return covered.crossJoin(F.broadcast(total)).withColumn(  # total is one row
        "coverage", F.col("covered") / F.col("messages")
    )


def lexicon_overlap(lexicon: DataFrame) -> DataFrame:
    """For every ordered pair of lexicons: common terms and their percent of the left one.

    Terms are first counted by the set of lexicons that hold them; pairs are built from
    those few sets and not from the terms.
    """
    sets = (
        lexicon.groupBy("term")
        .agg(F.array_sort(F.collect_set("lexicon")).alias("holders"))
        .groupBy("holders")
        .agg(F.count("*").alias("n"))
    )
    sizes = sets.select(F.explode("holders").alias("left"), "n").groupBy("left").agg(
        F.sum("n").alias("size")
    )
    pairs = (
        sets.select(F.explode("holders").alias("left"), "holders", "n")
        .select("left", F.explode("holders").alias("right"), "n")
        .where(F.col("left") != F.col("right"))
        .groupBy("left", "right")
        .agg(F.sum("n").alias("common"))
    )
    names = sizes.select(F.col("left").alias("right"))
    every = sizes.join(F.broadcast(names), F.col("left") != F.col("right"))  # a row per lexicon
    return every.join(pairs, ["left", "right"], "left").select(
        "left",
        "right",
        F.coalesce("common", F.lit(0)).alias("common"),
        (F.coalesce("common", F.lit(0)) * 100.0 / F.col("size")).alias("percent"),
    )


def common_terms(lexicon: DataFrame, left: str, right: str) -> DataFrame:
    """Values of the terms two opinion lexicons share."""
    polar = lexicon.where(F.col("dim") == POLARITY)

    def side(name: str, out: str) -> DataFrame:
        return polar.where(F.col("lexicon") == name).select("term", F.col("value").alias(out))

    return side(left, "left_value").join(side(right, "right_value"), "term")


def lexicon_correlation(lexicon: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of opinion lexicons over their common terms.

    One row per term and one aggregate per pair: no pair of rows is ever formed.
    """
    wide = widen_lexicons(lexicon, names)
    pairs = list(combinations(names, 2))
    shared = [(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()) for a, b in pairs]

    def pearson(a: str, b: str, both: Column) -> Column:
        """Null where one side has no spread."""
        x, y = F.when(both, F.col(f"`{a}`")), F.when(both, F.col(f"`{b}`"))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    stats = wide.agg(
        *[pearson(a, b, s).alias(f"r{i}") for i, ((a, b), s) in enumerate(zip(pairs, shared))],
        *[F.count(F.when(s, 1)).alias(f"n{i}") for i, s in enumerate(shared)],
    )
    rows = [
        F.struct(
            F.lit(a).alias("left"),
            F.lit(b).alias("right"),
            F.col(f"n{i}").alias("common"),
            F.col(f"r{i}").alias("r"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return stats.select(F.inline(F.array(*rows))).where(F.col("common") > 0)


def vocabulary_set(lexicon: DataFrame, a: str, b: str, op: str) -> DataFrame:
    def terms(name: str) -> DataFrame:
        return lexicon.where(F.col("lexicon") == name).select("term").distinct()

    if op == "intersect":
        return terms(a).intersect(terms(b))
    if op == "difference":
        return terms(a).subtract(terms(b))
    raise ValueError(f"op must be 'intersect' or 'difference', not {op!r}")


# ---------------------------------------------------------------- rankings


def top_features(scores: DataFrame, n: int = 30) -> DataFrame:
    return scores.orderBy(F.desc_nulls_last("score"), "name").limit(n)


def top_models(scores: DataFrame, n: int = 3, by: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(by), "model").limit(n)


def rank_models(scores: DataFrame, columns: Sequence[str], n: int = 3) -> DataFrame:
    """The 1..n markers of each score column; a score table has one row per model."""
    for c in columns:
        place = F.dense_rank().over(Window.orderBy(F.desc(c)))
        scores = scores.withColumn(f"{c}_rank", F.when(place <= n, place))
    return scores


def best_model(scores: DataFrame, key: str, by: str = "external_score") -> DataFrame:
    rest = [c for c in scores.columns if c != key]
    order = F.struct(F.col(by), F.col("model"))
    best = scores.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select(key, *[F.col(f"b.{c}") for c in rest])


def extreme_masks(scores: DataFrame, n: int = 3, by: str = "external_score") -> DataFrame:
    best = scores.orderBy(F.desc(by), "mask").limit(n).withColumn("end", F.lit("best"))
    worst = scores.orderBy(F.asc(by), F.desc("mask")).limit(n).withColumn("end", F.lit("worst"))
    return best.unionByName(worst)


def round_curve(scores: DataFrame, gen: str = "gen", value: str = "score") -> DataFrame:
    """avg, min, max per round and the best so far; the running window is over the rounds."""
    rounds = scores.groupBy(gen).agg(
        F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    so_far = Window.orderBy(gen).rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumn("best", F.max("max").over(so_far))


def score_delta(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    right = b.select("model", *[F.col(c).alias(f"_{c}") for c in columns])
    diff: list[Column] = [(F.col(c) - F.col(f"_{c}")).alias(c) for c in columns]
    return a.join(right, "model").select("model", *diff)
