"""Scoring: verification, confusion, class figures, folds, score tables, masks.

Predictions and gold labels come as a table of pairs. Pairs are counted by label
combination first, so everything after works on a handful of cells per dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill import runtime
from moodmill.functions.patterns import CLASSES

# task: (least number of fields, fields of the key)
TASKS = {"A": (5, 4), "B": (3, 2), "2016A": (3, 1)}


# ---------------------------------------------------------------- files


def parse_predictions(lines: DataFrame, task: str) -> DataFrame:
    """Each line (``value``) with its problem, key and label."""
    least, width = TASKS[task]
    rows = lines.withColumn("f", F.split(F.trim("value"), "\t"))
    label = F.get("f", width)
    problem = (
        F.when(~F.col("value").contains("\t"), "no tab")
        .when(F.size("f") < least, "too few fields")
        .when(~label.isin(list(CLASSES)), "unknown label")
    )
    good = problem.isNull()
    keep = [c for c in lines.columns if c != "value"]
    return rows.select(
        *keep,
        "value",
        problem.alias("problem"),
        F.when(good, F.array_join(F.slice("f", 1, width), "*")).alias("key"),
        F.when(good, label).alias("label"),
    )


def verify_predictions(lines: DataFrame, task: str) -> DataFrame:
    """One row: lines, lines without tab, errors by kind, unique keys, class breakdown."""
    parsed = parse_predictions(lines, task)

    def n(test: Column) -> Column:
        return F.count(F.when(test, 1))

    problem, label = F.col("problem"), F.col("label")
    return parsed.agg(
        n(problem.isNull() | (problem != "no tab")).alias("lines"),
        n(problem == "no tab").alias("no_tab"),
        n(problem == "too few fields").alias("bad_arity"),
        n(problem == "unknown label").alias("unknown_label"),
        F.countDistinct("key").alias("unique_keys"),
        *[n(label == c).alias(c) for c in CLASSES],
    )


def last_labels(parsed: DataFrame, ordinal: str = "line_no") -> DataFrame:
    """The label of every key; of duplicates the last line counts."""
    good = parsed.where(F.col("key").isNotNull())
    return good.groupBy("key").agg(F.max_by("label", ordinal).alias("label"))


def submission_pairs(
    submission: DataFrame, gold: DataFrame, expected_rows: int | None = None
) -> DataFrame:
    """Pairs of a numbered submission and a row-aligned gold table, strictly checked.

    ``submission``: line_no, value as ``NA <n> <label>``; ``gold``: line_no, value as
    ``NA <dataset> <label>``. A wrong line, a line without partner, or a wrong number
    of rows fails the job.
    """
    label = "(positive|negative|neutral)"

    def strict(value: Column, pattern: str, group: int) -> Column:
        bad = F.raise_error(F.concat(F.lit("wrong file format: "), F.coalesce(value, F.lit("?"))))
        return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, group)).otherwise(bad)

    ours = submission.select(
        "line_no", F.regexp_replace("value", r"^[ \t]+|[ \t\r\n]+$", "").alias("s")
    )
    theirs = gold.select("line_no", F.col("value").alias("g"))
    both = ours.join(theirs, "line_no", "full_outer")
    numbered = strict(F.col("s"), rf"^NA\t(\d+)\t{label}", 1).cast("long")
    right_line = F.when(numbered == F.col("line_no"), F.col("s"))
    pairs = both.select(
        "line_no",
        strict(F.col("g"), rf"^NA\t([^\t]+)\t{label}", 1).alias("dataset"),
        strict(F.col("g"), rf"^NA\t([^\t]+)\t{label}", 2).alias("gold"),
        strict(right_line, rf"^NA\t(\d+)\t{label}", 2).alias("pred"),
    )
    if expected_rows is None:
        return pairs
    n = pairs.count()
    if n != expected_rows:
        raise ValueError(f"expected {expected_rows} rows, found {n}")
    return pairs


# ---------------------------------------------------------------- scores


def confusion(pairs: DataFrame, classes: Sequence = CLASSES) -> DataFrame:
    """Gold by predicted counts; every class has a row and a column."""
    cells = pairs.where(F.col("pred").isNotNull()).groupBy("gold", "pred").agg(
        F.count("*").alias("n")
    )
    spark = pairs.sparkSession
    kind = pairs.schema["gold"].dataType.simpleString()
    rows = runtime.local_table(spark, [(c,) for c in classes], f"gold {kind}")
    wide = cells.groupBy("gold").pivot("pred", list(classes)).agg(F.sum("n"))
    return F.broadcast(rows).join(wide, "gold", "left").select(
        "gold", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(str(c)) for c in classes]
    )


def class_scores(
    pairs: DataFrame, by: Sequence[str] = (), classes: Sequence = CLASSES, support: bool = True
) -> DataFrame:
    """Precision, recall and F per class; all 0 where one of the counts is 0.

    A missing prediction counts for the gold total only.
    """
    cells = pairs.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))
    kind = pairs.schema["gold"].dataType.simpleString()
    spread = F.explode(F.array(*[F.lit(c).cast(kind) for c in classes])).alias("label")
    hit, want = F.col("pred") == F.col("label"), F.col("gold") == F.col("label")
    n = F.col("n")
    out = (
        cells.select("*", spread)
        .groupBy(*by, "label")
        .agg(
            F.sum(F.when(hit & want, n).otherwise(0)).alias("correct"),
            F.sum(F.when(want, n).otherwise(0)).alias("support"),
            F.sum(F.when(hit, n).otherwise(0)).alias("predicted"),
        )
    )
    none = (F.col("correct") == 0) | (F.col("support") == 0) | (F.col("predicted") == 0)

    def guarded(value: Column) -> Column:
        return F.when(none, 0.0).otherwise(value)

    out = out.withColumns(
        {
            "precision": guarded(F.try_divide("correct", "predicted")),
            "recall": guarded(F.try_divide("correct", "support")),
            "f": guarded(F.try_divide(2 * F.col("correct"), F.col("predicted") + F.col("support"))),
        }
    )
    return out if support else out.drop("support")


def headline_score(pairs: DataFrame, by: Sequence[str] = (), ends: Sequence = CLASSES[:2]):
    """Mean of the F of the positive and of the negative class."""
    scores = class_scores(pairs, by, classes=ends)
    return scores.groupBy(*by).agg((F.sum("f") / 2).alias("score"))


def score_by_dataset(pairs: DataFrame, drop_missing: bool = False) -> DataFrame:
    """Per dataset the class figures and the headline, in percent."""
    if drop_missing:
        pairs = pairs.where(F.col("pred").isNotNull())
    scores = class_scores(pairs, ("dataset",))
    f = {c: F.sum(F.when(F.col("label") == c, F.col("f"))) for c in CLASSES}
    return scores.groupBy("dataset").agg(
        *[(100 * f[c]).alias(f"f_{c}") for c in CLASSES],
        (100 * (f["positive"] + f["negative"]) / 2).alias("overall"),
    )


# ---------------------------------------------------------------- folds


def stratified_folds(
    df: DataFrame, id_col: str = "doc_id", label: str = "label", k: int = 10, seed: int = 9000
) -> DataFrame:
    """``fold`` 0..k-1, per class balanced to one row, for classes of any size."""
    key = runtime.shuffle_key(F.col(id_col).cast("string"), F.lit(str(seed)))
    keyed = df.withColumn("_key", F.concat_ws(":", key, F.col(id_col).cast("string")))
    ranked = runtime.rank_in_groups(keyed, [label], "_key", "_place")
    return ranked.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop(
        "_key", "_place"
    )


# ---------------------------------------------------------------- score tables


def summarize_scores(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation per model and metric (scores: model, fold, metric, value)."""
    return scores.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )


def t_test(a: DataFrame, b: DataFrame, n: int = 10, level: float = 0.05) -> DataFrame:
    """Two-sided two-sample t-test from the means and deviations of n runs each.

    With n runs a side the degrees of freedom are 2n - 2 and even, for which the
    distribution function is a finite sum.
    """
    df = 2 * n - 2
    right = b.select(
        "model", "metric", F.col("mean").alias("_mean"), F.col("std").alias("_std")
    )
    spread = F.sqrt((F.pow("std", F.lit(2)) + F.pow("_std", F.lit(2))) / n)
    t = F.try_divide(F.col("mean") - F.col("_mean"), spread)
    angle = F.atan(F.abs("t") / F.sqrt(F.lit(float(df))))
    factor, terms = 1.0, F.lit(1.0)
    for j in range(1, df // 2):
        factor *= (2 * j - 1) / (2 * j)
        terms = terms + factor * F.pow(F.cos(angle), F.lit(2.0 * j))
    return (
        a.join(right, ["model", "metric"])
        .select("model", "metric", t.alias("t"), F.lit(df).alias("df"))
        .withColumn(
            "p",
            F.when(F.col("t").isNotNull(), F.greatest(1 - F.sin(angle) * terms, F.lit(0.0))),
        )
        .withColumn("significant", F.col("p") < level)
    )


# ---------------------------------------------------------------- masks


def insertion_masks(spark: SparkSession, order: Sequence[int], size: int) -> DataFrame:
    """Masks that switch blocks on one after the other in the given order."""
    steps = spark.range(1, len(order) + 1).withColumnRenamed("id", "step")
    chosen = F.slice(F.array(*[F.lit(i) for i in order]), F.lit(1), F.col("step").cast("int"))
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.when(F.array_contains(chosen, i), "1").otherwise("0"),
    )
    return steps.select(
        "step", F.concat(F.lit("["), F.array_join(bits, ", "), F.lit("]")).alias("mask")
    )


def decode_masks(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """mask, block, enabled: one row per position, named by the block order."""
    spark = masks.sparkSession
    order = runtime.local_table(spark, list(enumerate(names)), "pos int, block string")
    bits = F.posexplode(F.split(F.trim(F.col("mask"), F.lit("[] ")), ",\\s*")).alias("pos", "bit")
    return (
        masks.select("mask", bits)
        .join(F.broadcast(order), "pos")  # one row per block
        .select("mask", "block", "pos", (F.col("bit") == "1").alias("enabled"))
    )
