"""Feature scores, selection and scaling as aggregates over the long feature table.

A feature table stores non-zero values only; the zeros of the other messages are
accounted for by the class sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodmill import runtime
from moodmill.config import LexiconSpec

Scorer = Callable[[DataFrame, DataFrame], DataFrame]
LEAST = -1.7976931348623157e308  # stands for an undefined score


def class_sizes(labels: DataFrame) -> dict[int, int]:
    """Messages per class: as many values as there are classes."""
    rows = labels.groupBy("label").agg(F.count("*").alias("n")).collect()
    return {r["label"]: r["n"] for r in sorted(rows, key=lambda r: r["label"])}


def _labeled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Non-zero values with the class of their message, which they may carry already."""
    rows = features.where(F.col("value") != 0)
    if "label" in features.columns:
        return rows.select("name", "value", "label")
    rows = rows.select("doc_id", "name", "value")
    return rows.join(labels.select("doc_id", "label"), "doc_id")


def _class_sums(features: DataFrame, labels: DataFrame, sizes: dict[int, int]) -> DataFrame:
    v = F.col("value")
    return _labeled(features, labels).groupBy("name").agg(
        F.sum(v).alias("total"),
        F.sum(v * v).alias("squares"),
        *[
            F.sum(F.when(F.col("label") == c, v).otherwise(0.0)).alias(f"s{i}")
            for i, c in enumerate(sizes)
        ],
    )


def score_chi2(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Observed against expected feature mass per class; null for a feature without mass."""
    sizes = class_sizes(labels)
    n = sum(sizes.values())
    sums = _class_sums(features, labels, sizes)
    # the sum of (o - e)^2 / e over all classes, with both adding up to the total
    parts = [
        F.try_divide(F.col(f"s{i}") * F.col(f"s{i}") * n, F.col("total") * size)
        for i, size in enumerate(sizes.values())
    ]
    return sums.select("name", (_sum(parts) - F.col("total")).alias("score"))


def score_anova(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One-way F; null where the classes have no spread inside."""
    sizes = class_sizes(labels)
    n, k = sum(sizes.values()), len(sizes)
    sums = _class_sums(features, labels, sizes)
    by_class = _sum(
        [F.col(f"s{i}") * F.col(f"s{i}") / size for i, size in enumerate(sizes.values())]
    )
    between = by_class - F.col("total") * F.col("total") / n
    within = F.greatest(F.col("squares") - by_class, F.lit(0.0))
    none = within <= F.col("squares") * 1e-12
    score = F.when(none, None).otherwise((between / (k - 1)) / (within / (n - k)))
    return sums.select("name", score.alias("score"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def score_mutual_info(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Mutual information of the (discrete) value and the class, in nats."""
    sizes = class_sizes(labels)
    n = sum(sizes.values())
    at = [
        F.count(F.when(F.col("label") == c, 1)).cast("double").alias(f"c{i}")
        for i, c in enumerate(sizes)
    ]
    cols = [f"c{i}" for i in range(len(sizes))]
    # rows of one value and class are added up before they move
    cells = _labeled(features, labels).groupBy("name", "value").agg(*at)
    per_value = cells.select(
        "name",
        *cols,
        _sum([_xlogx(F.col(c)) for c in cols]).alias("joint"),
        _xlogx(_sum([F.col(c) for c in cols])).alias("marginal"),
    )
    per_name = per_value.groupBy("name").agg(
        F.sum("joint").alias("joint"),
        F.sum("marginal").alias("marginal"),
        *[F.sum(c).alias(c) for c in cols],
    )
    zeros = [F.lit(float(size)) - F.col(c) for c, size in zip(cols, sizes.values())]
    joint = F.col("joint") + _sum([_xlogx(z) for z in zeros])
    marginal = F.col("marginal") + _xlogx(_sum(zeros))
    classes = _sum([_xlogx(F.lit(float(size))) for size in sizes.values()])
    whole = _xlogx(F.lit(float(n)))
    score = (joint - marginal - classes + whole) / n
    return per_name.select("name", F.greatest(score, F.lit(0.0)).alias("score"))


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


# ---------------------------------------------------------------- selection


def select_percentile(scores: DataFrame, percent: float) -> DataFrame:
    """Names of the top ``percent`` by score: all above the interpolated percentile, and
    features at it in name order while they fit. Exact at any number of features."""
    filled = scores.select("name", F.coalesce("score", F.lit(LEAST)).alias("score"))
    ranked = runtime.number_rows(filled, [F.col("score"), F.col("name")], "rn", "scores")
    n = ranked.count()
    if n == 0:
        return ranked.select("name", "score")
    place = (n - 1) * (1 - percent / 100.0)
    low = int(place)
    near = ranked.where(F.col("rn").isin(low + 1, min(low + 2, n))).orderBy("rn").collect()
    threshold = near[0]["score"]
    if len(near) > 1 and place > low:
        threshold += (near[1]["score"] - near[0]["score"]) * (place - low)
    ties = ranked.where(F.col("score") == threshold).agg(
        F.min("rn").alias("first"), F.max("rn").alias("last")
    ).first()
    above = F.col("score") > threshold
    if ties["first"] is None:
        return ranked.where(above).select("name", "score")
    room = max(int(n * percent / 100.0) - (n - ties["last"]), 0)
    tied = (F.col("score") == threshold) & (F.col("rn") < ties["first"] + room)
    return ranked.where(above | tied).select("name", "score")


def keep_selected(features: DataFrame, selected: DataFrame) -> DataFrame:
    """The stored values of the selected features, for train or any other split."""
    return features.join(runtime.small_side(selected.select("name")), "name", "left_semi")


def select_in_block(
    features: DataFrame, labels: DataFrame, spec: LexiconSpec, scorer: Scorer = score_mutual_info
) -> DataFrame:
    """Selection inside one lexicon block, if its spec asks for any."""
    block = features.where(F.col("block") == spec.name)
    if spec.keep_percent is None:
        return block
    chosen = select_percentile(scorer(block, labels), spec.keep_percent)
    return keep_selected(block, chosen)


# ---------------------------------------------------------------- scaling


def scale_max_abs(features: DataFrame) -> DataFrame:
    largest = features.groupBy("name").agg(F.max(F.abs("value")).alias("_m"))
    scaled = F.when(F.col("_m") == 0, 0.0).otherwise(F.col("value") / F.col("_m"))
    return features.join(runtime.small_side(largest), "name").select(
        *[scaled.alias("value") if c == "value" else F.col(c) for c in features.columns]
    )


def scale_min_max(features: DataFrame, n_messages: int) -> DataFrame:
    """Values on 0..1, and ``zero``: what an absent (zero) value becomes."""
    ends = features.groupBy("name").agg(
        F.min("value").alias("_low"), F.max("value").alias("_high"), F.count("*").alias("_n")
    )
    implicit = F.col("_n") < n_messages
    low = F.when(implicit, F.least("_low", F.lit(0.0))).otherwise(F.col("_low"))
    high = F.when(implicit, F.greatest("_high", F.lit(0.0))).otherwise(F.col("_high"))
    span = ends.select("name", low.alias("_low"), (high - low).alias("_span"))
    width = F.when(F.col("_span") == 0, 1.0).otherwise(F.col("_span"))
    return features.join(runtime.small_side(span), "name").select(
        *[
            ((F.col("value") - F.col("_low")) / width).alias("value") if c == "value" else F.col(c)
            for c in features.columns
        ],
        (-F.col("_low") / width).alias("zero"),
    )
