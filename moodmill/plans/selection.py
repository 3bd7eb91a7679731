"""Feature scoring, selection and scaling over the word counts of the labeled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.config import LexiconSpec
from moodmill.operators import models as M
from moodmill.operators import profile as R
from moodmill.operators import select as S
from moodmill.plans import common as K
from moodmill.plans.common import query, with_sql

_FEATURES = (
    K.LABELED_SQL,
    "toks AS (SELECT doc_id, label, unnest(string_split(lower(text), ' ')) AS name FROM labeled)",
    "features AS (SELECT doc_id, label, name, count(*)::DOUBLE AS value FROM toks GROUP BY ALL)",
    "sizes AS (SELECT label, count(*)::DOUBLE AS size FROM labeled GROUP BY label)",
    "whole AS (SELECT count(*)::DOUBLE AS n FROM labeled)",
)


def _tables(spark, sf):
    docs = K.labeled(spark, sf).select(
        "doc_id", "label", F.split(F.lower("text"), " ").alias("toks")
    )
    return R.bag_of_words(docs, keep=("label",)), docs.select("doc_id", "label")


_CHI2 = (
    "totals AS (SELECT name, sum(value) AS total FROM features GROUP BY name)",
    "observed AS (SELECT name, label, sum(value) AS o FROM features GROUP BY name, label)",
    "grid AS (SELECT t.name, s.label, t.total * s.size / w.n AS e FROM totals t CROSS JOIN sizes s "
    "CROSS JOIN whole w)",
    "scores AS (SELECT g.name, round(sum((coalesce(o.o, 0) - g.e) * (coalesce(o.o, 0) - g.e) / g.e), 6) "
    "AS score FROM grid g LEFT JOIN observed o ON g.name = o.name AND g.label = o.label GROUP BY g.name)",
)


def _rounded(scores):
    return scores.withColumn("score", F.round("score", 6))


def _chi2(spark, sf):
    return _rounded(S.score_chi2(*_tables(spark, sf)))


@query("sel_01_score_chi2", with_sql(*_FEATURES, *_CHI2, select="SELECT * FROM scores"))
def chi2(spark, sf):
    return _chi2(spark, sf)


@query(
    "sel_02_score_anova",
    with_sql(
        *_FEATURES,
        "sums AS (SELECT name, label, sum(value) AS s FROM features GROUP BY name, label)",
        "parts AS (SELECT s.name, sum(s.s * s.s / z.size) AS between0, sum(s.s) AS total FROM sums s "
        "JOIN sizes z ON s.label = z.label GROUP BY s.name)",
        "squares AS (SELECT name, sum(value * value) AS sq FROM features GROUP BY name)",
        select="SELECT p.name, CASE WHEN q.sq - p.between0 <= q.sq * 1e-12 THEN NULL ELSE "
        "round(((p.between0 - p.total * p.total / w.n) / 2) / ((q.sq - p.between0) / (w.n - 3)), 6) END "
        "AS score FROM parts p JOIN squares q ON p.name = q.name CROSS JOIN whole w",
    ),
)
def anova(spark, sf):
    return _rounded(S.score_anova(*_tables(spark, sf)))


_MI = (
    "cells AS (SELECT name, value, label, count(*)::DOUBLE AS n FROM features GROUP BY ALL)",
    "present AS (SELECT name, label, sum(n) AS n FROM cells GROUP BY name, label)",
    "names AS (SELECT DISTINCT name FROM features)",
    "zeros AS (SELECT a.name, 0.0::DOUBLE AS value, s.label, s.size - coalesce(p.n, 0) AS n FROM names a "
    "CROSS JOIN sizes s LEFT JOIN present p ON p.name = a.name AND p.label = s.label)",
    "joint AS (SELECT * FROM cells UNION ALL SELECT * FROM zeros WHERE n > 0)",
    "marg AS (SELECT name, value, sum(n) AS m FROM joint GROUP BY name, value)",
    "info AS (SELECT j.name, round(greatest(sum(j.n / w.n * ln(w.n * j.n / (m.m * s.size))), 0), 6) AS score "
    "FROM joint j JOIN marg m ON j.name = m.name AND j.value = m.value JOIN sizes s ON j.label = s.label "
    "CROSS JOIN whole w GROUP BY j.name)",
)


@query("sel_03_score_mutual_info", with_sql(*_FEATURES, *_MI, select="SELECT * FROM info"))
def mutual_info(spark, sf):
    rows = _rounded(S.score_mutual_info(*_tables(spark, sf)))
    return rows


def _selected_sql(scores: str, percent: float) -> str:
    return (
        f"edge AS (SELECT quantile_cont(score, {1 - percent / 100}) AS t, count(*) AS n FROM {scores}), "
        f"ranked AS (SELECT s.name, s.score, e.t, e.n, row_number() OVER (PARTITION BY s.score > e.t, "
        f"s.score = e.t ORDER BY encode(s.name)) AS tie, count(*) FILTER (s.score > e.t) OVER () AS above "
        f"FROM {scores} s CROSS JOIN edge e) "
        "SELECT name, score FROM ranked WHERE score > t OR (score = t AND tie <= "
        f"greatest(floor(n * {percent} / 100) - above, 0))"
    )


@query(
    "sel_04_select_percentile",
    with_sql(*_FEATURES, *_CHI2, select="").rstrip() + ", " + _selected_sql("scores", 5),
)
def select_percentile(spark, sf):
    return S.select_percentile(_chi2(spark, sf), 5)


@query(
    "sel_04_keep_selected",
    with_sql(*_FEATURES, *_CHI2, select="").rstrip()
    + ", "
    + _selected_sql("scores", 30).replace(
        ") SELECT name, score FROM ranked", "), kept AS (SELECT name FROM ranked"
    )
    + ") SELECT doc_id, count(*) AS n, sum(value) AS total FROM features WHERE name IN (SELECT name FROM "
    "kept) GROUP BY doc_id",
)
def keep_selected(spark, sf):
    features, labels = _tables(spark, sf)
    chosen = S.select_percentile(_rounded(S.score_chi2(features, labels)), 30)
    rows = S.keep_selected(features, chosen)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "sel_05_scale_max_abs",
    with_sql(
        *_FEATURES,
        select="SELECT doc_id, name, round(value / max(value) OVER (PARTITION BY name), 6) AS value "
        "FROM features",
    ),
)
def scale_max_abs(spark, sf):
    rows = S.scale_max_abs(_tables(spark, sf)[0].drop("label"))
    return rows.withColumn("value", F.round("value", 6))


@query(
    "sel_06_scale_min_max",
    with_sql(
        *_FEATURES,
        "ends AS (SELECT name, CASE WHEN count(*) < (SELECT n FROM whole) THEN 0 ELSE min(value) END AS low, "
        "max(value) AS high FROM features GROUP BY name)",
        select="SELECT f.doc_id, f.name, round((f.value - e.low) / CASE WHEN e.high = e.low THEN 1 ELSE "
        "e.high - e.low END, 6) AS value, -e.low / CASE WHEN e.high = e.low THEN 1 ELSE e.high - e.low END "
        "AS zero FROM features f JOIN ends e ON f.name = e.name",
    ),
)
def scale_min_max(spark, sf):
    features, labels = _tables(spark, sf)
    rows = S.scale_min_max(features.drop("label"), labels.count())
    return rows.withColumn("value", F.round("value", 6))


@query(
    "sel_08_select_in_block",
    with_sql(*_FEATURES, *_MI, select="").rstrip()
    + ", "
    + _selected_sql("info", 5).replace(
        ") SELECT name, score FROM ranked", "), kept AS (SELECT name FROM ranked"
    )
    + ") SELECT name, count(*) AS n, sum(value) AS total FROM features WHERE name IN (SELECT name FROM "
    "kept) GROUP BY name",
)
def select_in_block(spark, sf):
    features, labels = _tables(spark, sf)
    blocks = features.withColumn("block", F.lit("WORDS"))
    spec = LexiconSpec("WORDS", keep_percent=5)

    def scorer(rows, labels):
        return _rounded(S.score_mutual_info(rows, labels))

    rows = S.select_in_block(blocks, labels, spec, scorer)
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(
    "top_02_top_features",
    with_sql(
        *_FEATURES, *_CHI2, select="SELECT * FROM scores ORDER BY score DESC, encode(name) LIMIT 30"
    ),
)
def top_features(spark, sf):
    return R.top_features(_chi2(spark, sf))


@query(
    "udf_03_own_scorer",
    with_sql(
        *_FEATURES,
        "dfs AS (SELECT name, count(*)::DOUBLE AS score FROM features GROUP BY name)",
        select="",
    ).rstrip()
    + ", "
    + _selected_sql("dfs", 10),
)
def own_scorer(spark, sf):
    """Any function from features and labels to name and score can drive the selection."""

    def document_frequency(features, labels):
        return features.groupBy("name").agg(F.count("*").cast("double").alias("score"))

    return S.select_percentile(document_frequency(*_tables(spark, sf)), 10)


@query(
    "ml_13_class_weights",
    with_sql(
        K.LABELED_SQL,
        "sizes AS (SELECT label, count(*) AS c FROM labeled GROUP BY label)",
        select="SELECT b.doc_id, b.label, round((SELECT sum(c) FROM sizes)::DOUBLE / ((SELECT count(*) FROM "
        "sizes) * s.c), 6) AS weight FROM labeled b JOIN sizes s ON b.label = s.label",
    ),
)
def class_weights(spark, sf):
    rows = M.class_weights(K.labeled(spark, sf).drop("text"))
    return rows.withColumn("weight", F.round("weight", 6))
