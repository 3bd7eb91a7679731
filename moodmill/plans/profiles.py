"""Profile queries over corpora and lexicons learned from the labeled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.operators import evaluate as E
from moodmill.operators import lexicon as L
from moodmill.operators import profile as R
from moodmill.plans import common as K
from moodmill.plans.common import query, with_sql
from moodmill.plans.lexicons import BAG, BAG_MATCHES

LANGS = ("de", "en", "es", "fr")


# ---------------------------------------------------------------- corpus


@query(
    "agg_12_label_distribution",
    with_sql(
        K.LABELED_SQL,
        select="SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) "
        "AS percent FROM labeled GROUP BY label",
    ),
)
def label_distribution(spark, sf):
    rows = R.label_distribution(K.labeled(spark, sf))
    return rows.withColumn("percent", F.round("percent", 6))


_COUNTS = "counts AS (SELECT tok, count(*) AS n FROM tokens GROUP BY tok)"


@query("agg_13_term_counts", with_sql(K.WORD_LISTS, K.TOKENS, _COUNTS, select="SELECT * FROM counts"))
def term_counts(spark, sf):
    return R.term_counts(K.words(spark, sf))


@query(
    "agg_14_bag_of_words",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        select="SELECT doc_id, tok AS name, count(*)::DOUBLE AS value FROM tokens GROUP BY doc_id, tok",
    ),
)
def bag(spark, sf):
    return R.bag_of_words(K.words(spark, sf))


@query(
    "agg_14_bag_binary_bigrams_min_df",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        K.GRAMS,
        "grams AS (SELECT DISTINCT doc_id, a AS name FROM ahead UNION SELECT doc_id, a || ' ' || b "
        "FROM ahead WHERE b IS NOT NULL)",
        "kept AS (SELECT name FROM grams GROUP BY name HAVING count(*) >= 3)",
        select="SELECT doc_id, name, 1.0::DOUBLE AS value FROM grams WHERE name IN (SELECT name FROM kept)",
    ),
)
def bag_binary(spark, sf):
    return R.bag_of_words(K.words(spark, sf), binary=True, ngram_range=(1, 2), min_df=3)


@query(
    "agg_15_vectorize",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        K.LABELED_SQL,
        "cells AS (SELECT doc_id, tok AS name, count(*) AS n FROM tokens GROUP BY doc_id, tok)",
        "train AS (SELECT DISTINCT name FROM cells WHERE doc_id IN (SELECT doc_id FROM labeled))",
        "vocab AS (SELECT name, CAST(row_number() OVER (ORDER BY encode(name)) - 1 AS INTEGER) AS idx "
        "FROM train)",
        select="SELECT c.doc_id, string_agg(v.idx || ':' || c.n, ' ' ORDER BY v.idx) AS row FROM cells c "
        "JOIN vocab v ON c.name = v.name GROUP BY c.doc_id",
    ),
)
def vectorize(spark, sf):
    """The vocabulary comes from the labeled documents; unseen words are dropped elsewhere."""
    from moodmill.operators import models as M

    features = R.bag_of_words(K.words(spark, sf))
    train = features.join(K.labels_only(spark, sf).select("doc_id"), "doc_id", "left_semi")
    rows = M.vectorize(features, M.feature_index(train))
    cells = F.zip_with(
        "indices", "values", lambda i, v: F.concat_ws(":", i, v.cast("long"))
    )
    return rows.select("doc_id", F.array_join(cells, " ").alias("row"))


@query(
    "top_01_top_terms",
    with_sql(
        K.WORD_LISTS, K.TOKENS, _COUNTS, select="SELECT * FROM counts ORDER BY n DESC, encode(tok) LIMIT 300"
    ),
)
def top_terms(spark, sf):
    return R.top_terms(R.term_counts(K.words(spark, sf)))


@query(
    "top_06_sample_rows",
    "SELECT doc_id, source FROM documents ORDER BY md5(doc_id || ':9000') LIMIT 25",
)
def sample_rows(spark, sf):
    return R.sample_rows(K.documents(spark, sf, "source"), "doc_id", 25)


@query(
    "top_06_pick_rows",
    "SELECT source, doc_id FROM documents WHERE source IN ('src3', 'src7')",
)
def pick_rows(spark, sf):
    return R.pick_rows(K.documents(spark, sf, "source"), "source", ["src3", "src7"])


_TRAIN_DEV = (
    "SELECT doc_id, text, label, 'train' AS split FROM labeled WHERE lang = 'en' UNION ALL "
    "SELECT doc_id, text, label, 'dev' FROM labeled WHERE lang <> 'en'"
)


@query("set_01_union_splits", with_sql(K.LABELED_SQL, select=_TRAIN_DEV))
def union_splits(spark, sf):
    rows = K.labeled(spark, sf, "text", "lang")
    train = rows.where(F.col("lang") == "en").withColumn("split", F.lit("train"))
    dev = rows.where(F.col("lang") != "en").withColumn("split", F.lit("dev"))
    return R.union_splits(train.drop("lang"), dev.drop("lang"))


@query("set_03_datasets", "SELECT DISTINCT source AS dataset FROM documents")
def datasets(spark, sf):
    docs = K.table(spark, sf, "documents").select(F.col("source").alias("dataset"))
    return R.datasets(docs)


# ---------------------------------------------------------------- lexicons


@query(
    "join_14_agg_20_lexicon_overlap",
    with_sql(
        K.LEARNED_SQL,
        "sizes AS (SELECT lexicon, count(*) AS size FROM learned GROUP BY lexicon)",
        "pairs AS (SELECT a.lexicon AS l, b.lexicon AS r, count(*) AS common FROM learned a JOIN learned b "
        "ON a.term = b.term AND a.lexicon <> b.lexicon GROUP BY a.lexicon, b.lexicon)",
        select='SELECT s.lexicon AS "left", t.lexicon AS "right", coalesce(p.common, 0) AS common, '
        "round(coalesce(p.common, 0) * 100.0::DOUBLE / s.size, 6) AS percent FROM sizes s JOIN sizes t "
        "ON s.lexicon <> t.lexicon LEFT JOIN pairs p ON p.l = s.lexicon AND p.r = t.lexicon",
    ),
)
def overlap(spark, sf):
    rows = R.lexicon_overlap(K.learned(spark, sf))
    return rows.withColumn("percent", F.round("percent", 6))


@query(
    "join_15_common_terms",
    with_sql(
        K.LEARNED_SQL,
        select="SELECT a.term, a.value AS left_value, b.value AS right_value FROM learned a JOIN learned b "
        "ON a.term = b.term WHERE a.lexicon = 'en' AND b.lexicon = 'es'",
    ),
)
def common_terms(spark, sf):
    return R.common_terms(K.learned(spark, sf), "en", "es")


@query(
    "agg_16_value_counts",
    with_sql(
        K.LEARNED_SQL,
        select="SELECT lexicon, dim, value, count(*) AS n FROM learned GROUP BY lexicon, dim, value",
    ),
)
def value_counts(spark, sf):
    return R.value_counts(K.learned(spark, sf))


def _histogram_sql(bins: int) -> str:
    return with_sql(
        K.LEARNED_SQL,
        "ends AS (SELECT lexicon, min(value) AS low, max(value) AS high FROM learned GROUP BY lexicon)",
        select="SELECT l.lexicon, l.dim, CAST(CASE WHEN high = low THEN 0 ELSE least(floor((value - low) "
        f"/ (high - low) * {bins}), {bins - 1}) END AS INTEGER) AS bin, count(*) AS n FROM learned l "
        "JOIN ends e ON l.lexicon = e.lexicon GROUP BY ALL",
    )


for _bins in (10, 20, 100):

    def _histogram(spark, sf, bins=_bins):
        return R.value_histogram(K.learned(spark, sf), bins)

    query(f"agg_16_histogram_{_bins}", _histogram_sql(_bins))(_histogram)


@query(
    "agg_17_category_totals",
    with_sql(
        K.EMOTIONS_SQL,
        select="SELECT lexicon, dim, round(sum(value), 4) AS total FROM emotions GROUP BY lexicon, dim",
    ),
)
def category_totals(spark, sf):
    rows = R.category_totals(K.emotions(spark, sf))
    return rows.withColumn("total", F.round("total", 4))


@query(
    "agg_17_categories_per_term",
    with_sql(
        K.EMOTIONS_SQL,
        select="SELECT lexicon, term, round(sum(value), 6) AS total FROM emotions GROUP BY lexicon, term",
    ),
)
def categories_per_term(spark, sf):
    rows = R.categories_per_term(K.emotions(spark, sf))
    return rows.withColumn("total", F.round("total", 6))


@query(
    "agg_18_category_patterns",
    with_sql(
        K.EMOTIONS_SQL,
        "patterns AS (SELECT lexicon, term, coalesce(string_agg(dim, '|' ORDER BY dim) FILTER (value = 1.0), "
        "'') AS pattern FROM emotions GROUP BY lexicon, term)",
        select="SELECT lexicon, pattern, count(*) AS n FROM patterns GROUP BY lexicon, pattern",
    ),
)
def category_patterns(spark, sf):
    return R.category_patterns(K.emotions(spark, sf))


@query(
    "agg_19_lexicon_coverage",
    with_sql(
        *BAG,
        K.lexicon_sql(),
        BAG_MATCHES,
        select="SELECT lexicon, count(DISTINCT doc_id) AS covered, (SELECT count(*) FROM documents) AS "
        "messages, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 6) AS coverage "
        "FROM matches GROUP BY lexicon",
    ),
)
def coverage(spark, sf):
    docs = K.words(spark, sf)
    matches = L.match_terms(docs, K.lexicon(spark), mode="bag")
    rows = R.lexicon_coverage(matches, docs)
    return rows.withColumn("coverage", F.round("coverage", 6))


@query(
    "agg_21_lexicon_correlation",
    with_sql(
        K.LEARNED_SQL,
        select='SELECT a.lexicon AS "left", b.lexicon AS "right", count(*) AS common, '
        "round(CASE WHEN stddev_pop(a.value) = 0 OR stddev_pop(b.value) = 0 THEN NULL ELSE "
        "corr(a.value, b.value) END, 6) AS r FROM learned a JOIN learned b "
        "ON a.term = b.term AND a.lexicon < b.lexicon GROUP BY a.lexicon, b.lexicon",
    ),
)
def correlation(spark, sf):
    rows = R.lexicon_correlation(K.learned(spark, sf), LANGS)
    return rows.withColumn("r", F.round("r", 6))


@query(
    "agg_22_widen",
    with_sql(
        K.EMOTIONS_SQL,
        select="SELECT lexicon, term, "
        + ", ".join(f"max(value) FILTER (dim = '{d}') AS {d}" for d in ("good", "bad", "plain"))
        + " FROM emotions GROUP BY lexicon, term",
    ),
)
def widen(spark, sf):
    return R.widen(K.emotions(spark, sf), ("good", "bad", "plain"))


@query(
    "agg_23_lexicon_profile",
    with_sql(
        K.LEARNED_SQL,
        select="SELECT lexicon, min(value) AS low, max(value) AS high, count(*) AS rows, "
        "count(DISTINCT term) AS terms FROM learned GROUP BY lexicon",
    ),
)
def lexicon_profile(spark, sf):
    return R.lexicon_profile(K.learned(spark, sf))


@query(
    "agg_24_graded_terms",
    with_sql(
        K.EMOTIONS_SQL,
        select="SELECT * FROM emotions WHERE term IN (SELECT term FROM emotions WHERE value > 0 "
        "AND value < 1)",
    ),
)
def graded_terms(spark, sf):
    return R.graded_terms(K.emotions(spark, sf))


for _op, _sql in (("intersect", "INTERSECT"), ("difference", "EXCEPT")):

    def _vocabulary(spark, sf, op=_op):
        return R.vocabulary_set(K.learned(spark, sf), "en", "fr", op)

    query(
        f"set_02_vocabulary_{_op}",
        with_sql(
            K.LEARNED_SQL,
            select=f"SELECT term FROM learned WHERE lexicon = 'en' {_sql} SELECT term FROM learned "
            "WHERE lexicon = 'fr'",
        ),
    )(_vocabulary)


# ---------------------------------------------------------------- rankings of score tables
# A score table is derived from the corpus: each source is scored like a model by the
# share of its documents that a simple rule gets right.


def source_scores(spark, sf):
    rows = K.labeled(spark, sf, "text", "source", "lang")
    right = F.when((F.length("text") % 3 - 1) == F.col("label"), 1.0).otherwise(0.0)
    return rows.groupBy(F.col("source").alias("model"), F.col("lang").alias("mask")).agg(
        F.round(F.avg(right), 6).alias("external_score"),
        F.round(F.avg(F.when(F.col("label") == 1, 1.0).otherwise(0.0)), 6).alias("cv_score"),
    )


SCORES_SQL = (
    f"{K.LABELED_SQL}, scores AS (SELECT source AS model, lang AS mask, round(avg(CASE WHEN "
    "length(text) % 3 - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS external_score, round(avg(CASE WHEN "
    "label = 1 THEN 1.0 ELSE 0.0 END), 6) AS cv_score FROM labeled GROUP BY source, lang), "
    "models AS (SELECT model, round(avg(external_score), 6) AS score, round(avg(cv_score), 6) AS other "
    "FROM scores GROUP BY model)"
)


def model_scores(spark, sf):
    return source_scores(spark, sf).groupBy("model").agg(
        F.round(F.avg("external_score"), 6).alias("score"),
        F.round(F.avg("cv_score"), 6).alias("other"),
    )


@query(
    "top_03_top_models",
    with_sql(SCORES_SQL, select="SELECT * FROM models ORDER BY score DESC, model LIMIT 3"),
)
def top_models(spark, sf):
    return R.top_models(model_scores(spark, sf))


@query(
    "top_03_rank_models",
    with_sql(
        SCORES_SQL,
        "ranked AS (SELECT *, dense_rank() OVER (ORDER BY score DESC) AS a, dense_rank() OVER "
        "(ORDER BY other DESC) AS b FROM models)",
        select="SELECT model, score, other, CAST(CASE WHEN a <= 3 THEN a END AS INTEGER) AS score_rank, "
        "CAST(CASE WHEN b <= 3 THEN b END AS INTEGER) AS other_rank FROM ranked",
    ),
)
def rank_models(spark, sf):
    return R.rank_models(model_scores(spark, sf), ("score", "other"))


@query(
    "top_04_best_model",
    with_sql(
        SCORES_SQL,
        select="SELECT mask, model, external_score, cv_score FROM scores QUALIFY row_number() OVER "
        "(PARTITION BY mask ORDER BY external_score DESC, model DESC) = 1",
    ),
)
def best_model(spark, sf):
    return R.best_model(source_scores(spark, sf), "mask")


def _mask_table(spark, sf):
    return source_scores(spark, sf).withColumn("mask", F.concat_ws("-", "model", "mask"))


_MASKS_SQL = (
    f"{SCORES_SQL}, masks AS (SELECT model, model || '-' || mask AS mask, external_score, cv_score "
    "FROM scores)"
)


@query(
    "top_05_extreme_masks",
    with_sql(
        _MASKS_SQL,
        select="(SELECT *, 'best' AS \"end\" FROM masks ORDER BY external_score DESC, mask LIMIT 3) UNION "
        "ALL (SELECT *, 'worst' AS \"end\" FROM masks ORDER BY external_score, mask DESC LIMIT 3)",
    ),
)
def extreme_masks(spark, sf):
    return R.extreme_masks(_mask_table(spark, sf))


@query(
    "win_05_round_curve",
    with_sql(
        SCORES_SQL,
        "rounds AS (SELECT CAST(replace(model, 'src', '') AS INTEGER) AS gen, avg(external_score) AS avg, "
        "min(external_score) AS min, max(external_score) AS max FROM scores GROUP BY 1)",
        select="SELECT gen, round(avg, 6) AS avg, min, max, max(max) OVER (ORDER BY gen) AS best FROM rounds",
    ),
)
def round_curve(spark, sf):
    scores = source_scores(spark, sf).select(
        F.replace("model", F.lit("src"), F.lit("")).cast("int").alias("gen"),
        F.col("external_score").alias("score"),
    )
    return R.round_curve(scores).withColumn("avg", F.round("avg", 6))


@query(
    "set_04_score_delta",
    with_sql(
        SCORES_SQL,
        select="SELECT a.model, round(a.external_score - b.external_score, 6) AS external_score, "
        "round(a.cv_score - b.cv_score, 6) AS cv_score FROM scores a JOIN scores b ON a.model = b.model "
        "WHERE a.mask = 'en' AND b.mask = 'fr'",
    ),
)
def score_delta(spark, sf):
    scores = source_scores(spark, sf)
    columns = ("external_score", "cv_score")
    delta = R.score_delta(
        scores.where(F.col("mask") == "en"), scores.where(F.col("mask") == "fr"), columns
    )
    return delta.withColumns({c: F.round(c, 6) for c in columns})


# ---------------------------------------------------------------- score statistics


def _fold_scores(spark, sf):
    """Sources play the models, languages the folds."""
    long = source_scores(spark, sf).unpivot(
        ["model", "mask"], ["external_score", "cv_score"], "metric", "value"
    )
    return long.withColumnRenamed("mask", "fold")


_LONG_SQL = (
    f"{SCORES_SQL}, long AS (SELECT model, mask AS fold, 'external_score' AS metric, external_score AS "
    "value FROM scores UNION ALL SELECT model, mask, 'cv_score', cv_score FROM scores), "
    "summary AS (SELECT model, metric, avg(value) AS mean, stddev_samp(value) AS std FROM long "
    "GROUP BY model, metric)"
)


@query(
    "eval_11_summarize_scores",
    with_sql(
        _LONG_SQL,
        select="SELECT model, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM summary",
    ),
)
def summarize(spark, sf):
    rows = E.summarize_scores(_fold_scores(spark, sf))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "eval_13_t_test",
    with_sql(
        _LONG_SQL,
        "a AS (SELECT * FROM summary WHERE metric = 'cv_score')",
        "b AS (SELECT * FROM summary WHERE metric = 'external_score')",
        "t AS (SELECT a.model, 'cv_score' AS metric, CASE WHEN a.std * a.std + b.std * b.std = 0 THEN NULL "
        "ELSE (a.mean - b.mean) / sqrt((a.std * a.std + b.std * b.std) / 10) END AS t FROM a JOIN b "
        "ON a.model = b.model)",
        select="SELECT model, metric, round(t, 6) AS t, 18 AS df, abs(t) > 2.10092204024 AS significant "
        "FROM t",
    ),
)
def t_test(spark, sf):
    summary = E.summarize_scores(_fold_scores(spark, sf))
    a = summary.where(F.col("metric") == "cv_score")
    b = summary.where(F.col("metric") == "external_score").withColumn("metric", F.lit("cv_score"))
    return E.t_test(a, b).withColumn("t", F.round("t", 6)).drop("p")
