"""Lexicon lookup queries and the statistics built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.functions import text as T
from moodmill.operators import corpus as C
from moodmill.operators import lexicon as L
from moodmill.plans import common as K
from moodmill.plans.common import EMOTION, OPINION, PHRASES, SPEC, SPECS, query, with_sql

# ---------------------------------------------------------------- SQL fragments

NEGATED_GRAMS = (
    "grams AS (SELECT DISTINCT doc_id, prefixed AS gram FROM negated)"
)
EFFECTIVE = "(l.dim <> 'polarity' OR l.value <> 0)"


def set_matches(source: str = "grams") -> str:
    return (
        "matches AS (SELECT g.doc_id, l.lexicon, g.gram, l.dim, CASE WHEN contains(g.gram, 'NEG_') "
        f"AND l.dim = 'polarity' THEN -l.value ELSE l.value END AS value FROM {source} g JOIN lex l "
        f"ON replace(g.gram, 'NEG_', '') = l.term WHERE {EFFECTIVE})"
    )


# every gram of the four kinds, as often as it occurs
ALL_GRAMS = (
    "allgrams AS (SELECT doc_id, 'words' AS kind, tok AS gram FROM tokens UNION ALL "
    "SELECT doc_id, 'bigrams', a || ' ' || b FROM ahead WHERE b IS NOT NULL UNION ALL "
    "SELECT doc_id, 'trigrams', a || ' ' || b || ' ' || c FROM ahead WHERE c IS NOT NULL UNION ALL "
    f"SELECT doc_id, 'gapped', gram FROM ({K.gap_variants('---')}))"
)
BAG_MATCHES = (
    "matches AS (SELECT g.doc_id, l.lexicon, g.kind, g.gram, l.dim, l.value FROM allgrams g "
    f"JOIN lex l ON g.gram = l.term WHERE {EFFECTIVE})"
)
NEGATED = (K.INFORMAL_LOWER, K.TOKENS, K.NEGATION, NEGATED_GRAMS)
BAG = (K.WORD_LISTS, K.TOKENS, K.GRAMS, ALL_GRAMS)
PLAIN = (K.WORD_LISTS, K.TOKENS, K.GRAMS, ALL_GRAMS, "grams AS (SELECT DISTINCT doc_id, gram FROM allgrams)")


def _set_negated(spark, sf, name=OPINION):
    docs = C.mark_negation(K.informal(spark, sf), "prefix")
    return docs, L.match_terms(docs, K.lexicon(spark, name), [SPEC[name]])


def _bag(spark, sf, *names):
    docs = K.words(spark, sf)
    return docs, L.match_terms(docs, K.lexicon(spark, *names), mode="bag")


# ---------------------------------------------------------------- matching


@query(
    "join_01_match_terms_set",
    with_sql(*NEGATED, K.lexicon_sql(OPINION), set_matches(), select="SELECT * FROM matches"),
)
def match_set(spark, sf):
    return _set_negated(spark, sf)[1].drop("kind")


@query(
    "join_01_match_phrases_set",
    with_sql(*PLAIN, K.lexicon_sql(PHRASES), set_matches(), select="SELECT * FROM matches"),
)
def match_phrases(spark, sf):
    docs = K.words(spark, sf)
    return L.match_terms(docs, K.lexicon(spark, PHRASES), [SPEC[PHRASES]]).drop("kind")


@query(
    "join_02_match_terms_bag",
    with_sql(
        *BAG,
        K.lexicon_sql(),
        BAG_MATCHES,
        select="SELECT doc_id, lexicon, kind, gram, dim, value, count(*) AS n FROM matches GROUP BY ALL",
    ),
)
def match_bag(spark, sf):
    matches = _bag(spark, sf)[1]
    return matches.groupBy(*matches.columns).agg(F.count("*").alias("n"))


_TAG_KEYS = {"ha.n": ("joy", 1.0), "idiot.r": ("anger", 0.5), "no.a": ("sad", 0.25),
             "the.v": ("joy", -0.5), "de.a": ("joy", 0.75)}
_WORD_KEYS = {"ha#ADJECTIVE": ("joy", 1.0), "the#ADVERB": ("joy", 0.5), "is#ADJECTIVE": ("sad", 0.25)}


def _keyed_rows(keys):
    return [("KEYED", k, d, v) for k, (d, v) in keys.items()]


def _keyed_sql(keys):
    rows = ", ".join(f"('KEYED', {K.lit(k)}, '{d}', CAST({v} AS DOUBLE))" for k, (d, v) in keys.items())
    return f"lex AS (SELECT * FROM (VALUES {rows}) AS v(lexicon, term, dim, value))"


_LETTER = (
    "CASE WHEN tag IN ('JJ') THEN 'a' WHEN tag IN ('NN', 'NNS') THEN 'n' WHEN tag = 'RB' THEN 'r' "
    "WHEN tag = 'VB' THEN 'v' ELSE '' END"
)
_WORDTAG = (
    "CASE WHEN tag IN ('JJ') THEN 'ADJECTIVE' WHEN tag IN ('NN', 'NNS') THEN 'NOUN' "
    "WHEN tag = 'RB' THEN 'ADVERB' WHEN tag = 'VB' THEN 'VERB' ELSE '' END"
)
TAGGED = (K.INFORMAL_LOWER, K.TOKENS, K.TAGGED_SQL)


@query(
    "join_03_match_tagged_dot",
    with_sql(
        *TAGGED,
        _keyed_sql(_TAG_KEYS),
        f"keyed AS (SELECT DISTINCT doc_id, tok || '.' || {_LETTER} AS gram FROM tagged)",
        select="SELECT k.doc_id, l.lexicon, k.gram, l.dim, l.value FROM keyed k JOIN lex l "
        "ON k.gram = l.term",
    ),
)
def match_tagged_dot(spark, sf):
    lex = L.inline_lexicon(spark, _keyed_rows(_TAG_KEYS))
    return L.match_tagged(K.tagged(spark, sf), lex, "dot")


@query(
    "join_03_match_tagged_hash",
    with_sql(
        *TAGGED,
        _keyed_sql(_WORD_KEYS),
        f"keyed AS (SELECT DISTINCT doc_id, tok, tok || '#' || {_WORDTAG} AS key FROM tagged)",
        select="SELECT k.doc_id, l.lexicon, k.tok AS gram, l.dim, l.value FROM keyed k JOIN lex l "
        "ON k.key = l.term",
    ),
)
def match_tagged_hash(spark, sf):
    """The derived tag depends on the token, so a token has one key and nothing collapses."""
    lex = L.inline_lexicon(spark, _keyed_rows(_WORD_KEYS))
    return L.match_tagged(K.tagged(spark, sf), lex, "hash")


def _senses(spark, sf):
    """A sense table of the corpus words: letter and scores follow from length and count."""
    toks = K.words(spark, sf).select(F.explode("toks").alias("word"))
    counts = toks.groupBy("word").agg(F.count("*").alias("n")).where(F.length("word") > 0)
    letters = F.array(*[F.lit(x) for x in "vnar"])
    senses = F.explode(F.sequence(F.lit(1), (F.col("n") % 3 + 1).cast("int"))).alias("sense")
    rows = counts.select("word", "n", senses)
    pos = ((F.length("word") + F.col("sense")) % 5) / 8
    neg = ((F.col("n") + F.col("sense")) % 4) / 8
    return rows.select(
        "word",
        F.element_at(letters, (F.length("word") % 4 + 1).cast("int")).alias("tag"),
        "sense",
        pos.alias("pos_score"),
        neg.alias("neg_score"),
        (1 - (pos + neg)).alias("obj_score"),
    )


_SENSES_SQL = (
    "wcounts AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word "
    "FROM documents) WHERE length(word) > 0 GROUP BY word), "
    "senses AS (SELECT word, ['v', 'n', 'a', 'r'][CAST(length(word) % 4 + 1 AS INTEGER)] AS letter, "
    "sense, ((length(word) + sense) % 5) / 8.0::DOUBLE AS pos_score, ((n + sense) % 4) / 8.0::DOUBLE "
    "AS neg_score FROM (SELECT word, n, unnest(range(1, n % 3 + 2)) AS sense FROM wcounts))"
)


def _synset_sql(table: str) -> str:
    return (
        f"prefixed AS (SELECT n.doc_id, n.pos, n.prefixed AS tok, {_LETTER} AS letter FROM negated n "
        "JOIN tagged t ON n.doc_id = t.doc_id AND n.pos = t.pos), "
        "scored AS (SELECT p.doc_id, p.pos, p.tok, CASE WHEN contains(p.tok, 'NEG_') THEN s.neg_score "
        "ELSE s.pos_score END AS pos_score, CASE WHEN contains(p.tok, 'NEG_') THEN s.pos_score ELSE "
        "s.neg_score END AS neg_score, 1 - (s.pos_score + s.neg_score) AS obj_score FROM prefixed p "
        f"JOIN {table} s ON replace(p.tok, 'NEG_', '') = s.word AND p.letter = s.letter)"
    )


def _negated_tagged(spark, sf):
    docs = K.informal(spark, sf)
    both = F.arrays_zip("toks", T.negate_tokens(F.col("toks"), "prefix").alias("neg"))
    rows = docs.select("doc_id", F.posexplode(both).alias("pos", "t"))
    tags = F.array(*[F.lit(t) for t in K.TAGS])
    return rows.select(
        "doc_id",
        "pos",
        F.col("t.neg").alias("tok"),
        F.element_at(tags, (F.length("t.toks") % len(K.TAGS) + 1).cast("int")).alias("tag"),
    )


_SCORED = (
    "SELECT doc_id, count(*) AS n, sum(pos)::BIGINT AS places, sum(pos_score) AS pos_score, "
    "sum(neg_score) AS neg_score, round(sum(obj_score), 6) AS obj_score FROM scored GROUP BY doc_id"
)
_FIRST = "firsts AS (SELECT * FROM senses WHERE sense = 1)"
_MEAN = (
    "means AS (SELECT word, letter, avg(pos_score) AS pos_score, avg(neg_score) AS neg_score "
    "FROM senses GROUP BY word, letter)"
)
_NEG_TAGGED = (K.INFORMAL_LOWER, K.TOKENS, K.TAGGED_SQL, K.NEGATION, _SENSES_SQL)


def _per_doc(rows):
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.sum("pos").alias("places"),
        F.sum("pos_score").alias("pos_score"),
        F.sum("neg_score").alias("neg_score"),
        F.round(F.sum("obj_score"), 6).alias("obj_score"),
    )


@query(
    "join_04_match_synsets_first",
    with_sql(*_NEG_TAGGED, _FIRST, _synset_sql("firsts"), select=_SCORED),
)
def synsets_first(spark, sf):
    return _per_doc(L.match_synsets(_negated_tagged(spark, sf), _senses(spark, sf), "first"))


@query(
    "join_04_match_synsets_mean",
    with_sql(
        *_NEG_TAGGED,
        _MEAN,
        _synset_sql("means"),
        select=_SCORED.replace("sum(pos_score)", "round(sum(pos_score), 6)").replace(
            "sum(neg_score)", "round(sum(neg_score), 6)"
        ),
    ),
)
def synsets_mean(spark, sf):
    rows = _per_doc(L.match_synsets(_negated_tagged(spark, sf), _senses(spark, sf), "mean"))
    return rows.withColumns({c: F.round(c, 6) for c in ("pos_score", "neg_score")})


@query(
    "join_05_cluster_features",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        select="SELECT DISTINCT doc_id, 'CLUST_' || length(tok) || tok[1] AS name, 1.0::DOUBLE AS value "
        "FROM tokens WHERE length(tok) > 1",
    ),
)
def clusters(spark, sf):
    docs = K.words(spark, sf)
    words = docs.select(F.explode("toks").alias("word")).distinct().where(F.length("word") > 1)
    table = words.select(
        "word", F.concat(F.length("word").cast("string"), F.substring("word", 1, 1)).alias("cluster")
    )
    return C.cluster_features(docs, table)


# ---------------------------------------------------------------- message statistics

_OPINION_STATS = (
    "coalesce(avg(m.value), 0) AS avg, coalesce(sum(m.value), 0) AS sum, coalesce(min(m.value), 0) AS "
    "min, coalesce(max(m.value), 0) AS max, count(*) FILTER (m.value < 0) AS negamt, "
    "count(*) FILTER (m.value > 0) AS posamt, CAST(sign(coalesce(sum(m.value), 0)) AS INTEGER) AS fpol"
)


def _opinion_sql(name: str) -> str:
    stats = _OPINION_STATS.replace("avg(m.value)", "round(avg(m.value), 6)")
    return (
        f"SELECT d.doc_id, '{name}' AS lexicon, {stats} FROM documents d LEFT JOIN matches m "
        "ON d.doc_id = m.doc_id GROUP BY d.doc_id"
    )


@query(
    "agg_01_opinion_features",
    with_sql(*NEGATED, K.lexicon_sql(OPINION), set_matches(), select=_opinion_sql(OPINION)),
)
def opinion_features(spark, sf):
    docs, matches = _set_negated(spark, sf)
    return L.opinion_features(matches, docs, [OPINION]).withColumn("avg", F.round("avg", 6))


@query(
    "agg_01_phrase_features",
    with_sql(*PLAIN, K.lexicon_sql(PHRASES), set_matches(), select=_opinion_sql(PHRASES)),
)
def phrase_features(spark, sf):
    docs = K.words(spark, sf)
    matches = L.match_terms(docs, K.lexicon(spark, PHRASES), [SPEC[PHRASES]])
    return L.opinion_features(matches, docs, [PHRASES]).withColumn("avg", F.round("avg", 6))


_EMOTION_STATS = (
    "SELECT doc_id, lexicon, dim, round(avg(value), 6) AS avg, sum(value) AS sum, min(value) AS min, "
    "max(value) AS max, {count} AS count FROM matches GROUP BY doc_id, lexicon, dim"
)


@query(
    "agg_02_emotion_features",
    with_sql(
        *NEGATED, K.lexicon_sql(EMOTION), set_matches(), select=_EMOTION_STATS.format(count="count(*)")
    ),
)
def emotion_features(spark, sf):
    rows = L.emotion_features(_set_negated(spark, sf, EMOTION)[1])
    return rows.withColumn("avg", F.round("avg", 6))


@query(
    "agg_02_emotion_terms",
    with_sql(
        *NEGATED,
        K.lexicon_sql(EMOTION),
        set_matches(),
        select="SELECT DISTINCT doc_id, lexicon || '_' || gram || '_' || dim AS name, value FROM matches "
        "WHERE abs(value) > 0.3",
    ),
)
def emotion_terms(spark, sf):
    return L.emotion_terms(_set_negated(spark, sf, EMOTION)[1], 0.3)


@query(
    "agg_03_tagged_emotion_features",
    with_sql(
        *TAGGED,
        _keyed_sql(_TAG_KEYS),
        f"keyed AS (SELECT DISTINCT doc_id, tok || '.' || {_LETTER} AS gram FROM tagged)",
        "matches AS (SELECT k.doc_id, l.lexicon, k.gram, l.dim, l.value FROM keyed k JOIN lex l "
        "ON k.gram = l.term)",
        select=_EMOTION_STATS.format(count="count(*) FILTER (value > 0)"),
    ),
)
def tagged_emotions(spark, sf):
    lex = L.inline_lexicon(spark, _keyed_rows(_TAG_KEYS))
    matches = L.match_tagged(K.tagged(spark, sf), lex, "dot")
    rows = L.emotion_features(matches, positive_only=True)
    return rows.withColumn("avg", F.round("avg", 6))


_SYNSET_COLS = ("pos_tot", "neg_tot", "obj_tot", "pos_avg", "neg_avg", "pos_avg_tre", "neg_avg_tre")


@query(
    "agg_04_synset_features",
    with_sql(
        *_NEG_TAGGED,
        _FIRST,
        _synset_sql("firsts"),
        "stats AS (SELECT d.doc_id, coalesce(sum(pos_score), 0) AS pos_tot, coalesce(sum(neg_score), 0) "
        "AS neg_tot, coalesce(sum(obj_score), 0) AS obj_tot, greatest(count(pos_score), 1) AS n, "
        "coalesce(sum(pos_score) FILTER (obj_score < 0.75), 0) AS pos_sub, "
        "coalesce(sum(neg_score) FILTER (obj_score < 0.75), 0) AS neg_sub, "
        "greatest(count(*) FILTER (obj_score < 0.75), 1) AS n_sub FROM documents d LEFT JOIN scored s "
        "ON d.doc_id = s.doc_id GROUP BY d.doc_id)",
        select="SELECT doc_id, round(pos_tot, 6) AS pos_tot, round(neg_tot, 6) AS neg_tot, "
        "round(obj_tot, 6) AS obj_tot, round(pos_tot / n, 6) AS pos_avg, round(neg_tot / n, 6) AS "
        "neg_avg, round(pos_sub / n_sub, 6) AS pos_avg_tre, round(neg_sub / n_sub, 6) AS neg_avg_tre, "
        "CAST(sign(pos_tot / n - neg_tot / n) AS INTEGER) AS decision FROM stats",
    ),
)
def synset_features(spark, sf):
    matches = L.match_synsets(_negated_tagged(spark, sf), _senses(spark, sf), "first")
    rows = L.synset_features(matches, K.documents(spark, sf))
    return rows.withColumns({c: F.round(c, 6) for c in _SYNSET_COLS})


@query(
    "agg_04_synset_terms",
    with_sql(
        *_NEG_TAGGED,
        _FIRST,
        _synset_sql("firsts"),
        "uniq AS (SELECT DISTINCT doc_id, tok, pos_score, neg_score, obj_score FROM scored)",
        "cells AS (SELECT doc_id, 'SWN_POS_' || tok AS name, pos_score AS value FROM uniq UNION ALL "
        "SELECT doc_id, 'SWN_NEG_' || tok, neg_score FROM uniq UNION ALL "
        "SELECT doc_id, 'SWN_OBJ_' || tok, obj_score FROM uniq)",
        select="SELECT doc_id, count(*) AS n, round(sum(value), 6) AS total, min(name) AS least, "
        "max(name) AS greatest FROM cells GROUP BY doc_id",
    ),
)
def synset_terms(spark, sf):
    matches = L.match_synsets(_negated_tagged(spark, sf), _senses(spark, sf), "first")
    cells = L.synset_terms(matches)
    return cells.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.round(F.sum("value"), 6).alias("total"),
        F.min("name").alias("least"),
        F.max("name").alias("greatest"),
    )


_SUMS = (
    "sums AS (SELECT doc_id, lexicon, dim, sum(value) AS value, CASE WHEN dim = 'polarity' THEN 'SUM_' "
    "|| lexicon ELSE lexicon || '_' || dim END AS name FROM matches GROUP BY doc_id, lexicon, dim)"
)


@query(
    "agg_05_lexicon_sums",
    with_sql(*BAG, K.lexicon_sql(), BAG_MATCHES, _SUMS, select="SELECT * FROM sums"),
)
def lexicon_sums(spark, sf):
    return L.lexicon_sums(_bag(spark, sf)[1])


@query(
    "agg_06_lexicon_agreement",
    with_sql(
        *BAG,
        K.lexicon_sql(),
        BAG_MATCHES,
        _SUMS,
        K.LABELED_SQL,
        select="SELECT s.*, b.label, CAST(CASE WHEN (s.value > 0.1 AND b.label = 1) OR (s.value < -0.1 "
        "AND b.label = -1) OR (s.value > -0.1 AND s.value < 0.1 AND b.label = 0) THEN 1 ELSE 0 END AS "
        "INTEGER) AS agrees FROM sums s JOIN labeled b ON s.doc_id = b.doc_id",
    ),
)
def agreement(spark, sf):
    sums = L.lexicon_sums(_bag(spark, sf)[1])
    return L.lexicon_agreement(sums, K.labels_only(spark, sf))


_KINDS = ("words", "bigrams", "trigrams", "gapped")


@query(
    "agg_07_lexicon_usage",
    with_sql(
        *BAG,
        K.lexicon_sql(),
        "hits AS (SELECT DISTINCT term, lexicon FROM lex l WHERE " + EFFECTIVE + ")",
        "used AS (SELECT h.lexicon, count(DISTINCT g.doc_id) AS messages, "
        + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in _KINDS)
        + " FROM allgrams g JOIN hits h ON g.gram = h.term GROUP BY h.lexicon)",
        "totals AS (SELECT (SELECT count(*) FROM documents) AS total_messages, "
        + ", ".join(f"count(*) FILTER (kind = '{k}') AS total_{k}" for k in _KINDS)
        + " FROM allgrams)",
        select="SELECT *, "
        + ", ".join(f"round({k} / total_{k}, 9) AS share_{k}" for k in ("messages", *_KINDS))
        + " FROM used CROSS JOIN totals",
    ),
)
def usage(spark, sf):
    docs, matches = _bag(spark, sf)
    rows = L.lexicon_usage(docs, matches)
    return rows.withColumns({f"share_{k}": F.round(f"share_{k}", 9) for k in ("messages", *_KINDS)})


_FOUND = "string_agg(gram || '=' || dim || '=' || value, '|' ORDER BY gram, dim, value)"


@query(
    "agg_08_found_by_lexicon",
    with_sql(
        *BAG,
        K.lexicon_sql(),
        BAG_MATCHES,
        select=f"SELECT doc_id, lexicon, {_FOUND} AS found, count(*) AS total FROM matches "
        "GROUP BY doc_id, lexicon",
    ),
)
def found_by_lexicon(spark, sf):
    rows = L.found_by_lexicon(_bag(spark, sf)[1])
    text = F.transform("found", lambda x: F.concat_ws("=", x["gram"], x["dim"], x["value"]))
    return rows.withColumn("found", F.array_join(text, "|"))


@query(
    "agg_08_found_by_term",
    with_sql(
        *BAG,
        K.lexicon_sql(),
        BAG_MATCHES,
        "cells AS (SELECT DISTINCT doc_id, gram, CASE WHEN dim = 'polarity' THEN lexicon ELSE lexicon || "
        "'_' || dim END AS key, value FROM matches)",
        select="SELECT doc_id, gram, string_agg(key || '=' || value, '|' ORDER BY key) AS values_text "
        "FROM cells GROUP BY doc_id, gram",
    ),
)
def found_by_term(spark, sf):
    rows = L.found_by_term(_bag(spark, sf)[1])
    entries = F.transform(
        F.array_sort(F.map_entries("values")), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return rows.select("doc_id", "gram", F.array_join(entries, "|").alias("values_text"))


@query(
    "agg_08_found_totals",
    with_sql(
        *BAG,
        K.lexicon_sql(),
        BAG_MATCHES,
        select="SELECT doc_id, kind, count(DISTINCT gram) AS total FROM matches GROUP BY doc_id, kind",
    ),
)
def found_totals(spark, sf):
    return L.found_totals(_bag(spark, sf)[1])


@query(
    "agg_09_term_lexicon_features",
    with_sql(
        *BAG,
        K.lexicon_sql(),
        BAG_MATCHES,
        select="SELECT DISTINCT doc_id, CASE WHEN dim = 'polarity' THEN lexicon || '_' || gram ELSE "
        "lexicon || '_' || gram || '_' || dim END AS name, value FROM matches",
    ),
)
def term_lexicon(spark, sf):
    return L.term_lexicon_features(_bag(spark, sf)[1])


@query(
    "agg_10_polarity_summary",
    with_sql(
        K.INFORMAL_LOWER,
        K.TOKENS,
        K.NEGATION,
        K.lexicon_sql(OPINION, PHRASES),
        "names AS (SELECT DISTINCT lexicon FROM lex)",
        "cells AS (SELECT n.doc_id, m.lexicon, n.pos, n.inside, coalesce(l.value, 0) AS value FROM "
        "negated n CROSS JOIN names m LEFT JOIN lex l ON l.term = n.tok AND l.lexicon = m.lexicon)",
        "ends AS (SELECT doc_id, max(pos) AS last_pos FROM tokens GROUP BY doc_id)",
        "kinds AS (SELECT DISTINCT doc_id, inside AS negated FROM negated)",
        select="SELECT s.doc_id, c.lexicon, s.negated, count(*) FILTER (c.inside = s.negated AND c.value "
        "> 0) AS count, max(CASE WHEN c.inside = s.negated THEN c.value ELSE 0 END) AS max, "
        "sum(CASE WHEN c.inside = s.negated THEN c.value ELSE 0 END) AS sum, "
        "max(CASE WHEN c.pos = e.last_pos AND c.inside = s.negated THEN c.value END) AS last "
        "FROM kinds s JOIN cells c ON s.doc_id = c.doc_id JOIN ends e ON e.doc_id = s.doc_id "
        "GROUP BY s.doc_id, c.lexicon, s.negated",
    ),
)
def polarity_summary(spark, sf):
    lex = K.lexicon(spark, OPINION, PHRASES)
    return L.polarity_summary(K.informal(spark, sf), lex, [OPINION, PHRASES])


def _sequence_sql(gram: str, guard: str, kind: str) -> str:
    return with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        K.GRAMS,
        K.lexicon_sql(kind),
        f"seq AS (SELECT doc_id, pos, {gram} AS gram FROM ahead WHERE {guard})",
        "cells AS (SELECT s.doc_id, s.pos, coalesce(l.value, 0) AS value, max(s.pos) OVER (PARTITION BY "
        "s.doc_id) AS last_pos FROM seq s LEFT JOIN lex l ON s.gram = l.term)",
        select="SELECT d.doc_id, coalesce(max(value), 0) AS P_MAX, coalesce(sum(value), 0) AS P_SUM, "
        "count(*) FILTER (value > 0) AS P_COUNT, coalesce(max(CASE WHEN pos = last_pos AND value > 0 "
        "THEN 1 ELSE 0 END), 0) AS P_LASPOS FROM documents d LEFT JOIN cells c ON d.doc_id = c.doc_id "
        "GROUP BY d.doc_id",
    )


def _sequence(spark, sf, grams, kind):
    lex = K.lexicon(spark, kind).where(F.col("value") != 0)
    return L.sequence_stats(K.words(spark, sf), grams, lex, "P")


@query("agg_11_sequence_stats_unigram", _sequence_sql("a", "TRUE", OPINION))
def sequence_unigram(spark, sf):
    return _sequence(spark, sf, F.col("toks"), OPINION)


@query("agg_11_sequence_stats_bigram", _sequence_sql("a || ' ' || b", "b IS NOT NULL", PHRASES))
def sequence_bigram(spark, sf):
    return _sequence(spark, sf, T.ngram_array(F.col("toks"), 2), PHRASES)


# ---------------------------------------------------------------- blocks and extension points

@query("lexicon_feature_blocks")
def feature_blocks(spark, sf):
    """All lexicons with their own settings as one feature table."""
    docs = K.informal(spark, sf)
    rows = L.lexicon_features(docs, K.lexicon(spark), SPECS)
    return rows.groupBy("block", "name").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")
    )


@query(
    "udf_02_own_scoring",
    with_sql(
        *NEGATED,
        K.lexicon_sql(OPINION),
        set_matches(),
        select="SELECT doc_id, max(value) - min(value) AS spread FROM matches GROUP BY doc_id",
    ),
)
def own_scoring(spark, sf):
    def spread(matches):
        return matches.groupBy("doc_id").agg(
            (F.max("value") - F.min("value")).alias("spread")
        )

    return _set_negated(spark, sf)[1].transform(spread)
