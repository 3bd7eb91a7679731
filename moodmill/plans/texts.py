"""Text queries: tokenizing, normalizing, negation, grams, surface features, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.config import BlockSpec, CleanSpec
from moodmill.functions import patterns as P
from moodmill.functions import text as T
from moodmill.operators import corpus as C
from moodmill.operators import profile as R
from moodmill.plans import common as K
from moodmill.plans.common import query, with_sql

JOINED = "array_to_string(toks, ' ') AS toks"


def joined(docs):
    return docs.select("doc_id", F.array_join("toks", " ").alias("toks"))


def ordered(column: str) -> str:
    return f"string_agg({column}, ' ' ORDER BY pos)"


# ---------------------------------------------------------------- raw text

_ENTITIES = "html"
for _name, _char in P.BASIC_ENTITIES:
    _ENTITIES = f"replace({_ENTITIES}, {K.lit(_name)}, {K.lit(_char)})"


@query("txt_01_unescape", f"SELECT page_id, {_ENTITIES} AS html FROM pages")
def unescape(spark, sf):
    return C.unescape_text(K.table(spark, sf, "pages").select("page_id", "html"), "html")


@query("txt_01_unescape_named", f"SELECT page_id, {_ENTITIES} AS html FROM pages")
def unescape_named(spark, sf):
    rows = K.table(spark, sf, "pages").select("page_id", "html")
    return C.unescape_text(rows, "html", full=False)


@query(
    "txt_02_squeeze",
    r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{00a0}\x{1680}\x{180e}\x{202f}\x{205f}\x{3000}"
    r"\x{2000}-\x{200a}]+', ' ', 'g')) AS text FROM documents",
)
def squeeze(spark, sf):
    return C.squeeze_text(K.documents(spark, sf))


_EDGES = (
    f"regexp_replace(regexp_replace(text, {K.lit(P.EDGE_LEFT)}, '\\1\\2 \\3', 'g'), "
    f"{K.lit(P.EDGE_RIGHT)}, '\\1 \\2\\3', 'g')"
)


@query("txt_03_split_edges", f"SELECT doc_id, {_EDGES} AS text FROM documents")
def split_edges(spark, sf):
    return C.split_edges(K.documents(spark, sf))


# ---------------------------------------------------------------- tokenizers


@query("txt_04_tokenize_social")
def tokenize_social(spark, sf):
    return joined(C.tokenize(K.documents(spark, sf), "social"))


@query(
    "txt_05_tokenize_informal",
    f"SELECT doc_id, array_to_string(regexp_extract_all(text, {K.lit(P.INFORMAL_TOKEN)}), ' ') "
    "AS toks FROM documents",
)
def tokenize_informal(spark, sf):
    return joined(C.tokenize(K.documents(spark, sf), "informal"))


@query("txt_05_tokenize_formal")
def tokenize_formal(spark, sf):
    return joined(C.tokenize(K.documents(spark, sf), "formal"))


@query(
    "txt_05_tokenize_space",
    "SELECT doc_id, len(string_split(text, ' ')) AS n, string_split(text, ' ')[1] AS first_tok, "
    "string_split(text, ' ')[-1] AS last_tok FROM documents",
)
def tokenize_space(spark, sf):
    docs = C.tokenize(K.documents(spark, sf), "space")
    return docs.select(
        "doc_id",
        F.size("toks").cast("long").alias("n"),
        F.element_at("toks", 1).alias("first_tok"),
        F.element_at("toks", -1).alias("last_tok"),
    )


@query(
    "txt_05_tokenize_word",
    f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), {K.lit(P.WORD_TOKEN)}), ' ') "
    "AS toks FROM documents",
)
def tokenize_word(spark, sf):
    return joined(C.tokenize(K.documents(spark, sf), "word"))


@query(
    "txt_06_tokenize_strip_mentions",
    f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(text, "
    f"{K.lit(P.HANDLE)}, ' ', 'g'), {K.lit(P.INFORMAL_TOKEN)}), lambda x: x NOT IN "
    f"{K.in_list(P.HANDLE_STOPS)}), ' ') AS toks FROM documents",
)
def tokenize_strip_mentions(spark, sf):
    return joined(C.tokenize_strip_mentions(K.documents(spark, sf)))


# ---------------------------------------------------------------- rewriting


@query(
    "txt_07_split_contractions",
    with_sql(
        K.WORD_LISTS,
        select="SELECT doc_id, array_to_string(flatten(list_transform(toks, lambda t: CASE WHEN "
        "regexp_matches(t || '''s', '[\\p{L}\\p{N}_]''s$') THEN [t, '''s'] ELSE [t || '''s'] END)), "
        "' ') AS toks FROM lists",
    ),
)
def split_contractions(spark, sf):
    """Every token gets a clitic, which must come off again after word characters."""
    docs = K.words(spark, sf)
    owned = C.map_tokens(docs, lambda t: F.transform(t, lambda x: F.concat(x, F.lit("'s"))))
    return joined(C.map_tokens(owned, T.split_contractions))


@query("txt_08_lower", with_sql(K.INFORMAL_LOWER, select=f"SELECT doc_id, {JOINED} FROM lists"))
def lower(spark, sf):
    docs = C.tokenize(K.documents(spark, sf), "informal")
    return joined(C.map_tokens(docs, T.lower_tokens))


_PAGE_LISTS = (
    "lists AS (SELECT page_id AS doc_id, string_split(url || ' ' || html, ' ') AS toks FROM pages)"
)


def _normalized(test: str, mark: str) -> str:
    return with_sql(
        _PAGE_LISTS,
        select="SELECT doc_id, array_to_string(list_transform(toks, lambda t: CASE WHEN "
        f"{test} THEN '{mark}' ELSE t END), ' ') AS toks FROM lists",
    )


def _page_tokens(spark, sf):
    return C.tokenize(K.pages(spark, sf), "space")


_INFORMAL_PAGES = (
    f"lists AS (SELECT page_id AS doc_id, regexp_extract_all(url || ' ' || html, "
    f"{K.lit(P.INFORMAL_TOKEN)}) AS toks FROM pages)"
)


@query(
    "txt_09_mark_mentions",
    with_sql(
        K.INFORMAL_LISTS,
        select="SELECT doc_id, array_to_string(list_transform(toks, lambda t: CASE WHEN "
        "starts_with(t, '@') THEN '@MENTION' ELSE t END), ' ') AS toks FROM lists",
    ),
)
def mark_mentions(spark, sf):
    docs = K.documents(spark, sf).withColumn("text", F.lower("text"))
    return joined(C.normalize_tokens(C.tokenize(docs, "informal"), mentions=True))


@query(
    "txt_10_mark_hashtags",
    with_sql(
        K.INFORMAL_LISTS,
        select="SELECT doc_id, array_to_string(list_transform(toks, lambda t: CASE WHEN "
        "starts_with(t, '#') THEN '#HASH' ELSE t END), ' ') AS toks FROM lists",
    ),
)
def mark_hashtags(spark, sf):
    docs = K.documents(spark, sf).withColumn("text", F.lower("text"))
    return joined(C.normalize_tokens(C.tokenize(docs, "informal"), hashtags=True))


@query("txt_11_mark_urls", _normalized("starts_with(t, 'http')", "HTTP"))
def mark_urls(spark, sf):
    return joined(C.normalize_tokens(_page_tokens(spark, sf), urls=True))


@query(
    "txt_12_mark_numbers",
    with_sql(
        _INFORMAL_PAGES,
        select="SELECT doc_id, array_to_string(list_transform(toks, lambda t: CASE WHEN "
        f"regexp_matches(t, {K.lit(P.NUMBER)}) THEN 'NUMBER' ELSE t END), ' ') AS toks FROM lists",
    ),
)
def mark_numbers(spark, sf):
    docs = C.tokenize(K.pages(spark, sf), "informal")
    return joined(C.normalize_tokens(docs, numbers=True))


def _without(stops: tuple[str, ...]) -> str:
    return (
        "SELECT doc_id, array_to_string(list_filter(toks, lambda t: t NOT IN "
        f"{K.in_list(stops)}), ' ') AS toks FROM lists"
    )


@query("txt_13_remove_stops", with_sql(K.INFORMAL_LOWER, select=_without(P.SHORT_STOPS)))
def remove_stops(spark, sf):
    return joined(C.remove_stops(K.informal(spark, sf), P.SHORT_STOPS))


@query("txt_13_remove_stops_punct", with_sql(K.INFORMAL_LOWER, select=_without(P.SHORT_STOPS_PUNCT)))
def remove_stops_punct(spark, sf):
    return joined(C.remove_stops(K.informal(spark, sf), P.SHORT_STOPS_PUNCT))


@query("txt_13_remove_stops_english")
def remove_stops_english(spark, sf):
    return joined(C.remove_stops(K.informal(spark, sf)))


@query(
    "txt_13_remove_listed",
    with_sql(
        K.INFORMAL_LOWER,
        K.TOKENS,
        "common AS (SELECT tok FROM tokens GROUP BY tok HAVING count(*) > 100)",
        select="SELECT tok, count(*) AS n FROM tokens WHERE tok NOT IN (SELECT tok FROM common) "
        "GROUP BY tok",
    ),
)
def remove_listed(spark, sf):
    """The stop list is the corpus' own frequent words, a table of any length."""
    docs = K.informal(spark, sf)
    counts = R.term_counts(docs)
    listed = counts.where(F.col("n") > 100).select(F.col("tok").alias("word"))
    return C.remove_listed(counts, listed)


def _clean_steps(source: str) -> str:
    return (
        f"SELECT doc_id, array_to_string(list_transform(list_filter({source}, lambda t: t NOT IN "
        f"{K.in_list(P.SHORT_STOPS)}), lambda t: CASE WHEN starts_with(t, '@') THEN '@MENTION' "
        f"WHEN starts_with(t, 'http') THEN 'HTTP' WHEN regexp_matches(t, {K.lit(P.NUMBER)}) "
        "THEN 'NUMBER' ELSE t END), ' ') AS toks"
    )


@query("txt_14_clean", with_sql(K.INFORMAL_LOWER, select=_clean_steps("toks") + " FROM lists"))
def clean(spark, sf):
    return joined(C.clean(K.documents(spark, sf), CleanSpec(tokenizer="informal")))


@query("txt_14_clean_social")
def clean_social(spark, sf):
    return joined(C.clean(K.documents(spark, sf)))


@query(
    "txt_15_clean_negated",
    with_sql(
        K.INFORMAL_LOWER,
        K.TOKENS,
        K.NEGATION,
        "marked AS (SELECT doc_id, list(prefixed ORDER BY pos) AS toks FROM negated GROUP BY doc_id)",
        select=_clean_steps("toks") + " FROM marked",
    ),
)
def clean_negated(spark, sf):
    return joined(C.clean(K.documents(spark, sf), CleanSpec(tokenizer="informal", negate="prefix")))


@query(
    "txt_16_clean_configured",
    with_sql(
        f"lists AS (SELECT doc_id, regexp_extract_all(text, {K.lit(P.INFORMAL_TOKEN)}) AS toks "
        "FROM documents)",
        "kept AS (SELECT doc_id, len(list_filter(toks, lambda t: regexp_matches(t, '\\p{Lu}') AND NOT "
        "regexp_matches(t, '\\p{Ll}'))) AS n_caps, len(list_filter(toks, lambda t: starts_with(t, '@'))) "
        "AS n_mentions, len(list_filter(toks, lambda t: starts_with(t, '#'))) AS n_hashtags, "
        f"list_transform(list_filter(toks, lambda t: t NOT IN {K.in_list(P.SHORT_STOPS)}), "
        "lambda t: lower(t)) AS toks FROM lists)",
        select="SELECT doc_id, n_caps, n_mentions, n_hashtags, array_to_string(list_transform(toks, "
        "lambda t: CASE WHEN starts_with(t, '@') THEN '@MENTION' WHEN starts_with(t, '#') THEN '#HASH' "
        f"WHEN starts_with(t, 'http') THEN 'HTTP' WHEN regexp_matches(t, {K.lit(P.NUMBER)}) "
        "THEN 'NUMBER' ELSE t END), ' ') AS cleaned FROM kept",
    ),
)
def clean_configured(spark, sf):
    spec = CleanSpec(tokenizer="informal", stops_first=True, hashtags=True)
    docs = C.clean(K.documents(spark, sf), spec)
    counts = ("n_caps", "n_mentions", "n_hashtags")
    return docs.select("doc_id", *[F.col(c).cast("long").alias(c) for c in counts], "cleaned")


@query(
    "txt_17_negation_prefix",
    with_sql(
        K.INFORMAL_LOWER,
        K.TOKENS,
        K.NEGATION,
        select=f"SELECT doc_id, {ordered('prefixed')} AS toks FROM negated GROUP BY doc_id",
    ),
)
def negation_prefix(spark, sf):
    return joined(C.mark_negation(K.informal(spark, sf), "prefix"))


@query(
    "txt_18_negation_suffix",
    with_sql(
        K.INFORMAL_LOWER,
        K.TOKENS,
        K.NEGATION,
        select=f"SELECT doc_id, {ordered('suffixed')} AS toks, sum(CASE WHEN inside THEN 1 ELSE 0 END)"
        "::BIGINT AS n_negated FROM negated GROUP BY doc_id",
    ),
)
def negation_suffix(spark, sf):
    docs = C.mark_negation(K.informal(spark, sf), "suffix")
    return docs.select(
        "doc_id", F.array_join("toks", " ").alias("toks"), F.col("n_negated").cast("long")
    )


# ---------------------------------------------------------------- tags


@query(
    "txt_19_filter_tags",
    with_sql(
        K.INFORMAL_LOWER,
        K.TOKENS,
        K.TAGGED_SQL,
        select=f"SELECT doc_id, {ordered('tok')} AS toks FROM tagged WHERE tag IN ('NN', 'RB', 'JJ') "
        "GROUP BY doc_id",
    ),
)
def filter_tags(spark, sf):
    kept = C.filter_tags(K.tagged(spark, sf), ("NN", "RB", "JJ"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "tok")))
    return kept.groupBy("doc_id").agg(
        F.array_join(F.transform(in_order, lambda p: p["tok"]), " ").alias("toks")
    )


_GROUP_CASE = "CASE " + " ".join(
    f"WHEN tag IN {K.in_list(tags)} THEN '{{{g}}}'" for g, tags in P.PENN_GROUPS.items()
) + " ELSE '' END"


@query(
    "txt_20_map_tags",
    with_sql(
        K.INFORMAL_LOWER,
        K.TOKENS,
        K.TAGGED_SQL,
        select="SELECT tag, "
        + _GROUP_CASE.format(**P.SYNSET_LETTERS)
        + " AS letter, "
        + _GROUP_CASE.format(**{g: g.upper() for g in P.PENN_GROUPS})
        + " AS word, count(*) AS n FROM tagged GROUP BY ALL",
    ),
)
def map_tags(spark, sf):
    rows = C.map_tags(K.tagged(spark, sf), "synset").withColumnRenamed("mapped", "letter")
    rows = C.map_tags(rows, "word").withColumnRenamed("mapped", "word")
    return rows.groupBy("tag", "letter", "word").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- grams


def _gram_sql(n: int, joiner: str) -> str:
    names = ["a", "b", "c", "d"][:n]
    gram = f" || '{joiner}' || ".join(names)
    return with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        K.GRAMS,
        select=f"SELECT {gram} AS gram, count(*) AS n FROM ahead WHERE {names[-1]} IS NOT NULL "
        "GROUP BY gram",
    )


def _gram_counts(docs):
    grams = docs.select(F.explode_outer("grams").alias("gram")).where("gram IS NOT NULL")
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


for _n, _joiner, _name in (
    (2, " ", "bigrams"),
    (3, "_", "trigrams"),
    (4, " ", "fourgrams"),
):

    def _grams(spark, sf, n=_n, joiner=_joiner):
        return _gram_counts(C.ngrams(K.words(spark, sf), n, joiner))

    query(f"txt_21_{_name}", _gram_sql(_n, _joiner))(_grams)


@query(
    "txt_22_gapped_ngrams",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        K.GRAMS,
        f"gapped AS ({K.gap_variants('---')})",
        select="SELECT doc_id, count(*) AS n, sum(length(gram))::BIGINT AS n_chars, min(gram) AS least, "
        "max(gram) AS greatest FROM gapped GROUP BY doc_id",
    ),
)
def gapped(spark, sf):
    """Counted per message inside the row: the sevenfold list never leaves it."""
    docs = K.words(spark, sf)

    def figures(grams):
        chars = F.aggregate(grams, F.lit(0).cast("long"), lambda s, g: s + F.length(g))
        return F.struct(
            F.size(grams).cast("long").alias("n"),
            chars.alias("n_chars"),
            F.array_min(grams).alias("least"),
            F.array_max(grams).alias("greatest"),
        )

    made_once = T.let(T.gapped_array(F.col("toks")), lambda grams: F.array(figures(grams)))
    return docs.where(F.size("toks") >= 3).select("doc_id", F.inline(made_once))


@query(
    "txt_22_gapped_in_vocabulary",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        K.GRAMS,
        f"gapped AS ({K.gap_variants('-')})",
        select="SELECT gram, count(*) AS n FROM gapped WHERE gram IN ('the-the', 'the-and', 'of-the', "
        "'de-la') GROUP BY gram",
    ),
)
def gapped_vocabulary(spark, sf):
    vocabulary = K.lexicon(spark, K.PHRASES).where(F.col("term").contains("---"))
    vocabulary = vocabulary.select(F.replace("term", F.lit("---"), F.lit("-")).alias("gram"))
    hits = C.gapped_ngrams(K.words(spark, sf), "-", vocabulary)
    return hits.groupBy("gram").agg(F.count("*").alias("n"))


def _char_sql(n: int) -> str:
    gram = " || ".join(["ch"] + [f"lead(ch, {i}) OVER w" for i in range(1, n)])
    return (
        f"SELECT gram, count(*) AS n FROM (SELECT {gram} AS gram FROM (SELECT doc_id, "
        "generate_subscripts(c, 1) AS pos, unnest(c) AS ch FROM (SELECT doc_id, "
        "string_split(text, '') AS c FROM documents)) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) "
        "WHERE gram IS NOT NULL GROUP BY gram"
    )


for _n in (3, 4, 5):

    def _chars(spark, sf, n=_n):
        return C.gram_counts(C.char_ngrams(K.documents(spark, sf), n))

    query(f"txt_23_char_{_n}grams", _char_sql(_n))(_chars)


# ---------------------------------------------------------------- surface

_CAPS = "regexp_matches(t, '\\p{Lu}') AND NOT regexp_matches(t, '\\p{Ll}')"
_RAW_LISTS = "lists AS (SELECT doc_id, string_split(text, ' ') AS toks FROM documents)"
_RAW_INFORMAL = (
    f"lists AS (SELECT doc_id, regexp_extract_all(text, {K.lit(P.INFORMAL_TOKEN)}) AS toks "
    "FROM documents)"
)


def _count(test: str) -> str:
    return f"len(list_filter(toks, lambda t: {test}))::BIGINT"


def _longs(docs, *names):
    return docs.select("doc_id", *[F.col(c).cast("long").alias(c) for c in names])


@query(
    "txt_24_25_surface_counts",
    with_sql(
        _RAW_INFORMAL,
        select=f"SELECT doc_id, {_count(_CAPS)} AS n_caps, {_count('starts_with(t, ' + K.lit('@') + ')')} AS n_mentions, "
        f"{_count('starts_with(t, ' + K.lit('#') + ')')} AS n_hashtags FROM lists",
    ),
)
def surface(spark, sf):
    docs = C.surface_counts(C.tokenize(K.documents(spark, sf), "informal"))
    return _longs(docs, "n_caps", "n_mentions", "n_hashtags")


@query(
    "txt_26_tag_counts",
    with_sql(
        K.INFORMAL_LOWER,
        K.TOKENS,
        K.TAGGED_SQL,
        select="SELECT doc_id, 'POS_' || tag AS name, count(*)::DOUBLE AS value FROM tagged "
        "GROUP BY doc_id, tag",
    ),
)
def tag_counts(spark, sf):
    return C.tag_counts(K.tagged(spark, sf))


_ELONG = (
    "len(list_filter(range(1, length(t) - 1), lambda i: t[i] = t[i + 1] AND t[i] = t[i + 2] "
    "AND t[i] <> chr(10))) > 0"
)


@query(
    "txt_27_elongated",
    with_sql(
        _RAW_LISTS,
        select=f"SELECT doc_id, {_count(_ELONG)} AS n_words, "
        f"{_count(f'regexp_matches(t, {K.lit(P.ELONGATED_PUNCT)})')} AS n_marks FROM lists",
    ),
)
def elongated(spark, sf):
    docs = C.elongated(C.tokenize(K.documents(spark, sf), "space"))
    return docs.select(
        "doc_id",
        F.size("long_words").cast("long").alias("n_words"),
        F.size("long_marks").cast("long").alias("n_marks"),
    )


@query(
    "txt_28_last_token_punct",
    with_sql(
        _RAW_LISTS,
        select="SELECT doc_id, regexp_matches(toks[-1], '[!?]') AS ends_marked FROM lists",
    ),
)
def last_punct(spark, sf):
    docs = C.last_token_punct(C.tokenize(K.documents(spark, sf), "space"))
    return docs.select("doc_id", "ends_marked")


_FACE_HAPPY = f"regexp_matches(t, {K.lit(P.HAPPY_FACE)})"
_FACE_SAD = f"regexp_matches(t, {K.lit(P.SAD_FACE)})"
_FACE_OK = f"NOT regexp_matches(t, {K.lit(P.FACE_EXCLUDED)})"


@query(
    "txt_29_emoticon_flags",
    with_sql(
        "lists AS (SELECT page_id AS doc_id, string_split(url || ' ' || html, ' ') AS toks FROM pages)",
        select=f"SELECT doc_id, len(list_filter(toks, lambda t: {_FACE_OK} AND {_FACE_HAPPY})) > 0 "
        f"AS has_happy, len(list_filter(toks, lambda t: {_FACE_OK} AND {_FACE_SAD})) > 0 AS has_sad, "
        f"CASE WHEN {_FACE_HAPPY.replace('(t,', '(toks[-1],')} THEN 1 "
        f"WHEN {_FACE_SAD.replace('(t,', '(toks[-1],')} THEN -1 ELSE 0 END AS last_face FROM lists",
    ),
)
def emoticons(spark, sf):
    docs = C.emoticon_flags(_page_tokens(spark, sf))
    return docs.select("doc_id", "has_happy", "has_sad", "last_face")


_MIXED = f"regexp_matches(t, {K.lit(P.END_MIXED)}) AND contains(t, '!') AND contains(t, '?')"


@query(
    "txt_30_punct_counts",
    with_sql(
        "lists AS (SELECT doc_id, regexp_extract_all(text, '[!?]+|[^\\s!?]+') AS toks FROM documents)",
        select=f"SELECT doc_id, {_count(_CAPS)} AS n_caps, "
        f"{_count(f'regexp_matches(t, {K.lit(P.END_EXCLAMATION)})')} AS n_exclaim, "
        f"{_count(f'regexp_matches(t, {K.lit(P.END_QUESTION)})')} AS n_question, "
        f"{_count(_MIXED)} AS n_mixed FROM lists",
    ),
)
def punct(spark, sf):
    def marks_apart(text):
        return F.regexp_extract_all(text, F.lit(r"[!?]+|[^\s!?]+"), F.lit(0))

    docs = C.punct_counts(C.tokenize(K.documents(spark, sf), marks_apart))
    return _longs(docs, "n_caps", "n_exclaim", "n_question", "n_mixed")


@query(
    "txt_31_token_features",
    with_sql(
        _RAW_INFORMAL,
        f"counts AS (SELECT doc_id, {_count(_CAPS)} AS caps, "
        f"{_count('starts_with(t, ' + K.lit('@') + ')')} AS ats, "
        f"{_count('starts_with(t, ' + K.lit('#') + ')')} AS hashes FROM lists)",
        select="SELECT doc_id, 'TOKEN' AS block, unnest(list_distinct(toks)) AS name, 1.0::DOUBLE AS "
        "value FROM lists UNION ALL SELECT doc_id, 'STS', 'STS_ALL_CAPS', caps::DOUBLE FROM counts "
        "UNION ALL SELECT doc_id, 'STS', 'STS_MENTIONS', ats::DOUBLE FROM counts "
        "UNION ALL SELECT doc_id, 'STS', 'STS_HASH', hashes::DOUBLE FROM counts",
    ),
)
def token_features(spark, sf):
    return C.token_features(C.tokenize(K.documents(spark, sf), "informal"))


@query(
    "txt_32_labels",
    with_sql(
        K.LABELED_SQL,
        "named AS (SELECT doc_id, label AS code, CASE label WHEN 1 THEN 'positive' WHEN -1 THEN "
        "'negative' ELSE 'neutral' END AS name FROM labeled)",
        select="SELECT doc_id, name, code, code AS again, 0 AS objective, CAST(NULL AS INTEGER) AS "
        "unknown FROM named",
    ),
)
def labels(spark, sf):
    rows = K.labels_only(spark, sf).join(K.table(spark, sf, "documents").select("doc_id"), "doc_id")
    named = rows.select("doc_id", T.decode_label(F.col("label")).alias("name"))
    code = T.encode_label(F.col("name"))
    return named.select(
        "doc_id",
        "name",
        code.alias("code"),
        T.encode_label(T.decode_label(code)).alias("again"),
        T.encode_label(F.lit("objective")).alias("objective"),
        T.encode_label(F.concat("name", F.lit("?"))).alias("unknown"),
    )


@query(
    "txt_33_features_above",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        select="SELECT doc_id, tok AS name, count(*)::DOUBLE AS value FROM tokens GROUP BY doc_id, tok "
        "HAVING count(*) > 5",
    ),
)
def features_above(spark, sf):
    return C.features_above(R.bag_of_words(K.words(spark, sf)), 5)


@query(
    "txt_34_enabled_lexicons",
    with_sql(
        K.LEARNED_SQL,
        select="SELECT lexicon, count(*) AS terms FROM learned WHERE lexicon <> 'de' GROUP BY lexicon",
    ),
)
def enabled(spark, sf):
    config = spark.createDataFrame([("de", False), ("fr", True)], "lexicon string, enabled boolean")
    rows = C.enabled_lexicons(K.learned(spark, sf), config)
    return rows.groupBy("lexicon").agg(F.count("*").alias("terms"))


def _clusters(docs):
    """Words of the corpus clustered by length and first letter."""
    words = docs.select(F.explode("toks").alias("word")).distinct()
    return words.where(F.length("word") > 1).select(
        "word", F.concat(F.length("word").cast("string"), F.substring("word", 1, 1)).alias("cluster")
    )


_BLOCK_SUMS = (
    "SELECT block, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, sum(value) AS total "
    "FROM features GROUP BY block"
)


@query(
    "txt_35_feature_blocks",
    with_sql(
        _RAW_INFORMAL,
        "norm AS (SELECT doc_id, list_transform(toks, lambda t: lower(CASE WHEN starts_with(t, '@') "
        "THEN '@MENTION' WHEN starts_with(t, 'http') THEN 'HTTP' ELSE t END)) AS toks FROM lists)",
        "tokens AS (SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, "
        "unnest(toks) AS tok FROM norm)",
        K.NEGATION,
        f"surface AS (SELECT doc_id, {_count(_CAPS)} AS caps, "
        f"{_count('starts_with(t, ' + K.lit('@') + ')')} AS ats, "
        f"{_count('starts_with(t, ' + K.lit('#') + ')')} AS hashes, "
        f"{_count(_ELONG)} AS long_words, "
        f"{_count(f'regexp_matches(t, {K.lit(P.ELONGATED_PUNCT)})')} AS long_marks, "
        "regexp_matches(toks[-1], '[!?]')::INTEGER AS ends, "
        f"(len(list_filter(toks, lambda t: {_FACE_OK} AND {_FACE_HAPPY})) > 0)::INTEGER AS happy, "
        f"(len(list_filter(toks, lambda t: {_FACE_OK} AND {_FACE_SAD})) > 0)::INTEGER AS sad, "
        f"CASE WHEN {_FACE_HAPPY.replace('(t,', '(toks[-1],')} THEN 1 "
        f"WHEN {_FACE_SAD.replace('(t,', '(toks[-1],')} THEN -1 ELSE 0 END AS last_face, "
        "len(toks) AS n FROM lists)",
        "features AS (SELECT 'NEGATION' AS block, doc_id, sum(inside::INTEGER)::DOUBLE AS value "
        "FROM negated GROUP BY doc_id UNION ALL "
        "SELECT 'SURFACE', doc_id, unnest([caps, ats, hashes])::DOUBLE FROM surface UNION ALL "
        "SELECT 'ELONGATED', doc_id, long_words::DOUBLE FROM surface UNION ALL "
        "SELECT 'PUNCT', doc_id, unnest([long_marks, ends])::DOUBLE FROM surface WHERE n > 0 UNION ALL "
        "SELECT 'EMOTICON', doc_id, unnest([happy, sad, last_face])::DOUBLE FROM surface WHERE n > 0)",
        select=_BLOCK_SUMS,
    ),
)
def blocks(spark, sf):
    docs = K.documents(spark, sf)
    spec = BlockSpec(ngrams=False, char_ngrams=False, clusters=False)
    features = C.feature_blocks(docs, spec)
    return features.groupBy("block").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.sum("value").alias("total"),
    )


@query("txt_35_feature_blocks_all")
def blocks_all(spark, sf):
    """Every block at once; the gram blocks are counted inside the row."""
    docs = K.documents(spark, sf)
    tags = K.tagged(spark, sf)
    scores = C.feature_rows(
        K.documents(spark, sf, "n_chars"), "SCORE", {"LENGTH_SCORE": F.col("n_chars")}
    ).drop("block")
    features = C.feature_blocks(
        docs, tagged=tags, clusters=_clusters(K.informal(spark, sf)), scores=scores
    )
    return features.groupBy("block").agg(F.count("*").alias("n_rows"), F.sum("value").alias("total"))


@query(
    "txt_35_feature_rejects",
    "SELECT conv_id AS doc_id, 'no tokens' AS reason FROM conversations "
    f"WHERE len(regexp_extract_all(text, {K.lit(P.INFORMAL_TOKEN)})) = 0",
)
def rejects(spark, sf):
    rows = K.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return C.feature_rejects(rows)


@query(
    "txt_36_ids_by_class",
    with_sql(
        K.LABELED_SQL,
        select="SELECT CASE label WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END "
        "AS class, doc_id FROM labeled",
    ),
)
def by_class(spark, sf):
    return C.ids_by_class(K.labeled(spark, sf))


# ---------------------------------------------------------------- ordered views


@query(
    "win_01_running_state",
    with_sql(
        K.INFORMAL_LOWER,
        K.TOKENS,
        K.NEGATION,
        select="SELECT doc_id, tok, inside, count(*) AS n, sum(pos)::BIGINT AS places FROM negated "
        "GROUP BY doc_id, tok, inside",
    ),
)
def running_state(spark, sf):
    rows = C.running_state(K.informal(spark, sf))
    return rows.groupBy("doc_id", "tok", "inside").agg(
        F.count("*").alias("n"), F.sum("pos").alias("places")
    )


@query(
    "win_02_adjacent",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        K.GRAMS,
        select="SELECT a AS tok_1, b AS tok_2, c AS tok_3, count(*) AS n, min(pos) AS first_pos "
        "FROM ahead WHERE c IS NOT NULL GROUP BY a, b, c",
    ),
)
def adjacent(spark, sf):
    rows = C.adjacent(K.words(spark, sf), 3)
    return rows.groupBy("tok_1", "tok_2", "tok_3").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos")
    )


@query(
    "win_04_last_value",
    with_sql(
        K.WORD_LISTS,
        select="SELECT doc_id, CAST(len(toks) - 1 AS INTEGER) AS pos, toks[-1] AS tok FROM lists",
    ),
)
def last_value(spark, sf):
    return C.last_value_per_doc(K.words(spark, sf))


# ---------------------------------------------------------------- extension points


@query(
    "udf_01_own_tokenizer",
    "SELECT doc_id, array_to_string(string_split(text, ', '), '|') AS toks FROM documents",
)
def own_tokenizer(spark, sf):
    docs = C.tokenize(K.documents(spark, sf), lambda text: F.split(text, ", "))
    return docs.select("doc_id", F.array_join("toks", "|").alias("toks"))


@query(
    "snk_10_sanitize_keys",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        "counts AS (SELECT doc_id, tok, count(*) AS n FROM tokens GROUP BY doc_id, tok)",
        select="SELECT key, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN starts_with(tok, '$') OR "
        "contains(tok, '.') THEN '_' || replace(tok, '.', 'PP') ELSE tok END AS key, n FROM counts) "
        "GROUP BY key",
    ),
)
def sanitize(spark, sf):
    """Nested map per message: found -> token -> count."""
    docs = K.words(spark, sf)
    counts = F.map_from_entries(T.term_runs(F.col("toks")))
    nested = F.create_map(F.lit("found.tokens"), counts)
    clean = docs.select(T.sanitize_keys(nested, depth=2).alias("m"))
    rows = clean.select(F.explode(F.element_at("m", "_foundPPtokens")).alias("key", "n"))
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


@query(
    "snk_11_rename_keys",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        select="SELECT 'pre_' || tok || '_suf' AS name, count(*) AS n, 'pre_' || tok || '_suf' AS "
        "map_name FROM tokens GROUP BY tok",
    ),
)
def rename(spark, sf):
    from moodmill.sources import sinks

    docs = K.words(spark, sf)
    features = sinks.rename_features(R.bag_of_words(docs), "pre_", "_suf")
    totals = features.groupBy("name").agg(F.sum("value").cast("long").alias("n"))
    maps = docs.select(
        sinks.rename_keys(F.map_from_entries(T.term_runs(F.col("toks"))), "pre_", "_suf").alias("m")
    )
    names = maps.select(F.explode(F.map_keys("m")).alias("map_name")).distinct()
    return totals.join(names, F.col("name") == F.col("map_name"))
