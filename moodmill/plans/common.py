"""The query registry, and the tables and SQL fragments the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill import runtime
from moodmill.config import LexiconSpec
from moodmill.functions import patterns as P
from moodmill.operators import corpus as C
from moodmill.operators import lexicon as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- tables


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Documents, hashed over the cores by id when the files give too few splits."""
    docs = table(spark, sf, "documents").select("doc_id", *(cols or ("text",)))
    return runtime.spread(docs, "doc_id")


def labeled(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Documents with a 3-class label: toxic -1, good 1, else 0."""
    labels = table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0).alias("label"),
    )
    return documents(spark, sf, *cols).join(labels, "doc_id")


def labels_only(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0).alias("label"),
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Lowercased space tokens."""
    docs = documents(spark, sf)
    return docs.select("doc_id", F.split(F.lower("text"), " ").alias("toks"))


def flat_tokens(text) -> F.Column:
    """Lowercased words between runs of white space."""
    return F.filter(F.split(F.lower(text), FLAT), lambda t: t != "")


def flat_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return docs.select("doc_id", flat_tokens(F.col("text")).alias("toks"))


def informal(spark: SparkSession, sf: str) -> DataFrame:
    """Lowercased informal tokens: punctuation stands alone, so negation scopes close."""
    docs = C.tokenize(documents(spark, sf), "informal").drop("text")
    return docs.select("doc_id", F.transform("toks", F.lower).alias("toks"))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Informal tokens with a part of speech derived from their length."""
    return C.explode_tokens(informal(spark, sf)).withColumn("tag", tag_of(F.col("tok")))


def tag_of(tok) -> F.Column:
    """A part of speech derived from the token's length."""
    return F.element_at(F.array(*[F.lit(t) for t in TAGS]), (F.length(tok) % len(TAGS) + 1).cast("int"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as messages: the address, then the markup."""
    rows = table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("text")
    )
    return runtime.spread(rows, "doc_id")


FLAT = r"[ \t\n\x0B\f\r]+"
TAGS = ("NN", "VB", "JJ", "RB", "DT", "NNS")

# ---------------------------------------------------------------- SQL


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words_: tuple[str, ...]) -> str:
    return "(" + ", ".join(lit(w) for w in words_) + ")"


LABEL_SQL = "CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END"
LABELED_SQL = (
    f"labeled AS (SELECT d.doc_id, d.text, d.source, d.lang, CAST({LABEL_SQL} AS INTEGER) AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
WORD_LISTS = "lists AS (SELECT doc_id, string_split(lower(text), ' ') AS toks FROM documents)"
FLAT_SQL = f"list_filter(regexp_split_to_array(lower(text), '{FLAT}'), lambda x: x <> '')"
FLAT_LISTS = f"lists AS (SELECT doc_id, {FLAT_SQL} AS toks FROM documents)"
INFORMAL_LISTS = (
    f"lists AS (SELECT doc_id, regexp_extract_all(lower(text), {lit(P.INFORMAL_TOKEN)}) AS toks "
    "FROM documents)"
)
INFORMAL_LOWER = (
    "lists AS (SELECT doc_id, list_transform(regexp_extract_all(text, "
    f"{lit(P.INFORMAL_TOKEN)}), lambda x: lower(x)) AS toks FROM documents)"
)
TOKENS = (
    "tokens AS (SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, "
    "unnest(toks) AS tok FROM lists)"
)
OPENS = f"(lower(tok) IN {in_list(P.NEGATION_WORDS)} OR contains(lower(tok), 'n''t'))"
CLOSES = f"regexp_matches(tok, {lit(P.NEGATION_CLOSE)})"
NEGATION = (
    f"marks AS (SELECT *, CASE WHEN {OPENS} THEN 1 WHEN {CLOSES} THEN 0 END AS mark FROM tokens), "
    "states AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id "
    "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state, "
    "coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marks), "
    "negated AS (SELECT doc_id, pos, tok, "
    "CASE WHEN state = 1 AND mark IS NULL THEN 'NEG_' || tok ELSE tok END AS prefixed, "
    "CASE WHEN before = 1 THEN tok || '_NEG' ELSE tok END AS suffixed, "
    "before = 1 AS inside FROM states)"
)
TAGGED_SQL = (
    f"tagged AS (SELECT doc_id, pos, tok, [{', '.join(lit(t) for t in TAGS)}]"
    f"[CAST(length(tok) % {len(TAGS)} + 1 AS INTEGER)] AS tag FROM tokens)"
)
GRAMS = (
    "ahead AS (SELECT doc_id, pos, tok AS a, lead(tok, 1) OVER w AS b, lead(tok, 2) OVER w AS c, "
    "lead(tok, 3) OVER w AS d FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"
)


def gap_variants(mark: str) -> str:
    """SELECT of all gapped grams of the view ``ahead``."""

    def glue(parts: list[str]) -> str:
        text = " || ' ' || ".join(parts)
        return f"replace(replace({text}, '{mark} ', '{mark}'), ' {mark}', '{mark}')"

    selects = []
    for names, guard in ((["a", "b", "c", "d"], "d"), (["a", "b", "c"], "c")):
        forms = [
            glue([f"'{mark}'" if i == hole else n for i, n in enumerate(names)])
            for hole in range(len(names))
        ]
        selects.append(
            f"SELECT doc_id, unnest([{', '.join(forms)}]) AS gram FROM ahead "
            f"WHERE {guard} IS NOT NULL"
        )
    return " UNION ALL ".join(selects)


def with_sql(*parts: str, select: str) -> str:
    return "WITH " + ", ".join(parts) + " " + select


# ---------------------------------------------------------------- a small invented lexicon

OPINION = "MOOD"
PHRASES = "TURNS"
EMOTION = "FEELS"
LEXICON_ROWS = (
    (OPINION, "worthless", "polarity", -2.0),
    (OPINION, "idiot", "polarity", -2.5),
    (OPINION, "loser", "polarity", -1.5),
    (OPINION, "trash", "polarity", -1.0),
    (OPINION, "scum", "polarity", -3.0),
    (OPINION, "stupid", "polarity", -2.0),
    (OPINION, "ha", "polarity", 1.0),
    (OPINION, "nd", "polarity", 0.25),
    (OPINION, "ou", "polarity", 0.75),
    (OPINION, "ti", "polarity", -0.5),
    (OPINION, "he", "polarity", 0.0),
    (OPINION, "von", "polarity", 0.5),
    (OPINION, "un", "polarity", 0.1),
    (PHRASES, "the the", "polarity", 1.0),
    (PHRASES, "of the", "polarity", 0.5),
    (PHRASES, "de de", "polarity", -0.5),
    (PHRASES, "the and", "polarity", 0.75),
    (PHRASES, "the the the", "polarity", -1.5),
    (PHRASES, "the---the", "polarity", 0.25),
    (PHRASES, "the---and", "polarity", -0.75),
    (PHRASES, "of---the", "polarity", 2.0),
    (PHRASES, "de---la", "polarity", -0.25),
    (PHRASES, "ha", "polarity", 0.5),
    (PHRASES, "scum", "polarity", -1.0),
    (EMOTION, "worthless", "sad", 1.0),
    (EMOTION, "worthless", "anger", 0.5),
    (EMOTION, "idiot", "anger", 1.0),
    (EMOTION, "scum", "anger", 0.75),
    (EMOTION, "scum", "sad", -0.25),
    (EMOTION, "ha", "joy", 1.0),
    (EMOTION, "ha", "sad", 0.0),
    (EMOTION, "nd", "joy", 0.25),
    (EMOTION, "der", "joy", -0.5),
    (EMOTION, "les", "sad", 0.5),
)
SPECS = (
    LexiconSpec(OPINION, negated=True),
    LexiconSpec(PHRASES, bigrams=True, trigrams=True, gapped=True),
    LexiconSpec(EMOTION, opinion=False),
)
SPEC = {s.name: s for s in SPECS}


def lexicon(spark: SparkSession, *names: str) -> DataFrame:
    rows = [r for r in LEXICON_ROWS if not names or r[0] in names]
    return L.inline_lexicon(spark, rows)


def lexicon_sql(*names: str) -> str:
    rows = ", ".join(
        f"({lit(n)}, {lit(t)}, {lit(d)}, CAST({v} AS DOUBLE))"
        for n, t, d, v in LEXICON_ROWS
        if not names or n in names
    )
    return f"lex AS (SELECT * FROM (VALUES {rows}) AS v(lexicon, term, dim, value))"


# ---------------------------------------------------------------- a lexicon learned from labels


def learned(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the labeled documents: per language the mean label of their documents."""
    rows = labeled(spark, sf, "text", "lang").select(
        "lang",
        "label",
        F.explode(F.array_distinct(flat_tokens(F.col("text")))).alias("term"),
    )
    return rows.groupBy(F.col("lang").alias("lexicon"), "term").agg(
        F.round(F.avg("label"), 6).alias("value")
    ).select("lexicon", "term", F.lit("polarity").alias("dim"), "value")


LEARNED_SQL = (
    f"{LABELED_SQL}, seen AS (SELECT lang, label, unnest(list_distinct({FLAT_SQL})) "
    "AS term FROM labeled), learned AS (SELECT lang AS lexicon, term, 'polarity' AS dim, "
    "round(avg(label), 6) AS value FROM seen GROUP BY lang, term)"
)


def emotions(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the labeled documents by class: 1 where half of a term's documents have it."""
    rows = labeled(spark, sf).select(
        F.when(F.col("label") == 1, "good").when(F.col("label") == -1, "bad").otherwise("plain")
        .alias("dim"),
        F.explode(F.array_distinct(flat_tokens(F.col("text")))).alias("term"),
    )
    counts = rows.groupBy("term", "dim").agg(F.count("*").alias("n"))
    totals = counts.groupBy("term").agg(F.sum("n").alias("m"))
    share = F.col("n") / F.col("m")
    value = F.when(share >= 0.5, 1.0).otherwise(F.round(share, 6))
    return counts.join(totals, "term").select(
        F.lit("CLASS").alias("lexicon"), "term", "dim", value.alias("value")
    )


EMOTIONS_SQL = (
    f"{LABELED_SQL}, seen AS (SELECT CASE label WHEN 1 THEN 'good' WHEN -1 THEN 'bad' ELSE 'plain' END "
    f"AS dim, unnest(list_distinct({FLAT_SQL})) AS term FROM labeled), "
    "counts AS (SELECT term, dim, count(*) AS n FROM seen GROUP BY term, dim), "
    "totals AS (SELECT term, sum(n) AS m FROM counts GROUP BY term), "
    "emotions AS (SELECT 'CLASS' AS lexicon, c.term, c.dim, CASE WHEN CAST(c.n AS DOUBLE) / t.m >= 0.5 "
    "THEN 1.0::DOUBLE ELSE round(CAST(c.n AS DOUBLE) / t.m, 6) END AS value "
    "FROM counts c JOIN totals t ON c.term = t.term)"
)
