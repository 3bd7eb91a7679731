"""Queries that put side tables next to messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodmill.functions import text as T
from moodmill.operators import align as A
from moodmill.operators import corpus as C
from moodmill.operators import evaluate as E
from moodmill.operators import profile as R
from moodmill.plans import common as K
from moodmill.plans.common import query, with_sql

# Two category sheets: one over the English documents, one over the labeled ones.
_SHEET_COLS = ("WC", "COMMA", "PERIOD")


def _sheet(docs, factor: float = 1.0):
    def n(mark):
        return (F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))) * factor

    return docs.select(
        "doc_id",
        (F.size(F.split("text", " ")) * factor).cast("double").alias("WC"),
        n(",").cast("double").alias("COMMA"),
        n(".").cast("double").alias("PERIOD"),
    )


def _sheet_sql(source: str, factor: float) -> str:
    return (
        f"SELECT doc_id, (len(string_split(text, ' ')) * {factor})::DOUBLE AS WC, "
        f"((length(text) - length(replace(text, ',', ''))) * {factor})::DOUBLE AS COMMA, "
        f"((length(text) - length(replace(text, '.', ''))) * {factor})::DOUBLE AS PERIOD FROM {source}"
    )


_SHEETS = (
    K.LABELED_SQL,
    f"first AS ({_sheet_sql('documents', 1.0)} WHERE lang = 'en')",
    f"second AS ({_sheet_sql('labeled', 0.5)})",
)


def _docs(spark, sf, *cols):
    return K.documents(spark, sf, *cols)


@query(
    "join_06_attach_with_fallback",
    with_sql(
        *_SHEETS,
        select="SELECT d.doc_id, d.source, "
        + ", ".join(
            f"CASE WHEN f.doc_id IS NOT NULL THEN f.{c} WHEN s.doc_id IS NOT NULL THEN s.{c} ELSE 0 END "
            f"AS {c}"
            for c in _SHEET_COLS
        )
        + " FROM documents d LEFT JOIN first f ON d.doc_id = f.doc_id LEFT JOIN second s ON d.doc_id = s.doc_id",
    ),
)
def attach_with_fallback(spark, sf):
    docs = _docs(spark, sf, "text", "lang")
    first = _sheet(docs.where(F.col("lang") == "en"))
    second = _sheet(K.labeled(spark, sf), 0.5)
    return A.attach_with_fallback(_docs(spark, sf, "source"), first, second, "doc_id")


@query(
    "join_07_attach_strict",
    with_sql(
        *_SHEETS,
        select="SELECT l.doc_id, l.label, s.WC, s.COMMA, s.PERIOD FROM labeled l JOIN second s "
        "ON l.doc_id = s.doc_id",
    ),
)
def attach_strict(spark, sf):
    rows = K.labeled(spark, sf)
    return A.attach_strict(rows.drop("text"), _sheet(rows, 0.5), "doc_id")


@query(
    "join_07_missing_rows",
    with_sql(
        *_SHEETS,
        select="SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM second)",
    ),
)
def missing_rows(spark, sf):
    return A.missing_rows(_docs(spark, sf, "source"), _sheet(K.labeled(spark, sf), 0.5), "doc_id")


@query(
    "join_08_attach_scores",
    "SELECT d.doc_id, d.source, l.quality AS EXT_quality, l.toxic AS EXT_toxic FROM documents d "
    "LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def attach_scores(spark, sf):
    scores = K.table(spark, sf, "labels")
    return A.attach_scores(_docs(spark, sf, "source"), scores, "EXT_", "doc_id")


_POSITIONS = (
    "lined AS (SELECT doc_id AS line_no, doc_id::VARCHAR AS sid, source FROM documents), "
    "other AS (SELECT doc_id AS line_no, CASE WHEN n_chars % 7 = 0 THEN 'x' ELSE doc_id::VARCHAR END AS "
    "sid, lang FROM documents WHERE n_chars % 11 <> 0)"
)


def _positions(spark, sf):
    docs = K.table(spark, sf, "documents")
    left = docs.select(
        F.col("doc_id").alias("line_no"), F.col("doc_id").cast("string").alias("sid"), "source"
    )
    right = docs.where(F.col("n_chars") % 11 != 0).select(
        F.col("doc_id").alias("line_no"),
        F.when(F.col("n_chars") % 7 == 0, "x").otherwise(F.col("doc_id").cast("string")).alias("sid"),
        "lang",
    )
    return A.align_by_position(left, right)


@query(
    "join_09_align_rows",
    with_sql(
        _POSITIONS,
        select="SELECT l.line_no, l.sid, l.source, o.sid AS right_sid, o.lang AS right_lang FROM lined l "
        "JOIN other o ON l.line_no = o.line_no AND l.sid = o.sid",
    ),
)
def align_rows(spark, sf):
    return _positions(spark, sf)[0]


@query(
    "join_09_align_mismatches",
    with_sql(
        _POSITIONS,
        select="SELECT coalesce(l.line_no, o.line_no) AS line_no, l.sid, o.sid AS right_sid FROM lined l "
        "FULL JOIN other o ON l.line_no = o.line_no WHERE l.sid IS DISTINCT FROM o.sid",
    ),
)
def align_mismatches(spark, sf):
    return _positions(spark, sf)[1]


@query(
    "join_10_attach_tagged",
    with_sql(
        K.INFORMAL_LOWER,
        K.TOKENS,
        K.TAGGED_SQL,
        K.LABELED_SQL,
        select="SELECT t.doc_id, l.label, t.tag, count(*) AS n FROM tagged t JOIN labeled l ON "
        "t.doc_id = l.doc_id GROUP BY ALL",
    ),
)
def attach_tagged(spark, sf):
    rows = A.attach_tagged(K.labels_only(spark, sf), K.tagged(spark, sf), "doc_id")
    return rows.groupBy("doc_id", "label", "tag").agg(F.count("*").alias("n"))


@query(
    "join_11_fill_predictions",
    with_sql(
        K.LABELED_SQL,
        select="SELECT d.doc_id, d.source, coalesce(CASE l.label WHEN 1 THEN 'positive' WHEN -1 THEN "
        "'negative' WHEN 0 THEN 'neutral' END, 'neutral') AS label FROM documents d LEFT JOIN labeled l "
        "ON d.doc_id = l.doc_id",
    ),
)
def fill_predictions(spark, sf):
    predictions = K.labels_only(spark, sf).select("doc_id", T.decode_label(F.col("label")).alias("label"))
    return A.fill_predictions(_docs(spark, sf, "source"), predictions, "neutral", ("doc_id",))


_GOLD = (
    K.LABELED_SQL,
    "gold AS (SELECT doc_id, CASE label WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END "
    "AS gold FROM labeled)",
    "preds AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'positive' WHEN n_chars % 3 = 1 THEN "
    "'negative' ELSE 'neutral' END AS pred FROM documents WHERE n_chars % 5 <> 0)",
)


def _gold(spark, sf):
    gold = K.labels_only(spark, sf).join(
        K.table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi"
    )
    gold = gold.select("doc_id", T.decode_label(F.col("label")).alias("label"))
    docs = K.table(spark, sf, "documents").where(F.col("n_chars") % 5 != 0)
    third = F.col("n_chars") % 3
    label = F.when(third == 0, "positive").when(third == 1, "negative").otherwise("neutral")
    return A.gold_pairs(gold, docs.select("doc_id", label.alias("label")), ("doc_id",))


@query(
    "join_12_gold_pairs",
    with_sql(
        *_GOLD,
        select="SELECT g.doc_id, g.gold, p.pred FROM gold g LEFT JOIN preds p ON g.doc_id = p.doc_id",
    ),
)
def gold_pairs(spark, sf):
    return _gold(spark, sf)[0]


@query(
    "join_12_missing_predictions",
    with_sql(
        *_GOLD, select="SELECT doc_id FROM gold WHERE doc_id NOT IN (SELECT doc_id FROM preds)"
    ),
)
def missing_predictions(spark, sf):
    return _gold(spark, sf)[1]


@query(
    "join_13_restrict",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def restrict(spark, sf):
    ids = K.table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    return A.restrict(_docs(spark, sf, "source"), ids, "doc_id")


# ---------------------------------------------------------------- feature blocks

_BLOCKS_SQL = (
    K.WORD_LISTS,
    K.TOKENS,
    "words AS (SELECT doc_id, 'WORDS' AS block, tok AS name, count(*)::DOUBLE AS value FROM tokens "
    "GROUP BY doc_id, tok)",
    "sizes AS (SELECT doc_id, 'SIZE' AS block, 'n' AS name, len(toks)::DOUBLE AS value FROM lists)",
    "features AS (SELECT doc_id, block, block || ':' || name AS name, value FROM words UNION ALL "
    "SELECT doc_id, block, block || ':' || name, value FROM sizes)",
)


def _blocks(spark, sf):
    docs = K.words(spark, sf)
    words = R.bag_of_words(docs).withColumn("block", F.lit("WORDS"))
    sizes = C.feature_rows(docs, "SIZE", {"n": F.size("toks")})
    return A.concat_blocks(words, sizes)


@query(
    "join_16_concat_blocks",
    with_sql(
        *_BLOCKS_SQL,
        select="SELECT block, name, count(*) AS n, sum(value) AS total FROM features GROUP BY block, name",
    ),
)
def concat_blocks(spark, sf):
    rows = _blocks(spark, sf)
    return rows.groupBy("block", "name").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


@query(
    "join_17_select_blocks",
    with_sql(
        *_BLOCKS_SQL,
        "masks AS (SELECT * FROM (VALUES ('[1, 0]', 'WORDS'), ('[0, 1]', 'SIZE'), ('[1, 1]', 'WORDS'), "
        "('[1, 1]', 'SIZE')) AS m(mask, block))",
        select="SELECT m.mask, f.block, f.doc_id, count(*) AS n, sum(f.value) AS total FROM features f "
        "JOIN masks m ON f.block = m.block GROUP BY ALL",
    ),
)
def select_blocks(spark, sf):
    masks = spark.createDataFrame([("[1, 0]",), ("[0, 1]",), ("[1, 1]",)], "mask string")
    decoded = E.decode_masks(masks, ("WORDS", "SIZE"))
    rows = A.select_blocks(_blocks(spark, sf), decoded)
    return rows.groupBy("mask", "block", "doc_id").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )
