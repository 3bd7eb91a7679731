"""File queries: every format is written from the given tables and read back.

Files go to the shared folder of ``spark.checkpoint.dir``. What must keep an order is
written range-partitioned and sorted, so the file names carry the order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill import runtime
from moodmill.functions import text as T
from moodmill.operators import corpus as C
from moodmill.operators import lexicon as L
from moodmill.operators import profile as R
from moodmill.plans import common as K
from moodmill.plans import scoring
from moodmill.plans.common import query, with_sql
from moodmill.plans.lexicons import BAG, BAG_MATCHES
from moodmill.plans.profiles import _MASKS_SQL, SCORES_SQL, _mask_table, source_scores
from moodmill.sources import readers, sinks

FLAT = "translate(text, chr(9) || chr(10) || chr(13), '   ')"


def flat(col="text"):
    """Text on one line, without tabs."""
    return F.translate(col, "\t\n\r", "   ")


def _write(df, order, *cols, header: tuple[str, ...] = ()) -> str:
    """Lines of tab-joined columns in the order of one column; ``header`` lines first."""
    spark = df.sparkSession
    path = runtime.scratch_path(spark, "lines")
    lines = df.select(F.col(order).alias("_o"), F.concat_ws("\t", *cols).alias("value"))
    if header:
        top = spark.createDataFrame(
            [(i - len(header), h) for i, h in enumerate(header)], "_o long, value string"
        )
        lines = lines.select(F.col("_o").cast("long"), "value").unionByName(top)
    lines = lines.repartitionByRange("_o").sortWithinPartitions("_o")
    lines.select("value").write.text(path)
    return path


def _docs(spark, sf, *cols):
    return K.documents(spark, sf, *(cols or ("text", "source", "n_chars")))


def _labels(spark, sf):
    return K.labeled(spark, sf, "text", "source", "n_chars").withColumn(
        "name", T.decode_label(F.col("label"))
    )


_NAMED = (
    K.LABELED_SQL,
    "named AS (SELECT doc_id, source, CASE label WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE "
    f"'neutral' END AS name, {FLAT} AS flat FROM labeled)",
)

# ---------------------------------------------------------------- messages


@query(
    "src_01_read_messages_a",
    with_sql(
        *_NAMED,
        select="SELECT doc_id::VARCHAR AS sid, source AS uid, 1 AS start_pos, CAST(length(flat) AS INTEGER) "
        "AS end_pos, name AS sentiment, flat AS text FROM named WHERE doc_id % 9 <> 0",
    ),
)
def messages_a(spark, sf):
    rows = _labels(spark, sf)
    text = F.when(F.col("doc_id") % 9 == 0, readers.MISSING_TEXT).otherwise(flat())
    path = _write(
        rows, "doc_id", "doc_id", "source", F.lit(1), F.length(flat()), "name", text
    )
    return readers.read_messages(spark, path, "A")


@query(
    "src_01_read_messages_b",
    with_sql(
        *_NAMED,
        select="SELECT doc_id::VARCHAR AS sid, source AS uid, CASE WHEN doc_id % 4 = 0 THEN 'neutral' ELSE "
        "name END AS sentiment, '<' || flat || '>' AS text FROM named WHERE doc_id % 9 <> 0",
    ),
)
def messages_b(spark, sf):
    """Quoted and unknown labels, escaped text, unavailable and malformed rows."""
    rows = _labels(spark, sf)
    i = F.col("doc_id")
    label = F.when(i % 4 == 0, "objective").otherwise(F.concat(F.lit('"'), "name", F.lit('"')))
    text = F.when(i % 9 == 0, readers.MISSING_TEXT).otherwise(
        F.concat(F.lit("&lt;"), F.replace(flat(), F.lit("&"), F.lit("&amp;")), F.lit("&gt;"))
    )
    path = _write(rows, "doc_id", "doc_id", "source", label, text)
    return readers.read_messages(spark, path, "B")


@query(
    "src_01_read_messages_2016a",
    with_sql(
        *_NAMED,
        select="SELECT doc_id::VARCHAR AS sid, name AS sentiment, flat AS text, row_number() OVER (ORDER BY "
        "doc_id) AS line_no FROM named",
    ),
)
def messages_2016a(spark, sf):
    label = F.concat(F.lit('"'), "name", F.lit('"'))
    path = _write(_labels(spark, sf), "doc_id", "doc_id", label, flat())
    return readers.read_messages(spark, path, "2016A", numbered=True)


@query(
    "src_02_message_rejects",
    with_sql(
        *_NAMED,
        select="SELECT CASE WHEN doc_id % 5 = 0 THEN doc_id || chr(9) || source ELSE doc_id || chr(9) || "
        "source || chr(9) || name || chr(9) || flat || chr(9) || 'x' END AS value, CAST(CASE WHEN doc_id % 5 "
        "= 0 THEN 2 ELSE 5 END AS INTEGER) AS fields, CASE WHEN doc_id % 5 = 0 THEN 'too few fields' ELSE "
        "'too many fields' END AS reason FROM named WHERE doc_id % 5 < 2",
    ),
)
def message_rejects(spark, sf):
    i = F.col("doc_id")
    tail = F.when(i % 5 == 0, F.lit(None)).otherwise(F.concat_ws("\t", "name", flat()))
    extra = F.when(i % 5 == 1, "x")
    path = _write(_labels(spark, sf), "doc_id", "doc_id", "source", tail, extra)
    return readers.message_rejects(spark, path, "B")


@query(
    "src_20_repair_messages",
    with_sql(
        *_NAMED,
        select="SELECT doc_id::VARCHAR AS sid, source AS uid, name AS sentiment, "
        "replace(translate(flat, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', "
        "'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY'), 'ß', 'ss') AS text FROM named",
    ),
)
def repair(spark, sf):
    """A third of the rows has its text only in the second download."""
    rows = _labels(spark, sf).select(
        F.col("doc_id").cast("string").alias("sid"),
        F.col("source").alias("uid"),
        "doc_id",
        F.col("name").alias("sentiment"),
        flat().alias("text"),
    )
    lost = F.col("doc_id") % 3 == 0
    original = rows.withColumns(
        {c: F.when(~lost, F.col(c)) for c in ("sentiment", "text")}
    )
    return readers.repair_messages(original, rows.where(lost))


# ---------------------------------------------------------------- keyed files


@query(
    "src_03_read_keyed",
    "SELECT source AS key, arg_max(doc_id::VARCHAR || '|' || n_chars::VARCHAR, doc_id) AS fields "
    "FROM documents GROUP BY source",
)
def keyed(spark, sf):
    path = _write(_docs(spark, sf), "doc_id", "source", "doc_id", "n_chars", header=("# head",))
    rows = readers.read_keyed(spark, path, arity=3, offset=1)
    return rows.select("key", F.array_join("fields", "|").alias("fields"))


@query(
    "src_04_read_ragged",
    f"SELECT array_to_string(string_split({FLAT}, ' '), '|') AS fields FROM documents",
)
def ragged(spark, sf):
    path = _write(_docs(spark, sf), "doc_id", F.split(flat(), " "))
    return readers.read_ragged(spark, path).select(F.array_join("fields", "|").alias("fields"))


_SYN = readers.EMOTION_SCORES


@query(
    "src_05_read_emotion_scores",
    " UNION ALL ".join(
        f"SELECT doc_id::VARCHAR AS sid, 'syn_{n}' AS name, ((n_chars + {i}) % 7)::DOUBLE AS value "
        "FROM documents"
        for i, n in enumerate(_SYN)
    ),
)
def emotion_scores(spark, sf):
    scores = [(F.col("n_chars") + i) % 7 for i in range(len(_SYN))]
    path = _write(_docs(spark, sf), "doc_id", "doc_id", *scores)
    return readers.read_emotion_scores(spark, path)


@query(
    "src_06_read_category_sheet",
    "SELECT doc_id::VARCHAR AS sid, 'WC' AS name, (n_chars % 50)::DOUBLE AS value FROM documents UNION ALL "
    "SELECT doc_id::VARCHAR, 'Sixltr', (n_chars % 6)::DOUBLE FROM documents",
)
def category_sheet(spark, sf):
    path = runtime.scratch_path(spark, "sheet")
    rows = _docs(spark, sf).select(
        F.col("doc_id").alias("sid"),
        (F.col("n_chars") % 50).alias("WC"),
        (F.col("n_chars") % 6).alias("Sixltr"),
        F.lit("x").alias("junk"),
    )
    rows.write.csv(path, sep="\t", header=True)
    return readers.read_category_sheet(spark, path)


# ---------------------------------------------------------------- lexicons


@query(
    "src_07_load_lexicon_json_flat",
    with_sql(
        K.LEARNED_SQL,
        select="SELECT upper(lexicon) AS lexicon, term, dim, value FROM learned",
    ),
)
def lexicon_json(spark, sf):
    """A lexicon per language, each as many files of one JSON object."""
    path = runtime.scratch_path(spark, "json")
    bucket = F.pmod(F.xxhash64("term"), F.lit(64))
    objects = K.learned(spark, sf).groupBy("lexicon", bucket.alias("b")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("term", "value")))).alias("value")
    )
    objects.write.partitionBy("lexicon", "b").text(path)
    names = K.table(spark, sf, "documents").select("lang").distinct().collect()
    parts = [
        readers.load_lexicon_json(spark, f"{path}/lexicon={r['lang']}/*/*.txt", r["lang"].upper())
        for r in names
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "src_07_load_lexicon_json_nested",
    with_sql(K.EMOTIONS_SQL, select="SELECT 'EMO' AS lexicon, term, dim, value FROM emotions"),
)
def lexicon_json_nested(spark, sf):
    terms = K.emotions(spark, sf).groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("dims")
    )
    bucket = F.pmod(F.xxhash64("term"), F.lit(64))
    objects = terms.groupBy(bucket.alias("b")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("term", "dims")))).alias("value")
    )
    path = runtime.scratch_path(spark, "json")
    _one_object_per_file(objects, path)
    return readers.load_lexicon_json(spark, f"{path}/*/*.txt", "EMO")


def _one_object_per_file(objects, path):
    objects.write.partitionBy("b").text(path)


@query(
    "src_08_load_clusters",
    with_sql(
        K.FLAT_LISTS,
        K.TOKENS,
        "words AS (SELECT tok AS word, count(*) AS n FROM tokens GROUP BY tok)",
        select="SELECT word, lpad(length(word)::VARCHAR, 5, '0') AS cluster FROM words",
    ),
)
def clusters(spark, sf):
    counts = R.term_counts(K.flat_words(spark, sf))
    path = runtime.scratch_path(spark, "clusters")
    cluster = F.lpad(F.length("tok").cast("string"), 5, "0")
    lines = counts.select(F.concat_ws("\t", cluster, "tok", "n").alias("value"))
    # every line is followed by an empty one
    lines.select(F.explode(F.array("value", F.lit(""))).alias("value")).write.text(path)
    return readers.load_clusters(spark, path)


_SYNSETS = (
    K.LABELED_SQL,
    "words AS (SELECT doc_id, unnest(list_distinct(string_split(translate(lower(text), chr(10), ' '), ' '))) "
    "AS word FROM labeled)",
)


def _synset_file(spark, sf):
    """One synset line per labeled document, its distinct words as members."""
    rows = _labels(spark, sf)
    words = F.array_distinct(F.split(F.translate(F.lower("text"), "\n", " "), " "))
    words = F.filter(words, lambda w: (w != "") & ~w.contains("#"))
    terms = F.array_join(
        F.transform(words, lambda w, i: F.concat_ws("#", w, i % 3 + 1)), " "
    )
    i = F.col("doc_id")
    return _write(
        rows, "doc_id", F.lit("n"), "doc_id", (i % 5) / 8, (i % 4) / 8, terms, F.lit("gloss"),
        header=("# comment", ""),
    )


@query(
    "src_09_load_synset_lexicon",
    with_sql(
        *_SYNSETS,
        select="SELECT word, arg_max((doc_id % 5) / 8, doc_id)::DOUBLE AS pos_score, arg_max((doc_id % 4) / 8, "
        "doc_id)::DOUBLE AS neg_score FROM words WHERE word <> '' AND NOT contains(word, '#') GROUP BY word",
    ),
)
def synset_lexicon(spark, sf):
    return readers.load_synset_lexicon(spark, _synset_file(spark, sf))


@query(
    "src_09_load_senses",
    with_sql(
        *_SYNSETS,
        select="SELECT word, 'n' AS tag, count(*) AS n, sum((doc_id % 5) / 8)::DOUBLE AS pos_score FROM words "
        "WHERE word <> '' AND NOT contains(word, '#') GROUP BY word",
    ),
)
def senses(spark, sf):
    rows = readers.load_senses(spark, _synset_file(spark, sf))
    return rows.groupBy("word", "tag").agg(
        F.count("*").alias("n"), F.sum("pos_score").alias("pos_score")
    )


@query(
    "src_10_load_wordlist",
    with_sql(
        K.FLAT_LISTS,
        K.TOKENS,
        select="SELECT DISTINCT tok AS word FROM tokens",
    ),
)
def wordlist(spark, sf):
    toks = K.flat_words(spark, sf).select(F.explode("toks").alias("tok"))
    path = runtime.scratch_path(spark, "words")
    toks.select(F.concat(F.lit(" "), "tok").alias("value")).write.text(path)
    return readers.load_wordlist(spark, path)


_VALENCE = "words AS (SELECT tok, count(*) AS n FROM tokens GROUP BY tok)"


@query(
    "src_11_load_valence_list",
    with_sql(
        K.FLAT_LISTS,
        K.TOKENS,
        _VALENCE,
        select="SELECT t.doc_id, sum(coalesce(CASE WHEN w.n % 3 > 0 THEN w.n % 11 - 5 END, 0))::BIGINT AS "
        "score FROM tokens t LEFT JOIN words w ON t.tok = w.tok GROUP BY t.doc_id",
    ),
)
def valence(spark, sf):
    docs = K.flat_words(spark, sf)
    counts = R.term_counts(docs).where(F.col("n") % 3 > 0)
    path = runtime.scratch_path(spark, "valence")
    counts.select(F.concat_ws("\t", "tok", F.col("n") % 11 - 5).alias("value")).write.text(path)
    scored = readers.valence_scores(
        C.explode_tokens(docs), readers.load_valence_list(spark, path)
    )
    return scored.groupBy("doc_id").agg(F.sum("score").alias("score"))


@query(
    "src_12_load_cooccurrence",
    with_sql(
        K.FLAT_LISTS,
        K.LABELED_SQL,
        "tokens AS (SELECT l.doc_id, b.label, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM "
        "lists l JOIN labeled b ON l.doc_id = b.doc_id)",
        "ahead AS (SELECT doc_id, label, tok AS a, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS b "
        "FROM tokens)",
        "grams AS (SELECT 'unigram' AS kind, label, a AS term FROM ahead UNION ALL SELECT 'bigram', label, "
        "a || ' ' || b FROM ahead WHERE b IS NOT NULL)",
        "counts AS (SELECT kind, term, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = -1) AS n "
        "FROM grams GROUP BY kind, term)",
        select="SELECT 'CO' AS lexicon, kind, term, (p - n)::DOUBLE AS score, p::DOUBLE AS n_pos, n::DOUBLE "
        "AS n_neg FROM counts",
    ),
)
def cooccurrence(spark, sf):
    """Unigram and bigram files of marker counts, from the labeled documents."""
    rows = K.labeled(spark, sf).select(
        "doc_id", "label", K.flat_tokens(F.col("text")).alias("toks")
    )
    paths = {}
    for kind, grams in (("unigram", F.col("toks")), ("bigram", T.ngram_array(F.col("toks"), 2))):
        counts = rows.select("label", F.explode(grams).alias("term")).groupBy("term").agg(
            F.count(F.when(F.col("label") == 1, 1)).alias("p"),
            F.count(F.when(F.col("label") == -1, 1)).alias("n"),
        )
        paths[kind] = runtime.scratch_path(spark, kind)
        line = F.concat_ws("\t", "term", F.col("p") - F.col("n"), "p", "n")
        counts.select(line.alias("value")).write.text(paths[kind])
    return readers.load_cooccurrence_lexicon(spark, paths, "CO")


@query(
    "src_13_load_word_emotion",
    with_sql(
        K.EMOTIONS_SQL,
        select="SELECT term, 'NRCE_' || upper(dim) AS dim, value FROM emotions",
    ),
)
def word_emotion(spark, sf):
    rows = K.emotions(spark, sf)
    rows = rows.withColumn("_n", F.xxhash64("term"))
    rows = rows.withColumn("_n", F.abs(F.col("_n") % 1000000))
    path = _write(rows, "_n", "term", "dim", "value", header=("header",) * 46)
    return readers.load_word_emotion(spark, path)


_POLAR = (
    K.LABELED_SQL,
    f"seen AS (SELECT label, unnest(list_distinct({K.FLAT_SQL})) AS word FROM labeled)",
    "flags AS (SELECT word, CAST(max(label = 1) AS INTEGER) AS pos, CAST(max(label = -1) AS INTEGER) AS neg "
    "FROM seen GROUP BY word)",
)


@query(
    "src_14_load_polarity_lists",
    with_sql(*_POLAR, select="SELECT word, pos, neg, pos - neg AS polarity FROM flags WHERE pos + neg > 0"),
)
def polarity_lists(spark, sf):
    rows = K.labeled(spark, sf).select(
        "label", F.explode(F.array_distinct(K.flat_tokens(F.col("text")))).alias("word")
    )
    paths = []
    for label in (1, -1):
        words = rows.where(F.col("label") == label).select("word").distinct()
        words = words.withColumn("_n", F.abs(F.xxhash64("word") % 1000000))
        paths.append(_write(words, "_n", "word", header=(";",) * 35))
    return readers.load_polarity_lists(spark, *paths)


@query(
    "src_15_load_clues",
    with_sql(
        *_POLAR,
        select="SELECT word, CASE WHEN pos = 1 THEN 'strongsubj' ELSE 'weaksubj' END AS type, CAST(1 AS "
        "INTEGER) AS len, 'adj' AS pos1, 'n' AS stemmed1, CASE WHEN pos > neg THEN 'positive' WHEN pos < neg "
        "THEN 'negative' ELSE 'neutral' END AS priorpolarity, pos - neg AS polarity FROM flags",
    ),
)
def clues(spark, sf):
    """Clue lines, each word twice (the second line counts), with a broken pair in them."""
    rows = K.labeled(spark, sf).select(
        "label", F.explode(F.array_distinct(K.flat_tokens(F.col("text")))).alias("word")
    )
    # a clue is split at its equals sign, so those of the word are written as entities
    rows = rows.withColumn("word", F.replace(F.replace("word", F.lit("&"), F.lit("&amp;")), F.lit("="), F.lit("&#61;")))
    flags = rows.groupBy("word").agg(
        F.max(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p"),
        F.max(F.when(F.col("label") == -1, 1).otherwise(0)).alias("n"),
    )
    kind = F.when(F.col("p") == 1, "strongsubj").otherwise("weaksubj")
    polarity = (
        F.when(F.col("p") > F.col("n"), "positive")
        .when(F.col("p") < F.col("n"), "negative")
        .otherwise("neutral")
    )

    def line(kind_, polarity_):
        return F.concat(
            F.lit("type="), kind_, F.lit(" len=1 word1="), "word",
            F.lit(" pos1=adj m stemmed1=n priorpolarity="), polarity_,
        )

    lines = F.array(line(F.lit("old"), F.lit("both")), line(kind, polarity))
    path = runtime.scratch_path(spark, "clues")
    flags.select(F.explode(lines).alias("value")).write.text(path)
    plain = F.replace(F.replace("word", F.lit("&#61;"), F.lit("=")), F.lit("&amp;"), F.lit("&"))
    return readers.load_clues(spark, path).withColumn("word", plain)


@query(
    "src_16_load_category_lexicon",
    with_sql(
        *_POLAR,
        "wide AS (SELECT word AS term, CASE WHEN pos = 1 THEN 'Positiv' END AS p, CASE WHEN neg = 1 THEN "
        "'Negativ' END AS n FROM flags)",
        select="SELECT term, 'Pos' AS dim, p AS value FROM wide WHERE p IS NOT NULL UNION ALL SELECT term, "
        "'Neg', n FROM wide WHERE n IS NOT NULL",
    ),
)
def category_lexicon(spark, sf):
    rows = K.labeled(spark, sf).select(
        "label", F.explode(F.array_distinct(K.flat_tokens(F.col("text")))).alias("word")
    )
    wide = (
        rows.groupBy(F.col("word").alias("Entry"))
        .agg(
            F.max(F.when(F.col("label") == 1, "Positiv")).alias("Pos"),
            F.max(F.when(F.col("label") == -1, "Negativ")).alias("Neg"),
        )
    )
    path = runtime.scratch_path(spark, "categories")
    wide.write.csv(path, sep=";", header=True, escape='"')
    return readers.load_category_lexicon(spark, path)


# ---------------------------------------------------------------- tagged corpora

_TAGGED = (K.INFORMAL_LOWER, K.TOKENS, K.TAGGED_SQL)


def _tagged_sids(spark, sf):
    """Messages as lists of token and tag."""
    pair = lambda t: F.struct(t.alias("tok"), K.tag_of(t).alias("tag"))
    return K.informal(spark, sf).select(F.col("doc_id").alias("sid"), F.transform("toks", pair).alias("pairs"))


@query(
    "src_17_snk_03_tagged_corpus",
    with_sql(
        *_TAGGED,
        select="SELECT doc_id::VARCHAR AS sid, string_agg(tok || '/' || tag, ' ' ORDER BY pos) AS toks FROM "
        "tagged GROUP BY doc_id",
    ),
)
def tagged_corpus(spark, sf):
    path = runtime.scratch_path(spark, "tagged")
    sinks.write_tagged(_tagged_sids(spark, sf), path)
    once, again = runtime.split_repeated(readers.read_tagged_lists(spark, path), "sid")
    pairs = F.transform("pairs", lambda p: F.concat_ws("/", p["tok"], p["tag"]))
    joined = F.when(F.size("pairs") > 0, F.array_join(pairs, " "))
    lists = runtime.one_or_none(once, joined, "toks").select("sid", "toks")
    if again is None:
        return lists
    in_order = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("/", "tok", "tag").alias("v"))))
    rows = sinks.token_rows(again).groupBy("sid").agg(
        F.array_join(F.transform(in_order, lambda p: p["v"]), " ").alias("toks")
    )
    return lists.unionByName(rows)


@query(
    "src_18_read_conll",
    with_sql(
        *_TAGGED,
        select="SELECT tok, tag, count(*) AS n, sum(pos)::BIGINT AS places, max(0.5)::DOUBLE AS confidence "
        "FROM tagged GROUP BY tok, tag",
    ),
)
def conll(spark, sf):
    """One message per line group, a decimal comma, and a malformed row in each message."""
    rows = K.informal(spark, sf)
    tags = F.array(*[F.lit(t) for t in K.TAGS])
    line = F.transform(
        "toks",
        lambda t: F.concat_ws(
            "\t",
            t,
            F.element_at(tags, (F.length(t) % len(K.TAGS) + 1).cast("int")),
            F.lit("0,5"),
        ),
    )
    block = F.concat(F.array_join(line, "\n"), F.lit("\nbroken row\n"))
    path = runtime.scratch_path(spark, "conll")
    rows.where(F.size("toks") > 0).select(block.alias("value")).write.text(path)
    parsed = readers.read_conll(spark, path)
    return parsed.groupBy("tok", "tag").agg(
        F.count("*").alias("n"), F.sum("pos").alias("places"), F.max("confidence").alias("confidence")
    )


# ---------------------------------------------------------------- experiment files


@query(
    "src_19_snk_09_mask_scores",
    with_sql(_MASKS_SQL, select="SELECT mask, cv_score, external_score, model FROM masks"),
)
def mask_scores(spark, sf):
    path = runtime.scratch_path(spark, "masks")
    sinks.write_mask_scores(_mask_table(spark, sf), path)
    return readers.read_mask_scores(spark, path)


@query(
    "src_19_snk_09_round_log",
    with_sql(
        SCORES_SQL,
        select="SELECT CAST(replace(model, 'src', '') AS INTEGER) AS gen, round(avg(external_score), 6) AS avg, "
        "min(external_score) AS min, max(external_score) AS max FROM scores GROUP BY 1",
    ),
)
def round_log(spark, sf):
    scores = source_scores(spark, sf).select(
        F.replace("model", F.lit("src"), F.lit("")).cast("int").alias("gen"),
        F.col("external_score").alias("score"),
    )
    path = runtime.scratch_path(spark, "log")
    sinks.write_round_log(R.round_curve(scores), path)
    return readers.read_round_log(spark, path).withColumn("avg", F.round("avg", 6))


# ---------------------------------------------------------------- sinks


def _predictions(spark, sf):
    rows = _labels(spark, sf)
    return rows.select(
        F.col("doc_id").cast("string").alias("sid"),
        F.col("source").alias("uid"),
        F.when(F.col("doc_id") % 6 != 0, F.col("label")).alias("pred"),
        flat().alias("text"),
    )


@query(
    "snk_01_write_predictions",
    with_sql(
        *_NAMED,
        select="SELECT doc_id::VARCHAR AS sid, source AS uid, CASE WHEN doc_id % 6 = 0 THEN 'neutral' ELSE name "
        "END AS sentiment, flat AS text FROM named",
    ),
)
def write_predictions(spark, sf):
    path = runtime.scratch_path(spark, "predictions")
    sinks.write_predictions(_predictions(spark, sf), path, default="neutral")
    return readers.read_messages(spark, path, "B")


@query(
    "snk_02_write_submission",
    with_sql(
        *_NAMED,
        select="SELECT 'NA' AS tag, d.doc_id + 1 AS line_no, coalesce(CASE WHEN n.doc_id % 6 <> 0 THEN n.name "
        "END, 'neutral') AS label, d.doc_id + 1 AS at FROM documents d LEFT JOIN named n ON d.doc_id = n.doc_id",
    ),
)
def write_submission(spark, sf):
    """Every document gets a line in its place; the file lines are numbered again to check it."""
    docs = _docs(spark, sf, "source").select(
        F.col("doc_id").cast("string").alias("sid"),
        F.col("source").alias("uid"),
        (F.col("doc_id") + 1).alias("line_no"),
    )
    preds = _predictions(spark, sf).where(F.col("pred").isNotNull())
    preds = preds.select("sid", "uid", T.decode_label(F.col("pred")).alias("label"))
    path = runtime.scratch_path(spark, "submission")
    sinks.write_submission(docs, preds, path)
    lines = readers.number_lines(readers.read_lines(spark, path), "at")
    f = F.split("value", "\t")
    return lines.select(
        F.get(f, 0).alias("tag"), F.get(f, 1).cast("long").alias("line_no"), F.get(f, 2).alias("label"), "at"
    )


@query(
    "snk_04_blocks",
    with_sql(
        K.WORD_LISTS,
        K.TOKENS,
        select="SELECT doc_id, tok AS name, count(*)::DOUBLE AS value, 'WORDS' AS block, 'train' AS split FROM "
        "tokens GROUP BY doc_id, tok UNION ALL SELECT doc_id, 'n', len(toks)::DOUBLE, 'SIZE', 'train' FROM "
        "lists",
    ),
)
def blocks(spark, sf):
    docs = K.words(spark, sf)
    path = runtime.scratch_path(spark, "blocks")
    sinks.write_block(R.bag_of_words(docs), "WORDS", "train", path)
    size = C.feature_rows(docs, "SIZE", {"n": F.size("toks")})
    sinks.write_block(size, "SIZE", "train", path)
    sinks.write_block(size, "OTHER", "train", path)
    sinks.write_block(size, "SIZE", "dev", path)
    return sinks.read_blocks(spark, path, ["WORDS", "SIZE"], "train")


@query(
    "snk_05_write_documents",
    with_sql(
        *BAG,
        K.lexicon_sql(),
        BAG_MATCHES,
        "sums AS (SELECT doc_id, count(*) AS n, round(sum(value), 6) AS total FROM matches GROUP BY doc_id)",
        select="SELECT l.doc_id, len(l.toks)::BIGINT AS n_toks, l.toks[1] AS first_tok, coalesce(s.n, 0) AS "
        "n_matches, s.total FROM lists l LEFT JOIN sums s ON l.doc_id = s.doc_id",
    ),
)
def write_documents(spark, sf):
    docs = K.words(spark, sf)
    matches = L.match_terms(docs, K.lexicon(spark), mode="bag")
    found = matches.groupBy("doc_id").agg(
        F.collect_list(F.struct("lexicon", "kind", "gram", "dim", "value")).alias("matches")
    )
    path = runtime.scratch_path(spark, "documents")
    sinks.write_documents(docs.join(found, "doc_id", "left"), path)
    stored = spark.read.parquet(path)
    total = F.aggregate("matches", F.lit(0.0), lambda s, m: s + m["value"])
    return stored.select(
        "doc_id",
        F.size("toks").cast("long").alias("n_toks"),
        F.get("toks", 0).alias("first_tok"),
        F.coalesce(F.when(F.col("matches").isNotNull(), F.size("matches")), F.lit(0)).cast("long").alias(
            "n_matches"
        ),
        F.round(total, 6).alias("total"),
    )


@query(
    "snk_06_add_run_prediction",
    with_sql(
        K.LABELED_SQL,
        select="SELECT d.doc_id::VARCHAR AS sid, d.source, l.label AS pred_sent_0, -l.label AS pred_sent_1 "
        "FROM documents d LEFT JOIN labeled l ON d.doc_id = l.doc_id",
    ),
)
def add_run_prediction(spark, sf):
    docs = _docs(spark, sf, "source").select(F.col("doc_id").cast("string").alias("sid"), "source")
    preds = K.labels_only(spark, sf).select(
        F.col("doc_id").cast("string").alias("sid"), F.col("label").alias("pred")
    )
    once = sinks.add_run_prediction(docs, preds, 0)
    return sinks.add_run_prediction(once, preds.withColumn("pred", -F.col("pred")), 1)


@query(
    "snk_07_append_run",
    "SELECT 'first' AS run_id, 'lexicon_sign' AS model, 3 AS n_classes, 3 AS n_lexicons UNION ALL "
    "SELECT 'second', 'lexicon_sign', 3, 3",
)
def append_run(spark, sf):
    from moodmill.operators import evaluate as E

    # read by the score, the figures and the counts
    pairs = runtime.materialize(scoring.pairs(spark, sf), "pairs")
    docs = K.words(spark, sf)
    matches = L.match_terms(docs, K.lexicon(spark), mode="bag")
    score = E.headline_score(pairs).first()["score"]
    run = sinks.run_record(
        spark, score, E.class_scores(pairs), pairs, L.lexicon_usage(docs, matches), "lexicon_sign"
    )
    run = runtime.materialize(run, "run")  # one row, or every append would make it anew
    path = runtime.scratch_path(spark, "runs")
    for run_id in ("first", "second", "first"):  # the first job runs again
        sinks.append_run(run, path, run_id)
    return spark.read.parquet(path).select(
        "run_id", "model", F.size("classes").alias("n_classes"), F.size("lexicons").alias("n_lexicons")
    )


@query(
    "snk_12_usage_report",
    with_sql(
        *BAG,
        K.lexicon_sql(),
        BAG_MATCHES,
        select="SELECT lexicon, count(DISTINCT doc_id)::VARCHAR AS messages FROM matches GROUP BY lexicon",
    ),
)
def usage_report(spark, sf):
    docs = K.words(spark, sf)
    usage = L.lexicon_usage(docs, L.match_terms(docs, K.lexicon(spark), mode="bag"))
    path = runtime.scratch_path(spark, "usage")
    sinks.write_usage_report(usage, path)
    return spark.read.csv(path, header=True).select("lexicon", "messages")


@query(
    "win_03_last_by_key",
    "SELECT source, arg_max(doc_id, doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source",
)
def last_by_key(spark, sf):
    rows = K.documents(spark, sf, "source", "lang")
    return readers.last_by_key(rows, "source", "doc_id")
