"""Message jobs: tokenizing, cleaning, negation, grams, surface features.

Input is a message table with ``doc_id`` and ``text``; the token list is the column
``toks``. Operators that return one row per token explode that list at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodmill import runtime
from moodmill.config import BlockSpec, CleanSpec
from moodmill.functions import patterns as P
from moodmill.functions import social
from moodmill.functions import text as T

Tokenizer = Callable[[Column], Column]
MODES = ("social", "informal", "formal", "space", "word")


def tokenizer(df: DataFrame, mode: str | Tokenizer) -> Tokenizer:
    """A named tokenizer, or a caller's own column function."""
    if callable(mode):
        return mode
    if mode == "social":
        protected = social.protected_pattern()
        return lambda text: T.tokens_social(text, protected)
    named = {
        "informal": T.tokens_informal,
        "formal": T.tokens_formal,
        "space": T.tokens_space,
        "word": T.tokens_word,
    }
    if mode not in named:
        raise ValueError(f"tokenizer must be one of {MODES} or a function, not {mode!r}")
    return named[mode]


def tokenize(messages: DataFrame, mode: str | Tokenizer = "social") -> DataFrame:
    return messages.withColumn("toks", tokenizer(messages, mode)(F.col("text")))


def explode_tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per token, ``pos`` from 0.

    The outer form: Spark pushes no test of the list's size, which would hold the tokenizer a
    second time, below the rows.
    """
    rows = docs.select("doc_id", *keep, F.posexplode_outer("toks").alias("pos", "tok"))
    return rows.where("tok IS NOT NULL")


def tokenize_strip_mentions(messages: DataFrame, stops: Sequence[str] = P.HANDLE_STOPS):
    bare = F.regexp_replace("text", P.HANDLE, " ")
    return messages.withColumn("toks", T.drop_stops(T.tokens_informal(bare), stops))


def map_tokens(docs: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return docs.withColumn("toks", change(F.col("toks")))


def unescape_text(df: DataFrame, col: str = "text", full: bool = True) -> DataFrame:
    undo = T.unescape_html if full else T.unescape_basic
    return df.withColumn(col, undo(F.col(col)))


def squeeze_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, T.squeeze_whitespace(F.col(col)))


def split_edges(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, T.split_edge_punct(F.col(col)))


def english_stops() -> tuple[str, ...]:
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def remove_stops(docs: DataFrame, stops: Sequence[str] | None = None) -> DataFrame:
    words = english_stops() if stops is None else stops
    return map_tokens(docs, lambda t: T.drop_stops(t, words))


def remove_listed(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens (column ``tok``) not on a word list of any length."""
    return tokens.join(
        runtime.small_side(words.withColumnRenamed("word", "tok")), "tok", "left_anti"
    )


def normalize_tokens(
    docs: DataFrame,
    mentions: bool = False,
    hashtags: bool = False,
    urls: bool = False,
    numbers: bool = False,
) -> DataFrame:
    steps = (
        (mentions, T.mark_mentions),
        (hashtags, T.mark_hashtags),
        (urls, T.mark_urls),
        (numbers, T.mark_numbers),
    )
    for wanted, step in steps:
        docs = map_tokens(docs, step) if wanted else docs
    return docs


def mark_negation(docs: DataFrame, style: str = "prefix") -> DataFrame:
    """Negation scope; the suffix form also counts the marked tokens."""
    marked = map_tokens(docs, lambda t: T.negate_tokens(t, style))
    if style == "prefix":
        return marked
    ends = T.count_where(F.col("toks"), lambda t: t.endswith(P.NEGATION_SUFFIX))
    return marked.withColumn("n_negated", ends)


def clean(messages: DataFrame, spec: CleanSpec = CleanSpec()) -> DataFrame:
    """Tokenize and clean in the order of the spec; with ``stops_first`` the surface
    counts of the raw tokens and the cleaned text are added."""
    docs = tokenize(messages, spec.tokenizer)
    stops = english_stops() if spec.stops is None else spec.stops
    if spec.stops_first:
        docs = map_tokens(surface_counts(docs), lambda t: T.drop_stops(t, stops))
    docs = map_tokens(docs, T.lower_tokens) if spec.lower else docs
    docs = mark_negation(docs, spec.negate) if spec.negate else docs
    if not spec.stops_first:
        docs = map_tokens(docs, lambda t: T.drop_stops(t, stops))
    docs = normalize_tokens(docs, spec.mentions, spec.hashtags, spec.urls, spec.numbers)
    if spec.stops_first:
        docs = docs.withColumn("cleaned", F.array_join("toks", " "))
    return docs


# ---------------------------------------------------------------- grams


def ngrams(docs: DataFrame, n: int, joiner: str = " ") -> DataFrame:
    return docs.withColumn("grams", T.ngram_array(F.col("toks"), n, joiner))


def gapped_ngrams(
    docs: DataFrame, mark: str = "---", vocabulary: DataFrame | None = None
) -> DataFrame:
    """One row per gapped gram; with a vocabulary (column ``gram``) only its members."""
    grams = docs.select(
        "doc_id", F.explode(T.gapped_array(F.col("toks"), mark)).alias("gram")
    )
    return grams if vocabulary is None else grams.join(
        runtime.small_side(vocabulary), "gram", "left_semi"
    )


def char_ngrams(messages: DataFrame, n: int) -> DataFrame:
    return messages.withColumn("grams", T.char_ngram_array(F.col("text"), n))


def gram_counts(docs: DataFrame) -> DataFrame:
    """Corpus counts of the ``grams`` lists, added up inside each task first.

    The outer form, as in ``explode_tokens``, so that the grams are made once.
    """
    rows = docs.select(F.explode_outer("grams").alias("gram")).where("gram IS NOT NULL")
    return rows.groupBy("gram").agg(F.sum(F.lit(1)).alias("n"))


def form_grams(toks: Column, form: str) -> Column:
    """The grams of one form: ``tok``, ``bi`` or ``tri`` plus the joiner, ``gap`` plus the mark."""
    if form == "tok":
        return toks
    if form.startswith("bi"):
        return T.ngram_array(toks, 2, form[2:])
    if form.startswith("tri"):
        return T.ngram_array(toks, 3, form[3:])
    if form.startswith("gap"):
        return T.gapped_array(toks, form[3:])
    raise ValueError(f"unknown gram form {form!r}")


#: Tests of the first and of the second word of a gram: a gram both fail is not wanted.
Begins = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def wanted_grams(toks: Column, form: str, begins: Begins) -> Column:
    """The grams of one form, without those of which the first words tell that they are not
    wanted. Only a mark at the start makes the second word the first one that is seen."""
    first, second = begins
    if form == "tok":
        return F.filter(toks, first)
    if form.startswith("gap"):
        return T.gapped_array(toks, form[3:], lambda a, b: first(a) | second(b))
    n, joiner = (2, form[2:]) if form.startswith("bi") else (3, form[3:])
    some = T.ngrams_from(toks, n, joiner, first)
    # a gram with a null word has fewer words
    return F.when(F.exists(toks, lambda t: t.isNull()), form_grams(toks, form)).otherwise(some)


def gram_forms(
    docs: DataFrame,
    forms: Iterable[str],
    distinct: bool = False,
    begins: Mapping[str, Begins] | None = None,
) -> DataFrame:
    """doc_id, form, gram over several gram forms in one scan of the messages.

    A form is ``tok``, ``bi`` or ``tri`` plus the joiner, or ``gap`` plus the mark. With
    ``distinct`` repeated grams go inside the row, before anything is exploded. ``begins``
    has tests by form, whose failures need not be built (see ``wanted_grams``).
    """

    def grams(form: str) -> Column:
        if begins and form in begins:
            return wanted_grams(F.col("toks"), form, begins[form])
        return form_grams(F.col("toks"), form)

    sets = [
        F.struct(
            F.lit(f).alias("form"),
            (F.array_distinct(grams(f)) if distinct else grams(f)).alias("grams"),
        )
        for f in sorted(set(forms))
    ]
    return docs.select("doc_id", F.explode(F.array(*sets)).alias("s")).select(
        "doc_id", F.col("s.form").alias("form"), F.explode("s.grams").alias("gram")
    )


# ---------------------------------------------------------------- tags


def filter_tags(tagged: DataFrame, tags: Sequence[str] = P.CONTENT_TAGS) -> DataFrame:
    return tagged.where(F.col("tag").isin(list(tags)))


def map_tags(tagged: DataFrame, scheme: str) -> DataFrame:
    return tagged.withColumn("mapped", T.map_tag(F.col("tag"), scheme))


def tag_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("doc_id", F.concat(F.lit("POS_"), F.col("tag")).alias("name")).agg(
        F.count("*").cast("double").alias("value")
    )


# ---------------------------------------------------------------- surface features


def surface_counts(docs: DataFrame) -> DataFrame:
    toks = F.col("toks")
    return docs.withColumns(
        {
            "n_caps": T.count_where(toks, T.is_caps),
            "n_mentions": T.count_where(toks, lambda t: t.startswith("@")),
            "n_hashtags": T.count_where(toks, lambda t: t.startswith("#")),
        }
    )


def elongated(docs: DataFrame) -> DataFrame:
    toks = F.col("toks")
    return docs.withColumns(
        {
            "long_words": F.filter(toks, lambda t: t.rlike(P.ELONGATED_WORD)),
            "long_marks": F.filter(toks, lambda t: t.rlike(P.ELONGATED_PUNCT)),
        }
    )


def last_token_punct(docs: DataFrame) -> DataFrame:
    last = F.try_element_at(F.col("toks"), F.lit(-1))
    return docs.withColumn("ends_marked", F.coalesce(last.rlike("[!?]"), F.lit(False)))


def emoticon_flags(docs: DataFrame) -> DataFrame:
    """Any happy or sad face outside links and times, and the polarity of the last token."""
    toks = F.col("toks")
    last = F.try_element_at(toks, F.lit(-1))
    usable = F.filter(toks, lambda t: ~t.rlike(P.FACE_EXCLUDED))
    return docs.withColumns(
        {
            "has_happy": F.exists(usable, T.happy_face),
            "has_sad": F.exists(usable, T.sad_face),
            "last_face": F.when(T.happy_face(last), 1).when(T.sad_face(last), -1).otherwise(0),
        }
    )


def punct_counts(docs: DataFrame) -> DataFrame:
    toks = F.col("toks")
    return docs.withColumns(
        {
            "n_caps": T.count_where(toks, T.is_caps),
            "n_exclaim": T.count_where(toks, lambda t: t.rlike(P.END_EXCLAMATION)),
            "n_question": T.count_where(toks, lambda t: t.rlike(P.END_QUESTION)),
            "n_mixed": T.count_where(
                toks, lambda t: t.rlike(P.END_MIXED) & t.contains("!") & t.contains("?")
            ),
        }
    )


def feature_rows(docs: DataFrame, block: str, values: dict[str, Column]) -> DataFrame:
    """Long features: doc_id, block, name, value."""
    cells = [
        F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"))
        for n, v in values.items()
    ]
    return docs.select("doc_id", F.lit(block).alias("block"), F.inline(F.array(*cells)))


def token_features(docs: DataFrame) -> DataFrame:
    """Presence of every token, plus the three message counters."""
    presence = docs.select(
        "doc_id",
        F.lit("TOKEN").alias("block"),
        F.explode(F.array_distinct("toks")).alias("name"),
        F.lit(1.0).alias("value"),
    )
    stats = feature_rows(
        surface_counts(docs),
        "STS",
        {
            "STS_ALL_CAPS": F.col("n_caps"),
            "STS_MENTIONS": F.col("n_mentions"),
            "STS_HASH": F.col("n_hashtags"),
        },
    )
    return presence.unionByName(stats)


def features_above(features: DataFrame, threshold: float) -> DataFrame:
    return features.where(F.col("value") > threshold)


def ids_by_class(messages: DataFrame, label: str = "label") -> DataFrame:
    """Message ids with their class name, only the three classes."""
    named = messages.withColumn("class", T.decode_label(F.col(label)))
    return named.where(F.col("class").isNotNull()).select("class", "doc_id")


def enabled_lexicons(lexicon: DataFrame, config: DataFrame) -> DataFrame:
    """Terms of the lexicons not switched off; a lexicon without an entry is on."""
    side = config.select("lexicon", "enabled")
    return (
        lexicon.join(side, "lexicon", "left")
        .where(F.coalesce("enabled", F.lit(True)))
        .drop("enabled")
    )


def _counts(values: dict[str, Column]) -> Column:
    """Names and whole numbers as ``term_runs`` gives them."""
    return F.array(
        *[F.struct(F.lit(n).alias("term"), v.cast("long").alias("n")) for n, v in values.items()]
    )


def _block(block: str, cells: Column) -> Column:
    return F.struct(F.lit(block).alias("block"), cells.alias("cells"))


def feature_blocks(
    messages: DataFrame,
    spec: BlockSpec = BlockSpec(),
    tokenizer_mode: str = "informal",
    tagged: DataFrame | None = None,
    clusters: DataFrame | None = None,
    scores: DataFrame | None = None,
) -> DataFrame:
    """All switched-on blocks as long features. A block that is off is never planned.

    Messages without a token cannot carry last-token features; ``feature_rejects``
    lists them, and they get no row of those blocks.
    """
    raw = tokenize(messages, tokenizer_mode)
    # the surface blocks come from one scan: a list of names and counts each
    rows = emoticon_flags(last_token_punct(elongated(surface_counts(raw))))
    rows = rows.withColumn("_some", F.size("toks") > 0)
    rows = map_tokens(normalize_tokens(rows, mentions=True, urls=True), T.lower_tokens)
    marked = mark_negation(rows, "suffix")
    sets = [_block("NEGATION", _counts({"NEGATED_NUM": F.col("n_negated")}))]
    parts = []

    def counts(frame: DataFrame, terms: Column, block: str) -> DataFrame:
        return frame.select(
            "doc_id", F.lit(block).alias("block"), F.inline(T.term_runs(terms))
        ).select("doc_id", "block", F.col("term").alias("name"), F.col("n").cast("double").alias("value"))

    if spec.ngrams:
        toks = F.col("toks")
        grams = F.concat(
            toks,
            *[T.ngram_array(toks, n) for n in (2, 3, 4)],
            T.gapped_array(toks),
        )
        parts.append(counts(marked, grams, "NGRAM"))
    if spec.char_ngrams:
        text = F.lower("text")
        grams = F.concat(*[T.char_ngram_array(text, n) for n in (3, 4, 5)])
        parts.append(counts(messages, grams, "CHAR"))
    surface = {
        name: F.col(col)
        for wanted, name, col in (
            (spec.caps, "NR_ALL_CAPS", "n_caps"),
            (spec.mentions, "NR_MENTIONS", "n_mentions"),
            (spec.hashtags, "NR_HASH", "n_hashtags"),
        )
        if wanted
    }
    if surface:
        sets.append(_block("SURFACE", _counts(surface)))
    if spec.punctuation:
        values = {"PCT_ELONG": F.size("long_marks"), "PCT_LAST!?": F.col("ends_marked")}
        sets.append(_block("PUNCT", F.when(F.col("_some"), _counts(values))))
    if spec.emoticons:
        values = {
            "EMOT_POS": F.col("has_happy"),
            "EMOT_NEG": F.col("has_sad"),
            "EMOT_LAST": F.col("last_face"),
        }
        sets.append(_block("EMOTICON", F.when(F.col("_some"), _counts(values))))
    if spec.elongated:
        sets.append(_block("ELONGATED", _counts({"FLG_ELONGATED": F.size("long_words")})))
    each = marked.select("doc_id", F.explode(F.array(*sets)).alias("s"))
    cells = each.select("doc_id", F.col("s.block").alias("block"), F.inline("s.cells"))
    value = F.col("n").cast("double").alias("value")
    parts.append(cells.select("doc_id", "block", F.col("term").alias("name"), value))
    if spec.tags and tagged is not None:
        parts.append(tag_counts(tagged).withColumn("block", F.lit("POS")))
    if spec.clusters and clusters is not None:
        docs = map_tokens(normalize_tokens(raw, mentions=True, urls=True), T.lower_tokens)
        parts.append(cluster_features(docs, clusters).withColumn("block", F.lit("CLUSTER")))
    if spec.scores and scores is not None:
        parts.append(scores.withColumn("block", F.lit("SCORE")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def feature_rejects(messages: DataFrame, tokenizer_mode: str = "informal") -> DataFrame:
    empty = tokenize(messages, tokenizer_mode).where(F.coalesce(F.size("toks"), F.lit(0)) == 0)
    return empty.select("doc_id", F.lit("no tokens").alias("reason"))


def cluster_features(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Presence of each word cluster (clusters: word, cluster) in a message."""
    terms = docs.select("doc_id", F.explode(F.array_distinct("toks")).alias("word"))
    return (
        terms.join(runtime.small_side(clusters), "word")
        .select("doc_id", F.concat(F.lit("CLUST_"), F.col("cluster")).alias("name"))
        .distinct()
        .withColumn("value", F.lit(1.0))
    )


# ---------------------------------------------------------------- ordered views


def running_state(docs: DataFrame) -> DataFrame:
    """Tokens with the negation state before and after each of them."""
    suffix = T.negate_tokens(F.col("toks"), "suffix")
    return docs.select("doc_id", F.posexplode(F.arrays_zip("toks", suffix.alias("marked")))).select(
        "doc_id",
        "pos",
        F.col("col.toks").alias("tok"),
        (F.col("col.marked") != F.col("col.toks")).alias("inside"),
    )


def adjacent(docs: DataFrame, n: int) -> DataFrame:
    """Windows of n neighbouring tokens, one row each, ``pos`` of the first."""
    grams = T._windows(F.col("toks"), n, lambda w: w, "array<array<string>>")
    return docs.select("doc_id", F.posexplode(grams).alias("pos", "w")).select(
        "doc_id", "pos", *[F.get("w", i).alias(f"tok_{i + 1}") for i in range(n)]
    )


def last_value_per_doc(docs: DataFrame) -> DataFrame:
    last = F.try_element_at(F.col("toks"), F.lit(-1))
    return docs.select("doc_id", (F.size("toks") - 1).alias("pos"), last.alias("tok"))
