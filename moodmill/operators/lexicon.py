"""Lexicon lookup and the statistics of what was found.

All lexicons are looked up by one join against the long table
``lexicon, term, dim, value`` (``dim`` is ``polarity`` for opinion lexicons). Only
matches are shuffled: the lexicon is broadcast once it is counted to be below the size
bound (``runtime.small_side``), and joined by a shuffle with skew handling above it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodmill import runtime
from moodmill.config import LexiconSpec
from moodmill.functions import patterns as P
from moodmill.functions import text as T
from moodmill.operators import corpus as C

POLARITY = "polarity"
KINDS = {"tok": "words", "bi ": "bigrams", "tri ": "trigrams", "gap---": "gapped"}
HIGH_BOUND = 0.1


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def bare(term: Column) -> Column:
    return F.replace(term, F.lit(P.NEGATION_PREFIX), F.lit(""))


def effective(lexicon: DataFrame) -> DataFrame:
    """A zero opinion value counts as no entry; a zero emotion value is a value."""
    return lexicon.where((F.col("dim") != POLARITY) | (F.col("value") != 0))


# ---------------------------------------------------------------- matching


def match_terms(
    docs: DataFrame,
    lexicon: DataFrame,
    specs: Sequence[LexiconSpec] | None = None,
    mode: str = "set",
) -> DataFrame:
    """doc_id, lexicon, kind, gram, dim, value for every match.

    ``set``: each lexicon looks at the gram forms of its spec, a gram counts once per
    message, ``NEG_`` is ignored for the lookup and turns the sign of opinion values.
    ``bag``: every lexicon sees tokens, bigrams, trigrams and gapped grams as often as
    they occur, and negation is not looked at.
    """
    if mode == "bag":
        kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
        table = runtime.small_side(effective(lexicon).withColumnRenamed("term", "gram"))
        grams = C.gram_forms(docs, KINDS, begins=_begins(table, "gram", KINDS))
        hits = grams.join(table, "gram")
        return hits.select(
            "doc_id", "lexicon", kinds[F.col("form")].alias("kind"), "gram", "dim", "value"
        )
    if mode != "set":
        raise ValueError(f"mode must be 'set' or 'bag', not {mode!r}")
    specs = specs or ()
    if not specs:
        raise ValueError("set mode needs the specs of the lexicons to look up")
    table = runtime.small_side(_by_form(effective(lexicon), specs))
    forms = {f for s in specs for f in s.forms()}
    # repeats of a form go inside the row; those of another form are found among the matches
    several = any(len(s.forms()) > 1 for s in specs)
    grams = C.gram_forms(docs, forms, distinct=True, begins=_begins(table, "term", forms, bare))
    grams = grams.withColumn("term", bare(F.col("gram")))
    turned = F.col("gram").contains(P.NEGATION_PREFIX) & (F.col("dim") == POLARITY)
    hits = grams.join(table, ["form", "term"]).select(
        "doc_id",
        "lexicon",
        F.col("form").alias("kind"),
        "gram",
        "dim",
        F.when(turned, -F.col("value")).otherwise(F.col("value")).alias("value"),
    )
    if several:
        hits = hits.dropDuplicates(["doc_id", "lexicon", "gram", "dim"])
    return hits


#: Rows of a lexicon up to which grams are judged by their first words before they are built,
#: and characters of the beginnings of its terms.
LISTED_ROWS, LISTED_CHARS = 5000, 1 << 20


def _begins(
    table: DataFrame, key: str, forms: Iterable[str],
    change: Callable[[Column], Column] | None = None, form_of: Callable[[str], str] = str,
) -> dict[str, C.Begins]:
    """Tests by form that the first words of every gram in column ``key`` of ``table`` pass.

    A gram is words around joiners, so its first word is what a term has before one of its
    joiners, or between a mark at its start and a later space. ``change`` is what is done to a
    gram before it is looked up; it must not reach over a joiner, else the form has no test.
    A longer lexicon has no tests: all grams are built and joined. ``form_of`` tells the form
    of a value of the table's column ``form``, where that says more.
    """
    cols = [c for c in ("form", key) if c in table.columns]
    rows = table.select(*cols).where(F.col(key).isNotNull()).limit(LISTED_ROWS + 1).collect()
    if len(rows) > LISTED_ROWS:
        return {}

    def test(words: set[str]) -> Callable[[Column], Column]:
        own = sorted(words)
        return lambda w: (change(w) if change else w).isin(own)

    out = {}
    for name in forms:
        form = form_of(name)
        terms = {r[key] for r in rows if "form" not in cols or r["form"] == name}
        mark = form[2:] if form.startswith("bi") else form[3:]
        joins = () if form == "tok" else (" ", mark) if form.startswith("gap") else (mark,)
        if not all(joins) or (change and set("".join(joins)) & set(P.NEGATION_PREFIX)):
            continue
        first, second = terms, set()
        if joins:
            if sum(len(t) * t.count(j) for t in terms for j in joins) > LISTED_CHARS:
                continue
            first = _before(terms, joins)
            if form.startswith("gap"):
                second = _before({t[len(mark) :] for t in terms if t.startswith(mark)}, (" ",))
        out[name] = test(first), test(second)
    return out


def _before(terms: Iterable[str], joins: Sequence[str]) -> set[str]:
    """What terms have before each joiner in them."""
    out = set()
    for term in terms:
        for join in joins:
            at = term.find(join)
            while at >= 0:
                out.add(term[:at])
                at = term.find(join, at + 1)
    return out


def _by_form(lexicon: DataFrame, specs: Sequence[LexiconSpec]) -> DataFrame:
    """The lexicon rows under each gram form their spec asks for, wanted dims only."""
    spark = lexicon.sparkSession
    rows = [(s.name, f) for s in specs for f in s.forms()]
    forms = runtime.local_table(spark, rows, "lexicon string, form string")
    table = lexicon.join(F.broadcast(forms), "lexicon")  # one row per lexicon and form
    for s in specs:
        if s.dims:
            table = table.where((F.col("lexicon") != s.name) | F.col("dim").isin(list(s.dims)))
    return table


def tag_key(tok: Column, tag: Column, scheme: str) -> Column:
    """``token.letter`` (``dot``) or ``token#TAG`` (``hash``)."""
    if scheme == "dot":
        return F.concat_ws(".", tok, T.map_tag(tag, "synset"))
    if scheme == "hash":
        return F.concat_ws("#", tok, T.map_tag(tag, "word"))
    raise ValueError(f"unknown key scheme {scheme!r}")


def match_tagged(
    tagged: DataFrame, lexicon: DataFrame, scheme: str, bigrams: bool = False, joiner: str = " "
) -> DataFrame:
    """Lookup of tagged tokens, and of pairs of neighbours by the tag of the pair.

    ``tagged`` has a row per token, or a row per message with the lists ``toks`` and ``tags``
    (and ``bigram_tags``), whose keys are built and freed of repeats inside the row.
    ``bigram_tag`` is the tag of a token and the next one as one word. In the hash form the
    entries of one gram under several tags collapse to the entry of its last matching
    occurrence, pairs after tokens. A lexicon holds a term and dim once.
    """
    if "toks" in tagged.columns:
        once, again = runtime.split_repeated(tagged)
        keyed = _tagged_lists(once, scheme, bigrams, joiner)
        if again is not None:  # rows of one message: neighbours across them
            several = _tagged_rows(_tokens_of(again), scheme, bigrams, joiner)
            keyed = keyed.unionByName(several.withColumn("alone", F.lit(False)))
    else:
        keyed = _tagged_rows(tagged, scheme, bigrams, joiner)
    if scheme == "dot":
        table = runtime.small_side(effective(lexicon))
        hits = keyed.join(table, "term").groupBy("doc_id", "lexicon", "gram", "dim")
        return hits.agg(F.first("value").alias("value"))
    # a gram that is the beginning of its term travels once
    start = F.expr("left(term, length(term) - length(substring_index(term, '#', -1)) - 1)")
    keyed = keyed.withColumn("gram", F.when(start != F.col("tok"), F.col("tok"))).drop("tok")
    hits = keyed.join(runtime.small_side(effective(lexicon)), "term")
    hits = hits.withColumn("gram", F.coalesce("gram", start)).drop("term")
    if "alone" not in hits.columns:
        return _last_entries(hits)
    # only a gram with several tags in its message has entries to choose from
    hits = runtime.materialize(hits, "matches")
    single = hits.where("alone").select("doc_id", "lexicon", "gram", "dim", "value")
    return single.unionByName(_last_entries(hits.where("NOT alone")))


def _tokens_of(docs: DataFrame) -> DataFrame:
    """A row per token of message rows."""
    lists = [F.col("toks").alias("tok"), F.col("tags").alias("tag")]
    if "bigram_tags" in docs.columns:
        lists.append(F.concat("bigram_tags", F.array(F.lit(None).cast("string"))).alias("bigram_tag"))
    rows = docs.select("doc_id", F.posexplode_outer(F.arrays_zip(*lists)).alias("pos", "t"))
    return rows.select("doc_id", "pos", "t.*").where("tok IS NOT NULL")


def _tagged_rows(tagged: DataFrame, scheme: str, bigrams: bool, joiner: str) -> DataFrame:
    """doc_id, place, tok, gram, term of tokens and pairs."""
    keyed = tagged.select(
        "doc_id", F.struct(F.lit(0).alias("pair"), "pos").alias("place"), "tok", "tag"
    )
    if bigrams:
        if "bigram_tag" not in tagged.columns:
            raise ValueError("bigrams of a tagged lexicon need the column bigram_tag")
        ahead = F.lead("tok").over(Window.partitionBy("doc_id").orderBy("pos"))
        pairs = tagged.withColumn("next", ahead).where("next IS NOT NULL")
        keyed = keyed.unionByName(
            pairs.select(
                "doc_id",
                F.struct(F.lit(1).alias("pair"), "pos").alias("place"),
                F.concat_ws(joiner, "tok", "next").alias("tok"),
                F.col("bigram_tag").alias("tag"),
            )
        )
    keyed = keyed.withColumn("gram", tag_key(F.col("tok"), F.col("tag"), scheme))
    return keyed.withColumn("term", bare(F.col("gram"))).drop("tag")


def _tagged_lists(docs: DataFrame, scheme: str, bigrams: bool, joiner: str) -> DataFrame:
    """doc_id, place, tok, gram, term: each key of a message once, at its last place; ``alone``
    is a gram with one key."""
    if bigrams and "bigram_tags" not in docs.columns:
        raise ValueError("bigrams of a tagged lexicon need the column bigram_tags")
    keys = _keys(f"plain|{scheme}|" + (f"pairs{joiner}" if bigrams else "alone"), docs)
    last = T.let(
        F.sort_array(keys),  # by gram, term, place
        lambda ks: F.filter(
            ks,
            lambda k, i: F.coalesce(
                (F.get(ks, i + 1)["gram"] != k["gram"]) | (F.get(ks, i + 1)["term"] != k["term"]),
                F.lit(True),
            ),
        ),
    )
    def other(ks: Column, i: Column, k: Column) -> Column:
        return F.coalesce(F.get(ks, i)["gram"] != k["gram"], F.lit(True))

    marked = T.let(
        last,
        lambda ks: F.transform(
            ks,
            lambda k, i: F.struct(
                k["gram"].alias("gram"),
                k["term"].alias("term"),
                k["place"].alias("place"),
                (other(ks, i - 1, k) & other(ks, i + 1, k)).alias("alone"),
            ),
        ),
    )
    rows = docs.select("doc_id", F.explode_outer(marked).alias("k")).where("k IS NOT NULL")
    return rows.select(
        "doc_id",
        F.struct(F.lit(0).alias("pair"), F.col("k.place").alias("pos")).alias("place"),
        F.col("k.gram").alias("tok"),
        F.col("k.gram").alias("gram"),
        "k.term",
        "k.alone",
    )


def _last_entries(hits: DataFrame) -> DataFrame:
    """Of the matches of a gram, the entry of its last place."""
    entry = F.struct("place", "dim", "value")
    each = hits.groupBy("doc_id", "lexicon", "gram").agg(F.collect_list(entry).alias("e"))
    last = T.let(
        F.array_max("e")["place"], lambda place: F.filter("e", lambda e: e["place"] == place)
    )
    entries = F.transform(last, lambda e: F.struct(e["dim"].alias("dim"), e["value"].alias("value")))
    return each.select("doc_id", "lexicon", "gram", F.inline_outer(entries))


def sense_scores(senses: DataFrame, sense: str) -> DataFrame:
    """word, letter and the three scores of a word's first sense, or the mean of all."""
    if sense == "first":
        table = senses.where(F.col("sense") == 1).drop("sense")
    elif sense == "mean":
        table = senses.groupBy("word", "tag").agg(*[F.avg(c).alias(c) for c in SENSE_DIMS])
    else:
        raise ValueError(f"sense must be 'first' or 'mean', not {sense!r}")
    return table.withColumnRenamed("tag", "letter")


def match_synsets(tagged: DataFrame, senses: DataFrame, sense: str = "first") -> DataFrame:
    """Scores of the first sense, or the mean over all senses, of each tagged token.

    ``NEG_`` is stripped for the lookup and swaps positive and negative.
    """
    table = runtime.small_side(sense_scores(senses, sense))
    keyed = tagged.select(
        "doc_id",
        "pos",
        "tok",
        bare(F.col("tok")).alias("word"),
        T.map_tag(F.col("tag"), "synset").alias("letter"),
    ).where(F.col("letter") != "")
    negated = F.col("tok").contains(P.NEGATION_PREFIX)
    return keyed.join(table, ["word", "letter"]).select(
        "doc_id",
        "pos",
        "tok",
        F.when(negated, F.col("neg_score")).otherwise(F.col("pos_score")).alias("pos_score"),
        F.when(negated, F.col("pos_score")).otherwise(F.col("neg_score")).alias("neg_score"),
        "obj_score",
    )


# ---------------------------------------------------------------- message statistics


def opinion_features(matches: DataFrame, docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """avg, sum, min, max, negamt, posamt, fpol per message and lexicon; zeros for no match.

    Matches are brought together by message once; the messages join as one row each, and
    the lexicons without a match are filled in inside that row.
    """
    v = F.col("value")
    stats = {
        "avg": F.avg(v),
        "sum": F.sum(v),
        "min": F.min(v),
        "max": F.max(v),
        "negamt": F.count(F.when(v < 0, 1)),
        "posamt": F.count(F.when(v > 0, 1)),
    }
    hits = matches.where(F.col("dim") == POLARITY).select("doc_id", "lexicon", "value")
    found = (
        hits.repartition("doc_id")
        .groupBy("doc_id", "lexicon")
        .agg(*[c.alias(n) for n, c in stats.items()])
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("lexicon", F.struct(*stats).alias("s"))).alias("found"))
    )
    zero = F.struct(
        *[F.lit(0.0).alias(n) for n in ("avg", "sum", "min", "max")],
        *[F.lit(0).cast("long").alias(n) for n in ("negamt", "posamt")],
    )
    out = _per_lexicon(docs.select("doc_id").join(found, "doc_id", "left"), names, zero)
    return out.select("doc_id", "lexicon", "s.*").withColumn("fpol", F.signum("sum").cast("int"))


def _per_lexicon(rows: DataFrame, names: Sequence[str], zero: Column) -> DataFrame:
    """A row per lexicon of every row: ``s`` from its array ``found``, or ``zero``."""
    each = rows.withColumn("found", F.map_from_entries("found")).withColumn(
        "lexicon", F.explode(F.array(*[F.lit(n) for n in names]))
    )
    return each.withColumn("s", F.coalesce(F.try_element_at("found", F.col("lexicon")), zero))


def emotion_features(matches: DataFrame, positive_only: bool = False) -> DataFrame:
    """avg, sum, min, max, count per message, lexicon and dim; no row for no match.

    ``positive_only`` is the count of the tag-keyed lexicons: values above zero.
    """
    v = F.col("value")
    count = F.count(F.when(v > 0, 1)) if positive_only else F.count("*")
    hits = matches.where(F.col("dim") != POLARITY)
    return hits.groupBy("doc_id", "lexicon", "dim").agg(
        F.avg(v).alias("avg"),
        F.sum(v).alias("sum"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        count.alias("count"),
    )


def emotion_terms(matches: DataFrame, threshold: float | None = None) -> DataFrame:
    """One feature per matched term and dim, optionally only above an absolute value."""
    hits = matches.where(F.col("dim") != POLARITY)
    if threshold:
        hits = hits.where(F.abs("value") > threshold)
    return hits.select(
        "doc_id", F.concat_ws("_", "lexicon", "gram", "dim").alias("name"), "value"
    ).distinct()


def synset_features(matches: DataFrame, docs: DataFrame, thresh: float = 0.75) -> DataFrame:
    """Totals, averages, averages of the subjective tokens and the sign of the difference."""
    subjective = F.col("obj_score") < thresh
    none = docs.select(
        "doc_id",
        *[F.lit(None).cast("double").alias(c) for c in ("pos_score", "neg_score", "obj_score")],
    )
    scores = matches.select("doc_id", "pos_score", "neg_score", "obj_score")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    def subj(c: str) -> Column:
        return F.coalesce(F.sum(F.when(subjective, F.col(c))), F.lit(0.0))

    n = F.greatest(F.count("pos_score"), F.lit(1))
    n_subj = F.greatest(F.count(F.when(subjective, 1)), F.lit(1))
    out = none.unionByName(scores).groupBy("doc_id").agg(
        total("pos_score").alias("pos_tot"),
        total("neg_score").alias("neg_tot"),
        total("obj_score").alias("obj_tot"),
        (total("pos_score") / n).alias("pos_avg"),
        (total("neg_score") / n).alias("neg_avg"),
        (subj("pos_score") / n_subj).alias("pos_avg_tre"),
        (subj("neg_score") / n_subj).alias("neg_avg_tre"),
    )
    decision = F.signum(F.col("pos_avg") - F.col("neg_avg")).cast("int")
    return out.withColumn("decision", decision)


def synset_terms(matches: DataFrame) -> DataFrame:
    """Per-token scores as features; the last occurrence of a token counts."""
    last = matches.groupBy("doc_id", "tok").agg(
        F.max_by(F.struct("pos_score", "neg_score", "obj_score"), "pos").alias("s")
    )
    cells = [
        F.struct(
            F.concat(F.lit(f"SWN_{n}_"), F.col("tok")).alias("name"),
            F.col(f"s.{c}").alias("value"),
        )
        for n, c in (("POS", "pos_score"), ("NEG", "neg_score"), ("OBJ", "obj_score"))
    ]
    return last.select("doc_id", F.inline(F.array(*cells)))


def lexicon_sums(matches: DataFrame) -> DataFrame:
    """Bag-mode sums per message, lexicon and dim, with the feature name."""
    name = F.when(
        F.col("dim") == POLARITY, F.concat(F.lit("SUM_"), F.col("lexicon"))
    ).otherwise(F.concat_ws("_", "lexicon", "dim"))
    sums = matches.groupBy("doc_id", "lexicon", "dim").agg(F.sum("value").alias("value"))
    return sums.withColumn("name", name)


def lexicon_agreement(sums: DataFrame, labels: DataFrame, bound: float = HIGH_BOUND) -> DataFrame:
    """1 where a sum and the gold label agree; exactly at a bound nothing agrees."""
    v, gold = F.col("value"), F.col("label")
    agree = (
        ((v > bound) & (gold == 1))
        | ((v < -bound) & (gold == -1))
        | ((v > -bound) & (v < bound) & (gold == 0))
    )
    return sums.join(labels.select("doc_id", "label"), "doc_id").withColumn(
        "agrees", F.coalesce(agree, F.lit(False)).cast("int")
    )


# ---------------------------------------------------------------- usage


def gram_totals(docs: DataFrame) -> DataFrame:
    """One row of corpus totals; gram counts follow from the token counts."""
    n = F.size("toks").cast("long")
    three = F.greatest(n - 2, F.lit(0))
    four = F.greatest(n - 3, F.lit(0))
    return docs.agg(
        F.count("*").alias("total_messages"),
        F.sum(n).alias("total_words"),
        F.sum(F.greatest(n - 1, F.lit(0))).alias("total_bigrams"),
        F.sum(three).alias("total_trigrams"),
        F.sum(4 * four + 3 * three).alias("total_gapped"),
    )


def lexicon_usage(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched words, messages and grams per lexicon and their share of the corpus."""
    # an emotion lexicon has several dims per matched gram: count each gram once
    per_doc = matches.groupBy("doc_id", "lexicon", "kind", "gram", "dim").agg(
        F.count("*").alias("n")
    )
    per_doc = per_doc.groupBy("doc_id", "lexicon", "kind", "gram").agg(F.max("n").alias("n"))
    per_doc = per_doc.groupBy("doc_id", "lexicon").agg(
        *[
            F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k)
            for k in KINDS.values()
        ]
    )
    used = per_doc.groupBy("lexicon").agg(
        F.count("*").alias("messages"), *[F.sum(k).alias(k) for k in KINDS.values()]
    )
    totals = gram_totals(docs)
    shares = [
        F.try_divide(F.col(k), F.col(f"total_{k}")).alias(f"share_{k}")
        for k in ("messages", *KINDS.values())
    ]
    return used.crossJoin(F.broadcast(totals)).select("*", *shares)  # totals is one row


def found_by_lexicon(matches: DataFrame) -> DataFrame:
    """Per message and lexicon the found grams in order, and how many there are."""
    return matches.groupBy("doc_id", "lexicon").agg(
        F.array_sort(F.collect_list(F.struct("gram", "dim", "value"))).alias("found"),
        F.count("*").alias("total"),
    )


def found_by_term(matches: DataFrame) -> DataFrame:
    """Per message and gram a map from lexicon (and dim) to value."""
    key = F.when(F.col("dim") == POLARITY, F.col("lexicon")).otherwise(
        F.concat_ws("_", "lexicon", "dim")
    )
    pair = F.struct(key.alias("key"), F.col("value"))
    return matches.groupBy("doc_id", "gram").agg(
        F.map_from_entries(F.array_sort(F.collect_set(pair))).alias("values")
    )


def found_totals(matches: DataFrame) -> DataFrame:
    distinct = matches.select("doc_id", "kind", "gram").distinct()
    return distinct.groupBy("doc_id", "kind").agg(F.count("*").alias("total"))


def term_lexicon_features(matches: DataFrame) -> DataFrame:
    name = F.when(F.col("dim") == POLARITY, F.concat_ws("_", "lexicon", "gram")).otherwise(
        F.concat_ws("_", "lexicon", "gram", "dim")
    )
    return matches.select("doc_id", name.alias("name"), "value").distinct()


# ---------------------------------------------------------------- token sequences


def polarity_summary(docs: DataFrame, lexicon: DataFrame, names: Sequence[str]) -> DataFrame:
    """count above 0, max, sum and last of each polarity, apart for plain and negated tokens.

    A token without an entry counts as 0. Only matches are shuffled: whether a zero
    takes part in the maximum follows from the token counts of the message.
    """
    marks = T.negate_tokens(F.col("toks"), "suffix")
    lists = docs.select("doc_id", "toks", marks.alias("marked"))
    lists = lists.withColumn(
        "n_in",
        T.count_where(F.arrays_zip("toks", "marked"), lambda p: p["toks"] != p["marked"]),
    ).withColumn("n_all", F.size("toks"))
    # the outer form: Spark pushes no test of the list's size, which holds the tokenizer and the
    # negation a second time, below the rows; a null token meets no entry
    toks = lists.select(
        "doc_id", F.posexplode_outer(F.arrays_zip("toks", "marked")).alias("pos", "t"), "n_all"
    ).select(
        "doc_id",
        (F.col("t.toks") != F.col("t.marked")).alias("negated"),
        F.col("t.toks").alias("term"),
        (F.col("pos") == F.col("n_all") - 1).alias("at_end"),
    )
    polar = lexicon.where((F.col("dim") == POLARITY) & F.col("lexicon").isin(list(names)))
    hits = toks.join(runtime.small_side(polar), "term").select("doc_id", "lexicon", "negated", "value", "at_end")
    last_in = F.coalesce(
        F.try_element_at("toks", F.lit(-1)) != F.try_element_at("marked", F.lit(-1)), F.lit(False)
    )
    v = F.col("value")
    stats = {
        "count": F.count(F.when(v > 0, 1)),
        "max": F.max(v),
        "hits": F.count(v),
        "sum": F.coalesce(F.sum(v), F.lit(0.0)),
        "last": F.max(F.when(F.col("at_end"), v)),
    }
    found = (
        hits.repartition("doc_id")
        .groupBy("doc_id", "lexicon", "negated")
        .agg(*[c.alias(n) for n, c in stats.items()])
        .groupBy("doc_id")
        .agg(
            F.collect_list(
                F.struct(F.struct("lexicon", "negated").alias("key"), F.struct(*stats).alias("s"))
            ).alias("found")
        )
    )
    zero = F.struct(
        F.lit(0).cast("long").alias("count"),
        F.lit(None).cast("double").alias("max"),
        F.lit(0).cast("long").alias("hits"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("double").alias("last"),
    )
    # one row per message meets its matches; states and lexicons are filled in inside it
    base = lists.select("doc_id", "n_all", "n_in", last_in.alias("last_in"))
    every = base.join(found, "doc_id", "left").withColumn("found", F.map_from_entries("found"))
    states = F.array(F.lit(False), F.lit(True))
    every = every.withColumn("negated", F.explode(states)).withColumn(
        "lexicon", F.explode(F.array(*[F.lit(n) for n in names]))
    )
    here = F.when(F.col("negated"), F.col("n_in")).otherwise(F.col("n_all") - F.col("n_in"))
    every = every.where(here > 0)
    key = F.struct("lexicon", "negated")
    rows = every.withColumn("s", F.coalesce(F.try_element_at("found", key), zero))
    zeros = F.col("s.hits") < F.col("n_all")
    holds = F.col("negated") == F.col("last_in")
    return rows.select(
        "doc_id",
        "lexicon",
        "negated",
        "s.count",
        F.when(zeros, F.greatest("s.max", F.lit(0.0))).otherwise(F.col("s.max")).alias("max"),
        "s.sum",
        F.when(holds, F.coalesce("s.last", F.lit(0.0))).alias("last"),
    )


def sequence_stats(docs: DataFrame, grams: Column, lexicon: DataFrame, prefix: str) -> DataFrame:
    """max, sum, count above 0 and "last above 0" over a gram list; zeros if it is empty.

    ``lexicon`` is term, value for the kind of gram in the list.
    """
    lists = docs.select("doc_id", grams.alias("g")).withColumn("n", F.size("g"))
    rows = lists.select("doc_id", "n", F.posexplode_outer("g").alias("pos", "term"))
    table = runtime.small_side(lexicon.select("term", "value"))
    hits = rows.join(table, "term").select(
        "doc_id", "value", (F.col("pos") == F.col("n") - 1).alias("at_end")
    )
    base = lists.select(
        "doc_id", "n", F.lit(None).cast("double").alias("value"), F.lit(False).alias("at_end")
    )
    v = F.col("value")
    out = base.unionByName(hits, allowMissingColumns=True).groupBy("doc_id").agg(
        F.max("n").alias("_n"),
        F.count(v).alias("_hits"),
        F.max(v).alias("_max"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{prefix}_SUM"),
        F.count(F.when(v > 0, 1)).alias(f"{prefix}_COUNT"),
        F.max(F.when(F.col("at_end") & (v > 0), 1).otherwise(0)).alias(f"{prefix}_LASPOS"),
    )
    filled = F.when(F.col("_hits") < F.col("_n"), F.greatest("_max", F.lit(0.0))).otherwise(
        F.coalesce("_max", F.lit(0.0))
    )
    return out.withColumn(f"{prefix}_MAX", filled).drop("_n", "_hits", "_max")


# ---------------------------------------------------------------- feature blocks


OPINION_STATS = {
    "avg": ("avg",),
    "sum": ("sum",),
    "min": ("min",),
    "max": ("max",),
    "amounts": ("negamt", "posamt"),
    "final": ("fpol",),
}
EMOTION_STATS = {"avg": "avg", "sum": "summ", "min": "minn", "max": "maxn", "amounts": "count"}


SYNSET_STATS = {
    "sum": {"pos_tot": "pos_tot", "neg_tot": "neg_tot", "obj_tot": "obj_tot"},
    "avg": {"pos_avg": "pos_avg", "neg_avg": "neg_avg"},
    "thresh": {"pos_avg_tre": "pos_avg_tre", "neg_avg_tre": "neg_avg_tre"},
    "decision": {"decision": "DECISION"},
}
SENSE_DIMS = ("pos_score", "neg_score", "obj_score")
SENSE_FORM = "sense"


def with_tags(docs: DataFrame, tagged: DataFrame) -> DataFrame:
    """``tags`` (and ``bigram_tags``) of the messages' tokens as lists, from one row per token."""
    cols = [c for c in ("tag", "bigram_tag") if c in tagged.columns]
    lists = tagged.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("t")
    )
    named = [F.coalesce(F.col(f"t.{c}"), F.array().cast("array<string>")).alias(f"{c}s") for c in cols]
    return docs.join(lists, "doc_id", "left").select(*docs.columns, *named)


def look_ups(spec: LexiconSpec) -> tuple[str, ...]:
    """Names of the kinds of keys that a spec looks at: its token list, then its form."""
    lists = "negated" if spec.negated else "plain"
    if spec.family == "synset":
        if spec.bigrams or spec.trigrams or spec.gapped:
            raise ValueError(f"{spec.name}: senses are looked up by token")
        return (f"{lists}|{SENSE_FORM}",)
    if spec.family == "tagged":
        if spec.trigrams or spec.gapped:
            raise ValueError(f"{spec.name}: a tagged lexicon has tokens and bigrams")
        pairs = f"pairs{spec.joiner}" if spec.bigrams else "alone"
        return (f"{lists}|{spec.tag_scheme}|{pairs}",)
    return tuple(f"{lists}|{form}" for form in spec.forms())


def _keys(
    look_up: str, docs: DataFrame, begins: Mapping[str, C.Begins] | None = None
) -> Column:
    """Array of (gram, term, place) of one kind of key; the place counts only where tags do."""
    lists, form, *rest = look_up.split("|")
    toks = F.col("toks") if lists == "plain" else F.col("negated")

    def key(gram: Column, term: Column, place: Column | int = -1) -> Column:
        place = F.lit(place) if isinstance(place, int) else place
        return F.struct(gram.alias("gram"), term.alias("term"), place.cast("int").alias("place"))

    if not rest and form != SENSE_FORM:
        if begins and look_up in begins:
            grams = C.wanted_grams(toks, form, begins[look_up])
        else:
            grams = C.form_grams(toks, form)
        return F.transform(F.array_distinct(grams), lambda g: key(g, bare(g)))
    if "tags" not in docs.columns:
        raise ValueError("lexicons keyed by tag or sense need the tags of the messages")
    both = F.arrays_zip(toks.alias("tok"), F.col("tags").alias("tag"))
    if form == SENSE_FORM:
        letter = lambda t: T.map_tag(t["tag"], "synset")
        return F.transform(
            F.filter(
                F.transform(
                    both,
                    lambda t, i: F.struct(t["tok"].alias("tok"), letter(t).alias("letter"), i.alias("i")),
                ),
                lambda t: t["letter"] != "",
            ),
            lambda t: key(t["tok"], F.concat_ws(".", bare(t["tok"]), t["letter"]), t["i"]),
        )

    def tagged_key(t: Column, i: Column) -> Column:
        gram = tag_key(t["tok"], t["tag"], form)
        return key(gram, bare(gram)) if form == "dot" else key(t["tok"], bare(gram), i)

    keys = F.transform(both, tagged_key)
    if rest[0] != "alone":
        if "bigram_tags" not in docs.columns:
            raise ValueError("bigrams of a tagged lexicon need the tags of the bigrams")
        pairs = F.arrays_zip(
            T.ngram_array(toks, 2, rest[0].removeprefix("pairs")).alias("tok"),
            F.col("bigram_tags").alias("tag"),
        )
        pairs = F.filter(pairs, lambda t: t["tok"].isNotNull())
        keys = F.concat(keys, F.transform(pairs, lambda t, i: tagged_key(t, F.size(toks) + i)))
    return F.array_distinct(keys) if form == "dot" else keys


def look_up_keys(
    docs: DataFrame, kinds: Iterable[str], *keep: str, distinct: bool = False,
    begins: Mapping[str, C.Begins] | None = None,
) -> DataFrame:
    """doc_id, look_up, gram, term, place of every kind of key, from one scan of the messages.

    ``begins`` has tests by kind (see ``_begins``), whose failures are left out. ``distinct`` is doc_id, look_up, term, each once per message: repeats go inside the row,
    and only messages of several rows are shuffled for it.
    """
    kinds = sorted(set(kinds))
    if distinct:
        once, again = runtime.split_repeated(docs)
        rows = once.withColumn("negated", T.negate_tokens(F.col("toks"), "prefix"))
        sets = [
            F.struct(
                F.lit(kind).alias("look_up"),
                F.array_distinct(F.transform(_keys(kind, once), lambda k: k["term"])).alias("terms"),
            )
            for kind in kinds
        ]
        cells = rows.select("doc_id", *keep, F.explode(F.array(*sets)).alias("s")).select(
            "doc_id", *keep, F.col("s.look_up").alias("look_up"), F.explode("s.terms").alias("term")
        )
        if again is None:
            return cells
        several = look_up_keys(again, kinds, *keep).select("doc_id", *keep, "look_up", "term")
        return cells.unionByName(several.distinct())
    rows = docs.withColumn("negated", T.negate_tokens(F.col("toks"), "prefix"))
    sets = [
        F.struct(F.lit(kind).alias("look_up"), _keys(kind, docs, begins).alias("keys"))
        for kind in kinds
    ]
    return rows.select("doc_id", *keep, F.explode(F.array(*sets)).alias("s")).select(
        "doc_id", *keep, F.col("s.look_up").alias("look_up"), F.inline("s.keys")
    )


def match_specs(
    docs: DataFrame,
    lexicon: DataFrame,
    specs: Sequence[LexiconSpec],
    senses: DataFrame | None = None,
) -> DataFrame:
    """doc_id, lexicon, gram, place, dim, value: stored matches of lexicons of all families.

    One scan of ``docs`` (doc_id, toks, and tags where a family needs them) yields the keys of
    every kind, and one join looks them up in all lexicons and in the table of senses.
    """
    spark = docs.sparkSession
    asked_for = [(s.name, look_up) for s in specs for look_up in look_ups(s)]
    asked = F.broadcast(runtime.local_table(spark, asked_for, "lexicon string, look_up string"))
    table = effective(lexicon).where(F.col("lexicon").isin([s.name for s in specs if not s.senses]))
    for s in specs:
        if s.dims:
            table = table.where((F.col("lexicon") != s.name) | F.col("dim").isin(list(s.dims)))
    table = table.select("lexicon", "term", "dim", "value")
    for s in specs:
        if s.senses:
            if senses is None:
                raise ValueError(f"{s.name} needs a table of senses")
            cells = [F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in SENSE_DIMS]
            rows = sense_scores(senses, s.senses).select(
                F.lit(s.name).alias("lexicon"),
                F.concat_ws(".", "word", "letter").alias("term"),
                F.inline(F.array(*cells)),
            )
            table = table.unionByName(rows)
    table = runtime.small_side(table.join(asked, "lexicon"))
    kinds = {look_up for _, look_up in asked_for}
    simple = [k for s in specs if s.family not in ("synset", "tagged") for k in look_ups(s)]
    rows = table.select(F.col("look_up").alias("form"), "term")
    begins = _begins(rows, "term", set(simple), bare, lambda k: k.split("|")[1])
    keys = look_up_keys(docs, kinds, begins=begins)
    turned = F.col("gram").contains(P.NEGATION_PREFIX)
    other = F.when(F.col("dim") == "pos_score", "neg_score").when(F.col("dim") == "neg_score", "pos_score")
    by_sense = F.col("look_up").endswith(SENSE_FORM)
    hits = keys.join(table, ["look_up", "term"]).select(
        "doc_id",
        "lexicon",
        "gram",
        "place",
        F.when(turned & by_sense, F.coalesce(other, "dim")).otherwise(F.col("dim")).alias("dim"),
        F.when(turned & (F.col("dim") == POLARITY), -F.col("value")).otherwise(F.col("value")).alias("value"),
    )
    return runtime.materialize(hits, "matches")


def lexicon_features(
    docs: DataFrame,
    lexicon: DataFrame,
    specs: Sequence[LexiconSpec],
    tagged: DataFrame | None = None,
    senses: DataFrame | None = None,
) -> DataFrame:
    """Long features of many lexicons, one block each, as their specs ask.

    The messages are read once, for the matches of all families: opinion and emotion lexicons
    over grams, lexicons keyed by tag, and lexicons of senses. Tags come as the column
    ``tags`` of ``docs`` (``bigram_tags`` for pairs) or as rows of ``tagged``. Lexicons that
    respect negation see the negated tokens. What a family does not have is an error.
    """
    for spec in specs:
        spec.wanted()
    lists = docs.select("doc_id", *[c for c in ("toks", "tags", "bigram_tags") if c in docs.columns])
    if tagged is not None and "tags" not in docs.columns:
        lists = with_tags(lists, tagged)
    matches = match_specs(lists, lexicon, specs, senses)

    def of(own: Sequence[LexiconSpec]) -> DataFrame:
        return matches.where(F.col("lexicon").isin([s.name for s in own]))

    parts = []
    plain = [s for s in specs if s.family in ("opinion", "emotion")]
    if plain:
        hits = of(plain)
        if any(len(s.forms()) > 1 for s in plain):  # a gram may stand in several forms
            hits = hits.dropDuplicates(["doc_id", "lexicon", "gram", "dim"])
        parts += _stat_blocks(hits, docs, plain)
    for scheme in ("dot", "hash"):
        own = [s for s in specs if s.family == "tagged" and s.tag_scheme == scheme]
        if own:
            hits = of(own) if scheme == "dot" else _last_entries(of(own))
            parts += _stat_blocks(hits, docs, own, positive_only=True)
    for spec in (s for s in specs if s.family == "synset"):
        cells = [F.max(F.when(F.col("dim") == c, F.col("value"))).alias(c) for c in SENSE_DIMS]
        tokens = of([spec]).groupBy("doc_id", F.col("place").alias("pos"), F.col("gram").alias("tok"))
        scores = runtime.materialize(tokens.agg(*cells), "senses")
        parts.append(_synset_block(scores, docs, spec))
        if spec.terms:
            rows = synset_terms(scores).withColumn("block", F.lit(spec.name))
            parts.append(rows.select("doc_id", "block", "name", "value"))
    return union_all(parts)


def _synset_block(scores: DataFrame, docs: DataFrame, spec: LexiconSpec) -> DataFrame:
    stats = synset_features(scores, docs, spec.thresh).withColumn("lexicon", F.lit(spec.name))
    cells = [
        F.struct(
            F.lit(f"{spec.name}_{name}").alias("name"), F.col(c).cast("double").alias("value")
        )
        for key in spec.wanted()
        for c, name in SYNSET_STATS[key].items()
    ]
    return _named(stats, F.array(*cells))


def _stat_blocks(
    matches: DataFrame, docs: DataFrame, specs: Sequence[LexiconSpec], positive_only: bool = False
) -> list[DataFrame]:
    parts = []
    opinion = [s for s in specs if s.opinion]
    if opinion:
        stats = opinion_features(matches, docs, [s.name for s in opinion])
        wanted = F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(key).alias("key"),
                        F.concat_ws("_", F.col("lexicon"), F.lit(c)).alias("name"),
                        F.col(c).cast("double").alias("value"),
                    )
                    for key, cols in OPINION_STATS.items()
                    for c in cols
                ]
            ),
            lambda s: _asked(opinion, s["key"]),
        )
        parts.append(_named(stats, wanted))
    emotion = [s for s in specs if not s.opinion]
    if emotion:
        stats = emotion_features(matches, positive_only)
        stats = stats.where(F.col("lexicon").isin([s.name for s in emotion]))
        wanted = F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(key).alias("key"),
                        F.concat_ws("_", F.col("lexicon"), F.col("dim"), F.lit(suffix)).alias("name"),
                        F.col("count" if key == "amounts" else key).cast("double").alias("value"),
                    )
                    for key, suffix in EMOTION_STATS.items()
                ]
            ),
            lambda s: _asked(emotion, s["key"]),
        )
        parts.append(_named(stats, wanted))
    terms = [s.name for s in specs if s.terms]
    if terms:
        found = matches.where(F.col("lexicon").isin(terms))
        rows = found.select("doc_id", F.col("lexicon").alias("block"), "lexicon", "gram", "dim", "value")
        name = F.when(F.col("dim") == POLARITY, F.concat_ws("_", "lexicon", "gram")).otherwise(
            F.concat_ws("_", "lexicon", "gram", "dim")
        )
        parts.append(rows.select("doc_id", "block", name.alias("name"), "value"))
    return parts


def _asked(specs: Sequence[LexiconSpec], key: Column) -> Column:
    test = F.lit(False)
    for s in specs:
        test = test | ((F.col("lexicon") == s.name) & key.isin(list(s.wanted())))
    return test


def _named(stats: DataFrame, cells: Column) -> DataFrame:
    rows = stats.select("doc_id", F.col("lexicon").alias("block"), F.inline(cells))
    return rows.select("doc_id", "block", "name", "value")


def inline_lexicon(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A lexicon from literal rows (lexicon, term, dim, value)."""
    schema = "lexicon string, term string, dim string, value double"
    return runtime.local_table(spark, rows, schema)
