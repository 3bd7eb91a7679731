"""Goldens of the token-level functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from moodmill.config import BlockSpec, CleanSpec
from moodmill.functions import social
from moodmill.functions import text as T
from moodmill.operators import corpus as C


def one(spark, text, column):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return df.select(column(F.col("text")).alias("x")).first()["x"]


def toks(spark, text, change):
    return one(spark, text, lambda c: change(T.tokens_space(c)))


@pytest.fixture(scope="module")
def protected(spark):
    return social.protected_pattern()


SENTENCE = "This is a TEST tweet #hashtext @mention http://www.testurl.com $89.99 :) >:("


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (SENTENCE, SENTENCE.split(" ")),
        ("it's (hello) \"there\"", ["it's", "(", "hello", ")", '"', "there", '"']),
        ("U.S.A. won 1,000,000 at 12:30", ["U.S.A.", "won", "1,000,000", "at", "12:30"]),
        ("a&amp;lt;b <3 o.O ^_^ x=3", ["a", "<", "b", "<3", "o.O", "^_^", "x", "=3"]),
        ("mail me@x.org!! wait...", ["mail", "me@x.org", "!!", "wait", "..."]),
        ("  spaced\tout\n", ["spaced", "out"]),
        ("", []),
    ],
)
def test_social_tokens(spark, protected, text, expected):
    assert one(spark, text, lambda c: T.tokens_social(c, protected)) == expected


def test_social_words_alone_equal_the_whole_text(spark, protected):
    from moodmill.plans import common as K

    def whole(text):
        plain = T.unescape_html(F.replace(text, F.lit("&amp;"), F.lit("&")))
        spaced = F.regexp_replace(
            T.split_edge_punct(T.squeeze_whitespace(plain)), protected, " $0 "
        )
        return F.filter(F.split(spaced, " +"), lambda t: t != "")

    for table in (K.documents, K.pages):
        df = table(spark, "/root/testdata/sf0.001")
        both = df.select(T.tokens_social(F.col("text"), protected).alias("a"), whole(F.col("text")).alias("b"))
        assert both.where("a <> b").count() == 0


def test_informal_and_formal_tokens(spark):
    assert one(spark, "no way... :-D don't @me #tag", T.tokens_informal) == [
        "no", "way", "...", ":-D", "don't", "@me", "#tag",
    ]
    assert one(spark, 'He said "can\'t", ok.', T.tokens_formal) == [
        "He", "said", "``", "ca", "n't", "''", ",", "ok", ".",
    ]


def test_unescape(spark):
    text = "&eacute;&#233;&#xE9; &amp;lt; &bogus; &#128512; a & b"
    assert one(spark, text, T.unescape_html) == "ééé &lt; &bogus; 😀 a & b"


@pytest.mark.parametrize(
    ("text", "prefix", "suffix"),
    [
        (
            "i never know me : i know something",
            "i never NEG_know NEG_me : i know something",
            "i never know_NEG me_NEG :_NEG i know something",
        ),
        ("a no b not c . d", "a no NEG_b not NEG_c . d", "a no b_NEG not_NEG c_NEG ._NEG d"),
        ("don't go", "don't NEG_go", "don't go_NEG"),
        ("plain words", "plain words", "plain words"),
        ("no", "no", "no"),
    ],
)
def test_negation(spark, text, prefix, suffix):
    assert toks(spark, text, lambda t: T.negate_tokens(t, "prefix")) == prefix.split(" ")
    assert toks(spark, text, lambda t: T.negate_tokens(t, "suffix")) == suffix.split(" ")


def test_gapped_grams(spark):
    assert toks(spark, "a b c", T.gapped_array) == ["---b c", "a---c", "a b---"]
    assert toks(spark, "a b c", lambda t: T.gapped_array(t, "-")) == ["-b c", "a-c", "a b-"]
    # the glue also takes the spaces of a word that is the mark
    assert toks(spark, "a - c", lambda t: T.gapped_array(t, "-")) == ["--c", "a-c", "a--"]
    assert len(toks(spark, " ".join("abcdefghijklmn"), T.gapped_array)) == 80


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7])
def test_gapped_count(spark, n):
    words = F.array(*[F.lit(f"w{i}") for i in range(n)]).cast("array<string>")
    got = spark.range(1).select(F.size(T.gapped_array(words)).alias("n")).first()["n"]
    assert got == 4 * max(n - 3, 0) + 3 * max(n - 2, 0)


def test_grams(spark):
    assert toks(spark, "a b c", lambda t: T.ngram_array(t, 2, "_")) == ["a_b", "b_c"]
    assert toks(spark, "a", lambda t: T.ngram_array(t, 2)) == []
    assert one(spark, "a😀bc", lambda c: T.char_ngram_array(c, 3)) == ["a😀b", "😀bc"]


def test_term_runs(spark):
    assert [tuple(r) for r in toks(spark, "b a b", T.term_runs)] == [("a", 1), ("b", 2)]


def test_contractions(spark):
    got = toks(spark, "don't John's they’ll x", T.split_contractions)
    assert got == ["do", "n't", "John", "'s", "they", "’ll", "x"]


@pytest.mark.parametrize("text", ["1", "-1.5", ".5", "5.", "1e5", "nan", "-inf", "Infinity"])
def test_numbers(spark, text):
    assert toks(spark, text, T.mark_numbers) == ["NUMBER"]


@pytest.mark.parametrize("text", ["1d", "1,000", "e5", "$5", "1.2.3", "infinite"])
def test_not_numbers(spark, text):
    assert toks(spark, text, T.mark_numbers) == [text]


def test_emoticons(spark):
    rows = [(1, "hi :)"), (2, "oh :("), (3, "at 10:30 http://x"), (4, ":) ok")]
    docs = C.tokenize(spark.createDataFrame(rows, "doc_id long, text string"), "space")
    flags = {r["doc_id"]: r for r in C.emoticon_flags(docs).collect()}
    assert (flags[1]["has_happy"], flags[1]["last_face"]) == (True, 1)
    assert (flags[2]["has_sad"], flags[2]["last_face"]) == (True, -1)
    assert not flags[3]["has_happy"] and not flags[3]["has_sad"]
    assert flags[4]["has_happy"] and flags[4]["last_face"] == 0


def test_clean_orders(spark):
    df = spark.createDataFrame([(1, "The cat no @me at 5 http://x")], "doc_id long, text string")
    spec = CleanSpec(tokenizer="space")
    assert C.clean(df, spec).first()["toks"] == ["cat", "no", "@MENTION", "NUMBER", "HTTP"]
    first = C.clean(df, CleanSpec(tokenizer="space", stops_first=True)).first()
    assert first["cleaned"] == "the cat no @MENTION NUMBER HTTP"
    negated = C.clean(df, CleanSpec(tokenizer="space", negate="prefix")).first()["toks"]
    assert negated == ["cat", "no", "NEG_@me", "NEG_at", "NEG_5", "NEG_http://x"]


def test_sanitize_keys(spark):
    got = spark.sql("SELECT map('a.b', 1, '$c', 2) AS m").select(T.sanitize_keys(F.col("m")))
    assert got.first()[0] == {"_aPPb": 1, "_$c": 2}


def test_errors(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        C.tokenize(df, "other")
    with pytest.raises(ValueError):
        T.negate_tokens(F.col("toks"), "other")


def test_surface_blocks_read_the_messages_once(spark):
    rows = [(1, "@you NOT sooo good !!! :)"), (2, ""), (3, None)]
    messages = spark.createDataFrame(rows, "doc_id long, text string")
    spec = BlockSpec(ngrams=False, char_ngrams=False, clusters=False)
    found = C.feature_blocks(messages, spec)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    got = {(r["doc_id"], r["block"], r["name"]): r["value"] for r in found.collect()}
    assert got[1, "SURFACE", "NR_MENTIONS"] == 1 and got[1, "ELONGATED", "FLG_ELONGATED"] == 1
    assert got[1, "EMOTICON", "EMOT_POS"] == 1 and got[1, "EMOTICON", "EMOT_LAST"] == 1
    # without a token there is no row of the blocks that need one
    assert {b for d, b, _ in got if d != 1} == {"NEGATION", "SURFACE", "ELONGATED"}


def test_gram_counts_make_grams_once_and_sort_no_message(spark):
    rows = spark.createDataFrame([(1, "abcab"), (2, "ab"), (3, ""), (4, None), (4, "cab")], "doc_id long, text string")
    counts = C.gram_counts(C.char_ngrams(rows, 2))
    assert {r["gram"]: r["n"] for r in counts.collect()} == {"ab": 4, "bc": 1, "ca": 2}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan and plan.count("regexp_extract_all(") == 1


def test_ended_words_are_cut_without_the_large_pattern(spark, protected):
    """Words of letters and end marks, and of signs that nothing protected is made of."""
    never = f"(?:{protected})(?!)"  # a pattern that protects nothing
    text = "word. Été, yes?! END!!… no|way 9% an$$$ *** && on"
    expected = ["word", ".", "Été", ",", "yes", "?!", "END", "!!…", "no|way", "9%", "an$$$", "***", "&&", "on"]
    assert one(spark, text, lambda c: T.tokens_social(c, never)) == expected
    assert one(spark, text, lambda c: T.tokens_social(c, protected)) == expected
    # abbreviations and the head of a link keep their dot
    kept = "Mr. www. Rep. a.b. st, www, Mr? x."
    tokens = ["Mr.", "www.", "Rep.", "a.b.", "st", ",", "www", ",", "Mr", "?", "x", "."]
    assert one(spark, kept, lambda c: T.tokens_social(c, protected)) == tokens
