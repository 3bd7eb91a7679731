"""Column functions over message text and token arrays.

A message is one row, its token list one ``array<string>`` column. All functions
here map columns to columns inside the row, so token work needs no shuffle at
any corpus size; only what is counted or matched afterwards moves.
"""

from __future__ import annotations

import html.entities
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodmill.functions import patterns as P

NO_TOKENS = "array<string>"


def _empty() -> Column:
    return F.array().cast(NO_TOKENS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


# ---------------------------------------------------------------- raw text


def unescape_basic(text: Column) -> Column:
    """Undo the common named entities; the ampersand goes last, so nothing is undone twice."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), P.BASIC_ENTITIES, text)


def _entity_table() -> Column:
    names = dict(html.entities.name2codepoint, apos=ord("'"))
    pairs = [F.lit(x) for name in sorted(names) for x in (f"&{name};", chr(names[name]))]
    return F.create_map(*pairs)


def _numeric_entity(piece: Column) -> Column:
    hexa = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
    deci = F.regexp_extract(piece, r"^&#([0-9]{1,7});$", 1)
    digits = F.when(hexa != "", hexa).when(deci != "", F.hex(deci.cast("long")))
    code = F.conv(digits, 16, 10).cast("long")
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))


def unescape_html(text: Column) -> Column:
    """Undo every named (HTML 4) and numeric entity in one pass; unknown ones stay."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{P.ENTITY_TOKEN}|[^&]+|&"), F.lit(0))
    table = _entity_table()
    undone = F.transform(
        pieces,
        lambda p: F.when(
            p.startswith("&") & (F.length(p) > 1),
            F.coalesce(F.try_element_at(table, p), _numeric_entity(p), p),
        ).otherwise(p),
    )
    return F.when(text.contains("&"), F.array_join(undone, "")).otherwise(text)


def squeeze_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, P.WHITESPACE, " "))


def split_edge_punct(text: Column) -> Column:
    left = F.regexp_replace(text, P.EDGE_LEFT, "$1$2 $3")
    return F.regexp_replace(left, P.EDGE_RIGHT, "$1 $2$3")


# ---------------------------------------------------------------- tokenizers


def tokens_space(text: Column) -> Column:
    return F.split(text, " ")


def tokens_word(text: Column) -> Column:
    """Lowercased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(P.WORD_TOKEN), F.lit(0))


def tokens_informal(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.INFORMAL_TOKEN), F.lit(0))


def tokens_formal(text: Column) -> Column:
    spaced = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in P.FORMAL_STEPS:
        spaced = F.regexp_replace(spaced, pattern, replacement)
    return F.filter(F.split(F.trim(spaced), r"\s+"), lambda t: t != "")


def tokens_social(text: Column, protected: str) -> Column:
    """Keep protected spans whole and split the rest on spaces.

    No protected span has an inner space, and a space and an edge of the text mean the
    same to the pattern except before an abbreviation. So each word is looked at by
    itself, with the space before it, and words of letters, digits and a few signs, in
    which nothing can be protected, are not looked at at all. Words of letters and end
    marks, most of the others, are cut before their marks.
    """
    plain = squeeze_whitespace(unescape_html(F.replace(text, F.lit("&amp;"), F.lit("&"))))

    def cut(word: Column, i: Column) -> Column:
        placed = F.when(i > 0, F.concat(F.lit(" "), word)).otherwise(word)
        spaced = F.regexp_replace(placed, protected, " $0 ")
        ended = F.split(word, f"(?={P.END_MARKS})", 2)
        return (
            F.when(word.rlike(P.UNMARKED_WORD), F.array(word))
            .when(word.rlike(P.ENDED_WORD), ended)
            .otherwise(F.split(spaced, " +"))
        )

    words = F.flatten(F.transform(F.split(split_edge_punct(plain), " "), cut))
    return F.filter(words, lambda t: t != "")


# ---------------------------------------------------------------- token rewriting


def lower_tokens(toks: Column) -> Column:
    return F.transform(toks, F.lower)


def split_contractions(toks: Column) -> Column:
    return F.flatten(
        F.transform(
            toks,
            lambda t: F.when(
                t.rlike("(?U)" + P.CONTRACTION),
                F.array(
                    F.regexp_replace(t, "(?U)" + P.CONTRACTION, "$1"),
                    F.regexp_extract(t, "(?U)" + P.CONTRACTION, 2),
                ),
            ).otherwise(F.array(t)),
        )
    )


def _replace_tokens(toks: Column, test: Callable[[Column], Column], mark: str) -> Column:
    return F.transform(toks, lambda t: F.when(test(t), F.lit(mark)).otherwise(t))


def mark_mentions(toks: Column) -> Column:
    return _replace_tokens(toks, lambda t: t.startswith("@"), "@MENTION")


def mark_hashtags(toks: Column) -> Column:
    return _replace_tokens(toks, lambda t: t.startswith("#"), "#HASH")


def mark_urls(toks: Column) -> Column:
    return _replace_tokens(toks, lambda t: t.startswith("http"), "HTTP")


def mark_numbers(toks: Column) -> Column:
    return _replace_tokens(toks, lambda t: t.rlike(P.NUMBER), "NUMBER")


def drop_stops(toks: Column, stops: Sequence[str]) -> Column:
    words = list(stops)
    return F.filter(toks, lambda t: ~t.isin(words))


# ---------------------------------------------------------------- negation


def opens_negation(tok: Column) -> Column:
    low = F.lower(tok)
    return low.isin(list(P.NEGATION_WORDS)) | low.contains(P.NEGATION_PART)


def closes_negation(tok: Column) -> Column:
    return tok.rlike(P.NEGATION_CLOSE)


def _negation_cuts(toks: Column) -> Column:
    """Positions where the negation state changes, after a start marker at -1."""
    seen = F.transform(
        toks,
        lambda t, i: F.struct(
            i.alias("at"),
            F.when(opens_negation(t), F.lit(True))
            .when(closes_negation(t), F.lit(False))
            .alias("open"),
        ),
    )
    start = F.array(F.struct(F.lit(-1).alias("at"), F.lit(False).alias("open")))
    return F.concat(start, F.filter(seen, lambda s: s["open"].isNotNull()))


def negate_tokens(toks: Column, style: str = "prefix") -> Column:
    """Mark the tokens in negation scope.

    A scope runs from a negation word to a token of closing punctuation. ``prefix``
    writes ``NEG_`` before the words inside, and leaves negation words and the
    punctuation alone. ``suffix`` writes ``_NEG`` after everything that follows the
    first negation word, later ones and the closing mark included.

    The list is cut at the state changes and each piece marked as a whole, which
    stays linear in the length of the message.
    """
    if style not in ("prefix", "suffix"):
        raise ValueError(f"unknown negation style {style!r}")

    def mark(part: Column) -> Column:
        if style == "prefix":
            return F.transform(part, lambda t: F.concat(F.lit(P.NEGATION_PREFIX), t))
        return F.transform(part, lambda t: F.concat(t, F.lit(P.NEGATION_SUFFIX)))

    def piece(ts: Column, cuts: Column, cut: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(cuts, k + 1)["at"], F.size(ts))
        head = F.slice(ts, F.greatest(cut["at"] + 1, F.lit(1)), F.when(k > 0, 1).otherwise(0))
        if style == "suffix":
            was_open = (k > 0) & F.coalesce(F.get(cuts, k - 1)["open"], F.lit(False))
            head = F.when(was_open, mark(head)).otherwise(head)
        body = F.slice(ts, cut["at"] + 2, stop - cut["at"] - 1)
        return F.concat(head, F.when(cut["open"], mark(body)).otherwise(body))

    return let(
        toks,
        lambda ts: let(
            _negation_cuts(ts),
            lambda cuts: F.flatten(F.transform(cuts, lambda c, k: piece(ts, cuts, c, k))),
        ),
    )


# ---------------------------------------------------------------- n-grams


def _windows(toks: Column, n: int, build: Callable[[Column], Column], kind: str) -> Column:
    return let(
        toks,
        lambda ts: F.when(
            F.size(ts) >= n,
            F.transform(
                F.sequence(F.lit(1), F.size(ts) - (n - 1)),
                lambda i: build(F.slice(ts, i, F.lit(n))),
            ),
        ).otherwise(F.array().cast(kind)),
    )


def ngram_array(toks: Column, n: int, joiner: str = " ") -> Column:
    return _windows(toks, n, lambda w: F.array_join(w, joiner), NO_TOKENS)


def ngrams_from(
    toks: Column, n: int, joiner: str, begins: Callable[[Column], Column]
) -> Column:
    """The n-grams whose first word passes a test; only those are built."""

    def grams(ts: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ts) - n)
        starts = F.filter(places, lambda i: begins(F.get(ts, i)))
        return F.transform(starts, lambda i: F.array_join(F.slice(ts, i + 1, F.lit(n)), joiner))

    return let(toks, lambda ts: F.when(F.size(ts) >= n, grams(ts)).otherwise(_empty()))


def gapped_array(
    toks: Column, mark: str = "---", begins: Callable[[Column, Column], Column] | None = None
) -> Column:
    """Every 4-gram and 3-gram with each position replaced in turn by a glued mark.

    With ``begins``, a test of the first and the second word, grams that fail it may be left
    out before they are built.

    The words are always joined by one space, and the spaces around the mark go. The
    glue also takes the spaces next to a word that itself begins or ends with the mark,
    which needs a search in the joined text; messages without such a word skip it.
    """
    gap = F.lit(mark)

    def searched(ts: Column, start: Column, n: int, hole: int) -> Column:
        words = [gap if j == hole else F.get(ts, start + j) for j in range(n)]
        text = F.replace(F.concat_ws(" ", *words), F.lit(mark + " "), gap)
        return F.replace(text, F.lit(" " + mark), gap)

    def direct(ts: Column, start: Column, n: int, hole: int) -> Column:
        parts: list[Column] = []
        for j in range(n):
            if j == hole:
                parts.append(gap)
            else:
                parts += [F.lit(" ")] if j and hole != j - 1 else []
                parts.append(F.get(ts, start + j))
        return F.concat(*parts)

    def at(
        ts: Column, places: Column, n: int, form: Callable[[Column, Column, int, int], Column]
    ) -> Column:
        return F.flatten(
            F.transform(places, lambda i: F.array(*[form(ts, i, n, hole) for hole in range(n)]))
        )

    def gaps(ts: Column, n: int, form: Callable[[Column, Column, int, int], Column]) -> Column:
        rows = at(ts, F.sequence(F.lit(0), F.size(ts) - n), n, form)
        return F.when(F.size(ts) >= n, rows).otherwise(_empty())

    def chosen(ts: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(ts) - 3),
            lambda i: begins(F.get(ts, i), F.get(ts, i + 1)),
        )

        def grams(starts: Column) -> Column:
            longer = F.filter(starts, lambda i: i <= F.size(ts) - 4)
            return F.concat(at(ts, longer, 4, direct), at(ts, starts, 3, direct))

        return F.when(F.size(ts) >= 3, let(places, grams)).otherwise(_empty())

    def build(ts: Column) -> Column:
        odd = F.exists(ts, lambda t: t.startswith(mark) | t.endswith(mark))
        forms = [F.concat(gaps(ts, 4, f), gaps(ts, 3, f)) for f in (searched, direct)]
        if begins is None:
            return F.when(odd, forms[0]).otherwise(forms[1])
        empty = F.exists(ts, lambda t: t.isNull())  # has grams of its own
        return F.when(odd, forms[0]).when(empty, forms[1]).otherwise(chosen(ts))

    return let(toks, build)


def char_ngram_array(text: Column, n: int) -> Column:
    """All runs of n characters: look n ahead from every character, then step over it."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


# ---------------------------------------------------------------- token tests and counts


def is_caps(tok: Column) -> Column:
    return tok.rlike(P.CAPS_HAS_UPPER) & ~tok.rlike(P.CAPS_HAS_LOWER)


def count_where(toks: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(toks, test))


def happy_face(tok: Column) -> Column:
    return tok.rlike(P.HAPPY_FACE)


def sad_face(tok: Column) -> Column:
    return tok.rlike(P.SAD_FACE)


def term_runs(toks: Column) -> Column:
    """Distinct terms of one message with their counts, from one sort inside the row."""

    def runs(ts: Column) -> Column:
        size = F.size(ts)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(ts, i) != F.get(ts, i - 1)),
        )
        return let(
            starts,
            lambda ss: F.transform(
                ss,
                lambda s, k: F.struct(
                    F.get(ts, s).alias("term"),
                    (F.coalesce(F.get(ss, k + 1), size) - s).cast("long").alias("n"),
                ),
            ),
        )

    none = F.array().cast("array<struct<term:string,n:bigint>>")
    return let(
        F.sort_array(toks), lambda ts: F.when(F.size(ts) > 0, runs(ts)).otherwise(none)
    )


# ---------------------------------------------------------------- labels, tags, keys


def encode_label(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in P.LABEL_CODES.items() for x in kv])
    return F.try_element_at(table, label)


def decode_label(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in P.LABEL_NAMES.items() for x in kv])
    return F.try_element_at(table, code.cast("int"))


def map_tag(tag: Column, scheme: str) -> Column:
    """Penn tag to a synset letter (``synset``) or a lexicon word (``word``); '' if neither."""
    if scheme not in ("synset", "word"):
        raise ValueError(f"unknown tag scheme {scheme!r}")
    out = F.when(F.lit(False), F.lit(""))
    for group, tags in P.PENN_GROUPS.items():
        name = P.SYNSET_LETTERS[group] if scheme == "synset" else group.upper()
        out = out.when(tag.isin(list(tags)), F.lit(name))
    return out.otherwise(F.lit(""))


def _safe_key(key: Column) -> Column:
    odd = key.startswith("$") | key.contains(".")
    return F.when(odd, F.concat(F.lit("_"), F.replace(key, F.lit("."), F.lit("PP")))).otherwise(key)


def sanitize_keys(value: Column, depth: int = 1) -> Column:
    """Rewrite map keys that a document store refuses, down ``depth`` levels of maps."""
    out = F.transform_keys(value, lambda k, _: _safe_key(k))
    if depth > 1:
        out = F.transform_values(out, lambda _, v: sanitize_keys(v, depth - 1))
    return out


def fold_ascii(text: Column) -> Column:
    """Latin letters without their accents, typographic marks as ASCII, the rest as it is."""
    accented = (
        "àáâãäåçèéêëìíîï"
        "ñòóôõöùúûüýÿ"
        "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏ"
        "ÑÒÓÔÕÖÙÚÛÜÝ"
        "‘’“”– "
    )
    plain = (
        "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY" "''\"\"- "
    )
    out = F.translate(text, accented, plain)
    for mark, words in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("…", "..."),
                        ("—", "--")):
        out = F.replace(out, F.lit(mark), F.lit(words))
    return out
