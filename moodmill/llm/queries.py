"""One query per operator over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from moodmill.llm import (
    decontaminate,
    divergence,
    fingerprints,
    jaccard_join,
    language_id,
    lexical_search,
    packing,
    quality,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    token_counts,
    warc,
)
from moodmill.llm.common import table
from moodmill.runtime import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, through a cache that starts empty."""
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("piece_bpe_32k.model"),
        scratch_path(spark, "token-cache"),
    )


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary pieces of every document, each a sequence of its own length."""
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose word shingles overlap by 75 per cent."""
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base patterns and assignment-aware literals of every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every document, of its edited text and of the next document."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings that come earlier."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, normalised to a member per record and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without word runs of earlier documents."""
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in every document."""
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the other sources and from its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op6_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
    array_to_string(w[i : i + 12], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
        FROM item WHERE len(w) > 0)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
found AS (
  SELECT p.doc_id, p.i, q.n, q.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
        FROM places, (SELECT DISTINCT n FROM wanted) WHERE i + n - 1 <= len(w)) p
  JOIN wanted q ON q.phrase = p.phrase AND q.n = p.n),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM found))
  GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h
  FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM q
"""

ORACLES["op5_substring_dedup"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc)),
gone AS (
  SELECT doc_id, i FROM win JOIN (SELECT phrase, min(doc_id) AS first FROM win GROUP BY phrase)
    USING (phrase) WHERE first < doc_id),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM gone),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM doc),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM words ANTI JOIN hit USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

ORACLES["op3_jaccard_join"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc
        WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT c.a, c.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
    FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) c
  JOIN size p ON p.doc_id = c.a JOIN size q ON q.doc_id = c.b
  WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM doc LEFT JOIN size USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

ORACLES["op12_source_divergence"] = r"""
WITH doc AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r
  FROM documents),
word AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
grp AS (SELECT DISTINCT lang, source FROM doc),
seen AS (SELECT lang, source, term, count(*) AS c FROM word JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (
  SELECT grp.lang, grp.source, term, coalesce(c, 0) AS c
  FROM grp JOIN kept USING (lang) LEFT JOIN seen USING (lang, source, term)),
p AS (
  SELECT *, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 1))
      // (sum(c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p
  FROM cell),
q AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 1))
      // (sum(c) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM cell GROUP BY lang, term)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS v
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES["op13_lexical_search"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
size AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM doc WHERE len(w) > 0),
asked AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(w) AS term FROM item) GROUP BY ALL),
post AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
impact AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)) AS g
  FROM post, size),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM post GROUP BY term), size),
score AS (
  SELECT i, r, doc_id, CAST(sum(times * w * g) AS BIGINT) AS score
  FROM asked JOIN impact USING (term) JOIN weight USING (term) GROUP BY ALL),
ranked AS (
  SELECT i, doc_id, score,
    CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN item USING (i) WHERE rank <= 20
"""
