"""Secret scans that read assignments.

Three fixed patterns find the base spans. Beside them, source and configuration text is read into pairs of a name and its literals; a name that was given literals passes
them on when it is assigned to another name; a literal is reported when a name it reached
is a sensitive one and the literal looks like a secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import texts

# Fixed values of the scan's contract.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex", "literal")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of names that speak for a secret, and their weight.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3,
    "apikey": 3, "credential": 3, "credentials": 3, "privatekey": 3, "accesskey": 3,
    "secretkey": 3, "authkey": 3, "bearer": 2, "auth": 2, "signature": 1, "salt": 1, "key": 1,
}
#: Least score of a literal: weight of its name plus its bits per character.
LEAST_SCORE = 5.0
LEAST_CHARS = 8

NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
STRING = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
#: Letters and signs that may stand before a string.
PREFIX = r"(?:[fFbBrRuULcC]{1,2}8?|[@$]{1,2})"
#: Brackets of a type, one inside another at most.
BRACKETS = r"(?:\[[^\[\]\n=]*(?:\[[^\[\]\n=]*\][^\[\]\n=]*)*\]|<[^<>\n=]*(?:<[^<>\n=]*>[^<>\n=]*)*>)"
TYPE = rf"[&*]?{NAME}{BRACKETS}?\??(?:[^\S\n]*+\|[^\S\n]*+{NAME}{BRACKETS}?)*"
#: All stands on one line, but a string may begin, or be added, on a later one; a quoted key
#: there is no value.
PAIR = re.compile(
    rf"(?<![A-Za-z0-9_.\-])(?P<quote>[\"']?)(?P<name>{NAME})(?P=quote)(?:(?<=[\"'])[^\S\n]*+\])?"
    rf"(?:[^\S\n]*+:[^\S\n]*+{TYPE})?[^\S\n]*+(?::=|=>|=(?!=)|:(?![/:]))[^\S\n]*+"
    rf"(?:\\?[^\S\n]*+\n\s*+(?={PREFIX}?{STRING}(?!\s*+[:=\]])))?(?:{PREFIX}(?=[\"']))?"
    rf"(?P<value>{STRING}|[^\s,;\"'#(){{}}\[\]]+)"
    rf"(?P<more>(?:[^\S\n]*+[+.][^\S\n]*+(?:{PREFIX}?{STRING}|{NAME})"
    rf"|\s*+\+\s*+{PREFIX}?{STRING}(?!\s*+[:=\]]))*)"
)
TERM = re.compile(rf"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|({NAME})")
BARE = re.compile(r"[A-Za-z0-9+/_.=~!@$%^&*\-]+")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|example|placeholder|none|null|true|false)$")
HEX_BYTES = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))

COLUMNS = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; cheap tests keep plain prose off them."""
    found = []
    lower = text.lower()
    if any(word in lower for word in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_CHARS:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_CHARS:
                found.append((m.start(), 1, m.end()))
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(HEX_BYTES):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy(literal: str) -> float:
    """Bits per character by the literal's own counts."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values())


def name_weight(name: str) -> int:
    """Weight of the most sensitive part, over words of snake, kebab, dotted and camel case."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
    parts = [w for w in re.split(r"[_.\-]+", words) if w]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(w, 0) for w in parts + joined), default=0)


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """Literals that reached a sensitive name, as (start, kind, end)."""
    known: dict[str, int] = {}  # the assignment that a name was last set by
    held: list[tuple[list[tuple[int, int]], list[int]]] = []  # its literals, earlier assignments
    weights: list[int] = []
    for m in PAIR.finditer(text):
        got, earlier = _literals(m, text, known)
        if got or earlier:
            known[m["name"]] = len(held)
            held.append((got, earlier))
            weights.append(name_weight(m["name"]))
    best: dict[tuple[int, int], int] = {}
    # a name reaches what the names on its right side hold: each assignment is looked at once
    for i in range(len(held) - 1, -1, -1):
        got, earlier = held[i]
        for span in got:
            best[span] = max(best.get(span, 0), weights[i])
        for j in earlier:
            weights[j] = max(weights[j], weights[i])
    found = []
    for (a, b), weight in best.items():
        literal = text[a:b]
        if weight and b - a >= LEAST_CHARS and not PLACEHOLDER.match(literal):
            if " " not in literal and weight + entropy(literal) >= LEAST_SCORE:
                found.append((a, 3, b))
    return sorted(found)


def _literals(m: re.Match, text: str, known: dict[str, int]) -> tuple[list, list[int]]:
    """Spans of the literals on the right side, and the assignments of its known names."""
    value, at = m["value"], m.start("value")
    got: list[tuple[int, int]] = []
    earlier: list[int] = []
    if value[0] in "\"'":
        got.append((at + 1, at + len(value) - 1))
    elif value in known:
        earlier.append(known[value])
    elif BARE.fullmatch(value):
        got.append((at, at + len(value)))
    for term in TERM.finditer(text, m.start("more"), m.end("more")):
        if term[3] is not None:
            earlier += [known[term[3]]] if term[3] in known else []
        else:
            group = 1 if term[1] is not None else 2
            got.append((term.start(group), term.end(group)))
    return [span for span in got if span[1] > span[0]], earlier


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    more = literal_spans(text) if "=" in text or ":" in text else []
    return base, more


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts per base kind, digest of the base spans, all spans.

    Offsets count code points, ends are exclusive. A null or empty text has no span; texts
    are read whole; repeated rows give equal rows; an empty table gives none;
    other columns are ignored.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                base, more = scan_text(text)
                kinds = Counter(kind for _, kind, _ in base)
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                out.append((kinds[0], kinds[1], kinds[2], digest, _joined(sorted(base + more))))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")[1:]])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame.astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(find, COLUMNS)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping spans by one.

    A null text stays null; all other columns stay as they are, but an ``n_chars`` column
    follows the changed text.
    """
    out = docs.withColumn("text", _redactor(mark)(F.col("text")))
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(counted, F.col("n_chars")))
    return out


def _redactor(mark: str):
    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        return column.map(lambda t: t if t is None else redacted(t, mark))

    return clean


def redacted(text: str, mark: str) -> str:
    base, more = scan_text(text)
    out, at = [], 0
    for start, _, end in sorted(base + more):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text
