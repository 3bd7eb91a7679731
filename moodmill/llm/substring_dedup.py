"""Removal of word runs that an earlier document has, by suffix automata.

Reference shards are the spans of one anchor (see anchors.py). A shard's automaton holds
all its spans and, per state, the least document that its words come from; each span is
streamed through it for the matching statistics, and a match of the full window length
whose state leads to a smaller document is a removal. Shards are sent to the documents
that can match them instead of to all documents, since all shards together grow with the
corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.anchors import FIRSTS, Repeats, Symbols, covered
from moodmill.llm.signatures import NO_ID, Words

WINDOW, GRAM = 13, 5
COLUMNS = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class WordSymbols(Symbols):
    def __init__(self, texts: list[str]):
        self.words = Words(texts)
        self.hash, self.first = self.words.hash, self.words.first

    def content(self, a: int, b: int) -> bytes:
        data = self.words.data[self.words.start[a] : self.words.end[b - 1]]
        return b" ".join(data.split())


class Automaton:
    """Suffix automaton of word sequences; each state keeps the least document of its words."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [2**63]

    def _state(self, size: int, doc: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.size.append(size)
        self.least.append(doc)
        return len(self.size) - 1

    def _split(self, at: int, word: bytes, to: int) -> int:
        """A state of its own for what ``at`` followed by ``word`` stands for."""
        new = self._state(self.size[at] + 1, self.least[to], like=to)
        self.link[to] = new
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            to = self.next[last].get(word)
            if to is not None:  # known from an earlier sequence
                if self.size[to] != self.size[last] + 1:
                    to = self._split(last, word, to)
                self.least[to] = min(self.least[to], doc)
                last = to
                continue
            new = self._state(self.size[last] + 1, doc)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                to = self.next[at][word]
                self.link[new] = (
                    to if self.size[to] == self.size[at] + 1 else self._split(at, word, to)
                )
            last = new

    def close(self) -> None:
        """Words of a state are also words of its suffixes: pass the least documents on."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[state]
            self.least[up] = min(self.least[up], self.least[state])

    def least_docs(self, words: list[bytes], window: int) -> list[int]:
        """Per window of ``words`` the least document with it, or 2**63."""
        state = size = 0
        out = []
        for i, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            while self.size[self.link[state]] >= window:
                state = self.link[state]
                size = self.size[state]
            if i >= window:
                out.append(self.least[state] if size >= window else 2**63)
        return out


def shards(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Spans (content, first doc_id and start, last place) of one anchor after the other.

    A content comes once from every task that has it; its places are brought together here.
    """
    key, spans = None, {}
    for batch in batches:
        columns = [batch[c].tolist() for c in ("sig", "part", "content")]
        firsts = zip(batch["doc_id"].tolist(), batch["start"].tolist())
        lasts = zip(batch["last_doc"].tolist(), batch["last_start"].tolist())
        for sig, part, content, first, last in zip(*columns, firsts, lasts, strict=True):
            if (sig, part) != key:
                if spans:
                    yield [(c, *first, last) for c, (first, last) in spans.items()]
                key, spans = (sig, part), {}
            seen = spans.get(content)
            spans[content] = (min(seen[0], first), max(seen[1], last)) if seen else (first, last)
    if spans:
        yield [(c, *first, last) for c, (first, last) in spans.items()]


def first_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, names = [], [c.split()[0] for c in FIRSTS.split(", ")]
    for rows in shards(batches):
        spans = [(content.split(b" "), doc) for content, doc, _, _ in rows]
        automaton = None
        if len(spans) > 1:
            automaton = Automaton()
            for words, doc in spans:
                automaton.add(words, doc)
            automaton.close()
        for (content, doc, _, last), (words, _) in zip(rows, spans, strict=True):
            n = len(words) - WINDOW + 1
            # alone in its shard, a span comes first where its first copy stands
            least = automaton.least_docs(words, WINDOW) if automaton else [doc] * n
            if doc < last[0] or min(least) < doc:  # else no document has it later than another
                ends = [i for i in range(1, n) if least[i] != least[i - 1]] + [n]
                out.append((hashlib.md5(content).digest(), ends, [least[i - 1] for i in ends], None))
        if len(out) >= 5000:
            yield pd.DataFrame(out, columns=names)
            out = []
    yield pd.DataFrame(out, columns=names)


def kept_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        columns = [batch[c] for c in ("doc_id", "text", "begins", "ends")]
        for doc_id, text, begins, ends in zip(*columns, strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            n = len(words)
            if begins is not None:
                gone = covered(n, begins, ends, WINDOW)
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            out.append((doc_id, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A window is 13 words of one document; all words of a window that starts in a smaller
    doc_id as well are removed. A null text has no words. Repeats inside a document stay;
    rows of one doc_id do not remove from each other. A null doc_id counts as the least;
    an empty table gives no row; other columns are ignored.
    """
    found = Repeats(docs, WordSymbols, first_documents, WINDOW, GRAM, within=False)
    kept = found.kept(kept_words, COLUMNS)
    return kept.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
