"""Packing by powers of two.

A document of n tokens is cut into as many full sequences as it fills and the binary
digits of the rest. Each piece is a sequence by itself, in the bucket of its length, so
nothing is padded and no sequence crosses documents.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodmill.llm.common import texts
from moodmill.runtime import materialize

SEQUENCE = 1024
#: The byte-level split pattern, a fixed value, with possessive repeats.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
#: The same for text in which no white space touches white space: without looking ahead.
SPLIT_PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: White space of that pattern beside the space and the line end (Unicode's White_Space).
RARE_SPACE = "\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
SPACE_RUNS = ("  ", " \n", "\n ", "\n\n", *RARE_SPACE)

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "_part int, _nth long"
)


class TokenIds:
    """Little-endian 32-bit ids of a text, as the tokenizer of a JSON file gives them.

    A plain byte-level BPE is run by its merge ranks, the faster way to the same ids. A text
    that holds the string of an added token goes through the file's own tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = _as_ranks(path)
        self.any_text = _by_ranks(ranks, SPLIT) if ranks else None
        self.plain_text = _by_ranks(ranks, SPLIT_PLAIN) if ranks else None

    def of(self, text: str) -> bytes:
        if self.any_text is None or any(content in text for content in self.added):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        elif any(run in text for run in SPACE_RUNS):
            ids = self.any_text.encode_ordinary(text)
        else:
            ids = self.plain_text.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def _by_ranks(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _as_ranks(path: str) -> dict[bytes, int] | None:
    """The merge ranks of a tokenizer; None unless it is a plain byte-level BPE whose
    ids follow the order of its merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = (
        spec["normalizer"] is None
        and model["type"] == "BPE"
        and not model.get("ignore_merges")
        and split.get("type") == "ByteLevel"
        and split.get("use_regex")
        and not split.get("add_prefix_space")
    )
    if not plain:
        return None
    joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    if any(model["vocab"].get(piece) != 256 + i for i, piece in enumerate(joined)):
        return None
    shown = _shown_bytes()
    return {
        bytes(shown[c] for c in piece): i
        for piece, i in model["vocab"].items()
        if all(c in shown for c in piece) and i < 256 + len(joined)
    }


def _shown_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


def binary_lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """Full lengths first, then the binary digits of the rest from the largest."""
    lengths = [most] * (n // most)
    rest = n % most
    while rest:
        part = 1 << (rest.bit_length() - 1)
        lengths.append(part)
        rest -= part
    return lengths


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence`` is a power of two. Each document's ids are closed by ``end_id``, so a null
    or empty text is one piece of length 1. Sequence ids count from 0 without gaps, bucket
    by bucket from the shortest. Repeated rows are packed as often as they occur; an empty
    table gives no piece; other columns are ignored.
    """
    closing = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = TokenIds(tokenizer)
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True):
                ids = memoryview(ids_of.of(text) + closing)
                total, start = len(ids) // 4, 0
                for length in binary_lengths(total, sequence):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((doc_id, start, length, crc, total, part, seen[length]))
                    seen[length] += 1
                    start += length
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    # written once: the numbers below refer to the tasks that cut the pieces
    cuts = materialize(texts(docs).mapInPandas(cut, PIECES), "pieces")
    buckets = cuts.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    totals = buckets.groupBy("length").agg(F.sum("_n").alias("_total"))
    # a row per length: eleven at most for sequences of 1024
    shorter = totals.alias("a").join(
        F.broadcast(totals.select(F.col("length").alias("_l"), F.col("_total").alias("_t"))),
        F.col("_l") < F.col("length"),
        "left",
    ).groupBy("length").agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("_base"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = buckets.withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    ).join(F.broadcast(shorter), "length")
    return cuts.join(first.drop("_n"), ["length", "_part"]).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("_base") + F.col("_before") + F.col("_nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
