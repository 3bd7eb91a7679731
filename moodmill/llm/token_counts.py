"""Token counts behind a digest cache.

A text is known by the digest of its content, a tokenizer by the digest of its file. The
counts of known texts come from the stored cache; every other text is encoded once,
however many copies it has, and its count is appended.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.common import texts

OVER_LIMIT = 4096
#: Words whose counts a worker remembers.
MEMO_WORDS = 400_000
CACHE_SCHEMA = "content binary, n_tokens long"


class _PieceCounts(dict):
    """Tokens per word of a sentencepiece model.

    No piece of the model holds a space mark after another character (checked on load), so
    no token crosses from a word into the spaces before the next word, and a text has as
    many tokens as its words encoded one by one.
    """

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        self.apart = not any(
            re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(size)
        )

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word))  # the model itself puts the space before it back
        if len(self) < MEMO_WORDS:  # the frequent words come first and stay
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not self.apart or text.endswith(" ") or "▁" in text:
            return len(self.model.encode(text))
        words = text.split(" ")
        if "" in words:  # runs of spaces belong to the word behind them
            words = [word[1:] for word in re.findall(" +[^ ]+", " " + text)]
        return sum(map(self.__getitem__, words))


class _JsonCounts:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)


def load_counter(path: str):
    return _JsonCounts(path) if path.endswith(".json") else _PieceCounts(path)


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, limit: int = OVER_LIMIT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a ``.model`` or ``.json`` file, ``cache`` a shared folder
    that may not exist yet and that one job at a time appends to. A null or empty text has
    no bytes and no tokens; copies share one encoding; texts of any length are encoded
    whole; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = f"{cache}/version={tokenizer_version(tokenizer)}"
    content = F.unhex(F.sha2("text", 256)).alias("content")
    rows = texts(docs)

    stored = read_cache(spark, folder)
    wanted = rows.select(content, "text")
    if stored is not None:
        wanted = wanted.join(stored.select("content"), "content", "left_anti")
    # one row per text leaves a map task, so copies do not meet in one reducer
    misses = wanted.groupBy("content").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = load_counter(tokenizer)
        for batch in batches:
            yield pd.DataFrame(
                {"content": batch["content"], "n_tokens": [counter.count(t) for t in batch["text"]]}
            )

    misses.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(folder)

    counts = spark.read.schema(CACHE_SCHEMA).parquet(folder)
    keyed = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content)
    return keyed.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
