"""The pipeline's stages on planted rows, and that its rows are those of plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from moodmill.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(5)) for _ in range(300)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, base = prose(40), prose(200)
    near = list(base)
    near[50] = "changed"
    texts = [" ".join(prose(120)) for _ in range(60)]  # clean
    texts += [" ".join(base), " ".join(near), " ".join(base)]  # one group: 60, 61, 62
    texts += [" ".join(prose(50) + passage), " ".join(prose(900) + passage[:13])]  # 63 hit, 64 not
    texts += ["12 34 !!", "", None]  # rejected: no letters
    texts += [" ".join(prose(60)) + ' password = "hunter2hunter2" ' + " ".join(prose(20))]
    rows = [(i, t, None if t is None else "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    out = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    bench = [("q1", " ".join(passage)), ("q2", None)]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(
        f"{out}/benchmark.parquet"
    )
    return f"file://{out}", texts


def test_stages_keep_clean_documents_and_pack_the_rest(spark, folder, tmp_path):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        gone = [{65, 66, 67}, {65, 66, 67, 61, 62}, {65, 66, 67, 61, 62, 63}][min(k, 2)]
        assert ids == set(range(len(texts))) - gone, name
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = rows[68]["text"]
    assert "hunter2" not in kept and "[secret]" in kept and rows[68]["n_chars"] == len(kept)
    assert all(rows[i]["text"] == texts[i] for i in rows if i != 68)

    ids_of = packing.TokenIds(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, row in rows.items():
        ids = np.frombuffer(ids_of.of(row["text"]) + b"\0\0\0\0", "<u4")
        at = 0
        for length in packing.binary_lengths(len(ids)):
            want.add((i, at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids)))
            at += length
    found = corpus_pipeline.run(spark, path)
    got = found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_documents_give_no_rows(spark, folder, tmp_path):
    path, _ = folder
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
