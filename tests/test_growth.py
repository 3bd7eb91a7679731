"""Work that must be done once per message, and rows that must not be shuffled."""

from __future__ import annotations

from pyspark.ml.linalg import Vectors

from moodmill import runtime
from moodmill.config import ModelSpec
from moodmill.operators import models as M
from moodmill.plans import QUERIES, modeling
from moodmill.plans import files as plans
from moodmill.sources import readers, sinks


def documents(spark, texts):
    folder = runtime.scratch_path(spark, "in")
    rows = [(i, t, "en", f"s{i % 2}", 0) for i, t in texts]
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    ).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i, _ in texts if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    return folder


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gapped_grams_are_made_once(spark):
    folder = documents(spark, [(1, "a b c d"), (2, "x y")])
    found = QUERIES["txt_22_gapped_ngrams"](spark, folder)
    assert plan(found).count("sequence(0") == 4  # two sizes, by two ways to join
    # ---b c d, a---c d, a b---d, a b c---, ---b c, a---c, a b---, ---c d, b---d, b c---
    assert list(map(tuple, found.collect())) == [(1, 10, 8 + 7 + 7 + 8 + 2 * (6 + 5 + 6), "---b c", "b---d")]


def test_tagged_lines_of_lists(spark):
    kind = "sid long, pairs array<struct<tok string, tag string>>"
    rows = [(1, [("a", "N"), ("b", "V")]), (2, []), (3, None), (4, [("c", "N")]), (4, [("d", "V"), ("e", "N")]),
            (None, [("f", "N")])]
    lists = spark.createDataFrame(rows, kind)
    of_lists = sorted(r["value"] for r in sinks.tagged_lines(lists).collect())
    assert of_lists == sorted(r["value"] for r in sinks.tagged_lines(sinks.token_rows(lists)).collect())
    assert of_lists == ["1\ta N\tb V", "4\tc N\td V\te N", "f N"]
    assert "Aggregate" not in plan(sinks.tagged_lines(lists.where("sid < 4")))  # one line each as it is


def test_tagged_corpus_with_repeated_ids(spark):
    folder = documents(spark, [(1, "one two."), (2, None), (5, "bb a"), (5, "ccc"), (6, "")])
    found = QUERIES["src_17_snk_03_tagged_corpus"](spark, folder)
    assert sorted(map(tuple, found.collect())) == [("1", "one/RB two/RB ./VB"), ("5", "bb/JJ ccc/RB a/VB")]
    path = runtime.scratch_path(spark, "tagged")
    sinks.write_tagged(plans._tagged_sids(spark, folder), path)
    tokens = sorted(map(tuple, readers.read_tagged(spark, path).collect()))
    assert tokens[:3] == [("1", 0, "one", "RB"), ("1", 1, "two", "RB"), ("1", 2, ".", "VB")]


def test_run_record_is_made_once(spark, monkeypatch):
    folder = documents(spark, [(i, f"idiot ha text {i}") for i in range(12)])
    runs = []
    append = sinks.append_run
    monkeypatch.setattr(sinks, "append_run", lambda run, *a: (runs.append(run), append(run, *a)))
    found = QUERIES["snk_07_append_run"](spark, folder)
    assert sorted(r["run_id"] for r in found.collect()) == ["first", "second"]
    assert len(runs) == 3
    for run in runs:  # a stored row, not the way to it
        assert "Join" not in plan(run) and run.count() == 1


def test_classes_of_a_linear_model_are_fitted_together(spark):
    for name in ("linear_svc", "elastic", "hinge_sgd"):
        assert M._stages(name, {}, 10)[-1].getParallelism() == len(M.LABELS)
    assert M._stages("boosted", {}, 10)[-1].getParallelism() == 1  # it holds dense rows


def test_rows_of_a_tree_are_dealt_out(spark, monkeypatch):
    rows = [(i, i % 3 - 1, float(i % 3), Vectors.sparse(2, {i % 2: 1.0 + i % 3})) for i in range(30)]
    table = spark.createDataFrame(rows, ["doc_id", "label", "target", "features"]).coalesce(1)
    whole = M.fit_model(table, ModelSpec("tree", {"depth": 4})).stages[-1].toDebugString
    monkeypatch.setattr(M, "TREE_ROWS", 10)
    assert M._dealt(table, 30).rdd.getNumPartitions() == 3
    assert M._dealt(table, 10).rdd.getNumPartitions() == 1
    parts = M.fit_model(table, ModelSpec("tree", {"depth": 4})).stages[-1].toDebugString
    assert whole.splitlines()[1:] == parts.splitlines()[1:]


def test_splits_are_dealt_over_the_cores(spark):
    folder = documents(spark, [(i, f"text {i}") for i in range(200)])
    train, external = modeling.splits(spark, folder)
    cores = spark.sparkContext.defaultParallelism
    assert len(train.inputFiles()) >= cores and train.count() + external.count() == 200
