"""Queries that do their whole job at any size: no cut by a bound on rows or counts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from moodmill import runtime
from moodmill.operators import batch
from moodmill.operators import models as M
from moodmill.plans import QUERIES


def test_neighbours_are_those_of_all_labelled_rows(spark):
    """More labelled rows than are held at once; equal vectors in several blocks."""
    rng = random.Random(4)
    points = np.array([[rng.randrange(4), rng.randrange(4), rng.random() > 0.7] for _ in range(90)], float)
    labels = [rng.randrange(3) for _ in points]
    rows = [(i * 3, [float(x) for x in p], c) for i, (p, c) in enumerate(zip(points, labels))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want = {}
    for i, p in enumerate(points):
        far = np.sqrt(((points - p) ** 2).sum(1))
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[:3]
        want[i * 3] = int(np.bincount([labels[j] for j in near], minlength=3).argmax())
    for most in (7, 40, 1000):
        found = M.knn_predict(df, df.drop("label"), 3, most=most, block=16).collect()
        assert len(found) == 90 and {r["vec_id"]: r["pred"] for r in found} == want


def test_neighbours_of_repeated_ids(spark):
    rows = [(1, [0.0], 5), (1, [0.0], 5), (2, [0.1], 7), (3, [0.3], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for most in (1, 10):
        found = sorted(map(tuple, M.knn_predict(df, df.drop("label"), 1, most=most).collect()))
        assert found == [(1, 7), (1, 7), (2, 5), (3, 7)]
    alone = df.limit(1)
    assert list(map(tuple, M.knn_predict(alone, alone.drop("label"), 1).collect())) == [(1, 5)]


def test_the_sweep_has_all_names_of_the_training_messages(spark, monkeypatch):
    folder = runtime.scratch_path(spark, "in")
    own = lambda i: "ab" + chr(97 + i // 8) + chr(97 + i % 8)
    texts = [(i, f"common {own(i)}", "en", "s", 0) for i in range(60)]
    spark.createDataFrame(
        texts, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    seen = {}
    monkeypatch.setattr(M, "percentile_sweep", lambda features, *a, **k: seen.update(names=features))
    QUERIES["eval_15_percentile_sweep"](spark, folder)
    # a name that stands in one message is a name as well
    assert seen["names"].select("name").distinct().count() == 61


@pytest.fixture(scope="module")
def counts(spark):
    """Vector tables with a few frequent and many rare features."""
    rng = random.Random(7)
    rows, cells = [], []
    for i in range(120):
        label = (-1, 0, 1)[i % 3]
        rows.append((i, label, i % 4 if i < 100 else 9))
        cells += [(i, f"f{rng.randrange(4)}", float(rng.randrange(1, 4))) for _ in range(3)]
        cells += [(i, f"l{label}", 1.0)] * (rng.random() < 0.6) + [(i, f"rare{i // 2}", 1.0), (i, f"one{i}", 2.0)]
    messages = spark.createDataFrame(rows, "doc_id long, label int, fold int")
    features = spark.createDataFrame(cells, "doc_id long, name string, value double")
    return M._tables(features, messages.where("fold < 9"), messages.where("fold = 9"))


def test_held_rows_are_dense_rows(counts, monkeypatch):
    rows = batch.sparse_rows(*counts)
    flat, size = batch.flat_rows(rows), M._size(counts[0])
    columns = np.arange(1, size, 2)
    dense = np.zeros((len(flat.classes), size))
    dense[np.repeat(np.arange(len(dense)), np.diff(flat.starts)), flat.indices] = flat.values
    rng = np.random.default_rng(3)
    x, slope = rng.normal(size=(6, len(columns) + 1)), rng.normal(size=(len(dense), 6))
    for share, room in ((0.0, 1 << 20), (0.1, 1 << 20), (2.0, 1 << 20), (0.0, 8 * len(dense) * 3)):
        monkeypatch.setattr(batch, "OFTEN", {"few": share, "many": share})
        monkeypatch.setattr(batch, "DENSE_BYTES", room)
        held = batch.Held(flat, columns, size)
        assert held.dense.nbytes <= room
        assert np.allclose(held.times(x), dense[:, columns] @ x[:, :-1].T)
        gradient = np.zeros_like(x)
        held.add(slope, gradient)
        assert np.allclose(gradient[:, :-1], slope.T @ dense[:, columns]) and not gradient[:, -1].any()


def test_no_coefficients_leave_the_tasks(counts, monkeypatch):
    """Rows that are sent come back as counts; rows dealt out give the same, in slices."""
    size = M._size(counts[0])
    some = batch.ranges(range(0, size, 3))
    jobs = [batch.Job("a", params={"C": 0.1, "max_iter": 20}), batch.Job("a", params={"C": 0.1, "max_iter": 3}),
            batch.Job("b", "linear_svc", {"C": 0.1, "max_iter": 20}, some), batch.Job("c", "hinge_sgd", {"max_iter": 9}),
            batch.Job("d", params={"max_iter": 5}, features=())]
    scores = lambda: sorted(map(tuple, batch.cross_validate(jobs, *counts, size, 4).collect()))
    with monkeypatch.context() as patch:
        patch.setattr(batch, "fit", None)
        patch.setattr(batch, "TASK_BYTES", 1)  # a model at a time
        sent = scores()
    assert len(sent) == len(jobs) * 4 * 5
    for name, value in (("SENT_BYTES", 0), ("DIRECT_BYTES", 0), ("SLICE_BYTES", 800)):
        monkeypatch.setattr(batch, name, value)
    dealt = scores()
    assert [r[:4] for r in sent] == [r[:4] for r in dealt]
    assert np.allclose([r[4] for r in sent], [r[4] for r in dealt])


def test_stored_rows_have_a_file_per_core(spark, monkeypatch):
    table = runtime.materialize(spark.range(20_000).coalesce(1), "one")
    assert len(runtime.compact(table).inputFiles()) == 1
    monkeypatch.setattr(runtime, "CORE_BYTES", 1000)
    dealt = runtime.compact(table)
    assert len(dealt.inputFiles()) == spark.sparkContext.defaultParallelism and dealt.count() == 20_000
