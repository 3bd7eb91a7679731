"""Models fitted side by side against Spark's own, fitted one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest

from moodmill.config import ModelSpec
from moodmill.operators import batch, models
from moodmill.operators.batch import Job


@pytest.fixture(scope="module")
def tables(spark):
    """Noisy counts in which the class shows a little."""
    rng = random.Random(5)
    rows, cells = [], []
    for i in range(150):
        label = (-1, 0, 1)[i % 3]
        for _ in range(10):
            shift = label + 1 if rng.random() < 0.45 else rng.randrange(3)
            cells.append((i, f"f{shift * 5 + rng.randrange(6):02d}", float(rng.randrange(1, 4))))
        rows.append((i, label, i % 4 if i < 120 else 9))
    messages = spark.createDataFrame(rows, "doc_id long, label int, fold int")
    features = spark.createDataFrame(cells, "doc_id long, name string, value double")
    train, external = messages.where("fold < 9"), messages.where("fold = 9")
    return models._tables(features, train, external)


def fitted(tables, job, fold=None, folds=4):
    rows = batch.sparse_rows(*tables)
    size = models._size(tables[0])
    found = batch.fit(rows, size, [(job.settings(), fold)], [{job.iterations()}], batch.class_sizes(rows, folds))
    return found[0][job.iterations()]


def test_coefficients_equal_sparks(tables):
    train, _ = tables
    for params in (
        {"C": 0.1, "max_iter": 300},
        {"C": 0.1, "max_iter": 300, "balanced": False, "fit_intercept": False},
    ):
        ours = fitted(tables, Job("a", params=params), fold=1)
        own = models.fit_model(train.where("fold <> 1"), ModelSpec("logistic", params)).stages[-1]
        theirs = np.column_stack([own.coefficientMatrix.toArray(), own.interceptVector.toArray()])
        # without a penalty on it, an intercept is known up to a shift of all classes
        ours[:, -1] -= ours[:, -1].mean()
        assert np.abs(ours - theirs).max() < 5e-3
    params = {"C": 0.1, "max_iter": 300, "multi_class": "ovr"}
    ours = fitted(tables, Job("a", params=params), fold=1)
    # the classes stop together here and one by one there
    own = models.fit_model(train.where("fold <> 1"), ModelSpec("logistic", params)).stages[-1]
    for c, model in enumerate(own.models):
        theirs = np.append(model.coefficients.toArray(), model.intercept)
        assert np.abs(ours[c] - theirs).max() < 2e-2


def test_losses_have_the_slopes_they_claim():
    rng = np.random.default_rng(2)
    truth = np.eye(3)[rng.integers(0, 3, 6)][:, None, :]
    for k in range(len(batch.LOSSES)):
        own = batch.Batch(np.array([k]), np.zeros(0), np.zeros(0))
        z = rng.normal(size=(6, 1, 3))
        loss, slope = own.residuals(z, truth)
        for c in range(3):
            near = z.copy()
            near[:, :, c] += 1e-6
            assert np.allclose((own.residuals(near, truth)[0] - loss) / 1e-6, slope[:, :, c], atol=1e-4)


def test_a_mask_is_a_table_without_the_other_features(tables):
    ranges = ((0, 4), (9, 13))
    for name, params in (("logistic", {"C": 0.1}), ("linear_svc", {"C": 0.1}), ("hinge_sgd", {"alpha": 0.1})):
        masked = fitted(tables, Job("m", name, params, ranges), fold=0)
        cut = [models.slice_features(t, ranges) for t in tables]
        alone = fitted(cut, Job("m", name, params), fold=0)
        kept = [*range(0, 4), *range(9, 13), -1]
        assert np.allclose(masked[:, kept], alone, atol=2e-3)
        masked[:, kept] = 0
        assert not masked.any()


def test_rows_dealt_out_give_what_models_dealt_out_give(tables, monkeypatch):
    jobs = [
        Job("a", params={"C": 0.1, "max_iter": 25}),
        Job("b", params={"C": 0.1, "max_iter": 4}),
        Job("c", "linear_svc", {"C": 0.1, "max_iter": 30}, ((0, 9),)),
        Job("d", "hinge_sgd", {"max_iter": 15}),
    ]
    train, external = tables
    size = models._size(train)
    scores = lambda: sorted(map(tuple, batch.cross_validate(jobs, train, external, size, 4).collect()))
    small = scores()
    assert len(small) == len(jobs) * 4 * 5
    monkeypatch.setattr(batch, "SENT_BYTES", 0)
    monkeypatch.setattr(batch, "DIRECT", 0)
    monkeypatch.setattr(batch, "ROWS", 7)
    monkeypatch.setattr(batch, "BATCH_BYTES", 100_000)
    assert [r[:4] for r in small] == [r[:4] for r in scores()]
    assert np.allclose([r[4] for r in small], [r[4] for r in scores()])


def test_scores_are_those_of_sparks_cross_validation(tables):
    train, external = tables
    params = {"C": 0.05}
    ours = batch.cross_validate([Job("k", params=params)], train, external, models._size(train), 4)
    theirs = models.cross_validate(ModelSpec("logistic", params), train, external, 4)
    key = lambda rows: {(r["fold"], r["metric"]): r["value"] for r in rows.collect()}
    ours, theirs = key(ours), key(theirs)
    assert ours.keys() == theirs.keys()
    assert sum(abs(ours[k] - theirs[k]) > 1e-9 for k in ours) <= 1


def test_what_is_not_served_is_an_error():
    with pytest.raises(ValueError, match="not fitted in batches"):
        Job("a", "tree").settings()
    with pytest.raises(ValueError, match="no parameter depth"):
        Job("a", "logistic", {"depth": 3}).settings()
    assert batch.ranges([0, 1, 2, 5, 7, 8]) == ((0, 3), (5, 6), (7, 9)) and batch.ranges([]) == ()


def test_masks_and_their_memo(spark, tables, tmp_path):
    """Blocks in one table; masks known from the memo are not fitted again."""
    rng = random.Random(3)
    rows = [(i, (-1, 0, 1)[i % 3], i // 3 % 3 if i < 60 else 9) for i in range(75)]
    messages = spark.createDataFrame(rows, "doc_id long, label int, fold int")
    cells = []
    for i, label, _ in rows:
        cells.append((i, "GOOD", f"g{label}", 1.0))
        cells.append((i, "NOISE", f"n{rng.randrange(5)}", 1.0))
        cells.append((i, "OTHER", "same", 1.0))
    features = spark.createDataFrame(cells, "doc_id long, block string, name string, value double")
    train, external = messages.where("fold < 9"), messages.where("fold = 9")
    masks = spark.createDataFrame([("[1, 0, 0]",), ("[0, 1, 1]",), ("[0, 0, 0]",)], "mask string")
    memo = f"file://{tmp_path}/memo"
    specs = (ModelSpec("logistic", {"C": 1.0}), ModelSpec("tree", {"depth": 2}))
    run = lambda own: {
        r["mask"]: r
        for r in models.evaluate_masks(
            features, own, train, external, ("GOOD", "NOISE", "OTHER"), memo, models=specs, folds=3
        ).collect()
    }
    found = run(masks)
    assert found["[1, 0, 0]"]["external_score"] == 1.0 and found["[0, 1, 1]"]["external_score"] < 0.8
    assert spark.read.parquet(memo).count() == 3
    more = masks.union(spark.createDataFrame([("[1, 1, 0]",)], "mask string"))
    again = run(more)
    assert {k: v for k, v in again.items() if k in found} == found and again["[1, 1, 0]"]["external_score"] == 1.0
    assert spark.read.parquet(memo).count() == 4


def test_elimination_against_a_plain_loop(spark):
    """Ranks and scores equal those of fits one by one on cut tables."""
    rng = random.Random(8)
    rows, cells = [], []
    for i in range(90):
        label = (-1, 0, 1)[i % 3]
        for _ in range(8):
            shift = label + 1 if rng.random() < 0.5 else rng.randrange(3)
            cells.append((i, f"f{shift * 4 + rng.randrange(4):02d}", 1.0))
        rows.append((i, label, i // 3 % 2 if i < 70 else 9))
    messages = spark.createDataFrame(rows, "doc_id long, label int, fold int")
    features = spark.createDataFrame(cells, "doc_id long, name string, value double")
    train, external = messages.where("fold < 9"), messages.where("fold = 9")
    spec = ModelSpec("linear_svc", {"C": 0.2})
    steps, ranks = models.eliminate(features, train, external, 0.4, 2, spec)
    own = models._tables(features, train, external)
    size = models._size(own[0])
    alive = {0: list(range(size)), 1: list(range(size)), None: list(range(size))}
    left, want = {}, {}
    while True:
        scores, n = [], len(alive[None])
        for fold, kept in alive.items():
            ranges = batch.ranges(kept)
            cut = [models.slice_features(t, ranges) for t in own]
            x = fitted(cut, Job("", spec.name, spec.params), fold, 2)
            counts = batch.confusions(batch.sparse_rows(*cut), len(kept), [(x, fold)])[0]
            f = batch.f_scores(counts[1] if fold is None else counts[0])
            scores.append((f[0] + f[2]) / 2)
            weight = (x[:, :-1] ** 2).sum(axis=0)
            keep = max(1, min(n - 1, int(np.ceil(n * 0.6))))
            order = np.argsort(-weight, kind="stable")[:keep]
            if fold is None:
                for i in kept:
                    want[i] = n
            alive[fold] = sorted(kept[i] for i in order)
        left[n] = (sum(scores[:2]) / 2, scores[2])
        if n < 2:
            break
    found = {r["features"]: (r["cv_score"], r["external_score"]) for r in steps.collect()}
    assert found.keys() == left.keys()
    assert all(np.allclose(found[n], left[n], atol=0.05) for n in left)
    best = [r["features"] for r in steps.collect() if r["best"]]
    assert len(best) == 1 and found[best[0]][0] == max(v[0] for v in found.values())
    got = {r["name"]: r for r in ranks.collect()}
    assert len(got) == size and sum(r["chosen"] for r in got.values()) == best[0]
    ordered = [got[name]["left"] for name in sorted(got)]
    assert sum(a != want[i] for i, a in enumerate(ordered)) <= 2


def test_bayes_of_all_folds_equals_sparks(spark, tables, monkeypatch):
    spec = ModelSpec("multinomial_nb", {"alpha": 0.5})
    whole = models.vector_table(
        spark.createDataFrame(
            [(i, n, float(v)) for i in range(60) for n, v in (("every", i % 3 + 2), (f"x{i % 7}", i % 4 + 1))],
            "doc_id long, name string, value double",
        ),
        spark.createDataFrame([(i, i % 5 % 3 - 1, i % 4) for i in range(60)], "doc_id long, label int, fold int"),
    )
    for train, external in (tables, (whole, whole.where("fold = 0"))):
        theirs = models._queue({"multinomial_nb": spec}, train, external, 4).drop("key")
        with monkeypatch.context() as patch:
            # no model, whose size is that of the vocabulary, comes to the driver
            patch.setattr(models, "fit_model", None)
            ours = models.cross_validate(spec, train, external, 4)
        found = [{(r["model"], r["fold"], r["metric"]): r["value"] for r in x.collect()} for x in (ours, theirs)]
        assert found[0] == pytest.approx(found[1])
