"""Vectors, Spark ML models, cross-validation and the searches built on it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from importlib import import_module
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import ElementwiseProduct, MaxAbsScaler, MinMaxScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from moodmill import runtime
from moodmill.config import ModelSpec
from moodmill.operators import align, batch, bayes, evaluate, select
from moodmill.operators.select import Scorer

SEED = 9000
FOLDS = 10
LABELS = (-1, 0, 1)
ENDS = (1, -1)

# ---------------------------------------------------------------- vectors


def feature_index(features: DataFrame) -> DataFrame:
    """name, idx: names in order, numbered from 0 (learned on the training split)."""
    names = features.select("name").distinct()
    return runtime.number_rows(names, [F.col("name")], "rn", "vocabulary").select(
        "name", (F.col("rn") - 1).cast("int").alias("idx")
    )


def vectorize(features: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """doc_id, indices, values: one sparse row per message; unknown names are dropped."""
    vocabulary = feature_index(features) if vocabulary is None else vocabulary
    known = features.join(runtime.small_side(vocabulary), "name").repartition("doc_id")
    cells = known.groupBy("doc_id", "idx")  # both groupings share the one shuffle
    entries = F.array_sort(F.collect_list(F.struct("idx", "value")))
    rows = cells.agg(F.sum("value").alias("value")).groupBy("doc_id").agg(entries.alias("e"))
    return rows.select(
        "doc_id",
        F.transform("e", lambda e: e["idx"]).alias("indices"),
        F.transform("e", lambda e: e["value"]).alias("values"),
    )


def vector_table(
    features: DataFrame, messages: DataFrame, vocabulary: DataFrame | None = None
) -> DataFrame:
    """doc_id, label and a sparse vector per message, empty for one without any feature.

    Stored once, so every fold reads the same table. The vector is written as the struct
    it is stored as and read back as a vector: no row passes through Python.
    """
    vocabulary = runtime.materialize(
        feature_index(features) if vocabulary is None else vocabulary, "vocabulary"
    )
    size = max(vocabulary.count(), 1)
    base = messages.select("doc_id", *[c for c in ("label", "fold") if c in messages.columns])
    rows = base.join(vectorize(features, vocabulary), "doc_id", "left")
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),  # sparse
        F.lit(size).alias("size"),
        F.coalesce("indices", F.array().cast("array<int>")).alias("indices"),
        F.coalesce("values", F.array().cast("array<double>")).alias("values"),
    )
    rows = with_target(rows.withColumn("features", vector).drop("indices", "values"))
    path = runtime.scratch_path(rows.sparkSession, "vectors")
    rows.write.parquet(path)
    schema = StructType(
        [
            StructField(f.name, VectorUDT() if f.name == "features" else f.dataType)
            for f in rows.schema
        ]
    )
    return rows.sparkSession.read.schema(schema).parquet(path)


def with_target(rows: DataFrame) -> DataFrame:
    """The class index Spark ML wants: label -1, 0, 1 as 0, 1, 2."""
    return rows.withColumn("target", (F.col("label") + 1).cast("double"))


def class_weights(messages: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_class) on every row."""
    sizes = messages.groupBy(label).agg(F.count("*").alias("_n"))
    both = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    table = sizes.crossJoin(F.broadcast(both)).select(  # a row per class, one row of totals
        label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight")
    )
    return messages.join(F.broadcast(table), label)


# ---------------------------------------------------------------- models


class RidgeClassifier(Estimator):
    """One least-squares fit per class on +1 / -1; the greatest answer wins."""

    def __init__(self, reg: float = 1.0, classes: int = len(LABELS)):
        super().__init__()
        self.reg, self.classes = reg, classes

    def _fit(self, dataset: DataFrame) -> Model:
        parts = []
        for c in range(self.classes):
            side = F.when(F.col("target") == c, 1.0).otherwise(-1.0)
            fit = LinearRegression(
                labelCol="_side", regParam=self.reg, elasticNetParam=0.0,
                standardization=False, weightCol="weight", predictionCol=f"_p{c}",
            )
            parts.append(fit.fit(dataset.withColumn("_side", side)))
        return RidgeModel(parts)


class _RidgeWriter(MLWriter):
    def __init__(self, model: RidgeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        PipelineModel(self.model.parts).write().save(f"{path}/parts")


class _RidgeReader(MLReader):
    def load(self, path: str) -> RidgeModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RidgeModel(PipelineModel.load(f"{path}/parts").stages)
        return model._resetUid(metadata["uid"])


class RidgeModel(Model, MLWritable, MLReadable):
    def __init__(self, parts: Sequence):
        super().__init__()
        self.parts = list(parts)

    def write(self) -> MLWriter:
        return _RidgeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _RidgeReader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = reduce(lambda d, m: m.transform(d), self.parts, dataset)
        answers = [
            F.struct(F.col(f"_p{c}").alias("p"), F.lit(float(c)).alias("c"))
            for c in range(len(self.parts))
        ]
        best = F.array_max(F.array(*answers))
        return out.withColumn("prediction", best["c"]).drop(
            *[f"_p{c}" for c in range(len(self.parts))]
        )


class ClipNegative(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Scaled values below the training range count as 0: naive Bayes takes no negatives."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = F.transform(vector_to_array("ranged"), lambda x: F.greatest(x, F.lit(0.0)))
        return dataset.withColumn("clipped", array_to_vector(values)).drop("ranged")


class RangeScaler(Estimator):
    """Features scaled to 0 to 1 by their range in the training rows; a constant one is 0.

    Where every feature starts at 0, as counts do, the scaling keeps zeros and so sparse
    vectors; only a feature that starts elsewhere makes the rows dense.
    """

    def _fit(self, dataset: DataFrame) -> Model:
        ends = dataset.select(
            Summarizer.metrics("min", "max").summary(F.col("features")).alias("s")
        ).select("s.min", "s.max").first()
        low, high = ends["min"].toArray(), ends["max"].toArray()
        moves = high > low
        if not low.any():
            factors = np.divide(1.0, high, out=np.zeros_like(high), where=moves)
            stages = [_product("features", factors)]
        else:
            ranged = MinMaxScaler(inputCol="features", outputCol="ranged").fit(dataset)
            stages = [ranged, ClipNegative(), _product("clipped", moves.astype(float))]
        return PipelineModel(stages)


def _product(column: str, factors: np.ndarray) -> ElementwiseProduct:
    return ElementwiseProduct(
        scalingVec=Vectors.dense(factors), inputCol=column, outputCol="scaled"
    )


def _one_vs_rest(base, at_once: int = 1, **cols) -> OneVsRest:
    """One model per class, ``at_once`` of them in flight.

    A linear model is a long row of short jobs that leave cores idle, so all classes go at once;
    trees hold their binned rows while they grow, so those stay one after the other.
    """
    return OneVsRest(
        classifier=base, labelCol="target", weightCol="weight", parallelism=at_once, **cols
    )


def _stages(name: str, p: Mapping, n: int) -> list:
    """Spark stages of a registered model; ``n`` is the number of training rows."""
    cols = {"labelCol": "target"}
    weighted = {**cols, "weightCol": "weight"}
    if name == "logistic":
        model = LogisticRegression(
            maxIter=p.get("max_iter", 300), regParam=1.0 / (p.get("C", 100.0) * n),
            standardization=False, fitIntercept=p.get("fit_intercept", True), labelCol="target")
        if p.get("multi_class", "multinomial") == "ovr":
            return [_one_vs_rest(model, len(LABELS))]
        return [model.setFamily("multinomial").setWeightCol("weight")]
    if name == "hinge_sgd":
        scale = MaxAbsScaler(inputCol="features", outputCol="scaled")
        svc = LinearSVC(maxIter=p.get("max_iter", 100), regParam=p.get("alpha", 1e-4),
                        labelCol="target", featuresCol="scaled", standardization=False)
        return [scale, _one_vs_rest(svc, len(LABELS), featuresCol="scaled")]
    if name == "elastic":
        return [_one_vs_rest(LogisticRegression(
            maxIter=p.get("max_iter", 300), regParam=p.get("alpha", 1e-4),
            elasticNetParam=p.get("l1_ratio", 0.85), labelCol="target"), len(LABELS))]
    if name == "linear_svc":
        reg = 1.0 / (p.get("C", 0.5) * n)
        return [_one_vs_rest(LinearSVC(
            maxIter=p.get("max_iter", 1000), regParam=reg, standardization=False,
            labelCol="target"), len(LABELS))]
    if name == "multinomial_nb":
        return [RangeScaler(), NaiveBayes(modelType="multinomial", featuresCol="scaled",
                                          smoothing=p.get("alpha", 0.01), **cols)]
    if name == "gaussian_nb":
        return [NaiveBayes(modelType="gaussian", **cols)]
    if name == "tree":
        return [DecisionTreeClassifier(seed=p.get("seed", SEED), maxDepth=p.get("depth", 10),
                                       **weighted)]
    if name == "forest":
        return [RandomForestClassifier(seed=p.get("seed", SEED), numTrees=p.get("trees", 10),
                                       **weighted)]
    if name in ("boosted", "ada_boost"):
        return [_one_vs_rest(GBTClassifier(
            seed=p.get("seed", SEED), maxIter=p.get("rounds", 20),
            maxDepth=1 if name == "ada_boost" else p.get("depth", 3), labelCol="target"))]
    if name == "ridge":
        return [RidgeClassifier(p.get("alpha", 1.0) / n)]
    raise ValueError(f"unknown model {name!r}; known: {', '.join(MODELS)}")


MODELS = (
    "logistic", "hinge_sgd", "elastic", "linear_svc", "multinomial_nb", "gaussian_nb",
    "tree", "forest", "ada_boost", "boosted", "ridge",
)
DEFAULT_MODELS = (ModelSpec("logistic"), ModelSpec("hinge_sgd"), ModelSpec("linear_svc"))


#: Models that hold a dense row of binned features per message while they grow.
TREES = ("tree", "forest", "boosted", "ada_boost")
#: Messages that a task of them holds at once.
TREE_ROWS = 2_000


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows for a tree, ``TREE_ROWS`` to a task: a stored vector is small, so a file of them may
    hold all messages, and a single task would grow the tree."""
    return rows.repartition(-(-n // TREE_ROWS), "doc_id") if n > TREE_ROWS else rows


def fit_model(
    train: DataFrame, spec: ModelSpec, n: int | None = None, pre: Sequence = ()
) -> PipelineModel:
    """Fit a registered model on doc_id, label, target, features; balanced by default."""
    n = train.count() if n is None else n
    weighted = (
        class_weights(train)
        if spec.params.get("balanced", True)
        else train.withColumn("weight", F.lit(1.0))
    )
    if spec.name in TREES:
        weighted = _dealt(weighted, n)
    return Pipeline(stages=[*pre, *_stages(spec.name, spec.params, n)]).fit(weighted)


def predict(model: Transformer, rows: DataFrame) -> DataFrame:
    """Pairs of label and prediction as label codes."""
    out = model.transform(rows.withColumn("weight", F.lit(1.0)))
    return out.select(
        "doc_id",
        F.col("label").cast("int").alias("gold"),
        (F.col("prediction") - 1).cast("int").alias("pred"),
    )


class HeadlineEvaluator(Evaluator):
    """Mean F of the positive and negative class, for Spark's own tuning tools."""

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.select(
            (F.col("target") - 1).cast("int").alias("gold"),
            (F.col("prediction") - 1).cast("int").alias("pred"),
        )
        return float(evaluate.headline_score(pairs, ends=ENDS).first()["score"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


class FunctionTransformer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A pipeline stage around a caller's DataFrame function.

    A function of a module is saved by its name and found again by it; one that has no such
    name (a lambda, a function inside another) runs, but cannot be saved.
    """

    function = Param(
        Params._dummy(), "function", "module:name", typeConverter=TypeConverters.toString
    )

    def __init__(self, change: Callable[[DataFrame], DataFrame] | None = None):
        super().__init__()
        self.change = change
        if change is not None and "<" not in change.__qualname__:
            self._set(function=f"{change.__module__}:{change.__qualname__}")

    def write(self):
        if not self.isSet(self.function):
            raise ValueError("only a function with a name in a module can be saved")
        return super().write()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.change is None:
            module, name = self.getOrDefault(self.function).split(":")
            self.change = reduce(getattr, name.split("."), import_module(module))
        return self.change(dataset)


# ---------------------------------------------------------------- nearest neighbours


#: Labelled rows that the driver or a task holds at once; more are met block by block.
LABELLED_ROWS = 50_000
#: Distances that a task holds at once; ranks and sums of squares take as much again each.
DISTANCE_BYTES = 16 << 20
#: Width around the k-th distance, by the squared lengths, in which rounding may change the order.
ROUNDING = 1e-9


def _at_once(labelled: int, block: int) -> int:
    """Rows whose distances to all labelled ones are taken together."""
    return max(1, min(block, DISTANCE_BYTES // (8 * max(labelled, 1))))


def knn_predict(
    train: DataFrame, test: DataFrame, k: int = 3, most: int = LABELLED_ROWS, block: int = 500
) -> DataFrame:
    """Vote of the k nearest neighbours of ``vec_id, embedding`` among ``vec_id, embedding,
    label``; a row is not its own neighbour.

    Every row meets every labelled one. Labelled rows are stored in the order of their ids and
    sent to the tasks in blocks of ``most``, so neither the driver nor a task holds more at once;
    rows to be labelled stay where they are, and only the nearest of each block are shuffled.
    Distances are exact; equal ones go to the smaller id, equal votes to the smaller label.
    """
    ordered = runtime.number_rows(
        train.select("vec_id", "embedding", "label"), [F.col("vec_id").asc_nulls_last()], "place", "ordered"
    )
    labelled = runtime.materialize(ordered, "labelled")
    size = labelled.count()
    if not size:
        raise ValueError("no labelled rows to look for neighbours in")
    # a row is known by its number, as its id may repeat
    rows = test.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    if size > most:
        rows = runtime.materialize(rows, "unlabelled")
    parts = []
    for first in range(1, size + 1, most):
        some = labelled.where(F.col("place").between(first, first + most - 1))
        near = _nearest(rows, some.select("place", "vec_id", "embedding"), k, block)
        parts.append(runtime.materialize(near, "nearest") if size > most else near)
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        found = found.groupBy("row").agg(
            F.first("vec_id").alias("vec_id"), F.flatten(F.collect_list("near")).alias("near")
        )
    best = F.slice(F.array_sort("near"), 1, k)
    best = found.select("row", "vec_id", F.explode_outer(best["place"]).alias("place"))
    votes = best.join(labelled.select("place", "label"), "place", "left").groupBy("row", "label").agg(
        F.first("vec_id").alias("vec_id"), F.count("place").alias("n")
    )
    first = F.min(F.struct((-F.col("n")).alias("n"), F.isnull("label").alias("none"), "label")).alias("v")
    voted = votes.groupBy("row").agg(F.first("vec_id").alias("vec_id"), first)
    # a row that meets none but itself gets the smallest label
    least = F.broadcast(labelled.agg(F.min("label").alias("least")))
    pred = F.when(F.col("v.n") == 0, F.col("least")).otherwise(F.col("v.label"))
    return voted.crossJoin(least).select("vec_id", pred.alias("pred"))


def _nearest(rows: DataFrame, labelled: DataFrame, k: int, block: int) -> DataFrame:
    """row, vec_id and near: distance and place of the k nearest of some labelled rows."""
    own = labelled.toPandas().sort_values("place")
    model = rows.sparkSession.sparkContext.broadcast(
        (
            np.stack(own["embedding"].to_numpy()).astype("float64"),
            own["vec_id"].to_numpy(),
            own["place"].to_numpy(),
        )
    )
    step = _at_once(len(own), block)

    def run(batches):
        y, ids, places = model.value
        squares = (y * y).sum(1)
        most = squares[np.isfinite(squares)].max(initial=0.0)
        last, pairs = min(k, len(y)) - 1, max(1, DISTANCE_BYTES // (8 * max(y.shape[1], 1)))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                x = np.stack(part["embedding"].to_numpy()).astype("float64")
                square = (x * x).sum(1)
                far = square[:, None] + squares[None, :] - 2 * x @ y.T
                far[part["vec_id"].to_numpy()[:, None] == ids[None, :]] = np.inf
                edge = np.partition(far, last, axis=1)[:, last] + ROUNDING * (square + most)
                r, c = np.nonzero((far <= edge[:, None]) & np.isfinite(far))
                # the same two vectors have the same distance in any block
                d = np.concatenate(
                    [np.zeros(0)]
                    + [
                        np.sqrt(((x[r[i : i + pairs]] - y[c[i : i + pairs]]) ** 2).sum(1))
                        for i in range(0, len(r), pairs)
                    ]
                )
                order = np.lexsort((c, d, r))
                order = order[np.arange(len(r)) - np.searchsorted(r, r) < k]
                cuts = np.searchsorted(r[order], np.arange(1, len(part)))
                yield pd.DataFrame(
                    {
                        "row": part["row"].to_numpy(),
                        "vec_id": part["vec_id"].to_numpy(),
                        "d": np.split(d[order], cuts),
                        "place": np.split(places[c[order]], cuts),
                    }
                )

    found = rows.mapInPandas(run, "row long, vec_id long, d array<double>, place array<long>")
    return found.select("row", "vec_id", F.arrays_zip("d", "place").alias("near"))


# ---------------------------------------------------------------- cross-validation


def _figures(pairs: DataFrame) -> dict[str, float]:
    """Headline and per-class F, from three aggregated rows."""
    f = {r["label"]: r["f"] for r in evaluate.class_scores(pairs, classes=LABELS).collect()}
    return {
        "score": (f.get(1, 0.0) + f.get(-1, 0.0)) / 2,
        "f_neg": f.get(-1, 0.0),
        "f_neu": f.get(0, 0.0),
        "f_pos": f.get(1, 0.0),
    }


def _score_table(spark, rows: Sequence[tuple]) -> DataFrame:
    return runtime.local_table(spark, rows, "model string, fold int, metric string, value double")


def _external(figures: Mapping[str, float]) -> dict[str, float]:
    out = {f"external_{k}": v for k, v in figures.items() if k != "score"}
    out["external_score"] = figures["score"]
    return out


def _fold_scores(
    spec: ModelSpec, train: DataFrame, external: DataFrame, fold: int, name: str
) -> list[tuple]:
    model = fit_model(train.where(F.col("fold") != fold), spec)
    held = _figures(predict(model, train.where(F.col("fold") == fold)))
    values = {"cv_score": held["score"], **_external(_figures(predict(model, external)))}
    return [(name, fold, metric, float(v)) for metric, v in values.items()]


def cross_validate(
    spec: ModelSpec, train: DataFrame, external: DataFrame, folds: int = FOLDS,
    name: str | None = None, threads: int = 4,
) -> DataFrame:
    """Fit on all folds but one; score the held-out fold and the external set.

    ``train`` is a stored vector table with ``fold``. Fits run on the executors; the
    driver only keeps a few submitted at a time. Naive Bayes is fitted for all folds at once.
    """
    if spec.name == "multinomial_nb":
        alpha = spec.params.get("alpha", bayes.SMOOTHING)
        cells = bayes.cross_validate(train, external, _size(train), folds, alpha)
        rows = []
        for fold, (held, outer) in enumerate(cells):
            neg, _, pos = batch.f_scores(held)
            f = dict(zip(("f_neg", "f_neu", "f_pos"), batch.f_scores(outer)))
            values = {"cv_score": (neg + pos) / 2}
            values |= _external({**f, "score": (f["f_neg"] + f["f_pos"]) / 2})
            rows += [(name or spec.name, fold, metric, v) for metric, v in values.items()]
        return _score_table(train.sparkSession, rows)
    found = _queue({name or spec.name: spec}, train, external, folds, threads)
    return found.select(F.col("key").alias("model"), "fold", "metric", "value")


def _queue(
    specs: Mapping[str, ModelSpec], train: DataFrame, external: DataFrame, folds: int, threads: int = 4
) -> DataFrame:
    """key, model, fold, metric, value of all fits of several models, a few in flight."""

    def run(at: tuple[str, int]) -> list[tuple]:
        key, fold = at
        return [(key, *r) for r in _fold_scores(specs[key], train, external, fold, specs[key].name)]

    with ThreadPool(threads) as pool:
        rows = [r for part in pool.map(run, list(product(specs, range(folds))), 1) for r in part]
    return runtime.local_table(
        train.sparkSession, rows, "key string, model string, fold int, metric string, value double"
    )


def repeat_fit(
    spec: ModelSpec, train: DataFrame, test: DataFrame, seeds: Sequence[int] = range(FOLDS)
) -> DataFrame:
    """Fit on the whole training set once per seed; score training and test set."""
    rows = []
    for seed in seeds:
        model = fit_model(train, ModelSpec(spec.name, {**spec.params, "seed": seed}))
        values = {
            "train_score": _figures(predict(model, train))["score"],
            **_external(_figures(predict(model, test))),
        }
        rows += [(spec.name, int(seed), m, float(v)) for m, v in values.items()]
    return _score_table(train.sparkSession, rows)


def compare_models(
    train: DataFrame, external: DataFrame, models: Sequence[ModelSpec] = DEFAULT_MODELS,
    folds: int = FOLDS,
) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [cross_validate(m, train, external, folds) for m in models]
    )


def _tables(
    features: DataFrame, train: DataFrame, external: DataFrame, vocabulary: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Vector tables of both splits over the names of the training split."""
    own = features.join(train.select("doc_id"), "doc_id", "left_semi")
    if vocabulary is None:
        vocabulary = runtime.materialize(feature_index(own), "vocabulary")
    return (
        vector_table(own, train, vocabulary),
        vector_table(
            features.join(external.select("doc_id"), "doc_id", "left_semi"), external, vocabulary
        ),
    )


def _size(table: DataFrame) -> int:
    """Features of a vector table."""
    first = table.select("features").first()
    return first["features"].size if first else 1


def _subsets(
    features: DataFrame, train: DataFrame, external: DataFrame, subsets: Mapping[str, DataFrame],
    models: Sequence[ModelSpec], folds: int,
) -> DataFrame:
    """key, model, fold, metric, value for several sets of names (key: names) of one table.

    Linear models are fitted together over one vector table, a subset being a set of indices;
    any other model gets a table of its own per subset.
    """
    parts = []
    batched = [m for m in models if m.name in batch.SERVED]
    if batched:
        own = features.join(train.select("doc_id"), "doc_id", "left_semi")
        vocabulary = runtime.materialize(feature_index(own), "vocabulary")
        tables = _tables(features, train, external, vocabulary)
        jobs = []
        for key, names in subsets.items():
            # no more indices than the coefficients that the driver holds
            found = vocabulary.join(names.select("name"), "name", "left_semi").select("idx").toPandas()
            chosen = batch.ranges(np.sort(found["idx"].to_numpy()))
            jobs += [batch.Job(key, m.name, m.params, chosen) for m in batched]
        parts.append(batch.cross_validate(jobs, *tables, _size(tables[0]), folds))
    others = [m for m in models if m.name not in batch.SERVED]
    if others:
        for key, names in subsets.items():
            tables = _tables(select.keep_selected(features, names), train, external)
            scores = compare_models(*tables, others, folds)
            parts.append(scores.select(F.lit(key).alias("key"), *scores.columns))
    return reduce(DataFrame.unionByName, parts)


def percentile_sweep(
    features: DataFrame, train: DataFrame, external: DataFrame, percents: Sequence[float],
    models: Sequence[ModelSpec], scorer: Scorer = select.score_chi2, folds: int = FOLDS,
) -> DataFrame:
    """Scores for every share of selected features; the selection sees training rows only."""
    scores = runtime.materialize(scorer(features, train), "scores")
    chosen = {str(float(p)): select.select_percentile(scores, p) for p in percents}
    found = _subsets(features, train, external, chosen, models, folds)
    return found.withColumn("percent", F.col("key").cast("double")).drop("key")


def ablate(
    features: DataFrame, train: DataFrame, external: DataFrame, by: str, values: Sequence[str],
    spec: ModelSpec, folds: int = FOLDS, base: DataFrame | None = None,
) -> DataFrame:
    """One statistic or one dimension at a time, next to the ``base`` block if there is one.

    ``features`` has the columns ``stat`` and ``dim`` (see ``stat_and_dim``); emotion and
    opinion statistics of one kind go by one name.
    """
    if by not in ("stat", "dim"):
        raise ValueError("ablate by 'stat' or 'dim'")
    every = features.select("doc_id", "name", "value")
    kept = features.select("name", by).distinct()
    kept = runtime.materialize(kept, "statistics")
    subsets = {v: kept.where(F.col(by) == v).select("name") for v in values}
    if base is not None:
        every = every.unionByName(base.select("doc_id", "name", "value"))
        names = runtime.materialize(base.select("name").distinct(), "base-names")
        subsets = {v: own.unionByName(names) for v, own in subsets.items()}
    found = _subsets(every, train, external, subsets, (spec,), folds)
    return found.withColumnRenamed("key", "kept")


def stat_and_dim(features: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """``stat`` and ``dim`` of lexicon features, read off the end of their names.

    A name ends in its statistic, that of an emotion lexicon in dimension and statistic.
    """
    last = F.substring_index("name", "_", -1)
    before = F.substring_index(F.substring_index("name", "_", -2), "_", 1)
    one_name = F.create_map(*[F.lit(x) for pair in STAT_NAMES.items() for x in pair])
    known = before.isin(list(dims)) if dims else F.lit(False)
    return features.withColumns(
        {"stat": F.coalesce(F.try_element_at(one_name, last), last), "dim": F.when(known, before)}
    )


#: The statistic that a feature of any family belongs to, by the end of its name.
STAT_NAMES = {
    "summ": "sum", "minn": "min", "maxn": "max", "count": "amounts", "negamt": "amounts",
    "posamt": "amounts", "fpol": "final", "tot": "sum", "tre": "thresh", "DECISION": "decision",
}


#: Masks that are decoded and fitted together.
MASKS_AT_ONCE = 64


def evaluate_masks(
    features: DataFrame, masks: DataFrame, train: DataFrame, external: DataFrame,
    block_order: Sequence[str], memo: str | None = None, base: DataFrame | None = None,
    models: Sequence[ModelSpec] = DEFAULT_MODELS, folds: int = FOLDS,
) -> DataFrame:
    """The best model of every mask: mask, cv_score, external_score, model.

    All blocks (and ``base``, which every mask has) become one vector table, in which a block
    is a range of indices and a mask a set of ranges; the linear models of many masks are
    fitted together. ``memo`` is the folder of a table of earlier results: masks in it are not
    fitted again, and new ones are added to it.
    """
    spark = features.sparkSession
    wanted = runtime.materialize(masks.select("mask").distinct(), "masks")
    known = _memo(spark, memo)
    todo = wanted if known is None else wanted.join(known, "mask", "left_anti")
    parts = [] if known is None else [known.join(wanted, "mask", "left_semi")]
    tables = None
    for names in _chunks((r["mask"] for r in todo.orderBy("mask").toLocalIterator()), MASKS_AT_ONCE):
        if tables is None:
            tables, places = _block_tables(features, train, external, base)
        jobs = {}
        for mask in names:
            bits = [bit.strip() == "1" for bit in mask.strip("[] ").split(",")]
            on = [b for b, bit in zip(block_order, bits) if bit]
            jobs[mask] = tuple(sorted(places[b] for b in (*on, BASE) if b in places))
        found = runtime.materialize(_best_models(jobs, tables, models, folds), "mask-scores")
        if memo is not None:
            found.write.mode("append").parquet(memo)
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], MEMO)
    return reduce(DataFrame.unionByName, parts)


BASE = "BASE"
MEMO = "mask string, cv_score double, external_score double, model string"


def _memo(spark, path: str | None) -> DataFrame | None:
    if path is None:
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    # a search that ran twice may have left a mask twice
    return spark.read.schema(MEMO).parquet(path).dropDuplicates(["mask"])


def _chunks(items, size: int):
    own = []
    for item in items:
        own.append(item)
        if len(own) == size:
            yield own
            own = []
    if own:
        yield own


def _block_tables(
    features: DataFrame, train: DataFrame, external: DataFrame, base: DataFrame | None
) -> tuple[tuple[DataFrame, DataFrame], dict[str, tuple[int, int]]]:
    """Vector tables of all blocks side by side, and the range of indices of each."""
    rows = features.select("doc_id", "block", "name", "value")
    if base is not None:
        rows = rows.unionByName(base.select("doc_id", F.lit(BASE).alias("block"), "name", "value"))
    rows = align.concat_blocks(rows)  # names begin with their block, so a block's stand together
    own = rows.join(train.select("doc_id"), "doc_id", "left_semi")
    vocabulary = runtime.materialize(feature_index(own), "vocabulary")
    ends = vocabulary.groupBy(F.substring_index("name", ":", 1).alias("block")).agg(
        F.min("idx").alias("first"), F.max("idx").alias("last")
    )
    places = {r["block"]: (r["first"], r["last"] + 1) for r in ends.collect()}  # a row per block
    return _tables(rows.select("doc_id", "name", "value"), train, external, vocabulary), places


def slice_features(table: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """A vector table with the features of some ranges of indices only, moved together."""
    chosen = [i for start, end in ranges for i in range(start, end)]
    if not chosen:  # a vector has one feature at least
        return table.withColumn("features", array_to_vector(F.array(F.lit(0.0))))
    sliced = VectorSlicer(inputCol="features", outputCol="_own", indices=chosen).transform(table)
    return sliced.drop("features").withColumnRenamed("_own", "features")


def _best_models(
    jobs: Mapping[str, tuple[tuple[int, int], ...]], tables: tuple[DataFrame, DataFrame],
    models: Sequence[ModelSpec], folds: int,
) -> DataFrame:
    batched = [m for m in models if m.name in batch.SERVED]
    parts = []
    if batched:
        each = [
            batch.Job(key, m.name, m.params, ranges) for key, ranges in jobs.items() for m in batched
        ]
        parts.append(batch.cross_validate(each, *tables, _size(tables[0]), folds))
    for spec in (m for m in models if m.name not in batch.SERVED):
        for key, ranges in jobs.items():
            own = [slice_features(t, ranges) for t in tables]
            scores = cross_validate(spec, *own, folds)
            parts.append(scores.select(F.lit(key).alias("key"), *scores.columns))
    scores = reduce(DataFrame.unionByName, parts)
    wide = scores.groupBy("key", "model").pivot("metric", ["cv_score", "external_score"]).agg(
        F.avg("value")
    )
    order = Window.partitionBy("key").orderBy(F.desc("external_score"), "model")
    best = wide.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return best.select(F.col("key").alias("mask"), "cv_score", "external_score", "model")


def grid_search(
    name: str, grid: Mapping[str, Sequence], train: DataFrame, external: DataFrame,
    folds: int = FOLDS,
) -> DataFrame:
    """Scores of every parameter combination, summarized over the folds.

    Linear models are fitted together, points that differ in ``max_iter`` in one run; of any
    other model all fits of all points are in one queue.
    """
    keys = sorted(grid)
    points = {}
    for values in product(*[grid[k] for k in keys]):
        params = dict(zip(keys, values))
        points[", ".join(f"{k}={v}" for k, v in params.items())] = params
    if name in batch.SERVED:
        jobs = [batch.Job(label, name, params) for label, params in points.items()]
        scores = batch.cross_validate(jobs, train, external, _size(train), folds)
    else:
        specs = {label: ModelSpec(name, params) for label, params in points.items()}
        scores = _queue(specs, train, external, folds)
    summed = scores.groupBy("model", "metric", "key").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    return summed.withColumnRenamed("key", "params")


def eliminate(
    features: DataFrame, train: DataFrame, external: DataFrame, drop_share: float = 0.5,
    folds: int = 2, spec: ModelSpec = ModelSpec("linear_svc"), fold: str = "fold",
) -> tuple[DataFrame, DataFrame]:
    """Recursive elimination: steps (features, cv_score, external_score, best) and the rank of
    every feature (name, left, chosen).

    Each of ``folds`` parts is left out in turn; the others are fitted, lose the share of
    features with the least squared weights and are fitted again, down to one feature, and
    every model is scored on the part that it has not seen. The size with the best mean score
    (the smaller one of equals) is chosen, and the elimination over all training rows says
    which features those are: ``left`` is the smallest set that a feature is in. All fits of a
    step are one batch.
    """
    spark = features.sparkSession
    parts = train.withColumn("fold", F.col(fold) % folds)
    own = features.join(train.select("doc_id"), "doc_id", "left_semi")
    vocabulary = runtime.materialize(feature_index(own), "vocabulary")
    tables = _tables(features, parts, external, vocabulary)
    size = _size(tables[0])
    rows = batch.sparse_rows(*tables)
    sizes = batch.class_sizes(rows, folds)
    held = [*range(folds), None]
    alive = {i: np.arange(size) for i in held}
    left = np.full(size, size)
    steps = []
    while True:
        jobs = [
            (batch.Job("", spec.name, spec.params, batch.ranges(alive[i])).settings(), i) for i in held
        ]
        end = batch.Job("", spec.name, spec.params).iterations()
        fitted = [x[end] for x in batch.fit(rows, size, jobs, [{end}] * len(jobs), sizes)]
        cells = batch.confusions(rows, size, list(zip(fitted, held)))
        scored = [batch.f_scores(c[0]) for c in cells[:-1]]
        outer = batch.f_scores(cells[-1][1])
        n = len(alive[None])
        steps.append((n, float(np.mean([(f[0] + f[2]) / 2 for f in scored])), (outer[0] + outer[2]) / 2))
        left[alive[None]] = n
        if n < 2:
            break
        keep = max(1, min(n - 1, int(np.ceil(n * (1 - drop_share)))))
        for i, x in zip(held, fitted):
            weight = (x[:, :-1] ** 2).sum(axis=0)[alive[i]]
            best = np.argsort(-weight, kind="stable")[:keep]
            alive[i] = np.sort(alive[i][best])
    best = max(steps, key=lambda s: (s[1], -s[0]))[0]
    table = runtime.local_table(
        spark, [(*s, s[0] == best) for s in steps],
        "features int, cv_score double, external_score double, best boolean",
    )
    ranks = spark.createDataFrame(
        pd.DataFrame({"idx": np.arange(size, dtype="int32"), "left": left.astype("int32")})
    )
    ranked = vocabulary.join(ranks, "idx").select("name", "left", (F.col("left") <= best).alias("chosen"))
    return table, ranked


def compare_tokenizers(
    messages: DataFrame, external: DataFrame, modes: Sequence[str], spec: ModelSpec,
    folds: int = FOLDS,
) -> DataFrame:
    """The same model on the word counts of several tokenizers."""
    from moodmill.operators import corpus, profile

    parts = []
    for mode in modes:
        both = messages.select("doc_id", "text").unionByName(external.select("doc_id", "text"))
        bag = runtime.materialize(profile.bag_of_words(corpus.tokenize(both, mode)), "bag")
        scores = cross_validate(spec, *_tables(bag, messages, external), folds)
        parts.append(evaluate.summarize_scores(scores).withColumn("tokenizer", F.lit(mode)))
    return reduce(DataFrame.unionByName, parts)


def token_alignment(messages: DataFrame, modes: Sequence[str]) -> DataFrame:
    """The token lists of several tokenizers side by side, by position."""
    from moodmill.operators import corpus

    zipped = F.arrays_zip(
        *[corpus.tokenizer(messages, m)(F.col("text")).alias(m) for m in modes]
    )
    rows = messages.select("doc_id", F.posexplode(zipped).alias("pos", "t"))
    return rows.select("doc_id", "pos", *[F.col(f"t.{m}").alias(m) for m in modes])
