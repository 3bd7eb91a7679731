"""A pipeline from text to predictions: fitted, saved, and read in another session."""

from __future__ import annotations

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from moodmill.config import CleanSpec, LexiconSpec, ModelSpec
from moodmill.operators import lexicon, models, pipeline, select
from moodmill.operators import profile as R
from moodmill.plans.modeling import squeezed

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SPECS = (LexiconSpec("OPI", negated=True), LexiconSpec("EMO", opinion=False))
LEXICON = [
    ("OPI", "fine", "polarity", 1.0),
    ("OPI", "awful", "polarity", -2.0),
    ("EMO", "fine", "joy", 0.5),
    ("EMO", "tears", "sad", 1.0),
]


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(1)
    own = {1: ["fine", "good", "sun"], -1: ["awful", "tears", "rain"], 0: ["table", "noon", "road"]}
    rows = []
    for i in range(90):
        label = (1, -1, 0)[i % 3]
        words = rng.choices(own[label], k=3) + rng.choices(["the", "a", "of", "not", "and"], k=5)
        rng.shuffle(words)
        rows.append((i, " ".join(words), label))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def stages(spark, n, model=ModelSpec("multinomial_nb"), percent=50.0):
    lexicons = pipeline.LexiconStats(lexicon.inline_lexicon(spark, LEXICON), SPECS)
    words = pipeline.WordCounts(percent=percent)
    return pipeline.text_pipeline(n, CleanSpec(tokenizer="space"), words, lexicons, model)


NEW = [(1000, "not awful , fine sun"), (1001, ""), (1002, "tears tears rain"), (1003, "unseen words")]


def predicted(fitted, spark):
    new = spark.createDataFrame(NEW, "doc_id long, text string")
    return {r["doc_id"]: r["pred"] for r in pipeline.predictions(fitted, new).collect()}


LOAD = """
import json, sys
sys.path.insert(0, {root!r})
from pyspark.ml import PipelineModel
from moodmill.operators import pipeline
from moodmill.session import local_session
spark = local_session("other", 2)
new = spark.createDataFrame({new!r}, "doc_id long, text string")
fitted = PipelineModel.load({path!r})
print("FOUND", json.dumps({{r["doc_id"]: r["pred"] for r in pipeline.predictions(fitted, new).collect()}}))
"""


def test_saved_pipeline_predicts_the_same_in_another_process(spark, messages, tmp_path):
    whole = Pipeline(stages=[models.FunctionTransformer(squeezed), *stages(spark, 90).getStages()])
    fitted = whole.fit(messages)
    want = predicted(fitted, spark)
    assert want[1000] == 1 and want[1002] == -1 and set(want) == {1000, 1001, 1002, 1003}
    path = f"file://{tmp_path}/model"
    fitted.write().save(path)
    code = LOAD.format(root=ROOT, new=NEW, path=path)
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    line = next(x for x in run.stdout.splitlines() if x.startswith("FOUND"))
    assert {int(k): v for k, v in json.loads(line[6:]).items()} == want
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        fitted.write().save(path)


def test_blocks_are_what_the_long_tables_say(spark, messages):
    """The assembled vector against counts, selection and statistics put together by hand."""
    fitted = stages(spark, 90).fit(messages)
    names, sizes = [], []
    for stage in fitted.stages:
        if isinstance(stage, pipeline._BlockModel):
            own = {r["idx"]: r["name"] for r in stage.tables["vocabulary"].collect()}
            names.append([own[i] for i in range(len(own))])
            sizes.append(stage.getOrDefault(stage.size))
    assert list(map(len, names)) == sizes
    docs = pipeline.corpus.clean(messages, CleanSpec(tokenizer="space"))
    bag = R.bag_of_words(docs)
    chosen = select.select_percentile(select.score_chi2(bag, messages), 50.0)
    assert sorted(names[0]) == sorted(r["name"] for r in chosen.collect())
    stats = lexicon.lexicon_features(docs.select("doc_id", "toks"), lexicon.inline_lexicon(spark, LEXICON), SPECS)
    want = {(r["doc_id"], "w", r["name"]): r["value"] for r in select.keep_selected(bag, chosen).collect()}
    want |= {(r["doc_id"], "l", r["name"]): r["value"] for r in stats.collect() if r["value"]}
    got = {}
    rows = PipelineModel(fitted.stages[:4]).transform(messages)
    for r in rows.select("doc_id", vector_to_array("features").alias("v")).collect():
        assert len(r["v"]) == sum(sizes)
        for i, value in enumerate(r["v"]):
            block, at = ("w", i) if i < sizes[0] else ("l", i - sizes[0])
            if value:
                got[r["doc_id"], block, names[block == "l"][at]] = value
    assert got == want


def test_own_and_sparks_models_are_saved_with_the_pipeline(spark, messages, tmp_path):
    for name in ("ridge", "tree"):
        fitted = stages(spark, 90, ModelSpec(name), 100.0).fit(messages)
        path = f"file://{tmp_path}/{name}"
        fitted.write().save(path)
        assert predicted(PipelineModel.load(path), spark) == predicted(fitted, spark)


def test_a_nameless_function_runs_but_is_not_saved(spark, messages, tmp_path):
    step = models.FunctionTransformer(lambda df: df.withColumn("twice", F.col("doc_id") * 2))
    assert step.transform(messages).where("twice = 2 * doc_id").count() == 90
    with pytest.raises(ValueError, match="name in a module"):
        step.write().save(f"file://{tmp_path}/step")
