"""Goldens of lookup, scoring, selection and the placement helpers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodmill import runtime
from moodmill.config import LEXICONS, MASK_ORDER, LexiconSpec
from moodmill.operators import corpus as C
from moodmill.operators import evaluate as E
from moodmill.operators import lexicon as L
from moodmill.operators import models as M
from moodmill.operators import select as S

OPINION = [("LEX", t, "polarity", v) for t, v in (("good", 2.0), ("bad", -1.0), ("meh", 0.0))]
EMOTION = [("EMO", "happy", "joy", 1.0), ("EMO", "happy", "trust", 0.5), ("EMO", "sad", "joy", -1.0)]


def docs(spark, *texts):
    rows = [(i, t.split(" ")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, toks array<string>")


def test_opinion_set_and_bag(spark):
    table = docs(spark, "good bad good NEG_good meh zzz", "nothing here")
    lex = L.inline_lexicon(spark, OPINION)
    hits = L.match_terms(table, lex, [LexiconSpec("LEX")])
    stats = {r["doc_id"]: r for r in L.opinion_features(hits, table, ["LEX"]).collect()}
    got = stats[0]
    assert (got["sum"], got["min"], got["max"]) == (-1, -2, 2)
    assert got["avg"] == pytest.approx(-1 / 3)
    assert (got["negamt"], got["posamt"], got["fpol"]) == (2, 1, -1)
    assert [stats[1][c] for c in ("avg", "sum", "min", "max", "negamt", "posamt", "fpol")] == [0] * 7
    bag = L.lexicon_sums(L.match_terms(table, lex, mode="bag")).collect()
    assert [(r["name"], r["value"]) for r in bag] == [("SUM_LEX", 3.0)]


def test_large_lexicon_is_not_broadcast(spark, monkeypatch):
    table = docs(spark, "good bad", "bad bad")
    lex = L.inline_lexicon(spark, OPINION)
    monkeypatch.setattr(runtime.small_side, "__defaults__", (1, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = L.match_terms(table, lex, [LexiconSpec("LEX")])
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert sorted((r["doc_id"], r["gram"]) for r in hits.collect()) == [
            (0, "bad"), (0, "good"), (1, "bad"),
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("mode", ["set", "bag"])
def test_only_grams_that_may_match_are_built(spark, monkeypatch, mode):
    rng = np.random.default_rng(3)
    words = ["a", "b", "NEG_a", "c", "", "x---", "---b", ". .", "NEG_", "___", None]
    lists = []
    for size in [0, 1, 2, 3, 4] * 8 + [12] * 60:
        some = rng.choice(len(words), 4)  # few words each, so that marks and nulls are not everywhere
        lists.append([words[i] for i in rng.choice(some, size)])
    rows = [(i, toks) for i, toks in enumerate([*lists, None])]
    table = spark.createDataFrame(rows, "doc_id long, toks array<string>")
    terms = ["a", "a b", " a", ". . b", "a---b", "a b---c", "---b c", "---a", "a b c", "a_a", "b---", "--- a", "c  a"]
    lex = L.inline_lexicon(spark, [("LEX", t, "polarity", float(i + 1)) for i, t in enumerate(terms)])
    specs = [
        LexiconSpec("LEX", bigrams=True, trigrams=True, gapped=True),
        LexiconSpec("LEX", bigrams=True, trigrams=True, joiner="_"),
    ]
    for spec in specs[: 1 if mode == "bag" else 2]:
        some = sorted(map(str, L.match_terms(table, lex, [spec], mode).collect()))
        with monkeypatch.context() as m:
            m.setattr(L, "LISTED_ROWS", -1)
            every = sorted(map(str, L.match_terms(table, lex, [spec], mode).collect()))
        assert some == every and len(some) > 50
    if mode == "set":
        found = [L.match_specs(table, lex, [spec]).collect()]
        with monkeypatch.context() as m:
            m.setattr(L, "LISTED_ROWS", -1)
            found.append(L.match_specs(table, lex, [spec]).collect())
        assert sorted(map(str, found[0])) == sorted(map(str, found[1])) and len(found[0]) > 20
    many = docs(spark, " ".join("defghijk" * 20) + " a b c d")
    begins = L._begins(L.effective(lex), "term", L.KINDS)
    assert C.gram_forms(many, L.KINDS).count() > 1000
    assert C.gram_forms(many, L.KINDS, begins=begins).count() < 30


def test_stored_text_is_dealt_over_the_cores(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    cores = spark.sparkContext.defaultParallelism
    stored = runtime.materialize(runtime.dealt(rows.join(rows.select("doc_id"), "doc_id"), "doc_id"))
    assert len(stored.inputFiles()) >= cores > 1
    assert stored.count() == 400


def test_emotion(spark):
    table = docs(spark, "happy sad", "none")
    hits = L.match_terms(
        table, L.inline_lexicon(spark, EMOTION), [LexiconSpec("EMO", opinion=False)]
    )
    rows = {r["dim"]: r for r in L.emotion_features(hits).collect()}
    assert (rows["joy"]["avg"], rows["joy"]["count"], rows["trust"]["count"]) == (0, 2, 1)
    strict = {r["dim"]: r["count"] for r in L.emotion_features(hits, positive_only=True).collect()}
    assert strict == {"joy": 1, "trust": 1}


def test_tag_collapse(spark):
    tagged = spark.createDataFrame(
        [(0, 0, "run", "NN"), (0, 1, "run", "VB"), (0, 2, "run", "DT")],
        "doc_id long, pos int, tok string, tag string",
    )
    lex = L.inline_lexicon(
        spark, [("K", "run#NOUN", "joy", 1.0), ("K", "run#VERB", "joy", 2.0), ("K", "run.n", "joy", 3.0)]
    )
    assert [tuple(r) for r in L.match_tagged(tagged, lex, "hash").collect()] == [
        (0, "K", "run", "joy", 2.0)
    ]
    assert [r["value"] for r in L.match_tagged(tagged, lex, "dot").collect()] == [3.0]


@pytest.mark.parametrize(
    ("value", "label", "agrees"), [(0.1, 0, 0), (0.05, 0, 1), (0.2, 1, 1), (-0.2, 0, 0)]
)
def test_agreement(spark, value, label, agrees):
    sums = spark.createDataFrame([(1, value)], "doc_id long, value double")
    labels = spark.createDataFrame([(1, label)], "doc_id long, label int")
    assert L.lexicon_agreement(sums, labels).first()["agrees"] == agrees


def test_scorer(spark):
    gold = [(1, "positive"), (2, "positive"), (3, "negative"), (4, "neutral"), (5, "negative")]
    pred = [(1, "positive"), (2, "negative"), (3, "negative"), (4, "positive"), (6, "neutral")]
    from moodmill.operators import align

    pairs, missing = align.gold_pairs(
        spark.createDataFrame(gold, "sid long, label string"),
        spark.createDataFrame(pred, "sid long, label string"),
    )
    scores = {r["label"]: r for r in E.class_scores(pairs).collect()}
    for label in ("positive", "negative"):
        assert [scores[label][c] for c in ("precision", "recall", "f")] == [0.5, 0.5, 0.5]
    assert scores["neutral"]["f"] == 0
    assert E.headline_score(pairs).first()["score"] == 0.5
    assert [r["sid"] for r in missing.collect()] == [5]
    cells = E.confusion(pairs).collect()
    assert sum(r[c] for r in cells for c in ("positive", "negative", "neutral")) == 4


def test_submission_format(spark):
    lines = "line_no long, value string"
    gold = spark.createDataFrame([(1, "NA\tT1\tpositive"), (2, "NA\tT2\tneutral")], lines)
    good = spark.createDataFrame([(1, "NA\t1\tpositive\tx"), (2, " NA\t2\tnegative ")], lines)
    assert E.submission_pairs(good, gold, 2).count() == 2
    with pytest.raises(ValueError):
        E.submission_pairs(good, gold, 3)
    bad = spark.createDataFrame([(1, "NA\t1\tpositive"), (2, "NA\t7\tnegative")], lines)
    with pytest.raises(Exception, match="wrong file format"):
        E.submission_pairs(bad, gold).collect()


def test_chi2(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, -1)], "doc_id long, label int")
    rows = [(1, "f", 2.0), (3, "f", 1.0), (3, "g", 3.0)]
    features = spark.createDataFrame(rows, "doc_id long, name string, value double")
    scores = {r["name"]: r["score"] for r in S.score_chi2(features, labels).collect()}
    assert scores["f"] == pytest.approx(0) and scores["g"] == pytest.approx(6)


def test_t_test(spark):
    schema = "model string, metric string, mean double, std double"
    a = spark.createDataFrame([("m", "s", 0.50, 0.02)], schema)
    b = spark.createDataFrame([("m", "s", 0.52, 0.02)], schema)
    row = E.t_test(a, b).first()
    assert row["t"] == pytest.approx(-2.2360680) and row["df"] == 18 and row["significant"]
    # the tail of the t density, integrated numerically
    x = np.linspace(0, abs(row["t"]), 200_001)
    density = (1 + x * x / 18) ** -9.5
    scale = math.gamma(9.5) / (math.sqrt(18 * math.pi) * math.gamma(9))
    assert row["p"] == pytest.approx(1 - 2 * scale * np.trapezoid(density, x), abs=1e-6)


def reference_selection(scores: np.ndarray, percent: float) -> set[int]:
    edge = np.percentile(scores, 100 - percent)
    keep = scores > edge
    ties = np.where(scores == edge)[0]
    if len(ties):
        room = max(int(len(scores) * percent / 100) - keep.sum(), 0)
        keep[ties[:room]] = True
    return set(np.where(keep)[0])


@pytest.mark.parametrize("percent", [5, 30, 50, 100])
def test_select_percentile(spark, percent):
    scores = np.array([0, 0, 0, 0, 1, 2, 2, 2, 5, 7, 7], dtype=float)
    rows = [(f"n{i:02d}", float(s)) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "name string, score double")
    got = {int(r["name"][1:]) for r in S.select_percentile(df, percent).collect()}
    assert got == reference_selection(scores, percent)


def test_folds(spark):
    df = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label")
    )
    counts = E.stratified_folds(df, k=7).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_number_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    out = runtime.number_rows(df, [F.col("v")], "rn")
    assert out.where("rn <> v + 1").count() == 0 and out.count() == 5000


def test_line_numbers_over_several_files(spark, tmp_path):
    from moodmill.sources import readers

    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "b.txt").write_text("z\n")
    lines = readers.number_lines(readers.read_lines(spark, str(tmp_path)))
    assert {(r["line_no"], r["value"]) for r in lines.collect()} == {(1, "x"), (2, "y"), (3, "z")}


def test_nearest_neighbours_among_others(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(60, 4))
    rows = [(i, [float(x) for x in p], i % 3) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["pred"] for r in M.knn_predict(df, df.drop("label"), 3, block=16).collect()}
    for i, p in enumerate(points):
        near = np.argsort(((points - p) ** 2).sum(1), kind="stable")[1:4]  # not the row itself
        votes = np.bincount([j % 3 for j in near], minlength=3)
        assert got[i] == int(votes.argmax())


def test_distances_held_at_once_are_bounded():
    for labelled in (1, 2_000, M.LABELLED_ROWS, 10 * M.LABELLED_ROWS):
        rows = M._at_once(labelled, 500)
        assert 1 <= rows <= 500 and 8 * rows * labelled <= M.DISTANCE_BYTES


def test_mask_order():
    assert len(LEXICONS) == 16 and len(MASK_ORDER) == 17 and MASK_ORDER[0] == "BING"


def test_unknown_model(spark):
    from moodmill.config import ModelSpec

    with pytest.raises(ValueError):
        M._stages(ModelSpec("other").name, {}, 1)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        runtime.scratch_root(Session())


def test_part_files_follow_their_numbers(spark):
    from moodmill.sources.readers import file_order

    names = [f"file:/x/part-{i:05d}-abc.txt" for i in (99999, 100000, 5, 100001)]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    found = [r["p"] for r in rows.orderBy(file_order(F.col("p"))).collect()]
    assert found == [names[2], names[0], names[1], names[3]]


def test_last_line_of_the_second_download_wins(spark):
    from moodmill.sources.readers import repair_messages

    first = spark.createDataFrame(
        [("1", "u", "neutral", None)], "sid string, uid string, sentiment string, text string"
    )
    second = spark.createDataFrame(
        [("1", "u", "positive", "z early", 1), ("1", "u", "negative", "late", 2)],
        "sid string, uid string, sentiment string, text string, at long",
    )
    row = repair_messages(first, second).first()
    assert (row["sentiment"], row["text"]) == ("negative", "late")


def test_strict_join_fails_even_when_only_counted(spark):
    from moodmill.operators import align

    left = spark.createDataFrame([("1",), ("2",)], "sid string")
    side = spark.createDataFrame([("1", 0.5)], "sid string, x double")
    with pytest.raises(Exception, match="no category row"):
        align.attach_strict(left, side).count()


def test_constant_features_scale_to_zero(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame(
        [(Vectors.sparse(3, [0, 1], [2.0, 5.0]),), (Vectors.sparse(3, [1], [5.0]),)], ["features"]
    )
    # the second feature never changes, the third never occurs
    scaled = M.RangeScaler().fit(rows).transform(rows).collect()
    assert [r["scaled"].toArray().tolist() for r in scaled] == [[1, 0, 0], [0, 0, 0]]
    counts = spark.createDataFrame([(Vectors.sparse(9, [4], [3.0]),), (Vectors.sparse(9, [], []),)], ["features"])
    first = M.RangeScaler().fit(counts).transform(counts).first()["scaled"]
    assert first.indices.tolist() == [4] and first.values.tolist() == [1.0]


def test_ablation_reads_statistic_and_dimension(spark):
    names = ["LEX_sum", "EMO_joy_summ", "EMO_sad_maxn", "A_joy_B_sum"]
    rows = spark.createDataFrame([(1, n, 1.0) for n in names], "doc_id long, name string, value double")
    found = {r["name"]: (r["stat"], r["dim"]) for r in M.stat_and_dim(rows, ("joy", "sad")).collect()}
    assert found == {
        "LEX_sum": ("sum", None),
        "EMO_joy_summ": ("sum", "joy"),
        "EMO_sad_maxn": ("max", "sad"),
        "A_joy_B_sum": ("sum", None),
    }


def test_neighbours_leave_a_row_out_of_its_own_vote(spark):
    rows = spark.createDataFrame(
        [(1, [0.0, 0.0], 5), (2, [0.0, 0.1], 7), (3, [0.0, 0.2], 7), (4, [9.0, 9.0], 5)],
        "vec_id long, embedding array<double>, label int",
    )
    found = {r["vec_id"]: r["pred"] for r in M.knn_predict(rows, rows.drop("label"), k=1).collect()}
    assert found == {1: 7, 2: 5, 3: 7, 4: 7}


def test_tagged_lists_match_as_token_rows_do(spark):
    rows = [
        (1, ["run", "run", "far", "run"], ["NN", "VB", "RB", "NN"], ["NN", "VB", "JJ"]),
        (2, ["far"], ["RB"], []),
        (3, ["run", "far"], ["NN", "RB"], ["VB"]),
        (3, ["run", "far"], ["NN", "RB"], ["VB"]),  # a message of two rows
        (4, [], [], []),
    ]
    lists = spark.createDataFrame(
        rows, "doc_id long, toks array<string>, tags array<string>, bigram_tags array<string>"
    )
    terms = [("run#NOUN", 1.0), ("run#VERB", 2.0), ("far#ADVERB", 3.0), ("run-far#ADJECTIVE", 4.0)]
    terms += [("run-far#VERB", 5.0), ("run-run#NOUN", 6.0)]
    lex = L.inline_lexicon(spark, [("K", t, d, v) for t, v in terms for d in ("joy", "calm")])
    tokens = [
        (r[0], i, t, r[2][i], r[3][i] if i < len(r[3]) else None) for r in rows for i, t in enumerate(r[1])
    ]
    tokens = spark.createDataFrame(tokens, "doc_id long, pos int, tok string, tag string, bigram_tag string")
    for bigrams in (False, True):
        by_list = L.match_tagged(lists, lex, "hash", bigrams, "-")
        by_row = L.match_tagged(tokens, lex, "hash", bigrams, "-")
        assert sorted(map(tuple, by_list.collect())) == sorted(map(tuple, by_row.collect()))
    # messages of one row are shuffled once at most, by what was found
    once = L.match_tagged(lists.where("doc_id <> 3"), lex, "hash", True, "-")
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_distinct_keys_move_only_repeated_messages(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (2, ["c", "b", "d"])]
    messages = spark.createDataFrame(rows, "doc_id long, toks array<string>")
    kinds = ["plain|tok", "plain|bi "]
    own = L.look_up_keys(messages, kinds, distinct=True)
    every = L.look_up_keys(messages, kinds).select("doc_id", "look_up", "term").distinct()
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, every.collect()))
    single = L.look_up_keys(messages.limit(1), kinds, distinct=True)
    assert "hashpartitioning" not in single._jdf.queryExecution().executedPlan().toString()
