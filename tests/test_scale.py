"""Null keys, stale artefacts, frequent tokens and vocabularies without a limit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textlab.operators import explain, features, local_model, neighbors, sample
from textlab.operators.linear_many import ManyFits
from textlab.operators.models import fit_vectorizer, linear
from textlab.plans import layout, ordered
from textlab.plans.durable import materialize, stored


@pytest.fixture
def with_nulls(spark):
    rows = [(i, [None, "a", "b"][i % 3]) for i in range(30)] + [(None, "a")]
    return spark.createDataFrame(rows, "id long, label string")


def test_null_keys_are_kept(with_nulls):
    folds = sample.stratified_kfold(with_nulls, "label", 5, "id")
    assert folds.count() == 31 and folds.where("label is null").count() == 10
    split = sample.stratified_split(with_nulls, "label", 0.3, "id")
    assert split.count() == 31 and split.where("split = 'test'").count() == 10
    assert sample.random_split(with_nulls, 0.3, "id").count() == 31
    assert sample.undersample_to_minority(with_nulls, "label", "id").count() == 30


def test_running_values_of_a_null_group(spark):
    rows = [(None, i, 1) for i in range(5)] + [("g", i, 2) for i in range(5)]
    frame = spark.createDataFrame(rows, "g string, at long, v long")
    made = ordered.running(frame.withColumn("_b", F.floor(F.col("at") / 2)), ["g"], ["at"], {"s": ("sum", F.col("v"))}).collect()
    assert sorted(r["s"] for r in made if r["g"] is None) == [1, 2, 3, 4, 5]
    assert sorted(r["s"] for r in made if r["g"] == "g") == [2, 4, 6, 8, 10]
    before = ordered.previous_value(frame, ["g"], "at", "at", "p", 2).collect()
    assert len(before) == 10 and {r["at"]: r["p"] for r in before if r["g"] is None} == {0: None, 1: 0, 2: 1, 3: 2, 4: 3}


def test_rewritten_input_is_built_again(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    build = lambda df: df.agg(F.sum("id").alias("s"))
    spark.range(3).write.parquet(path)
    assert materialize(spark.read.parquet(path), root, "sum", build).first()["s"] == 3
    assert materialize(spark.read.parquet(path), root, "sum", lambda df: 1 / 0).first()["s"] == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert materialize(spark.read.parquet(path), root, "sum", build).first()["s"] == 10
    maps = spark.createDataFrame([({"a": 1},)], "m map<string,int>")
    assert materialize(maps, root, "maps", lambda df: df.select(F.size("m").alias("n"))).first()["n"] == 1


@pytest.fixture
def shuffled_joins(spark):
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_share(df) -> float:
    """The share of the rows that the fullest task of the frame's last stage holds."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


def test_frequent_token_is_spread(spark, shuffled_joins):
    """One word stands in every row: no task gets a large part of its rows, also where the other side is an aggregate."""
    docs = spark.range(0, 20000, numPartitions=8).select("id", F.concat(F.lit("hot w"), F.col("id") % 50).alias("text"))
    hot = features.token_counts(docs, "id", "text").where("token = 'hot'")
    table = features.token_counts(docs, "id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    assert largest_share(hot.join(table, "token")) == 1
    assert largest_share(layout.join_frequent(hot, table, "token", "id")) < 0.3
    counts = features.word_counts(docs, "id", "text")
    assert largest_share(counts) < 0.25 and counts.count() == 40000
    weights = table.select("token", F.lit(0.5).alias("w"))
    values = features.tfidf(docs, "id", "text")
    assert values.count() == 40000
    assert explain.linear_shap(docs, values, "id", weights).count() == 60000
    assert explain.occlusion(values, "id", weights).count() == 40000
    assert explain.path_gradients(values, "id", weights).count() == 40000
    vectors = table.select(F.col("token").alias("word"), F.array(F.col("n").cast("float")).alias("vec"))
    assert features.mean_embedding(docs, "id", "text", vectors, 1).where("vec[0] = 10200").count() == 20000


@pytest.mark.parametrize("rows", [4000, 40000])
def test_only_frequent_keys_are_cut(spark, shuffled_joins, rows):
    """A third of the rows share a key: parts follow from its rows, the fullest task stays small, rare keys are not repeated."""
    large = spark.range(0, rows, numPartitions=8).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    found = layout.frequent_keys(large, "k", 64)
    assert list(found.values()) == [pytest.approx(1 / 3, rel=0.01)]
    small = large.select("k").distinct().withColumn("v", F.length("k"))
    joined = layout.join_frequent(large, small, "k", "id")
    assert joined.count() == rows and joined.where(F.col("v") != F.length("k")).count() == 0
    assert largest_share(joined) < 0.06  # of 64 tasks
    assert layout.join_frequent(large, small, "k", "id", "left_semi").count() == rows
    even = spark.range(rows).select("id", F.col("id").alias("k"))
    assert layout.frequent_keys(even, "k", 64) == {}


def test_no_token_is_dropped(spark):
    docs = spark.range(3000).select("id", F.concat_ws(" ", *[F.concat(F.lit(f"t{k}x"), F.col("id")) for k in range(100)]).alias("text"))
    assert docs.count() == 3000
    made = fit_vectorizer(docs, "text", "id", "word_count")
    assert len(made.stages[1].vocabulary) == 300000
    hashed = fit_vectorizer(docs.limit(20), "text", "id", "word_count", slots=64).transform(docs.limit(20))
    assert {sum(r["features"].values) for r in hashed.collect()} == {100.0}


def test_scratch_folders_go_with_their_run(spark):
    from textlab.plans.durable import path_exists, scratch_path, scratch_run

    kept = scratch_path(spark, "kept")
    with pytest.raises(ZeroDivisionError), scratch_run(spark):
        outer = scratch_path(spark, "outer")
        spark.range(3).write.parquet(outer)
        with scratch_run(spark):
            inner = scratch_path(spark, "inner")
            spark.read.parquet(outer).write.parquet(inner)
            spark.read.parquet(inner).write.parquet(kept)
        assert path_exists(spark, outer) and not path_exists(spark, inner)
        1 / 0  # noqa: B018
    assert not path_exists(spark, outer)
    assert spark.read.parquet(kept).count() == 3


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_estimates_lose_no_neighbour(metric):
    """Single-precision estimates name the candidates; the result is that of all distances in double precision."""
    rng = np.random.default_rng(0)
    for change in ("none", "far", "copies", "whole", "large", "small", "odd"):
        points, queries = rng.normal(size=(700, 9)), rng.normal(size=(301, 9))
        barred = rng.integers(0, 3, 301)[:, None] == rng.integers(0, 3, 700) if change == "none" else None
        if change == "far":
            points, queries = points + 1e9, queries + 1e9
        elif change == "copies":
            points[::2], queries[::3] = points[0], points[0]
        elif change == "whole":
            points, queries = np.round(points), np.round(queries)
        elif change in ("large", "small"):
            by = 1e30 if change == "large" else 1e-12
            points, queries = points * by, queries * by
        elif change == "odd":
            points[5, 3], points[6, 1], queries[2, 2] = np.nan, np.inf, np.nan
        with np.errstate(all="ignore"):
            points, queries = neighbors._matrix(points, metric), neighbors._matrix(queries, metric)
            d = neighbors._distances(queries, points, "manhattan" if metric == "manhattan" else "euclidean")
            d = np.round(d * d / 2 if metric == "cosine" else d, 9)
            if barred is not None:
                d[barred] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :7]
            row, column = np.nonzero(np.take_along_axis(d, best, 1) < np.inf)
            want = list(zip(row, best[row, column], d[row, best[row, column]]))
            assert list(zip(*neighbors.closest(queries, points, 7, metric, barred))) == want, change


def test_trials_vote_in_the_task():
    """Counts of what many trials say, as a plain count over the first neighbours has it."""
    rng, rows, trials = np.random.default_rng(3), [], [(0, 3, False), (1, 5, True), (2, 9, True), (3, 8, False)]
    for i in range(120):
        n = int(rng.integers(1, 10))
        d = np.sort(np.round(rng.integers(0 if i % 3 else 1, 6, n) / 4, 9))
        rows.append(([{"place": p + 1, "label": int(rng.integers(0, 3)), "distance": float(x)} for p, x in enumerate(d)], i % 2, i % 4))
    want = {}
    for near, truth, fold in rows:
        for trial, k, by_distance in trials:
            votes = {}
            for n in near[:k]:
                zeros, weight = votes.get(n["label"], (0, 0.0))
                at_zero = by_distance and n["distance"] == 0
                votes[n["label"]] = (zeros + at_zero, weight + (0.0 if at_zero else 1 / n["distance"] if by_distance else 1.0))
            said = max(votes, key=lambda c: (votes[c][0], round(votes[c][1], 9), -c))
            want[trial, fold, truth, said] = want.get((trial, fold, truth, said), 0) + 1
    frame = pd.DataFrame(rows, columns=["near", "y_true", "fold"])
    made = pd.concat(neighbors.trial_votes(trials)(iter([frame[:50], frame[50:50], frame[50:]])))
    assert {tuple(int(v) for v in r[:4]): int(r[4]) for r in made[["trial", "fold", "y_true", "y_pred", "n"]].to_numpy()} == want


def test_rows_of_fits_are_dealt_evenly(spark):
    """A file of one row group is one partition; the fits' blocks are not."""
    rows = spark.range(0, 4000, 1, 1).select((F.col("id") % 2).alias("label"), array_to_vector(F.array(F.col("id") / 4000)).alias("features"))
    with ManyFits(rows) as fits:
        sizes = [r["rows"] for r in fits.blocks.select("rows").collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 4000 / spark.sparkContext.defaultParallelism + 8


def test_document_frequency_counts_a_document_once(spark):
    docs = spark.createDataFrame([(1, "aa bb aa AA"), (2, "bb, c"), (3, None)], "id long, text string")
    assert {(r["token"], r["n"]) for r in features.document_frequency(docs, "text").collect()} == {("aa", 1), ("bb", 2)}


def test_stored_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    assert stored(spark.range(50).mapInPandas(seen, "id long")).agg(F.sum("id")).first()[0] == 1225
    assert made.value == 50


def test_shap_row_of_absent_tokens(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    values = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (2, "a", 2.0)], "id long, token string, value double")
    weights = spark.createDataFrame([("a", 2.0), ("b", -1.0)], "token string, w double")
    made = {(r["id"], r["token"]): r["phi"] for r in explain.linear_shap(docs, values, "id", weights).collect()}
    a, b = 2.0 * 1.0, -1.0 / 6  # what the means come to
    want = {(1, "a"): 2 - a, (1, "b"): -0.5 - b, (1, explain.ABSENT): 0.0, (2, "a"): 4 - a, (2, explain.ABSENT): -b, (3, explain.ABSENT): -a - b}
    assert made == pytest.approx(want)


@pytest.mark.parametrize("weighting, kind", [("tfidf", "l2"), ("word_count", "hinge")])
def test_copies_answer_by_their_words(spark, monkeypatch, weighting, kind):
    """A linear model of words answers masked copies from scores of single words as it does from their texts."""
    texts = ["Foo foo bar_x x baz", "bar_x qux qux, éa Qux", "zed foo 12 baz-bar_x"]
    df = spark.createDataFrame([(i, f"{texts[i % 3]} w{i % 7}", int(i % 3 == 0)) for i in range(30)] + [(30, None, 0), (31, " ,", 0)], "id long, text string, label int")
    train = df.where("id < 30")
    vectorizer = fit_vectorizer(train, "text", "id", weighting)
    model = PipelineModel([*vectorizer.stages, linear(kind, c=10.0)(vectorizer.transform(train))])

    def explained():
        made = local_model.lime_explain(df, model, "id", "text", n_samples=150, n_features=4)
        return made._jdf.queryExecution().executedPlan().toString(), {(r["id"], r["word"]): (r["weight"], r["intercept"]) for r in made.collect()}

    plan, made = explained()
    monkeypatch.setattr(local_model, "_word_stages", lambda _: None)
    wholes, want = explained()
    assert "_copy" not in plan and "_copy" in wholes and "Exchange" not in plan
    assert made.keys() == want.keys()
    for key, pair in want.items():
        assert made[key] == pytest.approx(pair, abs=1e-9)
