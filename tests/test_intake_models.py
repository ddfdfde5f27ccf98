import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textlab.functions import fixed
from textlab.operators import cells, intake, metrics, models, neighbors
from textlab.plans.components import components
from textlab.plans.durable import checkpointed, materialize
from textlab.sources import tables
from textlab.streaming.accept import accept_batch, accept_unique_stream, earlier_keys


def python_accept(rows):
    titles, prefixes, taken = set(), set(), []
    for o, t, x in sorted(rows):
        if len(x) > 200 and t not in titles and x[:100] not in prefixes:
            titles.add(t)
            prefixes.add(x[:100])
            taken.append(o)
    return taken


def story_text(prefix, n=250):
    return (prefix * 300)[:100].ljust(n, "z")


def accepted(df, **options):
    return sorted(r.o for r in intake.accept_unique(df, "o", F.col("t"), F.col("x"), **options).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "o bigint, t string, x string")


def test_a_rejected_row_blocks_nobody(spark):
    rows = [(1, "t1", story_text("a")), (2, "t1", story_text("b")), (3, "t3", story_text("b"))]
    assert accepted(frame(spark, rows)) == [1, 3]


def test_length_gate(spark):
    rows = [(1, "t", "q" * 200), (2, "t", "q" * 201), (3, "t", "r" * 300)]
    assert accepted(frame(spark, rows)) == [2] == python_accept(rows)


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.5)])
def test_acceptance_equals_the_sequential_walk(spark, seed, hot):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < hot else f"t{rng.randrange(25)}", story_text(f"p{rng.randrange(25)}-")) for i in range(200)]
    assert accepted(frame(spark, rows)) == python_accept(rows)
    assert accepted(frame(spark, rows), limit=4) == python_accept(rows)[:4]


def keyed(spark, rows):
    return spark.createDataFrame(rows, "o bigint, t bigint, p bigint")


def walk_of(rows):
    titles, prefixes, out = set(), set(), []
    for o, t, p in sorted(rows):
        if t not in titles and p not in prefixes:
            titles.add(t)
            prefixes.add(p)
            out.append(o)
    return out


@pytest.mark.parametrize("rounds,walk", [(1, 40), (2, 15), (3, 400)])
def test_components_walked_in_order_equal_the_sequential_walk(spark, rounds, walk):
    rng = random.Random(rounds)
    chain = [(i, i // 2, (i + 1) // 2) for i in range(60)]  # every row blocks the next
    others = [(1000 + i, 100 + rng.randrange(40), 100 + rng.randrange(40)) for i in range(150)]
    got = intake.accept_keys(keyed(spark, chain + others), "o", "t", "p", rounds, walk)
    assert sorted(r.o for r in got.collect()) == walk_of(chain + others)


def test_a_long_chain_needs_few_jobs(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("o"), (F.col("id") / 2).cast("bigint").alias("t"), ((F.col("id") + 1) / 2).cast("bigint").alias("p"))
    spark.sparkContext.setJobGroup("chain", "chain")
    got = intake.accept_keys(chain, "o", "t", "p")
    assert got.agg(F.count("o"), F.sum("o")).first()[:] == (n // 2, sum(range(0, n, 2)))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 50


def test_components_of_paths_stars_and_circles(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 80)] + [(200, 201 + i) for i in range(30)] + [(300 + i, 300 + (i + 1) % 50) for i in range(50)]
    names = {x: rng.getrandbits(50) for link in links for x in link}
    df = spark.createDataFrame([(names[a], names[b]) for a, b in links] + [(7, 7)], "_u bigint, _v bigint")
    for few in (0, 20, 1000):
        got = {}
        for u, c in components(df, few).collect():
            got.setdefault(c, set()).add(u)
        want = [{names[a] for a, _ in links[:80]}, {names[200]}, {names[a] for a, _ in links[110:]}, {7}]
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_null_titles_block_nobody(spark):
    rows = [(i, None, story_text(f"p{i // 2}-")) for i in range(40)]
    assert accepted(frame(spark, rows)) == list(range(0, 40, 2))


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"t{rng.randrange(15)}", story_text(f"p{rng.randrange(15)}-")) for i in range(90)]
    source = tmp_path / "in"
    for part in range(3):
        frame(spark, rows[part * 30 : part * 30 + 30]).coalesce(1).write.parquet(str(source / f"part{part}"))
    done = str(tmp_path / "accepted")
    stream = spark.readStream.schema("o bigint, t string, x string").option("maxFilesPerTrigger", 1).parquet(str(source / "part*"))
    accept_unique_stream(stream, done, str(tmp_path / "progress"), "o", F.col("t"), F.col("x")).awaitTermination()
    got = sorted(r.o for r in spark.read.parquet(done).collect())
    assert got == python_accept(rows)
    accept_batch(frame(spark, rows[60:]), 2, done, "o", F.col("t"), F.col("x"))
    assert sorted(r.o for r in spark.read.parquet(done).collect()) == got


def test_batches_out_of_order_are_first_come_by_batch(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, f"t{rng.randrange(60)}", story_text(f"p{rng.randrange(60)}-")) for i in range(120)]
    batches = [rows[80:], rows[:40], rows[40:80]]
    done, titles, prefixes, want = str(tmp_path / "accepted"), set(), set(), []
    for number, part in enumerate(batches):
        accept_batch(frame(spark, part), number, done, "o", F.col("t"), F.col("x"), bucket_rows=16)
        for o, t, x in sorted(part):
            if t not in titles and x[:100] not in prefixes:
                titles.add(t)
                prefixes.add(x[:100])
                want.append(o)
    read = lambda: sorted(r.o for r in spark.read.parquet(done).collect())
    assert read() == sorted(want)
    accept_batch(frame(spark, batches[2]), 2, done, "o", F.col("t"), F.col("x"), bucket_rows=16)
    assert read() == sorted(want)


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    done, read = str(tmp_path / "accepted"), []
    distinct = lambda a, b: spark.range(a, b).select(
        F.col("id").alias("o"), F.concat(F.lit("t"), "id").alias("t"), F.rpad(F.concat("id", F.lit("-")), 250, "z").alias("x")
    )
    sizes = [0, 400, 4000]
    for number in range(2):
        accept_batch(distinct(sizes[number], sizes[number + 1]), number, done, "o", F.col("t"), F.col("x"), bucket_rows=64)
        probe = intake.candidate_keys(distinct(10, 12), "o", F.col("t"), F.col("x"))
        earlier, _, buckets = earlier_keys(probe, number + 1, done, bucket_rows=64)
        read.append((earlier.count(), buckets))
        assert probe.join(earlier, probe["_title"] == earlier["key"], "left_semi").count() == 2
    # Ten times the history: more buckets, no more keys read by the same batch.
    assert read[1][1] >= 8 * read[0][1] and max(n for n, _ in read) <= 4 * 64 * 1.5
    assert spark.read.parquet(done).count() == 4000


def test_prompts_are_fixed_by_the_seed(spark):
    ids = spark.range(300)
    a, b = intake.prompt_table(ids, "id"), intake.prompt_table(ids.repartition(5), "id")
    assert sorted(a.collect()) == sorted(b.collect())
    rows = a.collect()
    assert {r.theme for r in rows} <= set(fixed.THEMES) and all(512 <= r.max_new_tokens < 1024 and 0.8 <= r.temperature < 1.2 for r in rows)
    assert 0.35 < sum("surprising twist" in r.prompt for r in rows) / 300 < 0.65


def test_batch_infer_keeps_rows_together(spark):
    df = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("text")).repartition(4)
    out = intake.batch_infer(df, "text", lambda: "m", lambda m, ts: [m + t for t in ts])
    assert all(r.response == f"mt{r.id}" for r in out.collect())


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "quoted", text\nwith lines \\ and é', 1), (None, 0)], "text string, score int")
    tables.write_table(df, str(tmp_path / "c"), "csv")
    got = {r.score: r.text for r in tables.read_labeled_csv(spark, str(tmp_path / "c")).collect()}
    assert got == {r.score: r.text for r in df.collect()}
    (tmp_path / "e.csv").write_text("text,score\n")
    with pytest.raises(ValueError, match="no rows"):
        tables.read_labeled_csv(spark, str(tmp_path / "e.csv"))


def test_materialize_builds_once_per_input(spark, tmp_path):
    calls = []

    def build(df):
        calls.append(1)
        return df.groupBy().agg(F.sum("id").alias("s"))

    def run(n, **o):
        return materialize(spark.range(n), str(tmp_path), "sum", build, **o).head().s

    assert [run(10), run(10), run(11), run(10, override=True)] == [45, 45, 55, 45]
    assert len(calls) == 3


def test_checkpoint_is_reliable(spark):
    assert "ExistingRDD" in checkpointed(spark.range(5))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", neighbors.METRICS)
@pytest.mark.parametrize("block", [8, 2048])
def test_neighbours_equal_brute_force(spark, metric, block):
    rng = np.random.default_rng(4)
    # One cluster holds most rows.
    points = np.vstack([rng.normal(0, 0.05, (90, 6)) + 1, rng.normal(0, 1, (50, 6))])
    rows = [(i, [float(v) for v in p], int(i % 3)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>, label int")
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    got = neighbors.nearest(train, test, 4, metric, block=block).orderBy("id", "place").collect()
    where = {}
    for r in got:
        where.setdefault(r.id, []).append(r.neighbour)
    train_ids = [i for i in range(140) if i % 4]
    for q in range(0, 140, 4):
        a, b = points[q], points[train_ids]
        d = {
            "euclidean": np.sqrt(((a - b) ** 2).sum(1)), "manhattan": np.abs(a - b).sum(1),
            "cosine": 1 - b @ a / np.linalg.norm(b, axis=1) / np.linalg.norm(a),
        }[metric]
        assert where[q] == [train_ids[j] for j in np.lexsort((train_ids, np.round(d, 9)))[:4]]


@pytest.mark.parametrize("metric", neighbors.METRICS)
def test_cells_leave_out_most_rows_and_no_neighbour(spark, metric):
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 10, (12, 6))
    points = middles[rng.integers(0, 12, 600)] + rng.normal(0, 0.05, (600, 6))
    points[::50] = rng.normal(0, 10, (12, 6))  # far from every cluster
    points[100:120] = points[100]  # ties
    rows = [(i, [float(v) for v in p], int(i % 3)) for i, p in enumerate(points)]
    df = spark.createDataFrame([*rows, (600, None, 0)], "id bigint, vec array<double>, label int")
    train, test = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    want = neighbors.nearest(train.where("vec IS NOT NULL"), test.where("vec IS NOT NULL"), 4, metric)
    for options in ({"cells": 40}, {"cells": 40, "block": 16, "whole": 0.01}):
        got = cells.nearest_in_cells(train, test, 4, metric, **options)
        assert sorted(got.collect()) == sorted(want.collect())
    compared = cells.compared_rows(train, test, 4, metric, cells=40).agg(F.sum("compared")).first()[0]
    assert compared < 0.2 * 480 * 120
    few = cells.nearest_in_cells(train.where("id < 4"), test, 4, metric, cells=2)
    assert few.count() == 3 * 120


def test_distance_votes(spark):
    train = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 1), (3, [1.2], 1)], "id bigint, vec array<double>, label int")
    test = spark.createDataFrame([(10, [0.0]), (11, [0.3])], "id bigint, vec array<double>")
    got = {r.id: r.y_pred for r in neighbors.knn_classify(train, test, 3, "distance").collect()}
    assert got == {10: 0, 11: 0}
    assert {r.y_pred for r in neighbors.knn_classify(train, test, 3, "uniform").collect()} == {1}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(2 * (i % 2) - 1, 0.7, 4)], i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    return df.select("id", array_to_vector("v").alias("features"), "label").persist()


@pytest.mark.parametrize(
    "fit",
    [models.linear("l2", max_iter=20), models.linear("l1", max_iter=20), models.linear("elasticnet", max_iter=20),
     models.linear("hinge", max_iter=20), models.modified_huber(iters=10), models.tree("decision_tree"),
     models.tree("random_forest", trees=5), models.tree("boosted", trees=3, max_depth=2), models.mlp([4], max_iter=40)],
)
def test_every_model_beats_a_floor(points, fit):
    counts = metrics.confusion_counts(models.predictions(fit(points), points))
    assert metrics.summary_scores(metrics.label_scores(counts)).head().f1_macro > 0.9


def test_cross_validation_holds_every_row_out_once(points):
    held = models.cross_validate(points, {"a": models.linear(max_iter=3), "b": models.linear("hinge", max_iter=3)}, k=3)
    assert held.count() == 480 and held.where("model = 'a'").select("id").distinct().count() == 240
    assert models.compare_models(held).where("best").count() == 1


def test_search_draws_are_repeatable_and_in_range():
    for name, space in models.SEARCH_SPACES.items():
        for t in range(20):
            p = models.draw_params(space, 1, t)
            assert p == models.draw_params(space, 1, t)
            for key, (kind, *bounds) in space.items():
                if kind in ("int", "real", "log"):
                    assert bounds[0] <= p[key] <= bounds[1]


def test_text_pipeline_round_trip(spark, tmp_path):
    rows = [(i, ("good fine nice " if i % 2 else "bad poor awful ") + f"word{i % 7}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, text string, label int")
    path = str(tmp_path / "m")
    model, pred = models.train_and_evaluate(df, models.linear(max_iter=10), F.lower("text"), model_path=path)
    assert pred.count() == 12 and pred.where("y_true = y_pred").count() == 12
    from pyspark.ml import PipelineModel

    report, outcomes = models.score_table(PipelineModel.load(path), df)
    assert report.where("label = 'accuracy'").head().f1 == 1.0 and outcomes.count() == 60


@pytest.mark.parametrize("weighting", ["embedding", "embedding_oov_zero"])
def test_pipeline_on_word_vectors(spark, tmp_path, weighting):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from textlab.operators import features
    from textlab.operators.local_model import lime_explain

    rows = [(i, ("good fine " if i % 2 else "bad awful ") * (1 + i % 3) + f"unknown{i % 7}", i % 2, i * 1.5) for i in range(60)]
    rows += [(60, "", 0, 0.0), (61, None, 1, 0.0), (62, "nothing known", 0, 0.0), (63, "good " * 3000, 1, 0.0)]
    df = spark.createDataFrame(rows, "id bigint, text string, label int, other double")
    vectors = spark.createDataFrame([("good", [1.0, 0.5]), ("fine", [0.5, 1.0]), ("bad", [-1.0, 0.25]), ("awful", [-0.5, -1.0])], "word string, vec array<double>")
    path = str(tmp_path / "m")
    model, pred = models.train_and_evaluate(
        df, models.linear(max_iter=10), F.col("text"), model_path=path, weighting=weighting, vectors=vectors
    )
    assert pred.count() == 13
    oov = "zero" if weighting == "embedding_oov_zero" else "skip"
    want = {r.id: r.vec for r in features.mean_embedding(df, "id", "text", vectors, 2, oov).collect()}
    stored = PipelineModel.load(path)
    # A features column of the caller's is replaced, other columns stay.
    answered = stored.transform(df.withColumn("features", F.lit(0)))
    assert answered.columns[:4] == ["id", "text", "label", "other"]
    got = {r.id: list(r.v) for r in answered.select("id", vector_to_array("features").alias("v")).collect()}
    assert got == want and want[60] == want[61] == want[62] == [0.0, 0.0] and want[63] == [1.0, 0.5]
    assert want[3] == pytest.approx([0.75 * 2 / (2 + (oov == "zero") / 1), 0.75 * 2 / (2 + (oov == "zero") / 1)])
    assert sorted(models.predictions(stored, df).collect()) == sorted(models.predictions(model, df).collect())
    report, _ = models.score_table(stored, df.where("id < 60"))
    assert report.where("label = 'accuracy'").head().f1 == 1.0
    with pytest.raises(ValueError, match="word vectors"):
        models.fit_vectorizer(df, weighting=weighting)
    with pytest.raises(ValueError, match="in place"):
        lime_explain(df, stored, "id", "text")


def test_search_query_runs_every_study(spark, sf_dir, monkeypatch):
    from textlab.operators import models
    from textlab.testbed import queries

    given = []

    def search(df, studies, n_trials, **options):
        given.append((n_trials, options))
        return df.sparkSession.createDataFrame([(s, 0, 0.5) for s in studies], "study string, trial long, value double")

    monkeypatch.setattr(models, "random_search", search)
    found = [r["study"] for name in ("g07_random_search", "g07_tree_search") for r in queries.QUERIES[name](spark, sf_dir).collect()]
    assert sorted(found) == sorted(models.SEARCH_SPACES) and given == [(50, {})] * 2


def test_stored_folds_equal_the_union(spark):
    from textlab.operators import models
    from textlab.plans.durable import scratch_path

    df = spark.createDataFrame([(i, i % 2, [float(i % 2) + i % 3, float(i % 5)]) for i in range(40)], "id long, label int, v array<double>")
    from pyspark.ml.functions import array_to_vector

    df = df.select("id", "label", array_to_vector("v").alias("features"))
    fits = {"0": models.linear("l2"), "1": models.linear("l2", c=0.01)}
    stored = models.cross_validate(df, fits, 2, folder=scratch_path(spark, "folds"))
    plain = models.cross_validate(df, fits, 2)
    columns = ["model", "place", "fold", "id", "y_true", "y_pred"]
    assert sorted(stored.select(columns).collect()) == sorted(plain.select(columns).collect())


def test_fits_of_a_search_run_side_by_side_on_few_partitions(spark, monkeypatch):
    import threading

    from pyspark.ml.functions import array_to_vector

    from textlab.operators import models

    rows = [(i, i % 2, [float(i % 2) + i % 3, float(i % 5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").repartition(4)
    df = df.select("id", "label", array_to_vector("v").alias("features"))
    want = {r.trial: r.value for r in models.random_search(df, "decision_tree", 4, k=2).collect()}
    all_there, partitions, fit_tree = threading.Barrier(4, timeout=60), [], models.FIT_FUNCTIONS["decision_tree"]

    def fits(**params):
        def fit(train):
            all_there.wait()
            partitions.append(train.rdd.getNumPartitions())
            return fit_tree(**params)(train)

        return fit

    monkeypatch.setitem(models.FIT_FUNCTIONS, "decision_tree", fits)
    got = {r.trial: r.value for r in models.random_search(df, "decision_tree", 4, k=2).collect()}
    assert got == want and partitions == [1] * 8
