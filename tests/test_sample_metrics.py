import math
import random

import pytest
from pyspark.sql import functions as F

from textlab.operators import metrics, sample
from textlab.plans.ordered import class_rank, previous_value, running, with_order_bucket


def labels(spark, sizes):
    rows = [(i, c) for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "id bigint, label int")


def test_class_rank_is_exact_and_layout_free(spark):
    df = labels(spark, {0: 300, 1: 40, 2: 1})
    a = {r.id: (r["rank"], r.class_rows) for r in class_rank(df, ["label"], "id").collect()}
    b = {r.id: (r["rank"], r.class_rows) for r in class_rank(df.repartition(7), ["label"], "id", hex_digits=1).collect()}
    assert a == b
    assert sorted(v[0] for v in a.values() if v[1] == 300) == list(range(1, 301))


def test_undersample_and_downsample(spark):
    df = labels(spark, {0: 50, 1: 9, 2: 20})
    assert {r.label: r["count"] for r in sample.undersample_to_minority(df, "label", "id").groupBy("label").count().collect()} == {0: 9, 1: 9, 2: 9}
    down = sample.downsample_class(df, "label", 0, 30, "id").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in down} == {0: 30, 1: 9, 2: 20}
    assert sample.downsample_class(df, "label", 1, 30, "id").count() == 79


@pytest.mark.parametrize("k", [3, 10])
def test_folds_partition_the_table(spark, k):
    df = labels(spark, {0: 53, 1: 17})
    folds = sample.stratified_kfold(df, "label", k, "id").groupBy("fold", "label").count().collect()
    for label, n in ((0, 53), (1, 17)):
        counts = [r["count"] for r in folds if r.label == label]
        assert sum(counts) == n and max(counts) - min(counts) <= 1 and len(counts) == k


def test_splits(spark):
    df = labels(spark, {0: 53, 1: 18})
    assert sample.random_split(df, 0.2, "id").where("split = 'test'").count() == math.ceil(0.2 * 71)
    got = {(r.label, r.split): r["count"] for r in sample.stratified_split(df, "label", 0.2, "id").groupBy("label", "split").count().collect()}
    assert got[(0, "test")] + got[(1, "test")] == 15 and got[(0, "test")] == 11


def test_shots_and_eval_subset(spark):
    df = labels(spark, {0: 30, 1: 10, 2: 5})
    shots = sample.sample_shots(df, "label", 3, "id").orderBy("shot").collect()
    assert [r.shot for r in shots] == [1, 2, 3, 4, 5, 6] and [r.label for r in shots] == [0, 0, 0, 1, 1, 1]
    assert sample.balanced_eval_subset(df, "label", [0, 1, 2], None, "id").count() == 15
    assert sample.balanced_eval_subset(df, "label", [0, 1], 8, "id").count() == 16


def test_few_shot_prompt(spark):
    shots = spark.createDataFrame([(1, "T1", "C1", 0), (2, "T2", "C2", 1)], "shot int, text string, cot string, score int")
    test = spark.createDataFrame([("ask",)], "text string")
    p = sample.few_shot_prompts(test, shots, "Do it.\n## Input:\nX", F.col("text")).head().prompt
    assert p.startswith("Do it.\n\n\n### EXAMPLE FORMAT") and p.endswith("\n\n## Input:\nask\n## Input Response:\n<>\n")
    assert p.index("# Example: 1:\n# Data:\nT1\n") < p.index("# Example: 2:\n# Data:\nT2\n") and "<score>1</score>" in p


def python_report(pairs):
    out = {}
    for lab in {x for p in pairs for x in p}:
        tp = sum(t == lab and p == lab for t, p in pairs)
        pred, true = sum(p == lab for _, p in pairs), sum(t == lab for t, _ in pairs)
        pr, rc = (tp / pred if pred else 0.0), (tp / true if true else 0.0)
        out[str(lab)] = (pr, rc, 2 * pr * rc / (pr + rc) if pr + rc else 0.0, true)
    return out


def test_report_with_a_class_never_predicted(spark):
    rng = random.Random(1)
    pairs = [(rng.choice([0, 1, 2]), rng.choice([0, 1, 3])) for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, y_true int, y_pred int")
    got = {r.label: r for r in metrics.classification_report(df).collect()}
    for lab, (pr, rc, f1, n) in python_report(pairs).items():
        assert (got[lab].precision, got[lab].recall, got[lab].f1) == pytest.approx((pr, rc, f1)) and got[lab].support == n
    expected = python_report(pairs)
    assert got["macro avg"].f1 == pytest.approx(sum(v[2] for v in expected.values()) / len(expected))
    assert got["accuracy"].f1 == pytest.approx(sum(t == p for t, p in pairs) / 200)
    grid = metrics.confusion_matrix(df).collect()
    assert len(grid) == 16 and sum(r.n for r in grid) == 200


def test_cv_summary_uses_population_deviation(spark):
    folds = spark.createDataFrame([(f, float(f), 0, 10) for f in (1, 2, 4)], "fold int, v double, parse_failures int, rows int")
    for m in metrics.CV_METRICS:
        folds = folds.withColumn(m, F.col("v"))
    r = metrics.cv_summary(folds).where("metric = 'accuracy'").head()
    assert r["mean"] == pytest.approx(7 / 3) and r["std"] == pytest.approx(math.sqrt(14 / 9)) and r["rows"] == 30


def test_best_model_first_wins_ties(spark):
    rows = [("b", 2, 0.5), ("a", 1, 0.5), ("c", 3, 0.4)]
    df = spark.createDataFrame([(m, p, v, v, v) for m, p, v in rows], "model string, place int, accuracy double, f1_weighted double, precision_weighted double")
    for metric in ("accuracy", "f1", "unknown"):
        assert [r.model for r in metrics.select_best(df, metric).where("best").collect()] == ["a"]


def test_early_stop(spark):
    df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate([1.0, 2.0, 2.0, 2.0, 2.0, 9.0])], "trial int, step bigint, value double")
    trace = metrics.early_stop_trace(df, patience=3)
    assert [r.wait for r in trace.orderBy("step").collect()] == [0, 0, 1, 2, 3, 0]
    assert metrics.early_stop_step(trace).head().stop_step == 5


@pytest.mark.parametrize("hot, most, spacing", [(0.0, 1024, 1), (0.9, 1024, 3), (0.9, 4, 2)])
def test_running_values_match_plain_python_under_skew(spark, hot, most, spacing):
    """Rows with even, spaced and exponentially spaced order values; one and two levels of buckets."""
    rng = random.Random(3)
    rows = [(0 if rng.random() < hot else rng.randrange(5), i**spacing, rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, o bigint, v bigint")
    bucketed = with_order_bucket(df, "o", 64, most)
    levels = [c for c in ("_a", "_b") if c in bucketed.columns]
    assert levels == ["_a"] + ["_b"] * (most == 4)
    sizes = [r["count"] for r in bucketed.groupBy(*levels).count().collect()]
    assert max(sizes) <= 1.5 * 64 and len(sizes) >= 3000 / 64
    got = running(bucketed, ["g"], ["o"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}).collect()
    sums, tops = {}, {}
    expected = {}
    for g, o, v in rows:
        sums[g], tops[g] = sums.get(g, 0) + v, max(tops.get(g, -1), v)
        expected[o] = (sums[g], tops[g])
    assert {r.o: (r.s, r.m) for r in got} == expected
    whole = running(df, ["g"], ["o"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}).collect()
    assert {r.o: (r.s, r.m) for r in whole} == expected


@pytest.mark.parametrize("most", [1024, 3])
def test_previous_value_across_buckets(spark, monkeypatch, most):
    from textlab.plans import ordered

    monkeypatch.setattr(ordered.with_order_bucket, "__defaults__", (ordered.BUCKET_ROWS, most))
    rows = [(1, i * 3, None if i == 7 else f"v{i}") for i in range(50)] + [(2, 5, "x"), (3, 0, "a"), (3, 10**6, "b"), (None, 2, "n"), (None, 149, "m")]
    df = spark.createDataFrame(rows, "g int, o bigint, v string")
    for bucket_rows in (8, 3, 1000):
        got = {(r.g, r.o): r.p for r in previous_value(df, ["g"], "o", "v", "p", bucket_rows).collect()}
        assert got[(2, 5)] is None and got[(1, 0)] is None and got[(3, 10**6)] == "a" and got[(None, 149)] == "n" and len(got) == 55
        assert all(got[(1, i * 3)] == (None if i == 8 else f"v{i - 1}") for i in range(1, 50))


def test_running_f1(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(2), rng.randrange(2)) for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id bigint, y_true int, y_pred int")
    got = {r.id: r.f1 for r in metrics.running_f1(df, "id", F.lit(1)).collect()}
    for i in range(60):
        rep = python_report(pairs[: i + 1])
        assert got[i] == pytest.approx(sum(v[2] * v[3] for v in rep.values()) / (i + 1))


@pytest.mark.parametrize("case", ["even", "spread", "ties", "one", "tiny", "wide"])
def test_quantiles_by_narrowing_counts(spark, case):
    import numpy as np

    from textlab.plans.ordered import exact_quantile, kth_smallest

    rng = np.random.default_rng(5)
    values = {
        "even": rng.random(3000), "spread": 10.0 ** rng.uniform(-280, 280, 400), "ties": rng.integers(0, 4, 999).astype(float),
        "one": np.array([7.0]), "tiny": np.array([0.0, 5e-324, 1e-323, 1.0, np.nextafter(1.0, 2)]),
        "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0, -1.0]),
    }[case]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
    ordered = np.sort(values)
    for k in {0, len(values) // 3, len(values) - 1}:
        assert kth_smallest(df, "v", k, accuracy=50, few=20) == ordered[k]
    at = 0.95 * (len(values) - 1)
    low, high = ordered[int(at)], ordered[min(int(at) + 1, len(values) - 1)]
    assert exact_quantile(df, "v", 0.95) == pytest.approx(low * (1 - at % 1) + high * (at % 1), rel=1e-12)


def test_length_stats_without_lengths_and_with_long_ones(spark):
    none = spark.createDataFrame([(None,)], "n bigint")
    assert metrics.length_stats(none, "n").collect() == [(None, None)] == metrics.length_stats(none.limit(0), "n").collect()
    some = spark.range(1, 20_002).select((F.col("id") * 3).alias("n"))
    assert metrics.length_stats(some, "n").collect() == [(60_003, 57_003)]
