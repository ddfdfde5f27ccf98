"""Metrics over prediction tables (id, y_true, y_pred ...).

Each report reads the predictions once, into the confusion counts (one row per
pair of labels); everything after that is a table of a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlab.functions.scores import outcome
from textlab.plans.ordered import exact_quantile, running, with_order_bucket


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def confusion_counts(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pred.groupBy(*(by or []), "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """Counts for every pair of labels that occur, zeros included."""
    counts = confusion_counts(pred)
    labels = counts.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    all_labels = labels.agg(F.array_sort(F.collect_set("label")).alias("l")).scalar()
    grid = labels.select(F.col("label").alias("y_true"), F.explode(all_labels).alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b with 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def label_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per label (true or predicted) from confusion counts."""
    by = by or []
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.alias("h")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")),
    )
    tallies = counts.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits")
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    return tallies.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    )


def summary_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and weighted means from label scores."""
    rows = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / rows
    return scores.groupBy(*(by or [])).agg(
        rows.alias("rows"),
        (F.sum("hits") / rows).alias("accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
    )


def classification_report(pred: DataFrame) -> DataFrame:
    """A row per label and rows "accuracy", "macro avg", "weighted avg"."""
    scores = label_scores(confusion_counts(pred))
    per_label = scores.select(
        F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support"
    )
    s = summary_scores(scores)
    rows = F.array(
        F.struct(
            F.lit("accuracy").alias("label"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"),
            F.col("accuracy").alias("f1"), F.col("rows").alias("support"),
        ),
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("label"), F.col(f"precision_{kind}").alias("precision"),
                F.col(f"recall_{kind}").alias("recall"), F.col(f"f1_{kind}").alias("f1"), F.col("rows").alias("support"),
            )
            for kind in ("macro", "weighted")
        ],
    )
    return per_label.unionByName(s.select(F.inline(rows)))


def outcomes(pred: DataFrame, id_col: str = "id") -> DataFrame:
    """id and TP/TN/FP/FN; rows with labels other than 0 and 1 have none and are left out."""
    return pred.select(id_col, outcome(F.col("y_true"), F.col("y_pred")).alias("outcome")).where(
        "outcome IS NOT NULL"
    )


def fold_metrics(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Scores, parse failures and their rate per fold (and per further ``keys``)."""
    by = [*(keys or []), "fold"]
    failed = F.col("parse_failed").cast("bigint") if "parse_failed" in pred.columns else F.lit(0).cast("bigint")
    counts = pred.groupBy(*by, "y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("n"), F.sum(failed).alias("failures")
    )
    failures = counts.groupBy(*by).agg(F.sum("failures").alias("parse_failures"))
    scored = summary_scores(label_scores(counts, by), by).join(failures, by)
    return scored.withColumn("parse_failure_rate", _ratio(F.col("parse_failures"), F.col("rows")))


CV_METRICS = ("f1_macro", "accuracy", "precision_macro", "recall_macro", "parse_failure_rate")


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over the folds, failures and rows in all."""
    wide = folds.agg(
        *[F.avg(m).alias(f"{m}_mean") for m in CV_METRICS],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in CV_METRICS],
        F.sum("parse_failures").alias("parse_failures"),
        F.sum("rows").alias("rows"),
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std"))
                    for m in CV_METRICS
                ]
            )
        ),
        "parse_failures",
        "rows",
    )


def select_best(folds: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Mean scores per model (rounded to 3) with the best model marked.

    ``folds`` has model, place (order of listing) and the metrics of ``fold_metrics``.
    The best has the highest unrounded mean; the first listed wins a tie; an
    unknown metric means accuracy.
    """
    chosen = {"accuracy": "accuracy", "f1": "f1_weighted", "precision": "precision_weighted"}.get(metric, "accuracy")
    means = folds.groupBy("model", "place").agg(
        F.avg("accuracy").alias("a"), F.avg("f1_weighted").alias("f"), F.avg("precision_weighted").alias("p"),
        F.avg(chosen).alias("chosen"),
    )
    best = means.agg(F.max_by("model", F.struct("chosen", -F.col("place"))).alias("m")).scalar()
    return means.select(
        "model",
        F.round("a", 3).alias("mean_accuracy"),
        F.round("f", 3).alias("mean_f1"),
        F.round("p", 3).alias("mean_precision"),
        (F.col("model") == best).alias("best"),
    )


def trial_leaderboard(trials: DataFrame, min_value: float | None = None) -> DataFrame:
    """Best trial per study, studies ranked by it; the earliest trial wins a tie."""
    kept = trials if min_value is None else trials.where(F.col("value") > min_value)
    best = kept.groupBy("study").agg(
        F.max_by("trial", F.struct("value", -F.col("trial"))).alias("best_trial"),
        F.max("value").alias("best_value"),
        F.count(F.lit(1)).alias("trials"),
    )
    ranked = W.partitionBy(F.lit(0)).orderBy(F.col("best_value").desc(), "study")  # a row per study
    return best.withColumn("place", F.row_number().over(ranked))


def good_trials(trials: DataFrame, min_value: float = 0.56) -> DataFrame:
    return trials.where(F.col("value") > min_value)


def numbered_steps(history: DataFrame, trial: str, ts: str, tie: str) -> DataFrame:
    """Add ``step`` (1..n per trial in order of ``ts``, then ``tie``) without a window per whole trial."""
    bucketed = with_order_bucket(history.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))), "_at")
    return running(bucketed, [trial], ["_at", tie], {"step": ("sum", F.lit(1))}).drop("_at", "_a", "_b")


def early_stop_trace(history: DataFrame, patience: int = 3) -> DataFrame:
    """Per trial and step: best so far, steps since the last strict gain, and whether training has stopped.

    Needs trial, step (1..n), value. The running maximum of (value, -step) holds
    the best value and the first step that reached it, so one pass of running
    values over bounded buckets gives the trace; a trial of any length is spread.
    """
    bucketed = with_order_bucket(history, "step")
    top = F.struct(F.col("value").alias("v"), (-F.col("step")).alias("s"))
    best = running(bucketed, ["trial"], ["step"], {"_top": ("max", top)})
    waited = best.withColumn("best", F.col("_top.v")).withColumn(
        "wait", (F.col("step") + F.col("_top.s")).cast("int")
    )
    stops = running(waited, ["trial"], ["step"], {"_stopped": ("max", (F.col("wait") >= patience).cast("int"))})
    return stops.select(
        "trial", "step", "value", "best", (F.col("wait") == 0).alias("improved"), "wait",
        (F.col("_stopped") == 1).alias("stopped"),
    )


def early_stop_step(trace: DataFrame) -> DataFrame:
    """First stopped step per trial, null if it never stops, and the best value up to there."""
    return trace.groupBy("trial").agg(
        F.min(F.when(F.col("stopped"), F.col("step"))).alias("stop_step"),
        F.max(F.when(~F.col("stopped"), F.col("best"))).alias("best_running"),
    )


def running_f1(pred: DataFrame, order: str, length: Column) -> DataFrame:
    """Weighted F1 over the rows so far (two classes) and the longest prompt so far, in ``order``."""
    flag = lambda t, p: ((F.col("y_true") == t) & (F.col("y_pred") == p)).cast("bigint")
    bucketed = with_order_bucket(pred.withColumn("_length", length), order)
    sums = running(
        bucketed, [], [order],
        {
            "tp": ("sum", flag(1, 1)), "tn": ("sum", flag(0, 0)), "fp": ("sum", flag(0, 1)), "fn": ("sum", flag(1, 0)),
            "longest": ("max", F.col("_length")),
        },
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    f1_one = _ratio(2 * tp, 2 * tp + fp + fn)
    f1_zero = _ratio(2 * tn, 2 * tn + fp + fn)
    weighted = (f1_one * (tp + fn) + f1_zero * (tn + fp)) / (tp + tn + fp + fn)
    return sums.select(order, weighted.alias("f1"), "longest")


def length_stats(df: DataFrame, length: str, accuracy: int | None = None) -> DataFrame:
    """Longest and 95th percentile (linear interpolation, truncated); a row, of nulls without lengths.

    Exact by default, by passes of counts over ``df`` when it is called; ``accuracy`` switches to the mergeable sketch
    of a single pass.
    """
    if accuracy is None:
        p95 = F.lit(exact_quantile(df, length, 0.95)).cast("double")
    else:
        p95 = F.percentile_approx(length, 0.95, accuracy)
    return df.agg(F.max(length).alias("max_length"), F.floor(F.round(p95, 6)).cast("bigint").alias("p95_length"))


def report_table(pred: DataFrame, params: dict) -> DataFrame:
    """The report and the parameters as rows (section, name, metric, value), ready to store."""
    report = classification_report(pred).select(
        F.lit("metrics").alias("section"),
        F.col("label").alias("name"),
        F.inline(
            F.array(*[
                F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), 9).cast("string").alias("value"))
                for m in ("precision", "recall", "f1", "support")
            ])
        ),
    )
    if not params:
        return report
    settings = report.sparkSession.createDataFrame(
        [("hyperparameters", str(k), "value", str(v)) for k, v in sorted(params.items())],
        "section string, name string, metric string, value string",
    )
    return report.unionByName(settings)
