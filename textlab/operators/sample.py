"""Balancing, splitting and sampling with exact sizes.

Which rows are taken is fixed by a seeded hash of the id, so a result does not
depend on partitioning and can be repeated. Ranks come from
``plans.ordered.class_rank``; a class of any size is ranked in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlab.functions import fixed
from textlab.plans.ordered import class_rank


def downsample_class(df: DataFrame, label: str, cls, n: int, id_col: str, seed=42) -> DataFrame:
    """Cut class ``cls`` to ``n`` rows; the other classes stay whole."""
    ranked = class_rank(df.where(F.col(label) == cls), [label], id_col, seed)
    kept = ranked.where(F.col("rank") <= n).select(*df.columns)
    others = df.where(~F.col(label).eqNullSafe(cls))
    return others.unionByName(kept)


def undersample_to_minority(df: DataFrame, label: str, id_col: str, seed=42) -> DataFrame:
    """Cut every class to the size of the smallest."""
    smallest = df.groupBy(label).count().agg(F.min("count").alias("n")).scalar()
    return class_rank(df, [label], id_col, seed).where(F.col("rank") <= smallest).select(*df.columns)


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """One row per class: rows, and rows of the classes before it (by label value)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_rows"))
    earlier = W.partitionBy(F.lit(0)).orderBy(label).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("rows_before", F.coalesce(F.sum("class_rows").over(earlier), F.lit(0)))


def stratified_kfold(df: DataFrame, label: str, k: int, id_col: str, seed=42) -> DataFrame:
    """Add ``fold`` (0..k-1): classes are dealt out one after the other, so folds are even in each class."""
    before = class_sizes(df, label).select(label, "rows_before")
    ranked = class_rank(df, [label], id_col, seed, per_class=before)
    return ranked.select(
        *df.columns, F.pmod(F.col("rows_before") + F.col("rank") - 1, F.lit(k)).cast("int").alias("fold")
    )


def random_split(df: DataFrame, test_size: float, id_col: str, seed=42) -> DataFrame:
    """Add ``split``: ceil(test_size * rows) rows are "test"."""
    ranked = class_rank(df, [], id_col, seed)
    n_test = F.ceil(F.lit(float(test_size)) * F.col("class_rows"))
    return ranked.withColumn("split", F.when(F.col("rank") <= n_test, "test").otherwise("train")).select(
        *df.columns, "split"
    )


def split_allotment(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """Test rows per class: ceil(test_size * rows) in all, shared out by largest remainder of the train side."""
    one = W.partitionBy(F.lit(0))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    total = sizes.withColumn("n", F.sum("c").over(one))
    train = total.withColumn("n_train", F.col("n") - F.ceil(F.lit(float(test_size)) * F.col("n")))
    shares = train.withColumn("whole", F.expr("(c * n_train) DIV n")).withColumn("rest", F.expr("(c * n_train) % n"))
    missing = F.col("n_train") - F.sum("whole").over(one)
    order = F.row_number().over(one.orderBy(F.col("rest").desc(), F.col(label)))
    return shares.withColumn("extra", (order <= missing).cast("int")).select(
        label, (F.col("c") - F.col("whole") - F.col("extra")).alias("n_test")
    )


def stratified_split(df: DataFrame, label: str, test_size: float, id_col: str, seed=42) -> DataFrame:
    """Add ``split`` with the class shares kept in "train" and "test"."""
    ranked = class_rank(df, [label], id_col, seed, per_class=split_allotment(df, label, test_size))
    return ranked.select(
        *df.columns, F.when(F.col("rank") <= F.col("n_test"), "test").otherwise("train").alias("split")
    )


def sample_shots(df: DataFrame, label: str, n: int, id_col: str, seed=42) -> DataFrame:
    """``n`` rows of class 0 and ``n`` of class 1, with their place ``shot`` (1..2n)."""
    two = df.where(F.col(label).isin(0, 1))
    ranked = class_rank(two, [label], id_col, seed).where(F.col("rank") <= n)
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(label, "rank"))  # at most 2n rows
    return ranked.withColumn("shot", place).select(*df.columns, "shot")


def balanced_eval_subset(df: DataFrame, label: str, classes: list, k: int | None, id_col: str, seed=42) -> DataFrame:
    """The same number of rows of each class in ``classes``: ``k``, or the smallest class if that is less."""
    wanted = df.where(F.col(label).isin(*classes))
    smallest = wanted.groupBy(label).count().agg(F.min("count").alias("n")).scalar()
    size = smallest if k is None else F.least(F.lit(k), smallest)
    return class_rank(wanted, [label], id_col, seed).where(F.col("rank") <= size).select(*df.columns)


def few_shot_prompts(test: DataFrame, shots: DataFrame, prompt: str, text: Column) -> DataFrame:
    """Add ``prompt``: instructions, the worked examples, then the row's text.

    ``shots`` has shot, text, cot and score of a few examples; they become one
    value, read once and inlined into every row.
    """
    parts = fixed.SHOT_FORMAT
    pieces = []
    for name, column in (("n", F.col("shot")), ("text", F.col("text")), ("reasoning", F.col("cot")), ("score", F.col("score"))):
        head, parts = parts.split("{" + name + "}")
        pieces += [F.lit(head), column.cast("string")]
    example = F.concat(*pieces, F.lit(parts))
    examples = shots.agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("shot", example.alias("e")))), lambda s: s["e"]), ""
        ).alias("examples")
    ).scalar()
    head = prompt.split(fixed.INPUT_MARK)[0] + fixed.SHOTS_HEAD
    return test.withColumn(
        "prompt", F.concat(F.lit(head), examples, F.lit(fixed.SHOTS_END), text, F.lit(fixed.SHOTS_ASK))
    )
