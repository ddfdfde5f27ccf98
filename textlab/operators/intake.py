"""Prompts for generated stories, running a model over a table, accepting stories without repeats."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions import fixed
from textlab.functions.text import extract_title_text, fill, text_stats, uniform
from textlab.plans.components import components
from textlab.plans.durable import checkpointed


def prompt_table(ids: DataFrame, id_col: str, seed: int = 42, min_tokens: int = 512, max_tokens: int = 1024) -> DataFrame:
    """A prompt per id: theme, structure, token budget, temperature and optional clauses, all fixed by the seed."""
    key = F.col(id_col)

    def pick(values, what: str) -> Column:
        place = (uniform(f"{seed}:{what}", key) * len(values)).cast("int") + 1
        return F.element_at(F.array(*[F.lit(v) for v in values]), place)

    head = fixed.PROMPT_HEAD.replace("{theme}", "{}").replace("{structure}", "{}")
    clauses = [
        F.when(uniform(f"{seed}:clause{i}", key) < p, clause).otherwise("")
        for i, (clause, p) in enumerate(fixed.PROMPT_CLAUSES)
    ]
    chosen = ids.select(id_col, pick(fixed.THEMES, "theme").alias("theme"), pick(fixed.STRUCTURES, "structure").alias("structure"))
    return chosen.select(
        id_col,
        "theme",
        "structure",
        (F.lit(min_tokens) + (uniform(f"{seed}:tokens", key) * (max_tokens - min_tokens)).cast("int")).alias("max_new_tokens"),
        (F.lit(0.8) + uniform(f"{seed}:temperature", key) * 0.4).alias("temperature"),
        F.concat(fill(head, F.col("theme"), F.col("structure")), *clauses, F.lit(fixed.PROMPT_TAIL)).alias("prompt"),
    )


_MODELS: dict[str, Any] = {}


def _loaded(call: str, load: Callable[[], Any]) -> Any:
    """The model of a call in this worker; one at a time."""
    if call not in _MODELS:
        _MODELS.clear()
        _MODELS[call] = load()
    return _MODELS[call]


def batch_infer(
    df: DataFrame,
    text_col: str,
    load: Callable[[], Any],
    infer: Callable[[Any, list[str]], list[str]],
    name: str = "response",
) -> DataFrame:
    """Add ``infer(model, texts)`` as a column.

    ``load`` runs once per Python worker and is kept for its later tasks; the Arrow batches
    stream through the model. Set ``spark.sql.execution.arrow.maxRecordsPerBatch`` for the
    batch size. Ids travel in the row, so answers cannot be mismatched.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    call = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded(call, load)
        for batch in batches:
            answers = infer(model, batch[text_col].tolist())
            if len(answers) != len(batch):
                raise ValueError(f"{len(answers)} answers for {len(batch)} texts")
            yield batch.assign(**{name: answers})

    return df.mapInPandas(run, ", ".join([*fields, f"`{name}` string"]))


#: Rounds of firsts before what is left is cut into components.
ROUNDS = 6
#: Rows that one task walks in order; also the links whose components one task finds.
WALK = 1 << 17


def accept_keys(
    candidates: DataFrame, order: str, title: str, prefix: str, rounds: int = ROUNDS, walk: int = WALK
) -> DataFrame:
    """(order, title, prefix) of the rows a first-come acceptance takes.

    In order, a row is taken when neither its title nor its prefix belongs to a row taken before; a row not
    taken blocks nobody. A round takes every row that is first for both its title and its prefix and drops all
    rows sharing a key with them. Most rows are decided in a few such rounds; chains of rows that block one
    another are not, they lose a link or two a round. So after ``rounds`` of them the rest is cut into connected
    components, which share no keys, and tasks walk whole components in order, about ``walk`` rows each.
    Of a component of more rows only the first go, up to a row drawn so that ``walk`` / 8 are expected; the later ones lose
    those that share a key with a row taken, and go through the same again.

    A title or prefix that most rows share is never gathered in the rounds: firsts are found by map-side
    minimum, the two tables of firsts meet on the unique order, and the rows to drop go through anti joins
    that adaptive execution may split. Keys must not be null.
    """
    # Of rows equal in both keys only the first can be taken.
    undecided = checkpointed(candidates.groupBy(title, prefix).agg(F.min(order).alias(order)))
    taken = candidates.select(order, title, prefix).limit(0)
    steps = 0
    while left := undecided.count():
        steps += 1
        if steps % (rounds + 1) and left > walk:
            winners = _firsts(undecided, order, title, prefix)
        else:
            winners = _walked(undecided, left, order, title, prefix, walk)
        winners = checkpointed(winners)
        taken = taken.unionByName(winners)
        if left <= walk:
            break  # all of it was walked
        if steps % 16 == 0:
            taken = checkpointed(taken)
        undecided = checkpointed(
            undecided.join(winners.select(title), title, "left_anti").join(winners.select(prefix), prefix, "left_anti")
        )
    return taken


def _firsts(undecided: DataFrame, order: str, title: str, prefix: str) -> DataFrame:
    """Rows that are first for their title and for their prefix."""
    by_title = undecided.groupBy(title).agg(F.min(F.struct(order, prefix)).alias("f"))
    by_prefix = undecided.groupBy(prefix).agg(F.min(order).alias(order))
    return (
        by_title.select(F.col(f"f.{order}").alias(order), title, F.col(f"f.{prefix}").alias("_p"))
        .join(by_prefix, order)
        .where(F.col("_p") == F.col(prefix))
        .select(order, title, prefix)
    )


def _walked(undecided: DataFrame, rows: int, order: str, title: str, prefix: str, walk: int) -> DataFrame:
    """Rows taken among whole components, or among the first rows of components larger than ``walk``."""
    if rows <= walk:
        grouped = undecided.withColumn("_bin", F.lit(0))
    else:
        # Equal hashes of different keys only join components, which changes no decision.
        ends = undecided.withColumns({"_u": F.xxhash64(F.lit("t"), title), "_v": F.xxhash64(F.lit("p"), prefix)})
        member = checkpointed(ends.join(components(ends.select("_u", "_v"), walk), "_u"))
        sizes = member.groupBy("_component").agg(F.count(F.lit(1)).alias("_n"))
        large = sizes.where(F.col("_n") > walk)
        grouped = member.join(large, "_component", "left")
        # The first rows of a large component: up to the smallest order of a sample of one row in walk / 8.
        drawn = grouped.where("_n IS NOT NULL").where(F.pmod(F.xxhash64(F.lit("cut"), order), F.lit(max(1, walk // 8))) == 0)
        cuts = drawn.groupBy("_component").agg(F.min(order).alias("_cut"))
        grouped = grouped.join(cuts, "_component", "left").where(
            F.col("_n").isNull() | F.col("_cut").isNull() | (F.col(order) <= F.col("_cut"))
        )
        bins = max(1, 2 * rows // walk)
        grouped = grouped.withColumn("_bin", F.pmod(F.xxhash64("_component"), F.lit(bins)))

    def in_order(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        titles, prefixes, kept = set(), set(), []
        for t, p in zip(group[title], group[prefix]):
            free = t not in titles and p not in prefixes
            kept.append(free)
            if free:
                titles.add(t)
                prefixes.add(p)
        return group.loc[kept, [order, title, prefix]]

    columns = [order, title, prefix]
    schema = T.StructType([undecided.schema[c] for c in columns])
    return grouped.select("_bin", *columns).groupBy("_bin").applyInPandas(in_order, schema)


def candidate_keys(df: DataFrame, order: str, title: Column, text: Column, prefix: int = 100, min_len: int = 200) -> DataFrame:
    """order and the digests of title and text prefix, for the rows long enough to be considered.

    A null title equals no other title; a null text is not considered.
    """
    own = F.concat(F.lit("no title"), F.col(order).cast("string")).cast("binary")
    return df.where(F.length(text) > min_len).select(
        F.col(order),
        F.coalesce(F.unhex(F.sha2(title, 256)), own).alias("_title"),
        F.unhex(F.sha2(F.substring(text, 1, prefix), 256)).alias("_prefix"),
    )


def accept_unique(
    df: DataFrame,
    order: str,
    title: Column,
    text: Column,
    prefix: int = 100,
    min_len: int = 200,
    limit: int | None = None,
) -> DataFrame:
    """Rows accepted first-come by title and text prefix; ``order`` must be unique.

    ``limit`` keeps the first accepted rows; later rows have no say in earlier ones.
    """
    taken = accept_keys(candidate_keys(df, order, title, text, prefix, min_len), order, "_title", "_prefix").select(order)
    if limit is not None:
        taken = taken.orderBy(order).limit(limit)
    return df.join(taken, order, "left_semi")


def generated_stories(df: DataFrame, order: str, generated: str, limit: int | None = None) -> DataFrame:
    """Stories read from generated texts, without repeats, with their metrics and score 0.

    ``df`` also has the ``theme`` and ``structure`` that were asked for.
    """
    read = df.select(order, "theme", "structure", extract_title_text(F.col(generated)).alias("_s")).where("_s IS NOT NULL")
    stories = read.select(order, F.col("_s.title").alias("title"), F.col("_s.text").alias("text"), "theme", "structure")
    accepted = accept_unique(stories, order, F.col("title"), F.col("text"), limit=limit)
    stats = text_stats(F.col("text"))
    return accepted.select(
        order, "title", "text", "theme", "structure", *[c.alias(n) for n, c in stats.items()], F.lit(0).alias("score")
    )
