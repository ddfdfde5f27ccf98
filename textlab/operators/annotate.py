"""Nested annotations to training tables.

A story row holds its sentences and annotations, so these jobs are row-local:
they scan, project and explode, without a shuffle. The long form (one row per
annotation) is for annotations that arrive as a flat table; it aggregates
map-side before its single shuffle.

Stories have the schema of ``textlab.sources.stories.STORY_COLUMNS``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions import fixed
from textlab.functions.scores import binarize_drop_mid, binarize_keep_mid, binarize_score_map
from textlab.functions.text import fill, let, mark_empty, normalized, split_sentences, story_text, strip
from textlab.operators.rows import document_lemmas, with_lemmas

FLAGS = [f"r{k}" for k in fixed.REASONS]


def sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per sentence: id, 0-based ``pos``, ``sentence``."""
    return df.select(id_col, F.posexplode(split_sentences(F.col(text_col))).alias("pos", "sentence"))


def reasons_long(stories: DataFrame) -> DataFrame:
    """One row per (story, annotator, sentence id, reason)."""
    by_annotator = stories.select("story_id", F.explode("incremental.reasons").alias("annotator", "marked"))
    by_sentence = by_annotator.select("story_id", "annotator", F.explode("marked").alias("sentence_key", "reasons"))
    return by_sentence.select(
        "story_id",
        "annotator",
        F.expr("try_cast(sentence_key AS INT)").alias("sentence_id"),
        F.explode("reasons").alias("reason"),
    )


def sentence_flags(reasons: DataFrame, base: int) -> DataFrame:
    """``r1..r7`` per (story, pos): set when any annotator gave the reason.

    ``base`` is the id the annotators give the first sentence (0 or 1). Only
    ``annot*`` keys count; other reasons set nothing.
    """
    marked = reasons.where(F.col("annotator").startswith("annot"))
    return marked.groupBy("story_id", (F.col("sentence_id") - base).cast("int").alias("pos")).agg(
        *[F.max(F.when(F.col("reason") == k, 1).otherwise(0)).alias(f"r{k}") for k in fixed.REASONS]
    )


def flag_sentences(sentence_rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Sentences with their flags, 0 where nobody marked them; stray flags drop out."""
    return sentence_rows.join(flags, ["story_id", "pos"], "left").fillna(0, subset=FLAGS)


def stray_annotations(sentence_rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Marked positions that name no sentence, counted per story."""
    return (
        flags.join(sentence_rows, ["story_id", "pos"], "left_anti")
        .groupBy("story_id")
        .agg(F.count(F.lit(1)).alias("strays"))
    )


def story_flags(flags: DataFrame) -> DataFrame:
    """A story has a flag when one of its sentences has it."""
    return flags.groupBy("story_id").agg(*[F.max(f).alias(f) for f in FLAGS])


def reason_text(flag_of, sentence: Column) -> Column:
    """What is wrong with a sentence: the first reason in full, the others appended.

    ``flag_of(k)`` is the condition that reason ``k`` is set.
    """
    pieces = []
    earlier = F.lit(False)
    for k in fixed.REASONS:
        here = flag_of(k)
        opening = fill(fixed.REASON_OPENINGS[k], sentence)
        if k in fixed.REASON_CONTINUATIONS:
            piece = F.when(here & earlier, fixed.REASON_CONTINUATIONS[k]).when(here, opening)
        else:
            piece = F.when(here, opening)
        pieces.append(piece.otherwise(""))
        earlier = earlier | here
    return F.concat(*pieces)


def sentence_reason_text(flagged: DataFrame) -> DataFrame:
    """Add ``reason_text`` to sentences with flag columns ``r1..r7``."""
    return flagged.withColumn(
        "reason_text", reason_text(lambda k: F.col(f"r{k}") == 1, F.col("sentence"))
    )


def cot_block(score: Column, problems: Column) -> Column:
    """The worked assessment of a story from its score and its list of problems."""
    listed = F.when(strip(problems) == "", fixed.NO_PROBLEMS).otherwise(problems)
    block = None
    for value, (opening, conclusion) in fixed.VERDICTS.items():
        text = F.concat(
            F.lit(fixed.ASSESSMENT_HEAD + opening + fixed.ASSESSMENT_PROBLEMS),
            listed,
            F.lit(fixed.ASSESSMENT_END + conclusion),
        )
        block = F.when(score == value, text) if block is None else block.when(score == value, text)
    return block.otherwise(fixed.INVALID_SCORE)


def _reasons_at(reasons: Column, sentence_id: Column, prefix: str = "annot") -> Column:
    """All reasons given against one sentence id, over the annotators with ``prefix``."""
    named = F.map_filter(reasons, lambda who, _: who.startswith(prefix)) if prefix else reasons
    none = F.array().cast("array<int>")
    return F.flatten(
        F.transform(
            F.map_values(named),
            lambda marked: F.coalesce(F.try_element_at(marked, sentence_id.cast("string")), none),
        )
    )


def _with_problems(stories: DataFrame) -> DataFrame:
    """Add ``marks`` (reasons per sentence, 0-based ids) and ``problems`` (their text)."""
    sents = F.col("incremental.sentences")
    marks = F.transform(sents, lambda _, i: _reasons_at(F.col("incremental.reasons"), i))
    texts = F.zip_with(
        sents, F.col("marks"), lambda s, given: reason_text(lambda k: F.array_contains(given, k), s)
    )
    problems = F.array_join(
        F.transform(
            F.filter(texts, lambda t: t != ""), lambda t: F.concat(F.lit(fixed.PROBLEM_SEPARATOR), t)
        ),
        "",
    )
    return stories.withColumn("marks", marks).withColumn("problems", problems)


def _story_flag_columns() -> list[Column]:
    given = F.flatten("marks")
    return [F.array_contains(given, k).cast("int").alias(f"r{k}") for k in fixed.REASONS]


def cot_dataset(stories: DataFrame) -> DataFrame:
    """id, text, score, worked assessment and story flags: one row per story, no shuffle."""
    return _with_problems(stories).select(
        "story_id",
        story_text(F.col("title"), F.col("text")).alias("text"),
        F.col("incremental.consensus_score").alias("score"),
        cot_block(F.col("incremental.consensus_score"), F.col("problems")).alias("cot"),
        *_story_flag_columns(),
    )


def binary_reason_dataset(stories: DataFrame, cot_from_binary: bool = False) -> DataFrame:
    """``cot_dataset`` with a 0/1 score and each annotator's 0/1 holistic score.

    The assessment uses the raw 1..5 score; ``cot_from_binary=True`` feeds it the
    0/1 score instead, where only 1 has a wording.
    """
    raw = F.col("incremental.consensus_score")
    binary = binarize_keep_mid(raw)
    return _with_problems(stories).select(
        "story_id",
        story_text(F.col("title"), F.col("text")).alias("text"),
        binary.alias("score"),
        cot_block(binary if cot_from_binary else raw.cast("int"), F.col("problems")).alias("cot"),
        F.col("holistic.num_annotators").alias("num_annotators"),
        binarize_score_map(F.col("holistic.scores")).alias("holistic_scores_per_annotator"),
        *_story_flag_columns(),
    )


def _merged_sentences(base: int) -> Column:
    """Array of (pos, key, reasons) per distinct sentence of a story, by position.

    Sentences equal after lower-casing and stripping are one: the first position
    stays and the reasons are pooled.
    """
    sents = F.col("incremental.sentences")
    keyed = F.transform(
        sents,
        lambda s, i: F.struct(
            strip(F.lower(s)).alias("key"),
            i.alias("pos"),
            _reasons_at(F.col("incremental.reasons"), i + base, prefix="").alias("reasons"),
        ),
    )

    def merge(ordered: Column, marked: Column) -> Column:
        first = F.filter(ordered, lambda r, i: (i == 0) | (F.get(ordered, i - 1)["key"] != r["key"]))
        pooled = F.transform(
            first,
            lambda r: F.struct(
                r["pos"].alias("pos"),
                r["key"].alias("key"),
                F.flatten(
                    F.transform(F.filter(marked, lambda m: m["key"] == r["key"]), lambda m: m["reasons"])
                ).alias("reasons"),
            ),
        )
        return F.array_sort(pooled)

    # Sorted by (key, pos), equal sentences are neighbours and the first of a run is the earliest.
    return let(
        F.array_sort(keyed),
        lambda ordered: let(
            F.filter(ordered, lambda r: F.size(r["reasons"]) > 0), lambda marked: merge(ordered, marked)
        ),
    )


def _flag_fields(reasons: Column, score: Column, reason8: str) -> list[Column]:
    if reason8 not in ("ignore", "set_score"):
        raise ValueError(f"unknown reason8 {reason8!r}")
    if reason8 == "set_score":
        outside = F.array_contains(reasons, 8) | F.array_contains(reasons, 0)
        score = F.when(outside, F.lit(1.0)).otherwise(score)
    return [score.alias("score")] + [F.array_contains(reasons, k).cast("int").alias(f"r{k}") for k in fixed.REASONS]


def incremental_flags(stories: DataFrame, base: int = 1, reason8: str = "ignore") -> DataFrame:
    """One row per distinct sentence of a story: key, first position, score, ``r1..r7``."""
    rows = stories.select(
        "story_id",
        F.col("incremental.consensus_score").alias("_score"),
        F.inline(_merged_sentences(base)),
    )
    return rows.select(
        "story_id", "pos", F.col("key").alias("sentence"), *_flag_fields(F.col("reasons"), F.col("_score"), reason8)
    )


def _context(title: Column, previous: Column, current: Column) -> Column:
    return strip(F.concat(title, F.lit(" - "), F.concat_ws(" ", previous, current)))


def _lemmatizer(stories: DataFrame, texts: list[Column], lemmas: DataFrame | None) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Stories with what their normalised words become, and the function that puts lemmas into a normalised text."""
    if lemmas is None:
        return stories, lambda text: text
    spaced = lambda text: F.split(text, " ")
    known = document_lemmas(stories, "story_id", F.filter(F.flatten(F.array(*texts)), lambda w: w != ""), lemmas)
    return known, lambda text: with_lemmas(spaced(text), F.col("_lemmas"))


def incremental_context(
    stories: DataFrame, base: int = 1, reason8: str = "ignore", lemmas: DataFrame | None = None, **normalize_options
) -> DataFrame:
    """Each sentence after its predecessor and the title, all normalised.

    Sentences that normalise to nothing are dropped first, so the predecessor is
    the last kept one. With a table of ``lemmas`` (word, lemma) normalised words are replaced by their
    lemma; without one the job is row-local.
    """
    norm = lambda text: normalized(text, **normalize_options)
    sentences = F.flatten(F.transform("incremental.sentences", lambda s: F.split(norm(s), " ")))
    stories, lemma = _lemmatizer(stories, [F.split(norm(F.col("title")), " "), sentences], lemmas)
    kept = F.filter(
        F.transform(
            _merged_sentences(base),
            lambda m: F.struct(
                lemma(normalized(m["key"], **normalize_options)).alias("norm"), m["pos"].alias("pos"), m["reasons"].alias("reasons")
            ),
        ),
        lambda m: m["norm"] != "",
    )
    # The title is bound once per story; outside the generator it would be redone per sentence.
    with_context = let(
        kept,
        lambda rows: let(
            lemma(normalized(F.col("title"), **normalize_options)),
            lambda title: F.transform(
                rows,
                lambda m, i: F.struct(
                    m["pos"].alias("pos"),
                    _context(title, F.get(rows, i - 1)["norm"], m["norm"]).alias("sentence"),
                    m["reasons"].alias("reasons"),
                ),
            ),
        ),
    )
    exploded = stories.select(
        "story_id", F.col("incremental.consensus_score").alias("_score"), F.inline(with_context)
    )
    return exploded.select(
        "story_id", "pos", "sentence", *_flag_fields(F.col("reasons"), F.col("_score"), reason8)
    )


def context_rows(
    rows: DataFrame, id_col: str, order: str, text_col: str, title: Column | None = None, **normalize_options
) -> DataFrame:
    """``incremental_context`` for sentences (or turns) that already are rows.

    Predecessors come from ``previous_value``, so a group of any size is spread
    over many tasks.
    """
    from textlab.plans.ordered import previous_value

    kept = rows.withColumn("_current", normalized(F.col(text_col), **normalize_options)).where("_current <> ''")
    chained = previous_value(kept, [id_col], order, "_current", "_previous")
    head = F.lit("") if title is None else title
    return chained.select(
        id_col, order, _context(head, F.col("_previous"), F.col("_current")).alias("sentence")
    )


def holistic_dataset(stories: DataFrame, lemmas: DataFrame | None = None, **normalize_options) -> DataFrame:
    """Normalised "title - text" with a 0/1 score, by lemmas where a table is given; stories scored 3 are left out."""
    spaced = [F.split(normalized(F.col(c), **normalize_options), " ") for c in ("title", "text")]
    stories, lemma = _lemmatizer(stories, spaced, lemmas)
    return stories.select(
        "story_id",
        F.concat(
            lemma(normalized(F.col("title"), **normalize_options)),
            F.lit(" - "),
            mark_empty(lemma(normalized(F.col("text"), **normalize_options))),
        ).alias("sentence"),
        binarize_drop_mid(F.col("holistic.consensus_score")).alias("score"),
    ).where("score <> -1")
