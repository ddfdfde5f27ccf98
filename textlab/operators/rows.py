"""Row-level operators over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.scores import extract_score, resolve_missing_score
from textlab.functions.text import clean_model_output, fill, words
from textlab.operators.features import typical
from textlab.plans.layout import join_frequent


def join_text_columns(df: DataFrame, columns: list[str], new: str, sep: str = "-", null_token: str = "") -> DataFrame:
    """Join columns as text into ``new``, which comes first and replaces them."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    joined = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(null_token)) for c in columns])
    return df.select(joined.alias(new), *[c for c in df.columns if c not in columns])


def document_lemmas(df: DataFrame, id_col: str, found: Column, lemmas: DataFrame, name: str = "_lemmas") -> DataFrame:
    """``df`` with ``name``: a map of the words in the array ``found`` that ``lemmas`` (word, lemma) lists to their lemma.

    Only the distinct words of a document meet the table, frequent ones in parts by the document; what comes
    back are the few that change.
    """

    def distinct(docs: DataFrame) -> DataFrame:
        return docs.select(id_col, F.explode(F.array_distinct(found)).alias("word"))

    changed = join_frequent(distinct(df), lemmas.select("word", "lemma"), "word", id_col, measured=distinct(typical(df)))
    maps = changed.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias(name))
    return df.join(maps, id_col, "left")


def with_lemmas(found: Column, lemmas: Column) -> Column:
    """The words of an array, each by its lemma where the map has one, joined by one space."""
    return F.array_join(F.transform(found, lambda w: F.coalesce(F.try_element_at(lemmas, w), w)), " ")


def lemmatize(df: DataFrame, id_col: str, text_col: str, lemmas: DataFrame) -> DataFrame:
    """Replace every word that ``lemmas`` (word, lemma) lists by its lemma; words re-join with one space.

    The table may be of any size; ``lemmas`` has a row per word.
    """
    found = words(F.col(text_col))
    known = document_lemmas(df, id_col, found, lemmas)
    return known.withColumn(text_col, F.coalesce(with_lemmas(found, F.col("_lemmas")), F.lit(""))).select(*df.columns)


def render_chat(df: DataFrame, user_template: str, assistant_template: str, text: Column, reasoning: Column,
                score: Column) -> DataFrame:
    """Add ``messages``: the user turn with the text, the assistant turn with reasoning and score tag."""
    tag = F.concat(F.lit("<score>"), score.cast("string"), F.lit("</score>"))
    turns = [("user", fill(user_template, text)), ("assistant", fill(assistant_template, reasoning, tag))]
    return df.withColumn(
        "messages",
        F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns]),
    )


def render_text(messages: Column) -> Column:
    """One text from chat messages: a heading per role, then the content."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n"
    )


def read_scores(df: DataFrame, text: Column, truth: Column, variant: str = "last_binary", policy: str = "const_0") -> DataFrame:
    """Add ``y_true``, ``y_pred`` and ``parse_failed`` from model answers.

    Policy ``drop`` removes the rows without a score; the others fill one in.
    """
    answer = clean_model_output(text) if variant == "last_binary" else text
    read = df.withColumn("_score", extract_score(answer, variant)).withColumn("y_true", truth)
    out = read.withColumn("parse_failed", F.col("_score").isNull()).withColumn(
        "y_pred", resolve_missing_score(F.col("_score"), F.col("y_true"), policy)
    )
    if policy == "drop":
        out = out.where("NOT parse_failed")
    return out.drop("_score")
