"""Column functions over text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlab.functions import fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes.

    A column that a lambda refers to is re-evaluated for every element when the
    optimizer merges projections; binding it as a lambda variable prevents that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unicode_pattern(pattern: str) -> Column:
    """Pattern whose classes and line ends follow Unicode text, not ASCII."""
    return F.lit("(?Ud)" + pattern)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def words(text: Column) -> Column:
    """Whitespace tokens, none empty."""
    return F.filter(F.split(text, fixed.WHITESPACE_RUN), lambda w: w != "")


def vocabulary_words(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.lower(w))


def feature_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters, the tokens features count."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.FEATURE_TOKEN), F.lit(0))


def clean_text(text: Column, lower: bool = False) -> Column:
    """Delete the characters that break JSON or CSV cells."""
    return F.translate(F.lower(text) if lower else text, fixed.MARKUP_CHARACTERS, "")


def normalized(
    text: Column,
    lower: bool = True,
    strip_punct: bool = True,
    stopwords: Sequence[str] = fixed.STOP_WORDS,
) -> Column:
    """Strip, lower, delete punctuation, drop stop words, in this order; may be ''.

    Punctuation goes before the stop words are looked up, so "don't" is looked
    up as "dont" and stays.
    """
    out = strip(text)
    if lower:
        out = F.lower(out)
    if strip_punct:
        out = F.translate(out, fixed.ASCII_PUNCTUATION, "")
    if stopwords:
        kept = F.filter(
            F.split(out, fixed.WHITESPACE_RUN), lambda w: (w != "") & ~w.isin(*stopwords)
        )
        out = F.array_join(kept, " ")
    return out


def mark_empty(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\z", fixed.EMPTY_SENTENCE)


def normalize_text(text: Column, **options) -> Column:
    """``normalized`` with an emptied text marked ``REMOVE``."""
    return mark_empty(normalized(text, **options))


def split_sentences(text: Column) -> Column:
    """Sentences of a text, ended by . ! or ?, stripped, none blank."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def text_stats(text: Column) -> dict[str, Column]:
    """``word_count`` and ``diversity_score`` (distinct lower-cased words per word)."""
    tokens = words(text)
    count = F.size(tokens)
    distinct = F.size(F.array_distinct(F.transform(tokens, lambda w: F.lower(w))))
    return {
        "word_count": count,
        "diversity_score": F.when(count > 0, F.round(distinct / count, 2)).otherwise(F.lit(0.0)),
    }


def story_text(title: Column, text: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit(" Text: "), text)


def extract_title_text(generated: Column) -> Column:
    """Struct ``title, text`` of the last story in a generated text; null if there is none."""

    def matches(pattern: str) -> Column:
        p = unicode_pattern(pattern)
        return F.arrays_zip(
            F.regexp_extract_all(generated, p, F.lit(1)).alias("title"),
            F.regexp_extract_all(generated, p, F.lit(2)).alias("text"),
        )

    def last_story(found: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        return F.when(
            F.size(found) > 0,
            F.struct(
                F.btrim(strip(last["title"]), F.lit('"')).alias("title"),
                F.replace(
                    F.btrim(strip(last["text"]), F.lit('"')), F.lit("\n"), F.lit(" ")
                ).alias("text"),
            ),
        )

    strict = let(matches(fixed.TITLE_TEXT), last_story)
    loose = let(matches(fixed.TITLE_TEXT_LOOSE), last_story)
    return F.coalesce(strict, loose)


def clean_model_output(text: Column) -> Column:
    """Undo tokenizer leftovers, drop thinking blocks, strip; null becomes ''."""
    out = F.coalesce(text, F.lit(""))
    for leftover, plain in fixed.TOKENIZER_LEFTOVERS.items():
        out = F.replace(out, F.lit(leftover), F.lit(plain))
    return strip(F.regexp_replace(out, fixed.THINKING_BLOCK, ""))


def strip_prompt(text: Column) -> Column:
    """The prompt of a rendered example: up to the response mark, without system header."""
    head = strip(F.substring_index(text, fixed.RESPONSE_MARK, 1))
    prompt = F.concat(head, F.lit("\n" + fixed.RESPONSE_MARK))
    return F.regexp_replace(prompt, unicode_pattern(fixed.SYSTEM_HEADER), F.lit(""))


def fill(template: str, *values: Column) -> Column:
    """Put ``values`` in order into the ``{}`` places of a literal template."""
    parts = template.split("{}")
    if len(parts) != len(values) + 1:
        raise ValueError(f"template has {len(parts) - 1} places for {len(values)} values")
    pieces = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        pieces += [value, F.lit(part)]
    return F.concat(*pieces)


def uniform(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) fixed by seed and keys, the same in any partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
