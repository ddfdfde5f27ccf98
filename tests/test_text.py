import re

import pytest
from pyspark.sql import functions as F

from textlab.functions import fixed, scores, text
from textlab.operators import rows


def one(spark, value, column, type_="string"):
    return spark.createDataFrame([(value,)], f"t {type_}").select(column(F.col("t"))).head()[0]


def test_fixed_tables():
    assert len(fixed.STOP_WORDS) == 153 == len(set(fixed.STOP_WORDS))
    assert len(fixed.THEMES) == 41 and len(fixed.STRUCTURES) == 10
    assert all(c.isspace() for c in fixed.WHITESPACE)


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("It is.", "REMOVE"), ("Don't go there!", "dont go"), ("  The  CAT\tsat\n(down). ", "cat sat"), ("", "REMOVE"), ("a dog", "dog"),
        ("É lan — vital!", "é lan — vital"), ("__x__ [y]", "x"),
    ],
)
def test_normalize(spark, raw, expected):
    assert one(spark, raw, text.normalize_text) == expected


def test_normalize_options(spark):
    assert one(spark, " The Cat. ", lambda c: text.normalize_text(c, lower=False, strip_punct=False, stopwords=())) == "The Cat."
    assert one(spark, "   ", lambda c: text.normalize_text(c, stopwords=())) == "REMOVE"


def test_clean_text(spark):
    assert one(spark, 'A [b] <c> "d" \\ {e}', lambda c: text.clean_text(c, lower=True)) == "a b c d  e"


def test_whole_corpus_against_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = docs.select(
        "text", text.normalize_text(F.col("text")).alias("n"), text.split_sentences(F.col("text")).alias("s"),
        text.words(F.col("text")).alias("w"), *[c.alias(k) for k, c in text.text_stats(F.col("text")).items()],
    ).collect()
    assert len(got) == 200
    for r in got:
        assert r.n == "REMOVE" or not set(r.n.split(" ")) & (set(fixed.STOP_WORDS) | {""}) and not set(r.n) & set(fixed.ASCII_PUNCTUATION)
        parts = [p.strip() for p in re.findall(r"[^.!?]+[.!?]*", r.text)]
        assert r.s == [p for p in parts if p]
        assert r.w == r.text.split()
        words = r.text.split()
        assert r.word_count == len(words)
        assert abs(r.diversity_score - (len(set(r.text.lower().split())) / len(words) if words else 0)) <= 0.005 + 1e-9


@pytest.mark.parametrize(
    "raw,expected",
    [
        ('Title: "A" Text: one\ntwo', ("A", "one two")), ("Title: A\nText: x Title: B\nText: y\n", ("B", "y")), ("no story", None),
        ("Title: only", None), ('Title: A Title: B Text: "z"', ("A Title: B", "z")), ("Title:  Text: \nq\n\n", ("", "q")),
    ],
)
def test_extract_title_text(spark, raw, expected):
    got = one(spark, raw, text.extract_title_text)
    assert (got and (got.title, got.text)) == expected


def test_clean_model_output(spark):
    raw = "<think>a\n<score>1</score></think>HiĠthereĊxĉyâĢĻs \n"
    assert one(spark, raw, text.clean_model_output) == "Hi there\nx\ty's"
    assert one(spark, None, text.clean_model_output) == ""


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("<score>1</score>", 1), ("<score> 0 </score>", 0), ("<score>0</score> <score>1</score>", 1), ("## Score: 1", 1),
        ("Final score - 0", 0), ("score: 12", None), ("<score>5</score>", None), ("none", None),
        ("Score: 1 <score>0</score>", 0), ("SCORE1", 1), ("score: 1é", None),
    ],
)
def test_last_binary(spark, raw, expected):
    assert one(spark, raw, scores.extract_score) == expected


def test_other_score_variants(spark):
    assert one(spark, "<score> 42 </score><score>1</score>", lambda c: scores.extract_score(c, "first_int")) == 42
    assert one(spark, "<score>9</score> ## Response: <score>3</score>", lambda c: scores.extract_score(c, "first_digit")) == 3
    assert one(spark, "<score>9</score>", lambda c: scores.extract_score(c, "first_digit")) is None
    with pytest.raises(ValueError):
        scores.extract_score(F.lit(""), "other")


@pytest.mark.parametrize(
    "policy,truth,expected",
    [("const_0", 1, 0), ("const_1", 0, 1), ("flip_true", 0, 1), ("flip_true", 1, 0), ("shift_true", 4, 5), ("shift_true", 5, 1), ("drop", 1, None)],
)
def test_missing_score_policies(spark, policy, truth, expected):
    df = spark.createDataFrame([(None, truth), (1, truth)], "p int, t int")
    got = [r[0] for r in df.select(scores.resolve_missing_score(F.col("p"), F.col("t"), policy)).collect()]
    assert got == [expected, 1]


def test_drop_policy_removes_rows(spark):
    df = spark.createDataFrame([("<score>1</score>", 1), ("none", 0)], "x string, t int")
    assert rows.read_scores(df, F.col("x"), F.col("t"), policy="drop").count() == 1
    kept = rows.read_scores(df, F.col("x"), F.col("t")).orderBy("t").collect()
    assert [(r.y_pred, r.parse_failed) for r in kept] == [(0, True), (1, False)]


def test_the_two_binarizations_disagree_on_three(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 2.0, 2.7, 3.0, 3.5, 5.0)], "s double")
    got = df.select(scores.binarize_drop_mid(F.col("s")).alias("a"), scores.binarize_keep_mid(F.col("s")).alias("b")).collect()
    assert [r.a for r in got] == [0, 0, 0, -1, 1, 1]
    assert [r.b for r in got] == [0, 0, 0, 1, 1, 1]
    with pytest.raises(Exception, match="invalid score"):
        spark.createDataFrame([(6.0,)], "s double").select(scores.binarize_keep_mid(F.col("s"))).collect()


def test_strip_prompt(spark):
    header = "x<|eot_id|><|start_header_id|>user<|end_header_id|>\n"
    assert one(spark, header + " ask \n## Response:\nanswer", text.strip_prompt) == "ask\n## Response:"
    assert one(spark, "ask", text.strip_prompt) == "ask\n## Response:"


def test_join_text_columns(spark):
    df = spark.createDataFrame([(1, "a", None, 2.5)], "id int, x string, y string, z double")
    out = rows.join_text_columns(df, ["x", "y", "z"], "t", null_token="nan")
    assert out.columns == ["t", "id"] and out.head().t == "a-nan-2.5"
    with pytest.raises(ValueError, match="nope"):
        rows.join_text_columns(df, ["nope"], "t")


def test_lemmatize(spark):
    df = spark.createDataFrame([(1, "cats and  dogs cats"), (2, "  "), (3, "none")], "id int, text string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "word string, lemma string")
    got = {r.id: r.text for r in rows.lemmatize(df, "id", "text", lemmas).collect()}
    assert got == {1: "cat and dog cat", 2: "", 3: "none"}


def test_render_chat(spark):
    df = spark.createDataFrame([("story", "why", 1)], "t string, c string, s int")
    m = rows.render_chat(df, "U {}", "A {} B {}", F.col("t"), F.col("c"), F.col("s")).head().messages
    assert [(x.role, x.content) for x in m] == [("user", "U story"), ("assistant", "A why B <score>1</score>")]
