import pytest
from pyspark.sql import functions as F

from textlab.functions import fixed
from textlab.operators import annotate
from textlab.sources.stories import read_story_json, write_story_json

SCHEMA = (
    "story_id bigint, title string, text string, "
    "holistic struct<num_annotators:int,scores:map<string,double>,consensus_score:double>, "
    "incremental struct<sentences:array<string>,num_annotators:int,scores:map<string,double>,"
    "reasons:map<string,map<string,array<int>>>,consensus_score:double>"
)


def story(spark, sentences, reasons, score=2.0, title="A Title", text="Some text.", hol=None, scores=None, id_=1):
    hol = score if hol is None else hol
    row = (id_, title, text, (2, scores or {}, hol), (sentences, 2, {}, reasons, score))
    return spark.createDataFrame([row], SCHEMA)


def flags_of(row):
    return [row[f"r{k}"] for k in fixed.REASONS]


def test_base_decides_which_sentence_is_marked(spark):
    df = spark.createDataFrame([(1, "annot0", 1, 3)], "story_id bigint, annotator string, sentence_id int, reason int")
    assert annotate.sentence_flags(df, base=0).head().pos == 1
    assert annotate.sentence_flags(df, base=1).head().pos == 0
    s = story(spark, ["one", "two", "three"], {"annot0": {"1": [3]}})
    zero = {r.sentence: r.r3 for r in annotate.incremental_flags(s, base=0).collect()}
    one = {r.sentence: r.r3 for r in annotate.incremental_flags(s, base=1).collect()}
    assert zero == {"one": 0, "two": 1, "three": 0} and one == {"one": 1, "two": 0, "three": 0}


def test_ids_outside_are_dropped_and_counted(spark):
    s = story(spark, ["one", "two"], {"annot0": {"0": [1], "9": [2], "x": [3]}})
    assert [flags_of(r) for r in annotate.incremental_flags(s, base=1).collect()] == [[0] * 7] * 2
    flags = annotate.sentence_flags(annotate.reasons_long(s).where("sentence_id IS NOT NULL"), base=1)
    sents = spark.createDataFrame([(1, 0, "one"), (1, 1, "two")], "story_id bigint, pos int, sentence string")
    assert annotate.stray_annotations(sents, flags).head().strays == 2


def test_reason_eight(spark):
    s = story(spark, ["one"], {"annot0": {"1": [8]}}, score=4.0)
    r = annotate.incremental_flags(s).head()
    assert flags_of(r) == [0] * 7 and r.score == 4.0
    assert annotate.incremental_flags(s, reason8="set_score").head().score == 1.0


def test_equal_sentences_merge_into_the_first(spark):
    s = story(spark, ["A b.", "other", " a B. "], {"annot0": {"1": [1]}, "who": {"3": [5]}})
    got = annotate.incremental_flags(s).orderBy("pos").collect()
    assert [(r.pos, r.sentence) for r in got] == [(0, "a b."), (1, "other")]
    assert flags_of(got[0]) == [1, 0, 0, 0, 1, 0, 0]


def test_only_annot_keys_count_in_the_assessment(spark):
    s = story(spark, ["one"], {"annot0": {"0": [2]}, "other": {"0": [3]}})
    r = annotate.cot_dataset(s).head()
    assert flags_of(r) == [0, 1, 0, 0, 0, 0, 0]


def test_assessment_text_is_exact(spark):
    s = story(spark, ["First.", "It flew."], {"annot0": {"1": [5, 2, 8]}}, score=2.0, title="T", text="X")
    r = annotate.cot_dataset(s).head()
    assert r.text == "Title: T Text: X"
    assert r.cot == (
        "1. Overall Coherence:\n\t- The story is not coherent because it contains some problematic sentences\n"
        "2. Problematic sentences:\n\t-The sentence 'It flew.' discusses an entity which has not been introduced yet <r2>1</r2>"
        " and contains information inconsistent with the knowledge about the world <r5>1</r5>\n"
        "3. Conclusion\n\t - The story is not coherent"
    )
    clean = annotate.cot_dataset(story(spark, ["First."], {}, score=5.0)).head().cot
    assert "2. Problematic sentences:\n\t- No problematic sentences\n3." in clean
    assert annotate.cot_dataset(story(spark, ["First."], {}, score=2.5)).head().cot == "Error: Invalid Score"


def test_binary_reason_dataset(spark):
    s = story(spark, ["First."], {}, score=4.0, scores={"annot0": 2.0, "annot1": 3.0})
    r = annotate.binary_reason_dataset(s).head()
    assert r.score == 1 and r.num_annotators == 2 and r.holistic_scores_per_annotator == {"annot0": 0, "annot1": 1}
    assert "is coherent even" in r.cot
    assert "not coherent at all" in annotate.binary_reason_dataset(s, cot_from_binary=True).head().cot


def test_context_skips_emptied_sentences(spark):
    s = story(spark, ["The cat sat.", "It is.", "A dog ran!"], {"annot0": {"3": [7]}}, title="It is")
    got = annotate.incremental_context(s).orderBy("pos").collect()
    assert [(r.pos, r.sentence) for r in got] == [(0, "- cat sat"), (2, "- cat sat dog ran")]
    assert got[1].r7 == 1 and got[0].r7 == 0


def test_context_rows_equals_nested_form(spark):
    sents = ["The cat sat.", "It is.", "A dog ran!", "Birds sing."]
    nested = annotate.incremental_context(story(spark, sents, {}, title="")).select("pos", "sentence").collect()
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sents)], "story_id bigint, pos bigint, t string")
    assert sorted(map(tuple, nested)) == sorted((r.pos, r.sentence) for r in annotate.context_rows(df, "story_id", "pos", "t").collect())


def test_holistic_rules(spark):
    rows = [story(spark, [], {}, hol=h, title="It is", text=t, id_=i) for i, (h, t) in enumerate([(3.0, "x"), (4.0, "is it"), (1.0, "A cat")])]
    df = rows[0].unionByName(rows[1]).unionByName(rows[2])
    got = {r.story_id: (r.sentence, r.score) for r in annotate.holistic_dataset(df).collect()}
    assert got == {1: (" - REMOVE", 1), 2: (" - cat", 0)}


def test_story_json_round_trip(spark, tmp_path):
    s = story(spark, ["One.", "Two."], {"annot0": {"1": [1, 2]}}, scores={"annot0": 2.0})
    shaped = s.select(
        F.col("story_id").cast("string").alias("key"),
        F.struct(F.col("story_id").alias("StoryID"), F.col("title").alias("Title"), F.col("text").alias("Text"),
                 F.col("holistic").alias("HolisticData"), F.col("incremental").alias("IncrementalData")).alias("story"),
    )
    path = str(tmp_path / "stories")
    write_story_json(shaped, path)
    assert read_story_json(spark, path, lines=True).collect() == s.collect()


def test_missing_keys(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"7": {"StoryID": 7, "Title": "t"}}')
    assert read_story_json(spark, str(p), on_missing="skip").count() == 0
    with pytest.raises(Exception, match="lacks a needed key"):
        read_story_json(spark, str(p)).collect()
    p.write_text('{"7": {"StoryID": ')
    with pytest.raises(Exception):
        read_story_json(spark, str(p)).collect()


def test_context_job_is_row_local(spark):
    plan = annotate.incremental_context(story(spark, ["a"], {}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
