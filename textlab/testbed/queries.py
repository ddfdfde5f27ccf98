"""Registered queries: each binds one operator to the given tables, over whole tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textlab.functions import fixed, scores, text
from textlab.operators import annotate, cells, explain, features, intake, metrics, models, neighbors, rows, sample
from textlab.operators.linear_many import LinearModel
from textlab.operators.local_model import lime_explain
from textlab.plans.durable import checkpointed, materialize, scratch_path
from textlab.plans.layout import spread
from textlab.plans.ordered import class_rank
from textlab.sources import tables
from textlab.sources.stories import read_story_json, write_story_json
from textlab.streaming.accept import accept_unique_stream
from textlab.testbed import sql, views

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


# ---------------------------------------------------------------- annotations


@query(
    "c11_split_sentences",
    sql.with_(sql.SENTENCES) + "SELECT story_id AS doc_id, pos, sentence FROM sentences",
)
def c11(spark, d):
    return annotate.sentences(views.documents(spark, d), "doc_id", "text")


@query(
    "c01_reasons_long",
    sql.with_(sql.REASONS)
    + "SELECT DISTINCT story_id, annotator, sentence_id, reason FROM reasons JOIN documents ON story_id = doc_id",
)
def c01(spark, d):
    return annotate.reasons_long(views.nested_stories(spark, d))


@query(
    "c02_sentence_flags",
    sql.with_(sql.REASONS, sql.FLAGS) + "SELECT * FROM flags",
)
def c02(spark, d):
    return annotate.sentence_flags(views.reasons(spark, d), base=0)


@query(
    "c02_flagged_sentences",
    sql.with_(sql.REASONS, sql.FLAGS, sql.SENTENCES, sql.FLAGGED) + "SELECT * FROM flagged",
)
def c02_flagged(spark, d):
    sents = annotate.sentences(views.stories(spark, d), "story_id", "text")
    return annotate.flag_sentences(sents, annotate.sentence_flags(views.reasons(spark, d), base=0))


@query(
    "c02_stray_annotations",
    sql.with_(sql.REASONS, sql.FLAGS, sql.SENTENCES)
    + "SELECT story_id, count(*) AS strays FROM flags ANTI JOIN sentences USING (story_id, pos) GROUP BY story_id",
)
def c02_strays(spark, d):
    sents = annotate.sentences(views.stories(spark, d), "story_id", "text")
    return annotate.stray_annotations(sents, annotate.sentence_flags(views.reasons(spark, d), base=0))


@query(
    "c03_story_flags",
    sql.with_(sql.REASONS)
    + f"SELECT story_id, {sql.FLAG_AGGS} FROM reasons GROUP BY story_id",
)
def c03(spark, d):
    return annotate.story_flags(annotate.sentence_flags(views.reasons(spark, d), base=0))


@query(
    "c04_sentence_reason_text",
    sql.with_(sql.REASONS, sql.FLAGS, sql.SENTENCES, sql.FLAGGED)
    + f"SELECT story_id, pos, {sql.reason_text()} AS reason_text FROM flagged",
)
def c04(spark, d):
    sents = annotate.sentences(views.stories(spark, d), "story_id", "text")
    flagged = annotate.flag_sentences(sents, annotate.sentence_flags(views.reasons(spark, d), base=0))
    return annotate.sentence_reason_text(flagged).select("story_id", "pos", "reason_text")


COT = sql.with_(sql.STORIES, sql.REASONS, sql.FLAGS, sql.SENTENCES, sql.FLAGGED, sql.PROBLEMS)


@query(
    "c05_cot_block",
    COT + f"SELECT story_id, {sql.cot_block('score5', 'problems')} AS cot FROM stories JOIN problems USING (story_id)",
)
def c05(spark, d):
    """The long form: flags arrive as rows and the problem list is put together per story."""
    sents = annotate.sentences(views.stories(spark, d), "story_id", "text")
    flagged = annotate.flag_sentences(sents, annotate.sentence_flags(views.reasons(spark, d), base=0))
    # One entry per sentence of the story's own text.
    problems = (
        annotate.sentence_reason_text(flagged)
        .groupBy("story_id")
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.col("reason_text") != "", F.struct("pos", "reason_text")))
            ).alias("found")
        )
        .select(
            "story_id",
            F.array_join(
                F.transform("found", lambda f: F.concat(F.lit(fixed.PROBLEM_SEPARATOR), f["reason_text"])), ""
            ).alias("problems"),
        )
    )
    return (
        views.stories(spark, d)
        .select("story_id", "score5")
        .join(problems, "story_id")
        .select("story_id", annotate.cot_block(F.col("score5"), F.col("problems")).alias("cot"))
    )


@query(
    "c06_cot_dataset",
    COT
    + f"""SELECT story_id, 'Title: ' || title || ' Text: ' || text AS text, CAST(score5 AS DOUBLE) AS score,
      {sql.cot_block('score5', 'problems')} AS cot, {sql.FLAG_NAMES}
      FROM stories JOIN problems USING (story_id)""",
)
def c06(spark, d):
    return annotate.cot_dataset(views.nested_stories(spark, d))


ANNOTATOR_SCORES = """annotator_scores AS (
  SELECT l_orderkey AS story_id, 'annot' || CAST(l_suppkey % 3 AS VARCHAR) AS annotator,
         CAST(floor(max(l_quantity)) AS BIGINT) % 6 AS s FROM lineitem GROUP BY ALL)"""


@query(
    "c07_binary_reason_dataset",
    COT.rstrip()
    + f""", {ANNOTATOR_SCORES},
      sc AS (SELECT story_id, count(*) AS n,
        string_agg(annotator || '=' || CASE WHEN s <= 2 THEN '0' ELSE '1' END, ',' ORDER BY annotator) AS per_annotator
        FROM annotator_scores GROUP BY story_id)
      SELECT story_id, 'Title: ' || title || ' Text: ' || text AS text,
        CAST(CASE WHEN score5 <= 2 THEN 0 ELSE 1 END AS INTEGER) AS score,
        {sql.cot_block('score5', 'problems')} AS cot, CAST(coalesce(n, 0) AS INTEGER) AS num_annotators,
        coalesce(per_annotator, '') AS scores, {sql.FLAG_NAMES}
      FROM stories JOIN problems USING (story_id) LEFT JOIN sc USING (story_id)""",
)
def c07(spark, d):
    out = annotate.binary_reason_dataset(views.nested_stories(spark, d))
    entries = F.array_sort(F.map_entries("holistic_scores_per_annotator"))
    shown = F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return out.withColumn("scores", shown).drop("holistic_scores_per_annotator")


MERGED = f"""keyed AS (SELECT story_id, pos, {sql.strip('lower(sentence)')} AS key FROM sentences),
  hits AS (SELECT k.story_id, k.key, r.reason FROM keyed k JOIN reasons r ON k.story_id = r.story_id AND k.pos = r.sentence_id + 1 - 1),
  merged AS (SELECT story_id, key, min(pos) AS pos FROM keyed GROUP BY ALL),
  hit_flags AS (SELECT story_id, key, {sql.FLAG_AGGS} FROM hits GROUP BY ALL),
  incremental AS (SELECT m.story_id, m.pos, m.key AS sentence, CAST(score5 AS DOUBLE) AS score,
    {', '.join(f'coalesce(h.r{k}, 0) AS r{k}' for k in fixed.REASONS)}
    FROM merged m JOIN stories USING (story_id) LEFT JOIN hit_flags h ON m.story_id = h.story_id AND m.key = h.key)"""
# The view's sentence ids start at 0, so base=0 fits them; base=1 shifts every mark by one sentence.
MERGED_BASE_1 = MERGED.replace("r.sentence_id + 1 - 1", "r.sentence_id - 1")


@query(
    "c08_incremental_flags",
    sql.with_(sql.STORIES, sql.REASONS, sql.SENTENCES, MERGED_BASE_1) + "SELECT * FROM incremental",
)
def c08(spark, d):
    return annotate.incremental_flags(views.nested_stories(spark, d), base=1)


@query(
    "c09_incremental_context",
    sql.with_(sql.STORIES, sql.REASONS, sql.SENTENCES, MERGED_BASE_1)
    + f"""SELECT story_id, pos, {sql.strip("t || ' - ' || CASE WHEN prev IS NULL THEN cur ELSE prev || ' ' || cur END")} AS sentence,
      score, {sql.FLAG_NAMES}
      FROM (SELECT *, lag(cur) OVER (PARTITION BY story_id ORDER BY pos) AS prev FROM
        (SELECT i.*, {sql.normalized('title')} AS t, {sql.normalized('sentence')} AS cur
         FROM incremental i JOIN stories USING (story_id)) WHERE cur <> '')""",
)
def c09(spark, d):
    return annotate.incremental_context(views.nested_stories(spark, d), base=1)


@query(
    "c09_context_of_turns",
    f"""SELECT conv_id, turn, {sql.strip("' - ' || CASE WHEN prev IS NULL THEN cur ELSE prev || ' ' || cur END")} AS sentence
      FROM (SELECT *, lag(cur) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM
        (SELECT conv_id, turn, {sql.normalized('text')} AS cur FROM conversations) WHERE cur <> '')""",
)
def c09_turns(spark, d):
    return annotate.context_rows(views.table(spark, d, "conversations"), "conv_id", "turn", "text")


@query(
    "c10_holistic_dataset",
    sql.with_(sql.STORIES)
    + f"""SELECT story_id, {sql.normalized('title')} || ' - ' ||
        CASE WHEN {sql.normalized('text')} = '' THEN 'REMOVE' ELSE {sql.normalized('text')} END AS sentence,
        CAST(CASE WHEN score5 > 3 THEN 1 ELSE 0 END AS INTEGER) AS score
      FROM stories WHERE score5 <> 3""",
)
def c10(spark, d):
    return annotate.holistic_dataset(views.nested_stories(spark, d))


LEMMAS = f"""lemmas AS (SELECT DISTINCT word, substr(word, 1, length(word) - 1) AS lemma
        FROM (SELECT unnest({sql.words('text')}) AS word FROM documents)
        WHERE length(word) > 3 AND word LIKE '%s' AND word NOT LIKE '%ss')"""


def by_lemma(source, key, column):
    """A normalised column of a table with words replaced by lemmas, per key."""
    keys = ", ".join(key)
    return f"""(SELECT {keys}, string_agg(coalesce(lemma, word), ' ' ORDER BY i) AS {column} FROM
        (SELECT {keys}, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM
          (SELECT {keys}, string_split({column}, ' ') AS w FROM {source})) LEFT JOIN lemmas USING (word) GROUP BY {keys})"""


@query(
    "c09_incremental_context_lemmas",
    sql.with_(sql.STORIES, sql.REASONS, sql.SENTENCES, MERGED_BASE_1, LEMMAS)
    + f""", kept AS (SELECT * FROM (SELECT story_id, pos, {sql.normalized('sentence')} AS cur FROM incremental) WHERE cur <> ''),
      titles AS (SELECT story_id, {sql.normalized('title')} AS t FROM stories)
      SELECT story_id, pos, {sql.strip("t || ' - ' || CASE WHEN prev IS NULL THEN cur ELSE prev || ' ' || cur END")} AS sentence,
        score, {sql.FLAG_NAMES}
      FROM (SELECT *, lag(cur) OVER (PARTITION BY story_id ORDER BY pos) AS prev FROM {by_lemma('kept', ['story_id', 'pos'], 'cur')})
      JOIN {by_lemma('titles', ['story_id'], 't')} USING (story_id)
      JOIN (SELECT story_id, pos, score, {sql.FLAG_NAMES} FROM incremental) USING (story_id, pos)""",
)
def c09_lemmas(spark, d):
    return annotate.incremental_context(views.nested_stories(spark, d), base=1, lemmas=views.lemmas(spark, d))


@query(
    "c10_holistic_dataset_lemmas",
    sql.with_(sql.STORIES, LEMMAS)
    + f""", titles AS (SELECT story_id, {sql.normalized('title')} AS t FROM stories),
      bodies AS (SELECT story_id, {sql.normalized('text')} AS b FROM stories)
      SELECT story_id, t || ' - ' || CASE WHEN b = '' THEN 'REMOVE' ELSE b END AS sentence,
        CAST(CASE WHEN score5 > 3 THEN 1 ELSE 0 END AS INTEGER) AS score
      FROM stories JOIN {by_lemma('titles', ['story_id'], 't')} USING (story_id) JOIN {by_lemma('bodies', ['story_id'], 'b')} USING (story_id)
      WHERE score5 <> 3""",
)
def c10_lemmas(spark, d):
    return annotate.holistic_dataset(views.nested_stories(spark, d), lemmas=views.lemmas(spark, d))


# ----------------------------------------------------------------- row level


@query("b01_clean_text", """SELECT doc_id, translate(lower(text), '[]<>"\\{}', '') AS text FROM documents""")
def b01(spark, d):
    return views.documents(spark, d).select("doc_id", text.clean_text(F.col("text"), lower=True).alias("text"))


@query(
    "b02_join_text_columns",
    "SELECT concat_ws('-', p_name, p_brand, p_type) AS joined, p_partkey, p_size, p_retailprice FROM part",
)
def b02(spark, d):
    return rows.join_text_columns(views.table(spark, d, "part"), ["p_name", "p_brand", "p_type"], "joined")


@query(
    "b03_normalize_text",
    f"SELECT doc_id, CASE WHEN n = '' THEN 'REMOVE' ELSE n END AS text FROM (SELECT doc_id, {sql.normalized('text')} AS n FROM documents)",
)
def b03(spark, d):
    return views.documents(spark, d).select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query(
    "b04_lemmatize",
    f"""WITH lemmas AS (SELECT DISTINCT word, substr(word, 1, length(word) - 1) AS lemma
        FROM (SELECT unnest({sql.words('text')}) AS word FROM documents)
        WHERE length(word) > 3 AND word LIKE '%s' AND word NOT LIKE '%ss'),
      tokens AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
        FROM (SELECT doc_id, {sql.words('text')} AS w FROM documents))
      SELECT doc_id, coalesce(t, '') AS text FROM documents LEFT JOIN (
        SELECT doc_id, string_agg(coalesce(lemma, word), ' ' ORDER BY pos) AS t
        FROM tokens LEFT JOIN lemmas USING (word) GROUP BY doc_id) USING (doc_id)""",
)
def b04(spark, d):
    docs = views.documents(spark, d).select("doc_id", "text")
    return rows.lemmatize(docs, "doc_id", "text", views.lemmas(spark, d))


@query(
    "b05_binarize_drop_mid",
    sql.with_(sql.STORIES)
    + "SELECT story_id, CAST(CASE WHEN score5 > 3 THEN 1 ELSE 0 END AS INTEGER) AS score FROM stories WHERE score5 <> 3",
)
def b05(spark, d):
    return (
        views.stories(spark, d)
        .select("story_id", scores.binarize_drop_mid(F.col("score5")).alias("score"))
        .where("score <> -1")
    )


@query(
    "b06_binarize_keep_mid",
    sql.with_(sql.STORIES)
    + "SELECT story_id, CAST(CASE WHEN trunc(score5 - 0.3) <= 2 THEN 0 ELSE 1 END AS INTEGER) AS score FROM stories",
)
def b06(spark, d):
    return views.stories(spark, d).select(
        "story_id", scores.binarize_keep_mid(F.col("score5") - 0.3).alias("score")
    )


@query(
    "b07_binarize_score_map",
    sql.with_(ANNOTATOR_SCORES)
    + """SELECT story_id, annotator, CAST(CASE WHEN s <= 2 THEN 0 ELSE 1 END AS INTEGER) AS score
       FROM annotator_scores JOIN documents ON story_id = doc_id""",
)
def b07(spark, d):
    return views.nested_stories(spark, d).select(
        "story_id", F.explode(scores.binarize_score_map(F.col("holistic.scores"))).alias("annotator", "score")
    )


@query(
    "b08_text_stats",
    f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS word_count,
        CASE WHEN len(w) > 0 THEN round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w), 2) ELSE 0.0 END AS diversity_score
      FROM (SELECT doc_id, {sql.words('text')} AS w FROM documents)""",
)
def b08(spark, d):
    stats = text.text_stats(F.col("text"))
    return views.documents(spark, d).select("doc_id", *[c.alias(n) for n, c in stats.items()])


@query(
    "b09_story_text",
    sql.with_(sql.STORIES) + "SELECT story_id, 'Title: ' || title || ' Text: ' || text AS text FROM stories",
)
def b09(spark, d):
    return views.stories(spark, d).select("story_id", text.story_text(F.col("title"), F.col("text")).alias("text"))


@query(
    "b10_extract_title_text",
    sql.with_(sql.GENERATED)
    + f"""SELECT id, trim({sql.strip("regexp_extract(s, '(?s)^(.*?)Text:(.*)$', 1)")}, '"') AS title,
        replace(trim({sql.strip("regexp_extract(s, '(?s)^(.*?)Text:(.*)$', 2)")}, '"'), chr(10), ' ') AS text
      FROM (SELECT id, string_split(text, 'Title:')[-1] AS s FROM generated)""",
)
def b10(spark, d):
    story = text.extract_title_text(F.col("text"))
    return views.generated(spark, d).select("id", story.alias("s")).select("id", "s.title", "s.text")


@query("b11_clean_model_output", sql.with_(sql.GENERATED) + f"SELECT id, {sql.clean_output('text')} AS text FROM generated")
def b11(spark, d):
    return views.generated(spark, d).select("id", text.clean_model_output(F.col("text")).alias("text"))


@query(
    "b12_extract_score",
    sql.with_(sql.GENERATED)
    + f"""SELECT id, {sql.last_binary(sql.clean_output('text'))} AS last_binary,
        CAST(regexp_extract_all(string_split(text, 'Response:')[-1], '<score>\\s*(\\d+)\\s*</score>', 1)[1] AS INTEGER) AS first_int,
        CAST(regexp_extract_all(string_split(text, '## Response:')[2], '<score>(\\d)</score>', 1)[1] AS INTEGER) AS first_digit
      FROM generated""",
)
def b12(spark, d):
    answer = F.col("text")
    return views.generated(spark, d).select(
        "id",
        scores.extract_score(text.clean_model_output(answer)).alias("last_binary"),
        scores.extract_score(scores.after_last(answer, "Response:"), "first_int").alias("first_int"),
        scores.extract_score(answer, "first_digit").alias("first_digit"),
    )


@query(
    "b13_resolve_missing_score",
    sql.with_(sql.GENERATED)
    + f"""SELECT id, s IS NULL AS parse_failed, s AS dropped,
        CAST(coalesce(s, CASE WHEN truth < 5 THEN truth + 1 ELSE 1 END) AS INTEGER) AS shift_true,
        coalesce(s, 1) AS const_1, CAST(coalesce(s, 1 - truth) AS INTEGER) AS flip_true, coalesce(s, 0) AS const_0
      FROM (SELECT id, truth, {sql.last_binary(sql.clean_output('text'))} AS s FROM generated)""",
)
def b13(spark, d):
    read = views.generated(spark, d).select(
        "id", "truth", scores.extract_score(text.clean_model_output(F.col("text"))).alias("s")
    )
    fill_in = lambda policy: scores.resolve_missing_score(F.col("s"), F.col("truth"), policy)
    return read.select(
        "id",
        F.col("s").isNull().alias("parse_failed"),
        fill_in("drop").alias("dropped"),
        *[fill_in(p).alias(p) for p in ("shift_true", "const_1", "flip_true", "const_0")],
    )


USER_TEMPLATE = "Judge whether the text holds together.\n\n## Input:\n{}\n"
ASSISTANT_TEMPLATE = "\n## Response:\n{}\n4. Score:\n{}"
LABELED = "labeled AS (SELECT doc_id, text, quality AS label, toxic FROM documents JOIN labels USING (doc_id))"
USER_SQL = "'Judge whether the text holds together.' || chr(10) || chr(10) || '## Input:' || chr(10) || text || chr(10)"
ASSISTANT_SQL = (
    "chr(10) || '## Response:' || chr(10) || 'toxic ' || toxic || chr(10) || '4. Score:' || chr(10) || '<score>' || label || '</score>'"
)


def chat(spark, d):
    reasoning = F.concat(F.lit("toxic "), F.col("toxic").cast("string"))
    return rows.render_chat(
        views.labeled_documents(spark, d), USER_TEMPLATE, ASSISTANT_TEMPLATE, F.col("text"), reasoning, F.col("label")
    )


@query(
    "b14_render_chat",
    sql.with_(LABELED)
    + f"""SELECT doc_id, 'user' AS role, {USER_SQL} AS content FROM labeled
      UNION ALL SELECT doc_id, 'assistant', {ASSISTANT_SQL} FROM labeled""",
)
def b14(spark, d):
    return chat(spark, d).select("doc_id", F.inline("messages"))


@query(
    "b15_strip_prompt",
    sql.with_(sql.GENERATED)
    + f"""SELECT id, regexp_replace({sql.strip("string_split('<|begin|>system<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || text, '## Response:')[1]")}
        || chr(10) || '## Response:', '(?s)^.*?<\\|eot_id\\|><\\|start_header_id\\|>user<\\|end_header_id\\|>\\s*', '') AS prompt FROM generated""",
)
def b15(spark, d):
    header = "<|begin|>system<|eot_id|><|start_header_id|>user<|end_header_id|>\n"
    return views.generated(spark, d).select(
        "id", text.strip_prompt(F.concat(F.lit(header), F.col("text"))).alias("prompt")
    )


# ------------------------------------------------------------------ sampling


@query("d00_class_rank", sql.ranked("labels", "quality", "doc_id"))
def d00(spark, d):
    return class_rank(views.table(spark, d, "labels"), ["quality"], "doc_id")


@query(
    "d01_downsample_class",
    f"SELECT doc_id, quality, toxic FROM ({sql.ranked('labels', 'quality', 'doc_id')}) WHERE quality <> 1 OR rank <= 64",
)
def d01(spark, d):
    return sample.downsample_class(views.table(spark, d, "labels"), "quality", 1, 64, "doc_id")


@query(
    "d02_undersample_to_minority",
    f"""SELECT doc_id, quality, toxic FROM ({sql.ranked('labels', 'quality', 'doc_id')})
      WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""",
)
def d02(spark, d):
    return sample.undersample_to_minority(views.table(spark, d, "labels"), "quality", "doc_id")


@query(
    "d03_stratified_kfold",
    f"""SELECT doc_id, quality, toxic, CAST((before + rank - 1) % 10 AS INTEGER) AS fold
      FROM ({sql.ranked('labels', 'quality', 'doc_id')}) JOIN (
        SELECT quality, coalesce(sum(n) OVER (ORDER BY quality ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)) USING (quality)""",
)
def d03(spark, d):
    return sample.stratified_kfold(views.table(spark, d, "labels"), "quality", 10, "doc_id")


@query(
    "d04_random_split",
    f"""SELECT doc_id, CASE WHEN rank <= ceil(0.2 * class_rows) THEN 'test' ELSE 'train' END AS split
      FROM ({sql.ranked('documents', None, 'doc_id')})""",
)
def d04(spark, d):
    return sample.random_split(views.table(spark, d, "documents").select("doc_id"), 0.2, "doc_id")


ALLOT = """allot AS (SELECT quality, c - w - CASE WHEN row_number() OVER (ORDER BY rest DESC, quality) <= n_train - sum(w) OVER ()
    THEN 1 ELSE 0 END AS n_test FROM (SELECT quality, c, n_train, (c * n_train) // n AS w, (c * n_train) % n AS rest FROM (
      SELECT quality, c, n, n - CAST(ceil(0.2 * n) AS BIGINT) AS n_train FROM (
        SELECT quality, count(*) AS c, (SELECT count(*) FROM labels) AS n FROM labels GROUP BY quality))))"""


@query(
    "d05_stratified_split",
    sql.with_(ALLOT)
    + f"""SELECT doc_id, quality, toxic, CASE WHEN rank <= n_test THEN 'test' ELSE 'train' END AS split
      FROM ({sql.ranked('labels', 'quality', 'doc_id')}) JOIN allot USING (quality)""",
)
def d05(spark, d):
    return sample.stratified_split(views.table(spark, d, "labels"), "quality", 0.2, "doc_id")


@query(
    "d06_sample_shots",
    sql.with_(LABELED)
    + f"""SELECT doc_id, text, label, toxic, CAST(row_number() OVER (ORDER BY label, rank) AS INTEGER) AS shot
      FROM ({sql.ranked('labeled', 'label', 'doc_id')}) WHERE rank <= 3""",
)
def d06(spark, d):
    return sample.sample_shots(views.labeled_documents(spark, d), "label", 3, "doc_id")


@query(
    "d07_balanced_eval_subset",
    sql.with_(sql.STORIES)
    + f"""SELECT story_id, score5 FROM ({sql.ranked('stories', 'score5', 'story_id')})
      WHERE rank <= least(40, (SELECT min(n) FROM (SELECT count(*) AS n FROM stories GROUP BY score5)))""",
)
def d07(spark, d):
    return sample.balanced_eval_subset(
        views.stories(spark, d).select("story_id", "score5"), "score5", [1, 2, 3, 4, 5], 40, "story_id"
    )


SHOT_SQL = sql.q(fixed.SHOT_FORMAT)
for _name, _value in (("{n}", "CAST(shot AS VARCHAR)"), ("{text}", "text"), ("{reasoning}", "'toxic ' || toxic"), ("{score}", "CAST(label AS VARCHAR)")):
    SHOT_SQL = SHOT_SQL.replace(_name, f"' || {_value} || '")


@query(
    "d08_few_shot_prompts",
    sql.with_(
        LABELED,
        f"""shots AS (SELECT *, row_number() OVER (ORDER BY label, rank) AS shot
          FROM ({sql.ranked('labeled', 'label', 'doc_id')}) WHERE rank <= 2)""",
    )
    + f"""SELECT doc_id, md5({sql.q(USER_TEMPLATE.split(fixed.INPUT_MARK)[0] + fixed.SHOTS_HEAD)} ||
        (SELECT string_agg({SHOT_SQL}, '' ORDER BY shot) FROM shots) || {sql.q(fixed.SHOTS_END)} || text || {sql.q(fixed.SHOTS_ASK)}) AS prompt_md5
      FROM documents""",
)
def d08(spark, d):
    shots = sample.sample_shots(views.labeled_documents(spark, d), "label", 2, "doc_id").select(
        "shot", "text", F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("cot"), F.col("label").alias("score")
    )
    out = sample.few_shot_prompts(views.documents(spark, d), shots, USER_TEMPLATE, F.col("text"))
    # The digest keeps the comparison small; the operator returns the prompt itself.
    return out.select("doc_id", F.md5("prompt").alias("prompt_md5"))


# ------------------------------------------------------------------- metrics


@query("e01_class_distribution", "SELECT quality, count(*) AS rows FROM labels GROUP BY quality")
def e01(spark, d):
    return metrics.class_distribution(views.table(spark, d, "labels"), "quality")


@query("e04_length_stats", """SELECT max(n_chars) AS max_length,
    CAST(floor(round(quantile_cont(n_chars, 0.95), 6)) AS BIGINT) AS p95_length FROM documents""")
def e04(spark, d):
    return metrics.length_stats(views.table(spark, d, "documents"), "n_chars")


@query(
    "e05_confusion_matrix",
    sql.with_(sql.PRED5, "l AS (SELECT y_true AS v FROM pred5 UNION SELECT y_pred FROM pred5)")
    + """SELECT a.v AS y_true, b.v AS y_pred, count(p.id) AS n FROM l a CROSS JOIN l b
       LEFT JOIN pred5 p ON p.y_true = a.v AND p.y_pred = b.v GROUP BY ALL""",
)
def e05(spark, d):
    return metrics.confusion_matrix(views.pred5(spark, d))


ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in ("precision", "recall", "f1"))


@query(
    "e06_classification_report",
    sql.with_(sql.PRED5, sql.label_scores("pred5"), sql.summary())
    + f"""SELECT label, {ROUNDED}, support FROM (
        SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM scores
        UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, rows FROM summary
        UNION ALL SELECT 'macro avg', precision_macro, recall_macro, f1_macro, rows FROM summary
        UNION ALL SELECT 'weighted avg', precision_weighted, recall_weighted, f1_weighted, rows FROM summary)""",
)
def e06(spark, d):
    r = metrics.classification_report(views.pred5(spark, d))
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "e07_outcomes",
    sql.with_(sql.PRED2)
    + """SELECT id, CASE WHEN y_true = 1 THEN CASE WHEN y_pred = 1 THEN 'TP' ELSE 'FN' END
       WHEN y_pred = 1 THEN 'FP' ELSE 'TN' END AS outcome FROM pred2""",
)
def e07(spark, d):
    return metrics.outcomes(views.pred2(spark, d))


SUMMARY_COLS = ["accuracy"] + [f"{c}_{k}" for k in ("macro", "weighted") for c in ("precision", "recall", "f1")]
SUMMARY_SQL = ", ".join(f"round({c}, 9) AS {c}" for c in SUMMARY_COLS)


@query(
    "e08_fold_metrics",
    sql.with_(sql.PRED5, sql.label_scores("pred5", "fold"), sql.summary("fold"))
    + f"SELECT fold, rows, {SUMMARY_SQL}, 0::BIGINT AS parse_failures, 0.0::DOUBLE AS parse_failure_rate FROM summary",
)
def e08(spark, d):
    m = metrics.fold_metrics(views.pred5(spark, d))
    return m.select("fold", "rows", *[F.round(c, 9).alias(c) for c in SUMMARY_COLS], "parse_failures", "parse_failure_rate")


GENERATED_FOLDS = f"""answers AS (SELECT id % 10 AS fold, truth AS y_true, coalesce(s, 0) AS y_pred, s IS NULL AS failed FROM (
    SELECT id, truth, {sql.last_binary(sql.clean_output('text'))} AS s FROM generated))"""


@query(
    "e09_cv_summary",
    sql.with_(
        sql.GENERATED,
        GENERATED_FOLDS,
        sql.label_scores("answers", "fold"),
        sql.summary("fold"),
        """per_fold AS (SELECT s.*, f.failures, f.failures / s.rows AS parse_failure_rate FROM summary s JOIN
          (SELECT fold, CAST(sum(CAST(failed AS INTEGER)) AS BIGINT) AS failures FROM answers GROUP BY fold) f USING (fold))""",
    )
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, round(avg({m}), 9) AS mean, round(stddev_pop({m}), 9) AS std,
          CAST(sum(failures) AS BIGINT) AS parse_failures, CAST(sum(rows) AS BIGINT) AS rows FROM per_fold"""
        for m in metrics.CV_METRICS
    ),
)
def e09(spark, d):
    """Model answers to cross-validation summary: clean, read scores, per fold, over folds."""
    read = rows.read_scores(views.generated(spark, d), F.col("text"), F.col("truth"))
    folds = metrics.fold_metrics(read.withColumn("fold", (F.col("id") % 10).cast("int")))
    s = metrics.cv_summary(folds)
    return s.select("metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "parse_failures", "rows")


@query(
    "e10_select_best",
    sql.with_(
        sql.PRED2,
        """models AS (SELECT fold, y_true, y_pred, 'as given' AS model, 1 AS place FROM pred2
          UNION ALL SELECT fold, y_true, 1 - y_pred, 'flipped', 2 FROM pred2 UNION ALL SELECT fold, y_true, 0, 'constant', 3 FROM pred2)""",
        sql.label_scores("models", "model, place, fold"),
        sql.summary("model, place, fold"),
        """means AS (SELECT model, place, avg(accuracy) AS a, avg(f1_weighted) AS f, avg(precision_weighted) AS p
          FROM summary GROUP BY ALL)""",
    )
    + """SELECT model, round(a, 3) AS mean_accuracy, round(f, 3) AS mean_f1, round(p, 3) AS mean_precision,
       model = (SELECT model FROM means ORDER BY f DESC, place LIMIT 1) AS best FROM means""",
)
def e10(spark, d):
    p = views.pred2(spark, d)
    models = (
        p.withColumn("model", F.lit("as given")).withColumn("place", F.lit(1))
        .unionByName(p.withColumn("y_pred", 1 - F.col("y_pred")).withColumn("model", F.lit("flipped")).withColumn("place", F.lit(2)))
        .unionByName(p.withColumn("y_pred", F.lit(0)).withColumn("model", F.lit("constant")).withColumn("place", F.lit(3)))
    )
    return metrics.select_best(metrics.fold_metrics(models, ["model", "place"]), "f1")


@query(
    "e11_trial_leaderboard",
    sql.with_(
        sql.TRIALS,
        """best AS (SELECT study, trial AS best_trial, value AS best_value, n AS trials FROM (
          SELECT *, row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) AS r, count(*) OVER (PARTITION BY study) AS n
          FROM trials WHERE value > 0.56) WHERE r = 1)""",
    )
    + "SELECT *, CAST(row_number() OVER (ORDER BY best_value DESC, study) AS INTEGER) AS place FROM best",
)
def e11(spark, d):
    return metrics.trial_leaderboard(views.trials(spark, d), 0.56)


@query("e11_good_trials", sql.with_(sql.TRIALS) + "SELECT * FROM trials WHERE value > 0.56")
def e11_good(spark, d):
    return metrics.good_trials(views.trials(spark, d))


HISTORY = """history AS (SELECT user_id AS trial, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value
  FROM events)"""
TRACE = """b AS (SELECT *, max(value) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    max(value) OVER (PARTITION BY trial ORDER BY step) AS best FROM history),
  i AS (SELECT *, before IS NULL OR value > before AS improved FROM b),
  w AS (SELECT *, CAST(step - max(CASE WHEN improved THEN step END) OVER (PARTITION BY trial ORDER BY step) AS INTEGER) AS wait FROM i),
  trace AS (SELECT trial, step, value, best, improved, wait,
    max(CAST(wait >= 3 AS INTEGER)) OVER (PARTITION BY trial ORDER BY step) = 1 AS stopped FROM w)"""


@query("e12_early_stop_trace", sql.with_(HISTORY, TRACE) + "SELECT * FROM trace")
def e12(spark, d):
    return metrics.early_stop_trace(checkpointed(numbered(spark, d).select("trial", "step", "value")))


@query("e12_numbered_steps", sql.with_(HISTORY) + "SELECT trial, step, value FROM history")
def numbered(spark, d):
    steps = metrics.numbered_steps(views.history(spark, d), "trial", "ts", "step_id")
    return steps.select("trial", "step", "value")


@query(
    "e12_early_stop_step",
    sql.with_(HISTORY, TRACE)
    + """SELECT trial, min(CASE WHEN stopped THEN step END) AS stop_step, max(CASE WHEN NOT stopped THEN best END) AS best_running
       FROM trace GROUP BY trial""",
)
def e12_stop(spark, d):
    return metrics.early_stop_step(e12(spark, d))


@query(
    "e13_running_f1",
    sql.with_(
        sql.PRED2,
        """s AS (SELECT id, sum(CAST(y_true = 1 AND y_pred = 1 AS INTEGER)) OVER w AS tp, sum(CAST(y_true = 0 AND y_pred = 0 AS INTEGER)) OVER w AS tn,
          sum(CAST(y_true = 0 AND y_pred = 1 AS INTEGER)) OVER w AS fp, sum(CAST(y_true = 1 AND y_pred = 0 AS INTEGER)) OVER w AS fn,
          max(100 + id % 37) OVER w AS longest FROM pred2 WINDOW w AS (ORDER BY id))""",
    )
    + """SELECT id, round(((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END) * (tp + fn) +
        (CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0.0 END) * (tn + fp)) / (tp + tn + fp + fn), 9) AS f1,
      longest FROM s""",
)
def e13(spark, d):
    out = metrics.running_f1(views.pred2(spark, d), "id", 100 + F.col("id") % 37)
    return out.select("id", F.round("f1", 9).alias("f1"), "longest")


@query(
    "e14_report_table",
    sql.with_(
        sql.PRED5,
        sql.label_scores("pred5"),
        sql.summary(),
        """report AS (SELECT CAST(label AS VARCHAR) AS name, precision, recall, f1, support FROM scores
          UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, rows FROM summary
          UNION ALL SELECT 'macro avg', precision_macro, recall_macro, f1_macro, rows FROM summary
          UNION ALL SELECT 'weighted avg', precision_weighted, recall_weighted, f1_weighted, rows FROM summary)""",
    )
    + " UNION ALL ".join(
        f"SELECT 'metrics' AS section, name, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS number, NULL AS setting FROM report"
        for m in ("precision", "recall", "f1", "support")
    )
    + """ UNION ALL SELECT 'hyperparameters', 'C', 'value', NULL, '1.0'
      UNION ALL SELECT 'hyperparameters', 'penalty', 'value', NULL, 'l2'""",
)
def e14(spark, d):
    table = metrics.report_table(views.pred5(spark, d), {"C": 1.0, "penalty": "l2"})
    is_metric = F.col("section") == "metrics"
    return table.select(
        "section", "name", "metric",
        F.when(is_metric, F.round(F.col("value").cast("double"), 6)).alias("number"),
        F.when(~is_metric, F.col("value")).alias("setting"),
    )


# ------------------------------------------------------------------ features

VOCABULARY = f"vocabulary AS (SELECT DISTINCT lower(unnest({sql.words('text')})) AS token FROM documents)"
COUNTS = """counts AS (SELECT doc_id, token, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM documents) GROUP BY ALL)"""
WORD_COUNTS = "word_counts AS (SELECT * FROM counts SEMI JOIN vocabulary USING (token))"
TFIDF = """tfidf AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM (
    SELECT doc_id, token, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*) OVER (PARTITION BY token))) + 1) AS w
    FROM word_counts))"""
FEATURES = (VOCABULARY, COUNTS, WORD_COUNTS, TFIDF)


@query("e02_vocabulary", sql.with_(VOCABULARY) + "SELECT token FROM vocabulary")
def e02(spark, d):
    return features.vocabulary(views.documents(spark, d), "text")


CHOSEN = ["the", "of", "and", "le", "la", "der", "die", "que", "el", "no_such_word"]


@query(
    "e03_token_totals",
    sql.with_(VOCABULARY, COUNTS, WORD_COUNTS)
    + f"""SELECT token, CAST(coalesce(t, 0) AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY coalesce(t, 0), token) AS INTEGER) AS place
      FROM (SELECT unnest([{', '.join(sql.q(c) for c in CHOSEN)}]) AS token)
      LEFT JOIN (SELECT token, sum(tf) AS t FROM word_counts GROUP BY token) USING (token)""",
)
def e03(spark, d):
    return features.token_totals(features.word_counts(views.documents(spark, d), "doc_id", "text"), CHOSEN)


@query("f01_word_counts", sql.with_(VOCABULARY, COUNTS, WORD_COUNTS) + "SELECT doc_id, token, tf FROM word_counts")
def f01(spark, d):
    return features.word_counts(views.documents(spark, d), "doc_id", "text")


@query("f02_tfidf", sql.with_(*FEATURES) + "SELECT doc_id, token, round(value, 9) AS value FROM tfidf")
def f02(spark, d):
    t = features.tfidf(views.documents(spark, d), "doc_id", "text")
    return t.select("doc_id", "token", F.round("value", 9).alias("value"))


WORD_VECTORS = f"""tokens AS (SELECT doc_id, unnest({sql.words('text')}) AS word FROM documents),
  word_vectors AS (SELECT word, embedding AS vec FROM (SELECT DISTINCT word FROM tokens WHERE regexp_full_match(word, '[a-z]+'))
    JOIN embeddings ON CAST('0x' || substr(md5(word), 1, 4) AS BIGINT) % (SELECT count(*) FROM embeddings) = vec_id)"""
MEANS = """SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(coalesce(s / {divisor}, 0.0), 6) AS value
  FROM (SELECT doc_id, len(list_filter(string_split_regex(text, {run}), lambda w: w <> '')) AS size FROM documents)
  CROSS JOIN (SELECT unnest(range(64)) AS dim)
  LEFT JOIN (SELECT doc_id, i AS dim, sum(CAST(v AS DOUBLE)) AS s, count(*) AS known FROM (
    SELECT doc_id, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS i FROM tokens JOIN word_vectors USING (word)) GROUP BY ALL)
  USING (doc_id, dim)"""


def spell_out(df):
    return df.select("doc_id", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("f03_mean_embedding", sql.with_(WORD_VECTORS) + MEANS.format(divisor="known", run=sql.RUN))
def f03(spark, d):
    return spell_out(
        features.mean_embedding(views.documents(spark, d), "doc_id", "text", views.word_vectors(spark, d), 64)
    )


@query("f04_mean_embedding_oov_zero", sql.with_(WORD_VECTORS) + MEANS.format(divisor="size", run=sql.RUN))
def f04(spark, d):
    return spell_out(
        features.mean_embedding(views.documents(spark, d), "doc_id", "text", views.word_vectors(spark, d), 64, oov="zero")
    )


# -------------------------------------------------------------- explanations



def tfidf_of(spark, d):
    """The explanations store what they read several times."""
    return features.tfidf(views.documents(spark, d), "doc_id", "text")


WEIGHTED = "weighted AS (SELECT *, CAST('0x' || substr(md5(token), 1, 4) AS BIGINT) / 65535 - 0.5 AS w FROM tfidf)"


@query(
    "h02_linear_shap",
    sql.with_(
        *FEATURES,
        WEIGHTED,
        """m AS (SELECT token, any_value(w) AS w, sum(value) / (SELECT count(*) FROM documents) AS mean FROM weighted GROUP BY token)""",
    )
    + """SELECT doc_id, token, round(m.w * (value - mean), 9) AS phi FROM weighted JOIN m USING (token)
      UNION ALL SELECT doc_id, '(absent tokens)', round(coalesce(c, 0.0) - (SELECT sum(w * mean) FROM m), 9) FROM documents
      LEFT JOIN (SELECT doc_id, sum(m.w * mean) AS c FROM weighted JOIN m USING (token) GROUP BY doc_id) USING (doc_id)""",
)
def h02(spark, d):
    docs = views.documents(spark, d)
    out = explain.linear_shap(docs, tfidf_of(spark, d), "doc_id", views.weights(spark, d))
    return out.select("doc_id", "token", F.round("phi", 9).alias("phi"))


@query(
    "h03_occlusion",
    sql.with_(*FEATURES, WEIGHTED)
    + """SELECT doc_id, token, round(1 / (1 + exp(-z)) - 1 / (1 + exp(-(z - w * value))), 9) AS drop
      FROM (SELECT *, sum(w * value) OVER (PARTITION BY doc_id) AS z FROM weighted)""",
)
def h03(spark, d):
    f = tfidf_of(spark, d)
    out = explain.occlusion(f, "doc_id", views.weights(spark, d))
    return out.select("doc_id", "token", F.round("drop", 9).alias("drop"))


@query(
    "h04_path_gradients",
    sql.with_(
        *FEATURES,
        WEIGHTED,
        """docs AS (SELECT doc_id, z, norm, list_sum(list_transform(range(1, 51), lambda k:
            1 / (1 + exp(-((k - 0.5) / 50 * z))) * (1 - 1 / (1 + exp(-((k - 0.5) / 50 * z)))))) / 50 AS slope
          FROM (SELECT doc_id, sum(w * value) AS z, sqrt(sum(w * value * w * value)) AS norm FROM weighted GROUP BY doc_id))""",
    )
    + """SELECT doc_id, token, round(CASE WHEN norm > 0 THEN w * value / norm ELSE 0.0 END, 9) AS attribution,
        round(slope * z - (1 / (1 + exp(-z)) - 0.5), 9) AS delta FROM weighted JOIN docs USING (doc_id)""",
)
def h04(spark, d):
    f = tfidf_of(spark, d)
    out = explain.path_gradients(f, "doc_id", views.weights(spark, d))
    return out.select("doc_id", "token", F.round("attribution", 9).alias("attribution"), F.round("delta", 9).alias("delta"))


SECTION = "string_split(regexp_extract(text, '(?is)2\\.\\s*Problematic sentences:(.*)$', 1), '3.')[1]"


@query(
    "h05_flagged_sentences",
    sql.with_(
        sql.GENERATED,
        # Without look-ahead: cut the section at "-The", read each piece, keep the last tag.
        f"""sections AS (SELECT id, source_text, {SECTION} AS s FROM generated),
        pieces AS (SELECT id, source_text, unnest(p) AS piece, generate_subscripts(p, 1) AS n FROM (
          SELECT id, source_text, string_split(s, '-The') AS p FROM sections)),
        found AS (SELECT id, source_text, n, regexp_extract(piece, '(?s)^ sentence ''([^'']+)''([^-]*)$', ['s', 'rest']) AS f
          FROM pieces WHERE n > 1 AND regexp_matches(piece, '(?s)^ sentence ''([^'']+)''([^-]*)$'))""",
    )
    + f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INTEGER) AS place, {sql.strip('f.s')} AS sentence,
        regexp_extract_all(f.rest, '<(r\\d)>\\d</r\\d>', 1)[-1] AS tag, contains(lower(source_text), lower({sql.strip('f.s')})) AS matched FROM found
      WHERE len(regexp_extract_all(f.rest, '<(r\\d)>\\d</r\\d>', 1)) > 0""",
)
def h05(spark, d):
    return explain.flagged_sentences(views.generated(spark, d), "id", "text", "source_text")


def escaped(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


def style_sql(part: int) -> str:
    return "CASE tag " + " ".join(f"WHEN '{t}' THEN {sql.q(s[part])}" for t, s in fixed.TAG_STYLES.items()) + " END"


@query(
    "h06_highlight",
    sql.with_(
        sql.GENERATED,
        # The view flags one sentence per answer, and at most the one; no flag where it holds an apostrophe or a hyphen breaks the line.
        f"""f AS (SELECT id, {escaped('source_text')} AS body, coalesce({sql.last_binary(sql.clean_output('text'))}, 0) AS y_pred,
            regexp_extract({SECTION}, '(?s)-The sentence ''([^'']+)''[^-]*?<(r\\d)>\\d</r\\d>[^-]*$', ['s', 't']) AS flag FROM generated),
        g AS (SELECT id, body, y_pred, flag.t AS tag, {escaped(sql.strip('flag.s'))} AS sentence FROM f)""",
    )
    + f"""SELECT id, CASE WHEN tag = '' THEN '<div>' || body || '</div>' ELSE '<div><h4>' ||
        CASE WHEN y_pred = 1 THEN 'Coherente' ELSE 'No coherente' END || '</h4><div>' ||
        regexp_replace(body, regexp_escape(sentence), '<span style="background-color: ' || {style_sql(0)} || '; border-left: 4px solid ' ||
          {style_sql(1)} || '" title="' || {style_sql(2)} || '">' || replace(sentence, chr(92), chr(92) || chr(92)) || '</span>', 'gi') ||
        '</div><ul><li style="border-left: 4px solid ' || {style_sql(1)} || '"><b>' || upper(tag) || ':</b> ' || {style_sql(2)} || '</li></ul></div>' END AS html
      FROM g""",
)
def h06(spark, d):
    read = rows.read_scores(views.generated(spark, d), F.col("text"), F.col("truth"))
    return explain.highlight(read, "source_text", "text", "y_pred").select("id", "html")


# -------------------------------------------------------------------- intake


def unit(what: str, key: str) -> str:
    return f"(CAST('0x' || substr(md5('42:{what}:' || CAST({key} AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


def pick_sql(values, what: str) -> str:
    return f"[{', '.join(sql.q(v) for v in values)}][CAST(floor({unit(what, 'doc_id')} * {len(values)}) AS BIGINT) + 1]"


PROMPTS = f"""prompts AS (SELECT doc_id, theme, structure, CAST(512 + floor({unit('tokens', 'doc_id')} * 512) AS INTEGER) AS max_new_tokens,
    round(0.8::DOUBLE + {unit('temperature', 'doc_id')} * 0.4::DOUBLE, 9) AS temperature,
    replace(replace({sql.q(fixed.PROMPT_HEAD)}, '{{theme}}', theme), '{{structure}}', structure) ||
    {' || '.join(f"CASE WHEN {unit(f'clause{i}', 'doc_id')} < {p} THEN {sql.q(c)} ELSE '' END" for i, (c, p) in enumerate(fixed.PROMPT_CLAUSES))} ||
    {sql.q(fixed.PROMPT_TAIL)} AS prompt
  FROM (SELECT doc_id, {pick_sql(fixed.THEMES, 'theme')} AS theme, {pick_sql(fixed.STRUCTURES, 'structure')} AS structure FROM documents))"""


@query("i01_prompt_table", sql.with_(PROMPTS) + "SELECT * FROM prompts")
def i01(spark, d):
    """A prompt for every document id."""
    out = intake.prompt_table(views.table(spark, d, "documents"), "doc_id")
    return out.withColumn("temperature", F.round("temperature", 9))


def load_length_model():
    return {"limit": 1000}


def infer_by_length(model, texts):
    return [f"<score>{int(len(t) > model['limit'])}</score>" for t in texts]


@query(
    "i02_batch_infer",
    "SELECT doc_id, CASE WHEN length(text) > 1000 THEN '<score>1</score>' ELSE '<score>0</score>' END AS response FROM documents",
)
def i02(spark, d):
    docs = views.documents(spark, d).select("doc_id", "text")
    return intake.batch_infer(docs, "text", load_length_model, infer_by_length).select("doc_id", "response")


def greedy(source: str) -> str:
    """Sequential acceptance over ``source`` (ord, title, text), one row at a time."""
    return f"""queue AS MATERIALIZED (SELECT ord, title, md5(substr(text, 1, 100)) AS prefix, row_number() OVER (ORDER BY ord) AS n
      FROM {source} WHERE length(text) > 200),
    walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS ord, []::VARCHAR[] AS titles, []::VARCHAR[] AS prefixes, FALSE AS ok
      UNION ALL SELECT q.n, q.ord,
        CASE WHEN list_contains(titles, q.title) OR list_contains(prefixes, q.prefix) THEN titles ELSE list_append(titles, q.title) END,
        CASE WHEN list_contains(titles, q.title) OR list_contains(prefixes, q.prefix) THEN prefixes ELSE list_append(prefixes, q.prefix) END,
        NOT (list_contains(titles, q.title) OR list_contains(prefixes, q.prefix))
      FROM walk w JOIN queue q ON q.n = w.n + 1),
    accepted AS (SELECT ord FROM walk WHERE ok)"""


FIRST_LINE_STORIES = "candidates AS (SELECT doc_id AS ord, string_split(text, chr(10))[1] AS title, text FROM documents)"


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


@query(
    "i03_accept_unique",
    with_recursive(FIRST_LINE_STORIES, greedy("candidates")) + "SELECT ord AS story_id FROM accepted",
)
def i03(spark, d):
    stories = views.stories(spark, d)
    return intake.accept_unique(stories, "story_id", F.col("title"), F.col("text")).select("story_id")


@query(
    "i04_generated_stories",
    with_recursive(
        sql.GENERATED,
        PROMPTS,
        f"""candidates AS (SELECT id AS ord, trim({sql.strip("regexp_extract(s, '(?s)^(.*?)Text:(.*)$', 1)")}, '"') AS title,
          replace(trim({sql.strip("regexp_extract(s, '(?s)^(.*?)Text:(.*)$', 2)")}, '"'), chr(10), ' ') AS text
          FROM (SELECT id, string_split(text, 'Title:')[-1] AS s FROM generated))""",
        greedy("candidates"),
    )
    + f"""SELECT ord AS id, title, text, theme, structure, CAST(len(w) AS INTEGER) AS word_count,
        round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w), 2) AS diversity_score, 0 AS score
      FROM (SELECT *, {sql.words('text')} AS w FROM candidates JOIN accepted USING (ord)) JOIN prompts ON ord = doc_id""",
)
def i04(spark, d):
    asked = intake.prompt_table(views.table(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), "theme", "structure"
    )
    answers = views.generated(spark, d).select("id", "text").join(asked, "id")
    return intake.generated_stories(answers, "id", "text")


@query(
    "i05_accept_unique_stream",
    with_recursive(FIRST_LINE_STORIES, greedy("candidates")) + "SELECT ord AS story_id FROM accepted",
)
def i05(spark, d):
    """The documents as a file stream; what the finished stream has accepted."""
    source = views.table(spark, d, "documents")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/documents.parquet*")  # a file or a folder of files
    accepted = scratch_path(spark, "accepted")
    accept_unique_stream(
        stream.withColumnRenamed("doc_id", "story_id"), accepted, scratch_path(spark, "progress"),
        "story_id", F.substring_index("text", "\n", 1), F.col("text"),
    ).awaitTermination()
    return spark.read.parquet(accepted).select("story_id")


# -------------------------------------------------------------------- models


def labeled(spark, d):
    """id, text, label of the labelled documents, read once."""
    docs = views.labeled_documents(spark, d)
    cleaned = text.clean_text(F.col("text"), lower=True).alias("text")
    return checkpointed(docs.select(F.col("doc_id").alias("id"), cleaned, "label"))


def vectorized(spark, d):
    docs = labeled(spark, d)
    return models.fit_vectorizer(docs).transform(docs)


def summary_of(pred):
    scored = metrics.summary_scores(metrics.label_scores(metrics.confusion_counts(pred)))
    return scored.select("rows", F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"))


def fitted(spark, d, fits):
    """Training-set scores per model, a floor check for fits without an SQL counterpart."""
    data = vectorized(spark, d).persist()
    out = None
    for name, fit in fits.items():
        row = summary_of(models.predictions(fit(data), data)).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return checkpointed(out)


@query("g01_fit_linear")
def g01(spark, d):
    return fitted(spark, d, {
        "l2": models.linear("l2"), "l1": models.linear("l1", c=10.0),
        "elasticnet": models.linear("elasticnet", c=10.0), "hinge": models.linear("hinge"),
    })


@query("g02_fit_modified_huber")
def g02(spark, d):
    return fitted(spark, d, {"modified_huber": models.modified_huber()})


def embedded(spark, d):
    """Embeddings as vectors, label 0/1 by parity of the given label."""
    return checkpointed(views.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), array_to_vector("embedding").alias("features"), (F.col("label") % 2).alias("label")
    ))


def fitted_on_embeddings(spark, d, fits):
    data = embedded(spark, d)
    out = None
    for name, fit in fits.items():
        row = summary_of(models.predictions(fit(data), data)).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return checkpointed(out)


@query("g03_fit_tree")
def g03(spark, d):
    return fitted_on_embeddings(spark, d, {
        "decision_tree": models.tree("decision_tree"),
        "random_forest": models.tree("random_forest"),
        "boosted": models.tree("boosted"),
    })


@query("g04_fit_mlp")
def g04(spark, d):
    return fitted_on_embeddings(spark, d, {"mlp": models.mlp([16])})


KNN = f"""vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, rank <= ceil(0.2 * class_rows) AS is_test
    FROM ({sql.ranked('embeddings', None, 'vec_id')})),
  pairs AS (SELECT q.vec_id, t.label, t.vec_id AS neighbour, round({{distance}}, 9) AS distance
    FROM vecs q JOIN vecs t ON q.is_test AND NOT t.is_test),
  near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS place FROM pairs QUALIFY place <= 5)"""


def knn_data(spark, d):
    vecs = sample.random_split(views.table(spark, d, "embeddings"), 0.2, "vec_id")
    vecs = vecs.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label", "split")
    return vecs.where("split = 'train'"), vecs.where("split = 'test'")


@query(
    "g05_knn_classify",
    sql.with_(KNN.format(distance="1 - list_cosine_similarity(q.e, t.e)"))
    + """SELECT vec_id, arg_max(label, [w, -label]) AS y_pred FROM (
       SELECT vec_id, label, CAST(count(*) AS DOUBLE) AS w FROM near GROUP BY vec_id, label) GROUP BY vec_id""",
)
def g05(spark, d):
    train, test = knn_data(spark, d)
    return neighbors.knn_classify(train, test, 5, "uniform", "cosine", id_col="vec_id")


@query(
    "g05_knn_nearest",
    sql.with_(KNN.format(distance="list_distance(q.e, t.e)"))
    + "SELECT vec_id, neighbour, label, distance, CAST(place AS INTEGER) AS place FROM near",
)
def g05_nearest(spark, d):
    train, test = knn_data(spark, d)
    return neighbors.nearest(train, test, 5, "euclidean", id_col="vec_id")


@query("g05_knn_in_cells", ORACLES["g05_knn_nearest"])
def g05_in_cells(spark, d):
    train, test = knn_data(spark, d)
    return cells.nearest_in_cells(train, test, 5, "euclidean", id_col="vec_id")


@query("g06_cross_validate")
def g06(spark, d):
    columns = {"l2": LinearModel("logistic", c=100.0), "hinge": LinearModel("hinge", c=100.0)}
    held_out = models.cross_validate_words(labeled(spark, d), columns)
    return checkpointed(models.compare_models(held_out, "f1"))


TRIALS = 50  # a study of the reference's full pipeline


def searched(data, studies):
    found = models.random_search(data, studies, TRIALS)
    return checkpointed(found.select("study", "trial", F.round("value", 6).alias("value")))


@query("g07_random_search")
def g07(spark, d):
    """The linear studies, whose models move together, and the kNN study."""
    return searched(embedded(spark, d), [*models.LINEAR_STUDIES, "knn"])


@query("g07_tree_search")
def g07_trees(spark, d):
    """The studies that take a fit per trial and fold: trees, forests, boosted trees and networks."""
    return searched(embedded(spark, d), [s for s in models.SEARCH_SPACES if s not in (*models.LINEAR_STUDIES, "knn")])


@query("g08_train_and_evaluate")
def g08(spark, d):
    docs = labeled(spark, d)
    _, pred = models.train_and_evaluate(docs, models.linear("l2", c=100.0), F.col("text"))
    return checkpointed(pred)


@query("g08_train_on_embeddings")
def g08_embeddings(spark, d):
    """As g08, on means of word vectors."""
    docs = labeled(spark, d)
    vectors = checkpointed(views.word_vectors(spark, d))
    _, pred = models.train_and_evaluate(
        docs, models.linear("l2", c=100.0), F.col("text"), weighting="embedding", vectors=vectors
    )
    return checkpointed(pred)


@query("g09_score_table")
def g09(spark, d):
    docs = labeled(spark, d)
    path = scratch_path(spark, "model")
    models.train_and_evaluate(docs, models.linear("l2", c=100.0), F.col("text"), model_path=path)
    report, _ = models.score_table(PipelineModel.load(path), docs)
    return report


@query("h01_lime_explain")
def h01(spark, d):
    """Every document explained by a model fitted on the labelled ones."""
    docs = labeled(spark, d)
    model, _ = models.train_and_evaluate(docs, models.linear("l2", c=100.0), F.col("text"))
    cleaned = text.clean_text(F.col("text"), lower=True).alias("text")  # as the model has seen its texts
    target = views.documents(spark, d).select(F.col("doc_id").alias("id"), cleaned)
    # A file of few row groups would leave the work, far more than reading, to as many tasks.
    target = spread(target, "id", 4 * spark.sparkContext.defaultParallelism)
    return lime_explain(target, model, "id", "text").select("id", "word", F.round("weight", 6).alias("weight"))


# ----------------------------------------------------------- sources and sinks


@query(
    "a01_read_story_json",
    sql.with_(sql.STORIES, sql.SENTENCES)
    + """SELECT story_id, title, text, CAST(score5 AS DOUBLE) AS consensus, CAST(coalesce(n, 0) AS INTEGER) AS sentences
       FROM stories LEFT JOIN (SELECT story_id, count(*) AS n FROM sentences GROUP BY story_id) USING (story_id)""",
)
def a01(spark, d):
    """The stories written as JSON objects keyed by id, one per line, and read back."""
    nested = views.nested_stories(spark, d).select(
        F.col("story_id").cast("string").alias("key"),
        F.struct(
            F.col("story_id").alias("StoryID"), F.col("title").alias("Title"), F.col("text").alias("Text"),
            F.col("holistic").alias("HolisticData"), F.col("incremental").alias("IncrementalData"),
        ).alias("story"),
    )
    path = scratch_path(spark, "stories")
    write_story_json(nested, path)
    back = read_story_json(spark, path, lines=True)
    return back.select(
        "story_id", "title", "text", F.col("incremental.consensus_score").alias("consensus"),
        F.size("incremental.sentences").alias("sentences"),
    )


@query("a02_read_labeled_csv", sql.with_(LABELED) + "SELECT doc_id, text, label AS score FROM labeled")
def a02(spark, d):
    path = scratch_path(spark, "labeled")
    tables.write_table(views.labeled_documents(spark, d).select("doc_id", "text", F.col("label").alias("score")), path, "csv")
    return tables.read_labeled_csv(spark, path, "doc_id bigint, text string, score int")


@query("a03_write_table", "SELECT * FROM documents")
def a03(spark, d):
    path = scratch_path(spark, "documents")
    tables.write_table(views.table(spark, d, "documents"), path, "parquet")
    return spark.read.parquet(path)


@query(
    "a04_write_instruction_json",
    sql.with_(LABELED, ALLOT)
    + f"""SELECT CASE WHEN rank <= n_test THEN 'validation' ELSE 'train' END AS split,
        {USER_SQL} AS instruction, '' AS input, {ASSISTANT_SQL} AS output
      FROM ({sql.ranked('labeled', 'label', 'doc_id')}) JOIN allot ON label = quality""",
)
def a04(spark, d):
    docs = sample.stratified_split(views.labeled_documents(spark, d), "label", 0.2, "doc_id")
    tag = F.concat(F.lit("<score>"), F.col("label").cast("string"), F.lit("</score>"))
    records = tables.instruction_records(
        docs,
        text.fill(USER_TEMPLATE, F.col("text")),
        text.fill(ASSISTANT_TEMPLATE, F.concat(F.lit("toxic "), F.col("toxic").cast("string")), tag),
        F.when(F.col("split") == "test", "validation").otherwise("train"),
    )
    path = scratch_path(spark, "instructions")
    tables.write_instruction_json(records, path)
    return spark.read.schema("instruction string, input string, output string, split string").json(path)


@query("a05_materialize", sql.with_(VOCABULARY) + "SELECT token FROM vocabulary")
def a05(spark, d):
    """Built once, then loaded: the second call reads what the first one stored."""
    root = scratch_path(spark, "artefacts")
    build = lambda docs: features.vocabulary(docs, "text")
    source = views.documents(spark, d)
    materialize(source, root, "vocabulary", build)
    return materialize(source, root, "vocabulary", build)
