"""Pieces of DuckDB SQL shared by the checks. Written from the definitions, not from the Spark code."""

from __future__ import annotations

from textlab.functions import fixed


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = q(fixed.WHITESPACE)
RUN = q(fixed.WHITESPACE_RUN)
STOPS = ", ".join(q(w) for w in fixed.STOP_WORDS)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {RUN}), lambda w: w <> '')"


def normalized(x: str) -> str:
    bare = f"translate(lower({strip(x)}), {q(fixed.ASCII_PUNCTUATION)}, '')"
    return (
        f"array_to_string(list_filter(string_split_regex({bare}, {RUN}), "
        f"lambda w: w <> '' AND w NOT IN ({STOPS})), ' ')"
    )


def sentence_list(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?]+[.!?]*'), "
        f"lambda s: {strip('s')}), lambda s: s <> '')"
    )


STORIES = """stories AS (
  SELECT doc_id AS story_id, string_split(text, chr(10))[1] AS title, text, CAST(doc_id % 5 + 1 AS INTEGER) AS score5
  FROM documents)"""

SENTENCES = f"""sentences AS (
  SELECT story_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT doc_id AS story_id, {sentence_list('text')} AS s FROM documents))"""

REASONS = """reasons AS (
  SELECT l_orderkey AS story_id, 'annot' || CAST(l_suppkey % 3 AS VARCHAR) AS annotator,
         CAST(l_linenumber - 1 AS INTEGER) AS sentence_id, CAST(l_partkey % 8 + 1 AS INTEGER) AS reason
  FROM lineitem)"""

FLAG_AGGS = ", ".join(
    f"CAST(max(CASE WHEN reason = {k} THEN 1 ELSE 0 END) AS INTEGER) AS r{k}" for k in fixed.REASONS
)
FLAGS = f"""flags AS (
  SELECT story_id, sentence_id AS pos, {FLAG_AGGS} FROM reasons GROUP BY ALL)"""

FLAG_NAMES = ", ".join(f"r{k}" for k in fixed.REASONS)


def any_flag(upto: int) -> str:
    return "(" + " OR ".join(f"r{k} = 1" for k in range(1, upto)) + ")"


def reason_text() -> str:
    parts = []
    for k in fixed.REASONS:
        head, tail = fixed.REASON_OPENINGS[k].split("{}")
        full = f"{q(head)} || sentence || {q(tail)}"
        later = (
            f"WHEN r{k} = 1 AND {any_flag(k)} THEN {q(fixed.REASON_CONTINUATIONS[k])} "
            if k > 1 else ""
        )
        parts.append(f"CASE {later}WHEN r{k} = 1 THEN {full} ELSE '' END")
    return " || ".join(parts)


def cot_block(score: str, problems: str) -> str:
    listed = f"CASE WHEN {strip(problems)} = '' THEN {q(fixed.NO_PROBLEMS)} ELSE {problems} END"
    whens = " ".join(
        f"WHEN {score} = {v} THEN {q(fixed.ASSESSMENT_HEAD + o + fixed.ASSESSMENT_PROBLEMS)} || {listed} || "
        f"{q(fixed.ASSESSMENT_END + c)}"
        for v, (o, c) in fixed.VERDICTS.items()
    )
    return f"CASE {whens} ELSE {q(fixed.INVALID_SCORE)} END"


FLAGGED = f"""flagged AS (
  SELECT s.story_id, s.pos, s.sentence, {', '.join(f'coalesce(f.r{k}, 0) AS r{k}' for k in fixed.REASONS)}
  FROM sentences s LEFT JOIN flags f USING (story_id, pos))"""

PROBLEMS = f"""problems AS (
  SELECT story_id, coalesce(string_agg({q(fixed.PROBLEM_SEPARATOR)} || txt, '' ORDER BY pos) FILTER (txt <> ''), '') AS problems,
         {', '.join(f'max(r{k}) AS r{k}' for k in fixed.REASONS)}
  FROM (SELECT *, {reason_text()} AS txt FROM flagged) GROUP BY story_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


GENERATED = f"""generated AS (
  SELECT doc_id AS id, CAST(doc_id % 2 AS INTEGER) AS truth, text AS source_text,
    CASE WHEN doc_id % 3 = 0 THEN '<think>x <score>1</score></think>' ELSE '' END || 'Title: ' ||
    string_split(text, chr(10))[1] || chr(10) || 'Text: ' || text || chr(10) || '## Response:' || chr(10) ||
    '2. Problematic sentences:' || chr(10) || chr(9) || '-The sentence ''' || coalesce({sentence_list('text')}[1], '') ||
    ''' fails <r' || CAST(doc_id % 7 + 1 AS VARCHAR) || '>1</r' || CAST(doc_id % 7 + 1 AS VARCHAR) || '>' || chr(10) ||
    '3. Conclusion ' || CASE doc_id % 5 WHEN 0 THEN '<score>1</score>' WHEN 1 THEN '<score> 0 </score>'
      WHEN 2 THEN '## Score: 1' WHEN 3 THEN '<score>0</score> <score>1</score>' ELSE 'none' END AS text
  FROM documents)"""


def clean_output(x: str) -> str:
    out = f"coalesce({x}, '')"
    for leftover, plain in fixed.TOKENIZER_LEFTOVERS.items():
        out = f"replace({out}, {q(leftover)}, {q(plain)})"
    return strip(f"regexp_replace({out}, '(?s)<think>.*?</think>', '', 'g')")


def last_binary(x: str) -> str:
    return (
        f"CAST(coalesce(list_extract(regexp_extract_all({x}, '<score>\\s*([01])\\s*</score>', 1), -1), "
        f"list_extract(regexp_extract_all({x}, '(?i)score\\s*[:\\-]?\\s*([01])\\b', 1), -1)) AS INTEGER)"
    )


def ranked(table: str, label: str | None, id_col: str, seed: int = 42) -> str:
    part = f"PARTITION BY {label} " if label else ""
    return (
        f"SELECT *, row_number() OVER ({part}ORDER BY md5('{seed}:' || CAST({id_col} AS VARCHAR)), {id_col}) AS rank, "
        f"count(*) OVER ({part.strip()}) AS class_rows FROM {table}"
    )


PRED2 = """pred2 AS (SELECT o_orderkey AS id, CAST(o_orderkey % 10 AS INTEGER) AS fold,
  CAST(o_totalprice > 250000 AS INTEGER) AS y_true, CAST(o_custkey % 2 AS INTEGER) AS y_pred FROM orders)"""
PRED5 = """pred5 AS (SELECT o_orderkey AS id, CAST(o_orderkey % 10 AS INTEGER) AS fold,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS y_true, CAST(o_custkey % 5 + 1 AS INTEGER) AS y_pred FROM orders)"""
TRIALS = "trials AS (SELECT o_orderpriority AS study, o_orderkey AS trial, o_totalprice / 500000 AS value FROM orders)"


def label_scores(pred: str, by: str = "") -> str:
    """CTEs tallies and scores over a prediction table, per ``by`` columns."""
    b = f"{by}, " if by else ""
    return f"""tallies AS (SELECT {b}label, sum(t) AS support, sum(p) AS predicted, sum(h) AS hits FROM (
      SELECT {b}y_true AS label, 1 AS t, 0 AS p, CAST(y_true = y_pred AS INTEGER) AS h FROM {pred}
      UNION ALL SELECT {b}y_pred AS label, 0, 1, 0 FROM {pred}) GROUP BY ALL),
    scores AS (SELECT {b}label, CAST(support AS BIGINT) AS support, hits,
      CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision,
      CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall,
      CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0.0 END AS f1 FROM tallies)"""


def summary(by: str = "") -> str:
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    cols = ", ".join(
        [f"avg({c}) AS {c}_macro" for c in ("precision", "recall", "f1")]
        + [f"sum({c} * support) / sum(support) AS {c}_weighted" for c in ("precision", "recall", "f1")]
    )
    return f"""summary AS (SELECT {b}CAST(sum(support) AS BIGINT) AS rows, sum(hits) / sum(support) AS accuracy, {cols}
      FROM scores {group})"""
