"""Registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import bpe, clusters, exact, hard_negatives, near, neighbours, packing, pages, quality, secrets, shards, substrings, urls
from textlab.llm.common import raw, table

QUERIES, ORACLES = {}, {}


def query(run):
    QUERIES[run.__name__] = run
    return run


URL_RULES = (
    urls.host_rule("com", "/", "allow"),
    urls.host_rule("example.com", "/en/", "block"),
    urls.host_rule("www.example.com", "/en/", "allow"),
    urls.host_rule("net", "/es/", "block"),
    urls.host_rule("net", "/fr/", "block"),
)


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _url_sql() -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r.name))
    cases = []
    for r in ordered:
        host, path = r.name[: r.name.index("/")], r.name[r.name.index("/") :]
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{r.name}'")
    verdicts = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in ordered)
    words = [(p.name, "-".join(p.name.split())) for p in urls.DEFAULT_PATTERNS]
    fits = " ".join(
        f"WHEN regexp_matches(host || path, '^([^/]*[.-])?{w}([-.:/]|$)', 's') THEN '{n}'" for n, w in sorted(words)
    )
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', ['h', 'p'], 's'), {{'h': '', 'p': ''}}) AS x FROM pages
), parts AS (
  SELECT page_id, translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.p AS path FROM cut
), ruled AS (
  SELECT page_id, host, path, CASE {' '.join(cases)} END AS rule, CASE {fits} END AS pattern FROM parts
)
SELECT page_id, host, path, rule, pattern,
       CASE rule {verdicts} ELSE CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END END AS verdict
FROM ruled"""


ORACLES["op3_url_filter"] = _url_sql()


@query
def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return rows.select(
        "doc_id",
        shards.record_size("text").alias("size"),
        F.crc32(F.coalesce(raw("text"), F.lit(b""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_digest")).alias("text_sha256"))


ORACLES["op9_exact_dedup"] = """
WITH rows AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM rows JOIN groups USING (text_sha256)"""


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), places AS (
  SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS p FROM w WHERE len(ws) >= 50
), win AS (
  SELECT doc_id, p, sha256(array_to_string(ws[p:p + 49], ' ')) AS h FROM places
), first AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS i FROM win JOIN first USING (h) WHERE doc_id > least
), cut AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN ws
              ELSE [ws[i] FOR i IN list_sort(list_filter(generate_series(1, len(ws)), lambda i: NOT list_contains(gone, i)))] END AS left_words
  FROM w LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(left_words, ' '), '')) AS kept_sha256 FROM kept"""


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), word_bpe(), decoded=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe())


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")

@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.digest(*clusters.cluster(table(spark, sf_dir, "embeddings")))


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """Every round written out: assign by whole-number distances, then floors of the means."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY 1 LIMIT {k})
)""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, cluster, d FROM (
    SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{r}
  ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1
)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i)
    GROUP BY cluster
  ) m ON m.cluster = c{r}.cluster
)"""
            )
    return f"""WITH {', '.join(parts)}
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLES["op13_centroid_clusters"] = _cluster_sql()


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=moved)


ORACLES["op11_hard_negatives"] = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""
