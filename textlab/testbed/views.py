"""Derived views that bind the generic operators to the given tables.

Every view reads a whole table; none cuts rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.text import feature_tokens, split_sentences, words
from textlab.operators.features import distinct_words
from textlab.plans.layout import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The given files have one row group each; ``textlab.partitions`` says how far to spread them.
    partitions = spark.conf.get("textlab.partitions", None)
    return spread(table(spark, sf_dir, "documents"), "doc_id", partitions and int(partitions))


def stories(spark, sf_dir) -> DataFrame:
    """story_id, title (first line), text, score5 (1..5)."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("story_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        (F.col("doc_id") % 5 + 1).cast("int").alias("score5"),
    )


def reasons(spark, sf_dir) -> DataFrame:
    """story_id, annotator, sentence_id (0-based), reason (1..8) from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("story_id"),
        F.concat(F.lit("annot"), (F.col("l_suppkey") % 3).cast("string")).alias("annotator"),
        (F.col("l_linenumber") - 1).cast("int").alias("sentence_id"),
        (F.col("l_partkey") % 8 + 1).cast("int").alias("reason"),
    )


def nested_stories(spark, sf_dir) -> DataFrame:
    """Stories in their nested form.

    Ids have small domains (3 annotators, 7 sentence ids, 8 reasons), so what an
    annotator marked fits the 56 bits of one number; another line number stops the job. A single map-side
    aggregation gathers everything a story needs, and the maps are spelled out
    from the bits afterwards.
    """
    annotators = (0, 1, 2)
    who = F.col("l_suppkey") % 3
    place = """CAST(CASE WHEN l_linenumber BETWEEN 1 AND 7 THEN (l_linenumber - 1) * 8 + l_partkey % 8
        ELSE raise_error(concat('sentence number ', l_linenumber, ' does not fit the bits of a mark')) END AS INT)"""
    lines = table(spark, sf_dir, "lineitem").withColumn("_bit", F.expr(f"shiftleft(1L, {place})"))
    gathered = lines.groupBy(F.col("l_orderkey").alias("story_id")).agg(
        *[F.bit_or(F.when(who == a, F.col("_bit"))).alias(f"_marks{a}") for a in annotators],
        *[F.max(F.when(who == a, F.col("l_quantity"))).alias(f"_score{a}") for a in annotators],
    )

    def marked(bits: Column) -> Column:
        given = lambda i: F.filter(
            F.sequence(F.lit(1), F.lit(8)), lambda r: F.getbit(bits, i * 8 + r - 1) == 1
        )
        entries = F.transform(
            F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct(i.cast("string").alias("key"), given(i).alias("value"))
        )
        return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))

    def per_annotator(column: str, value) -> Column:
        entries = F.array(
            *[
                F.when(F.col(f"{column}{a}").isNotNull(), F.struct(F.lit(f"annot{a}").alias("key"), value(F.col(f"{column}{a}")).alias("value")))
                for a in annotators
            ]
        )
        return F.map_from_entries(F.array_compact(entries))

    scores = per_annotator("_score", lambda s: (s.cast("int") % 6).cast("double"))
    consensus = F.col("score5").cast("double").alias("consensus_score")
    return (
        stories(spark, sf_dir)
        .join(gathered, "story_id", "left")
        .select(
            "story_id",
            "title",
            "text",
            F.struct(F.size(scores).alias("num_annotators"), scores.alias("scores"), consensus).alias("holistic"),
            F.struct(
                split_sentences(F.col("text")).alias("sentences"),
                F.size(scores).alias("num_annotators"),
                scores.alias("scores"),
                per_annotator("_marks", marked).alias("reasons"),
                consensus,
            ).alias("incremental"),
        )
    )


def lemmas(spark, sf_dir) -> DataFrame:
    """word, lemma: plural-looking words of the documents without their s."""
    word = F.col("word")
    return (
        documents(spark, sf_dir)
        .select(F.explode(words(F.col("text"))).alias("word"))
        .where((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"))
        .distinct()
        .select("word", F.expr("substr(word, 1, length(word) - 1)").alias("lemma"))
    )


def labeled_documents(spark, sf_dir) -> DataFrame:
    """doc_id, text, label (quality 0/1) of the documents that have labels."""
    return documents(spark, sf_dir).join(
        table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic"), "doc_id"
    ).select("doc_id", "text", "label", "toxic")


def pred2(spark, sf_dir) -> DataFrame:
    """id, fold, two-class y_true, y_pred from orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % 10).cast("int").alias("fold"),
        (F.col("o_totalprice") > 250000).cast("int").alias("y_true"),
        (F.col("o_custkey") % 2).cast("int").alias("y_pred"),
    )


def pred5(spark, sf_dir) -> DataFrame:
    """id, fold, five-class y_true, y_pred from orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % 10).cast("int").alias("fold"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("y_true"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("y_pred"),
    )


def trials(spark, sf_dir) -> DataFrame:
    """study, trial, value from orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("study"),
        F.col("o_orderkey").alias("trial"),
        (F.col("o_totalprice") / 500000).alias("value"),
    )


def generated(spark, sf_dir) -> DataFrame:
    """id, truth, text: an answer in the shape a model gives, one per document."""
    docs = documents(spark, sf_dir)
    first = F.get(split_sentences(F.col("text")), F.lit(0))
    kind = F.col("doc_id") % 5
    tag = (F.col("doc_id") % 7 + 1).cast("string")
    score = (
        F.when(kind == 0, "<score>1</score>")
        .when(kind == 1, "<score> 0 </score>")
        .when(kind == 2, "## Score: 1")
        .when(kind == 3, "<score>0</score> <score>1</score>")
        .otherwise("none")
    )
    return docs.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 2).cast("int").alias("truth"),
        F.col("text").alias("source_text"),
        F.concat(
            F.when(F.col("doc_id") % 3 == 0, "<think>x <score>1</score></think>").otherwise(""),
            F.lit("Title: "),
            F.substring_index("text", "\n", 1),
            F.lit("\nText: "),
            F.col("text"),
            F.lit("\n## Response:\n2. Problematic sentences:\n\t-The sentence '"),
            F.coalesce(first, F.lit("")),
            F.lit("' fails <r"), tag, F.lit(">1</r"), tag, F.lit(">\n3. Conclusion "),
            score,
        ).alias("text"),
    )


def history(spark, sf_dir) -> DataFrame:
    """trial, step position (ts, event_id) and value from events."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trial"), F.col("event_id").alias("step_id"), "ts", "value"
    )


def word_vectors(spark, sf_dir) -> DataFrame:
    """word, vec for plain words; words with capitals, accents or punctuation have no vector."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    plain = distinct_words(documents(spark, sf_dir), "text").where(F.col("word").rlike("^[a-z]+$"))
    place = F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("bigint") % n
    # Never null, or the join's test for null would be put before ``distinct`` and hash every occurrence of a word.
    return plain.withColumn("vec_id", F.coalesce(place, F.lit(-1))).join(vectors, "vec_id").select("word", F.col("embedding").alias("vec"))


def weights(spark, sf_dir) -> DataFrame:
    """token, w in -0.5..0.5 for every feature token of the documents."""
    tokens = documents(spark, sf_dir).select(F.explode(feature_tokens(F.col("text"))).alias("token")).distinct()
    return tokens.withColumn(
        "w", F.conv(F.substring(F.md5("token"), 1, 4), 16, 10).cast("double") / 65535 - 0.5
    )
