import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls, empty and long texts, copies in other case, repeated rows and clashing extra columns."""
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 1),
        (2, "alpha BETA gamma delta epsilon zeta.", "en", "a", 1),
        (3, None, "en", "a", 0),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "en", "b", 0),
        (6, "start six " + passage + " end six", "en", "b", 0),
        (7, passage + " seven goes on", "en", "c", 0),
        (8, "x " * 5000 + passage, "en", "c", 0),
        (9, "word", "de", "c", 0),
        (9, "word", "de", "c", 0),
        (None, "no id here", "de", "d", 0),
        (None, "no id here", "de", "d", 0),
        (10, "naïve café — 日本語 <|endoftext|> don't 12345 !!! \x1c\x85", None, None, None),
        (11, "y" * 3000, "fr", "d", 0),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return frame.withColumn("kept", F.lit("mine")).withColumn("bucket", F.lit(7)).withColumn("shard", F.lit("s")).cache()


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")
