"""Quality classifier by importance resampling.

Two generative models of hashed unigrams and bigrams are counted, one over labelled good documents (the
target) and one over all documents (the raw text), both mixed with a uniform one in the same proportion, so that
what neither has seen says nothing. The log of their ratio, summed over a document, is its
importance weight; adding Gumbel noise and taking the k largest draws k documents without replacement in
proportion to their weights (Xie et al. 2023). k is the share of good documents among the labelled ones and
its standard error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.bpe import slices
from textlab.llm.common import release, unused
from textlab.plans.durable import scratch_path

BUCKET_BITS = 16
TARGET_DOCUMENTS = 20_000  # bound of the labelled sample that the target model is fitted on
UNIFORM = 3.0  # parts of a uniform model mixed into one part of each counted one
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
REPEAT = np.uint64(0x51ED270B)  # stands for a word that follows itself, whatever the word
SPREAD, FIRST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def features(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """Buckets of the words, punctuation runs and pairs of neighbours of a text."""
    tokens = TOKEN.findall(text or "")
    one = np.fromiter(map(xxhash.xxh32_intdigest, tokens), np.uint64, len(tokens))
    two = np.where(one[1:] == one[:-1], REPEAT, one[:-1] * FIRST + one[1:])
    return ((np.concatenate((one, two)) * SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class QualityModel:
    """``log_ratio`` per bucket, and the share of documents to keep."""

    log_ratio: np.ndarray
    share: float

    def score(self, docs: DataFrame, text_col: str = "text") -> Column:
        """A struct of ``n_features`` and ``log_weight`` for each text; a null or empty text has weight 0."""
        ratio = self.log_ratio
        bits = len(ratio).bit_length() - 1
        kind = T.StructType([T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())])

        def weigh(texts: pa.Array) -> pa.Array:
            sizes, weights = [], []
            for text in texts:
                found = features(text.as_py(), bits)
                sizes.append(len(found))
                weights.append(float(ratio[found].sum()))
            return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())], ["n_features", "log_weight"])

        weigh.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(weigh, kind)(F.col(text_col))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    bits: int = BUCKET_BITS,
    target_documents: int = TARGET_DOCUMENTS,
    seed: int = 17,
) -> QualityModel:
    """Count both models in one pass over all of ``docs``.

    Labels of 1 are good, other values are not, null ones are left out. At most ``target_documents`` good
    ones, drawn by a seeded hash, make the target; the raw model counts every document. Without labels
    nothing is rejected. A task sends one row per bucket, and ``2**bits`` rows reach the driver.
    """
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    share, of = labelled.agg(F.avg((F.col(label_col) == 1).cast("double")), F.count(F.lit(1))).first()
    target = (
        labelled.where(F.col(label_col) == 1).select(F.col(id_col).alias("__id")).distinct()
        .orderBy(F.xxhash64(F.lit(seed), F.col("__id")), "__id").limit(target_documents)
    )
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    marked = rows.join(F.broadcast(target), F.col("__doc") == F.col("__id"), "left")  # bounded by target_documents
    marked = marked.select(F.col("__id").isNotNull().alias("target"), F.col("__text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                found = [features(t, bits) for t in part.column(1).to_pylist()]
                good = part.column(0).to_pylist()
                counts[0] += np.bincount(np.concatenate(found), minlength=1 << bits)
                if any(good):
                    counts[1] += np.bincount(np.concatenate([f for f, g in zip(found, good) if g]), minlength=1 << bits)
        buckets = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(counts[0][buckets]), pa.array(counts[1][buckets])], names=["bucket", "raw", "good"])
        release()

    summed = marked.mapInArrow(count, "bucket bigint, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    totals = np.zeros((2, 1 << bits))
    for row in summed.collect():  # 2**bits rows at most
        totals[:, row["bucket"]] = row["raw"], row["good"]
    if share is None or not totals[1].any():
        return QualityModel(np.zeros(1 << bits), 1.0)
    raw, good = (np.log((t / t.sum() + UNIFORM / len(t)) / (1 + UNIFORM)) for t in totals)
    # Few labels leave the share open; its standard error goes to the documents' favour.
    return QualityModel(good - raw, min(1.0, share + math.sqrt(share * (1 - share) / of)))


def gumbel(id_col: str, text_col: str, seed: int) -> Column:
    """Standard Gumbel noise, fixed by seed, id and text."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("gumbel"), F.col(id_col), F.col(text_col)), 12)
    return -F.log(-F.log((bits.cast("double") + 0.5) / F.lit(2.0**52)))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float | None:
    """The k-th largest value, by histograms that narrow down on it; ``few`` numbers at most reach the driver."""
    if k <= 0:
        return None
    x = F.col(column)
    low, high, left = *values.agg(F.min(x), F.max(x)).first(), k
    while low is not None and low < high:
        inside = values.where(x.between(low, high))
        width = (high - low) / bins
        place = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("a"), F.max(x).alias("b"))
        for row in sorted(found.collect(), key=lambda r: -r["bin"]):
            if row["n"] >= left:
                break
            left -= row["n"]
        low, high = row["a"], row["b"]
        if row["n"] <= few:
            return sorted((r[0] for r in values.where(x.between(low, high)).select(x).collect()), reverse=True)[left - 1]
    return high


def weighted(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """``docs`` with n_features, log_weight and sample_key (weight and noise)."""
    rows = docs.drop("n_features", "log_weight", "sample_key")
    (score,) = unused(rows, "score")
    scored = rows.withColumn(score, model.score(docs, text_col))
    noise = gumbel(id_col, text_col, seed)
    return (
        scored.withColumn("n_features", F.col(f"{score}.n_features"))
        .withColumn("log_weight", F.col(f"{score}.log_weight"))
        .withColumn("sample_key", F.col("log_weight") + noise)
        .drop(score)
    )


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, **options
) -> tuple[QualityModel, DataFrame, float | None]:
    """The model, the stored weights of all documents (id, n_features, log_weight, sample_key), and the smallest key that is kept."""
    model = fit(docs, labels, id_col, text_col, seed=seed, **options)
    path = scratch_path(docs.sparkSession, "weights")
    rows = docs.select(F.col(id_col), F.col(text_col))
    weighted(rows, model, id_col, text_col, seed).drop(text_col).write.parquet(path)
    weights = docs.sparkSession.read.parquet(path)
    return model, weights, kth_largest(weights, "sample_key", round(model.share * weights.count()))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc id, n_features, log_weight, sample_key and kept, a row per document.

    A null text is an empty one with weight 0. Rows equal in id and text share their key; rows tied at the
    smallest kept key are all kept. Without labels all rows are kept. Other columns are not read.
    """
    _, weights, least = resample(docs, labels, **options)
    return weights.withColumn("kept", F.lit(False) if least is None else F.col("sample_key") >= F.lit(least))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, **options) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns; texts are weighed again and not shuffled."""
    model, _, least = resample(docs, labels, id_col, text_col, seed, **options)
    if least is None:
        return docs.where(F.lit(False))
    (score,) = unused(docs, "score")
    scored = docs.withColumn(score, model.score(docs, text_col))
    key = F.col(f"{score}.log_weight") + gumbel(id_col, text_col, seed)
    return scored.where(key >= F.lit(least)).select(*docs.columns)
