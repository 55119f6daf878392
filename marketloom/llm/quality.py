"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are estimated, one from target text (labelled good documents) and one from
all raw text; a document's importance weight is the ratio of its probabilities under the two. Documents are sampled
without replacement by Gumbel top-k: log weight / temperature plus Gumbel noise, the k largest stay. k is the number of
documents whose weight reaches the cut that best separates the labelled good from the labelled bad.

The n-grams are words, pairs of words and pairs of word shapes (letter case, digits, signs; a repeated word is a sign of
its own). Counting and scoring are scans: each task counts into a fixed number of buckets, only those counts are
shuffled, and the log ratios (one number per bucket) go back to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.tables import filled, settled, table
from marketloom.llm.texthash import chunks, lowered, mixed, runs, word_bounds

BUCKETS = 1 << 14
SMOOTHING = 50.0  # n-grams added to either model's count of a bucket, the raw model scaled to the target's size
TEMPERATURE = 0.1  # noise counts for documents near the cut only
LABELLED = 20_000  # at most so many good and so many bad labelled documents fit the target model and the cut
KEY_SCALE = 1 << 20  # keys are compared as integers of this resolution
BINS = 4096
SEED = 17


def _shapes():
    """Byte classes of a word's shape: capitals, letters (all beyond ASCII), digits, and every other byte as itself."""
    import numpy as np

    shape = np.arange(256, dtype=np.uint64) + np.uint64(1)
    shape[65:91], shape[97:123], shape[128:], shape[48:58] = 66, 98, 98, 49
    return shape


def hashed_ngrams(texts: list[bytes]):
    """Document numbers and buckets of all n-grams of ``texts``."""
    import numpy as np

    data, doc, starts, ends = word_bounds(texts)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    words = runs(lowered()[data], starts, ends)
    kind = _shapes()[data]
    new = np.ones(len(data), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    before = np.concatenate([[0], np.cumsum(new)])
    shapes = runs(kind[new], before[starts], before[ends])
    first = np.ones(len(doc), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    previous, previous_shape = np.roll(words, 1), np.roll(shapes, 1)
    previous[first], previous_shape[first] = 1, 1
    again = previous == words
    salt = [np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xCBBB9D5DC1059ED8)]
    pairs = mixed(previous * salt[0] + words)
    pairs[again] = salt[1]
    shaped = mixed(previous_shape * salt[1] + shapes * np.uint64(3) + again.astype(np.uint64)) ^ salt[2]
    grams = np.concatenate([words, pairs, shaped])
    return np.concatenate([doc, doc, doc]), (mixed(grams) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def log_weights(texts: list[str], ratios):
    """Sum of the log ratios of each text's n-grams, and their number."""
    import numpy as np

    weights, sizes = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for first, chunk in chunks(texts):
        doc, bucket = hashed_ngrams(chunk)
        weights[first:first + len(chunk)] = np.bincount(doc, weights=ratios[bucket], minlength=len(chunk))
        sizes[first:first + len(chunk)] = np.bincount(doc, minlength=len(chunk))
    return weights, sizes


@dataclass(frozen=True)
class Model:
    """Log ratios by bucket, and the cut on the log weight (minus infinity: nothing is rejected)."""

    ratios: object
    cut: float


def log_ratios(raw, target):
    """log P(bucket | target) - log P(bucket | raw). Both models get the same smoothing, so a bucket that few n-grams hit in
    either says little; without target text all ratios are zero."""
    import numpy as np

    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log(target + SMOOTHING) - np.log(expected + SMOOTHING)


def ngram_counts(docs: DataFrame, target_ids: list[int], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket, raw, target``: n-grams of all documents, and of those whose key is in ``target_ids``."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        wanted = pa.array(sorted(target_ids), pa.int64())
        for batch in batches:
            good = pc.is_in(batch.column(0), value_set=wanted).to_numpy(zero_copy_only=False)
            for first, chunk in chunks(batch.column(1).to_pylist()):
                doc, bucket = hashed_ngrams(chunk)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[first:first + len(chunk)][doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (some, raw[some], target[some])], names=["bucket", "raw", "target"])

    read = docs.select(F.col(key).cast("bigint").alias("key"), filled(text).alias("text"))
    parts = read.mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def scores(docs: DataFrame, ratios, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_grams, log_weight``, one row per document."""

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            weights, sizes = log_weights(batch.column(1).to_pylist(), ratios)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())], names=["key", "n_grams", "log_weight"])

    return docs.select(F.col(key).cast("bigint").alias("key"), filled(text).alias("text")).mapInArrow(
        score, "key bigint, n_grams bigint, log_weight double")


def gumbel_key(weight: Column, key: Column) -> Column:
    """Integer sampling key: log weight / temperature plus noise that is fixed by the document's key."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(SEED)), 12).cast("double") + 0.5) / float(1 << 52)
    noisy = weight / TEMPERATURE - F.log(-F.log(uniform))
    return F.floor(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), noisy)) * KEY_SCALE)


def kth_largest(df: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of an integer column, by counts over ever finer bins (at most ``BINS`` rows each)."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = -(-(high - low + 1) // BINS)
        inside = df.where(F.col(column).between(low, high))
        bins = inside.groupBy(F.expr(f"({column} - ({low}L)) div {width}L").alias("bin")).count().collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if row["count"] >= k:
                low, high = low + row["bin"] * width, min(high, low + row["bin"] * width + width - 1)
                break
            k -= row["count"]
    return low


def _best_cut(good, bad) -> float:
    """The weight from which on keeping errs least on labelled documents."""
    import numpy as np

    if not len(good) or not len(bad):
        return -math.inf
    values = np.concatenate([good, bad])
    order = np.argsort(values, kind="stable")
    gain = np.concatenate([np.full(len(good), -1), np.full(len(bad), 1)])[order]
    kept_from = np.concatenate([[0], np.cumsum(gain)])  # gain of dropping the i lowest
    i = int(np.argmax(kept_from))
    return -math.inf if i == 0 else float(values[order][i - 1] + (values[order][min(i, len(values) - 1)] - values[order][i - 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """Model and scores of ``docs``. ``labels`` has ``doc_id`` and ``quality``; rows with nulls there say nothing."""
    import numpy as np

    def drawn(quality: int) -> list[int]:
        some = labels.where(F.col("quality") == quality).select(F.col("doc_id").cast("bigint").alias("k")).where("k IS NOT NULL").distinct()
        return [r["k"] for r in some.orderBy(F.xxhash64("k", F.lit(SEED)), "k").limit(LABELLED).collect()]

    good, bad = drawn(1), drawn(0)
    counts = ngram_counts(docs, good, key=key, text=text).collect()  # at most BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    ratios = log_ratios(raw, target)
    scored = settled(scores(docs, ratios, key=key, text=text), "quality-scores")
    ids = docs.sparkSession.createDataFrame([(k, q) for q, some in ((1, good), (0, bad)) for k in some], "key bigint, quality int")
    # one row for each labelled key, however often it occurs: 2 * LABELLED rows at most
    known = scored.join(F.broadcast(ids), "key").groupBy("key", "quality").agg(F.min("log_weight").alias("log_weight")).toPandas()
    cut = _best_cut(known.log_weight[known.quality == 1].to_numpy(), known.log_weight[known.quality == 0].to_numpy())
    return Model(ratios, cut), scored


def sampled(scored: DataFrame, model: Model) -> tuple[DataFrame, int | None]:
    """Scores with ``sample_key``, and the least key that stays (None: all stay). Keys equal to it stay as well."""
    keyed = scored.withColumn("sample_key", gumbel_key(F.col("log_weight"), F.col("key")))
    k = scored.where(F.col("log_weight") >= model.cut).count()
    if model.cut == -math.inf or not k:
        return keyed, None
    return keyed, kth_largest(keyed, "sample_key", k)


def judged(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row per document: ``key, n_grams, log_weight, sample_key, kept``.

    A text without words (null, empty, white space) has weight 0 like one of which nothing is known. Repeated rows get the
    same key and verdict. Without good and bad labels, or in an empty table, nothing is rejected.
    """
    model, scored = fit(docs, labels, **columns)
    keyed, least = sampled(scored, model)
    return keyed.withColumn("kept", F.lit(True) if least is None else F.col("sample_key") >= least)


def kept_rows(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: the weight is computed again where the row is, so texts do not move."""
    model, scored = fit(docs, labels, key=key, text=text)
    _, least = sampled(scored, model)
    if least is None:
        return docs
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), filled(text).alias("text"), F.col(key).cast("bigint").alias("key"))

    def weigh(texts):
        import pandas as pd

        return pd.Series(log_weights(texts.tolist(), model.ratios)[0])

    weight = F.pandas_udf(weigh, "double")
    scored_rows = held.withColumn("log_weight", weight("text"))
    return scored_rows.where(gumbel_key(F.col("log_weight"), F.col("key")) >= least).select("row.*")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("key", "doc_id")
