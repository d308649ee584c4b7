"""Quality classifier by importance resampling.

Two generative models over hashed word unigrams and bigrams: one of the raw corpus, counted over
all documents, one of the target, counted over the documents labelled good (at most
``target_rows`` of them, those of smallest hash). A document's log weight is the sum of its
features' log ratios, and Gumbel noise seeded by its id turns the k largest keys into a sample
without replacement with those weights. k is the share of good labels among all labels, of all
documents.

Null and empty texts have no features and a log weight of 0. Rows that repeat a document have its
key each and are taken in order of doc_id; ties of both count as one place after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chaptermill.llm.common import written
from chaptermill.llm.hashing import WordHasher, runs, text_chunks

BUCKETS = 1 << 14
#: Bound of the labelled documents that the target model is fitted on.
TARGET_ROWS = 20_000
SEED = 29
#: Rows around the k-th key that one task ranks.
RANKED = 100_000


def _features(hasher: WordHasher, texts: list[bytes]):
    """Bucket and text number of every unigram and bigram."""
    import numpy as np

    words, starts = hasher.words(texts)
    number = np.repeat(np.arange(len(texts)), np.diff(starts))
    pairs = runs(words, 2)
    inside = number[1:] == number[:-1]
    buckets = np.concatenate([words, pairs[inside]]) >> np.uint64(64 - 14)
    return buckets.astype(np.int64), np.concatenate([number, number[1:][inside]])


def feature_counts(docs: DataFrame, flag: str, text: str = "text") -> DataFrame:
    """bucket, raw and target: counts over all rows and over those with a true ``flag``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = WordHasher()
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flags = np.array([bool(x.as_py()) for x in batch.column(batch.schema.get_field_index(flag))], bool)
            for at, texts in text_chunks(batch.column(batch.schema.get_field_index(text))):
                buckets, number = _features(hasher, texts)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[flags[at : at + len(texts)][number]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    each = docs.select(text, flag).mapInArrow(run, "bucket long, raw long, target long")
    return each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_weights(docs: DataFrame, ratios, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_features and log_weight. ``ratios`` is a broadcast of BUCKETS numbers."""
    docs = docs.drop("n_features", "log_weight")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = WordHasher()
        for batch in batches:
            column = batch.schema.get_field_index(text)
            counts, sums = [], []
            for _, texts in text_chunks(batch.column(column)):
                buckets, number = _features(hasher, texts)
                counts.append(np.bincount(number, minlength=len(texts)))
                sums.append(np.bincount(number, weights=ratios.value[buckets], minlength=len(texts)))
            rest = [i for i in range(batch.num_columns) if i != column]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in rest], pa.array(np.concatenate([[], *counts]).astype(np.int64)), pa.array(np.concatenate([[], *sums]))],
                names=[*[batch.schema.names[i] for i in rest], "n_features", "log_weight"],
            )

    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())]))


def _ratios(counts: DataFrame):
    """Log of target share over raw share by bucket, each bucket counted once more than found."""
    import numpy as np

    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for row in counts.collect():  # one row a bucket
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _of_equals(scored: DataFrame, k: int, inside: DataFrame, high: float, low: float, above: int) -> DataFrame:
    """The last step of :func:`top_k` where a great many rows have one key, or as good as: their places are
    counted over ranges of (key, doc_id), so no task holds them all."""
    rank = F.struct(-F.col("key"), F.col("doc_id").isNull(), F.col("doc_id"))
    dealt = written(inside.withColumn("_rank", rank).repartitionByRange("_rank").withColumn("_part", F.spark_partition_id()), "resampling-equals")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_rank")) + F.col("before")
    judged = dealt.join(F.broadcast(before), "_part").withColumn("kept", place <= k - above).drop("_rank", "_part", "n", "before")
    return judged.unionByName(scored.filter(F.col("key") > high).withColumn("kept", F.lit(True))).unionByName(scored.filter(F.col("key") < low).withColumn("kept", F.lit(False)))


def top_k(scored: DataFrame, k: int, ranked: int = RANKED) -> DataFrame:
    """``scored`` (doc_id, key) with kept: the k rows of largest key, the lower doc_id first among equals, and rows
    without one last.

    A quantile sketch brackets the k-th key; rows above the bracket are kept, those below not. While more
    than ``ranked`` rows lie inside, a sketch of these alone narrows the bracket, each time to about 1
    in 2,500; only what is left is ranked.
    """
    n = scored.count()
    if k <= 0 or k >= n:
        return scored.withColumn("kept", F.lit(k > 0))
    accuracy = 10_000
    inside, left, low, high, above = scored, n, None, None, 0
    while left > ranked or low is None:
        middle = 1 - (k - above) / left
        ends = inside.select(F.percentile_approx("key", [max(0.0, middle - 2 / accuracy), min(1.0, middle + 2 / accuracy)], accuracy)).first()[0]
        if ends == [low, high]:
            return _of_equals(scored, k, inside, high, low, above)
        low, high = ends
        above += inside.filter(F.col("key") > high).count()
        inside = inside.filter(F.col("key").between(low, high))
        left = inside.count()
    place = Window.orderBy(F.desc("key"), F.asc_nulls_last("doc_id"))
    inside = inside.withColumn("kept", F.row_number().over(place) <= k - above)
    return inside.unionByName(scored.filter(F.col("key") > high).withColumn("kept", F.lit(True))).unionByName(scored.filter(F.col("key") < low).withColumn("kept", F.lit(False)))


def resample(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_weight, key and kept of every document. ``labels``: doc_id, good (0 or 1)."""
    spark = docs.sparkSession
    judged = labels.filter("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good"))
    share = judged.agg(F.avg("good")).first()[0]
    chosen = judged.filter("good = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).select("doc_id", F.lit(True).alias("_target"))
    # At most target_rows ids.
    flagged = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left")
    ratios = spark.sparkContext.broadcast(_ratios(feature_counts(flagged, "_target")))
    weighed = log_weights(docs.select("doc_id", "text"), ratios)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 12) + 0.5) / F.lit(float(1 << 52))  # below 1, exactly
    scored = written(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "resampling-keys")
    return top_k(scored, round(scored.count() * (1.0 if share is None else share)))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(docs, labels.select("doc_id", F.col("quality").alias("good")))
