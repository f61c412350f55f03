"""Quality selection by importance resampling.

Two generative models of hashed word n-grams (words, punctuation runs and their pairs)
are counted: one over target text (documents labelled as good), one over all raw
documents. A document's log importance is the sum over its n-grams of the log ratio of
the two models. Adding Gumbel noise and taking the k largest samples k documents
without replacement in proportion to importance. k is a share of all documents; unless
given, it is the good ones' share of the labels.

Counts of raw text cover every document. The target model uses at most MAX_TARGET
labelled documents, the first by a hash of their ids. The k-th largest key is found by
histograms of narrowing range, so that no more than a few thousand rows reach the driver.

Defined cases: a null or empty text has log importance 0; noise comes from the md5 of
the id (null: an empty one), so reruns agree; rows whose key equals the last one that is
taken are all kept; without labels or target text every log importance is 0; repeated
rows give repeated results; a text of any length is read whole, one at a time; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavetally.llm.common import kth_largest, stash

BUCKETS = 1 << 14
MAX_TARGET = 20_000
SMOOTHING = 1.0
SEED = "resample-1"
REMEMBERED = 300_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Odd multipliers that mix a pair's hashes.
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

WEIGHED = "doc_id bigint, n_grams bigint, log_importance double"


class _Hashes(dict):
    def __missing__(self, chunk: str) -> tuple[int, ...]:
        import xxhash

        found = tuple(xxhash.xxh64_intdigest(t.encode()) for t in _TOKEN.findall(chunk))
        if len(self) < REMEMBERED:
            self[chunk] = found
        return found


def grams(text: str | None, hashes: _Hashes, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's words and pairs of neighbours."""
    flat = [h for chunk in map(hashes.__getitem__, (text or "").lower().split()) for h in chunk]
    one = np.array(flat, dtype=np.uint64)
    two = one[:-1] * _LEFT + (one[1:] ^ (one[1:] >> np.uint64(31))) * _RIGHT
    return np.concatenate([one * _LEFT, two]) >> np.uint64(64 - (buckets.bit_length() - 1))


def _counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    hashes, counts = _Hashes(), np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            counts += np.bincount(grams(text.as_py(), hashes, buckets).astype(np.int64), minlength=buckets)
    at = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])


def _model(texts: DataFrame, buckets: int) -> np.ndarray:
    """Log probability of each bucket."""
    parts = texts.select("text").mapInArrow(partial(_counts, buckets=buckets), "bucket int, n bigint")
    counts = np.zeros(buckets)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row per bucket
        counts[row["bucket"]] = row["n"]
    return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * buckets)), counts.sum()


def _weighed(batches: Iterator[pa.RecordBatch], ratios) -> Iterator[pa.RecordBatch]:
    hashes, ratio = _Hashes(), ratios.value
    for batch in batches:
        own = [grams(text.as_py(), hashes, len(ratio)).astype(np.int64) for text in batch.column(1)]
        yield pa.record_batch(
            [batch.column(0), pa.array([len(g) for g in own], pa.int64()), pa.array([float(ratio[g].sum()) for g in own], pa.float64())],
            names=["doc_id", "n_grams", "log_importance"],
        )


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return -F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, max_target: int = MAX_TARGET, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_grams, log_importance, key, kept for every row. labels: doc_id, quality (1: target)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if share is None:
        share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        share = 1.0 if share is None else share
    sample = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).select("doc_id")
    target, there = _model(docs.join(F.broadcast(sample), "doc_id"), buckets)
    raw, _ = _model(docs, buckets)
    ratios = docs.sparkSession.sparkContext.broadcast(target - raw if there else np.zeros(buckets))
    weighed = docs.select("doc_id", "text").mapInArrow(partial(_weighed, ratios=ratios), WEIGHED)
    weighed = stash(weighed.withColumn("key", F.col("log_importance") + gumbel(F.col("doc_id"))))
    last = kth_largest(weighed, "key", round(share * weighed.count()))
    return weighed.withColumn("kept", F.col("key") >= F.lit(last) if last is not None else F.lit(False))
