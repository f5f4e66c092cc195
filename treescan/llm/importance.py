"""Quality classifier by importance resampling.

Texts become counts of hashed words and word pairs. Two generative models, smoothed distributions over the buckets, are
taken from target text (labelled of high quality; a bounded sample) and from raw text (all documents). The logarithm of
a text's weight is its log probability under the first less that under the second. Gumbel noise from the hash of id and
text turns the top k of weight and noise into a sample without replacement, in proportion to the weights.

Exactly k rows are kept (all where there are fewer). The k-th largest key is found by counting leading bits of the keys,
16 a round, over the written table of keys; of rows with that very key those written first are kept, found in the same
way by their number in the table. Null and empty texts have weight 1 (logarithm 0). Rows that repeat id and text share
their noise, and so their key. Without target texts all weights are 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treescan.llm.common import LOWER, chunks, free_name, materialize, small_batches, word_hashes

BUCKETS = 1 << 16


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of UTF-8 texts, and the text that each comes from."""
    words = [t.translate(LOWER).split() for t in texts]
    flat = pa.array([w for x in words for w in x], pa.large_binary())
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = flat.dictionary_encode()
    h = word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(words)), [len(x) for x in words])
    both = doc[1:] == doc[:-1]
    pair = (h[:-1][both] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:][both] * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.concatenate([h >> np.uint64(48), pair >> np.uint64(48)]).astype(np.int64), np.concatenate([doc, doc[1:][both]])


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(target, text) to (bucket, raw, target): one row for each bucket of a task."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1).fill_null("").cast(pa.binary()).to_pylist()
        for lo, hi in chunks(texts):
            bucket, doc = features(texts[lo:hi])
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[own[lo:hi][doc]], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_target: int = 20_000, smoothing: float = 1.0) -> np.ndarray:
    """log of target over raw probability for each bucket. Target texts are those of the at most max_target labelled ids
    of high quality with the smallest hash; raw counts are of all documents."""
    few = labels.where(F.col("quality") == 1).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_target).withColumn("_target", F.lit(True))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id", "left").select(F.coalesce("_target", F.lit(False)).alias("target"), F.col("_text").alias("text"))
    got = rows.mapInArrow(bucket_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    raw[got["bucket"]] += got["raw"]
    target[got["bucket"]] += got["target"]
    if not len(got) or not got["target"].sum():
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(key: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    return -F.ln(-F.ln(u))


@F.arrow_udf(T.LongType())
def ordered_bits(key: pa.Array) -> pa.Array:
    """Whole numbers in the order of doubles, one for each double (0.0 for -0.0)."""
    bits = (key.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


def nth_largest(rows: DataFrame, name: str, k: int) -> tuple[int, int]:
    """The k-th largest whole number of a column (k from 1 to the number of rows), and how many of the rows with it are
    among the k largest. 16 bits a round, so that at most 65,536 counts come to the driver in each."""
    low, shift = None, 48
    while True:
        part = rows if low is None else rows.where(F.shiftright(name, shift + 16) == low)
        counts = sorted(((r["p"], r["count"]) for r in part.groupBy(F.shiftright(name, shift).alias("p")).count().collect()), reverse=True)
        for p, c in counts:
            if k <= c:
                low = p
                break
            k -= c
        if not shift:
            return low, k
        shift -= 16


def among_largest(rows: DataFrame, bits: str, number: str, k: int) -> Column:
    """Whether a row is one of the k with the largest bits, the smallest numbers first among equals; numbers are unique."""
    n = rows.count()
    if k <= 0 or not n:
        return F.lit(False)
    if k >= n:
        return F.lit(True)
    least, of_these = nth_largest(rows, bits, k)
    last, _ = nth_largest(rows.where(F.col(bits) == least).select((-F.col(number)).alias(number)), number, of_these)
    return (F.col(bits) > least) | ((F.col(bits) == least) & (F.col(number) <= -last))


def resample(docs: DataFrame, labels: DataFrame, *, share: float | None = None, k: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", max_target: int = 20_000, keep: list[str] | None = None) -> DataFrame:
    """docs (or their columns ``keep``) with a struct column ``importance`` (or a free name; the last column):
    log_weight, key and kept. Sampled are k rows, or ``share`` of all rows; without either, the share of labelled rows
    that are of high quality."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    ratios = sc.broadcast(log_ratios(docs, labels, id_col=id_col, text_col=text_col, max_target=max_target))

    def weigh(text: pa.Array) -> pa.Array:
        texts, out = text.fill_null("").cast(pa.binary()).to_pylist(), []
        for lo, hi in chunks(texts):
            bucket, doc = features(texts[lo:hi])
            out.append(np.bincount(doc, weights=ratios.value[bucket], minlength=hi - lo))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    name, weight = free_name(docs, "importance"), "_weight"
    while any(c.lower().startswith(weight) for c in docs.columns):
        weight += "_"
    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    rows = docs.select(*columns, F.arrow_udf(weigh, T.DoubleType())(F.col(text_col)).alias(weight), gumbel(F.xxhash64(id_col, text_col), seed).alias(weight + "g"))
    rows = rows.withColumn(weight + "k", F.col(weight) + F.col(weight + "g")).withColumn(weight + "b", ordered_bits(weight + "k"))
    rows = materialize(rows.withColumn(weight + "n", F.monotonically_increasing_id()), "weights")
    if k is None:
        if share is None:
            good = labels.where("quality in (0, 1)").agg(F.avg("quality")).first()[0]
            share = 1.0 if good is None else good
        k = round(rows.count() * share)
    kept = among_largest(rows.select(weight + "b", weight + "n"), weight + "b", weight + "n", k)
    return rows.withColumn(name, F.struct(F.col(weight).alias("log_weight"), F.col(weight + "k").alias("key"), kept.alias("kept"))).drop(*[weight + c for c in ("", "g", "k", "b", "n")])
