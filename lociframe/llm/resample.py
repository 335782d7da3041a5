"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The target model counts the hashed word uni- and bigrams of the labelled good documents, the raw model
those of all documents. A document's weight is the log ratio of its probability under either model; with
Gumbel noise added, the k highest keys are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, likely, materialise, merged_sketch, mix, strings, text_hash, text_or_empty, tidied, word_hashes

#: Hash buckets for unigrams, and as many for bigrams; counts for target and raw.
BUCKETS, CHUNK = 1 << 16, 1 << 13
#: Added to each bucket's count, in parts of a mean bucket.
SMOOTHING = 0.05
#: Bins of one pass of the selection of the k-th highest key.
BINS = 1024


def buckets(text: str) -> np.ndarray:
    """The buckets of a text's lower-cased words (0 to BUCKETS) and word pairs (after those)."""
    h = mix(word_hashes(text.lower().encode().split()))
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    m = np.uint64(BUCKETS - 1)
    return np.concatenate([h & m, (pairs & m) + np.uint64(BUCKETS)]).astype(np.int64)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, unigrams and bigrams normalised apart."""
    out = []
    for t, r in zip(np.split(target.astype(float), 2), np.split(raw.astype(float), 2), strict=True):
        t, r = (x + SMOOTHING * max(x.sum(), 1.0) / BUCKETS for x in (t, r))
        out.append(np.log(t / t.sum()) - np.log(r / r.sum()))
    return np.concatenate(out)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, text: str = "text", seed: int = 42) -> DataFrame:
    """(doc_id, key, n_words, log_weight, gumbel_key, kept) for each row of docs; kept: among the k highest keys.

    k is `share` of the rows, by default the labelled rows' share of good ones (quality 1, toxic 0). Noise
    comes from a hash of doc_id, text and seed, so runs and retries agree. Null and empty texts have weight
    0 and are never kept; repeated rows have equal keys, and ties at the k-th key are all kept, so more
    than k are where rows repeat. Without labelled good rows the target is the raw text, and sampling uniform.
    """
    spark = docs.sparkSession
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(text).alias("key"), text_or_empty(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(np.concatenate([np.empty(0, np.int64), *map(buckets, strings(b, "t"))]), minlength=2 * BUCKETS)
        parts = [(i, total[i * CHUNK : (i + 1) * CHUNK]) for i in range(len(total) // CHUNK)]
        parts = [(i, zlib.compress(c.tobytes(), 1)) for i, c in parts if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=["chunk", "counts"])

    def counted(texts: DataFrame) -> np.ndarray:
        counts = np.zeros(2 * BUCKETS, np.int64)
        for i, raw in merged_sketch(texts.mapInArrow(tidied(count), "chunk int, counts binary"), "sum"):
            counts[i * CHUNK : (i + 1) * CHUNK] = np.frombuffer(zlib.decompress(raw), np.int64)
        return counts

    all_text = counted(rows.select("t"))
    target = counted(likely(rows.where("doc_id is not null"), good, "doc_id").join(good, "doc_id", "left_semi").select("t"))
    model = spark.sparkContext.broadcast(log_ratios(target if target.any() else all_text, all_text).astype(np.float32))  # 0.5 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for b in batches:
            found = [buckets(t) for t in strings(b, "t")]
            weight = [float(ratio[x].sum(dtype=np.float64)) for x in found]
            n = [(len(x) + 1) // 2 for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(column(b, "doc_id"), pa.int64()), pa.array(column(b, "key"), pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.float64())], names=["doc_id", "key", "n_words", "log_weight"])

    scored = rows.mapInArrow(tidied(score), "doc_id bigint, key bigint, n_words bigint, log_weight double")
    uniform = (F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    scored = materialise(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    if share is None:
        n = labels.agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("g")).first()
        share = n.g / n.n if n.n else 1.0
    real = scored.where("n_words > 0")
    cut = kth_highest(real, "gumbel_key", round(share * real.count()))
    return scored.withColumn("kept", (F.col("n_words") > 0) & (F.col("gumbel_key") >= F.lit(cut)))


def kth_highest(df: DataFrame, key: str, k: int) -> float:
    """The k-th highest value of a column, by passes that count it in bins; exact, whatever k is."""
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return lo
    while hi > lo:
        width = (hi - lo) / BINS
        if width <= 0 or lo + width <= lo:
            break
        inside = df.where(F.col(key).between(lo, hi))
        bin_of = F.least(F.floor((F.col(key) - lo) / width), F.lit(BINS - 1))
        hist = {r.b: r for r in inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for b in sorted(hist, reverse=True):
            if k <= hist[b].n:
                if (hist[b].lo, hist[b].hi) == (lo, hi):
                    return _kth_distinct(inside, key, k)
                lo, hi = hist[b].lo, hist[b].hi
                break
            k -= hist[b].n
    return hi


def _kth_distinct(df: DataFrame, key: str, k: int) -> float:
    """For values too close for bins: the few that are left, counted one by one."""
    for r in df.groupBy(key).count().orderBy(F.desc(key)).toLocalIterator():
        if k <= r["count"]:
            return r[key]
        k -= r["count"]
    raise ValueError("k exceeds the rows")
