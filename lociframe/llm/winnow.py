"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of each window, rightmost of equal ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import column, mix, rolling, strings, text_hash, text_or_empty, tidied, window_argmin_right

#: Code points in a gram, grams in a window: any shared passage of K + W - 1 = 51 code points shares a selected gram.
K, W = 20, 32


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 64-bit hashes) that winnowing selects; shorter texts have one gram, the empty text none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = mix(rolling(points + np.uint64(1), min(k, len(points))))
    at = window_argmin_right(grams, min(w, len(grams)))
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    return at[keep], grams[at[keep]]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' sets of hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def printed(at: np.ndarray, hashes: np.ndarray) -> str:
    """position:hash pairs, the hash's upper 32 bits in hexadecimal."""
    return " ".join(f"{p}:{h:08x}" for p, h in zip(at.tolist(), (hashes >> np.uint64(32)).tolist(), strict=True))


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Every row of docs with positions array<long> and hashes array<long>; a null text counts as empty.

    No shuffle: rows are independent, and memory is bounded by a batch of texts.
    """
    kept = [f for f in docs.schema.fieldNames() if f not in ("fp_positions", "fp_hashes")]
    schema = docs.select(*kept).schema.add("fp_positions", ArrayType(LongType())).add("fp_hashes", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t, k, w) for t in strings(b, text)]
            cols = [*b.columns, pa.array([p.tolist() for p, _ in prints], pa.list_(pa.int64())), pa.array([h.view(np.int64).tolist() for _, h in prints], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "fp_positions", "fp_hashes"])

    return docs.select(*kept).mapInArrow(tidied(run), schema)


EDITS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text, of its edited form, and their likeness to each other and to the next document.

    The next document is the one with the next lower doc_id (the highest after the lowest). Rows are
    dealt into ranges of doc_id; the first row of each range also goes to the range before it, so that
    each range is read once, in order, and texts are shuffled once. A partition keeps one row at a time.
    Null doc_ids come last and return null; rows with equal doc_id follow by their text's hash; equal
    rows follow each other. A single row is its own next document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    low = -(2**63)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(low)).alias("ord"), text_or_empty().alias("text"), text_hash().alias("tie"))
    n = max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(x) for x in rows.select("ord").approxQuantile("ord", [i / n for i in range(1, n)], 0.2 / n)})
    cuts = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(ord_: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ord_.to_numpy(np.int64)).astype(np.int32))

    # Range r holds ord in (cuts[r - 1], cuts[r]]; the ranges run downwards.
    rows = rows.withColumn("range", range_of("ord"))
    heads = {r["range"]: (r["h"]["ord"], r["h"]["tie"]) for r in rows.groupBy("range").agg(F.max(F.struct("ord", "tie")).alias("h")).collect()}  # one row a range
    if not heads:
        return spark.createDataFrame([], EDITS)
    order = sorted(heads, reverse=True)
    before = {heads[r]: order[i - 1] for i, r in enumerate(order)}

    @F.pandas_udf("int")
    def also_to(ord_: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series([before.get(x, -1) for x in zip(ord_.tolist(), tie.tolist(), strict=True)], dtype=np.int32)

    rows = rows.withColumn("to", also_to("ord", "tie"))
    own = F.struct(F.col("range").alias("part"), F.lit(0).alias("extra"))
    dealt = rows.withColumn("go", F.explode(F.when(F.col("to") >= 0, F.array(own, F.struct(F.col("to").alias("part"), F.lit(1).alias("extra")))).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "ord", "text", "tie", F.col("go.part").alias("part"), F.col("go.extra").alias("extra"))
    dealt = dealt.repartition(n, "part").sortWithinPartitions(F.desc("part"), "extra", F.desc("ord"), F.desc("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None

        def pair(this: tuple, then: tuple) -> None:
            doc, text, (at, hashes) = this[1:4]
            half = len(text) // 2
            edited = text[: len(text) - half] + then[2][:half]
            e_at, e_hashes = fingerprint(edited, k, w)
            out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(at, hashes), printed(e_at, e_hashes), likeness(hashes, e_hashes), likeness(hashes, then[3][1])))

        for b in batches:
            for part, extra, doc, text in zip(column(b, "part"), column(b, "extra"), column(b, "doc_id"), strings(b, "text"), strict=True):
                if extra and (last is None or last[0] != part or last[4]):
                    continue  # a further copy of the next range's first row
                row = (part, doc, text, fingerprint(text, k, w), extra)
                if last is not None and last[0] == part and not last[4]:
                    pair(last, row)
                last = row
            if len(out) >= 200:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

    return dealt.mapInArrow(tidied(run), EDITS)


NAMES = [x.split()[0] for x in EDITS.split(", ")]
TYPES = [{"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in EDITS.split(", ")]
