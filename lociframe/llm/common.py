"""What the text operators share: row keys, scratch tables in the shared folder, Arrow plumbing and word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Rows in an Arrow batch; documents are a few kilobytes each, so a batch stays at some megabytes.
BATCH_ROWS = 500


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, so that their workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = f"{tempfile.mkdtemp(prefix='lociframe-')}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> None:
    """What a session needs before operators run in it: the package at its executors, and Arrow batches of some megabytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_hash(col: str = "text") -> Column:
    """With doc_id, the key of a row: only rows equal in both share it, and these get equal results."""
    return F.xxhash64(text_or_empty(col))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs on this machine alone."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            base = tempfile.mkdtemp(prefix="lociframe-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it (in any case): for columns that pass through with df's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(name: str, value: str, body: str) -> str:
    """SQL for body with a name for the value, which is then computed once a row, in nested lambdas too."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], by: list[str], n: str = "n", least: int = 20_000, most: int = 1_000) -> DataFrame:
    """rows joined with groups, one row for each value of keys, whose column n says how many rows have it.

    A key of more than `least` rows and more than one in `most` of all is dealt to several tasks by a hash of the
    columns `by`, and its group's row goes to each; there are fewer than `most` such keys, so they are broadcast.
    """
    total, top = groups.agg(F.sum(n), F.max(n)).first()
    limit = max(least, (total or 0) // most)
    if (top or 0) <= limit:
        return rows.join(groups, keys)
    hot = F.broadcast(groups.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("_parts")))
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("_parts"))).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    to = groups.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(to, [*keys, "_part"]).drop("_part")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, so lost executors cost one task each."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lociframe/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes; wraps around."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes of all runs of k items, built by doubling: log k passes instead of k."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    done, have, part, size, bits = None, 0, h, 1, k
    while bits:
        if bits & 1:
            if done is None:
                done, have = part, size
            else:
                n = len(h) - have - size + 1
                done = done[:n] * np.uint64(pow(base, size, 1 << 64)) + part[have : have + n]
                have += size
        bits >>= 1
        if bits:
            n = len(part) - size
            part = part[:n] * np.uint64(pow(base, size, 1 << 64)) + part[size : size + n]
            size *= 2
    return done


def window_argmin_right(v: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of its minimum, the rightmost of equal ones."""
    n = len(v) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, size = np.arange(len(v)), 1
    while size < w:
        step = min(size, w - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(v[right] <= v[left], right, left)
        size += step
    return best


def signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: What workers remember between tasks: by owner, how to forget it.
CACHES: dict[str, Callable[[], None]] = {}


def tidy() -> None:
    """Forget what other operators remembered, and return free memory to the system."""
    for forget in CACHES.values():
        forget()
    trim()


def trim() -> None:
    """Return free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable, owner: str | None = None) -> Callable:
    """run, after which the worker is tidied; an operator that owns a cache goes on with it and only returns memory."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy() if owner is None else trim()

    return inner


def merged_sketch(partials: DataFrame, combine: str) -> list[tuple[int, bytes]]:
    """Combine partial sketches (chunk int, counts binary of int64) over all partitions, in two levels.

    The first level folds partitions k*k to (k+1)*(k+1) together, so no group has more rows than about
    twice the square root of the partitions; the result has the sketch's fixed size, whatever the corpus.
    """

    def fold(table: pa.Table) -> pa.Table:
        total = None
        for raw in table.column("counts").to_pylist():
            one = np.frombuffer(zlib.decompress(raw), np.int64)
            total = one.copy() if total is None else (total + one if combine == "sum" else total | one)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    level = partials.withColumn("salt", F.floor(F.sqrt(F.spark_partition_id())))
    level = level.groupBy("chunk", "salt").applyInArrow(fold, "chunk int, counts binary")
    return [(r.chunk, r.counts) for r in level.groupBy("chunk").applyInArrow(fold, "chunk int, counts binary").collect()]


def likely(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = 1 << 27) -> DataFrame:
    """rows without most of those whose 64-bit key isn't in keys, by a Bloom filter, before a join on the key.

    The filter has 16 bits a key and at most `most_bits` (16 MB); beyond that it lets more rows pass, and
    the join that follows drops them as well. So its size is bounded and the result never depends on it.
    """
    bits = 1 << 16
    n = keys.count()
    while bits < min(16 * n, most_bits):
        bits *= 2

    def places(h: np.ndarray) -> list[np.ndarray]:
        h = mix(h.view(np.uint64))
        return [(x & np.uint64(bits - 1)).astype(np.int64) for x in (h, h >> np.uint64(32), mix(h))]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(bits, bool)
        for b in batches:
            h = np.array(column(b, key), np.int64)
            for p in places(h):
                full[p] = True
        words = np.packbits(full).view(np.int64)
        step = 1 << 13
        parts = [(i, words[i * step : (i + 1) * step]) for i in range(-(-len(words) // step))]
        parts = [(i, zlib.compress(w.tobytes(), 1)) for i, w in parts if w.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([w for _, w in parts], pa.binary())], names=["chunk", "counts"])

    words = np.zeros(bits // 64, np.int64)
    for i, raw in merged_sketch(keys.select(key).mapInArrow(tidied(build), "chunk int, counts binary"), "or"):
        one = np.frombuffer(zlib.decompress(raw), np.int64)
        words[i << 13 : (i << 13) + len(one)] = one
    sent = rows.sparkSession.sparkContext.broadcast(words.view(np.uint8))

    @F.arrow_udf("boolean")
    def passes(k: pa.Array) -> pa.Array:
        h = k.to_numpy(zero_copy_only=False).astype(np.int64)
        ok = np.ones(len(h), bool)
        for p in places(h):
            ok &= (sent.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return pa.array(ok)

    return rows.where(passes(key))
