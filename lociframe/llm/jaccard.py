"""Set-similarity join of documents on word n-grams: rare-first prefix filtering, then one verification a pair.

The global order of n-grams is (bound of the corpus count, hash), the bound being the lesser of the
count of the n-gram's bucket and that of its rarest word's. Any fixed total order makes prefix filtering
exact; counts put rare n-grams first, so common passages stay out of prefixes. Counts live in a sketch of
fixed size, gathered over all documents.

Documents with equal sets are one class from the start. Within an n-gram's list of classes the pairs are
not all emitted: first each class is paired with the list's pivot (the class whose prefix has the fewest
rarer n-grams, in a group of near copies the one nearest to the original); classes that verified links
connect need no further test among themselves. What the rounds leave unconnected is then paired
exhaustively, under the length and positional filters, so components are exact.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, likely, materialise, merged_sketch, mix, rolling, spread_join, strings, text_hash, text_or_empty, tidied, word_hashes
from .components import connected_components

#: Counters of either frequency sketch, of n-grams and of words (16 MB as 64-bit integers), in chunks.
BUCKETS, CHUNK = 1 << 20, 1 << 14
LOW = np.uint64(BUCKETS - 1)
#: Parts of a set's signature: how many of its hashes fall in each.
PARTS = 64


def hashed(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a text's words, A-Z lower-cased, and of its n-word shingles; fewer words are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = mix(word_hashes(words))
    n = min(n, len(words))
    return h, mix(rolling(h, n) + np.uint64(n))


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(hashed(text, n)[1])


def signature(s: np.ndarray) -> bytes:
    """How many hashes fall in each of PARTS; two signatures bound the overlap of their sets."""
    return np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS), 65535).astype("<u2").tobytes()


def overlap_bound(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u2").astype(np.int64)
    least = np.minimum(x, y)
    least[least == 65535] = 1 << 40  # a full counter bounds nothing
    return int(least.sum())


def class_of(s: np.ndarray) -> int:
    """The 64-bit name of a set; equal sets are one class."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def required(a, b, num: int, den: int):
    """The least overlap of sets of sizes a and b whose Jaccard similarity is num/den or more."""
    return -((-num * (a + b)) // (num + den))


def prefix_length(size: int, num: int, den: int) -> int:
    return size + (num * size) // -den + 1 if size else 0


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """An upper bound of the overlap of two sorted sets, by halving one and splitting the other at the same place."""
    if not depth or len(a) < 2 or not len(b):
        return min(len(a), len(b))
    m = len(a) // 2
    j = int(np.searchsorted(b, a[m]))
    hit = j < len(b) and b[j] == a[m]
    return suffix_bound(a[:m], b[:j], depth - 1) + hit + suffix_bound(a[m + 1 :], b[j + hit :], depth - 1)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    need = required(len(a), len(b), num, den)
    if suffix_bound(a, b, 2) < need:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def _counted(hashes: list[np.ndarray]) -> np.ndarray:
    return np.bincount((np.concatenate([np.empty(0, np.uint64), *hashes]) & LOW).astype(np.int64), minlength=BUCKETS)


_DOCS = "doc_id bigint, key bigint, class bigint, n_shingles bigint, signature binary, chunk int, counts binary"


def _classes_and_counts(docs: DataFrame, text: str, n: int) -> DataFrame:
    """Rows of two kinds: a document with its class, and at a partition's end its chunks of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * BUCKETS, np.int64)
        for b in batches:
            both = [hashed(t, n) for t in strings(b, "t")]
            found = [np.unique(g) for _, g in both]
            counts[:BUCKETS] += _counted(found)
            counts[BUCKETS:] += _counted([w for w, _ in both])
            none = [None] * len(found)
            yield _batch(column(b, "doc_id"), column(b, "key"), list(map(class_of, found)), list(map(len, found)), list(map(signature, found)), none, none)
        chunks = [(i, counts[i * CHUNK : (i + 1) * CHUNK]) for i in range(2 * BUCKETS // CHUNK)]
        chunks = [(i, zlib.compress(c.tobytes(), 1)) for i, c in chunks if c.any()]
        none = [None] * len(chunks)
        yield _batch(none, none, none, none, none, [i for i, _ in chunks], [c for _, c in chunks])

    def _batch(*cols: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _DOCS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(text).alias("key"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(tidied(run), _DOCS)


def similarity_components(docs: DataFrame, text: str = "text", n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, key, n_shingles, class, group, component_id) for each row of docs; links at Jaccard similarity >= num/den.

    group names what links connect, component_id is the least doc_id in it. Null and empty texts have the empty set and link
    with nothing; rows with a null doc_id link like others and count as the greatest; repeated rows are
    equal sets. Memory: a batch of texts and the sketch in each worker.
    """
    spark = docs.sparkSession
    both = materialise(_classes_and_counts(docs, text, n), "classes")
    rows = both.where("class is not null").select("doc_id", "key", "class", "n_shingles", "signature")
    sketch = np.zeros(2 * BUCKETS, np.int64)
    for chunk, raw in merged_sketch(both.where("chunk is not null").select("chunk", "counts"), "sum"):
        sketch[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(raw), np.int64)
    order = spark.sparkContext.broadcast(zlib.compress(np.minimum(sketch, 2**32 - 1).astype(np.uint32).tobytes(), 1))  # 2 * BUCKETS counters

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = np.frombuffer(zlib.decompress(order.value), np.uint32), set()
        for b in batches:
            grams, classes, sizes, places = [], [], [], []
            for t in strings(b, "t"):
                w, g = hashed(t, n)
                s, at = np.unique(g, return_index=True)
                if not len(s) or (name := class_of(s)) in seen:
                    continue
                seen.add(name)  # a partition's copies are one before the shuffle
                p = prefix_length(len(s), num, den)
                rare = count[BUCKETS:][(w & LOW).astype(np.int64)]
                rare = np.lib.stride_tricks.sliding_window_view(rare, min(n, len(w))).min(axis=1)[at]
                c = np.minimum(count[:BUCKETS][(s & LOW).astype(np.int64)], rare)
                g = s
                if p < len(s):
                    part = np.flatnonzero(c <= np.partition(c, p - 1)[p - 1])
                    c, g = c[part], s[part]
                grams.append(g[np.lexsort((g, c))][:p])
                classes.append(np.full(p, name))
                sizes.append(np.full(p, len(s)))
                places.append(np.arange(p))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))], names=["gram", "class", "size", "place"])

    listed = materialise(docs.select(text_or_empty(text).alias("t")).mapInArrow(tidied(prefixes), "gram bigint, class bigint, size int, place int"), "prefixes")
    pivots = listed.groupBy("gram").agg(F.min(F.struct("place", "size", "class")).alias("pivot"), F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"))
    pivots = materialise(pivots.where("lo <> hi").drop("lo", "hi"), "pivots")
    lists = materialise(spread_join(listed, pivots, ["gram"], ["class"]).drop("n").dropDuplicates(["gram", "class"]), "shared")
    order.unpersist()

    one = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("key").alias("k"))).alias("r"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
    one = materialise(one, "sets")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(text).alias("key"), text_or_empty(text).alias("t"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = zip(*(column(b, c) for c in ("sa", "sb", "xs", "ys")), strict=True)
            hit = pa.array([overlap_bound(p, q) >= required(x, y, num, den) for x, y, p, q in of], pa.bool_())
            yield b.select(["a", "b"]).filter(hit)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, n).tobytes() for t in strings(b, "t")], pa.binary())], names=["class", "grams"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in column(b, c)] for c in ("xg", "yg"))
            hit = pa.array([linked(p, q, num, den) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(hit)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link: first by signatures, then, for the few that are left, by the sets themselves."""
        pairs = pairs.join(one.select(F.col("class").alias("a"), F.col("size").alias("sa"), F.col("signature").alias("xs")), "a")
        pairs = pairs.join(one.select(F.col("class").alias("b"), F.col("size").alias("sb"), F.col("signature").alias("ys")), "b")
        pairs = materialise(pairs.select("a", "b", "sa", "sb", "xs", "ys").mapInArrow(tidied(bounded), "a bigint, b bigint"), "candidates")
        members = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        pick = materialise(members.join(one, "class").select("class", F.col("r.d").alias("d"), F.col("r.k").alias("key")), "members")
        texts = likely(source, pick, "key").withColumnRenamed("key", "k2")
        texts = texts.join(pick, texts.doc_id.eqNullSafe(pick.d) & (texts.k2 == pick.key)).select("class", "t").dropDuplicates(["class"])
        stored = materialise(texts.mapInArrow(tidied(sets), "class bigint, grams binary"), "grams")
        pairs = pairs.join(stored.select(F.col("class").alias("a"), F.col("grams").alias("xg")), "a")
        pairs = pairs.join(stored.select(F.col("class").alias("b"), F.col("grams").alias("yg")), "b")
        return materialise(pairs.select("a", "b", "xg", "yg").mapInArrow(tidied(verify), "a bigint, b bigint"), "links")

    def passing(x: dict, y: dict):
        """The length and positional filters, for columns size and place of either side."""
        total = x["size"] + y["size"]
        need = F.ceil(F.lit(num) * total / F.lit(num + den))
        left = F.least(x["size"] - x["place"], y["size"] - y["place"])
        small, large = F.least(x["size"], y["size"]), F.greatest(x["size"], y["size"])
        return (small * den >= large * num) & (left >= need)

    star = lists.select("class", "size", "place", F.col("pivot.class").alias("pc"), F.col("pivot.size").alias("ps"), F.col("pivot.place").alias("pp")).where("class <> pc")
    star = star.where(passing({"size": F.col("size"), "place": F.col("place")}, {"size": F.col("ps"), "place": F.col("pp")}))
    star = materialise(star.select(F.least("class", "pc").alias("a"), F.greatest("class", "pc").alias("b")).distinct(), "star")
    edges = verified(star)
    own = connected_components(edges).select(F.col("node").alias("class"), "label")
    # Sizes that may link are in one band or in two that follow each other; a little wider, so that rounding loses none.
    band = F.floor(F.log("size") / F.lit(math.log(den / num) * (1 + 1e-9))).cast("int") if num < den else F.col("size")
    labelled = materialise(lists.join(own, "class", "left").select("gram", "class", "size", "place", band.alias("band"), F.coalesce("label", "class").alias("label")), "labelled")

    # Pairs are formed of members of different labels only: what is connected has nothing left to test. The filters
    # depend on size and place alone, so cells of these pass or fail as a whole before their members are paired.
    cells = labelled.select("gram", "band", "label", "size", "place").distinct()
    lower = cells.select("gram", "band", F.col("label").alias("la"), F.col("size").alias("sx"), F.col("place").alias("px"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("next"))
    upper = cells.select("gram", F.col("band").alias("next"), F.col("label").alias("lb"), F.col("size").alias("sy"), F.col("place").alias("py"))
    near = passing({"size": F.col("sx"), "place": F.col("px")}, {"size": F.col("sy"), "place": F.col("py")})
    apart = lower.join(upper, ["gram", "next"]).where("la <> lb and (band <> next or la < lb)").where(near).drop("band", "next")
    x = labelled.select("gram", F.col("label").alias("la"), F.col("size").alias("sx"), F.col("place").alias("px"), F.col("class").alias("x"))
    y = labelled.select("gram", F.col("label").alias("lb"), F.col("size").alias("sy"), F.col("place").alias("py"), F.col("class").alias("y"))
    rest = apart.join(x, ["gram", "la", "sx", "px"]).join(y, ["gram", "lb", "sy", "py"])
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    edges = edges.union(verified(rest.join(star, ["a", "b"], "left_anti")))  # pairs that failed before aren't verified again
    labels = connected_components(edges)

    known = rows.groupBy("class").agg(F.min("doc_id").alias("first"))
    label = labels.join(known, labels.node == known["class"]).select("node", "label", "first")
    least = label.groupBy("label").agg(F.min("first").alias("component"))
    linked_class = label.join(least, "label").select(F.col("node").alias("class"), "component", "label")
    per_class = known.join(linked_class, "class", "left").select("class", F.coalesce("component", "first").alias("component"), F.coalesce("label", "class").alias("group"))
    out = rows.join(per_class, "class")
    empty = F.col("n_shingles") == 0
    return out.select("doc_id", "key", "n_shingles", "class", "group", F.when(empty, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """Of each group of rows that link, directly or through others, the row of the least doc_id; docs' own columns.

    Groups are what links connect, whatever the doc_ids: unrelated rows whose doc_ids are equal or null all
    stay. A null doc_id counts as the greatest; of equal doc_ids in a group the least text hash stays, of rows
    equal in both one. Rows without words (null and empty texts too) all stay. No column name is reserved.
    """
    rows = similarity_components(docs, text, **how)
    d, k = fresh(docs, "_d", "_k")
    words = materialise(rows.where("n_shingles > 0").select("group", F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key").alias("r")), "grouped")
    stay = words.groupBy("group").agg(F.min("r").alias("r")).select(F.col("r.doc_id").alias(d), F.col("r.key").alias(k))
    found = docs.join(stay, docs["doc_id"].cast("bigint").eqNullSafe(stay[d]) & (text_hash(text) == stay[k]))
    if not words.groupBy("r").count().where("count > 1").isEmpty():
        found = found.dropDuplicates([d, k])
    wordless = docs.where(~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike("[^ \\t-\\r]"))
    return found.select([docs[c] for c in docs.columns]).union(wordless)
