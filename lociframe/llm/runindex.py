"""Removal of repeated byte strings by run-length indexes: a run-compressed Burrows-Wheeler transform with sampled run ends.

A window is LENGTH bytes. Where a window stands again, its anchor does too: of the grams of GRAM bytes in it the one of
least hash, the rightmost of equal ones. So strings that could match meet by their anchors, without any pair being formed:

1. Each text is cut into the regions of its anchors: the bytes of all windows that chose one. Anchors that occur once are out,
   and equal regions become one, with their number and the first place. Of any but the first all windows stand earlier.
2. The different regions of an anchor are dealt to buckets of about BUCKET bytes, in which a run-length index is built over
   all regions, in the order of their places. Matching statistics stream over the text from the sampled run ends:
   within a run of the transform the match with the lexical predecessor moves on by one byte and loses one byte of length.
3. Positions whose match is LENGTH or longer share their window with its source; the least place of such a chain stays,
   the others are marked.

An anchor with more than HOT different regions would make one bucket grow with the corpus; its windows are dealt one by one, by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, likely, materialise, mix, rolling, signed, spread_join, text_hash, text_or_empty, tidied

LENGTH, GRAM = 100, 32
#: Bytes of regions in a bucket, and different regions of an anchor that one bucket takes.
BUCKET, HOT = 1 << 20, 4096

_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ANCHOR = pa.struct([("anchor", pa.int64()), ("region", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_PROFILE = "doc_id bigint, key bigint, n_bytes bigint, kept_sha256 string, anchors array<struct<anchor:bigint,region:bigint,first:int,last:int>>"
_SPAN = "doc_id bigint, key bigint, first int, last int"


class RunIndex:
    """A text's Burrows-Wheeler transform as its runs, with the text positions of the first and last row of each run."""

    def __init__(self, text: np.ndarray) -> None:
        """text: small integers; it is read as if a least symbol, found nowhere in it, followed."""
        if not len(text):
            self.n, self.symbol, (self.length, self.first, self.last, self.common) = 0, text, np.empty((4, 0), np.int64)
            return
        rows, ranks = _suffix_order(text)
        before = np.where(rows > 0, text[rows - 1], -1)  # the text's begin is a run of its own
        head = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        last = np.r_[head[1:], len(rows)] - 1
        self.n, self.symbol, self.length = len(text), before[head], last - head + 1
        self.first, self.last = rows[head], rows[last]
        # What a run's first row has in common with the row before it, the last one of the run before.
        self.common = np.r_[0, _common(text, ranks, self.first[1:], self.last[:-1])]

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, source) for each position: its longest match with its predecessor among all suffixes, and where that stands (-1: nowhere).

        Only the first rows of runs have to be looked up: other rows have the symbol of the row before them, so their
        matches are those of the position to the left, moved on by one. Hence one pass in the order of the text.
        """
        if not self.n:
            return self.first, self.first
        order = np.argsort(self.first)
        at = self.first[order]
        source, length = np.r_[-1, self.last[:-1]][order], self.common[order]
        since = np.repeat(np.arange(len(at)), np.diff(np.r_[at, self.n]))
        moved = np.arange(self.n) - at[since]
        return np.maximum(length[since] - moved, 0), np.where(source[since] < 0, -1, source[since] + moved)


def _suffix_order(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffixes of a text that isn't empty in order, ranks by their first h symbols for growing h): prefix doubling from seven symbols that fit a word."""
    n, h = len(text), 7
    wide = np.zeros(n + h, np.int64)
    wide[:n] = text + 1
    key = np.zeros(n, np.int64)
    for i in range(h):
        key = (key << 9) | wide[i : i + n]
    ranks = []
    while True:
        rows = np.argsort(key)
        ordered = key[rows]
        step = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        rank = np.empty(n, np.int64)
        rank[rows] = step
        ranks.append((h, rank))
        if step[-1] == n - 1:
            return rows, ranks
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        h *= 2


def _common(text: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at a and b begin with alike: binary search by the ranks of stretches, then symbol by symbol."""
    n, a, b = len(text), a.copy(), b.copy()
    got = np.zeros(len(a), np.int64)
    for h, rank in reversed(ranks):
        fit = np.flatnonzero((a + h <= n) & (b + h <= n))
        same = fit[rank[a[fit]] == rank[b[fit]]]
        a[same], b[same], got[same] = a[same] + h, b[same] + h, got[same] + h
    for _ in range(ranks[0][0]):
        fit = np.flatnonzero((a < n) & (b < n))
        same = fit[text[a[fit]] == text[b[fit]]]
        if not len(same):
            break
        stop = np.ones(len(a), bool)
        stop[same] = False
        a[same], b[same], got[same] = a[same] + 1, b[same] + 1, got[same] + 1
        a[stop] = n
    return got


def repeated_windows(regions: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, start) of the windows of `length` bytes that also stand earlier, in an earlier region or to the left."""
    size = np.array([len(r) for r in regions], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int16)
    of = np.repeat(np.arange(len(regions)), size + 1)
    at = np.arange(len(text)) - begin[of]
    inside = at < size[of]
    text[inside] = np.frombuffer(b"".join(regions), np.uint8).astype(np.int16) + 1
    matched, source = RunIndex(text).statistics()
    # A window is free of separators, so its source is as well. Chains of sources end at one root for each string.
    window = at + length <= size[of]
    root = np.where(window & (matched >= length), source, np.arange(len(text)))
    while (root[root] != root).any():
        root = root[root]
    least = np.arange(len(text))
    w = np.flatnonzero(window)
    np.minimum.at(least, root[w], w)
    again = w[least[root[w]] < w]
    return of[again], at[again]


def anchored(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, region hash, first window, last window) of each anchor of a text."""
    if len(text) < length:
        return (np.empty(0, np.int64),) * 4
    grams = mix(rolling(_SYMBOLS[np.frombuffer(text, np.uint8)], gram))
    # A hash above, and below it the distance from the end of all places: the least is the rightmost of equal hashes.
    best, size, w = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64)), 1, length - gram + 1
    while size < w:
        step = min(size, w - size)
        best = np.minimum(best[:-step], best[step:])
        size += step
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    last = np.r_[first[1:], len(best)] - 1
    at = (np.uint64(0xFFFFFFFF) - (best[first] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    view = memoryview(text)
    region = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + length], p) for a, b, p in zip(first.tolist(), last.tolist(), (at - first).tolist(), strict=True)), np.uint64, len(first))
    return signed(grams[at]), signed(region), first, last


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(text).alias("key"), text_or_empty(text).cast("binary").alias("t"))


def _profiles(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = column(b, "t")
            found = [anchored(t, length, gram) for t in texts]
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*found, strict=True), (np.int64, np.int64, np.int32, np.int32), strict=True)], names=["anchor", "region", "first", "last"]) if found else pa.array([], _ANCHOR)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(column(b, "doc_id"), pa.int64()), pa.array(column(b, "key"), pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), lists], names=["doc_id", "key", "n_bytes", "kept_sha256", "anchors"])

    return _rows(docs, text).mapInArrow(tidied(run), _PROFILE)


def _place(*more: str) -> F.Column:
    """What is earlier: the smaller doc_id (null last), then the text's hash, then the start."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", *more)


def earlier_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(profiles, spans): spans has doc_id, key and the first and last start of runs of windows that also start earlier."""
    p = materialise(_profiles(docs, text, length, gram), "anchors")
    a = p.select("doc_id", "key", F.explode("anchors").alias("a")).select("doc_id", "key", "a.*")
    seen = materialise(a.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "seen")
    met = materialise(spread_join(likely(a, seen, "anchor"), seen, ["anchor"], ["doc_id", "key", "first"]).drop("n"), "met")
    regions = met.groupBy("anchor", "region").agg(F.count("*").alias("n"), F.min(_place("first", "last")).alias("rep"))
    regions = materialise(regions, "regions")
    copies = spread_join(met, regions.where("n > 1"), ["anchor", "region"], ["doc_id", "key", "first"])
    copies = copies.where(_place("first", "last") > F.col("rep")).select("doc_id", "key", "first", "last")
    kinds = regions.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = materialise(kinds, "kinds")
    # The first place of each of an anchor's different regions gives its bytes.
    ask = spread_join(regions.drop("n"), kinds, ["anchor"], ["region"], n="kinds").select("anchor", "rep.*", (F.col("kinds") > hot).alias("hot"))
    ask = materialise(ask.drop("none").groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "first", "last", "hot")).alias("ask")), "ask")
    total = ask.selectExpr("inline(ask)").where("not hot").agg(F.sum(F.col("last") - F.col("first") + length)).first()[0] or 0
    rows = likely(_rows(docs, text), ask, "key")
    asked = rows.join(ask.withColumnsRenamed({"doc_id": "_d", "key": "_k"}), rows.doc_id.eqNullSafe(F.col("_d")) & (rows.key == F.col("_k"))).select("doc_id", "key", "t", "ask")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, t, ask in zip(column(b, "doc_id"), column(b, "key"), column(b, "t"), column(b, "ask"), strict=True):
                cut = [(x["anchor"], x["first"], t[x["first"] : x["last"] + length], None) for x in ask if not x["hot"]]
                cut += [(x["anchor"], i, None, xxhash.xxh3_64_intdigest(t[i : i + length]) - (1 << 63)) for x in ask if x["hot"] for i in range(x["first"], x["last"] + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(cut), pa.int64()), pa.array([key] * len(cut), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*cut, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True))], names=["doc_id", "key", "anchor", "first", "bytes", "window"])

    pieces = materialise(asked.mapInArrow(tidied(cut_out), "doc_id bigint, key bigint, anchor bigint, first int, bytes binary, window bigint"), "pieces")

    def mark(table: pa.Table) -> pa.Table:
        # In the order of places: the index takes a smaller position for an earlier place.
        table = table.append_column("none", table.column("doc_id").is_null()).sort_by([(c, "ascending") for c in ("none", "doc_id", "key", "first")])
        place = np.stack([table.column(c).cast(pa.int64()).fill_null(0).to_numpy() for c in ("none", "doc_id", "key", "first")])
        table = table.take(pa.array(np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(axis=0)])))  # equal rows are one place
        of, start = repeated_windows(table.column("bytes").to_pylist(), length)
        head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)]) if len(of) else of
        tail = np.r_[head[1:], len(of)] - 1 if len(of) else of
        base = table.column("first").to_numpy()[of[head]] if len(of) else of
        spans = [pa.array((base + start[i]).astype(np.int32)) for i in (head, tail)]
        return pa.Table.from_arrays([table.column(c).take(pa.array(of[head])) for c in ("doc_id", "key")] + spans, names=["doc_id", "key", "first", "last"])

    dealt = pieces.where("window is null").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // bucket)))))
    indexed = dealt.groupBy("bucket").applyInArrow(mark, _SPAN)
    single = pieces.where("window is not null").drop("bytes")
    twice = single.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min(_place("first")).alias("rep")).where("n > 1")
    single = spread_join(single, materialise(twice, "twice"), ["anchor", "window"], ["doc_id", "key", "first"]).where(_place("first") > F.col("rep"))
    return p, copies.union(indexed).union(single.select("doc_id", "key", "first", F.col("first").alias("last")))


def without_earlier_strings(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, **sizes: int) -> DataFrame:
    """(doc_id, key, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs; kept, the bytes that stay, is null where nothing goes.

    Every byte goes that a string of `length` bytes covers which also starts earlier: in a document of smaller doc_id (null
    comes last, equal ids are told apart by their texts' hashes), or to the left in the same one, overlaps included. Strings are judged on
    the input, and never cross documents. Null texts are empty; texts under `length` bytes keep all. Equal rows are
    one place, so neither loses its bytes to the other. Spans count as one where they touch. Bytes that stay may cut code points.
    Columns besides doc_id and the text aren't read. Memory: a batch of texts, or a bucket.
    """
    p, spans = earlier_spans(docs, text, length, gram, **sizes)
    spans = materialise(spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    rows = likely(_rows(docs, text), spans, "key")
    s = spans.withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    hit = rows.join(s, rows.doc_id.eqNullSafe(s._d) & (rows.key == s._k)).select("doc_id", "key", "t", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, key, t, spans in zip(column(b, "doc_id"), column(b, "key"), column(b, "t"), column(b, "spans"), strict=True):
                edge = np.zeros(len(t) + 1, np.int64)
                np.add.at(edge, [x["first"] for x in spans], 1)
                np.add.at(edge, [x["last"] + length for x in spans], -1)
                stay = np.cumsum(edge)[:-1] == 0
                kept = np.frombuffer(t, np.uint8)[stay].tobytes()
                out.append((doc, key, len(t), len(t) - len(kept), int((~stay).sum() and (np.diff(np.r_[1, stay.astype(np.int8)]) == -1).sum()), hashlib.sha256(kept).hexdigest(), kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.string(), pa.binary()], strict=True)], names=["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = hit.mapInArrow(tidied(cut), "doc_id bigint, key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    q = s.select("_d", "_k")
    rest = p.join(q, p.doc_id.eqNullSafe(q._d) & (p.key == q._k), "left_anti")
    zero = F.lit(0).cast("bigint")
    return done.union(rest.select("doc_id", "key", "n_bytes", zero, zero, "kept_sha256", F.lit(None).cast("binary")))
