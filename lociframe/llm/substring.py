"""Removal of word spans that occur more than once in a corpus, the corpus being its own reference.

A window is LENGTH words. Each document is winnowed: of the grams of GRAM words in a window the least
hash (the rightmost of equal ones) is the window's anchor, so equal windows have equal anchors in the
same place. Only anchors meet across documents. An anchor's region is the words of all windows that
chose it; regions that are equal word for word repeat as a whole, and only where one anchor stands in
different regions are its windows hashed and counted one by one. Every step is an equi-join or a
pre-aggregated count, linear in the input; nothing is gathered on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, likely, materialise, mix, rolling, signed, spread_join, strings, text_hash, text_or_empty, tidied, window_argmin_right, word_hashes

LENGTH, GRAM = 35, 8

_ANCHOR = pa.struct([("anchor", pa.int64()), ("region", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_PROFILE = "doc_id bigint, key bigint, n_words bigint, kept_sha256 string, anchors array<struct<anchor:bigint,region:bigint,first:int,last:int>>"


def anchored(words: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, region hash, first window, last window) of each anchor of a document, and its windows' anchors."""
    h = mix(word_hashes(words))
    if len(h) < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, h
    grams = mix(rolling(h, gram))
    at = window_argmin_right(grams, length - gram + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    # Hashes of regions: from prefix sums of the polynomial, region by region.
    region = np.empty(len(first), np.uint64)
    for size in np.unique(last - first):
        of = last - first == size
        region[of] = rolling(h, int(size) + length)[first[of]]
    region = mix(region + (at[first] - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (last - first).astype(np.uint64))
    return signed(grams[at[first]]), signed(region), first, last, h


def _profiles(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, anchors = [], [], []
            for t in strings(b, "t"):
                words = t.encode().split()
                a, r, first, last, _ = anchored(words, length, gram)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(pa.StructArray.from_arrays([pa.array(a), pa.array(r), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["anchor", "region", "first", "last"]))
            offsets = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
            flat = pa.concat_arrays(anchors) if anchors else pa.array([], _ANCHOR)
            yield pa.RecordBatch.from_arrays([pa.array(column(b, "doc_id"), pa.int64()), pa.array(column(b, "key"), pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "key", "n_words", "kept_sha256", "anchors"])

    return _rows(docs, text).mapInArrow(tidied(run), _PROFILE)


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(text).alias("key"), text_or_empty(text).alias("t"))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(profiles, spans): spans has doc_id, key and the first and last start of runs of repeated windows."""
    p = materialise(_profiles(docs, text, length, gram), "anchors")
    a = p.select("doc_id", "key", F.explode("anchors").alias("a")).select("doc_id", "key", "a.*")
    # An anchor that occurs once is out. `one` says that all its regions are equal.
    seen = a.groupBy("anchor").agg(F.count("*").alias("n"), F.min("region").alias("lo"), F.max("region").alias("hi")).where("n > 1")
    seen = materialise(seen.select("anchor", "n", (F.col("lo") == F.col("hi")).alias("one")), "seen")
    met = materialise(spread_join(a, seen, ["anchor"], ["doc_id", "key", "first"]).drop("n"), "met")
    mixed = met.where("not one").groupBy("anchor", "region").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "first")).alias("rep"))
    mixed = materialise(mixed, "regions")
    whole = met.where("one").select("doc_id", "key", "first", "last")
    again = spread_join(met.where("not one"), mixed.where("n > 1").select("anchor", "region", "n"), ["anchor", "region"], ["doc_id", "key", "first"]).select("doc_id", "key", "first", "last")
    # One occurrence of each of an anchor's different regions gives its windows. Where the region repeats, so do they.
    ask = mixed.select("anchor", F.col("rep.doc_id").alias("doc_id"), F.col("rep.key").alias("key"), F.col("rep.first").alias("first"), "n")
    ask = materialise(ask.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "n")).alias("ask")), "ask")
    rows = likely(_rows(docs, text), ask, "key")
    asked = rows.join(ask.withColumnsRenamed({"doc_id": "_d", "key": "_k"}), rows.doc_id.eqNullSafe(F.col("_d")) & (rows.key == F.col("_k"))).select("doc_id", "key", "t", "ask")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, t, ask in zip(column(b, "doc_id"), column(b, "key"), strings(b, "t"), column(b, "ask"), strict=True):
                anchor, _, first, last, h = anchored(t.encode().split(), length, gram)
                hashes = rolling(h, length)
                i = np.searchsorted(first, [x["first"] for x in ask])
                reach = last[i] - first[i] + 1
                starts = np.concatenate([np.arange(first[j], last[j] + 1) for j in i])
                n = np.repeat([x["n"] for x in ask], reach)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(starts), pa.int64()), pa.array([key] * len(starts), pa.int64()), pa.array(np.repeat(anchor[i], reach)), pa.array(signed(mix(hashes[starts]))), pa.array(starts.astype(np.int32)), pa.array(n.astype(np.int64))], names=["doc_id", "key", "anchor", "window", "start", "n"])

    w = materialise(asked.mapInArrow(tidied(windows), "doc_id bigint, key bigint, anchor bigint, window bigint, start int, n bigint"), "windows")
    twice = w.groupBy("anchor", "window").agg(F.sum("n").alias("n"), F.count("*").alias("c")).where("n > 1 and c > 1")
    twice = materialise(twice.select("anchor", "window", F.col("c").alias("n")), "twice")
    single = spread_join(w.where("n = 1").drop("n"), twice, ["anchor", "window"], ["doc_id", "key", "start"]).select("doc_id", "key", F.col("start").alias("first"), F.col("start").alias("last"))
    return p, whole.union(again).union(single)


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, n_words, n_removed, kept_sha256, kept_text) for each row of docs; kept_text is null where nothing goes.

    Words are split at space and 09-0D. Null and empty texts have no words. Equal rows repeat each other, so
    both lose their windows. Documents of fewer than `length` words keep all. Memory: a batch of texts.
    """
    p, spans = repeated_spans(docs, text, length, gram)
    spans = materialise(spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    rows = likely(_rows(docs, text), spans, "key")
    s = spans.withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    hit = rows.join(s, rows.doc_id.eqNullSafe(s._d) & (rows.key == s._k)).select("doc_id", "key", "t", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, key, t, spans in zip(column(b, "doc_id"), column(b, "key"), strings(b, "t"), column(b, "spans"), strict=True):
                words = t.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [x["first"] for x in spans], 1)
                np.add.at(edge, [x["last"] + length for x in spans], -1)
                stay = np.cumsum(edge)[:-1] == 0
                kept = b" ".join([words[i] for i in np.flatnonzero(stay)])
                out.append((doc, key, len(words), len(words) - int(stay.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()] * 2, strict=True)], names=["doc_id", "key", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = hit.mapInArrow(tidied(cut), "doc_id bigint, key bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    q = s.select("_d", "_k")
    rest = p.join(q, p.doc_id.eqNullSafe(q._d) & (p.key == q._k), "left_anti")
    return done.union(rest.select("doc_id", "key", "n_words", F.lit(0).cast("bigint"), "kept_sha256", F.lit(None).cast("string")))
