"""Suffix automata of reference shards: documents are streamed through them for matching statistics.

A shard is some reference passages of bounded size; its automaton has at most two states a word, so what is
broadcast is bounded, and checked. Streaming a word costs amortised constant time and yields the length of the
longest run of words ending there that stands in the shard. Maximal runs of `length` words or more are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, strings, text_hash, text_or_empty, tidied

LENGTH = 35
#: Words of a shard, and bytes that its automaton may have when it is broadcast.
SHARD_WORDS, MOST_BYTES = 50_000, 64 << 20


class Automaton:
    """The suffix automaton of some word sequences; a separator that no text has keeps matches within one of them."""

    def __init__(self, passages: list[list[bytes]]):
        self.words: dict[bytes, int] = {}
        self.link, self.long = [-1], [0]
        self.next: dict[tuple[int, int], int] = {}
        out: list[list[int]] = [[]]  # the words that lead on from each state
        last = 0
        for n, passage in enumerate(passages):
            for w in [-1 - n, *(self.words.setdefault(x, len(self.words)) for x in passage)]:
                last = self._extend(last, w, out)

    def _extend(self, last: int, w: int, out: list[list[int]]) -> int:
        new = self._state(self.long[last] + 1, 0, out)
        p = last
        while p >= 0 and (p, w) not in self.next:
            self.next[p, w] = new
            out[p].append(w)
            p = self.link[p]
        if p < 0:
            return new
        q = self.next[p, w]
        if self.long[p] + 1 == self.long[q]:
            self.link[new] = q
            return new
        copy = self._state(self.long[p] + 1, self.link[q], out)
        for x in out[q]:
            self.next[copy, x] = self.next[q, x]
        out[copy] = list(out[q])
        while p >= 0 and self.next.get((p, w)) == q:
            self.next[p, w] = copy
            p = self.link[p]
        self.link[q] = self.link[new] = copy
        return new

    def _state(self, long: int, link: int, out: list[list[int]]) -> int:
        self.long.append(long)
        self.link.append(link)
        out.append([])
        return len(self.long) - 1

    def statistics(self, words: list[bytes]) -> np.ndarray:
        """For each word the length of the longest run ending there that stands in a passage."""
        found = np.zeros(len(words), np.int64)
        at = n = 0
        for i, x in enumerate(words):
            w = self.words.get(x)
            if w is None:
                at = n = 0
                continue
            while at and (at, w) not in self.next:
                at = self.link[at]
                n = self.long[at]
            if (to := self.next.get((at, w))) is not None:
                at, n = to, n + 1
            found[i] = n
        return found

    def size(self) -> int:
        """Bytes, about: of a transition, of a state, of a word."""
        return 150 * len(self.next) + 64 * len(self.long) + 80 * len(self.words)


def covered(found: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a run of `length` or more, from the matching statistics."""
    edge = np.zeros(len(found) + 1, np.int64)
    ends = np.flatnonzero(found >= length)
    np.add.at(edge, ends - found[ends] + 1, 1)
    np.add.at(edge, ends + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def shards(references: DataFrame, text: str = "text", words: int = SHARD_WORDS) -> DataFrame:
    """(shard, t): the distinct reference texts dealt to shards of about that many words; a longer text is a shard alone."""
    t = references.select(text_or_empty(text).alias("t")).distinct().where("t rlike '[^ \\\\t-\\\\r]'")
    t = materialise(t.withColumn("n", F.expr("size(split(t, '[ \\\\t-\\\\r]+'))")), "references")
    parts = max(1, -(-2 * (t.agg(F.sum("n")).first()[0] or 0) // words))
    return t.select(F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int").alias("shard"), "t")


def without_reference_spans(docs: DataFrame, references: DataFrame, text: str = "text", length: int = LENGTH, reference_text: str = "text", words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, key, n_words, n_removed, kept_text) for each row of docs, without runs of `length` words or more that references have.

    The references are a bounded table beside the corpus (a benchmark, say): one pass over docs for each shard.
    Null and empty texts have no words; repeated rows get the same. A shard whose automaton is too large
    for a broadcast is refused.
    """
    spark = docs.sparkSession
    dealt = materialise(shards(references, reference_text, words), "shards")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(text).alias("key"), text_or_empty(text).alias("t"))
    spans = None
    for shard in sorted(r.shard for r in dealt.select("shard").distinct().collect()):  # as many as the references need
        automaton = Automaton([r.t.encode().split() for r in dealt.where(F.col("shard") == shard).collect()])
        if automaton.size() > MOST_BYTES:
            raise ValueError(f"the automaton of a shard takes about {automaton.size()} bytes; deal the references to smaller shards")
        sent = spark.sparkContext.broadcast(automaton)

        def stream(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for doc, key, t in zip(column(b, "doc_id"), column(b, "key"), strings(b, "t"), strict=True):
                    gone = np.flatnonzero(np.diff(np.r_[0, covered(sent.value.statistics(t.encode().split()), length), 0]))
                    if len(gone):
                        out.append((doc, key, gone[::2].tolist(), gone[1::2].tolist()))
                if out:
                    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "key", "starts", "ends"])

        found = materialise(rows.mapInArrow(tidied(stream), "doc_id bigint, key bigint, starts array<bigint>, ends array<bigint>"), "matches")
        spans = found if spans is None else spans.union(found)
        sent.destroy()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, key, t, starts, ends in zip(column(b, "doc_id"), column(b, "key"), strings(b, "t"), column(b, "starts"), column(b, "ends"), strict=True):
                given = t.encode().split()
                edge = np.zeros(len(given) + 1, np.int64)
                np.add.at(edge, [x for s in starts or [] for x in s], 1)
                np.add.at(edge, [x for s in ends or [] for x in s], -1)
                stay = np.cumsum(edge)[:-1] == 0
                out.append((doc, key, len(given), len(given) - int(stay.sum()), b" ".join([given[i] for i in np.flatnonzero(stay)]).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "key", "n_words", "n_removed", "kept_text"])

    schema = "doc_id bigint, key bigint, n_words bigint, n_removed bigint, kept_text string"
    none = F.lit(None).cast("array<array<bigint>>")
    if spans is None:
        return rows.select("*", none.alias("starts"), none.alias("ends")).mapInArrow(tidied(cut), schema)
    one = spans.dropDuplicates(["doc_id", "key", "starts"]).groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    return rows.join(one, rows.doc_id.eqNullSafe(one._d) & (rows.key == one._k), "left").select("doc_id", "key", "t", "starts", "ends").mapInArrow(tidied(cut), schema)
