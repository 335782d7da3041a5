"""Quality rules: per-document word statistics, and lines that too many documents of a host share."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, materialise, spread_join, strings, text_hash, text_or_empty, tidied

SYMBOLS = "#*$%&|<>"

#: A line is boilerplate of its host if more than MIN_DOCS different documents and more than HOST_SHARE of the host's have it.
MIN_DOCS, HOST_SHARE = 20, 0.05
#: The lower limits, either of which suffices, of op2 and quality_rules: lines that more than ENOUGH_DOCS different documents of a host have, however large
#: it is, or more than FLOOR_DOCS of them and FLOOR_SHARE of the host's. (A line of FLOOR_DOCS documents tells nothing on a small host.)
ENOUGH_DOCS, FLOOR_DOCS, FLOOR_SHARE = 5, 2, 0.005
#: A document that keeps less than this share of its words without such lines is depleted, and in op2 one that keeps fewer words than the base rules ask for.
LEAST_LEFT, LEAST_WORDS = 0.5, 50


def normalised_line(line: str) -> str:
    """Lower case, white space (space and 09-0D) collapsed: what decides whether two lines are the same."""
    return b" ".join(line.lower().encode().split()).decode()


def base_statistics(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.encode().split()  # bytes split at just space and 09-0D
    n = len(words)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(grams)) < len(grams):
        often = {g for g, c in Counter(grams).items() if c > 1}
        until = 0
        for i, g in enumerate(grams):
            if g in often:
                repeat += i + 3 - max(i, until)
                until = i + 3
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


_PROFILE = "doc_id bigint, key bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<h:bigint,words:bigint>>"


def profiles(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """A row for each document: its base statistics and the hash and word count of each distinct normalised line."""
    names = [x.split(" ")[0] for x in _PROFILE.split(", ")]
    line = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5, line]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats, lines = [], []
            for t in strings(b, "t"):
                stats.append(base_statistics(t))
                n: Counter = Counter()
                for x in map(normalised_line, t.split("\n")):
                    if x:
                        n[xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63)] += x.count(" ") + 1
                lines.append([{"h": h, "words": w} for h, w in n.items()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([column(b, "doc_id"), column(b, "key"), column(b, "host"), *(zip(*stats, strict=True) if stats else [[]] * 5), lines], types, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(text).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(tidied(run), _PROFILE)


def verdicts(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, least_left: float = LEAST_LEFT, shared: bool = False, either: bool = False, least_words: int = 0) -> DataFrame:
    """A row for each row of docs: doc_id, key, the statistics, base_failed, frequent (hashes of its lines above the limits), kept.

    With shared also n_shared_words and shared, the same for the lines above the limits or above the lower
    ones, either of which suffices; kept is decided by the frequent lines alone. With either, frequent
    lines are those above the lower limits. Documents that keep fewer than least_words are depleted as well.

    Lines are counted by host over different documents: equal texts count once, so that a page which is
    merely copied isn't taken for boilerplate (copies are for the near-duplicate stage). Counts are
    pre-aggregated before their shuffle, and only lines above the limits are joined back. A null text is
    empty and fails the base rules; a null host is a host of its own; repeated rows get the same verdict.
    """
    p = materialise(profiles(docs, text, host), "profiles")
    once = p.groupBy("host", "key").agg(F.first("lines").alias("lines"), F.count("*").alias("copies"))
    hosts = once.groupBy("host").agg(F.count("*").alias("host_docs"))
    counts = once.select("host", "copies", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("docs"), F.sum("copies").alias("n")).where(F.col("docs") > (min(min_docs, ENOUGH_DOCS, FLOOR_DOCS) if shared or either else min_docs))
    above = (F.col("docs") > min_docs) & (F.col("docs") > F.col("host_docs") * host_share)
    low = (F.col("docs") > ENOUGH_DOCS) | ((F.col("docs") > FLOOR_DOCS) & (F.col("docs") > F.col("host_docs") * FLOOR_SHARE))
    # n: the rows of documents that a line is joined to, copies included, for which it is dealt to tasks.
    frequent = counts.join(F.broadcast(hosts) if _few(hosts) else hosts, "host").where(above | low if shared or either else above).select("host", "h", "n", *([above.alias("above")] if shared else []))
    frequent = materialise(frequent, "frequent")
    lines = p.select("doc_id", "key", "host", F.explode("lines").alias("l")).select("doc_id", "key", "host", F.col("l.h").alias("h"), F.col("l.words").alias("words"))
    sums = [F.sum("words").alias("n_frequent_words"), F.collect_list("h").alias("frequent")]
    if shared:
        sums = [F.sum(F.when(F.col("above"), F.col("words"))).alias("n_frequent_words"), F.collect_list(F.when(F.col("above"), F.col("h"))).alias("frequent"), F.sum("words").alias("n_shared_words"), F.collect_list("h").alias("shared")]
    removed = spread_join(lines, frequent, ["host", "h"], ["doc_id", "key"]).drop("n").distinct().groupBy("doc_id", "key", "host").agg(*sums)
    base = p.drop("lines")
    same = [base[c].eqNullSafe(removed[c]) for c in ("doc_id", "key", "host")]
    out = base.join(removed, same[0] & same[1] & same[2], "left").select(*[base[c] for c in base.columns], F.coalesce("n_frequent_words", F.lit(0).cast("bigint")).alias("n_frequent_words"), "frequent", *(["n_shared_words", "shared"] if shared else []))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_frequent_words")
    depleted = (left < F.col("n_words") * F.lit(least_left)) | (left < least_words)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def _few(hosts: DataFrame, most: int = 10_000) -> bool:
    """Hosts are broadcast only if there are at most so many."""
    return hosts.limit(most + 1).count() <= most


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of docs that pass, with their frequent and shared lines removed from the text; docs' own columns, whatever their names.

    Null and empty texts fail; repeated rows all stay or all go; rows of null or equal doc_ids are told apart by their texts.

    Where less than least_left of the words would stay without the shared lines, only the frequent ones go: on a
    host with some near copies of a document all its lines are shared, and one of the copies has to survive.
    """
    v = verdicts(docs, text, host, **limits, shared=True).where("kept")
    most = F.col("n_words") * F.lit(1 - limits.get("least_left", LEAST_LEFT))
    d, k, h, gone = fresh(docs, "_d", "_k", "_h", "_frequent")
    v = v.select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("host").alias(h), F.when(F.col("n_shared_words") <= most, F.col("shared")).otherwise(F.col("frequent")).alias(gone)).dropDuplicates([d, k, h])
    kept = docs.join(v, docs["doc_id"].cast("bigint").eqNullSafe(v[d]) & (text_hash(text) == v[k]) & F.coalesce(docs[host].cast("string"), F.lit("")).eqNullSafe(v[h]))

    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text)
            new = []
            for t, drop in zip(b.column(i).to_pylist(), column(b, gone), strict=True):
                if t and drop:
                    drop = set(drop)
                    t = "\n".join(x for x in t.split("\n") if not (y := normalised_line(x)) or xxhash.xxh3_64_intdigest(y.encode()) - (1 << 63) not in drop)
                new.append(t)
            cols = [pa.array(new, b.schema.field(i).type) if j == i else c for j, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).select(names)

    return kept.select(*[docs[c] for c in names], gone).mapInArrow(tidied(run), docs.schema)
