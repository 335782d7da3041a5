"""Phrase collocation mining: sketched candidates, counted by automata, scored by their lowest cut.

1. A count-min sketch of all phrases of 2 to MOST words, by language. Tasks add to sketches that stop counting at
   LEAST; these are summed cell by cell in two levels, and only one bit of a cell is kept: whether it reached LEAST.
2. Shards of documents are read again. The phrases of a shard whose bits are set, and whose shorter parts' bits are,
   are compiled into an Aho-Corasick automaton that scans the shard and counts all their matches, overlapping ones too.
   A shard's automaton holds what the shard has itself, so it is bounded by the shard, whatever the corpus.
3. Counts are summed over shards; phrases under LEAST, which only the sketch let through, go. Every phrase that
   has LEAST occurrences or more is counted in full, so the sketch's errors cost time, never results.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, spread_join, text_or_empty, tidied, word_hashes

#: Words of the longest phrase, and the occurrences that make a phrase a candidate.
MOST, LEAST = 5, 100
#: A candidate goes if a longer one that contains it has this percentage of its occurrences, or more.
SHARE = 100
TOP = 2000
#: Rows of the sketch, expected phrases a cell, and the most cells of a row: 2^27 make 32 MB of bits in two rows, and 256 MB
#: of counts in a task. Beyond that, at some 8 billion characters, more phrases pass the sketch to be counted by shards; results don't change.
ROWS, LOAD, MOST_CELLS = 2, 40, 1 << 27
#: Characters of text that one automaton counts in.
SHARD = 4 << 20
#: Cells that are merged together.
_CHUNK = 1 << 20

_TABLE = bytes(46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STOP = b"."


def shard_words(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word or stop, words by code, which codes are words) of texts in lower case, with a stop after each piece."""
    flat = b" . ".join([*(t.encode().translate(_TABLE).replace(b".", b" . ") for t in texts), b""])
    # Of the white space that split() knows, what isn't a space or tab has become a stop.
    coded = pa.array(flat.split(), pa.binary()).dictionary_encode()
    stop = pc.index(coded.dictionary, pa.scalar(_STOP, pa.binary())).as_py()
    words = np.ones(len(coded.dictionary), bool)
    if stop >= 0:
        words[stop] = False
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, words


def phrase_cells(codes: np.ndarray, hashes: np.ndarray, words: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, starts, hashes) of the phrases of m words, for m from 2 to most."""
    h, ok = hashes[codes], words[codes]
    gram, fit = h, ok
    for m in range(2, most + 1):
        if len(gram) < 2:
            return
        gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[m - 1 :]
        fit = fit[:-1] & ok[m - 1 :]
        at = np.flatnonzero(fit)
        yield m, at, mix(gram[at] + np.uint64(m))


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return ((h if row == 0 else mix(h + np.uint64(row))) >> np.uint64(20)) & np.uint64(cells - 1)


def _language(lang: str) -> np.uint64:
    return word_hashes([lang.encode()])[0]


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[str]]]:
    """(lang, texts) of about `size` characters; all languages are given out when they reach four times that together."""
    held, chars, total = defaultdict(list), defaultdict(int), 0
    for b in batches:
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[lang].append(t)
            chars[lang] += len(t)
            total += len(t)
            if chars[lang] >= size:
                yield lang, held.pop(lang)
                total -= chars.pop(lang)
            elif total >= 4 * size:
                for one in list(held):
                    yield one, held.pop(one)
                chars.clear()
                total = 0
    yield from held.items()


def sketch_bits(rows: DataFrame, cells: int, most: int, least: int) -> np.ndarray:
    """Of each cell of each row of the sketch, packed, whether phrases reached `least` in it."""
    kind = np.uint8 if least < 128 else np.uint16 if least < 1 << 15 else np.uint64  # holds twice the most

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(ROWS * cells, kind)
        for lang, texts in _shards(batches, SHARD):
            codes, words, is_word = shard_words(texts)
            for _, _, h in phrase_cells(codes, word_hashes(words.to_pylist()), is_word, most):
                h = mix(h + _language(lang))
                for row in range(ROWS):
                    at, n = np.unique(_cells(h, row, cells), return_counts=True)
                    at = at.astype(np.int64) + row * cells
                    sketch[at] = np.minimum(sketch[at] + np.minimum(n, least).astype(kind), kind(least))
        for i in range(0, len(sketch), _CHUNK):
            part = sketch[i : i + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // _CHUNK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    def total(table: pa.Table) -> np.ndarray:
        out = None
        for raw in table.column("counts").combine_chunks().to_pylist():
            one = np.frombuffer(zlib.decompress(raw), kind).astype(np.uint64)
            out = one if out is None else np.minimum(out + one, np.uint64(least))
        return out

    def fold(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total(table).astype(kind).tobytes(), 1)], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(np.packbits(total(table) >= least).tobytes(), 1)], pa.binary())})

    # About the square root of the tasks' sketches meet in the first level, so no group holds many.
    level = rows.mapInArrow(tidied(build), "chunk int, counts binary").withColumn("salt", F.floor(F.sqrt(F.spark_partition_id())))
    level = level.groupBy("chunk", "salt").applyInArrow(fold, "chunk int, counts binary")
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for r in level.groupBy("chunk").applyInArrow(finish, "chunk int, counts binary").collect():
        one = np.frombuffer(zlib.decompress(r.counts), np.uint8)
        bits[r.chunk * _CHUNK // 8 : r.chunk * _CHUNK // 8 + len(one)] = one
    return bits


def _symbols(ids: np.ndarray) -> np.ndarray:
    """Two code points for each id, from two disjoint ranges, so that a match can only begin at a word; id -1 is the guard."""
    out = np.empty((len(ids), 2), np.uint32)
    out[:, 0], out[:, 1] = 0x1000 + ids // 128, 0x100 + ids % 128
    out[ids < 0] = 0x20
    return out.ravel()


def count_matches(codes: np.ndarray, phrases: list[np.ndarray], n_words: int) -> np.ndarray:
    """Occurrences in a shard of phrases, given as arrays of codes of equal lengths each, in their order; -1 in codes is no word.

    Words in no phrase and the stops between pieces become the same guard symbol, which no automaton's key has.
    """
    used = np.bincount(np.concatenate([p.ravel() for p in phrases]), minlength=n_words)
    order = np.argsort(-used, kind="stable")  # frequent words come first among a node's children
    ids = np.full(n_words + 1, -1, np.int64)
    ids[order] = np.where(used[order] > 0, np.arange(n_words), -1)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    at = 0
    for p in phrases:
        width = 2 * p.shape[1]
        text = _symbols(ids[p.ravel()]).tobytes().decode("utf-32-le", "surrogatepass")
        for i in range(len(p)):
            automaton.add_word(text[i * width : (i + 1) * width], at + i)
        at += len(p)
    automaton.make_automaton()
    text = _symbols(ids[codes]).tobytes().decode("utf-32-le", "surrogatepass")
    found = np.zeros(at, np.int64)
    step = 1 << 20
    overlap = 2 * max(p.shape[1] for p in phrases)
    for begin in range(0, len(text), step):  # a stretch at a time; matches that ended in the one before aren't counted again
        found += np.bincount(np.fromiter((v for end, v in automaton.iter(text[max(begin - overlap, 0) : begin + step]) if end >= min(begin, overlap)), np.int64), minlength=at)
    return found


def _counted(lang: str, texts: list[str], bits: np.ndarray, cells: int, most: int) -> Iterator[pa.RecordBatch]:
    codes, words, is_word = shard_words(texts)
    if not is_word.any():
        return
    single = np.bincount(codes, minlength=len(words))
    one = np.flatnonzero(is_word)
    yield _batch(lang, 1, words.take(pa.array(one)), single[one])
    phrases, before = [], is_word[codes]
    for m, at, h in phrase_cells(codes, word_hashes(words.to_pylist()), is_word, most):
        h = mix(h + _language(lang))
        ok = before[at] & before[at + 1]
        for row in range(ROWS):
            i = _cells(h, row, cells).astype(np.int64) + row * cells
            ok &= (bits[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 == 1
        at, h = at[ok], h[ok]
        before = np.zeros(len(codes), bool)
        before[at] = True
        if not len(at):
            break
        # Equal phrases by the codes of their words themselves; hashes only sort them.
        rows = codes[at[:, None] + np.arange(m)][np.argsort(h, kind="stable")]
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
        phrases.append(np.unique(rows, axis=0) if len(np.unique(h)) != len(rows) else rows)
    if not phrases:
        return
    codes[~is_word[codes]] = -1
    found = count_matches(codes, phrases, len(words))
    for p in phrases:
        n, found = found[: len(p)], found[len(p) :]
        yield _batch(lang, p.shape[1], pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in p.T), pa.scalar(b" ", pa.binary())), n)


def _batch(lang: str, m: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    k = len(phrase)
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(k, np.int64))), pa.array(np.full(k, m, np.int32)), phrase.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "m", "phrase", "f"])


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, least: int = LEAST) -> DataFrame:
    """(lang, m, phrase, f): all words, and the phrases of 2 to `most` words with `least` occurrences or more, by language."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("t"))
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    cells = 1 << 16
    while cells < min(size * (most - 1) // 6 // LOAD, MOST_CELLS):
        cells *= 2
    sent = docs.sparkSession.sparkContext.broadcast(sketch_bits(rows, cells, most, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, texts in _shards(batches, SHARD):
            yield from _counted(one, texts, sent.value, cells, most)

    found = rows.mapInArrow(tidied(count), "lang string, m int, phrase string, f bigint")
    return materialise(found.groupBy("lang", "m", "phrase").agg(F.sum("f").alias("f")).where(f"m = 1 or f >= {least}"), "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by score and occurrences, both descending, then by phrase.

    Texts lose the case of A-Z, are split into pieces at [.,;:!?\\n\\v\\f\\r], and these into words at spaces and tabs. n: words of
    the language; a: occurrences of the phrase inside pieces; l and r: those of the two parts at the cut of the lowest score
    floor(1000 a n / (l r)), the first of equal ones. A phrase inside a longer candidate that has `share` percent of its occurrences,
    or more, goes. Null texts are empty, a null language is `und`; repeated rows count as often as they stand there. A language
    without candidates has no rows. Columns besides the text and the language aren't read.

    Products are exact decimals of 38 digits, and an overflow would raise an error. A part that very many candidates
    share is dealt to several tasks; ranks are taken of salted parts of a language first.
    """
    c = phrase_counts(docs, text, lang, most, least)
    words = c.where("m = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    candidates = c.where("m > 1").selectExpr("lang", "m", "phrase", "f as a", "split(phrase, ' ') as w")
    cuts = candidates.selectExpr("lang", "phrase", "a", "m", "w", "explode(sequence(1, m - 1)) as k")
    cuts = cuts.selectExpr("lang", "phrase", "a", "m", "k", "array_join(slice(w, 1, k), ' ') as first", "array_join(slice(w, k + 1, m - k), ' ') as rest")
    parts = c.select("lang", F.col("phrase").alias("part"), "f")

    def with_count(rows: DataFrame, part: str, name: str) -> DataFrame:
        asked = materialise(rows.groupBy("lang", part).agg(F.count("*").alias("asked")).join(parts.withColumnsRenamed({"part": part, "f": name}), ["lang", part]), name)
        return spread_join(rows, asked, ["lang", part], ["phrase", "k"], n="asked").drop("asked")

    cuts = with_count(with_count(materialise(cuts, "cuts"), "first", "l"), "rest", "r").join(words, "lang")
    product = lambda x, y: f"cast({x} as decimal(19, 0)) * cast({y} as decimal(18, 0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(floor(({product('a', 'n')} * 1000BD) div ({product('l', 'r')})) as bigint)"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "n", "cut.*")
    # What a longer candidate contains, one with a word less between the two contains as well, and at least as often.
    inner = candidates.where("m > 2").selectExpr("lang", "a", "explode(array(array_join(slice(w, 1, m - 1), ' '), array_join(slice(w, 2, m - 1), ' '))) as phrase")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * a").drop("longer", "k")

    def first(rows: DataFrame, *by: str) -> DataFrame:
        order = "score desc, a desc, phrase"
        return rows.withColumn("rank", F.expr(f"cast(row_number() over (partition by {', '.join(('lang', *by))} order by {order}) as bigint)")).where(f"rank <= {top}")

    salted = first(kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(256))), "salt")
    return first(salted.drop("salt", "rank")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
