"""Best-fit packing of token sequences by bin completion.

Pieces of equal length are interchangeable, so the search works on the counts by length: at most
`capacity` numbers, whatever the corpus, gathered by a pre-aggregated count. It yields patterns (the
lengths that share a sequence) with multiplicities; every piece then finds its pattern by its rank
among the pieces of its length. No piece is gathered on the driver.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import ODD, chunks
from .common import CACHES, column, materialise, text_or_empty, tidied, trim

CAPACITY, END_ID = 4096, 1
#: Steps of the whole search, and fillings that are put in order of waste at a time. The steps bound the time of the
#: search for fewer sequences, not the pieces: all pieces are packed whatever they are.
NODES, TOGETHER = 2_000_000, 16


@dataclass(frozen=True)
class Pattern:
    lengths: tuple[int, ...]  # descending
    times: int


class Pieces:
    """Pieces left by length, with a bit set of the lengths that are left; taking and giving back are undone steps."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n}
        self.lengths = sum(1 << k for k in self.left)
        self.total = sum(k * n for k, n in self.left.items())

    def longest(self, most: int) -> int:
        """The longest length left that is at most `most`; 0 if there is none."""
        return (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 and self.lengths & ((1 << (most + 1)) - 1) else 0

    def up_to(self, most: int) -> int:
        """Tokens of the pieces of at most that length."""
        return sum(k * n for k, n in self.left.items() if k <= most)

    def take(self, need: Counter, times: int) -> None:
        for k, n in need.items():
            self.total -= k * n * times
            self.left[k] -= n * times
            if not self.left[k]:
                del self.left[k]
                self.lengths &= ~(1 << k)

    def give(self, need: Counter, times: int) -> None:
        for k, n in need.items():
            self.total += k * n * times
            self.left[k] = self.left.get(k, 0) + n * times
            self.lengths |= 1 << k


def undominated(chosen: list[int], waste: int, others: int) -> bool:
    """Whether no piece left out (lengths: the bits of `others`) could take the place of chosen ones or of none.

    A piece x replaces chosen ones of sum s if s <= x <= s + waste: whatever packing has this filling has an
    equally good one with x here and those in x's place. One piece of the same length is no replacement.
    """
    one, more = 0, 0  # bit sets of the sums of one chosen piece, and of two or more
    for c in chosen:
        more |= (more | one) << c
        one |= 1 << c
    if more & others:
        return False
    reach, done = (1 | one | more) << 1, 1  # sums raised by 1 to `waste`
    if not waste:
        return True
    while done < waste:
        step = min(done, waste - done)
        reach |= reach << step
        done += step
    return not reach & others


def fillings(pieces: Pieces, room: int, most_waste: int, budget: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """All undominated fillings of `room` with pieces left, as (waste, lengths); best fit's comes first.

    Lengths are chosen from the longest that fits down, each as often as it fits and then less often. A
    branch ends where the room can't be filled up to `most_waste`, or up to less than the shortest piece that it
    leaves out. Each step takes one from `budget`; without budget the enumeration ends early. The pieces may
    change between two fillings if they are as before when the next one is asked for.
    """
    path: list[list[int]] = []  # length, times, pieces' tokens below it, shortest length left out before it
    rest, short, limit = pieces.up_to(room), room + 1, room
    budget[0] -= len(pieces.left) // 8
    while True:
        while (k := pieces.longest(min(limit, room))) and budget[0] > 0:
            budget[0] -= 1
            n = pieces.left[k]
            # Lengths that were passed over as too long for the room can't be used below either.
            c = min(n, room // k)
            rest -= k * n
            path.append([k, c, rest, short])
            room -= k * c
            limit = k - 1
        chosen = [k for k, c, _, _ in path for _ in range(c)]
        if room <= most_waste and room < short:
            budget[0] -= 8 + len(chosen)
            others = pieces.lengths & ((1 << (room + sum(chosen) + 1)) - 1)
            for k, c, _, _ in path:
                if c == pieces.left[k]:
                    others &= ~(1 << k)
            if undominated(chosen, room, others):
                yield room, tuple(chosen)
        while path:
            budget[0] -= 1
            k, c, below, short = path[-1]
            if not c or budget[0] <= 0:
                room += k * c
                path.pop()
                continue
            path[-1][1] = c - 1
            room += k
            short, rest, limit = min(short, k), below, k - 1
            if room - rest <= min(most_waste, short - 1):
                break
        else:
            return


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: for each t, those of the pieces above capacity - t and above half of it,
    and what the pieces from t to half the capacity need beyond the room that the latter leave."""
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    lengths = sorted(counts)
    for t in [0, *(k for k in lengths if 2 * k <= capacity)]:
        alone = sum(n for k, n in counts.items() if k > capacity - t)
        large = [(k, n) for k, n in counts.items() if capacity - t >= k and 2 * k > capacity]
        small = sum(k * n for k, n in counts.items() if 2 * k <= capacity and k >= t)
        room = sum((capacity - k) * n for k, n in large)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(small - room) // capacity)))
    return best


def completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns that pack all of counts (length: pieces) into as few sequences as the search finds.

    Bin completion: depth first over the longest piece left, each time through the undominated fillings
    around it, a few at a time by waste. A filling is applied as often as the counts last, later less often. A
    branch ends once its waste exceeds what a packing better than the incumbent may have; best fit decreasing is
    the first incumbent. The search ends at the lower bound, when nothing is left to try (the result is then
    optimal), or after `nodes` steps: a limit of time, whatever it leaves is packed as the incumbent has it.
    """
    best = best_fit_decreasing(counts, capacity)
    fewest, total, bound = sum(p.times for p in best), sum(k * n for k, n in counts.items()), lower_bound(counts, capacity)
    if fewest <= bound:
        return best
    pieces, budget = Pieces(counts), [nodes]
    waste = used = 0
    # Frames: [longest, its fillings to come, those at hand, pattern applied now or None, its need, times]
    frames: list[list] = []

    def open_frame() -> None:
        longest = pieces.longest(capacity)
        spare = (fewest - 1) * capacity - total - waste
        frames.append([longest, fillings_around(pieces, longest, capacity, spare, budget), [], None, None, 0])

    open_frame()
    while frames and fewest > bound:
        frame = frames[-1]
        longest, source, ready, filling, need, times = frame
        if filling is not None:  # back from below: take the pattern back, then apply it less often
            pieces.give(need, times)
            waste -= filling[0] * times
            used -= times
            times -= 1
        if budget[0] <= 0:
            break
        if filling is None or not times:
            if not ready:
                ready.extend(sorted(islice(source, TOGETHER), reverse=True))
            if not ready:
                frames.pop()
                continue
            filling = ready.pop()
            need = Counter((longest, *filling[1]))
            times = min(pieces.left[k] // n for k, n in need.items())
            # Each sequence more of this waste has to leave the packing better than the incumbent.
            if filling[0]:
                times = min(times, ((fewest - 1) * capacity - total - waste) // filling[0])
            if times <= 0:
                frame[3:] = None, None, 0
                continue
        frame[3:] = filling, need, times
        pieces.take(need, times)
        waste += filling[0] * times
        used += times
        if not pieces.left:
            if used < fewest:
                fewest, best = used, [Pattern((f[0], *f[3][1]), f[5]) for f in frames]
        elif used + -(-pieces.total // capacity) < fewest:
            open_frame()
    return best


def fillings_around(pieces: Pieces, longest: int, capacity: int, spare: int, budget: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """The fillings of the sequence of one piece of the longest length, as if that piece were taken out while they are looked for."""
    one = Counter((longest,))
    pieces.take(one, 1)
    source = fillings(pieces, capacity - longest, spare, budget)
    while True:
        found = next(source, None)
        pieces.give(one, 1)
        if found is None:
            return
        yield found
        pieces.take(one, 1)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit on counts: fill round the largest with the longest that fits; the first incumbent."""
    left = {k: n for k, n in counts.items() if n}
    sizes = sorted(left)
    out = []
    while left:
        largest = sizes[-1]
        chosen, need, room = [largest], {largest: 1}, capacity - largest
        i = bisect_right(sizes, room)
        while i:
            k = sizes[i - 1]
            fit = min(room // k, left[k] - need.get(k, 0))
            if fit > 0:
                chosen += [k] * fit
                need[k] = need.get(k, 0) + fit
                room -= k * fit
            i = min(i - 1, bisect_right(sizes, room))
        times = min(left[k] // n for k, n in need.items())
        out.append(Pattern(tuple(chosen), times))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        sizes = [k for k in sizes if k in left]
    return out


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset (both bigint); lengths must be from 1 to capacity.

    Ranks within a length come from a count by (length, slice) and row numbers within slices, so that one
    length of a third of all pieces is still numbered by many tasks. An empty table gives no rows; equal
    rows are pieces of their own.
    """
    spark = pieces.sparkSession
    slices = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = pieces.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    by_slice = cut.groupBy(F.col(length).alias("_l"), F.col("_s")).agg(F.count("*").alias("_n"))
    counts = {int(r["_l"]): int(r["n"]) for r in by_slice.groupBy("_l").agg(F.sum("_n").alias("n")).collect()}  # `capacity` rows at most
    if not counts:
        return pieces.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint"))
    patterns = completion(counts, capacity)
    names = list(pieces.columns)
    plan = spark.sparkContext.broadcast(_places(patterns))  # a row for each length of each pattern: bounded by the lengths
    before = by_slice.select("_l", "_s", (F.sum("_n").over(Window.partitionBy("_l").orderBy("_s")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(length, "_s").orderBy(*order)) - 1
    ranked = cut.withColumn("_w", within).join(before, (F.col(length) == before._l) & (cut._s == before._s)).select(*pieces.columns, (F.col("_w") + F.col("_before")).alias("_rank"))
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            k, rank = (np.array(column(b, c), np.int64) for c in (length, "_rank"))
            at = np.searchsorted(p["key"], (k << 44) | rank, "right") - 1
            i = rank - p["from"][at]
            seq = p["base"][at] + i // p["each"][at]
            off = p["offset"][at] + (i % p["each"][at]) * k
            yield pa.RecordBatch.from_arrays([*[b.column(j) for j in range(len(names))], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(run, "chunks"), schema)


def _places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where the ranks of each length go: from rank `from`, `each` to a sequence from `base` on, at `offset`."""
    rows, used, base = [], {}, 0
    for p in patterns:
        at, i = 0, 0
        while i < len(p.lengths):
            k = p.lengths[i]
            n = p.lengths[i:].count(k) if i + 1 < len(p.lengths) and p.lengths[i + 1] == k else 1
            start = used.get(k, 0)
            rows.append(((k << 44) | start, start, n, base, at))
            used[k] = start + n * p.times
            at += n * k
            i += n
        base += p.times
    rows.sort()
    return {c: np.array(v, np.int64) for c, v in zip(("key", "from", "each", "base", "offset"), zip(*rows, strict=True), strict=True)}


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: Texts that are encoded together: the more, the fewer chunks are looked up twice. Their arrays take about 20 times as much.
TEXT_BYTES = 4 << 20
#: Chunks, and words, that a worker remembers, with as many of the generation before: about 150 bytes each.
REMEMBERED = 400_000
#: Chunks of these characters alone are normalised and split here: none of them composes with another one.
PLAIN = re.compile("[!-~\u00a1-\u017f]+")


class ChunkIds:
    """The ids of texts as little-endian 32-bit integers, from remembered chunks and words; the library encodes new words.

    Chunks between white space are made of fewer different words (the same word comes with other
    punctuation and in capitals), so what a new chunk lacks are mostly words that are known. New words are
    encoded many in one call, and told apart by the tokens that end a word.
    """

    _loaded: dict[tuple[str, int], ChunkIds] = {}
    LONGEST = 64

    def __init__(self, path: str, most: int = REMEMBERED):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split["pattern"]["Regex"]).findall
        self.special = [x["content"] for x in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + len(self.special) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(spec["model"]["end_of_word_suffix"] or "\0")]] = True
        del spec, vocab
        trim()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, most: int = REMEMBERED) -> ChunkIds:
        if (path, most) not in cls._loaded:
            cls._loaded[path, most] = cls(path, most)
        return cls._loaded[path, most]

    def singly(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encoded_words(self, words: list[str], together: int = 200) -> Iterator[bytes]:
        """The ids of each word; a group whose words can't be told apart is encoded word by word."""
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(group) or ends[-1] != 4 * len(ids):
                yield from self.singly(group)
                continue
            raw, at = ids.tobytes(), 0
            for end in ends.tolist():
                yield raw[at:end]
                at = end

    def encoded(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """(chunk, ids) of each of some chunks."""
        special, plain, other = self.special, [], []
        for c in new:
            (plain if PLAIN.fullmatch(c) and not ("<" in c and any(s in c for s in special)) else other).append(c)
        lower = [self.words_of(c.lower()) for c in plain]
        if len(self.words) > self.most:
            self.words, self.older_words = {}, self.words
        words, older, lacking = self.words, self.older_words, []
        for w in set().union(*lower):
            if w not in words:
                if (raw := older.get(w)) is None:
                    lacking.append(w)
                else:
                    words[w] = raw
        words.update(zip(lacking, self.encoded_words(lacking), strict=True))
        for c, parts in zip(plain, lower, strict=True):
            yield c, b"".join(map(words.__getitem__, parts))
        yield from zip(other, self.singly(other), strict=True)
        for w in lacking:
            if len(w) > self.LONGEST:
                del words[w]

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an array without nulls.

        Each different chunk of the array is looked up once; numpy then puts the ids together by the
        chunks' codes, which costs far less than to look up every chunk of every text.
        """
        if pc.any(pc.match_substring_regex(texts, ODD.pattern)).as_py():
            lists = pa.array([chunks(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)  # splits where str.split() does; may give empty chunks
        coded = lists.values.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, distinct))
        new = []
        for i in [i for i, raw in enumerate(found) if raw is None]:
            c = distinct[i]
            if (raw := older.get(c)) is None:
                new.append(i)
            else:
                found[i] = known[c] = raw
        fresh = dict(self.encoded([distinct[i] for i in new]))
        for i in new:
            found[i] = fresh[distinct[i]]
        known.update((c, raw) for c, raw in fresh.items() if len(c) <= self.LONGEST)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        n = size[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        if ends[-1] < 1 << 31:  # half the memory
            first, ends, size = (x.astype(np.int32) for x in (first, ends, size))
        at = np.repeat(first[codes] - ends[:-1], n)
        at += np.arange(ends[-1], dtype=at.dtype)
        ids = ids[at]
        del at
        bounds = ends[lists.offsets.to_numpy()].tolist()
        for i, j in zip(bounds, bounds[1:], strict=False):
            yield ids[i:j].tobytes()


CACHES["chunks"] = ChunkIds._loaded.clear


def gathered(batches: Iterator[pa.RecordBatch], most: int = TEXT_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The two columns of batches, some rows at a time: up to `most` bytes, or one row if that has more, however large the batches are."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for b in sliced(batch, most):
            if held and size + b.nbytes > most:
                yield tuple(pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1))
                held, size = [], 0
            held.append(b)
            size += b.nbytes
    if held:
        yield tuple(pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1))


def sliced(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of up to `most` bytes, or of one row that has more: Spark fills a batch by rows, 10,000 unless a session says otherwise."""
    if batch.nbytes <= most or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    yield from sliced(batch.slice(0, half), most)
    yield from sliced(batch.slice(half), most)


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, remembered: int = REMEMBERED, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """A row for each piece of each document: its ids and END_ID, cut only where longer than capacity.

    Chunks between white space are encoded once and remembered: no token spans white space. The memory of
    a worker's chunks is bounded; what it forgets is encoded anew. `remembered` and `text_bytes` trade memory
    for time; results don't depend on them.
    """
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkIds.of(tokenizer, remembered)
        end = np.array([END_ID], "<u4").tobytes()
        for docs, texts in gathered(batches, text_bytes):
            out = []
            for doc, raw in zip(docs.to_pylist(), encode(texts), strict=True):
                raw += end
                for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty(text).alias("t")).mapInArrow(tidied(run, "chunks"), schema)


def packed_documents(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, remembered: int = REMEMBERED, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    Null and empty texts are the end id alone; repeated rows are pieces of their own; null doc_ids stay null.
    """
    pieces = materialise(token_pieces(docs, tokenizer, text, capacity, remembered=remembered, text_bytes=text_bytes), "pieces")
    return pack(pieces, "length", ("doc_id", "piece", "start", "ids_crc32"), capacity)
