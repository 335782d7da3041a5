"""Fill-in-middle by a parallel automaton scan.

A finite automaton over UTF-8 bytes counts units (code points) and sentinels. A chunk of a text can be scanned
before anything is known of the state it is entered in: it gives, for each state, the state it is left in and
what was counted on the way. These functions compose associatively, so a prefix scan over a text's chunks tells
each chunk's entry state and what stands before it; the place of a unit is then sought in one chunk alone.

The scheme is used twice: over blocks of BLOCK bytes, side by side in one task, and over chunks of CHUNK bytes,
which different tasks scan where a document is longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, strings, text_hash, text_or_empty, tidied

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred draws so many leave a text plain, and so many of the others put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes that are scanned side by side in a task; bytes of a document's chunk, which any task may scan.
BLOCK, CHUNK = 256, 1 << 16
#: Bytes of texts that a task scans at a time.
AT_ONCE = 1 << 21
#: A sentinel counts as so much, a unit as 1.
MARK = 1 << 40

_OUT = "doc_id bigint, key bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_OUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


class Scanner:
    """The automaton of a set of sentinels and of UTF-8, with its scans; column 256 of the tables stands for no byte."""

    def __init__(self, sentinels: Sequence[str] = SENTINELS) -> None:
        words = [s.encode() for s in sentinels]
        states, follow, effect = [(b"", 0)], [], []
        for begun, pending in states:  # grows while it is walked
            row, counts = [], []
            for b in range(256):
                now = begun + bytes([b])
                found = any(now.endswith(w) for w in words)
                now = next(now[i:] for i in range(len(now) + 1) if any(len(now) - i < len(w) and w.startswith(now[i:]) for w in words))
                if b < 0x80 or b >= 0xC0:  # a lead byte also ends what a broken sequence had begun
                    left, done = (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0), (b < 0x80) + (pending > 0)
                else:
                    left, done = max(pending - 1, 0), int(pending < 2)
                if (now, left) not in states:
                    states.append((now, left))
                row.append(states.index((now, left)))
                counts.append(done + MARK * found)
            follow.append([*row, len(follow)])
            effect.append([*counts, 0])
        self.n = len(states)
        self.follow, self.effect = np.array(follow, np.int32), np.array(effect, np.int64)

    def blocks(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, first byte, bytes as columns, state left in, counts) of each block; the latter two by the state it is entered in."""
        size = np.array([len(t) for t in texts], np.int64)
        count = -(-size // BLOCK)
        of = np.repeat(np.arange(len(texts)), count)
        first = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * BLOCK
        flat = np.append(np.frombuffer(b"".join(texts), np.uint8), np.uint8(0))
        at = ((np.cumsum(size) - size)[of] + first)[None, :] + np.arange(BLOCK)[:, None]
        inside = first[None, :] + np.arange(BLOCK)[:, None] < size[of][None, :]
        cols = np.where(inside, flat[np.where(inside, at, 0)], np.int32(256)).astype(np.int32)
        to = np.broadcast_to(np.arange(self.n, dtype=np.int32), (len(of), self.n)).copy()
        seen = np.zeros((len(of), self.n), np.int64)
        for c in cols:
            i = to * 257 + c[:, None]
            seen += self.effect.ravel()[i]
            to = self.follow.ravel()[i]
        return of, first, cols, to, seen

    @staticmethod
    def composed(of: np.ndarray, to: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part the function of all parts of its text up to it, by doubling."""
        to, seen, step = to.copy(), seen.copy(), 1
        while step < len(of) and (of[step:] == of[:-step]).any():
            same = np.flatnonzero(of[step:] == of[:-step])
            left = to[same]
            later_to, later_seen = to[same + step], seen[same + step]
            seen[same + step] = seen[same] + np.take_along_axis(later_seen, left, 1)
            to[same + step] = np.take_along_axis(later_to, left, 1)
            step *= 2
        return to, seen

    def entries(self, of: np.ndarray, to: np.ndarray, seen: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """(entry state, counts before, counts after) of each part, start being the state that each part's text is entered in."""
        all_to, all_seen = self.composed(of, to, seen)
        after = all_seen[np.arange(len(of)), start]
        again = np.r_[False, of[1:] == of[:-1]] if len(of) else np.empty(0, bool)
        entry, before = start.copy(), np.zeros(len(of), np.int64)
        i = np.flatnonzero(again)
        entry[i], before[i] = all_to[i - 1, start[i]], after[i - 1]
        return entry, before, after

    def summaries(self, texts: list[bytes], blocks: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each text as one function: the state it is left in and its counts, by the state it is entered in."""
        of, _, _, to, seen = blocks or self.blocks(texts)
        to, seen = self.composed(of, to, seen)
        whole = np.broadcast_to(np.arange(self.n, dtype=np.int32), (len(texts), self.n)).copy(), np.zeros((len(texts), self.n), np.int64)
        last = np.flatnonzero(np.r_[of[1:] != of[:-1], True]) if len(of) else np.empty(0, np.int64)
        whole[0][of[last]], whole[1][of[last]] = to[last], seen[last]
        return whole

    def places(self, texts: list[bytes], text: np.ndarray, rank: np.ndarray, start: np.ndarray, blocks: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """The byte after the unit of a rank (0: the begin) in a text, for arrays of these; start: state that each text is entered in."""
        of, first, cols, to, seen = blocks or self.blocks(texts)
        entry, before, after = self.entries(of, to, seen, start[of])
        out = np.zeros(len(text), np.int64)
        ask = np.flatnonzero(rank > 0)
        # The parts of a text follow each other, so (text, units up to their end) ascends; the first that reaches the rank has it.
        ends = np.rec.fromarrays([of, after % MARK])
        block = np.searchsorted(ends, np.rec.fromarrays([text[ask], rank[ask]], dtype=ends.dtype)) if len(of) else ask
        state, left = entry[block], rank[ask] - before[block] % MARK
        for j, c in enumerate(cols):
            i = state * 257 + c[block]
            done = self.effect.ravel()[i] % MARK
            hit = (left > 0) & (left <= done)
            out[ask[hit]] = first[block[hit]] + j + 1
            left, state = left - done, self.follow.ravel()[i]
        return out


def drawn(draw: str, n: int) -> tuple[int, int, str]:
    """(units of the prefix, units up to the middle's end, form) of a text of n units without sentinels, by a draw of 32 hex digits or more."""
    a, b, c, d = (int(draw[i : i + 8], 16) for i in (0, 8, 16, 24))
    low, high = sorted((a % (n + 1), b % (n + 1)))
    return low, high, "plain" if n == 0 or c % 100 >= 100 - PLAIN else "spm" if d % 100 < SUFFIX_FIRST else "psm"


def arranged(text: bytes, form: str, low: int, high: int) -> bytes:
    p, s, m = (x.encode() for x in SENTINELS)
    if form == "psm":
        return p + text[:low] + s + text[high:] + m + text[low:high]
    return s + text[high:] + p + text[:low] + m + text[low:high] if form == "spm" else text


def restored(output: str = "output", form: str = "form") -> str:
    """SQL for the text that an output was made of: sentinels stand in no text that is arranged."""
    parts = f"split({output}, '<[PSM]>')"
    return f"case {form} when 'psm' then concat({parts}[1], {parts}[3], {parts}[2]) when 'spm' then concat({parts}[2], {parts}[3], {parts}[1]) else {output} end"


def _rows(docs: DataFrame, text: str, seed: int) -> DataFrame:
    doc = F.col("doc_id").cast("bigint")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    return docs.select(doc.alias("doc_id"), text_hash(text).alias("key"), draw.alias("draw"), text_or_empty(text).cast("binary").alias("t"))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about AT_ONCE bytes of t, or one row."""
    for b in batches:
        size = np.cumsum([len(t) for t in column(b, "t")])
        begin = 0
        while begin < b.num_rows:
            done = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + AT_ONCE, "right")))
            yield b.slice(begin, end - begin)
            begin = end


def _outputs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT_TYPES, strict=True)], names=[x.split(" ")[0] for x in _OUT.split(", ")])


def _made(doc: int | None, key: int, text: bytes, n: int, form: str, low: int, high: int, cut: Sequence[int]) -> tuple:
    chars = (None, None) if form == "plain" else (low, high - low)
    return doc, key, n, form, *chars, arranged(text, form, *cut).decode()


def fill_in_middle(docs: DataFrame, text: str = "text", seed: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, key, n, form, prefix_chars, middle_chars, output) for each row of docs, in no order.

    Cuts and forms are drawn from seed and doc_id, so they don't depend on partitions or repeated tasks. A null text is
    empty; empty texts and texts with a sentinel stay plain, with null prefix_chars and middle_chars. A null doc_id
    draws as an empty one; equal rows get equal results. Columns of docs besides doc_id and the text aren't read.

    Documents of at most `chunk` bytes are scanned where they are. Of longer ones different tasks scan the chunks and send
    only the chunks' functions, which compose by document (a row's text is bounded by Spark, so this is a few thousand
    small rows at most); each cut is then sought in the one chunk that holds it, when the output is put together.
    """
    rows = _rows(docs, text, seed)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        for b in _portions(batches):
            texts = column(b, "t")
            blocks = scan.blocks(texts)
            seen = scan.summaries(texts, blocks)[1][:, 0]
            plans = [drawn(d, int(s % MARK)) for d, s in zip(strings(b, "draw"), seen, strict=True)]
            plans = [(0, 0, "plain") if s >= MARK else p for p, s in zip(plans, seen, strict=True)]
            rank = np.array([x for low, high, _ in plans for x in (low, high)], np.int64)
            cut = scan.places(texts, np.repeat(np.arange(len(texts)), 2), rank, np.zeros(len(texts), np.int32), blocks).reshape(-1, 2).tolist()
            yield _outputs([_made(doc, key, t, int(s % MARK), form, low, high, c) for doc, key, t, s, (low, high, form), c in zip(column(b, "doc_id"), column(b, "key"), texts, seen, plans, cut, strict=True)])

    near = rows.where(F.octet_length("t") <= chunk).mapInArrow(tidied(short), _OUT)
    return near.union(_long(rows.where(F.octet_length("t") > chunk), chunk))


def _long(rows: DataFrame, chunk: int) -> DataFrame:
    states = Scanner().n
    parts = rows.dropDuplicates(["doc_id", "key"]).selectExpr("doc_id", "key", "draw", f"posexplode(transform(sequence(0, (octet_length(t) - 1) div {chunk}), i -> substring(t, i * {chunk} + 1, {chunk}))) as (part, t)")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        for b in _portions(batches):
            to, seen = scan.summaries(column(b, "t"))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.int64()), states).cast(pa.list_(pa.int64())) for x in (to, seen)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "key", "draw", "part")), *lists], names=["doc_id", "key", "draw", "part", "to", "seen"])

    # Chunks are dealt to tasks on their own, so that one giant document doesn't keep one task busy.
    sent = parts.repartition("doc_id", "key", "part")
    functions = materialise(sent.mapInArrow(tidied(summarise), "doc_id bigint, key bigint, draw string, part int, to array<bigint>, seen array<bigint>"), "chunks")

    def resolve(table: pa.Table) -> pa.Table:
        """The functions of one document's chunks: its units, form and cuts, each as (chunk, entry state, units into the chunk)."""
        table = table.sort_by("part")
        scan, none = Scanner(), np.zeros(table.num_rows, np.int32)
        to, seen = (np.array(table.column(c).to_pylist(), t) for c, t in (("to", np.int32), ("seen", np.int64)))
        entry, before, after = scan.entries(none, to, seen, none)
        units = after % MARK
        n = int(units[-1])
        low, high, form = drawn(table.column("draw")[0].as_py(), n) if after[-1] < MARK else (0, 0, "plain")
        at = np.searchsorted(units, [low, high])
        cuts = [{"part": int(i), "entry": int(entry[i]), "rank": int(r - before[i] % MARK)} for i, r in zip(at, (low, high), strict=True)]
        keys = [table.column(c).slice(0, 1) for c in ("doc_id", "key")]
        more = [pa.array([x], t) for x, t in ((n, pa.int64()), (form, pa.string()), (low, pa.int64()), (high, pa.int64()), (cuts, pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("rank", pa.int64())]))))]
        return pa.Table.from_arrays([*keys, *more], names=["_d", "_k", "n", "form", "low", "high", "cuts"])

    plans = materialise(functions.groupBy("doc_id", "key").applyInArrow(resolve, "_d bigint, _k bigint, n bigint, form string, low bigint, high bigint, cuts array<struct<part:int,entry:int,rank:bigint>>"), "cuts")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner()
        for b in _portions(batches):
            out = []
            for doc, key, t, n, form, low, high, cuts in zip(*(column(b, c) for c in ("doc_id", "key", "t", "n", "form", "low", "high", "cuts")), strict=True):
                pieces = [t[c["part"] * chunk : (c["part"] + 1) * chunk] for c in cuts]
                place = scan.places(pieces, np.arange(2), np.array([c["rank"] for c in cuts]), np.array([c["entry"] for c in cuts], np.int32))
                out.append(_made(doc, key, t, n, form, low, high, [c["part"] * chunk + int(p) for c, p in zip(cuts, place, strict=True)]))
            yield _outputs(out)

    return rows.join(plans, rows["doc_id"].eqNullSafe(plans["_d"]) & (rows["key"] == plans["_k"])).drop("_d", "_k", "draw").mapInArrow(tidied(assemble), _OUT)
