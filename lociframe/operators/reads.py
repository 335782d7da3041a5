"""Alignments: their geometry, flags and tags, the bases they have at a place, and pile-ups.

Functions take the columns of sources.tables.read_sam.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .intervals import BIN
from .relational import dealt

# The bits of a read's flag, from the least.
FLAGS = ["PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY"]


def flag_text(flag: Column) -> Column:
    """The names of a flag's bits, comma-joined."""
    return F.when(flag.isNotNull(), F.concat_ws(",", *[F.when(flag.bitwiseAND(1 << i) != 0, x) for i, x in enumerate(FLAGS)]))


def flag_number(text: Column) -> Column:
    """A flag from names joined by commas, or from a number; null where a name is unknown."""
    names = F.upper(text)
    bits = sum((F.when(F.call_function("find_in_set", F.lit(x), names) > 0, 1 << i).otherwise(0) for i, x in enumerate(FLAGS)), F.lit(0))
    # Names first: a cast that fails costs more than all else of a read.
    return F.coalesce(F.when(names.rlike(f"^,*(?:(?:{'|'.join(FLAGS)})(?:,+|$))*$"), bits), text.try_cast("int"))


def tag_value(tags: Column, name: str) -> Column:
    """A tag's value without its type; null where there is none."""
    return F.substr(F.try_element_at(tags, F.lit(name)), F.lit(3))


def with_tag(tags: Column, name: str, kind: str, value: Column) -> Column:
    """A tag set or replaced."""
    return F.map_concat(without_tag(tags, name), F.create_map(F.lit(name), F.concat(F.lit(kind + ":"), value.cast("string"))))


def without_tag(tags: Column, name: str) -> Column:
    return F.map_filter(tags, lambda k, v: k != name)


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, where each begins and the last ends); a null is empty."""
    t = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
    data = np.frombuffer(t.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if data.size and data.max() > 127:
        whole = t.to_pylist()
        return np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum([len(x) for x in whole])]
    return data, ends - ends[0]


def _letters(codes: np.ndarray, there: np.ndarray) -> pa.Array:
    """Strings of one code point, or empty ones."""
    if codes.size and codes.max() > 127:
        return pa.array([chr(c) if t else "" for c, t in zip(codes.tolist(), there.tolist(), strict=True)], pa.string())
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(np.r_[0, np.cumsum(there)].astype(np.int32)), pa.py_buffer(codes[there].astype(np.uint8))])


class _Aligned:
    """Reads of an Arrow batch with start, cigar, seq and qual: their operations, one after the other, each with its read and its places in reference and read."""

    def __init__(self, b: pa.RecordBatch):
        cigar = b.column("cigar")
        ends = np.asarray(cigar.offsets, np.int64)
        flat = cigar.values.slice(ends[0], ends[-1] - ends[0])
        codes, at = _codes(flat.field("op"))
        self.op = codes[at[:-1]] if len(flat) else np.empty(0, np.uint8)
        self.len = np.asarray(flat.field("len"), np.int64)
        counts = np.diff(ends)
        self.row = np.repeat(np.arange(len(counts)), counts)
        first = np.minimum(ends[:-1] - ends[0], max(len(flat) - 1, 0))
        of = lambda which: np.where(np.isin(self.op, np.frombuffer(which, np.uint8)), self.len, 0)
        before = lambda n: np.cumsum(n) - n
        self.uses = of(b"MDN=X")
        r, q = before(self.uses), before(of(b"MIS=X"))
        self.r, self.q = (x - x[first][self.row] if len(x) else x for x in (r, q))
        self.shows = of(b"M=XD")
        self.start, self.placed = np.asarray(pc.fill_null(b.column("start"), 0), np.int64), np.asarray(pc.is_valid(b.column("start")))
        self.seq, self.seq_at = _codes(b.column("seq"))
        self.qual, self.qual_at = _codes(b.column("qual"))
        self.rated = ~np.asarray(pc.fill_null(pc.equal(b.column("qual"), "*"), True))

    def seen(self, op: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, whether there is one, quality) at the ith place of operations; a deletion shows '*' of 0."""
        row, at, gone = self.row[op], self.q[op] + i, self.op[op] == ord("D")

        def of(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x, has = ends[row] + at, at < ends[row + 1] - ends[row]
            return np.where(has, codes[np.where(has, x, 0)], 0) if len(codes) else np.zeros(len(x), np.uint8), has

        base, has = of(self.seq, self.seq_at)
        quality = of(self.qual, self.qual_at)[0].astype(np.int64) - 33
        return np.where(gone, ord("*"), base), gone | has, np.where(gone | ~self.rated[row], 0, quality)

    def bases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(read, place, base, whether there is one, quality) of all places that the reads cover."""
        op = np.repeat(np.arange(len(self.op)), self.shows)
        i = np.arange(len(op)) - np.repeat(np.cumsum(self.shows) - self.shows, self.shows)
        return self.row[op], self.start[self.row[op]] + self.r[op] + i, *self.seen(op, i)


#: Bases that a task holds at a time, or those of one read or name.
AT_ONCE = 1 << 20


def _portions(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some AT_ONCE bases."""
    a = _Aligned(b)
    part = np.cumsum(np.bincount(a.row, a.shows, len(b))) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(b)]
    yield from (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


_READ = ("chrom", "start", "_vid", "name", "seq", "qual", "cigar")
_SEEN = {"chrom": "string", "pos": "int", "read": "bigint", "name": "string", "base": "string", "quality": "int", "reverse": "boolean"}


def _row(b: pa.RecordBatch, row: np.ndarray, pos: pa.Array, base: np.ndarray, there: np.ndarray, quality: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    own = {"chrom": "chrom", "read": "_vid", "name": "name", "reverse": "reverse"}
    new = {"pos": pos, "base": _letters(base, there) if "base" in columns else None, "quality": pa.array(quality, pa.int32())}
    taken = pa.array(row)
    return pa.RecordBatch.from_arrays([b.column(own[c]).take(taken) if c in own else new[c] for c in columns], names=columns)


def bases_at(places: DataFrame, reads: DataFrame, *, on: str = "chrom", pos: str = "pos", bin_width: int = BIN, columns: tuple[str, ...] = ("read", "name", "base", "quality")) -> DataFrame:
    """places joined with the reads over them: columns of read (as numbered), name, base and quality. Only places asked for are made rows.

    '*' of 0 stands for a deletion; what a read skips gives no row. The places of a bin meet a read as one list, in one row for each bin that it reaches,
    so no row is made of a read and a place apart from it.
    """
    ship(reads.sparkSession)
    kind = places.schema[pos].dataType.simpleString()
    lists = places.groupBy(F.col(on).alias("_c"), F.col(pos).cast("bigint").alias("_p")).agg(F.count("*").alias("_n")).where("_p is not null")
    lists = lists.groupBy("_c", F.floor(F.col("_p") / bin_width).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_p", "_n"))).alias("_l"))
    r = reads.where(F.col("start") < F.col("end")).select(F.col(on).alias("chrom"), *_READ[1:], F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor((F.col("end") - 1) / bin_width))).alias("_b"))
    j = r.join(lists, (F.col("chrom") == F.col("_c")) & (r._b == lists._b)).select(*_READ, F.col("_l._p").alias("_p"), F.col("_l._n").alias("_n"))
    schema = f"chrom string, pos bigint, {', '.join(f'{c} {_SEEN[c]}' for c in columns)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, ends = _Aligned(b), np.asarray(b.column("_p").offsets, np.int64)
            flat = lambda c: np.asarray(b.column(c).values, np.int64)[ends[0] : ends[-1]]  # noqa: B023, E731
            at, n = flat("_p"), flat("_n")
            row = np.repeat(np.arange(len(b)), np.diff(ends))
            off = at - a.start[row]
            used = np.flatnonzero(a.uses > 0)
            # Operations by (read, place in the reference), of which the last one not behind a place has it.
            keys = a.row[used] << 33 | a.r[used]
            inside = np.flatnonzero((off >= 0) & (off < np.bincount(a.row, a.uses, len(b))[row]))
            op = used[np.searchsorted(keys, row[inside] << 33 | off[inside], side="right") - 1]
            shown = a.shows[op] > 0
            inside, op = np.repeat(inside[shown], n[inside[shown]]), np.repeat(op[shown], n[inside[shown]])
            for k in range(0, len(op), AT_ONCE):
                i, o = inside[k : k + AT_ONCE], op[k : k + AT_ONCE]
                yield _row(b, row[i], pa.array(at[i]), *a.seen(o, off[i] - a.r[o]), ["chrom", "pos", *columns])

    more = [c for c in places.columns if c not in (on, pos)]
    if more:  # each place once, then its rows
        j = j.withColumn("_n", F.transform("_n", lambda x: F.lit(1).cast("bigint")))
    seen = j.mapInArrow(run, schema).select(F.col("chrom").alias(on), F.col("pos").cast(kind).alias(pos), *columns)
    return places.join(seen, [on, pos]).select(*places.columns, *columns) if more else seen.select(*places.columns, *columns)


def all_bases(reads: DataFrame, columns: tuple[str, ...] = ("chrom", "pos", "read", "name", "base", "quality", "reverse")) -> DataFrame:
    """Columns of chrom, pos, read, name, base, quality and, where flags are known, reverse: a row for each place that a read covers, by places of its operations."""
    ship(reads.sparkSession)
    strand = [(F.col("flag").bitwiseAND(0x10) != 0).alias("reverse")] if "flag" in reads.columns else []
    columns = [c for c in columns if c != "reverse" or strand]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _portions(b):
                a = _Aligned(x)
                row, pos, *seen = a.bases()
                yield _row(x, row, pa.array(pos, pa.int32(), mask=~a.placed[row]), *seen, columns)

    return reads.select(*_READ, *strand).mapInArrow(run, ", ".join(f"{c} {_SEEN[c]}" for c in columns))


def mate_bases(reads: DataFrame, depth: int | None = None) -> DataFrame:
    """chrom, pos, read, base, quality: mates_corrected(all_bases(reads)), but reads are dealt by name before they become bases.

    depth: of each place all but the first reads that a task has may be left out, where a pile-up of that depth, without a least quality, follows.
    """
    ship(reads.sparkSession)
    columns = ["chrom", "pos", "read", "base", "quality"]
    near = dealt(reads.select(*_READ), "name").sortWithinPartitions("name", "_vid")

    def corrected(b: pa.RecordBatch) -> list[np.ndarray]:
        """Of whole names: contig's number, place, read, base (0: none), quality."""
        a = _Aligned(b)
        row, pos, base, there, quality = a.bases()
        names = np.asarray(pc.dictionary_encode(b.column("name"), null_encoding="encode").indices, np.int64)
        chrom = np.asarray(pc.dictionary_encode(b.column("chrom"), null_encoding="encode").indices, np.int64)[row]
        # A name's reads follow each other in the order that they were read in.
        shared = np.flatnonzero((np.bincount(names) > 1)[names][row])
        order = shared[np.lexsort((row[shared], pos[shared], chrom[shared], names[row[shared]]))]
        key = np.stack([names[row[order]], chrom[order], pos[order]])
        new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)] if len(order) else np.empty(0, bool)
        first = np.flatnonzero(new)
        first = first[np.diff(np.r_[first, len(order)]) == 2]
        x, y = order[first], order[first + 1]
        both = (base[x] != ord("*")) & (base[y] != ord("*"))
        x, y = x[both], y[both]
        qx, qy, same = quality[x], quality[y], (base[x] == base[y]) & (there[x] == there[y])
        quality[x] = np.where(same, np.minimum(qx + qy, 200), np.where(qx >= qy, np.floor(qx * 0.8), 0))
        quality[y] = np.where(same | (qx >= qy), 0, np.floor(qy * 0.8))
        return [row, pos, base, there, quality, chrom]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bases = [], 0

        def out(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            row, pos, base, there, quality, chrom = corrected(b)
            keep = np.arange(len(row))
            if depth is not None:
                read = np.asarray(b.column("_vid"), np.int64)[row]
                order = np.lexsort((read, pos, chrom))
                new = np.r_[True, (chrom[order][1:] != chrom[order][:-1]) | (pos[order][1:] != pos[order][:-1])] if len(order) else np.empty(0, bool)
                place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                keep = order[place < depth]
            yield _row(b, row[keep], pa.array(pos[keep], pa.int32()), base[keep], there[keep], quality[keep], columns)

        for b in batches:
            # The batch's last name may go on in the next one.
            names, last = b.column("name"), b.column("name")[len(b) - 1]
            same = pc.is_null(names) if not last.is_valid else pc.fill_null(pc.equal(names, last), False)
            cut = len(b) - int(pc.sum(same).as_py())
            if not cut:
                held.append(b)
                continue
            held.append(b.slice(0, cut))
            bases += int(_Aligned(held[-1]).shows.sum())
            rest = b.slice(cut)
            if bases >= AT_ONCE:
                yield from out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, bases = [rest], 0
            else:
                held.append(rest)
        if held:
            yield from out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return near.where("start is not null").mapInArrow(run, ", ".join(f"{c} {_SEEN[c]}" for c in columns))


def mates_corrected(bases: DataFrame, keys: list[str]) -> DataFrame:
    """Where two reads of one name cover a place, the evidence counts once.

    Equal bases: the first read has the sum of both qualities, at most 200, the other 0. Different ones: the better, the first of
    equal ones, keeps 0.8 of its quality, the other has 0. Groups by (place, name) are the two mates, never more than a name's reads.
    """
    mates = Window.partitionBy(*keys, "name").orderBy("read")
    both = mates.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, rank = F.count("*").over(both), F.row_number().over(mates)
    mine, other = F.col("quality"), F.when(rank == 1, F.lead("quality").over(mates)).otherwise(F.lag("quality").over(mates))
    its = F.when(rank == 1, F.lead("base").over(mates)).otherwise(F.lag("base").over(mates))
    better = (mine > other) | ((mine == other) & (rank == 1))
    new = F.when(F.col("base") == its, F.when(rank == 1, F.least(mine + other, F.lit(200))).otherwise(0)).otherwise(F.when(better, F.floor(mine * 0.8)).otherwise(0))
    return bases.withColumn("quality", F.when((n == 2) & (F.col("base") != "*") & (its != "*"), new).otherwise(mine).cast("int"))


def pileup(bases: DataFrame, keys: list[str], depth: int | None = None, least_quality: int = 0) -> DataFrame:
    """keys, depth, bases (in the order of the reads) and the summed quality by place.

    `depth`, a feature of pile-ups, keeps the first reads of each place; without it all count. A place has as many rows as
    reads over it, so without a depth only counts are safe on places of extreme depth: see base_counts.
    """
    kept = bases.where(F.col("quality") >= least_quality)
    if depth is not None:
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("read"))).where(F.col("_n") <= depth).drop("_n")
    reads = F.array_sort(F.collect_list(F.struct("read", "base")))
    return kept.groupBy(*keys).agg(F.count("*").alias("depth"), F.array_join(F.transform(reads, lambda x: x["base"]), "").alias("bases"), F.sum("quality").cast("bigint").alias("quality"))


def base_counts(bases: DataFrame, keys: list[str], least_quality: int = 0) -> DataFrame:
    """keys, base, count, quality: combined before the shuffle, whatever the depth."""
    return bases.where(F.col("quality") >= least_quality).groupBy(*keys, "base").agg(F.count("*").alias("count"), F.sum("quality").cast("bigint").alias("quality"))
