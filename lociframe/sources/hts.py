"""Block-gzipped text, BCF and BAM as a Spark data source, in both directions.

Block-gzipped files are read in ranges of compressed bytes, one task each. A range of text starts at its first whole block
and ends with the line that crosses its end. BCF and BAM have no marks between records: a range looks for the first place
in its blocks from which a chain of plausible records follows. Gzipped, plain and unzipped BCF files are one task. Binary
records become the lines of the text formats, which the text readers parse. With an index beside a file (sources.regions)
a filter on places is pushed down to the blocks that can hold it. Files are opened through pyarrow's file systems, by path or URI.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.relational import PARTS
from ..scratch import stored
from ..shipping import ship
from .vcf import ROW_BITS, VcfHeader, sniff, split_bits, vcf_lines

NAME = "lociframe_hts"
SPLIT = 64 << 20
# Fixed values of the formats: the empty block that ends a file, limits of types, what stands for missing and for the end.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
MISSING = {1: -(1 << 7), 2: -(1 << 15), 3: -(1 << 31), 4: -(1 << 63)}
INT_CODE = {1: "b", 2: "h", 3: "i", 4: "q"}
# BCF's places are 32 bits: one from here on stands behind the tags of its record, which other readers pass over, and this in its stead.
LAST_PLACE = (1 << 31) - 1
FLOAT_MISSING, FLOAT_END = 0x7F800001, 0x7F800002


def _file_system(path: str) -> pafs.FileSystem:
    return pafs.FileSystem.from_uri(path)[0] if "://" in path else pafs.LocalFileSystem()


def _files(path: str) -> tuple[pafs.FileSystem, list[tuple[str, int]]]:
    """The file system and the sorted (path, size) of a file or of a folder's parts; hidden files and marks are left out."""
    path = path.removeprefix("file:") if path.startswith("file:") else path
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, allow_not_found=False))
    keep = [f for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and not f.base_name.endswith((".csi", ".tbi", ".bai"))]
    return fs, sorted((f.path, f.size) for f in keep)


def block_size(head: bytes) -> int | None:
    """The length of the block that starts here, None where none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return None
    return int.from_bytes(head[16:18], "little") + 1


def _block(f, at: int) -> tuple[bytes, int] | None:
    """(data, where the next block starts) of the block at a place; None if there is none, or a broken one."""
    f.seek(at)
    size = block_size(head := f.read(18))
    if size is None or len(rest := f.read(size - 18)) < size - 18:
        return None
    try:
        return zlib.decompress(head + rest, 31), at + size
    except zlib.error:
        return None


def _first_block(f, start: int, end: int) -> int | None:
    """The first place in [start, end) at which a whole block starts; magic bytes inside of other blocks don't decompress."""
    at = start
    while at < end:
        f.seek(at)
        window = f.read(min(1 << 17, end - at) + 3)
        i = window.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            if at + i < end and _block(f, at + i):
                return at + i
            i = window.find(b"\x1f\x8b\x08\x04", i + 1)
        at += len(window) - 3 if len(window) > 3 else 4
    return None


def blocks(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, data) of all blocks from a place on; a broken one is an error."""
    while at < size:
        got = _block(f, at)
        if got is None:
            raise ValueError(f"no whole block at byte {at}")
        yield at, got[0]
        at = got[1]


def block_lines(f, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines of a range: those that start in its blocks but for the first, and the one that starts right at its end.

    The range at 0 has its first line too. So each line is in exactly one range, however long it is.
    """
    at = _first_block(f, start, end)
    if at is None:
        return
    pieces, held, place, own, skip = [], 0, 0, None, start > 0
    for where, data in blocks(f, at, size):
        if own is None and where >= end:
            own = place + held
        if own is not None and place > own:
            return
        *whole, rest = data.split(b"\n")
        for line in whole:
            if own is not None and place > own:
                return
            if pieces:
                line = b"".join([*pieces, line])
                pieces, held = [], 0
            if not skip:
                yield line
            skip = False
            place += len(line) + 1
        pieces.append(rest)
        held += len(rest)
    if held and not skip and (own is None or place <= own):
        yield b"".join(pieces)


class Walk:
    """Bytes of a block-gzipped file from a virtual place (a block's place, bytes into its data) on."""

    def __init__(self, f, size: int, at: int = 0, within: int = 0):
        self.more, self.held, self.used = blocks(f, at, size), deque(), within

    def tell(self) -> tuple[int, int] | None:
        """The virtual place of the next byte; None at the end of the file."""
        while not self.held or self.used >= len(self.held[0][1]):
            if self.held:
                self.used -= len(self.held.popleft()[1])
            if not self.held:
                got = next(self.more, None)
                if got is None:
                    return None
                self.held.append(got)
        return self.held[0][0], self.used

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None at the end of the file."""
        parts, have = [], 0
        while have < n:
            if self.tell() is None:
                if have:
                    raise ValueError("the file ends inside of a record")
                return None
            part = self.held[0][1][self.used : self.used + n - have]
            self.used += len(part)
            have += len(part)
            parts.append(part)
        return b"".join(parts)

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        parts = []
        while self.tell() is not None:
            data = self.held[0][1]
            end = data.find(b"\n", self.used)
            parts.append(data[self.used : end if end >= 0 else len(data)])
            self.used = end + 1 if end >= 0 else len(data)
            if end >= 0:
                return b"".join(parts)
        return b"".join(parts) if parts else None


#: Records that have to follow each other plausibly before a place counts as the start of one, and bytes looked at first.
CHAIN, LOOK = 8, 1 << 18


def first_record(f, start: int, end: int, size: int, length: Callable[[bytes, int], int | None]) -> tuple[int, int] | None:
    """The virtual place of the first record that starts in the blocks of [start, end).

    length(data, i) is the length of the record that could start at i, 0 where more bytes are needed to tell, None where none can. A place
    counts if CHAIN records follow each other from it on, or fewer up to the file's very end.
    """
    at = _first_block(f, start, end)
    if at is None:
        return None
    data, begins, more = bytearray(), [], blocks(f, at, size)
    whole = False

    def extend(n: int) -> None:
        nonlocal whole
        while len(data) < n and not whole:
            got = next(more, None)
            if got is None:
                whole = True
                return
            begins.append((len(data), got[0]))
            data.extend(got[1])

    def chained(i: int) -> bool:
        for _ in range(CHAIN):
            if i >= len(data):
                extend(i + 1)
                if i >= len(data):
                    return i == len(data)
            n = length(data, i)
            while n == 0 and not whole:
                extend(len(data) + LOOK)
                n = length(data, i)
            if not n:
                return False
            i += n
        return True

    i, k = 0, 0
    while True:
        extend(i + 1)
        if i >= len(data):
            return None
        while k + 1 < len(begins) and begins[k + 1][0] <= i:
            k += 1
        if begins[k][1] >= end:
            return None
        if chained(i):
            return begins[k][1], i - begins[k][0]
        i += 1


class Stream:
    """Bytes of a whole block-gzipped, gzipped or plain file in order, some at a time."""

    def __init__(self, f, size: int):
        f.seek(0)
        head = f.read(18)
        self.chunks = (d for _, d in blocks(f, 0, size)) if block_size(head) else self._plain(f, size, head[:2] == b"\x1f\x8b")
        self.buffer = b""

    @staticmethod
    def _plain(f, size: int, zipped: bool) -> Iterator[bytes]:
        f.seek(0)
        z = zlib.decompressobj(31) if zipped else None
        while data := f.read(1 << 20):
            if z is None:
                yield data
                continue
            while data:  # members may follow each other
                yield z.decompress(data)
                data = z.unused_data
                if z.eof:
                    z = zlib.decompressobj(31)

    def take(self, n: int) -> bytes | None:
        """The next n bytes; None at the end of the file."""
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            data = next(self.chunks, None)
            if data is None:
                if have:
                    raise ValueError("the file ends inside of a record")
                return None
            parts.append(data)
            have += len(data)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]

    def lines(self) -> Iterator[bytes]:
        pieces = [self.buffer]
        for data in self.chunks:
            *whole, rest = data.split(b"\n")
            for line in whole:
                yield b"".join([*pieces, line])
                pieces = []
            pieces.append(rest)
        if any(pieces):
            yield b"".join(pieces)


# --- BCF


def dictionaries(h: VcfHeader) -> tuple[list[str], list[str]]:
    """(strings, contigs) by number: PASS, then filters, INFO and FORMAT tags in the header's order, each name once."""
    return list(dict.fromkeys(["PASS", *h.filters, *h.info, *h.format])), list(h.contigs)


def numbered_names(text: str) -> tuple[dict[int, str], dict[int, str]]:
    """(strings, contigs) of a header's lines, in their order or by the numbers (IDX) that they give."""
    import re

    strings, contigs, seen = {0: "PASS"}, {}, {"PASS"}
    for kind, body in re.findall(r"^##(INFO|FORMAT|FILTER|contig)=<(.*)>\s*$", text, re.M):
        name = re.match(r"(?:.*,)?ID=([^,]*)", body)[1]
        own = re.search(r",IDX=(\d+)", body)
        if kind == "contig":
            contigs[int(own[1]) if own else len(contigs)] = name
        elif name not in seen:
            seen.add(name)
            strings[int(own[1]) if own else len(strings)] = name
    return strings, contigs


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def unpack(self, form: str) -> tuple:
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out

    def kind(self) -> tuple[int, int]:
        b = self.data[self.at]
        self.at += 1
        n = b >> 4
        if n == 15:
            n = self.values(*self.kind())[0]
        return n, b & 15

    def values(self, n: int, kind: int):
        """A list of numbers (None: missing; cut at the end mark) or a string."""
        if kind == 0:
            return []
        if kind == 7:
            raw = self.data[self.at : self.at + n]
            self.at += n
            return raw.rstrip(b"\0").decode()
        if kind == 5:
            bits = self.unpack(f"{n}I")
            out = [None if b == FLOAT_MISSING else struct.unpack("<f", struct.pack("<I", b))[0] for b in bits if b != FLOAT_END]
            return out
        low = MISSING[kind]
        return [None if x == low else x for x in self.unpack(f"{n}{INT_CODE[kind]}") if x != low + 1]

    def typed(self):
        return self.values(*self.kind())


def _shown(v) -> str:
    if isinstance(v, str):
        return v or "."
    return ",".join("." if x is None else f"{x:g}" if isinstance(x, float) else str(x) for x in v) or "."


def _genotype(v: list) -> str:
    out = ""
    for i, x in enumerate(v):
        x = x or 0
        out += ("|" if x & 1 else "/") * (i > 0) + ("." if x >> 1 == 0 else str((x >> 1) - 1))
    return out or "."


def decode_record(shared: bytes, each: bytes, strings: dict[int, str], contigs: dict[int, str]) -> str:
    """One BCF record as a VCF line."""
    c = _Cursor(shared)
    chrom, pos, _, bits, n_info, n_allele, n = c.unpack("iiiIHHI")
    n_sample, n_fmt = n & 0xFFFFFF, n >> 24
    name = c.typed()
    alleles = [c.typed() for _ in range(n_allele)]
    filters = c.typed()
    info = []
    for _ in range(n_info):
        key, v = strings[c.typed()[0]], c.typed()
        info.append(key if v == [] else f"{key}={_shown(v)}")
    if pos == LAST_PLACE and c.at < len(shared):
        pos = c.typed()[0]
    qual = "." if bits == FLOAT_MISSING else f"{struct.unpack('<f', struct.pack('<I', bits))[0]:g}"
    cells = [contigs[chrom], str(pos + 1), name or ".", alleles[0] if alleles else ".", ",".join(alleles[1:]) or ".", qual, ";".join(strings[x] for x in filters) or ".", ";".join(info) or "."]
    if n_sample:
        c, keys, columns = _Cursor(each), [], []
        for _ in range(n_fmt):
            key = strings[c.typed()[0]]
            length, kind = c.kind()
            keys.append(key)
            columns.append([(_genotype if key == "GT" else _shown)(c.values(length, kind)) for _ in range(n_sample)])
        cells += [":".join(keys) or ".", *[":".join(x) or "." for x in (zip(*columns) if columns else [()] * n_sample)]]
    return "\t".join(cells)


def _int_kind(values: list[int]) -> int:
    lo, hi = min(values, default=0), max(values, default=0)
    return 1 if lo >= -120 and hi <= 127 else 2 if lo >= -32760 and hi <= 32767 else 3 if lo >= MISSING[3] + 8 and hi < 1 << 31 else 4


def _typed_head(n: int, kind: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + _numbers([n])


def _numbers(values: list[int]) -> bytes:
    kind = _int_kind([x for x in values if x is not None])
    return _typed_head(len(values), kind) + struct.pack(f"<{len(values)}{INT_CODE[kind]}", *[MISSING[kind] if x is None else x for x in values])


def _text(s: str) -> bytes:
    raw = s.encode()
    return _typed_head(len(raw), 7) + raw


def _float_bits(x: float | None) -> int:
    return FLOAT_MISSING if x is None else struct.unpack("<I", struct.pack("<f", x))[0]


def _floats(values: list[float | None]) -> bytes:
    return _typed_head(len(values), 5) + struct.pack(f"<{len(values)}I", *map(_float_bits, values))


def _parsed(text: str, number) -> list:
    return [None if x == "." else number(x) for x in text.split(",")]


def _each_sample(rows: list[list], pad) -> tuple[int, list]:
    n = max(map(len, rows), default=0)
    return n, [x for r in rows for x in r + [pad] * (n - len(r))]


def encode_record(line: str, h: VcfHeader, strings: dict[str, int], contigs: dict[str, int]) -> bytes:
    """One VCF line as a BCF record; its tags, filters and contig have to be in the header."""
    c = line.split("\t")
    alleles = [c[3], *([] if c[4] == "." else c[4].split(","))]
    info = [] if c[7] == "." else c[7].split(";")
    keys = c[8].split(":") if len(c) > 9 and c[8] != "." else []
    end = next((int(x[4:]) for x in info if x.startswith("END=")), None)
    pos = int(c[1]) - 1
    out = struct.pack("<iiiIHHI", contigs[c[0]], min(pos, LAST_PLACE), min(end - pos, LAST_PLACE) if end else len(c[3]), _float_bits(None if c[5] == "." else float(c[5])), len(info), len(alleles), len(keys) << 24 | max(len(c) - 9, 0))
    out += _text("" if c[2] == "." else c[2]) + b"".join(map(_text, alleles))
    out += b"\0" if c[6] == "." else _numbers([strings[x] for x in c[6].split(";")])
    for item in info:
        key, has, value = item.partition("=")
        kind = h.info[key].type
        out += _numbers([strings[key]])
        out += b"\0" if not has or kind == "Flag" else _numbers(_parsed(value, int)) if kind == "Integer" else _floats(_parsed(value, float)) if kind == "Float" else _text(value)
    if pos >= LAST_PLACE:
        out += _numbers([pos])
    each = b""
    samples = [x.split(":") for x in c[9:]]
    for i, key in enumerate(keys):
        cells = [s[i] if i < len(s) else "." for s in samples]
        each += _numbers([strings[key]])
        kind = "GT" if key == "GT" else h.format[key].type
        if kind in ("GT", "Integer"):
            if kind == "GT":
                rows = []
                for x in cells:
                    calls = x.replace("|", "/").split("/")
                    marks = [False, *[y == "|" for y in x if y in "|/"]]
                    rows.append([(0 if a == "." else int(a) + 1) << 1 | m for a, m in zip(calls, marks)])
            else:
                rows = [_parsed(x, int) for x in cells]
            k = _int_kind([x for r in rows for x in r if x is not None])
            n, flat = _each_sample(rows, MISSING[k] + 1)
            each += _typed_head(n, k) + struct.pack(f"<{len(flat)}{INT_CODE[k]}", *[MISSING[k] if x is None else x for x in flat])
        elif kind == "Float":
            n, flat = _each_sample([[_float_bits(y) for y in _parsed(x, float)] for x in cells], FLOAT_END)
            each += _typed_head(n, 5) + struct.pack(f"<{len(flat)}I", *flat)
        else:
            raw = [x.encode() for x in cells]
            n = max(map(len, raw), default=0)
            each += _typed_head(n, 7) + b"".join(x.ljust(n, b"\0") for x in raw)
    return struct.pack("<II", len(out), len(each)) + out + each


def bcf_header(s: Stream | Walk) -> str:
    magic = s.take(9)
    if magic is None or magic[:4] != b"BCF\2":
        raise ValueError("not a BCF file of version 2")
    return s.take(int.from_bytes(magic[5:9], "little")).rstrip(b"\0").decode().rstrip("\n")


def bcf_records(s: Stream | Walk, text: str) -> Iterator[str]:
    strings, contigs = numbered_names(text)
    while (head := s.take(8)) is not None:
        a, b = struct.unpack("<II", head)
        yield decode_record(s.take(a), s.take(b) if b else b"", strings, contigs)


def bcf_length(text: str) -> Callable[[bytes, int], int | None]:
    """For first_record: what holds of any record under this header."""
    contigs = set(numbered_names(text)[1])
    samples = max(len(text.rsplit("\n", 1)[-1].split("\t")) - 9, 0)

    def length(d: bytes, i: int) -> int | None:
        if len(d) < i + 33:
            return 0
        a, b, contig, pos, span, _, counts, more = struct.unpack_from("<IIiiiIII", d, i)
        n_alleles, n_info, n_samples, n_fmt = counts >> 16, counts & 0xFFFF, more & 0xFFFFFF, more >> 24
        if a < 25 + 3 * n_info or a > 1 << 30 or b > 1 << 30 or contig not in contigs or pos < -1 or span < 0 or n_alleles < 1 or n_samples != samples or (b > 0) != (n_fmt > 0 and samples > 0) or d[i + 32] & 15 != 7:
            return None
        return 8 + a + b

    return length


# --- BAM


def _tags(data: bytes) -> Iterator[str]:
    sizes, at = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}, 0
    show = lambda x: f"{x:g}" if isinstance(x, float) else str(x)
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            yield f"{name}:{kind}:{data[at:end].decode()}"
            at = end + 1
        elif kind == "A":
            yield f"{name}:A:{chr(data[at])}"
            at += 1
        elif kind == "B":
            of, n = chr(data[at]), int.from_bytes(data[at + 1 : at + 5], "little")
            values = struct.unpack_from(f"<{n}{sizes[of]}", data, at + 5)
            yield f"{name}:B:{of}" + "".join("," + show(v) for v in values)
            at += 5 + struct.calcsize(f"<{n}{sizes[of]}")
        else:
            (v,) = struct.unpack_from("<" + sizes[kind], data, at)
            yield f"{name}:{'f' if kind == 'f' else 'i'}:{show(v)}"
            at += struct.calcsize("<" + sizes[kind])


def bam_header(s: Stream | Walk) -> tuple[list[str], list[str]]:
    """(header lines, contigs)."""
    magic = s.take(8)
    if magic is None or magic[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n = int.from_bytes(magic[4:8], "little")
    head = s.take(n).rstrip(b"\0").decode().rstrip("\n") if n else ""
    names = []
    for _ in range(int.from_bytes(s.take(4), "little")):
        names.append(s.take(int.from_bytes(s.take(4), "little")).rstrip(b"\0").decode())
        s.take(4)
    return head.split("\n") if head else [], names


def bam_records(s: Stream | Walk, names: list[str]) -> Iterator[str]:
    while (size := s.take(4)) is not None:
        yield bam_line(s.take(int.from_bytes(size, "little")), names)


def bam_length(names: list[str]) -> Callable[[bytes, int], int | None]:
    """For first_record: what holds of any record of a file with these contigs."""

    def length(d: bytes, i: int) -> int | None:
        if len(d) < i + 36:
            return 0
        size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos, _ = struct.unpack_from("<IiiBBHHHIiii", d, i)
        if not (-1 <= ref < len(names) and -1 <= mate < len(names) and pos >= -1 and mate_pos >= -1 and l_name) or 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq > size or size > 1 << 30:
            return None
        name = d[i + 36 : i + 36 + l_name]
        if len(name) < l_name:
            return 0
        return 4 + size if name[-1] == 0 and all(33 <= x <= 126 for x in name[:-1]) else None

    return length


def bam_line(d: bytes, names: list[str]) -> str:
    """An alignment as SAM text."""
    contig = lambda i: "*" if i < 0 else names[i]
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, length = struct.unpack_from("<iiBBHHHIiii", d)
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_ops}I", d, at)
    at += 4 * n_ops
    raw = d[at : at + (l_seq + 1) // 2]
    at += len(raw)
    qual, tags = d[at : at + l_seq], d[at + l_seq :]
    seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in raw)[:l_seq] or "*"
    shown = "*" if not l_seq or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    other = "=" if mate >= 0 and mate == ref else contig(mate)
    cells = [d[32 : at].split(b"\0", 1)[0].decode(), flag, contig(ref), pos + 1, mapq, "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*", other, mate_pos + 1, length, seq, shown, *_tags(tags)]
    return "\t".join(map(str, cells))


# --- the data source


@dataclass
class Range(InputPartition):
    """Compressed bytes [start, end) of a file, or, with an index, the virtual places from one to before another."""

    file: str
    number: int
    split: int
    start: int
    end: int
    size: int
    chunks: list[tuple[tuple[int, int], tuple[int, int]]] | None = None
    kind: str | None = None


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: list[Range]


#: Tasks that read one source: with short ranges in large files, starting tasks would take the time.
MOST_TASKS = 1000


def kind_of(f, size: int) -> str:
    """bgzf, bcf, bam, ubcf (not zipped), gzip or text, by a file's first bytes and, inside of gzip, by those of its content."""
    f.seek(0)
    head = f.read(18)
    if head[:2] != b"\x1f\x8b":
        return {"bcf": "ubcf", "bam": "bam"}.get(sniff(head), "text")
    inner = sniff((Stream(f, size).take(4) if size > 28 else b"") or b"")
    if not block_size(head):
        return {"bcf": "ubcf", "bam": "ubam"}.get(inner, "gzip")
    return inner if inner in ("bcf", "bam") else "bgzf"


def range_lines(f, kind: str, start: int, end: int, size: int) -> Iterator[str]:
    """The lines of a range of a file; a file that can't be cut belongs to the range at 0, which has header lines too."""
    if kind == "bgzf":
        yield from (x.decode() for x in block_lines(f, start, end, size))
    elif kind in ("bcf", "bam"):
        s = Walk(f, size)
        head, lines, length = opened(s, kind)
        begin = s.tell()  # of the records
        if start == 0:
            yield from head
        if begin is None or begin[0] >= end:
            return
        at = begin if begin[0] >= start else first_record(f, start, end, size, length)
        if at is None:
            return
        s = Walk(f, size, *at)
        more = lines(s)
        while (at := s.tell()) is not None and at[0] < end:
            yield next(more)
    elif start == 0:
        s = Stream(f, size)
        if kind in ("ubcf", "ubam"):
            head, lines, _ = opened(s, kind[1:])
            yield from head
            yield from lines(s)
        else:
            yield from (x.decode() for x in s.lines())


def opened(s: Stream | Walk, kind: str) -> tuple[list[str], Callable[[Stream | Walk], Iterator[str]], Callable[[bytes, int], int | None]]:
    """(header lines, reader of records as lines, what first_record needs) of a BCF or BAM file whose header is read from s."""
    if kind == "bcf":
        text = bcf_header(s)
        return text.split("\n"), lambda w: bcf_records(w, text), bcf_length(text)
    head, names = bam_header(s)
    return head, lambda w: bam_records(w, names), bam_length(names)


def chunk_lines(f, kind: str, size: int, chunks: list[tuple[tuple[int, int], tuple[int, int]]]) -> Iterator[str]:
    """The records that start at virtual places inside of chunks."""
    if kind == "bgzf":
        lines = lambda w: (x.decode() for x in iter(w.line, None))
    else:
        lines = opened(Walk(f, size), kind)[1]
    for begin, end in chunks:
        s = Walk(f, size, *begin)
        more = lines(s)
        while (at := s.tell()) is not None and at < end:
            yield next(more)


class HtsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self):
        """Ranges, or where there are more of them than MOST_TASKS, neighbours together."""
        found = self.ranges()
        n = -(-len(found) // MOST_TASKS)
        return found if n < 2 else [Ranges(found[i : i + n]) for i in range(0, len(found), n)]

    def ranges(self) -> list[Range]:
        """Of all files; the folder is listed once, and files are opened by the tasks alone."""
        _, files = _files(self.path)
        bits = split_bits(len(files))
        out = []
        for n, (name, size) in enumerate(files):
            step = max(self.split, -(-size // ((1 << bits) - 1)))
            out += [Range(name, n, i, at, min(at + step, size), size) for i, at in enumerate(range(0, size, step))]
        return [replace(r, number=r.number << bits | r.split) for r in out]

    def lines(self, partition: Range) -> Iterator[str]:
        fs = _file_system(self.path)
        if fs.get_file_info(partition.file).size != partition.size:
            raise ValueError(f"{partition.file} has changed while it was read")
        with fs.open_input_file(partition.file) as f:
            kind = partition.kind or kind_of(f, partition.size)
            if partition.chunks is not None:
                yield from chunk_lines(f, kind, partition.size, partition.chunks)
            else:
                yield from range_lines(f, kind, partition.start, partition.end, partition.size)

    def read(self, partition: Range | Ranges | None):
        if partition is None:  # what Spark passes where there are no partitions
            return
        if isinstance(partition, Ranges):
            for one in partition.ranges:
                yield from self.read(one)
            return
        first, n, batch, held = partition.number << ROW_BITS, 0, [], 0
        for x in self.lines(partition):
            batch.append(x)
            held += len(x)
            if len(batch) == 10_000 or held > 8 << 20:
                yield self.batch(batch, first + n)
                n, batch, held = n + len(batch), [], 0
        if batch:
            yield self.batch(batch, first + n)

    def batch(self, lines: list[str], first: int) -> pa.RecordBatch:
        return _batch(lines, first)


def _batch(lines: list[str], first: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["_vid", "value"])


def zipped_block(data: bytes, level: int = 6) -> bytes:
    """One block of at most BLOCK bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    if len(body) + 26 > 1 << 16:
        return zipped_block(data, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Part(WriterCommitMessage):
    held: str | None
    final: str | None


class HtsWriter(DataSourceWriter):
    """One file for each task, under a hidden name until all have ended; what lost tasks leave stays hidden, and readers pass over it."""

    def __init__(self, options: dict):
        self.path, self.kind, self.head = options["path"], options["kind"], options["head"]

    def _place(self) -> tuple[pafs.FileSystem, str]:
        path = self.path.removeprefix("file:") if self.path.startswith("file:") else self.path
        return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)

    def write(self, rows):
        from pyspark import TaskContext

        context = TaskContext.get()
        n = context.partitionId()
        fs, at = self._place()
        fs.create_dir(at)
        ending = "bcf" if self.kind in ("b", "u") else "vcf.gz"
        held, final = f"{at}/.part-{n:05d}-{context.taskAttemptId()}", f"{at}/part-{n:05d}.{ending}"
        binary = self.kind in ("b", "u")
        h = VcfHeader.parse(self.head.split("\n"))
        strings, contigs = ({x: i for i, x in enumerate(names)} for names in dictionaries(h))
        lines = 0
        with fs.open_output_stream(held) as out:
            buffer = bytearray()

            def put(data: bytes) -> None:
                if self.kind == "u":
                    out.write(data)
                    return
                buffer.extend(data)
                while len(buffer) >= BLOCK:
                    out.write(zipped_block(bytes(buffer[:BLOCK])))
                    del buffer[:BLOCK]

            if binary:
                head = self.head.encode() + b"\n\0"
                put(b"BCF\2\2" + struct.pack("<I", len(head)) + head)
            elif n == 0:
                put(self.head.encode() + b"\n")
            for row in rows:
                put(encode_record(row.value, h, strings, contigs) if binary else row.value.encode() + b"\n")
                lines += 1
            if self.kind != "u":
                if buffer:
                    out.write(zipped_block(bytes(buffer)))
                out.write(END_BLOCK)
        return Part(held, final if lines or n == 0 else None)

    def commit(self, messages):
        fs, _ = self._place()
        for m in filter(None, messages):
            if m.final:
                fs.move(m.held, m.final)
            else:
                fs.delete_file(m.held)

    def abort(self, messages):
        fs, _ = self._place()
        for m in filter(None, messages):
            if m.held and fs.get_file_info(m.held).is_file:
                fs.delete_file(m.held)


class HtsSource(DataSource):
    """_vid, value: the lines of text, BCF and BAM files, header lines first."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "_vid bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return HtsReader(dict(self.options))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return HtsWriter(dict(self.options))


def read_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """_vid (file order), value: lines of a block-gzipped, gzipped or plain text, BCF or BAM file or folder of such."""
    ship(spark)
    spark.dataSource.register(HtsSource)
    return spark.read.format(NAME).option("path", path).option("split", str(split)).load()


def read_header_lines(path: str, mark: str = "#") -> list[str]:
    """The lines that start with a mark, of the first file that has any lines; read by the driver, which stops at the first other line."""
    fs, files = _files(path)
    for name, size in files:
        with fs.open_input_file(name) as f:
            kind = kind_of(f, size)
            s = Stream(f, size)
            lines = iter(opened(s, kind.lstrip("u"))[0]) if kind.lstrip("u") in ("bcf", "bam") else (x.decode() for x in s.lines())
            out = []
            for x in lines:
                if not x.startswith(mark):
                    return out
                out.append(x)
            if out:
                return out
    return []


def open_variants(spark: SparkSession, path: str, tags: list[str] | None = None, split: int = SPLIT, place: str = "int") -> tuple[DataFrame, VcfHeader]:
    """(variants, header) of VCF text, plain, gzipped or block-gzipped, or of BCF, as the first bytes tell."""
    from .vcf import variants_of

    h = VcfHeader.parse(read_header_lines(path))
    lines = read_lines(spark, path, split).where("not startswith(value, '#') and value <> ''")
    return variants_of(lines, h, tags, place), h


#: Records of a file: a part for each LEAST, up to PARTS for each core, and no more than MOST in one.
LEAST_RECORDS, MOST_RECORDS = 100_000, 500_000


def _file_count(rows: DataFrame) -> int:
    n = rows.count()
    return max(min(n // LEAST_RECORDS, PARTS * rows.sparkSession.sparkContext.defaultParallelism), n // MOST_RECORDS) + 1


def write_variants(df: DataFrame, header: VcfHeader, path: str, mode: str = "z") -> None:
    """A folder of parts in order. Modes: z block-gzipped text, b BCF, u BCF that isn't zipped; v is write_vcf's plain text.

    BCF numbers the contigs and filters of its header, so those that records have and the header lacks are added: these
    are collected, being as few as the contigs of a genome. The folder must not hold parts yet.
    """
    from .vcf import write_vcf

    if mode == "v":
        write_vcf(df, header, path)
        return
    if mode not in ("z", "b", "u"):
        raise ValueError(f"mode {mode} isn't one of v, z, b, u")
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(HtsSource)
    h = VcfHeader.parse(header.lines())
    # The records are made text once, for the names in the header, the bounds of the parts and the parts themselves.
    rows = stored(vcf_lines(df.withColumns({"_chrom": F.col("chrom"), "_filters": F.col("filters")}), h, ["_chrom", "_filters"]), "lines")
    if mode != "z":
        for r in rows.select(F.col("_chrom").alias("chrom")).distinct().orderBy("chrom").collect():
            h.contigs.setdefault(r.chrom, None)
        for r in rows.selectExpr("explode(_filters) as f").distinct().orderBy("f").collect():
            if r.f != "PASS":
                h.filters.setdefault(r.f, "")
    lines = rows.repartitionByRange(_file_count(rows), "_vid").sortWithinPartitions("_vid").select("value")
    lines.write.format(NAME).mode("append").option("path", path).option("kind", mode).option("head", "\n".join(h.lines())).save()
