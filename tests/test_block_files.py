"""Block-gzipped text, BCF and BAM: ranges of a file have all its lines once, and what is written is read again."""

import gzip
import random
import struct

import pytest

from lociframe.sources import hts, tables
from lociframe.sources.vcf import Tag, VcfHeader, read_vcf

HEAD = VcfHeader.parse(["##fileformat=VCFv4.2", '##FILTER=<ID=LOW,Description="l">', Tag("N", "1", "Integer").line(), Tag("AF", "A", "Float").line(), Tag("S").line(), Tag("F", "0", "Flag").line(), Tag("GT").line("FORMAT"), Tag("AD", "R", "Integer").line("FORMAT"), Tag("GQ", "1", "Float").line("FORMAT"), Tag("T").line("FORMAT"), "##contig=<ID=c1>", "##contig=<ID=c2>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"])
RECORDS = [
    "c1\t5\trs1\tA\tC\t9.5\tLOW\tN=70000;AF=0.5;S=x y;F\tGT:AD:GQ:T\t0/1:300,2:1.5:ab\t1|1:0,9:2:longer text",
    "c1\t9\t.\tAC\tA,<DEL>\t.\tPASS\tAF=0.25,.;N=-3\tGT:AD\t./2:1,2,3\t0:.",
    "c2\t70001\t.\tG\t.\t0\tLOW;q\t.\tGT\t.|.\t0/0",
    "c2\t70002\t.\t" + "G" * 400 + "\tT\t.\t.\tS=" + "z" * 40 + "\tGT\t0/1\t./.",
]


@pytest.mark.parametrize("sizes", [[0], [1, 0, 5, 70000, 3], [200] * 900, [150_000, 1, 1, 300_000]])
def test_ranges_have_each_line_once(tmp_path, sizes):
    rng = random.Random(len(sizes))
    lines = [bytes(rng.choice(b"acgt\x1f\x8b\x08\x04") for _ in range(n)) for n in sizes]
    for end in (b"\n", b""):
        data = b"\n".join(lines) + end
        parts = [data[i : i + 5000] for i in range(0, len(data), 5000)]
        path = tmp_path / "x.gz"
        path.write_bytes(b"".join(map(hts.zipped_block, parts)) + hts.END_BLOCK)
        assert gzip.decompress(path.read_bytes()) == data
        size = path.stat().st_size
        want = data.split(b"\n")
        want = want[:-1] if not want[-1] else want
        with path.open("rb") as f:
            for step in (1000, 4097, 33_333, size):
                got = [x for at in range(0, size, step) for x in hts.block_lines(f, at, min(at + step, size), size)]
                assert got == want, (step, len(got), len(want))


def test_broken_block_is_an_error(tmp_path):
    path = tmp_path / "x.gz"
    good = hts.zipped_block(b"a\n" * 50)
    path.write_bytes(good + good[:-8] + bytes([good[-8] ^ 1]) + good[-7:])
    with path.open("rb") as f, pytest.raises(ValueError):
        list(hts.block_lines(f, 0, 2 * len(good), 2 * len(good)))


def test_records_survive_binary_form():
    h = HEAD
    h.filters.setdefault("q", "")
    strings, contigs = hts.dictionaries(h)
    text = "\n".join(h.lines())
    assert hts.numbered_names(text) == (dict(enumerate(strings)), dict(enumerate(contigs)))
    for line in RECORDS:
        raw = hts.encode_record(line, h, {x: i for i, x in enumerate(strings)}, {x: i for i, x in enumerate(contigs)})
        a, b = struct.unpack("<II", raw[:8])
        assert hts.decode_record(raw[8 : 8 + a], raw[8 + a : 8 + a + b], dict(enumerate(strings)), dict(enumerate(contigs))) == line


@pytest.mark.parametrize("mode", ["z", "b", "u"])
def test_files_written_and_read(spark, tmp_path, mode):
    plain = tmp_path / "x.vcf"
    rows = [f"c{1 + i // 600}\t{i + 1}\t.\tA\tC\t.\t.\tN={i};AF=0.5\tGT:GQ:AD:T\t0/1:1.5:{i},2:t{i}\t1|1:2:.:u" for i in range(1200)]
    plain.write_text("\n".join([*HEAD.lines(), *rows]) + "\n")
    df = read_vcf(spark, str(plain))
    hts.write_variants(df, HEAD, str(tmp_path / mode), mode)
    back, header = hts.open_variants(spark, str(tmp_path / mode), split=2000)
    assert header.samples == ["a", "b"] and list(header.info) == list(HEAD.info)
    cols = [c for c in df.columns if c != "_vid"]
    assert back.orderBy("_vid").select(cols).collect() == df.orderBy("_vid").select(cols).collect()
    assert not [p for p in (tmp_path / mode).iterdir() if p.name.startswith(".part")]
    with pytest.raises(ValueError):
        hts.write_variants(df, HEAD, str(tmp_path / "n"), "x")


def test_empty_table_still_has_its_header(spark, tmp_path):
    plain = tmp_path / "x.vcf"
    plain.write_text("\n".join(HEAD.lines()) + "\n")
    for mode in "zb":
        hts.write_variants(read_vcf(spark, str(plain)), HEAD, str(tmp_path / mode), mode)
        back, header = hts.open_variants(spark, str(tmp_path / mode))
        assert header.samples == ["a", "b"] and back.count() == 0


def _bam(lines: list[tuple], contigs: list[str]) -> bytes:
    out = b"BAM\1" + struct.pack("<I", 11) + b"@HD\tVN:1.6\n" + struct.pack("<I", len(contigs))
    for c in contigs:
        out += struct.pack("<I", len(c) + 1) + c.encode() + b"\0" + struct.pack("<I", 999)
    for name, flag, ref, pos, mapq, cigar, mate, seq, qual, tags in lines:
        body = struct.pack("<iiBBHHHIiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), mate, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | hts.OPS.index(o)) for n, o in cigar)
        codes = [hts.BASES.index(x) for x in seq] + [0] * (len(seq) % 2)
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        body += (bytes(qual) if qual else b"\xff" * len(seq)) + tags
        out += struct.pack("<I", len(body)) + body
    return out


def test_alignments_of_bam(spark, tmp_path):
    tags = b"NMC\x07" + b"RGZg1\0" + b"XAAq" + b"XBBs\x02\0\0\0\x01\0\xff\xff" + b"XFf" + struct.pack("<f", 1.5)
    data = _bam([("r1", 0, 0, 9, 60, [(3, "M"), (2, "D"), (2, "M")], 0, "ACGTN", [30, 31, 32, 33, 34], tags), ("r2", 4, -1, -1, 0, [], -1, "ACG", None, b"")], ["c1", "c2"])
    path = tmp_path / "x.bam"
    path.write_bytes(b"".join(hts.zipped_block(data[i : i + 50]) for i in range(0, len(data), 50)) + hts.END_BLOCK)
    lines = [r.value for r in hts.read_lines(spark, str(path)).orderBy("_vid").collect()]
    assert lines == ["@HD\tVN:1.6", "r1\t0\tc1\t10\t60\t3M2D2M\t=\t0\t0\tACGTN\t?@ABC\tNM:i:7\tRG:Z:g1\tXA:A:q\tXB:B:s,1,-1\tXF:f:1.5", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*"]
    (r,) = tables.alignments_of(hts.read_lines(spark, str(path))).collect()
    assert (r.start, r.end, r.query_length, r.tags["NM"]) == (9, 16, 5, "i:7")
