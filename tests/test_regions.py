"""Binary files cut among tasks, and regions read by index: the same records as a whole read has, from few bytes."""

import random
import struct

import pytest

from lociframe.sources import hts, regions, tables
from lociframe.sources.vcf import VcfHeader, read_vcf, restricted

HEAD = ["##fileformat=VCFv4.2", '##INFO=<ID=END,Number=1,Type=Integer,Description="e">', '##INFO=<ID=S,Number=1,Type=String,Description="s">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="g">', "##contig=<ID=c1>", "##contig=<ID=c2>", "##contig=<ID=c3>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"]


def zipped(data: bytes, rng: random.Random, most: int = 3000) -> bytes:
    """Blocks whose borders fall anywhere, empty ones among them."""
    out, at = [], 0
    while at < len(data):
        n = rng.choice([0, 1, rng.randint(1, most), most])
        out.append(hts.zipped_block(data[at : at + n]))
        at += n
    return b"".join(out) + hts.END_BLOCK


def bam(rng: random.Random, n: int) -> bytes:
    out = b"BAM\1" + struct.pack("<I", 11) + b"@HD\tVN:1.6\n" + struct.pack("<I", 3) + b"".join(struct.pack("<I", 3) + f"c{i}".encode() + b"\0" + struct.pack("<I", 1 << 20) for i in (1, 2, 3))
    for i in range(n):
        name, k = f"read{i}".encode(), rng.choice([0, 1, 5, 90, 700])
        ops = [(k, "M")] if k else []
        body = struct.pack("<iiBBHHHIiii", 3 * i // n, i * 37, len(name) + 1, 60, 0, len(ops), 0, k, -1, -1, 0) + name + b"\0" + b"".join(struct.pack("<I", m << 4 | hts.OPS.index(o)) for m, o in ops)
        body += bytes(rng.choice([0, 255, rng.randrange(256)]) for _ in range((k + 1) // 2)) + bytes(rng.randrange(40) for _ in range(k)) + (b"NMi" + struct.pack("<i", i) if i % 2 else b"")
        out += struct.pack("<I", len(body)) + body
    return out


def bcf(rng: random.Random, n: int) -> bytes:
    h = VcfHeader.parse(HEAD)
    strings, contigs = ({x: i for i, x in enumerate(names)} for names in hts.dictionaries(h))
    text = "\n".join(h.lines()).encode() + b"\n\0"
    line = lambda i: f"c{1 + 3 * i // n}\t{i * 11 + 1}\t.\tA\tC\t.\t.\tS={'z' * rng.choice([0, 3, 900]) or 'q'}\tGT\t0/1\t.|1"
    return b"BCF\2\2" + struct.pack("<I", len(text)) + text + b"".join(hts.encode_record(line(i), h, strings, contigs) for i in range(n))


@pytest.mark.parametrize("make, kind", [(bam, "bam"), (bcf, "bcf")])
def test_binary_ranges_have_each_record_once(tmp_path, make, kind):
    for seed in range(12):
        rng = random.Random(seed)
        raw = make(rng, rng.choice([0, 1, 7, 400]))
        path = tmp_path / f"{seed}.{kind}"
        path.write_bytes(zipped(raw, rng))
        size = path.stat().st_size
        with path.open("rb") as f:
            assert hts.kind_of(f, size) == kind
            want = list(hts.range_lines(f, kind, 0, size, size))
            s = hts.Stream(f, size)
            head, records, _ = hts.opened(s, kind)
            assert want == [*head, *records(s)]
            for step in (101, 997, 5000, 40_000):
                got = [x for at in range(0, size, step) for x in hts.range_lines(f, kind, at, min(at + step, size), size)]
                assert got == want, (seed, step)


def test_one_file_by_eight_tasks(spark, tmp_path):
    rng = random.Random(3)
    (tmp_path / "x.bam").write_bytes(zipped(bam(rng, 3000), rng))
    split = -(-(tmp_path / "x.bam").stat().st_size // 8)
    lines = hts.read_lines(spark, str(tmp_path), split=split)
    assert lines.rdd.getNumPartitions() == 8
    got = [r.value for r in lines.orderBy("_vid").collect()]
    assert got == [r.value for r in hts.read_lines(spark, str(tmp_path)).orderBy("_vid").collect()] and len(got) == 3001


def test_bins():
    rng = random.Random(4)
    for _ in range(3000):
        a = rng.randrange(1 << rng.choice([10, 20, 31]))
        b = a + rng.randrange(1, 1 << rng.choice([3, 14, 20, 30]))
        x = rng.randrange(a, b)
        y = x + rng.randrange(1, 1 << rng.choice([2, 16, 24]))
        assert any(regions.bin_of(a, b) in r for r in regions.bins_over(x, y, regions.DEPTH))
        assert regions._bin_begin(regions.bin_of(a, b), regions.DEPTH) <= a


def records(rng: random.Random, n: int) -> list[str]:
    out = []
    for c in ("c1", "c2", "c3"):
        for pos in sorted(rng.randrange(1, 3_000_000) for _ in range(n)):
            end = f"END={pos + rng.randrange(200_000)};" if rng.random() < 0.01 else ""
            out.append(f"{c}\t{pos}\t.\t{'A' * rng.choice([1, 1, 7])}\tC\t.\t.\t{end}S={rng.randrange(10**9)}\tGT\t0/1\t1/1")
    return out


class Counted:
    """A file that counts what is read of it."""

    total = 0

    def __init__(self, f):
        self.f = f

    def __enter__(self):
        return self

    def __exit__(self, *x):
        self.f.close()

    def seek(self, at):
        self.f.seek(at)

    def read(self, n):
        data = self.f.read(n)
        Counted.total += len(data)
        return data


@pytest.mark.parametrize("mode", ["z", "b"])
def test_regions_by_index(spark, tmp_path, monkeypatch, mode):
    rng = random.Random(5)
    plain = tmp_path / "x.vcf"
    plain.write_text("\n".join([*HEAD, *records(rng, 40_000)]) + "\n")
    df = read_vcf(spark, str(plain))
    hts.write_variants(df.coalesce(1), VcfHeader.parse(HEAD), str(tmp_path / mode), mode)
    to = str(tmp_path / mode)
    cols = ["chrom", "pos", "ref", "alts", "info"]
    asked = ["c2:1,000,001-1,030,000", "c2:1,020,000-1,040,000", "c3", "c1:2999000-", "nowhere:1-5"]
    want = sorted(map(str, restricted(df, asked).select(cols).collect()))
    unindexed, _ = regions.open_regions(spark, to, asked, split=300_000)
    assert sorted(map(str, unindexed.select(cols).collect())) == want
    n = regions.write_indexes(spark, to)
    assert n == len([p for p in (tmp_path / mode).iterdir() if p.name.endswith(".csi")]) > 0
    assert [p.name for p in (tmp_path / mode).iterdir() if p.name.startswith(".part")] == []
    got, _ = regions.open_regions(spark, to, asked)
    rows = got.select("_vid", *cols).collect()
    assert sorted(str(r).replace(f"_vid={r._vid}, ", "") for r in rows) == want and len({r._vid for r in rows}) == len(rows)
    # What a task of one per cent of a contig reads.
    system = hts._file_system(to)

    class Fs:
        get_file_info = staticmethod(system.get_file_info)
        open_input_file = staticmethod(lambda name: Counted(system.open_input_file(name)))

    monkeypatch.setattr(hts, "_file_system", lambda path: Fs)
    reader = regions.RegionReader({"path": to})
    from pyspark.sql import datasource as ds

    pushed = [ds.EqualTo(("chrom",), "c2"), ds.GreaterThan(("end",), 1_000_000), ds.LessThan(("start",), 1_030_000)]
    assert list(reader.pushFilters(pushed)) == pushed
    parts = reader.partitions()
    Counted.total = 0
    lines = [x for p in parts for x in reader.lines(p)]
    size = sum(p.stat().st_size for p in (tmp_path / mode).iterdir() if p.name.startswith("part") and not p.name.endswith(".csi"))
    assert 0 < Counted.total < 0.05 * size
    assert {x for x in lines if (c := regions.variant_place(x))[0] == "c2" and c[2] > 1_000_000 and c[1] < 1_030_000} == {x for x in plain.read_text().split("\n") if x.startswith("c2\t") and (c := regions.variant_place(x)) and c[2] > 1_000_000 and c[1] < 1_030_000}


def test_records_out_of_order_get_no_index():
    for places in ([("c1", 5), ("c1", 4)], [("c1", 5), ("c2", 1), ("c1", 6)]):
        with pytest.raises(ValueError):
            regions.Index.build(iter([((c, p, p + 1), i, i + 1) for i, (c, p) in enumerate(places)]), None)


def test_alignments_over_regions(spark, tmp_path):
    rng = random.Random(6)
    (tmp_path / "x.bam").write_bytes(zipped(bam(rng, 2000), rng))
    whole = tables.alignments_of(hts.read_lines(spark, str(tmp_path / "x.bam")))
    want = sorted(r.name for r in restricted(whole, ["c2:30,001-34,000"]).collect())
    for _ in range(2):
        lines = regions.lines_over(spark, str(tmp_path / "x.bam"), ["c2:30,001-34,000"], "alignments")
        assert sorted(r.name for r in tables.alignments_of(lines).collect()) == want and want
        assert regions.write_indexes(spark, str(tmp_path / "x.bam")) == 1
    with (tmp_path / "x.bam.csi").open("rb") as f:
        again = regions.Index.unpack(f, (tmp_path / "x.bam.csi").stat().st_size, ["c1", "c2", "c3"])
    with (tmp_path / "x.bam").open("rb") as f:
        size = (tmp_path / "x.bam").stat().st_size
        built = regions.Index.build(*regions.indexed_records(f, size, "bam"))
    assert again.contigs == built.contigs and not again.text
