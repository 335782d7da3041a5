"""Large files: records are written by several tasks, and many short ranges are few tasks."""

from pathlib import Path

from lociframe.sources import hts, vcf


def test_records_are_written_in_parts_and_ranges_are_read_together(spark, tmp_path, monkeypatch):
    text = ["##fileformat=VCFv4.2", '##INFO=<ID=N,Number=1,Type=Integer,Description="n">', "##contig=<ID=c1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    text += [f"c1\t{i + 1}\tr{i}\tA\tC\t.\t.\tN={i * 7919 % 1000}" for i in range(3000)]
    (tmp_path / "a.vcf").write_text("\n".join(text) + "\n")
    header = vcf.read_header(spark, str(tmp_path / "a.vcf"))
    monkeypatch.setattr(hts, "LEAST_RECORDS", 500)
    hts.write_variants(vcf.read_vcf(spark, str(tmp_path / "a.vcf"), header).coalesce(1), header, str(tmp_path / "b"), "b")
    assert len(list(Path(tmp_path / "b").glob("part-*"))) == 7
    monkeypatch.setattr(hts, "MOST_TASKS", 4)
    reader = hts.HtsReader({"path": str(tmp_path / "b"), "split": "1000"})
    assert len(reader.ranges()) > 7 and len(reader.partitions()) <= 4
    assert [r for p in reader.partitions() for r in p.ranges] == reader.ranges()
    back, _ = hts.open_variants(spark, str(tmp_path / "b"), split=1000)
    assert [r.id for r in back.orderBy("_vid").select("id").collect()] == [f"r{i}" for i in range(3000)]
