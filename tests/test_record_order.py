"""Record ids are distinct and in file order whatever the size of splits, and annotation doesn't depend on it."""

import pytest

from lociframe.plans.annotate import annotate
from lociframe.sources import vcf

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"


@pytest.fixture
def sizes(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def put(most, cost="4m"):
        for n, v in zip(names, (most, cost), strict=True):
            spark.conf.set(n, v)

    yield put
    put(*before)


@pytest.mark.parametrize("most, cost", [("64k", "4m"), ("512k", "4m"), ("1m", "64k"), ("128m", "4194304b")])
def test_ids_are_distinct_and_in_order(spark, tmp_path, sizes, most, cost):
    sizes(most, cost)
    for n in (1, 3):
        folder = tmp_path / f"{n}"
        folder.mkdir()
        want = []
        for f in range(n):
            lines = [f"{f}-{i}-" + "x" * (i % 40) for i in range(60_000)]
            (folder / f"part {f}é.txt").write_text("\n".join(lines) + "\n")
            want += lines
        got = vcf.with_order(spark.read.text(str(folder))).select("_vid", "value").orderBy("_vid").collect()
        assert len({r._vid for r in got}) == len(got)
        assert [r.value for r in got] == want


def test_settings_changed_after_the_plan_are_an_error(spark, tmp_path, sizes):
    (tmp_path / "x.txt").write_text("line\n" * 400_000)
    sizes("2m")
    df = vcf.with_order(spark.read.text(str(tmp_path / "x.txt")))
    sizes("64k", "64k")
    with pytest.raises(Exception, match="split settings were changed"):
        df.selectExpr("max(_vid)").collect()


def test_numbers_have_room():
    assert [vcf.split_bits(n) for n in (0, 1, 2, 3, 1 << 16, 1 << 20)] == [30, 30, 29, 28, 14, 10]
    with pytest.raises(ValueError):
        vcf.split_bits((1 << 20) + 1)
    assert [vcf._bytes(x) for x in ("64k", "128MB", "134217728b", "4194304", "1 g")] == [1 << 16, 1 << 27, 1 << 27, 1 << 22, 1 << 30]


def test_annotation_at_any_split_size(spark, tmp_path, sizes):
    (tmp_path / "v.vcf").write_text(HEAD + "".join(f"c1\t{i * 3 + 1}\t.\tA\tC\t.\t.\t.\n" for i in range(60_000)))
    (tmp_path / "r.bed").write_text('##INFO=<ID=TAG,Number=1,Type=String,Description="t">\n#chr\tstart\tend\tTAG\n' + "".join(f"c1\t{i * 30}\t{i * 30 + 30}\tt{i}\n" for i in range(6000)))
    found = []
    for most in ("128m", "512k", "64k"):
        sizes(most)
        df, _ = annotate(spark, str(tmp_path / "v.vcf"), f'{{"bed": [{{"file": "{tmp_path}/r.bed"}}]}}')
        found.append([(r.start, r.info.TAG) for r in df.orderBy("_vid").select("start", "info").collect()])
        assert found[-1] == [(i * 3, f"t{i // 10}") for i in range(60_000)]
