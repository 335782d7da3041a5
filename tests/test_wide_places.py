"""Places over 2^31, which orders reach at some 54 million keys."""

import duckdb
import pytest

from lociframe.plans import region_queries  # noqa: F401
from lociframe.plans.table_queries import ORACLES, QUERIES
from lociframe.sources import hts, regions
from lociframe.sources.vcf import VcfHeader


@pytest.mark.parametrize("name", ["src5_src6_snk9_region_reads", "src3_bcf_by_ranges"])
def test_orders_over_32_bits(spark, tmp_path, name):
    con = duckdb.connect()
    keys = "select unnest(range(2400, 2700)) k union all select unnest(range(53687000, 53687400)) union all select unnest(range(107374100, 107374300)) union all select unnest(range(5000000000, 5000000100))"
    con.sql(f"create table orders as select cast(k as bigint) o_orderkey, cast(k % 1000 as double) + 0.5 o_totalprice from ({keys})")
    con.sql(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_records_and_bins_of_wide_places():
    h = VcfHeader.parse(['##INFO=<ID=END,Number=1,Type=Integer,Description="e">', "##contig=<ID=c1>"])
    for start in (-1, 5, (1 << 31) - 2, (1 << 31) - 1, 1 << 31, 1 << 40):
        line = f"c1\t{start + 1}\tr\tA\tC\t.\t.\tEND={start + 30_000}"
        raw = hts.encode_record(line, h, {"PASS": 0, "END": 1}, {"c1": 0})
        a = int.from_bytes(raw[:4], "little")
        assert hts.decode_record(raw[8 : 8 + a], b"", {0: "PASS", 1: "END"}, {0: "c1"}) == line
    for begin, end in ((5, 9), ((1 << 32) - 5, (1 << 32) + 5), (1 << 33, (1 << 33) + 1), (1 << 40, 1 << 41)):
        assert any(regions.bin_of(begin, end) in r for r in regions.bins_over(begin, end, regions.DEPTH))
