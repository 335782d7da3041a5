"""Queries that read regions of files by index, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rl
from ..scratch import shared_folder, stored
from ..sources import hts, regions, vcf
from .table_queries import query, table


def _orders(spark, d, to: str) -> tuple[str, vcf.VcfHeader]:
    """Orders as variants of three contigs in order of their places, some long, as block-gzipped text or BCF parts."""
    o = table(spark, d, "orders").selectExpr("o_orderkey k", "concat('c', o_orderkey % 3 + 1) chrom", "o_orderkey * 40L start", "if(o_orderkey % 101 = 0, 30000, 1) span", "cast(o_totalprice as int) price")
    line = "concat_ws('\\t', chrom, start + 1, 'o' || k, 'A', 'C', '.', '.', if(span > 1, 'END=' || (start + span) || ';', '') || 'N=' || price) as value"
    head = ["##fileformat=VCFv4.2", vcf.Tag("END", "1", "Integer").line(), vcf.Tag("N", "1", "Integer").line(), "##contig=<ID=c1>", "##contig=<ID=c2>", "##contig=<ID=c3>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    first = spark.createDataFrame([(i, x) for i, x in enumerate(head)], "o bigint, value string")
    rows = o.selectExpr("(k % 3 + 1) * 100000000000 + k as o", line)
    first.union(rows).orderBy("o").select("value").write.text(f"{to}/vcf")
    header = vcf.read_header(spark, f"{to}/vcf")
    return f"{to}/vcf", header


#: One per cent of a contig, two regions that overlap, and the end of another contig.
ASKED = ["c2:100,001-102,000", "c1:20,001-60,000", "c1:50,001-90,000", "c3:200000-"]
_OVER = """select o_orderkey k, 'c' || (o_orderkey % 3 + 1) chrom, o_orderkey * 40 as s, o_orderkey * 40 + case when o_orderkey % 101 = 0 then 30000 else 1 end as e, cast(trunc(o_totalprice) as int) price from orders"""


@query(f"""with o as ({_OVER}) select mode, 'o' || k as id, chrom, s + 1 as pos, price as n from o, (select unnest(['b', 'z']) as mode) m
where (chrom = 'c2' and e > 100000 and s < 102000) or (chrom = 'c1' and e > 20000 and s < 90000) or (chrom = 'c3' and e > 199999)""")
def src5_src6_snk9_region_reads(spark, d):
    """Regions of BCF and of block-gzipped text by the indexes that were built beside them."""
    to = shared_folder(spark, "regions")
    path, header = _orders(spark, d, to)
    df, out = vcf.read_vcf(spark, path, header, place="bigint"), None
    for mode in "bz":
        hts.write_variants(df, header, f"{to}/{mode}", mode)
        regions.write_indexes(spark, f"{to}/{mode}")
        found, _ = regions.open_regions(spark, f"{to}/{mode}", ASKED, place="bigint")
        rows = found.select(F.lit(mode).alias("mode"), "id", "chrom", F.col("pos").cast("bigint").alias("pos"), F.col("info.N").alias("n"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"""with o as ({_OVER}) select row_number() over (order by chrom, k) as line, 'o' || k as id, price as n from o""")
def src3_bcf_by_ranges(spark, d):
    """A BCF file that many tasks read, each a range of its bytes, in the file's order."""
    to = shared_folder(spark, "ranges")
    path, header = _orders(spark, d, to)
    hts.write_variants(vcf.read_vcf(spark, path, header, place="bigint"), header, f"{to}/b", "b")
    back, _ = hts.open_variants(spark, f"{to}/b", split=1 << 14)
    # Decoded once: numbering looks at the rows more than once.
    return rl.numbered(stored(back.selectExpr("_vid", "id", "info.N as n"), "decoded"), "_vid", "line").select("line", "id", "n")
