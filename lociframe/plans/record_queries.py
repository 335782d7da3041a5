"""Queries of record edits, block-gzipped and binary files, alignments and regions near others, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genotypes as gt
from ..operators import intervals as iv
from ..operators import reads as rd
from ..operators import records as rc
from ..operators import relational as rl
from ..scratch import shared_folder
from ..sources import hts, vcf
from ..sources import tables as tb
from .file_queries import _lines
from .table_queries import _C, _MERGE, _set_a, query, table

_D = "(select s_nationkey chrom, s_suppkey * 37 % 997 as s, s_suppkey * 37 % 997 + 9 as e from supplier)"


@query(f"""with m as ({_MERGE.format(_C)}), h as (select m.chrom, "start" ts, greatest(s, "start") s, least(e, "end") e from m join {_D} d on d.chrom = m.chrom and s < "end" and e > "start"),
t as (select m.*, f from m left join (select chrom, ts, min(s) f from h group by 1, 2) x on x.chrom = m.chrom and ts = "start"),
a as (select chrom, s, e from h union all select t.chrom, greatest(s, "start" - 5), e from t join {_D} d on d.chrom = t.chrom and s < "start" and e > greatest("start" - 5, 0) where f is null or f - "start" > 5
 union all select t.chrom, s, least(e, "end" + 5) from t join {_D} d on d.chrom = t.chrom and s < "end" + 5 and e > "end" where f is null)
{_MERGE.format('a')}""")
def jn11_regions_near(spark, d):
    """Suppliers' regions on customers' or at most five beside them."""
    near = table(spark, d, "supplier").select(F.col("s_nationkey").alias("chrom"), (F.col("s_suppkey") * 37 % 997).alias("start"), (F.col("s_suppkey") * 37 % 997 + 9).alias("end"))
    return iv.regions_near(_set_a(spark, d), near, 5)


@query("""with g as (select p_partkey k, p_size z, n, p_partkey % (n + 1) a, p_size % (n + 1) c from part, lateral (select case when p_size % 2 = 0 then 3 else 1 end n) x),
w as (select *, list_sort(list_distinct([0, a, c])) keep, list_sort(list_distinct([0, a, c]))[2:] more from g)
select row_number() over (order by k) as line, concat_ws(chr(9), 'c1', k + 1, coalesce(nullif(concat_ws(';', case when k % 4 = 0 then 'id' || k end, case when k % 3 = 0 then 'rs' || k end), ''), '.'), 'A',
 case when len(more) = 0 then '.' else array_to_string(list_transform(more, lambda i: ['C', 'GT', 'T'][i]), ',') end, case when k % 5 = 0 then z else 7 end,
 case k % 3 when 0 then case when z > 25 then 'q10' else 'PASS' end when 1 then 'LOW' || case when z > 25 then ';q10' else '' end else case when z > 25 then 'q10' else '.' end end,
 case when len(more) = 0 then '' else 'AC=' || array_to_string(list_transform(more, lambda i: k + i), ',') || ';' end || 'RD=' || array_to_string(list_transform(keep, lambda i: k * 10 + i), ','), 'GT:GL:DP:SB',
 (list_position(keep, a) - 1) || '/0:' || array_to_string(flatten(list_transform(keep, lambda j: list_transform(list_filter(keep, lambda i: i <= j), lambda i: k + j * (j + 1) // 2 + i))), ',') || ':' || z || ':x' || (k % 7),
 (list_position(keep, c) - 1) || ':' || array_to_string(list_transform(keep, lambda i: 100 + i), ',') || ':' || (k % 50) || ':.') as value from w""")
def map6_mrg8_mrg12_mrg13_record_edits(spark, d):
    """Alleles that no sample has go, with their values; ids, filters, qualities and samples' values are set."""
    to = shared_folder(spark, "edits")
    p = table(spark, d, "part").selectExpr("p_partkey k", "p_size z", "if(p_size % 2 = 0, 3, 1) n")
    line = """concat_ws('\\t', 'c1', k + 1, if(k % 4 = 0, 'id' || k, '.'), 'A', if(n = 3, 'C,GT,T', 'C'), if(k % 5 = 0, string(z), '.'), element_at(array('PASS', 'LOW;old', '.'), int(k % 3) + 1),
      'AC=' || array_join(transform(sequence(1, n), i -> k + i), ',') || ';RD=' || array_join(transform(sequence(0, n), i -> k * 10 + i), ','), 'GT:GL:DP',
      (k % (n + 1)) || '/0:' || array_join(transform(sequence(0, (n + 1) * (n + 2) div 2 - 1), i -> k + i), ',') || ':' || z, (z % (n + 1)) || ':' || array_join(transform(sequence(0, n), i -> 100 + i), ',') || ':.') as value"""
    head = ["##fileformat=VCFv4.2", vcf.Tag("AC", "A", "Integer").line(), vcf.Tag("RD", "R", "Integer").line(), vcf.Tag("GT").line("FORMAT"), vcf.Tag("GL", "G", "Integer").line("FORMAT"), vcf.Tag("DP", "1", "Integer").line("FORMAT"), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\ttwo"]
    path = _lines(p.selectExpr("k", line), f"{to}/vcf", head, "k")
    header = vcf.read_header(spark, path)
    df = rc.trimmed_alleles(vcf.read_vcf(spark, path, header), header)
    k = F.col("pos") - 1
    df = df.withColumn("id", rc.added_id(F.col("id"), F.when(k % 3 == 0, F.concat(F.lit("rs"), k))))
    filters = rc.removed_filter(F.col("filters"), F.lit("old"))
    df = df.withColumn("filters", filters).join(p.select(F.col("k") + 1, "z").toDF("pos", "_z"), "pos")
    df = df.withColumn("filters", F.when(F.col("_z") > 25, rc.added_filter(F.col("filters"), F.lit("q10"))).otherwise(F.col("filters"))).drop("_z")
    df = rc.with_quality(df, F.lit(7))
    df, header = rc.with_format(df, header, header.format["DP"], F.create_map(F.lit("one"), F.lit(99), F.lit("two"), (k % 50).cast("int")))
    df, header = rc.with_format(df, header, vcf.Tag("SB"), F.create_map(F.lit("one"), F.concat(F.lit("x"), k % 7)))
    return rl.numbered(vcf.vcf_lines(df, header), "_vid", "line").select("line", "value")


@query("""select mode, row_number() over (partition by mode order by p_partkey) as line, concat_ws(chr(9), 'c' || (p_partkey % 3), p_partkey * 2 + 1, case when p_partkey % 4 = 0 then 'id' || p_partkey else '.' end, 'A', case when p_size % 2 = 0 then 'C,GT' else 'C' end, p_size,
 case when p_partkey % 5 = 0 then 'LOW;q10' else '.' end, 'N=' || (p_partkey * 1000) || case when p_partkey % 3 = 0 then ';S=' || lower(p_brand[1:4]) else '' end || case when p_size > 20 then ';F' else '' end, 'GT:DP', (p_partkey % 2) || '/0:' || p_size, '.|1:.') as value
from part, (select unnest(['b', 'z']) as mode) m""")
def src1_src3_src4_snk1_block_files(spark, d):
    """Records written as BCF and as block-gzipped text, told apart by their first bytes and read again, the text by ranges of its blocks."""
    to = shared_folder(spark, "blocks")
    line = """concat_ws('\\t', 'c' || (p_partkey % 3), p_partkey * 2 + 1, if(p_partkey % 4 = 0, 'id' || p_partkey, '.'), 'A', if(p_size % 2 = 0, 'C,GT', 'C'), p_size, if(p_partkey % 5 = 0, 'LOW;q10', '.'),
      'N=' || (p_partkey * 1000) || if(p_partkey % 3 = 0, ';S=' || lower(substr(p_brand, 1, 4)), '') || if(p_size > 20, ';F', ''), 'GT:DP', (p_partkey % 2) || '/0:' || p_size, '.|1:.') as value"""
    head = ["##fileformat=VCFv4.2", vcf.Tag("N", "1", "Integer").line(), vcf.Tag("S").line(), vcf.Tag("F", "0", "Flag").line(), vcf.Tag("GT").line("FORMAT"), vcf.Tag("DP", "1", "Integer").line("FORMAT"), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\ttwo"]
    path = _lines(table(spark, d, "part").selectExpr("p_partkey", line), f"{to}/vcf", head, "p_partkey")
    header = vcf.read_header(spark, path)
    df, out = vcf.read_vcf(spark, path, header), None
    for mode in "bz":
        hts.write_variants(df, header, f"{to}/{mode}", mode)
        again, found = hts.open_variants(spark, f"{to}/{mode}", split=1 << 16)
        lines = rl.numbered(vcf.vcf_lines(again, found), "_vid", "line").select(F.lit(mode).alias("mode"), "line", "value")
        out = lines if out is None else out.union(lines)
    return out


_NAMES = "['" + "', '".join(rd.FLAGS) + "']"


@query(f"""select l_orderkey || '.' || l_linenumber as name, array_to_string(list_transform(list_filter(range(12), lambda i: f & (1 << i) > 0), lambda i: ({_NAMES})[i + 1]), ',') as flags, f as flag, cast(l_quantity as integer) as mismatches,
 'RG:Z:' || lower(l_returnflag) || ',XT:A:U' as tags, 12 + cast(l_quantity as integer) as reference_length, 15 + cast(l_quantity as integer) as query_length from (select *, l_orderkey * 83 % 4096 f from lineitem) x""")
def seq20_read_geometry(spark, d):
    """Flags to names and back, tags read, set and removed, lengths by the CIGAR."""
    to = shared_folder(spark, "reads")
    q = F.col("l_quantity").cast("int")
    line = F.concat_ws("\t", F.concat_ws(".", "l_orderkey", "l_linenumber"), F.col("l_orderkey") * 83 % 4096, F.lit("c1\t100\t60"), F.concat(F.lit("2S10M2D3I"), q, F.lit("M4H")), F.lit("*\t0\t0\t*\t*"), F.concat(F.lit("NM:i:"), q), F.concat(F.lit("RG:Z:"), "l_returnflag"), F.lit("XT:A:U"))
    path = _lines(table(spark, d, "lineitem").select("*", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), line.alias("value")), f"{to}/sam", ["@HD\tVN:1.6"], "o")
    r = tb.read_sam(spark, path, mask=0)
    r = r.withColumn("new", rd.with_tag(rd.without_tag(F.col("tags"), "NM"), "RG", "Z", F.lower(rd.tag_value(F.col("tags"), "RG"))))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("new"), lambda x: F.concat(x["key"], F.lit(":"), x["value"]))), ",")
    flags = rd.flag_text(F.col("flag"))
    return r.select("name", flags.alias("flags"), rd.flag_number(flags).cast("bigint").alias("flag"), rd.tag_value(F.col("tags"), "NM").cast("int").alias("mismatches"), shown.alias("tags"), (F.col("end") - F.col("start")).alias("reference_length"), "query_length")


_READS = """select *, case when l_linenumber < 3 then l_orderkey || '' else l_orderkey || '.' || l_linenumber end as name, l_orderkey % 500 * 10 + l_linenumber * 4 as s, l_orderkey * 10 + l_linenumber as o, l_linenumber % 2 = 1 as cut,
 translate(substr(md5(l_orderkey || ' ' || l_linenumber), 1, 16), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from (select distinct l_orderkey, l_linenumber from lineitem) l"""
#: The bases of each read: with cut 3S5M2D5M1I2M, else 12M4H.
_BASES = f"""with r as ({_READS}), x as (select *, case when not cut then i when i < 5 then i + 3 when i < 7 then null when i < 12 then i + 1 else i + 2 end q from r, (select unnest(range(14)) i) y where cut or i < 12),
b as (select 'c' || (l_orderkey % 3) chrom, s + i pos, o, name, case when q is null then '*' else substr(seq, q + 1, 1) end base, case when q is null then 0 else (q * 7 + l_linenumber * 5) % 60 end quality from x)"""


def _reads(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    r = spark.sql(_READS)
    qual = F.expr("array_join(transform(sequence(0, if(cut, 15, 11)), q -> char(33 + (q * 7 + l_linenumber * 5) % 60)), '')")
    line = F.concat_ws("\t", "name", F.lit(0), F.concat(F.lit("c"), F.col("l_orderkey") % 3), F.col("s") + 1, F.lit(60), F.when(F.col("cut"), "3S5M2D5M1I2M").otherwise("12M4H"), F.lit("*\t0\t0"), F.substr("seq", F.lit(1), F.when(F.col("cut"), 16).otherwise(12)), qual)
    return tb.read_sam(spark, _lines(r.select("o", line.alias("value")), f"{shared_folder(spark, 'pileup')}/sam", ["@HD\tVN:1.6"], "o"))


@query(f"""{_BASES}, m as (select *, count(*) over w2 n, row_number() over w rk, coalesce(lead(base) over w, lag(base) over w) ob, coalesce(lead(quality) over w, lag(quality) over w) oq from b
 window w as (partition by chrom, pos, name order by o), w2 as (partition by chrom, pos, name)),
c as (select *, case when n = 2 and base <> '*' and ob <> '*' then case when base = ob then case when rk = 1 then least(quality + oq, 200) else 0 end when quality > oq or quality = oq and rk = 1 then floor(quality * 0.8) else 0 end else quality end q2 from m),
k as (select *, row_number() over (partition by chrom, pos order by o) place from c)
select chrom, pos, count(*) as depth, string_agg(base, '' order by o) as bases, cast(sum(q2) as bigint) as quality from k where place <= 8 group by 1, 2""")
def seq21_pileup(spark, d):
    """The first eight bases of each place, mates that overlap counted once."""
    return rd.pileup(rd.mate_bases(_reads(spark, d), depth=8), ["chrom", "pos"], depth=8)


@query(f"""{_BASES} select chrom, pos, base, count(*) as count, cast(sum(quality) as bigint) as quality from b join (select distinct 'c' || (o_custkey % 3) chrom, o_custkey * 7 % 5100 pos from orders) p using (chrom, pos) group by 1, 2, 3""")
def jn14_agg8_bases_at_places(spark, d):
    """How often reads have each base at the places of orders; no other place becomes a row."""
    places = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("chrom"), (F.col("o_custkey") * 7 % 5100).alias("pos")).distinct()
    return rd.base_counts(rd.bases_at(places, _reads(spark, d), bin_width=64, columns=("base", "quality")), ["chrom", "pos"])


_CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_TERM = f"(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(e) + (n - j) * ln(1 - e))"


@query(f"""{_BASES}, k as (select chrom, pos, base, greatest(4, least(63, quality)) q, o from b where base in ('A', 'C', 'G', 'T')),
c as (select *, count(*) over (partition by chrom, pos) n, row_number() over (partition by chrom, pos, base order by q desc, o) - 1 as r, power(10, -q / 10.0) e from k),
t as (select *, list_sum(list_transform(range(r, n + 1), lambda j: exp({_TERM}))) reach, list_sum(list_transform(range(r + 1, n + 1), lambda j: exp({_TERM}))) beyond from c),
s as (select chrom, pos, max(n) n, {', '.join(f"sum(case when base = '{x}' then -10 * log10(beyond / reach) else 0 end) s{x}, count(*) filter (base = '{x}') n{x}" for x in gt.BASES)} from t group by 1, 2)
select chrom, pos, n as depth, {', '.join(f'round(greatest(0, ' + (' + '.join(f's{x}' for x in gt.BASES if x not in g) or '0') + ('' if g[0] == g[1] else f' - 4.343 * ({_CHOOSE.format(f"(n{g[0]} + n{g[1]})", f"n{g[1]}")} - (n{g[0]} + n{g[1]}) * ln(2))') + f'), 3) as "{g}"' for g in gt.GENOTYPES)} from s""")
def seq18_genotype_likelihoods(spark, d):
    """The ten genotypes at each place that reads cover, where errors don't depend on each other."""
    g = gt.genotype_likelihoods(rd.all_bases(_reads(spark, d), ("chrom", "pos", "base", "quality", "reverse")), ["chrom", "pos"], dependence=0.0)
    return g.select("chrom", F.col("pos").cast("bigint").alias("pos"), "depth", *[F.round(x, 3).alias(x) for x in gt.GENOTYPES])
