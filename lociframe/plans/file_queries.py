"""Queries that go through files: tables become VCF, gene element, FASTA, region and flat files in the shared folder,
which the readers, the annotator and the writers then take. One registered query each, with the same in SQL.

The genes are made from `part`: one of two exons on each contig, in either strand, without stops but the last codon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import motifs
from ..operators import relational as rl
from ..scratch import shared_folder
from ..sources import tables as tb
from ..sources import vcf
from .annotate import annotate, from_tsv, register_annotator, to_tsv, write_tsv
from .table_queries import query, table

# The made genes: exon and coding bounds on the contig, and the transcript's length.
EXONS, CODING, LENGTH = ((3000, 3040), (3060, 3116)), (3006, 3104), 96
_LETTERS = "translate(substr(md5(cast(p_partkey as varchar(20))) || md5(p_partkey || 'x') || md5(p_partkey || 'y'), 1, 96), '0123456789abcdef', 'ACGACGACGACGACGA')"
#: SQL, for both engines: part with its strand, the transcript's 5' untranslated length u and its sequence.
GENES = f"""select p_partkey, p_size, 'k' || p_partkey chrom, 'T' || p_partkey || '.1' tx, 'G' || p_partkey gene, p_size % 2 = 1 minus, case when p_size % 2 = 1 then 12 else 6 end u,
  case when p_size % 2 = 1 then substr(s, 1, 87) || 'TAA' || substr(s, 91) else substr(s, 1, 81) || 'TAA' || substr(s, 85) end seq from (select p_partkey, p_size, {_LETTERS} s from part) x"""


def _genes(spark: SparkSession, d: str) -> DataFrame:
    rl.dealt(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").createOrReplaceTempView("part")
    return spark.sql(GENES)


def _lines(df: DataFrame, path: str, head: list[str], order: str) -> str:
    """A text file: head lines, then column `value` in order."""
    first = df.sparkSession.createDataFrame([(i - (1 << 40), x) for i, x in enumerate(head)], "o bigint, value string")
    first.union(df.select(F.col(order).cast("bigint"), "value")).orderBy("o").select("value").write.text(path)
    return path


def _elements(genes: DataFrame, path: str) -> str:
    """A gene element file with each gene and its transcript, by the writer of such lines."""
    (s1, e1), (s2, e2) = EXONS
    block = lambda *x: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in x])
    common = [F.col("chrom"), F.lit(s1).alias("start"), F.lit(e2).alias("end")]
    more = [F.col("gene"), F.when(F.col("minus"), "-").otherwise("+").alias("strand")]
    none = F.lit(None).cast("int")
    gene = genes.select((2 * F.col("p_partkey")).alias("_ord"), *common, F.col("gene").alias("name"), F.lit("Gene").alias("biotype"), *more, none.alias("cds_start"), none.alias("cds_end"), block((s1, e2)).alias("blocks"), F.lit(None).cast("string").alias("info"))
    rna = genes.select((2 * F.col("p_partkey") + 1).alias("_ord"), *common, F.col("tx").alias("name"), F.lit("mRNA").alias("biotype"), *more, F.lit(CODING[0]).alias("cds_start"), F.lit(CODING[1]).alias("cds_end"), block(*EXONS).alias("blocks"), F.lit(None).cast("string").alias("info"))
    return _lines(tb.gea_lines(gene.union(rna)), path, ["##fileformat=GenomeElementAnnotation_v1.0", "#chrom"], "_ord")


def _variants(df: DataFrame, path: str, info: list[vcf.Tag] = (), values: dict[str, Column] | None = None, more: dict[str, Column] | None = None) -> str:
    """A VCF file by the writer, of columns _vid, chrom, start, ref, alts."""
    more = more or {}
    struct = F.struct(*[v.alias(k) for k, v in (values or {"_none": F.lit(None).cast("string")}).items()])
    rows = df.select("_vid", "chrom", "start", "ref", "alts", more.get("id", F.lit(None).cast("string")).alias("id"), more.get("qual", F.lit(None).cast("float")).alias("qual"), more.get("filters", F.array().cast("array<string>")).alias("filters"), struct.alias("info"), F.create_map().cast("map<string,string>").alias("extra_info"))
    vcf.write_vcf(rows, vcf.VcfHeader().with_tags(list(info)), path)
    return path


_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_LONG = "['Phe','Leu','Ser','Tyr','*','Cys','Trp','Pro','His','Gln','Arg','Ile','Met','Thr','Asn','Lys','Val','Ala','Asp','Glu','Gly'][strpos('FLSY*CWPHQRIMTNKVADEG', {0})]"
_CODON = f"substr('{_AMINO}', 16 * strpos('TCAG', {{0}}[1]) + 4 * strpos('TCAG', {{0}}[2]) + strpos('TCAG', {{0}}[3]) - 20, 1)"


@query(f"""with t as ({GENES}), v as (select *, 3000 + (p_partkey * 7 + j * 29) % 116 g from t, (select unnest([0, 1, 2, 3]) j) js),
p as (select *, g between 3040 and 3059 intron, case when g < 3040 then g - 3000 else g - 3020 end x, case when minus then 3060 - g else g - 3039 end bef, case when minus then g - 3039 else 3060 - g end aft from v),
q as (select *, bef < aft or (bef = aft and not minus) near5, case when minus then 56 else 40 end e1 from p),
a as (select *, case when intron then case when near5 then e1 else e1 + 1 end when minus then 96 - x else x + 1 end n, case when not intron then '' when near5 then '+' || bef else '-' || aft end off, u + 78 c from q),
b as (select *, case when intron then 'A' when minus then translate(seq[n], 'ACGT', 'TGCA') else seq[n] end ref from a),
w as (select *, 'CGTA'[strpos('ACGT', ref)] alt from b),
s as (select *, case when minus then translate(ref, 'ACGT', 'TGCA') else ref end r, case when minus then translate(alt, 'ACGT', 'TGCA') else alt end l, case when n <= u then '-' || (u - n + 1) when n <= c then '' || (n - u) else '*' || (n - c) end || off pos,
  case when n <= u then 'utr5' when n <= c then 'cds' else 'utr3' end kind, (n - u - 1) // 3 k from w),
o as (select *, seq[u + 3 * k + 1 : u + 3 * k + 3] old from s),
m as (select *, old[: (n - u - 1) % 3] || l || old[(n - u - 1) % 3 + 2 :] new from o),
z as (select *, {_CODON.format('old')} ao, {_CODON.format('new')} an from m),
y as (select *, case when intron then 'coding_transcript_intron_variant' when kind = 'utr5' then '5_prime_UTR_exon_variant' when kind = 'utr3' then '3_prime_UTR_exon_variant'
   when ao = an then case when ao = '*' then 'stop_retained_variant' when k = 0 then 'start_retained_variant' else 'synonymous_variant' end
   else case when k = 0 then 'start_loss' when an = '*' then 'stop_gained' when ao = '*' then 'stop_loss' else 'missense_variant' end end con,
  case when intron then case when bef < 3 and near5 then 'splice_donor_variant' when aft < 3 and not near5 then 'splice_acceptor_variant' end
   when g in (3000, 3001, 3002, 3037, 3038, 3039, 3060, 3061, 3062, 3113, 3114, 3115) then 'exonic_splice_region_variant' end splice from z)
select chrom as "CHROM", cast(g + 1 as varchar) as "POS", ref as "REF", alt as "ALT", gene as "Gene", tx as "Transcript", tx || ':c.' || pos || r || '>' || l
 || case when kind = 'cds' and not intron then '(p.' || {_LONG.format('ao')} || (k + 1) || {_LONG.format('an')} || '/p.' || ao || (k + 1) || an || ')' else '' end as "HGVSnom",
 case when intron then tx || ':c.IVS1' || off || r || '>' || l else '.' end as "IVSnom", con || coalesce('+' || splice, '') as "MolecularConsequence", con as "MC1",
 map {{'coding_transcript_intron_variant': 'Intron', '5_prime_UTR_exon_variant': 'UTR5', '3_prime_UTR_exon_variant': 'UTR3', 'stop_retained_variant': 'StopRetained', 'start_retained_variant': 'StartRetained', 'synonymous_variant': 'Synonymous', 'start_loss': 'StartLoss', 'stop_gained': 'Nonsense', 'stop_loss': 'StopLoss', 'missense_variant': 'Missense'}}[con]
 || coalesce('+' || map {{'splice_donor_variant': 'SpliceDonor', 'splice_acceptor_variant': 'SpliceAcceptor', 'exonic_splice_region_variant': 'SpliceSites'}}[splice], '') as "VarType",
 case when intron then 'I1' when (g < 3050) = minus then 'E2' else 'E1' end as "ExonIntron", '25' as "AAlength" from y""")
def csq1_csq2_csq4_csq8_csq11_csq17_agg3_seq3_seq4_src2_src11_src13_src15_src25_single_bases(spark, d):
    """Four bases of each gene changed: in exons, introns and untranslated parts of both strands."""
    genes = _genes(spark, d)
    to = shared_folder(spark, "genes")
    v = genes.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("j"))
    v = v.withColumn("start", (3000 + (F.col("p_partkey") * 7 + F.col("j") * 29) % 116).cast("int"))
    x = F.when(F.col("start") < 3040, F.col("start") - 3000).otherwise(F.col("start") - 3020)
    base = F.when(F.col("minus"), F.translate(F.substr("seq", 96 - x, F.lit(1)), "ACGT", "TGCA")).otherwise(F.substr("seq", x + 1, F.lit(1)))
    v = v.withColumn("ref", F.when(F.col("start").between(3040, 3059), "A").otherwise(base))
    v = v.select((F.col("p_partkey") * 4 + F.col("j")).cast("bigint").alias("_vid"), "chrom", "start", "ref", F.array(F.translate("ref", "ACGT", "CGTA")).alias("alts"))
    fasta = _lines(genes.select("p_partkey", F.concat(F.lit(">"), "tx", F.lit(" made\n"), F.substr("seq", F.lit(1), F.lit(50)), F.lit("\n"), F.substr("seq", F.lit(51))).alias("value")), f"{to}/tx", [], "p_partkey")
    tags = "HGVSnom,IVSnom,Gene,Transcript,VarType,MolecularConsequence,MC1,ExonIntron,AAlength"
    config = f'{{ /* */ "hgvs": {{"gene_data": "{_elements(genes, f"{to}/gea")}", "refseq": "{fasta}", "columns": "{tags}"}}, }}'.replace("/* */", "# the genes\n")
    df, header = annotate(spark, _variants(v, f"{to}/vcf"), config)
    return to_tsv(df, header, f"CHROM,POS,REF,ALT,{tags}")


@query(f"""with t as ({GENES}), v as (select *, (p_partkey * 37 + j * 4999) % 20000 g from t, (select unnest([0, 1, 2, 3]) j) js),
w as (select *, case when g < 3000 then 3000 - g when g >= 3116 then g - 3116 end away, case when g < 3000 then minus when g >= 3116 then not minus end down from v)
select chrom as "CHROM", cast(g + 1 as varchar) as "POS", case when away > 10000 then '.' else gene end as "Gene",
 case when away > 10000 then 'intergenic_variant' when down then 'downstream_' || case when away <= 1000 then '1K' else '10K' end || '_of_gene' else 'upstream_' || case when away <= 1000 then '1K' else '10K' end || '_of_gene' end as "MolecularConsequence",
 case when away > 10000 then 'Intergenic' when down then 'Downstream' || case when away <= 1000 then '1K' else '10K' end else 'Upstream' || case when away <= 1000 then '1K' else '10K' end end as "VarType",
 case when away > 10000 then '.' when down then cast(away as varchar) else cast(-away as varchar) end as "TSSdistance" from w where away is not null""")
def csq10_csq14_csq18_jn4_intergenic(spark, d):
    """Bases beside each gene, near and far."""
    genes = _genes(spark, d)
    to = shared_folder(spark, "genes")
    v = genes.select("p_partkey", "chrom", F.explode(F.array(*map(F.lit, range(4)))).alias("j")).withColumn("start", ((F.col("p_partkey") * 37 + F.col("j") * 4999) % 20000).cast("int"))
    v = v.where("start < 3000 or start >= 3116").select((F.col("p_partkey") * 4 + F.col("j")).cast("bigint").alias("_vid"), "chrom", "start", F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alts"))
    df, header = annotate(spark, _variants(v, f"{to}/vcf"), f'{{"mc": {{"gene_data": "{_elements(genes, f"{to}/gea")}", "columns": "Gene,MolecularConsequence,VarType,TSSdistance"}}}}')
    return to_tsv(df, header, "CHROM,POS,Gene,MolecularConsequence,VarType,TSSdistance")


@query("""with v as (select p_partkey k, ['C', 'G', 'T'][1 : p_size % 3 + 1] a from part), b as (select k, list_reverse(['C', 'G', 'T'])[1 : k % 3 + 1] da from v where k % 4 > 0)
select 'c1' as "CHROM", cast(v.k * 3 + 1 as varchar) as "POS", array_to_string(a, ',') as "ALT", case when v.k % 5 = 0 then 'own' when m then 'rs' || v.k else '.' end as "ID", case when m and v.k % 2 = 0 then 'LOW' else '.' end as "FILTER",
 case when m then array_to_string(list_transform(a, lambda x: coalesce(cast(v.k * 10 + nullif(list_position(da, x), 0) as varchar), '.')), ',') else '.' end as "AC", case when m then 'Yes' else '.' end as "DB"
from (select v.k, a, da, coalesce(len(list_intersect(a, da)) > 0, false) m from v left join b using (k)) v""")
def jn1_map1_mrg4_mrg6_mrg7_prj1_src10_allele_databases(spark, d):
    """ID, FILTER, per-allele counts and a flag from records at the same place with a shared allele."""
    p, to = table(spark, d, "part"), shared_folder(spark, "alleles")
    place = [F.col("p_partkey").cast("bigint").alias("_vid"), F.lit("c1").alias("chrom"), (F.col("p_partkey") * 3).cast("int").alias("start"), F.lit("A").alias("ref")]
    v = p.select(*place, F.slice(F.array(*map(F.lit, "CGT")), F.lit(1), F.col("p_size") % 3 + 1).alias("alts"))
    v = _variants(v, f"{to}/vcf", more={"id": F.when(F.col("_vid") % 5 == 0, "own")})
    b = p.where("p_partkey % 4 > 0").select(*place, F.slice(F.array(*map(F.lit, "TGC")), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int")).alias("alts"))
    tags = [vcf.Tag("AC", "A", "Integer", "count"), vcf.Tag("DB", "0", "Flag", "known")]
    counts = F.transform("alts", lambda x, i: (F.col("_vid") * 10 + i + 1).cast("int"))
    b = _variants(b, f"{to}/db", tags, {"AC": counts, "DB": F.lit(True)}, {"id": F.concat(F.lit("rs"), "_vid"), "filters": F.when(F.col("_vid") % 2 == 0, F.array(F.lit("LOW"))).otherwise(F.array().cast("array<string>"))})
    df, header = annotate(spark, v, f'{{"vcf": [{{"file": "{b}", "columns": "ID,FILTER,AC,INFO/DB,QUAL"}}]}}')
    return to_tsv(df, header, "CHROM,POS,ALT,ID,FILTER,AC,DB")


@query("""with r as (select p_partkey k, p_partkey * 7 s, p_partkey * 7 + p_size e, p_brand b, p_size z from part), v as (select distinct o_orderkey % 14000 x from orders),
h as (select x, b, min(k) k, max(z) z from v join r on s <= x and x < e group by 1, 2)
select 'c1' as "CHROM", cast(x as varchar) as "START", cast(x + 1 as varchar) as "END", coalesce(string_agg(b, ',' order by k), '.') as "BRAND", case when count(b) > 0 then 'Yes' else '.' end as "HIT" from v left join h using (x) group by x""")
def src8_src9_agg1_mrg9_prj2_prj4_region_databases(spark, d):
    """Tags of the regions that contain each variant, from a region file with its own header, all of its columns by default."""
    to = shared_folder(spark, "regions")
    head = [vcf.Tag("BRAND", "1", "String", "brand").line(), vcf.Tag("HIT", "0", "Flag", "hit").line(), "#chr\tstart\tend\tBRAND\tHIT"]
    r = table(spark, d, "part").select("p_partkey", F.concat_ws("\t", F.lit("c1"), F.col("p_partkey") * 7, F.col("p_partkey") * 7 + F.col("p_size"), "p_brand", F.lit("1")).alias("value"))
    regions = _lines(r, f"{to}/bed", head, "p_partkey")
    v = table(spark, d, "orders").select((F.col("o_orderkey") % 14000).cast("int").alias("start")).distinct()
    v = _variants(v.select(F.col("start").cast("bigint").alias("_vid"), F.lit("c1").alias("chrom"), "start", F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alts")), f"{to}/vcf")
    df, header = annotate(spark, v, f'{{"bed": [{{"file": "{regions}"}}]}}')
    return to_tsv(df, header, "BED,BRAND,HIT")


@query("""select row_number() over (order by p_partkey) as line, 'c' || (p_partkey % 3) || chr(9) || (p_partkey * 2 + 1) || chr(9) || case when p_partkey % 4 = 0 then 'id' || p_partkey else '.' end || chr(9) || 'A' || chr(9) || case when p_size % 2 = 0 then 'C,GT' else 'C' end || chr(9)
|| p_size || chr(9) || case when p_partkey % 5 = 0 then 'LOW;q10' else '.' end || chr(9) || 'N=' || p_size || case when p_partkey % 3 = 0 then ';S=' || lower(p_brand[1:4]) else '' end || case when p_size > 20 then ';F' else '' end as value from part""")
def snk1_snk2_snk3_src2_prj8_records(spark, d):
    """Records written, read from all parts of the folder in order, a tag renamed, and printed again."""
    p, to = table(spark, d, "part"), shared_folder(spark, "records")
    v = p.select(F.col("p_partkey").cast("bigint").alias("_vid"), F.concat(F.lit("c"), F.col("p_partkey") % 3).alias("chrom"), (F.col("p_partkey") * 2).cast("int").alias("start"), F.lit("A").alias("ref"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("C"), F.lit("GT"))).otherwise(F.array(F.lit("C"))).alias("alts"), "p_size", "p_brand", "p_partkey")
    tags = [vcf.Tag("NUM", "1", "Integer", "n"), vcf.Tag("S", "1", "String", "s"), vcf.Tag("F", "0", "Flag", "f")]
    values = {"NUM": F.col("p_size").cast("int"), "S": F.when(F.col("p_partkey") % 3 == 0, F.lower(F.substr("p_brand", F.lit(1), F.lit(4)))), "F": F.col("p_size") > 20}
    more = {"id": F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("id"), "p_partkey")), "qual": F.col("p_size").cast("float"), "filters": F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("LOW"), F.lit("q10"))).otherwise(F.array().cast("array<string>"))}
    path = _variants(v, f"{to}/vcf", tags, values, more)
    header = vcf.read_header(spark, path)
    df, header = vcf.rename_tags(vcf.read_vcf(spark, path, header), header, {"INFO/NUM": "N"})
    vcf.write_vcf(df, header, f"{to}/again")
    again = vcf.with_order(spark.read.text(f"{to}/again").where("not startswith(value, '#')"))
    return rl.numbered(again, "_vid", "line").select("line", "value")


@query("""with f as (select p_partkey k, 1 + p_partkey % 60 p, upper(translate(substr(md5('g' || p_partkey % 7) || md5('h' || p_partkey % 7), 1, 64), '0123456789abcdef', 'ACGTACGTACGTACGT')) s, p_partkey % 7 c, p_size from part)
select 's' || c as "CHROM", cast(case when k % 4 = 1 then p - 1 else p end as varchar) as "POS", case when k % 4 = 1 then substr(s, p - 1, 1) else substr(s, p, 1) end as "REF",
 case k % 4 when 0 then translate(substr(s, p, 1), 'ACGT', 'CGTA') when 1 then substr(s, p - 1, 1) || 'GG' when 2 then translate(substr(s, p, 1), 'ACGT', 'CGTA') else '.' end as "ALT", 'a|' || p_size as "NOTE" from f where not (k % 4 = 1 and p = 1)""")
def str5_src22_seq12_flat_table_to_variants(spark, d):
    """A flat table to variants: references fetched or verified, insertions anchored, the other strand turned."""
    to = shared_folder(spark, "flat")
    seq = "upper(translate(substr(md5('g' || {0}) || md5('h' || {0}), 1, 64), '0123456789abcdef', 'ACGTACGTACGTACGT'))"
    contigs = spark.range(7).selectExpr("id", f"'>s' || id || '\\n' || {seq.format('id')} as value")
    fasta = _lines(contigs, f"{to}/fa", [], "id")
    p = table(spark, d, "part").selectExpr("p_partkey k", "p_size", "1 + p_partkey % 60 p", "p_partkey % 7 c", f"{seq.format('p_partkey % 7')} s").where("not (k % 4 = 1 and p = 1)")
    here, turned = "substr(s, p, 1)", "translate(substr(s, p, 1), 'ACGT', 'TGCA')"
    ref = f"case k % 4 when 0 then lower({here}) when 1 then '.' when 2 then {turned} else {here} end"
    alt = f"case k % 4 when 0 then translate({here}, 'ACGT', 'CGTA') when 1 then 'GG' when 2 then translate(translate({here}, 'ACGT', 'CGTA'), 'ACGT', 'TGCA') else '.' end"
    flat = _lines(p.selectExpr("k", f"concat_ws('\\t', 's' || c, p, {ref}, {alt}, 'a;' || p_size) as value"), f"{to}/tsv", ["#Chr\tpos\tref\talt\tNOTE"], "k")
    tags = tb.read_info_tags([vcf.Tag("NOTE", "1", "String", "n").line()])
    df, header = from_tsv(spark, flat, tags, tb.read_fasta(spark, fasta))
    return to_tsv(df, header, "CHROM,POS,REF,ALT,NOTE")


@query("""select p_brand as name2, 'N' || p_partkey || '.' || (p_size % 3 + 1) as name1, 'c1' as chrom, case when p_size % 2 = 0 then '+' else '-' end as strand, p_partkey * 100 + i * 30 as start, p_partkey * 100 + i * 30 + 20 as "end", case when p_size % 2 = 0 then i + 1 else 3 - i end as exon
from part, (select unnest([0, 1, 2]) i) x where lower(p_brand) = 'brand#11' or p_partkey % 10 = 7""")
def src17_src18_snk6_exp5_gene_predictions(spark, d):
    """Gene predictions in the four dialects, found by gene or transcript, as tables of exons."""
    to, p = shared_folder(spark, "predictions"), table(spark, d, "part")
    text = lambda x: x.cast("string")
    ends = [F.concat(*[F.concat((F.col("p_partkey") * 100 + 30 * i + w).cast("string"), F.lit(",")) for i in range(3)]) for w in (0, 20)]
    cells = {"bin": F.lit("1"), "name1": F.concat(F.lit("N"), "p_partkey", F.lit("."), F.col("p_size") % 3 + 1), "name2": F.col("p_brand"), "chrom": F.lit("c1"), "strand": F.when(F.col("p_size") % 2 == 0, "+").otherwise("-"), "txstart": text(F.col("p_partkey") * 100), "txend": text(F.col("p_partkey") * 100 + 80), "cdsstart": text(F.col("p_partkey") * 100 + 5), "cdsend": text(F.col("p_partkey") * 100 + 75), "exon_count": F.lit("3"), "exonstarts": ends[0], "exonends": ends[1], "score": F.lit("0")}
    out = None
    for i, (dialect, cols) in enumerate(tb.DIALECTS.items()):
        some = p.where(F.col("p_partkey") % 4 == i)
        path = _lines(some.select("p_partkey", F.concat_ws("\t", *[cells[c] for c in cols]).alias("value")), f"{to}/{dialect}", ["#title"], "p_partkey")
        read = tb.read_gene_predictions(spark, path, dialect)
        if dialect == "genePred":  # has no gene names: they are taken from the table again
            read = read.drop("name2").join(some.select(cells["name1"].alias("name1"), F.col("p_brand").alias("name2")), "name1")
        found = tb.find_predictions(read, gene="BRAND#11").union(read.where("name1 rlike '^N[0-9]*7[.]' and lower(name2) <> 'brand#11'"))
        found = tb.exon_table(found).select("name2", "name1", "chrom", "strand", "start", "end", "exon")
        out = found if out is None else out.union(found)
    return out


@query("""select l_orderkey || '.' || l_linenumber as name, l_linenumber * 100 as start, l_linenumber * 100 + 10 + 2 + cast(l_quantity as integer) as "end", 10 + 3 + cast(l_quantity as integer) as query_length
from lineitem where l_returnflag <> 'A' and l_linestatus = 'F' and l_linenumber >= 2""")
def src20_flt10_alignments(spark, d):
    """Alignments from text, with their ends on the contig; failed, duplicate and uncertain ones left out."""
    li, to = table(spark, d, "lineitem"), shared_folder(spark, "reads")
    flag = F.when(F.col("l_returnflag") == "A", 1024).when(F.col("l_linestatus") == "O", 512).otherwise(0)
    line = F.concat_ws("\t", F.concat_ws(".", "l_orderkey", "l_linenumber"), flag, F.lit("c1"), F.col("l_linenumber") * 100 + 1, F.col("l_linenumber") * 10, F.concat(F.lit("10M2D3I"), F.col("l_quantity").cast("int"), F.lit("M")), F.lit("*\t0\t0\tACGT\tIIII"))
    path = _lines(li.select(F.col("l_orderkey").alias("o"), line.alias("value")), f"{to}/sam", ["@HD\tVN:1.6", "@SQ\tSN:c1\tLN:9999"], "o")
    return tb.read_sam(spark, path, least_quality=20).select("name", "start", "end", "query_length")


@query("""select 'c1' as chrom, least(p_partkey * 7, p_partkey * 7 + p_size - 25) as start, greatest(p_partkey * 7, p_partkey * 7 + p_size - 25) as "end", coalesce(t.new, p_type) as kind from part
left join (select p_type old, min_by('t' || p_partkey, p_partkey) as new from part where p_partkey % 3 = 0 group by 1) t on t.old = p_type where p_brand in (select p_brand from part where p_size = 7) and p_size <> 25""")
def src19_src23_src24_snk7_jn7_jn8_small_files(spark, d):
    """Intervals written and read with bounds put right; names looked up in a list file; values in a rename file, the first of which counts."""
    p, to = table(spark, d, "part"), shared_folder(spark, "small")
    p.where("p_size = 7").select(F.concat(F.lit(" "), "p_brand", F.lit("  "))).write.text(f"{to}/names")
    _lines(p.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.translate("p_type", " ", "_"), F.lit("  t"), "p_partkey").alias("value")), f"{to}/rename", ["# old new"], "p_partkey")
    r = p.withColumn("chrom", F.lit("c1")).withColumn("start", F.col("p_partkey") * 7).withColumn("end", F.col("p_partkey") * 7 + F.col("p_size") - 25).where("p_size <> 25")
    tb.write_bed(r, f"{to}/bed", track="parts")
    bounds = tb.read_bed(spark, f"{to}/bed").distinct()
    kept = rl.whitelisted(r, tb.read_names(spark, f"{to}/names"), "p_brand", F.lit(True))
    kept = kept.select(F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"), "chrom", F.translate("p_type", " ", "_").alias("kind"))
    named = rl.renamed_values(kept, "kind", tb.read_rename_table(spark, f"{to}/rename"), "old", "new")
    return named.join(bounds, ["chrom", "start", "end"]).select("chrom", "start", "end", F.translate("kind", "_", " ").alias("kind"))


@query("""select 'c1' as "CHROM", cast(p_partkey as varchar) as "POS", upper(p_brand) as "UP", cast(p_size * 2 as varchar) as "TWICE" from part""")
def udf1_udf2_udf3_snk4_prj3_prj5_modules(spark, d):
    """An annotator of the user's, named in the configuration, and its tags in a flat file, read back."""
    to = shared_folder(spark, "modules")
    v = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("_vid"), F.lit("c1").alias("chrom"), (F.col("p_partkey") - 1).cast("int").alias("start"), F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alts"), "p_brand", "p_size")
    tags = [vcf.Tag("BRAND", "1", "String", "b"), vcf.Tag("SIZE", "1", "Integer", "s")]
    path = _variants(v, f"{to}/vcf", tags, {"BRAND": F.lower("p_brand"), "SIZE": F.col("p_size").cast("int")})
    register_annotator("doubling", lambda df: df.withColumns({"UP": F.upper("info.BRAND"), "TWICE": F.col("info.SIZE") * 2}), [vcf.Tag("UP"), vcf.Tag("TWICE", "1", "Integer")])
    df, header = annotate(spark, path, '{"module": "doubling"}')
    write_tsv(to_tsv(df, header, "CHROM,POS,UP,TWICE"), f"{to}/tsv")
    return tb.read_tsv(spark, f"{to}/tsv").select(F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), "UP", "TWICE")


@query("""with v as (select p_partkey k, case when p_partkey % 25 < 22 then 'chr' || (p_partkey % 25 + 1) when p_partkey % 25 = 22 then 'chrX' when p_partkey % 25 = 23 then 'chrY' else 'chrM' end chrom, p_size % 3 a, p_partkey % 3 b, p_size from part)
select chrom as "CHROM", cast(k + 1 as varchar) as "POS", s as "SAMPLE", case when s = 'two' then b || '|' || a when p_size % 4 = 0 then './' || a else a || '/' || b end as "GT",
 case when s = 'two' then ['A', 'C', 'GT'][b + 1] || '|' || ['A', 'C', 'GT'][a + 1] when p_size % 4 = 0 then './' || ['A', 'C', 'GT'][a + 1] else ['A', 'C', 'GT'][a + 1] || '/' || ['A', 'C', 'GT'][b + 1] end as "TGT",
 case when s = 'two' then '.' else cast(p_size as varchar) end as "DP" from v, (select unnest(['one', 'two']) s) x""")
def prj7_prj9_prj10_exp1_map8_snk4_samples(spark, d):
    """Two of three samples' genotypes and depths as flat rows, contigs in the other style."""
    to = shared_folder(spark, "samples")
    names = F.array(*[F.lit(x) for x in [*map(str, range(1, 23)), "X", "Y", "MT"]])
    a, b, k = F.col("p_size") % 3, F.col("p_partkey") % 3, F.col("p_partkey")
    one = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("./"), a)).otherwise(F.concat_ws("/", a, b))
    line = F.concat_ws("\t", F.get(names, (k % 25).cast("int")), k + 1, F.lit(".\tA\tC,GT\t.\t.\t.\tGT:DP"), F.concat(one, F.lit(":"), "p_size"), F.lit("0/0:1"), F.concat(b, F.lit("|"), a))
    head = ["##fileformat=VCFv4.2", vcf.Tag("GT").line("FORMAT"), vcf.Tag("DP", "1", "Integer").line("FORMAT"), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone\tleft\ttwo"]
    path = _lines(table(spark, d, "part").select("p_partkey", line.alias("value")), f"{to}/vcf", head, "p_partkey")
    header = vcf.read_header(spark, path)
    df, header = vcf.subset_samples(vcf.read_vcf(spark, path, header), header, ["one", "two"])
    df, header = vcf.rename_contigs(df, header, vcf.contig_style("ucsc"))
    return to_tsv(df, header, "CHROM,POS,SAMPLE,GT,TGT,FMT/DP")


@query("""with l as (select 'c' || (p_partkey % 3) chrom, p_partkey pos, p_size from part where p_partkey % 2 = 0), r as (select 'c' || (p_partkey % 3) chrom, p_partkey pos, p_size from part where p_partkey % 3 = 0)
select coalesce(l.chrom, r.chrom) as chrom, cast(coalesce(l.pos, r.pos) - 1 as integer) as start, l.p_size as first, r.p_size as second, 'B,A' as tags from l full join r on l.chrom = r.chrom and l.pos = r.pos
where coalesce(l.chrom, r.chrom) = 'c0' and coalesce(l.pos, r.pos) between 31 and 600 or coalesce(l.chrom, r.chrom) = 'c2' and coalesce(l.pos, r.pos) >= 150""")
def jn9_src5_src26_flt12_prj11_paired_files(spark, d):
    """Two files restricted to regions and paired by site, with one header."""
    p, to = table(spark, d, "part"), shared_folder(spark, "paired")
    sides, headers = [], []
    for n, name, tag in ((2, "first", "B"), (3, "second", "A")):
        v = p.where(F.col("p_partkey") % n == 0).select(F.col("p_partkey").cast("bigint").alias("_vid"), F.concat(F.lit("c"), F.col("p_partkey") % 3).alias("chrom"), (F.col("p_partkey") - 1).cast("int").alias("start"), F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alts"), "p_size")
        path = _variants(v, f"{to}/{name}", [vcf.Tag(tag, "1", "Integer")], {tag: F.col("p_size").cast("int")})
        headers.append(vcf.read_header(spark, path))
        sides.append(vcf.restricted(vcf.read_vcf(spark, path, headers[-1]), ["c0:31-600", "c2:150"]).select("chrom", "start", F.col("info")[tag].alias(name)))
    tags = ",".join(headers[0].merged(headers[1]).info)
    return rl.full_outer_sites(*sides, ["chrom", "start"]).withColumn("tags", F.lit(tags))


@query(f"""with t as ({GENES}) select p_partkey, 'm' || m as motif, i - 1 as at from t, (select unnest([1, 2]) m) ms, (select unnest(range(1, 97)) i) x
where case m when 1 then i <= 93 and regexp_matches(substr(seq, i, 4), '^[AG][CT].G$') else i <= 91 and (substr(seq, i, 1) = 'A')::int + (substr(seq, i + 1, 1) = 'C')::int + (substr(seq, i + 2, 1) = 'G')::int + (substr(seq, i + 3, 1) in ('A', 'C'))::int + (substr(seq, i + 4, 1) = 'A')::int + (substr(seq, i + 5, 1) = 'A')::int >= 6 end""")
def seq15_seq17_motif_scan(spark, d):
    """Where motifs in ambiguity codes stand in each gene's sequence."""
    return motifs.motif_matches(_genes(spark, d).select("p_partkey", "seq"), "seq", {"m1": "RYNG", "m2": "ACGMAA"})


_FIRST = "case substr({0}, i, 1) when 'A' then 1 else 0 end + case substr({0}, i + 1, 1) when 'C' then 2 else 0 end + case substr({0}, i + 2, 1) when 'G' then 3 when 'T' then -1 else 0 end"
_SECOND = "case substr({0}, i, 1) when 'C' then 4 when 'T' then 2 else 0 end + case substr({0}, i + 1, 1) when 'A' then 3 when 'G' then 1 else 0 end"
_BEST = "list_max(list_transform(range(1, {1}), lambda i: {0}))"


@query(f"""with t as ({GENES}), s as (select p_partkey, seq[1:24] a, seq[1:11] || translate(seq[12:12], 'ACGT', 'TGCA') || seq[13:24] b from t),
c as (select p_partkey, {_BEST.format(_FIRST.format('b'), 23)} - {_BEST.format(_FIRST.format('a'), 23)} x, {_BEST.format(_SECOND.format('b'), 24)} - {_BEST.format(_SECOND.format('a'), 24)} y from s)
select p_partkey, case when abs(x) >= abs(y) then 'first' else 'second' end as matrix, cast(case when abs(x) >= abs(y) then x else y end as double) as change from c""")
def jn15_agg10_src21_seq16_matrix_changes(spark, d):
    """The weight matrix of a file whose best score a changed base alters most."""
    to = shared_folder(spark, "matrices")
    path = _lines(spark.createDataFrame([(1, ">second\n0 4 0 2\n3 0 1 0\n>first x\n1 0 0 0\n0 2 0 0\n0 0 3 -1")], "o int, value string"), f"{to}/pwm", [], "o")
    s = _genes(spark, d).selectExpr("p_partkey", "substr(seq, 1, 24) a", "substr(seq, 1, 11) || translate(substr(seq, 12, 1), 'ACGT', 'TGCA') || substr(seq, 13, 12) b")
    return motifs.matrix_changes(s, "a", "b", tb.read_matrices(spark, path)).drop("a", "b")


@query("""with s as (select c, string_agg(translate(md5('f' || c || '.' || i), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' order by i) seq from (select unnest(range(5)) c) cs, (select unnest(range(4000)) i) x group by c),
v as (select distinct o_orderkey % 5 c, o_orderkey * 7919 % 128000 g from orders)
select 's' || c as "CHROM", cast(g + 1 as varchar) as "POS", case when g < 10 or g + 11 > 128000 then '.' else substr(seq, g - 9, 10) || '.' || substr(seq, g + 2, 10) end as "FLKSEQ" from v join s using (c)""")
def jn6_seq11_src16_flanking_bases(spark, d):
    """Ten bases on either side of each variant, from stretches of contigs of 128,000 bases."""
    to = shared_folder(spark, "contigs")
    contigs = spark.range(5).selectExpr("id", "'>s' || id || '\\n' || array_join(transform(sequence(0, 3999), i -> translate(md5('f' || id || '.' || i), '0123456789abcdef', 'ACGTACGTACGTACGT')), '\\n') as value")
    fasta = _lines(contigs, f"{to}/fa", [], "id")
    v = table(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_orderkey") % 5).alias("chrom"), (F.col("o_orderkey") * 7919 % 128000).cast("int").alias("start")).distinct()
    v = _variants(v.select(F.xxhash64("chrom", "start").alias("_vid"), "chrom", "start", F.lit("N").alias("ref"), F.array(F.lit("C")).alias("alts")), f"{to}/vcf")
    df, header = annotate(spark, v, f'{{"ref": "{fasta}"}}', flank=True)
    return to_tsv(df, header, "CHROM,POS,FLKSEQ")
