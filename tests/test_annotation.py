"""Annotation end to end, on hand-made tables, and its parts against brute force."""

import random

import numpy as np
import pytest

from lociframe.functions import align
from lociframe.functions.consequence import Transcript, effect, reverse_complement, translate
from lociframe.functions.text import fisher_two_sided
from lociframe.operators import intervals as iv
from lociframe.plans.annotate import annotate, from_tsv, to_tsv, transcript_effects, write_tsv
from lociframe.sources import tables, vcf

HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=LOW,Description="low">
##INFO=<ID=AF,Number=A,Type=Float,Description="f">
##INFO=<ID=DB,Number=0,Type=Flag,Description="d">
##FORMAT=<ID=GT,Number=1,Type=String,Description="g">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">
##contig=<ID=c1,length=400>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tdemo
"""
ROWS = ["c1\t112\t.\tA\tC\t30\tPASS\tAF=0.5;DB\tGT:DP\t0/1:12", "c1\t118\trs1\tG\tC,T\t.\t.\tAF=0.1,0.25;XX=7\tGT:DP\t1|2:.", "c1\t152\t.\tCA\tC\t1.5\tLOW\t.\tGT:DP\t./.:3", "c1\t390\t.\tT\t<NON_REF>\t.\t.\t.\tGT:DP\t0/0:1"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    rng = random.Random(1)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    exons = [(100, 130), (150, 180), (200, 230)]
    tx = "".join(genome[s:e] for s, e in exons)
    put = lambda name, text: (d / name).write_text(text) and str(d / name)
    return {
        "vcf": put("v.vcf", HEADER + "\n".join(ROWS) + "\n"),
        "db": put("d.vcf", HEADER.replace("ID=AF", "ID=DAF") + "c1\t118\trs9\tG\tT,A\t.\t.\tDAF=0.9,0.8\tGT:DP\t0/0:1\nc1\t118\trs10\tG\tC\t.\t.\tDAF=0.7\tGT:DP\t0/0:1\n"),
        "bed": put("b.bed", '##INFO=<ID=BAND,Number=1,Type=String,Description="b">\n#chr\tstart\tend\tBAND\nc1\t100\t112\tp1\nc1\t100\t300\tp2\nc1\t111\t112\tp1\nc1\t112\t113\tp9\n'),
        "gea": put("g.gea", "##fileformat=GenomeElementAnnotation_v1.0\n#chrom\n" + "c1\t90\t240\tG1\tGene\tGEN\t+\t.\t.\t1\t90\t240\t.\nc1\t100\t230\tT1.1\tmRNA\tGEN\t+\t105\t225\t3\t100,150,200\t130,180,230\t.\nc1\t100\t230\tN1\tncRNA\tGEN\t-\t.\t.\t3\t100,150,200\t130,180,230\t.\n"),
        "fa": put("t.fa", f">T1.1 x\n{tx[:50]}\n{tx[50:]}\n"),
        "genome": put("g.fa", f">c1\n{genome}\n"),
        "dir": d,
        "seq": genome,
    }


def test_vcf_round_trip(spark, files):
    h = vcf.read_header(spark, files["vcf"])
    df = vcf.read_vcf(spark, files["vcf"], h)
    rows = df.orderBy("_vid").collect()
    assert (rows[0].start, rows[0].end, rows[0].info.AF, rows[0].info.DB) == (111, 112, [0.5], True)
    assert rows[1].extra_info == {"XX": "7"} and rows[1].samples[0].gt.phased and rows[1].samples[0].fmt.DP is None
    assert rows[2].samples[0].gt.alleles == [None, None] and rows[2].end == 153
    assert [r.value for r in vcf.vcf_lines(df, h).orderBy("_vid").collect()] == ROWS
    out = str(files["dir"] / "out.vcf")
    vcf.write_vcf(df, h, out)
    again = vcf.read_vcf(spark, out, h)
    assert vcf.vcf_lines(again, h).count() == 4 and vcf.read_header(spark, out).lines() == h.lines()
    df2, h2 = vcf.rename_tags(df, h, {"INFO/AF": "FREQ"})
    df2, h2 = vcf.rename_contigs(df2, h2, {"CTG/c1": "chr1"})
    assert vcf.vcf_lines(df2, h2).orderBy("_vid").first().value.startswith("chr1\t112") and "FREQ" in h2.info


def test_annotate_and_flatten(spark, files):
    cfg = f"""{{ // comment with "quotes"
      "hgvs": {{"gene_data": "{files['gea']}", "refseq": "{files['fa']}", "columns": "HGVSnom,Gene,Transcript,VarType,ExonIntron,AAlength,MC1,TSSdistance"}},
      "vcf": [{{"file": "{files['db']}", "columns": "ID,DAF,QUAL"}},], # trailing comma
      "bed": [{{"file": "{files['bed']}"}}], "ref": "{files['genome']}" }}"""
    df, h = annotate(spark, files["vcf"], cfg, flank=True)
    rows = df.orderBy("_vid").collect()
    assert [r.info.BAND for r in rows] == ["p1,p2", "p2", "p2", None]
    assert [r.id for r in rows] == [None, "rs1", None, None]
    assert rows[1].info.DAF[0] is None and rows[1].info.DAF[1:] == pytest.approx([0.9])
    assert rows[0].info.Transcript == ["T1.1|N1"] and rows[0].info.Gene == ["GEN|GEN"]
    assert rows[0].info.FLKSEQ == files["seq"][101:111] + "." + files["seq"][112:122]
    assert {"HGVSnom", "BAND", "DAF", "FLKSEQ"} <= set(h.info)
    t = to_tsv(df, h, "BED,REF,ALT,SAMPLE,GT,TGT,AF,DB,BAND", split="ALT")
    flat = [tuple(r) for r in t.collect()]
    assert flat[0] == ("c1", "111", "112", "A", "A", "demo", "0/1", "A/C", ".", "Yes", "p1,p2")
    assert flat[1][4] == "C" and flat[1][8] == "0.5" and flat[4][8] == "0.25" and len(flat) == 9
    assert to_tsv(df, h, "POS,GT", skip_ref=True).count() == 2 and to_tsv(df, h, "POS", skip_uncovered=True).count() == 3
    write_tsv(t, str(files["dir"] / "flat"))
    with pytest.raises(ValueError):
        to_tsv(df, h, "nothing")


def test_variants_are_parsed_twice_at_most(spark, files):
    cfg = f"""{{"hgvs": {{"gene_data": "{files['gea']}", "refseq": "{files['fa']}", "columns": "HGVSnom,Gene,Transcript,VarType,MC1"}}}}"""
    df, h = annotate(spark, files["vcf"], cfg)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1  # once before, where what genes need is written
    short, _ = annotate(spark, files["vcf"], cfg.replace("HGVSnom,Gene,Transcript,VarType,MC1", "HGVSnom,ExonIntron"))
    assert "nearest" not in short._jdf.queryExecution().analyzed().toString() and [r.info.HGVSnom for r in short.orderBy("_vid").collect()] == [r.info.HGVSnom for r in df.orderBy("_vid").collect()]


def test_indels_move_to_their_last_equal_place(spark):
    from lociframe.plans.annotate import AHEAD, shifted_indels

    import random

    rng = random.Random(8)
    seq = "".join(rng.choice("ACGT") for _ in range(300)) + "CAG" * 20 + "T" * 1500 + "".join(rng.choice("AC") for _ in range(1200)) + "G" * 30
    rows = []
    for i in range(400):
        at = rng.choice([rng.randrange(len(seq)), rng.randrange(295, 380), rng.randrange(1800, 1870)])
        ref = seq[at : at + rng.choice([1, 2, 4])]
        rows.append((i, "c1", at, ref, [ref[:1], ref[:1] + rng.choice(["T", "CAG", "A", "AGC"]) + ref[1:], "<DEL>", "G" + ref]))
    rows.append((900, "c2", 5, "AC", ["A"]))
    got = {(r._vid, r.allele): (r.s_start, r.s_ref, r.s_alt) for r in shifted_indels(spark.createDataFrame(rows, "_vid bigint, chrom string, start int, ref string, alts array<string>"), spark.createDataFrame([("c1", seq)], "name string, seq string"), chunk=512).collect()}
    from lociframe.functions.consequence import trimmed

    want = {}
    for vid, chrom, at, ref, alts in rows:
        for k, alt in enumerate(alts):
            s, r, a = trimmed(at, ref, alt) if alt[0] != "<" else (0, "A", "C")
            ahead = seq[s : s + AHEAD] if chrom == "c1" else ""
            if (len(r) == len(a) == 1) or (not r and not a) or len(ahead) < AHEAD:
                continue
            after, i = a + ahead[len(r) :], 0
            while i < min(len(ahead), len(after)) and ahead[i] == after[i]:
                i += 1
            if i:
                want[vid, k] = (s + i, ahead[i : i + len(r)], after[i : i + len(a)])
    assert got == want and len(want) > 100


def test_binding_sites(spark, tmp_path):
    rows = ["c1\t10\t20\ts1\tTFBS", "c1\t12\t15\ts2\tTFBS", "c1\t100\t110\tG\tGene", "c1\t104\t106\ts3\tTFBS", "c9\t5\t9\ts4\tTFBS"]
    (tmp_path / "e.gea").write_text("##fileformat=GenomeElementAnnotation_v1.0\n#chrom\n" + "".join("\t".join([*r.split("\t"), "g", "+", ".", ".", "1", r.split("\t")[1], r.split("\t")[2], "."]) + "\n" for r in rows))
    v = [("c1", 12, "A", "C,<DEL>,T"), ("c1", 10, "A" * 12, "A"), ("c1", 11, "ACGT", "AA"), ("c1", 105, "A", "G"), ("c9", 4, "AAAAAA", "A"), ("c9", 30000, "A", "C")]
    (tmp_path / "v.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n" + "".join(f"{c}\t{p}\t.\t{r}\t{a}\t.\t.\t.\n" for c, p, r, a in v))
    df, _ = annotate(spark, str(tmp_path / "v.vcf"), f'{{"hgvs": {{"gene_data": "{tmp_path}/e.gea", "columns": "MolecularConsequence,VarType"}}}}')
    got = [(r.info.MolecularConsequence, r.info.VarType) for r in df.orderBy("_vid").collect()]
    # Near a gene (c1) its terms come first, inside of one intragenic does; apart from all (c9) the site's own.
    assert got[0][0] == ["upstream_1K_of_gene"] * 3 and got[3] == (["intragenic_variant"], ["Intragenic"])
    assert got[4] == (["TFBS_ablation"], ["TFBS"]) and got[5] == (["intergenic_variant"], ["Intergenic"])
    from lociframe.plans.annotate import binding_site_effects
    from lociframe.sources.tables import read_gea
    from lociframe.sources.vcf import read_vcf

    found = binding_site_effects(read_vcf(spark, str(tmp_path / "v.vcf")), read_gea(spark, str(tmp_path / "e.gea"))).join(read_vcf(spark, str(tmp_path / "v.vcf")), "_vid")
    assert sorted((r.pos, r.allele, r.site) for r in found.collect() if r.chrom == "c1") == [(10, 0, "TFBS_ablation"), (11, 0, "TFBS_variant"), (12, 0, "TFBS_variant"), (12, 2, "TFBS_variant"), (105, 0, "TFBS_variant")]


def test_from_tsv(spark, files):
    g = files["seq"]
    other = reverse_complement(g[19])
    rows = [f"c1\t11\t{g[10]}\tA\tx;y", "c1\t31\t.\tGG\t.", f"c1\t20\t{other}\t{reverse_complement('ACGT'[('ACGT'.index(g[19]) + 1) % 4])}\tz", "c1\tbad\tA\tC\t.", f"c1\t41\t{g[40:43]}\t.\tq"]
    p = files["dir"] / "t.tsv"
    p.write_text("#Chr\tpos\tref\talt\tNOTE\n" + "\n".join(rows) + "\n")
    tags = tables.read_info_tags(['##INFO=<ID=NOTE,Number=1,Type=String,Description="n">'])
    df, h = from_tsv(spark, str(p), tags, tables.read_fasta(spark, files["genome"]))
    out = df.orderBy("_vid").collect()
    assert [(r.start, r.ref) for r in out] == [(10, g[10]), (29, g[29]), (19, g[19]), (40, g[40:43])]
    assert out[0].info.NOTE == "x|y" and out[1].alts == [g[29] + "GG"] and out[2].alts == ["ACGT"[("ACGT".index(g[19]) + 1) % 4]] and out[3].alts == []


def test_transcript_positions_and_names():
    exons = [(100, 130), (150, 180), (200, 230)]
    plus, minus = Transcript("T", "+", exons, (105, 225)), Transcript("T", "-", exons, (105, 225))
    assert (plus.utr5, plus.cds_end, plus.length) == (5, 85, 90) and (minus.utr5, minus.cds_end) == (5, 85)
    assert plus.locate(100)[:2] == (1, 0) and plus.locate(131)[:2] == (30, 2) and plus.locate(149)[:2] == (31, -1) and plus.locate(99) is None
    assert plus.locate(139)[:2] == (30, 10) and minus.locate(140)[:2] == (60, 10)
    assert minus.locate(229)[:2] == (1, 0) and plus.name_of(plus.locate(100)) == "-5" and plus.name_of(plus.locate(229)) == "*5"
    gap = Transcript("T", "+", [(0, 20)], None, [("M", 5), ("D", 1), ("M", 4), ("I", 2), ("M", 10)])
    assert gap.locate(4)[0] == 5 and gap.locate(6)[0] == 6 and gap.locate(10)[0] == 12 and gap.length == 21


def test_coding_changes():
    seq = "GGGGG" + "ATGGCTAAAGATTGTCATTAA" + "CCCC"
    t = Transcript("T", "+", [(0, len(seq))], (5, 26))
    say = lambda s, r, a: effect(t, seq, s, r, a)
    assert (say(8, "G", "A")["consequence"], say(8, "G", "A")["hgvs"]) == ("missense_variant", "T:c.4G>A(p.Ala2Thr/p.A2T)")
    assert say(10, "T", "C")["consequence"] == "synonymous_variant"
    assert say(11, "A", "T")["consequence"] == "stop_gained" and say(5, "A", "C")["consequence"] == "start_loss"
    assert say(23, "T", "C")["consequence"] == "stop_loss" and say(25, "A", "G")["consequence"] == "stop_retained_variant"
    fs = say(7, "GG", "G")
    assert fs["consequence"].startswith("frameshift") and "p.Ala2Leu" in fs["hgvs"]
    assert say(9, "C", "CA")["hgvs"] == "T:c.5_6insA(p.Lys3*/p.K3*)" or "fs" in say(9, "C", "CA")["hgvs"]
    assert say(13, "AGAT", "A")["consequence"] == "conservative_inframe_deletion" and "p.D4del" in say(13, "AGAT", "A")["hgvs"]
    assert say(13, "A", "AGCC")["consequence"].endswith("inframe_insertion") and "ins" in say(13, "A", "AGCC")["hgvs"]
    told = lambda s, r, a: (say(s, r, a)["consequence"], say(s, r, a)["hgvs"].split("/")[-1].rstrip(")"))
    assert told(4, "GATG", "G") == ("start_loss", "p.M1del") and told(22, "TTAA", "T") == ("stop_loss", "p.*7P")
    assert told(13, "A", "ATAA") == ("stop_gained", "p.D4*") and told(13, "A", "AGCCTAG") == ("frameshift_truncate", "p.D4delinsA*")
    assert told(10, "TAAA", "TTAG") == ("stop_gained", "p.K3*") and told(19, "TCAT", "T") == ("conservative_inframe_deletion", "p.H6del")
    assert told(22, "T", "TGCC") == ("conservative_inframe_insertion", "p.H6_*7insA") and told(5, "AT", "A")[0] == "start_loss"
    assert say(2, "G", "A")["hgvs"] == "T:c.-3G>A" and say(26, "C", "A")["hgvs"] == "T:c.*1C>A"
    assert say(4, "C", "<NON_REF>") is None and translate("ATGTGA", True) == "MW"
    rc = reverse_complement(seq)
    m = Transcript("T", "-", [(0, len(seq))], (len(seq) - 26, len(seq) - 5))
    assert effect(m, seq, len(seq) - 9, rc[len(seq) - 9], "T")["hgvs"] == "T:c.4G>A(p.Ala2Thr/p.A2T)"


def test_effects_frame(spark, files):
    h = vcf.read_header(spark, files["vcf"])
    x = transcript_effects(vcf.read_vcf(spark, files["vcf"], h), tables.read_gea(spark, files["gea"]), tables.read_fasta(spark, files["fa"]))
    assert x.count() == 8 and {r.transcript for r in x.collect()} == {"T1.1", "N1"}


def test_joins_equal_brute_force(spark):
    rng = random.Random(6)
    pts = [(i, rng.choice("ab"), rng.randrange(3000)) for i in range(300)]
    reg = [(j, rng.choice("ab"), s := rng.randrange(3000), s + rng.choice([0, 1, 5, 40, 900, 2500])) for j in range(120)]
    p = spark.createDataFrame(pts, "i int, chrom string, pos int")
    r = spark.createDataFrame(reg, "j int, chrom string, start int, end int")
    hits = sorted((i, j) for i, c, x in pts for j, d, s, e in reg if c == d and s <= x < e)
    for width in (4, 16, 8192):
        assert sorted((x.i, x.j) for x in iv.range_join(p, r, bin_width=width).collect()) == hits
        left = iv.range_join(p, r, how="left", bin_width=width)
        assert left.count() == len(hits) + 300 - len({i for i, _ in hits})
        assert iv.range_join(p, r, how="left_semi", bin_width=width).count() == len({i for i, _ in hits})
        assert iv.range_join(p, r, how="left_anti", bin_width=width).count() == 300 - len({i for i, _ in hits})
    pairs = sorted((a[0], b[0]) for a in reg for b in reg if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    for width in (2, 4, 64):
        assert sorted((x.j, x.r_j) for x in iv.overlap_join(r, r, bin_width=width).collect()) == pairs


def test_alignment_and_motifs():
    assert align.global_cigar("ACGTACGT", "ACGTCGT") == (14 - 7, [("M", 4), ("I", 1), ("M", 3)])
    assert align.global_cigar("TTACGTAA", "GGACGTCC", local=True)[0] == 8
    assert align.motif_hits("AACGTNACGA", "ACGW") == [1, 6] and align.motif_hits("AAAA", "AC", 1) == [0, 1, 2]
    w = np.array([[1, 0, 0, 0], [0, 2, 0, 0]])
    assert align.matrix_scores("ACGA", w).tolist() == [3, 0, 0] and align.best_change("AC", "AG", w) == -2


def test_fisher():
    assert abs(fisher_two_sided(3, 1, 1, 3) - 0.485714) < 1e-6 and fisher_two_sided(0, 0, 0, 0) == 1.0


def test_interval_sets_equal_brute_force_whatever_the_stretches(spark):
    rng = random.Random(61)
    make = lambda: [(rng.choice(["a", "b", None]), s := rng.randrange(200), s + rng.choice([1, 2, 9, 60])) for _ in range(40)]
    a, b = make(), make()
    frames = [spark.createDataFrame(x, "chrom string, start int, end int") for x in (a, b)]
    cover = lambda rows: {(c, x) for c, s, e in rows for x in range(s, e)}

    def runs(points):
        out = []
        for c, x in sorted(points, key=lambda p: (p[0] or "", p[1])):
            if out and out[-1][0] == c and out[-1][2] == x:
                out[-1][2] = x + 1
            else:
                out.append([c, x, x + 1])
        return sorted(map(tuple, out), key=str)

    pa, pb = cover(a), cover(b)
    for stretch in (1, 16, 1 << 20):
        for got, want in ((iv.merge_intervals(frames[0], stretch=stretch), pa), (iv.intersect_intervals(*frames, stretch=stretch), pa & pb), (iv.subtract_intervals(*frames, stretch=stretch), pa - pb), (iv.union_intervals(*frames, stretch=stretch), pa | pb)):
            assert sorted(map(tuple, got.collect()), key=str) == runs(want)


def test_nearest_on_one_key_takes_linear_time(spark):
    from lociframe.operators.nearest import nearest

    left = spark.range(100_000).selectExpr("'k' k", "id * 3 x")
    right = spark.range(100_000).selectExpr("'k' k", "id * 3 + 1 s", "id * 3 + 2 e", "id")
    out = nearest(left, right, on="k", left_at="x", right_start="s", right_end="e", payload=["id"], tolerance=5)
    assert out.where("next_id * 3 = x and (x = 0 or prev_id * 3 + 3 = x)").count() == 100_000
