"""Genes and variants grow together: no side of their joins goes through the driver, however small Spark takes its files to be."""

from pyspark.sql import functions as F

from lociframe.operators.transcripts import places_of_names
from lociframe.plans import annotate as an
from lociframe.scratch import stored
from lociframe.sources.vcf import VcfHeader


def _elements(spark):
    rows = [(i, "c1", 10, 40, ("G", "T.1", "S")[i], ("Gene", "mRNA", "TFBS")[i], "G", "+", 10, 40, [(10, 40)], None, None) for i in range(3)]
    return stored(spark.createDataFrame(rows, "_ord bigint, chrom string, start int, end int, name string, biotype string, gene string, strand string, cds_start int, cds_end int, blocks array<struct<start:int,end:int>>, cigar array<struct<op:string,len:int>>, info string"), "elements")


def _annotated(spark, monkeypatch, genome):
    monkeypatch.setattr(an, "stored", lambda df, name: df)  # one plan for all steps
    v = stored(spark.createDataFrame([(1, "c1", 12, 13, "A", ["C"]), (2, "c1", 90, 91, "A", ["C"])], "_vid bigint, chrom string, start int, end int, ref string, alts array<string>"), "variants").withColumn("info", F.struct(F.lit(None).cast("string").alias("_none")))
    s = stored(spark.createDataFrame([("T.1", "T.1", "ACG" * 10)], "name string, title string, seq string"), "sequences")
    columns = [(t, "+") for t in ("HGVSnom", "Gene", "VarType", "MolecularConsequence", "MC1", "TSSdistance")]
    return an.annotate_genes(v, VcfHeader(), _elements(spark), s, columns, genome=s if genome else None)[0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gene_annotation_broadcasts_no_table(spark, monkeypatch):
    out = _annotated(spark, monkeypatch, False)
    assert "SortMergeJoin" in _plan(out) and "Broadcast" not in _plan(out)
    assert [r.info.Gene for r in out.orderBy("_vid").collect()] == [["G"], ["G"]]


def test_shifted_indels_broadcast_no_table(spark, monkeypatch):
    assert "Broadcast" not in _plan(_annotated(spark, monkeypatch, True))


def test_names_are_placed_without_a_broadcast(spark):
    names = stored(spark.createDataFrame([("T.1:c.1A>C",)], "name string"), "names")
    found = places_of_names(names, "name", _elements(spark))
    assert "Broadcast" not in _plan(found)
    assert [(r.chrom, r.start, r.problem) for r in found.collect()] == [("c1", 10, None)]
