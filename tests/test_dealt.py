"""Work is dealt to all tasks, whatever files it comes from."""

from pyspark.sql import functions as F

from lociframe.functions.align import IUPAC, motif_hits_of
from lociframe.operators.relational import class_join
from lociframe.plans.file_queries import _genes
from lociframe.plans.table_queries import QUERIES


def test_genes_are_dealt_to_tasks(spark):
    genes = _genes(spark, "/root/testdata/sf0.001")
    assert genes.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert genes.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def test_motifs_of_many_sequences_do_not_reach_over_their_ends():
    seqs = ["ACGT", None, "", "G", "acgu" * 3, "TACG", "CGAN", "ACG"]
    for motif in ("ACG", "RYN", "CGA", "T", "ACGTACGTACGTACG"):
        for most in (0, 1):
            texts = [(x or "").upper().replace("U", "T") for x in seqs]
            want = [(i, j) for i, t in enumerate(texts) for j in range(len(t) - len(motif) + 1) if sum(t[j + k] not in IUPAC[c] for k, c in enumerate(motif)) <= most]
            row, at = motif_hits_of(seqs, motif, most)
            assert list(zip(row.tolist(), at.tolist(), strict=True)) == want


def test_rows_of_equal_alleles_are_joined_by_class(spark):
    rows = [(i, "t" if i % 7 else None, i % 2, None if i % 11 == 0 else [["a", "b"], ["b", "c"], ["d"], ["a", None], []][i % 5]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, kind string, size int, alts array<string>")
    joined = class_join(df, df, ["kind", "size"], "alts", F.col("id") != F.col("d_id"))
    shares = lambda a, b: a is not None and b is not None and bool({x for x in a if x} & {x for x in b if x})
    pairs = [(x[0], y[0]) for x in rows for y in rows if x[0] != y[0] and x[1] and x[1:3] == y[1:3] and shares(x[3], y[3])]
    alone = [(x[0], None) for x in rows if x[0] not in {a for a, _ in pairs}]
    assert sorted(map(str, pairs + alone)) == sorted(str((r.id, r.d_id)) for r in joined.collect())


def test_pairs_of_equal_alleles_are_not_shuffled(spark):
    """What the plan has above the join that makes the pairs: no exchange, which would sort the square of a group."""
    plan = QUERIES["jn1_allele_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Exchange" not in plan[: plan.index("Join")]
    assert "arrays_overlap" not in plan[: plan.index("Join", plan.index("Join") + 4)]
