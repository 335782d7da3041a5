"""Places on transcripts by column functions equal those by the transcript's own geometry."""

import random

from pyspark.sql import functions as F

from lociframe.functions.consequence import Transcript
from lociframe.operators.transcripts import located, located_ends


def test_located(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(60):
        at, blocks = 100, []
        for _ in range(rng.randint(1, 5)):
            n = rng.randint(1, 12)
            blocks.append((at, at + n))
            at += n + rng.randint(1, 15)
        t = Transcript("T", rng.choice("+-"), blocks)
        for pos in range(blocks[0][0], blocks[-1][1]):
            place = t.locate(pos)
            exon = place[2] if place[3] or place[1] > 0 else place[2] + 1
            want[i, pos] = (place[0], place[1], exon)
            rows.append((i, pos, t.strand, rng.sample(blocks, len(blocks))))
    df = spark.createDataFrame(rows, "i int, pos int, strand string, blocks array<struct<start:int,end:int>>")
    got = {(r.i, r.pos): (r.at.pos, r.at.offset, r.at.exon) for r in df.select("i", "pos", located("pos", "blocks", "strand").alias("at")).collect()}
    assert got == want


def test_ends(spark):
    t = spark.createDataFrame([("A.1", "G", "c1", "+", 10, 60, [(10, 20), (40, 60)]), ("B.1", "H", "c1", "-", 15, 60, [(15, 20), (30, 60)]), ("C.1", "I", "c2", "+", 0, 5, [(0, 5)])], "name1 string, name2 string, chrom string, strand string, txstart int, txend int, blocks array<struct<start:int,end:int>>")
    r = spark.createDataFrame([(1, "c1", 10, 20), (2, "c1", 22, 39), (3, "c1", 0, 11), (4, "c3", 1, 2), (5, None, None, None)], "id int, chrom string, start int, end int")
    got = {x.id: (x.start_on, x.end_on) for x in located_ends(r, t, "id").collect()}
    assert got == {1: ("A.1(G):n.1,EX1", "A.1(G):n.10,EX1|B.1(H):n.31,EX2"), 2: ("A.1(G):n.10+3,EX1|B.1(H):n.31-3,EX2", "A.1(G):n.11-2,EX2|B.1(H):n.22,EX1"), 3: ("Intergenic", "A.1(G):n.1,EX1"), 4: ("Intergenic", "Intergenic"), 5: ("Intergenic", "Intergenic")}
    assert located_ends(r, t.limit(0), "id").where(F.col("start_on") != "Intergenic").count() == 0
