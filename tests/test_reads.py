"""Bases of reads against the plain way, read by read."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import reads as rd

SCHEMA = "_vid bigint, name string, flag int, chrom string, start int, end int, cigar array<struct<op:string,len:int>>, seq string, qual string"


def made(n: int, seed: int = 1) -> list[tuple]:
    rnd, out = random.Random(seed), []
    for i in range(n):
        cigar = [(rnd.choice("MIDNSHP=X"), rnd.randrange(0, 5)) for _ in range(rnd.randrange(0, 7))]
        long = sum(k for o, k in cigar if o in "MIS=X")
        seq = rnd.choice([None, "*", "".join(rnd.choice("ACGTNé") for _ in range(max(0, long - rnd.randrange(0, 2))))])
        qual = rnd.choice([None, "*", "".join(chr(rnd.randrange(33, 90)) for _ in range(long))])
        start = rnd.randrange(0, 40)
        out.append((i, rnd.choice([None, f"n{rnd.randrange(n // 2)}", f"n{i}x"]), rnd.choice([0, 16]), f"c{rnd.randrange(2)}", start, start + sum(k for o, k in cigar if o in "MDN=X"), cigar, seq, qual))
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    """(chrom, pos, read, name, base, quality, reverse)."""
    out = []
    for vid, name, flag, chrom, start, _, cigar, seq, qual in rows:
        r = q = 0
        for o, k in cigar:
            for i in range(k if o in "M=XD" else 0):
                base = (seq or "")[q + i : q + i + 1]
                known = qual is not None and qual != "*"
                quality = 0 if o == "D" or not known else ord(qual[q + i]) - 33 if q + i < len(qual) else -33
                out.append((chrom, start + r + i, vid, name, "*" if o == "D" else base if seq is not None else "", quality, flag == 16))
            r, q = r + (k if o in "MDN=X" else 0), q + (k if o in "MIS=X" else 0)
    return out


def shown(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_all_bases_and_bases_at_places(spark, monkeypatch, at_once):
    rows = made(300)
    reads = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    columns = ("chrom", "pos", "read", "name", "base", "quality", "reverse")
    assert shown(rd.all_bases(reads), *columns) == shown(spark.createDataFrame(want, "chrom string, pos int, read bigint, name string, base string, quality int, reverse boolean"), *columns)
    asked = [(f"c{i % 2}", i % 37, i % 3) for i in range(90)]
    for places in (spark.createDataFrame(asked, "chrom string, pos int, more int"), spark.createDataFrame([x[:2] for x in asked], "chrom string, pos int")):
        more = places.columns[2:]
        pairs = sorted(str((x[:2] + (x[2:] if more else ()), y[2:6])) for x in asked for y in want if x[:2] == y[:2])
        got = rd.bases_at(places, reads, bin_width=16).collect()
        assert sorted(str((tuple(r)[: len(places.columns)], tuple(r)[len(places.columns) :])) for r in got) == pairs


def test_mates_are_corrected_as_bases_are(spark):
    rows = [(*r[:7], r[7] or "ACGTACGTACGTACGTACGTACGTACGT", r[8] or "*") for r in made(200, 2)]
    reads = spark.createDataFrame(rows, SCHEMA)
    columns = ("chrom", "pos", "read", "base", "quality")
    old = rd.mates_corrected(rd.all_bases(reads), ["chrom", "pos"])
    assert shown(rd.mate_bases(reads), *columns) == shown(old, *columns)
    piles = [shown(rd.pileup(x, ["chrom", "pos"], depth=3), "chrom", "pos", "depth", "bases", "quality") for x in (old, rd.mate_bases(reads, depth=3))]
    assert piles[0] == piles[1]


def test_no_base_is_shuffled_before_its_place_has_been_counted(spark):
    """The reads of a deep place are dealt by name, and few of their bases leave a task."""
    reads = spark.createDataFrame([(i, f"n{i // 2}", 0, "c", i % 3, i % 3 + 5, [("M", 5)], "ACGTA", "IIIII") for i in range(4000)], SCHEMA).repartition(2)
    assert rd.mate_bases(reads, depth=4).count() <= 7 * 4 * 4 * spark.sparkContext.defaultParallelism
    assert {r.depth for r in rd.pileup(rd.mate_bases(reads, depth=4), ["chrom", "pos"], depth=4).collect()} == {4}


def test_flags_by_name(spark):
    df = spark.createDataFrame([(i,) for i in [*range(0, 4096, 7), None]], "f int")
    assert df.where(~rd.flag_number(rd.flag_text(F.col("f"))).eqNullSafe(F.col("f"))).count() == 0
    texts = {"": 0, "dup,DUP": 1024, ",PAIRED,,READ1,": 65, "PAIRED,WHAT": None, "PAIR": None, "12": 12, None: None, "PAIREDDUP": None}
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", rd.flag_number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == texts
