"""Names of changes read back to the genome."""

import random

from lociframe.functions.consequence import Transcript, effect
from lociframe.functions.names import change_on_genome, genome_place, parsed_name
from lociframe.operators.transcripts import places_of_names


def test_grammar():
    told = lambda x: None if (n := parsed_name(x)) is None else (n.on, n.gene, n.kind, n.first, n.last, n.change, n.replaced, n.new)
    assert told("T.1:c.-3+5A>G") == ("T.1", None, "c", "-3+5", "-3+5", "sub", "A", "G")
    assert told('"T.1(GEN):c.10_12delACG"') == ("T.1", "GEN", "c", "10", "12", "del", "ACG", None)
    assert told("T:n.5_6insgg") == ("T", None, "n", "5", "6", "ins", None, "GG")
    assert told("T:c.*3_*4delinsTT(p.A1B/p.X)") == ("T", None, "c", "*3", "*4", "delins", None, "TT")
    assert told("T:c.7delAinsTT")[5:] == ("delins", "A", "TT") and told("T:c.7_9dup")[5:] == ("dup", None, None)
    assert told("c1:g.17=")[5] == "same"
    assert [told(x) for x in (None, "", "T", "T:c.", "T:x.5A>C", "T:c.5A>", "T:c.5inv", "T:c.A>C", "T:c.5_6ins")] == [None] * 9


def test_places_go_there_and_back():
    rng = random.Random(4)
    for _ in range(150):
        at, blocks = 50, []
        for _ in range(rng.randint(1, 4)):
            n = rng.randint(3, 20)
            blocks.append((at, at + n))
            at += n + rng.randint(1, 12)
        total = sum(e - s for s, e in blocks)
        cigar = []
        if rng.random() < 0.4 and total > 12:
            cigar = [("M", 5), (rng.choice("DI"), 2), ("M", total - 7)]
        t = Transcript("T.1", rng.choice("+-"), blocks, (blocks[0][0] + 1, blocks[-1][1] - 1), cigar)
        for pos in range(blocks[0][0], blocks[-1][1]):
            place = t.locate(pos)
            lost = cigar and cigar[1][0] == "D" and place[3] and genome_place(t, place[0]) != pos
            if lost:  # a base that the transcript lacks shares its position with the one behind
                assert t.locate(genome_place(t, place[0]))[0] == place[0]
                continue
            back = genome_place(t, place[0], place[1])
            if not cigar:
                assert back == pos
            if not cigar:
                x = effect(t, None, pos, "A", "C")
                assert change_on_genome(parsed_name(x["hgvs"]), t) == {"start": pos, "end": pos + 1, "ref": "A", "alt": "C", "problem": None}


def test_changes_of_all_kinds():
    t = Transcript("T", "-", [(100, 130), (150, 180)], (105, 175))
    where = lambda x: change_on_genome(parsed_name(x), t)
    assert where("T:c.1A>G") == {"start": 174, "end": 175, "ref": "T", "alt": "C", "problem": None}
    assert where("T:c.1_3del") == {"start": 172, "end": 175, "ref": None, "alt": "", "problem": None}
    assert where("T:c.1_2insAC") == {"start": 174, "end": 174, "ref": "", "alt": "GT", "problem": None}
    assert where("T:c.1_2dupAC") == {"start": 173, "end": 175, "ref": "GT", "alt": "GTGT", "problem": None}
    assert where("T:c.25+2A>C")["start"] == 148 and where("T:c.26-1A>C")["start"] == 130
    assert where("T:c.20+2A>C") == {"problem": "no such place"} and where("T:c.900A>C") == {"problem": "no such place"} and where("T:c.*30A>C") == {"problem": "no such place"}
    assert where("T:c.1_3delAC")["problem"] == "bases don't fit the places" and where("T:c.1_9insA")["problem"]
    assert change_on_genome(parsed_name("T:c.1A>C"), None) == {"problem": "no such transcript"}
    assert change_on_genome(parsed_name("c1:g.5_7delinsA"), None) == {"start": 4, "end": 7, "ref": None, "alt": "A", "problem": None}


def test_column_of_names(spark):
    e = spark.createDataFrame([(1, "c1", "A.1", "mRNA", "+", 12, 18, [(10, 20)], None), (2, "c9", "A.1", "mRNA", "+", 2, 8, [(0, 10)], None), (3, "c2", "N", "ncRNA", "-", None, None, [(0, 9)], [("M", 9)])], "_ord bigint, chrom string, name string, biotype string, strand string, cds_start int, cds_end int, blocks array<struct<start:int,end:int>>, cigar array<struct<op:string,len:int>>")
    rows = [(1, "A.1:c.1A>C", "x"), (2, "N:n.1A>C", "x"), (3, "c7:g.3T>A", None), (4, "B:c.1A>C", "x"), (5, None, "x"), (6, "rubbish", "x"), (7, "A.1(G):c.-1del", "x"), (7, "A.1(G):c.-1del", "x")]
    df = spark.createDataFrame(rows, "id int, name string, chrom string")
    out = places_of_names(df, "name", e)
    assert out.columns == ["id", "name", "chrom", "start", "end", "ref", "alt", "change", "problem"]
    got = sorted(((r.id, r.chrom, r.start, r.end, r.ref, r.alt, r.problem) for r in out.collect()), key=str)
    assert got == sorted([(1, "c1", 12, 13, "A", "C", None), (2, "c2", 8, 9, "T", "G", None), (3, "c7", 2, 3, "T", "A", None), (4, None, None, None, None, None, "no such transcript"), (5, None, None, None, None, None, "not a name"), (6, None, None, None, None, None, "not a name"), (7, "c1", 11, 12, None, "", None), (7, "c1", 11, 12, None, "", None)], key=str)
    assert places_of_names(df.limit(0), "name", e).count() == 0
