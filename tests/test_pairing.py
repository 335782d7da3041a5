"""Pairing of several files' records at a site, in each mode, by hand and by what holds of any result."""

import itertools
import random

import pytest

from lociframe.operators import pairing as pr


def lines(mode, *files):
    """Each file as a list of 'REF>ALT,ALT' texts; the lines as sets of (file, text)."""
    rows, at = [], {}
    for f, texts in enumerate(files):
        for t in texts:
            ref, alts = t.split(">", 1)
            at[len(rows)] = (f, t)
            rows.append((f, len(rows), ref, [] if alts == "." else alts.split(",")))
    return [sorted(at[r] for r in line.values()) for line in pr.lines_of(rows, mode)]


def test_kinds():
    want = {("A", "C"): pr.SNP, ("AC", "GT"): pr.SNP, ("A", "AT"): pr.INDEL, ("ATT", "A"): pr.INDEL, ("A", "."): pr.REF, ("A", "*"): pr.REF, ("A", "<*>"): pr.REF, ("A", "<DEL>"): pr.OTHER, ("AC", "*"): pr.OTHER, ("ACT", "TG"): pr.OTHER, ("a", "A"): pr.REF, ("G", "G]c:1]"): 0, ("CAT", "T"): pr.INDEL}
    assert {k: pr.allele_kind(*k) for k in want} == want


def test_modes_by_hand():
    assert lines("exact", ["A>C,T"], ["A>T,C"], ["A>C"]) == [[(0, "A>C,T"), (1, "A>T,C")], [(2, "A>C")]]
    assert lines("some", ["A>C,T"], ["A>T,C"], ["A>C"]) == [[(0, "A>C,T"), (1, "A>T,C"), (2, "A>C")]]
    assert lines("some", ["A>C"], ["A>G"]) == [[(0, "A>C")], [(1, "A>G")]]
    assert lines("snps", ["A>C"], ["A>G"], ["A>AT"]) == [[(0, "A>C"), (1, "A>G")], [(2, "A>AT")]]
    assert lines("indels", ["A>AG"], ["A>AT"], ["A>C"]) == [[(0, "A>AG"), (1, "A>AT")], [(2, "A>C")]]
    assert lines("both", ["A>C", "A>AT"], ["A>AG", "A>T"]) == [[(0, "A>C"), (1, "A>T")], [(0, "A>AT"), (1, "A>AG")]]
    assert lines("both", ["A>."], ["A>T"]) == [[(0, "A>.")], [(1, "A>T")]]
    assert lines("both+ref", ["A>."], ["A>T"], ["A>AT"]) == [[(0, "A>."), (1, "A>T")], [(2, "A>AT")]]
    assert lines("any", ["A>AT"], ["A>T"], ["A><DEL>"]) == [[(0, "A>AT"), (1, "A>T"), (2, "A><DEL>")]]


def test_what_most_files_have_goes_first():
    assert lines("exact", ["A>T"], ["A>C"], ["A>C"]) == [[(1, "A>C"), (2, "A>C")], [(0, "A>T")]]
    # The best score outdoes the order: the alleles that are shared, before those of one kind.
    assert lines("any", ["A>C"], ["A>AT", "A>C,G"]) == [[(0, "A>C"), (1, "A>C,G")], [(1, "A>AT")]]
    # Repeats in one file go with those of another, one by one.
    assert lines("exact", ["A>C", "A>C"], ["A>C", "A>C", "A>C"]) == [[(0, "A>C"), (1, "A>C")], [(0, "A>C"), (1, "A>C")], [(1, "A>C")]]
    assert lines("exact", ["a>C"], ["A>c"]) == [[(0, "a>C"), (1, "A>c")]]


@pytest.mark.parametrize("mode", list(pr.MODES))
def test_any_site(mode):
    rng = random.Random(mode)
    alts = ["C", "G", "T", "AT", "AGG", "<DEL>", "."]
    for _ in range(300):
        files = []
        for _ in range(rng.randint(1, 5)):
            records = [rng.sample(alts[:6], rng.randint(1, 3)) if rng.random() < 0.9 else ["."] for _ in range(rng.randint(0, 4))]
            files.append([f"A>{','.join(r)}" for r in records])
        got = lines(mode, *files)
        flat = sorted(x for line in got for x in line)
        assert flat == sorted((f, t) for f, texts in enumerate(files) for t in texts)
        for line in got:
            assert len({f for f, _ in line}) == len(line)
        # Lines that are left apart could not have been joined.
        def members(line):
            return pr.variants_of([(f, i, t.split(">")[0], [] if t.endswith(".") else t.split(">", 1)[1].split(",")) for i, (f, t) in enumerate(line)])
        for one, two in itertools.combinations(got, 2):
            if not {f for f, _ in one} & {f for f, _ in two}:
                assert pr.line_score(mode, members(one), members(two)) == 0 or pr.line_score(mode, members(two), members(one)) == 0


def test_files_paired(spark):
    rng = random.Random(9)
    files, want = [], {}
    for f in range(3):
        rows = [(f * 1000 + i, f"c{rng.randrange(2)}", rng.randrange(40), "A", rng.sample(["C", "G", "AT"], rng.randint(0, 2))) for i in range(60)]
        rows.append((f * 1000 + 99, None, None, None, None))
        files.append(spark.createDataFrame(rows, "_vid bigint, chrom string, start int, ref string, alts array<string>"))
        for r in rows:
            want.setdefault(r[1:3], []).append((f, r[0], r[3] or ".", r[4] or []))
    got = pr.paired(files, "both")
    assert got.columns == ["chrom", "start", "line", "r0", "r1", "r2"]
    expect = sorted(((c or "", -1 if s is None else s, n, *(line.get(f) for f in range(3))) for (c, s), rows in want.items() for n, line in enumerate(pr.lines_of(sorted(rows), "both"))), key=str)
    assert sorted(((r[0] or "", -1 if r[1] is None else r[1], *r[2:]) for r in got.collect()), key=str) == expect
    with pytest.raises(ValueError):
        pr.paired(files, "most")
    with pytest.raises(ValueError):
        pr.paired([])
