"""Records of many files at the same sites, paired by how well their alleles go together.

Files' records are gathered by site (contig and position), which few records have, so a site is one row whatever the
files' size. At a site, records of equal alleles in different files are one variant. The variant that most
files have goes first; it takes in the best-scored of those whose files it lacks, again and again, and becomes a line; then
the next begins. Sets of files are bit masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Kinds of alleles as bits.
REF, SNP, INDEL, OTHER = 1, 2, 4, 8
# Which kinds may share a line in each mode, and how well they go together; equal alleles always may but in `exact` ones of other records.
_SNPS, _INDELS, _REFS = {(SNP, SNP): 3}, {(INDEL, INDEL): 3}, ({(SNP, REF): 2, (REF, SNP): 2}, {(INDEL, REF): 2, (REF, INDEL): 2})
MODES: dict[str, dict[tuple[int, int], int]] = {
    "exact": {},
    "some": {},
    "snps": _SNPS,
    "indels": _INDELS,
    "both": _SNPS | _INDELS,
    "both+ref": _SNPS | _INDELS | _REFS[0] | _REFS[1],
    "any": _SNPS | _INDELS | _REFS[0] | _REFS[1],
}
SURE = 1 << 40


def allele_kind(ref: str, alt: str) -> int:
    """REF, SNP (several bases changed in place included), INDEL, OTHER, or 0 for a break end, which goes with nothing else."""
    r, a = ref.upper(), alt.upper()
    if a in (".", "<X>", "<*>") or r == a or (len(r) == 1 and a in ("X", "*")):
        return REF
    if a.startswith("<"):
        return OTHER
    n = next((i for i, (x, y) in enumerate(zip(r, a, strict=False)) if x != y), min(len(r), len(a)))
    r, a = r[n:], a[n:]
    if not r and a[0] in "[]":
        return 0
    if not r or not a:
        return INDEL
    while len(r) > 1 and len(a) > 1 and r[-1] == a[-1]:
        r, a = r[:-1], a[:-1]
    if len(r) == len(a):
        return SNP
    return INDEL if 1 in (len(r), len(a)) and r[-1] == a[-1] else OTHER


@dataclass
class Variant:
    """Alleles that some files have, as (ref, alts in order)."""

    alleles: tuple[str, ...]
    kind: int
    at: dict[int, int]

    def __post_init__(self):
        self.text, self.folded = ",".join(self.alleles), {x.upper() for x in self.alleles}


def variants_of(records: list[tuple[int, int, str, list[str]]]) -> list[Variant]:
    """The different variants of (file, record, ref, alts), in order; the nth repeat in one file goes with that of another."""
    out: dict[tuple, Variant] = {}
    for file, record, ref, alts in records:
        alleles = tuple(f"{ref}>{a}" for a in alts) or (f"{ref}>.",)
        n = next(i for i in range(len(records)) if (alleles, i) not in out or file not in out[alleles, i].at)
        if (alleles, n) not in out:
            kinds = [allele_kind(ref, a) for a in alts]
            changes = [k for k in kinds if k != REF]
            out[alleles, n] = Variant(alleles, reduce(int.__or__, changes, 0) if changes else REF, {})
        out[alleles, n].at[file] = record
    return list(out.values())


def _score(mode: str, a: int, b: int) -> int:
    """How well two kinds go together; of records of several kinds the best of their kinds counts, and with `any` all go at least."""
    table = MODES[mode]
    if mode == "any":
        return table.get((a, b), 1)
    return max((table.get((x, y), 0) for x in (1, 2, 4, 8) if a & x for y in (1, 2, 4, 8) if b & y), default=0)


def line_score(mode: str, one: list[Variant], two: list[Variant]) -> int:
    """0: may not share a line. The least score of the variants decides, then how many files have them; shared alleles outdo all."""
    least = None
    for a in one:
        for b in two:
            if mode == "exact":
                if a.kind == b.kind and (a.text == b.text or (len(a.alleles) == len(b.alleles) and len(a.text) == len(b.text) and a.folded <= b.folded)):
                    return SURE
                continue
            if (a.kind == b.kind and a.text == b.text) or (a.kind & b.kind and a.folded & b.folded):
                return SURE
            score = _score(mode, a.kind, b.kind)
            if not score:
                return 0
            least = score if least is None else min(least, score)
    return 0 if least is None else (1 << (28 + least)) + sum(len(v.at) for v in one + two)


def lines_of(records: list[tuple[int, int, str, list[str]]], mode: str) -> list[dict[int, int]]:
    """The lines of a site, each as {file: record}."""
    sets = [([v], sum(1 << f for f in v.at)) for v in variants_of(records)]
    out = []
    while sets:
        best = max(range(len(sets)), key=lambda i: (sum(len(v.at) for v in sets[i][0]), -i))
        members, files = sets[best]
        scored = [(line_score(mode, members, other), -i) for i, (other, mask) in enumerate(sets) if not mask & files]
        score, at = max(scored, default=(0, 0))
        if score:
            low, high = sorted((best, -at))
            sets[low] = (sets[low][0] + sets[high][0], files | sets[-at][1])
            del sets[high]
        else:
            out.append({f: r for v in members for f, r in v.at.items()})
            del sets[best]
    return out


def paired(files: list[DataFrame], mode: str = "exact") -> DataFrame:
    """(chrom, start, line, r0, r1, ...): the lines of each site, with each file's _vid on it, null where it has none.

    files have _vid, chrom, start, ref and alts. Every record is on one line. Modes: exact (the same alleles, in any order),
    some (a shared allele), snps, indels, both (alleles may differ if they are of that kind), both+ref (and records
    without alternatives go with them), any. Lines are numbered from 0 in the order in which they are made.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode} isn't one of {', '.join(MODES)}")
    if not files:
        raise ValueError("no files to pair")
    spark = files[0].sparkSession
    ship(spark)
    rows = None
    for i, f in enumerate(files):
        one = f.select("chrom", "start", F.struct(F.lit(i).alias("file"), F.col("_vid").cast("bigint").alias("record"), "ref", "alts").alias("r"))
        rows = one if rows is None else rows.union(one)
    sites = rows.groupBy("chrom", "start").agg(F.array_sort(F.collect_list("r")).alias("records"))
    names = [f"r{i}" for i in range(len(files))]
    kinds = {n: sites.schema[n].dataType.simpleString() for n in ("chrom", "start")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            site, number, cells = [], [], [[] for _ in names]
            for i, records in enumerate(b.column(2).to_pylist()):
                for n, line in enumerate(lines_of([(r["file"], r["record"], r["ref"] or ".", r["alts"] or []) for r in records], mode)):
                    site.append(i)
                    number.append(n)
                    for f, cell in enumerate(cells):
                        cell.append(line.get(f))
            at = pa.array(site, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(number, pa.int32()), *(pa.array(c, pa.int64()) for c in cells)], names=["chrom", "start", "line", *names])

    return sites.mapInArrow(run, f"chrom {kinds['chrom']}, start {kinds['start']}, line int, " + ", ".join(f"{n} bigint" for n in names))
