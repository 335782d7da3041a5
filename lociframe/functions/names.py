"""Names of changes, like T.1:c.-3+5A>G or c1:g.10_12del, read back: a small grammar, and places on the genome."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from .consequence import Transcript, reverse_complement

_POINT = r"[*-]?\d+(?:[+-]\d+)?"
_NAME = re.compile(rf"""["']?(?P<on>[^:("']+)(?:\((?P<gene>[^)]*)\))?:(?P<kind>[cngm])\.(?P<from>{_POINT})(?:_(?P<to>{_POINT}))?(?P<change>[ACGTUNacgtun]+>[ACGTUNacgtun]+|delins[ACGTUNacgtun]+|del[ACGTUNacgtun]*ins[ACGTUNacgtun]+|(?:del|dup)[ACGTUNacgtun]*|ins[ACGTUNacgtun]+|=)(?:\(p\..*\))?["']?""")
_PART = re.compile(r"([*-]?)(\d+)([+-]\d+)?")


@dataclass
class Name:
    """on: transcript or contig; first and last: places as they are written; replaced and new: bases in the name's own direction."""

    on: str
    gene: str | None
    kind: str
    first: str
    last: str
    change: str
    replaced: str | None
    new: str | None


def parsed_name(text: str | None) -> Name | None:
    """None where the text isn't a name of the grammar. change: sub, del, dup, ins, delins or same."""
    m = _NAME.fullmatch((text or "").strip())
    if not m:
        return None
    body = m["change"]
    if body == "=":
        change, replaced, new = "same", None, None
    elif ">" in body:
        replaced, new = body.upper().split(">")
        change = "sub" if len(replaced) == len(new) == 1 else "delins"
    else:
        rest = re.fullmatch(r"(del|dup)?([A-Za-z]*?)(?:ins([A-Za-z]+))?", body)
        change = {(True, True): "delins", (True, False): rest[1], (False, True): "ins"}[rest[1] is not None, rest[3] is not None]
        replaced, new = (rest[2] or "").upper() or None, (rest[3] or "").upper() or None
    return Name(m["on"].strip(), m["gene"], m["kind"], m["from"], m["to"] or m["from"], change, replaced, new)


def genome_place(t: Transcript, n: int, offset: int = 0) -> int | None:
    """The 0-based genomic place of transcript position n (from 1), moved by an offset into an intron.

    None where the transcript has no such base, where the genome lacks it (an insertion of the alignment), or where the
    offset doesn't start at the edge of an exon that has an intron on that side.
    """
    x = None
    for i, (begin, shift) in enumerate(t.steps):
        end = t.steps[i + 1][0] if i + 1 < len(t.steps) else sum(e - s for s, e in t.blocks)
        if begin <= n - 1 - shift < end:
            x = n - 1 - shift  # of two bases that share a position the later, which the transcript has
    if x is None:
        return None
    i = bisect_right(t.starts, x) - 1
    s, e = t.exons[i]
    within = x - t.starts[i]
    if (offset > 0 and (within != e - s - 1 or i + 1 == len(t.exons))) or (offset < 0 and (within != 0 or i == 0)):
        return None
    return e - 1 - within - offset if t.minus else s + within + offset


def named_place(t: Transcript, kind: str, point: str) -> int | None:
    """The genomic place of a point as names write it: 45, -12, *3, with +5 or -2 in introns; n. counts from the transcript's begin."""
    sign, digits, offset = _PART.fullmatch(point).groups()
    n = int(digits)
    if kind == "n":
        n = n if not sign else 0
    elif not t.cds:
        return None
    else:
        n = t.utr5 - n + 1 if sign == "-" else t.cds_end + n if sign == "*" else t.utr5 + n
    return genome_place(t, n, int(offset or 0)) if n > 0 else None


def change_on_genome(name: Name, t: Transcript | None) -> dict:
    """start, end (0-based, half-open; an insertion lies between), ref and alt on the plus strand (null: not told), and problem.

    t is the transcript, None for names on the genome (g. and m.), whose places are taken as they are.
    """
    if name.kind in "gm":
        points = [int(x) - 1 if x.isdigit() else None for x in (name.first, name.last)]
    elif t is None:
        return {"problem": "no such transcript"}
    else:
        points = [named_place(t, name.kind, x) for x in (name.first, name.last)]
    if None in points:
        return {"problem": "no such place"}
    lo, hi = sorted(points)
    turn = (lambda s: None if s is None else reverse_complement(s)) if t is not None and t.minus else (lambda s: s)
    ref, alt = turn(name.replaced), turn(name.new)
    if name.change == "ins":
        return {"start": hi, "end": hi, "ref": "", "alt": alt, "problem": None if hi - lo == 1 else "an insertion lies between neighbours"}
    told = {"start": lo, "end": hi + 1, "ref": ref, "alt": {"del": "", "dup": None if ref is None else ref + ref, "same": ref}.get(name.change, alt), "problem": None}
    if ref is not None and len(ref) != hi + 1 - lo:
        told["problem"] = "bases don't fit the places"
    return told
