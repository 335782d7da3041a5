"""Alignment and motif search over sequences, for Arrow UDFs."""

from __future__ import annotations

import numpy as np

# The nucleotide ambiguity codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def global_cigar(a: str, b: str, match: int = 2, mismatch: int = 2, gap_open: int = 5, gap_extend: int = 2, local: bool = False) -> tuple[int, list[tuple[str, int]]]:
    """Score and CIGAR (M; I: only in a; D: only in b) of the best alignment with affine gaps, global or local."""
    n, m, low = len(a), len(b), -(1 << 30)
    best, ins, dele = (np.full((n + 1, m + 1), low, np.int64) for _ in range(3))
    best[0, 0] = 0
    for i in range(1, n + 1):
        ins[i, 0] = -gap_open - gap_extend * i
        best[i, 0] = 0 if local else ins[i, 0]
    for j in range(1, m + 1):
        dele[0, j] = -gap_open - gap_extend * j
        best[0, j] = 0 if local else dele[0, j]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            ins[i, j] = max(best[i - 1, j] - gap_open, ins[i - 1, j]) - gap_extend
            dele[i, j] = max(best[i, j - 1] - gap_open, dele[i, j - 1]) - gap_extend
            best[i, j] = max(best[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else -mismatch), ins[i, j], dele[i, j], 0 if local else low)
    i, j = (int(x) for x in np.unravel_index(best.argmax(), best.shape)) if local else (n, m)
    score, ops, state = int(best[i, j]), [], "M"
    while (i or j) and not (local and state == "M" and best[i, j] == 0):
        if state == "M":
            if i and j and best[i, j] == best[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else -mismatch):
                ops.append("M")
                i, j = i - 1, j - 1
            else:
                state = "I" if i and best[i, j] == ins[i, j] else "D"
        elif state == "I":
            ops.append("I")
            state = "M" if ins[i, j] == best[i - 1, j] - gap_open - gap_extend else "I"
            i -= 1
        else:
            ops.append("D")
            state = "M" if dele[i, j] == best[i, j - 1] - gap_open - gap_extend else "D"
            j -= 1
    out: list[tuple[str, int]] = []
    for op in reversed(ops):
        if out and out[-1][0] == op:
            out[-1] = (op, out[-1][1] + 1)
        else:
            out.append((op, 1))
    return score, out


def motif_hits(seq: str, motif: str, mismatches: int = 0) -> list[int]:
    """0-based places where an ambiguity-code motif fits with at most so many mismatches."""
    return motif_hits_of([seq], motif, mismatches)[1].tolist()


def motif_hits_of(seqs: list[str | None], motif: str, mismatches: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(number of the sequence, place) of the fits in all sequences, which are looked at as one; none reaches over an end."""
    k = len(motif)
    raw = [(x or "").upper().replace("U", "T").encode() for x in seqs]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    s = np.frombuffer(b"".join(raw), np.uint8)
    if len(s) < k or not k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bad = np.zeros(len(s) - k + 1, np.int32)
    for i, c in enumerate(motif.upper()):
        refused = np.ones(256, bool)
        refused[np.frombuffer(IUPAC[c].encode(), np.uint8)] = False
        bad += refused[s[i : len(s) - k + 1 + i]]
    at = np.flatnonzero(bad <= mismatches)
    row = np.searchsorted(ends, at, side="right")
    inside = at + k <= ends[row]
    row, at = row[inside], at[inside]
    return row, at - (ends[row] - np.array([len(x) for x in raw], np.int64)[row])


def matrix_scores(seq: str, weights: np.ndarray) -> np.ndarray:
    """The score of a weight matrix (rows of A, C, G, T) at each place of a sequence."""
    w = np.c_[np.asarray(weights, float), np.zeros(len(weights))]
    codes = np.frombuffer(seq.upper().replace("U", "T").translate(str.maketrans("ACGT", "\0\1\2\3")).encode(), np.uint8)
    codes = np.minimum(codes, 4)
    k = len(w)
    return sum((w[i][codes[i : len(codes) - k + 1 + i]] for i in range(k)), np.zeros(max(0, len(codes) - k + 1))) if len(codes) >= k else np.empty(0)


def best_change(ref_seq: str, alt_seq: str, weights: np.ndarray) -> float:
    """The change, largest by magnitude, of a matrix's best score between two sequences."""
    a, b = matrix_scores(ref_seq, weights), matrix_scores(alt_seq, weights)
    return float(b.max() - a.max()) if len(a) and len(b) else 0.0
