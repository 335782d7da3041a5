"""Likelihoods of genotypes from the bases over a place, with errors that depend on each other.

Bases are counted by place, base, strand and quality before the shuffle, so a place has a few hundred rows at most however deep it
is; from these the likelihoods of the ten genotypes of A, C, G and T are computed at once. The best bases count first: the nth base
of a kind and strand has (1 - dependence)^n of its weight, but SHARE at least, and an error is the less surprising the more
of its kind there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

BASES = "ACGT"
GENOTYPES = [a + b for i, a in enumerate(BASES) for b in BASES[i:]]
# How much errors of a kind depend on each other, the weight that is always left, the bounds of qualities, decibels per unit.
DEPENDENCE, SHARE, LEAST_QUALITY, MOST_QUALITY, PHRED = 0.17, 0.03, 4, 63, 4.343


_LOG_FACTORIALS = np.zeros(1)


def _log_factorials(n: int) -> np.ndarray:
    """Logarithms of the factorials of 0 to n at least; each is computed once in a process."""
    global _LOG_FACTORIALS
    if n >= len(_LOG_FACTORIALS):
        _LOG_FACTORIALS = np.r_[_LOG_FACTORIALS, [lgamma(x + 1) for x in range(len(_LOG_FACTORIALS), 2 * n + 1)]]
    return _LOG_FACTORIALS


def _log_choose(n: int, k: np.ndarray) -> np.ndarray:
    known = _log_factorials(n)
    return known[n] - (known[k] + known[n - k])


def surprise(quality: int, n: int) -> np.ndarray:
    """For k from 0 to n - 1: -10 log10 of the chance of more than k errors among n bases, given k or more."""
    error = 10.0 ** (-quality / 10)
    k = np.arange(n + 1)
    # Tails from the far end, in logarithms: at great depths the chances themselves vanish.
    terms = _log_choose(n, k) + k * log(error) + (n - k) * log(1 - error)
    tails = np.logaddexp.accumulate(terms[::-1])[::-1]
    return -10 / log(10) * (tails[1:] - tails[:-1])


MOST_HELD = 4_000_000


class Model:
    """The error model; what it computes for a quality and a depth is remembered, up to MOST_HELD numbers of it."""

    def __init__(self, dependence: float = DEPENDENCE):
        self.dependence, self.known, self.held = dependence, {}, 0

    def of(self, quality: int, n: int) -> np.ndarray:
        if (quality, n) not in self.known:
            if self.held > MOST_HELD:
                self.known.clear()
                self.held = 0
            self.known[quality, n] = surprise(quality, n)
            self.held += n
        return self.known[quality, n]

    def likelihoods(self, seen: list[tuple[str, bool, int, int]]) -> list[float]:
        """Phred-scaled, of all genotypes, from (base, reverse, quality, count)."""
        n = sum(c for *_, c in seen)
        sums, counts, by_strand = [0.0] * 4, [0] * 4, {}
        for base, reverse, quality, count in sorted(seen, key=lambda x: (-min(max(x[2], LEAST_QUALITY), MOST_QUALITY), -x[1], x[0])):
            b, w = BASES.index(base), by_strand.get((base, reverse), 0)
            weight = (1 - self.dependence) ** np.arange(w, w + count, dtype=float) * (1 - SHARE) + SHARE
            sums[b] += float((weight * self.of(min(max(quality, LEAST_QUALITY), MOST_QUALITY), n)[counts[b] : counts[b] + count]).sum())
            counts[b] += count
            by_strand[base, reverse] = w + count
        out = []
        for x in GENOTYPES:
            i, j = BASES.index(x[0]), BASES.index(x[1])
            others = sum(s for k, s in enumerate(sums) if k not in (i, j))
            if i != j:
                both = counts[i] + counts[j]
                others -= PHRED * (float(_log_choose(both, np.array([counts[j]]))[0]) - both * log(2))
            out.append(max(others, 0.0))
        return out


def genotype_likelihoods(bases: DataFrame, keys: list[str], dependence: float = DEPENDENCE) -> DataFrame:
    """keys, depth and a column for each genotype (AA, AC, ..., TT): 0 for the best explained, more for others.

    bases have the keys, base, quality and, where it is known, reverse (the strand). Only A, C, G and T count. Every base counts whatever the
    depth; none are sampled away. Bases of equal kind, strand and quality are alike, so results don't depend on any order.
    """
    ship(bases.sparkSession)
    known = bases.where(F.upper("base").isin(*BASES))
    reverse = F.coalesce(F.col("reverse"), F.lit(False)) if "reverse" in bases.columns else F.lit(False)
    counts = known.groupBy(*keys, F.upper("base").alias("_b"), reverse.alias("_r"), F.col("quality").cast("int").alias("_q")).agg(F.count("*").alias("_n"))
    places = counts.groupBy(*keys).agg(F.sum("_n").alias("depth"), F.collect_list(F.struct("_b", "_r", F.coalesce("_q", F.lit(0)).alias("_q"), "_n")).alias("_seen"))
    schema = places.select(*keys, "depth").schema
    for g in GENOTYPES:
        schema = schema.add(g, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(dependence)
        for b in batches:
            rows = [model.likelihoods([(x["_b"], x["_r"], x["_q"], x["_n"]) for x in seen]) for seen in b.column(len(keys) + 1).to_pylist()]
            cells = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * len(GENOTYPES)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys) + 1], *cells], names=[*keys, "depth", *GENOTYPES])

    return places.mapInArrow(run, schema)


def called_genotype(df: DataFrame) -> DataFrame:
    """df with the genotype of least likelihood value, the first of equal ones, and quality, by which the second best is worse."""
    each = F.array_sort(F.array(*[F.struct(F.col(g).alias("v"), F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(GENOTYPES)]))
    return df.withColumn("_e", each).withColumn("genotype", F.col("_e")[0]["g"]).withColumn("quality", F.col("_e")[1]["v"] - F.col("_e")[0]["v"]).drop("_e")
