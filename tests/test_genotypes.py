"""Genotype likelihoods against the definition, and the incomplete integrals against sums."""

import math
import random

import pytest

from lociframe.functions import text as tx
from lociframe.operators import genotypes as gt


def by_definition(seen, dependence):
    """One base at a time, best first, with chances summed as they are."""
    bases = sorted(((min(max(q, 4), 63), r, b) for b, r, q in seen), reverse=True)
    n = len(bases)
    sums, count, strand = dict.fromkeys("ACGT", 0.0), dict.fromkeys("ACGT", 0), {}
    for q, r, b in bases:
        e = 10 ** (-q / 10)
        tail = lambda k: math.fsum(math.comb(n, j) * e**j * (1 - e) ** (n - j) for j in range(k, n + 1))  # noqa: B023, E731
        w = strand.get((b, r), 0)
        sums[b] += ((1 - dependence) ** w * 0.97 + 0.03) * -10 * math.log10(tail(count[b] + 1) / tail(count[b]))
        count[b] += 1
        strand[b, r] = w + 1
    out = []
    for x, y in gt.GENOTYPES:
        rest = sum(v for k, v in sums.items() if k not in (x, y))
        if x != y:
            both = count[x] + count[y]
            rest -= 4.343 * math.log(math.comb(both, count[y]) / 2**both)
        out.append(max(rest, 0))
    return out


def test_likelihoods_by_definition(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for place in range(25):
        seen = [(rng.choice("AACGT"), rng.random() < 0.5, rng.choice([2, 10, 30, 30, 41, 70])) for _ in range(rng.choice([1, 2, 9, 40]))]
        rows += [(place, b.lower() if rng.random() < 0.1 else b, r, q) for b, r, q in seen] + [(place, "N", False, 40), (place, "*", True, 0)]
        want[place] = (len(seen), by_definition(seen, 0.17))
    df = spark.createDataFrame(rows, "place int, base string, reverse boolean, quality int")
    out = gt.genotype_likelihoods(df, ["place"])
    got = {r.place: (r.depth, [r[g] for g in gt.GENOTYPES]) for r in out.collect()}
    assert got.keys() == want.keys()
    for k, (n, values) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(values, abs=1e-6), k
    assert gt.genotype_likelihoods(df.limit(0), ["place"]).count() == 0
    called = gt.called_genotype(out).collect()
    assert all(r.quality >= 0 and r[r.genotype] == min(r[g] for g in gt.GENOTYPES) for r in called)


def test_deep_places(spark):
    df = spark.range(30_000).selectExpr("1 as place", "if(id % 2 = 0, 'A', 'C') as base", "id % 4 < 2 as reverse", "cast(20 + id % 20 as int) as quality")
    (r,) = gt.called_genotype(gt.genotype_likelihoods(df, ["place"])).collect()
    assert (r.depth, r.genotype) == (30_000, "AC") and all(math.isfinite(r[g]) for g in gt.GENOTYPES)


def test_incomplete_integrals():
    for s in range(1, 12):
        for x in (0.1, 1.0, 3.5, 11.0, 60.0):
            assert tx.gamma_share(s, x) == pytest.approx(1 - math.fsum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(s)), abs=1e-12)
    for n in (1, 2, 9, 30):
        for k in range(1, n + 1):
            for p in (0.01, 0.3, 0.5, 0.97):
                assert tx.beta_share(k, n - k + 1, p) == pytest.approx(math.fsum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1)), abs=1e-12)
    assert tx.gamma_share(0.5, 2.0) == pytest.approx(math.erf(math.sqrt(2.0)), abs=1e-12) and tx.gamma_share(2, 0) == 0 and tx.beta_share(2, 3, 0) == 0 and tx.beta_share(2, 3, 1) == 1
    assert all(math.isnan(v) for v in (tx.gamma_share(0, 1), tx.gamma_share(1, -1), tx.beta_share(1, 0, 0.5), tx.beta_share(1, 1, 2)))
