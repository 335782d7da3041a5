"""Bin completion against exact optima, and the parts of its search against plain enumeration."""

import random
from collections import Counter
from itertools import product

from lociframe.llm import packing


def optimum(items, capacity):
    """The fewest sequences, by dynamic programming over all subsets: (sequences, tokens in the last)."""
    n = len(items)
    best = [(1, 0)] + [(n + 1, 0)] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        for i in range(n):
            if m >> i & 1:
                c, used = best[m ^ (1 << i)]
                best[m] = min(best[m], (c, used + items[i]) if used + items[i] <= capacity else (c + 1, items[i]))
    return best[-1][0] if n else 0


def sequences(patterns):
    return sum(p.times for p in patterns)


def test_reaches_the_optimum_and_beats_best_fit():
    rng, beaten = random.Random(1), 0
    for _ in range(400):
        capacity = rng.choice((20, 100, 1000, 4096))
        low, high = rng.choice((1, capacity // 10, capacity // 6)), rng.choice((capacity, capacity // 2, capacity * 2 // 3))
        items = [rng.randint(max(1, low), high) for _ in range(rng.randint(6, 12))]
        counts = Counter(items)
        packed = packing.completion(counts, capacity)
        back = Counter()
        for p in packed:
            assert sum(p.lengths) <= capacity
            for k in p.lengths:
                back[k] += p.times
        best = optimum(items, capacity)
        assert back == counts and sequences(packed) == best
        assert packing.lower_bound(counts, capacity) <= best if items else not packed
        beaten += best < sequences(packing.best_fit_decreasing(counts, capacity))
    assert beaten > 3


def test_many_tiny_pieces():
    packed = packing.completion({2900: 1, 1400: 8, 1: 1100}, 4096)
    assert sequences(packed) == 5 and sum(len(p.lengths) * p.times for p in packed) == 1109
    assert sequences(packing.completion({1: 10**7}, 4096)) == -(-(10**7) // 4096)


def dominated(chosen, waste, outside):
    """By definition: some piece outside fits in place of a set of chosen ones, one of its own length excepted."""
    for pick in product((0, 1), repeat=len(chosen)):
        s, n = sum(c for c, p in zip(chosen, pick, strict=True) if p), sum(pick)
        if any(s <= x <= s + waste and not (n == 1 and s == x) for x in outside):
            return True
    return False


def test_fillings_are_all_that_are_undominated():
    rng = random.Random(7)
    for _ in range(200):
        room = rng.randint(5, 40)
        counts = Counter(rng.randint(1, room + 5) for _ in range(rng.randint(1, 7)))
        expect = set()
        for times in product(*(range(n + 1) for n in counts.values())):
            chosen = sorted(Counter(dict(zip(counts, times, strict=True))).elements(), reverse=True)
            outside = [k for k, n, c in zip(counts, counts.values(), times, strict=True) if n > c]
            waste = room - sum(chosen)
            if 0 <= waste <= 6 and not dominated(chosen, waste, outside):
                expect.add((waste, tuple(chosen)))
        found = list(packing.fillings(packing.Pieces(counts), room, 6, [10**6]))
        assert len(found) == len(set(found)) and set(found) == expect
