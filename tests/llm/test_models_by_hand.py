"""op1's fingerprints and op5's weights worked out again in plain Python integers and floats."""

import math
import random
from collections import Counter

import xxhash

from lociframe.llm import resample, winnow
from lociframe.llm.common import ship

MASK = (1 << 64) - 1


def finished(x):
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> 33)) * c & MASK
    return x ^ (x >> 33)


def selected(text, k, w):
    """Winnowing by its definition: all grams' hashes, of each window the least, of equal ones the rightmost."""
    points = [ord(c) + 1 for c in text]
    if not points:
        return []
    k = min(k, len(points))
    grams = []
    for i in range(len(points) - k + 1):
        h = 0
        for p in points[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + p) & MASK
        grams.append(finished(h))
    w, out = min(w, len(grams)), []
    for i in range(len(grams) - w + 1):
        at = min(range(i, i + w), key=lambda j: (grams[j], -j))
        if not out or out[-1] != (at, grams[at]):
            out.append((at, grams[at]))
    return out


def test_fingerprints_by_definition():
    rng = random.Random(51)
    for _ in range(120):
        text = "".join(rng.choices("ab é🙂\n", k=rng.randint(0, 90)))
        k, w = rng.choice(((winnow.K, winnow.W), (3, 4), (1, 1), (5, 2)))
        at, hashes = winnow.fingerprint(text, k, w)
        assert list(zip(at.tolist(), hashes.tolist(), strict=True)) == selected(text, k, w)
        other = "".join(rng.choices("ab é🙂\n", k=rng.randint(0, 90)))
        a, b = ({h for _, h in selected(t, k, w)} for t in (text, other))
        likeness = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(winnow.likeness(hashes, winnow.fingerprint(other, k, w)[1]) - likeness) < 1e-12


def features(text):
    h = [finished(xxhash.xxh3_64_intdigest(x.encode())) for x in text.lower().split(" ") if x]
    n = resample.BUCKETS
    return [x % n for x in h], [finished((a * 0x9E3779B97F4A7C15 + b) & MASK) % n for a, b in zip(h, h[1:], strict=False)]


def test_weights_by_the_two_models(spark):
    ship(spark)
    rng = random.Random(52)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary[: 30 if i % 3 else 60], k=rng.randint(1, 40)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = [(i, int(i % 3 == 0), int(i == 30)) for i in range(60)]
    good = {i for i, q, t in labels if q and not t}
    counts = {name: [Counter(), Counter()] for name in ("target", "raw")}
    for i, t in rows:
        for kind, found in enumerate(features(t)):
            counts["raw"][kind].update(found)
            if i in good:
                counts["target"][kind].update(found)

    def log_p(name, kind, bucket):
        c, n = counts[name][kind], resample.BUCKETS
        total = sum(c.values())
        add = resample.SMOOTHING * total / n
        return math.log((c[bucket] + add) / (total + add * n))

    out = {r.doc_id: r for r in resample.resample(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), share=0.4).collect()}
    for i, t in rows:
        weight = sum(log_p("target", kind, x) - log_p("raw", kind, x) for kind, found in enumerate(features(t)) for x in found)
        assert abs(out[i].log_weight - weight) < 1e-3 * max(1, abs(weight))
    keys = sorted((r.gumbel_key for r in out.values()), reverse=True)
    assert {i for i, r in out.items() if r.kept} == {i for i, r in out.items() if r.gumbel_key >= keys[35]}
    noise = [r.gumbel_key - r.log_weight for r in out.values()]
    assert 0.2 < sum(noise) / len(noise) < 1.0  # Gumbel's mean is 0.577
