"""Run-length indexes and the removal of earlier byte strings, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from lociframe.llm import runindex
from lociframe.llm.common import prepare

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("key", T.StringType()), ("anchor", T.StringType()), ("first", T.StringType()), ("n_bytes", T.StringType()))])


def test_statistics_by_definition():
    rng = random.Random(1)
    for k in range(60):
        t = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.choice([0, 1, 2, 9, 200]))]
        if k % 3 == 0:
            t = t[:40] * 5
        index = runindex.RunIndex(np.array(t, np.int16))
        order = sorted(range(len(t)), key=lambda i: t[i:])
        before = [t[i - 1] if i else -1 for i in order]
        assert np.repeat(index.symbol, index.length).tolist() == before
        length, source = index.statistics()
        for a, b in zip([None, *order], order, strict=False):
            common = 0
            while a is not None and max(a, b) + common < len(t) and t[a + common] == t[b + common]:
                common += 1
            assert (length[b], source[b]) == (common, -1 if a is None else a)


def test_a_repetitive_text_has_few_runs():
    rng = random.Random(2)
    base = [rng.randrange(256) for _ in range(400)]
    assert len(runindex.RunIndex(np.array(base * 40, np.int16)).symbol) < 500


def expected(rows, length):
    seen, out = {}, Counter()
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1]}, key=lambda x: (x[0], x[1]))
    for none, doc, t in order:
        b = t.encode()
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], ((none, doc, t), i))
    for doc, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] != ((doc is None, doc or 0, t), i):
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("sizes", [{}, {"bucket": 3000}, {"hot": 3}, {"hot": 1, "bucket": 500}])
@pytest.mark.parametrize("length, gram", [(100, 32), (30, 7)])
def test_earlier_strings(spark, length, gram, sizes):
    prepare(spark)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé f\n€") for _ in range(n))
    shared, edge, base = text(160), text(41), text(700)
    texts = [None, "", "short", base, base, base, "a" * 500, "ab" * 300, "é" * 300]
    for i in range(40):
        t = text(rng.randint(0, 500))
        texts.append(t + (shared if i % 3 == 0 else edge if i % 3 == 1 else "") + text(rng.randint(0, 300)))
    for _ in range(6):
        at = rng.randrange(len(base))
        texts.append(base[:at] + text(3) + base[at:])
    texts += [text(120_000), shared + text(40) + shared, shared[:-1] + "x" + shared[1:]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, texts[10]), (None, texts[12])]
    docs = spark.createDataFrame([(*r, "k", "a", "f", "n") for r in rows], SCHEMA).repartition(3)
    got = runindex.without_earlier_strings(docs, length=length, gram=gram, **sizes)
    assert got.columns == ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    got = got.collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected(rows, length)
    assert all(r.kept is None or hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_no_documents(spark):
    prepare(spark)
    assert runindex.without_earlier_strings(spark.createDataFrame([], SCHEMA)).count() == 0
