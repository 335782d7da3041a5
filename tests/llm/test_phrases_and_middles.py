"""Collocations and fill-in-middle against brute force: nulls, copies, ties, long texts, empty tables, clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from lociframe.llm import fim, phrases
from lociframe.llm.common import prepare

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("n", T.LongType()), ("key", T.StringType()), ("phrase", T.StringType()), ("part", T.StringType()), ("form", T.StringType()))])


def rows_of(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 1, "k", "p", "x", "f") for r in rows], SCHEMA)


def test_scans_compose_to_the_whole():
    rng = random.Random(1)
    scan = fim.Scanner()
    for _ in range(60):
        texts = ["".join(rng.choice("ab<PSM>é€😀 ") for _ in range(rng.choice([0, 1, 5, 255, 257, 1500]))) for _ in range(rng.randint(1, 5))]
        raw = [t.encode() for t in texts]
        seen = scan.summaries(raw)[1][:, 0]
        assert [x % fim.MARK for x in seen] == [len(t) for t in texts]
        assert [x // fim.MARK for x in seen] == [sum(map(t.count, fim.SENTINELS)) for t in texts]
        ask = [(i, rng.randint(0, len(t))) for i, t in enumerate(texts) for _ in range(3)]
        got = scan.places(raw, np.array([i for i, _ in ask]), np.array([r for _, r in ask]), np.zeros(len(raw), np.int32))
        assert got.tolist() == [len(texts[i][:r].encode()) for i, r in ask]
        # Cut anywhere, inside code points and sentinels too: the parts' functions compose to the whole's.
        for t in raw:
            cut = sorted(rng.randint(0, len(t)) for _ in range(4))
            parts = [t[a:b] for a, b in zip([0, *cut], [*cut, len(t)], strict=True)]
            to, n = scan.composed(np.zeros(5, np.int64), *scan.summaries(parts))
            whole = scan.summaries([t])
            assert (to[-1] == whole[0][0]).all() and (n[-1] == whole[1][0]).all()


def expected_middle(doc, t):
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(t)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:lo], t[lo:hi], t[hi:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [fim.CHUNK, 37])
def test_fill_in_middle(spark, chunk):
    rng = random.Random(3)
    texts = [None, "", "a", "<P>", "x<S", "é<M>é", "<" * 50, *("".join(rng.choice("ab c\n<éP€😀") for _ in range(rng.randint(1, 400))) for _ in range(60)), "z€" * 40_000, "<P" * 30_000 + "<S>"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[20], None), (12, texts[12], "en"), (12, texts[13], "en")]
    got = fim.fill_in_middle(rows_of(spark, rows), chunk=chunk).selectExpr("*", f"{fim.restored()} as again").collect()
    want = Counter((d, *expected_middle(d, t or ""), t or "") for d, t, _ in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(rows_of(spark, rows).limit(0), chunk=chunk).count() == 0


def expected_phrases(rows, most, least, share, top):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in cand.items():
        inside = [b for q, b in cand.items() if q[0] == lang and len(q) > len(w) + 1 and any(list(q[i : i + len(w)]) == w for i in range(1, len(q)))]
        if not any(100 * b >= share * a for b in inside):
            score, k = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]], n[lang]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total, -s) for lang, found in out.items() for i, (s, a, p, left, right, total) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize(("least", "share", "top", "load"), [(8, 100, 2000, 40), (5, 80, 7, 40), (200, 100, 50, 40), (8, 100, 2000, 10**9)])
def test_collocations(spark, monkeypatch, least, share, top, load):
    monkeypatch.setattr(phrases, "SHARD", 3_000)
    monkeypatch.setattr(phrases, "LOAD", load)
    rng = random.Random(4)
    vocab = ["the", "of", "Über", "a\x00b", "\x1cq", "x", "hAs", "no", "wordé", "l" * 300]
    text = lambda k: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";", "\x0b", "-"]) for _ in range(k))
    rows = [(i, text(rng.randint(0, 60)), rng.choice(["en", "fr", None])) for i in range(80)]
    rows += [(100 + i, "one rare phrase here now, twice one", "en") for i in range(12)] + [(200, "x x " * 900, "en"), (201, None, "en"), (202, "", "de"), (203, ".;,", "nl"), (5, rows[5][1], rows[5][2])]
    docs = rows_of(spark, rows).repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=least, share=share, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == expected_phrases(rows, 5, least, share, top) and got


def test_collocations_of_nothing(spark):
    none = rows_of(spark, [])
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(rows_of(spark, [(1, None, None), (2, "", "en"), (3, "two words", "en")])).count() == 0


def test_matches_over_stretches_of_the_scan():
    rng = random.Random(5)
    codes = np.array([rng.randrange(3) for _ in range(700_000)])
    codes[::97] = -1
    wanted = [np.array([[0, 1], [1, 1]]), np.array([[0, 1, 1], [2, 2, 2]])]
    got = phrases.count_matches(codes, wanted, 3).tolist()
    assert got == [sum((codes[i : len(codes) - len(p) + 1 + i] == x for i, x in enumerate(p)), start=np.zeros(len(codes) - len(p) + 1, int)).tolist().count(len(p)) for block in wanted for p in block]


def test_products_beyond_64_bits(spark):
    a, n, left, right = 9 * 10**15, 8 * 10**17, 10**16 + 7, 3 * 10**16 + 1
    spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint").createOrReplaceTempView("big")
    product = lambda x, y: f"cast({x} as decimal(19, 0)) * cast({y} as decimal(18, 0))"
    assert spark.sql(f"select ({product('a', 'n')} * 1000BD) div ({product('l', 'r')}) as s from big").first().s == 1000 * a * n // (left * right)
