"""Suffix automata against brute force, and the removal of reference spans through them."""

import random

import numpy as np

from lociframe.llm import automaton
from lociframe.llm.common import ship


def brute(text, passages):
    runs = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(text))]


def test_statistics():
    rng = random.Random(41)
    for _ in range(150):
        passages = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 15))] for _ in range(rng.randint(0, 4))]
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 25))]
        a = automaton.Automaton(passages)
        found = a.statistics(text)
        assert found.tolist() == brute(text, passages)
        assert len(a.long) <= 2 * (sum(map(len, passages)) + len(passages)) + 1
        for length in (1, 3):
            expect = {j for i, n in enumerate(found.tolist()) if n >= length for j in range(i - n + 1, i + 1)}
            assert set(np.flatnonzero(automaton.covered(found, length)).tolist()) == expect


def test_spans_of_references_go(spark):
    ship(spark)
    rng = random.Random(42)
    word = lambda: "".join(rng.choices("abcde", k=2))
    refs = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(12)] + [None, "", refs0 := "one two three four five six"]
    texts = [None, "", refs0, *[" ".join([*(word() for _ in range(20)), *(rng.choice(refs[:12]).split()), *(word() for _ in range(9))]) for _ in range(40)]]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[4])], "doc_id bigint, text string")
    passages = [r.split(" ") for r in refs if r]
    for words in (20, 10_000):
        got = automaton.without_reference_spans(docs, spark.createDataFrame([(r,) for r in refs], "text string"), length=4, words=words).collect()
        assert len(got) == docs.count()
        for r in got:
            w = (texts[4 if r.doc_id is None else r.doc_id] or "").split()
            # A run lies within one passage, so every window of four words of it does.
            gone = {j for p in passages for k in range(len(p) - 3) for i in range(len(w) - 3) if w[i : i + 4] == p[k : k + 4] for j in range(i, i + 4)}
            assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    assert automaton.without_reference_spans(docs, spark.createDataFrame([], "text string")).count() == docs.count()
