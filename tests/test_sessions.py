"""Sessions by ranges equal those by key; renamed values take the first of duplicates."""

import random

from lociframe.operators import relational as rl


def test_sessions_in_ranges(spark):
    rng = random.Random(1)
    rows, at = [], {}
    for i in range(4000):
        k = rng.choice(["hot"] * 8 + ["a", "b", None])
        at[k] = at.get(k, 0) + rng.choice([0, 1, 2, 9])
        rows.append((i, k, at[k], "x"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id int, k string, x bigint, _r string").drop("_r")
    want, last = {}, {}
    for i, k, x, _ in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        n, before = last.get(k, (0, None))
        n += before is None or x - before > 3
        last[k], want[i] = (n, x), n
    for most, parts in ((10**6, 64), (10, 7), (10, 40)):
        got = {r.id: r.session for r in rl.gap_sessions(df, "k", "x", 3, "id", most=most, parts=parts).collect()}
        assert got == want, (most, parts)
    assert rl.gap_sessions(df.limit(0), "k", "x", 3, "id").count() == 0


def test_first_of_duplicate_names(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    table = spark.createDataFrame([(2, "a", "late"), (1, "a", "zz"), (3, "q", "x")], "o int, old string, new string")
    assert sorted(str(r.v) for r in rl.renamed_values(df, "v", table, "old", "new", "o").collect()) == ["None", "b", "zz"]
    assert sorted(str(r.v) for r in rl.renamed_values(df, "v", table, "old", "new").collect()) == ["None", "b", "late"]
