"""Every registered query that has SQL against it, on the smallest tables."""

from pathlib import Path

import pytest

from lociframe.plans import element_queries, file_queries, record_queries, region_queries  # noqa: F401
from lociframe.plans.table_queries import ORACLES, QUERIES
from lociframe.sources.vcf import region

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def views():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, views, name):
    got = QUERIES[name](spark, str(DATA))
    want = views.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    shown = lambda x: round(x, 6) if isinstance(x, float) else x
    left = sorted(str([shown(r[c]) for c in cols]) for r in got.collect())
    right = sorted(str([shown(x) for x in r]) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
    assert left == right


def test_regions():
    assert [region(x) for x in ("c1", "c1:120", "HLA:A:1,000-2,000", "c1:5-")] == [("c1", 0, None), ("c1", 119, None), ("HLA:A", 999, 2000), ("c1", 4, None)]
    for x in ("", "c1:9-3"):
        with pytest.raises(ValueError):
            region(x)
