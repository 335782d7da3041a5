"""Values of text: what the smallest tables don't show."""

import base64

from pyspark.sql import functions as F

from lociframe.functions.text import base64_text


def test_base64_stays_on_one_line(spark):
    texts = ["", "x", "a" * 57, "a" * 58, "é" * 200]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "t string").select("t", base64_text(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == {x: base64.b64encode(x.encode()).decode() for x in texts} | {None: None}
