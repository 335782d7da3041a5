"""Stream-static annotation: a stream of records joined with static databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import range_join
from ..scratch import shared_folder


def annotated_stream(stream: DataFrame, regions: DataFrame, **names) -> DataFrame:
    """The same range join as in batches; the static side is read once a micro-batch, and no state is kept."""
    return range_join(stream, regions, **names)


def annotated_once(spark: SparkSession, source: str, regions: DataFrame) -> DataFrame:
    """Run a file stream of orders to its end, and return each order's first region as a table.

    Micro-batches are appended to Parquet files in the shared folder, with their checkpoint beside them.
    """
    schema = spark.read.parquet(source).schema
    # A stream reads what a pattern matches: this one matches the table alone, be it a file or a folder.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{source[:-1]}[{source[-1]}]")
    points = stream.select("o_orderkey", F.lit("c1").alias("chrom"), (F.col("o_orderkey") % 14000).alias("pos"))
    out = annotated_stream(points, regions, bin_width=64).select("o_orderkey", "pos", "p_partkey")
    to = shared_folder(spark, "stream")
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{to}/state").outputMode("append").trigger(availableNow=True).start(f"{to}/rows")
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{to}/rows").groupBy("o_orderkey", "pos").agg(F.min("p_partkey").alias("p_partkey"))
