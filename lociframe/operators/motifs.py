"""Motifs over sequence columns: places where they fit, and how a change alters a weight matrix's best score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ..functions.align import best_change, motif_hits_of
from ..shipping import ship


def motif_matches(df: DataFrame, seq: str, motifs: dict[str, str], mismatches: int = 0, keep: list[str] | None = None) -> DataFrame:
    """A row (kept columns, motif, at) for each 0-based place of the sequence where a motif in ambiguity codes fits.

    At most so many letters may differ; a null sequence has no places. Rows are independent: no shuffle.
    """
    ship(df.sparkSession)
    keep = keep or [c for c in df.columns if c != seq]
    schema = df.select(*keep).schema.add("motif", StringType()).add("at", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for name, motif in motifs.items():
                row, at = map(pa.array, motif_hits_of(texts, motif, mismatches))
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(row) for i in range(len(keep))], pa.array([name] * len(row), pa.string()), at], names=[*keep, "motif", "at"])

    return df.select(*keep, F.col(seq).cast("string").alias("_seq")).mapInArrow(run, schema)


#: Matrices that are sent to the executors: a collection has some hundreds.
MOST_MATRICES = 20_000


def matrix_changes(df: DataFrame, before: str, after: str, matrices: DataFrame, into: tuple[str, str] = ("matrix", "change")) -> DataFrame:
    """df with the matrix whose best score changes most from one sequence to the other, by magnitude, and that change.

    Of equal changes the matrix of least name counts. Matrices longer than a sequence change nothing. Both are null without
    a sequence or without matrices. There may be MOST_MATRICES of these; more are refused.
    """
    ship(df.sparkSession)
    rows = sorted((r.name, np.array(r.weights, float)) for r in matrices.limit(MOST_MATRICES + 1).collect())
    if len(rows) > MOST_MATRICES:
        raise ValueError(f"more than {MOST_MATRICES} matrices")
    sent = df.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf("struct<name:string,change:double>")
    def best(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            found = None
            for name, w in sent.value if x is not None and y is not None else ():
                c = best_change(x, y, w)
                if found is None or abs(c) > abs(found["change"]):
                    found = {"name": name, "change": c}
            out.append(found)
        return pa.array(out, pa.struct([("name", pa.string()), ("change", pa.float64())]))

    found = df.withColumn("_best", best(F.col(before).cast("string"), F.col(after).cast("string")))
    return found.select(*df.columns, F.col("_best.name").alias(into[0]), F.col("_best.change").alias(into[1]))
