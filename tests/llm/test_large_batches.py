"""Batches of any size: a worker's memory must not depend on how many rows Spark puts in one."""

import pyarrow as pa

import corpus_pipeline
from lociframe.llm import packing
from lociframe.llm.common import BATCH_ROWS
from lociframe.llm.queries import tokenizer_path


def test_large_batches_are_cut_for_encoding():
    texts = [f"text {i} " * (i % 40) for i in range(3000)] + ["x" * 50_000, "", "end"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "t"])
    parts = list(packing.gathered(iter([batch.slice(0, 0), batch, batch.slice(5, 3)]), 20_000))
    assert [x for _, t in parts for x in t.to_pylist()] == texts + texts[5:8]
    assert [x for d, _ in parts for x in d.to_pylist()] == [*range(len(texts)), 5, 6, 7]
    assert all(t.nbytes + d.nbytes <= 20_000 or len(t) == 1 for d, t in parts) and len(parts) > 10
    encode = packing.ChunkIds(tokenizer_path())
    assert [x for _, t in parts for x in encode(t)] == list(encode(pa.array(texts + texts[5:8])))


def test_each_stage_alone_keeps_batches_small(spark):
    docs = spark.createDataFrame([(1, "some words of a text", "en", "s", 20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.set(key, "10000")
        stage(spark, docs, "")
        assert spark.conf.get(key) == str(BATCH_ROWS)
