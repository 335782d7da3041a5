"""A corpus through five stages: quality rules, line dedup, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import jaccard, linededup, packing, pii, quality
from lociframe.llm.common import documents, materialise, prepare
from lociframe.llm.queries import tokenizer_path


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like, whatever others there are, with n_chars as the text now is (null of a null text)."""
    return docs.select([F.length("text").cast(like.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in like.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail go, null and empty texts among them; boilerplate lines go from the others. Equal rows fare alike."""
    prepare(spark)
    return _counted(quality.quality_rules(docs), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines, and long lines, go, and with them the documents of which nothing is left; null and empty texts stay."""
    prepare(spark)
    return _counted(linededup.without_repeated_runs(docs, long_words=linededup.LONG_WORDS).where("n_removed_lines = 0 or text rlike '[^ \\t-\\r]'"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at five-word shingles and a similarity of 0.8 the one of least doc_id stays; those without words all stay."""
    prepare(spark)
    return _counted(jaccard.keep_one(docs, n=5, num=4, den=5), docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to their kind in brackets; null and empty texts stay."""
    prepare(spark)
    return _counted(pii.redacted(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens and their places in sequences, null and empty texts as the end id alone; little is remembered, as the JVM has grown by now."""
    prepare(spark)
    return packing.packed_documents(docs, tokenizer_path(), remembered=100_000, text_bytes=2 << 20)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express scored patterns or tokenizers' ids; tests compare the stages and the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name)
    return docs
