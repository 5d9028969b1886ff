"""A training-data pipeline over ``documents``: each stage's result is written, read again and given to the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docsieve.llm import exact_dedup, packing, quality, simhash, suffix_dedup
from docsieve.llm.common import remove_tables, shared_dir, table, tables_written

_left: list[str] = []


def _stage(operator: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that removes the intermediate tables of those before it, unless ``docs`` still reads them: a saved result does not."""

    @wraps(operator)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = "\n".join(docs.inputFiles()) if _left else ""
        done = [p for p in _left if p.rsplit("/", 1)[-1] not in read]
        remove_tables(spark, done)
        _left[:] = [p for p in _left if p not in done]
        with tables_written() as paths:
            out = operator(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run_stage


@_stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return exact_dedup.drop_copies(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_one_per_group(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 200-byte strings that occur elsewhere; ``n_chars`` follows the text."""
    return suffix_dedup.remove_repeats(docs)


@_stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed_sequences),
]

#: A trained network and suffix arrays have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/docsieve-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        if k:
            remove_tables(spark, [f"{base}/{k - 1}"])
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
