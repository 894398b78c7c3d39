"""From raw documents to training tokens: language ID, near duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of `docs`. `run`
writes each stage as Parquet into the shared checkpoint folder and rereads it,
so that a lost executor costs one stage's tasks at most.

Cases: each stage takes null columns, empty and very long texts, repeated rows,
empty tables and extra columns as its operator's docstring says; rows that the
language stage cannot tell (null or letterless texts) leave first.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm import decontaminate, language_id, mixing, simhash, wavelet
from corpusgate.llm.common import staged, table
from corpusgate.llm.token_counts import tokenizer_path
from corpusgate.session import scratch_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language cannot be told."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash class: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a benchmark window occurs."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)

REMEMBERED = 300_000  # pieces of one worker: the other stages' workers and heap are still there


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode into wavelet-matrix files and read back where each document's tokens lie."""
    path = f"{scratch_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    wavelet.write(docs.select(F.col("doc_id"), F.col("text")), path, tokenizer_path(), remembered=REMEMBERED)
    return wavelet.read(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# language model, fingerprints, components and token ids are not expressible in SQL; tests/llm holds a brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
