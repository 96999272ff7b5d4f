"""Corpus pipeline: documents pass a quality classifier, line dedup, near-duplicate removal, decontamination, and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpulse.llm import bpe, decontam, line_dedup, near_dedup, quality
from sparkpulse.llm.common import scratch_path, table
from sparkpulse.llm.queries import tokenizer_path

#: The stages fit a classifier and merge by hashes of many sorts, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that stood in an earlier one; texts of which nothing is left go."""
    return line_dedup.dedup_lines(docs).where("removed_chunks = 0 OR trim(text) <> ''").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of copies and near copies; of repeated rows one."""
    return near_dedup.one_of_each(docs).select(*docs.columns)


def clean_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, and the digests of the ids and of the text they decode to."""
    return bpe.encode_rows(docs, tokenizer_path("word_bpe_49k.json"), ["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("near dedup", one_of_each),
    ("decontamination", clean_of_tests),
    ("BPE encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
