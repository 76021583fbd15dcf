"""From raw documents to token files: five stages, each written and read again before the next.

STAGES are (name, function); a function takes the session, the documents its predecessor kept and the table folder. All but
the last return the columns of documents, and each calls one operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterwise.llm import common, decontamination, jaccard, mixing, registry, tokens, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects with a score of 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")))
    return toxicity.without_toxic(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that 0.8 of five-word shingles links."""
    return jaccard.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with ten words in a row, or a whole shorter item, of the benchmark."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet weights that grow with the root of their size."""
    return mixing.mix_sources(docs, mixing.root_weights(docs)).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and their index, and returns what they hold of each document."""
    return tokens.token_table(docs, registry.tokenizer_file())


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("source mixture", mixed),
    ("token files", token_files),
]

#: A trained classifier and a tokenizer are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
