"""A training corpus from raw documents: five stages, each written and read again.

Every stage gets what the one before kept, decides over all of it, and returns documents; the last
returns what the token files hold.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from extracteval.llm import inverted_index, minhash, mixing, token_files, toxicity
from extracteval.llm.registry import table
from extracteval.session import materialise, scratch_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays, one without an id only if
    none has one. Rows that are equal in id and text are one document."""
    return minhash.drop_near_copies(docs, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return inverted_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a row for each pass over a document, with the
    words that the mix takes of it."""
    return mixing.mixed_documents(docs, length="n_chars")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files, and what they hold of each row."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.token_files(docs, path, scratch_path(spark, "corpus-ids")).drop("file")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_tokens),
]

#: a trained classifier and a tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
