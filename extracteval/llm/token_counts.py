"""Token counts behind a digest cache.

The cache is a Parquet folder of ``content, version, n_tokens``: the digest of a text, the digest of
the tokenizer that counted it, the count. Texts are joined to it by digest; only distinct texts that
it doesn't have are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "content string, version string, n_tokens bigint"
DOCS = 64  # texts whose ids are in memory at once


def content(text: Column) -> Column:
    """The text as the tokenizer counts it: null as empty. Nothing else is made equal, since white
    space and case do change a count."""
    return F.coalesce(text, F.lit(""))


def version(path: str) -> str:
    """Digest of the tokenizer: its file and its library."""
    import sentencepiece

    with open(path, "rb") as f:
        return hashlib.sha256(sentencepiece.__version__.encode() + b"\0" + f.read()).hexdigest()


def read_cache(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """``content, n_tokens`` of one tokenizer; a replayed append repeats rows, which counts once."""
    try:
        rows = spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("version") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """``content, n_tokens`` of ``content, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            counts = []
            for lo in range(0, batch.num_rows, DOCS):
                part = batch["text"].slice(lo, DOCS).to_pylist()
                counts += [len(ids) for ids in model.encode(part, num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch["content"], pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content string, n_tokens bigint")


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``path`` is a sentencepiece model that every executor can read, ``cache`` the cache's folder.

    * null text: counted as empty, 0 bytes;
    * very long texts: encoded whole;
    * repeated rows and equal texts: encoded once, each row gets the count; null ``doc_id``: a row
      like any other;
    * empty table: no rows, nothing appended. Other columns are ignored, whatever their names.
    """
    spark, tokenizer = docs.sparkSession, version(path)
    text = content(F.col("text"))
    texts = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("content"), text.alias("text"))
    # one text of each digest, chosen before the shuffle as well
    distinct = texts.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, tokenizer), "content", "left_anti")
    counted = encode_counts(misses, path).select("content", F.lit(tokenizer).alias("version"), "n_tokens")
    counted.write.mode("append").parquet(cache)
    known = read_cache(spark, cache, tokenizer)
    return texts.drop("text").join(known, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
