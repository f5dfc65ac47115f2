"""Resumable, exactly-once processing of a growing folder.

The file source and its checkpoint remember which input files were taken; the ledger keeps
the processed keys. Each micro-batch writes its own ``batch_id=n`` folder and overwrites it
when the batch is replayed after a failure, so a lost executor or driver never leaves
duplicates behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BUCKETS = 64  # a batch writes at most one file to each


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    from ..operators.ledger import _exists

    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())])
    if not _exists(spark.sparkContext, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches; an empty relation before the first one."""
    return _read(spark, path, schema).drop("bucket")


def seen_keys(batch: DataFrame, batch_id: int, ledger: str, key: str, schema: T.StructType) -> DataFrame:
    """The keys other batches have, from the buckets that the batch's own keys fall into: a batch of few
    keys reads a few of the ledger's parts. The numbers of the buckets come to the driver."""
    touched = [r["bucket"] for r in batch.select(_bucket(key).alias("bucket")).distinct().collect()]
    rows = _read(batch.sparkSession, ledger, schema).filter(F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id))
    return rows.select(key).distinct()


def append_batch(batch: DataFrame, batch_id: int, ledger: str, key: str, schema: T.StructType, process: Callable[[DataFrame], DataFrame]) -> None:
    """Process the rows of one batch whose key no other batch has, and write them under the
    batch id, in buckets of the key's hash. The batch's own folder is left out of the check so a
    replay gives the same rows."""
    fresh = batch.join(seen_keys(batch, batch_id, ledger, key, schema), key, "left_anti")
    # a key repeated inside the batch is processed once, by its least row, so a replay takes the same
    once = fresh.groupBy(key).agg(F.min(F.struct(*fresh.columns)).alias("_row")).select("_row.*")
    done = process(once).withColumn("bucket", _bucket(key)).repartition("bucket")
    done.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{ledger}/batch_id={batch_id}")


def run_available(
    spark: SparkSession,
    source: str,
    source_schema: T.StructType,
    ledger: str,
    checkpoint: str,
    key: str,
    ledger_schema: T.StructType,
    process: Callable[[DataFrame], DataFrame],
    glob: str = "*.parquet",
    files_per_batch: int | None = None,
) -> None:
    """Take everything that is new in ``source``, then stop. Run it again after new files
    arrive, or after a crash: finished work is not repeated."""
    reader = spark.readStream.schema(source_schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(
            lambda df, i: append_batch(df, i, ledger, key, ledger_schema, process)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
