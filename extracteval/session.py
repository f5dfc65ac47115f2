"""Session helpers: a sensible default session and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_ROWS = 4_000_000  # rows of the largest relation that one slice has, about
MOST_SLICES = 8  # each slice reads its inputs anew


def get_spark(app: str = "extracteval", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time; ``conf`` overrides any key
    (dots written as ``__``)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` as the cluster set it.

    Where it is unset a temporary folder is used, and only under a local master, so
    that a cluster job never writes to one machine's disk by accident.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="extracteval-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run below the shared folder; nothing is ever reused or deleted."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a relation that several steps need as Parquet in the shared folder and go on
    from the files: the work behind it is done once, survives the loss of executors, and
    the planner sees its true size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go as soon as it has run, instead of when the driver
    happens to collect its garbage."""
    was = spark.conf.get(CLEAN, None)
    try:
        spark.conf.set(CLEAN, "true")
        yield
    finally:
        spark.conf.unset(CLEAN) if was is None else spark.conf.set(CLEAN, was)


def slices_for(rows: int) -> int:
    """In how many slices a step over that many rows is taken."""
    return min(rows // SLICE_ROWS + 1, MOST_SLICES)


def store_slices(
    spark: SparkSession, makes: Sequence[Callable[[Callable[[DataFrame], DataFrame]], DataFrame]], on: str, slices: int, name: str
) -> DataFrame:
    """What each of ``makes`` gives for every slice of the keys ``on``, written one after the other
    into one folder, so that the disk holds the shuffles of one of them at a time. ``make`` gets the
    function that keeps a slice's rows of a relation; all rows of a key are in one slice, and those
    without a key are in one as well."""
    path = scratch_path(spark, name)
    with dropping_shuffles(spark):
        for make in makes:
            for i in range(slices):
                out = make(lambda df: df.where(F.pmod(F.xxhash64(on), F.lit(slices)) == i) if slices > 1 else df)
                out.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
