"""File-tree manifests and run logs."""

from __future__ import annotations

import hashlib
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import file_name
from ..operators.ledger import running_before
from ..session import materialise

_LISTED = "inner string, is_file boolean, size_bytes bigint, micros bigint"
_HASHED = "inner string, size_bytes bigint, micros bigint, sha256 string"
TASK_BYTES, TASK_FILES = 128 << 20, 1_000  # what one task digests, about
TASK_FOLDERS = 100  # what one task lists, about
MOST_TASKS = 10_000


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(quote(uri, safe=":/"))


def _list_folders(uri: str, glob: str):
    """What stands directly in each folder: subfolders, and files with a name like ``glob``."""

    def run(batches):
        from fnmatch import fnmatchcase

        import pyarrow as pa
        from pyarrow import fs

        system, _ = _open(uri)
        types = [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        for batch in batches:
            for folder in batch["inner"].to_pylist():
                found = system.get_file_info(fs.FileSelector(folder))
                kept = [(f.path, f.is_file, f.size, f.mtime_ns and f.mtime_ns // 1000) for f in found if not f.is_file or fnmatchcase(f.base_name, glob)]
                columns = zip(*kept) if kept else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["inner", "is_file", "size_bytes", "micros"])

    return run


def _digest_files(uri: str):
    """SHA-256 of each file, read block by block, so that no task has to hold one."""

    def run(batches):
        import pyarrow as pa

        system, _ = _open(uri)
        for batch in batches:
            hashes = []
            for inner in batch["inner"].to_pylist():
                digest = hashlib.sha256()
                with system.open_input_stream(inner, compression=None) as stream:
                    while block := stream.read(1 << 20):
                        digest.update(block)
                hashes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["inner"], batch["size_bytes"], batch["micros"], pa.array(hashes, pa.string())], ["inner", "size_bytes", "micros", "sha256"])

    return run


def list_files(spark: SparkSession, uri: str, glob: str = "*") -> DataFrame:
    """``inner, size_bytes, micros`` of every file below a folder, empty and hidden ones as well, which
    Spark's own listing leaves out. Tasks list one level of folders after the other, each level
    stored, so neither the driver nor any task holds the tree; the rounds are its depth."""
    _, root = _open(uri)
    folders, levels = spark.createDataFrame([(root,)], "inner string"), []
    cores = spark.sparkContext.defaultParallelism
    while n := folders.count():
        # a task for every folder would start a worker, and leave a file of the level, for each
        tasks = max(n // TASK_FOLDERS + 1, min(n, cores))
        level = folders.repartition(min(tasks, MOST_TASKS)).mapInArrow(_list_folders(uri, glob), _LISTED)
        level = materialise(level, "listed")
        levels.append(level.where("is_file").drop("is_file"))
        folders = level.where("not is_file").select("inner")
    return reduce(DataFrame.union, levels)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, file_name, size_bytes, modified_time, sha256`` of every file below a folder.

    The listed files are dealt out by hash of their path, to as many tasks as their bytes and number
    ask for: a folder with most of the files is digested by many tasks. One file is one task, as
    SHA-256 has no parallel form."""
    base = path.rstrip("/") if "://" in path else "file:" + path.rstrip("/")
    uri = base if "://" in base else "file://" + base.removeprefix("file:")
    listed, (_, root) = list_files(spark, uri, glob), _open(uri)
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    tasks = max(size // TASK_BYTES + n // TASK_FILES + 1, min(n, spark.sparkContext.defaultParallelism))
    hashed = listed.repartition(min(tasks, MOST_TASKS), "inner").mapInArrow(_digest_files(uri), _HASHED)
    full = F.concat(F.lit(base), F.substring("inner", len(root.rstrip("/")) + 1, 1 << 20))
    return hashed.select(full.alias("path"), file_name(F.col("inner")).alias("file_name"), "size_bytes", F.timestamp_micros("micros").alias("modified_time"), "sha256")


def write_manifest(manifest_df: DataFrame, path: str) -> None:
    """The rows and their roll-up, as two tables below ``path``."""
    from ..operators.audit import manifest_rollup

    manifest_df.write.mode("errorifexists").parquet(f"{path}/files")
    manifest_rollup(manifest_df).write.mode("errorifexists").parquet(f"{path}/rollup")


# The shape of a progress line.
LOG_TIME = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]"
LOG_PROGRESS = r"Progress: (\d+)/(\d+) .*Success: (\d+) \| Failed: (\d+)"


def parse_log_lines(lines: DataFrame, line: str = "value", log: str = "log") -> DataFrame:
    """Progress lines of run logs: per batch the rows done, succeeded and failed since the
    line before, the seconds they took, and rows per second. ``lines`` is ``(log, value)``.

    The line before is carried from one chunk to the next, so no window ever holds a whole
    log."""
    def number(i: int):
        return F.regexp_extract(line, LOG_PROGRESS, i).cast("bigint")

    found = lines.filter(F.col(line).rlike(LOG_PROGRESS)).select(
        log,
        F.to_timestamp(F.regexp_extract(line, LOG_TIME, 1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        number(1).alias("done"),
        number(2).alias("total"),
        number(3).alias("success"),
        number(4).alias("failed"),
    )
    numbered = running_before(
        found,
        log,
        ["ts", "done"],
        {"batch": F.lit(1).cast("bigint")},
        {f"p_{c}": F.col(c) for c in ("ts", "done", "success", "failed")},
    )
    start = (
        lines.filter(F.col(line).rlike(LOG_TIME))
        .groupBy(log)
        .agg(F.min(F.to_timestamp(F.regexp_extract(line, LOG_TIME, 1), "yyyy-MM-dd HH:mm:ss")).alias("started"))
    )
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.coalesce("p_ts", "started"))
    delta = lambda c: (F.col(c) - F.coalesce(F.col(f"p_{c}"), F.lit(0))).alias(f"batch_{c}")
    return (
        numbered.join(start, log)
        .select(
            log,
            (F.col("batch") + 1).alias("batch"),
            "done",
            "total",
            delta("done"),
            delta("success"),
            delta("failed"),
            seconds.alias("seconds"),
            F.try_divide(F.col("done") - F.coalesce("p_done", F.lit(0)), seconds).alias("rows_per_second"),
        )
    )


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(file_name(F.input_file_name()).alias("log"), "value")
    return parse_log_lines(lines)
