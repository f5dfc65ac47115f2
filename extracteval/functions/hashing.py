"""Reproducible draws. Order comes from md5(seed | key), never from a random generator,
so results do not depend on partitioning and any SQL engine can recompute them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_hex(seed: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def hash_int(seed: str, *keys: Column) -> Column:
    """The first 32 bits of the hash as a non-negative number."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 8), 16, 10).cast("bigint")


def hash_rank(
    df: DataFrame,
    key: str,
    seed: str,
    by: Sequence[str] = (),
    out: str = "hash_rank",
    prefix: int = 3,
) -> DataFrame:
    """Exact 1-based rank of each row in hash order, over the table or within ``by``.

    A plain ``row_number`` would pull a hot group (or the whole table) through one task.
    Here rows are cut into 16**prefix slices by the leading hash digits, which are
    uniform whatever the data; each slice is ranked by itself and shifted by the number
    of rows in earlier slices. ``key`` must be unique within the group.
    """
    by = list(by)
    # the slice key is one struct: it groups, partitions and joins alike (null labels
    # included), so the ranked rows meet their shifts without moving again
    cell = F.struct(*[F.col(b).alias(f"by{i}") for i, b in enumerate(by)], F.substring("_hash", 1, prefix).alias("slice"))
    sliced = df.withColumn("_hash", hash_hex(seed, F.col(key))).withColumn("_cell", cell)
    counts = sliced.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    # at most 16**prefix rows per group reach this window
    earlier = (
        W.partitionBy(*([F.col(f"_cell.by{i}") for i in range(len(by))] or [F.lit(0)]))
        .orderBy("_cell.slice")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    shifts = counts.select("_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    within = W.partitionBy("_cell").orderBy("_hash", key)
    return (
        sliced.withColumn("_local", F.row_number().over(within))
        .join(shifts, "_cell")
        .withColumn(out, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .select(*df.columns, out)
    )


def hash_cut(df: DataFrame, hashed: str, n: int, fits: int = 4096) -> tuple[str, int] | None:
    """Where the ``n``-th row in the order of the hex column ``hashed`` lies: the leading digits of its
    slice, and how many rows of that slice are among the first ``n``. None if there are no more than
    ``n`` rows. Slices are cut finer until one holds at most ``fits`` rows (or equal hashes only):
    each round counts 4,096 slices of the one before and fetches one row."""
    edge, rest = "", n
    while True:
        digits = min(len(edge) + 3, 32)
        inside = df.filter(F.substring(hashed, 1, len(edge)) == edge) if edge else df
        counts = inside.groupBy(F.substring(hashed, 1, digits).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("slice"))
        found = counts.withColumn("upto", upto).filter(F.col("upto") > rest).orderBy("slice").limit(1).first()
        if found is None:
            return None
        edge, rest = found["slice"], rest - (found["upto"] - found["n"])
        if found["n"] <= fits or digits == 32:
            return edge, int(rest)
