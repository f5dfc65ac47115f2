"""Run ledgers: what is done, what is pending, what it cost, how far it got.

Running sums are prefix scans over ranges of the sort key, so a run with a third of all rows, or with
all rows at one time, is still summed by many tasks. Money is summed as DECIMAL to make the result
independent of the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..session import materialise


def scan_parts(df: DataFrame, by: str, order: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """``df`` sorted over all tasks by group and order and stored, with the measures as ``_m_*``, the
    number of the range each row fell into as ``_part`` and what tells equal rows apart as ``_tie``.
    Ranges are cut by the planner's sample of whole sort keys, so a group with a third of all rows, or
    rows of one time only, lie in as many ranges as their size asks for."""
    tied = df.withColumns({f"_m_{n}": c for n, c in measures.items()}).withColumn("_tie", F.monotonically_increasing_id())
    ranges = tied.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (by, *order)], F.col("_tie").asc())
    return materialise(ranges.withColumn("_part", F.spark_partition_id()), "scan")


def running_before(
    df: DataFrame,
    by: str,
    order: Sequence[str],
    measures: Mapping[str, Column],
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds, per measure, its sum over the earlier rows of the same ``by`` group, and, per
    ``carry``, its value in the row just before (null in the first).

    A prefix scan: rows are dealt out by ranges of (group, order), each range is summed by itself, and
    the totals of the ranges, a row for each group in each, are summed up before it. Rows that are equal
    in all order columns follow each other in an order that is fixed for the call."""
    names, carry = list(measures), dict(carry or {})
    cut = scan_parts(df, by, order, measures)
    last = []
    if carry:
        cut = cut.withColumn("_row", F.struct(*[c.alias(n) for n, c in carry.items()]))
        last = [F.max_by("_row", F.struct(*order, "_tie")).alias("_s_row")]
    totals = cut.groupBy("_part", F.col(by).alias("_by")).agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names], *last)
    parts = W.partitionBy("_by").orderBy("_part")
    earlier = parts.rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(
        F.col("_part").alias("_p"),
        "_by",
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_p_{n}") for n in names],
        *([F.lag("_s_row").over(parts).alias("_p_row")] if carry else []),
    )
    rows = W.partitionBy("_part", by).orderBy(*[F.col(c).asc_nulls_first() for c in order], "_tie")
    within = rows.rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumns(
        {
            **{f"_l_{n}": F.sum(f"_m_{n}").over(within) for n in names},
            **({"_l_row": F.lag("_row").over(rows)} if carry else {}),
        }
    )
    joined = local.join(shifts, (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_by")))
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[(F.coalesce(f"_l_{n}", zero) + F.coalesce(f"_p_{n}", zero)).alias(n) for n in names],
        *[F.coalesce("_l_row", "_p_row")[n].alias(n) for n in carry],
    )


def money(c: Column) -> Column:
    return c.cast("decimal(18,6)")


def usage_cost(df: DataFrame, tokens_in: str = "input_tokens", tokens_out: str = "output_tokens", price_in: float = L.INPUT_PRICE, price_out: float = L.OUTPUT_PRICE, limit: int = L.OUTPUT_LIMIT) -> DataFrame:
    """Cost of each call and whether its output came near the limit."""
    cost = F.col(tokens_in) * F.lit(price_in) / 1000 + F.col(tokens_out) * F.lit(price_out) / 1000
    return df.withColumn("cost", cost).withColumn("near_limit", F.col(tokens_out) >= F.lit(limit * L.NEAR_LIMIT))


def budget_cutoff(df: DataFrame, budget: float, by: str = "run_id", cost: str = "cost", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Rows of each run that were still started within the budget: those whose earlier
    rows cost less than it in total."""
    spent = running_before(df, by, [ts, tie], {"spent_before": money(F.col(cost))})
    return spent.filter(F.col("spent_before") < money(F.lit(budget)))


def progress(df: DataFrame, by: str = "run_id", elapsed: str = "elapsed", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """After each row of a run: rows done, mean time per row so far and the time left at
    that pace."""
    before = running_before(df, by, [ts, tie], {"_done": F.lit(1).cast("bigint"), "_time": money(F.col(elapsed))})
    sizes = df.groupBy(F.col(by).alias("_run")).agg(F.count(F.lit(1)).alias("_total"))
    done = F.col("_done") + 1
    mean = (F.col("_time") + money(F.col(elapsed))).cast("double") / done
    return (
        before.join(sizes, F.col(by).eqNullSafe(F.col("_run")))
        .withColumn("done", done)
        .withColumn("mean_time", mean)
        .withColumn("eta", mean * (F.col("_total") - done))
        .drop("_done", "_time", "_run", "_total")
    )


def pending(inputs: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Inputs the ledger has no row for, by key (a row count would break on lost or
    multi-line rows)."""
    return inputs.join(ledger.select(key).distinct(), key, "left_anti")


def _exists(df_or_spark, path: str) -> bool:
    jvm = df_or_spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(df_or_spark._jsc.hadoopConfiguration())
    return fs.exists(target)


def stage(spark, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A step whose output is kept as Parquet: built once, read back afterwards. Only a
    write that committed (``_SUCCESS`` present) counts, so a half-written step is redone."""
    if not _exists(spark.sparkContext, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
