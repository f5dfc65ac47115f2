"""Bringing sources together by query.

Duplicates are removed with ``min_by``/``max_by`` aggregates, not with a window: they
combine on the map side, so a query that makes up a third of a table costs one partial
row per task instead of one giant sort. After that every join meets one row per query on
the deduplicated side, and only the kept side can be hot, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: str | Sequence[str], ord: str, pick) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.col(ord)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def keep_first(df: DataFrame, key: str | Sequence[str], ord: str) -> DataFrame:
    """One row per key: the earliest by ``ord``."""
    return _pick(df, key, ord, F.min_by)


def keep_last(df: DataFrame, key: str | Sequence[str], ord: str) -> DataFrame:
    """One row per key: the latest by ``ord``, as when a dict entry is overwritten."""
    return _pick(df, key, ord, F.max_by)


def _named(df: DataFrame, on: str, ord: str, name: str) -> DataFrame:
    return df.select(on, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in (on, ord)])


def align_inner(sources: dict[str, DataFrame], on: str = "query", ord: str = "ord") -> DataFrame:
    """Queries present in every source, first occurrence of each; other columns are
    prefixed with the source name."""
    parts = [_named(keep_first(df, on, ord), on, ord, name) for name, df in sources.items()]
    return reduce(lambda a, b: a.join(b, on), parts)


def align_outer(
    sources: dict[str, DataFrame], counts: Sequence[str], on: str = "query"
) -> DataFrame:
    """Full outer join; the listed count columns are 0 where a source lacks the query.
    Rows are matched as they are (duplicates multiply), so deduplicate first if needed."""
    parts = [
        df.select(on, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != on])
        for name, df in sources.items()
    ]
    joined = reduce(lambda a, b: a.join(b, on, "full"), parts)
    filled = {f"{name}_{c}" for name in sources for c in counts}
    return joined.select(
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in filled else F.col(c) for c in joined.columns]
    )


def align_left(base: DataFrame, others: dict[str, DataFrame], on: str = "query", ord: str = "ord") -> DataFrame:
    """Every base row, its duplicates included, with the first match of each other source."""
    out = base
    for name, df in others.items():
        out = out.join(_named(keep_first(df, on, ord), on, ord, name), on, "left")
    return out


def align_flagged(a: DataFrame, b: DataFrame, on: str = "query", names: tuple[str, str] = ("gt", "cand")) -> DataFrame:
    """Union of the queries with ``<name>_in_source`` flags. Pass deduplicated sources."""
    left = a.select(on, F.lit(True).alias("_a"), *[F.col(c).alias(f"{names[0]}_{c}") for c in a.columns if c != on])
    right = b.select(on, F.lit(True).alias("_b"), *[F.col(c).alias(f"{names[1]}_{c}") for c in b.columns if c != on])
    joined = left.join(right, on, "full")
    return joined.select(
        *[c for c in joined.columns if c not in ("_a", "_b")],
        F.coalesce("_a", F.lit(False)).alias(f"{names[0]}_in_source"),
        F.coalesce("_b", F.lit(False)).alias(f"{names[1]}_in_source"),
    )


def presence(sources: dict[str, DataFrame], on: str = "query") -> DataFrame:
    """One row per query with, per source, how many rows carry it. One shuffle whatever
    the number of sources, with map-side sums."""
    tagged = [
        df.select(on, *[F.lit(1 if n == name else 0).cast("bigint").alias(f"n_{n}") for n in sources])
        for name, df in sources.items()
    ]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy(on).agg(*[F.sum(f"n_{n}").alias(f"n_{n}") for n in sources])


def common_queries(sources: dict[str, DataFrame], on: str = "query") -> DataFrame:
    """Queries that occur in every source."""
    seen = presence(sources, on)
    return seen.filter(reduce(lambda a, b: a & b, [F.col(f"n_{n}") > 0 for n in sources])).select(on)


def query_overlap(sources: dict[str, DataFrame], on: str = "query") -> DataFrame:
    """Coverage diagnostics as ``metric, n``: rows, unique queries, surplus rows, queries
    common to all, and for each ordered pair those only on the left."""
    seen = presence(sources, on)
    names = list(sources)
    has = {n: F.col(f"n_{n}") > 0 for n in names}
    aggs = []
    for n in names:
        aggs += [
            (f"{n}_rows", F.sum(f"n_{n}")),
            (f"{n}_unique", F.count_if(has[n])),
            (f"{n}_duplicates", F.sum(F.greatest(F.col(f"n_{n}") - 1, F.lit(0)))),
        ]
    aggs.append(("common_to_all", F.count_if(reduce(lambda a, b: a & b, has.values()))))
    aggs += [
        (f"{a}_not_in_{b}", F.count_if(has[a] & ~has[b])) for a in names for b in names if a != b
    ]
    one = seen.agg(*[F.coalesce(e, F.lit(0)).cast("bigint").alias(n) for n, e in aggs])
    return tidy(one)


def tidy(one_row: DataFrame) -> DataFrame:
    """A one-row table of counts as ``metric, n`` rows."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("n")) for c in one_row.columns]
    return one_row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.metric", "_c.n")


def duplicate_queries(df: DataFrame, on: str = "query") -> DataFrame:
    return df.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def merge_retries(base: DataFrame, retry: DataFrame, on: str, ord: str) -> DataFrame:
    """Failed base rows take the columns of a successful retry; all others stay. The last
    retry per key counts. Both sides have ``success`` and the same payload columns."""
    payload = [c for c in base.columns if c != on]
    good = keep_last(retry.filter("success"), on, ord).select(
        F.col(on).alias("_on"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in payload]
    )
    # only failures can change, so successes are not part of the join condition's matches
    joined = base.join(good, (F.col(on) == F.col("_on")) & ~F.col("success"), "left")
    return joined.select(
        on,
        *[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        F.coalesce("_hit", F.lit(False)).alias("recovered"),
    )
