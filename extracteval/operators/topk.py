"""Selections of a few rows for a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import compare


def showcase_scores(strong: DataFrame, weak: list[DataFrame], on: str = "qid") -> DataFrame:
    """Per query common to all: key matches of each source, the total of all matches and
    the contrast (twice the strong source's key matches minus the weak ones')."""
    base = strong.select(
        on, "gt_keys", F.col("matched_keys").alias("strong_keys"), (F.col("matched_keys") + F.col("matched_values")).alias("_s")
    )
    parts = [
        w.select(on, F.col("matched_keys").alias(f"weak{i}_keys"), (F.col("matched_keys") + F.col("matched_values")).alias(f"_w{i}"))
        for i, w in enumerate(weak, 1)
    ]
    joined = reduce(lambda a, b: a.join(b, on), parts, base)
    n = range(1, len(weak) + 1)
    return joined.withColumns(
        {
            "total_score": sum((F.col(f"_w{i}") for i in n), F.col("_s")),
            "contrast": sum((-F.col(f"weak{i}_keys") for i in n), F.col("strong_keys") * 2),
        }
    ).drop("_s", *[f"_w{i}" for i in n])


def showcase_scores_once(reference: DataFrame, strong: DataFrame, weak: list[DataFrame], on: str = "qid") -> DataFrame:
    """As :func:`showcase_scores` from the attributes themselves: every source, the reference included,
    is scanned once, and all counts of a query are sums over its terms' source masks. Queries in the
    reference, or in all other sources, are returned."""
    sources = {"reference": reference, "strong": strong, **{f"weak{i}": w for i, w in enumerate(weak, 1)}}
    counted = compare.mask_counts(compare.source_masks(sources, on), on)
    others = range(1, len(sources))
    keys = {i: compare.shared(0, i, facet="key") for i in others}
    values = {i: compare.shared(0, i, facet="value") for i in others}
    seen = F.bit_or("mask")
    every = sum(1 << i for i in others)
    scored = counted.groupBy(on).agg(
        compare.shared(0, facet="key").alias("gt_keys"),
        keys[1].alias("strong_keys"),
        *[keys[i].alias(f"weak{i - 1}_keys") for i in others if i > 1],
        sum((keys[i] + values[i] for i in others), F.lit(0)).cast("bigint").alias("total_score"),
        (keys[1] * 2 - sum((keys[i] for i in others if i > 1), F.lit(0))).cast("bigint").alias("contrast"),
        seen.alias("_seen"),
    )
    there = (F.col("_seen").bitwiseAND(F.lit(1).cast("bigint")) == 1) | (F.col("_seen").bitwiseAND(F.lit(every).cast("bigint")) == every)
    return scored.filter(there).drop("_seen")


def showcase(scores: DataFrame, gt_sizes: DataFrame, k: int = 5, pool: int = 20, on: str = "qid") -> DataFrame:
    """``k`` best matches (out of the ``pool`` highest totals) and ``k`` contrasts: strict
    ones first, then looser ones to fill up. ``gt_sizes`` is ``(qid, n_attrs)``. Only
    top-k operators; each task sends at most ``pool`` rows."""
    # both selections read the scores, which are worked out once
    rich = materialise(scores.join(gt_sizes.select(on, "n_attrs"), on), "showcase")
    best = (
        rich.orderBy(F.desc("total_score"), on)
        .limit(pool)
        .filter("n_attrs >= 3 and weak1_keys >= 2 and weak2_keys >= 1")
        .orderBy(F.desc("total_score"), on)
        .limit(k)
        .withColumn("kind", F.lit("best"))
        .withColumn("tier", F.lit(1))
    )
    strict = "n_attrs >= 3 and strong_keys >= 3 and weak1_keys <= 1 and weak2_keys <= 1"
    loose = "n_attrs >= 2 and strong_keys >= 2 and (weak1_keys <= 1 or weak2_keys <= 1)"
    tier = F.when(F.expr(strict), 1).when(F.expr(loose), 2)
    contrast = (
        rich.withColumn("kind", F.lit("contrast"))
        .withColumn("tier", tier)
        .filter(F.col("tier").isNotNull())
        .orderBy("tier", F.desc("contrast"), on)
        .limit(k)
    )
    return best.unionByName(contrast)
