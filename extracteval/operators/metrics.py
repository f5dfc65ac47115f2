"""Scorecards, rates, histograms and head-to-head tallies over per-query comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalize import norm_key, norm_value, squeeze
from ..functions.spreading import deal
from ..functions.tables import small_table
from .align import keep_last, tidy
from .compare import both_sides


def _sum(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


# ------------------------------------------------------------------ scorecards and rates


def scorecard(counts: DataFrame) -> DataFrame:
    """Totals, queries with at least one match, and queries whose non-empty reference set
    is matched in full; for keys and for values. One pass."""
    cols = [F.count(F.lit(1)).alias("queries")]
    for f in ("keys", "values"):
        m, g = F.col(f"matched_{f}"), F.col(f"gt_{f}")
        cols += [
            _sum(m).alias(f"total_{f}_matched"),
            F.count_if(m > 0).alias(f"queries_any_{f}"),
            F.count_if((m == g) & (g > 0)).alias(f"queries_all_{f}"),
        ]
    return counts.agg(*cols)


def match_rate(counts: DataFrame, zero: bool = False) -> DataFrame:
    """Matched / reference size per query; null, or 0 with ``zero``, for an empty reference."""
    def rate(f: str) -> Column:
        r = F.try_divide(F.col(f"matched_{f}"), F.col(f"gt_{f}"))
        return (F.coalesce(r, F.lit(0.0)) if zero else r).alias(f"{f[:-1]}_rate")

    return counts.select("*", rate("keys"), rate("values"))


# Histogram classes as [low, high), the first and last being exact.
RATE_BUCKETS = [
    (0, "0%", 0.0, 0.0),
    (1, "1-25%", 0.0, 0.25),
    (2, "26-50%", 0.25, 0.5),
    (3, "51-75%", 0.5, 0.75),
    (4, "76-99%", 0.75, 1.0),
    (5, "100%", 1.0, 1.0),
]


def rate_buckets(counts: DataFrame, matched: str = "matched_keys", total: Column | str = "gt_keys") -> DataFrame:
    """Queries per rate class; all six classes appear. Queries with an empty denominator
    are skipped."""
    total = F.col(total) if isinstance(total, str) else total
    rate = F.try_divide(F.col(matched), total)
    bucket = (
        F.when(rate == 0, 0).when(rate < 0.25, 1).when(rate < 0.5, 2).when(rate < 0.75, 3).when(rate < 1, 4).otherwise(5)
    )
    found = (
        counts.select(bucket.alias("bucket"), rate.alias("_r"))
        .filter(F.col("_r").isNotNull())
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    classes = small_table(
        counts.sparkSession, RATE_BUCKETS, "bucket int, label string, low double, high double"
    )
    return classes.join(found, "bucket", "left").select(
        "bucket", "label", "low", "high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def success_matrix(flagged: DataFrame, gt: str = "gt_success", cand: str = "cand_success") -> DataFrame:
    g, c = F.coalesce(F.col(gt), F.lit(False)), F.coalesce(F.col(cand), F.lit(False))
    return flagged.agg(
        F.count_if(g & c).alias("both"),
        F.count_if(g & ~c).alias("gt_only"),
        F.count_if(~g & c).alias("cand_only"),
        F.count_if(~g & ~c).alias("neither"),
    )


def peer_scorecard(counts: DataFrame) -> DataFrame:
    """Symmetric comparison of two candidates: overlap is full when the smaller set is
    covered; the rate divides by the larger."""
    cols = [F.count(F.lit(1)).alias("queries")]
    for f in ("keys", "values"):
        m = F.col(f"matched_{f}")
        small = F.least(F.col(f"gt_{f}"), F.col(f"cand_{f}"))
        cols += [
            _sum(m).alias(f"total_{f}_matched"),
            F.count_if(m > 0).alias(f"queries_any_{f}"),
            F.count_if((m > 0) & (m == small)).alias(f"queries_full_{f}"),
        ]
    return counts.agg(*cols)


def peer_buckets(counts: DataFrame) -> DataFrame:
    return rate_buckets(counts, "matched_keys", F.greatest(F.col("gt_keys"), F.col("cand_keys")))


# -------------------------------------------------------------------------- key tables


def key_frequency(gt: DataFrame, cand: DataFrame, on: str = "qid", mode: str = "collapse") -> DataFrame:
    """Per key: entries on either side and queries where both sides have it. Counted per
    (query, key) first, so one very common key never lands in a single task unreduced."""
    sides = both_sides(gt, cand, mode)
    per_query = (
        deal(sides.filter(F.col("norm_key") != "").select(on, "norm_key", "is_gt"), sides.count(), on, "norm_key")
        .groupBy(on, "norm_key")
        .agg(F.count_if(F.col("is_gt")).alias("g"), F.count_if(~F.col("is_gt")).alias("c"))
    )
    return per_query.groupBy(F.col("norm_key").alias("key")).agg(
        _sum("g").alias("gt_freq"),
        _sum("c").alias("cand_freq"),
        F.count_if((F.col("g") > 0) & (F.col("c") > 0)).alias("match_freq"),
    )


def one_sided_keys(freq: DataFrame, side: str = "gt") -> DataFrame:
    """Keys one side uses and the other never does, with their frequency."""
    other = "cand" if side == "gt" else "gt"
    return freq.filter((F.col(f"{side}_freq") > 0) & (F.col(f"{other}_freq") == 0)).select(
        "key", F.col(f"{side}_freq").alias("freq")
    )


def top_keys(freq: DataFrame, k: int = 20) -> DataFrame:
    """Most matched keys with both frequencies and the rate; ties by key."""
    return (
        freq.filter(F.col("match_freq") > 0)
        .orderBy(F.desc("match_freq"), "key")
        .limit(k)
        .withColumn("rate", F.coalesce(F.try_divide("match_freq", "gt_freq"), F.lit(0.0)))
    )


# ------------------------------------------------------------------------------ triage


def _last_values(attrs: DataFrame, on: str, mode: str) -> DataFrame:
    """One value per query and key: the last one given."""
    named = attrs.select(
        on, norm_key(F.col("attribute_key"), mode).alias("norm_key"), norm_value(F.col("value"), mode).alias("last_value"), "pos"
    )
    return keep_last(named, [on, "norm_key"], "pos").drop("pos")


def triage(gt: DataFrame, cand: DataFrame, on: str = "qid", mode: str = "collapse") -> DataFrame:
    """Each reference attribute as TRUE (key found, value equal), FALSE (value differs) or
    NA (key missing). The candidate is reduced to its last value per key before the join,
    so the reference keeps its row count."""
    left = gt.withColumn("norm_key", norm_key(F.col("attribute_key"), mode)).withColumn(
        "norm_value", norm_value(F.col("value"), mode)
    )
    verdict = (
        F.when(F.col("last_value").isNull(), "NA")
        .when(F.col("last_value") == F.col("norm_value"), "TRUE")
        .otherwise("FALSE")
    )
    return (
        left.join(_last_values(cand, on, mode), [on, "norm_key"], "left")
        .withColumn("verdict", verdict)
        .drop("last_value", "norm_value")
    )


def _micro(true: Column, false: Column, total: Column) -> list[Column]:
    return [
        total.alias("total"),
        true.alias("true_n"),
        false.alias("false_n"),
        (total - true - false).alias("na_n"),
        F.coalesce(F.try_divide(true, total), F.lit(0.0)).alias("true_rate"),
        F.coalesce(F.try_divide(true + false, total), F.lit(0.0)).alias("key_found_rate"),
    ]


def triage_micro(gt: DataFrame, cands: dict[str, DataFrame], on: str = "qid", mode: str = "collapse") -> DataFrame:
    """Micro-averaged triage and mean attributes per query of each source, over the
    queries that source answered."""
    from functools import reduce

    parts = []
    for name, cand in cands.items():
        answered = cand.select(on).distinct()
        parts += [
            triage(gt.join(answered, on, "left_semi"), cand, on, mode).select(
                F.lit(name).alias("source"), "verdict", F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("q")
            ),
            cand.groupBy(on)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("source"), F.lit(None).cast("string").alias("verdict"), "n", F.lit(1).alias("q")),
        ]
    # verdicts and volumes stacked, so that one aggregation finishes all sources
    sums = reduce(DataFrame.unionByName, parts).groupBy("source").agg(
        F.count("verdict").alias("t"),
        F.count_if(F.col("verdict") == "TRUE").alias("y"),
        F.count_if(F.col("verdict") == "FALSE").alias("f"),
        F.try_divide(F.sum("n"), F.sum("q")).alias("avg_attributes"),
    )
    return sums.select("source", *_micro(F.col("y"), F.col("f"), F.col("t")), "avg_attributes")


def leaderboard(micro: DataFrame) -> DataFrame:
    """Two rankings of the sources: by value match and by volume. One row per source
    reaches the windows."""
    def ranked(kind: str, score: str) -> DataFrame:
        w = W.partitionBy("ranking").orderBy(F.desc("score"))
        return micro.select("source", F.lit(kind).alias("ranking"), F.col(score).alias("score")).withColumn(
            "rank", F.rank().over(w)
        )

    return ranked("value_match", "true_rate").unionByName(ranked("volume", "avg_attributes"))


def macro_metrics(gt: DataFrame, cand: DataFrame, on: str = "qid") -> DataFrame:
    """Means over reference queries of: share of reference keys found, share of equal
    values among the shared keys, and volumes; plus corpus-wide key counts."""
    cells = (
        both_sides(gt, cand)
        .groupBy(on, "norm_key")
        .agg(
            F.max_by(F.when(F.col("is_gt"), F.col("norm_value")), F.when(F.col("is_gt"), F.col("pos"))).alias("g"),
            F.max_by(F.when(~F.col("is_gt"), F.col("norm_value")), F.when(~F.col("is_gt"), F.col("pos"))).alias("c"),
        )
    )
    g, c = F.col("g").isNotNull(), F.col("c").isNotNull()
    per_query = (
        cells.groupBy(on)
        .agg(
            F.count_if(g).alias("gk"),
            F.count_if(c).alias("ck"),
            F.count_if(g & c).alias("both"),
            F.count_if(g & c & (F.col("g") == F.col("c"))).alias("equal"),
        )
        .filter("gk > 0")
    )
    zero = lambda r: F.coalesce(r, F.lit(0.0))
    means = per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(zero(F.try_divide("both", "gk"))).alias("avg_key_overlap"),
        F.avg(zero(F.try_divide("equal", "both"))).alias("avg_value_match"),
        F.avg("ck").alias("avg_cand_keys"),
        F.avg("gk").alias("avg_gt_keys"),
    )
    corpus = (
        cells.groupBy("norm_key")
        .agg(F.bool_or(g).alias("ig"), F.bool_or(c).alias("ic"))
        .agg(
            F.count_if("ig").alias("corpus_gt_keys"),
            F.count_if("ic").alias("corpus_cand_keys"),
            F.count_if(F.col("ig") & F.col("ic")).alias("corpus_common_keys"),
        )
    )
    keys = corpus.select(F.struct(*corpus.columns).alias("_c")).scalar()
    return means.select("*", *[keys[c].alias(c) for c in corpus.columns])


# ---------------------------------------------------------------- pairwise across sources


def pairwise(src: DataFrame, dst: DataFrame, on: str = "qid", mode: str = "collapse") -> DataFrame:
    """Each source attribute, numbered by key within its query, against the target map."""
    found = F.col("last_value").isNotNull()
    return (
        src.withColumn("norm_key", norm_key(F.col("attribute_key"), mode))
        .withColumn("norm_value", norm_value(F.col("value"), mode))
        .join(_last_values(dst, on, mode), [on, "norm_key"], "left")
        .select(
            on,
            F.row_number().over(W.partitionBy(on).orderBy("norm_key", "pos")).alias("position"),
            "norm_key",
            "norm_value",
            found.alias("key_match"),
            F.when(~found, "NA")
            .when(F.col("last_value") == F.col("norm_value"), "TRUE")
            .otherwise("FALSE")
            .alias("value_match"),
        )
    )


def pairwise_totals(attrs: DataFrame, on: str = "qid", mode: str = "collapse") -> DataFrame:
    """TRUE/FALSE/NA totals for every ordered pair of sources over the queries both have.

    ``attrs`` carries ``source``. Hits come from one equi-join on (query, key) against one
    row per source and key; misses are what is left of the source's own count, so nothing
    is emitted for them. All steps are sums with map-side combining."""
    norm = attrs.select(
        on,
        "source",
        norm_key(F.col("attribute_key"), mode).alias("norm_key"),
        norm_value(F.col("value"), mode).alias("norm_value"),
        "pos",
    )
    last = (
        keep_last(norm, [on, "source", "norm_key"], "pos")
        .select(on, "norm_key", F.col("source").alias("dst"), F.col("norm_value").alias("dst_value"))
    )
    entries = norm.groupBy(on, "source", "norm_key", "norm_value").agg(F.count(F.lit(1)).alias("n"))
    hits = (
        entries.withColumnRenamed("source", "src")
        .join(last, [on, "norm_key"])
        .filter("src <> dst")
        .groupBy("src", "dst")
        .agg(
            _sum(F.when(F.col("norm_value") == F.col("dst_value"), F.col("n"))).alias("true_n"),
            _sum(F.when(F.col("norm_value") != F.col("dst_value"), F.col("n"))).alias("false_n"),
        )
    )
    # one small array of sources per query gives the denominators
    sizes = norm.groupBy(on, "source").agg(F.count(F.lit(1)).alias("n"))
    mine = sizes.groupBy(on).agg(F.collect_list(F.struct("source", "n")).alias("s"))
    totals = (
        mine.select(F.explode("s").alias("a"), "s")
        .select("a", F.explode("s").alias("b"))
        .filter("a.source <> b.source")
        .groupBy(F.col("a.source").alias("src"), F.col("b.source").alias("dst"))
        .agg(_sum("a.n").alias("total"))
    )
    return totals.join(hits, ["src", "dst"], "left").select(
        "src",
        "dst",
        *_micro(F.coalesce("true_n", F.lit(0)), F.coalesce("false_n", F.lit(0)), F.col("total")),
    )


def count_agreement(df: DataFrame, counts: dict[str, str]) -> DataFrame:
    """Whether all sources counted the same, and which ones counted most (comma-joined;
    ``same`` when all tie). ``counts`` maps source name to its count column."""
    cols = [F.col(c) for c in counts.values()]
    top = F.greatest(*cols)
    leaders = F.array_join(
        F.array_compact(F.array(*[F.when(F.col(c) == top, F.lit(n)) for n, c in counts.items()])), ","
    )
    same = top == F.least(*cols)
    return df.select("*", same.alias("count_match"), F.when(same, "same").otherwise(leaders).alias("high_count"))


def head_to_head(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often ``a`` beats, ties with or loses to ``b``."""
    outcome = F.when(F.col(a) > F.col(b), "win").when(F.col(a) == F.col(b), "tie").otherwise("loss")
    return df.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def improvement(base: DataFrame, cand: DataFrame, on: str = "qid") -> DataFrame:
    """Queries where the candidate's key + value matches exceed the baseline's. Inputs are
    per-query triage counts ``keys_ok, values_ok``."""
    score = F.col("keys_ok") + F.col("values_ok")
    return (
        base.select(on, score.alias("base_score"))
        .join(cand.select(on, score.alias("cand_score")), on)
        .filter("cand_score > base_score")
        .withColumn("improvement", F.col("cand_score") - F.col("base_score"))
    )


def match_scores(gt: DataFrame, cand: DataFrame, on: str = "qid") -> DataFrame:
    """Per query: reference attributes whose key, and whose key and value, were found."""
    return triage(gt, cand, on).groupBy(on).agg(
        F.count_if(F.col("verdict") != "NA").alias("keys_ok"),
        F.count_if(F.col("verdict") == "TRUE").alias("values_ok"),
    )


def improvement_summary(better: DataFrame) -> DataFrame:
    """Averages over the improved queries and the size bands 1-2, 3-5, 6+."""
    i = F.col("improvement")
    return better.agg(
        F.count(F.lit(1)).alias("cases"),
        F.try_divide(F.sum("base_score"), F.count(F.lit(1))).alias("avg_base_score"),
        F.try_divide(F.sum("cand_score"), F.count(F.lit(1))).alias("avg_cand_score"),
        F.try_divide(F.sum(i), F.count(F.lit(1))).alias("avg_improvement"),
        F.count_if(i.between(1, 2)).alias("band_1_2"),
        F.count_if(i.between(3, 5)).alias("band_3_5"),
        F.count_if(i >= 6).alias("band_6_up"),
    )


def count_improvement(df: DataFrame, base: str, cand: str) -> DataFrame:
    """Rows where the baseline found at most one attribute and the candidate at least two
    more."""
    gain = F.col(cand) - F.col(base)
    return df.filter((F.col(base) <= 1) & (F.col(cand) >= 2) & (gain >= 2)).withColumn("improvement", gain)


def count_tally(df: DataFrame, base: str, cand: str) -> DataFrame:
    b, c = F.col(base), F.col(cand)
    return df.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(c > b).alias("better"),
        F.count_if(c < b).alias("worse"),
        F.count_if(c == b).alias("equal"),
        F.try_divide(F.sum(b), F.count(F.lit(1))).alias("avg_base"),
        F.try_divide(F.sum(c), F.count(F.lit(1))).alias("avg_cand"),
    )


def grounding(attrs: DataFrame, queries: DataFrame, on: str = "qid") -> DataFrame:
    """Attributes with ``grounded``: the value, or one of its words, occurs in the query."""
    v, q = F.lower(F.col("value")), F.lower(F.col("query"))
    words = F.filter(F.split(squeeze(v), " "), lambda w: w != "")
    return (
        attrs.join(queries.select(on, "query"), on)
        .withColumn("grounded", q.contains(v) | F.exists(words, lambda w: q.contains(w)))
        .drop("query")
    )


# ----------------------------------------------------------------------- run statistics


def behaviour_matrix(df: DataFrame, expected: str, counts: dict[str, str]) -> DataFrame:
    """Per expectation class: cases and, per source, how many yielded any attribute."""
    return df.groupBy(expected).agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.count_if(F.col(c) > 0).alias(f"{n}_identified") for n, c in counts.items()],
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Success rate, attribute total and mean per query of a nested result relation."""
    n = F.when(F.col("success"), F.size("attributes")).otherwise(0)
    return results.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
        F.try_divide(F.count_if("success"), F.count(F.lit(1))).alias("success_rate"),
        _sum(n).alias("attributes"),
        F.try_divide(F.sum(n), F.count(F.lit(1))).alias("avg_attributes"),
    )


def attr_histogram(results: DataFrame) -> DataFrame:
    return results.groupBy(F.size("attributes").cast("bigint").alias("n_attributes")).agg(
        F.count(F.lit(1)).alias("queries")
    )


def structural_quality(results: DataFrame) -> DataFrame:
    """Per result: distinct values, entries, primary keys, and whether both priorities are
    present throughout. Works inside the row."""
    a = F.col("attributes")
    return results.select(
        "qid",
        F.size(F.array_distinct(F.transform(a, lambda e: e["value"]))).cast("bigint").alias("unique_values"),
        F.size(a).cast("bigint").alias("total_keys"),
        F.size(F.filter(a, lambda e: e["key_priority"] == 1)).cast("bigint").alias("primary_keys"),
        F.forall(
            a, lambda e: e["key_priority"].isNotNull() & e["attribute_priority"].isNotNull()
        ).alias("has_priorities"),
    )


def priority_distribution(results: DataFrame) -> DataFrame:
    """How many records use each attribute priority."""
    return (
        results.select(F.explode(F.array_distinct(F.transform("attributes", lambda e: e["attribute_priority"]))).alias("attribute_priority"))
        .groupBy("attribute_priority")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def length_profile(df: DataFrame, length: Column | str, limit: int) -> DataFrame:
    n = F.col(length) if isinstance(length, str) else length
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.min(n).cast("bigint").alias("min_length"),
        F.max(n).cast("bigint").alias("max_length"),
        F.try_divide(F.sum(n), F.count(n)).alias("avg_length"),
        F.count_if(n >= limit).alias("at_limit"),
    )


def fuzzy_scorecard(gt: DataFrame, cands: dict[str, DataFrame], synonyms: DataFrame, on: str = "qid") -> DataFrame:
    """Per query and source: reference attributes matched by canonical key and by fuzzy
    value, and the key share."""
    from functools import reduce

    from .compare import canonical_flags, crowded_queries, fuzzy_flags

    out = []
    for name, cand in cands.items():
        crowded = crowded_queries(gt, cand, on)
        scored = canonical_flags(fuzzy_flags(gt, cand, on, crowded), cand, synonyms, on, crowded)
        out.append(
            scored.groupBy(on).agg(
                F.lit(name).alias("source"),
                F.count(F.lit(1)).alias("gt_attributes"),
                F.count_if("key_matched").alias("key_matches"),
                F.count_if("value_matched").alias("value_matches"),
            )
        )
    return reduce(DataFrame.unionByName, out).withColumn("key_share", F.try_divide("key_matches", "gt_attributes"))


def tidy_report(sections: dict[str, DataFrame], total: Column | None = None) -> DataFrame:
    """One-row count tables stacked as ``section, metric, n``."""
    from functools import reduce

    return reduce(
        DataFrame.unionByName,
        [tidy(df).select(F.lit(s).alias("section"), "metric", "n") for s, df in sections.items()],
    )
