"""Identities that hold for any input, and independence of the partitioning."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from extracteval.operators import compare, datasets, metrics, vocabulary
from extracteval.plans import fixtures as fx

QUERIES = entry.queries()


def test_sets_add_up(spark, sf_dir):
    sets = compare.set_compare(compare.term_flags(fx.gt(spark, sf_dir), fx.cand_b(spark, sf_dir)))
    bad = sets.filter(
        (F.size("matched_key_set") + F.size("gt_only_key_set") != F.col("gt_keys"))
        | (F.size("matched_key_set") + F.size("cand_only_key_set") != F.col("cand_keys"))
    )
    assert bad.isEmpty()


def test_triage_covers_the_reference(spark, sf_dir):
    gt = fx.gt(spark, sf_dir)
    verdicts = metrics.triage(gt, fx.cand_c(spark, sf_dir)).groupBy("verdict").count().collect()
    assert sum(r["count"] for r in verdicts) == gt.count()


def test_buckets_cover_non_empty_queries(spark, sf_dir):
    counts = compare.set_counts(compare.term_flags(fx.gt(spark, sf_dir), fx.cand_b(spark, sf_dir)))
    assert metrics.rate_buckets(counts).agg(F.sum("n")).first()[0] == counts.filter("gt_keys > 0").count()


def test_base_fixes_the_queries(spark, sf_dir):
    flags = compare.term_flags(fx.gt(spark, sf_dir), fx.cand_b(spark, sf_dir))
    base = fx.queries(spark, sf_dir).select((F.col("qid") + 100).alias("qid"))
    counts = compare.set_counts(flags, base=base)
    assert counts.count() == base.count()
    assert counts.filter("qid >= 200 and gt_keys <> 0").isEmpty()


def test_splits_are_partitions(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    got = {r["split"]: r["count"] for r in datasets.split_random(docs, "doc_id", "s").groupBy("split").count().collect()}
    assert got == {"train": int(n * 0.8), "val": int(n * 0.1), "test": n - int(n * 0.8) - int(n * 0.1)}
    lab = spark.createDataFrame([(i, "a" if i < 25 else "b" if i < 40 else "c") for i in range(41)], "id bigint, label string")
    split = datasets.split_stratified(lab, "label", "id", "s").groupBy("label", "split").count().collect()
    # 2.5 and 1.5 round to even; a label with one row gives none
    assert {(r["label"], r["split"]): r["count"] for r in split} == {
        ("a", "val"): 2, ("a", "train"): 23, ("b", "val"): 2, ("b", "train"): 13, ("c", "train"): 1,
    }


@pytest.mark.parametrize("n", [5, 40, 10_000])
def test_proportional_sample(spark, sf_dir, n):
    items = fx.items(spark, sf_dir)
    train = items.filter("in_train")
    sample = datasets.proportional_sample(items, train, n, "name", "label", "ord", "s")
    unseen = datasets.not_in_training(items, train, "name").select("name").distinct().count()
    assert sample.count() == min(n, unseen) == sample.select("name").distinct().count()
    assert sample.join(train, "name", "left_semi").isEmpty()


def test_compression_keeps_its_bounds(spark, sf_dir):
    v = fx.vocab(spark, sf_dir)
    out = vocabulary.compress_vocab(v, 2, 3)
    assert out.select("key").distinct().count() == 2
    assert out.groupBy("key").count().filter("count > 3").isEmpty()


@pytest.mark.parametrize(
    "name",
    ["a1_scorecard", "a15_pairwise_totals", "w5_budget_cutoff", "t2_synthesize", "t7_split_stratified", "x1_tag_dictionary", "k3_showcase"],
)
def test_partitioning_does_not_matter(spark, sf_dir, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, aqe in (("1", "true"), ("7", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            seen.append(sorted(map(str, QUERIES[name](spark, sf_dir).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert seen[0] == seen[1]


def test_joins_without_broadcast(spark, sf_dir):
    """The paths taken when no side is small enough to broadcast."""
    from extracteval.functions import tables

    names = ["x1_tag_dictionary", "x2_tag_dictionary_lenient", "t7_split_stratified", "w6_progress", "j11_canonical_match"]
    small = [sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in names]
    before, limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), tables.BROADCAST_BYTES
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tables.BROADCAST_BYTES = 0
        large = [sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in names]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        tables.BROADCAST_BYTES = limit
    assert small == large
