"""The whole jobs, put together from the operators.

Each takes and returns DataFrames. Where one result feeds several reports it is written once
to the shared folder, so the work behind it is not repeated and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.hashing import hash_rank
from ..operators import compare, datasets, labels, metrics, tagging, vocabulary
from ..session import materialise, slices_for, store_slices


def head_to_head(reference: DataFrame, candidates: Mapping[str, DataFrame], on: str = "qid", top: int = 20) -> dict[str, DataFrame]:
    """Evaluate candidates against the reference over the reference's queries.

    Returns ``detail`` (one row per candidate and query), ``report`` (scorecard and rate
    classes as ``candidate, section, metric, n``), ``top_keys`` and ``missing_keys``."""
    base = reference.select(on).distinct()
    details, reports, tops, missing = [], [], [], []
    for name, cand in candidates.items():
        tag = F.lit(name).alias("candidate")
        # queries the reference does not have are not compared
        cand = cand.join(base, on, "left_semi")
        counts = materialise(compare.set_counts(compare.term_flags(reference, cand, on), on), f"counts-{name}")
        freq = metrics.key_frequency(reference, cand, on)
        details.append(metrics.match_rate(counts).select(tag, "*"))
        classes = metrics.rate_buckets(counts).select(F.lit("key_rate").alias("section"), F.col("label").alias("metric"), "n")
        reports.append(metrics.tidy_report({"match": metrics.scorecard(counts)}).unionByName(classes).select(tag, "*"))
        tops.append(metrics.top_keys(freq, top).select(tag, "*"))
        missing.append(metrics.one_sided_keys(freq).orderBy(F.desc("freq"), "key").limit(top).select(tag, "*"))
    stack = lambda parts: reduce(DataFrame.unionByName, parts)
    return {"detail": stack(details), "report": stack(reports), "top_keys": stack(tops), "missing_keys": stack(missing)}


def tag_reference(texts: DataFrame, on: str = "qid") -> DataFrame:
    """A rule-made reference for short product texts, assembled under all its keys."""
    attrs = tagging.assemble_reference(texts, on=on)
    return attrs.withColumn("pos", F.col("attribute_priority") * 100 + F.col("key_priority"))


def single_value_reference(texts: DataFrame, on: str = "qid") -> DataFrame:
    """A rule-made reference with one value per facet, as attribute relation; keys in name order."""
    maps = tagging.query_attributes(texts, on)
    rows = maps.select(on, F.posexplode(F.array_sort(F.map_entries("attributes"))).alias("_p", "_e"))
    place = (F.col("_p") + 1).alias
    return rows.select(on, place("pos"), F.col("_e.key").alias("attribute_key"), F.col("_e.value").alias("value"), F.lit(1).alias("key_priority"), place("attribute_priority"))


def tag_and_compare(
    texts: DataFrame, candidates: Mapping[str, DataFrame], on: str = "qid", tagger: Callable[[DataFrame, str], DataFrame] = tag_reference
) -> dict[str, DataFrame]:
    """Tag the texts for a reference (:func:`tag_reference` or :func:`single_value_reference`), then
    match the candidates by canonical key and fuzzy value. Returns the ``reference``, ``scores`` per query and source, ``totals`` per source
    and, for the first two sources, the head-to-head ``outcomes`` by key matches.

    A query is compared with itself only, so candidates are written and scored a slice of the queries
    and a source at a time, see :func:`~extracteval.session.store_slices`."""
    spark = texts.sparkSession
    reference = store_slices(spark, [lambda part: tagger(texts, on)], on, 1, "reference")
    slices = slices_for(reference.count())
    table = vocabulary.synonym_table(spark)
    # candidates are model outputs as a rule, and several steps read them
    candidates = {n: store_slices(spark, [lambda part, c=c: part(c)], on, slices, f"candidate-{n}") for n, c in candidates.items()}
    score = lambda n, c: lambda part: metrics.fuzzy_scorecard(part(reference), {n: part(c)}, table, on)
    scores = store_slices(spark, [score(n, c) for n, c in candidates.items()], on, slices, "scores")
    totals = scores.groupBy("source").agg(
        F.sum("gt_attributes").alias("gt_attributes"), F.sum("key_matches").alias("key_matches"), F.sum("value_matches").alias("value_matches")
    )
    a, b = list(candidates)[:2]
    side = lambda n: scores.filter(F.col("source") == n).select(on, F.col("key_matches").alias(n))
    return {"reference": reference, "scores": scores, "totals": totals, "outcomes": metrics.head_to_head(side(a).join(side(b), on), a, b)}


def multitask_records(pools: DataFrame, n: int, seed: str, ratios: Mapping[str, float] = L.TASK_RATIOS, train: float = 0.9) -> DataFrame:
    """Training records of three tasks, ``int(n * ratio)`` of each, in one drawn order and split:
    ``task, id, instruction, output, place, split``. ``pools`` is ``(key, value)`` as in
    :func:`~extracteval.operators.datasets.number_pools`."""
    sizes = {t: int(n * r) for t, r in ratios.items()}
    spark = pools.sparkSession
    made = {
        "isq_extraction": lambda m, s: datasets.extraction_records(datasets.number_pools(pools, s), m, s),
        "query_correction": lambda m, s: datasets.correction_records(spark, m, s),
        "translation": lambda m, s: datasets.translation_records(spark, m, s),
    }
    parts = [made[t](m, f"{seed}:{t}").select(F.lit(t).alias("task"), "id", "instruction", "output") for t, m in sizes.items()]
    stacked = materialise(reduce(DataFrame.unionByName, parts).withColumn("_key", F.concat_ws("|", "task", "id")), "tasks")
    last = int(sum(sizes.values()) * train)
    placed = hash_rank(stacked, "_key", f"{seed}:order", out="place")
    return placed.withColumn("split", F.when(F.col("place") <= last, "train").otherwise("val")).drop("_key")


def label_training(items: DataFrame, n: int, p: float, seed: str) -> DataFrame:
    """Instruction pairs from labelled items (``name, label_id, label, ord``): the first
    ``n`` valid rows, split by label, templates in rotation, the label as JSON output."""
    valid = materialise(labels.valid_labelled(items, n), "labelled")
    rendered = datasets.render_instruction(datasets.split_stratified(valid, "label_id", "ord", seed, p), "ord", f"{seed}:templates", "name")
    name = F.regexp_extract(F.to_json(F.array("label")), r"(?s)^\[(.*)\]$", 1)
    output = F.concat(F.lit('{"label_name": '), name, F.lit(', "label_id": '), F.col("label_id").cast("string"), F.lit("}"))
    return rendered.select("ord", "split", "instruction", output.alias("output"))


def label_evaluation(base: DataFrame, predictions: Mapping[str, DataFrame]) -> DataFrame:
    """Agreement of two predicted label sources with the base and with each other."""
    a, b = list(predictions)[:2]
    return labels.agreement_summary(labels.label_agreement(labels.align_labels(base, dict(predictions)), a, b))


__all__ = ["head_to_head", "label_evaluation", "label_training", "multitask_records", "single_value_reference", "tag_and_compare", "tag_reference"]
