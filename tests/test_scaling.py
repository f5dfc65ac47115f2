"""What the steps of a comparison ask of the driver and of one task."""

import re

import pytest
from pyspark.sql import functions as F

from extracteval import session
from extracteval.functions.spreading import DIRECT_TASKS, MOST_TASK_ROWS, MOST_TASKS, deal, tasks_for
from extracteval.operators import compare, metrics, tagging, vocabulary
from extracteval.plans import jobs
from extracteval.sources import files


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_sides_are_not_built_by_the_driver(spark, attrs):
    gt = attrs([(1, "size", "size 10"), (1, "color", "dark red"), (2, "brand", "acme"), (2, "make", "12 x")])
    cand = attrs([(1, "size", "10"), (1, "color", "red"), (2, "brand", "acme tools"), (2, "make", "x 12.")])
    flagged = compare.fuzzy_flags(gt, cand)
    assert "Broadcast" not in _plan(flagged)
    assert {(r.qid, r.pos): r.value_matched for r in flagged.collect()} == {(1, 1): True, (1, 2): True, (2, 1): True, (2, 2): False}
    scored = metrics.fuzzy_scorecard(gt, {"c": cand}, vocabulary.synonym_table(spark))
    # the synonyms alone, a fixed inline table
    assert _plan(scored).count("BroadcastExchange") <= 2
    assert {r.qid: r.value_matches for r in scored.collect()} == {1: 2, 2: 1}


def test_tasks_follow_the_rows():
    assert [tasks_for(n, 8) for n in (0, 9_999, 25_000, 1_000_000)] == [1, 1, 3, 8]
    assert tasks_for(100_000_000, 8) == 401
    assert tasks_for(10**12, 8) == MOST_TASKS


def test_tasks_grow_before_rows_are_sorted_for_many(spark):
    tasks = lambda n: int(re.search(r"hashpartitioning\(id#\d+L, (\d+)\), REPARTITION_BY_NUM", _plan(deal(spark.range(3), n, "id")))[1])
    # 100,000,000 rows were dealt to 401 tasks: the tasks that deal them out kept them in memory
    assert [tasks(n) for n in (1_000_000, 40_000_000, 100_000_000)] == [5, 161, DIRECT_TASKS]
    assert tasks(400 * MOST_TASK_ROWS) == 401


ROWS = [(1, "A", "x", 1, 1), (1, "a ", "X", 2, 1), (1, None, "y", 1, 2), (None, "b", "x", 1, 1), (2, "b", None, 1, 1)]
OTHER = [(1, "a", "x", 1, 1), (1, "a", "x", 1, 1), (1, None, "y", 2, 2), (None, "b", "x", 1, 1), (3, "c", "z", 1, 1)]
GROUPED = {
    "term_flags": compare.term_flags,
    "source_masks": lambda a, b: compare.source_masks({"a": a, "b": b}),
    "entry_pairs": compare.entry_pairs,
    "priority_counts": compare.priority_counts,
    "key_frequency": metrics.key_frequency,
}


@pytest.mark.parametrize("name", list(GROUPED))
def test_terms_are_dealt_before_they_are_grouped(attrs, name):
    above, dealt, below = _plan(GROUPED[name](attrs(ROWS), attrs(OTHER))).partition("REPARTITION_BY_NUM")
    # a task that reads a row group keeps no hash table of its terms
    assert dealt and "HashAggregate" in above and "Aggregate" not in below


def test_dealt_groups_are_whole(attrs):
    out = compare.priority_counts(attrs(ROWS), attrs(OTHER)).collect()
    # query 1: two entries A/x against two a/x; keys that are null group together
    assert {r.qid: (r.pairs, r.key_priority_matches, r.attr_priority_matches, r.perfect) for r in out} == {
        1: (5, 2, 5, 2), None: (1, 1, 1, 1), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)
    }
    freq = {r.key: (r.gt_freq, r.cand_freq, r.match_freq) for r in metrics.key_frequency(attrs(ROWS), attrs(OTHER)).collect()}
    assert freq == {"a": (2, 2, 1), "b": (2, 1, 1), "c": (0, 1, 0)}


def test_texts_are_dealt_before_names_are_found(spark):
    texts = spark.createDataFrame([(1, "an acme motor"), (2, "motor"), (None, "acme")], "qid bigint, query string")
    tags = tagging.tag_dictionary(texts, tagging.dictionary(spark, {"acme": "Acme"}))
    assert "REPARTITION_BY_NUM" in _plan(tags)
    assert sorted((str(r.qid), r.value) for r in tags.collect()) == [("1", "Acme"), ("None", "Acme")]


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "a.txt").write_text(str(i))
    tasks, store = [], files.materialise
    monkeypatch.setattr(files, "materialise", lambda df, name: tasks.append(df.rdd.getNumPartitions()) or store(df, name))
    monkeypatch.setattr(files, "TASK_FOLDERS", 10)
    found = files.list_files(spark, f"file://{tmp_path}", "*.txt").collect()
    assert len({r.inner for r in found}) == len(found) == 30
    assert max(tasks) <= max(4, spark.sparkContext.defaultParallelism)


FUZZY_GT = [(1, "Color", "dark red"), (1, "size", "size 10"), (1, "make", ""), (2, "brand", "acme"), (3, "type", "x"), (None, "color", "red"), (4, None, None)]
FUZZY_CAND = [(1, "color", "red"), (1, "n", "10 x"), (2, "make", "ACME tools"), (2, "make", " "), (None, "color", "red"), (4, None, None), (5, "type", "x")]


@pytest.mark.parametrize("few, many", [(32, 10_000), (0, 10_000), (32, 0), (1, 1)])
def test_crowded_queries_get_the_flags_of_the_others(spark, attrs, monkeypatch, few, many):
    monkeypatch.setattr(compare, "FEW_VALUES", few)
    monkeypatch.setattr(compare, "MANY_ROWS", many)
    gt, cand, table = attrs(FUZZY_GT), attrs(FUZZY_CAND), vocabulary.synonym_table(spark)
    crowded = {r.qid for r in compare.crowded_queries(gt, cand).queries.collect()}
    assert crowded == {(32, 10_000): set(), (0, 10_000): {1, 2, 4, 5}, (32, 0): {1, 2, 3, 4, None}, (1, 1): {1, 2}}[few, many]
    values = {(r.qid, r.pos): r.value_matched for r in compare.fuzzy_flags(gt, cand).collect()}
    assert values == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): True, (3, 1): False, (None, 1): False, (4, 1): False}
    flags = compare.canonical_flags(gt, cand, table)
    assert flags.columns[:2] == ["qid", "canonical_key"] and len(flags.columns) == len(gt.columns) + 2
    keys = {(r.qid, r.pos): r.key_matched for r in flags.collect()}
    assert keys == {(1, 1): True, (1, 2): False, (1, 3): False, (2, 1): True, (3, 1): False, (None, 1): False, (4, 1): False}


def test_reference_is_shuffled_once_to_be_scored(spark, attrs):
    scored = metrics.fuzzy_scorecard(attrs(FUZZY_GT), {"c": attrs(FUZZY_CAND)}, vocabulary.synonym_table(spark))
    # the reference, the candidate's values, its keys; before, every value went by all its keys as well
    assert len(re.findall(r"Exchange hashpartitioning\(qid#\d+L", _plan(scored))) == 3 and "Generate" not in _plan(scored)


def test_keywords_that_rule_each_other_out_are_found_in_one_pass(spark):
    texts = spark.createDataFrame(
        [(1, "pump motor"), (2, "a pump"), (2, "big pump"), (3, "steel motor"), (None, "pump motor"), (4, "")], "qid bigint, query string"
    )
    words = {"kind": {"pump": "Pump", "big pump": "Big pump"}, "motor": {"motor": "Motor"}, "use": {"pump": "Pumping"}, "stuff": {"steel": "Steel"}}
    # kind gives way to motor, and use to a kind that did not give way itself
    tags = tagging.tag_keyword_facets(texts, tagging.facet_dictionary(spark, words), {"kind": "motor", "use": "kind"})
    assert _plan(tags).count("REPARTITION_BY_NUM") == 1
    none = [("None", "kind", "Pump"), ("None", "motor", "Motor"), ("None", "use", "Pumping")]
    assert sorted((str(r.qid), r.facet, r.value) for r in tags.collect()) == sorted(
        [("1", "motor", "Motor"), ("1", "use", "Pumping"), ("2", "kind", "Big pump"), ("3", "motor", "Motor"), ("3", "stuff", "Steel"), *none]
    )


TEXTS = [(1, "siemens 5 hp motor 230 v"), (2, "table fan copper"), (2, "abb 3 kw motor 1440 rpm"), (None, "12 v pump"), (3, None), (4, "stepper motor nema 23")]


def _scored(spark, monkeypatch, tagger, slice_rows):
    calls, real = [], metrics.fuzzy_scorecard
    monkeypatch.setattr(session, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(session, "MOST_SLICES", 2)
    monkeypatch.setattr(metrics, "fuzzy_scorecard", lambda gt, cands, *a: calls.append(list(cands)) or real(gt, cands, *a))
    texts = spark.createDataFrame(TEXTS, "qid bigint, query string")
    as_attrs = lambda tags: tags.select("qid", F.col("facet").alias("attribute_key"), "value")
    candidates = {"q": as_attrs(tagging.tag_all_quantities(texts)), "a": as_attrs(tagging.tag_first_of(texts))}
    out = jobs.tag_and_compare(texts, candidates, tagger=tagger)
    monkeypatch.setattr(metrics, "fuzzy_scorecard", real)
    return calls, sorted(map(str, out["scores"].collect())), sorted(map(str, out["totals"].collect()))


def test_a_slice_of_the_queries_is_scored_at_a_time(spark, monkeypatch):
    whole, sliced = (_scored(spark, monkeypatch, jobs.tag_reference, n) for n in (4_000_000, 8))
    assert whole[0] == [["q"], ["a"]] and sliced[0] == [["q"], ["q"], ["a"], ["a"]]
    # the same rows, queries that come twice and texts without a key included
    assert whole[1:] == sliced[1:] and any("qid=None" in r for r in whole[1])


def test_slices_follow_the_rows():
    assert [session.slices_for(n) for n in (0, 4_000_000, 10**12)] == [1, 2, session.MOST_SLICES]


def test_single_values_are_scored_in_slices_too(spark, monkeypatch):
    whole, sliced = (_scored(spark, monkeypatch, jobs.single_value_reference, n) for n in (4_000_000, 4))
    assert whole[0] == [["q"], ["a"]] and sliced[0] == [["q"], ["q"], ["a"], ["a"]]
    assert whole[1:] == sliced[1:] and any("qid=None" in r for r in whole[1])


def test_shuffles_go_with_the_slice_that_made_them(spark):
    setting = spark.conf.get(session.CLEAN, None)
    seen = []
    make = lambda part: seen.append(spark.conf.get(session.CLEAN)) or part(spark.range(100)).groupBy("id").count()
    out = session.store_slices(spark, [make], "id", 3, "sliced")
    assert seen == ["true"] * 3 and spark.conf.get(session.CLEAN, None) == setting
    assert sorted(r.id for r in out.collect()) == list(range(100))
