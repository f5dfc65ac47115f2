"""Registered queries: the whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import tagging
from . import fixtures as fx
from . import jobs
from .build_queries import _CLEAN, _FACETS, _KEYWORDS, _LOW, _QUANT, _ROT, _SINGLE, _TAGS, _N_PART, _all_sql, _case, product_sql, records_sql, synth_sql, typo_sql
from .compare_queries import _SCORE, buckets_sql, canonical_match_sql, counts_sql, fuzzy_sql
from .registry import query
from .sqltext import h32, hx, lit


def _report_sql(name: str) -> str:
    v = f"fx_cand_{name}"
    return f"""SELECT '{name}' AS candidate, 'match' AS section, metric, n FROM (UNPIVOT ({_SCORE}{counts_sql(v)} c) ON COLUMNS(*) INTO NAME metric VALUE n) a_{name}
        UNION ALL SELECT '{name}', 'key_rate', label, n FROM ({buckets_sql(v, 'fx_gt', 'gt_keys')}) b_{name}"""


@query("e1_head_to_head", f"{_report_sql('b')} UNION ALL {_report_sql('c')}")
def _(spark, d):
    return jobs.head_to_head(fx.gt(spark, d), {"b": fx.cand_b(spark, d), "c": fx.cand_c(spark, d)})["report"]


_E2 = f"""WITH r AS (SELECT qid, facet, value, row_number() OVER (PARTITION BY qid ORDER BY facet_ord, ord, value) AS ap FROM {_TAGS} t JOIN (SELECT DISTINCT facet, facet_ord FROM {_FACETS} f) o USING (facet)),
    e_gt AS (SELECT qid, ap * 100 + key_priority AS pos, attribute_key, value FROM r JOIN {_FACETS} k USING (facet)),
    t AS (SELECT qid, {_CLEAN} AS q FROM fx_specs),
    e_q AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT qid, '{f}' AS attribute_key, {e} AS value FROM t" for f, e in _QUANT.items())}) u WHERE value IS NOT NULL AND value <> ''),
    e_k AS (SELECT qid, facet AS attribute_key, value FROM {_KEYWORDS} k WHERE NOT (facet = 'product_type' AND qid IN (SELECT qid FROM {_KEYWORDS} m WHERE facet = 'motor_type')))
    """


def _total_sql(name: str) -> str:
    v = f"e_{name[0]}"
    return f"""SELECT '{name}' AS source, count(*) AS gt_attributes, count(*) FILTER (WHERE m.key_matched) AS key_matches, count(*) FILTER (WHERE f.value_matched) AS value_matches
        FROM {fuzzy_sql(v, 'e_gt')} f JOIN {canonical_match_sql(v, 'e_gt')} m ON m.qid = f.qid AND m.pos = f.pos"""


@query("e2_tag_and_compare", f"{_E2} {_total_sql('quantities')} UNION ALL {_total_sql('keywords')}")
def _(spark, d):
    texts = fx.specs(spark, d)
    as_attrs = lambda tags: tags.select("qid", F.col("facet").alias("attribute_key"), "value")
    candidates = {
        "quantities": as_attrs(tagging.tag_quantities(texts)),
        "keywords": as_attrs(tagging.tag_keyword_facets(texts, tagging.facet_dictionary(spark))),
    }
    return jobs.tag_and_compare(texts, candidates)["totals"]


_E4 = f"""WITH e_gt AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY facet) AS pos, facet AS attribute_key, value FROM {_SINGLE} r),
    t AS ({_LOW}),
    e_q AS (SELECT qid, facet AS attribute_key, value FROM ({_all_sql()}) u WHERE value IS NOT NULL),
    e_a AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT qid, '{f}' AS attribute_key, {_case(r)} AS value FROM t" for f, r in L.FIRST_OF.items())}) u WHERE value IS NOT NULL)
    """


@query("e4_rule_totals", f"{_E4} {_total_sql('quantities')} UNION ALL {_total_sql('alternatives')}")
def _(spark, d):
    texts = fx.specs(spark, d)
    as_attrs = lambda tags: tags.select("qid", F.col("facet").alias("attribute_key"), "value")
    candidates = {"quantities": as_attrs(tagging.tag_all_quantities(texts)), "alternatives": as_attrs(tagging.tag_first_of(texts))}
    return jobs.tag_and_compare(texts, candidates, tagger=jobs.single_value_reference)["totals"]


def _some_sql(items, few: int, many: int, seed: str) -> str:
    listed = "[" + ", ".join(lit(v) for v in items) + "]"
    return f"list_transform(list_sort(list_transform({listed}, lambda p: {hx(seed, 'id', 'p')} || p))[1:{few} + {h32(seed + ':n', 'id')} % {many - few + 1}], lambda s: substr(s, 33))"


def _sized(task: str) -> str:
    return f"CAST(floor({_N_PART} * {L.TASK_RATIOS[task]}) AS BIGINT)"


def _multitask_sql(seed: str) -> str:
    x, c, t = (f"{seed}:{task}" for task in L.TASK_RATIOS)
    sizes = [_sized(task) for task in L.TASK_RATIOS]
    terms = "MAP {" + ", ".join(f"{lit(a)}: {lit(b)}" for a, b in L.TRANSLATIONS.items()) + "}"
    named = f"array_to_string(list_transform(list_filter(attributes, lambda e: {h32(x + ':named', 'id', 'e.key')} % 10 >= 3), lambda e: e.value), ' ')"
    right = f"(SELECT id, {product_sql(c)} || ' ' || array_to_string({_some_sql(L.CORRECTION_PHRASES, 2, 4, c + ':phrase')}, ' ') AS text FROM (SELECT unnest(range(0, {sizes[1]})) AS id) i) q"
    return f"""WITH m AS (SELECT 'isq_extraction' AS task, id, {lit(L.EXTRACTION_TASK)} || product || coalesce(' ' || nullif({named}, ''), '') AS instruction,
          '{{"product": "' || product || '"' || array_to_string(list_transform(attributes, lambda e: ', "' || e.key || '": "' || e.value || '"'), '') || '}}' AS output
          FROM (SELECT *, {product_sql(x)} AS product FROM {records_sql(synth_sql(x, sizes[0], 2, 8), x)} r) a
        UNION ALL SELECT 'query_correction', id, {lit(L.CORRECTION_TASK)} || noisy, text FROM ({typo_sql(c, 'id', right)}) b
        UNION ALL SELECT 'translation', id, CASE WHEN f THEN {lit(L.TRANSLATION_TASKS['forward'])} || h ELSE {lit(L.TRANSLATION_TASKS['backward'])} || o END, CASE WHEN f THEN o ELSE h END FROM
          (SELECT id, {h32(t + ':direction', 'id')} % 2 = 0 AS f, array_to_string(l, ' ') AS h, array_to_string(list_transform(l, lambda w: {terms}[w]), ' ') AS o FROM
            (SELECT id, {_some_sql(L.TRANSLATIONS, 2, 4, t + ':term')} AS l FROM (SELECT unnest(range(0, {sizes[2]})) AS id) i) d) e)
        SELECT task, id, md5(instruction) AS instruction, output, place, CASE WHEN place <= floor((SELECT count(*) FROM m) * 0.9) THEN 'train' ELSE 'val' END AS split FROM
        (SELECT *, row_number() OVER (ORDER BY {hx(seed + ':order', "task || '|' || CAST(id AS VARCHAR)")}) AS place FROM m) p"""


@query("e5_multitask_records", _multitask_sql("e5"))
def _(spark, d):
    out = jobs.multitask_records(fx.pools(spark, d), fx.table(spark, d, "part").count(), "e5")
    return out.withColumn("instruction", F.md5("instruction"))


@query(
    "e3_label_training",
    f"""WITH v AS (SELECT ord, trim(name) AS name, CAST(label_id AS BIGINT) AS label_id, label FROM fx_items ORDER BY ord LIMIT (SELECT count(*) * 3 // 4 FROM fx_items)),
        s AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY {hx('e3', 'ord')}, ord) AS r, count(*) OVER (PARTITION BY label_id) AS n,
                (row_number() OVER (ORDER BY {hx('e3:templates', 'ord')}, ord) - 1) % {len(L.INSTRUCTION_TEMPLATES)} AS no FROM v)
        SELECT ord, CASE WHEN r <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.1, 0)) ELSE 0 END THEN 'val' ELSE 'train' END AS split, md5(CASE no {_ROT} END) AS instruction,
          '{{"label_name": "' || label || '", "label_id": ' || CAST(label_id AS VARCHAR) || '}}' AS output FROM s""",
)
def _(spark, d):
    items = fx.items(spark, d)
    return jobs.label_training(items, items.count() * 3 // 4, 0.1, "e3").withColumn("instruction", F.md5("instruction"))
