"""Registered queries: alignment, joins, set operations, metrics, windows, top-k, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.normalize import norm_key

from ..functions.tables import small_table
from ..operators import align, audit, compare, datasets, labels, ledger, metrics, reshape, topk, vocabulary
from . import fixtures as fx
from .parsing_queries import CLASSED, ROLLUP, canonical_sql, classed
from .registry import query
from .sqltext import hx, nk, nks, nv, nvs, values

# ------------------------------------------------------------ shared pieces of reference SQL


def terms_sql(cand: str, gt: str = "fx_gt") -> str:
    """(qid, facet, term, in_gt, in_cand)."""
    def side(view: str, g: str, c: str) -> str:
        return " UNION ALL ".join(
            f"SELECT qid, '{f}' AS facet, {expr} AS term, {g} AS g, {c} AS c FROM {view}"
            for f, expr in (("key", nk("attribute_key")), ("value", nv("value")))
        )

    return f"""(SELECT qid, facet, term, bool_or(g) AS in_gt, bool_or(c) AS in_cand FROM
        ({side(gt, 'true', 'false')} UNION ALL {side(cand, 'false', 'true')}) u WHERE term <> '' GROUP BY qid, facet, term)"""


def counts_sql(cand: str, gt: str = "fx_gt") -> str:
    def n(f: str, cond: str) -> str:
        return f"count(*) FILTER (WHERE facet = '{f}' AND {cond})"

    return f"""(SELECT qid, {n('key', 'in_gt')} AS gt_keys, {n('key', 'in_cand')} AS cand_keys, {n('key', 'in_gt AND in_cand')} AS matched_keys,
        {n('value', 'in_gt')} AS gt_values, {n('value', 'in_cand')} AS cand_values, {n('value', 'in_gt AND in_cand')} AS matched_values
        FROM {terms_sql(cand, gt)} f GROUP BY qid)"""


def triage_sql(cand: str, gt: str = "fx_gt") -> str:
    return f"""(SELECT g.*, {nk('g.attribute_key')} AS norm_key, CASE WHEN c.v IS NULL THEN 'NA' WHEN c.v = {nv('g.value')} THEN 'TRUE' ELSE 'FALSE' END AS verdict
        FROM {gt} g LEFT JOIN (SELECT qid, {nk('attribute_key')} AS k, arg_max({nv('value')}, pos) AS v FROM {cand} GROUP BY qid, k) c
        ON c.qid = g.qid AND c.k = {nk('g.attribute_key')})"""


def flags(spark, d, cand=fx.cand_b, gt=fx.gt):
    return compare.term_flags(gt(spark, d), cand(spark, d))


def counts(spark, d, cand=fx.cand_b, gt=fx.gt):
    return compare.set_counts(flags(spark, d, cand, gt))


# ------------------------------------------------------------------------------- joins

_FIRST = "(SELECT query, arg_min(qid, ord) AS qid, arg_min(n_attrs, ord) AS n_attrs FROM {v} GROUP BY query)"
_B, _C = _FIRST.format(v="fx_res_b"), _FIRST.format(v="fx_res_c")


def _res(spark, d, name):
    return fx.res_counts(spark, d, name).select("qid", "ord", "query", "n_attrs")


@query(
    "j1_align_inner",
    f"SELECT b.query, b.qid AS b_qid, b.n_attrs AS b_n_attrs, c.qid AS c_qid, c.n_attrs AS c_n_attrs FROM {_B} b JOIN {_C} c ON c.query = b.query",
)
def _(spark, d):
    return align.align_inner({"b": _res(spark, d, "b"), "c": _res(spark, d, "c")})


@query(
    "j2_align_outer",
    """SELECT coalesce(b.qid, c.qid) AS qid, coalesce(b.n_attrs, 0) AS b_n_attrs, coalesce(c.n_attrs, 0) AS c_n_attrs
       FROM fx_res_b b FULL JOIN fx_res_c c ON b.qid = c.qid""",
)
def _(spark, d):
    sources = {n: _res(spark, d, n).select("qid", "n_attrs") for n in ("b", "c")}
    return align.align_outer(sources, ["n_attrs"], "qid")


@query(
    "j3_align_left",
    f"""SELECT g.qid, g.query, b.qid AS b_qid, b.n_attrs AS b_n_attrs, c.qid AS c_qid, c.n_attrs AS c_n_attrs
        FROM fx_queries g LEFT JOIN {_B} b ON b.query = g.query LEFT JOIN {_C} c ON c.query = g.query""",
)
def _(spark, d):
    base = fx.queries(spark, d).select("qid", "query")
    return align.align_left(base, {"b": _res(spark, d, "b"), "c": _res(spark, d, "c")})


@query(
    "j4_align_flagged",
    """SELECT coalesce(b.qid, c.qid) AS qid, b.success AS b_success, c.success AS c_success, b.qid IS NOT NULL AS b_in_source, c.qid IS NOT NULL AS c_in_source
       FROM fx_res_b b FULL JOIN fx_res_c c ON b.qid = c.qid""",
)
def _(spark, d):
    b, c = (fx.res_counts(spark, d, n).select("qid", "success") for n in ("b", "c"))
    return align.align_flagged(b, c, "qid", ("b", "c"))


@query("j5_common_queries", "SELECT query FROM fx_res_b INTERSECT SELECT query FROM fx_res_c INTERSECT SELECT query FROM fx_res_gt")
def _(spark, d):
    return align.common_queries({n: fx.res_counts(spark, d, n) for n in ("gt", "b", "c")})


@query("j6_in_vocab", "SELECT key, value, ord FROM fx_vocab WHERE key IN (SELECT attribute_key FROM fx_gt)")
def _(spark, d):
    return vocabulary.in_vocab(fx.vocab(spark, d), fx.gt(spark, d).select(F.col("attribute_key").alias("key")))


@query(
    "j7_not_in_training",
    "SELECT doc_id FROM documents WHERE lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM documents WHERE doc_id % 4 = 0)",
)
def _(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    return datasets.not_in_training(docs, docs.filter("doc_id % 4 = 0"), "text").select("doc_id")


_ENTRY = "string_agg(CAST(attribute_priority AS VARCHAR) || ',' || CAST(key_priority AS VARCHAR) || ',' || attribute_key || ',' || value || ',' || CAST(n AS VARCHAR), ';' ORDER BY attribute_priority, key_priority, attribute_key, value)"


def _entries_sql(view):
    return f"""(SELECT qid, k, sum(n) AS n, {_ENTRY} AS e FROM (SELECT qid, {nks('attribute_key')} AS k, attribute_key, value, key_priority, attribute_priority, count(*) AS n
        FROM {view} GROUP BY ALL) t GROUP BY qid, k)"""


@query(
    "j8_entry_pairs",
    f"""SELECT g.qid, g.k AS norm_key, g.e AS gt_entries, c.e AS cand_entries, CAST(g.n AS BIGINT) AS n_gt, CAST(c.n AS BIGINT) AS n_cand, CAST(g.n * c.n AS BIGINT) AS pairs
        FROM {_entries_sql('fx_gt')} g JOIN {_entries_sql('fx_cand_c')} c ON c.qid = g.qid AND c.k = g.k""",
)
def _(spark, d):
    def text(c):
        return F.array_join(
            F.transform(c, lambda e: F.concat_ws(",", e["attribute_priority"], e["key_priority"], e["attribute_key"], e["value"], e["n"])), ";"
        ).alias(c)

    out = compare.entry_pairs(fx.gt(spark, d), fx.cand_c(spark, d))
    return out.select("qid", "norm_key", text("gt_entries"), text("cand_entries"), "n_gt", "n_cand", "pairs")


def _by_value(view):
    return f"(SELECT qid, {nvs('value')} AS v, list_sort(list(DISTINCT {nks('attribute_key')})) AS ks, list_sort(list(DISTINCT {{'k': {nks('attribute_key')}, 'a': key_priority, 'b': attribute_priority}})) AS es, arg_min(value, pos) AS o FROM {view} GROUP BY qid, v)"


def _entries_sql(es: str) -> str:
    return f"array_to_string(list_transform({es}, lambda e: e.k || ':' || e.a || ':' || e.b), '|')"


@query(
    "j9_value_pairs",
    f"""SELECT g.qid, g.v AS norm_value, array_to_string(g.ks, '|') AS gt_keys, array_to_string(c.ks, '|') AS cand_keys, g.o AS gt_original, c.o AS cand_original,
        {_entries_sql('g.es')} AS gt_entries, {_entries_sql('c.es')} AS cand_entries, list_has_any(g.ks, c.ks) AS under_same_key FROM {_by_value('fx_gt')} g JOIN {_by_value('fx_cand_b')} c ON c.qid = g.qid AND c.v = g.v""",
)
def _(spark, d):
    out = compare.value_pairs(fx.gt(spark, d), fx.cand_b(spark, d))
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["key"], e["key_priority"].cast("string"), e["attribute_priority"].cast("string"))), "|")
    return out.withColumns({c: F.array_join(c, "|") for c in ("gt_keys", "cand_keys")} | {c: shown(c) for c in ("gt_entries", "cand_entries")})


def _nums(x: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all({x}, '\d+\.?\d*')))"


def fuzzy_sql(cand: str, gt: str = "fx_gt") -> str:
    g, c = nv("g.value"), nv("c.value")
    return f"""(SELECT g.qid, g.pos, g.attribute_key, EXISTS (SELECT 1 FROM {cand} c WHERE c.qid = g.qid AND {g} <> '' AND {c} <> '' AND
        (contains({g}, {c}) OR contains({c}, {g}) OR (len({_nums(g)}) > 0 AND {_nums(g)} = {_nums(c)}))) AS value_matched FROM {gt} g)"""


@query("j10_fuzzy_match", f"SELECT qid, pos, value_matched FROM {fuzzy_sql('fx_cand_c')} f")
def _(spark, d):
    return compare.fuzzy_flags(fx.gt(spark, d), fx.cand_c(spark, d)).select("qid", "pos", "value_matched")


def canonical_match_sql(cand: str, gt: str = "fx_gt") -> str:
    return f"""(SELECT g.qid, g.pos, g.canonical_key, EXISTS (SELECT 1 FROM ({canonical_sql(cand)}) c WHERE c.qid = g.qid AND c.canonical_key = g.canonical_key) AS key_matched
        FROM ({canonical_sql(gt)}) g)"""


@query("j11_canonical_match", f"SELECT qid, pos, canonical_key, key_matched FROM {canonical_match_sql('fx_cand_b')} m")
def _(spark, d):
    out = compare.canonical_flags(fx.gt(spark, d), fx.cand_b(spark, d), vocabulary.synonym_table(spark))
    return out.select("qid", "pos", "canonical_key", "key_matched")


_LAST = "(SELECT lower(trim(keyword)) AS k, arg_max(label_id, ord) AS id, arg_max(label_name, ord) AS name FROM {v} GROUP BY k)"
ALIGNED = f"""(SELECT b.ord, b.keyword, coalesce(x.id, '') AS base_id, coalesce(x.name, '') AS base_name, coalesce(m.id, '') AS m1_id, coalesce(m.name, '') AS m1_name,
    coalesce(n.id, '') AS m2_id, coalesce(n.name, '') AS m2_name FROM fx_label_base b LEFT JOIN {_LAST.format(v='fx_label_base')} x ON x.k = lower(trim(b.keyword))
    LEFT JOIN {_LAST.format(v='fx_label_m1')} m ON m.k = lower(trim(b.keyword)) LEFT JOIN {_LAST.format(v='fx_label_m2')} n ON n.k = lower(trim(b.keyword)))"""


def aligned(spark, d):
    return labels.align_labels(
        fx.label_source(spark, d, "base"), {n: fx.label_source(spark, d, n) for n in ("m1", "m2")}
    )


@query("j12_align_labels", f"SELECT * FROM {ALIGNED} a")
def _(spark, d):
    return aligned(spark, d)


@query(
    "j13_map_keys",
    """WITH known AS (SELECT DISTINCT attribute_key AS key FROM fx_gt)
       SELECT v.key, v.value, v.ord, coalesce(o.target, k.key) AS mapped_key FROM fx_vocab v
       LEFT JOIN (SELECT 'finish' AS key, 'type' AS target UNION ALL SELECT 'manufacturer', 'brand' UNION ALL SELECT 'size', 'nowhere') o
         ON o.key = v.key AND o.target IN (SELECT key FROM known) LEFT JOIN known k ON k.key = v.key WHERE coalesce(o.target, k.key) IS NOT NULL""",
)
def _(spark, d):
    overrides = small_table(spark, [("finish", "type"), ("manufacturer", "brand"), ("size", "nowhere")], "key string, target string")
    return vocabulary.map_keys(fx.vocab(spark, d), fx.gt(spark, d).select(F.col("attribute_key").alias("key")), overrides)


@query(
    "j14_merge_retries",
    """WITH r AS (SELECT qid, arg_max(n_attrs, ord) AS n FROM (SELECT qid, ord, n_attrs + 10 AS n_attrs FROM fx_res_c WHERE success) t GROUP BY qid)
       SELECT b.qid, CASE WHEN NOT b.success AND r.qid IS NOT NULL THEN true ELSE b.success END AS success,
              CASE WHEN NOT b.success AND r.qid IS NOT NULL THEN r.n ELSE b.n_attrs END AS n_attrs, (NOT b.success AND r.qid IS NOT NULL) AS recovered
       FROM fx_res_b b LEFT JOIN r ON r.qid = b.qid""",
)
def _(spark, d):
    base = fx.res_counts(spark, d, "b").select("qid", "success", "n_attrs")
    retry = fx.res_counts(spark, d, "c").select("qid", "ord", "success", (F.col("n_attrs") + 10).alias("n_attrs"))
    return align.merge_retries(base, retry, "qid", "ord")


# ----------------------------------------------------------------------- set operations


def _set(facet: str, cond: str) -> str:
    return f"coalesce(string_agg(CASE WHEN facet = '{facet}' AND {cond} THEN term END, '|' ORDER BY term), '')"


@query(
    "u1_set_compare",
    f"""SELECT qid, {_set('key', 'in_gt AND in_cand')} AS matched_key_set, {_set('key', 'NOT in_cand')} AS gt_only_key_set, {_set('key', 'NOT in_gt')} AS cand_only_key_set,
        {_set('value', 'in_gt AND in_cand')} AS matched_value_set, {_set('value', 'NOT in_cand')} AS gt_only_value_set, {_set('value', 'NOT in_gt')} AS cand_only_value_set,
        count(*) FILTER (WHERE facet = 'key' AND in_gt) AS gt_keys, count(*) FILTER (WHERE facet = 'key' AND in_cand) AS cand_keys,
        count(*) FILTER (WHERE facet = 'key' AND in_gt AND in_cand) AS matched_keys, count(*) FILTER (WHERE facet = 'value' AND in_gt) AS gt_values,
        count(*) FILTER (WHERE facet = 'value' AND in_cand) AS cand_values, count(*) FILTER (WHERE facet = 'value' AND in_gt AND in_cand) AS matched_values
        FROM {terms_sql('fx_cand_b')} f GROUP BY qid""",
)
def _(spark, d):
    out = compare.set_compare(flags(spark, d))
    return out.withColumns({c: F.array_join(c, "|") for c in out.columns if c.endswith("_set")})


@query(
    "u2_vocab_overlap",
    f"""SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'left_only' WHEN a.key IS NULL THEN 'right_only' ELSE 'common' END AS membership
        FROM (SELECT DISTINCT {nk('attribute_key')} AS key FROM fx_gt) a FULL JOIN (SELECT DISTINCT {nk('attribute_key')} AS key FROM fx_cand_b) b ON a.key = b.key""",
)
def _(spark, d):
    named = lambda df: df.select(norm_key(F.col("attribute_key")).alias("attribute_key"))
    return compare.vocab_overlap(named(fx.gt(spark, d)), named(fx.cand_b(spark, d)))


_NAMES = ["gt", "b", "c"]
_OVERLAP = (
    "WITH " + ", ".join(f"u_{n} AS (SELECT query, count(*) AS n FROM fx_res_{n} GROUP BY query)" for n in _NAMES)
    + " "
    + " UNION ALL ".join(
        [f"SELECT '{n}_rows' AS metric, CAST(sum(n) AS BIGINT) AS n FROM u_{n}" for n in _NAMES]
        + [f"SELECT '{n}_unique', count(*) FROM u_{n}" for n in _NAMES]
        + [f"SELECT '{n}_duplicates', CAST(sum(n - 1) AS BIGINT) FROM u_{n}" for n in _NAMES]
        + ["SELECT 'common_to_all', count(*) FROM u_gt JOIN u_b USING (query) JOIN u_c USING (query)"]
        + [f"SELECT '{a}_not_in_{b}', count(*) FROM u_{a} WHERE query NOT IN (SELECT query FROM u_{b})" for a in _NAMES for b in _NAMES if a != b]
    )
)


@query("u3_query_overlap", _OVERLAP)
def _(spark, d):
    return align.query_overlap({n: fx.res_counts(spark, d, n) for n in _NAMES})


@query(
    "u4_union_tiers",
    "SELECT 'small' AS tier, qid, query FROM fx_queries WHERE qid % 3 = 0 UNION ALL SELECT 'large', qid, query FROM fx_queries WHERE qid % 3 <> 0",
)
def _(spark, d):
    q = fx.queries(spark, d).select("qid", "query")
    return datasets.union_tiers({"small": q.filter("qid % 3 = 0"), "large": q.filter("qid % 3 <> 0")})


def _ks(cond: str) -> str:
    return f"coalesce(string_agg(CASE WHEN {cond} THEN term END, '|' ORDER BY term), '')"


@query(
    "u5_exact_keyset",
    f"""SELECT qid, {_ks('in_gt AND in_cand')} AS common_keys, {_ks('NOT in_cand')} AS gt_only_keys, {_ks('NOT in_gt')} AS cand_only_keys, bool_and(in_gt AND in_cand) AS perfect
        FROM (SELECT * FROM {terms_sql('fx_cand_c', 'fx_cand_b')} f WHERE facet = 'key') t GROUP BY qid""",
)
def _(spark, d):
    out = compare.exact_keyset(flags(spark, d, fx.cand_c, fx.cand_b))
    return out.withColumns({c: F.array_join(c, "|") for c in out.columns if c.endswith("_keys")})


@query(
    "u6_vocab_parity",
    """SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'left_only' WHEN a.key IS NULL THEN 'right_only' ELSE 'common' END AS membership
       FROM (SELECT DISTINCT key FROM fx_vocab) a FULL JOIN (SELECT DISTINCT attribute_key AS key FROM fx_cand_c) b ON a.key = b.key""",
)
def _(spark, d):
    isq = fx.isq(spark, d).join(fx.queries(spark, d), "qid")
    source = fx.cand_c(spark, d).select(F.col("attribute_key").alias("key"))
    return vocabulary.vocab_parity(datasets.distill_pairs(isq), source)


# ----------------------------------------------------------------------------- metrics

_SCORE = """SELECT count(*) AS queries, CAST(sum(matched_keys) AS BIGINT) AS total_keys_matched, count(*) FILTER (WHERE matched_keys > 0) AS queries_any_keys,
    count(*) FILTER (WHERE matched_keys = gt_keys AND gt_keys > 0) AS queries_all_keys, CAST(sum(matched_values) AS BIGINT) AS total_values_matched,
    count(*) FILTER (WHERE matched_values > 0) AS queries_any_values, count(*) FILTER (WHERE matched_values = gt_values AND gt_values > 0) AS queries_all_values FROM """


@query("a1_scorecard", _SCORE + counts_sql("fx_cand_b") + " c")
def _(spark, d):
    return metrics.scorecard(counts(spark, d))


@query(
    "a2_match_rate",
    f"""SELECT qid, matched_keys::DOUBLE / nullif(gt_keys, 0) AS key_rate, matched_values::DOUBLE / nullif(gt_values, 0) AS value_rate,
        coalesce(matched_keys::DOUBLE / nullif(gt_keys, 0), 0) AS key_rate_0 FROM {counts_sql('fx_cand_b', 'fx_cand_c')} c""",
)
def _(spark, d):
    c = counts(spark, d, fx.cand_b, fx.cand_c)
    zero = metrics.match_rate(c, zero=True).select("qid", F.col("key_rate").alias("key_rate_0"))
    return metrics.match_rate(c).select("qid", "key_rate", "value_rate").join(zero, "qid")


FREQ = f"""(SELECT k AS key, CAST(sum(g) AS BIGINT) AS gt_freq, CAST(sum(c) AS BIGINT) AS cand_freq, count(*) FILTER (WHERE g > 0 AND c > 0) AS match_freq FROM
    (SELECT qid, k, sum(g) AS g, sum(c) AS c FROM (SELECT qid, {nk('attribute_key')} AS k, 1 AS g, 0 AS c FROM fx_gt UNION ALL SELECT qid, {nk('attribute_key')}, 0, 1 FROM fx_cand_b) u GROUP BY qid, k) t
    GROUP BY k)"""


def freq(spark, d):
    return metrics.key_frequency(fx.gt(spark, d), fx.cand_b(spark, d))


@query("a3_key_frequency", f"SELECT * FROM {FREQ} f")
def _(spark, d):
    return freq(spark, d)


@query(
    "a4_one_sided_keys",
    f"SELECT 'gt' AS side, key, gt_freq AS freq FROM {FREQ} f WHERE cand_freq = 0 UNION ALL SELECT 'cand', key, cand_freq FROM {FREQ} f WHERE gt_freq = 0",
)
def _(spark, d):
    f = freq(spark, d)
    sides = [metrics.one_sided_keys(f, s).select(F.lit(s).alias("side"), "key", "freq") for s in ("gt", "cand")]
    return sides[0].unionByName(sides[1])


def buckets_sql(cand: str, gt: str, denom: str) -> str:
    return f"""SELECT b.bucket, b.label, CAST(b.low AS DOUBLE) AS low, CAST(b.high AS DOUBLE) AS high, count(r.r) AS n FROM {values(metrics.RATE_BUCKETS, 'bucket', 'label', 'low', 'high')} b
        LEFT JOIN (SELECT matched_keys::DOUBLE / nullif({denom}, 0) AS r FROM {counts_sql(cand, gt)} c) r
        ON b.bucket = CASE WHEN r.r = 0 THEN 0 WHEN r.r < 0.25 THEN 1 WHEN r.r < 0.5 THEN 2 WHEN r.r < 0.75 THEN 3 WHEN r.r < 1 THEN 4 WHEN r.r >= 1 THEN 5 END
        GROUP BY ALL"""


@query("a5_rate_buckets", buckets_sql("fx_cand_b", "fx_gt", "gt_keys"))
def _(spark, d):
    return metrics.rate_buckets(counts(spark, d))


@query(
    "a6_success_matrix",
    """SELECT count(*) FILTER (WHERE g AND c) AS "both", count(*) FILTER (WHERE g AND NOT c) AS gt_only, count(*) FILTER (WHERE NOT g AND c) AS cand_only,
       count(*) FILTER (WHERE NOT g AND NOT c) AS neither FROM (SELECT coalesce(a.success, false) AS g, coalesce(b.success, false) AS c FROM fx_res_gt a FULL JOIN fx_res_b b ON a.qid = b.qid) t""",
)
def _(spark, d):
    g, b = (fx.res_counts(spark, d, n).select("qid", "success") for n in ("gt", "b"))
    return metrics.success_matrix(align.align_flagged(g, b, "qid"))


@query("a7_triage", f"SELECT qid, pos, norm_key, verdict FROM {triage_sql('fx_cand_b')} t")
def _(spark, d):
    return metrics.triage(fx.gt(spark, d), fx.cand_b(spark, d)).select("qid", "pos", "norm_key", "verdict")


def _micro_sql(name: str) -> str:
    v = f"fx_cand_{name}"
    return f"""SELECT '{name}' AS source, t.total, t.true_n, t.false_n, t.total - t.true_n - t.false_n AS na_n, t.true_n::DOUBLE / t.total AS true_rate,
        (t.true_n + t.false_n)::DOUBLE / t.total AS key_found_rate, a.avg_attributes FROM
        (SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'TRUE') AS true_n, count(*) FILTER (WHERE verdict = 'FALSE') AS false_n
         FROM {triage_sql(v)} x WHERE qid IN (SELECT qid FROM {v})) t, (SELECT count(*)::DOUBLE / count(DISTINCT qid) AS avg_attributes FROM {v}) a"""


MICRO = f"({_micro_sql('b')} UNION ALL {_micro_sql('c')})"


def micro(spark, d):
    return metrics.triage_micro(fx.gt(spark, d), {"b": fx.cand_b(spark, d), "c": fx.cand_c(spark, d)})


@query("a8_triage_micro", f"SELECT * FROM {MICRO} m")
def _(spark, d):
    return micro(spark, d)


@query(
    "a9_macro_metrics",
    f"""WITH cells AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.k, b.k) AS k, a.v AS g, b.v AS c FROM
          (SELECT qid, {nk('attribute_key')} AS k, arg_max({nv('value')}, pos) AS v FROM fx_gt GROUP BY qid, k) a FULL JOIN
          (SELECT qid, {nk('attribute_key')} AS k, arg_max({nv('value')}, pos) AS v FROM fx_cand_b GROUP BY qid, k) b ON a.qid = b.qid AND a.k = b.k),
        per AS (SELECT qid, count(g) AS gk, count(c) AS ck, count(*) FILTER (WHERE g IS NOT NULL AND c IS NOT NULL) AS bo, count(*) FILTER (WHERE g = c) AS eq FROM cells GROUP BY qid HAVING count(g) > 0),
        keys AS (SELECT k, bool_or(g IS NOT NULL) AS ig, bool_or(c IS NOT NULL) AS ic FROM cells GROUP BY k)
        SELECT count(*) AS queries, round(avg(bo::DOUBLE / gk), 6) AS avg_key_overlap, round(avg(coalesce(eq::DOUBLE / nullif(bo, 0), 0)), 6) AS avg_value_match, avg(ck) AS avg_cand_keys, avg(gk) AS avg_gt_keys,
          (SELECT count(*) FROM keys WHERE ig) AS corpus_gt_keys, (SELECT count(*) FROM keys WHERE ic) AS corpus_cand_keys, (SELECT count(*) FROM keys WHERE ig AND ic) AS corpus_common_keys FROM per""",
)
def _(spark, d):
    out = metrics.macro_metrics(fx.gt(spark, d), fx.cand_b(spark, d))
    # the mean of doubles depends on the order of addition in its last digits
    return out.withColumns({c: F.round(c, 6) for c in ("avg_key_overlap", "avg_value_match")})


def pair_join(cand: str) -> str:
    """All reference/candidate entry pairs with equal key and value, written out."""
    return f"""(SELECT g.qid, g.key_priority = c.key_priority AS kp, g.attribute_priority = c.attribute_priority AS ap FROM fx_gt g JOIN {cand} c
        ON c.qid = g.qid AND {nks('c.attribute_key')} = {nks('g.attribute_key')} AND {nvs('c.value')} = {nvs('g.value')})"""


@query(
    "a10_priority_alignment",
    f"""SELECT CAST(coalesce(sum(p), 0) AS BIGINT) AS perfect, CAST(coalesce(sum(n - p), 0) AS BIGINT) AS partial, count(*) FILTER (WHERE p > 0) AS queries_with_perfect FROM
        (SELECT qid, count(*) AS n, count(*) FILTER (WHERE kp AND ap) AS p FROM {pair_join('fx_cand_c')} x GROUP BY qid) t""",
)
def _(spark, d):
    return metrics_priority(spark, d, compare.priority_alignment)


def metrics_priority(spark, d, fn):
    return fn(compare.priority_counts(fx.gt(spark, d), fx.cand_c(spark, d)))


@query(
    "a11_priority_counts",
    f"""SELECT q.qid, count(x.qid) AS pairs, count(*) FILTER (WHERE x.kp) AS key_priority_matches, count(*) FILTER (WHERE x.ap) AS attr_priority_matches, count(*) FILTER (WHERE x.kp AND x.ap) AS perfect
        FROM (SELECT DISTINCT qid FROM (SELECT qid FROM fx_gt UNION ALL SELECT qid FROM fx_cand_c) u) q LEFT JOIN {pair_join('fx_cand_c')} x ON x.qid = q.qid GROUP BY q.qid""",
)
def _(spark, d):
    return metrics_priority(spark, d, lambda c: c)


@query(
    "a12_peer_scorecard",
    f"""SELECT count(*) AS queries, CAST(sum(matched_keys) AS BIGINT) AS total_keys_matched, count(*) FILTER (WHERE matched_keys > 0) AS queries_any_keys,
        count(*) FILTER (WHERE matched_keys > 0 AND matched_keys = least(gt_keys, cand_keys)) AS queries_full_keys, CAST(sum(matched_values) AS BIGINT) AS total_values_matched,
        count(*) FILTER (WHERE matched_values > 0) AS queries_any_values, count(*) FILTER (WHERE matched_values > 0 AND matched_values = least(gt_values, cand_values)) AS queries_full_values
        FROM {counts_sql('fx_cand_c', 'fx_cand_b')} c""",
)
def _(spark, d):
    return metrics.peer_scorecard(counts(spark, d, fx.cand_c, fx.cand_b))


@query("a12_peer_buckets", buckets_sql("fx_cand_c", "fx_cand_b", "greatest(gt_keys, cand_keys)"))
def _(spark, d):
    return metrics.peer_buckets(counts(spark, d, fx.cand_c, fx.cand_b))


_COUNT3 = """(SELECT g.qid, g.n_attrs AS gt, coalesce(b.n_attrs, 0) AS b, coalesce(c.n_attrs, 0) AS c FROM fx_res_gt g LEFT JOIN fx_res_b b ON b.qid = g.qid LEFT JOIN fx_res_c c ON c.qid = g.qid)"""


def count3(spark, d):
    sources = {n: _res(spark, d, n).select("qid", "n_attrs") for n in _NAMES}
    out = align.align_outer(sources, ["n_attrs"], "qid")
    return out.select("qid", *[F.col(f"{n}_n_attrs").alias(n) for n in _NAMES])


@query(
    "a13_count_agreement",
    f"""SELECT *, (gt = b AND b = c) AS count_match, CASE WHEN gt = b AND b = c THEN 'same' ELSE concat_ws(',', CASE WHEN gt = greatest(gt, b, c) THEN 'gt' END,
        CASE WHEN b = greatest(gt, b, c) THEN 'b' END, CASE WHEN c = greatest(gt, b, c) THEN 'c' END) END AS high_count FROM {_COUNT3} t""",
)
def _(spark, d):
    return metrics.count_agreement(count3(spark, d), {n: n for n in _NAMES})


@query(
    "a14_pairwise",
    f"""SELECT t.qid, CAST(row_number() OVER (PARTITION BY t.qid ORDER BY norm_key, pos) AS INTEGER) AS position, norm_key, {nv('value')} AS norm_value, verdict <> 'NA' AS key_match, verdict AS value_match
        FROM {triage_sql('fx_cand_c', 'fx_cand_b')} t""",
)
def _(spark, d):
    return metrics.pairwise(fx.cand_b(spark, d), fx.cand_c(spark, d))


def _pair_totals(a: str, b: str) -> str:
    v = {"gt": "fx_gt", "b": "fx_cand_b", "c": "fx_cand_c"}
    return f"""SELECT '{a}' AS src, '{b}' AS dst, total, true_n, false_n, total - true_n - false_n AS na_n, true_n::DOUBLE / total AS true_rate, (true_n + false_n)::DOUBLE / total AS key_found_rate FROM
        (SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'TRUE') AS true_n, count(*) FILTER (WHERE verdict = 'FALSE') AS false_n FROM {triage_sql(v[b], v[a])} x WHERE qid IN (SELECT qid FROM {v[b]})) t"""


@query("a15_pairwise_totals", " UNION ALL ".join(_pair_totals(a, b) for a in _NAMES for b in _NAMES if a != b))
def _(spark, d):
    stacked = None
    for n, f in (("gt", fx.gt), ("b", fx.cand_b), ("c", fx.cand_c)):
        part = f(spark, d).withColumn("source", F.lit(n))
        stacked = part if stacked is None else stacked.unionByName(part)
    return metrics.pairwise_totals(stacked)


@query(
    "a16_head_to_head",
    f"""SELECT CASE WHEN coalesce(b.m, 0) > coalesce(c.m, 0) THEN 'win' WHEN coalesce(b.m, 0) = coalesce(c.m, 0) THEN 'tie' ELSE 'loss' END AS outcome, count(*) AS n FROM
        (SELECT qid, matched_keys AS m FROM {counts_sql('fx_cand_b')} x) b JOIN (SELECT qid, matched_keys AS m FROM {counts_sql('fx_cand_c')} y) c ON b.qid = c.qid GROUP BY 1""",
)
def _(spark, d):
    b = counts(spark, d, fx.cand_b).select("qid", F.col("matched_keys").alias("b"))
    c = counts(spark, d, fx.cand_c).select("qid", F.col("matched_keys").alias("c"))
    return metrics.head_to_head(b.join(c, "qid"), "b", "c")


def _score_sql(v: str) -> str:
    return f"(SELECT qid, count(*) FILTER (WHERE verdict <> 'NA') + count(*) FILTER (WHERE verdict = 'TRUE') AS s FROM {triage_sql(v)} t GROUP BY qid)"


BETTER = f"(SELECT c.qid, c.s AS base_score, b.s AS cand_score, b.s - c.s AS improvement FROM {_score_sql('fx_cand_c')} c JOIN {_score_sql('fx_cand_b')} b ON b.qid = c.qid WHERE b.s > c.s)"


def better(spark, d):
    g = fx.gt(spark, d)
    return metrics.improvement(metrics.match_scores(g, fx.cand_c(spark, d)), metrics.match_scores(g, fx.cand_b(spark, d)))


@query("a17_improvement", f"SELECT * FROM {BETTER} b")
def _(spark, d):
    return better(spark, d)


@query(
    "a17_improvement_summary",
    f"""SELECT count(*) AS cases, sum(base_score)::DOUBLE / count(*) AS avg_base_score, sum(cand_score)::DOUBLE / count(*) AS avg_cand_score, sum(improvement)::DOUBLE / count(*) AS avg_improvement,
        count(*) FILTER (WHERE improvement BETWEEN 1 AND 2) AS band_1_2, count(*) FILTER (WHERE improvement BETWEEN 3 AND 5) AS band_3_5, count(*) FILTER (WHERE improvement >= 6) AS band_6_up FROM {BETTER} b""",
)
def _(spark, d):
    return metrics.improvement_summary(better(spark, d))


@query("a18_count_improvement", f"SELECT qid, gt, b, c, b - c AS improvement FROM {_COUNT3} t WHERE c <= 1 AND b >= 2 AND b - c >= 2")
def _(spark, d):
    return metrics.count_improvement(count3(spark, d), "c", "b")


@query(
    "a18_count_tally",
    f"""SELECT count(*) AS queries, count(*) FILTER (WHERE b > c) AS better, count(*) FILTER (WHERE b < c) AS worse, count(*) FILTER (WHERE b = c) AS equal,
        sum(c)::DOUBLE / count(*) AS avg_base, sum(b)::DOUBLE / count(*) AS avg_cand FROM {_COUNT3} t""",
)
def _(spark, d):
    return metrics.count_tally(count3(spark, d), "c", "b")


@query(
    "a19_grounding",
    """SELECT a.qid, a.pos, contains(lower(q.query), lower(a.value)) OR len(list_filter(string_split(trim(lower(a.value)), ' '), lambda w: w <> '' AND contains(lower(q.query), w))) > 0 AS grounded
       FROM fx_cand_c a JOIN fx_queries q ON q.qid = a.qid""",
)
def _(spark, d):
    return metrics.grounding(fx.cand_c(spark, d), fx.queries(spark, d)).select("qid", "pos", "grounded")


def _same(a: str, b: str, f: str) -> str:
    return f"(lower(trim({a}_{f})) = lower(trim({b}_{f})) AND trim({a}_{f}) <> '')"


_AGREE = {
    "m1_id_match": _same("base", "m1", "id"),
    "m2_id_match": _same("base", "m2", "id"),
    "peers_id_match": _same("m1", "m2", "id"),
    "m1_name_match": _same("base", "m1", "name"),
    "m2_name_match": _same("base", "m2", "name"),
    "all_id_match": f"({_same('base', 'm1', 'id')} AND {_same('base', 'm2', 'id')})",
}


@query("a20_label_agreement", f"SELECT ord, {', '.join(f'{e} AS {n}' for n, e in _AGREE.items())} FROM {ALIGNED} a")
def _(spark, d):
    return labels.label_agreement(aligned(spark, d), "m1", "m2").select("ord", *_AGREE)


@query(
    "a20_agreement_summary",
    " UNION ALL ".join(
        f"SELECT '{n}' AS metric, count(*) FILTER (WHERE {e}) AS n, count(*) FILTER (WHERE {e})::DOUBLE / count(*) AS share FROM {ALIGNED} a" for n, e in _AGREE.items()
    ),
)
def _(spark, d):
    return labels.agreement_summary(labels.label_agreement(aligned(spark, d), "m1", "m2"))


_EXPECT = "CASE qid % 4 WHEN 0 THEN 'must' WHEN 1 THEN 'must_not' WHEN 2 THEN 'restricted' ELSE 'ambiguous' END"


@query(
    "a21_behaviour_matrix",
    f"SELECT {_EXPECT} AS expected, count(*) AS cases, count(*) FILTER (WHERE b > 0) AS b_identified, count(*) FILTER (WHERE c > 0) AS c_identified FROM {_COUNT3} t GROUP BY 1",
)
def _(spark, d):
    k = F.col("qid") % 4
    expected = F.when(k == 0, "must").when(k == 1, "must_not").when(k == 2, "restricted").otherwise("ambiguous")
    return metrics.behaviour_matrix(count3(spark, d).withColumn("expected", expected), "expected", {"b": "b", "c": "c"})


@query(
    "a22_usage_cost",
    f"""SELECT event_id, CAST(input_tokens AS DOUBLE) * {L.INPUT_PRICE} / 1000 + CAST(output_tokens AS DOUBLE) * {L.OUTPUT_PRICE} / 1000 AS cost,
        output_tokens >= {L.OUTPUT_LIMIT * L.NEAR_LIMIT} AS near_limit FROM fx_usage""",
)
def _(spark, d):
    return ledger.usage_cost(fx.usage(spark, d)).select("event_id", "cost", "near_limit")


@query(
    "a23_run_summary",
    """SELECT count(*) AS queries, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed, count(*) FILTER (WHERE success)::DOUBLE / count(*) AS success_rate,
       CAST(sum(CASE WHEN success THEN n_attrs ELSE 0 END) AS BIGINT) AS attributes, sum(CASE WHEN success THEN n_attrs ELSE 0 END)::DOUBLE / count(*) AS avg_attributes FROM fx_res_b""",
)
def _(spark, d):
    return metrics.run_summary(fx.res(spark, d, "b"))


@query("a24_attr_histogram", "SELECT n_attrs AS n_attributes, count(*) AS queries FROM fx_res_b GROUP BY n_attrs")
def _(spark, d):
    return metrics.attr_histogram(fx.res(spark, d, "b"))


@query(
    "a25_vocab_coverage",
    f"""WITH k AS (SELECT qid, {nk('attribute_key')} AS key FROM fx_cand_b), v AS (SELECT DISTINCT {nk('attribute_key')} AS key FROM fx_gt)
        SELECT count(DISTINCT key) AS keys, count(DISTINCT key) FILTER (WHERE key IN (SELECT key FROM v)) AS keys_valid,
          (count(DISTINCT key) FILTER (WHERE key IN (SELECT key FROM v)))::DOUBLE / count(DISTINCT key) AS key_share,
          count(DISTINCT qid) AS examples, (SELECT count(*) FROM (SELECT qid FROM k GROUP BY qid HAVING bool_and(key IN (SELECT key FROM v))) x) AS examples_valid,
          (SELECT count(*) FROM (SELECT qid FROM k GROUP BY qid HAVING bool_and(key IN (SELECT key FROM v))) x)::DOUBLE / count(DISTINCT qid) AS example_share FROM k""",
)
def _(spark, d):
    named = lambda df: df.withColumn("attribute_key", norm_key(F.col("attribute_key")))
    known = named(fx.gt(spark, d)).select(F.col("attribute_key").alias("key"))
    return vocabulary.vocab_coverage(named(fx.cand_b(spark, d)), known)


@query("a25_vocab_frequency", "SELECT key, count(*) AS n FROM fx_vocab GROUP BY key")
def _(spark, d):
    return fx.vocab(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a26_duplicate_content",
    "SELECT sha256, count(*) AS copies, min(path) AS first_name FROM fx_manifest GROUP BY sha256 HAVING count(*) > 1",
)
def _(spark, d):
    return audit.duplicate_content(fx.manifest(spark, d))


@query(
    "a26_duplicate_members",
    "SELECT sha256, path, count(*) OVER (PARTITION BY sha256) AS copies FROM fx_manifest QUALIFY count(*) OVER (PARTITION BY sha256) > 1",
)
def _(spark, d):
    return audit.duplicate_members(fx.manifest(spark, d)).select("sha256", "path", "copies")


@query("a27_manifest_rollup", ROLLUP)
def _(spark, d):
    return audit.manifest_rollup(classed(spark, d))


REQUIRED = ["0_train_log.csv", "1_Summary.md", "7_inference.py", "no_such.txt", "12_Summary.md"]


@query(
    "a28_anchor_check",
    f"SELECT r.file_name, r.file_name IN (SELECT file_name FROM {CLASSED} c) AS found FROM {values([(n,) for n in REQUIRED], 'file_name')} r",
)
def _(spark, d):
    required = small_table(spark, [(n,) for n in REQUIRED], "file_name string")
    return audit.anchor_check(required, classed(spark, d))


@query("a29_classify", f"SELECT path, family, category FROM {CLASSED} c")
def _(spark, d):
    return classed(spark, d).select("path", "family", "category")


@query(
    "a30_structural_quality",
    """SELECT qid, count(DISTINCT value) AS unique_values, count(*) AS total_keys, count(*) FILTER (WHERE key_priority = 1) AS primary_keys,
       bool_and(key_priority IS NOT NULL AND attribute_priority IS NOT NULL) AS has_priorities FROM fx_gt GROUP BY qid""",
)
def _(spark, d):
    return metrics.structural_quality(fx.res(spark, d, "gt"))


@query("a31_priority_distribution", "SELECT attribute_priority, count(DISTINCT qid) AS records FROM fx_gt GROUP BY attribute_priority")
def _(spark, d):
    return metrics.priority_distribution(fx.res(spark, d, "gt"))


@query("a32_label_frequency", "SELECT label_id, count(*) AS n, arg_min(label_name, ord) AS label_name FROM fx_label_m1 GROUP BY label_id")
def _(spark, d):
    return labels.label_frequency(fx.label_source(spark, d, "m1"))


@query(
    "a33_length_profile",
    """SELECT count(*) AS records, min(n_chars) AS min_length, max(n_chars) AS max_length, sum(n_chars)::DOUBLE / count(*) AS avg_length, count(*) FILTER (WHERE n_chars >= 2000) AS at_limit FROM documents""",
)
def _(spark, d):
    return metrics.length_profile(fx.table(spark, d, "documents"), "n_chars", 2000)


@query("a34_duplicate_queries", "SELECT query, count(*) AS n FROM fx_queries GROUP BY query HAVING count(*) > 1")
def _(spark, d):
    return align.duplicate_queries(fx.queries(spark, d))


def _fuzzy_score(name: str) -> str:
    v = f"fx_cand_{name}"
    return f"""SELECT f.qid, '{name}' AS source, count(*) AS gt_attributes, count(*) FILTER (WHERE m.key_matched) AS key_matches, count(*) FILTER (WHERE f.value_matched) AS value_matches,
        count(*) FILTER (WHERE m.key_matched)::DOUBLE / count(*) AS key_share FROM {fuzzy_sql(v)} f JOIN {canonical_match_sql(v)} m ON m.qid = f.qid AND m.pos = f.pos GROUP BY f.qid"""


@query("a35_fuzzy_scorecard", f"{_fuzzy_score('b')} UNION ALL {_fuzzy_score('c')}")
def _(spark, d):
    return metrics.fuzzy_scorecard(
        fx.gt(spark, d), {"b": fx.cand_b(spark, d), "c": fx.cand_c(spark, d)}, vocabulary.synonym_table(spark)
    )


# ----------------------------------------------------------------------------- windows


@query("w1_keep_first", "SELECT query, min(ord) AS ord, arg_min(qid, ord) AS qid FROM fx_queries GROUP BY query")
def _(spark, d):
    return align.keep_first(fx.queries(spark, d), "query", "ord")


@query("w2_keep_last", f"SELECT qid, {nk('attribute_key')} AS norm_key, arg_max(value, pos) AS value FROM fx_cand_c GROUP BY qid, norm_key")
def _(spark, d):
    named = fx.cand_c(spark, d).select("qid", norm_key(F.col("attribute_key")).alias("norm_key"), "value", "pos")
    return align.keep_last(named, ["qid", "norm_key"], "pos").drop("pos")


@query(
    "w3_leaderboard",
    f"""SELECT source, 'value_match' AS ranking, true_rate AS score, CAST(rank() OVER (ORDER BY true_rate DESC) AS INTEGER) AS rank FROM {MICRO} m
        UNION ALL SELECT source, 'volume', avg_attributes, CAST(rank() OVER (ORDER BY avg_attributes DESC) AS INTEGER) FROM {MICRO} m""",
)
def _(spark, d):
    return metrics.leaderboard(micro(spark, d))


_WEIGHTS = values(list(L.IMPORTANCE.items()), "key", "weight")


@query(
    "w4_attr_rank",
    f"""SELECT id, pos, key, CAST(w AS INTEGER) AS weight, CAST(row_number() OVER (PARTITION BY id ORDER BY w DESC, pos) AS INTEGER) AS attribute_priority FROM
        (SELECT a.qid AS id, a.pos, a.attribute_key AS key, coalesce(t.weight, {L.DEFAULT_IMPORTANCE}) + CASE WHEN regexp_matches(a.value, '[0-9]') THEN {L.DIGIT_BONUS} ELSE 0 END AS w
         FROM fx_gt a LEFT JOIN {_WEIGHTS} t ON t.key = a.attribute_key) x""",
)
def _(spark, d):
    parts = fx.gt(spark, d).select(F.col("qid").alias("id"), "pos", F.col("attribute_key").alias("key"), "value")
    return datasets.attr_rank(parts).select("id", "pos", "key", "weight", "attribute_priority")


@query(
    "w5_budget_cutoff",
    """SELECT event_id, CAST(b AS DOUBLE) AS spent_before FROM (SELECT event_id, coalesce(sum(CAST(cost AS DECIMAL(18,6))) OVER (PARTITION BY run_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM fx_usage) t WHERE b < 500""",
)
def _(spark, d):
    out = ledger.budget_cutoff(fx.usage(spark, d), 500)
    return out.select("event_id", F.col("spent_before").cast("double").alias("spent_before"))


@query(
    "w6_progress",
    """SELECT event_id, done, CAST(s AS DOUBLE) / done AS mean_time, CAST(s AS DOUBLE) / done * (total - done) AS eta FROM (SELECT event_id, row_number() OVER w AS done,
       sum(CAST(cost AS DECIMAL(18,6))) OVER w AS s, count(*) OVER (PARTITION BY run_id) AS total FROM fx_usage WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) t""",
)
def _(spark, d):
    return ledger.progress(fx.usage(spark, d), elapsed="cost").select("event_id", "done", "mean_time", "eta")


@query(
    "w7_primary_keys",
    """SELECT qid, lower(trim(value)) AS value_lower, coalesce(arg_max(CASE WHEN key_priority = 1 THEN attribute_key END, CASE WHEN key_priority = 1 THEN pos END),
       arg_min(attribute_key, key_priority * 1000 + pos)) AS primary_key FROM fx_gt GROUP BY qid, value_lower""",
)
def _(spark, d):
    return reshape.primary_keys(reshape.value_groups(fx.gt(spark, d))).select("qid", "value_lower", "primary_key")


CAPPED = "(SELECT key, value, ord, CAST(row_number() OVER (PARTITION BY key ORDER BY ord) AS INTEGER) AS value_rank FROM (SELECT key, value, min(ord) AS ord FROM fx_vocab GROUP BY key, value) t QUALIFY value_rank <= {k})"


@query("w8_cap_values", f"SELECT * FROM {CAPPED.format(k=7)} c")
def _(spark, d):
    return vocabulary.cap_values(fx.vocab(spark, d), 7)


# ------------------------------------------------------------------------------- top-k


@query(
    "k1_top_keys",
    f"SELECT key, gt_freq, cand_freq, match_freq, coalesce(match_freq::DOUBLE / nullif(gt_freq, 0), 0) AS rate FROM {FREQ} f WHERE match_freq > 0 ORDER BY match_freq DESC, key LIMIT 20",
)
def _(spark, d):
    return metrics.top_keys(freq(spark, d), 20)


_TOP3 = "(SELECT key FROM fx_vocab GROUP BY key ORDER BY count(*) DESC, min(ord), key LIMIT 3)"


@query("k2_compress_vocab", f"SELECT key, value, ord, value_rank FROM {CAPPED.format(k=10)} c WHERE key IN {_TOP3}")
def _(spark, d):
    return vocabulary.compress_vocab(fx.vocab(spark, d), 3, 10)


@query(
    "k2_compression_summary",
    f"""SELECT (SELECT count(*) FROM fx_vocab) AS original, count(*) AS kept, count(DISTINCT key) AS keys, ((SELECT count(*) FROM fx_vocab) - count(*))::DOUBLE / (SELECT count(*) FROM fx_vocab) AS reduction
        FROM {CAPPED.format(k=10)} c WHERE key IN {_TOP3}""",
)
def _(spark, d):
    v = fx.vocab(spark, d)
    return vocabulary.compression_summary(v, vocabulary.compress_vocab(v, 3, 10))


_SHOW = f"""WITH c1 AS (SELECT qid, attribute_key, value FROM fx_cand_c WHERE pos = 1),
    s AS (SELECT b.qid, b.gt_keys, b.matched_keys AS strong_keys, c.matched_keys AS weak1_keys, e.matched_keys AS weak2_keys, g.n_attrs,
            b.matched_keys + b.matched_values + c.matched_keys + c.matched_values + e.matched_keys + e.matched_values AS total_score,
            2 * b.matched_keys - c.matched_keys - e.matched_keys AS contrast
          FROM {counts_sql('fx_cand_b')} b JOIN {counts_sql('fx_cand_c')} c ON c.qid = b.qid JOIN {counts_sql('c1')} e ON e.qid = b.qid JOIN fx_res_gt g ON g.qid = b.qid),
    best AS (SELECT * FROM (SELECT * FROM s ORDER BY total_score DESC, qid LIMIT 20) t WHERE n_attrs >= 3 AND weak1_keys >= 2 AND weak2_keys >= 1 ORDER BY total_score DESC, qid LIMIT 5),
    con AS (SELECT *, CASE WHEN n_attrs >= 3 AND strong_keys >= 3 AND weak1_keys <= 1 AND weak2_keys <= 1 THEN 1
              WHEN n_attrs >= 2 AND strong_keys >= 2 AND (weak1_keys <= 1 OR weak2_keys <= 1) THEN 2 END AS tier FROM s)
    SELECT 'best' AS kind, CAST(1 AS INTEGER) AS tier, qid, total_score, contrast FROM best
    UNION ALL SELECT * FROM (SELECT 'contrast', tier, qid, total_score, contrast FROM con WHERE tier IS NOT NULL ORDER BY tier, contrast DESC, qid LIMIT 5) x"""


@query("k3_showcase", _SHOW)
def _(spark, d):
    weak = [fx.cand_c, lambda s, p: fx.cand_c(s, p).filter("pos = 1")]
    scores = topk.showcase_scores_once(fx.gt(spark, d), fx.cand_b(spark, d), [w(spark, d) for w in weak])
    out = topk.showcase(scores, fx.res_counts(spark, d, "gt"))
    return out.select("kind", "tier", "qid", "total_score", "contrast")


_DIGEST = f"""(SELECT c.key, string_agg(c.value, ' | ' ORDER BY c.value_rank) || CASE WHEN max(t.n) > 5 THEN ' ... (+' || CAST(max(t.n) - 5 AS VARCHAR) || ' more)' ELSE '' END AS digest,
    max(t.n) AS total, max(t.o) AS first_ord FROM {CAPPED.format(k=5)} c JOIN (SELECT key, count(DISTINCT value) AS n, min(ord) AS o FROM fx_vocab GROUP BY key) t ON t.key = c.key GROUP BY c.key)"""


@query("k4_vocab_digest", f"SELECT * FROM {_DIGEST} g")
def _(spark, d):
    return vocabulary.vocab_digest(fx.vocab(spark, d), 5)


@query("k5_sample_n", f"SELECT doc_id FROM documents ORDER BY {hx('s1', 'doc_id')}, doc_id LIMIT (SELECT count(*) // 10 FROM documents)")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    return datasets.sample_n(docs, docs.count() // 10, "s1", "doc_id")


# ----------------------------------------------------------------------------- reshape


@query(
    "r1_segments",
    """SELECT qid, CAST(r // 3 AS BIGINT) AS segment, string_agg(attribute_key || '=' || value, '; ' ORDER BY r) AS items
       FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY attribute_priority, key_priority, pos) - 1 AS r FROM fx_gt) t GROUP BY qid, r // 3""",
)
def _(spark, d):
    out = reshape.segments(fx.gt(spark, d), "qid", ["attribute_priority", "key_priority", "pos"], 3, ["attribute_key", "value"])
    text = F.transform("items", lambda e: F.concat(e["attribute_key"], F.lit("="), e["value"]))
    return out.select("qid", "segment", F.array_join(text, "; ").alias("items"))


@query(
    "u1_set_segments",
    f"""SELECT qid, facet, side, CAST(r // 2 AS BIGINT) AS segment, string_agg(term, '; ' ORDER BY term) AS terms FROM
        (SELECT *, row_number() OVER (PARTITION BY qid, facet, side ORDER BY term) - 1 AS r FROM
          (SELECT qid, facet, term, CASE WHEN in_gt AND in_cand THEN 'matched' WHEN in_gt THEN 'gt_only' ELSE 'cand_only' END AS side FROM {terms_sql('fx_cand_b')} f) a) b GROUP BY qid, facet, side, r // 2""",
)
def _(spark, d):
    return compare.set_segments(flags(spark, d), 2).withColumn("terms", F.array_join("terms", "; "))


_HAVE = " UNION ALL ".join(f"SELECT '{s}' AS s, qid, facet, term FROM {terms_sql(v, v)} f{i}" for i, (s, v) in enumerate((("gt", "fx_gt"), ("b", "fx_cand_b"), ("c", "fx_cand_c"))))


@query(
    "u2_source_overlaps",
    f"""WITH h AS ({_HAVE}), p AS (SELECT * FROM {values([("gt", "b"), ("gt", "c"), ("b", "c")], "src", "dst")} v, (SELECT DISTINCT facet FROM h) f),
        x AS (SELECT src, dst, facet, (SELECT count(*) FROM h WHERE s = src AND h.facet = p.facet) AS a, (SELECT count(*) FROM h WHERE s = dst AND h.facet = p.facet) AS b,
          (SELECT count(*) FROM h g JOIN h k ON k.qid = g.qid AND k.facet = g.facet AND k.term = g.term WHERE g.s = src AND k.s = dst AND g.facet = p.facet) AS n FROM p)
        SELECT src, dst, facet, n AS both, a - n AS src_only, b - n AS dst_only FROM x""",
)
def _(spark, d):
    sources = {"gt": fx.gt(spark, d), "b": fx.cand_b(spark, d), "c": fx.cand_c(spark, d)}
    return compare.source_overlaps(compare.mask_counts(compare.source_masks(sources), None), list(sources))


@query(
    "r1_format_groups",
    """SELECT qid, string_agg(t, ' |||| ' ORDER BY attribute_priority) AS formatted FROM (SELECT qid, attribute_priority,
       arg_min(value, key_priority * 1000 + pos) || ' - ' || string_agg(attribute_key, ' | ' ORDER BY key_priority, pos) AS t FROM fx_gt GROUP BY qid, attribute_priority) x GROUP BY qid""",
)
def _(spark, d):
    return reshape.format_groups(fx.gt(spark, d))


def _wide(n: int, view: str) -> str:
    cols = ", ".join(
        f"coalesce(max(CASE WHEN r = {i} THEN attribute_key END), '') AS attr_key_{i}, coalesce(max(CASE WHEN r = {i} THEN value END), '') AS attr_value_{i}" for i in range(1, n + 1)
    )
    return f"SELECT qid, {cols}, CAST(greatest(count(*) - {n}, 0) AS BIGINT) AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY attribute_key, pos) AS r FROM {view}) t GROUP BY qid"


@query("r2_widen", _wide(8, "fx_gt"))
def _(spark, d):
    return reshape.widen(fx.gt(spark, d), 8)


@query(
    "r2_overflow_rows",
    "SELECT qid, r AS place, attribute_key, value FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY attribute_key, pos) AS r FROM fx_gt) t WHERE r > 4",
)
def _(spark, d):
    return reshape.overflow_rows(fx.gt(spark, d), 4)


@query("r3_widen_auto", f"SELECT * EXCLUDE (overflow) FROM ({_wide(7, 'fx_gt')}) w")
def _(spark, d):
    return reshape.widen_auto(fx.gt(spark, d))


@query(
    "r4_value_groups",
    """SELECT qid, lower(trim(value)) AS value_lower, arg_min(trim(value), pos) AS value, arg_min(attribute_priority, pos) AS attribute_priority,
       string_agg(trim(attribute_key) || '/' || CAST(key_priority AS VARCHAR), ',' ORDER BY key_priority, pos) AS keys FROM fx_gt GROUP BY qid, value_lower""",
)
def _(spark, d):
    out = reshape.value_groups(fx.gt(spark, d))
    text = F.array_join(F.transform("keys", lambda e: F.concat(e["key"], F.lit("/"), e["key_priority"].cast("string"))), ",")
    return out.select("qid", "value_lower", "value", "attribute_priority", text.alias("keys"))


@query(
    "r5_tidy_report",
    f"""WITH s AS ({_SCORE}{counts_sql('fx_cand_b')} c), q AS (SELECT count(*) AS queries, count(*) FILTER (WHERE success) AS succeeded FROM fx_res_b)
        SELECT 'match' AS section, metric, n FROM (UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE n) a
        UNION ALL SELECT 'runs', metric, n FROM (UNPIVOT q ON COLUMNS(*) INTO NAME metric VALUE n) b""",
)
def _(spark, d):
    runs = metrics.run_summary(fx.res(spark, d, "b")).select("queries", "succeeded")
    return metrics.tidy_report({"match": metrics.scorecard(counts(spark, d)), "runs": runs})


@query(
    "r6_priority_digest",
    """SELECT qid, string_agg(pk || '=' || v || '(P' || CAST(ap AS VARCHAR) || ')', ' | ' ORDER BY fp) AS digest FROM (SELECT qid, lower(trim(value)) AS vl, arg_min(trim(value), pos) AS v,
       arg_min(attribute_priority, pos) AS ap, min(pos) AS fp, coalesce(arg_max(CASE WHEN key_priority = 1 THEN attribute_key END, CASE WHEN key_priority = 1 THEN pos END),
       arg_min(attribute_key, key_priority * 1000 + pos)) AS pk FROM fx_gt GROUP BY qid, vl) t GROUP BY qid""",
)
def _(spark, d):
    return reshape.priority_digest(reshape.value_groups(fx.gt(spark, d)))
