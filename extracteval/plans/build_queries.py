"""Registered queries: tagging, dataset construction, incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions.parsing import parse_nested
from ..functions.tables import small_table
from ..operators import compare, datasets, ledger, tagging, vocabulary
from ..operators.reshape import nest
from ..session import scratch_path
from ..streaming import ledger as stream
from . import fixtures as fx
from .compare_queries import _DIGEST, counts_sql, flags
from .registry import query
from .sqltext import h32, hx, in_list, lit, values

_CLEAN = r"lower(trim(regexp_replace(translate(url_decode(query), '+', ' '), '\s+', ' ', 'g')))"


def dict_sql(facets) -> str:
    return values([(f, n, c, i) for f, words in facets.items() for i, (n, c) in enumerate(words.items())], "facet", "name", "canonical", "rank")


# ---------------------------------------------------------------------------- dictionaries

_PART_NAMES = """(SELECT 'brand' AS facet, lower(p_brand) AS name, p_brand AS canonical, CAST(min(p_partkey) AS INTEGER) AS rank FROM part GROUP BY p_brand
    UNION ALL SELECT 'type', lower(p_type), p_type, CAST(min(p_partkey) AS INTEGER) FROM part GROUP BY p_type
    UNION ALL SELECT 'start', substr(p_name, 1, 4), upper(substr(p_name, 1, 4)), CAST(min(p_partkey) AS INTEGER) FROM part GROUP BY substr(p_name, 1, 4))"""


def part_names(spark, d):
    """A dictionary mined from the parts."""
    p = fx.table(spark, d, "part")
    cells = {
        "brand": (F.lower("p_brand"), F.col("p_brand")),
        "type": (F.lower("p_type"), F.col("p_type")),
        "start": (F.substring("p_name", 1, 4), F.upper(F.substring("p_name", 1, 4))),
    }
    entry = F.explode(
        F.array(*[F.struct(F.lit(f).alias("facet"), n.alias("name"), c.alias("canonical")) for f, (n, c) in cells.items()])
    )
    return (
        p.select("p_partkey", entry.alias("_e"))
        .groupBy("_e.facet", "_e.name", "_e.canonical")
        .agg(F.min("p_partkey").cast("int").alias("rank"))
    )


def _boundary(x: str) -> str:
    return rf"contains(' ' || regexp_replace({x}, '[-/\s]', ' ', 'g') || ' ', ' ' || name || ' ')"


@query(
    "x1_tag_dictionary",
    rf"""WITH t AS (SELECT qid, lower(trim(query)) AS raw, trim(regexp_replace(regexp_replace(lower(trim(query)), '[^\p{{L}}\p{{M}}\p{{N}}\s&.]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM fx_queries),
        h AS (SELECT qid, facet, canonical, length(name) AS n, rank, CASE WHEN {_boundary('raw')} OR {_boundary('plain')} THEN 2 WHEN starts_with(raw, name) OR starts_with(plain, name) THEN 1 END AS tier FROM t, {_PART_NAMES} v)
        SELECT qid, facet, arg_max(canonical, tier * 10000000000 + n * 100000000 - rank) AS value, CAST(1 AS INTEGER) AS ord FROM h WHERE tier IS NOT NULL GROUP BY qid, facet""",
)
def _(spark, d):
    return tagging.tag_dictionary(fx.queries(spark, d), part_names(spark, d), "boundary")


_LENIENT_BRAND = rf"""WITH h AS (SELECT t.qid, v.name, v.canonical, v.rank, t.q FROM (SELECT qid, {_CLEAN} AS q FROM fx_specs) t, {dict_sql({'brand': L.BRANDS})} v WHERE contains(t.q, v.name)),
        k AS (SELECT *, CASE WHEN regexp_matches(q, '(^|[\s,])' || regexp_escape(name) || '([\s,]|$|''s)') THEN true WHEN length(name) < 3 THEN false
              WHEN name = 'spg' THEN regexp_matches(q, '\b' || regexp_escape(name) || '\b') ELSE true END AS ok FROM h)
        SELECT qid, 'brand' AS facet, arg_max(canonical, length(name) * 1000 - rank) AS value, CAST(1 AS INTEGER) AS ord FROM k WHERE ok GROUP BY qid"""


@query("x2_tag_dictionary_lenient", _LENIENT_BRAND)
def _(spark, d):
    return tagging.tag_dictionary(fx.specs(spark, d), tagging.dictionary(spark, L.BRANDS), "lenient")


def _ex(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(q, {lit(pattern)}, {group}), '')"


def _union(parts: dict[str, str], source: str) -> str:
    body = " UNION ALL ".join(f"SELECT qid, '{f}' AS facet, {e} AS value FROM t" for f, e in parts.items())
    return f"WITH t AS ({source}) SELECT * FROM ({body}) u WHERE value IS NOT NULL AND value <> ''"


_WATTS = f"CASE WHEN {_ex(L.ANY_KW)} IS NULL AND (NOT contains(q, 'v') OR NOT contains(split_part(q, 'v', 1), {_ex(L.WATT)})) THEN {_ex(L.WATT)} END"
_QUANT = {
    "power": f"coalesce({_ex(L.HORSEPOWER)} || ' HP', {_ex(L.KILOWATT)} || ' KW', {_WATTS} || ' W')",
    "power_kw": f"CASE WHEN {_ex(L.HORSEPOWER)} IS NOT NULL THEN {_ex(L.KILOWATT)} || ' KW' END",
    "weight": f"{_ex(L.WEIGHT)} || CASE WHEN contains(regexp_extract(q, {lit(L.WEIGHT + '.{0,3}')}, 0), 'kg') THEN ' kg' ELSE ' gm' END",
    "kv_rating": f"CASE WHEN NOT contains(q, 'kw') THEN {_ex(L.KV_RATING)} || ' KV' END",
    "ip_rating": f"upper({_ex(L.IP_RATING)})",
    "efficiency": f"upper({_ex(L.EFFICIENCY_CLASS)})",
    **{f: f"{lit(a)} || {_ex(p)} || {lit(b)}" for f, (p, a, b) in L.QUANTITIES.items()},
}


@query("x3_tag_quantities", _union(_QUANT, f"SELECT qid, {_CLEAN} AS q FROM fx_specs"))
def _(spark, d):
    return tagging.tag_quantities(fx.specs(spark, d)).drop("ord")


# the reference engine has no look-ahead: the watt pattern names what may follow instead
_WATT_SQL = r"(\d+\.?\d*)\s*(?:w|watt)(?:\s*[^k\s]|\s*$)"
_LOW = "SELECT qid, lower(query) AS q FROM fx_specs"


def _all_sql() -> str:
    def every(p: str, suffix: str) -> str:
        return f"list_transform(regexp_extract_all(q, {lit(p)}, 1), lambda v: v || '{suffix}')"

    volts = " UNION ALL ".join(f"SELECT qid, 'voltage' AS facet, unnest({every(p, 'v')}) AS value FROM t" for p in L.ALL_VOLTS)
    return f"""SELECT qid, 'power_unit' AS facet, CASE WHEN regexp_matches(q, {lit(L.HORSEPOWER_WORD)}) AND NOT regexp_matches(q, {lit(L.HORSEPOWER_NUMBER)}) THEN 'horse power' END AS value FROM t
        UNION ALL SELECT qid, 'power_hp', {_ex(L.FIRST_HP)} || ' hp' FROM t UNION ALL SELECT qid, 'power_kw', {_ex(L.FIRST_KW)} || ' kw' FROM t
        UNION ALL SELECT qid, 'power_w', coalesce({_ex(_WATT_SQL)}, {_ex(L.FIRST_WATT[1])}) || ' w' FROM t
        UNION ALL SELECT DISTINCT * FROM ({volts}) v UNION ALL SELECT DISTINCT * FROM (SELECT qid, 'speed' AS facet, unnest({every(L.ALL_SPEEDS, ' rpm')}) AS value FROM t) s"""


@query("x4_tag_all_quantities", f"WITH t AS ({_LOW}) SELECT * FROM ({_all_sql()}) u WHERE value IS NOT NULL")
def _(spark, d):
    return tagging.tag_all_quantities(fx.specs(spark, d)).drop("ord")


def _case(rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(q, {lit(p)}) THEN {lit(v)}" for p, v in rules) + " END"


@query("x5_tag_first_of", _union({f: _case(r) for f, r in L.FIRST_OF.items()}, _LOW))
def _(spark, d):
    return tagging.tag_first_of(fx.specs(spark, d)).drop("ord")


@query("x5_tag_first_of_single", _union({f: _case(r) for f, r in L.FIRST_OF_SINGLE.items()}, _LOW))
def _(spark, d):
    return tagging.tag_first_of(fx.specs(spark, d), L.FIRST_OF_SINGLE).drop("ord")


_KEYWORDS = f"""(SELECT qid, facet, arg_max(canonical, length(name) * 1000 - rank) AS value FROM (SELECT qid, {_CLEAN} AS q FROM fx_specs) t, {dict_sql(L.KEYWORD_FACETS)} v
    WHERE contains(q, name) GROUP BY qid, facet)"""


@query(
    "x6_tag_keyword_facets",
    f"SELECT qid, facet, value FROM {_KEYWORDS} k WHERE NOT (facet = 'product_type' AND qid IN (SELECT qid FROM {_KEYWORDS} m WHERE facet = 'motor_type'))",
)
def _(spark, d):
    return tagging.tag_keyword_facets(fx.specs(spark, d), tagging.facet_dictionary(spark)).drop("ord")


def _contains_any(words) -> str:
    return "(" + " OR ".join(f"contains(q, {lit(w)})" for w in words) + ")"


_MULTI = [("application", v, i, _contains_any(ws)) for i, (v, ws) in enumerate(L.APPLICATIONS.items())]
_MULTI += [(f, v, i, f"regexp_matches(q, {lit(p)})") for f, t in (("material", L.MATERIALS), ("product_category", L.CATEGORIES)) for i, (v, p) in enumerate(t.items())]


@query(
    "x7_tag_multi",
    f"WITH t AS ({_LOW}) " + " UNION ALL ".join(f"SELECT qid, '{f}' AS facet, {lit(v)} AS value FROM t WHERE {c}" for f, v, _, c in _MULTI),
)
def _(spark, d):
    return tagging.tag_multi(fx.specs(spark, d)).drop("ord")


@query(
    "x7_tag_multi_dictionary",
    f"SELECT DISTINCT qid, facet, canonical AS value FROM (SELECT qid, lower(query) AS q FROM fx_specs) t, {values([('application', w, a) for a, ws in L.APPLICATIONS.items() for w in ws], 'facet', 'name', 'canonical')} v WHERE contains(q, name)",
)
def _(spark, d):
    names = tagging.dictionary(spark, [(w, a) for a, ws in L.APPLICATIONS.items() for w in ws], "application")
    return tagging.tag_multi_dictionary(fx.specs(spark, d), names).drop("ord")


_MOTOR = f"""(SELECT qid, 'motor_type' AS facet, value, ord FROM (SELECT qid, unnest(CASE WHEN len(f) > 0 THEN f WHEN regexp_matches(q, {lit(L.ANY_MOTOR)}) THEN [{{'o': 0, 'v': 'motor'}}] ELSE f END, recursive := true) FROM
    (SELECT qid, q, list_filter([{', '.join(f"{{'o': {i}, 'v': CASE WHEN {_contains_any(ws)} THEN {lit(v)} END}}" for i, (v, ws) in enumerate(L.MOTOR_TYPES.items()))}], lambda e: e.v IS NOT NULL) AS f
     FROM (SELECT qid, """ + r"""trim(regexp_replace(regexp_replace(lower(query), '[^\p{L}\p{M}\p{N}\s.&]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM fx_specs) a) b) c (qid, ord, value))"""


@query("x7_tag_motor_types", f"SELECT qid, facet, value FROM {_MOTOR} m")
def _(spark, d):
    return tagging.tag_motor_types(fx.specs(spark, d)).drop("ord")


_EVERY_MODEL = "list_concat(" * (len(L.MODEL_PATTERNS) - 1) + f"regexp_extract_all(query, {lit(L.MODEL_PATTERNS[0])}, 1)" + "".join(
    f", regexp_extract_all(query, {lit(p)}, 1))" for p in L.MODEL_PATTERNS[1:]
)
_MODEL_SQL = f"list_filter({_EVERY_MODEL}, lambda m: length(m) >= {L.MODEL_MIN_LENGTH} AND NOT regexp_matches(m, {lit(L.NOT_A_MODEL)}))[1]"


@query(
    "x8_tag_model",
    f"""SELECT 'patterns' AS mode, qid, v AS value FROM (SELECT qid, {_MODEL_SQL} AS v FROM fx_specs) t WHERE v IS NOT NULL
        UNION ALL SELECT 'code', qid, upper(v) FROM (SELECT qid, coalesce({_ex(L.MODEL_SCHEME)}, CASE WHEN length({_ex(L.MODEL_CODE)}) >= {L.MODEL_CODE_MIN_LENGTH} THEN {_ex(L.MODEL_CODE)} END) AS v
          FROM (SELECT qid, {_CLEAN} AS q FROM fx_specs) a) b WHERE v IS NOT NULL""",
)
def _(spark, d):
    s = fx.specs(spark, d)
    parts = [tagging.tag_model(s, m).select(F.lit(m).alias("mode"), "qid", "value") for m in ("patterns", "code")]
    return parts[0].unionByName(parts[1])


_TAGS = f"""(WITH t AS ({_LOW}) SELECT qid, facet, value, 1 AS ord FROM ({_all_sql()}) u WHERE value IS NOT NULL UNION ALL SELECT qid, facet, value, ord FROM {_MOTOR} m
    UNION ALL {' UNION ALL '.join(f"SELECT qid, '{f}', {_case(r)}, 1 FROM t WHERE {_case(r)} IS NOT NULL" for f, r in L.FIRST_OF.items())}
    UNION ALL {' UNION ALL '.join(f"SELECT qid, '{f}', {lit(v)}, {i} FROM t WHERE {c}" for f, v, i, c in _MULTI)})"""
# the reference reads decoded texts, has a model number, and a category only without a motor type
_TAGS = f"""(SELECT * FROM ({_TAGS} UNION ALL SELECT qid, 'model_number', v, 1 FROM (SELECT qid, {_MODEL_SQL} AS v FROM fx_specs) m WHERE v IS NOT NULL) a
    WHERE NOT (facet = 'product_category' AND qid IN (SELECT qid FROM {_MOTOR} n)))""".replace("fx_specs", "(SELECT qid, url_decode(query) AS query FROM fx_specs)")
# brand between blanks, hyphens, slashes or edges, or else at the start; frame size and KV rating
_EDGED = r"regexp_matches({x}, '(^|[\s/-])' || regexp_escape(name) || '($|[\s/-])')"
_BRAND = f"""(SELECT qid, arg_max(lower(canonical), tier * 1000000 + length(name) * 1000 - rank) AS value FROM (
    SELECT *, CASE WHEN {_EDGED.format(x="raw")} OR {_EDGED.format(x="plain")} THEN 2 WHEN starts_with(raw, name) OR starts_with(plain, name) THEN 1 END AS tier FROM
    (SELECT qid, lower(trim(query)) AS raw, trim(regexp_replace(regexp_replace(lower(query), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s.&]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM fx_specs) q, {dict_sql({'brand': L.REFERENCE_BRANDS})} v
    WHERE contains(raw, name) OR contains(plain, name)) h WHERE tier IS NOT NULL GROUP BY qid)"""
_TAGS = f"""(SELECT * FROM {_TAGS} r0 UNION ALL SELECT qid, 'brand', value, 1 FROM {_BRAND} r1
    UNION ALL SELECT qid, 'frame_size', v, 1 FROM (SELECT qid, coalesce({_ex(L.FRAME_SIZE).replace('(q,', '(query,')}, {_ex(L.FRAME_NUMBER)}) AS v FROM (SELECT qid, query, lower(query) AS q FROM fx_specs) s0) r2 WHERE v IS NOT NULL
    UNION ALL SELECT qid, 'kv_rating', {_ex(L.KV_RATING)} || ' kv', 1 FROM (SELECT qid, lower(query) AS q FROM fx_specs) r3 WHERE {_ex(L.KV_RATING)} IS NOT NULL)""".replace("FROM fx_specs", "FROM (SELECT qid, url_decode(query) AS query FROM fx_specs) d")
_FACETS = values([(f, i, n, k) for i, (f, ks) in enumerate(L.FACET_KEYS.items()) for n, k in enumerate(ks, 1)], "facet", "facet_ord", "key_priority", "attribute_key")


@query(
    "x9_assemble",
    f"""WITH r AS (SELECT qid, facet, value, CAST(row_number() OVER (PARTITION BY qid ORDER BY facet_ord, ord, value) AS INTEGER) AS attribute_priority FROM {_TAGS} t
          JOIN (SELECT DISTINCT facet, facet_ord FROM {_FACETS} f) o USING (facet))
        SELECT qid, attribute_key, value, key_priority, attribute_priority FROM r JOIN {_FACETS} k USING (facet)""",
)
def _(spark, d):
    return tagging.assemble_reference(fx.specs(spark, d))


_CODE_SQL = f"""SELECT qid, upper(v) AS value FROM (SELECT qid, coalesce({_ex(L.MODEL_SCHEME)}, CASE WHEN length({_ex(L.MODEL_CODE)}) >= {L.MODEL_CODE_MIN_LENGTH} THEN {_ex(L.MODEL_CODE)} END) AS v
    FROM (SELECT qid, {_CLEAN} AS q FROM fx_specs) a) b WHERE v IS NOT NULL"""
_SINGLE = f"""(SELECT qid, facet, value FROM ({_LENIENT_BRAND}) s0 UNION ALL SELECT qid, facet, value FROM ({_union(_QUANT, f"SELECT qid, {_CLEAN} AS q FROM fx_specs")}) s1
    UNION ALL SELECT qid, facet, value FROM {_KEYWORDS} s2 WHERE NOT (facet = 'product_type' AND qid IN (SELECT qid FROM {_KEYWORDS} m WHERE facet = 'motor_type'))
    UNION ALL SELECT qid, facet, value FROM ({_union({f: _case(r) for f, r in L.FIRST_OF_SINGLE.items()}, f"SELECT qid, {_CLEAN} AS q FROM fx_specs")}) s3
    UNION ALL SELECT qid, 'model_number', value FROM ({_CODE_SQL}) s4)"""
_SINGLE = f"""(SELECT * FROM {_SINGLE} r0 UNION ALL SELECT qid, 'product_type', {_case(L.LAST_RESORT)} FROM (SELECT qid, {_CLEAN} AS q FROM fx_specs) f
    WHERE {_case(L.LAST_RESORT)} IS NOT NULL AND qid NOT IN (SELECT qid FROM {_SINGLE} r1))"""


@query(
    "x9_query_attributes",
    f"""SELECT s.qid, coalesce(string_agg(facet || '=' || value, '; ' ORDER BY facet), '') AS attributes FROM fx_specs s LEFT JOIN {_SINGLE} r ON r.qid = s.qid GROUP BY s.qid""",
)
def _(spark, d):
    text = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return tagging.query_attributes(fx.specs(spark, d)).select("qid", F.array_join(text, "; ").alias("attributes"))


@query(
    "x10_fallback_category",
    f"""WITH t AS ({_LOW}), f AS (SELECT qid, {_CLEAN} AS q FROM fx_specs WHERE qid NOT IN (SELECT qid FROM ({_union({f: _case(r) for f, r in L.FIRST_OF.items()}, _LOW)}) u))
        SELECT qid, 'product_type' AS facet, {_case(L.LAST_RESORT)} AS value FROM f WHERE {_case(L.LAST_RESORT)} IS NOT NULL""",
)
def _(spark, d):
    s = fx.specs(spark, d)
    return tagging.fallback_category(s, tagging.tag_first_of(s)).drop("ord")


_PRIO = [("brand", 1), ("manufacturer", 2), ("product-type", 3), ("size", 4), ("finish", 5)]


@query(
    "x11_tag_vocab",
    f"""WITH RECURSIVE n AS (SELECT key, value, min(ord) AS ord FROM fx_vocab WHERE length(value) > 1 GROUP BY key, value),
        h AS (SELECT q.qid, n.key, n.value, n.ord, CAST(p.rank AS INTEGER) AS key_rank FROM fx_queries q, n JOIN {values(_PRIO, 'key', 'rank')} p ON p.key = n.key WHERE contains(lower(q.query), lower(trim(n.value)))),
        s AS (SELECT qid, list({{'key_rank': key_rank, 'key': key, 'ord': ord, 'value': value}} ORDER BY key_rank, key, ord, value) AS l FROM h GROUP BY qid),
        f AS (SELECT qid, l, 1 AS i, [] :: VARCHAR[] AS keys, [] :: VARCHAR[] AS vals, false AS took FROM s UNION ALL
          SELECT qid, l, i + 1, CASE WHEN t THEN list_append(keys, l[i].key) ELSE keys END, CASE WHEN t THEN list_append(vals, l[i].value) ELSE vals END, t
          FROM (SELECT *, NOT (list_contains(keys, l[i].key) OR list_contains(vals, l[i].value)) AS t FROM f WHERE i <= len(l)) g)
        SELECT qid, l[i - 1].key AS key, l[i - 1].key_rank AS key_rank, l[i - 1].value AS value FROM f WHERE took""",
)
def _(spark, d):
    prio = small_table(spark, _PRIO, "key string, rank int")
    return tagging.tag_vocab(fx.queries(spark, d), fx.vocab(spark, d), prio)


def _supplement_sql(alternatives) -> str:
    cases = [f"nullif(regexp_extract(q, {lit(p)}, 0), '')" if v is None else f"CASE WHEN regexp_matches(q, {lit(p)}) THEN {lit(v)} END" for p, v in alternatives]
    return f"coalesce({', '.join(cases)})"


_VOCAB = [("motor power", 1), ("type", 2), ("phase", 3)]
_VOCAB_VALUES = [("motor power", "5 hp", 1), ("motor power", "3 hp", 2), ("type", "gear motor", 3), ("type", "stepper", 4), ("phase", "1 phase", 5)]


@query(
    "x11_tag_vocab_supplements",
    f"""WITH t AS (SELECT qid, lower(query) AS q FROM fx_specs),
        h AS (SELECT qid, v.key, v.value, p.rank, row_number() OVER (PARTITION BY qid, v.key ORDER BY v.ord) AS r FROM t JOIN {values(_VOCAB_VALUES, 'key', 'value', 'ord')} v ON contains(q, v.value) JOIN {values(_VOCAB, 'key', 'rank')} p ON p.key = v.key)
        SELECT qid, key, CAST(rank AS INTEGER) AS key_rank, value FROM h WHERE r = 1
        """
    + "".join(
        f" UNION ALL SELECT qid, {lit(k)}, NULL, {_supplement_sql(a)} FROM t WHERE {_supplement_sql(a)} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.qid = t.qid AND h.key IN ({', '.join(map(lit, u))}))"
        for k, u, a in L.VOCAB_SUPPLEMENTS
    ),
)
def _(spark, d):
    vocab = small_table(spark, _VOCAB_VALUES, "key string, value string, ord int")
    prio = small_table(spark, _VOCAB, "key string, rank int")
    return tagging.tag_vocab(fx.specs(spark, d), vocab, prio, supplements=tagging.vocab_supplements())


@query(
    "x12_apply_predictor",
    r"""SELECT qid, regexp_matches(query, '[a-z]+\s+[0-9]+') AS success, nullif(regexp_extract(query, '([a-z]+)\s+([0-9]+)', 1), '') AS attribute_key,
        nullif(regexp_extract(query, '([a-z]+)\s+([0-9]+)', 2), '') AS value FROM fx_specs""",
)
def _(spark, d):
    out = tagging.apply_predictor(fx.specs(spark, d))
    first = F.get(parse_nested(F.col("raw_output")), F.lit(0))
    return out.select("qid", "success", first["attribute_key"].alias("attribute_key"), first["value"].alias("value"))


@query(
    "x13_build_prompts",
    f"""SELECT qid, md5({lit(vocabulary.PROMPT_HEAD)} || (SELECT string_agg({lit(vocabulary.PROMPT_BULLET)} || key || ': ' || digest || chr(10), '' ORDER BY first_ord) FROM {_DIGEST} g)
        || chr(10) || 'Query: "' || query || '"' || chr(10) || 'Output: ') AS prompt FROM fx_queries""",
)
def _(spark, d):
    out = vocabulary.build_prompts(fx.queries(spark, d), vocabulary.vocab_digest(fx.vocab(spark, d), 5))
    return out.select("qid", F.md5("prompt").alias("prompt"))


# -------------------------------------------------------------------------- dataset building

_CLUSTERS = [("product-type", "item"), ("brand", "brand"), ("manufacturer", "brand"), ("size", "power_source")]


@query(
    "t1_value_pools",
    f"""SELECT DISTINCT c.cluster AS key, v.value FROM fx_vocab v JOIN {values(_CLUSTERS, 'key', 'cluster')} c ON c.key = v.key
        WHERE lower(trim(v.value)) NOT IN {in_list(L.NOISE_VALUES)} AND length(v.value) BETWEEN 1 AND 40 AND NOT (c.cluster = 'power_source' AND regexp_matches(v.value, '^[0-9]'))""",
)
def _(spark, d):
    return vocabulary.value_pools(fx.vocab(spark, d), small_table(spark, _CLUSTERS, "key string, cluster string"))


_POOLS = "(SELECT key, value FROM fx_pools)"


def synth_sql(seed: str, n: str, fewest: int, most: int, keys: int = 7, prime: int = 7, pool: str = "") -> str:
    """Drawn parts (id, pos, key, value) over the pools: seven keys, one per table column they come from."""
    pool = pool or seed
    return f"""(SELECT d.id, CAST(d.pos AS INTEGER) AS pos, k.key, v.value FROM
        (SELECT id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS key_no FROM (SELECT id, list_filter(list_transform(range(0, m + {prime - keys}), lambda j: (s + j * p) % {prime}), lambda x: x < {keys})[1:m] AS l FROM
          (SELECT id, least({fewest} + {h32(seed + ':m', 'id')} % {most - fewest + 1}, {keys}) AS m, {h32(seed + ':start', 'id')} % {prime} AS s, {h32(seed + ':step', 'id')} % {prime - 1} + 1 AS p
           FROM (SELECT unnest(range(0, {n})) AS id) i) a) b) d
        JOIN (SELECT key, n, row_number() OVER (ORDER BY {hx(pool + ':keys', 'key')}, key) - 1 AS key_no FROM (SELECT key, count(*) AS n FROM {_POOLS} p GROUP BY key) c) k ON k.key_no = d.key_no
        JOIN (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY {hx(pool + ':pool', 'value')}, value) AS value_no FROM {_POOLS} p) v
          ON v.key = k.key AND v.value_no = {h32(seed + ':value', 'd.id', 'k.key')} % k.n + 1)"""


_N_PART = "(SELECT count(*) FROM part)"


def synthetic(spark, d, seed, low, high):
    # the number of records follows the size of the input
    return datasets.synthesize(fx.pools(spark, d), fx.table(spark, d, "part").count(), low, high, seed)


@query("t2_synthesize", f"SELECT * FROM {synth_sql('t2', _N_PART, 1, 5)} s")
def _(spark, d):
    return synthetic(spark, d, "t2", 1, 5)


def records_sql(parts: str, seed: str) -> str:
    shuffled = f"{h32(seed + ':shuffle', 'id', 'key')}"
    return f"(SELECT id, list({{'key': key, 'value': value}} ORDER BY pos) AS attributes, string_agg(value, ' ' ORDER BY {shuffled}, key) AS query FROM {parts} s GROUP BY id)"


@query(
    "t2_records",
    f"SELECT id, query, array_to_string(list_transform(attributes, lambda e: e.key || '=' || e.value), ';') AS attributes FROM {records_sql(synth_sql('t2', _N_PART, 3, 6), 't2')} r",
)
def _(spark, d):
    recs = datasets.records(synthetic(spark, d, "t2", 3, 6), "t2")
    text = F.array_join(F.transform("attributes", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return recs.select("id", "query", text.alias("attributes"))


def product_sql(seed: str) -> str:
    return f"{in_list(L.PRODUCTS).replace('(', '[', 1)[:-1]}][{h32(seed + ':product', 'id')} % {len(L.PRODUCTS)} + 1]"


def _some(low: int, high: int, tag: str) -> str:
    return f"attributes[1:{low} + {h32('t3:' + tag, 'id')} % (greatest(least({high}, len(attributes)), {low}) - {low} + 1)]"


def _phrase(items: str, sep: str) -> str:
    return f"array_to_string(list_transform({items}, lambda e: translate(e.key, '_', ' ') || '{sep}' || e.value), ', ')"


_PREFIX = f"{in_list(L.DETAIL_PREFIXES).replace('(', '[', 1)[:-1]}][{h32('t3:prefix', 'id')} % {len(L.DETAIL_PREFIXES)} + 1]"
_KEEP = "CAST('0x' || substr(md5('t3:keep|' || CAST(id AS VARCHAR) || '|' || e.key), 1, 8) AS BIGINT) % 10 >= 3"
_OTHERS = f"array_to_string(list_transform(list_filter(attributes, lambda e: e.key <> 'brand' AND {_KEEP})[1:2 + {h32('t3:detail', 'id')} % 4], lambda e: e.value), ', ')"
_RENDER = f"""CASE style WHEN 'natural' THEN 'looking for ' || product || ' with ' || {_phrase(_some(2, 4, 'natural'), ' ')}
    WHEN 'specification' THEN product || ', ' || {_phrase(_some(3, 6, 'spec'), ': ')}
    WHEN 'detailed' THEN concat_ws(' ', nullif({_PREFIX}, ''), list_filter(attributes, lambda e: e.key = 'brand')[1].value, product, nullif({_OTHERS}, ''))
    ELSE product || ' ' || array_to_string(list_transform({_some(1, 3, 'brief')}, lambda e: e.value), ' ') END"""


@query(
    "t3_render_query",
    f"""SELECT id, style, {_RENDER} AS query FROM (SELECT id, attributes, {product_sql('t3')} AS product, ['natural', 'specification', 'detailed', 'brief'][{h32('t3:style', 'id')} % 4 + 1] AS style
        FROM {records_sql(synth_sql('t3', _N_PART, 3, 6), 't3')} r) x""",
)
def _(spark, d):
    recs = datasets.with_product(datasets.records(synthetic(spark, d, "t3", 3, 6), "t3"), L.PRODUCTS, "t3")
    return datasets.render_query(recs, "t3").select("id", "style", "query")


_SYN = [("brand", "brand", 1), ("brand", "manufacturer", 2), ("brand", "company", 3), ("color", "color", 1), ("color", "colour", 2)]


@query(
    "t4_fan_out",
    f"""SELECT a.qid AS id, coalesce(s.attribute_key, a.attribute_key) AS attribute_key, a.value, CAST(coalesce(s.key_priority, 1) AS INTEGER) AS key_priority, a.attribute_priority
        FROM fx_gt a LEFT JOIN {values(_SYN, 'key', 'attribute_key', 'key_priority')} s ON s.key = a.attribute_key WHERE a.key_priority = 1""",
)
def _(spark, d):
    ranked = fx.gt(spark, d).filter("key_priority = 1").select(
        F.col("qid").alias("id"), F.col("attribute_key").alias("key"), "value", "attribute_priority"
    )
    return datasets.fan_out(ranked, small_table(spark, _SYN, "key string, attribute_key string, key_priority int"))


@query(
    "t5_dedupe_records",
    """SELECT min(qid) AS id, query FROM (SELECT q.qid, q.query FROM fx_queries q JOIN (SELECT qid FROM fx_gt GROUP BY qid HAVING count(*) >= 7) g ON g.qid = q.qid) t
       GROUP BY query""",
)
def _(spark, d):
    recs = fx.queries(spark, d).join(nest(fx.gt(spark, d)), "qid").select(F.col("qid").alias("id"), "query", "attributes")
    return datasets.dedupe_records(recs, 7).select("id", "query")


@query(
    "t6_split_random",
    f"""SELECT doc_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM
        (SELECT doc_id, row_number() OVER (ORDER BY {hx('t6', 'doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents) t""",
)
def _(spark, d):
    return datasets.split_random(fx.table(spark, d, "documents").select("doc_id"), "doc_id", "t6")


@query(
    "t7_split_stratified",
    f"""SELECT ord, label_ref, CASE WHEN r <= CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.1, 0)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM
        (SELECT ord, label_ref, row_number() OVER (PARTITION BY label_ref ORDER BY {hx('t7', 'ord')}, ord) AS r, count(*) OVER (PARTITION BY label_ref) AS n FROM fx_labels) t""",
)
def _(spark, d):
    return datasets.split_stratified(fx.labels(spark, d).select("ord", "label_ref"), "label_ref", "ord", "t7")


def proportional_sql(seed: str, n: str) -> str:
    return f"""WITH p AS (SELECT *, lower(trim(name)) AS nm FROM fx_items), tr AS (SELECT DISTINCT nm FROM p WHERE in_train),
        un AS (SELECT nm, arg_min(name, ord) AS name, arg_min(label, ord) AS label, min(ord) AS ord FROM p WHERE nm NOT IN (SELECT nm FROM tr) GROUP BY nm),
        fr AS (SELECT label, count(*) AS f FROM p WHERE nm IN (SELECT nm FROM tr) GROUP BY label),
        a AS (SELECT u.label, greatest(1, CAST(round_even(coalesce(f, 1) * {n} / (SELECT sum(f) FROM fr)::DOUBLE, 0) AS BIGINT)) AS a FROM (SELECT DISTINCT label FROM un) u LEFT JOIN fr ON fr.label = u.label),
        b AS (SELECT label, greatest(1, CAST(round_even(a * ({n}::DOUBLE / (SELECT sum(a) FROM a)), 0) AS BIGINT)) AS a FROM a),
        r AS (SELECT un.*, CASE WHEN row_number() OVER (PARTITION BY un.label ORDER BY {hx(seed + ':label', 'nm')}, nm) <= b.a THEN 0 ELSE 1 END AS tier FROM un JOIN b ON b.label = un.label)
        SELECT name, label, ord FROM (SELECT *, row_number() OVER (ORDER BY tier, {hx(seed + ':fill', 'nm')}, nm) AS place FROM r) x WHERE place <= {n}"""


def proportional(spark, d, n, seed):
    items = fx.items(spark, d)
    out = datasets.proportional_sample(items, items.filter("in_train"), n, "name", "label", "ord", seed)
    return out.select("name", "label", "ord")


@query("t8_proportional_sample", proportional_sql("t8", f"({_N_PART} // 20)"))
def _(spark, d):
    return proportional(spark, d, fx.table(spark, d, "part").count() // 20, "t8")


@query("t8_proportional_sample_topped_up", proportional_sql("t8b", f"({_N_PART} * 3 // 40)"))
def _(spark, d):
    return proportional(spark, d, fx.table(spark, d, "part").count() * 3 // 40, "t8b")


_ROT = " ".join(f"WHEN {i} THEN replace({lit(t)}, '{{product_name}}', name)" for i, t in enumerate(L.INSTRUCTION_TEMPLATES))


@query(
    "t9_render_instruction",
    f"""SELECT ord, CAST(no AS INTEGER) AS template_no, md5(CASE no {_ROT} END) AS instruction FROM
        (SELECT ord, name, (row_number() OVER (ORDER BY {hx('t9', 'ord')}, ord) - 1) % {len(L.INSTRUCTION_TEMPLATES)} AS no FROM fx_items) t""",
)
def _(spark, d):
    out = datasets.render_instruction(fx.items(spark, d), "ord", "t9", "name")
    return out.select("ord", "template_no", F.md5("instruction").alias("instruction"))


def _json_sql(order: str) -> str:
    return f"""'{{' || string_agg('"' || k || '": "' || CASE WHEN qid % 3 = 0 AND k = 'size' THEN 'zz "x"' ELSE v END || '"', ', ' ORDER BY {order}) || '}}'"""


_DISTILL = f"""(SELECT qid, replace({_json_sql('pos')}, 'zz "x"', 'zz \\"x\\"') AS output, replace({_json_sql('k')}, 'zz "x"', 'zz \\"x\\"') AS output_sorted
    FROM (SELECT qid, pos, lower(trim(attribute_key)) AS k, lower(value) AS v FROM fx_cand_b) t GROUP BY qid)"""


def _pairs(spark, d, sort):
    messy = fx.isq(spark, d).join(fx.queries(spark, d), "qid")
    extra = F.when(F.col("qid") % 3 == 0, ' | ZZ "x":size:specification').otherwise("")
    return datasets.distill_pairs(messy.withColumn("isq_pipe", F.concat("isq_pipe", extra)), sort=sort)


@query(
    "t10_distill_pairs",
    f"SELECT q.qid, {lit(L.INSTRUCTION)} || q.query AS instruction, p.output, p.output_sorted FROM fx_queries q JOIN {_DISTILL} p ON p.qid = q.qid",
)
def _(spark, d):
    by_key = _pairs(spark, d, True).select("qid", F.col("output").alias("output_sorted"))
    return _pairs(spark, d, False).select("qid", "instruction", "output").join(by_key, "qid")


@query(
    "t11_chat_format",
    """SELECT a.conv_id, a.turn, md5('<bos><start_of_turn>user' || chr(10) || a.text || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || b.text || '<end_of_turn><eos>') AS text
       FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""",
)
def _(spark, d):
    turns = fx.table(spark, d, "conversations")
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return datasets.chat_format(user.join(reply, ["conv_id", "turn"])).select("conv_id", "turn", F.md5("text").alias("text"))


_TASKS = list(L.TASK_RATIOS)


@query(
    "t12_mix_tasks",
    " UNION ALL ".join(
        f"SELECT '{t}' AS task, qid FROM (SELECT qid, row_number() OVER (ORDER BY {hx('t12:' + t, 'qid')}, qid) AS r FROM fx_queries WHERE qid % 3 = {i}) t{i} WHERE r <= floor(({_N_PART} * 9 // 20) * {L.TASK_RATIOS[t]})"
        for i, t in enumerate(_TASKS)
    ),
)
def _(spark, d):
    q = fx.queries(spark, d)
    tasks = {t: q.filter(F.col("qid") % 3 == i).select("qid") for i, t in enumerate(_TASKS)}
    return datasets.mix_tasks(tasks, L.TASK_RATIOS, q.count() * 9 // 20, "qid", "t12")


_SUFFIXES = [
    "twin screw extruder machine automatic", "stainless steel plastic extractor 440 v", "gold refining industrial voltage 3 phase",
    "blown film extrusion electrical capacity 50 kg/hr",
]
_TYPO_TEXT = f"p_name || ' ' || {in_list(_SUFFIXES).replace('(', '[', 1)[:-1]}][p_partkey % 4 + 1]"


def typo_sql(seed: str, key: str, source: str) -> str:
    """``(key, text, noisy)`` of a source with a key and a text."""
    right = in_list([r for _, r in L.TYPO_PAIRS]).replace("(", "[", 1)[:-1] + "]"
    wrong = in_list([w for w, _ in L.TYPO_PAIRS]).replace("(", "[", 1)[:-1] + "]"
    out = f"SELECT {key}, text AS x, text, 1 + {h32(seed + ':n', key)} % 3 AS n FROM {source}"
    for i in range(3):
        no = f"({h32(f'{seed}:pair{i}', key)} % {len(L.TYPO_PAIRS)} + 1)"
        out = f"""SELECT {key}, CASE WHEN {i} < n AND instr(x, r) > 0 THEN substr(x, 1, instr(x, r) - 1) || w || substr(x, instr(x, r) + length(r)) ELSE x END AS x, text, n
            FROM (SELECT *, {right}[{no}] AS r, {wrong}[{no}] AS w FROM ({out}) s{i}) u{i}"""
    at = f"CAST({h32(seed + ':join', key)} % greatest(len(ws) - 1, 1) AS INTEGER)"
    joined = "array_to_string(list_concat(list_concat(ws[1:jp], [ws[jp + 1] || ws[jp + 2]]), list_slice(ws, jp + 3, len(ws))), ' ')"
    return f"""SELECT {key}, text, CASE WHEN {h32(seed + ':coin', key)} % 2 = 0 AND len(ws) > 2 THEN {joined} ELSE x END AS noisy FROM
        (SELECT *, {at} AS jp FROM (SELECT *, string_split(x, ' ') AS ws FROM ({out}) z) y) v"""


@query("t13_inject_typos", typo_sql("t13", "p_partkey", f"(SELECT p_partkey, {_TYPO_TEXT} AS text FROM part) p"))
def _(spark, d):
    suffix = F.get(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("p_partkey") % 4).cast("int"))
    texts = fx.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", suffix).alias("text"))
    return datasets.inject_typos(texts, "text", "p_partkey", "t13")


_TERMS = list(L.TRANSLATIONS)


@query(
    "t14_translate_terms",
    f"""WITH t AS (SELECT p_partkey AS id, unnest([1, 2, 3]) AS pos, unnest([{in_list(_TERMS).replace('(', '[', 1)[:-1]}][p_partkey % {len(_TERMS)} + 1], p_name, {in_list(_TERMS).replace('(', '[', 1)[:-1]}][p_size % {len(_TERMS)} + 1]]) AS term FROM part),
        j AS (SELECT id, string_agg(t.term, ' ' ORDER BY pos) AS h, string_agg(coalesce(x.translation, t.term), ' ' ORDER BY pos) AS f FROM t LEFT JOIN {values(list(L.TRANSLATIONS.items()), 'term', 'translation')} x ON x.term = t.term GROUP BY id)
        SELECT id, 'forward' AS direction, h AS source, f AS target FROM j UNION ALL SELECT id, 'backward', f, h FROM j""",
)
def _(spark, d):
    known = F.array(*[F.lit(t) for t in _TERMS])
    pick = lambda c: F.get(known, (F.col(c) % len(_TERMS)).cast("int"))
    phrases = fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.array(pick("p_partkey"), F.col("p_name"), pick("p_size")).alias("terms")
    )
    return datasets.translate_terms(phrases, datasets.translation_table(spark))


def _tier_sql(tier: str) -> str:
    n, low, high = L.TIERS[tier]
    s = f"t15:{tier}"
    size = f"CAST({n} * {_N_PART} // 1000 AS BIGINT)"
    return f"""SELECT '{tier}' AS tier, i.id, concat_ws(' ', {product_sql(s).replace('CAST(id', 'CAST(i.id')}, r.query) AS query,
        'product=' || {product_sql(s).replace('CAST(id', 'CAST(i.id')} || coalesce(';' || array_to_string(list_transform(r.attributes, lambda e: e.key || '=' || e.value), ';'), '') AS attributes
        FROM (SELECT unnest(range(0, {size})) AS id) i LEFT JOIN {records_sql(synth_sql(s, size, max(low - 1, 0), high - 1, pool='t15'), s)} r ON r.id = i.id"""


@query("t15_tiered_benchmark", " UNION ALL ".join(_tier_sql(t) for t in L.TIERS))
def _(spark, d):
    n = fx.table(spark, d, "part").count()
    tiers = {t: (size * n // 1000, low, high) for t, (size, low, high) in L.TIERS.items()}
    out = datasets.tiered_benchmark(fx.pools(spark, d), "t15", tiers)
    text = F.array_join(F.transform("attributes", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("tier", "id", "query", text.alias("attributes"))


# -------------------------------------------------------------------------- incremental work


@query("i1_pending", "SELECT event_id, run_id FROM fx_usage WHERE event_id % 3 <> 0")
def _(spark, d):
    u = fx.usage(spark, d)
    return ledger.pending(u, u.filter("event_id % 3 = 0"), "event_id").select("event_id", "run_id")


_LEDGER = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("run_id", T.LongType()), T.StructField("success", T.BooleanType())]
)


@query("i2_append_ledger", "SELECT event_id, run_id, success FROM fx_usage")
def _(spark, d):
    path, checkpoint = scratch_path(spark, "i2-ledger"), scratch_path(spark, "i2-checkpoint")
    schema = fx.table(spark, d, "events").schema

    def process(batch):
        return batch.select("event_id", F.col("user_id").alias("run_id"), (F.col("event_type") != "error").alias("success"))

    def run(where):
        stream.run_available(spark, d, schema, path, where, "event_id", _LEDGER, process, "events.parquet")

    run(checkpoint)
    # resumed with its checkpoint there is nothing to take; without it the ledger stops repeats
    run(checkpoint)
    return stream.read_ledger(spark, path, _LEDGER).drop("batch_id")


@query("i3_stage", f"SELECT qid, matched_keys FROM {counts_sql('fx_cand_b')} c")
def _(spark, d):
    path = scratch_path(spark, "i3")
    first = ledger.stage(spark, path, lambda: compare.set_counts(flags(spark, d)).select("qid", "matched_keys"))
    again = ledger.stage(spark, path, lambda: first.limit(0))
    return again

