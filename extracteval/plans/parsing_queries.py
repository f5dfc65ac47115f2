"""Registered queries: sources and sinks, normalising, parsing, filters."""

from __future__ import annotations

from pyspark.sql import functions as F



from ..functions import lexicon as L
from ..functions import normalize as N
from ..functions import parsing as P
from ..operators import audit, compare, filters, labels, ledger, reshape, vocabulary
from ..session import scratch_path
from ..sources import files, results
from . import fixtures as fx
from .registry import query
from .sqltext import in_list, lit, nk, nks, nv, nvs, values

SYNONYMS = values([(v, c, i) for i, (c, vs) in enumerate(L.KEY_SYNONYMS.items()) for v in vs], "variant", "canonical", "rank")

# ----------------------------------------------------------------------------- sources


@query(
    "s1_read_results",
    """SELECT 'b' AS source, r.query, r.success, a.pos, a.attribute_key, a.value, a.key_priority, a.attribute_priority
       FROM fx_res_b r JOIN fx_cand_b a ON a.qid = r.qid""",
)
def _(spark, d):
    path = scratch_path(spark, "s1")
    out = fx.res(spark, d, "b").select(
        # the byte-order mark some writers put before the first heading
        F.col("query").alias("﻿query"),
        F.when(F.col("success"), "True").otherwise("False").alias("success"),
        F.to_json(F.struct("attributes")).alias("attributes_json"),
    )
    # files of one folder with different headings: another order, one more column, a comma in its name
    odd = F.length("attributes_json") % 2 == 0
    results.write_report(out.filter(odd), f"{path}/x=1", out.columns)
    other = out.filter(~odd).withColumnRenamed("\ufeffquery", "query").withColumn("note, free", F.lit('said "a, b"'))
    results.write_report(other, f"{path}/x=2", ["success", "note, free", "attributes_json", "query"])
    return reshape.unnest(results.read_results(spark, f"{path}/*", "b"), "source", "query", "success")


@query("s2_read_vocab", "SELECT key, value, count(*) AS n FROM fx_vocab GROUP BY key, value")
def _(spark, d):
    path = scratch_path(spark, "s2")
    fx.vocab(spark, d).select("key", "value").write.options(quote='"', escape='"').csv(path)
    return results.read_vocab(spark, path).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s3_read_vocab_text",
    """SELECT DISTINCT key, v AS value FROM (SELECT key, CASE WHEN ord % 7 = 0 THEN 'na' ELSE value || ', x' END AS v FROM fx_vocab) t
       WHERE v <> 'na'""",
)
def _(spark, d):
    path = scratch_path(spark, "s3")
    noisy = F.when(F.col("ord") % 7 == 0, "NA").otherwise(F.concat(F.upper("value"), F.lit(", X")))
    fx.vocab(spark, d).select(F.concat(F.lit("  "), F.upper("key"), F.lit(" , "), noisy)).write.text(path)
    return results.read_vocab_text(spark, path)


@query(
    "s4_read_map_results",
    """SELECT 'b' AS source, r.query, r.success, a.pos, a.attribute_key, a.value, a.key_priority, a.pos AS attribute_priority
       FROM fx_res_b r JOIN fx_cand_b a ON a.qid = r.qid""",
)
def _(spark, d):
    path = scratch_path(spark, "s4")
    pairs = F.transform("attributes", lambda a: F.struct(a["attribute_key"], a["value"]))
    fx.res(spark, d, "b").select("query", "success", F.map_from_entries(pairs).alias("attributes")).write.json(path)
    read = results.read_map_results(spark, path, "b", multi_line=False)
    return reshape.unnest(read, "source", "query", "success")


@query("s5_read_write_pairs", "SELECT query AS instruction, CAST(qid AS VARCHAR) AS output FROM fx_queries")
def _(spark, d):
    path = scratch_path(spark, "s5")
    results.write_pairs(
        fx.queries(spark, d).select(F.col("query").alias("instruction"), F.col("qid").cast("string").alias("output")), path
    )
    return results.read_pairs(spark, path)


@query(
    "s6_read_queries",
    "SELECT 'csv' AS kind, query FROM fx_queries UNION ALL SELECT 'lines', query FROM fx_queries",
)
def _(spark, d):
    csv, lines = scratch_path(spark, "s6"), scratch_path(spark, "s6")
    q = fx.queries(spark, d)
    results.write_report(q.select("qid", F.concat(F.lit(" "), "query").alias("query")), csv, ["qid", "query"])
    heading = q.filter("qid = 0").select(F.lit("query").alias("query"))
    q.select("query").unionByName(heading).write.text(lines)
    return (
        results.read_queries(spark, csv)
        .select(F.lit("csv").alias("kind"), "query")
        .unionByName(results.read_queries(spark, lines).select(F.lit("lines").alias("kind"), "query"))
    )


@query(
    "s7_read_run_log",
    """WITH n AS (
         SELECT run_id, ts, date_trunc('second', ts) AS sec, success,
                row_number() OVER w AS done, count(*) OVER (PARTITION BY run_id) AS total
         FROM fx_usage WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
       p AS (SELECT *, lag(sec) OVER (PARTITION BY run_id ORDER BY done) AS prev, min(sec) OVER (PARTITION BY run_id) AS started FROM n)
       SELECT 'run' || CAST(run_id AS VARCHAR) AS log, CAST(done AS BIGINT) AS batch, CAST(done AS BIGINT) AS done, CAST(total AS BIGINT) AS total,
              CAST(1 AS BIGINT) AS batch_done, CAST(CASE WHEN success THEN 1 ELSE 0 END AS BIGINT) AS batch_success,
              CAST(CASE WHEN success THEN 0 ELSE 1 END AS BIGINT) AS batch_failed,
              CAST(epoch(sec) - epoch(coalesce(prev, started)) AS BIGINT) AS seconds,
              1.0 / nullif(epoch(sec) - epoch(coalesce(prev, started)), 0) AS rows_per_second
       FROM p""",
)
def _(spark, d):
    one = F.lit(1).cast("bigint")
    u = fx.usage(spark, d)
    counted = ledger.running_before(
        u,
        "run_id",
        ["ts", "event_id"],
        {"n": one, "ok": F.when(F.col("success"), one).otherwise(0)},
    ).join(u.groupBy(F.col("run_id").alias("r")).agg(F.count(F.lit(1)).alias("total")), F.col("run_id") == F.col("r"))
    done = F.col("n") + 1
    ok = F.col("ok") + F.when(F.col("success"), 1).otherwise(0)
    line = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] Progress: "), done, F.lit("/"), F.col("total"),
        F.lit(" (1.0%) | Success: "), ok, F.lit(" | Failed: "), done - ok,
    )
    lines = counted.select(F.concat(F.lit("run"), F.col("run_id").cast("string")).alias("log"), line.alias("value"))
    return files.parse_log_lines(lines)


@query("s8_manifest")
def _(spark, d):
    return files.manifest(spark, d, "*.parquet").select("file_name", "size_bytes", "sha256")


@query(
    "s8_manifest_of_texts",
    """WITH f AS (SELECT coalesce(CAST(doc_id // 20 AS VARCHAR), '__HIVE_DEFAULT_PARTITION__') AS part,
                         string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY part)
       SELECT 'part=' || part AS folder, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS sha256 FROM f""",
)
def _(spark, d):
    # a file for every twenty documents, in a folder of its own
    path = scratch_path(spark, "s8")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.expr("doc_id div 20").alias("part"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(path)
    found = files.manifest(spark, path, "*.txt")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "size_bytes", "sha256")


@query(
    "s9_write_report",
    """SELECT qid, count(DISTINCT norm) AS gt_keys FROM (SELECT qid, """ + nk("attribute_key") + """ AS norm FROM fx_gt) t GROUP BY qid""",
)
def _(spark, d):
    path = scratch_path(spark, "s9")
    counts = compare.set_counts(compare.term_flags(fx.gt(spark, d), fx.cand_b(spark, d)))
    results.write_report(counts, path, ["qid", "gt_keys"])
    return spark.read.schema("qid bigint, gt_keys bigint").option("header", "true").csv(path)


@query(
    "s10_showcase_report",
    """SELECT qid, 'gt' AS source, attribute_priority, key_priority, attribute_key AS key, value FROM fx_gt
       UNION ALL SELECT qid, 'b', attribute_priority, key_priority, attribute_key, value FROM fx_cand_b""",
)
def _(spark, d):
    path = scratch_path(spark, "s10")
    rows = reshape.showcase_rows({n: reshape.nest(f(spark, d)) for n, f in (("gt", fx.gt), ("b", fx.cand_b))})
    results.write_showcase(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    sides = F.array(*[F.struct(F.lit(n).alias("source"), F.col(n).alias("attrs")) for n in ("gt", "b")])
    return (
        back.select("qid", F.explode(sides).alias("_s"))
        .select("qid", "_s.source", F.explode("_s.attrs").alias("_a"))
        .select("qid", "source", "_a.*")
    )


FAMILIES = [("first", r"^.*summary"), ("second", r"inference|cache")]
_FAMILY = "CASE WHEN regexp_matches(lower(file_name), '^.*summary') THEN 'first' WHEN regexp_matches(lower(file_name), 'inference|cache') THEN 'second' ELSE 'common' END"
_CATEGORY = (
    "CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(file_name), {lit(w)})" for w in ws) + f" THEN {lit(c)}" for c, ws in L.CATEGORY_WORDS
    )
    + " ELSE 'other' END"
)
CLASSED = f"(SELECT *, {_FAMILY} AS family, {_CATEGORY} AS category FROM (SELECT *, split_part(path, '/', -1) AS file_name FROM fx_manifest) m)"
ROLLUP = f"""SELECT family, category, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM {CLASSED} c GROUP BY ROLLUP (family, category)"""


def classed(spark, d):
    m = fx.manifest(spark, d).withColumn("file_name", audit.file_name(F.col("path")))
    return audit.classify(m, [(f, p) for f, p in FAMILIES])


@query("s11_write_manifest", ROLLUP)
def _(spark, d):
    path = scratch_path(spark, "s11")
    files.write_manifest(classed(spark, d), path)
    return spark.read.schema("family string, category string, files bigint, bytes bigint").parquet(f"{path}/rollup")


# ------------------------------------------------------------------------- normalising

_MESSY_KEY = "'  ' || attribute_key || '__' || value || '-  X  '"


def messy_key():
    return F.concat(F.lit("  "), F.col("attribute_key"), F.lit("__"), F.col("value"), F.lit("-  X  "))


@query("p1_norm_key_strict", f"SELECT qid, pos, {nks(_MESSY_KEY)} AS norm_key FROM fx_cand_b")
def _(spark, d):
    return fx.cand_b(spark, d).select("qid", "pos", N.norm_key(messy_key(), "strict").alias("norm_key"))


@query("p2_norm_key_collapse", f"SELECT qid, pos, {nk(_MESSY_KEY)} AS norm_key FROM fx_cand_b")
def _(spark, d):
    return fx.cand_b(spark, d).select("qid", "pos", N.norm_key(messy_key()).alias("norm_key"))


@query(
    "p3_norm_value",
    f"SELECT doc_id, sha256({nvs('text')}) AS strict, sha256({nv('text')}) AS collapsed FROM documents",
)
def _(spark, d):
    t = F.col("text")
    return fx.table(spark, d, "documents").select(
        "doc_id", F.sha2(N.norm_value(t, "strict"), 256).alias("strict"), F.sha2(N.norm_value(t), 256).alias("collapsed")
    )


_QUOTED = """CASE p_partkey % 7 WHEN 0 THEN '"' || p_name || '"' WHEN 1 THEN ' "'' ' || p_name || ' ''",, ' WHEN 2 THEN '''' || p_name || ',,'
   WHEN 3 THEN '""' || upper(p_name) || '  x''' WHEN 4 THEN p_name || '"' WHEN 5 THEN '"" '' ' || p_name || ' '' ""' ELSE '  ' || p_name || '   y ' END"""


def _peel(x: str) -> str:
    return f"""CASE WHEN length({x}) >= 2 AND ((starts_with({x}, '"') AND ends_with({x}, '"')) OR (starts_with({x}, '''') AND ends_with({x}, '''')))
        THEN trim(substr({x}, 2, length({x}) - 2)) ELSE {x} END"""


@query(
    "p4_norm_value_quoted",
    f"""WITH a AS (SELECT p_partkey, trim({_QUOTED}) AS x FROM part), b AS (SELECT p_partkey, {_peel('x')} AS x FROM a),
        c AS (SELECT p_partkey, {_peel('x')} AS x FROM b), e AS (SELECT p_partkey, {_peel('x')} AS x FROM c), f AS (SELECT p_partkey, {_peel('x')} AS x FROM e)
        SELECT p_partkey, """
    + r"""regexp_replace(lower(trim(regexp_replace(trim(regexp_replace(x, '^["'']+|["'']+$', '', 'g')), ',+$', ''))), '\s+', ' ', 'g') AS value FROM f""",
)
def _(spark, d):
    n = F.col("p_name")
    k = F.col("p_partkey") % 7
    q = (
        F.when(k == 0, F.concat(F.lit('"'), n, F.lit('"')))
        .when(k == 1, F.concat(F.lit(" \"' "), n, F.lit(" '\",, ")))
        .when(k == 2, F.concat(F.lit("'"), n, F.lit(",,")))
        .when(k == 3, F.concat(F.lit('""'), F.upper(n), F.lit("  x'")))
        .when(k == 4, F.concat(n, F.lit('"')))
        .when(k == 5, F.concat(F.lit("\"\" ' "), n, F.lit(" ' \"\"")))
        .otherwise(F.concat(F.lit("  "), n, F.lit("   y ")))
    )
    return fx.table(spark, d, "part").select("p_partkey", N.norm_value(q, "quoted").alias("value"))


@query(
    "p5_norm_key_snake",
    "SELECT p_partkey, translate(trim(lower(' ' || p_name || '/' || p_brand || ' (' || p_type || ') ')), ' /()', '__') AS key FROM part",
)
def _(spark, d):
    raw = F.concat(F.lit(" "), "p_name", F.lit("/"), "p_brand", F.lit(" ("), "p_type", F.lit(") "))
    return fx.table(spark, d, "part").select("p_partkey", N.norm_key(raw, "snake").alias("key"))


def canonical_sql(view: str) -> str:
    form = r"regexp_replace(trim(lower(attribute_key)), '[_\-\s]+', ' ', 'g')"
    return f"""SELECT a.*, coalesce(s.canonical, {form}) AS canonical_key FROM {view} a
        LEFT JOIN (SELECT variant, arg_min(canonical, rank) AS canonical FROM {SYNONYMS} v GROUP BY variant) s ON s.variant = {form}"""


@query(
    "p6_canonical_key",
    f"SELECT qid, pos, canonical_key FROM ({canonical_sql('fx_cand_b')}) x UNION ALL SELECT qid, pos, canonical_key FROM ({canonical_sql('fx_gt')}) y",
)
def _(spark, d):
    both = fx.cand_b(spark, d).unionByName(fx.gt(spark, d))
    return N.canonical_key(both, "attribute_key", vocabulary.synonym_table(spark)).select("qid", "pos", "canonical_key")


@query(
    "p7_clean_query",
    r"SELECT qid, trim(regexp_replace(translate(url_decode(' 9% ' || query), '+', ' '), '\s+', ' ', 'g')) AS query FROM fx_specs",
)
def _(spark, d):
    return fx.specs(spark, d).select("qid", N.clean_query(F.concat(F.lit(" 9% "), "query")).alias("query"))


# ------------------------------------------------------------------------------ parsing


def entries(df, keys, cell):
    return df.select(*keys, F.explode(cell).alias("_e")).select(*keys, "_e.*")


_ISQ_ROWS = "SELECT qid, pos, lower(trim(attribute_key)) AS key, lower(value) AS value FROM fx_cand_b"


@query("p8_parse_isq_list", _ISQ_ROWS + " WHERE qid % 10 <> 0")
def _(spark, d):
    # every tenth cell is not a list literal and must yield nothing
    cell = F.when(F.col("qid") % 10 == 0, F.concat("isq_list", F.lit(" x"))).otherwise(F.col("isq_list"))
    return entries(fx.isq(spark, d), ["qid"], P.parse_isq_list(cell))


@query("p9_parse_isq_lenient", _ISQ_ROWS)
def _(spark, d):
    doubled = F.replace("isq_list", F.lit("'"), F.lit('""'))
    cell = F.when(F.col("qid") % 3 == 0, doubled).when(F.col("qid") % 3 == 1, F.translate("isq_list", "[]", "")).otherwise(F.col("isq_list"))
    return entries(fx.isq(spark, d), ["qid"], P.parse_isq_lenient(cell))


@query(
    "p10_parse_isq_pipe",
    f"""WITH n AS ({_ISQ_ROWS}), s AS (SELECT qid, max(pos) AS m FROM n GROUP BY qid)
        SELECT 'strict' AS mode, qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos) AS INTEGER) AS pos, key, value FROM n
        UNION ALL SELECT 'lenient', qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos) AS INTEGER), key, value FROM
          (SELECT * FROM n UNION ALL SELECT qid, 100, 'Two', 'Bad' FROM s UNION ALL SELECT qid, 101, 'b', 'a' FROM s) t""",
)
def _(spark, d):
    messy = fx.isq(spark, d).withColumn("isq_pipe", F.concat("isq_pipe", F.lit(" | Bad:Two | a:b:c:d |  | :x")))
    return entries(messy.withColumn("mode", F.lit("strict")), ["mode", "qid"], P.parse_isq_pipe(F.col("isq_pipe"))).unionByName(
        entries(messy.withColumn("mode", F.lit("lenient")), ["mode", "qid"], P.parse_isq_pipe(F.col("isq_pipe"), strict=False))
    )


@query(
    "p11_parse_flat_map",
    """SELECT event_id, CAST(1 AS INTEGER) AS pos, 'k' AS key, CASE WHEN event_id % 3 = 0 THEN 'last' ELSE json_extract_string(props, '$.k') END AS value FROM events WHERE event_id % 5 <> 0
       UNION ALL SELECT event_id, CAST(2 AS INTEGER), 'n', '1' FROM events WHERE event_id % 5 <> 0 AND event_id % 3 = 0""",
)
def _(spark, d):
    k = F.col("event_id")
    cell = F.when(k % 5 == 0, F.concat("props", F.lit("}"), F.lit("{"))).when(k % 2 == 0, F.translate("props", '"', "'")).otherwise(F.col("props"))
    # every third cell has a key twice
    again = F.lit(', "n": "1", "k": "last"}')
    cell = F.when(k % 3 == 0, F.concat(F.expr("substring(props, 1, length(props) - 1)"), again)).otherwise(cell)
    cell = F.when(k % 5 == 0, F.substring("props", 2, 100)).otherwise(cell)
    return entries(fx.table(spark, d, "events"), ["event_id"], P.parse_flat_map(cell))


@query(
    "p12_unpivot_attrs",
    """SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY attribute_key, pos) AS INTEGER) AS pos,
              attribute_key, lower(value) AS value FROM fx_gt""",
)
def _(spark, d):
    return P.unpivot_attrs(reshape.widen(fx.gt(spark, d), 9).drop("overflow"), 9)


@query(
    "p13_parse_nested",
    "SELECT qid, pos, attribute_key, value, key_priority, attribute_priority FROM fx_cand_b WHERE qid % 10 <> 0",
)
def _(spark, d):
    cells = fx.res(spark, d, "b").select("qid", F.to_json(F.struct("attributes")).alias("cell"))
    broken = cells.withColumn("cell", F.when(F.col("qid") % 10 == 0, F.substring("cell", 1, 20)).otherwise(F.col("cell")))
    return reshape.unnest(broken.select("qid", P.parse_nested(F.col("cell")).alias("attributes")), "qid")


_RAW = """CASE event_id % 4 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Result: ' || props || ' end'
   WHEN 2 THEN 'two ' || props || ' and ' || props ELSE 'nothing' END"""


@query(
    "p14_rescue_json",
    rf"""SELECT event_id, nullif(trim(regexp_extract(r, '(?s)(\{{.*\}})', 1)), '') AS outermost, nullif(trim(regexp_extract(r, '(?s)(\{{.*?\}})', 1)), '') AS shortest,
         nullif(trim(regexp_extract(r, '(\{{[^}}]+\}})', 1)), '') AS no_inner_brace,
         CASE WHEN event_id % 4 = 0 THEN props ELSE r END AS fenced FROM (SELECT event_id, props, {_RAW} AS r FROM events) t""",
)
def _(spark, d):
    k, p = F.col("event_id") % 4, F.col("props")
    raw = (
        F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("Result: "), p, F.lit(" end")))
        .when(k == 2, F.concat(F.lit("two "), p, F.lit(" and "), p))
        .otherwise("nothing")
    )
    return fx.table(spark, d, "events").select("event_id", *[P.rescue_json(raw, m).alias(m) for m in P.RESCUE_POLICIES])


@query(
    "p15_parse_model_list",
    "SELECT qid, pos, lower(value) || ':' || lower(trim(attribute_key)) || ':specification' AS item FROM fx_cand_b",
)
def _(spark, d):
    loose = F.concat(F.replace("isq_pipe", F.lit(" | "), F.lit("\n")), F.lit(", no colons\n\n"))
    cell = F.when(F.col("qid") % 2 == 0, F.col("isq_list")).otherwise(loose)
    return (
        fx.isq(spark, d)
        .select("qid", F.posexplode(P.parse_model_list(cell)).alias("i", "item"))
        .select("qid", (F.col("i") + 1).alias("pos"), "item")
    )


@query(
    "p16_flatten_api_attrs",
    """SELECT p_partkey, p_brand || ':brand:specification|' || CAST(p_size AS VARCHAR) || ':size:s' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '|' || p_type || ':type:' END AS nested,
              p_brand || ':brand:specification|' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ':-:' ELSE ':type:' END AS simple FROM part""",
)
def _(spark, d):
    top = F.concat(
        F.lit('{"t1":{"attr_value":"'), F.col("p_brand"), F.lit('","attr_name":"brand","attr_type":"specification","others":[{"attr_value":"'),
        F.col("p_size").cast("string"), F.lit('","attr_name":"size","attr_type":"s"},{"attr_value":"'), F.col("p_brand"),
        F.lit('","attr_name":"brand","attr_type":"specification"},{"attr_value":"z","attr_name":"-"}]},"t2":{"attr_value":"'),
        F.col("p_type"), F.lit('","attr_name":"'), F.when(F.col("p_partkey") % 3 == 0, "-").otherwise("type"), F.lit('"}}'),
    )
    return fx.table(spark, d, "part").select(
        "p_partkey",
        F.array_join(P.flatten_api_attrs(top), "|").alias("nested"),
        F.array_join(P.flatten_api_attrs(top, nested=False), "|").alias("simple"),
    )


@query(
    "p17_top_label",
    """SELECT ord, CASE WHEN ord % 6 = 0 THEN '' ELSE label_ref END AS name, CASE WHEN ord % 6 = 0 THEN '' ELSE substr(label_ref, 1, 1) END AS id,
              CASE WHEN ord % 6 = 0 THEN '' ELSE 'A' END AS accuracy FROM fx_labels""",
)
def _(spark, d):
    one = F.concat(F.lit('[{"name":"'), F.col("label_ref"), F.lit('","id":"'), F.substring("label_ref", 1, 1), F.lit('","accuracy":"A"},{"name":"other"}]'))
    cell = F.when(F.col("ord") % 12 == 0, "[]").when(F.col("ord") % 12 == 6, "<html>").otherwise(one)
    return fx.labels(spark, d).select("ord", P.top_label(cell).alias("_l")).select("ord", "_l.*")


@query("p18_invert_template", "SELECT ord, CASE WHEN ord % 6 = 5 THEN '' ELSE name END AS name FROM fx_items")
def _(spark, d):
    templates = F.array(*[F.lit(t) for t in L.INSTRUCTION_TEMPLATES], F.lit("free text about {product_name}"))
    text = F.replace(F.get(templates, (F.col("ord") % 6).cast("int")), F.lit("{product_name}"), F.col("name"))
    return fx.items(spark, d).select("ord", P.invert_template(text).alias("name"))


@query(
    "p19_profile_row",
    """SELECT r.qid, CAST(CASE WHEN r.success THEN a.u ELSE 0 END AS INTEGER) AS unique_value_count,
              CAST(CASE WHEN r.success THEN a.n ELSE 0 END AS INTEGER) AS total_key_count, r.success
       FROM fx_res_b r JOIN (SELECT qid, count(DISTINCT lower(trim(value))) AS u, count(*) AS n FROM fx_cand_b GROUP BY qid) a ON a.qid = r.qid""",
)
def _(spark, d):
    return fx.res(spark, d, "b").select("qid", *P.profile_attrs(F.col("attributes"), F.col("success")))


@query(
    "p20_sort_attrs",
    "SELECT qid, string_agg(lower(trim(attribute_key)) || '=' || lower(value), ';' ORDER BY lower(trim(attribute_key)), pos) AS attrs FROM fx_cand_b GROUP BY qid",
)
def _(spark, d):
    ordered = P.sort_attrs(P.parse_isq_pipe(F.col("isq_pipe")))
    return fx.isq(spark, d).select(
        "qid", F.array_join(F.transform(ordered, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("attrs")
    )


@query("p21_to_isq", "SELECT value || ':' || key || ':specification' AS isq, min(ord) AS ord FROM fx_vocab GROUP BY value, key")
def _(spark, d):
    return reshape.to_isq(fx.vocab(spark, d))


@query("p22_fix_backslashes", "SELECT page_id, url FROM pages")
def _(spark, d):
    return fx.table(spark, d, "pages").select("page_id", N.fix_backslashes(F.translate("url", "/", "\\")).alias("url"))


_FLAGS = ", ".join(f"regexp_matches(query, {lit('(?i)' + p)}) AS {n}" for n, p in P.FACET_WORDS.items())
FEATURES = rf"""SELECT qid, length(query) AS query_length, CAST(len(string_split_regex(trim(query), '\s+')) AS BIGINT) AS word_count, {_FLAGS}"""


@query("p23_query_features", f"{FEATURES} FROM fx_specs")
def _(spark, d):
    return P.query_features(fx.specs(spark, d)).drop("query")


# ------------------------------------------------------------------------------ filters


@query(
    "f1_hard_queries",
    f"""SELECT qid, word_count FROM ({FEATURES}, n_attrs, success FROM (SELECT qid, query || ' for industrial use' AS query, n_attrs, success FROM fx_res_c) r) t
        WHERE word_count >= 5 AND query_length >= 40 AND n_attrs <= 2 AND success""",
)
def _(spark, d):
    base = fx.res_counts(spark, d, "c").withColumn("query", F.concat("query", F.lit(" for industrial use")))
    return filters.hard_queries(P.query_features(base)).select("qid", "word_count")


@query(
    "f2_multi_facet",
    f"""SELECT qid FROM ({FEATURES} FROM fx_queries) t WHERE word_count >= 4 AND
        ((has_color AND has_location) OR (has_color AND has_size) OR (has_color AND has_material) OR (has_size AND has_location))""",
)
def _(spark, d):
    return filters.multi_facet(P.query_features(fx.queries(spark, d))).select("qid")


_HYG_KEY = "CASE p_partkey % 4 WHEN 0 THEN 'power' WHEN 1 THEN 'color' WHEN 2 THEN 'power_source' ELSE 'size' END"
_HYG_VALUE = """CASE p_partkey % 11 WHEN 0 THEN 'AC' WHEN 1 THEN ' N/A ' WHEN 2 THEN 'as per ' || p_name WHEN 3 THEN 'Copper' WHEN 4 THEN '415 v dc'
   WHEN 5 THEN '5 hp' WHEN 6 THEN p_name || p_name || p_name || p_name WHEN 7 THEN 'buyer requirement' WHEN 8 THEN '' WHEN 9 THEN 'STD' ELSE p_name END"""


@query(
    "f3_clean_values",
    f"""SELECT qid, key, value FROM (SELECT p_partkey AS qid, {_HYG_KEY} AS key, {_HYG_VALUE} AS value FROM part) t
        WHERE lower(trim(value)) NOT IN {in_list(L.NOISE_VALUES)}
          AND NOT ({' OR '.join(f"contains(lower(trim(value)), {lit(p)})" for p in L.NOISE_PARTS)})
          AND length(value) BETWEEN 1 AND 40
          AND NOT (key = 'power' AND value IN {in_list(L.NOT_POWER)})
          AND NOT (key = 'color' AND (upper(value) IN {in_list(L.NOT_COLOR)} OR contains(lower(value), 'requirement')))
          AND NOT (key = 'power_source' AND regexp_matches(value, '^[0-9]') AND NOT contains(lower(value), 'dc') AND NOT contains(lower(value), 'ac'))""",
)
def _(spark, d):
    k, m, n = F.col("p_partkey") % 4, F.col("p_partkey") % 11, F.col("p_name")
    key = F.when(k == 0, "power").when(k == 1, "color").when(k == 2, "power_source").otherwise("size")
    value = (
        F.when(m == 0, "AC").when(m == 1, " N/A ").when(m == 2, F.concat(F.lit("as per "), n)).when(m == 3, "Copper").when(m == 4, "415 v dc")
        .when(m == 5, "5 hp").when(m == 6, F.concat(n, n, n, n)).when(m == 7, "buyer requirement").when(m == 8, "").when(m == 9, "STD").otherwise(n)
    )
    return vocabulary.clean_values(fx.table(spark, d, "part").select(F.col("p_partkey").alias("qid"), key.alias("key"), value.alias("value")))


@query(
    "f4_valid_labelled",
    """SELECT ord, trim(name) AS name, CAST(label_id AS BIGINT) AS label_id, label FROM fx_items
       WHERE ord % 10 <> 0 AND ord % 9 <> 0 ORDER BY ord LIMIT (SELECT count(*) // 4 FROM fx_items)""",
)
def _(spark, d):
    messy = fx.items(spark, d).select(
        "ord",
        F.concat(F.lit(" "), "name").alias("name"),
        F.when(F.col("ord") % 9 == 0, "x1").otherwise(F.col("label_id")).alias("label_id"),
        F.when(F.col("ord") % 10 == 0, " ").otherwise(F.col("label")).alias("label"),
    )
    return labels.valid_labelled(messy, messy.count() // 4)


@query(
    "f5_exclude_paths",
    "SELECT path FROM fx_manifest WHERE NOT path LIKE 'src3/%' AND NOT path LIKE '%.pyc' AND NOT path LIKE '%/1%.md'",
)
def _(spark, d):
    return audit.exclude_paths(
        fx.manifest(spark, d), dirs=["src3"], suffixes=[".PYC".lower()], globs=["1*.md"], names=[".env"]
    ).select("path")


@query("f6_only_success", "SELECT qid, n_attrs FROM fx_res_b WHERE success")
def _(spark, d):
    return filters.only_success(fx.res_counts(spark, d, "b")).select("qid", "n_attrs")


