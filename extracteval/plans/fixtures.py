"""Attribute relations derived from the driver tables.

``SQL`` holds the defining text of each view for a reference engine; the functions build
the same relations with DataFrame expressions. Attribute views have ``qid, pos,
attribute_key, value, key_priority, attribute_priority``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# --------------------------------------------------------------------------- SQL texts

_ATTR = "SELECT p_partkey AS qid, {pos} AS pos, {key} AS attribute_key, {value} AS value, {kp} AS key_priority, {ap} AS attribute_priority FROM part{where}"


def _sql_attrs(rows: list[tuple[int, str, str, int, int, str]]) -> str:
    return " UNION ALL ".join(
        _ATTR.format(pos=p, key=k, value=v, kp=kp, ap=ap, where=f" WHERE {w}" if w else "") for p, k, v, kp, ap, w in rows
    )


_W1, _W2, _SIZE = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)", "CAST(p_size AS VARCHAR)"

SQL = {
    "fx_queries": (
        "SELECT p_partkey AS qid, p_partkey AS ord, p_name || ' ' || lower(p_brand) || ' ' || lower(p_type) || ' size ' || "
        f"{_SIZE} AS query FROM part"
    ),
    "fx_gt": _sql_attrs(
        [
            (1, "'colour'", _W1, 1, 1, ""),
            (2, "'color'", _W1, 2, 1, ""),
            (3, "'product_type'", _W2, 1, 2, ""),
            (4, "'brand'", "p_brand", 1, 3, ""),
            (5, "'make'", "p_brand", 2, 3, ""),
            (6, "'size'", _SIZE, 1, 4, ""),
            (7, "'type'", "p_type", 1, 5, "p_partkey % 4 <> 0"),
        ]
    ),
    "fx_cand_b": _sql_attrs(
        [
            (1, "' Product-Type '", f"upper({_W2})", 1, 1, "p_partkey % 11 <> 0"),
            (2, "CASE WHEN p_partkey % 3 = 0 THEN 'Manufacturer' ELSE 'Brand' END", "p_brand", 1, 2, "p_partkey % 11 <> 0"),
            (3, "'size'", "CAST(p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR)", 1, 4, "p_partkey % 11 <> 0"),
            (4, "'finish'", "lower(p_type)", 1, 3, "p_partkey % 11 <> 0 AND p_partkey % 5 <> 0"),
        ]
    ),
    "fx_cand_c": _sql_attrs(
        [
            (1, "'color'", f"CASE WHEN p_partkey % 9 = 0 THEN 'plain' ELSE {_W1} END", 1, 1, "p_partkey % 13 <> 0"),
            (2, "'size'", f"'size ' || {_SIZE}", 1, 2, "p_partkey % 13 <> 0"),
            (3, "'size'", _SIZE, 1, 2, "p_partkey % 13 <> 0 AND p_partkey % 6 = 0"),
        ]
    ),
    # one row per query and source: did the run succeed, how many attributes
    "fx_res_b": (
        "SELECT q.qid, q.ord, q.query, q.qid % 5 <> 1 AS success, CAST(coalesce(a.n, 0) AS BIGINT) AS n_attrs FROM fx_queries q "
        "LEFT JOIN (SELECT qid, count(*) AS n FROM fx_cand_b GROUP BY qid) a ON a.qid = q.qid WHERE q.qid % 11 <> 0"
    ),
    "fx_res_c": (
        "SELECT q.qid, q.ord, q.query, q.qid % 7 <> 1 AS success, CAST(coalesce(a.n, 0) AS BIGINT) AS n_attrs FROM fx_queries q "
        "LEFT JOIN (SELECT qid, count(*) AS n FROM fx_cand_c GROUP BY qid) a ON a.qid = q.qid WHERE q.qid % 13 <> 0"
    ),
    "fx_res_gt": (
        "SELECT q.qid, q.ord, q.query, q.qid % 17 <> 1 AS success, CAST(a.n AS BIGINT) AS n_attrs FROM fx_queries q "
        "JOIN (SELECT qid, count(*) AS n FROM fx_gt GROUP BY qid) a ON a.qid = q.qid"
    ),
    # encoded outputs of source b
    "fx_isq": (
        "SELECT qid, string_agg(item, ' | ' ORDER BY pos) AS isq_pipe, '[' || string_agg('''' || item || '''', ', ' ORDER BY pos) || ']' AS isq_list "
        "FROM (SELECT qid, pos, lower(value) || ':' || lower(trim(attribute_key)) || ':specification' AS item FROM fx_cand_b) t GROUP BY qid"
    ),
    # vocabulary mined from source b: the keys are uneven on purpose
    "fx_vocab": (
        "SELECT lower(trim(attribute_key)) AS key, lower(value) AS value, qid * 10 + pos AS ord FROM fx_cand_b"
    ),
    # specification-like texts with quantities, units and keywords
    "fx_specs": (
        "SELECT o_orderkey AS qid, CASE o_orderkey % 8 "
        "WHEN 0 THEN 'crompton greaves ' || a || ' hp three phase induction motor ' || b || ' rpm' "
        "WHEN 1 THEN 'Siemens ' || a || '.5 kw 1 phase ' || b || ' volt foot mounted IE3 motor' "
        "WHEN 2 THEN 'bldc brushless fan motor ' || b || 'kv ' || a || ' amp aluminium' "
        "WHEN 3 THEN a || ' kg gear motor ratio ' || a || ':1 dual shaft used' "
        "WHEN 4 THEN 'nema ' || a || ' stepper ' || a || '.8 degree model AB' || b || '-X tefc ip55' "
        "WHEN 5 THEN 'dol%20starter+' || b || 'v ' || a || 'w 4 pole drip  proof vertical' "
        "WHEN 6 THEN 'table fan carbon brush spg copper motor part 3TW' || b || ' sewspg' "
        "ELSE 'sewing motar spare ' || a || ' gm' END AS query "
        "FROM (SELECT o_orderkey, CAST(1 + o_custkey % 30 AS VARCHAR) AS a, CAST(100 * (1 + o_custkey % 29) AS VARCHAR) AS b FROM orders) t"
    ),
    # three label sources over the orders
    "fx_labels": (
        "SELECT o_orderkey AS ord, 'Item ' || CAST(o_orderkey AS VARCHAR) AS keyword, o_orderpriority AS label_ref, "
        "CASE WHEN o_orderkey % 5 = 0 THEN '5-LOW' ELSE o_orderpriority END AS label_m1, "
        "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN '1-URGENT' ELSE lower(o_orderpriority) END AS label_m2 FROM orders"
    ),
    "fx_label_base": "SELECT ord, keyword, split_part(label_ref, '-', 1) AS label_id, label_ref AS label_name FROM fx_labels",
    "fx_label_m1": (
        "SELECT ord, upper(keyword) AS keyword, split_part(label_m1, '-', 1) AS label_id, label_m1 AS label_name FROM fx_labels "
        "UNION ALL SELECT ord + 100000000, ' ' || keyword, '9', 'late' FROM fx_labels WHERE ord % 50 = 0"
    ),
    "fx_label_m2": "SELECT ord, keyword, split_part(label_m2, '-', 1) AS label_id, label_m2 AS label_name FROM fx_labels WHERE ord % 3 <> 0",
    "fx_usage": (
        "SELECT event_id, user_id AS run_id, ts, value AS cost, event_type <> 'error' AS success, event_type, props, "
        "CAST(floor(value * 20) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens FROM events"
    ),
    # named records with a label, several per name
    "fx_items": (
        "SELECT p_partkey AS ord, p_name || ' ' || lower(p_brand) AS name, CAST(p_size AS VARCHAR) AS label_id, p_type AS label, "
        "p_partkey % 3 <> 0 AS in_train FROM part"
    ),
    # a value pool per key for synthesis
    "fx_pools": (
        "SELECT DISTINCT key, value FROM (SELECT 'color' AS key, split_part(p_name, ' ', 1) AS value FROM part "
        "UNION ALL SELECT 'item', split_part(p_name, ' ', 2) FROM part UNION ALL SELECT 'brand', lower(p_brand) FROM part "
        "UNION ALL SELECT 'type', lower(p_type) FROM part UNION ALL SELECT 'size', 'size ' || CAST(p_size AS VARCHAR) FROM part "
        "UNION ALL SELECT 'price', CAST(CAST(floor(p_retailprice / 10) AS BIGINT) AS VARCHAR) || ' usd' FROM part "
        "UNION ALL SELECT 'segment', lower(c_mktsegment) FROM customer) t"
    ),
    # documents as files of a manifest
    "fx_manifest": (
        "SELECT source || '/' || CAST(doc_id AS VARCHAR) || '_' || CASE doc_id % 5 WHEN 0 THEN 'train_log.csv' WHEN 1 THEN 'Summary.md' "
        "WHEN 2 THEN 'inference.py' WHEN 3 THEN 'cache.pyc' ELSE 'notes.dat' END AS path, doc_id, n_chars AS size_bytes, sha256(text) AS sha256 FROM documents"
    ),
}


def with_views(sql: str) -> str:
    """Prefix a query with the views it names, directly or through another view."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in SQL and name not in needed:
                visit(SQL[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in needed)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {views}, {body[14:].strip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {views}, {body[4:].strip()}"
    return f"WITH {views} {body}"


# --------------------------------------------------------------------------- DataFrames


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _words() -> tuple[Column, Column]:
    return F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))


def _attrs(part: DataFrame, rows: list[tuple[int, Column, Column, int, int, Column | None]]) -> DataFrame:
    """All attributes of a part in one pass over it."""
    def entry(pos: int, key: Column, value: Column, kp: int, ap: int, cond: Column | None) -> Column:
        e = F.struct(
            F.lit(pos).alias("pos"),
            key.alias("attribute_key"),
            value.alias("value"),
            F.lit(kp).alias("key_priority"),
            F.lit(ap).alias("attribute_priority"),
        )
        return e if cond is None else F.when(cond, e)

    entries = F.array_compact(F.array(*[entry(*r) for r in rows]))
    return part.select(F.col("p_partkey").alias("qid"), F.explode(entries).alias("_e")).select("qid", "_e.*")


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("qid"),
        F.col("p_partkey").alias("ord"),
        F.concat_ws(" ", "p_name", F.lower("p_brand"), F.lower("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("query"),
    )


def gt(spark: SparkSession, d: str) -> DataFrame:
    w1, w2 = _words()
    size = F.col("p_size").cast("string")
    return _attrs(
        table(spark, d, "part"),
        [
            (1, F.lit("colour"), w1, 1, 1, None),
            (2, F.lit("color"), w1, 2, 1, None),
            (3, F.lit("product_type"), w2, 1, 2, None),
            (4, F.lit("brand"), F.col("p_brand"), 1, 3, None),
            (5, F.lit("make"), F.col("p_brand"), 2, 3, None),
            (6, F.lit("size"), size, 1, 4, None),
            (7, F.lit("type"), F.col("p_type"), 1, 5, F.col("p_partkey") % 4 != 0),
        ],
    )


def cand_b(spark: SparkSession, d: str) -> DataFrame:
    _, w2 = _words()
    k = F.col("p_partkey")
    return _attrs(
        table(spark, d, "part").filter(k % 11 != 0),
        [
            (1, F.lit(" Product-Type "), F.upper(w2), 1, 1, None),
            (2, F.when(k % 3 == 0, "Manufacturer").otherwise("Brand"), F.col("p_brand"), 1, 2, None),
            (3, F.lit("size"), (F.col("p_size") + F.when(k % 7 == 0, 1).otherwise(0)).cast("string"), 1, 4, None),
            (4, F.lit("finish"), F.lower("p_type"), 1, 3, k % 5 != 0),
        ],
    )


def cand_c(spark: SparkSession, d: str) -> DataFrame:
    w1, _ = _words()
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    return _attrs(
        table(spark, d, "part").filter(k % 13 != 0),
        [
            (1, F.lit("color"), F.when(k % 9 == 0, "plain").otherwise(w1), 1, 1, None),
            (2, F.lit("size"), F.concat(F.lit("size "), size), 1, 2, None),
            (3, F.lit("size"), size, 1, 2, k % 6 == 0),
        ],
    )


_RESULTS = {"b": (cand_b, 11, 5), "c": (cand_c, 13, 7), "gt": (gt, None, 17)}


def res(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Nested results of a source: ``qid, ord, query, success, attributes``."""
    from ..operators.reshape import nest

    attrs, gap, fail = _RESULTS[name]
    q = queries(spark, d)
    if gap:
        q = q.filter(F.col("qid") % gap != 0)
    return q.join(nest(attrs(spark, d)), "qid").withColumn("success", F.col("qid") % fail != 1)


def res_counts(spark: SparkSession, d: str, name: str) -> DataFrame:
    return res(spark, d, name).withColumn("n_attrs", F.size("attributes").cast("bigint")).drop("attributes")


def isq(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reshape import nest

    items = F.transform(
        "attributes",
        lambda a: F.concat(F.lower(a["value"]), F.lit(":"), F.lower(F.trim(a["attribute_key"])), F.lit(":specification")),
    )
    return nest(cand_b(spark, d)).select(
        "qid",
        F.array_join(items, " | ").alias("isq_pipe"),
        F.concat(F.lit("["), F.array_join(F.transform(items, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]")).alias("isq_list"),
    )


def vocab(spark: SparkSession, d: str) -> DataFrame:
    return cand_b(spark, d).select(
        F.lower(F.trim("attribute_key")).alias("key"), F.lower("value").alias("value"), (F.col("qid") * 10 + F.col("pos")).alias("ord")
    )


def specs(spark: SparkSession, d: str) -> DataFrame:
    a = (1 + F.col("o_custkey") % 30).cast("string")
    b = (100 * (1 + F.col("o_custkey") % 29)).cast("string")
    texts = [
        ("crompton greaves ", a, " hp three phase induction motor ", b, " rpm"),
        ("Siemens ", a, ".5 kw 1 phase ", b, " volt foot mounted IE3 motor"),
        ("bldc brushless fan motor ", b, "kv ", a, " amp aluminium"),
        (a, " kg gear motor ratio ", a, ":1 dual shaft used"),
        ("nema ", a, " stepper ", a, ".8 degree model AB", b, "-X tefc ip55"),
        ("dol%20starter+", b, "v ", a, "w 4 pole drip  proof vertical"),
        ("table fan carbon brush spg copper motor part 3TW", b, " sewspg"),
        ("sewing motar spare ", a, " gm"),
    ]
    cells = [F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in t]) for t in texts]
    query = cells[-1]
    for i, c in reversed(list(enumerate(cells[:-1]))):
        query = F.when(F.col("o_orderkey") % 8 == i, c).otherwise(query)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.select(F.col("o_orderkey").alias("qid"), query.alias("query"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        k.alias("ord"),
        F.concat(F.lit("Item "), k.cast("string")).alias("keyword"),
        p.alias("label_ref"),
        F.when(k % 5 == 0, "5-LOW").otherwise(p).alias("label_m1"),
        F.when(k % 7 == 0, "").when(k % 4 == 0, "1-URGENT").otherwise(F.lower(p)).alias("label_m2"),
    )


def label_source(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = labels(spark, d)
    if name == "base":
        label, keyword = F.col("label_ref"), F.col("keyword")
    elif name == "m1":
        label, keyword = F.col("label_m1"), F.upper("keyword")
    else:
        df, label, keyword = df.filter("ord % 3 <> 0"), F.col("label_m2"), F.col("keyword")
    out = df.select("ord", keyword.alias("keyword"), F.split_part(label, F.lit("-"), F.lit(1)).alias("label_id"), label.alias("label_name"))
    if name == "m1":
        late = df.filter("ord % 50 = 0").select(
            (F.col("ord") + 100000000).alias("ord"), F.concat(F.lit(" "), "keyword").alias("keyword"), F.lit("9").alias("label_id"), F.lit("late").alias("label_name")
        )
        out = out.unionByName(late)
    return out


def usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.col("user_id").alias("run_id"),
        "ts",
        F.col("value").alias("cost"),
        (F.col("event_type") != "error").alias("success"),
        "event_type",
        "props",
        F.floor(F.col("value") * 20).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("output_tokens"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("ord"),
        F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("name"),
        F.col("p_size").cast("string").alias("label_id"),
        F.col("p_type").alias("label"),
        (F.col("p_partkey") % 3 != 0).alias("in_train"),
    )


def pools(spark: SparkSession, d: str) -> DataFrame:
    w1, w2 = _words()
    cells = {
        "color": w1,
        "item": w2,
        "brand": F.lower("p_brand"),
        "type": F.lower("p_type"),
        "size": F.concat(F.lit("size "), F.col("p_size").cast("string")),
        "price": F.concat(F.floor(F.col("p_retailprice") / 10).cast("bigint").cast("string"), F.lit(" usd")),
    }
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in cells.items()]))
    parts = table(spark, d, "part").select(entries.alias("_e")).select("_e.*")
    segments = table(spark, d, "customer").select(F.lit("segment").alias("key"), F.lower("c_mktsegment").alias("value"))
    return parts.unionByName(segments).distinct()


def manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    name = F.when(k == 0, "train_log.csv").when(k == 1, "Summary.md").when(k == 2, "inference.py").when(k == 3, "cache.pyc").otherwise("notes.dat")
    return table(spark, d, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("_"), name).alias("path"),
        "doc_id",
        F.col("n_chars").alias("size_bytes"),
        F.sha2("text", 256).alias("sha256"),
    )
