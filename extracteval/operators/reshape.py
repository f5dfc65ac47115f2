"""Between the long attribute relation, nested results, wide columns and report text.

Arrays here hold the attributes of one result, which the data model already keeps in one
cell; rows are only regrouped, never gathered across results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import running_before



def nest(attrs: DataFrame, on: str = "qid") -> DataFrame:
    """Long to nested: one row per query with its attributes in position order."""
    entry = F.struct("pos", "attribute_key", "value", "key_priority", "attribute_priority")
    return attrs.groupBy(on).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)),
            lambda e: F.struct(
                e["attribute_key"].alias("attribute_key"),
                e["value"].alias("value"),
                e["key_priority"].alias("key_priority"),
                e["attribute_priority"].alias("attribute_priority"),
            ),
        ).alias("attributes")
    )


def unnest(results: DataFrame, *keep: str) -> DataFrame:
    """Nested to long, with positions from 1."""
    return results.select(*keep, F.posexplode("attributes").alias("_i", "_a")).select(
        *keep, (F.col("_i") + 1).alias("pos"), "_a.*"
    )


def format_groups(attrs: DataFrame, on: str = "qid") -> DataFrame:
    """``value - key | synonym |||| value2 - key``: groups in attribute-priority order,
    synonyms in key-priority order, the value being that of the group's first entry."""
    entry = F.struct("key_priority", "pos", "attribute_key", "value")
    groups = (
        attrs.fillna(1, ["key_priority", "attribute_priority"])
        .fillna("", ["attribute_key", "value"])
        .groupBy(on, "attribute_priority")
        .agg(F.array_sort(F.collect_list(entry)).alias("_e"))
        .select(
            on,
            F.struct(
                "attribute_priority",
                F.concat(
                    F.get("_e", F.lit(0))["value"],
                    F.lit(" - "),
                    F.array_join(F.transform("_e", lambda e: e["attribute_key"]), " | "),
                ).alias("text"),
            ).alias("_g"),
        )
    )
    return groups.groupBy(on).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_g")), lambda g: g["text"]), " |||| ").alias("formatted")
    )


def widen(attrs: DataFrame, n: int = 9, on: str = "qid") -> DataFrame:
    """Long to wide: attributes sorted by key into ``attr_key_i``/``attr_value_i``, padded
    with '' up to ``n``; ``overflow`` says how many did not fit.

    Only the first ``n`` attributes of a query are placed, and Spark applies that limit
    before the shuffle; the others are counted by a plain aggregation. Nothing is gathered
    into a list, so a query with any number of attributes is fine."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(on).orderBy("attribute_key", "pos"))
    placed = attrs.select(on, "attribute_key", "value", "pos").withColumn("_i", place).filter(F.col("_i") <= n)
    sizes = attrs.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    none = F.lit(None)
    both = placed.select(on, "_i", "attribute_key", "value", none.cast("bigint").alias("_n")).unionByName(
        sizes.select(
            on, none.cast("int").alias("_i"), none.cast("string").alias("attribute_key"), none.cast("string").alias("value"), "_n"
        )
    )
    cols = []
    for i in range(1, n + 1):
        here = F.col("_i") == i
        cols += [
            F.coalesce(F.max(F.when(here, F.col("attribute_key"))), F.lit("")).alias(f"attr_key_{i}"),
            F.coalesce(F.max(F.when(here, F.col("value"))), F.lit("")).alias(f"attr_value_{i}"),
        ]
    return both.groupBy(on).agg(*cols, F.greatest(F.max("_n") - n, F.lit(0)).cast("bigint").alias("overflow"))


def overflow_rows(attrs: DataFrame, n: int, on: str = "qid") -> DataFrame:
    """The attributes that :func:`widen` to ``n`` pairs has no place for, one row each with their
    ``place`` (from ``n + 1``), so that both together hold every attribute. Places are a prefix scan:
    a query with very many attributes is numbered by many tasks."""
    placed = running_before(attrs, on, ["attribute_key", "pos"], {"_before": F.lit(1).cast("bigint")})
    return placed.filter(F.col("_before") >= n).select(on, (F.col("_before") + 1).alias("place"), "attribute_key", "value")


def segments(rows: DataFrame, by: str, order: list[str], size: int, columns: list[str]) -> DataFrame:
    """Arrays of bounded length in place of one array per group: the rows of a group in ``order``, cut
    into runs of ``size``; ``by, segment`` (from 0) and ``items``, structs of ``columns``. No row and no
    task holds more than its runs, however large a group is. A null group is a group of its own."""
    placed = running_before(rows, by, order, {"_before": F.lit(1).cast("bigint")})
    runs = placed.groupBy(by, F.floor(F.col("_before") / size).alias("segment"))
    listed = runs.agg(F.array_sort(F.collect_list(F.struct("_before", F.struct(*columns).alias("item")))).alias("_i"))
    return listed.select(by, "segment", F.transform("_i", lambda e: e["item"]).alias("items"))


WIDEST = 2000


def widen_auto(attrs: DataFrame, on: str = "qid", widest: int = WIDEST) -> DataFrame:
    """:func:`widen` to the largest attribute count in the data. Column names must be known
    to plan the result, so this runs one aggregation and fetches a single number. A query with more
    than ``widest`` attributes is an error: widen to a fixed width and add :func:`overflow_rows`."""
    sizes = attrs.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    width = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    if width > widest:
        raise ValueError(f"a query has {width} attributes, more than {widest} pairs of columns")
    return widen(attrs, int(width), on).drop("overflow")


def value_groups(attrs: DataFrame, on: str = "qid") -> DataFrame:
    """One row per distinct (case-insensitive, trimmed) value of a query: first spelling,
    first attribute priority and all its keys with their priorities."""
    text = F.trim(F.coalesce(F.col("value"), F.lit("")))
    return (
        attrs.withColumn("value_lower", F.lower(text))
        .withColumn("value", text)
        .groupBy(on, "value_lower")
        .agg(
            F.min_by("value", "pos").alias("value"),
            F.min_by("attribute_priority", "pos").alias("attribute_priority"),
            F.min("pos").alias("first_pos"),
            F.array_sort(
                F.collect_list(F.struct("key_priority", "pos", F.trim(F.col("attribute_key")).alias("key")))
            ).alias("keys"),
        )
    )


def primary_keys(groups: DataFrame) -> DataFrame:
    """The key that stands for a value group: the last one with key priority 1, else the
    first in priority order."""
    ones = F.filter("keys", lambda e: e["key_priority"] == 1)
    return groups.withColumn(
        "primary_key",
        F.coalesce(F.try_element_at(ones, F.lit(-1))["key"], F.get("keys", F.lit(0))["key"]),
    )


def priority_digest(groups: DataFrame, on: str = "qid") -> DataFrame:
    """``key=value(Pn) | ...`` in order of first appearance."""
    item = F.concat(
        "primary_key", F.lit("="), "value", F.lit("(P"), F.coalesce(F.col("attribute_priority").cast("string"), F.lit("?")), F.lit(")")
    )
    return (
        primary_keys(groups)
        .select(on, F.struct("first_pos", item.alias("text")).alias("_i"))
        .groupBy(on)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("_i")), lambda e: e["text"]), " | ").alias("digest"))
    )


def to_isq(vocab: DataFrame, ord: str = "ord") -> DataFrame:
    """Key/value rows to distinct ``value:key:specification`` texts with their first position."""
    trimmed = vocab.filter(F.col("key").isNotNull() & F.col("value").isNotNull())
    return trimmed.groupBy(
        F.concat_ws(":", F.trim("value"), F.trim("key"), F.lit("specification")).alias("isq")
    ).agg(F.min(ord).alias("ord"))


def showcase_rows(results: dict[str, DataFrame], on: str = "qid") -> DataFrame:
    """Per query one struct per source with its attributes in priority order, ready for
    ``to_json`` or a JSON writer."""
    out = None
    for name, df in results.items():
        part = df.select(
            on,
            F.array_sort(
                F.transform(
                    "attributes",
                    lambda e: F.struct(
                        F.coalesce(e["attribute_priority"], F.lit(1)).alias("attribute_priority"),
                        F.coalesce(e["key_priority"], F.lit(1)).alias("key_priority"),
                        e["attribute_key"].alias("key"),
                        e["value"].alias("value"),
                    ),
                )
            ).alias(name),
        )
        out = part if out is None else out.join(part, on, "full")
    return out
