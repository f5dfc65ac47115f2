"""Extractor outputs and vocabularies in their file formats."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import PLACEHOLDERS
from ..functions.normalize import strip
from ..functions.parsing import last_wins, parse_nested
from ..schemas import ATTRIBUTE, MAP_RESULT, PAIR, RESULT_CSV, VOCAB

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
_BOM = "﻿"


def csv_headings(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a folder by their heading. Every file's first line is parsed as CSV, so names
    may hold commas; a byte-order mark is dropped. One row per file comes to the driver, like the
    listing that reading them takes anyway."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "row").alias("heading"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").collect():
        names = tuple(c.strip() for c in next(csv.reader([row["heading"].lstrip(_BOM)]), []))
        found.setdefault(names, []).append(unquote(row["file"]))
    return found


def _read_csv(spark: SparkSession, names: Sequence[str], files: list[str]) -> DataFrame:
    known = {f.name: f.dataType for f in RESULT_CSV}
    schema = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
    return spark.read.schema(schema).options(**_CSV, enforceSchema="true").csv(files)


def read_results(spark: SparkSession, path: str, source: str) -> DataFrame:
    """CSV with attribute JSON in a cell -> ``source, query, success, attributes``.

    Columns are matched by each file's own heading, so their order and number may vary between
    files; a missing ``success`` means true, a missing ``query`` is an error. Cells may span lines,
    which is why one file is one task: write the input as many files of moderate size."""
    parts = []
    for names, files in csv_headings(spark, path).items():
        if "query" not in names:
            raise ValueError(f"no column named query in {files[0]}")
        success = (F.col("success") == "True") if "success" in names else F.lit(True)
        nested = F.col("attributes_json") if "attributes_json" in names else F.lit(None).cast("string")
        parts.append(_read_csv(spark, names, files).select(
            F.lit(source).alias("source"),
            F.regexp_replace("query", f"^{_BOM}", "").alias("query"),
            F.coalesce(success, F.lit(False)).alias("success"),
            parse_nested(nested).alias("attributes"),
        ))
    if not parts:
        return spark.createDataFrame([], T.StructType([
            T.StructField("source", T.StringType()), T.StructField("query", T.StringType()),
            T.StructField("success", T.BooleanType()), T.StructField("attributes", T.ArrayType(ATTRIBUTE)),
        ]))
    return reduce(DataFrame.union, parts)


def read_map_results(spark: SparkSession, path: str, source: str, multi_line: bool = True) -> DataFrame:
    """JSON results with a flat attribute map -> the same relation; the order of the map
    becomes the attribute priority. A repeated key keeps its first place and last value."""
    raw = spark.read.schema(MAP_RESULT).option("multiLine", str(multi_line).lower()).json(path)
    entries = F.transform(
        last_wins(F.map_entries("attributes")),
        lambda e, i: F.struct(
            e["key"].alias("attribute_key"),
            e["value"].alias("value"),
            F.lit(1).alias("key_priority"),
            (i + 1).cast("int").alias("attribute_priority"),
        ),
    )
    return raw.select(
        F.lit(source).alias("source"),
        "query",
        F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce(entries, F.array().cast(T.ArrayType(ATTRIBUTE))).alias("attributes"),
    )


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Headerless two-column CSV."""
    return spark.read.schema(VOCAB).options(quote='"', escape='"').csv(path)


def read_vocab_text(spark: SparkSession, path: str, placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """Lines split at the first comma, trimmed and lower-case; short values and
    placeholders are dropped; pairs are distinct."""
    parts = F.split("value", ",", 2)
    return (
        spark.read.text(path)
        .filter(F.col("value").contains(","))
        .select(F.lower(strip(F.get(parts, F.lit(0)))).alias("key"), F.lower(strip(F.get(parts, F.lit(1)))).alias("value"))
        .filter((F.col("key") != "") & (F.length("value") > 1) & ~F.col("value").isin(list(placeholders)))
        .distinct()
    )


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Of each file the ``query`` column of a CSV if its heading has one, else every non-blank line
    except a ``query`` heading."""
    parts = []
    for names, files in csv_headings(spark, path).items():
        if "query" in names and len(names) > 1:
            parts.append(_read_csv(spark, names, files).select("query"))
        else:
            lines = spark.read.text(files).select(F.regexp_replace("value", f"^{_BOM}", "").alias("query"))
            parts.append(lines.filter(F.lower(strip(F.col("query"))) != "query"))
    rows = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "query string")
    return rows.select(strip(F.col("query")).alias("query")).filter("query <> ''")


def read_pairs(spark: SparkSession, path: str, schema: T.StructType = PAIR) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_pairs(df: DataFrame, path: str) -> None:
    """JSON Lines, one file per partition."""
    df.write.mode("errorifexists").json(path)


def write_report(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a heading and a fixed column order."""
    df.select(*columns).write.mode("errorifexists").options(header="true", quote='"', escape='"').csv(path)


def write_showcase(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
