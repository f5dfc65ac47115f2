"""File manifests and their audits."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L


def _glob(pattern: str) -> str:
    """A shell pattern as a regex over a file name; a match at its start is enough."""
    return "^" + re.escape(pattern).replace(r"\*", ".*")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def exclude_paths(
    df: DataFrame,
    path: str = "path",
    dirs: Sequence[str] = L.EXCLUDED_DIRS,
    suffixes: Sequence[str] = L.EXCLUDED_SUFFIXES,
    globs: Sequence[str] = L.EXCLUDED_GLOBS,
    names: Sequence[str] = L.EXCLUDED_NAMES,
) -> DataFrame:
    """Drop files below an excluded directory, with an excluded suffix, glob or name."""
    name = file_name(F.col(path))
    bad = (
        F.arrays_overlap(F.split(F.col(path), "/"), F.array(*[F.lit(d) for d in dirs]))
        | F.lower(name).rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")
        | name.rlike("|".join(_glob(g) for g in globs))
        | name.isin(list(names))
    )
    return df.filter(~bad)


def classify(
    df: DataFrame,
    families: Sequence[tuple[str, str]],
    categories: Sequence[tuple[str, Sequence[str]]] = L.CATEGORY_WORDS,
    name: str = "file_name",
    default_family: str = "common",
) -> DataFrame:
    """``family`` by the first matching pattern and ``category`` by the first list one of
    whose words the lower-case name contains."""
    low = F.lower(F.col(name))
    family = F.coalesce(*[F.when(low.rlike(p), F.lit(f)) for f, p in families], F.lit(default_family))
    category = F.coalesce(
        *[F.when(low.rlike("|".join(re.escape(w) for w in ws)), F.lit(c)) for c, ws in categories], F.lit("other")
    )
    return df.withColumn("family", family).withColumn("category", category)


def duplicate_content(manifest: DataFrame, digest: str = "sha256", name: str = "path") -> DataFrame:
    """Contents that occur more than once: copies and the first name. Members are not
    gathered; join back on the digest to list them (:func:`duplicate_members`)."""
    return manifest.groupBy(digest).agg(F.count(F.lit(1)).alias("copies"), F.min(name).alias("first_name")).filter(
        F.col("copies") > 1
    )


def duplicate_members(manifest: DataFrame, digest: str = "sha256", name: str = "path") -> DataFrame:
    """One row per file whose content occurs elsewhere too."""
    return manifest.join(duplicate_content(manifest, digest, name).select(digest, "copies"), digest)


def manifest_rollup(manifest: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Files and bytes per family and category, per family, and in total (null marks a
    total)."""
    return manifest.rollup("family", "category").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes")
    )


def anchor_check(required: DataFrame, manifest: DataFrame, name: str = "file_name") -> DataFrame:
    """Whether each required name is in the manifest."""
    have = manifest.select(name, F.lit(True).alias("_found")).distinct()
    return required.join(have, name, "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def integrity_report(manifest: DataFrame, required: DataFrame, digest: str = "sha256", size: str = "size_bytes") -> Mapping[str, DataFrame]:
    """The counts of an integrity report as one-row tables by section."""
    return {
        "summary": manifest.agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"),
            F.count_distinct(digest).alias("unique_contents"),
        ),
        "duplicates": duplicate_content(manifest, digest).agg(F.count(F.lit(1)).alias("groups")),
        "anchors": anchor_check(required, manifest).agg(
            F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing")
        ),
    }
