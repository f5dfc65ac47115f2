"""Row filters over query and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only_success(results: DataFrame) -> DataFrame:
    return results.filter("success")


def hard_queries(features: DataFrame, count: str = "n_attrs") -> DataFrame:
    """Long texts with few attributes although the run succeeded; longest first."""
    return features.filter(
        (F.col("word_count") >= 5) & (F.col("query_length") >= 40) & (F.col(count) <= 2) & F.col("success")
    ).orderBy(F.desc("word_count"), "qid")


def multi_facet(features: DataFrame) -> DataFrame:
    """Texts of four words or more that name a colour with another facet, or a size with a
    place."""
    color, place, size, material = (F.col(f"has_{f}") for f in ("color", "location", "size", "material"))
    return features.filter(
        (F.col("word_count") >= 4) & ((color & (place | size | material)) | (size & place))
    )
