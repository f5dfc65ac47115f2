"""Intermediate tables whose shuffles are large."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import materialise

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``materialise``, with the shuffle files behind the table dropped as soon as it is written,
    instead of when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    was = conf.get(CLEAN, None)
    try:
        conf.set(CLEAN, "true")
        return materialise(df, name)
    finally:
        conf.unset(CLEAN) if was is None else conf.set(CLEAN, was)
