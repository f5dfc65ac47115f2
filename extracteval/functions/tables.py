"""Small tables as part of the plan, and broadcasts behind a size check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_literal(x) for x in v) + ")"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Fixed rows as an inline table. Unlike a parallelised Python list it has known
    statistics, so Catalyst can see that it is small and choose the join by itself."""
    fields = T.StructType.fromDDL(schema).fields
    rows = list(rows)
    if not rows:
        return spark.createDataFrame([], schema)
    body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields)
    names = ", ".join(f"`{f.name}`" for f in fields)
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({names})")


# A side is broadcast only if it was measured to be below this many bytes.
BROADCAST_BYTES = 32 * 1024 * 1024
ROW_OVERHEAD = 64


def fits_broadcast(rows: int, chars: int, limit: int | None = None) -> bool:
    """Whether a side measured to hold ``rows`` rows and ``chars`` characters is surely small."""
    return rows * ROW_OVERHEAD + 4 * chars <= (BROADCAST_BYTES if limit is None else limit)


def broadcast_if(df: DataFrame, rows: int, chars: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a side measured to hold ``rows`` rows and ``chars`` characters,
    if that is surely small; beyond the limit the join is left to the planner, which
    shuffles both sides and splits skewed partitions."""
    return F.broadcast(df) if fits_broadcast(rows, chars, limit) else df
