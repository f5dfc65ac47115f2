"""Connected components of an edge table, by alternating large and small stars.

Each round first contracts the edges of every task by themselves, then joins what tasks know of each
other: two aggregates and two joins. It is written to the shared folder, so lineage stays short and a
lost executor repeats one round at most. A vertex's neighbours are never gathered: only their minimum
is, with partial sums before the shuffle, and the joins that bring it back to the edges are plain
equi-joins whose hot side adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialise

CONTRACT = 1 << 18  # edges that a task contracts at a time


def contract(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Each vertex but the least of its component with that least one."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        for batch in batches:
            held += zip(batch["u"].to_pylist(), batch["v"].to_pylist())
            if len(held) >= CONTRACT:
                yield out(contract(held))
                held = []
        yield out(contract(held))

    def out(found: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["u", "v"])

    return edges.mapInArrow(run, "u string, v string")


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each vertex, itself included."""
    return edges.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``, both strings, for every vertex that has an edge to another; ``root`` is the
    least vertex of its component. Loops and rows with a null end are ignored, repeated edges do no
    harm, no edges give no rows."""
    now = materialise(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")), "cc")
    state = None
    while True:
        local = _contracted(now)  # u > v
        both = local.union(local.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of a vertex move to its least neighbour
        large = both.where("v > u").join(_least(both), F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large, "cc")
        # small star: smaller neighbours of a vertex, and itself, move to the least of them
        least = _least(large)
        small = large.join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        seen = Observation()
        now = materialise(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")), "cc")
        was, state = state, (seen.get["n"], seen.get["s"])
        if not state[0] or was == state:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
