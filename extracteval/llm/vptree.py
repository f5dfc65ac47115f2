"""Nearest neighbours by largest inner product with vantage-point trees, one per shard.

Inner products are turned into distances: with ``m`` the largest norm, every vector gets a further
coordinate ``sqrt(m^2 - |x|^2)`` and a query a zero, so ``|q - x|^2 = |q|^2 + m^2 - 2 q.x`` and the
nearest points have the largest products. A tree parts its points by their distance from a vantage
point; a branch is left out if, by the triangle inequality, none of its points can be nearer than the
worst neighbour so far. ``factor`` scales that radius: 1 is exact search, less leaves out more.

Equal vectors are one *class*, of which the ids that can be among a query's neighbours are kept: the
``k + 1`` smallest. Every shard's tree meets the queries in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .groups import sorted_groups

SHARD = 8192  # vectors of a tree
QUERIES = 1024  # queries of a block
LEAF = 128


# ---- trees ----


class Tree:
    """Points in the order of their places in the tree, and nodes ``(lo, mid, hi, bounds)``: the
    vantage point is ``lo``, the near half ``lo + 1 .. mid``, the far one ``mid .. hi``."""

    def __init__(self, points: np.ndarray, names: np.ndarray, norm: float, classes: np.ndarray | None = None):
        self.points, self.norm = points, norm
        self.square = np.einsum("ij,ij->i", points, points)
        self.lift = np.sqrt(np.maximum(norm**2 - self.square, 0))
        order, self.nodes = np.arange(len(points)), {}
        rng = np.random.default_rng(len(points))
        todo = [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= LEAF:
                continue
            pick = lo + int(rng.integers(hi - lo))
            order[[lo, pick]] = order[[pick, lo]]
            rest = order[lo + 1 : hi]
            d = self._between(order[lo], rest)
            half = len(rest) // 2
            by = np.argpartition(d, half)
            order[lo + 1 : hi], d = rest[by], d[by]
            mid = lo + 1 + half
            self.nodes[lo, hi] = (mid, d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max())
            todo += [(lo + 1, mid), (mid, hi)]
        self.points, self.names, self.square, self.lift = points[order], names[order], self.square[order], self.lift[order]
        self.classes = self.names if classes is None else classes[order]

    def _between(self, i: int, rest: np.ndarray) -> np.ndarray:
        dot = self.points[rest] @ self.points[i] + self.lift[rest] * self.lift[i]
        return np.sqrt(np.maximum(2 * self.norm**2 - 2 * dot, 0))

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and places of each query's ``k`` best, -inf where there are fewer, and how many
        products were worked out. Ties go to the smaller name."""
        n, own = len(queries), np.einsum("ij,ij->i", queries, queries)
        best, at = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        names = np.append(self.names, np.iinfo(np.int64).max)
        at[:] = len(self.names)
        seen = 0

        def radius(rows: np.ndarray) -> np.ndarray:
            d = np.sqrt(np.maximum(own[rows] + self.norm**2 - 2 * best[rows, -1], 0))
            return factor * d * (1 + 1e-9) + 1e-9

        def meet(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
            nonlocal seen
            seen += len(rows) * (hi - lo)
            dots = queries[rows] @ self.points[lo:hi].T
            better = (dots >= best[rows, -1:]).any(axis=1)  # only these rows change
            if better.any():
                some = rows[better]
                scores = np.concatenate([best[some], dots[better]], axis=1)
                places = np.concatenate([at[some], np.broadcast_to(np.arange(lo, hi), (len(some), hi - lo))], axis=1)
                order = np.lexsort((names[places], -scores), axis=1)[:, :k]
                best[some], at[some] = np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)
            return dots

        def visit(rows: np.ndarray, lo: int, hi: int) -> None:
            if not len(rows) or lo == hi:
                return
            if (lo, hi) not in self.nodes:
                meet(rows, lo, hi)
                return
            mid, near_min, near_max, far_min, far_max = self.nodes[lo, hi]
            dots = meet(rows, lo, lo + 1)[:, 0]
            d = np.sqrt(np.maximum(own[rows] + self.norm**2 - 2 * dots, 0))
            sides = ((lo + 1, mid, near_min, near_max), (mid, hi, far_min, far_max))
            first = d <= (near_max + far_min) / 2
            for mine, (a, b, low, high) in ((first, sides[0]), (~first, sides[1]), (first, sides[1]), (~first, sides[0])):
                r = radius(rows)
                visit(rows[mine & (d - r <= high) & (d + r >= low)], a, b)

        visit(np.arange(n), 0, len(self.points))
        return best, at, seen


# ---- tables ----


def usable(v: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, dim)


def build_trees(classes: DataFrame, norm: float, shards: int) -> DataFrame:
    """``dim, shard, names, classes, points``: the index, a row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["dim", "shard"]):
            dim = group["dim"][0].as_py()
            blobs = [group["least"].to_numpy(), group["class"].to_numpy(), _matrix(group["vector"], dim)]
            yield pa.RecordBatch.from_arrays(
                [group["dim"].chunk(0)[:1], group["shard"].chunk(0)[:1], *(pa.array([b.tobytes()]) for b in blobs)], ["dim", "shard", "names", "classes", "points"]
            )

    dealt = classes.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int").alias("shard"), "class", "least", "vector")
    dealt = dealt.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "least", "class")
    return dealt.mapInArrow(run, "dim int, shard int, names binary, classes binary, points binary")


def search_shards(index: DataFrame, queries: DataFrame, norm: float, shards: int, blocks: int, k: int, factor: float) -> DataFrame:
    """``query, class, least, score``: the ``k`` best classes of each shard for each query ``class, vector``."""
    keys = ["dim", "shard", "block"]
    blob = lambda t: F.lit(None).cast(t)
    trees = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "names", "classes", "points", blob("bigint").alias("query"), blob("array<double>").alias("vector"))
    asked = queries.select(
        F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("class", F.lit(3)), F.lit(blocks)).cast("int").alias("block"),
        F.lit(1).alias("kind"), blob("binary").alias("names"), blob("binary").alias("classes"), blob("binary").alias("points"), F.col("class").alias("query"), "vector",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for group in sorted_groups(batches, keys):
            if group["kind"][0].as_py() or len(group) < 2:  # no tree, or nobody asks
                continue
            dim, shard = group["dim"][0].as_py(), group["shard"][0].as_py()
            if last != (dim, shard):
                names, classes = (np.frombuffer(group[c][0].as_py(), np.int64) for c in ("names", "classes"))
                tree, last = Tree(np.frombuffer(group["points"][0].as_py(), np.float64).reshape(-1, dim), names, norm, classes), (dim, shard)
            who, vectors = group["query"][1:].to_numpy(), _matrix(group["vector"][1:], dim)
            best, at, _ = tree.search(vectors, k, factor)
            row, col = np.nonzero(best > -np.inf)
            found = tree.points[at[row, col]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(who[row]), pa.array(tree.classes[at[row, col]]), pa.array(tree.names[at[row, col]]), pa.array((found * vectors[row]).sum(axis=1))],
                ["query", "class", "least", "score"],
            )

    dealt = trees.union(asked).repartition(*keys).sortWithinPartitions(*keys, "kind", "query")
    return dealt.mapInArrow(run, "query bigint, class bigint, least bigint, score double")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row whose ``vec_id`` is divisible by ``every``, the
    ``k`` nearest found, ties to the smaller ``vec_id``.

    * vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
      rows with a null ``vec_id``; vectors of another length are no candidates of a query;
    * equal vectors tie; a query's own row is no candidate of it; repeated rows count once;
    * fewer candidates than ``k``: all of them; empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(v)).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector"))
    # row limits are applied before the shuffle too, so copies without end stay where they are
    first = W.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = materialise(few.withColumn("class", F.xxhash64("vector", "ids")), "vp-classes")
    about = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not about[0]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    norm, shards = math.sqrt(about[1]) * (1 + 1e-12), math.ceil(about[0] / shard)
    named = classes.select("class", F.col("ids")[0].alias("least"), "vector", "ids")
    asking = rows.where(F.col("vec_id") % every == 0).distinct()
    asking = materialise(asking.join(named.select("vector", "class"), "vector").select("vec_id", "class"), "vp-queries")
    queries = named.join(asking.select("class").distinct(), "class", "left_semi").select("class", "vector")
    blocks = max(1, math.ceil(asking.select("class").distinct().count() / QUERIES))
    index = materialise(build_trees(named, norm, shards), "vp-index")
    found = materialise(search_shards(index, queries, norm, shards, blocks, k + 1, factor), "vp-found")
    best = W.partitionBy("query").orderBy(F.desc("score"), "least", "class")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    each = top.join(named.select("class", "least", "ids"), ["class", "least"]).select("query", "score", F.explode("ids").alias("vec_id"))
    least = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        each.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
        .groupBy(F.col("query").alias("class")).agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("l"))
    )
    out = asking.join(lists, "class").select(
        F.col("vec_id").alias("query_id"), F.posexplode(F.expr(f"slice(filter(l, x -> x.vec_id <> vec_id), 1, {k})")).alias("p", "x")
    )
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
