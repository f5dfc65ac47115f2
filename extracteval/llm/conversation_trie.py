"""Prefix trie of conversations, as a distributed burst trie.

A conversation is a sequence of turn ids, a digest of role and text each. A *container* is the set of
suffixes that stand under one node; it bursts into one container for each next turn id if more than
``limit`` rows of turns stand under its node, and the node becomes a *head*. Whether a node bursts
depends on its own size alone, so all bursts of all depths are found by one aggregate over the digests
of prefixes, not by a round for each depth. What is left in containers is bounded: they are dealt to
tasks, sorted by depth, prefix and conversation, and swept into nodes with all sums of their subtrees.
Heads, of which there are few, get their sums by aggregates: of the nodes under a head each is owned
by its least conversation, which passes through the head, so the sums under a head are those of the
owned nodes of the conversations that pass it.

Texts are read once and never shuffled; digests travel. The turns of one conversation are sorted and
streamed by one task, which holds none of them but the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storing import stored

LIMIT = 1 << 14  # rows of turns that a container holds at most
INHERITED = 6  # a conversation takes fewer turns than this from its base
ROWS = 1 << 14
_ROOT = hashlib.blake2b(b"", digest_size=16).digest()
_NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- sequences ----


def turns(conversations: DataFrame) -> DataFrame:
    """``c, pos, id, n``: the turns of each conversation in order, their ids and code points. Null
    turns come first, equal ones by id; rows without a conversation id belong to none."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"), F.length(text).alias("n"),
    )
    order = W.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "id")
    return rows.select("c", F.row_number().over(order).alias("pos"), "id", "n")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``c, d, id, n, size``: each conversation with its first turns taken from its base; row 0 stands
    for the root, ``size`` is the number of turns. A base has at most a hundred conversations (ids are
    cut towards zero), and gives each five turns at most."""
    own = stored(turns(conversations), "trie-turns")
    sizes = own.groupBy("c").agg(F.max("pos").alias("own"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % INHERITED
    bases = sizes.select(F.col("c").alias("base"), F.col("own").alias("there"))
    convs = sizes.select("c", "own", h.cast("int").alias("h"), (F.col("c") - F.col("c") % 100).alias("base")).join(bases, "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.select("c", "base", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "trie-convs")
    given = own.where(f"pos < {INHERITED} and c % 100 = 0").withColumnRenamed("c", "base")
    first = convs.join(given, "base").where("pos <= h").select("c", F.col("pos").alias("d"), "id", "n", "size")
    rest = own.join(convs, "c").where("pos > h").select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("d"), "id", "n", "size")
    root = convs.select("c", F.lit(0).alias("d"), F.lit(None).cast("binary").alias("id"), F.lit(0).alias("n"), "size")
    return root.union(first).union(rest)


def paths(sequences: DataFrame) -> DataFrame:
    """``c, d, n, size, prefix, parent``: a row for each prefix of each conversation, with its digest
    and that of the prefix before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _ROOT
        for batch in batches:
            prefixes, parents = [], []
            for d, turn in zip(batch["d"].to_pylist(), batch["id"].to_pylist()):
                before = None if d == 0 else now
                now = _ROOT if d == 0 else hashlib.blake2b(now + turn, digest_size=16).digest()
                prefixes.append(now)
                parents.append(before)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in ("c", "d", "n", "size")), pa.array(prefixes, pa.binary()), pa.array(parents, pa.binary())], names)

    names = ["c", "d", "n", "size", "prefix", "parent"]
    dealt = sequences.select("c", "d", "n", "size", "id").repartition("c").sortWithinPartitions("c", "d")
    return dealt.mapInArrow(run, "c bigint, d int, n int, size int, prefix binary, parent binary")


# ---- containers ----


def burst(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``head``, the depth of the deepest head that a conversation passes, and ``container``, the
    prefix one deeper. The root is always a head."""
    under = rows.where("d > 0").groupBy("prefix").agg(F.sum(F.col("size") - F.col("d") + 1).alias("under"))
    heads = under.where(F.col("under") > limit).select("prefix")
    deepest = rows.where("d > 0").select("c", "d", "prefix").join(heads, "prefix").groupBy("c").agg(F.max("d").alias("head"))
    placed = rows.join(deepest, "c", "left").withColumn("head", F.coalesce("head", F.lit(0)))
    return placed.withColumn("container", F.max(F.when(F.expr("d = head + 1"), F.col("prefix"))).over(W.partitionBy("c")))


class _Sweep:
    """The nodes of one container, from rows sorted by depth, prefix and conversation."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.nodes: list[list] = []  # prefix, parent, owner, depth, members, code points, ends
        self.ups: list[int] = []

    def add(self, d: int, prefix: bytes, parent: bytes, c: int, n: int, last: bool) -> None:
        i = self.at.get(prefix)
        if i is None:
            i = self.at[prefix] = len(self.nodes)
            self.nodes.append([prefix, parent, c, d, 0, n, None])
            self.ups.append(self.at.get(parent, -1))
        node = self.nodes[i]
        node[4] += 1
        if last:
            node[6] = _joined(node[6], c)

    def rows(self) -> Iterator[tuple]:
        size = len(self.nodes)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for i in range(size - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (self.nodes[i][4] - 1) * self.nodes[i][5]
            if (up := self.ups[i]) >= 0:
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        for i, (prefix, parent, owner, d, members, _, ends) in enumerate(self.nodes):
            up = self.ups[i]
            yield prefix, parent if up < 0 else None, owner, d, None if up < 0 else self.nodes[up][2], members, children[i], leaves[i], saved[i], ends.hexdigest() if ends else _NO_ENDS


def _joined(ends, c: int):
    """SHA-256 of the ids so far, with commas between them, and one more."""
    if ends is None:
        return hashlib.sha256(b"%d" % c)
    ends.update(b",%d" % c)
    return ends


_NODE = "prefix binary, top binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], [x.split()[0] for x in _NODE.split(", ")])


def sweep(placed: DataFrame) -> DataFrame:
    """The nodes of all containers; ``top`` is the head above, for a container's first node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        container, nodes, out = None, _Sweep(), []
        for batch in batches:
            for key, *row in zip(*(batch[k].to_pylist() for k in ("container", "d", "prefix", "parent", "c", "n", "last"))):
                if key != container:
                    out += nodes.rows()
                    container, nodes = key, _Sweep()
                    if len(out) >= ROWS:
                        yield _batch(out)
                        out = []
                nodes.add(*row)
        out += nodes.rows()
        if out:
            yield _batch(out)

    rows = placed.where("d > head").select("container", "d", "prefix", "parent", "c", "n", (F.col("d") == F.col("size")).alias("last"))
    return rows.repartition("container").sortWithinPartitions("container", "d", "prefix", "c").mapInArrow(run, _NODE)


# ---- heads ----


def _ends(rows: DataFrame) -> DataFrame:
    """``prefix, ends_sha256`` of heads at which conversations end. A digest of an ordered list is
    made from first to last; it is streamed, nothing is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, ends = None, None
        for batch in batches:
            done = []
            for key, c in zip(batch["prefix"].to_pylist(), batch["c"].to_pylist()):
                if key != prefix:
                    if ends:
                        done.append((prefix, ends.hexdigest()))
                    prefix, ends = key, None
                ends = _joined(ends, c)
            yield out(done)
        if ends:
            yield out([(prefix, ends.hexdigest())])

    def out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["prefix", "ends_sha256"])

    return rows.where("d = size").select("prefix", "c").repartition("prefix").sortWithinPartitions("prefix", "c").mapInArrow(run, "prefix binary, ends_sha256 string")


def _heads(placed: DataFrame, under: DataFrame) -> DataFrame:
    """The nodes that burst, with the sums of what is ``under`` them."""
    rows = placed.where("d <= head")
    nodes = rows.groupBy("prefix").agg(
        F.first("parent").alias("parent"), F.min("c").alias("conv_id"), F.first("d").alias("d"), F.count(F.lit(1)).alias("n_convs"), F.first("n").alias("n"),
    )
    nodes = stored(nodes, "trie-heads")
    tops = under.where("top is not null").select(F.col("top").alias("parent"), "conv_id", F.col("depth").alias("d"), "n_leaves", "saved_tokens")
    counts = tops.select("parent").union(nodes.where("parent is not null").select("parent")).groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(counts, "prefix", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # what each conversation owns: heads themselves, and containers as a whole
    owned = nodes.select(F.col("conv_id").alias("c"), "d", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    owned = owned.union(tops.select(F.col("conv_id").alias("c"), "d", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    passing = rows.join(owned.select("c").distinct(), "c", "left_semi").select("c", "d", "prefix", F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved"))
    both = passing.union(owned.select("c", "d", F.lit(None).cast("binary").alias("prefix"), "leaves", "saved"))
    deeper = W.partitionBy("c").orderBy(F.col("d").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    below = both.select("prefix", F.sum("leaves").over(deeper).alias("leaves"), F.sum("saved").over(deeper).alias("saved")).where("prefix is not null")
    sums = below.groupBy("prefix").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = nodes.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(sums, "prefix").join(_ends(rows), "prefix", "left").join(parents, "parent", "left")
        .select("prefix", F.lit(None).cast("binary").alias("top"), "conv_id", F.col("d").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("bigint").alias("n_children"),
                "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))
    )


def conversation_trie(conversations: DataFrame, limit: int = LIMIT, sequences: DataFrame | None = None) -> DataFrame:
    """A row for each node of the trie of the rebuilt ``conversations`` (or of ``sequences``, rows
    ``c, d, id, n, size`` as ``rebuilt`` makes them): ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    * null role or text: empty; null turn: first; equal turns of a conversation: by digest, each kept;
    * null ``conv_id``: the row belongs to no conversation and is left out;
    * repeated rows: turns of their own; very long texts: digested whole;
    * equal conversations: members of the same nodes;
    * empty table: no conversation, so no node, not even the root;
    * extra columns are ignored, whatever their names.
    """
    rows = stored(paths(rebuilt(conversations) if sequences is None else sequences), "trie-paths")
    placed = stored(burst(rows, limit), "trie-placed")
    swept = stored(sweep(placed), "trie-nodes")
    heads = stored(_heads(placed, swept), "trie-tops")
    above = heads.select(F.col("prefix").alias("top"), F.col("conv_id").alias("above"))
    below = swept.join(above, "top", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return heads.select(*columns).union(below.select(*columns))
