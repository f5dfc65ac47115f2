"""Near-duplicate documents by b-bit MinHash.

Every document's set of word shingles gets ``count`` minima. Bands of ``rows`` minima name buckets;
documents that share a bucket are candidates. Of each minimum only ``bits`` low bits are kept and
packed; the similarity of two candidates is estimated from the number of equal bit groups, corrected
for groups that are equal by chance, and only pairs whose estimate can still belong to a true link
are confirmed, on the full sets. Links then give connected components.

No bucket is ever expanded into all its pairs:

1. Documents with equal word sequences are one *class*; only classes go on.
2. In each bucket the class whose digest is least is the leader and is paired with the others. A
   pair that shares several buckets with the same leader counts once.
3. Components of the confirmed links are labelled. Buckets that still hold several components are
   joined to *clusters* where they share classes. In a cluster, the classes outside its largest
   component (the *seekers*) meet all its classes, both dealt into blocks of bounded size; those that
   share a bucket and are of different components are confirmed there, on their sets, and one link
   is returned for each two components that are joined. Together with 2 this covers every candidate
   pair, so no link between candidates is lost.

With the default 128 minima in 32 bands of 4, a pair at similarity 0.85 shares no bucket with a
probability below 1e-10, at 0.8 below 1e-7. The estimate's cut lies ``slack`` standard deviations
below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .groups import rows_of_bytes, rows_of_lists, sorted_groups
from .shingles import minima, mix, shingle_set, words

BLOCK = 512  # members, and seekers, of a cluster that meet in one group

DOCS = 256  # documents whose sets are in memory at once

_FEATURES = "doc_id bigint, digest string, n_shingles int, bands array<bigint>, bits binary"


def pack_bits(mins: np.ndarray, bits: int) -> np.ndarray:
    """The ``bits`` low bits of every minimum, packed in rows of bytes. Minima are mixed first:
    their low bits are not random as they come."""
    low = (mix(mins) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes.transpose(0, 2, 1).reshape(len(mins), planes.shape[1] * planes.shape[2]), axis=1)


def estimate(a: np.ndarray, b: np.ndarray, count: int, bits: int) -> np.ndarray:
    """Estimated similarity of the packed signatures ``a`` and ``b`` (broadcast against each other).
    A position is equal if all its bits are; 2**-bits of the unequal ones are equal by chance."""
    differs = (a ^ b).reshape(*np.broadcast_shapes(a.shape, b.shape)[:-1], bits, count // 8)
    equal = 1.0 - np.bitwise_count(np.bitwise_or.reduce(differs, axis=-2)).sum(axis=-1) / count
    chance = 2.0**-bits
    return (equal - chance) / (1.0 - chance)


def cut(threshold: float, count: int, bits: int, slack: float = 5.0) -> float:
    """The least estimate that a pair at the threshold can plausibly have."""
    chance = 2.0**-bits
    equal = threshold + (1 - threshold) * chance
    return threshold - slack * float(np.sqrt(equal * (1 - equal) / count)) / (1 - chance)


def features(docs: DataFrame, size: int = 5, count: int = 128, rows: int = 4, bits: int = 2, hashed: bool = False) -> DataFrame:
    """``doc_id, digest, n_shingles, bands, bits`` of every document, and ``text_hash`` if ``hashed``.
    The digest is that of the word sequence; documents without words have none, nor bands."""
    also = ["text_hash"] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS):
                yield signed(batch.slice(lo, DOCS))

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, sets = [], {}  # each digest of the batch is worked on once
        for text in batch["text"]:
            toks = words(text.as_py())
            digests.append(xxhash.xxh3_128_hexdigest(b" ".join(toks)) if toks else None)
            if toks and digests[-1] not in sets:
                sets[digests[-1]] = shingle_set(toks, size)
        mins = minima(list(sets.values()), count)
        keys = np.zeros((len(mins), count // rows), np.uint64)
        for r in range(rows):
            keys = mix(keys + mins[:, r::rows])
        keys = mix(keys + np.arange(keys.shape[1], dtype=np.uint64)).view(np.int64)
        packed = pack_bits(mins, bits)
        at = {d: j for j, d in enumerate(sets)}
        return pa.RecordBatch.from_arrays([
            batch["doc_id"],
            pa.array(digests, pa.string()),
            pa.array([len(sets[d]) if d else 0 for d in digests], pa.int32()),
            pa.array([keys[at[d]] if d else None for d in digests], pa.list_(pa.int64())),
            pa.array([packed[at[d]].tobytes() if d else None for d in digests], pa.binary()),
            *(batch[k] for k in also),
        ], ["doc_id", "digest", "n_shingles", "bands", "bits", *also])

    hashes = [F.xxhash64("text").alias(k) for k in also]
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text"), *hashes).mapInArrow(run, ", ".join([_FEATURES, *(f"{k} bigint" for k in also)]))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets have ``100 * intersection >= percent * union``."""
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch["sa"], batch["sb"]):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a string, b string")


def _plausible(a: Column, b: Column, na: Column, nb: Column, count: int, bits: int, percent: int, least: float) -> Column:
    """Sizes and packed bits allow a link."""
    sized = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        left, right = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in (x, y))
        return pd.Series(estimate(left, right, count, bits))

    return sized & (similarity(a, b) >= least)


def _seek(docs: DataFrame, feats: DataFrame, places: DataFrame, classes: DataFrame, roots: DataFrame, size: int, count: int, bits: int, percent: int, least: float) -> DataFrame:
    """Step 3: links between classes of different components that share a bucket."""
    rows = places.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    mixed = rows.groupBy("bucket").agg(F.min("digest").alias("a"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    rows = materialise(rows.join(mixed.select("bucket", "a"), "bucket").select("a", "digest", "root"), "minhash-mixed")
    clusters = materialise(components(rows.select("a", F.col("digest").alias("b"))), "minhash-clusters")
    known = rows.select("digest", "root").distinct().join(clusters.select(F.col("node").alias("digest"), F.col("root").alias("cluster")), "digest")
    known = materialise(known, "minhash-clustered")
    # the size of each component in its cluster; counts only
    parts = known.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    mains = parts.groupBy("cluster").agg(
        F.sum("n").alias("members"), F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("seekers")
    )
    sets = _sets(docs, feats, known.select("digest"), size)
    full = known.join(mains, "cluster").join(classes.select("digest", "bits", "bands"), "digest").join(sets, "digest")
    full = materialise(full, "minhash-seekers")
    deal = lambda n: F.pmod(F.xxhash64("digest"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks, groups = F.ceil(F.col("members") / BLOCK).cast("int"), F.ceil(F.col("seekers") / BLOCK).cast("int")
    keys, cols = ["cluster", "block", "part"], ["cluster", "block", "part", "seeks", "digest", "root", "bits", "bands", "shingles"]
    member = full.withColumn("block", deal(blocks)).withColumn("part", all_of(groups)).withColumn("seeks", F.lit(False))
    seeker = full.where("root <> main").withColumn("part", deal(groups)).withColumn("block", all_of(blocks)).withColumn("seeks", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            found = _links(group, count, bits, percent, least)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found)], ["a", "b"])

    dealt = member.select(cols).union(seeker.select(cols)).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a string, b string")


def _links(group: pa.Table, count: int, bits: int, percent: int, least: float) -> list[tuple[str, str]]:
    """Links of a group's seekers to its members, one for each two components that they join."""
    seeks = group["seeks"].to_numpy()
    at_m = np.flatnonzero(~seeks)
    if not len(at_m):
        return []
    packed, bands = rows_of_bytes(group["bits"]), rows_of_lists(group["bands"])
    digests, (_, roots) = group["digest"].to_numpy(), np.unique(group["root"].to_numpy().astype(str), return_inverse=True)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["shingles"]]
    n = np.array([len(s) for s in sets])
    found = []
    for i in np.flatnonzero(seeks):
        near = at_m[(roots[at_m] != roots[i]) & (100 * np.minimum(n[at_m], n[i]) >= percent * np.maximum(n[at_m], n[i]))]
        near = near[(bands[near] == bands[i]).any(axis=1)]
        near = near[estimate(packed[i][None, :], packed[near], count, bits) >= least] if len(near) else near
        if not len(near):
            continue
        values = np.concatenate([sets[j] for j in near])
        place = np.minimum(np.searchsorted(sets[i], values), n[i] - 1)
        common = np.add.reduceat(sets[i][place] == values, np.cumsum([0, *n[near][:-1]]), dtype=np.int64)
        for j in near[100 * common >= percent * (n[near] + n[i] - common)]:
            if roots[i] != roots[j]:
                found.append((digests[i], digests[j]))
                roots[roots == roots[i]] = roots[j]
    return found


def near_duplicates(
    docs: DataFrame, percent: int = 80, size: int = 5, count: int = 128, rows: int = 4, bits: int = 2, slack: float = 5.0
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the least ``doc_id`` reachable, ``kept`` marks the document that has it.

    * null, empty or blank text: no shingles, linked with nothing, its own component, kept;
    * fewer than ``size`` words: the whole sequence is the one shingle;
    * null ``doc_id``: takes part in links; its row carries the component's least id, which is null
      if no member has one, and ``kept`` is false unless the component has no id at all;
    * repeated rows: equal texts, so one class; every row with the least id is kept;
    * empty table: no rows. Other columns are ignored, whatever their names.
    """
    feats = materialise(features(docs, size, count, rows, bits), "minhash-features")
    worded = feats.where("digest is not null")
    member = _members(docs, feats, percent, size, count, rows, bits, slack)
    ids = member.groupBy("top").agg(F.min("least_id").alias("component_id"))
    named = member.join(ids, "top").select("digest", "component_id")
    out = worded.join(named, "digest").union(
        feats.where("digest is null").select("digest", "doc_id", "n_shingles", "bands", "bits", F.col("doc_id").alias("component_id"))
    )
    return out.select(
        "doc_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, percent: int = 80, size: int = 5, count: int = 128, rows: int = 4, bits: int = 2, slack: float = 5.0
) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: that of the least ``doc_id``, and of
    the least text hash among rows of that id. A null ``doc_id`` is later than all others.

    * repeated rows (equal in id and text): one document; an id with several texts: several
      documents, each in its own component;
    * null, empty or blank text: its own component, stays.
    """
    feats = materialise(features(docs, size, count, rows, bits, hashed=True), "minhash-features")
    worded = feats.where("digest is not null")
    member = _members(docs, feats, percent, size, count, rows, bits, slack).select("digest", "top")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    firsts = member.join(worded.groupBy("digest").agg(F.min(row).alias("keeper")), "digest")
    keepers = firsts.groupBy("top").agg(F.min("keeper").alias("keeper"))
    named = member.join(keepers, "top").select("digest", "keeper")
    stays = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash"))
    gone = worded.join(named, "digest").where(~stays).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    once = docs.dropDuplicates(["doc_id", "text"])
    return once.join(gone, once["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(once["text"]) == gone["gone_hash"]), "left_anti")


def _members(docs: DataFrame, feats: DataFrame, percent: int, size: int, count: int, rows: int, bits: int, slack: float) -> DataFrame:
    """``digest, least_id, top`` of each class: its component is that of the same ``top``."""
    if count % rows or count % 8:
        raise ValueError("count must be a multiple of rows and of 8")
    least = cut(percent / 100, count, bits, slack)
    worded = feats.where("digest is not null")
    classes = worded.groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
    )
    classes = materialise(classes, "minhash-classes")

    # only buckets that several classes share matter from here on
    places = classes.select("digest", F.posexplode("bands").alias("band", "bucket"))
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = materialise(places.join(shared.select("bucket"), "bucket", "left_semi"), "minhash-places")

    leaders = places.groupBy("bucket").agg(F.min("digest").alias("a"))
    pairs = places.join(leaders, "bucket").where(F.col("digest") > F.col("a")).select("a", F.col("digest").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("digest").alias(side), F.col("bits").alias(f"bits_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)
    likely = _plausible(F.col("bits_a"), F.col("bits_b"), F.col("n_a"), F.col("n_b"), count, bits, percent, least)
    pairs = materialise(pairs.where(likely).select("a", "b"), "minhash-pairs")
    sets = _sets(docs, feats, pairs.select(F.col("a").alias("digest")).union(pairs.select("b")), size)
    links = materialise(confirm(pairs, sets, percent), "minhash-links")
    roots = materialise(components(links), "minhash-roots")

    links2 = materialise(_seek(docs, feats, places, classes, roots, size, count, bits, percent, least), "minhash-more")
    # components of the first links are single vertices now
    lifted = (
        links2.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    )
    lifted = components(lifted).select(F.col("node").alias("root"), F.col("root").alias("top"))
    member = (
        classes.select("digest", "least_id").join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left")
        .withColumn("root", F.coalesce("root", "digest")).join(lifted, "root", "left")
        .select("digest", "least_id", F.coalesce("top", "root").alias("top"))
    )
    return materialise(member, "minhash-members")


def _sets(docs: DataFrame, feats: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Full shingle sets of the ``wanted`` digests, from one document of each."""
    wanted = materialise(wanted.distinct(), "minhash-wanted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), DOCS):
                digests, found = [], []
                for text in batch["text"].iloc[lo : lo + DOCS]:
                    toks = words(text)
                    digests.append(xxhash.xxh3_128_hexdigest(b" ".join(toks)))
                    found.append(shingle_set(toks, size).tobytes())
                yield pd.DataFrame({"digest": digests, "shingles": found})

    # a class is found again by the id of a member; ids are null or repeated at times, so its
    # digest decides, and one row of each digest stays
    ids = feats.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("id"))
    ids = materialise(ids.select(F.col("id").alias("wanted_id")).distinct(), "minhash-ids")
    text = docs.select(F.col("doc_id").cast("bigint").alias("wanted_id"), "text")
    # ids may be null: compared null-safe
    text = text.join(ids, text["wanted_id"].eqNullSafe(ids["wanted_id"]), "left_semi").select("text")
    found = text.where("text is not null").mapInPandas(run, "digest string, shingles binary").join(wanted, "digest", "left_semi")
    return materialise(found.groupBy("digest").agg(F.first("shingles").alias("shingles")), "minhash-sets")
