"""Removal of repeated substrings by distributed prefix doubling.

Positions get the rank of the bytes they start with, for growing lengths: 1, 2, 4, 8, 16, 26, 50. The
rank of a longer prefix is that of a pair of ranks at an offset; ranks are 64-bit hashes of the pair,
so that no sort is needed to name them, and the steps up to 26 bytes are taken inside a document.
From there on Spark sorts rank and position pairs over all documents, and positions whose rank is
unique are out:

1. *26 bytes.* Any 50 bytes hold 25 starts of 26 bytes; the one of least rank is the same wherever
   those 50 bytes occur, so only positions of least rank (*anchors*, one in thirteen) are sorted. With
   each goes the rank of its context, the 24 bytes on either side. An anchor whose rank and context
   occur in an earlier document is settled: all 50-byte strings around it are repeated. Of what is
   left, anchors whose rank occurs in one context only are unique there and out; the others, one for
   each context, are *open*.
2. *50 bytes.* The 50-byte strings around open anchors are sorted by rank; those of which an earlier
   document has the same are repeated. A settled string is never the first of its kind, so leaving
   those out of this sort loses nothing.

A rank that a sample shows to be frequent (a line or passage of very many documents) is sorted in
parts. The first of each part is left open by step 1, and compared once more in step 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import broadcast_if, small_table
from ..session import materialise
from .groups import sorted_groups
from .storing import stored

LENGTH, ANCHOR = 50, 26
SIDE = LENGTH - ANCHOR  # bytes of context on either side of an anchor
STARTS = SIDE + 1  # anchors' places inside a string
PIECE = 1 << 20  # strings of a text that are worked on at once
PARTS = 64  # parts of a frequent rank
SAMPLE, OFTEN = 64, 2000  # one document in SAMPLE is looked at; frequent is one anchor in OFTEN
ROWS = 1 << 16
NONE = (1 << 63) - 1  # stands for a null doc_id: later than all others

_BYTES = np.random.default_rng(5).integers(0, 2**64, 257, np.uint64)  # 256: beyond the text
_C1, _C2, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(32)


# ---- ranks inside a text ----


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of a prefix from those of two prefixes it consists of."""
    x = a * _C1 + b
    x ^= x >> _HALF
    x *= _C2
    return x ^ (x >> _HALF)


def double(r: np.ndarray, have: int, want: int) -> np.ndarray:
    """Ranks of ``want`` bytes from those of ``have``, doubling as often as needed."""
    while have < want:
        step = min(have, want - have)
        r = pair(r[:-step], r[step:])
        have += step
    return r


def _slide(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x, k = f(x[:-k], x[k:]), 2 * k
    return f(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def string_ranks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of 50 bytes or more: the ranks of 26 bytes at each start, the least of those in each
    50-byte string, and which starts are anchors."""
    r = double(_BYTES[raw], 1, ANCHOR)
    least = _slide(np.minimum, r, STARTS)
    ends = np.zeros(STARTS - 1, np.uint64)
    return r, least, _slide(np.maximum, np.concatenate([ends, least, ends]), STARTS) == r


def _raw(text: str | None) -> np.ndarray:
    return np.frombuffer(b"" if text is None else text.encode("utf-8", "surrogatepass"), np.uint8)


def _pieces(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text as pieces of bounded size that hold every string of it whole."""
    for lo in range(0, len(raw) - LENGTH + 1, PIECE):
        yield lo, raw[lo : lo + PIECE + LENGTH - 1]


def text_anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, rank and context rank of every anchor. Two pieces may name the same one."""
    places, ranks, contexts = [], [], []
    for lo, piece in _pieces(raw):
        r, _, chosen = string_ranks(piece)
        at = np.flatnonzero(chosen)
        # 24 bytes before and after, with a sign of its own for what is beyond the text
        wide = np.full(len(piece) + 2 * SIDE, 256, np.int64)
        left, right = max(0, lo - SIDE), min(len(raw), lo + len(piece) + SIDE)
        wide[SIDE - (lo - left) : SIDE + right - lo] = raw[left:right]
        side = double(_BYTES[wide], 1, SIDE)
        places.append(at + lo)
        ranks.append(r[at])
        contexts.append(pair(side[at], side[at + SIDE + ANCHOR]))
    return tuple(np.concatenate(x) for x in (places, ranks, contexts)) if places else tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64))


# ---- tables ----


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc, tag, text``: a null id as the latest; ``tag``, all 64 bits of the text's hash, parts texts
    of the same id. Two different texts of one id share a tag with a probability of 2^-64."""
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NONE))
    return docs.select(doc.alias("doc"), F.xxhash64("text").alias("tag"), "text")


def _anchors(docs: DataFrame) -> DataFrame:
    """``a, c, doc, tag``, a row per anchor, as small as it can be: ``a`` holds 48 bits of the rank and
    16 of the context's, ``c`` 32 more of the context's and the place. Two different strings of one
    group settle each other wrongly with a probability of 2^-48."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = [], 0
            for doc, tag, text in zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["text"]):
                place, rank, context = text_anchors(_raw(text.as_py()))
                a = (rank >> np.uint64(16) << np.uint64(16)) | (context >> np.uint64(48))
                c = (context << np.uint64(32)) | place.astype(np.uint64)
                out.append((a.view(np.int64), c.view(np.int64), np.full(len(place), doc), np.full(len(place), tag)))
                rows += len(place)
                if rows >= ROWS:
                    yield _batch(out)
                    out, rows = [], 0
            if rows:
                yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "c", "doc", "tag"])

    return docs.mapInArrow(run, "a bigint, c bigint, doc bigint, tag bigint")


def _rank() -> Column:
    return F.shiftrightunsigned("a", 16)


def frequent(docs: DataFrame) -> DataFrame:
    """``often``: ranks that a sample shows to be frequent, ``OFTEN`` at most. It only decides which
    ranks are sorted in parts."""
    seen = _anchors(docs.where(F.pmod(F.xxhash64("doc", "tag", F.lit(7)), F.lit(SAMPLE)) == 0)).groupBy(_rank().alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    seen = materialise(seen.where("n > 3"), "frequent")
    total = seen.agg(F.sum("n")).first()[0] or 0
    rows = seen.where(F.col("n") * OFTEN > total).orderBy(F.desc("n"), "rank").limit(OFTEN).collect()
    return small_table(docs.sparkSession, [(r["rank"],) for r in rows], "often bigint")


def _part(of: Column) -> Column:
    return F.when(of.isNotNull(), 1 + F.pmod(F.xxhash64("doc"), F.lit(PARTS))).otherwise(0).cast("int")


def _open_or_settled(anchors: DataFrame) -> DataFrame:
    """Step 1 on sorted anchors: ``settled, part, doc, tag, place``."""
    keys = ["part", "a", "c", "doc", "tag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = context = first = None  # what the last row was in
        held: list[tuple[np.ndarray, ...]] = []  # open rows of the first context, while it is the only one
        several = False
        for batch in batches:
            if not batch.num_rows:
                continue
            part, a, c, doc, tag = (batch[k].to_numpy() for k in keys)
            rank, low, place = a >> 16, c >> 32, c & 0xFFFFFFFF
            new_group = np.ones(len(rank), bool)
            new_group[1:] = (rank[1:] != rank[:-1]) | (part[1:] != part[:-1])
            new_group[0] = (rank[0], part[0]) != group
            new_ctx = new_group.copy()
            new_ctx[1:] |= (a[1:] != a[:-1]) | (low[1:] != low[:-1])
            new_ctx[0] |= (a[0], low[0]) != context
            # the first document of each context; that of the first rows may be from before
            starts = np.flatnonzero(new_ctx)
            firsts = np.concatenate([[doc[0] if new_ctx[0] else first], doc[starts[starts > 0]]])
            of = np.cumsum(new_ctx) - int(new_ctx[0])
            settled = doc > firsts[of]
            # a group of several contexts, or of a part, leaves open rows
            number = np.cumsum(new_group) - int(new_group[0])
            contexts = np.bincount(number, weights=new_ctx & ~new_group)
            many = (contexts > 0) | (np.bincount(number, weights=part) > 0)
            if not new_group[0]:
                many[0] |= several
            if held and many[0] and not new_group[0]:
                yield _rows([*zip(*held)], False)
                held = []
            if new_group[0]:
                held = []
            if settled.any():
                yield _rows([[x[settled]] for x in (part, doc, tag, place)], True)
            is_open = ~settled & many[number]
            if is_open.any():
                yield _rows([[x[is_open]] for x in (part, doc, tag, place)], False)
            last = number == number[-1]
            several = bool(many[-1])
            if number[-1] > 0:
                held = []
            if not several:
                keep = last & ~settled
                held.append(tuple(x[keep] for x in (part, doc, tag, place)))
            group, context, first = (rank[-1], part[-1]), (a[-1], low[-1]), firsts[-1]

    def _rows(columns: list, settled: bool) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), settled)), *map(pa.array, cols)], ["settled", "part", "doc", "tag", "place"])

    dealt = anchors.select(*keys).repartition(_rank(), "part").sortWithinPartitions(_rank(), "part", "a", F.shiftright("c", 32), "doc", "tag", "c")
    return dealt.mapInArrow(run, "settled boolean, part int, doc bigint, tag bigint, place bigint")


def _by_document(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Each text with what is said of it, side by side in one sorted task: ``doc, tag, place, kind,
    part, text``; the text's row comes first."""
    no = F.lit(None)
    rows = docs.select("doc", "tag", F.lit(-1).cast("bigint").alias("place"), F.lit(-1).alias("kind"), F.lit(0).alias("part"), "text")
    said = marks.select("doc", "tag", "place", "kind", "part", no.cast("string").alias("text"))
    return rows.union(said).repartition("doc", "tag").sortWithinPartitions("doc", "tag", "place", "kind")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str | None, np.ndarray, np.ndarray, np.ndarray]]:
    """``doc, tag, text``, places, kinds and parts. What is held at once is bounded by one text."""
    for group in sorted_groups(batches, ["doc", "tag"]):
        place = group["place"].to_numpy()
        n = int(np.searchsorted(place, 0))  # 1, or 0 if the text went elsewhere
        if n:
            yield group["doc"][0].as_py(), group["tag"][0].as_py(), group["text"][0].as_py(), place[n:], group["kind"].to_numpy()[n:], group["part"].to_numpy()[n:]


def one_of_each(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``doc, tag, text`` with one row of those that are equal in ``doc`` and ``tag``, and
    ``doc, tag, counts`` of those that were repeated (nothing if none was): how many of them each
    split of the input has. Only keys are counted; of the texts, only repeated ones are shuffled, and
    of those one a split."""
    each = keyed.groupBy("doc", "tag", F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    keys = each.groupBy("doc", "tag").agg(F.collect_list("n").alias("counts"), F.sum("n").alias("n")).where("n > 1").drop("n")
    keys = materialise(keys, "suffix-repeated")
    n = keys.count()
    if not n:
        return keyed, None
    known = broadcast_if(keys.select("doc", "tag"), n, 0)
    some = keyed.join(known, ["doc", "tag"], "left_semi").groupBy("doc", "tag").agg(F.first("text").alias("text"))
    rest = keyed.join(known, ["doc", "tag"], "left_anti")
    return rest.unionByName(materialise(some, "suffix-repeated-texts")), keys


def _strings(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """Step 2's rows: ``rank, part, doc, tag, place`` of the 50-byte strings around open anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = [], 0
        for doc, tag, text, places, _, parts in _texts(batches):
            if not len(places):
                continue
            raw = _raw(text)
            for lo, piece in _pieces(raw):
                r, least, _ = string_ranks(piece)
                here = (places >= lo) & (places < lo + len(r))
                at, part = places[here] - lo, parts[here]
                if not len(at):
                    continue
                # strings whose least rank is that of an open anchor inside
                starts = np.unique((at[:, None] - np.arange(STARTS)).reshape(-1))
                starts = starts[(starts >= 0) & (starts < len(least))]
                order = np.argsort(r[at], kind="stable")
                known, of = r[at][order], part[order]
                found = np.minimum(np.searchsorted(known, least[starts]), len(known) - 1)
                hit = known[found] == least[starts]
                starts, found = starts[hit], found[hit]
                rank = pair(r[starts], r[starts + SIDE])
                out.append((rank.view(np.int64), of[found].astype(np.int32), np.full(len(rank), doc), np.full(len(rank), tag), starts + lo))
                rows += len(rank)
                if rows >= ROWS:
                    yield _batch(out)
                    out, rows = [], 0
        if rows:
            yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["rank", "part", "doc", "tag", "place"])

    return _by_document(docs, open_).mapInArrow(run, "rank bigint, part int, doc bigint, tag bigint, place bigint")


def _later(strings: DataFrame) -> DataFrame:
    """``first, rank, part, doc, tag, place``: strings that an earlier document has, and, of ranks sorted
    in parts, the first ones of each part."""
    keys = ["rank", "part", "doc", "tag", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, part, doc, tag, place = (batch[k].to_numpy() for k in keys)
            new = np.ones(len(rank), bool)
            new[1:] = (rank[1:] != rank[:-1]) | (part[1:] != part[:-1])
            new[0] = (rank[0], part[0]) != group
            starts = np.flatnonzero(new)
            firsts = np.concatenate([[doc[0] if new[0] else first], doc[starts[starts > 0]]])
            of_first = doc == firsts[np.cumsum(new) - int(new[0])]
            keep = ~of_first | (part > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (of_first, rank, part, doc, tag, place)], ["first", *keys])
            group, first = (rank[-1], part[-1]), firsts[-1]

    dealt = strings.repartition("rank", "part").sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "first boolean, rank bigint, part int, doc bigint, tag bigint, place bigint")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc, tag, place, kind, part``: settled anchors (kind 1) and repeated strings (kind 2)."""
    often = frequent(docs)
    anchors = _anchors(docs).join(F.broadcast(often), _rank() == F.col("often"), "left").withColumn("part", _part(F.col("often")))
    step1 = stored(_open_or_settled(anchors), "suffix-26")
    strings = _strings(docs, step1.where("not settled").select("doc", "tag", "place", F.lit(0).alias("kind"), "part"))
    step2 = stored(_later(strings), "suffix-50")
    # at most PARTS documents of a rank here, and several places of each
    firsts = step2.where("first")
    earliest = firsts.groupBy("rank").agg(F.min("doc").alias("least"))
    more = firsts.join(earliest, "rank").where("doc > least")
    found = step2.where("not first").select("doc", "tag", "place").union(more.select("doc", "tag", "place"))
    return step1.where("settled").select("doc", "tag", "place", F.lit(1).alias("kind"), F.lit(0).alias("part")).union(found.select("doc", "tag", "place", F.lit(2).alias("kind"), F.lit(0).alias("part")))


def covered(size: int, places: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which bytes of a text are covered."""
    edge = np.zeros(size + 1, np.int32)
    if size >= LENGTH:
        lo = np.maximum(places - np.where(kinds == 1, SIDE, 0), 0)
        np.add.at(edge, lo, 1)
        np.add.at(edge, np.minimum(places + LENGTH, size), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``. A byte goes if a 50-byte
    string over it also starts in a document of a smaller id; matches never cross documents.

    * null or empty text: no bytes; texts of fewer than 50 bytes: kept;
    * very long texts: worked on in pieces, as a whole in effect;
    * repeated rows and other rows of the same id: not earlier than each other, a result each; rows
      equal in id and text are worked on once, however many they are;
    * null ``doc_id``: later than all others, not earlier than each other;
    * empty table: no rows. Other columns are ignored, whatever their names.
    """
    keyed, repeated = one_of_each(_keyed(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for doc, tag, text, places, kinds, _ in _texts(batches):
            raw = _raw(text)
            gone = covered(len(raw), places, kinds)
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((doc, tag, len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    names, types = ["doc", "tag", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 5 + [pa.string()]
    found = _by_document(keyed, repeated_spans(keyed)).mapInArrow(run, "doc bigint, tag bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    if repeated is not None:  # a row for each of them again
        n = repeated.agg(F.count(F.lit(1)), F.sum(8 * F.size("counts"))).first()
        found = found.join(broadcast_if(repeated, *n), ["doc", "tag"], "left")
        found = found.withColumn("copies", F.explode(F.coalesce("counts", F.array(F.lit(1).cast("bigint"))))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    doc_id = F.when(F.col("doc") != NONE, F.col("doc")).alias("doc_id")
    return found.select(doc_id, *names[2:])
