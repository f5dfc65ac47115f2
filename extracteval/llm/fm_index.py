"""Removal of word sequences that an earlier document has, by compressed indexes of shards.

A window is ``WINDOW`` words in a row. The least hash of any ``SEED`` words inside a window, its *seed*,
is the same wherever the window occurs; consecutive windows of a text with one seed are a *segment*,
about 70 words. Seeds that only one document has are out. The segments of the others are dealt to
shards by seed, so a window meets all its occurrences in one shard and a document is streamed through
the shards that can hold something of it, not through all. Of equal segments a shard gets one, with its
least and greatest document.

A shard is an FM-index over words: the Burrows-Wheeler transform of its segments as a wavelet tree
(stored level by level), the longest common prefixes of neighbouring suffixes, and the least document
of each group of suffixes that share ``WINDOW`` words. Segments are streamed through it from their last
word to their first; each step extends the match by one word through ranks in the wavelet tree, or
falls back to the parent interval, which gives matching statistics: the longest match at every word.
Where it reaches ``WINDOW`` and the least document of the interval is earlier, the window is repeated.

A seed with more than ``PART`` segments is split into parts of a shard's size. What a part finds about
its windows is then put together by the windows' digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import sorted_groups
from .shingles import mix
from .storing import stored

WINDOW, SEED = 50, 8
RUN = 64  # windows of a segment at most
PART = 4096  # segments of a part of a seed, by hash
SHARD = 1 << 19  # words of a shard, about
PIECE = 1 << 20  # bytes of a text that are hashed at once
BATCH = 1 << 21  # bytes of segments that are streamed at once
ROWS = 1 << 14
NONE = (1 << 63) - 1  # stands for a null doc_id: later than all others

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


# ---- words, seeds and segments of a text ----


def raw(text: str | None) -> np.ndarray:
    return np.frombuffer(b"" if text is None else text.encode("utf-8", "surrogatepass"), np.uint8)


def word_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end, in bytes."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, PIECE + 1), _powers(_INVERSE, PIECE + 1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word: of its bytes and length, whatever stands around it."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(int(np.searchsorted(end, start[lo] + PIECE, "right")), lo + 1)
        a, z = int(start[lo]), int(end[hi - 1])
        if z - a > PIECE:  # one long word
            out[lo] = xxhash.xxh64_intdigest(data[a:z].tobytes())
        else:
            sums = np.zeros(z - a + 1, np.uint64)
            np.cumsum((data[a:z].astype(np.uint64) + np.uint64(1)) * _UP[: z - a], out=sums[1:])
            s, e = start[lo:hi] - a, end[lo:hi] - a
            out[lo:hi] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def segments(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, first window and number of windows of each segment of a text."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(hashes) - SEED + 1
    grams = np.zeros(n, np.uint64)
    for i in range(SEED):
        grams = grams * _BASE + hashes[i : n + i]
    seeds = _least(mix(grams), WINDOW - SEED + 1)
    change = np.ones(len(seeds), bool)
    change[1:] = seeds[1:] != seeds[:-1]
    begin = np.flatnonzero(change)
    size = np.diff(begin, append=len(seeds))
    pieces = -(-size // RUN)
    if (pieces > 1).any():
        of = np.repeat(np.arange(len(begin)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(size[of] - nth * RUN, RUN)
        begin = begin[of] + nth * RUN
    return seeds[begin], begin, size


# ---- the index of a shard ----


class Wavelet:
    """A sequence of symbols as one bit vector for each bit of theirs, highest first; at each level
    zeros stand before ones. ``ranks`` costs two counts a level, whatever the alphabet."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.bits = max(int(kinds - 1).bit_length(), 1)
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for b in range(self.bits - 1, -1, -1):
            one = (now >> b) & 1 == 1
            words = np.packbits(np.pad(one, (0, -len(one) % 64 + 64)), bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(one) - one.sum()))
            now = np.concatenate([now[~one], now[one]])

    def trace(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the next ``symbols`` at or after a place stand in the last level."""
        for b, words, counts, zeros in zip(range(self.bits - 1, -1, -1), self.words, self.counts, self.zeros):
            word = at >> 6
            ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbols >> b) & 1 == 1, zeros + ones, at - ones)
        return at


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted suffixes, by prefix doubling, and the ranks of 1, 2, 4, ... symbols. No two suffixes
    may be equal before the first symbol that occurs only once."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        sorted_ = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        if rank[order[-1]] == n - 1:
            return order, ranks
        ranks.append(rank)
        step *= 2


class FMIndex:
    """Texts of symbols 1, 2, ... below ``kinds``, each with a document. Answers where the longest match
    at each place of a pattern is, up to ``depth`` symbols, and the least document that has it."""

    def __init__(self, texts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, kinds: int, depth: int = WINDOW) -> None:
        count, n = len(lengths), int(lengths.sum()) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        body = np.ones(n, bool)
        body[ends] = False
        symbols = np.zeros(n, np.int64)
        symbols[body] = texts
        # every text ends in a sign of its own, so suffixes differ at the latest there
        unique = symbols + count
        unique[ends] = np.arange(count)
        order, ranks = suffixes(unique)
        common = np.zeros(n, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            a, b = order[:-1] + common[1:], order[1:] + common[1:]
            inside = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            common[1:] += same.astype(np.int64) << k
        self.depth, self.kinds, self.n = depth, kinds, n
        transform = symbols[order - 1]
        self.tree = Wavelet(transform, kinds)
        first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=kinds))])[:kinds]
        self.offset = first - self.tree.trace(np.arange(kinds), np.zeros(kinds, np.int64))
        # suffixes that share depth symbols are a group
        common = np.minimum(common, depth).astype(np.uint8)
        new = common < depth
        self.group = (np.cumsum(new) - 1).astype(np.int32)
        self.starts = np.append(np.flatnonzero(new), n)
        self.least = np.minimum.reduceat(np.repeat(docs, lengths + 1)[order], self.starts[:-1])
        # least common prefix of 1, 2, 4, ... neighbours, for parent intervals
        self.levels = [np.append(common, 0).astype(np.uint8)]
        while 2 << (len(self.levels) - 1) <= n + 1:
            x, k = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[:-k], x[k:]))

    def _parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger interval around each, and its depth."""
        base = self.levels[0]
        depth = np.maximum(base[lo], base[hi])
        for k in range(len(self.levels) - 1, -1, -1):
            level, width = self.levels[k], 1 << k
            # to the left over suffixes that share the depth with the next
            at = np.maximum(lo - width + 1, 0)
            go = (lo - width + 1 >= 0) & (level[np.minimum(at, len(level) - 1)] >= depth) & (depth > 0)
            lo = np.where(go, lo - width, lo)
            go = (hi + width <= self.n) & (level[np.minimum(hi, len(level) - 1)] >= depth) & (depth > 0)
            hi = np.where(go, hi + width, hi)
        return np.where(depth > 0, lo, 0), np.where(depth > 0, hi, self.n), depth.astype(np.int64)

    def match(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of each pattern (their symbols one after another; 0 for a symbol that no text
        has): the length of the longest match, ``depth`` at most, and the least document where it is
        that long, NONE elsewhere."""
        statistics = np.zeros(len(patterns), np.int64)
        least = np.full(len(patterns), NONE, np.int64)
        by = np.argsort(-lengths, kind="stable")
        ends, sizes = np.cumsum(lengths)[by], lengths[by]
        lo, hi, long = np.zeros(len(by), np.int64), np.full(len(by), self.n, np.int64), np.zeros(len(by), np.int64)
        for j in range(1, int(lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -j, "right"))  # patterns that are so long
            lo, hi, long = lo[:live], hi[:live], long[:live]
            at = ends[:live] - j
            symbol = patterns[at]
            todo = np.arange(live)
            while len(todo):
                c = symbol[todo]
                both = self.tree.trace(np.concatenate([c, c]), np.concatenate([lo[todo], hi[todo]])) + np.tile(self.offset[c], 2)
                new_lo, new_hi = both[: len(todo)], both[len(todo) :]
                good = (new_lo < new_hi) & (c > 0)
                done = todo[good]
                lo[done], hi[done] = new_lo[good], new_hi[good]
                long[done] += 1
                todo = todo[~good]
                lost = (long[todo] == 0) | (symbol[todo] == 0)
                gone = todo[lost]
                lo[gone], hi[gone], long[gone] = 0, self.n, 0
                todo = todo[~lost]
                if len(todo):
                    lo[todo], hi[todo], long[todo] = self._parent(lo[todo], hi[todo])
            full = np.flatnonzero(long >= self.depth)
            group = self.group[lo[full]]
            lo[full], hi[full], long[full] = self.starts[group], self.starts[group + 1], self.depth
            statistics[at] = long
            least[at[full]] = self.least[group]
        return statistics, least


class _Names(dict):
    """Words by their bytes, as symbols from 1."""

    def __missing__(self, word: bytes) -> int:
        symbol = self[word] = len(self) + 1
        return symbol


class Shard:
    """An index over segments as bytes. Words are told apart by their bytes."""

    def __init__(self, texts: list[bytes], docs: list[int]) -> None:
        words, lengths = _words(texts)
        self.names = _Names()
        symbols = np.fromiter(map(self.names.__getitem__, words), np.int64, len(words))
        self.index = FMIndex(symbols, lengths, np.array(docs, np.int64), len(self.names) + 1)

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The least document of each window of each segment, and how many windows each has."""
        words, lengths = _words(texts)
        statistics, least = self.index.match(np.fromiter(map(self.names.get, words, repeat(0)), np.int64, len(words)), lengths)
        ends = np.cumsum(lengths)
        window = np.ones(len(statistics), bool)
        for i in range(1, WINDOW):
            window[ends - i] = False
        least = np.where(statistics >= WINDOW, least, NONE)
        return least[window], lengths - WINDOW + 1


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of texts in which one space stands between words, and how many each has."""
    return b" ".join(texts).split(), np.array([t.count(b" ") + 1 for t in texts], np.int64)


# ---- tables ----


def _keyed(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NONE))
    return docs.select(doc.alias("doc"), F.xxhash64("text").alias("tag"), "text")


def _texts(docs: DataFrame) -> DataFrame:
    """``doc, tag, text, times``: repeated rows once. Different texts of one id share a tag, 64 bits of
    a hash, with a probability of 2^-64."""
    return docs.groupBy("doc", "tag").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))


def _seeds(docs: DataFrame) -> DataFrame:
    """``seed, doc, tag``: the seeds of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = [], 0
            for doc, tag, text in zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["text"]):
                data = raw(text.as_py())
                seeds = np.unique(segments(word_hashes(data, *word_ends(data)))[0]).view(np.int64)
                out.append((seeds, np.full(len(seeds), doc), np.full(len(seeds), tag)))
                rows += len(seeds)
                if rows >= ROWS:
                    yield _batch(out)
                    out, rows = [], 0
            if rows:
                yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["seed", "doc", "tag"])

    return docs.mapInArrow(run, "seed bigint, doc bigint, tag bigint")


_SEGMENT = "seed bigint, part int, segment binary, words binary, doc bigint, tag bigint, first int"


def _segments(texts: DataFrame) -> DataFrame:
    """The segments of ``seeds`` (structs of seed and parts) of each text: ``seed, part, segment, words,
    doc, tag, first``. ``segment`` is a digest of 128 bits of the words, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            wanted_seeds = batch["seeds"]
            for i, (doc, tag, text) in enumerate(zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["text"])):
                parts = {np.uint64(x["seed"] & 0xFFFFFFFFFFFFFFFF): x["parts"] for x in wanted_seeds[i].as_py()}
                data = raw(text.as_py())
                start, end = word_ends(data)
                seeds, first, size = segments(word_hashes(data, start, end))
                wanted = np.flatnonzero(np.isin(seeds, np.fromiter(parts, np.uint64)))
                whole = data.tobytes()
                for seed, a, n in zip(seeds[wanted].tolist(), first[wanted].tolist(), size[wanted].tolist()):
                    words = b" ".join(whole[start[a] : end[a + n + WINDOW - 2]].split())
                    digest = xxhash.xxh3_128_digest(words)
                    part = int.from_bytes(digest[:4], "little") % parts[np.uint64(seed)] if parts[np.uint64(seed)] > 1 else -1
                    out.append((seed - (1 << 64) if seed >> 63 else seed, part, digest, words, doc, tag, a))
                    held += len(words)
                    if held >= BATCH:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], [x.split()[0] for x in _SEGMENT.split(", ")])

    return texts.mapInArrow(run, _SEGMENT)


_FOUND = "segment binary, low int, high int, doc bigint, window binary"


def _search(dealt: DataFrame) -> DataFrame:
    """Indexes each shard and streams its segments through it: runs of windows ``low`` to ``high`` (not
    included) of a segment that an earlier ``doc`` has. For segments of a split seed, every window with
    its digest and its least document in this part."""
    columns = ["shard", "segment", "words", "doc", "latest", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in sorted_groups(batches, ["shard"]):
            texts, docs = shard["words"].to_pylist(), shard["doc"].to_pylist()
            index = Shard(texts, docs)
            names, latest, parts = shard["segment"].to_pylist(), shard["latest"].to_pylist(), shard["part"].to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and size < BATCH:
                    size += len(texts[hi])
                    hi += 1
                yield from _found(index, names[lo:hi], texts[lo:hi], latest[lo:hi], parts[lo:hi])
                lo = hi

    def _found(index: Shard, names: list[bytes], texts: list[bytes], latest: list[int], parts: list[int]) -> Iterator[pa.RecordBatch]:
        least, windows = index.search(texts)
        starts = np.cumsum(windows) - windows
        out = []
        change = np.ones(len(least), bool)
        change[1:] = least[1:] != least[:-1]
        change[starts] = True
        change[np.repeat(np.array(parts) >= 0, windows)] = True  # each window by itself
        begin = np.flatnonzero(change)
        size = np.diff(begin, append=len(least))
        of = np.searchsorted(starts, begin, "right") - 1
        last, words = -1, []
        for i, a, n, doc in zip(of.tolist(), (begin - starts[of]).tolist(), size.tolist(), least[begin].tolist()):
            digest = None
            if parts[i] >= 0:
                if i != last:
                    last, words = i, texts[i].split()
                digest = xxhash.xxh3_128_digest(b" ".join(words[a : a + WINDOW]))
            elif doc >= latest[i]:
                continue
            out.append((names[i], a, a + n, doc, digest))
        if out:
            types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], [x.split()[0] for x in _FOUND.split(", ")])

    return dealt.select(*columns).sortWithinPartitions("shard", "segment").mapInArrow(run, _FOUND)


def repeated_windows(docs: DataFrame, part: int = PART, shard: int = SHARD) -> DataFrame:
    """``doc, tag, low, high``: runs of windows of a document that an earlier one has."""
    seeds = stored(_seeds(docs), "fm-seeds")
    shared = seeds.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z")
    wanted = seeds.join(shared.select("seed", F.ceil(F.col("n") / part).cast("int").alias("parts")), "seed").groupBy("doc", "tag").agg(F.collect_set(F.struct("seed", "parts")).alias("seeds"))
    rows = stored(_segments(_texts(docs).join(wanted, ["doc", "tag"])), "fm-segments")
    distinct = rows.groupBy("seed", "part", "segment").agg(F.first("words").alias("words"), F.min("doc").alias("doc"), F.max("doc").alias("latest"))
    distinct = stored(distinct, "fm-distinct")
    size = distinct.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, size // (6 * shard))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("seed", "part"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    found = stored(_search(dealt), "fm-found")
    split = found.where("window is not null")
    least = split.groupBy("window").agg(F.min("doc").alias("doc"))
    whole = found.where("window is null").select("segment", "low", "high", "doc").union(split.select("segment", "low", "high", "window").join(least, "window").select("segment", "low", "high", "doc"))
    places = rows.select("segment", F.col("doc").alias("later"), "tag", "first")
    return places.join(whole, "segment").where("doc < later").select(F.col("later").alias("doc"), "tag", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))


def remove_repeats(docs: DataFrame, part: int = PART, shard: int = SHARD) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256, n_windows`` (windows that an earlier
    document has). A word goes if a window over it also starts in a document of a smaller id.

    * null or empty text: no words; texts of fewer than 50 words: kept;
    * very long texts: hashed in pieces, whole in effect;
    * repeated rows and other rows of the same id: not earlier than each other, a result each;
    * null ``doc_id``: later than all others, not earlier than each other;
    * empty table: no rows. Other columns are ignored, whatever their names.
    """
    keyed = _keyed(docs)
    spans = repeated_windows(keyed, part, shard).groupBy("doc", "tag").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, times, text, runs in zip(batch["doc"].to_pylist(), batch["times"].to_pylist(), batch["text"], batch["spans"]):
                data = raw(text.as_py())
                whole = data.tobytes()
                start, end = word_ends(data)
                gone, windows = np.zeros(len(start), bool), 0
                if runs.is_valid:
                    a, z = (runs.values.field(i).to_numpy() for i in (0, 1))
                    edge = np.zeros(len(start) + 1, np.int32)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, z + WINDOW - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    windows = int((z - a).sum())
                kept = np.flatnonzero(~gone)
                digest = hashlib.sha256()
                if len(kept):
                    # words side by side are one piece of the text, but for its white space
                    cut = np.flatnonzero(np.diff(kept) > 1)
                    for n, (p, q) in enumerate(zip(kept[np.append(0, cut + 1)].tolist(), kept[np.append(cut, len(kept) - 1)].tolist())):
                        digest.update((b" " if n else b"") + b" ".join(whole[start[p] : end[q]].split()))
                out.append((None if doc == NONE else doc, len(start), int(gone.sum()), digest.hexdigest(), windows, times))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    names, types = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_windows", "times"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    rows = _texts(keyed).join(spans, ["doc", "tag"], "left").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_windows bigint, times bigint")
    return rows.selectExpr("doc_id", "n_words", "n_removed", "kept_sha256", "n_windows", "explode(sequence(1L, times)) as _time").drop("_time")
