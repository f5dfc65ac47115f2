"""Token ids as binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, in ascending ``doc_id`` order over all files by name:

    8 bytes   magic ``PFORIDS1``
    4 x u64   documents, ids, blocks, bytes of the block area
    documents: i64 doc_id, u8 is it null, u64 place of its end among the file's ids
    blocks:    u64 start in the block area
    block area, a block of 128 ids (the last may have fewer):
        u32 minimum, u8 width, u8 number of exceptions,
        ``width`` planes of 128 bits, the lowest bits of all values first: id - minimum, or 0
        for an exception,
        exceptions: u8 place, u32 id - minimum

The width is that of the value at a percentile of the block, so a few large ids don't widen it. All
numbers are little-endian; a block is found by its start and needs no other block.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise
from .files import put

MAGIC, BLOCK = b"PFORIDS1", 128
FILE_IDS = 1 << 21  # ids after which a file ends with the document
TEXT_BYTES = 1 << 23  # of the documents whose words are in memory at once; a longer one is alone
MEMO, MEMO_BYTES = 1 << 18, 64  # words a worker remembers the ids of, and their length at most
LINE_WORDS = 512  # words the library encodes in one call, or in one of its texts
LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"  # letters that nothing is put together with, and whose small letters are single

_HEAD = np.dtype([("min", "<u4"), ("width", "u1"), ("n", "u1")])
_EXCEPTION = np.dtype([("at", "u1"), ("value", "<u4")])


# ---- blocks ----


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, bytes]:
    """The blocks' starts, and the block area."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.empty(0, np.uint64), b""
    grid = np.full(n * BLOCK, ids[-1], np.uint32)  # the last block is filled up with its last id
    grid[: len(ids)] = ids
    grid = grid.reshape(n, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    if not rest.max() >> 16:  # less to move about
        rest = rest.astype(np.uint16)
    at = np.partition(rest, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))]
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    patched = rest > ((1 << width.astype(np.int64)) - 1)[:, None].astype(rest.dtype)
    packed: list[bytes] = [b""] * n
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            values = np.where(patched[rows], 0, rest[rows]).astype(np.uint16 if w <= 16 else np.uint32)
            planes = [np.packbits((values >> values.dtype.type(i)) & values.dtype.type(1), axis=1, bitorder="little") for i in range(w)]
            raw, size = np.concatenate(planes, axis=1).tobytes(), BLOCK // 8 * int(w)
            for i, r in enumerate(rows.tolist()):
                packed[r] = raw[i * size : (i + 1) * size]
    counts = patched.sum(axis=1)
    head = np.empty(n, _HEAD)
    head["min"], head["width"], head["n"] = low, width, counts
    where = np.nonzero(patched)
    exceptions = np.empty(len(where[0]), _EXCEPTION)
    exceptions["at"], exceptions["value"] = where[1], rest[where]
    ends = np.cumsum(counts)
    heads, patches, size, k = head.tobytes(), exceptions.tobytes(), _HEAD.itemsize, _EXCEPTION.itemsize
    area = [heads[i * size : (i + 1) * size] + packed[i] + patches[a * k : b * k] for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist()))]
    return np.cumsum([0, *map(len, area[:-1])]).astype("<u8"), b"".join(area)


def decode_blocks(starts: np.ndarray, area: bytes, count: int) -> np.ndarray:
    """The ids of all blocks."""
    n = len(starts)
    raw = np.frombuffer(area, np.uint8)
    heads = np.frombuffer(raw[starts[:, None] + np.arange(_HEAD.itemsize, dtype=np.uint64)].tobytes(), _HEAD) if n else np.empty(0, _HEAD)
    out = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(heads["width"]):
        rows = np.flatnonzero(heads["width"] == w)
        if w:
            size = BLOCK // 8 * int(w)
            data = raw[starts[rows][:, None] + np.arange(_HEAD.itemsize, _HEAD.itemsize + size, dtype=np.uint64)]
            planes = np.unpackbits(data, axis=1, bitorder="little").reshape(len(rows), int(w), BLOCK)
            values = np.zeros((len(rows), BLOCK), np.uint16 if w <= 16 else np.uint32)
            for i in range(w):
                values |= planes[:, i].astype(values.dtype) << values.dtype.type(i)
            out[rows] = values
    # all exceptions at once: where each lies is its block's first place plus its number in it
    counts = heads["n"].astype(np.int64)
    block = np.repeat(np.arange(n), counts)
    first = starts.astype(np.int64) + _HEAD.itemsize + BLOCK // 8 * heads["width"].astype(np.int64)
    number = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    where = first[block] + number * _EXCEPTION.itemsize
    e = np.frombuffer(raw[where[:, None] + np.arange(_EXCEPTION.itemsize)].tobytes(), _EXCEPTION)
    out[block, e["at"]] = e["value"]
    return (out + heads["min"][:, None]).reshape(-1)[:count]


# ---- files ----


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, percentile: float = 0.9) -> bytes:
    starts, area = encode_blocks(ids, percentile)
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(ids), len(starts), len(area)], "<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.cumsum(lengths).astype("<u8").tobytes() if lengths else b"", starts.astype("<u8").tobytes(), area,
    ])


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents' ids, the ends of their token ids, all token ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, count, blocks, size = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
    at = 40
    numbers = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    ends = np.frombuffer(data, "<u8", docs, at + 9 * docs)
    starts = np.frombuffer(data, "<u8", blocks, at + 17 * docs)
    area = data[at + 17 * docs + 8 * blocks :][:size]
    return [None if z else int(d) for d, z in zip(numbers, null)], ends, decode_blocks(starts, area, count)


# ---- encoding ----


def _small_letters(s: str) -> bool:
    return s.isalpha() and s == s.lower() and is_normalized("NFC", s)


def _lower(raw: bytes) -> bytes:
    """A text in small letters where that changes no id. The tokenizer lower-cases too, but for its
    special strings, and after it has put letters and marks together: a capital with a mark of U+0300
    to U+036F (bytes CC and CD) may be put together otherwise than the small letter."""
    if b"<|" in raw:
        return raw
    if b"\xcc" in raw or b"\xcd" in raw:
        return b" ".join([w if b"\xcc" in w or b"\xcd" in w else w.lower() for w in raw.split()])
    return raw.lower()


class WordIds(dict):
    """Ids of the words of a text, as bytes of little-endian 32-bit numbers.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its
    words, one after another. The library encodes each word; repeated words are remembered."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)

        # for words of small letters the tokenizer's rewriting and splitting change nothing
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # the last id of a word is marked, where the model marks it
        vocab, mark = self.plain.get_vocab(), getattr(self.plain.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for word, i in vocab.items() if mark and word.endswith(mark)]] = True

    @staticmethod
    def _ids(text: str, tokenizer) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of words of small letters, many at once."""
        cuts = pa.array(np.append(np.arange(0, len(words), LINE_WORDS), len(words)), pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(cuts, words), pa.scalar(" ", words.type)).to_pylist()
        ids = [np.empty(0, "<u4")]
        for lo in range(0, len(lines), 32):
            ids += [np.array(e.ids, "<u4") for e in self.plain.encode_batch_fast(lines[lo : lo + 32], add_special_tokens=False)]
        flat = np.concatenate(ids)
        sizes = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        if len(sizes) == len(words) and sizes.sum() == len(flat):
            return flat, sizes
        each = [self._ids(w, self.tokenizer) for w in words.to_pylist()]
        return np.concatenate([np.empty(0, "<u4"), *each]), np.array([len(e) for e in each], np.int64)

    def _learn(self, words: list[bytes]) -> None:
        letters = [w for w in words if not w.isascii() and _small_letters(w.decode("utf-8", "replace"))]
        flat, sizes = self._letters(pa.array(letters, pa.large_binary()).view(pa.large_string()))
        raw, ends = flat.tobytes(), (4 * np.cumsum(sizes)).tolist()
        self.update(zip(letters, (raw[a:b] for a, b in zip([0, *ends], ends))))
        rest = [w for w in words if w not in self]
        for lo in range(0, len(rest), LINE_WORDS):
            some = rest[lo : lo + LINE_WORDS]
            encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)
            self.update(zip(some, (np.array(e.ids, "<u4").tobytes() for e in encoded)))

    def _known(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of any words, remembered."""
        if len(self) > MEMO:
            self.clear()
        found = list(map(self.get, words))
        missing = [i for i, f in enumerate(found) if f is None]
        new = [words[i] for i in missing]
        self._learn(new)
        for i, w in zip(missing, new):
            found[i] = self[w]
        for w in new:
            if len(w) > MEMO_BYTES:
                self.pop(w, None)
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of distinct words. Words of Latin letters are taken apart into letters
        and the signs after them, as the tokenizer does, and their letters encoded once; the others are
        remembered."""
        core = pc.ascii_rtrim(words, punctuation)
        latin = pc.match_substring_regex(core, f"^{LATIN}$")
        letters = pc.utf8_lower(core.filter(latin)).dictionary_encode()
        signs = pc.replace_substring_regex(words.filter(latin), f"^{LATIN}", "", max_replacements=1).dictionary_encode()
        raw = lambda a: a.view(pa.large_binary()).to_pylist()
        kinds = [self._letters(letters.dictionary), self._known(raw(signs.dictionary)), self._known(raw(words.filter(pc.invert(latin))))]
        flat = np.concatenate([ids for ids, _ in kinds])
        start = np.cumsum([0, *(len(ids) for ids, _ in kinds)])
        place = [at + np.cumsum(sizes) - sizes for at, (_, sizes) in zip(start, kinds)]
        # two pieces a word
        at, size, here = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64), latin.to_numpy(zero_copy_only=False)
        for piece, rows, kind, number in ((0, here, 0, letters.indices.to_numpy()), (1, here, 1, signs.indices.to_numpy()), (0, ~here, 2, slice(None))):
            at[rows, piece], size[rows, piece] = place[kind][number], kinds[kind][1][number]
        return _taken(flat, at.reshape(-1), size.reshape(-1)), size.sum(axis=1)

    def texts(self, texts: list[str | None]) -> list[bytes]:
        raw = pa.array([_lower(b"" if t is None else t.encode("utf-8", "surrogatepass")) for t in texts], pa.large_binary())
        words = pc.ascii_split_whitespace(raw.view(pa.large_string()))
        numbered = words.flatten().dictionary_encode()
        known, size = self._distinct(numbered.dictionary)
        word = numbered.indices.to_numpy()
        sizes = size[word]
        ids = _taken(known, (np.cumsum(size) - size)[word], sizes).tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(sizes)])[words.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def _taken(ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of ``ids``, from these places and of these sizes, one after another."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Start and number of texts in a row that have at most so many bytes together, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(int(np.searchsorted(ends, most + (ends[lo - 1] if lo else 0), "right")), lo + 1)
        yield lo, hi - lo
        lo = hi


_ENCODERS: dict[str, WordIds] = {}


def write_token_files(docs: DataFrame, path: str, folder: str, end: int = 2, percentile: float = 0.9) -> DataFrame:
    """Write the ids of all texts, each followed by ``end``; returns ``file, n_docs, n_ids`` of the
    files written, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordIds(path))
        task, tail = TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        doc_ids, parts, held, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{task:06d}-{number:06d}.pfor"
            ids = np.frombuffer(b"".join(parts), "<u4")
            put(folder, name, file_bytes(doc_ids, [len(p) // 4 for p in parts], ids, percentile))
            return pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(parts)], "n_ids": [len(ids)]})

        for batch in batches:
            for lo, n in runs(batch["text"], TEXT_BYTES):
                part = batch.slice(lo, n)
                for doc_id, data in zip(part["doc_id"].to_pylist(), encoder.texts(part["text"].to_pylist())):
                    doc_ids.append(doc_id)
                    parts.append(data + tail)
                    held += len(parts[-1]) // 4
                    if held >= FILE_IDS:
                        yield flush()
                        doc_ids, parts, held, number = [], [], 0, number + 1
        if parts:
            yield flush()

    # equal ids are ordered by their text, so a task that is run again writes the same files; ranges
    # end inside them as well, and inside equal rows, so many rows of one id, or none, are several tasks
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), "hash", "row"]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialise(ordered.mapInArrow(run, "file string, n_docs bigint, n_ids bigint"), "token-files")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and ``file``, read from the files' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["file"].to_pylist(), batch["content"]):
                doc_ids, ends, ids = read_file(data.as_py())
                raw, starts = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(ends.astype(np.int64) - starts), pa.array(crc, pa.int64())],
                    ["file", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spark = manifest.sparkSession
    schema = "file string, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)
    # a row per file: the ids of all files before it
    before = manifest.select("file", (F.sum("n_ids").over(W.orderBy("file")) - F.col("n_ids")).alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file")


def token_files(docs: DataFrame, path: str, folder: str, end: int = 2) -> DataFrame:
    """Write the files into ``folder``, new for this call, and read them back: per document
    ``doc_id, start, n_tokens, ids_crc32, file``.

    * null or empty text: the end id only; very long texts: encoded whole;
    * ties and repeated rows: a document each, equal ids in the order of their texts' hash;
    * null ``doc_id``: after all others; empty table: no files, no rows;
    * other columns are ignored, whatever their names.
    """
    return read_token_files(write_token_files(docs, path, folder, end), folder)
