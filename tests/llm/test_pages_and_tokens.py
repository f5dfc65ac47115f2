import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from extracteval.llm import token_counts, token_files, warc

TEXTS = ["Hello, world. Hello world", None, "", "x\x1cy \x85z \xa0q w", "foo<|endoftext|>bar <|ENDOFTEXT|> Word WORD. Été", "ΣΑΣ ΟΔΟΣ", "don't WE'LL 'S\n\t12345 ½",
         "İstanbul ﬁ ́ ́x", "日本語 テキスト", "\x0b\x0c a\x00b \x00", "e ́", "🙂👍🏽", "word " * 20000, "a" * 5000, "Hello, world. Hello world"]


# ---- WARC ----


def test_archive_round_trip(spark, folder):
    rows = [(5, "http://a", "<p>one</p>"), (3, "http://b%0A\r\nx", "<p>one</p>"), (9, None, None), (8, "u", ""), (7, "é", "ü" * 100_000), (None, "n", "<p>one</p>"),
            (None, "m", "alone"), (3, "http://b%0A\r\nx", "<p>one</p>"), (11, "c", "<p>one</p>\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, url string, html string, n int, sha1 string")
    got = warc.archive(pages, folder()).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and (i is None or i > f)
        want.append((i, u, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)


def test_least_bytes_and_empty(spark, folder):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long text"), (4, "d", "long text")], "page_id bigint, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive(pages, folder(), least_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archive(pages.limit(0), folder()).collect() == []


def test_records_stand_alone():
    records = [warc.build_record(i, f"http://x/{i}", f"<html>page {i} of many alike</html>".encode() * 20, "D", 1, None) for i in range(300)]
    data = warc.build_archive(records)
    assert list(warc.read_archive(data)) == records and len(data) < sum(map(len, records)) / 8
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    assert list(warc.read_archive(warc.build_archive([b"a"]))) == [b"a"]
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\0" * 16))


# ---- tokens ----


def test_counts_match_the_library_and_fill_the_cache(spark, documents, folder):
    import sentencepiece

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), folder()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)]
    want = sorted(((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows), key=str)
    for _ in range(2):  # the second time from the cache
        got = token_counts.token_counts(documents(rows), path, cache).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
        assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})
    token_counts.token_counts(documents([(1, "new text")]), path, cache).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS}) + 1
    assert token_counts.token_counts(documents([]), path, folder()).collect() == []


def test_only_misses_are_encoded(spark, documents, folder):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), folder()
    text = spark.createDataFrame([("known",)], "text string").selectExpr("sha2(text, 256) AS content", f"'{token_counts.version(path)}' AS version", "77L AS n_tokens")
    text.write.parquet(cache)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents([(1, "known"), (2, "other")]), path, cache).collect()}
    assert got[1] == 77 and got[2] != 77


def test_word_ids_are_the_whole_texts_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)
    encoder = token_files.WordIds(path)
    for _ in range(2):
        assert encoder.texts(TEXTS) == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_words_with_signs_need_few_calls(monkeypatch):
    path, calls, ids = public_tokenizers.path("word_bpe_49k.json"), [], token_files.WordIds._ids
    monkeypatch.setattr(token_files.WordIds, "_ids", staticmethod(lambda text, tokenizer: calls.append(text) or ids(text, tokenizer)))
    letters, signs = "abcdefghijklmnopqrst", [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "%%%", "...$", "'-", "|>"]
    words = [a + b + c + signs[i % len(signs)] for i, (a, b, c) in enumerate(itertools.product(letters, repeat=3))]
    gaps = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\r\n ", "\u00a0", "\u2003", "\x1c"]
    texts = [" " + "".join(w + gaps[i % len(gaps)] for i, w in enumerate(words)), *words[:200], " ", "a's b'", "x<|endoftext|>Y.. "]
    encoder = token_files.WordIds(path)
    got = encoder.texts(texts)
    # each of 8,000 words was a call
    assert len(calls) < 100
    assert got == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_latin_words_are_taken_from_arrow_whatever_stands_by_them():
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    encoder, whole = token_files.WordIds(path), Tokenizer.from_file(path)
    ids = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    word = lambda: "".join(rng.choices("abcdeABCßäöüÄÖÜéÉçñÿÞÀ", k=rng.randint(2, 9))) + rng.choice(["", "", ".", ",%%%", "'", "<|", "'s"])
    texts = [" ".join(word() for _ in range(50)) for _ in range(200)]
    assert encoder.texts(texts) == ids(texts)
    plain = [t.replace("'s", "") for t in texts]
    encoder.clear()
    assert encoder.texts(plain) == ids(plain)
    # each of thousands of words was looked up and kept as an object
    assert len(encoder) < 10
    odd = ["".join(rng.choices("abzABZßéÉÿ×÷ªºµŸİıſǅΣς日яЯ'-.<|>1\u0301\u0308\u00a0 ", k=rng.randint(1, 12))) for _ in range(5000)] + ["a<|endoftext|>B", "<|ENDOFTEXT|> É", ""]
    assert encoder.texts(odd) == ids(odd)
    encoder.last[:] = False  # as for a model that marks no ends of words
    assert encoder.texts(texts[:20]) == ids(texts[:20])


def test_runs_of_texts_are_bounded_by_bytes():
    texts = pa.array(["abc", None, "é" * 9, "", "ab", "abc", "abc", None])
    assert list(token_files.runs(texts, 6)) == [(0, 2), (2, 1), (3, 3), (6, 2)]
    assert list(token_files.runs(texts.slice(3), 100)) == [(0, 5)] and list(token_files.runs(texts[:0], 6)) == []


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("percentile", [0.5, 0.9, 1.0])
def test_blocks_round_trip(n, percentile):
    rng = np.random.default_rng(n)
    for ids in ((rng.zipf(1.2, n) % 49408).astype(np.uint32), rng.integers(0, 2**32, n, np.uint32), np.full(n, 7, np.uint32)):
        starts, area = token_files.encode_blocks(ids, percentile)
        assert (token_files.decode_blocks(starts, area, n) == ids).all() and len(starts) == -(-n // 128)


def test_files_hold_every_document(documents, folder, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i * 3 % 17, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (4, "again"), (4, "again")]
    got = token_files.token_files(documents(rows), path, folder()).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(path)
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((d, len(ids(t)) // 4, zlib.crc32(ids(t))) for d, t in rows), key=str)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is None, d or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert token_files.token_files(documents([]), path, folder()).collect() == []


def test_word_ids_with_combining_marks():
    rng = random.Random(8)
    path = public_tokenizers.path("word_bpe_49k.json")
    letters = [*"JHTWYAEaejhtwy xé", *(chr(c) for c in (0x300, 0x301, 0x308, 0x30A, 0x30C, 0x327, 0x331, 0x591, 0x1EA1, 0x212B))]
    texts = ["J̌abc", "H̱", "T̈ x", "W̊", "Y̊"] + ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(20_000)]
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert token_files.WordIds(path).texts(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_many_rows_without_an_id_are_several_tasks(spark, documents, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, f"w{i}") for i in range(300)] + [(None, f"n{i}") for i in range(100)] + [(None, "same")] * 200
    # as much text as makes more than one range
    docs = documents(rows).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = token_files.token_files(docs, path, folder()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 600 and len({r.file for r in got if r.doc_id is None}) > 1
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
