import hashlib
import random

import numpy as np
import pytest

from extracteval.llm import fm_index


def brute(rows):
    late = lambda d: float("inf") if d is None else d
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first, out = {}, []
    for d, w in texts:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, late(d)), late(d))
    for d, w in texts:
        gone, windows = [False] * len(w), 0
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < late(d):
                gone[i : i + 50] = [True] * 50
                windows += 1
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), windows))
    return sorted(out, key=str)


def passages(seed, docs=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(5)]
    rows = []
    for d in range(docs):
        text = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            a = rng.randint(0, 149)
            text += x[a : rng.randint(a, 150)] + [rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append((d * 7 % 131, rng.choice([" ", "\n", "\t \x0b"]).join(text)))
    one = "same " * 3000
    edge = ["", None, " \n ", one, one + "end", "same " * 49, "same " * 50, "a b " * 400, "a b " * 300, "b a " * 60, "x" * 3000 + " " + "y " * 60, "x" * 3000 + " " + "y " * 55, " " * 80]
    return rows + [(300 + i, t) for i, t in enumerate(edge)] + [rows[5], (rows[6][0], " ".join(base[0])), *[(None, " ".join(base[1]))] * 3, (None, None), (None, None)]


@pytest.mark.parametrize("part", [fm_index.PART, 3])
def test_matches_brute_force(spark, documents, monkeypatch, part):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")
    try:
        rows = passages(part)
        got = fm_index.remove_repeats(documents(rows), part=part, shard=500).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(documents):
    assert fm_index.remove_repeats(documents([])).collect() == []


def test_matching_statistics_match_brute_force():
    rng = np.random.default_rng(4)
    for kinds, depth in ((3, 5), (6, 4), (40, 7)):
        texts = [rng.integers(1, kinds, rng.integers(1, 30)) for _ in range(25)]
        docs = rng.integers(0, 99, 25)
        index = fm_index.FMIndex(np.concatenate(texts), np.array([len(t) for t in texts]), docs, kinds, depth)
        patterns = [np.concatenate([texts[rng.integers(25)], rng.integers(0, kinds, 6), texts[3]]) for _ in range(20)]
        statistics, least = index.match(np.concatenate(patterns), np.array([len(p) for p in patterns]))
        at = 0
        for p in patterns:
            for i in range(len(p)):
                runs = {tuple(t[a : a + depth]): [] for t in texts for a in range(len(t))}
                best = 0
                while best < min(depth, len(p) - i) and any(r[: best + 1] == tuple(p[i : i + best + 1]) for r in runs):
                    best += 1
                assert statistics[at] == best
                have = [d for t, d in zip(texts, docs) for a in range(len(t) - depth + 1) if tuple(t[a : a + depth]) == tuple(p[i : i + depth])]
                assert least[at] == (min(have) if best == depth else fm_index.NONE)
                at += 1


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    text = " ".join(random.Random(5).choices(["alpha", "be", "gamma", "x" * 200, "é"], k=400))
    data = fm_index.raw(text)
    start, end = fm_index.word_ends(data)
    assert [data[a:z].tobytes() for a, z in zip(start, end)] == text.encode().split()
    whole = fm_index.word_hashes(data, start, end)
    assert len(set(whole.tolist())) == 5
    monkeypatch.setattr(fm_index, "PIECE", 300)
    assert (fm_index.word_hashes(data, start, end) == whole).all()


def test_segments_cover_every_window_once():
    rng = np.random.default_rng(6)
    hashes = np.concatenate([rng.integers(0, 2**64, 500, np.uint64), np.full(400, 7, np.uint64)])
    seeds, first, size = fm_index.segments(hashes)
    assert first.tolist() == (np.cumsum(size) - size).tolist() and size.sum() == len(hashes) - 49 and size.max() <= fm_index.RUN
    assert 12 < (500 - 49) / (first < 451).sum() < 30
