import hashlib
import random

import numpy as np
import pytest

from extracteval.llm import suffixes


def brute(rows):
    first, out = {}, []
    late = lambda d: float("inf") if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], late(d)), late(d))
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < late(d):
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def passages(seed, docs=90):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    rows = []
    for d in range(docs):
        text = ""
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            a = rng.randint(0, len(x))
            text += x[a : rng.randint(a, len(x))] + rng.choice(["", "#", "zz q"]) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
        rows.append((d * 7 % 101, text))
    edge = ["", None, "a" * 300, "a" * 120, "ab" * 80, "ab" * 80 + "x", "é" * 70, "xé" + "é" * 70, "q" * 49, "q" * 50, "q" * 50, "line of the day " * 2000]
    return rows + [(200 + i, t) for i, t in enumerate(edge)] + [(rows[5][0], rows[5][1]), (rows[6][0], base[0]), (None, base[1]), (None, base[1]), (None, None)]


@pytest.mark.parametrize("often", [False, True])
def test_matches_brute_force(spark, documents, monkeypatch, often):
    if often:  # every rank of the sample is sorted in parts
        monkeypatch.setattr(suffixes, "SAMPLE", 1)
        monkeypatch.setattr(suffixes, "OFTEN", 500)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")  # groups cross batches
    try:
        rows = passages(int(often))
        got = suffixes.remove_repeats(documents(rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_texts_without_id_are_told_apart(spark, documents):
    # two texts whose hashes agree in their low 22 bits, and many others without an id
    rng = random.Random(7)
    line = " ".join(rng.choice(["amber", "birch", "cedar", "delta"]) + str(i) for i in range(12))
    texts = [f"{i} {line}" if i % 2 else f"{i} " + "".join(rng.choice("klmnopqrst") for _ in range(90)) for i in range(9000)]
    low = {}
    for t, h in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) & 4194303 AS h").collect():
        low.setdefault(h, set()).add(t)
    pairs = [sorted(g) for g in low.values() if len({t[-5:] == line[-5:] for t in g}) == 2]
    assert pairs  # of one text that repeats a line and one that repeats nothing
    rows = [(1, line)] + [(None, t) for pair in pairs for t in pair] + [(None, t) for t in texts[:400]]
    got = suffixes.remove_repeats(documents(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_repeated_rows_are_worked_on_once(spark, documents, monkeypatch):
    line = "a passage of more than fifty bytes that stands in several documents"
    rows = [(None, line)] * 3000 + [(7, line + " x")] * 500 + [(1, line)] * 2 + [(1, "other"), (8, None), (8, None), (None, None), (None, "")]
    rng = random.Random(3)
    rng.shuffle(rows)
    docs = documents(rows).repartition(6)
    once, counts = suffixes.one_of_each(suffixes._keyed(docs))
    assert once.count() == len({r for r in rows}) and sum(map(sum, (r.counts for r in counts.collect()))) == 3504
    got = suffixes.remove_repeats(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert suffixes.one_of_each(suffixes._keyed(documents([(1, "a"), (1, "b"), (None, "a")])))[1] is None


def test_empty_table(documents):
    assert suffixes.remove_repeats(documents([])).collect() == []


def test_pieces_name_the_same_anchors(monkeypatch):
    raw = np.frombuffer(random.Random(2).randbytes(3000), np.uint8)
    whole = set(zip(*(x.tolist() for x in suffixes.text_anchors(raw))))
    monkeypatch.setattr(suffixes, "PIECE", 97)
    assert set(zip(*(x.tolist() for x in suffixes.text_anchors(raw)))) == whole


def test_every_string_has_an_anchor_and_names_it():
    raw = np.frombuffer(random.Random(3).randbytes(4000), np.uint8)
    r, least, chosen = suffixes.string_ranks(raw)
    for s in range(0, len(least), 13):
        inside = r[s : s + suffixes.STARTS]
        assert least[s] == inside.min() and chosen[s + int(inside.argmin())]
    assert 0.05 < chosen.mean() < 0.1
