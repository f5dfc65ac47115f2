import random

import numpy as np
import pytest

from extracteval.llm import minhash
from extracteval.llm.components import components
from extracteval.llm.shingles import minima, shingle_set, words


def sets_of(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(rows, percent):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)), d == least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_rows(seed, groups=4, copies=30):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(120)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 1000, " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_matches_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows(block)
    rows += [(2001, None), (2002, ""), (2003, " \n\t"), (2004, "One two"), (2005, "one TWO"), (2006, "É a b c d"), (2007, "é a b c d")]
    rows += [rows[3], (None, rows[5][1]), (None, "lonely words of no id at all here"), (2008, "w " * 30000)]
    got = minhash.near_duplicates(documents(rows), percent=85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 85)


def test_one_row_of_each_component_stays(spark, documents):
    import corpus_pipeline

    rng = random.Random(11)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)) for _ in range(5)]
    near = lambda k, *ends: [base[k] + f" {e}" for e in ends]
    rows = [(1, base[0]), *((7, t) for t in near(0, "x"))]  # id 7: a copy of 1, and the first of its own group
    rows += [(7, base[1]), *zip((8, 9), near(1, "x", "y"))]
    rows += [(20, t) for t in near(2, "x", "y")] + [(21, base[2])]  # two copies of the least id
    rows += [(None, t) for t in near(3, "x", "y", "z")]  # no ids
    rows += [(30, base[4]), *((None, t) for t in near(4, "x", "y"))]  # one id
    rows += [(None, ""), (None, None), (31, ""), (30, base[4])]
    got = corpus_pipeline.keep_one_of_near_copies(spark, documents(rows), "")
    assert got.columns == documents(rows).columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert len(kept) == len(set(kept)) == 8
    assert {(1, base[0]), (7, base[1]), (30, base[4]), (None, ""), (None, None), (31, "")} <= set(kept)
    assert sorted(d for d, t in kept if t and t.startswith(base[2])) == [20]
    assert sum(bool(t) and t.startswith(base[3]) for _, t in kept) == 1


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).collect() == []
    assert minhash.drop_near_copies(documents([])).collect() == []


def test_estimate_follows_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.85):
        pairs, ests = 60, []
        for _ in range(pairs):
            common, other = rng.integers(0, 2**63, 400, np.uint64), rng.integers(0, 2**63, (2, 400), np.uint64)
            n = int(2 * share / (1 + share) * 400)
            a, b = (np.unique(np.concatenate([common[:n], o[: 400 - n]])) for o in other)
            m = minhash.pack_bits(minima([a, b], 128), 2)
            ests.append(minhash.estimate(m[0], m[1], 128, 2))
        assert abs(float(np.mean(ests)) - share) < 0.02
        assert minhash.cut(share, 128, 2) < min(ests)


def test_short_and_blank_texts():
    assert len(shingle_set(words(None))) == len(shingle_set(words("  "))) == 0
    assert len(shingle_set(words("a b"))) == 1 and (shingle_set(words("A b")) == shingle_set(words("a  B"))).all()
    assert (shingle_set(words("a b")) != shingle_set(words("b a"))).all()


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(f"{rng.randrange(80):03d}", f"{rng.randrange(80):03d}") for _ in range(50)],
        "path": [(f"{i * 37 % 101:03d}", f"{(i + 1) * 37 % 101:03d}") for i in range(100)],
        "star": [("500", f"{i:03d}") for i in range(60)] + [(None, "1"), ("7", "7")],
        "none": [("1", "1")],
    }[kind]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string").repartition(5)).collect()}
    clean = [(a, b) for a, b in edges if a and b and a != b]
    want = {x: x for e in clean for x in e}
    for _ in clean:
        for a, b in clean:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
