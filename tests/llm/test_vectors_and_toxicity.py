import itertools
import random
import zlib

import numpy as np
import pytest

from extracteval.llm import toxicity, vptree

# ---- nearest neighbours ----


def brute(rows, k=20, every=20):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i, tuple(np.float32(v).tolist())] = 1
    out = []
    for q, qv in ok:
        if q % every == 0:
            near = sorted((-float(np.dot(np.float64(qv), np.float64(v))), i) for i, v in ok if i != q and len(v) == len(qv))
            out += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "copies", "few"])
def test_exact_search(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "spread":
        rows = [(i, (rng.normal(size=8) * rng.uniform(0.1, 3)).tolist()) for i in range(900)]
    elif kind == "copies":  # small whole numbers: many equal vectors and equal products
        rows = [(i, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(500)] + [(1000 + i, [1.0, 1.0, 0.0]) for i in range(100)]
    else:
        rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [0.5, 0.5]), (40, [1.0, 2.0, 3.0])]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 3), (2060, [1.0, None, 2.0]), (2080, [float("nan")] * 3), (2100, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), rows[0]]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, vector string")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in vptree.nearest(df, shard=200).collect())
    assert got == brute(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    assert vptree.nearest(df).collect() == []


def test_factor_trades_recall_for_work():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = vptree.Tree(x, np.arange(len(x)), 1.0 + 1e-12)
    q = x[::60]
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, 19]
    best, _, work = tree.search(q, 20)
    assert np.allclose(best[:, 19], want) and work < 0.6 * len(q) * len(x)
    less, _, quick = tree.search(q, 20, factor=0.5)
    assert quick < work and (less >= want[:, None] - 1e-9).mean() > 0.9


# ---- toxicity ----


def vector(word):
    out = {}
    for i, j, k in itertools.combinations(range(len(word)), 3):
        u = word[i] + word[j] + word[k]
        out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
    return out


def test_kernel_by_brute_force():
    names = ["idiot", "ixdixoxt", "banana", "abcabcabc", "ab"]
    x = toxicity.codes(names)
    want = [sum(v * v for v in vector(w).values()) ** 0.5 if len(w) > 2 else 1 for w in names]
    assert np.allclose(toxicity.norms(x), want, rtol=1e-5)
    rows = toxicity.feature_rows(x[:2])
    a, b = vector(names[0]), vector(names[1])
    assert np.isclose(rows[0] @ rows[1], sum(a[u] * b.get(u, 0) for u in a) / want[0] / want[1], rtol=1e-4)
    sums = toxicity.subsequence_sums(x[:3], rows.T.copy())
    assert np.allclose(sums[:2] / toxicity.norms(x[:2])[:, None], rows[:2] @ rows.T, rtol=1e-4)


def labelled(seed=0, n=700):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["th", "er", "in", "an", "ou", "ly", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for d in range(n):
        words = [rng.choice(vocab) for _ in range(60)]
        toxic = int(rng.random() < 0.25)
        for _ in range(4 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(["idiot", "moron", "loser", "stupid", "worthless"])
        docs.append((d, " ".join(words)))
        labels.append((d, toxic))
    return docs, labels


def test_held_out_documents_and_odd_ones(spark, documents):
    docs, labels = labelled()
    base = docs[1][1] if not labels[1][1] else docs[0][1]
    odd = [(2000, None), (2001, ""), (2002, "the ther in"), (2003, "you m-o-r-o-n and i d i o t " + base), (2004, "Worxthless!! stup1d stupidd idiot. " + base), (2005, "ther in " * 40000 + " idiot moron loser"), (2006, "x" * 100_000), docs[0]]
    odd += [(None, "idiot moron loser stupid")]
    table = spark.createDataFrame([*((*x, 1) for x in labels), (5, None, 0), (None, 1, 0), labels[3] + (0,)], "doc_id bigint, toxic int, text int")
    got = {}
    for r in toxicity.toxicity(documents(docs + odd), table).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        got[r.doc_id] = r
    for d, toxic in labels:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
    held = [(got[d].predicted, t) for d, t in labels if got[d].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert [got[i].predicted for i in range(2000, 2007)] == [0, 0, 0, 1, 1, 1, 0] and got[None].predicted == 1 and not got[None].held_out
    kept = toxicity.drop_toxic(documents(docs + odd), table)
    assert kept.count() == sum(got[d].predicted == 0 for d, _ in docs + odd)


def test_nothing_to_learn_from(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity.toxicity(documents([(1, "idiot"), (2, None)]), none).collect()] == [0, 0]
    assert toxicity.toxicity(documents([]), none).collect() == []
