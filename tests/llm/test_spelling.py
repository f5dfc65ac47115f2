import random
import re
import zlib
from collections import Counter

import pytest

from extracteval.llm import spelling


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, nears = {}, {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        nears[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, nears[w], words.get(form[w])))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    stems = ["letter", "aaaaa", "aaaaaa", "banana", "éclair", "ÉCLAIR", "x÷y×zz", "ababab", "abababa", "q" * 3000, "q" * 2999 + "r"]
    words = list(stems)
    for s in stems[:9]:
        for _ in range(25):
            w = list(s)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", "e", "É"])
            words.append("".join(w) or "z")
    weights = [rng.choice([1, 3, 9, 40]) for _ in words]
    rows = [(d, rng.choice([" ", "-1 ", "\n"]).join(rng.choices(words, weights, k=rng.randint(0, 90)))) for d in range(80)]
    return rows + [(None, "letter Letter LETTER"), (None, None), (7, ""), (7, "letter " * 2000), (7, "abcde")]


@pytest.mark.parametrize("part", [spelling.PART, 2])
def test_matches_brute_force(spark, documents, part):
    rows = texts(part)
    got = spelling.spelling_variants(documents(rows), part).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_machines_accept_the_pairs_once():
    rng = random.Random(3)
    for size in range(5):
        words = {"".join(rng.choice("abc") for _ in range(n)) for n in (size, size + 1) for _ in range(60)}
        pairs = [tuple(sorted((u[0], v[0]))) for u, v in spelling.part_pairs({w: (w, 1) for w in words}, size, True)]
        want = {tuple(sorted((u, v))) for u in words for v in words if u < v and near(u, v) and size in (len(u), len(v))}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_acceptors_are_minimal():
    a = spelling.Acceptor(sorted(x + y + z for x in "abc" for y in "de" for z in "fg"))
    assert len(a.ways) == 4


def test_empty_table(documents):
    assert spelling.spelling_variants(documents([])).collect() == []
