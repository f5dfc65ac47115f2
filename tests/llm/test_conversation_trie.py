import hashlib
import random
import zlib

import pytest

from extracteval.llm import conversation_trie


def brute(rows):
    """Nodes as the contract words them, from (conv_id, turn, role, text) rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = f"{len(role or '')}:{role or ''}{text or ''}"
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(key.encode()).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    for x, convs in members.items():
        under = [y for y in members if y[: len(x)] == x]
        leaves = sum(not any(len(z) == len(y) + 1 and z[:-1] == y for z in members) for y in under)
        saved = sum((len(members[y]) - 1) * len(y[-1][1]) for y in under if y)
        children = sum(len(z) == len(x) + 1 and z[:-1] == x for z in members)
        names = ",".join(map(str, sorted(ends.get(x, []))))
        out.append((min(convs), len(x), min(members[x[:-1]]) if x else None, len(convs), children, leaves, saved, hashlib.sha256(names.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(60), *range(100, 160), 207, 300, 301, 1205]:
        for t in range(rng.choice([1, 1, 2, 3, 7])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", "é" * 9])))
    rows += [(100, t, "user", "hi") for t in range(9)] + [(400 + c, t, "user", "go on") for c in range(9) for t in range(40)]
    rows += [(500, None, None, None), (501, None, "user", None), (501, None, "user", "x"), (501, 0, None, "x"), (None, 0, "user", "hi"), (None, None, None, None), (502, 3, "", ""), (502, 3, "", "")]
    return rows + [(503, 0, "a", "ba"), (504, 0, "ab", "a"), (505, 0, "user", "long " * 50_000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", b"y") for r in rows], "conv_id bigint, turn bigint, role string, text string, d int, c string, prefix binary")


@pytest.mark.parametrize("limit", [conversation_trie.LIMIT, 60, 1])
def test_matches_brute_force(spark, limit):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")  # nodes cross batches
    try:
        rows = talks(limit)
        got = conversation_trie.conversation_trie(table(spark, rows), limit).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_containers_hold_no_more_than_the_limit(spark):
    rows = [(1000 + i, t, "user", "start" if t < 3 else f"{i % 7}") for i in range(200) for t in range(6)]
    placed = conversation_trie.burst(conversation_trie.paths(conversation_trie.rebuilt(table(spark, rows))), 50)
    sizes = {r[0]: r[1] for r in placed.where("d > head").groupBy("container").count().collect()}
    assert max(sizes.values()) <= 50 and placed.where("d <= head and d > 0").count() > 0


def test_empty_table(spark):
    assert conversation_trie.conversation_trie(table(spark, [])).collect() == []
    assert conversation_trie.conversation_trie(table(spark, [(None, 1, "user", "x")])).collect() == []
