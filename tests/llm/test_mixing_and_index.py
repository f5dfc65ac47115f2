import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from extracteval.llm import inverted_index, line_templates, mixing

# ---- mixing ----


def mix_rows(seed=0, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 900])), rng.choice(["a"] * 6 + ["b", "c", "é", None])) for i in range(n)]
    return rows + [(1000, None, "a"), (1001, " \n ", "b"), (None, "x y z", "a"), (None, "x y z", "a"), (5, rows[5][1], rows[5][2]), (6, "other text of the same id", "d")]


def test_mix_meets_its_targets(documents):
    rows = mix_rows()
    got = mixing.mix_report(documents(rows), block_words=16, shard_words=500).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((d, len((t or "").split())) for d, t, _ in rows if d is not None)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), taken in by.items():
        assert target <= 2 * size + 1e-9 and abs(sum(taken) - target) <= max(16, size / 64) * 1.5 + 1
    again = mixing.mix_report(documents(rows[::-1]).repartition(5), block_words=16, shard_words=500).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # shares 3:1:2:3 of 2265; a and the empty source stop, then c does, and b gets the rest
    assert got == {"a": 20.0, None: 0.0, "c": 1000.0, "b": 1245.0}


def test_mix_of_nothing(documents):
    assert mixing.mix_report(documents([])).collect() == []
    got = mixing.mix_report(documents([(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(documents([(1, None), (2, "")])).collect() == []


def test_tree_deals_exact_quotas(spark):
    k = {1: 900, 2: 333, 3: 7, 4: 0}
    quotas = spark.createDataFrame(list(k.items()), "g int, k bigint")
    got = mixing.shard_quotas(quotas, sum(k.values()), 37).toPandas()
    assert got.groupby("g").quota.sum().to_dict() == k
    assert set(got.groupby("shard").quota.sum()) <= {1240 // 37, 1240 // 37 + 1}
    for _, rows in got[got.quota > 0].sort_values("start").groupby("g"):  # disjoint ranges that follow each other
        assert (rows.start.values[1:] == (rows.start + rows.quota).values[:-1]).all() and rows.start.values[0] == 0


def test_draws_are_hypergeometric(spark):
    n = 20000
    long = lambda x: F.lit(x).cast("bigint")
    x = spark.range(n).select(mixing.hypergeometric(long(500), long(120), long(200), mixing._uniform("id")).alias("x")).toPandas().x
    mean, var = 200 * 120 / 500, 200 * 0.24 * 0.76 * 300 / 499
    assert abs(x.mean() - mean) < 5 * (var / n) ** 0.5 and abs(x.var() / var - 1) < 0.06
    edge = spark.range(50).select(mixing.hypergeometric(long(9), long(9), long(4), mixing._uniform("id")).alias("x")).distinct().collect()
    assert [r.x for r in edge] == [4]


def test_runs_are_disjoint_and_texts_whole(documents):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(n)), s) for i, (n, s) in enumerate([(50, "a"), (7, "a"), (300, "b"), (1, "c"), (40, "c"), (90, None)])]
    docs = documents(rows)
    placed = mixing.lay_out(docs, block_words=8)
    runs = mixing.draw(placed, shard_words=60).toPandas()
    seen = set()
    for r in runs.itertuples():
        for j in range(r.first, r.first + r.words):
            assert (r.doc_id, r.turn, j) not in seen
            seen.add((r.doc_id, r.turn, j))
    mixed = mixing.mixed_documents(docs, block_words=8, shard_words=60)
    assert mixed.columns == docs.columns
    words = sorted(w for r in mixed.collect() for w in r.text.split())
    assert words == sorted(f"d{d}w{j}" for d, _, j in seen)


# ---- decontamination ----

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, size=10):
    out = []
    wins = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for p in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[p : p + size]), set()).add(i)
    for d, t in docs:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for win, ids in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= {i for i in ids if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_contamination_by_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "The", "É", "é", "x1", "zeta", "yy"] + [f"w{i}" for i in range(8)]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(12)] + [(3, "the the the the the the the the the the the"), (20, None), (21, "!!"), (None, "nameless w1 w2"), (20, "w3")]
    docs = [(i, say(rng.randint(0, 30)) + rng.choice(items)[1].__str__() + say(rng.randint(0, 5))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "..."), (103, "the " * 25), (None, items[3][1]), (docs[0][0], docs[0][1]), (docs[1][0], "another text w1"), (104, "Nameless W1-w2")]
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, window int")
    got = inverted_index.contamination(documents(docs), table).drop("text_hash").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)
    kept = inverted_index.drop_contaminated(documents(docs), table)
    assert kept.count() == sum(not r[-1] for r in brute(docs, items)) and kept.columns == documents(docs).columns


def test_contamination_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = inverted_index.contamination(documents([(1, "a b")]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
    assert inverted_index.contamination(documents([]), none).collect() == []


def test_proximity(spark, documents):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id bigint, text string")
    wins = inverted_index.windows(items)
    docs = documents([(1, "x alpha beta gamma delta"), (2, "alpha y beta gamma z delta"), (3, "delta q q q q q q q alpha beta gamma"), (4, "beta alpha gamma delta")])
    index = inverted_index.build_index(docs, wins.select(F.explode("words").alias("term")).distinct())
    assert sorted(r.id for r in inverted_index.proximity_matches(index, wins, slack=2).collect()) == [1, 2, 4]
    assert [(r.id, r.start) for r in inverted_index.phrase_matches(index, wins).collect()] == [(1, 1)]


# ---- line templates ----


def test_templates_by_hand(documents):
    logs = [(i, f"User bob{i} logged in from host{i} today ok\nunique {'abcdefghijkl'[i]}\n\nfixed line") for i in range(12)]
    free = [(100 + i, f"Failed to open the {w} file") for i, w in enumerate(["red", "blue", "green", "pink", "grey", "black", "white", "brown", "teal", "gold"])]
    odd = [(200, None), (201, ""), (202, "\n \n"), (203, "fixed line\r\nother " + "long " * 20000), (204, "Failed to open the last file"), (None, "fixed line"), (300, "fixed line"), (300, "fixed line")]
    got = {}
    for r in line_templates.drop_recurring_lines(documents(logs + free + odd)).collect():
        got.setdefault(r.doc_id, r)
    assert got[3].n_lines == 3 and got[3].n_dropped == 3 - 1 and got[3].kept.startswith("unique") and got[3].kept.endswith("\n")
    assert got[3].n_templates == 2
    assert got[104].n_dropped == 1 and got[104].kept == "" and got[204].kept == ""  # one variable word, ten fixed lines
    assert got[200].kept is None and got[201].kept == "" and got[202].kept == "\n \n" and got[202].n_lines == 0
    assert got[203].n_dropped == 1 and got[203].kept.startswith("other long") and got[None].n_dropped == got[300].n_dropped == 1


@pytest.mark.parametrize("values", [3, 20])
def test_common_values_of_a_field_are_not_fixed_text(documents, values):
    name = lambda i: "ab"[i % 2] + "cdefghijklmn"[i // 2]
    pairs = [(i, j) for i in range(values) for j in range(values)]
    rows = [(k, f"Today the account {name(i)} opened page {name(j)} ok") for k, (i, j) in enumerate(pairs * (9 if values == 3 else 1))]
    got = line_templates.drop_recurring_lines(documents(rows)).collect()
    assert {(r.n_dropped, r.n_templates, r.kept) for r in got} == {(1, 1, "")}


def test_rare_lines_stay(documents):
    rows = [(i, "a line that nine have") for i in range(9)]
    assert {r.n_dropped for r in line_templates.drop_recurring_lines(documents(rows)).collect()} == {0}
    assert line_templates.drop_recurring_lines(documents([])).collect() == []


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, f"s{i % 3}", " ".join(f"w{i}" for _ in range(i % 40)), i, i, i, i, "k") for i in range(90)] + [(None, None, "a b c", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, m bigint, m_runs bigint, m_taken bigint, row bigint, key string")
    got = mixing.mixed_documents(docs, block_words=8, shard_words=60)
    assert got.columns == docs.columns
    found = got.collect()
    assert found and all(r.m == r.doc_id == r.m_runs == r.m_taken == r.row for r in found)
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


def test_slots_are_looked_up_by_range(documents):
    placed = mixing.lay_out(documents(mix_rows()), block_words=4)
    runs = mixing.draw(placed, shard_words=40)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "sequence(start_slot" not in plan
    frame = runs.toPandas()
    slots = frame.groupby(["g", "place"]).shard.nunique()
    assert (slots == 1).all() and frame.shard.nunique() > 10
