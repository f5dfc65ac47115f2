"""Distributed shapes against plain Python on small random input, hot groups included."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from extracteval.functions import hashing
from extracteval.functions.hashing import hash_rank
from extracteval.operators import align, compare, datasets, ledger, metrics, reshape, tagging, topk, vocabulary
from extracteval.functions.tables import small_table


def random_attrs(rng, n, hot=0.4):
    """A third and more of the rows belong to query 0 and repeat few keys and values."""
    rows = []
    for _ in range(n):
        qid = 0 if rng.random() < hot else rng.randrange(1, 30)
        rows.append((qid, rng.choice(["Key_a", "key-a", "b", "c", ""]), rng.choice(["1", "2 x", "X  y", "x y", "", "12", "z 1 2", "z", "2 1", "yy"]), rng.randrange(1, 3), rng.randrange(1, 3)))
    return rows


def nk(s):
    return " ".join(s.lower().strip().replace("_", " ").replace("-", " ").split())


def nv(s):
    return " ".join(s.lower().strip().split())


@pytest.mark.parametrize("seed", [0, 10, 500])
def test_sets_and_priorities(attrs, seed):
    rng = random.Random(seed)
    g, c = random_attrs(rng, 300), random_attrs(rng, 300)
    gt, cand = attrs(g), attrs(c)
    by = lambda rows: {q: [r for r in rows if r[0] == q] for q in {r[0] for r in rows}}
    gq, cq = by(g), by(c)
    got = {r["qid"]: r for r in compare.set_counts(compare.term_flags(gt, cand)).collect()}
    pairs = {r["qid"]: r for r in compare.priority_counts(gt, cand).collect()}
    fuzzy = defaultdict(list)
    for r in compare.fuzzy_flags(gt, cand).orderBy("qid", "pos").collect():
        fuzzy[r["qid"]].append(r["value_matched"])
    for q in set(gq) | set(cq):
        a, b = gq.get(q, []), cq.get(q, [])
        ka, kb = {nk(r[1]) for r in a} - {""}, {nk(r[1]) for r in b} - {""}
        va, vb = {nv(r[2]) for r in a} - {""}, {nv(r[2]) for r in b} - {""}
        r = got[q]
        assert (r["gt_keys"], r["cand_keys"], r["matched_keys"]) == (len(ka), len(kb), len(ka & kb))
        assert (r["gt_values"], r["cand_values"], r["matched_values"]) == (len(va), len(vb), len(va & vb))
        strict = lambda r: (r[1].lower().strip().replace("_", " ").replace("-", " "), r[2].lower().strip())
        same = [(x, y) for x in a for y in b if strict(x) == strict(y)]
        p = pairs[q]
        assert p["pairs"] == len(same)
        assert p["key_priority_matches"] == sum(x[3] == y[3] for x, y in same)
        assert p["attr_priority_matches"] == sum(x[4] == y[4] for x, y in same)
        assert p["perfect"] == sum(x[3:] == y[3:] for x, y in same)

        def fuzzy_hit(v):
            v = nv(v)
            nums = set(re.findall(r"\d+\.?\d*", v))
            return v != "" and any(v in o or o in v or (nums and nums == set(re.findall(r"\d+\.?\d*", o))) for o in vb)

        assert fuzzy[q] == [fuzzy_hit(r[2]) for r in a]


def test_pairwise_totals(attrs):
    rng = random.Random(2)
    sources = {s: random_attrs(rng, 150) for s in "abc"}
    stacked = None
    for s, rows in sources.items():
        part = attrs(rows).withColumn("source", F.lit(s))
        stacked = part if stacked is None else stacked.unionByName(part)
    got = {(r["src"], r["dst"]): (r["total"], r["true_n"], r["false_n"], r["na_n"]) for r in metrics.pairwise_totals(stacked).collect()}
    for s in "abc":
        for t in "abc":
            if s == t:
                continue
            target = defaultdict(dict)
            for r in sources[t]:
                target[r[0]][nk(r[1])] = nv(r[2])
            res = Counter()
            for r in sources[s]:
                if r[0] in target:
                    m = target[r[0]]
                    res["total"] += 1
                    res["na" if nk(r[1]) not in m else "true" if m[nk(r[1])] == nv(r[2]) else "false"] += 1
            assert got[s, t] == (res["total"], res["true"], res["false"], res["na"])


def test_dictionary_hits_in_long_texts(spark):
    rng = random.Random(3)
    names = ["a", "ab", "abc", "abca", "bcab", "cc c", "é", "abcabcabcabc"]
    texts = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (0, 1, 2, 3, 4, 255, 256, 257, 513, 900)]
    df = spark.createDataFrame(list(enumerate(texts)), "qid bigint, query string")
    table = small_table(spark, [("f", n, n.upper(), i) for i, n in enumerate(names)], "facet string, name string, canonical string, rank int")
    got = Counter(
        (r["qid"], r["name"], r["before"], r["after"], r["at_start"])
        for r in tagging.dictionary_hits(df, table, F.col("query")).collect()
    )
    want = Counter()
    for q, t in enumerate(texts):
        for n in names:
            for p in range(len(t)):
                if t.startswith(n, p):
                    want[q, n, t[p - 1 : p] if p else "", t[p + len(n) : p + len(n) + 2], p == 0] += 1
    assert got == want


def test_hash_rank_is_a_permutation(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, label string")
    for prefix in (1, 2, 3):
        ranked = hash_rank(df, "id", "s", by=["label"], prefix=prefix).collect()
        for label in ("hot", None):
            ranks = {r["id"]: r["hash_rank"] for r in ranked if r["label"] == label}
            assert sorted(ranks.values()) == list(range(1, len(ranks) + 1))
            import hashlib

            order = sorted(ranks, key=lambda i: (hashlib.md5(f"s|{i}".encode()).hexdigest(), i))
            assert [ranks[i] for i in order] == list(range(1, len(ranks) + 1))


def test_budget_and_progress_with_a_hot_run(spark):
    rng = random.Random(4)
    rows = [(i, 0 if i % 3 else rng.randrange(1, 5), i * 600 + rng.randrange(600), round(rng.random() * 10, 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id bigint, run_id bigint, sec bigint, cost double").withColumn("ts", F.timestamp_seconds("sec"))
    kept = {r["event_id"] for r in ledger.budget_cutoff(df, 50).collect()}
    prog = {r["event_id"]: r for r in ledger.progress(df, elapsed="cost").collect()}
    for run in range(5):
        mine = sorted((r for r in rows if r[1] == run), key=lambda r: (r[2], r[0]))
        cents = 0
        for i, r in enumerate(mine):
            assert (r[0] in kept) == (cents < 5000)
            cents += round(r[3] * 100)
            assert prog[r[0]]["done"] == i + 1
            assert abs(prog[r[0]]["mean_time"] - cents / 100 / (i + 1)) < 1e-9
            assert abs(prog[r[0]]["eta"] - cents / 100 / (i + 1) * (len(mine) - i - 1)) < 1e-6


def test_keep_first_and_last_with_a_hot_key(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", f"v{i}") for i in range(1000)], "ord bigint, query string, v string")
    first = {r["query"]: r["v"] for r in align.keep_first(df, "query", "ord").collect()}
    last = {r["query"]: r["v"] for r in align.keep_last(df, "query", "ord").collect()}
    assert first["hot"] == "v1" and last["hot"] == "v998" and first["k3"] == last["k3"] == "v3"


def test_cap_values_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else "cold", f"v{i % 50}", 1000 - i) for i in range(1000)]
    got = defaultdict(list)
    for r in vocabulary.cap_values(spark.createDataFrame(rows, "key string, value string, ord bigint"), 5).orderBy("value_rank").collect():
        got[r["key"]].append(r["value"])
    for key in ("hot", "cold"):
        want = list(dict.fromkeys(v for k, v, o in sorted(rows, key=lambda r: r[2]) if k == key))[:5]
        assert got[key] == want


def test_synthesis_draws_distinct_keys(spark):
    pools = spark.createDataFrame([(f"k{i}", f"v{j}") for i in range(10) for j in range(i + 1)], "key string, value string")
    rows = datasets.synthesize(pools, 500, 2, 20, "x").collect()
    per = defaultdict(list)
    for r in rows:
        per[r["id"]].append(r["key"])
        assert int(r["value"][1:]) <= int(r["key"][1:])
    assert len(per) == 500 and all(len(k) == len(set(k)) and 2 <= len(k) <= 10 for k in per.values())
    assert {len(k) for k in per.values()} == set(range(2, 11))
    assert len({k for ks in per.values() for k in ks}) == 10


def test_vocabulary_tagging_matches_the_greedy_pass(spark):
    vocab = [("brand", "acme", 1), ("brand", "zeta", 2), ("size", "10 mm", 3), ("size", "5 kg", 4), ("type", "acme", 5), ("type", "round", 6)]
    texts = [(1, "ACME round 5 kg"), (2, "zeta acme 10 mm 5 kg"), (3, "none"), (4, "round")]
    got = defaultdict(dict)
    for r in tagging.tag_vocab(
        spark.createDataFrame(texts, "qid bigint, query string"),
        spark.createDataFrame(vocab, "key string, value string, ord bigint"),
        spark.createDataFrame([("brand", 1), ("size", 2), ("type", 3)], "key string, rank int"),
    ).collect():
        got[r["qid"]][r["key"]] = r["value"]
    assert dict(got) == {1: {"brand": "acme", "size": "5 kg", "type": "round"}, 2: {"brand": "acme", "size": "10 mm"}, 4: {"type": "round"}}


@pytest.mark.parametrize("seed", range(3))
def test_vocabulary_tagging_with_shared_values(spark, seed):
    rng = random.Random(seed)
    names = ["acme", "zeta", "ome", "round one", "5 kg", "red"]
    vocab = [(rng.choice("abcd"), rng.choice(names), i) for i in range(16)]
    texts = [(i, " ".join(rng.choice(names) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    ranks = [("b", 1), ("d", 2), ("a", 3), ("c", 4)]
    want = set()
    for qid, text in texts:
        used = set()
        for key, _ in ranks:
            first = {}
            for k, v, o in vocab:
                if k == key:
                    first.setdefault(v, o)
            for v in sorted(first, key=lambda v: first[v]):
                if v in text and v not in used:
                    used.add(v)
                    want.add((qid, key, v))
                    break
    got = tagging.tag_vocab(
        spark.createDataFrame(texts, "qid bigint, query string"), spark.createDataFrame(vocab, "key string, value string, ord bigint"),
        spark.createDataFrame(ranks, "key string, rank int"),
    ).collect()
    assert {(r["qid"], r["key"], r["value"]) for r in got} == want and len(got) == len(want)


def test_fuzzy_values_long_and_hot(attrs):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n)) or "a"
    hot = [word(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 33, 200])) for _ in range(120)]
    longs = [word(30) + rng.choice(hot) + word(700) for _ in range(5)] + ["", "12 x 5", "5 by 12.0"]
    gt = attrs([(1, f"k{i}", v) for i, v in enumerate(hot + longs)] + [(2, "k", "abc")])
    cand_values = [word(rng.choice([1, 4, 6, 12, 64])) for _ in range(60)] + longs[:2] + ["5/12"]
    got = {r["pos"]: r["value_matched"] for r in compare.fuzzy_flags(gt, attrs([(1, f"c{i}", v) for i, v in enumerate(cand_values)])).filter("qid = 1").collect()}
    norm = lambda v: " ".join(v.lower().split())
    import re

    nums = lambda v: set(re.findall(r"\d+\.?\d*", v))
    theirs = [norm(v) for v in cand_values if norm(v)]
    for pos, v in enumerate(map(norm, hot + longs), 1):
        want = bool(v) and any(v in t or t in v or (nums(v) and nums(v) == nums(t)) for t in theirs)
        assert got[pos] == want, v


def _names(spark, names):
    return spark.createDataFrame([("f", n, n.upper(), i) for i, n in enumerate(names)], "facet string, name string, canonical string, rank int")


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_dictionary_hits_are_those_of_brute_force(spark, monkeypatch, limit):
    from extracteval.functions import tables

    monkeypatch.setattr(tables, "BROADCAST_BYTES", limit)  # 0: the dictionary is shuffled
    rng = random.Random(11)
    names = {"".join(rng.choice("abé ") for _ in range(rng.randint(1, 14))) for _ in range(150)} | {"a", "b" * 30, "é" * 130}
    texts = ["".join(rng.choice("abé ") for _ in range(rng.choice([0, 1, 3, 40, 127, 128, 129, 600]))) for _ in range(40)] + [None, "", "é" * 400, "b" * 300]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "qid bigint, query string")
    want = sorted(
        (q, n, i == 0, t[i - 1] if i else "", t[i + len(n) : i + len(n) + 2])
        for q, t in [*enumerate(texts), (3, texts[3])] for n in names for i in range(len(t or "")) if t.startswith(n, i)
    )
    got = tagging.dictionary_hits(df, _names(spark, names), F.col("query")).select("qid", "name", "at_start", "before", "after").collect()
    assert sorted(map(tuple, got)) == want


def test_names_with_one_start_have_few_candidates(spark):
    names = [f"industrial motor {i:04d}" for i in range(2000)]
    rng = random.Random(5)
    texts = [(i, f"industrial motor {rng.randrange(9999):04d} industrial pump {i}, industrial motor and {rng.choice(names)}") for i in range(1500)]
    df = spark.createDataFrame(texts, "qid bigint, query string")
    table = _names(spark, names)
    hits = tagging.dictionary_hits(df, table, F.col("query")).count()
    candidates = tagging.dictionary_candidates(df, table, F.col("query")).count()
    assert hits == sum(t.count(n) for _, t in texts for n in {t[:21], t[-21:]} if n in set(names))
    assert hits <= candidates <= 2 * hits


def test_running_sums_of_one_run_and_time_in_many_ranges(spark):
    n = 4000
    df = spark.range(n).selectExpr("1 AS run", "7 AS ts", "id AS event", "CAST(id % 5 AS BIGINT) AS x").union(spark.sql("SELECT null, 7, CAST(1 AS BIGINT), CAST(3 AS BIGINT)"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ledger.scan_parts(df, "run", ["ts", "event"], {"s": F.col("x")})
        sizes = [r["count"] for r in parts.where("run = 1").groupBy("_part").count().collect()]
        got = ledger.running_before(df, "run", ["ts", "event"], {"s": F.col("x")}, {"was": F.col("event")}).where("run = 1").orderBy("event").collect()
        ties = ledger.running_before(df.withColumn("event", F.lit(0)), "run", ["ts", "event"], {"n": F.lit(1).cast("bigint")}).where("run = 1").select("n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) > 2 and max(sizes) < n / 2
    assert [r["s"] for r in got] == [sum(i % 5 for i in range(k)) for k in range(n)][:n]
    assert [r["was"] for r in got] == [None, *range(n - 1)]
    assert sorted(r["n"] for r in ties) == list(range(n))


def test_vocabulary_supplements(spark):
    texts = [(1, "Extruder 50 KG/hr 440 V 5 hp semi-automatic 3 phase"), (2, "motor power 3 hp manual"), (3, "plain"), (4, None), (5, "fully automatic 2.5 ton 1 phase")]
    df = spark.createDataFrame(texts, "qid bigint, query string")
    vocab = small_table(spark, [("motor power", "3 hp", 1), ("capacity", "50 kg", 2)], "key string, value string, ord int")
    prio = small_table(spark, [("motor power", 1), ("capacity", 2)], "key string, rank int")
    got = {}
    for r in tagging.tag_vocab(df, vocab, prio, supplements=tagging.vocab_supplements()).collect():
        got.setdefault(r["qid"], {})[r["key"]] = r["value"]
    assert got == {
        1: {"capacity": "50 kg", "voltage": "440 v", "power": "5 hp", "automation grade": "semi-automatic", "phase": "three phase"},
        2: {"motor power": "3 hp", "automation grade": "manual"},
        5: {"capacity": "2.5 ton", "automation grade": "fully automatic", "phase": "single phase"},
    }


@pytest.mark.parametrize("fits", [1, 20, 4096])
def test_samples_of_any_size_are_the_first_in_hash_order(spark, monkeypatch, fits):
    df = spark.range(3000).select((F.col("id") % 2500).alias("k"))  # some keys twice
    order = sorted((hashlib.md5(f"s|{k}".encode()).hexdigest(), k) for k in [i % 2500 for i in range(3000)])
    real = hashing.hash_cut
    monkeypatch.setattr(datasets, "hash_cut", lambda *a: real(*a, fits=fits))
    for n in (0, 1, 1234, 2999, 3000, 5000):
        got = sorted((hashlib.md5(f"s|{r['k']}".encode()).hexdigest(), r["k"]) for r in datasets.sample_n(df, n, "s", "k").collect())
        assert got == order[:n]


def test_fuzzy_keys_by_doubling(attrs):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("ab\U0001f600é") for _ in range(n))
    gt_values = [word(rnd.randint(1, 40)) for _ in range(60)]
    cand_values = [word(rnd.randint(1, 40)) for _ in range(60)] + [gt_values[0] + word(700), word(300) + gt_values[1][1:]]
    gt = attrs([(1, f"k{i}", v) for i, v in enumerate(gt_values)])
    cand = attrs([(1, f"c{i}", v) for i, v in enumerate(cand_values)])
    got = {r["pos"]: r["value_matched"] for r in compare.fuzzy_flags(gt, cand).collect()}
    assert got == {i: any(v in c or c in v for c in cand_values) for i, v in enumerate(gt_values, 1)}


def test_segments_hold_all_rows_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else None if i % 2 else "cold", i // 5, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    out = reshape.segments(df, "g", ["o", "v"], 64, ["v"]).collect()
    for g in ("hot", "cold", None):
        parts = sorted((r["segment"], [e["v"] for e in r["items"]]) for r in out if r["g"] == g)
        assert [s for s, _ in parts] == list(range(len(parts))) and all(len(v) == 64 for _, v in parts[:-1])
        assert [v for _, part in parts for v in part] == [v for h, _, v in rows if h == g]
    assert reshape.segments(df.limit(0), "g", ["o"], 64, ["v"]).count() == 0


def test_overflow_and_wide_rows_hold_every_attribute(attrs):
    df = attrs([(q, f"k{i % 7}", f"v{i}") for q, n in ((1, 3), (2, 150)) for i in range(n)])
    wide = {r["qid"]: r for r in reshape.widen(df, 5).collect()}
    over = reshape.overflow_rows(df, 5).collect()
    assert {q: r["overflow"] for q, r in wide.items()} == {1: 0, 2: 145}
    assert sorted(r["place"] for r in over) == list(range(6, 151)) and {r["qid"] for r in over} == {2}
    values = [wide[2][f"attr_value_{i}"] for i in range(1, 6)] + [r["value"] for r in over]
    assert sorted(values) == sorted(f"v{i}" for i in range(150))
    with pytest.raises(ValueError):
        reshape.widen_auto(df, widest=100)


def test_masks_give_the_counts_of_every_two_sources(attrs):
    rnd = random.Random(3)
    sources = {s: [(rnd.randint(1, 5), rnd.choice("abcd"), rnd.choice("xyz ")) for _ in range(15)] for s in ("r", "s", "t", "u")}
    frames = {s: attrs(rows) for s, rows in sources.items()}
    terms = {s: {(q, "key", k) for q, k, _ in rows} | {(q, "value", v) for q, _, v in rows if v.strip()} for s, rows in sources.items()}
    counts = compare.mask_counts(compare.source_masks(frames), None)
    got = {(r["src"], r["dst"], r["facet"]): (r["both"], r["src_only"], r["dst_only"]) for r in compare.source_overlaps(counts, list(frames)).collect()}
    pick = lambda s, f: {t for t in terms[s] if t[1] == f}
    names = list(sources)
    expected = {
        (a, b, f): (len(pick(a, f) & pick(b, f)), len(pick(a, f) - pick(b, f)), len(pick(b, f) - pick(a, f)))
        for i, a in enumerate(names) for b in names[i + 1 :] for f in ("key", "value")
    }
    assert got == expected
    # the showcase scores from masks are those of the comparisons one by one
    pairs = [compare.set_counts(compare.term_flags(frames["r"], frames[s])) for s in ("s", "t", "u")]
    slow = topk.showcase_scores(pairs[0], pairs[1:])
    fast = topk.showcase_scores_once(frames["r"], frames["s"], [frames["t"], frames["u"]])
    assert {tuple(r) for r in slow.select(*sorted(slow.columns)).collect()} == {tuple(r) for r in fast.select(*sorted(slow.columns)).collect()}


def test_prompts_refuse_a_digest_without_bound(spark):
    texts = spark.createDataFrame([("a pump",)], "query string")
    digest = spark.createDataFrame([(f"key {i}", "x | y", i) for i in range(100)], "key string, digest string, first_ord int")
    assert texts.count() == vocabulary.build_prompts(texts, digest).filter(F.col("prompt").contains("key 99: x | y")).count()
    with pytest.raises(ValueError):
        vocabulary.build_prompts(texts, digest, longest=500)
    assert vocabulary.build_prompts(texts, digest.limit(0)).first()["prompt"] is not None
