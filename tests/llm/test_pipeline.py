"""The pipeline's stages against the plain meaning of what each decides."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from extracteval.llm.queries import ORACLES, QUERIES
from extracteval.session import materialise
from tools.check_oracle import TABLES, rows_of

from .test_mixing_and_index import brute as contaminated
from .test_near_duplicates import brute as near


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_registered_once_for_each_operator():
    names = sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, was, seen = docs.columns, docs.toPandas(), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"test-{name}")
        now = docs.toPandas()
        seen[name] = (was, now)
        if name != "token_ids":
            assert docs.columns == columns
        was = now

    scores = {r.doc_id: r.predicted for r in QUERIES["op10_toxicity"](spark, sf_dir).collect()}
    before, after = seen["toxicity"]
    assert set(after.doc_id) == {d for d in before.doc_id if not scores[d]}

    before, after = seen["near_duplicates"]
    assert set(after.doc_id) == {r[0] for r in near(list(zip(before.doc_id, before.text)), 80) if r[3]}

    before, after = seen["decontamination"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    assert set(after.doc_id) == {r[0] for r in contaminated(list(zip(before.doc_id, before.text)), items) if not r[5]}

    before, after = seen["mixing"]
    words = lambda df: df.assign(n=df.text.str.split(r"[ \t-\r]+", regex=True).map(lambda w: len([x for x in w if x])))
    size, taken = words(before).groupby("source").n.sum(), words(after).groupby("source").n.sum()
    weights = dict(zip(sorted(size.index), [3, 1, 2] * len(size)))
    target, free = {}, set(size.index)
    while True:  # shared out again until none is above its stop
        rest = 1.5 * size.sum() - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    assert all(abs(taken[s] - target[s]) <= size[s] / 32 + 2 for s in size.index)
    assert after.doc_id.value_counts().max() <= 2 and (after.n_chars == after.text.str.len()).all()

    before, after = seen["token_ids"]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array([*e.ids, 2], "<u4").tobytes() for e in tokenizer.encode_batch(before.text.tolist(), add_special_tokens=False)]
    assert sorted(zip(after.doc_id, after.n_tokens, after.ids_crc32)) == sorted(zip(before.doc_id, (len(x) // 4 for x in ids), map(zlib.crc32, ids)))


def odd_documents(spark, sf_dir):
    """The given columns and others whose names the stages use inside, with nulls anywhere."""
    plain = " ".join(f"word{i} of a plain text" for i in range(40))
    rows = [(1, plain, "en", "a", 5), (1, plain, "en", "a", 5), (2, plain, None, "b", None), (None, "no id here " * 12, "en", None, 1)]
    rows += [(3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n ", "en", "a", 3), (None, None, None, None, None), (6, "long " * 60_000 + "end", "en", "a", 9)]
    rows += [(6, "another text of the same id", "en", "c", 1)]
    extra = ["bad_id", "bad_hash", "h", "term", "window", "digest", "keeper", "gone_id", "row", "key", "m", "file", "text_hash", "score"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, *[f"{i}"] * len(extra)) for i, r in enumerate(rows)], schema)


def test_stages_on_odd_tables(spark, sf_dir):
    docs = odd_documents(spark, sf_dir)
    stages, was = dict(corpus_pipeline.STAGES), docs.collect()

    # nothing toxic and no benchmark text: every row stays, repeated ones too, with its other columns
    for name in ("toxicity", "decontamination"):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns and sorted(out.collect(), key=str) == sorted(was, key=str)

    # one of equal texts; texts without five words in common with others stay
    out = stages["near_duplicates"](spark, docs, sf_dir)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and sorted(kept, key=str) == sorted({(r.doc_id, r.text) for r in was if r.doc_id != 2}, key=str)

    # nothing of wordless texts; whole texts or their words, once or twice
    out = stages["mixing"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.text.split() and r.n_chars == len(r.text) and r.doc_id not in (3, 4, 5)
        assert any(r.bad_id == x.bad_id and set(r.text.split()) <= set(x.text.split()) for x in was if x.text)

    # a row for each, null ids last, the end id alone where there is no text
    out = sorted(stages["token_ids"](spark, docs, sf_dir).collect(), key=lambda r: r.start)
    assert len(out) == len(was) and [r.doc_id for r in out][-2:] == [None, None]
    assert {r.n_tokens for r in out if r.doc_id in (3, 4)} == {1}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, sf_dir, name):
    docs = odd_documents(spark, sf_dir)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), sf_dir)
    assert out.collect() == [] and (name == "token_ids" or out.columns == docs.columns)
