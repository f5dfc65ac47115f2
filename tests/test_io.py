"""Sources, sinks and incremental runs on files."""

import hashlib
import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from extracteval.operators import ledger, reshape, tagging
from extracteval.sources import files, results
from extracteval.streaming import ledger as stream


def test_results_csv_with_bom_and_multiline_cells(spark, tmp_path):
    cell = json.dumps({"attributes": [{"attribute_key": "k", "value": "a\nb", "key_priority": 1, "attribute_priority": 2}]}, indent=1)
    path = tmp_path / "r.csv"
    path.write_text("﻿query,success,attributes_json\n" + f'"q ""1""",True,"{cell.replace(chr(34), chr(34) * 2)}"\nq2,False,\nq3,True,"{{broken"\n', encoding="utf-8")
    rows = {r["query"]: r for r in results.read_results(spark, str(path), "s").collect()}
    assert set(rows) == {'q "1"', "q2", "q3"}
    assert rows['q "1"']["attributes"][0]["value"] == "a\nb" and rows['q "1"']["success"]
    assert not rows["q2"]["success"] and rows["q2"]["attributes"] == [] and rows["q3"]["attributes"] == []


def test_missing_success_column_means_true(spark, tmp_path):
    (tmp_path / "r.csv").write_text("query\nq1\n")
    assert results.read_results(spark, str(tmp_path / "r.csv"), "s").first()["success"] is True


def test_map_results_array(spark, tmp_path):
    data = [{"query": "q", "success": True, "attributes": {"z": "1", "a": "2"}}, {"query": "r", "attributes": {}}]
    (tmp_path / "m.json").write_text(json.dumps(data, indent=2))
    rows = {r["query"]: r for r in results.read_map_results(spark, str(tmp_path / "m.json"), "s").collect()}
    assert [(a["attribute_key"], a["attribute_priority"]) for a in rows["q"]["attributes"]] == [("z", 1), ("a", 2)]
    assert rows["r"]["success"] is False and rows["r"]["attributes"] == []


def test_query_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,query\n1,"x, y"\n2,\n')
    (tmp_path / "b.txt").write_text("Query\nfirst\n\n second, with comma \n")
    assert [r[0] for r in results.read_queries(spark, str(tmp_path / "a.csv")).collect()] == ["x, y"]
    assert [r[0] for r in results.read_queries(spark, str(tmp_path / "b.txt")).collect()] == ["first", "second, with comma"]


def test_vocab_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("Color,Red, dark\ncolor,red, dark\nx,NA\nnocomma\n,y\nk,z\n")
    assert {tuple(r) for r in results.read_vocab_text(spark, str(tmp_path / "v.txt")).collect()} == {("color", "red, dark")}


def test_manifest_hashes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "_tmp").mkdir()
    content = {"a.txt": b"hello", "sub/b.bin": b"x" * 3_000_000, "sub/c.txt": b"", ".env": b"k=1", "_tmp/d.txt": b"d", "sub/e f%20é.txt": b"odd name"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    rows = files.manifest(spark, str(tmp_path)).collect()
    assert all(r["path"] == f"file:{tmp_path}/{r['path'][len(str(tmp_path)) + 6:]}" for r in rows)
    got = {r["file_name"]: (r["size_bytes"], r["sha256"]) for r in rows}
    assert got == {n.split("/")[-1]: (len(b), hashlib.sha256(b).hexdigest()) for n, b in content.items()}


def test_manifest_of_names_that_listings_treat_apart(spark, tmp_path):
    names = ["_metadata", "_common_metadata", "_x=1/a", "x._COPYING_", "deep/er/_still/.so/f", "zipped.gz", "a b/c", ".crc/.y.crc"]
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"not really zipped" * i)
    (tmp_path / "empty folder").mkdir()
    rows = files.manifest(spark, str(tmp_path) + "/").collect()
    want = {f"file:{tmp_path}/{n}": hashlib.sha256(b"not really zipped" * i).hexdigest() for i, n in enumerate(names)}
    assert len(rows) == len(names) and {r["path"]: r["sha256"] for r in rows} == want
    assert all(abs(r["modified_time"].timestamp() - (tmp_path / r["path"][len(f"file:{tmp_path}/"):]).stat().st_mtime) < 1e-3 for r in rows)
    assert files.manifest(spark, str(tmp_path / "empty folder")).collect() == []


def test_manifest_deals_one_large_folder_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_FILES", 10)
    for i in range(60):
        (tmp_path / f"f{i}").write_bytes(b"%d" % i)
    got = files.manifest(spark, str(tmp_path))
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(t["count"] for t in tasks) == 60 and len(tasks) >= 5 and max(t["count"] for t in tasks) < 30


def test_run_log(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "=== header ===\n[2026-02-06 03:18:30] Reading\n[2026-02-06 03:18:40] Progress: 100/300 (33.3%) | Success: 90 | Failed: 10\n"
        "[2026-02-06 23:59:50] Failed query #7: x\n[2026-02-07 00:00:00] Progress: 300/300 (100.0%) | Success: 280 | Failed: 20\n"
    )
    rows = files.read_run_log(spark, str(tmp_path)).orderBy("batch").collect()
    assert [(r["batch"], r["batch_done"], r["batch_success"], r["batch_failed"], r["seconds"]) for r in rows] == [
        (1, 100, 90, 10, 10), (2, 200, 190, 10, 74480),
    ]
    assert rows[0]["rows_per_second"] == 10.0


def test_predictor_failures_become_rows(spark):
    def predict(texts: pd.Series) -> pd.Series:
        if texts.str.contains("bad").any():
            raise ValueError("cannot")
        return texts.str.upper().where(texts != "none", None)

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "none")], "qid bigint, query string")
    rows = {r["qid"]: r for r in tagging.apply_predictor(df, predict).collect()}
    assert (rows[1]["success"], rows[1]["raw_output"], rows[1]["error"]) == (True, "OK", None)
    assert (rows[2]["success"], rows[2]["error"]) == (False, "ValueError: cannot")
    assert (rows[3]["success"], rows[3]["raw_output"]) == (False, None)


SOURCE = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
LEDGER = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType())])


def test_incremental_runs_are_idempotent(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "mark")

    def add(ids):
        spark.createDataFrame([(i, "x" * i) for i in ids], SOURCE).coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint=mark):
        stream.run_available(
            spark, source, SOURCE, out, checkpoint, "id", LEDGER, lambda b: b.select("id", F.length("text").alias("n")), files_per_batch=1
        )
        return sorted(r["id"] for r in stream.read_ledger(spark, out, LEDGER).collect())

    add([1, 2, 3])
    add([3, 4])  # a key that arrives twice
    assert run() == [1, 2, 3, 4]
    assert run() == [1, 2, 3, 4]
    add([5, 1])
    assert run() == [1, 2, 3, 4, 5]
    assert {r["id"]: r["n"] for r in stream.read_ledger(spark, out, LEDGER).collect()}[5] == 5
    pending = ledger.pending(spark.createDataFrame([(4,), (9,)], "id bigint"), stream.read_ledger(spark, out, LEDGER), "id")
    assert [r["id"] for r in pending.collect()] == [9]


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    out = str(tmp_path / "ledger")
    batch = spark.createDataFrame([(1, "a"), (2, "bb")], SOURCE)
    for _ in range(2):
        stream.append_batch(batch, 0, out, "id", LEDGER, lambda b: b.select("id", F.length("text").alias("n")))
    assert sorted(r["id"] for r in stream.read_ledger(spark, out, LEDGER).collect()) == [1, 2]


def test_a_batch_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    out = str(tmp_path / "ledger")
    count = lambda b: b.select("id", F.length("text").alias("n"))
    for i in range(3):
        stream.append_batch(spark.range(i * 2000, (i + 1) * 2000).select("id", F.lit("ab").alias("text")), i, out, "id", LEDGER, count)
    few = spark.createDataFrame([(5, "abc"), (2001, "abc"), (7000, "abc")], "id bigint, text string")
    seen = stream.seen_keys(few, 3, out, "id", LEDGER)
    assert {5, 2001} <= {r["id"] for r in seen.collect()} and 7000 not in {r["id"] for r in seen.collect()}
    # the filter on buckets reaches the listing of folders, so other buckets' files are not opened
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+", plan)
    assert len(seen.collect()) < 6000 * 3 / stream.BUCKETS * 2
    for _ in range(2):
        stream.append_batch(few, 3, out, "id", LEDGER, count)
        rows = stream.read_ledger(spark, out, LEDGER).collect()
        assert len(rows) == 6001 and {r["id"]: r["n"] for r in rows}[7000] == 3
    stream.append_batch(few.limit(0), 4, out, "id", LEDGER, count)
    assert stream.read_ledger(spark, out, LEDGER).count() == 6001


def test_stage_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "stage")
    assert ledger.stage(spark, path, build).count() == ledger.stage(spark, path, build).count() == 3
    assert len(calls) == 1


def test_report_sink_keeps_column_order(spark, tmp_path, attrs):
    wide = reshape.widen(attrs([(1, "k", 'say "hi", ok')]), 1)
    results.write_report(wide, str(tmp_path / "out"), ["attr_value_1", "qid"])
    back = spark.read.options(header="true", quote='"', escape='"').csv(str(tmp_path / "out"))
    assert back.columns == ["attr_value_1", "qid"] and back.first()[0] == 'say "hi", ok'


def test_each_file_has_its_own_heading(spark, tmp_path):
    (tmp_path / "a.csv").write_text('query,success,attributes_json\n"x, y",True,\n', encoding="utf-8")
    (tmp_path / "b 1.csv").write_text('\ufeffsuccess,"a,b",query\nFalse,1,z\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("query\nonly\n", encoding="utf-8")
    got = sorted((r["query"], r["success"]) for r in results.read_results(spark, str(tmp_path), "s").collect())
    assert got == [("only", True), ("x, y", True), ("z", False)]
    assert sorted(r["query"] for r in results.read_queries(spark, str(tmp_path)).collect()) == ["only", "x, y", "z"]
    (tmp_path / "d.csv").write_text("name\nx\n", encoding="utf-8")
    with pytest.raises(ValueError, match="query"):
        results.read_results(spark, str(tmp_path), "s")


def test_a_repeated_key_keeps_its_last_value(spark, tmp_path):
    from extracteval.functions.parsing import parse_flat_map

    cell = '{"a": "1", "b": "2", "a": "3"}'
    row = spark.createDataFrame([(cell,)], "c string").select(parse_flat_map(F.col("c")).alias("e")).first()
    assert [(e["key"], e["value"]) for e in row["e"]] == [("a", "3"), ("b", "2")]
    (tmp_path / "r.json").write_text('{"query": "q", "success": true, "attributes": %s}' % cell, encoding="utf-8")
    row = results.read_map_results(spark, str(tmp_path), "s", multi_line=False).first()
    assert [(a["attribute_key"], a["value"], a["attribute_priority"]) for a in row["attributes"]] == [("a", "3", 1), ("b", "2", 2)]
