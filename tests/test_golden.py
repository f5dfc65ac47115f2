"""Worked examples computed by hand."""

import json

import pytest
from pyspark.sql import functions as F

from extracteval.functions.normalize import percent_decode
from extracteval.functions import lexicon as L
from extracteval.functions import normalize as N
from extracteval.functions import parsing as P
from extracteval.operators import compare, metrics, reshape, tagging, vocabulary
from extracteval.plans import jobs


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x"))
    return row.first()["x"]


def test_cooler_motor(attrs):
    gt = attrs([
        (1, "motor_type", "cooler motor", 1, 1), (1, "product_type", "cooler motor", 2, 1),
        (1, "application", "cooler", 1, 2), (1, "use", "cooler", 2, 2),
    ])
    cand = attrs([(1, "usage", "cooler"), (1, "part type", "motor")])
    flags = compare.term_flags(gt, cand)
    row = metrics.match_rate(compare.set_counts(flags)).first()
    assert (row["matched_keys"], row["gt_keys"], row["cand_keys"]) == (0, 4, 2)
    assert (row["matched_values"], row["gt_values"], row["key_rate"], row["value_rate"]) == (1, 2, 0.0, 0.5)
    sets = compare.set_compare(flags).first()
    assert sets["gt_only_key_set"] == ["application", "motor type", "product type", "use"]
    assert sets["cand_only_key_set"] == ["part type", "usage"]
    assert sets["matched_value_set"] == ["cooler"]


def test_actuators(spark, attrs):
    gt = attrs([
        (1, "application", "actuator", 1, 1), (1, "use", "actuator", 2, 1),
        (1, "product_category", "actuator", 1, 2), (1, "category", "actuator", 2, 2),
    ])
    none = attrs([]) if False else gt.limit(0)
    row = metrics.match_rate(compare.set_counts(compare.term_flags(gt, none))).first()
    assert (row["gt_keys"], row["cand_keys"], row["matched_keys"]) == (4, 0, 0)
    assert (row["gt_values"], row["matched_values"], row["key_rate"], row["value_rate"]) == (1, 0, 0.0, 0.0)
    # candidate-only side: an empty reference gives no rate
    back = metrics.match_rate(compare.set_counts(compare.term_flags(none, gt))).first()
    assert back["key_rate"] is None


@pytest.mark.parametrize(
    "raw,expected",
    [
        ('"abc"', "abc"), ("'\"abc\"'", "abc"), ("\" 'abc' \"", "abc"), ('""abc', "abc"), ("abc'", "abc"), ("abc,,", "abc"),
        ("  A  B ", "a b"), ("\"", ""), ("''", ""), (None, ""), ("\" \" abc", '" abc'), ("'a' 'b'", "a' 'b"),
    ],
)
def test_unquote(spark, raw, expected):
    assert one(spark, N.norm_value(F.col("v").cast("string"), "quoted"), v=raw) == expected


@pytest.mark.parametrize(
    "raw,expected",
    [("a+b%20c", "a b c"), ("100% cotton%20x", "100% cotton x"), ("%zz", "%zz"), ("  a   b ", "a b"), ("5%", "5%")],
)
def test_clean_query(spark, raw, expected):
    assert one(spark, N.clean_query(F.col("v")), v=raw) == expected


def test_norm_key_modes(spark):
    assert one(spark, N.norm_key(F.col("v"), "strict"), v=" A_B--C ") == "a b  c"
    assert one(spark, N.norm_key(F.col("v")), v=" A_B--C  D ") == "a b c d"
    assert one(spark, N.norm_key(F.col("v"), "snake"), v=" Model (No)/X ") == "model_no_x"
    assert one(spark, N.norm_key(F.col("v").cast("string")), v=None) == ""


def pairs(spark, expr, v):
    return [(e["key"], e["value"]) for e in one(spark, expr, v=v)]


def test_list_parsers(spark):
    good = "['10 hp:Power:specification', \"it's:note:x\", 'bad']"
    assert pairs(spark, P.parse_isq_list(F.col("v")), good) == [("power", "10 hp"), ("note", "it's")]
    for broken in ("[", "['a:b:c'", "nonsense", "", "['a:b:c'] extra"):
        assert pairs(spark, P.parse_isq_list(F.col("v")), broken) == []
    assert pairs(spark, P.parse_isq_list(F.col("v")), "[]") == []
    assert pairs(spark, P.parse_isq_lenient(F.col("v")), '[""a:k1:s"",  ""b:k2:s""') == [("k1", "a"), ("k2", "b")]
    pipe = "A:k:s | b:k2 | :x:y |"
    assert pairs(spark, P.parse_isq_pipe(F.col("v")), pipe) == [("k", "a"), ("x", "")]
    assert pairs(spark, P.parse_isq_pipe(F.col("v"), strict=False), pipe) == [("k", "A"), ("k2", "b")]


def test_json_parsers(spark):
    assert pairs(spark, P.parse_flat_map(F.col("v")), "{'A': 'X', \"b\": 2}") == [("a", "x"), ("b", "2")]
    assert pairs(spark, P.parse_flat_map(F.col("v")), '{"a": "it\'s"}') == [("a", "it's")]
    assert pairs(spark, P.parse_flat_map(F.col("v")), "broken") == []
    nested = one(spark, P.parse_nested(F.col("v")), v='{"attributes": [{"attribute_key": "k", "value": 3}]}')
    assert [(a["attribute_key"], a["value"], a["key_priority"]) for a in nested] == [("k", "3", None)]
    assert one(spark, P.parse_nested(F.col("v")), v="oops") == []
    assert one(spark, P.parse_model_list(F.col("v")), v="['a:b:c', 'x']") == ["a:b:c"]
    assert one(spark, P.parse_model_list(F.col("v")), v="a:b:c\nx:y, d:e:f") == ["a:b:c", "d:e:f"]
    assert one(spark, P.parse_model_list(F.col("v")), v="[not json:a:b]") == ["[not json:a:b]"]
    assert one(spark, P.rescue_json(F.col("v"), "fenced"), v="x ```json\n{\"a\": 1}\n``` y") == '{"a": 1}'
    assert one(spark, P.top_label(F.col("v"))["name"], v="[]") == ""


def test_format_groups(attrs):
    rows = [(1, "make", "X", 2, 2), (1, "brand", "X", 1, 2), (1, "power", "5 hp", 1, 1)]
    assert reshape.format_groups(attrs(rows)).first()["formatted"] == "5 hp - power |||| X - brand | make"


def test_wide_round_trip_and_overflow(attrs):
    a = attrs([(1, "b", "2"), (1, "a", "1"), (1, "c", "3")])
    row = reshape.widen(a, 2).first()
    assert (row["attr_key_1"], row["attr_value_2"], row["overflow"]) == ("a", "2", 1)
    assert reshape.widen_auto(a).columns == ["qid"] + [f"attr_{k}_{i}" for i in (1, 2, 3) for k in ("key", "value")]


def test_rate_bucket_bounds(spark):
    counts = spark.createDataFrame(
        [(0, 4), (1, 8), (1, 4), (2, 4), (3, 4), (4, 4), (0, 0)], "matched_keys bigint, gt_keys bigint"
    )
    got = {r["bucket"]: r["n"] for r in metrics.rate_buckets(counts).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_canonical_first_entry_wins(spark):
    table = vocabulary.synonym_table(spark)
    df = spark.createDataFrame([("Type",), ("product__type",), ("part-type",), ("power kw",), ("other key",)], "k string")
    got = {r["k"]: r["canonical_key"] for r in N.canonical_key(df, "k", table).collect()}
    assert got == {
        "Type": "motor type", "product__type": "motor type", "part-type": "part type", "power kw": "power kw", "other key": "other key",
    }
    from extracteval.functions.lexicon import FOLDED_KEYS

    folded = vocabulary.synonym_table(spark, folded=FOLDED_KEYS)
    got = {r["k"]: r["canonical_key"] for r in N.canonical_key(df, "k", folded).collect()}
    assert (got["part-type"], got["power kw"]) == ("product type", "power")


def tags(df):
    return {(r["facet"], r["value"]) for r in df.collect()}


def test_motor_texts(spark):
    def texts(t):
        return spark.createDataFrame([(1, t)], "qid bigint, query string")

    assert tags(tagging.tag_motor_types(texts("सर्वो मोटर 5 hp"))) == {("motor_type", "servo motor")}
    assert tags(tagging.tag_motor_types(texts("old motars"))) == {("motor_type", "motor")}
    assert ("power", "5 HP") in tags(tagging.tag_quantities(texts("5hp 7.5 kw motor 415v")))
    assert ("power_kw", "7.5 KW") in tags(tagging.tag_quantities(texts("5hp 7.5 kw motor 415v")))
    assert ("weight", "5 kg") in tags(tagging.tag_quantities(texts("5 kg load")))
    assert ("weight", "50 gm") in tags(tagging.tag_quantities(texts("50 grams")))
    assert tags(tagging.tag_all_quantities(texts("220v or 440 volt or 220v, 1440 rpm"))) == {
        ("voltage", "220v"), ("voltage", "440v"), ("speed", "1440 rpm"),
    }
    assert tags(tagging.tag_model(texts("drive ABC-1234 220V"))) == {("model_number", "ABC-1234")}
    assert tags(tagging.tag_model(texts("220V 5HP"))) == set()
    brands = tagging.dictionary(spark, {"crompton": "Crompton", "crompton greaves": "Crompton Greaves", "ge": "GE", "abb": "ABB", "spg": "SPG"})
    lenient = lambda t: tags(tagging.tag_dictionary(texts(t), brands, "lenient"))
    assert lenient("new Crompton Greaves fan") == {("brand", "Crompton Greaves")}
    assert lenient("gear motor") == set() and lenient("ge motor") == {("brand", "GE")}
    assert lenient("xabbx") == {("brand", "ABB")} and lenient("xspgx") == set() and lenient("a (spg) b") == {("brand", "SPG")}
    strict = lambda t: tags(tagging.tag_dictionary(texts(t), brands, "boundary"))
    assert strict("xabbx") == set() and strict("abbmotor") == {("brand", "ABB")} and strict("fan-abb/2") == {("brand", "ABB")}
    assert strict("motor (abb)") == {("brand", "ABB")}


def test_literals_are_necessary():
    import re

    from extracteval.functions import lexicon as L

    assert tagging.literals(r"\bsteel\b|\bsoft\s*start") == ["steel", "soft"]
    assert tagging.literals("colou?r") == ["colo"] and tagging.literals("(a|b)c") is None and tagging.literals("x*y") is None
    patterns = [*L.CATEGORIES.values(), *L.MATERIALS.values(), *[p for rules in L.FIRST_OF.values() for p, _ in rules]]
    words = ["soft  start", "slipring", "slip ring", "gearbox", "nema 17", "foot mount", "steel", "drip proof", "b35", "brushes", "dc motor", "tp 3ph"]
    guarded = 0
    for p in patterns:
        need = tagging.literals(p)
        guarded += need is not None
        for w in words:
            if need is not None and re.search(p, w):
                assert any(t in w for t in need)
    assert guarded > 50


def test_reference_reads_decoded_texts(spark):
    texts = spark.createDataFrame([(1, "dol%20starter%20415v"), (2, "siemens induction motor with encoder"), (3, "rotary encoder"), (4, "motor 1FK2104-5AF"), (5, "100%25 c+d 5%")], "qid bigint, query string")
    got = {}
    for r in tagging.reference_tags(texts).collect():
        got.setdefault(r["qid"], {}).setdefault(r["facet"], []).append(r["value"])
    assert got[1]["voltage"] == ["415v"]
    assert "motor_type" in got[2] and "product_category" not in got[2]
    assert got[3]["product_category"] == ["encoder"]
    assert got[4]["model_number"] == ["1FK2104-5AF"]
    assert texts.filter("qid = 5").select(percent_decode(F.col("query"))).first()[0] == "100% c+d 5%"


def test_assembled_reference_has_brand_frame_and_kv(spark):
    rows = [(1, "abb motor frame size 132 920kv"), (2, "CG power master pump 5 hp"), (3, "havellsx 2200 KV 90 frame"), (4, "shelf%20l%26t/v-guard stabiliser"), (5, "grey bulb"), (6, None), (7, "")]
    texts = spark.createDataFrame(rows, "qid bigint, query string")
    got = {}
    for r in sorted(tagging.assemble_reference(texts).collect(), key=lambda r: (r["qid"], r["attribute_priority"], r["key_priority"])):
        got.setdefault(r["qid"], []).append((r["attribute_key"], r["value"], r["key_priority"], r["attribute_priority"]))
    assert [x for x in got[1] if x[2] == 1] == [("brand", "abb", 1, 1), ("motor_type", "motor", 1, 2), ("frame_size", "132", 1, 3), ("kv_rating", "920 kv", 1, 4)]
    assert got[1][:3] == [("brand", "abb", 1, 1), ("manufacturer", "abb", 2, 1), ("company", "abb", 3, 1)]
    assert got[2][0][1] == "power master"  # the longest of names that overlap
    values = lambda q, key: [v for k, v, *_ in got.get(q, []) if k == key]
    assert values(3, "brand") == ["havells"] and values(3, "frame") == ["90"] and values(3, "kv") == ["2200 kv"]
    assert values(4, "brand") == ["v-guard"] and not values(5, "brand") and 6 not in got and 7 not in got


def test_assembling_the_reference_shuffles_nothing(spark):
    texts = spark.createDataFrame([(1, "abb motor")], "qid bigint, query string")
    plan = tagging.assemble_reference(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


def test_assembled_in_row_as_from_tags(spark, sf_dir):
    from extracteval.plans import fixtures as fx

    texts = fx.specs(spark, sf_dir).limit(400)
    columns = ["qid", "attribute_key", "value", "key_priority", "attribute_priority"]
    a = tagging.assemble(tagging.reference_tags(texts)).select(*columns).collect()
    assert sorted(map(tuple, tagging.assemble_reference(texts).select(*columns).collect())) == sorted(map(tuple, a))


def test_one_map_per_query(spark):
    texts = [
        "Crompton+Greaves 5 HP three phase 415v 1440 rpm flange mounted motor",
        "abb%20servo motor 2.5 kw 1 phase foot mount aluminium",
        "xspg winding",
        "spg motor",
        "moter",
        "banana",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "qid int, query string")
    got = {r["qid"]: r["attributes"] for r in tagging.query_attributes(df).collect()}
    assert {k: got[0][k] for k in ("brand", "power", "phase", "voltage", "speed", "mounting")} == {
        "brand": "Crompton Greaves", "power": "5 HP", "phase": "three phase", "voltage": "415V", "speed": "1440 RPM", "mounting": "flange mounted",
    }
    assert {k: got[1][k] for k in ("brand", "power", "phase", "motor_type", "mounting", "material")} == {
        "brand": "ABB", "power": "2.5 KW", "phase": "single phase", "motor_type": "servo motor", "mounting": "foot mounted", "material": "aluminium",
    }
    assert "brand" not in got[2] and got[3]["brand"] == "SPG"
    assert got[4] == {"product_type": "motor"} and got[5] == {} and not got[6]
    assert "Exchange" not in tagging.query_attributes(df)._jdf.queryExecution().executedPlan().toString()


def test_records_of_three_tasks(spark):
    pools = spark.createDataFrame([(k, f"{k} {i}") for k in ("color", "size", "brand") for i in range(9)], "key string, value string")
    rows = jobs.multitask_records(pools, 200, "m").collect()
    assert {t: sum(r["task"] == t for r in rows) for t in L.TASK_RATIOS} == {"isq_extraction": 120, "query_correction": 40, "translation": 40}
    assert sorted(r["place"] for r in rows) == list(range(1, 201)) and sum(r["split"] == "train" for r in rows) == 180
    for r in rows:
        text = r["instruction"].split("\n\n", 1)[1].split(": ", 1)[1]
        if r["task"] == "isq_extraction":
            made = json.loads(r["output"])
            assert text.startswith(made["product"]) and len(made) in (3, 4)
            left = text[len(made["product"]) :].strip()
            for v in [v for k, v in made.items() if k != "product"]:
                left = left.replace(v, "", 1)
            assert not left.strip()
        elif r["task"] == "query_correction":
            assert any(r["output"].startswith(p) for p in L.PRODUCTS)
        else:
            back = {v: k for k, v in L.TRANSLATIONS.items()}
            assert r["output"] != text and set("".join(back)) & set(r["output"] + text)
    assert [tuple(r) for r in jobs.multitask_records(pools, 200, "m").orderBy("place").collect()] == sorted((tuple(r) for r in rows), key=lambda t: t[4])
