"""Parsers for the encodings extractors emit. Each is one expression over a column and
returns ``array<struct<pos, key, value>>`` unless it says otherwise; broken cells give an
empty array, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import API_MAP, LABEL_LIST, NESTED
from .normalize import squeeze, strip, unquote_value

ENTRIES = "array<struct<pos:int,key:string,value:string>>"

# one quoted Python string, with escapes
_ITEM = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
_LIST = rf"(?s)^\s*\[\s*(?:(?:{_ITEM})(?:\s*,\s*(?:{_ITEM}))*\s*,?\s*)?\]\s*$"


def _number(entries: Column) -> Column:
    """Give the surviving entries positions 1..n."""
    return F.transform(
        entries,
        lambda e, i: F.struct((i + 1).cast("int").alias("pos"), e["key"].alias("key"), e["value"].alias("value")),
    )


def _key_value(items: Column, min_parts: int, exact: bool, key_of, value_of) -> Column:
    """Split ``value:key[:type]`` items and keep those with enough parts."""
    parts = F.transform(items, lambda s: F.split(s, ":", -1))
    parts = F.filter(parts, lambda p: (F.size(p) == min_parts) if exact else (F.size(p) >= min_parts))
    return F.transform(
        parts,
        lambda p: F.struct(key_of(F.get(p, F.lit(1))).alias("key"), value_of(F.get(p, F.lit(0))).alias("value")),
    )


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(None).cast(ENTRIES), F.from_json(F.lit("[]"), ENTRIES))


def parse_isq_list(c: Column, normalise: bool = True) -> Column:
    """A Python list literal of ``value:key:type`` strings. The whole cell is dropped when
    it is not a well-formed list; entries need a non-empty key when normalising."""
    norm = unquote_value if normalise else strip
    bare = F.transform(
        F.regexp_extract_all(c, F.lit(f"({_ITEM})"), 1),
        lambda s: F.regexp_replace(
            F.regexp_replace(F.regexp_replace(s, r"(?s)^.(.*).$", "$1"), r"(?s)\\(.)", "$1"),
            r"""^[\s"']+|[\s"']+$""",
            "",
        ),
    )
    found = _key_value(bare, 2, False, norm, norm)
    if normalise:
        found = F.filter(found, lambda e: e["key"] != "")
    return _or_empty(F.when(c.rlike(_LIST), _number(found)))


def parse_isq_lenient(c: Column, normalise: bool = True) -> Column:
    """The forgiving reader: brackets go anywhere, doubled quotes become single ones, and
    items end wherever a quote, a comma and a quote follow each other."""
    norm = unquote_value if normalise else strip
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\[\]]", ""), '""', '"'), "''", "'")
    items = F.transform(
        F.split(text, r"""['"],\s*['"]""", -1),
        # white space, then double quotes, then single quotes, in that order
        lambda s: F.regexp_replace(F.regexp_replace(strip(s), '^"+|"+$', ""), "^'+|'+$", ""),
    )
    found = _key_value(F.filter(items, lambda s: s.contains(":")), 2, False, norm, norm)
    if normalise:
        found = F.filter(found, lambda e: e["key"] != "")
    return _or_empty(_number(found))


def parse_isq_pipe(c: Column, strict: bool = True) -> Column:
    """``value:key:type | value:key:type``. Strict entries have exactly three parts and
    lower-case values; lenient ones at least two, a key and a value."""
    items = F.transform(F.split(c, r"\|", -1), lambda s: strip(s))
    if strict:
        found = _key_value(items, 3, True, strip, lambda v: F.lower(strip(v)))
    else:
        found = F.filter(
            _key_value(items, 2, False, strip, strip), lambda e: (e["key"] != "") & (e["value"] != "")
        )
    return _or_empty(_number(found))


def last_wins(entries: Column) -> Column:
    """Map entries with each key once, in its first place with its last value, as an object that is
    read key by key has it. Entries without repeats are returned as they are."""
    keys = F.transform(entries, lambda e: e["key"])
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(F.transform(F.array_distinct(keys), last))


def parse_flat_map(c: Column) -> Column:
    """A flat JSON object, or a Python dict literal; both sides are unquoted and lower-cased. Of a
    repeated key the last value counts."""
    as_map = "map<string,string>"
    single = {"allowSingleQuotes": "true"}
    repaired = F.from_json(F.translate(c, "'", '"'), as_map)
    entries = last_wins(F.map_entries(F.coalesce(repaired, F.from_json(c, as_map, single))))
    found = F.transform(
        entries, lambda e: F.struct(unquote_value(e["key"]).alias("key"), unquote_value(e["value"]).alias("value"))
    )
    return _or_empty(_number(F.filter(found, lambda e: e["key"] != "")))


def parse_nested(c: Column) -> Column:
    """``{"attributes": [...]}`` to an array of attribute structs; broken cells are empty.
    (from_json gives a struct of nulls on garbage, so the inner field is tested.)"""
    return F.coalesce(F.from_json(c, NESTED)["attributes"], F.array().cast(NESTED["attributes"].dataType))


# Where each policy takes the JSON text from.
RESCUE_POLICIES = {
    "outermost": r"(?s)(\{.*\})",
    "shortest": r"(?s)(\{.*?\})",
    "no_inner_brace": r"(\{[^}]+\})",
    "fenced": r"(?s)```(?:json)?\s*(.*?)```",
}


def rescue_json(c: Column, policy: str = "outermost") -> Column:
    """The JSON part of free text, or null. ``fenced`` falls back to the whole text."""
    found = F.nullif(strip(F.regexp_extract(c, RESCUE_POLICIES[policy], 1)), F.lit(""))
    return F.coalesce(found, strip(c)) if policy == "fenced" else found


def parse_model_list(c: Column) -> Column:
    """A list a model wrote: JSON if it is bracketed, else split at newlines and commas.
    Returns ``array<string>`` of the items with exactly two colons."""
    text = F.translate(strip(c), "'", '"')
    loose = F.filter(F.transform(F.split(text, r"[\n,]", -1), lambda s: strip(s)), lambda s: s != "")
    bracketed = text.startswith("[") & text.endswith("]")
    parsed = F.from_json(text, "array<string>")
    items = F.when(bracketed, F.coalesce(parsed, F.array(text))).otherwise(loose)
    keep = F.filter(items, lambda s: F.length(s) - F.length(F.translate(s, ":", "")) == 2)
    return F.coalesce(keep, F.array().cast("array<string>"))


def _isq(e: Column) -> Column:
    return F.concat_ws(
        ":",
        F.coalesce(e["attr_value"], F.lit("")),
        F.coalesce(e["attr_name"], F.lit("")),
        F.coalesce(e["attr_type"], F.lit("")),
    )


def flatten_api_attrs(c: Column, nested: bool = True) -> Column:
    """Token map -> ``array<string>`` of ``value:name:type``. With ``nested``, entries named
    ``-`` are skipped together with their ``others``, and an ``others`` item is added only
    if the list does not have it yet; without, every top entry is kept as it is."""
    tops = F.map_values(F.from_json(c, API_MAP))
    if not nested:
        return F.coalesce(F.transform(tops, _isq), F.array().cast("array<string>"))
    none = F.array().cast("array<struct<isq:string,top:boolean>>")
    listed = F.transform(
        F.filter(tops, lambda e: F.coalesce(e["attr_name"], F.lit("")) != "-"),
        lambda e: F.concat(
            F.array(F.struct(_isq(e).alias("isq"), F.lit(True).alias("top"))),
            F.coalesce(
                F.transform(
                    F.filter(e["others"], lambda o: F.coalesce(o["attr_name"], F.lit("")) != "-"),
                    lambda o: F.struct(_isq(o).alias("isq"), F.lit(False).alias("top")),
                ),
                none,
            ),
        ),
    )
    flat = F.flatten(listed)
    seen = F.filter(
        flat,
        lambda e, i: e["top"]
        | ~F.array_contains(F.transform(F.slice(flat, F.lit(1), i), lambda p: p["isq"]), e["isq"]),
    )
    return F.coalesce(F.transform(seen, lambda e: e["isq"]), F.array().cast("array<string>"))


def top_label(c: Column) -> Column:
    """First candidate of a JSON label list as ``struct<name,id,accuracy>``, blanks if none."""
    first = F.try_element_at(F.from_json(c, LABEL_LIST), F.lit(1))
    return F.struct(*[F.coalesce(first[f], F.lit("")).alias(f) for f in ("name", "id", "accuracy")])


# The openings under which an instruction carries its entity, in match order.
ENTITY_PATTERNS = [
    r"Product Name:\s*(.+?)(?:\n|$)",
    r"Product:\s*(.+?)(?:\n|$)",
    r"Given:\s*(.+?)(?:\n|$)",
    r'searching for:\s*"(.+?)"',
]


def invert_template(c: Column) -> Column:
    """Recover the entity an instruction was rendered for; '' if no pattern fits."""
    hits = [F.nullif(strip(F.regexp_extract(c, p, 1)), F.lit("")) for p in ENTITY_PATTERNS]
    return F.coalesce(*hits, F.lit(""))


def sort_attrs(c: Column) -> Column:
    """Entries by key, equal keys in their old order."""
    return F.transform(
        F.array_sort(
            F.transform(c, lambda e: F.struct(e["key"].alias("key"), e["pos"].alias("pos"), e["value"].alias("value")))
        ),
        lambda e: F.struct(e["pos"].alias("pos"), e["key"].alias("key"), e["value"].alias("value")),
    )


def unpivot_attrs(df: DataFrame, n: int = 9, key: str = "attr_key_{}", value: str = "attr_value_{}") -> DataFrame:
    """Wide key/value column pairs to rows; pairs with a null or blank key are dropped.
    A projection with a generator: no shuffle."""
    pairs = [
        F.struct(F.lit(i).alias("pos"), F.col(key.format(i)).alias("key"), F.col(value.format(i)).alias("value"))
        for i in range(1, n + 1)
    ]
    wide = {c for i in range(1, n + 1) for c in (key.format(i), value.format(i))}
    rest = [c for c in df.columns if c not in wide]
    return (
        df.select(*rest, F.explode(F.array(*pairs)).alias("_p"))
        .filter(F.col("_p.key").isNotNull() & (strip(F.col("_p.key")) != ""))
        .select(
            *rest,
            F.col("_p.pos").alias("pos"),
            unquote_value(F.col("_p.key")).alias("attribute_key"),
            unquote_value(F.col("_p.value")).alias("value"),
        )
    )


def profile_attrs(attributes: Column, success: Column) -> list[Column]:
    """Distinct lower-case values, entry count and success of one nested result."""
    values = F.transform(attributes, lambda a: F.lower(strip(F.coalesce(a["value"], F.lit("")))))
    return [
        F.when(success, F.size(F.array_distinct(values))).otherwise(0).alias("unique_value_count"),
        F.when(success, F.size(attributes)).otherwise(0).alias("total_key_count"),
        success.alias("success"),
    ]


# Words that mark a facet in a query.
FACET_WORDS = {
    "has_color": "red|blue|green|black|white|yellow|pink|brown|grey|orange|purple|golden|silver",
    "has_location": "noida|delhi|mumbai|bangalore|pune|hyderabad|chennai|kolkata|ahmedabad|jaipur",
    "has_size": r"\d+kg|\d+mm|\d+cm|size \d+|\d+ inch|\d+ liter|waist \d+",
    "has_material": "cotton|leather|plastic|steel|aluminum|wood|glass|ceramic|metal",
}


def query_features(df: DataFrame, text: str = "query") -> DataFrame:
    """Length, word count and facet flags of each text."""
    flags = [F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False)).alias(n) for n, p in FACET_WORDS.items()]
    words = F.size(F.split(squeeze(F.col(text)), " "))
    return df.select(
        "*",
        F.length(text).cast("bigint").alias("query_length"),
        F.when(squeeze(F.col(text)) == "", 0).otherwise(words).cast("bigint").alias("word_count"),
        *flags,
    )
