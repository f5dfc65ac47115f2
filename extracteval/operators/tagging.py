"""Dictionary, regex and rule tagging over a table of texts.

Rules that are fixed patterns are column expressions: the tags of a text are built inside
its row and nothing is shuffled. Dictionaries are tables. To find which names occur in
which texts without comparing every text with every name, each text position emits digests
of short chunks that are equi-joined with one key of each name, the rarest of its chunks;
the candidate is then checked in full. Nothing is cut: every position of the whole text
takes part.

Tag relations are ``(qid, facet, value, ord)``.
"""

from __future__ import annotations

import re
import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.normalize import clean_query, percent_decode, squeeze
from ..functions.spreading import deal
from ..functions.tables import fits_broadcast, small_table
from ..schemas import PREDICTION
from ..session import materialise

LADDER = (1, 2, 4)  # bytes of the chunks that names are keyed by
_STRETCH = 1 << 16
_SAMPLE = 16


def dictionary(spark: SparkSession, entries: Mapping[str, str] | Iterable[tuple], facet: str = "brand") -> DataFrame:
    """A small fixed dictionary as a table ``(facet, name, canonical, rank)``."""
    items = entries.items() if isinstance(entries, Mapping) else entries
    rows = [(facet, n, c, i) for i, (n, c) in enumerate(items)]
    return small_table(spark, rows, "facet string, name string, canonical string, rank int")


def facet_dictionary(spark: SparkSession, facets: Mapping[str, Mapping[str, str]] = L.KEYWORD_FACETS) -> DataFrame:
    rows = [(f, n, c, i) for f, words in facets.items() for i, (n, c) in enumerate(words.items())]
    return small_table(spark, rows, "facet string, name string, canonical string, rank int")


def _chunk_size(n: Column) -> Column:
    """The length of a name's key: the longest of the ladder that fits into it."""
    size = F.lit(LADDER[0])
    for k in LADDER[1:]:
        size = F.when(n >= k, k).otherwise(size)
    return size


def _bytes(texts: DataFrame, text: Column, on: str) -> DataFrame:
    """Texts as UTF-8 in ``_x``. A place in bytes is found at once, and a name's bytes stand nowhere
    but at the start of a character."""
    return texts.select(on, text.cast("binary").alias("_x"))


def _chunks(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Every chunk of the given sizes in ``_x``: its place ``_at`` and its digest ``_key``. Places are
    numbered in stretches, so that a very long text makes no very long list."""
    # sizes are never null, and the generators are outer ones: the optimiser would otherwise test
    # the texts for null on their own, and work them out twice
    total = F.coalesce(F.octet_length("_x"), F.lit(0))
    number, most = len(sizes), total - 1
    size = F.lit(sizes[0])
    for i, k in list(enumerate(sizes))[1:]:
        size = F.when(F.col("_i") % number == i, k).otherwise(size)
    rows = rows.select("*", F.explode_outer(F.when(most >= 0, F.sequence(F.lit(0), most, F.lit(_STRETCH)))).alias("_s"))
    rows = rows.select("*", F.explode_outer(F.sequence(F.lit(0), F.least(F.lit(_STRETCH - 1), most - F.col("_s")) * number + number - 1)).alias("_i"))
    rows = rows.select("*", (F.col("_s") + F.expr(f"_i div {number}")).cast("int").alias("_at"), size.alias("_k"))
    # a chunk that does not fit is none
    return rows.where(F.col("_at") + F.col("_k") <= total).withColumn("_key", F.xxhash64(F.expr("substring(_x, _at + 1, _k)")))


def _keyed(rows: DataFrame, names: DataFrame, sizes: list[int], on: str, small: bool) -> DataFrame:
    """The names with one key each, ``_off`` bytes into the name: the one of its chunks that the texts
    have least often and, of those, the one that the fewest names have. One text in ``_SAMPLE`` is
    counted; that chooses keys and nothing else."""
    near = F.broadcast if small else lambda df: df
    size = _chunk_size(F.octet_length("_x"))
    each = names.select("name", F.col("name").cast("binary").alias("_x")).distinct().select("name", "_x", F.explode(F.sequence(F.lit(0), F.octet_length("_x") - size)).alias("_off"), size.alias("_k"))
    each = each.select("name", "_off", F.xxhash64(F.expr("substring(_x, _off + 1, _k)")).alias("_key"))
    shared = each.groupBy("_key").agg(F.count(F.lit(1)).alias("_names"))
    sample = rows.where(F.pmod(F.xxhash64(F.col(on), F.lit("sample")), F.lit(_SAMPLE)) == 0)
    counts = _chunks(sample, sizes).select("_key").join(near(shared), "_key", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    known = shared.join(near(counts), "_key", "left")
    rarest = F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_names").alias("names"), F.col("_off").alias("off"), F.col("_key").alias("key"))
    chosen = each.join(near(known), "_key").groupBy("name").agg(F.min(rarest).alias("_c"))
    return names.join(near(chosen.select("name", F.col("_c.off").alias("_off"), F.col("_c.key").alias("_key"))), "name")


def dictionary_candidates(texts: DataFrame, names: DataFrame, text: Column, on: str = "qid") -> DataFrame:
    """Places where a name's key stands in a text: the name's columns, ``_off``, ``_at`` and the text's
    bytes ``_x``. A dictionary that is measured to be small is looked up beside the texts; for another
    one a text's digest, place and key are shuffled, and the text is fetched for what is found."""
    sized = _chunk_size(F.octet_length("name"))
    names = names.where(F.octet_length("name") > 0)
    rows, chars, sizes = names.agg(F.count(F.lit(1)), F.sum(F.length("name") + F.length("canonical" if "canonical" in names.columns else "name")), F.collect_set(sized)).first()
    sizes = sorted(sizes) or [1]
    read = _bytes(texts, text, on)
    small = fits_broadcast(rows, chars or 0)
    keyed = materialise(_keyed(read, names, sizes, on, small), "dictionary")
    # what is found is grouped before its shuffle: by the texts of one task, not of a whole row group
    read = deal(read, texts.count(), on, "_x")
    if small:
        return _chunks(read, sizes).join(F.broadcast(keyed), "_key")
    read = read.withColumn("_text", F.xxhash64("_x"))
    found = _chunks(read, sizes).select(on, "_text", "_at", "_key").join(keyed, "_key").drop("_key")
    return found.join(read.distinct(), [on, "_text"])


def dictionary_hits(texts: DataFrame, names: DataFrame, text: Column, on: str = "qid") -> DataFrame:
    """Every occurrence of every dictionary name in every text, as the name's columns plus
    ``before``/``after`` (the two characters around it, '' at the edges) and ``at_start``.

    Names are keyed by their rarest chunk, see :func:`dictionary_candidates`, so names that share a
    frequent start do not meet each other's texts; what is found is compared in full."""
    begin, size = F.col("_at") - F.col("_off"), F.octet_length("name")
    cut = lambda start, n: F.substring("_x", start + 1, n).cast("string")
    # four bytes before hold the whole character before, eight bytes after two whole ones
    before = F.right(cut(F.greatest(begin - 4, F.lit(0)), F.least(F.lit(4), begin)), F.lit(1))
    return (
        dictionary_candidates(texts, names, text, on)
        .where((begin >= 0) & (F.substring("_x", begin + 1, size) == F.col("name").cast("binary")))
        .select(
            on,
            *names.columns,
            (begin == 0).alias("at_start"),
            F.when(begin == 0, "").otherwise(before).alias("before"),
            F.substring(cut(begin + size, F.lit(8)), 1, 2).alias("after"),
        )
    )


def _edge(c: Column, chars: str) -> Column:
    """At a text edge or next to one of ``chars`` (a regex class body)."""
    return (c == "") | F.substring(c, 1, 1).rlike(f"(?U)[{chars}]")


def tag_dictionary(texts: DataFrame, names: DataFrame, mode: str = "boundary", on: str = "qid", text: str = "query") -> DataFrame:
    """The longest dictionary name in each text, as ``(qid, facet, value, ord)``.

    ``boundary``: the name stands between spaces, hyphens, slashes or text edges, in the
    text or in its punctuation-free form; failing that, the text starts with it.
    ``lenient``: between spaces, commas or edges (or before 's), or anywhere if it has at
    least three characters; guarded names need word boundaries. Ties: lower rank.
    """
    raw = F.lower(F.trim(F.col(text)))
    if mode == "boundary":
        plain = squeeze(F.regexp_replace(raw, r"(?U)[^\p{L}\p{M}\p{N}\s&.]", " "))
        forms = texts.select(on, F.explode(F.array_distinct(F.array(raw, plain))).alias("_form"))
        hits = dictionary_hits(forms, names, F.col("_form"), on)
        delimited = _edge(F.col("before"), r"\s/\-") & _edge(F.col("after"), r"\s/\-")
        tier = F.when(delimited, 2).when(F.col("at_start"), 1)
    elif mode == "lenient":
        hits = dictionary_hits(texts, names, F.lower(clean_query(F.col(text))), on)
        delimited = _edge(F.col("before"), r"\s,") & (_edge(F.col("after"), r"\s,") | (F.col("after") == "'s"))
        word = ~F.col("before").rlike(r"(?U)\w") & ~F.substring("after", 1, 1).rlike(r"(?U)\w")
        guarded = F.col("name").isin(L.GUARDED_NAMES)
        inside = (F.length("name") >= L.SUBSTRING_MIN_LENGTH) & (~guarded | word)
        tier = F.when(delimited | inside, 1)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    order = F.struct(tier.alias("t"), F.length("name").alias("n"), (-F.col("rank")).alias("r"))
    return (
        hits.filter(tier.isNotNull())
        .groupBy(on, "facet")
        .agg(F.max_by("canonical", order).alias("value"))
        .withColumn("ord", F.lit(1))
    )


def tag_keyword_facets(
    texts: DataFrame,
    names: DataFrame,
    exclusive: Mapping[str, str] = L.EXCLUSIVE_FACETS,
    on: str = "qid",
    text: str = "query",
) -> DataFrame:
    """Per facet the canonical form of the longest keyword contained in the text; a facet
    listed in ``exclusive`` only counts where its counterpart found nothing.

    Facets that rule each other out are found in one group of a text, side by side, so the hits are
    looked for and grouped once. Texts without a key have nothing ruled out."""
    order = F.struct(F.length("name").alias("n"), (-F.col("rank")).alias("r"))
    linked = list(dict.fromkeys([*exclusive, *exclusive.values()]))
    together = F.coalesce(F.col("facet").isin(linked) & F.col(on).isNotNull(), F.lit(False)) if linked else F.lit(False)
    found = F.struct("facet", F.col("canonical").alias("value"))
    best = lambda of: F.max_by(found, F.when(of, order))
    rows = (
        dictionary_hits(texts, names, F.lower(clean_query(F.col(text))), on)
        .groupBy(on, together.alias("_together"), F.when(~together, F.col("facet")).alias("_facet"))
        .agg(best(~together).alias("_own"), *[best(F.col("facet") == f).alias(f"_linked{i}") for i, f in enumerate(linked)])
    )
    left = {f: F.when(F.col("_together"), F.col(f"_linked{i}")) for i, f in enumerate(linked)}
    for second, first in exclusive.items():
        left[second] = F.when(left[first].isNull(), left[second])
    rows = rows.select(on, F.explode(F.array("_own", *left.values())).alias("_f")).where("_f is not null")
    return rows.select(on, "_f.facet", "_f.value").withColumn("ord", F.lit(1))


def tag_multi_dictionary(texts: DataFrame, names: DataFrame, on: str = "qid", text: str = "query") -> DataFrame:
    """Every label with a keyword contained in the text."""
    return (
        dictionary_hits(texts, names, F.lower(F.col(text)), on)
        .groupBy(on, "facet", F.col("canonical").alias("value"))
        .agg(F.min("rank").alias("ord"))
    )


# -------------------------------------------------------------------- row-local pattern tags
#
# A family is a function that gives entries, array-valued tag columns over the forms of a text:
# _raw as it is, _low lower-case, _trim the same without blanks around, _clean decoded and lower-case, _plain without punctuation.
# Any number of families is evaluated in one projection over one scan.


def _forms(texts: DataFrame, on: str, text: str) -> DataFrame:
    c = F.col(text)
    # letters of every script stay: the patterns include Devanagari spellings
    plain = squeeze(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{M}\p{N}\s.&]", " "))
    return texts.select(
        on, c.alias("_raw"), F.lower(F.trim(c)).alias("_trim"), F.lower(c).alias("_low"), F.lower(clean_query(c)).alias("_clean"), plain.alias("_plain")
    )


def tag_rules(texts: DataFrame, families: Sequence[list[Entry]], on: str = "qid", text: str = "query") -> DataFrame:
    """The tags of all families, in one pass: projections and generators, no shuffle.

    The entries are built by expressions without lambdas, so they are compiled; nulls are
    dropped after the rows are made. (The outer generator keeps the optimiser from testing
    the array for emptiness first, which would evaluate all patterns twice.)"""
    entries = F.array(*[e.cell() for family in families for e in family])
    return (
        _forms(texts, on, text)
        .select(on, entries.alias("_e"))
        .select(on, F.explode_outer("_e").alias("_e"))
        .select(on, "_e.facet", "_e.suffix", F.posexplode_outer("_e.values").alias("_i", "_v"))
        .filter("_v is not null and _v <> ''")
        .select(on, "facet", F.concat("_v", "suffix").alias("value"), (F.col("_i") + 1).alias("ord"))
    )


class Entry(NamedTuple):
    """The values that a rule finds for a facet, null where there is none, and what follows each."""

    facet: str
    values: Column
    suffix: str

    def cell(self, *more: Column) -> Column:
        return F.struct(F.lit(self.facet).alias("facet"), *more, self.values.alias("values"), F.lit(self.suffix).alias("suffix"))


def _many(facet: str, values: Column, suffix: str = "") -> Entry:
    return Entry(facet, values, suffix)


def _one(facet: str, value: Column) -> Entry:
    return _many(facet, F.array(value))


def _hit(q: Column, pattern: str, group: int = 1) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(q, pattern, group), F.lit(""))


def quantity_tags(rules: Mapping[str, tuple[str, str, str]] = L.QUANTITIES) -> list[Entry]:
    q = F.col("_clean")
    hp, kw, watt = _hit(q, L.HORSEPOWER), _hit(q, L.KILOWATT), _hit(q, L.WATT)
    # a wattage that also stands before the first "v" is a voltage
    plausible = ~q.contains("v") | ~F.substring_index(q, "v", 1).contains(watt)
    watts = F.when(~q.rlike(L.ANY_KW) & plausible, watt)
    gram = F.when(_hit(q, L.WEIGHT + ".{0,3}", 0).contains("kg"), " kg").otherwise(" gm")
    tags = [
        _one("power", F.coalesce(F.concat(hp, F.lit(" HP")), F.concat(kw, F.lit(" KW")), F.concat(watts, F.lit(" W")))),
        _one("power_kw", F.when(hp.isNotNull(), F.concat(kw, F.lit(" KW")))),
        _one("weight", F.concat(_hit(q, L.WEIGHT), gram)),
        _one("kv_rating", F.when(~q.contains("kw"), F.concat(_hit(q, L.KV_RATING), F.lit(" KV")))),
        _one("ip_rating", F.upper(_hit(q, L.IP_RATING))),
        _one("efficiency", F.upper(_hit(q, L.EFFICIENCY_CLASS))),
    ]
    return tags + [_one(f, F.concat(F.lit(a), _hit(q, p), F.lit(b))) for f, (p, a, b) in rules.items()]


def all_quantity_tags() -> list[Entry]:
    q = F.col("_low")
    every = lambda p: F.regexp_extract_all(q, F.lit(p), 1)
    word = F.when(q.rlike(L.HORSEPOWER_WORD) & ~q.rlike(L.HORSEPOWER_NUMBER), "horse power")
    watt = F.coalesce(*[_hit(q, p) for p in L.FIRST_WATT])
    return [
        _one("power_unit", word),
        _one("power_hp", F.concat(_hit(q, L.FIRST_HP), F.lit(" hp"))),
        _one("power_kw", F.concat(_hit(q, L.FIRST_KW), F.lit(" kw"))),
        _one("power_w", F.concat(watt, F.lit(" w"))),
        _many("voltage", F.array_distinct(F.concat(*[every(p) for p in L.ALL_VOLTS])), "v"),
        _many("speed", F.array_distinct(every(L.ALL_SPEEDS)), " rpm"),
    ]


def literals(pattern: str) -> list[str] | None:
    """One piece of plain text per alternative that any match must contain; None where that
    is not evident (groups, classes, or an alternative without two plain characters)."""
    if any(c in pattern for c in "([{"):
        return None
    found = []
    for part in pattern.split("|"):
        plain = re.match(r"(?:\\b)?([^\\.*+?^$]+)", part)
        text = plain[1] if plain else ""
        if plain and part[plain.end() :][:1] in ("*", "?"):
            text = text[:-1]
        if len(text) < 2:
            return None
        found.append(text)
    return found


def matches(q: Column, pattern: str) -> Column:
    """``q.rlike(pattern)``, tried only on texts that contain a necessary literal: a plain
    search costs a fraction of a pattern match, and most patterns miss most texts."""
    need = literals(pattern)
    if need is None:
        return q.rlike(pattern)
    return reduce(lambda a, b: a | b, [q.contains(t) for t in dict.fromkeys(need)]) & q.rlike(pattern)


def first_of(q: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The value of the first rule whose pattern occurs, or null."""
    return F.coalesce(*[F.when(matches(q, p), F.lit(v)) for p, v in rules])


def first_of_tags(rules: Mapping[str, Sequence[tuple[str, str]]] = L.FIRST_OF) -> list[Entry]:
    return [_one(f, first_of(F.col("_low"), r)) for f, r in rules.items()]


def occurs(q: Column, rule: str | Sequence[str]) -> Column:
    """Whether a pattern (a string) or one of several keywords (a list) occurs in the text.
    A keyword that contains another one of its list adds nothing and is not searched for."""
    if isinstance(rule, str):
        return matches(q, rule)
    needed = [w for w in rule if not any(o != w and o in w for o in rule)]
    return reduce(lambda a, b: a | b, [q.contains(w) for w in needed])


def _labels(q: Column, labels: Mapping[str, str | Sequence[str]]) -> Column:
    """The labels that occur, null for the others."""
    return F.array(*[F.when(occurs(q, rule), F.lit(v)) for v, rule in labels.items()])


MULTI_LABEL = {"application": L.APPLICATIONS, "material": L.MATERIALS, "product_category": L.CATEGORIES}


def multi_tags(facets: Mapping[str, Mapping[str, str | Sequence[str]]] = MULTI_LABEL) -> list[Entry]:
    return [_many(f, _labels(F.col("_low"), labels)) for f, labels in facets.items()]


def motor_type_tags() -> list[Entry]:
    q = F.col("_plain")
    named = reduce(lambda a, b: a | b, [occurs(q, words) for words in L.MOTOR_TYPES.values()])
    plain = F.when(~named & q.rlike(L.ANY_MOTOR), F.lit("motor"))
    return [_many("motor_type", _labels(q, L.MOTOR_TYPES)), _one("motor_type", plain)]


def model_number(mode: str = "patterns") -> Column:
    """A model or part number, or null. ``patterns`` reads the original spelling and takes
    the first acceptable hit of the first pattern that has one; ``code`` reads the clean
    form: one known numbering scheme, then the first letters-digits code if it is long
    enough."""
    if mode == "patterns":
        every = F.concat(*[F.regexp_extract_all("_raw", F.lit(p), 1) for p in L.MODEL_PATTERNS])
        good = F.filter(
            every, lambda m: (F.length(m) >= L.MODEL_MIN_LENGTH) & ~m.rlike(L.NOT_A_MODEL)
        )
        return F.get(good, F.lit(0))
    code = _hit(F.col("_clean"), L.MODEL_CODE)
    return F.upper(
        F.coalesce(_hit(F.col("_clean"), L.MODEL_SCHEME), F.when(F.length(code) >= L.MODEL_CODE_MIN_LENGTH, code))
    )


def model_tags(mode: str = "patterns") -> list[Entry]:
    return [_one("model_number", model_number(mode))]


def tag_quantities(texts: DataFrame, rules: Mapping[str, tuple[str, str, str]] = L.QUANTITIES, on: str = "qid", text: str = "query") -> DataFrame:
    """One value per quantity facet: power in its units, voltage, speed, weight, ..."""
    return tag_rules(texts, [quantity_tags(rules)], on, text)


def tag_all_quantities(texts: DataFrame, on: str = "qid", text: str = "query") -> DataFrame:
    """All distinct voltages and speeds in order of appearance, and the first power in each
    unit (or the bare unit word)."""
    return tag_rules(texts, [all_quantity_tags()], on, text)


def tag_first_of(texts: DataFrame, rules: Mapping[str, Sequence[tuple[str, str]]] = L.FIRST_OF, on: str = "qid", text: str = "query") -> DataFrame:
    """Per facet the value of the first of its patterns that occurs."""
    return tag_rules(texts, [first_of_tags(rules)], on, text)


def tag_multi(texts: DataFrame, facets: Mapping[str, Mapping[str, str | Sequence[str]]] = MULTI_LABEL, on: str = "qid", text: str = "query") -> DataFrame:
    """Every label of every facet whose pattern or keyword occurs in the text, in table
    order."""
    return tag_rules(texts, [multi_tags(facets)], on, text)


def tag_motor_types(texts: DataFrame, on: str = "qid", text: str = "query") -> DataFrame:
    """Every motor type named, or plain ``motor`` when only the word (or a misspelling) is."""
    return tag_rules(texts, [motor_type_tags()], on, text)


def tag_model(texts: DataFrame, mode: str = "patterns", on: str = "qid", text: str = "query") -> DataFrame:
    return tag_rules(texts, [model_tags(mode)], on, text)


def fallback_category(texts: DataFrame, tags: DataFrame, on: str = "qid", text: str = "query") -> DataFrame:
    """Texts without any tag get the first product word they contain, if any."""
    untagged = texts.join(tags.select(on).distinct(), on, "left_anti")
    return tag_rules(untagged, [[_one("product_type", first_of(F.col("_clean"), L.LAST_RESORT))]], on, text)


def boundary_brand(names: Mapping[str, str] = L.REFERENCE_BRANDS) -> Column:
    """The brand of the longest name that stands between spaces, hyphens, slashes or text edges, in
    the text or its punctuation-free form; failing that, the longest one the text starts with. For a
    fixed table of names: one pattern per form, that is tried at the starts of words and takes the
    longest name there."""
    order = sorted(names, key=len, reverse=True)
    body = "|".join(re.escape(n) for n in order)
    place = {n: i for i, n in enumerate(order)}
    ranks = F.create_map(*[F.lit(x) for n, i in place.items() for x in (n, i)])
    brands = F.create_map(*[F.lit(x) for n, i in place.items() for x in (i, names[n])])
    at_word = F.lit(rf"(?<![^\s/\-])(?=({body})(?![^\s/\-]))")
    found = F.concat(*[F.regexp_extract_all(F.col(c), at_word, 1) for c in ("_trim", "_plain")])
    start = lambda c: F.regexp_extract(c, f"^({body})", 1)
    begun = F.filter(F.array(start("_trim"), start("_plain")), lambda n: n != "")
    best = lambda found: F.array_min(F.transform(found, lambda n: F.element_at(ranks, n)))
    return F.element_at(brands, F.coalesce(best(found), best(begun)))


def frame_size() -> Column:
    return F.coalesce(*[_hit(F.col(c), p) for c, p in (("_raw", L.FRAME_SIZE), ("_low", L.FRAME_NUMBER))])


def longest_contained(q: Column, names: Mapping[str, str], found: Callable[[str], Column] | None = None) -> Column:
    """The canonical form of the longest name of a fixed table that the text contains (ties: the first
    of the table), where ``found`` holds as well; a plain search per name, inside the row."""
    order = sorted(names, key=len, reverse=True)
    return F.coalesce(*[F.when(q.contains(n) & found(n) if found else q.contains(n), F.lit(names[n])) for n in order])


def lenient_brand(names: Mapping[str, str] = L.BRANDS) -> Column:
    """:func:`tag_dictionary` in lenient mode for a fixed table of names."""
    q = F.col("_clean")

    def found(name: str) -> Column:
        edged = q.rlike(rf"(^|[\s,]){re.escape(name)}([\s,]|$|'s)")
        if len(name) < L.SUBSTRING_MIN_LENGTH:
            return edged
        return edged | q.rlike(rf"(?U)\b{re.escape(name)}\b") if name in L.GUARDED_NAMES else F.lit(True)

    return longest_contained(q, names, found)


def keyword_tags(facets: Mapping[str, Mapping[str, str]] = L.KEYWORD_FACETS, exclusive: Mapping[str, str] = L.EXCLUSIVE_FACETS) -> list[Entry]:
    """:func:`tag_keyword_facets` for fixed tables."""
    values = {f: longest_contained(F.col("_clean"), words) for f, words in facets.items()}
    return [_one(f, F.when(values[exclusive[f]].isNull(), v) if f in exclusive else v) for f, v in values.items()]


def single_value_families() -> list[list[Entry]]:
    """The rules that give one value per facet: brand, quantities, keywords, ordered alternatives, code."""
    alternatives = [_one(f, first_of(F.col("_clean"), r)) for f, r in L.FIRST_OF_SINGLE.items()]
    return [[_one("brand", lenient_brand())], quantity_tags(), keyword_tags(), alternatives, model_tags("code")]


def query_attributes(texts: DataFrame, on: str = "qid", text: str = "query") -> DataFrame:
    """``(on, attributes MAP)``: one map of facet to value per text, from the rules of
    :func:`single_value_families`; a text without any gets the product word of last resort, and an
    empty map where it has none either (null texts too). Inside the row, nothing is shuffled."""
    entries = [e for family in single_value_families() for e in family]
    rows = _forms(texts, on, text).select(on, "_clean", F.array(*[e.cell() for e in entries]).alias("_e"))
    rows = rows.select(on, "_clean", F.explode_outer(F.array("_e")).alias("_e"))
    pair = lambda e: F.struct(e["facet"].alias("key"), F.concat(F.get(e["values"], F.lit(0)), e["suffix"]).alias("value"))
    given = F.transform(F.filter("_e", lambda e: F.get(e["values"], F.lit(0)) != ""), pair)
    rows = rows.select(on, "_clean", F.map_from_entries(given).alias("attributes"))
    last = first_of(F.col("_clean"), L.LAST_RESORT)
    fallback = (F.cardinality("attributes") == 0) & last.isNotNull()
    return rows.select(on, F.when(fallback, F.create_map(F.lit("product_type"), last)).otherwise(F.col("attributes")).alias("attributes"))


def reference_families() -> list[list[Entry]]:
    """The rules of the reference: brand, quantities, model number, motor types, ordered
    alternatives, labels, frame size and KV rating; a product category only without a motor type."""
    motor = [_many("motor_type", _labels(F.col("_plain"), L.MOTOR_TYPES)), _one("motor_type", F.when(F.col("_plain").rlike(L.ANY_MOTOR) & ~_any_motor_named(), F.lit("motor")))]
    no_motor = ~_any_motor_named() & ~F.col("_plain").rlike(L.ANY_MOTOR)
    labels = [_many(f, F.when(no_motor, v) if f == "product_category" else v) for f, v in ((f, _labels(F.col("_low"), t)) for f, t in MULTI_LABEL.items())]
    kv = F.concat(_hit(F.col("_low"), L.KV_RATING), F.lit(" kv"))
    own = [_one("brand", F.lower(boundary_brand())), _one("frame_size", frame_size()), _one("kv_rating", kv)]
    return [own, all_quantity_tags(), motor, first_of_tags(), labels, model_tags("patterns")]


def _any_motor_named() -> Column:
    return reduce(lambda a, b: a | b, [occurs(F.col("_plain"), words) for words in L.MOTOR_TYPES.values()])


def reference_tags(texts: DataFrame, on: str = "qid", text: str = "query") -> DataFrame:
    """The tags of a rule-made reference, from the decoded texts, see :func:`reference_families`."""
    return tag_rules(texts.select(on, percent_decode(F.col(text)).alias(text)), reference_families(), on, text)


def assemble_reference(texts: DataFrame, facet_keys: Mapping[str, Sequence[str]] = L.FACET_KEYS, on: str = "qid", text: str = "query") -> DataFrame:
    """The tags of :func:`reference_tags` as attribute relation, inside the row: entries are listed in
    the order of their facets, so a value's place in the list of those that are there is its priority.
    Neither a join nor a window, and nothing is shuffled."""
    decoded = _forms(texts.select(on, percent_decode(F.col(text)).alias(text)), on, text)
    order = {f: i for i, f in enumerate(facet_keys)}
    entries = sorted((e for family in reference_families() for e in family if e.facet in order), key=lambda e: order[e.facet])
    lists = [e.cell(F.lit(order[e.facet]).alias("f")) for e in entries]
    keys = F.array(*[F.array(*map(F.lit, facet_keys[f])) for f in order])
    given = lambda e: F.transform(F.filter(F.coalesce(e["values"], F.array().cast("array<string>")), lambda v: v != ""), lambda v: F.struct(e["f"].alias("f"), F.concat(v, e["suffix"]).alias("value")))
    rows = decoded.select(on, F.array(*lists).alias("_e")).select(on, F.explode_outer(F.array("_e")).alias("_e"))
    rows = rows.select(on, F.posexplode_outer(F.flatten(F.transform("_e", given))).alias("_p", "_v")).where("_v is not null")
    rows = rows.select(on, F.col("_v.value").alias("value"), (F.col("_p") + 1).alias("attribute_priority"), F.posexplode(F.get(keys, F.col("_v.f"))).alias("_i", "attribute_key"))
    return rows.select(on, "attribute_key", "value", (F.col("_i") + 1).alias("key_priority"), "attribute_priority")


def assemble(tags: DataFrame, facet_keys: Mapping[str, Sequence[str]] = L.FACET_KEYS, on: str = "qid") -> DataFrame:
    """Tags to the attribute relation: facet order (then tag order) numbers the attribute
    priorities, and every value is listed under all keys of its facet. Facets without an
    entry are dropped. The window sees the tags of one text."""
    spark = tags.sparkSession
    order = small_table(
        spark,
        [(f, i, list(ks)) for i, (f, ks) in enumerate(facet_keys.items())],
        "facet string, facet_ord int, keys array<string>",
    )
    ranked = tags.join(order, "facet").withColumn(
        "attribute_priority", F.row_number().over(W.partitionBy(on).orderBy("facet_ord", "ord", "value"))
    )
    return ranked.select(on, "value", "attribute_priority", F.posexplode("keys").alias("_i", "attribute_key")).select(
        on,
        "attribute_key",
        "value",
        (F.col("_i") + 1).alias("key_priority"),
        "attribute_priority",
    )


def vocab_supplements(rules: Sequence[tuple[str, Sequence[str], Sequence[tuple[str, str | None]]]] = L.VOCAB_SUPPLEMENTS) -> list[tuple[str, Sequence[str], Column]]:
    """Pattern rules ``(key, keys that rule it out, value in _low or null)`` after a vocabulary."""
    q = F.col("_low")
    value = lambda alternatives: F.coalesce(*[_hit(q, p, 0) if v is None else F.when(q.rlike(p), F.lit(v)) for p, v in alternatives])
    return [(key, unless, value(alternatives)) for key, unless, alternatives in rules]


def tag_vocab(texts: DataFrame, vocab: DataFrame, priority: DataFrame, on: str = "qid", text: str = "query", supplements: Sequence[tuple] | None = None) -> DataFrame:
    """Tag with a free vocabulary ``(key, value, ord)``: keys in ``priority (key, rank)``
    order, one value per key, no value twice in a text.

    Keys are gone through in order; each takes its first value, by ``ord``, that no key before it
    took. The hits of one text are folded inside its row: they are values of one text, and few.
    ``supplements`` (:func:`vocab_supplements`) follow in their order, with null ``key_rank``: each
    counts where it finds something and none of the keys that rule it out is there."""
    names = (
        vocab.filter(F.length("value") > 1)
        .groupBy("key", "value")
        .agg(F.min("ord").alias("ord"))
        .join(priority, "key")
        .select("key", "value", "ord", F.col("rank").alias("key_rank"), F.lower(F.trim("value")).alias("name"))
        .filter(F.length("name") > 0)
    )
    hits = dictionary_hits(texts, names, F.lower(F.col(text)), on)
    entry = F.struct("key_rank", "key", "ord", "value")
    listed = hits.groupBy(on).agg(F.array_sort(F.collect_set(entry)).alias("_hits"))
    none = F.expr("filter(_hits, x -> false)")
    fold = F.aggregate(
        "_hits",
        none,
        lambda out, x: F.when(
            F.exists(out, lambda o: (o["key"] == x["key"]) | (o["value"] == x["value"])), out
        ).otherwise(F.concat(out, F.array(x))),
    )
    folded = listed.select(on, fold.alias("_found"))
    if not supplements:
        return folded.select(on, F.inline("_found")).select(on, "key", "key_rank", "value")
    rows = texts.select(on, F.lower(F.col(text)).alias("_low")).join(folded.withColumnRenamed(on, "_on"), F.col(on) == F.col("_on"), "left")
    found = F.coalesce(F.transform("_found", lambda x: F.struct(x["key"].alias("key"), x["key_rank"].alias("key_rank"), x["value"].alias("value"))), F.array().cast("array<struct<key:string,key_rank:int,value:string>>"))
    rows = rows.select(on, "_low", found.alias("_found"))
    for key, unless, value in supplements:
        new = F.struct(F.lit(key).alias("key"), F.lit(None).cast("int").alias("key_rank"), value.alias("value"))
        free = value.isNotNull() & ~F.exists("_found", lambda o: o["key"].isin(*unless))
        rows = rows.select(on, "_low", F.when(free, F.concat("_found", F.array(new))).otherwise(F.col("_found")).alias("_found"))
    return rows.select(on, F.inline("_found"))


# ------------------------------------------------------------------------------- predictors


def rules_predictor(queries: pd.Series) -> pd.Series:
    """Default predictor: numbers with the word after them, as attribute JSON."""
    found = queries.str.extract(r"(?P<word>[a-z]+)\s+(?P<number>\d+)", expand=True)
    one = lambda w, n: {"attribute_key": w, "value": n, "key_priority": 1, "attribute_priority": 1}
    rows = zip(found["word"], found["number"])
    return pd.Series([None if pd.isna(w) else json.dumps({"attributes": [one(w, n)]}, ensure_ascii=False) for w, n in rows], index=queries.index, dtype=object)


def apply_predictor(
    texts: DataFrame,
    predict: Callable[[pd.Series], pd.Series] = rules_predictor,
    on: str = "qid",
    text: str = "query",
) -> DataFrame:
    """Run any ``Series -> Series`` predictor over the table in Arrow batches. A batch that
    raises is retried row by row, so one bad text becomes one failed row; missing outputs
    are failures too."""

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame({"qid": pdf["qid"], "query": pdf["query"]})
            try:
                raw, err = predict(pdf["query"]), pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            except Exception:  # noqa: BLE001 - any predictor error is data here
                raws, errs = [], []
                for value in pdf["query"]:
                    try:
                        raws.append(predict(pd.Series([value])).iloc[0])
                        errs.append(None)
                    except Exception as one:  # noqa: BLE001
                        raws.append(None)
                        errs.append(f"{type(one).__name__}: {one}")
                raw, err = pd.Series(raws, index=pdf.index, dtype=object), pd.Series(errs, index=pdf.index, dtype=object)
            raw = raw.astype(object).where(raw.notna(), None)
            out["success"] = [r is not None for r in raw]
            out["raw_output"], out["error"] = raw, err
            yield out

    return texts.select(F.col(on).cast("bigint").alias("qid"), F.col(text).alias("query")).mapInPandas(run, PREDICTION)
