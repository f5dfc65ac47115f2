"""Comparing a candidate with a reference, query by query.

The long form does the work: every attribute becomes a key term and a value term tagged
with its side, and one aggregation on (query, facet, term) says who has it. That replaces
the reference/candidate join: terms are dealt to as many tasks as their number asks for, and
a query with very many rows is spread over its terms. Arrays are only built from distinct terms, for
outputs that are one row per query by definition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import norm_key, norm_value
from ..functions.spreading import deal
from ..functions.tables import broadcast_if
from ..session import materialise
from .reshape import segments


def with_norms(attrs: DataFrame, mode: str = "collapse") -> DataFrame:
    return attrs.withColumn("norm_key", norm_key(F.col("attribute_key"), mode)).withColumn(
        "norm_value", norm_value(F.col("value"), mode)
    )


def both_sides(gt: DataFrame, cand: DataFrame, mode: str = "collapse") -> DataFrame:
    """Reference and candidate stacked, with ``is_gt`` and normalised columns."""
    return with_norms(
        gt.withColumn("is_gt", F.lit(True)).unionByName(cand.withColumn("is_gt", F.lit(False))), mode
    )


def _terms(rows: DataFrame, on: str, tag: str, keep_blank: bool = False) -> DataFrame:
    """``(on, tag, facet, term)``: a key term and a value term per attribute."""
    both = F.array(
        F.struct(F.lit("key").alias("facet"), F.col("norm_key").alias("term")),
        F.struct(F.lit("value").alias("facet"), F.col("norm_value").alias("term")),
    )
    terms = rows.select(on, tag, F.explode(both).alias("_t")).select(on, tag, "_t.facet", "_t.term")
    return terms if keep_blank else terms.filter(F.col("term") != "")


MOST_SOURCES = 63


def source_masks(sources: Mapping[str, DataFrame], on: str = "qid", mode: str = "collapse", keep_blank: bool = False) -> DataFrame:
    """``(on, facet, term, mask)``: which sources have each distinct key and value, a bit per source in
    the order given. One aggregation over one scan of each source, however many are compared: what any
    two share is read off the masks (:func:`mask_counts`, :func:`shared`)."""
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"{len(sources)} sources, more than {MOST_SOURCES} bits")
    tagged = [with_norms(df, mode).select(on, "norm_key", "norm_value", F.lit(1 << i).cast("bigint").alias("_bit")) for i, df in enumerate(sources.values())]
    rows = reduce(DataFrame.unionByName, tagged)
    terms = deal(_terms(rows, on, "_bit", keep_blank), 2 * rows.count(), on, "facet", "term")
    return terms.groupBy(on, "facet", "term").agg(F.bit_or("_bit").alias("mask"))


def mask_counts(masks: DataFrame, on: str | None = "qid") -> DataFrame:
    """How many terms have each mask, per query and facet, or (``on=None``) per facet overall: the
    histogram from which all counts between sources are sums."""
    return masks.groupBy(*([on] if on else []), "facet", "mask").agg(F.count(F.lit(1)).alias("n"))


def shared(*sources: int, facet: str | None = None) -> Column:
    """An aggregate over :func:`mask_counts`: the terms (of a facet) that all these sources have, given
    by their numbers."""
    bits = sum(1 << i for i in sources)
    has = F.col("mask").bitwiseAND(F.lit(bits).cast("bigint")) == bits
    has = has if facet is None else has & (F.col("facet") == facet)
    return F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).cast("bigint")


def source_overlaps(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``src, dst, facet, both, src_only, dst_only`` for every two sources (``src`` first in order), from
    the overall :func:`mask_counts`: a row per distinct mask and facet is summed, so neither pairs of
    terms nor a scan for each pair of sources are needed."""
    totals = counts.groupBy("facet").agg(*[
        F.struct(shared(a, b).alias("both"), shared(a).alias("a"), shared(b).alias("b")).alias(f"p{a}_{b}")
        for a in range(len(names)) for b in range(a + 1, len(names))
    ])
    rows = [
        F.struct(F.lit(names[a]).alias("src"), F.lit(names[b]).alias("dst"), F.col(f"p{a}_{b}.both").alias("both"), (F.col(f"p{a}_{b}.a") - F.col(f"p{a}_{b}.both")).alias("src_only"), (F.col(f"p{a}_{b}.b") - F.col(f"p{a}_{b}.both")).alias("dst_only"))
        for a in range(len(names)) for b in range(a + 1, len(names))
    ]
    return totals.select("facet", F.inline(F.array(*rows)))


def set_segments(flags: DataFrame, size: int, on: str = "qid") -> DataFrame:
    """The sets of :func:`set_compare` in arrays of at most ``size`` terms: ``on, facet, side, segment,
    terms``, ``side`` being matched, gt_only or cand_only. A query with any number of terms is spread
    over its segments."""
    side = F.when(F.col("in_gt") & F.col("in_cand"), "matched").when(F.col("in_gt"), "gt_only").otherwise("cand_only")
    rows = flags.select(F.struct(on, "facet", side.alias("side")).alias("_set"), "term")
    cut = segments(rows, "_set", ["term"], size, ["term"])
    return cut.select("_set.*", "segment", F.transform("items", lambda e: e["term"]).alias("terms"))


def term_flags(
    gt: DataFrame, cand: DataFrame, on: str = "qid", mode: str = "collapse", keep_blank: bool = False
) -> DataFrame:
    """``(on, facet, term, in_gt, in_cand)``: which side has each distinct key and value."""
    sides = both_sides(gt, cand, mode)
    terms = deal(_terms(sides, on, "is_gt", keep_blank), 2 * sides.count(), on, "facet", "term")
    return terms.groupBy(on, "facet", "term").agg(
        F.bool_or("is_gt").alias("in_gt"), F.bool_or(~F.col("is_gt")).alias("in_cand")
    )


_COUNTS = ["gt_keys", "cand_keys", "matched_keys", "gt_values", "cand_values", "matched_values"]


def set_counts(flags: DataFrame, on: str = "qid", base: DataFrame | None = None) -> DataFrame:
    """Per query: distinct keys and values of either side and how many are shared.
    ``base`` (one row per query) fixes the set of queries; those without terms get zeros."""
    def n(facet: str, cond: Column) -> Column:
        return F.count_if((F.col("facet") == facet) & cond)

    both = F.col("in_gt") & F.col("in_cand")
    counts = flags.groupBy(on).agg(
        n("key", F.col("in_gt")).alias("gt_keys"),
        n("key", F.col("in_cand")).alias("cand_keys"),
        n("key", both).alias("matched_keys"),
        n("value", F.col("in_gt")).alias("gt_values"),
        n("value", F.col("in_cand")).alias("cand_values"),
        n("value", both).alias("matched_values"),
    )
    if base is None:
        return counts
    return base.select(on).join(counts, on, "left").fillna(0, _COUNTS)


def set_compare(flags: DataFrame, on: str = "qid") -> DataFrame:
    """As :func:`set_counts`, with the sorted sets themselves."""
    def members(facet: str, cond: Column) -> Column:
        return F.array_sort(F.collect_list(F.when((F.col("facet") == facet) & cond, F.col("term"))))

    gt, cand = F.col("in_gt"), F.col("in_cand")
    sets = flags.groupBy(on).agg(
        members("key", gt & cand).alias("matched_key_set"),
        members("key", gt & ~cand).alias("gt_only_key_set"),
        members("key", ~gt & cand).alias("cand_only_key_set"),
        members("value", gt & cand).alias("matched_value_set"),
        members("value", gt & ~cand).alias("gt_only_value_set"),
        members("value", ~gt & cand).alias("cand_only_value_set"),
    )
    size = lambda *cs: sum((F.size(c) for c in cs[1:]), F.size(cs[0])).cast("bigint")
    return sets.select(
        "*",
        size("matched_key_set", "gt_only_key_set").alias("gt_keys"),
        size("matched_key_set", "cand_only_key_set").alias("cand_keys"),
        size("matched_key_set").alias("matched_keys"),
        size("matched_value_set", "gt_only_value_set").alias("gt_values"),
        size("matched_value_set", "cand_only_value_set").alias("cand_values"),
        size("matched_value_set").alias("matched_values"),
    )


def exact_keyset(flags: DataFrame, on: str = "qid") -> DataFrame:
    """Whether the key sets are equal, and the sorted differences."""
    keys = flags.filter("facet = 'key'").groupBy(on).agg(
        F.array_sort(F.collect_list(F.when(F.col("in_gt") & F.col("in_cand"), F.col("term")))).alias("common_keys"),
        F.array_sort(F.collect_list(F.when(~F.col("in_cand"), F.col("term")))).alias("gt_only_keys"),
        F.array_sort(F.collect_list(F.when(~F.col("in_gt"), F.col("term")))).alias("cand_only_keys"),
    )
    return keys.withColumn("perfect", (F.size("gt_only_keys") == 0) & (F.size("cand_only_keys") == 0))


def vocab_overlap(a: DataFrame, b: DataFrame, key: str = "attribute_key") -> DataFrame:
    """Corpus-level key sets: ``key, membership`` with common / left_only / right_only."""
    tagged = a.select(F.col(key).alias("key"), F.lit(True).alias("_left")).unionByName(
        b.select(F.col(key).alias("key"), F.lit(False).alias("_left"))
    )
    return (
        tagged.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.bool_or("_left").alias("_l"), F.bool_or(~F.col("_left")).alias("_r"))
        .select(
            "key",
            F.when(F.col("_l") & F.col("_r"), "common")
            .when(F.col("_l"), "left_only")
            .otherwise("right_only")
            .alias("membership"),
        )
    )


# ---------------------------------------------------------------- entry-level matches


def entry_pairs(gt: DataFrame, cand: DataFrame, on: str = "qid", mode: str = "strict") -> DataFrame:
    """Entries of both sides that share query and key, kept factored: one row per
    (query, key) with the distinct entries of each side and their multiplicities, plus how
    many pairs they stand for. The pairs are never written out one by one; every metric
    over them is a sum of products (:func:`priority_alignment`)."""
    sides = both_sides(gt, cand, mode)
    entries = (
        deal(sides, sides.count(), on, "norm_key")
        .groupBy(on, "norm_key", "is_gt", "attribute_key", "value", "key_priority", "attribute_priority")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    entry = F.struct("attribute_priority", "key_priority", "attribute_key", "value", "n")
    return (
        entries.groupBy(on, "norm_key")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("is_gt"), entry))).alias("gt_entries"),
            F.array_sort(F.collect_list(F.when(~F.col("is_gt"), entry))).alias("cand_entries"),
            F.sum(F.when(F.col("is_gt"), F.col("n")).otherwise(0)).alias("n_gt"),
            F.sum(F.when(~F.col("is_gt"), F.col("n")).otherwise(0)).alias("n_cand"),
        )
        .filter((F.col("n_gt") > 0) & (F.col("n_cand") > 0))
        .withColumn("pairs", F.col("n_gt") * F.col("n_cand"))
    )


def priority_counts(gt: DataFrame, cand: DataFrame, on: str = "qid", mode: str = "strict") -> DataFrame:
    """Per query, over all reference/candidate entry pairs with equal key and value:
    how many pairs there are, how many also agree on key priority, on attribute priority,
    and on both. Counted from group sizes, so a key repeated k times on each side costs
    k rows and not k*k."""
    sides, base = both_sides(gt, cand, mode), [on, "norm_key", "norm_value"]
    cells = (
        deal(sides, 4 * sides.count(), *base)
        .groupBy(*base, "key_priority", "attribute_priority")
        .agg(F.count_if(F.col("is_gt")).alias("g"), F.count_if(~F.col("is_gt")).alias("c"))
    )
    # every cell under its four priority combinations, written out as rows: grouping sets would be
    # shuffled again, since they group by copies of the columns the rows were dealt by
    kp, ap, no = F.col("key_priority"), F.col("attribute_priority"), F.lit(None)
    combination = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("kp"), b.alias("ap"))
    combinations = F.array(combination(3, no, no), combination(1, kp, no), combination(2, no, ap), combination(0, kp, ap))
    sets = cells.select(*base, "g", "c", F.explode(combinations).alias("_p")).groupBy(*base, "_p.kind", "_p.kp", "_p.ap").agg((F.sum("g") * F.sum("c")).alias("pairs"))
    kind = F.col("kind")
    total = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("pairs"))), F.lit(0)).cast("bigint")
    return sets.groupBy(on).agg(
        total(3).alias("pairs"),
        total(1).alias("key_priority_matches"),
        total(2).alias("attr_priority_matches"),
        total(0).alias("perfect"),
    )


def priority_alignment(counts: DataFrame) -> DataFrame:
    """Corpus totals: perfect (both priorities agree), partial (the other pairs with equal
    key and value), and queries with at least one perfect pair."""
    return counts.agg(
        F.coalesce(F.sum("perfect"), F.lit(0)).cast("bigint").alias("perfect"),
        F.coalesce(F.sum(F.col("pairs") - F.col("perfect")), F.lit(0)).cast("bigint").alias("partial"),
        F.count_if(F.col("perfect") > 0).alias("queries_with_perfect"),
    )


def value_pairs(gt: DataFrame, cand: DataFrame, on: str = "qid", mode: str = "strict") -> DataFrame:
    """One row per shared value of a query: the keys it has on either side, the same with their
    priorities (``gt_entries``, ``cand_entries``, distinct and in order), whether a key is shared
    too, and the first original spellings."""
    sides = both_sides(gt, cand, mode)

    def keys(side: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(side, F.col("norm_key"))))

    def entries(side: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(side, F.struct(F.col("norm_key").alias("key"), "key_priority", "attribute_priority"))))

    g, c = F.col("is_gt"), ~F.col("is_gt")
    return (
        sides.groupBy(on, "norm_value")
        .agg(
            keys(g).alias("gt_keys"),
            keys(c).alias("cand_keys"),
            entries(g).alias("gt_entries"),
            entries(c).alias("cand_entries"),
            F.min_by(F.when(g, F.col("value")), F.when(g, F.col("pos"))).alias("gt_original"),
            F.min_by(F.when(c, F.col("value")), F.when(c, F.col("pos"))).alias("cand_original"),
        )
        .filter((F.size("gt_keys") > 0) & (F.size("cand_keys") > 0))
        .withColumn("under_same_key", F.arrays_overlap("gt_keys", "cand_keys"))
    )


NUMBERS = r"\d+\.?\d*"


def _numbers(v: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(v, F.lit(f"({NUMBERS})"), 1)))


FEW_VALUES = 32  # candidate rows of a query that each of its reference rows is held against
MANY_ROWS = 10_000  # reference rows of a query that one task takes


class Crowded(NamedTuple):
    """The queries with more rows, on either side, than are compared beside them."""

    queries: DataFrame
    rows: int


def crowded_queries(gt: DataFrame, cand: DataFrame, on: str = "qid") -> Crowded:
    """The :class:`Crowded` of two relations; rows without a query match nothing and count as one query
    if they are many. Rows are counted, not gathered."""
    side = lambda df, g: df.select(on, F.lit(g).alias("_g"), F.lit(1 - g).alias("_c"))
    counts = side(gt, 1).unionByName(side(cand, 0)).groupBy(on).agg(F.sum("_g").alias("_g"), F.sum("_c").alias("_c"))
    queries = materialise(counts.filter((F.col("_g") > MANY_ROWS) | (F.col(on).isNotNull() & (F.col("_c") > FEW_VALUES))).select(on), "crowded")
    rows, chars = queries.agg(F.count(F.lit(1)), F.sum(F.length(F.col(on).cast("string")))).first()
    return Crowded(broadcast_if(queries, rows, chars or 0), rows)


def _by_size(gt: DataFrame, cand: DataFrame, on: str, crowded: Crowded | None, few: Callable, many: Callable) -> DataFrame:
    """``few(gt, cand)`` for most queries and ``many(gt, cand)`` for the crowded ones."""
    queries, rows = crowded or crowded_queries(gt, cand, on)
    if not rows:
        return few(gt, cand)
    queries = queries.select(F.col(on).alias("_crowded"))
    part = lambda how: [df.join(queries, F.col(on).eqNullSafe(F.col("_crowded")), how) for df in (gt, cand)]
    return few(*part("left_anti")).unionByName(many(*part("left_semi")))


def fuzzy_flags(gt: DataFrame, cand: DataFrame, on: str = "qid", crowded: Crowded | None = None) -> DataFrame:
    """Reference attributes with ``value_matched``: some candidate value of the same query
    is equal, contains it, is contained in it, or has the same non-empty set of numbers.
    Blank values match nothing.

    Queries of few values are compared beside their rows (:func:`_values_beside`), crowded ones by
    equi-joins of keys (:func:`_values_by_keys`): the same flags, but there each value is a row for
    every one of its keys."""
    return _by_size(gt, cand, on, crowded, lambda g, c: _values_beside(g, c, on), lambda g, c: _values_by_keys(g, c, on))


def _number_key(v: Column) -> Column:
    return F.array_join(_numbers(v), " ")


def _values_beside(gt: DataFrame, cand: DataFrame, on: str) -> DataFrame:
    """:func:`fuzzy_flags` of queries with at most ``FEW_VALUES`` candidate rows: their distinct values
    are listed per query and come to its reference rows, which are shuffled once."""
    values = cand.select(on, norm_value(F.col("value")).alias("v")).filter("v <> ''")
    lists = values.groupBy(on).agg(F.collect_set(F.struct("v", _number_key(F.col("v")).alias("k"))).alias("_theirs"))
    rows = gt.join(lists.hint("merge"), on, "left").withColumn("_v", norm_value(F.col("value")))
    v, k = F.col("_v"), F.col("_k")
    hit = F.exists("_theirs", lambda c: v.contains(c["v"]) | c["v"].contains(v) | ((k != "") & (k == c["k"])))
    rows = rows.withColumn("_k", F.when(F.col("_theirs").isNotNull(), _number_key(v)))
    return rows.withColumn("value_matched", F.coalesce((v != "") & hit, F.lit(False))).drop("_theirs", "_v", "_k")


def _values_by_keys(gt: DataFrame, cand: DataFrame, on: str) -> DataFrame:
    """:func:`fuzzy_flags` of queries of any size. Distinct values meet in equi-joins only, see
    :func:`_within`; nothing is gathered per query. All sides grow with the attributes, so the joins
    are merges: a dozen sides that are each small enough to be broadcast are not, together, small
    enough for the driver that would build their tables."""
    mine = gt.withColumn("norm_value", norm_value(F.col("value")))
    left = mine.select(on, F.col("norm_value").alias("v")).filter("v <> ''").distinct()
    right = cand.select(on, norm_value(F.col("value")).alias("v")).filter("v <> ''").distinct()
    nums = lambda df: df.withColumn("_k", _number_key(F.col("v"))).filter("_k <> ''")
    numbered = nums(left).join(nums(right).select(on, "_k").distinct().hint("merge"), [on, "_k"], "left_semi").select(on, "v")
    inside = _within(left, right, on).select(on, F.col("short").alias("v"))
    around = _within(right, left, on).select(on, F.col("long").alias("v"))
    hits = inside.union(around).union(numbered).distinct().select(on, F.col("v").alias("norm_value"), F.lit(True).alias("_hit"))
    return (
        mine.join(hits.hint("merge"), [on, "norm_value"], "left")
        .withColumn("value_matched", F.coalesce("_hit", F.lit(False)))
        .drop("_hit", "norm_value")
    )


def _grams(text: Column) -> Column:
    """Hashes of all pieces of a text by doubling: element ``j`` lists, for every position, that of the
    ``2 ** j`` characters from there, made of two of the level before. A step a position and level,
    whatever the length of the pieces."""
    chars = F.transform(F.split(text, ""), lambda c: F.xxhash64(c))
    levels = F.length(F.bin(F.length(text))) - 1

    def double(done: Column, j: Column) -> Column:
        last = F.element_at(done, -1)
        half = F.call_function("shiftleft", F.lit(1), j - 1)
        return F.concat(done, F.array(F.transform(F.slice(last, F.lit(1), F.size(last) - half), lambda x, i: F.xxhash64(x, F.get(last, i + half)))))

    return F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), F.array(chars), double)).otherwise(F.array(chars))


def _within(short: DataFrame, long: DataFrame, on: str) -> DataFrame:
    """``(on, short, long)`` of values ``v`` found inside values of the other table.

    A short value has two keys of one length, the largest power of two that fits: its start and its
    end, which cover it. A long value has a key at every position (:func:`_grams`), for the key lengths
    its query asks for. The short value lies inside where its start's key is, and its end's key the
    right way on; positions travel with 64-bit keys, not with text, and what is found is confirmed on
    the texts."""
    n, j = F.length("v"), F.length(F.bin(F.length("v"))) - 1
    s = short.select(on, F.col("v").alias("short"), n.alias("n"), j.alias("j"), F.get(_grams(F.col("v")), j).alias("_g"))
    s = s.select(on, "short", "n", "j", F.call_function("shiftleft", F.lit(1), F.col("j")).alias("k"), F.get("_g", F.lit(0)).alias("a"), F.element_at("_g", -1).alias("b"))
    asked = s.groupBy(on).agg(F.collect_set("j").alias("js"))  # thirty lengths at most
    level = F.transform(F.filter("js", lambda j: j < F.size("_g")), lambda j: F.struct(j.alias("j"), F.get("_g", j).alias("g")))
    grams = (
        long.join(asked.hint("merge"), on).select(on, "js", F.xxhash64("v").alias("id"), _grams(F.col("v")).alias("_g"))
        .select(on, "id", F.explode(level).alias("_l"))
        .select(on, "id", F.col("_l.j").alias("j"), F.posexplode("_l.g").alias("p", "g"))
    )
    starts = grams.join(s.select(on, "j", "k", F.col("a").alias("g"), "b", "n", "short").hint("merge"), [on, "j", "g"])
    exact = starts.filter("n = k").select(on, "id", "short")
    wider = starts.filter("n > k").select(on, "id", "j", (F.col("p") + F.col("n") - F.col("k")).alias("p"), F.col("b").alias("g"), "short")
    wider = wider.join(grams.hint("merge"), [on, "id", "j", "p", "g"], "left_semi").select(on, "id", "short")
    found = exact.union(wider).distinct()
    texts = long.select(on, F.xxhash64("v").alias("id"), F.col("v").alias("long"))
    return found.join(texts.hint("merge"), [on, "id"]).filter(F.col("long").contains(F.col("short"))).select(on, "short", "long")


def canonical_flags(gt: DataFrame, cand: DataFrame, synonyms: DataFrame, on: str = "qid", crowded: Crowded | None = None) -> DataFrame:
    """Reference attributes with ``key_matched``: the same query has a candidate key with
    the same canonical form. Queries of few keys are compared beside their rows, which then lie as
    :func:`fuzzy_flags` left them; crowded ones are joined by key."""
    from ..functions.normalize import canonical_key

    def beside(gt: DataFrame, cand: DataFrame) -> DataFrame:
        lists = cand.groupBy(on).agg(F.collect_set("canonical_key").alias("_theirs"))
        rows = gt.join(lists.hint("merge"), on, "left")
        return rows.withColumn("key_matched", F.coalesce(F.array_contains("_theirs", F.col("canonical_key")), F.lit(False))).drop("_theirs")

    def by_key(gt: DataFrame, cand: DataFrame) -> DataFrame:
        have = cand.select(on, "canonical_key", F.lit(True).alias("_hit")).distinct()
        rows = gt.join(have.hint("merge"), [on, "canonical_key"], "left")
        return rows.withColumn("key_matched", F.coalesce("_hit", F.lit(False))).drop("_hit")

    mine, theirs = canonical_key(gt, "attribute_key", synonyms), canonical_key(cand, "attribute_key", synonyms).select(on, "canonical_key")
    flagged = _by_size(mine, theirs, on, crowded, beside, by_key)
    return flagged.select(on, "canonical_key", *[c for c in gt.columns if c != on], "key_matched")
