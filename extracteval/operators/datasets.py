"""Building training and evaluation sets: synthesis, rendering, splitting, sampling.

All randomness is an md5 draw on the row's own key. Draws that need a position in a group
use :func:`~extracteval.functions.hashing.hash_rank`, which ranks slices of the hash space
and so copes with one label holding a third of the table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.hashing import hash_cut, hash_hex, hash_int, hash_rank
from ..functions.normalize import strip
from ..functions.parsing import parse_isq_pipe
from ..functions.tables import small_table
from ..session import materialise
from .align import keep_first


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _draw(values: Sequence[str], seed: str, *key: Column) -> Column:
    """One of a fixed list, by hash."""
    return F.get(_literals(values), F.pmod(hash_int(seed, *key), F.lit(len(values))).cast("int"))


# ----------------------------------------------------------------------------- synthesis


def _next_prime(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def number_pools(pools: DataFrame, seed: str) -> tuple[DataFrame, DataFrame, int]:
    """Number the keys, and the values of each key, by hash rank: key table, value table and
    key count (one number, fetched for the modulus of the draws)."""
    keys = pools.groupBy("key").agg(F.count(F.lit(1)).alias("n_values"))
    numbered = hash_rank(keys, "key", f"{seed}:keys").select(
        (F.col("hash_rank") - 1).alias("key_no"), "key", "n_values"
    )
    values = hash_rank(pools, "value", f"{seed}:pool", by=["key"]).select(
        "key", F.col("hash_rank").alias("value_no"), "value"
    )
    return numbered, values, keys.count()


def draw_records(numbered: tuple[DataFrame, DataFrame, int], n: int, fewest: int, most: int, seed: str) -> DataFrame:
    """``n`` records ``(id, pos, key, value)`` drawn from numbered pools.

    Keys are drawn without replacement inside the record's row: start and step modulo a
    prime walk through the key numbers without repeating one, so no record meets all keys.
    Values are looked up by number: two equi-joins on evenly spread keys, however uneven
    the pools."""
    keys, values, n_keys = numbered
    prime = _next_prime(n_keys)
    id_ = F.col("id")
    m = F.least(F.lit(fewest) + F.pmod(hash_int(f"{seed}:m", id_), F.lit(most - fewest + 1)), F.lit(n_keys))
    start = F.pmod(hash_int(f"{seed}:start", id_), F.lit(prime))
    step = F.pmod(hash_int(f"{seed}:step", id_), F.lit(max(prime - 1, 1))) + 1
    walk = F.filter(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), m + (prime - n_keys) - 1),
            lambda j: F.pmod(start + j * step, F.lit(prime)),
        ),
        lambda x: x < n_keys,
    )
    spark = keys.sparkSession
    drawn = spark.range(n).select("id", F.posexplode(F.slice(walk, F.lit(1), m.cast("int"))).alias("pos", "key_no"))
    keyed = drawn.join(keys, "key_no").withColumn(
        "value_no", F.pmod(hash_int(f"{seed}:value", id_, F.col("key")), F.col("n_values")) + 1
    )
    return keyed.join(values, ["key", "value_no"]).select("id", (F.col("pos") + 1).alias("pos"), "key", "value")


def synthesize(pools: DataFrame, n: int, fewest: int, most: int, seed: str) -> DataFrame:
    """``n`` records with a drawn number of distinct keys and one drawn value each.
    ``pools`` is ``(key, value)`` without duplicates."""
    return draw_records(number_pools(pools, seed), n, fewest, most, seed)


def records(parts: DataFrame, seed: str) -> DataFrame:
    """Synthetic parts to one row per record: ``attributes`` in drawn order and ``query``,
    the values in a hash-shuffled order."""
    part = F.struct("pos", "key", "value")
    shuffled = F.struct(hash_int(f"{seed}:shuffle", F.col("id"), F.col("key")).alias("h"), F.col("key"), F.col("value"))
    return parts.groupBy("id").agg(
        F.array_sort(F.collect_list(part)).alias("attributes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(shuffled)), lambda e: e["value"]), " ").alias("query"),
    )


def with_product(recs: DataFrame, products: Sequence[str], seed: str) -> DataFrame:
    return recs.withColumn("product", _draw(products, f"{seed}:product", F.col("id")))


STYLES = ("natural", "specification", "detailed", "brief")


def render_query(recs: DataFrame, seed: str, styles: Sequence[str] = STYLES) -> DataFrame:
    """A query text per record (``id, product, attributes``) in one of four styles, chosen
    and shaped by hash. Row-local."""
    id_, attrs, product = F.col("id"), F.col("attributes"), F.col("product")
    size = F.size(attrs)

    def some(low: int, high: int, tag: str) -> Column:
        """low..min(high, size) leading attributes."""
        top = F.greatest(F.least(F.lit(high), size), F.lit(low))
        count = F.lit(low) + F.pmod(hash_int(f"{seed}:{tag}", id_), top - low + 1)
        return F.slice(attrs, F.lit(1), count.cast("int"))

    def phrase(items: Column, sep: str) -> Column:
        return F.transform(items, lambda e: F.concat(F.translate(e["key"], "_", " "), F.lit(sep), e["value"]))

    brand = F.get(F.filter(attrs, lambda e: e["key"] == "brand"), F.lit(0))["value"]
    prefix = _draw(L.DETAIL_PREFIXES, f"{seed}:prefix", id_)
    others = F.filter(
        attrs, lambda e: (e["key"] != "brand") & (F.pmod(hash_int(f"{seed}:keep", id_, e["key"]), F.lit(10)) >= 3)
    )
    limit = (F.lit(2) + F.pmod(hash_int(f"{seed}:detail", id_), F.lit(4))).cast("int")
    listed = F.array_join(F.transform(F.slice(others, F.lit(1), limit), lambda e: e["value"]), ", ")
    texts = {
        "natural": F.concat(F.lit("looking for "), product, F.lit(" with "), F.array_join(phrase(some(2, 4, "natural"), " "), ", ")),
        "specification": F.concat_ws(", ", product, F.array_join(phrase(some(3, 6, "spec"), ": "), ", ")),
        "detailed": F.concat_ws(" ", F.nullif(prefix, F.lit("")), brand, product, F.nullif(listed, F.lit(""))),
        "brief": F.concat_ws(" ", product, F.transform(some(1, 3, "brief"), lambda e: e["value"])),
    }
    style = _draw(styles, f"{seed}:style", id_)
    chosen = reduce(lambda acc, s: acc.when(F.col("style") == s, texts[s]), styles[1:], F.when(F.col("style") == styles[0], texts[styles[0]]))
    return recs.withColumn("style", style).withColumn("query", F.trim(chosen))


def attr_rank(parts: DataFrame, weights: Mapping[str, int] = L.IMPORTANCE, on: str = "id") -> DataFrame:
    """``attribute_priority`` by importance of the key plus a bonus for values with a digit,
    ties in drawn order; the window holds one record."""
    from pyspark.sql import Window as W

    spark = parts.sparkSession
    table = small_table(spark, weights.items(), "key string, weight int")
    weight = F.coalesce("weight", F.lit(L.DEFAULT_IMPORTANCE)) + F.when(F.col("value").rlike(r"\d"), L.DIGIT_BONUS).otherwise(0)
    return (
        parts.join(table, "key", "left")
        .withColumn("weight", weight)
        .withColumn("attribute_priority", F.row_number().over(W.partitionBy(on).orderBy(F.desc("weight"), "pos")))
    )


def fan_out(ranked: DataFrame, synonyms: DataFrame, on: str = "id") -> DataFrame:
    """Each ranked attribute under all synonyms of its key (itself alone if it has none);
    ``synonyms`` is ``(key, attribute_key, key_priority)``."""
    return ranked.join(synonyms, "key", "left").select(
        on,
        F.coalesce("attribute_key", "key").alias("attribute_key"),
        "value",
        F.coalesce("key_priority", F.lit(1)).alias("key_priority"),
        "attribute_priority",
    )


def dedupe_records(recs: DataFrame, min_entries: int = 4, cap: int | None = None, ord: str = "id") -> DataFrame:
    """First record per query, at least ``min_entries`` attributes; the first ``cap`` records in
    order, where a set of fixed size is wanted."""
    found = keep_first(recs.filter(F.size("attributes") >= min_entries), "query", ord)
    return found if cap is None else found.orderBy(ord).limit(cap)


# ----------------------------------------------------------------------- records of tasks


def _draw_some(values: Sequence[str], few: int, many: int, seed: str, key: Column) -> Column:
    """``few`` to ``many`` of a short fixed list, in hash order, inside the row."""
    tagged = F.array(*[F.concat(hash_hex(seed, key, F.lit(v)), F.lit(v)) for v in values])
    count = F.lit(few) + F.pmod(hash_int(f"{seed}:n", key), F.lit(many - few + 1))
    return F.transform(F.slice(F.array_sort(tagged), F.lit(1), count.cast("int")), lambda s: F.substr(s, F.lit(33)))


def extraction_records(numbered: tuple[DataFrame, DataFrame, int], n: int, seed: str, fewest: int = 2, most: int = 8) -> DataFrame:
    """``(id, instruction, output)``: a product with drawn attributes, seven in ten of them named in
    the text, all of them in the JSON output."""
    id_ = F.col("id")
    recs = with_product(records(draw_records(numbered, n, fewest, most, seed), seed), L.PRODUCTS, seed)
    named = F.filter("attributes", lambda e: F.pmod(hash_int(f"{seed}:named", id_, e["key"]), F.lit(10)) >= 3)
    text = F.concat_ws(" ", "product", F.transform(named, lambda e: e["value"]))
    keys = F.concat(F.array(F.lit("product")), F.transform("attributes", lambda e: e["key"]))
    values = F.concat(F.array("product"), F.transform("attributes", lambda e: e["value"]))
    return recs.select("id", F.concat(F.lit(L.EXTRACTION_TASK), text).alias("instruction"), json_text(keys, values).alias("output"))


def correction_records(spark: SparkSession, n: int, seed: str) -> DataFrame:
    """``(id, instruction, output)``: a query with typos, and the query. Row-local."""
    id_ = F.col("id")
    right = F.concat_ws(" ", _draw(L.PRODUCTS, f"{seed}:product", id_), _draw_some(L.CORRECTION_PHRASES, 2, 4, f"{seed}:phrase", id_))
    wrong = inject_typos(spark.range(n).withColumn("output", right), "output", "id", seed)
    return wrong.select("id", F.concat(F.lit(L.CORRECTION_TASK), F.col("noisy")).alias("instruction"), "output")


def translation_records(spark: SparkSession, n: int, seed: str, terms: Mapping[str, str] = L.TRANSLATIONS) -> DataFrame:
    """``(id, instruction, output)``: two to four terms and their translation, in a drawn direction.
    Row-local: the table is fixed and short."""
    id_ = F.col("id")
    table = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
    drawn = spark.range(n).withColumn("_t", _draw_some(list(terms), 2, 4, f"{seed}:term", id_))
    here, there = F.array_join("_t", " "), F.array_join(F.transform("_t", lambda t: F.element_at(table, t)), " ")
    forward = F.pmod(hash_int(f"{seed}:direction", id_), F.lit(2)) == 0
    task = lambda d, text: F.concat(F.lit(L.TRANSLATION_TASKS[d]), text)
    return drawn.select("id", F.when(forward, task("forward", here)).otherwise(task("backward", there)).alias("instruction"), F.when(forward, there).otherwise(here).alias("output"))


# -------------------------------------------------------------------- splits and samples


def sample_n(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """``n`` rows in hash order of their key (all, if fewer), for any ``n``: rows below the slice of
    the hash space in which the n-th lies are kept by a filter, and only that small slice is ordered.
    Rows with one key count as equal."""
    hashed = df.withColumn("_h", hash_hex(seed, F.col(key)))
    cut = hash_cut(hashed, "_h", n)
    if cut is None:
        return df
    edge, rest = cut
    here = F.substring("_h", 1, len(edge))
    last = hashed.filter(here == edge).orderBy("_h", key).limit(rest)
    return hashed.filter(here < edge).unionByName(last).drop("_h")


def split_random(df: DataFrame, key: str, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Exact-size random split: ``split`` is train, val or test by hash rank."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_train = F.floor(total * F.lit(train)).cast("bigint")
    n_val = F.floor(total * F.lit(val)).cast("bigint")
    rank = F.col("hash_rank")
    return (
        hash_rank(df, key, seed)
        .withColumn("split", F.when(rank <= n_train, "train").when(rank <= n_train + n_val, "val").otherwise("test"))
        .drop("hash_rank")
    )


def split_stratified(df: DataFrame, label: str, key: str, seed: str, p: float = 0.1) -> DataFrame:
    """Per label, max(1, round-half-even(n * p)) rows go to val, but none if n is 1."""
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    n_val = F.when(
        F.col("_n") > 1, F.greatest(F.lit(1).cast("bigint"), F.bround(F.col("_n") * F.lit(p)).cast("bigint"))
    ).otherwise(0)
    return (
        hash_rank(df, key, seed, by=[label])
        .join(sizes, F.col(label).eqNullSafe(F.col("_label")))
        .withColumn("split", F.when(F.col("hash_rank") <= n_val, "val").otherwise("train"))
        .drop("hash_rank", "_label", "_n")
    )


def not_in_training(df: DataFrame, train: DataFrame, name: str) -> DataFrame:
    """Rows whose trimmed lower-case name the training set does not have. Names are compared
    by digest, so long texts are not shuffled as join keys."""
    digest = F.sha2(F.lower(strip(F.col(name))), 256)
    seen = train.select(digest.alias("_n")).distinct()
    return df.join(seen, digest == F.col("_n"), "left_anti")


def proportional_sample(pool: DataFrame, train: DataFrame, n: int, name: str, label: str, ord: str, seed: str) -> DataFrame:
    """Exactly ``n`` (or all, if fewer) unseen, distinct names, spread over labels in
    proportion to how often the training set uses them, at least one each.

    Allocation works on one row per label; names are ranked by hash within their label, and
    the trim or top-up to ``n`` ranks the chosen and then the remaining ones by hash."""
    norm = F.lower(strip(F.col(name)))
    named = pool.withColumn("_norm", norm)
    seen = train.select(norm.alias("_norm")).distinct()
    unseen = materialise(keep_first(named.join(seen, "_norm", "left_anti"), "_norm", ord), "unseen")
    freq = (
        named.join(seen, "_norm", "left_semi").groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_f"))
    )
    total = freq.agg(F.sum("_f").alias("t")).scalar()
    one = F.lit(1).cast("bigint")
    shares = (
        unseen.select(F.col(label).alias("_label"))
        .distinct()
        .join(freq, "_label", "left")
        .select("_label", F.greatest(one, F.bround(F.coalesce("_f", one) * n / total).cast("bigint")).alias("_a"))
    )
    shares = materialise(shares, "shares")  # one row per label
    allocated = shares.agg(F.sum("_a").alias("s")).scalar()
    shares = shares.select("_label", F.greatest(one, F.bround(F.col("_a") * (F.lit(float(n)) / allocated)).cast("bigint")).alias("_a"))
    tiered = materialise(
        hash_rank(unseen, "_norm", f"{seed}:label", by=[label])
        .join(shares, F.col(label) == F.col("_label"))
        .withColumn("tier", F.when(F.col("hash_rank") <= F.col("_a"), 0).otherwise(1))
        .drop("hash_rank", "_label", "_a"),
        "tiered",
    )
    chosen = tiered.agg(F.count_if(F.col("tier") == 0).alias("c")).scalar()
    place = F.col("hash_rank") + F.when(F.col("tier") == 1, chosen).otherwise(0)
    return hash_rank(tiered, "_norm", f"{seed}:fill", by=["tier"]).filter(place <= n).drop("hash_rank", "_norm", "tier")


def mix_tasks(tasks: Mapping[str, DataFrame], ratios: Mapping[str, float], n: int, key: str, seed: str) -> DataFrame:
    """``int(n * ratio)`` rows of each task, stacked with a ``task`` column."""
    parts = [
        hash_rank(df, key, f"{seed}:{t}").filter(F.col("hash_rank") <= int(n * ratios[t])).drop("hash_rank").withColumn("task", F.lit(t))
        for t, df in tasks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def union_tiers(tiers: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("tier", F.lit(t)) for t, df in tiers.items()])


# ------------------------------------------------------------------------ training texts


def json_text(keys: Column, values: Column) -> Column:
    """A flat JSON object as text, in the given order, with ``", "`` and ``": "`` between
    parts and non-ASCII characters kept."""
    quote = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    pairs = F.zip_with(keys, values, lambda k, v: F.concat(quote(k), F.lit(": "), quote(v)))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def distill_pairs(df: DataFrame, isq_pipe: str = "isq_pipe", sort: bool = False, query: str = "query") -> DataFrame:
    """Parsed extractor output as instruction/output pairs. A repeated key keeps its first
    place and its last value; ``sort`` orders the keys. Texts without attributes are
    skipped. Row-local."""
    entries = F.col("_e")
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    keys = F.array_sort(keys) if sort else keys
    values = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    return (
        df.withColumn("_e", parse_isq_pipe(F.col(isq_pipe)))
        .filter(F.size("_e") > 0)
        .withColumn("instruction", F.concat(F.lit(L.INSTRUCTION), F.col(query)))
        .withColumn("output", json_text(keys, values))
        .drop("_e")
    )


def render_instruction(df: DataFrame, key: str, seed: str, name: str, templates: Sequence[str] = L.INSTRUCTION_TEMPLATES, slot: str = "{product_name}") -> DataFrame:
    """Instruction templates in rotation over the hash-shuffled rows."""
    no = F.pmod(F.col("hash_rank") - 1, F.lit(len(templates))).cast("int")
    return (
        hash_rank(df, key, seed)
        .withColumn("template_no", no)
        .withColumn("instruction", F.replace(F.get(_literals(templates), F.col("template_no")), F.lit(slot), F.col(name)))
        .drop("hash_rank")
    )


def chat_format(df: DataFrame, instruction: str = "instruction", output: str = "output") -> DataFrame:
    # The turn markers of the chat format.
    return df.withColumn(
        "text",
        F.concat(
            F.lit("<bos><start_of_turn>user\n"),
            F.col(instruction),
            F.lit("<end_of_turn>\n<start_of_turn>model\n"),
            F.col(output),
            F.lit("<end_of_turn><eos>"),
        ),
    )


def inject_typos(df: DataFrame, text: str, key: str, seed: str, pairs: Sequence[tuple[str, str]] = L.TYPO_PAIRS, most: int = 3) -> DataFrame:
    """``noisy``: one to ``most`` drawn misspellings put in at their first chance, and in
    half of the rows two neighbouring words run together. Row-local."""
    wrong, right = _literals([w for w, _ in pairs]), _literals([r for _, r in pairs])
    id_ = F.col(key)
    n_errors = F.lit(1) + F.pmod(hash_int(f"{seed}:n", id_), F.lit(most))
    noisy = F.col(text)
    for i in range(most):
        no = F.pmod(hash_int(f"{seed}:pair{i}", id_), F.lit(len(pairs))).cast("int")
        r, w = F.get(right, no), F.get(wrong, no)
        at = F.call_function("instr", noisy, r)
        swapped = F.concat(F.substring(noisy, F.lit(1), at - 1), w, F.substring(noisy, at + F.length(r), F.length(noisy)))
        noisy = F.when((F.lit(i) < n_errors) & (at > 0), swapped).otherwise(noisy)
    out = df.withColumn("_n", noisy)
    words = F.filter(F.split(F.col("_n"), r"\s+"), lambda w: w != "")
    at = F.pmod(hash_int(f"{seed}:join", id_), F.greatest(F.size(words) - 1, F.lit(1))).cast("int")
    joined = F.concat_ws(
        " ",
        F.slice(words, F.lit(1), at),
        F.concat(F.get(words, at), F.get(words, at + 1)),
        F.slice(words, at + 3, F.size(words)),
    )
    join = (F.pmod(hash_int(f"{seed}:coin", id_), F.lit(2)) == 0) & (F.size(words) > 2)
    return out.withColumn("noisy", F.when(join, joined).otherwise(F.col("_n"))).drop("_n")


def translate_terms(phrases: DataFrame, table: DataFrame, on: str = "id") -> DataFrame:
    """Term lists (``id, terms``) and their term-by-term translation, as source and target
    in both directions. ``table`` is ``(term, translation)``; unknown terms stay."""
    looked_up = (
        phrases.select(on, F.posexplode("terms").alias("pos", "term"))
        .join(table, "term", "left")
        .groupBy(on)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", "term", F.coalesce("translation", "term").alias("translation")))
            ).alias("_t")
        )
    )
    here = F.array_join(F.transform("_t", lambda e: e["term"]), " ")
    there = F.array_join(F.transform("_t", lambda e: e["translation"]), " ")
    both = F.array(
        F.struct(F.lit("forward").alias("direction"), here.alias("source"), there.alias("target")),
        F.struct(F.lit("backward").alias("direction"), there.alias("source"), here.alias("target")),
    )
    return looked_up.select(on, F.explode(both).alias("_d")).select(on, "_d.*")


def tiered_benchmark(pools: DataFrame, seed: str, tiers: Mapping[str, tuple[int, int, int]] = L.TIERS, products: Sequence[str] = L.PRODUCTS) -> DataFrame:
    """Benchmark records per tier with exact labels: a product plus drawn attributes, and a
    query rendered from them."""
    keys, values, n_keys = number_pools(pools, seed)
    # all tiers read the same numbered pools
    numbered = (materialise(keys, "tier-keys"), materialise(values, "tier-values"), n_keys)
    parts = {}
    for tier, (n, low, high) in tiers.items():
        s = f"{seed}:{tier}"
        # tier sizes count the product; a record with no further attribute is just its product
        drawn = draw_records(numbered, n, max(low - 1, 0), high - 1, s)
        base = pools.sparkSession.range(n)
        recs = base.join(records(drawn, s), "id", "left").withColumn(
            "attributes", F.coalesce("attributes", F.array().cast("array<struct<pos:int,key:string,value:string>>"))
        )
        recs = with_product(recs, products, s)
        parts[tier] = recs.select(
            "id",
            F.concat_ws(" ", F.col("product"), F.col("query")).alias("query"),
            F.concat(
                F.array(F.struct(F.lit(0).alias("pos"), F.lit("product").alias("key"), F.col("product").alias("value"))),
                F.col("attributes"),
            ).alias("attributes"),
        )
    return union_tiers(parts)


def translation_table(spark: SparkSession, terms: Mapping[str, str] = L.TRANSLATIONS) -> DataFrame:
    return small_table(spark, terms.items(), "term string, translation string")
