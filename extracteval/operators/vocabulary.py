"""Mining, compressing, mapping and checking attribute vocabularies ``(key, value, ord)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.tables import small_table
from ..session import materialise


def synonym_table(spark: SparkSession, synonyms: Mapping[str, Sequence[str]] = L.KEY_SYNONYMS, folded: Mapping[str, str] | None = None) -> DataFrame:
    """``(variant, canonical, rank)``; the table order is the rank. ``folded`` renames
    canonical keys, for the reading that merges some of them."""
    folded = folded or {}
    rows = [
        (v, folded.get(c, c), i) for i, (c, vs) in enumerate(synonyms.items()) for v in vs
    ]
    return small_table(spark, rows, "variant string, canonical string, rank int")


def key_table(df: DataFrame, *cols: Column | str) -> DataFrame:
    """Distinct keys, written once. Joins against them then start from a known size: small
    key sets are broadcast, so that a key with a third of all rows needs no shuffle, and
    large ones are shuffled with skew handling."""
    return materialise(df.select(*cols).distinct(), "keys")


def in_vocab(vocab: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return vocab.join(key_table(keys, key), key, "left_semi")


def map_keys(vocab: DataFrame, known: DataFrame, overrides: DataFrame, key: str = "key") -> DataFrame:
    """``mapped_key``: the override if its target is known, else the key itself if known;
    rows with neither are dropped. ``known`` is ``(key)``, ``overrides`` ``(key, target)``."""
    known = key_table(known, F.col(key).alias("_known"))
    valid = overrides.join(known, F.col("target") == F.col("_known"), "left_semi").select(
        F.col(key).alias("_from"), "target"
    )
    return (
        vocab.join(valid, F.col(key) == F.col("_from"), "left")
        .join(known, F.col(key) == F.col("_known"), "left")
        .withColumn("mapped_key", F.coalesce("target", "_known"))
        .filter(F.col("mapped_key").isNotNull())
        .drop("_from", "target", "_known")
    )


def cap_values(vocab: DataFrame, k: int) -> DataFrame:
    """The first ``k`` distinct values of each key in input order, as the feature asks for.
    Spark pushes the row_number limit below the shuffle, so a key with a third of all
    values sends at most k rows per task."""
    first = vocab.groupBy("key", "value").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(W.partitionBy("key").orderBy("ord"))
    return first.withColumn("value_rank", rank).filter(F.col("value_rank") <= k)


def frequent_keys(vocab: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent keys; equally frequent ones in order of first appearance."""
    return (
        vocab.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
        .orderBy(F.desc("n"), "first_ord", "key")
        .limit(n)
    )


def compress_vocab(vocab: DataFrame, n_keys: int, n_values: int) -> DataFrame:
    """Top keys times first values, as ``(key, value, value_rank)``."""
    clean = vocab.filter(F.col("key").isNotNull() & F.col("value").isNotNull()).withColumns(
        {"key": F.trim("key"), "value": F.trim("value")}
    )
    kept = clean.join(frequent_keys(vocab, n_keys).select("key"), "key", "left_semi")
    return cap_values(kept, n_values)


def compression_summary(vocab: DataFrame, compressed: DataFrame) -> DataFrame:
    """Pairs before and after, keys kept, and the share of pairs saved."""
    before = vocab.agg(F.count(F.lit(1)).alias("n"))
    return compressed.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("key").alias("keys")).select(
        before.scalar().alias("original"),
        F.col("kept"),
        F.col("keys"),
        F.try_divide(before.scalar() - F.col("kept"), before.scalar()).alias("reduction"),
    )


def vocab_digest(vocab: DataFrame, n: int = 20) -> DataFrame:
    """Per key its first ``n`` distinct values and how many more there are, as prompt text."""
    sizes = vocab.select("key", "value", "ord").groupBy("key", "value").agg(F.min("ord").alias("ord")).groupBy("key").agg(
        F.count(F.lit(1)).alias("total"), F.min("ord").alias("first_ord")
    )
    heads = cap_values(vocab, n).groupBy("key").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("value_rank", "value"))), lambda e: e["value"]), " | "
        ).alias("head")
    )
    more = F.when(
        F.col("total") > n, F.concat(F.lit(" ... (+"), (F.col("total") - n).cast("string"), F.lit(" more)"))
    ).otherwise("")
    return heads.join(sizes, "key").select(
        "key", F.concat("head", more).alias("digest"), "total", "first_ord"
    )


PROMPT_HEAD = "Known attributes and values\n\n"
PROMPT_BULLET = "• "
PROMPT_QUERY = 'Query: "{}"\nOutput: '


LONGEST_BLOCK = 1 << 20


def build_prompts(texts: DataFrame, digest: DataFrame, guide: str = "", text: str = "query", longest: int = LONGEST_BLOCK) -> DataFrame:
    """One prompt per text: the vocabulary digest, a guide, the query. The digest is a
    report of bounded size (first values of each key), folded to a single cell and read
    as a scalar subquery; no join. A digest of more than ``longest`` characters, which would be copied
    into every prompt, is an error: compress the vocabulary first."""
    digest = materialise(digest.select("key", "digest", "first_ord"), "digest")
    chars = digest.agg(F.sum(F.length("key") + F.length("digest")).alias("n")).first()["n"] or 0
    if chars > longest:
        raise ValueError(f"the vocabulary digest has {chars} characters, more than {longest}")
    line = F.concat(F.lit(PROMPT_BULLET), F.col("key"), F.lit(": "), F.col("digest"), F.lit("\n"))
    block = digest.agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_ord", line.alias("line")))), lambda e: e["line"]
            ),
            "",
        ).alias("block")
    )
    before, after = PROMPT_QUERY.split("{}")
    return texts.withColumn(
        "prompt",
        F.concat(F.lit(PROMPT_HEAD), block.scalar(), F.lit("\n" + guide + before), F.col(text), F.lit(after)),
    )


def vocab_coverage(attrs: DataFrame, known: DataFrame, on: str = "qid", key: str = "attribute_key") -> DataFrame:
    """One row: keys in use, keys the vocabulary has, examples, examples whose keys are all
    known, and both shares."""
    flagged = (
        attrs.select(on, F.col(key).alias("_key"))
        .join(key_table(known, F.col("key").alias("_key"), F.lit(True).alias("_ok")), "_key", "left")
        .select(on, "_key", F.coalesce("_ok", F.lit(False)).alias("ok"))
    )
    by_key = flagged.groupBy("_key").agg(F.bool_and("ok").alias("ok")).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("y")).alias("s")
    )
    by_query = flagged.groupBy(on).agg(F.bool_and("ok").alias("ok"))
    k = by_key.scalar()
    return by_query.agg(F.count(F.lit(1)).alias("examples"), F.count_if("ok").alias("examples_valid")).select(
        k["n"].alias("keys"),
        k["y"].alias("keys_valid"),
        F.try_divide(k["y"], k["n"]).alias("key_share"),
        "examples",
        "examples_valid",
        F.try_divide("examples_valid", "examples").alias("example_share"),
    )


def vocab_parity(pairs: DataFrame, source: DataFrame, output: str = "output") -> DataFrame:
    """Keys of the JSON outputs against the source vocabulary ``(key)``."""
    from .compare import vocab_overlap

    keys = pairs.select(F.explode(F.map_keys(F.from_json(output, "map<string,string>"))).alias("key"))
    return vocab_overlap(keys, source, "key")


# ----------------------------------------------------------------------------- hygiene


def value_ok(key: Column, value: Column, placeholders: Sequence[str] = L.NOISE_VALUES) -> Column:
    """Whether a value may enter a pool: not a placeholder, no banned part, 1 to 40
    characters, and not one of the values known to belong to another key."""
    v = F.lower(F.trim(value))
    low = F.lower(value)
    foreign = (
        ((key == "power") & value.isin(L.NOT_POWER))
        | ((key == "color") & (F.upper(value).isin(L.NOT_COLOR) | low.contains("requirement")))
        | ((key == "power_source") & value.rlike(r"^\d") & ~low.contains("dc") & ~low.contains("ac"))
    )
    banned = v.rlike("|".join(L.NOISE_PARTS))
    return ~v.isin(list(placeholders)) & ~banned & F.length(value).between(1, L.MAX_VALUE_LENGTH) & ~foreign


def clean_values(vocab: DataFrame, placeholders: Sequence[str] = L.NOISE_VALUES) -> DataFrame:
    return vocab.filter(F.coalesce(value_ok(F.col("key"), F.col("value"), placeholders), F.lit(False)))


def value_pools(vocab: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct clean values per cluster; ``clusters`` is ``(key, cluster)``."""
    named = vocab.join(clusters, "key").select(F.col("cluster").alias("key"), "value").distinct()
    return clean_values(named)
