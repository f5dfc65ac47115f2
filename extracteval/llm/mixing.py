"""Mixing sources to target weights, in DataFrame operations.

Every source's documents are laid end to end in hash order and cut into blocks of words, whose order
is a permutation of their numbers. A source's quota of blocks is exact; a *splitting tree* deals the
quotas over the output shards: at each node the left half's share of every source is drawn from the
multivariate hypergeometric distribution, so shards hold what a shuffle of all blocks would give
them, without one. A shard takes the next blocks of each source's permuted list, and orders them by
hash.

A target above a source's size takes the source once whole, then blocks of a second pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import broadcast_if
from ..session import materialise

#: white space of the words ``[^\x20\x09-\x0D]+``
SPACE = r"[\x20\x09-\x0D]+"
#: blocks are stepped through by one of these primes that does not divide their number
PRIMES = (1_000_003, 1_000_033, 1_000_037)
SLICE_ROWS = 50_000  # rows of a slice of the hash order, about


def split_words(text: Column) -> Column:
    """The words of a text, without the empty strings at its ends."""
    return F.array_remove(F.split(text, SPACE), "")


def word_count(text: Column) -> Column:
    w = F.split(text, SPACE)
    ends = (F.element_at(w, 1) == "").cast("int") + ((F.element_at(w, -1) == "") & (F.size(w) > 1)).cast("int")
    return F.when(text.isNull(), 0).otherwise(F.size(w) - ends).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, target, g`` from ``source, source_size`` (one row per source).

    Sources by code point, null last, get the weights in turn and share ``share`` times the sum of
    the sizes. A target stops at ``most`` times its source's size; what is above is shared out again
    by weight. That ends at a level every target has, times its weight, unless its stop is lower:
    in order of stop per weight, the first sources up to some place are stopped."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", w.cast("bigint").alias("w"), F.row_number().over(order).alias("g"))
    ranked = ranked.withColumn("stop", F.col("source_size") * most).withColumn("ratio", F.col("stop") / F.col("w"))
    everything = W.partitionBy()
    upto = W.orderBy("ratio", "g").rowsBetween(W.unboundedPreceding, W.currentRow)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.sum("stop").over(upto) + F.col("stop")) / (
        F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w")
    )
    # the level if this source is the first that is not stopped; the first that holds is the true one
    levels = ranked.withColumn("level", level).withColumn("free", F.col("level") <= F.col("ratio"))
    found = levels.withColumn("at", F.min(F.when(F.col("free"), F.struct("ratio", "g", "level"))).over(everything))
    target = F.least(F.col("stop").cast("double"), F.col("at.level") * F.col("w"))
    return found.select("source", "source_size", F.coalesce(target, F.col("stop").cast("double")).alias("target"), "g")


def _log_factorial(n: Column) -> Column:
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    series = lambda x: x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return let(n.cast("double"), lambda x: F.when(x < 16, F.element_at(table, x.cast("int") + 1)).otherwise(series(x)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once and stands once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among ``draws`` of ``total`` of which ``good`` are good, by inversion
    of the uniform ``u``. Values are tried outwards from the likeliest, twelve deviations far."""
    lf = _log_factorial
    choose = lambda n, k: let(F.struct(n.alias("n"), k.alias("k")), lambda v: lf(v["n"]) - lf(v["k"]) - lf(v["n"] - v["k"]))

    def likeliest(v: Column) -> Column:
        mode = F.floor((v["draws"] + 1) * (v["good"] + 1).cast("double") / (v["total"] + 2)).cast("bigint")
        return F.least(v["high"], F.greatest(v["low"], mode))

    def steps(v: Column) -> Column:
        share = v["good"] / F.greatest(v["total"], F.lit(1))
        return F.sequence(F.lit(1), (12 * F.sqrt(v["draws"] * share * (1 - share)) + 20).cast("int"))

    def search(v: Column, mode: Column, p0: Column) -> Column:
        start = F.struct((v["u"] - p0).alias("u"), mode.alias("a"), mode.alias("b"), p0.alias("pa"), p0.alias("pb"), F.when(v["u"] < p0, mode).alias("x"))

        def step(s: Column, _: Column) -> Column:
            a, b, rest = s["a"], s["b"], v["total"] - v["good"] - v["draws"]
            up = s["pb"] * (v["good"] - b) * (v["draws"] - b).cast("double") / ((b + 1) * (rest + b + 1).cast("double"))
            down = s["pa"] * a * (rest + a).cast("double") / ((v["good"] - a + 1) * (v["draws"] - a + 1).cast("double"))
            next_ = F.struct(F.when(b < v["high"], up).otherwise(0.0).alias("pb"), F.when(a > v["low"], down).otherwise(0.0).alias("pa"))
            return let(next_, lambda p: F.struct(
                (s["u"] - p["pb"] - p["pa"]).alias("u"), F.greatest(a - 1, v["low"]).alias("a"), F.least(b + 1, v["high"]).alias("b"), p["pa"], p["pb"],
                F.when(s["x"].isNotNull(), s["x"]).when(s["u"] < p["pb"], b + 1).when(s["u"] < p["pb"] + p["pa"], a - 1).alias("x"),
            ))

        return F.aggregate(steps(v), start, step, lambda s: F.coalesce(s["x"], mode))

    def of(v: Column) -> Column:
        p0 = lambda mode: F.exp(choose(v["good"], mode) + choose(v["total"] - v["good"], v["draws"] - mode) - choose(v["total"], v["draws"]))
        return let(likeliest(v), lambda mode: let(p0(mode), lambda p: search(v, mode, p)))

    low, high = F.greatest(F.lit(0).cast("bigint"), draws - (total - good)), F.least(draws, good)
    values = F.struct(total.alias("total"), good.alias("good"), draws.alias("draws"), u.alias("u"), low.alias("low"), high.alias("high"))
    return let(values, of)


def _uniform(*keys: Column) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def _halves(total_blocks: int, shards: int, seed: int) -> Column:
    """The children of a node ``lo, hi, quotas, starts``; a node of one shard stays as it is."""
    lo, hi, quotas, starts = (F.col(c) for c in ("lo", "hi", "quotas", "starts"))
    mid = F.floor((lo + hi) / 2).cast("bigint")
    cap = lambda x: F.floor(x * F.lit(total_blocks).cast("decimal(20,0)") / shards).cast("bigint")
    every = F.aggregate(quotas, F.lit(0).cast("bigint"), lambda a, x: a + x)
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("xs"), every.alias("total"), (cap(mid) - cap(lo)).alias("draws"))

    def draw(s: Column, i: Column) -> Column:
        good = F.get(quotas, i)
        x = hypergeometric(s["total"], good, s["draws"], _uniform(F.lit(seed), lo, hi, i))
        return F.struct(
            F.concat(s["xs"], F.array(x)).alias("xs"), (s["total"] - good).alias("total"),
            (s["draws"] - x).alias("draws"),
        )

    left = F.aggregate(F.sequence(F.lit(0), F.size(quotas) - 1), start, draw, lambda s: s["xs"])
    node = lambda a, b, q, s: F.struct(a.alias("lo"), b.alias("hi"), q.alias("quotas"), s.alias("starts"))
    split = let(left, lambda x: F.array(
        node(lo, mid, x, starts),
        node(mid, hi, F.zip_with(quotas, x, lambda a, b: a - b), F.zip_with(starts, x, lambda a, b: a + b)),
    ))
    return F.when(hi - lo > 1, split).otherwise(F.array(node(lo, hi, quotas, starts)))


def shard_quotas(quotas: DataFrame, total_blocks: int, shards: int, seed: int = 1) -> DataFrame:
    """``shard, g, start, quota`` from ``g, k``: which of its permuted blocks each shard takes of
    each source. Quotas add up to ``k`` over the shards, and to the shard's size over the sources."""
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("g", "k"))).alias("s"))
    nodes = root.select(
        F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"),
        F.transform("s", lambda x: x["k"]).alias("quotas"), F.transform("s", lambda x: F.lit(0).cast("bigint")).alias("starts"), F.transform("s", lambda x: x["g"]).alias("g"),
    )
    for level in range(max(0, shards - 1).bit_length()):
        if level and level % 8 == 0:  # enough nodes now to spread them
            nodes = materialise(nodes.repartition("lo"), "mix-nodes")
        nodes = nodes.select("g", F.inline(_halves(total_blocks, shards, seed)))
    nodes = materialise(nodes, "mix-tree")
    each = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("g", "starts", "quotas")).alias("x"))
    return each.select("shard", F.col("x.g").alias("g"), F.col("x.starts").alias("start"), F.col("x.quotas").alias("quota"))


def _slot(block: Column, n: Column, turn: int) -> Column:
    """The place of a block in the permuted list of pass ``turn``."""
    step = F.lit(PRIMES[-1])
    for p in PRIMES[:-1][::-1]:
        step = F.when(n % p != 0, F.lit(p)).otherwise(step)
    return (block * (step % n) + (turn + 1) * 7919) % n + turn * n


def lay_out(docs: DataFrame, block_words: int = 256, seed: int = 1, **shares) -> DataFrame:
    """Every row with its place: ``doc_id, h, source, size, source_size, target, g, start, b, n, k``.
    ``start`` is its first word's place in the source, ``b`` the words of a block, ``n`` the source's
    blocks, ``k`` its quota of them. Stored, since several steps need it."""
    sized = materialise(
        docs.select("doc_id", "source", F.xxhash64("text").alias("h"), word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")),
        "mix-sized",
    )
    sources = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **shares), "mix-targets")
    about = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    numbered = sized.join(broadcast_if(sources.withColumnRenamed("source", "s"), about[0], about[1]), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    digits = max(1, math.ceil(math.log(max(1, sized.count() / SLICE_ROWS), 16)))
    numbered = numbered.withColumn("slice", F.substring("key", 1, digits))
    # running sums in two steps: over the slices of a source, then inside each slice
    before = numbered.groupBy("g", "slice").agg(F.sum("size").alias("n")).select(
        "g", "slice", (F.sum("n").over(W.partitionBy("g").orderBy("slice")) - F.col("n")).alias("before")
    )
    inside = W.partitionBy("g", "slice").orderBy("key", "doc_id", "size", "h").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = numbered.withColumn("upto", F.sum("size").over(inside)).join(before, ["g", "slice"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    b = F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr("source_size div 64")), F.expr(f"source_size div {1 << 31} + 0"))
    placed = placed.withColumn("b", b.cast("bigint")).withColumn("n", F.ceil(F.col("source_size") / F.col("b")).cast("bigint"))
    placed = placed.withColumn("k", F.least(2 * F.col("n"), F.floor(F.col("target") / F.col("b") + 0.5)).cast("bigint"))
    return materialise(placed.select("doc_id", "h", "source", "size", "source_size", "target", "g", "start", "b", "n", "k"), "mix-placed")


def draw(placed: DataFrame, shard_words: int = 1 << 22, seed: int = 1) -> DataFrame:
    """The mix, from ``lay_out``: ``shard, place, doc_id, h, source, g, start, turn, first, words``.
    Each row is a run of ``words`` words of one document from word ``first`` (from 0) on, in pass
    ``turn``; ``place`` orders the blocks of a shard."""
    sources = placed.where("size > 0").groupBy("g").agg(F.first("k").alias("k"), F.first("b").alias("b"), F.first("n").alias("n"))
    row = sources.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.col("k") * F.col("b")), F.lit(0))).first()
    shards = max(1, math.ceil(row[1] / shard_words))
    quotas = shard_quotas(sources.select("g", "k"), row[0], shards, seed)
    # shards are looked up by ranges of slots, cut where a multiple of the mean quota lies: two rows a
    # shard and source at most, not one a block
    width = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("k") / shards))
    ranges = quotas.where("quota > 0").join(sources.select("g", width.alias("width")), "g")
    ranges = ranges.select("shard", "g", F.col("start").alias("first_slot"), (F.col("start") + F.col("quota")).alias("end_slot"), F.explode(F.expr("sequence(start div width, (start + quota - 1) div width)")).alias("bucket"))
    ranges = materialise(ranges, "mix-ranges")
    worded = placed.where("size > 0")
    blocks = worded.withColumn("block", F.explode(F.expr("sequence(start div b, (start + size - 1) div b)")))
    turns = F.array(*[F.struct(F.lit(t).alias("turn"), _slot(F.col("block"), F.col("n"), t).alias("slot")) for t in (0, 1)])
    runs = blocks.withColumn("x", F.explode(turns)).where("x.slot < k").select(
        "doc_id", "h", "source", "g", "start", "x.turn", "x.slot",
        F.expr("greatest(start, block * b) - start").alias("first"),
        F.expr("least(start + size, (block + 1) * b) - greatest(start, block * b)").alias("words"), F.floor(F.col("x.slot") / width).alias("bucket"),
    )
    found = runs.join(ranges, ["g", "bucket"]).where("slot >= first_slot and slot < end_slot")
    return found.withColumn("place", F.xxhash64(F.lit(seed), "shard", "g", "slot")).drop("slot", "bucket", "first_slot", "end_slot")


def write_shards(mix: DataFrame, path: str) -> None:
    """The mix as Parquet, a shard in one task, in its shuffled order. A shard is ``shard_words``
    words at most, about."""
    mix.repartition("shard").sortWithinPartitions("shard", "place", "start", "first").write.parquet(path)


def mix_report(docs: DataFrame, block_words: int = 256, shard_words: int = 1 << 22, seed: int = 1) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``.

    * null or wordless text: size 0, nothing taken;
    * null source: a source of its own, last; null ``doc_id``: a document like any other;
    * repeated rows: separate documents, laid side by side;
    * no words at all: targets 0; empty table: no rows. Other columns are ignored.
    """
    placed = lay_out(docs.select("doc_id", "source", "text"), block_words, seed)
    taken = draw(placed, shard_words, seed).groupBy("g", "start").agg(F.sum("words").alias("taken"))
    # rows with words are told apart by their place
    out = placed.join(taken.select(F.col("g").alias("tg"), F.col("start").alias("ts"), "taken"), (F.col("g") == F.col("tg")) & (F.col("start") == F.col("ts")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = 256, shard_words: int = 1 << 22, seed: int = 1, length: str | None = None) -> DataFrame:
    """The mix as documents: a row for each pass that takes words of a document, with the columns of
    ``docs``. Its text is the document's, if the pass takes all of it, or else the words taken,
    joined by blanks. ``length`` names a column to set to the text's length.

    * null or wordless text: no row; null source: a source of its own; null ``doc_id``: as any other;
    * repeated rows (equal in id, source and text): laid out one by one, each pass over each a row;
    * empty table: no rows; extra columns keep their values, whatever their names."""
    placed = lay_out(docs.select("doc_id", "source", "text"), block_words, seed)
    runs = draw(placed, shard_words, seed).groupBy("g", "start", "turn").agg(
        F.first(F.struct("doc_id", "source", "h")).alias("key"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("runs"), F.sum("words").alias("taken")
    ).select("key", "runs", "taken")
    # the columns of the input stay inside one, so that no name of theirs meets one made here
    key = F.struct(F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("h"))
    once = docs.where(F.length("text") > 0).select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).dropDuplicates(["key"])
    joined = once.join(runs, "key")
    words = split_words(F.col("row.text"))
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(w, (r["first"] + 1).cast("int"), r["words"].cast("int")))), " "))
    text = F.when(F.col("taken") == word_count(F.col("row.text")), F.col("row.text")).otherwise(F.get(cut, F.lit(0)))
    out = joined.select("row", text.alias("text"))
    made = {"text": F.col("text")} | ({length: F.length("text").cast("bigint")} if length else {})
    return out.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
