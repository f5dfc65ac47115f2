"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations.

The index holds one posting ``(term, id, h, pos)`` for every occurrence of a test term in the
training documents, stored as Parquet. A *window* is ``size`` consecutive words of a test item, or
the whole item if it is shorter. Occurrences are found the way a phrase query is: the lists of a
window's two rarest terms, shifted by their offsets, are intersected first, and only what is left is
intersected with the lists of all its other terms. A term that fills a third of the corpus is looked
up by position only, never expanded, unless a window has no rarer one.

A document is known by its id and a hash of its text, so repeated ids with other texts stay apart and
null ids are found again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import broadcast_if
from ..session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: everything that is not a word: ASCII but for digits and small letters
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else. ``lower`` is much faster and the same on plain ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """The words of a text in order. A gap at either end leaves an empty string there: positions
    are the array's, and empty strings match nothing."""
    return F.split(ascii_lower(text), GAP)


def _count(words: Column) -> Column:
    first, last = F.element_at(words, 1) == "", F.element_at(words, -1) == ""
    return F.when(words.isNull(), 0).otherwise(F.size(words) - first.cast("int") - (last & (F.size(words) > 1)).cast("int"))


def _sized(df: DataFrame, term: str) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(term)), F.lit(0))).first()
    return row[0], row[1]


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """``item_id, window, words``: the distinct windows of each item."""
    words = items.select(F.col("item_id"), F.filter(word_array(F.col("text")), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return each.withColumn("window", F.md5(F.array_join("words", " "))).dropDuplicates(["item_id", "window"])


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of ``terms`` in ``docs``, stored: ``term, id, h, n_words, pos``. Every document also
    has one row with a null term, so that those without postings are listed."""
    rows, chars = _sized(terms, "term")
    text = F.col("text")
    each = (
        docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), word_array(text).alias("w"))
        .select("id", "h", _count(F.col("w")).cast("bigint").alias("n_words"), F.posexplode(F.concat(F.coalesce("w", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    )
    known = each.join(broadcast_if(terms.select("term"), rows, chars), F.col("word") == F.col("term"), "left")
    return materialise(known.where("term is not null or word is null").select("term", "id", "h", "n_words", "pos"), "postings")


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])


def phrase_matches(index: DataFrame, wins: DataFrame) -> DataFrame:
    """``window, len, id, h, start`` of every occurrence of the windows ``(window, words)``."""
    postings = index.where("term is not null")
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = wins.select("window", F.size("words").alias("len"), F.posexplode("words").alias("off", "term"))
    # a window with a term that never occurs has no list to intersect
    ranked = (
        terms.join(counts, "term").groupBy("window", "len")
        .agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("t")).where(F.size("t") == F.col("len"))
        .select("window", "len", F.col("t")[0].alias("a"), F.get("t", F.lit(1)).alias("b"), F.slice("t", 3, F.col("len")).alias("rest"))
    )
    ranked = materialise(ranked, "windows")
    anchors = ranked.select("window", F.col("a.term").alias("term"), F.col("a.off").alias("off"))
    rows, chars = _sized(anchors, "window")
    found = postings.join(broadcast_if(anchors, 2 * rows, 2 * chars), "term").select("window", "id", "h", (F.col("pos") - F.col("off")).alias("start"))
    found = materialise(found, "phrase-rarest")

    found = _intersect(found, ranked.where("b is not null").select("window", F.array("b").alias("t")), postings).union(
        _no_more(found, ranked.where("b is null"))
    )
    found = materialise(found, "phrase-second")
    docs = found.select("id", "h").distinct()
    n = docs.count()
    rest = ranked.where(F.size("rest") > 0).select("window", F.col("rest").alias("t"))
    near = postings.join(broadcast_if(docs, n, 0), _same_doc(postings, docs), "left_semi")
    found = _intersect(found, rest, near).union(_no_more(found, ranked.where(F.size("rest") == 0)))
    return found.join(ranked.select("window", "len"), "window").select("window", "len", "id", "h", "start")


def _no_more(found: DataFrame, wins: DataFrame) -> DataFrame:
    return found.join(wins.select("window"), "window", "left_semi")


def _intersect(found: DataFrame, wins: DataFrame, postings: DataFrame) -> DataFrame:
    """The candidates whose terms ``t`` all stand at their offsets."""
    rows = wins.select("window", F.size("t").alias("need"), F.explode("t").alias("x")).select("window", "need", "x.off", "x.term")
    n, chars = _sized(rows, "window")
    asked = found.join(broadcast_if(rows, 2 * n, 2 * chars), "window").withColumn("pos", (F.col("start") + F.col("off")).cast("int"))
    wanted = rows.select("term").distinct()
    k, chars = _sized(wanted, "term")
    lists = postings.join(broadcast_if(wanted, k, chars), "term", "left_semi")
    met = asked.join(lists, _same_doc(asked, lists) & (asked["term"] == lists["term"]) & (asked["pos"] == lists["pos"]), "left_semi")
    # repeated rows repeat postings and candidates alike: offsets are counted once
    return met.groupBy("window", "id", "h", "start").agg(F.count_distinct("off").alias("n"), F.first("need").alias("need")).where("n = need").select("window", "id", "h", "start")


def proximity_matches(index: DataFrame, wins: DataFrame, slack: int = 3) -> DataFrame:
    """``window, id, h``: documents where every word of a window occurs within ``slack`` places of
    where the phrase has it, seen from an occurrence of the window's rarest term."""
    postings = index.where("term is not null")
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = wins.select("window", F.size("words").alias("len"), F.posexplode("words").alias("off", "term"))
    full = materialise(terms.join(counts, "term"), "proximity-terms")
    rarest = full.groupBy("window", "len").agg(F.min(F.struct("n", "off", "term")).alias("a"), F.count(F.lit(1)).alias("have")).where("have = len")
    anchor = postings.join(rarest.select("window", "len", F.col("a.term").alias("term"), F.col("a.off").alias("o")), "term").select(
        "window", "len", "id", "h", (F.col("pos") - F.col("o")).alias("start")
    ).distinct()
    asked = anchor.join(full.select("window", "term", "off"), "window").withColumn(
        "pos", F.explode(F.sequence((F.col("start") + F.col("off") - slack).cast("int"), (F.col("start") + F.col("off") + slack).cast("int")))
    )
    met = asked.join(postings, _same_doc(asked, postings) & (asked["term"] == postings["term"]) & (asked["pos"] == postings["pos"]), "left_semi")
    return met.groupBy("window", "len", "id", "h", "start").agg(F.count_distinct("off").alias("n")).where("n = len").select("window", "id", "h").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``text_hash``.

    * null, empty or wordless text: no words, nothing hit;
    * an item without words has no window; one of fewer than ``size`` words is one window;
    * repeated rows, of either table: each document row gets its result, an item counts once;
    * null ``doc_id``: has its result like any other row; null ``item_id``: its windows hit, but
      it is not listed nor counted as an item;
    * empty tables: no rows, or no hits. Other columns are ignored, whatever their names.
    """
    wins = materialise(windows(items.select("item_id", "text"), size), "item-windows")
    distinct = wins.select("window", "words").dropDuplicates(["window"])
    index = build_index(docs, distinct.select(F.explode("words").alias("term")).distinct())
    hits = materialise(phrase_matches(index, distinct), "hits")
    covered = hits.select("id", "h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct()
    n_hit = covered.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("window", "id", "h").distinct().join(wins.where("item_id is not null").select("window", "item_id"), "window")
    ids = named.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    found = n_hit.join(ids, _same_doc(n_hit, ids), "left").select(n_hit["id"].alias("fid"), n_hit["h"].alias("fh"), "n_hit", "ids")
    all_docs = index.where("term is null").select("id", "h", "n_words")
    none = F.array().cast("array<string>")
    return all_docs.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")), "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.col("h").alias("text_hash"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` that no window of ``items`` occurs in, all columns kept."""
    bad = contamination(docs, items, size).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti")
