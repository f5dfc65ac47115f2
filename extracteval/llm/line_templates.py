"""Lines that recur across documents, found by a log-template tree.

A line is its words; words with a digit are variable. The tree has a fixed depth: a line goes by its
number of words, then by its first ``depth`` words, to a leaf. Inside a leaf, words further on are
generalised: a word that fewer than ``min_docs`` lines of the leaf have at its place is variable too.
A line with its variable words left open is a *template*. A template recurs if it is in ``min_docs``
documents and is definite enough: no word is open, or ``words`` words are fixed and so is a ``share``
of all. Lines of recurring templates are dropped.

A value of a variable field that ``min_docs`` lines have would pass for fixed text, and more data has
more of those. So of lines that stay, coarser templates are looked at as well: those with the words
open that fewer than 2, 4, 8, ... times ``min_docs`` lines have. The first that recurs, in whatever
lines, is taken. Among the values of a field and the words around it there is such a bound, since two
values or more share what the fixed words have.

Lines of the tree are counted once for each document. All steps are counts and equi-joins; a frequent
line or leaf is summed up before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import broadcast_if
from ..session import materialise
from .mixing import SPACE, let

OPEN = "<*>"


def _small(digests: DataFrame) -> DataFrame:
    """A broadcast, if the measured number of rows of digests is surely small."""
    rows = digests.count()
    return broadcast_if(digests, rows, 32 * len(digests.columns) * rows)


BLANKS = " \t\n\x0b\x0c\r"


def _tokens(line: Column) -> Column:
    """The words of a trimmed line, those with a digit open."""
    words = F.split(line, SPACE)
    return F.when(line.rlike("[0-9]"), F.transform(words, lambda w: F.when(w.rlike("[0-9]"), OPEN).otherwise(w))).otherwise(words)


def _raw_lines(docs: DataFrame) -> DataFrame:
    """``id, h, line_no, line, raw``: trimmed lines that are not blank, and their 64-bit hash."""
    each = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''").withColumn("raw", F.xxhash64("line"))


def _with_ids(raw: DataFrame, depth: int) -> DataFrame:
    each = raw.withColumn("tokens", _tokens(F.col("line"))).drop("line")
    leaf = F.md5(F.concat_ws(" ", F.size("tokens").cast("string"), F.slice("tokens", 1, depth)))
    return each.withColumn("line_id", F.md5(F.array_join("tokens", " "))).withColumn("leaf", leaf)


def lines(docs: DataFrame, depth: int = 3) -> DataFrame:
    """``id, h, line_no, raw, tokens, line_id, leaf`` of every line with a word."""
    return _with_ids(_raw_lines(docs), depth)


def recurring_lines(docs: DataFrame, found: DataFrame, depth: int, min_docs: int, words: int, share: float) -> DataFrame:
    """``line_id, template`` of the lines to drop. ``found`` are the stored lines without tokens."""
    once = found.groupBy("id", "h", "line_id", "leaf").agg(F.min("raw").alias("raw"))
    counted = once.groupBy("line_id", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("raw"))
    counted = materialise(counted, "lines-counted")
    leaves = counted.groupBy("leaf").agg(F.sum("n").alias("all")).where(F.col("all") >= min_docs).select("leaf")
    leaves = materialise(leaves, "lines-leaves")
    some = materialise(counted.join(_small(leaves), "leaf", "left_semi"), "lines-candidates")

    # the words of each candidate line, from any document that has it: found again by the hash of
    # one of its spellings, before words are made
    ids = some.select("line_id")
    raw = _raw_lines(docs).select("line", "raw").join(_small(some.select("raw")), "raw", "left_semi")
    texts = _with_ids(raw, depth).select("line_id", "tokens").join(_small(ids), "line_id", "left_semi")
    tokens = texts.groupBy("line_id").agg(F.first("tokens").alias("tokens")).join(some.drop("raw"), "line_id")
    placed = materialise(tokens.select("line_id", "leaf", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "word")), "lines-words")
    frequent = placed.where(F.col("pos") >= depth).groupBy("leaf", "pos", "word").agg(F.sum("n").alias("m")).where(F.col("m") >= min_docs)
    marked = placed.join(frequent, ["leaf", "pos", "word"], "left")
    # as many words as the line has
    whole = marked.groupBy("line_id", "size").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "m"))).alias("w"))
    # k-th: words that fewer than min_docs * 2^k lines have are open; only where that opens another word
    top = F.array_max(F.transform("w", lambda x: F.when((x["pos"] >= depth) & (x["word"] != OPEN), x["m"]).otherwise(0)))
    steps = whole.withColumn("k", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.floor(F.coalesce(top, F.lit(0)) / min_docs))) - 1)))
    least = F.lit(min_docs) * F.pow(F.lit(2.0), F.col("k"))
    opens = F.exists("w", lambda x: (x["pos"] >= depth) & (x["word"] != OPEN) & F.coalesce((x["m"] >= least / 2) & (x["m"] < least), F.lit(False)))
    word = lambda x: F.when((x["pos"] < depth) | (x["m"] >= least), x["word"]).otherwise(OPEN)
    whole = steps.where((F.col("k") == 0) | opens).select("line_id", "size", "k", F.transform("w", word).alias("w"))
    fixed = F.size(F.filter("w", lambda x: x != OPEN))
    definite = (fixed == F.col("size")) | ((fixed >= words) & (fixed >= share * F.col("size")))
    template = whole.where(definite).select("line_id", "k", F.md5(F.array_join("w", " ")).alias("template"))
    template = materialise(template, "lines-templates")

    def often(of: DataFrame) -> DataFrame:
        seen = found.select("id", "h", "line_id").join(_small(of), "line_id").select("id", "h", "template").distinct()
        return seen.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template")

    first = template.where("k = 0").select("line_id", "template")
    first = materialise(first.join(often(first), "template").select("line_id", "template"), "lines-first")
    # coarser templates of the other lines, counted in all lines that have them
    others = materialise(template.where("k > 0").join(_small(first.select("line_id")), "line_id", "left_anti"), "lines-others")
    wanted = materialise(others.select("template").distinct(), "lines-wanted")
    alike = materialise(template.join(_small(wanted), "template", "left_semi").select("line_id", "template").distinct(), "lines-alike")
    coarse = others.join(often(alike), "template").groupBy("line_id").agg(F.min_by("template", "k").alias("template"))
    return first.union(coarse)


def drop_recurring_lines(docs: DataFrame, depth: int = 3, min_docs: int = 10, words: int = 4, share: float = 0.7) -> DataFrame:
    """Per document: ``doc_id, n_lines`` (lines with a word), ``n_dropped, n_templates`` (different
    templates dropped), ``kept`` (the other lines, blank ones too, joined by line ends).

    * null text: no lines, ``kept`` is null; empty or blank text: no lines, kept as it is;
    * very long lines and texts: whole; lines of fewer words than ``depth``: the leaf is the line;
    * repeated rows: one document as to counts, a result each; null ``doc_id``: like any other;
    * empty table: no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    found = materialise(lines(docs, depth).drop("tokens"), "lines")
    drop = materialise(recurring_lines(docs, found, depth, min_docs, words, share), "lines-dropped")
    said = found.join(_small(drop), "line_id", "left").distinct()  # repeated rows
    per = said.groupBy("id", "h").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("template").alias("n_templates"),
        F.collect_set(F.when(F.col("template").isNotNull(), F.col("line_no"))).alias("gone"),  # lines of one text
    )
    text = docs.withColumn("key", F.xxhash64("text"))
    joined = text.join(per, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("h")), "left")
    # runs of lines between the dropped ones
    gone = F.sort_array("gone")
    begins, ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda i: i + 1)), lambda all_: F.concat(gone, F.array(F.size(all_)))
    runs = lambda all_: F.zip_with(begins, ends(all_), lambda a, b: F.slice(all_, a + 1, b - a))
    kept = let(F.split("text", "\n"), lambda all_: F.flatten(runs(all_)))
    return joined.select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce("n_templates", F.lit(0)).cast("bigint").alias("n_templates"),
        F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("kept"),
    )
