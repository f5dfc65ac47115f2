"""Spelling variants: pairs of vocabulary words one edit apart, by composition of finite-state machines.

With V the minimised acceptor of the vocabulary and E the transducer that inserts, deletes or replaces
one code point, the machine V o E o V accepts the pairs. It is not built whole. Two words one edit
apart share the first or the last half of the shorter one, so the composition falls into parts whose
initial state is that of V after a half was read (of V reversed, for the last half): a part has the
words of one half, and composes the minimised acceptors of what is left of them. Words of length M
are composed with themselves through replacements, and with words of length M + 1 through insertions.
States in which no edit was made are pairs of equal prefixes; after the edit both sides read the same.

A part of more than ``PART`` words is parted again by the halves of what its words do not share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialise
from .storing import stored

PART = 4096  # words of a part that is composed by one task
SHORT = 1  # parts whose shorter words have this much left are not parted again; letters bound them
ROWS = 1 << 14
LETTERS = "A-Za-zÀ-ÿ"
LEAST, OFTEN, EVERY = 5, 3, 97  # code points and occurrences of a word; runs that lose a letter


# ---- vocabulary ----


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: runs of letters of all texts, A-Z in lower case, one in 97 without one letter;
    those of five code points and three occurrences or more. A shorter run makes no word."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    words = runs.select(F.expr(f"if(h % {EVERY} = 0, concat(left(run, int(h % length(run))), substr(run, int(h % length(run)) + 2)), run)").alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= OFTEN) & (F.length("word") >= LEAST))


# ---- machines ----

State = tuple[tuple[str, int], ...]


class Acceptor:
    """The minimal acceptor of sorted, distinct words of one length: states with equal ways on are one
    state. State 0 is final."""

    def __init__(self, words: list[str]) -> None:
        self.names: dict[State, int] = {(): 0}
        self.ways: list[dict[str, int]] = [{}]
        path: list[list[tuple[str, int]]] = [[]]  # ways of the states of the last word, not yet named
        last = ""
        for word in words:
            k, most = 0, min(len(last), len(word))
            while k < most and last[k] == word[k]:
                k += 1
            self._close(path, last, k)
            path += [[] for _ in word[k:]]
            last = word
        self._close(path, last, 0)
        self.initial = self._named(path[0])

    def _named(self, ways: list[tuple[str, int]]) -> int:
        state = tuple(ways)
        if (name := self.names.get(state)) is None:
            name = self.names[state] = len(self.ways)
            self.ways.append(dict(state))
        return name

    def _close(self, path: list[list[tuple[str, int]]], word: str, depth: int) -> None:
        while len(path) > depth + 1:
            ways = path.pop()
            path[-1].append((word[len(path) - 1], self._named(ways)))


def _common(a: Acceptor, s: int, b: Acceptor, t: int, unless: str = "") -> Iterator[str]:
    """What both machines read from these states to the end, without what begins with ``unless``."""
    stack = [(s, t, "")]
    while stack:
        s, t, read = stack.pop()
        if not s and not t:
            yield read
            continue
        ways, others = a.ways[s], b.ways[t]
        for letter in ways.keys() & others.keys() if len(ways) > 1 and len(others) > 1 else ways if len(ways) == 1 else others:
            if letter in ways and letter in others and (read or letter != unless):
                stack.append((ways[letter], others[letter], read + letter))


def replaced(a: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs of words of ``a`` that differ in one letter."""
    stack = [(a.initial, "")]
    while stack:
        state, read = stack.pop()
        ways = list(a.ways[state].items())
        for i, (x, s) in enumerate(ways):
            stack.append((s, read + x))
            for y, t in ways[i + 1 :]:
                for rest in _common(a, s, a, t):
                    yield read + x + rest, read + y + rest


def inserted(a: Acceptor, b: Acceptor, at_end: bool = True) -> Iterator[tuple[str, str]]:
    """Pairs of a word of ``a`` and one of ``b`` that has one letter more. Of several places where the
    letter can stand, the last one counts; ``at_end`` says whether it may be the end."""
    stack = [(a.initial, b.initial, "")]
    while stack:
        s, t, read = stack.pop()
        for x, u in b.ways[t].items():
            if s or at_end:
                for rest in _common(a, s, b, u, x):
                    yield read + rest, read + x + rest
            if (v := a.ways[s].get(x)) is not None:
                stack.append((v, u, read + x))


def part_pairs(words: dict[str, tuple[str, int]], size: int, at_end: bool) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """Pairs among what is left of the words of a part: ``size`` letters, or one more."""
    short = sorted(w for w in words if len(w) == size)
    if not short:
        return
    long = sorted(w for w in words if len(w) == size + 1)
    a = Acceptor(short)
    found = [replaced(a)] if len(short) > 1 else []
    if long:
        found.append(inserted(a, Acceptor(long), at_end))
    for pairs in found:
        for x, y in pairs:
            yield words[x], words[y]


# ---- parts ----


def _parts(pieces: DataFrame) -> DataFrame:
    """Each piece in the two parts that it belongs to. ``part`` is a digest of the shared half and of
    the part before; ``size`` what the shorter words have left. A letter inserted at the end of a first
    half is one inserted at the start of the last half, where it counts."""
    first, last = "size div 2", "size - size div 2"
    rows = pieces.selectExpr(
        "word", "n",
        f"""inline(array(
          struct(unhex(md5(concat(hex(part), ' p ', size, ' ', left(rest, {first})))) as part, {last} as size, substr(rest, {first} + 1) as rest, at_end),
          struct(unhex(md5(concat(hex(part), ' s ', size, ' ', right(rest, {last})))) as part, {first} as size, left(rest, length(rest) - ({last})) as rest, false as at_end)))""",
    )
    return rows.select("part", "size", "rest", "at_end", "word", "n")


def _composed(parts: DataFrame) -> DataFrame:
    """``word, near, near_n``, both ways, for the pairs of each part."""
    columns = ["part", "size", "at_end", "rest", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []
        rows = (row for batch in batches for row in zip(*(batch[k].to_pylist() for k in columns)))
        for (_, size, at_end), group in groupby(rows, lambda r: r[:3]):
            for (u, n), (v, m) in part_pairs({r[3]: (r[4], r[5]) for r in group}, size, at_end):
                out += [(u, v, m), (v, u, n)]
                if len(out) >= ROWS:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])

    return parts.select(*columns).repartition("part").sortWithinPartitions("part", "size", "at_end").mapInArrow(run, "word string, near string, near_n bigint")


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """``word, near, near_n``: all words one edit apart, both ways, once each."""
    pieces = words.selectExpr("word", "n", "inline(array(struct(cast('' as binary) as part, length(word) as size), struct(cast('' as binary) as part, length(word) - 1 as size)))", "word as rest", "true as at_end")
    found = None
    while True:
        parts = stored(_parts(pieces), "spelling-parts")
        sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("words")).where("words > 1")
        seen = Observation()
        parts = materialise(parts.join(sizes, "part").observe(seen, F.sum(F.expr(f"int(words > {part} and size > {SHORT})")).alias("large")), "spelling-parts")
        large = (F.col("words") > part) & (F.col("size") > SHORT)
        pairs = _composed(parts.where(~large))
        found = pairs if found is None else found.union(pairs)
        if not seen.get["large"]:
            return found
        pieces = parts.where(large).select("word", "n", "part", "size", "rest", "at_end")


# ---- forms ----


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: forms followed to the last, by doubling; each step has twice the occurrences, so
    a handful of rounds do."""
    now = materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        seen = Observation()
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialise(now.join(on, "root", "left").observe(seen, F.count("next").alias("moved")).select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        if not seen.get["moved"]:
            return now


def spelling_variants(docs: DataFrame, part: int = PART) -> DataFrame:
    """Per vocabulary word: ``word, form, root, n, n_near, form_n``. The form of a word is its most
    frequent near word, if that is at least twice as frequent; the root is where forms end.

    * null or empty text: no runs; very long texts and words: whole;
    * null ``doc_id``: written as nothing before the colon; repeated rows: counted each;
    * near words of equal frequency: the least in code-point order;
    * empty table: no rows; extra columns are ignored, whatever their names.
    """
    words = stored(vocabulary(docs), "spelling-words")
    best = near_pairs(words, part).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.expr("if(-best.less >= 2 * n, best.near, null)").alias("form"), F.expr("if(-best.less >= 2 * n, -best.less, null)").alias("form_n"))
    forms = stored(joined, "spelling-forms")
    roots = _roots(forms)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
