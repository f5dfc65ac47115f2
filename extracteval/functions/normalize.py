"""Normalising expressions. Two families exist and are never mixed silently: the
``strict`` one keeps inner spacing, the ``collapse`` one squeezes it (the default)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that count as white space.
WHITE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# the same for patterns: (?U) makes \s cover no-break and other Unicode spaces
SPACES = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column, also: str = "") -> Column:
    """Inner runs of white space (and of the characters in ``also``) become one space, outer
    ones go. Normalising is the inner loop of every comparison, so the pattern only runs
    where two spaces really meet."""
    blank = WHITE + also
    flat = F.translate(c, blank, " " * len(blank))
    return F.trim(F.when(flat.contains("  "), F.regexp_replace(flat, " +", " ")).otherwise(flat))


def norm_key(c: Column, mode: str = "collapse") -> Column:
    if mode == "strict":
        return F.translate(strip(F.lower(c)), "_-", "  ")
    if mode == "collapse":
        return F.coalesce(squeeze(F.lower(c), "_-"), F.lit(""))
    if mode == "snake":
        # translate() drops the characters that have no counterpart: the parentheses
        return F.translate(strip(F.lower(c)), " /()", "__")
    raise ValueError(f"unknown key mode {mode!r}")


def norm_value(c: Column, mode: str = "collapse") -> Column:
    if mode == "strict":
        return F.coalesce(strip(F.lower(c)), F.lit(""))
    if mode == "collapse":
        return F.coalesce(squeeze(F.lower(c)), F.lit(""))
    if mode == "quoted":
        return unquote_value(c)
    raise ValueError(f"unknown value mode {mode!r}")


def unquote_value(c: Column) -> Column:
    """Peel matching quote pairs (white space inside each pair goes with it), then loose
    quotes at either end, trailing commas and spare white space; lower-case."""
    text = strip(F.coalesce(c, F.lit("")))
    # No more layers can be peeled than there are leading quotes, so the loop is short.
    lead = F.regexp_extract(text, r"""(?U)^["'\s]*""", 0)
    depth = F.length(lead) - F.length(F.translate(lead, "\"'", ""))
    peeled = F.aggregate(
        F.sequence(F.lit(1), depth),
        text,
        lambda acc, _: F.regexp_replace(acc, r"""(?sU)^(["'])\s*(.*?)\s*\1$""", "$2"),
    )
    inner = F.btrim(F.when(depth > 0, peeled).otherwise(text), F.lit("\"'"))
    inner = F.regexp_replace(F.lower(strip(F.rtrim(strip(inner), F.lit(",")))), SPACES, " ")
    # values without quotes or commas, nearly all of them, take the short way
    special = text.contains('"') | text.contains("'") | text.contains(",")
    return F.when(special, inner).otherwise(squeeze(F.lower(text)))


def percent_decode(c: Column) -> Column:
    """Percent escapes decoded and nothing else: plus signs, and percent signs that do not start
    an escape, are kept."""
    safe = F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(safe), c)


def clean_query(c: Column) -> Column:
    """Percent-decode, plus signs to spaces, squeeze. Percent signs that do not start an
    escape are kept as they are, so a malformed cell is never lost."""
    safe = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return squeeze(F.coalesce(F.try_url_decode(safe), c), "+")


def fix_backslashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def canonical_form(c: Column) -> Column:
    """The spelling under which synonym tables are looked up."""
    return F.regexp_replace(strip(F.lower(c)), r"(?U)[_\-\s]+", " ")


def canonical_key(df: DataFrame, key: str, synonyms: DataFrame, out: str = "canonical_key") -> DataFrame:
    """Replace a key by its canonical one; the lowest ``rank`` wins when a variant is
    listed twice; unlisted keys map to themselves.

    ``synonyms`` is ``(variant, canonical, rank)``. It is reduced to one row per variant
    first, so the left join keeps the row count; Catalyst broadcasts it by its own size
    estimate and shuffles otherwise.
    """
    one = synonyms.groupBy("variant").agg(F.min_by("canonical", "rank").alias("_canonical"))
    form = canonical_form(F.col(key))
    return (
        df.withColumn("_form", form)
        .join(one, F.col("_form") == F.col("variant"), "left")
        .withColumn(out, F.coalesce("_canonical", "_form"))
        .drop("_form", "_canonical", "variant")
    )
