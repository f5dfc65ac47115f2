"""Single-label classification: aligning, agreement and frequency of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import keep_last
from .ledger import running_before


def _norm(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def valid_labelled(df: DataFrame, n: int, name: str = "name", label_id: str = "label_id", label: str = "label", ord: str = "ord") -> DataFrame:
    """The first ``n`` rows (by ``ord``) whose three fields are filled and whose id is a
    number, for any ``n``: a row's place is a prefix scan over ranges of ``ord``, so the rows taken are
    never brought together. Among rows of one ``ord`` any may be taken."""
    fields = {c: F.trim(c) for c in (name, label_id, label)}
    filled = df.withColumns(fields).filter(" and ".join(f"{c} <> ''" for c in fields))
    valid = filled.withColumn(label_id, F.expr(f"try_cast({label_id} as bigint)")).filter(F.col(label_id).isNotNull())
    placed = running_before(valid.withColumn("_all", F.lit(0)), "_all", [ord], {"_place": F.lit(1).cast("bigint")})
    return placed.filter(F.col("_place") < n).drop("_all", "_place")


def align_labels(base: DataFrame, others: dict[str, DataFrame], key: str = "keyword", ord: str = "ord") -> DataFrame:
    """Every base row in its order with the labels each source gives its keyword (compared
    trimmed and lower-case; the last row of a source wins, the base's own included).
    Sources have ``label_id, label_name``; missing ones give ''."""
    out = base.select(ord, key, _norm(F.col(key)).alias("_k"))
    for name, df in {"base": base, **others}.items():
        last = keep_last(df.select(_norm(F.col(key)).alias("_k"), ord, "label_id", "label_name"), "_k", ord)
        out = out.join(
            last.select("_k", F.col("label_id").alias(f"{name}_id"), F.col("label_name").alias(f"{name}_name")), "_k", "left"
        )
    names = ["base", *others]
    blank = [F.coalesce(F.col(f"{n}_{f}").cast("string"), F.lit("")).alias(f"{n}_{f}") for n in names for f in ("id", "name")]
    return out.select(ord, key, *blank)


def label_agreement(aligned: DataFrame, a: str, b: str, base: str = "base") -> DataFrame:
    """Match flags per row; a blank label matches nothing."""
    def same(x: str, y: str, f: str) -> Column:
        return (_norm(F.col(f"{x}_{f}")) == _norm(F.col(f"{y}_{f}"))) & (_norm(F.col(f"{x}_{f}")) != "")

    return aligned.select(
        "*",
        same(base, a, "id").alias(f"{a}_id_match"),
        same(base, b, "id").alias(f"{b}_id_match"),
        same(a, b, "id").alias("peers_id_match"),
        same(base, a, "name").alias(f"{a}_name_match"),
        same(base, b, "name").alias(f"{b}_name_match"),
        (same(base, a, "id") & same(base, b, "id")).alias("all_id_match"),
    )


def agreement_summary(flags: DataFrame) -> DataFrame:
    """Count and share of each flag as ``metric, n, share``, in one pass."""
    names = [c for c in flags.columns if c.endswith("_match")]
    one = flags.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(c) for c in names])
    cells = [
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("n"), F.try_divide(F.col(c), F.col("_n")).alias("share"))
        for c in names
    ]
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def label_frequency(df: DataFrame, label_id: str = "label_id", name: str = "label_name", ord: str = "ord") -> DataFrame:
    """Rows per label with the name its first row gives it."""
    return df.groupBy(label_id).agg(F.count(F.lit(1)).alias("n"), F.min_by(name, ord).alias(name))
