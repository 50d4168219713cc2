"""Fingerprints of tables without order: what changed between two runs is told from sums of row hashes, never from a sort.

A row's text is its values in the order of the columns' names, each with its length in front and null apart from the empty text. Rows are
hashed by MD5; a fingerprint is the number of rows, the sum and the exclusive or of the hashes' first 15 digits, combined within partitions first.
Repeated rows count, order and partitions don't. Nested values count as their JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 15


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    def one(name: str) -> Column:
        c = F.col(f"`{name}`")
        text = F.to_json(c) if df.schema[name].dataType.typeName() in ("array", "map", "struct") else c.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat_ws("|", *[one(c) for c in sorted(columns or df.columns)])


def _sums(df: DataFrame, columns: list[str] | None) -> list[Column]:
    h = F.conv(F.substring(F.md5(row_text(df, columns).cast("binary")), 1, DIGITS), 16, 10).cast("long")
    return [F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("mixed")]


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n, total, mixed. Equal for tables that hold the same rows as often."""
    return df.agg(*_sums(df, columns))


def fingerprints(df: DataFrame, *keys: str, columns: list[str] | None = None) -> DataFrame:
    """The same for each group of rows; the keys count as part of the rows."""
    return df.groupBy(*keys).agg(*_sums(df, columns))


def changes(before: DataFrame, after: DataFrame, *keys: str, columns: list[str] | None = None) -> DataFrame:
    """(keys, change): same, changed, added or removed, of each group of either table; null keys are a group as well."""
    a, b = fingerprints(before, *keys, columns=columns), fingerprints(after, *keys, columns=columns).withColumnsRenamed({c: f"new_{c}" for c in (*keys, "n", "total", "mixed")})
    same = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys]
    out = a.join(b, same, "full")
    alike = (F.col("n") == F.col("new_n")) & (F.col("total") == F.col("new_total")) & (F.col("mixed") == F.col("new_mixed"))
    change = F.when(F.col("n").isNull(), "added").when(F.col("new_n").isNull(), "removed").when(alike, "same").otherwise("changed")
    return out.select(*[F.when(F.col("n").isNull(), F.col(f"new_{k}")).otherwise(F.col(k)).alias(k) for k in keys], change.alias("change"))


def settings_diff(before: dict[str, object], after: dict[str, object]) -> list[tuple[str, str, str]]:
    """(name, before, after) of the settings that differ, by name; numbers to four places, what is missing as a dash."""
    shown = lambda v: "-" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    names = sorted({*before, *after})
    return [(k, shown(before.get(k)), shown(after.get(k))) for k in names if shown(before.get(k)) != shown(after.get(k))]
