"""Comparison of two tables that should hold the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.narrowing import cut_by_rank
from millrace.operators.warehouse import row_hash


def count_compare(source: DataFrame, target: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("rows"))
    return one(source, "source").unionByName(one(target, "target"))


def _both(source: DataFrame, target: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Both sides grouped, stacked and grouped again: no join, null keys meet each other."""
    a = source.groupBy(*keys).agg(F.lit(1).alias("in_source"), F.lit(0).alias("in_target"), *[v.alias(f"source_{k}") for k, v in aggs.items()])
    b = target.groupBy(*keys).agg(F.lit(0).alias("in_source"), F.lit(1).alias("in_target"), *[v.alias(f"target_{k}") for k, v in aggs.items()])
    rows = a.unionByName(b, allowMissingColumns=True)
    names = [f"{s}_{k}" for k in aggs for s in ("source", "target")]
    return rows.groupBy(*keys).agg(F.max("in_source").alias("in_source"), F.max("in_target").alias("in_target"), *[F.max(n).alias(n) for n in names])


def group_count_diff(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose counts differ."""
    out = _both(source, target, keys, {"rows": F.count(F.lit(1))})
    a, b = F.coalesce("source_rows", F.lit(0)), F.coalesce("target_rows", F.lit(0))
    return out.where(a != b).select(*keys, a.alias("source_rows"), b.alias("target_rows"), (a - b).alias("difference"))


def row_checksum_diff(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose row hash differs or that exist on one side only."""
    a = source.select(key, row_hash(columns).alias("source_hash"))
    b = target.select(key, row_hash(columns).alias("target_hash"))
    j = a.join(b, key, "full")
    kind = F.when(F.col("target_hash").isNull(), "missing").when(F.col("source_hash").isNull(), "extra").when(F.col("source_hash") != F.col("target_hash"), "mismatch")
    return j.withColumn("kind", kind).where("kind IS NOT NULL").select(key, "kind")


def group_checksum(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str], amount: str) -> DataFrame:
    """Count, sum and checksum by group, differing groups only.

    The checksum is the sum of the row hashes, in two halves of 64 bits: it does not depend on row order and
    adds up in parts, so no group is ever collected to be hashed as one text.
    """
    half = lambda at: F.sum(F.conv(F.substring(row_hash(columns), at, 16), 16, 10).cast("decimal(20,0)")).cast("string")
    part = F.concat(half(1), F.lit(":"), half(17))
    out = _both(source, target, keys, {"rows": F.count(F.lit(1)), "total": F.round(F.sum(amount), 2), "checksum": part})
    same = F.col("source_checksum").eqNullSafe(F.col("target_checksum")) & F.col("source_rows").eqNullSafe(F.col("target_rows"))
    return out.where(~same).drop("in_source", "in_target")


def rule_totals(source: DataFrame, target: DataFrame, keys: Sequence[str], amount: str, tolerance: float = 0.01) -> DataFrame:
    """Totals by key within a tolerance: missing, mismatch, extra."""
    out = _both(source, target, keys, {"total": F.sum(amount)})
    gap = F.abs(F.col("source_total") - F.col("target_total"))
    kind = F.when(F.col("in_target") == 0, "missing").when(F.col("in_source") == 0, "extra").when(gap > tolerance, "mismatch")
    return out.withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "source_total", "target_total", "kind")


def missing_rows(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return source.join(target.select(key), key, "left_anti")


def field_mismatches(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Same key, differing field: one row per field with both values as text; nulls compare as values."""
    j = source.select(key, F.struct(*columns).alias("s")).join(target.select(key, F.struct(*columns).alias("t")), key)
    diffs = [
        F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"s.{c}").cast("string").alias("source_value"), F.col(f"t.{c}").cast("string").alias("target_value")))
        for c in columns
    ]
    return j.select(key, F.explode(F.filter(F.array(*diffs), lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def missed_changes(changes: DataFrame, applied: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """Changes of a time window that were not applied."""
    at = F.col(ts)
    kind = changes.schema[ts].dataType
    return changes.where((at >= F.lit(start).cast(kind)) & (at < F.lit(end).cast(kind))).join(applied.select(key), key, "left_anti")


def sampled_validation(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str], z: float = 1.96, margin: float = 0.05) -> DataFrame:
    """Error share of a repeatable sample with its interval.

    The sample size is z^2 x 0.25 / margin^2, with the finite correction under 10,000 rows. Rows are
    taken in the order of their key hash.
    """
    base = z * z * 0.25 / (margin * margin)
    spot = source.select(key, row_hash(columns).alias("h"), F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 13), 16, 10).cast("long").cast("double").alias("spot"))
    size = lambda n: F.ceil(F.when(n < 10000, F.lit(base) / (1 + (F.lit(base) - 1) / n)).otherwise(F.lit(base)))
    # the sample is a small share of a large table, and most of a small one, which is opened whole
    sample = cut_by_rank(spot, [], "spot", key, [(0.0, size)], "beyond").where("beyond = 0")
    other = target.select(F.col(key).alias("__k"), row_hash(columns).alias("__h"))
    j = sample.join(other, F.col(key) == F.col("__k"), "left")
    out = j.agg(F.count(F.lit(1)).alias("sample_size"), F.count_if(~F.col("h").eqNullSafe(F.col("__h"))).alias("errors"))
    out = source.agg(F.count(F.lit(1)).alias("population")).crossJoin(F.broadcast(out))
    p = F.col("errors") / F.col("sample_size")
    half = z * F.sqrt(p * (1 - p) / F.col("sample_size"))
    return out.withColumn("error_rate", p).withColumn("lower", F.greatest(F.lit(0.0), p - half)).withColumn("upper", F.least(F.lit(1.0), p + half)).withColumn("estimated_errors", F.floor(p * F.col("population")))


def drift_report(findings: DataFrame, table: str, kind: str, corrected: str, day: str, split: str) -> DataFrame:
    """Findings by table and type: share corrected, daily mean before and after ``split``, and whether it rose over 1.2x."""
    cut = F.lit(split).cast("date")
    out = findings.groupBy(table, kind).agg(
        F.count(F.lit(1)).alias("findings"), F.avg(F.col(corrected).cast("int")).alias("corrected_share"),
        (F.count_if(F.col(day) < cut) / F.greatest(F.countDistinct(F.when(F.col(day) < cut, F.col(day))), F.lit(1))).alias("daily_before"),
        (F.count_if(F.col(day) >= cut) / F.greatest(F.countDistinct(F.when(F.col(day) >= cut, F.col(day))), F.lit(1))).alias("daily_after"),
    )
    return out.withColumn("trend", F.when(F.col("daily_after") > F.col("daily_before") * 1.2, "increasing").otherwise("stable"))
