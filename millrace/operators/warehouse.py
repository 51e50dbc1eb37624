"""Table maintenance as joins plus rewrite: upserts, slowly changing dimensions, vault loads, change data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import prefixed


def row_hash(columns: Sequence[str]) -> Column:
    """MD5 over the columns in their prefixed form: rows that differ in any column or null have different texts."""
    return F.md5(prefixed(columns))


def _side(df: DataFrame, tag: str) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(tag))


def newest(df: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key, the newest: a combinable aggregate."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), ts).alias("__r")).select("__r.*")


def upsert(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Matched rows take the source's ``columns``, unmatched source rows are added."""
    cols = [c for c in target.columns if c != key]
    changed = set(columns or cols)
    j = _side(target, "t").join(_side(source.select(*target.columns), "s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    hit = F.col("s").isNotNull()
    out = [F.coalesce(f"s.{key}", f"t.{key}").alias(key)]
    for c in cols:
        fresh = hit if c in changed else (hit & F.col("t").isNull())
        out.append(F.when(fresh, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return j.select(*out)


def merge_newer(target: DataFrame, source: DataFrame, key: str, ts: str) -> DataFrame:
    """Upsert where a matched row is replaced only by a newer one; the source is reduced to its newest rows first."""
    s = newest(source.select(*target.columns), key, ts)
    j = _side(target, "t").join(_side(s, "s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    take = F.col("t").isNull() | F.coalesce(F.col(f"s.{ts}") > F.col(f"t.{ts}"), F.lit(False))
    return j.select(F.when(take, F.col("s")).otherwise(F.col("t")).alias("r")).select("r.*")


def scd2_start(df: DataFrame, key: str, attrs: Sequence[str], since: str) -> DataFrame:
    """First load of a versioned dimension."""
    return df.select(
        key, *attrs, row_hash(attrs).alias("row_hash"), F.lit(since).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current")
    )


def scd2(dim: DataFrame, source: DataFrame, key: str, attrs: Sequence[str], as_of: str) -> DataFrame:
    """Close the current version of changed keys and add the new one; unchanged and old versions stay.

    One join of the current rows with the source; every joined row gives one or two rows.
    """
    day = F.lit(as_of).cast("date")
    src = source.select(F.col(key).alias("__k"), F.struct(*attrs).alias("__a"), row_hash(attrs).alias("__h"))
    old = dim.where("NOT is_current")
    j = dim.where("is_current").join(src, F.col(key) == F.col("__k"), "full")
    changed = F.col(key).isNotNull() & F.col("__k").isNotNull() & (F.col("row_hash") != F.col("__h"))
    fresh = F.col(key).isNull()
    fields = [key, *attrs, "row_hash", "valid_from", "valid_to", "is_current"]
    keep = F.struct(
        *[F.col(c) for c in [key, *attrs, "row_hash", "valid_from"]], F.when(changed, day).otherwise(F.col("valid_to")).alias("valid_to"), (~changed & F.col("is_current")).alias("is_current")
    )
    add = F.struct(
        F.col("__k").alias(key), *[F.col(f"__a.{a}").alias(a) for a in attrs], F.col("__h").alias("row_hash"), day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current")
    )
    rows = F.array(F.when(~fresh, keep), F.when(changed | fresh, add))
    out = j.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(*[f"r.{f}" for f in fields])
    return old.select(*fields).unionByName(out)


def scd3(dim: DataFrame, source: DataFrame, key: str, attr: str) -> DataFrame:
    """Keep the value before the change in ``previous_<attr>``."""
    s = source.select(F.col(key).alias("__k"), F.col(attr).alias("__v"))
    prev = f"previous_{attr}"
    base = dim if prev in dim.columns else dim.withColumn(prev, F.lit(None).cast(dim.schema[attr].dataType))
    j = base.join(s, F.col(key) == F.col("__k"), "left")
    moved = F.col("__k").isNotNull() & ~F.col(attr).eqNullSafe(F.col("__v"))
    return j.withColumn(prev, F.when(moved, F.col(attr)).otherwise(F.col(prev))).withColumn(attr, F.when(moved, F.col("__v")).otherwise(F.col(attr))).drop("__k", "__v")


def scd4(df: DataFrame, key: str, bands: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rapidly changing attributes as bands: the mini dimension, and the key table that points to it."""
    banded = df.select(key, *[c.alias(n) for n, c in bands.items()]).withColumn("mini_key", row_hash(list(bands)))
    return banded.select("mini_key", *bands).distinct(), banded.select(key, "mini_key")


def scd6(dim: DataFrame, source: DataFrame, key: str, attr: str, as_of: str) -> DataFrame:
    """Versions as in type 2, each with the current value and the value before it."""
    out = scd2(dim, source, key, [attr], as_of)
    versions = Window.partitionBy(key).orderBy("valid_from")
    current = out.groupBy(F.col(key).alias("__k")).agg(F.max_by(attr, "valid_from").alias(f"current_{attr}"))
    return out.withColumn(f"previous_{attr}", F.lag(attr).over(versions)).join(current, F.col(key) == F.col("__k")).drop("__k")


def vault_hub(hub: DataFrame, source: DataFrame, key: str, loaded: str, record_source: str) -> DataFrame:
    """Hub rows plus one row for every unseen business key."""
    new = source.select(key).where(F.col(key).isNotNull()).distinct().join(hub.select(key), key, "left_anti")
    rows = new.select(F.md5(F.col(key).cast("string")).alias("hub_key"), key, F.lit(loaded).cast("date").alias("loaded"), F.lit(record_source).alias("record_source"))
    return hub.unionByName(rows)


def vault_satellite(sat: DataFrame, source: DataFrame, key: str, attrs: Sequence[str], loaded: str) -> DataFrame:
    """New version where the hash differs from the open one, which is closed; unseen keys open a first version."""
    return scd2(sat, source, key, attrs, loaded)


def vault_link(link: DataFrame, source: DataFrame, keys: Sequence[str], loaded: str) -> DataFrame:
    """Link rows plus the unseen pairs."""
    new = source.select(*keys).dropna().distinct().join(link.select(*keys), list(keys), "left_anti")
    return link.unionByName(new.select(row_hash(keys).alias("link_key"), *keys, F.lit(loaded).cast("date").alias("loaded")))


def incremental(target: DataFrame, source: DataFrame, key: str, ts: str) -> DataFrame:
    """Upsert of the source rows newer than the target's newest row."""
    last = target.agg(F.coalesce(F.max(ts), F.lit("1900-01-01").cast(target.schema[ts].dataType)).alias("__last"))
    fresh = source.crossJoin(F.broadcast(last)).where(F.col(ts) > F.col("__last")).drop("__last")
    return upsert(target, newest(fresh.select(*target.columns), key, ts), key)


def medallion(raw: DataFrame, key: str, kind: str, allowed: Sequence[str], ts: str, user: str, value: str) -> DataFrame:
    """Bronze rows cleaned and deduplicated (silver), then reduced to user and day (gold)."""
    clean = raw.where(F.col(key).isNotNull() & F.col(kind).isin(list(allowed)))
    silver = clean.groupBy(key).agg(F.max_by(F.struct(user, kind, ts, value), ts).alias("r")).select(key, "r.*")
    return silver.groupBy(user, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(F.when(F.col(kind) == "purchase", F.col(value))), F.lit(0.0)).alias("revenue"), F.max(ts).alias("last_activity")
    )


def apply_changes(target: DataFrame, changes: DataFrame, key: str, op: str, order: Sequence[str]) -> DataFrame:
    """Change records (c, u, d, r) applied in order: only the last one per key matters."""
    cols = target.columns
    last = changes.groupBy(key).agg(F.max_by(F.struct(op, *[c for c in cols if c != key]), F.struct(*order)).alias("__c"))
    kept = target.join(last.select(key), key, "left_anti")
    live = last.where(F.col(f"__c.{op}") != "d").select(*[F.col(key) if c == key else F.col(f"__c.{c}").alias(c) for c in cols])
    return kept.unionByName(live)


def dead_letters(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and failed rows with the first broken rule and a retry count."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    tagged = df.withColumn("error_type", error)
    retries = F.col("retry_count") + 1 if "retry_count" in df.columns else F.lit(0)
    return tagged.where("error_type IS NULL").drop("error_type"), tagged.where("error_type IS NOT NULL").withColumn("retry_count", retries)


def backfill(df: DataFrame, path: str, day: str, days: Sequence[str]) -> None:
    """Rewrite the given dates, each exactly once per run: dynamic overwrite replaces only the partitions present."""
    rows = df.where(F.col(day).cast("string").isin(list(days)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def date_dimension(df: DataFrame, ts: str) -> DataFrame:
    """Calendar from the first to the last day of the table."""
    ends = df.agg(F.to_date(F.min(ts)).alias("a"), F.to_date(F.max(ts)).alias("b"))
    d = F.col("day")
    days = ends.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "day", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("week"), F.dayofmonth(d).alias("day_of_month"), F.dayofweek(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.dayofweek(d).isin(1, 7).alias("is_weekend"),
    )
