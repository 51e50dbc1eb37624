"""Projections, filters, joins and row-set edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import prefixed

from millrace.operators.ordered import null_safe_join

#: Rows up to which a lookup side is hinted as broadcast after its size was counted.
LOOKUP_ROWS = 200_000


def lookup_side(df: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """Hint a broadcast only when the side is seen to be small; otherwise leave the plan to AQE."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def contains_filter(df: DataFrame, path: str, needle: str) -> DataFrame:
    """Rows whose field, as lower-case text, equals or contains the value; null drops."""
    return df.where(F.lower(F.col(path).cast("string")).contains(needle.lower()))


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Listed top-level fields in order, null for those that do not exist."""
    known = set(df.columns)
    return df.select(*[F.col(f) if f in known else F.lit(None).cast("string").alias(f) for f in fields])


def allowed_rows(df: DataFrame, key: str, column: str, allowed: Sequence[str]) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(column).isin(list(allowed)))


def clean_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """TRIM + LOWER the columns and drop rows where one of them is null."""
    out = df
    for c in columns:
        out = out.withColumn(c, F.trim(F.lower(F.col(c)))).where(F.col(c).isNotNull())
    return out


def surrogate_key(columns: Sequence[str]) -> Column:
    """MD5 of the key columns in their prefixed form, so different keys have different texts."""
    return F.md5(prefixed(columns))


def children_per_parent(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, out: str = "n"
) -> DataFrame:
    """All parents with the count of their children, zero kept.

    The children are counted before the join, so a parent with a third of all
    children is one row when it reaches the join.
    """
    counts = children.groupBy(F.col(child_key).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    joined = parents.join(counts, F.col(parent_key) == F.col("__p"), "left")
    return joined.withColumn(out, F.coalesce("__n", F.lit(0))).drop("__p", "__n")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent key is null or not found, with the reason."""
    known = parents.select(F.col(parent_key).alias("__p")).distinct()
    lost = children.join(known, F.col(child_key) == F.col("__p"), "left_anti")
    return lost.withColumn("reason", F.when(F.col(child_key).isNull(), "no parent").otherwise("unknown parent"))


def coverage_gaps(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, many: int = 4) -> DataFrame:
    """Parents without children and parents with ``many`` or more."""
    counted = children_per_parent(parents, children, parent_key, child_key, "supporting")
    kind = F.when(F.col("supporting") == 0, "gap").when(F.col("supporting") >= many, "over_indexed")
    return counted.withColumn("kind", kind).where("kind IS NOT NULL")


def top_per_outer(
    outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, order: Sequence[Column], n: int
) -> DataFrame:
    """The n best inner rows of each outer row.

    ``row_number <= n`` makes Spark keep only n rows per key and task before the
    shuffle (WindowGroupLimit), so a hot key does not arrive whole in one task.
    """
    best = top_n(inner, [inner_key], order, n)
    return outer.join(best, F.col(outer_key) == F.col(inner_key))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    from pyspark.sql import Window

    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= n)


def conflict_pairs(items: DataFrame, item: str, conflicts: str, label: str) -> DataFrame:
    """Explode conflict ids, keep those that exist, and count A-B and B-A once."""
    raw = items.select(F.col(item).alias("x"), F.explode(conflicts).alias("y")).where("x <> y")
    pairs = raw.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).distinct()
    names = items.select(F.col(item).alias("__i"), F.col(label).alias("__l"))
    first = pairs.join(names, F.col("item_a") == F.col("__i")).withColumnRenamed("__l", "label_a").drop("__i")
    return first.join(names, F.col("item_b") == F.col("__i")).withColumnRenamed("__l", "label_b").drop("__i")


def point_in_time(
    facts: DataFrame, versions: DataFrame, key: tuple[str, str], at: str, start: str, end: str
) -> DataFrame:
    """The dimension version valid at the fact's time: equi key first, interval as residual."""
    return facts.join(
        versions,
        (F.col(key[0]) == F.col(key[1]))
        & (F.col(at) >= F.col(start))
        & (F.col(end).isNull() | (F.col(at) < F.col(end))),
        "left",
    )


def band_lookup(people: DataFrame, bands: DataFrame, levels: Sequence[Sequence[str]], pick: Sequence[str]) -> DataFrame:
    """First band that fits, from the most to the least specific key list.

    ``bands`` is a small reference table; on each level its first row by ``band_id`` is used.
    """
    out = people
    names = []
    for i, keys in enumerate(levels):
        first = bands.groupBy(*keys).agg(F.min_by(F.struct(*pick), "band_id").alias(f"__band{i}"))
        out = null_safe_join(out, first, list(keys), "left")
        names.append(f"__band{i}")
    best = F.coalesce(*names)
    return out.select(
        *people.columns,
        *[best[p].alias(p) for p in pick],
        F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names)]).alias("match_level"),
    )


def update_from_values(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of ``target`` with ``column`` replaced where ``source`` lists the key."""
    fresh = source.select(F.col(key).alias("__k"), F.col(column).alias("__v"))
    joined = target.join(fresh, F.col(key) == F.col("__k"), "left")
    return joined.withColumn(column, F.coalesce("__v", column)).drop("__k", "__v")


def delete_where_in(target: DataFrame, keys: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of ``target`` whose key is not listed (null keys stay, as in DELETE ... IN)."""
    listed = keys.select(F.col(other).alias("__k")).distinct()
    return target.join(listed, F.col(key) == F.col("__k"), "left_anti")


def insert_if_absent(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Target rows plus those source rows whose key is new (one row per new key)."""
    fresh = source.join(target.select(key), key, "left_anti").dropDuplicates([key])
    return target.unionByName(fresh.select(*target.columns))


def keyset_after(df: DataFrame, order: Sequence[tuple[str, object]], limit: int, *, descending=False) -> DataFrame:
    """The page after the last seen tuple of sort values."""
    test, equal = None, F.lit(True)
    for name, last in order:
        step = F.col(name) < F.lit(last) if descending else F.col(name) > F.lit(last)
        branch = equal & step
        test = branch if test is None else test | branch
        equal = equal & (F.col(name) == F.lit(last))
    sort = [F.col(n).desc() if descending else F.col(n).asc() for n, _ in order]
    return df.where(test).orderBy(*sort).limit(limit)


def sort_mixed(df: DataFrame, column: str, *, reverse: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Null first, then other text by lower case, then numbers (also numeric text) by value; equal ones by ``ties``."""
    number = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    text = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    keys = [number, text]
    flip = [k.desc_nulls_last() if reverse else k.asc_nulls_first() for k in keys]
    return df.orderBy(*flip, *ties)


def severity_rank(column: str, names: Sequence[str]) -> Column:
    """Position in a named order, unknown names last."""
    pairs = [F.lit(x) for i, n in enumerate(names) for x in (n, i)]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(len(names)))
