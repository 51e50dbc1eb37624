"""Set operations over rows and terms, series and hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_terms(terms: DataFrame, term: str, side: str, ours: object) -> DataFrame:
    """Terms that other sides use and ``ours`` does not."""
    mine = F.max(F.when(F.col(side) == F.lit(ours), 1).otherwise(0))
    out = terms.groupBy(term).agg(mine.alias("__mine"), F.countDistinct(side).alias("used_by"))
    return out.where("__mine = 0").drop("__mine")


def shared_terms(terms: DataFrame, term: str, side: str, sides: int) -> DataFrame:
    """Terms used by two sides or more; ``gap`` marks those not used by all ``sides``."""
    out = terms.groupBy(term).agg(F.countDistinct(side).alias("used_by")).where("used_by >= 2")
    return out.withColumn("gap", F.col("used_by") < sides)


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Total, distinct and repeated rows; the distinct step is an aggregate over all columns."""
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))
    )


def dedupe_min_id(df: DataFrame, same: Sequence[str], key: str) -> DataFrame:
    """Earliest id of every set of equal rows, as an aggregate."""
    return df.groupBy(*same).agg(F.min(key).alias(key))


def day_spine(df: DataFrame, ts: str) -> DataFrame:
    """Every day from the first to the last, made on the executors from one row."""
    ends = df.agg(F.to_date(F.min(ts)).alias("a"), F.to_date(F.max(ts)).alias("b"))
    return ends.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))


def fill_gaps(df: DataFrame, ts: str, value: Column) -> DataFrame:
    daily = df.groupBy(F.to_date(ts).alias("__d")).agg(value.alias("total"), F.count(F.lit(1)).alias("n"))
    out = day_spine(df, ts).join(daily, F.col("day") == F.col("__d"), "left")
    return out.select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def hierarchy(df: DataFrame, key: str, parent: str, label: str) -> DataFrame:
    """Depth and path of every node below the roots, by a recursive query; a node that returns to itself ends there."""
    spark = df.sparkSession
    # the default caps on recursion rows and levels would stop a large tree with an error
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    df.select(F.col(key).alias("id"), F.col(parent).alias("parent_id"), F.col(label).alias("label")).createOrReplaceTempView(
        "hierarchy_nodes"
    )
    return spark.sql(
        """
        WITH RECURSIVE tree(id, depth, path, seen) AS (
          SELECT id, 0, CAST(label AS STRING), array(id) FROM hierarchy_nodes WHERE parent_id IS NULL
          UNION ALL
          SELECT n.id, t.depth + 1, concat(t.path, ' > ', n.label), array_append(t.seen, n.id)
          FROM hierarchy_nodes n JOIN tree t ON n.parent_id = t.id WHERE NOT array_contains(t.seen, n.id))
        SELECT id, depth, path FROM tree
        """
    )
