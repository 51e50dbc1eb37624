"""Extension points: checks, attribution models, chunkers and SQL functions supplied by the user."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class CheckSet:
    """Named row rules. All rules run in one aggregate over the table."""

    rules: dict[str, tuple[str, float, Callable[[], Column]]] = field(default_factory=dict)

    def add(self, name: str, severity: str, threshold: float):
        """Register a function that returns the condition a good row meets."""

        def wrap(fn: Callable[[], Column]):
            self.rules[name] = (severity, threshold, fn)
            return fn

        return wrap

    def run(self, df: DataFrame) -> DataFrame:
        """One row per rule: failing rows, their share, and whether the share stays within the threshold."""
        aggs = [
            F.sum(F.when(F.coalesce(fn(), F.lit(False)), 0).otherwise(1)).alias(name) for name, (_, _, fn) in self.rules.items()
        ]
        wide = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
        rows = F.array(
            *[
                F.struct(
                    F.lit(name).alias("check"),
                    F.lit(severity).alias("severity"),
                    F.lit(float(limit)).alias("threshold"),
                    F.coalesce(F.col(name), F.lit(0)).alias("failed"),
                )
                for name, (severity, limit, _) in self.rules.items()
            ]
        )
        out = wide.select("__rows", F.inline(rows))
        share = F.when(F.col("__rows") > 0, F.col("failed") / F.col("__rows")).otherwise(0.0)
        return out.withColumn("share", share).withColumn("passed", F.col("share") <= F.col("threshold")).drop("__rows")


def nested_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with their lines as an array of structs; an order has few lines."""
    packed = lines.groupBy("l_orderkey").agg(
        F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("lines")
    )
    return orders.join(packed, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")


def register_macros(spark: SparkSession) -> None:
    """SQL functions with an expression body: inlined by the optimizer, no Python at run time."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION macro_safe_divide(n DOUBLE, d DOUBLE, other DOUBLE) RETURNS DOUBLE "
        "RETURN CASE WHEN d = 0 OR d IS NULL THEN other ELSE n / d END"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION macro_cents(x DOUBLE) RETURNS DOUBLE RETURN x / 100.0")
