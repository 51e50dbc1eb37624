"""Order-dependent results without holding a whole group in one task.

A plain window puts every row of a key into one task. The functions here split a
key into ordered blocks, reduce each block to one row, run the window over those
few rows, and finish inside the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import magnitude_block


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; right keys are dropped."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    tagged = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(tagged, cond, how).drop(*[f"__r_{k}" for k in keys])


def block_prefix(df: DataFrame, keys: Sequence[str], block: str, sums: dict[str, Column]) -> DataFrame:
    """One row per key and block with the sum of each measure over all earlier blocks."""
    totals = df.groupBy(*keys, block).agg(*[agg.alias(name) for name, agg in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, block, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in sums]
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Column, block: Column, out: str
) -> DataFrame:
    """Running total by key; ``block`` must not fall while ``order`` rises."""
    base = df.withColumn("__block", block).withColumn("__v", value if isinstance(value, Column) else F.col(value))
    before = block_prefix(base, keys, "__block", {"__s": F.sum("__v")})
    inner = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = null_safe_join(base, before, [*keys, "__block"])
    return joined.withColumn(out, F.col("__s_before") + F.sum("__v").over(inner)).drop("__block", "__v", "__s_before")


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: dict[str, str],
    block: Column,
    *,
    forward: bool = False,
) -> DataFrame:
    """Previous (or next) row's values by key, carried over block borders.

    ``cols`` maps an output name to the source column.
    """
    picked = F.struct(*[F.col(src).alias(name) for name, src in cols.items()])
    base = df.withColumn("__block", block)
    order_key = F.struct(*order)
    edge = F.min_by(picked, order_key) if forward else F.max_by(picked, order_key)
    step = F.lead if forward else F.lag
    edges = (
        base.groupBy(*keys, "__block")
        .agg(edge.alias("__edge"))
        .select(
            *keys,
            "__block",
            step("__edge").over(Window.partitionBy(*keys).orderBy("__block")).alias("__carry"),
        )
    )
    inner = Window.partitionBy(*keys, "__block").orderBy(*order)
    joined = null_safe_join(base, edges, [*keys, "__block"])
    joined = joined.withColumn("__near", F.coalesce(step(picked).over(inner), F.col("__carry")))
    return joined.select(*df.columns, *[F.col(f"__near.{name}").alias(name) for name in cols])


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    *,
    descending: bool = True,
    tie: str | None = None,
    row_number: str | None = None,
    rank: str | None = None,
    dense_rank: str | None = None,
    total: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """Row number, rank, dense rank and group size by key over a numeric order.

    Distinct values are counted first, ranked block by block and joined back, so
    neither a hot key nor a hot value is sorted in one task. The row number breaks
    ties by the numeric column ``tie``, again block by block.
    """
    signed = -F.col(value) if descending else F.col(value)
    base = df.withColumn("__v", signed)
    counts = base.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__b", magnitude_block("__v", digits))
    blocks = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__bn"), F.count(F.lit(1)).alias("__bd"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys,
        "__b",
        F.coalesce(F.sum("__bn").over(earlier), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__bd").over(earlier), F.lit(0)).alias("__d0"),
        F.sum("__bn").over(Window.partitionBy(*keys)).alias("__total"),
    )
    inner = Window.partitionBy(*keys, "__b").orderBy("__v")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    values = null_safe_join(counts, blocks, [*keys, "__b"]).select(
        *keys,
        "__v",
        (F.col("__n0") + F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__start"),
        (F.col("__d0") + F.row_number().over(inner)).alias("__dense"),
        "__total",
    )
    out = null_safe_join(base, values, [*keys, "__v"])
    extra = []
    if row_number:
        if tie is None:
            raise ValueError("a row number needs a tie column")
        out = out.withColumn("__tb", magnitude_block(tie, digits))
        ahead = block_prefix(out, [*keys, "__v"], "__tb", {"__t": F.count(F.lit(1))})
        out = null_safe_join(out, ahead, [*keys, "__v", "__tb"])
        pos = F.row_number().over(Window.partitionBy(*keys, "__v", "__tb").orderBy(tie))
        extra.append((F.col("__start") + F.col("__t_before") + pos).cast("long").alias(row_number))
    if rank:
        extra.append((F.col("__start") + 1).cast("long").alias(rank))
    if dense_rank:
        extra.append(F.col("__dense").cast("long").alias(dense_rank))
    if total:
        extra.append(F.col("__total").cast("long").alias(total))
    return out.select(*df.columns, *extra)
