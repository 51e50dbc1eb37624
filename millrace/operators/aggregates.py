"""Grouped summaries. Everything reduces map-side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.operators.narrowing import exact_quantiles

#: Days-open buckets of the aging report.
AGING_STEPS = [(30, "0-30 days"), (60, "31-60 days"), (90, "61-90 days"), (120, "91-120 days")]
#: Accuracy rating by mean absolute percentage error.
ACCURACY_STEPS = [(10, "Excellent"), (15, "Good"), (25, "Fair")]
#: Coefficient-of-variation levels.
VOLATILITY_STEPS = [(0.15, "low"), (0.25, "moderate"), (0.40, "high")]
#: Relative slope bounds of the trend label.
TREND_STEPS = [(0.15, "strong_improvement"), (0.08, "improvement"), (-0.05, "stable"), (-0.08, "decline")]


def group_count(df: DataFrame, key: str) -> DataFrame:
    """Rows by key, a null key shown as ``(null)``, biggest first."""
    shown = F.coalesce(F.col(key).cast("string"), F.lit("(null)")).alias(key)
    return df.groupBy(shown).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), key)


def numeric_stats(df: DataFrame, column: str) -> DataFrame:
    """Count, min, max, sum and mean of the values that read as numbers."""
    v = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    return df.select(v.alias("v")).agg(
        F.count("v").alias("count"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.sum("v").alias("sum"),
        F.avg("v").alias("avg"),
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column in one pass; ties by value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("column", "value").count()
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ratio_of_totals(df: DataFrame, keys: Sequence[str], ratios: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Ratios of sums (not means of ratios), 0 on a zero base."""
    aggs = []
    for name, (top, base) in ratios.items():
        aggs += [F.sum(top).alias(f"__{name}_t"), F.sum(base).alias(f"__{name}_b")]
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[N.safe_divide(f"__{n}_t", f"__{n}_b").alias(n) for n in ratios])


def forecast_errors(df: DataFrame, keys: Sequence[str], forecast: str, actual: str) -> DataFrame:
    """MAPE, value-weighted MAPE and bias of forecasts by key."""
    f, a = F.col(forecast), F.col(actual)
    err = F.abs(a - f)
    rated = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"),
        F.coalesce(F.avg(F.when(a != 0, err / F.abs(a))) * 100, F.lit(0.0)).alias("mape"),
        N.safe_divide(F.sum(F.when(a != 0, err)), F.sum(F.abs(a))).alias("w"),
        F.count_if(f > a).alias("over_count"),
        F.count_if(f < a).alias("under_count"),
        F.count_if(f == a).alias("exact_count"),
        F.sum(f - a).alias("total_bias"),
        F.sum(a).alias("total_actual"),
    )
    over, under = F.col("over_count"), F.col("under_count")
    return rated.select(
        *keys,
        "periods",
        "mape",
        (F.col("w") * 100).alias("weighted_mape"),
        "over_count",
        "under_count",
        "exact_count",
        (F.col("total_bias") / F.col("periods")).alias("avg_bias"),
        (N.safe_divide("total_bias", "total_actual") * 100).alias("bias_pct"),
        N.safe_divide(over, over + under).alias("bias_ratio"),
        F.when(over > under, "Over-forecasting").when(under > over, "Under-forecasting").otherwise("Balanced").alias("direction"),
    )


def category_accuracy(df: DataFrame, category: str, forecast: str, actual: str) -> DataFrame:
    """One row per category row: error, bias, rating; worst first."""
    f, a = F.col(forecast), F.col(actual)
    err = F.when(a != 0, F.abs(a - f) / F.abs(a) * 100).otherwise(0.0)
    return (
        df.withColumn("error_pct", err)
        .withColumn("bias", F.when(f > a, "Over").when(f < a, "Under").otherwise("Exact"))
        .withColumn("variance", f - a)
        .withColumn("rating", N.threshold_label("error_pct", ACCURACY_STEPS, "Poor", descending=False))
        .orderBy(F.desc("error_pct"), category)
    )


def aging_buckets(df: DataFrame, days: Column, keys: Sequence[str] = ()) -> DataFrame:
    bucket = N.upto_label(days, AGING_STEPS, ">120 days").alias("bucket")
    return df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("items"))


def status_rollup(df: DataFrame, dims: Sequence[str], is_open: Column, overdue: Column, days: Column) -> DataFrame:
    """Counts, overdue and mean cycle of closed items, for the whole and by each dimension in one pass."""
    prepared = df.select(*dims, is_open.alias("__o"), overdue.alias("__d"), days.alias("__c"))
    sets = [[], *[[d] for d in dims]]
    out = prepared.groupingSets(sets, *dims).agg(
        F.grouping_id().cast("long").alias("__g"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("__o").alias("open"),
        F.count_if(F.col("__o") & F.col("__d")).alias("overdue"),
        F.coalesce(F.avg(F.when(~F.col("__o"), F.col("__c"))), F.lit(0.0)).alias("avg_cycle"),
    )
    # grouping_id has a 0 bit for the kept dimension, the first dimension being the highest bit
    full = 2 ** len(dims) - 1
    label, value = F.lit("all"), F.lit("all")
    for i, d in enumerate(dims):
        here = F.col("__g") == full - 2 ** (len(dims) - 1 - i)
        label = F.when(here, F.lit(d)).otherwise(label)
        value = F.when(here, F.col(d).cast("string")).otherwise(value)
    return out.select(label.alias("dimension"), value.alias("value"), "total", "open", "overdue", "avg_cycle")


def matrix_count(df: DataFrame, row: Column, col: Column, size: int = 5) -> DataFrame:
    """size x size grid with empty cells kept."""
    grid = df.sparkSession.range(1, size + 1).select(F.col("id").alias("probability"))
    grid = grid.crossJoin(df.sparkSession.range(1, size + 1).select(F.col("id").alias("impact")))
    counts = df.groupBy(row.cast("long").alias("__r"), col.cast("long").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    joined = grid.join(counts, (F.col("probability") == F.col("__r")) & (F.col("impact") == F.col("__c")), "left")
    return joined.select("probability", "impact", F.coalesce("__n", F.lit(0)).alias("items"))


def linear_trend(periods: DataFrame, keys: Sequence[str], order: str, value: str, last: int | None = None) -> DataFrame:
    """Least squares over the period index by key: slope, intercept, correlation, R2, label.

    ``periods`` must already be one row per period.
    """
    w = Window.partitionBy(*keys)
    base = periods.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1)
    if last:
        base = base.withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__i") >= F.col("__n") - last)
    y, x = F.col(value).cast("double"), F.col("__i").cast("double")
    out = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.when(F.stddev_pop(y) > 0, F.corr(y, x)).otherwise(0.0).alias("correlation"),
        F.regr_r2(y, x).alias("r2"),
        F.avg(y).alias("mean"),
    )
    out = out.withColumn("relative_slope", F.col("slope") / F.greatest("mean", F.lit(1.0)))
    label = None
    for bound, name in TREND_STEPS:
        test = F.col("relative_slope") > bound
        label = F.when(test, name) if label is None else label.when(test, name)
    return out.withColumn(
        "trend", F.when(F.col("points") < 3, "insufficient_data").otherwise(label.otherwise("strong_decline"))
    )


def volatility(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sample coefficient of variation, range ratio and level by key."""
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    cv = N.safe_divide("std", "mean")
    return (
        out.withColumn("cv", cv)
        .withColumn("range_ratio", F.when(F.col("mean") > 0, (F.col("high") - F.col("low")) / F.col("mean")).otherwise(0.0))
        .withColumn(
            "level",
            F.when(F.col("n") < 2, "insufficient_data")
            .when(F.col("mean") == 0, "no_velocity")
            .otherwise(N.upto_label("cv", VOLATILITY_STEPS, "very_high")),
        )
    )


def percentiles_linear(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def quartiles_by_index(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Q1 and Q3 as the sorted elements at n//4 and 3n//4."""
    return exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75}, method="index")


def daily_metrics(df: DataFrame, user: str, ts: str, kind: str, value: str, session: Column, purchase: str) -> DataFrame:
    """Events, distinct sessions, revenue and last activity by user and day."""
    return df.groupBy(F.col(user), F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct(session).alias("sessions"),
        F.coalesce(F.sum(F.when(F.col(kind) == purchase, F.col(value))), F.lit(0.0)).alias("revenue"),
        F.max(ts).alias("last_activity"),
    )


def monthly(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Rows and total by calendar month: the reduction that comes before any whole-table order."""
    return df.groupBy(F.trunc(F.to_date(ts), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    )


def json_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], out: str = "items") -> DataFrame:
    """JSON array of each key's rows in a fixed order. The answer is one cell per key, so keys must be fine-grained."""
    packed = F.struct(*[F.col(c) for c in [*order, *[f for f in fields if f not in order]]])
    sorted_rows = F.array_sort(F.collect_list(packed))
    shaped = F.transform(sorted_rows, lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return df.groupBy(*keys).agg(F.to_json(shaped).alias(out))
