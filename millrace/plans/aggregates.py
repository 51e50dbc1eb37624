"""Aggregations on the test tables."""

from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.plans.registry import query


@query(
    "group_count",
    "SELECT coalesce(event_type, '(null)') AS event_type, count(*) AS count FROM (SELECT CASE WHEN event_type <> 'error' "
    "THEN event_type END AS event_type FROM events) GROUP BY 1",
)
def group_count(t):
    return A.group_count(t.events.select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type")), "event_type")


@query(
    "numeric_stats",
    "SELECT count(v) AS count, min(v) AS min, max(v) AS max, sum(v) AS sum, avg(v) AS avg FROM "
    "(SELECT try_cast(o_totalprice::VARCHAR AS DOUBLE) AS v FROM orders)",
    digits="sum:1 avg",
)
def numeric_stats(t):
    return A.numeric_stats(t.orders.select(F.col("o_totalprice").cast("string").alias("v")), "v")


@query("having", "SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS a FROM orders GROUP BY 1 HAVING count(*) > 10", digits="a")
def having(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("a")).where("n > 10")


def _rev():
    return F.sum("o_totalprice").alias("revenue")


@query(
    "grouping_sets",
    "SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS revenue FROM orders "
    "GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())",
    digits="revenue:1",
)
def grouping_sets(t):
    s, p = "o_orderstatus", "o_orderpriority"
    return t.orders.groupingSets([[s, p], [s], [p], []], s, p).agg(_rev())


@query(
    "rollup",
    "SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS revenue FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    digits="revenue:1",
)
def rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(_rev())


@query(
    "cube",
    "SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS revenue FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    digits="revenue:1",
)
def cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(_rev())


@query(
    "filtered_agg",
    "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, "
    "count(*) FILTER (WHERE o_orderstatus = 'O') AS open, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS done_amount "
    "FROM orders GROUP BY 1",
    digits="done_amount:1",
)
def filtered_agg(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "F").alias("done"),
        F.count_if(s == "O").alias("open"),
        F.sum(F.when(s == "F", F.col("o_totalprice"))).alias("done_amount"),
    )


@query(
    "count_distinct",
    "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT props) AS sessions FROM events GROUP BY ALL",
)
def count_distinct(t):
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.countDistinct("props").alias("sessions"))


@query("approx_distinct", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users, true AS estimate_within_6_pct, count(*) AS events FROM events GROUP BY 1")
def approx_distinct(t):
    """HyperLogLog++ estimate by day next to the exact count, with whether it lies within three standard errors."""
    out = t.events.groupBy(F.to_date("ts").alias("day")).agg(
        F.approx_count_distinct("user_id", 0.02).alias("guess"), F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("events")
    )
    return out.select("day", "users", (F.abs(F.col("guess") - F.col("users")) <= 0.06 * F.col("users")).alias("estimate_within_6_pct"), "events")


DAILY = """
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events,
      count(DISTINCT json_extract_string(props, '$.k')) AS sessions,
      coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) AS revenue, max(ts) AS last_activity
    FROM events GROUP BY ALL
"""


@query("daily_user_metrics", DAILY, digits="revenue")
def daily_user_metrics(t):
    session = F.get_json_object("props", "$.k")
    return A.daily_metrics(t.events, "user_id", "ts", "event_type", "value", session, "purchase")


@query(
    "pivot_months",
    "SELECT o_orderstatus, " + ", ".join(f"sum(CASE WHEN month(o_orderdate) = {m} THEN o_totalprice END) AS m{m}" for m in range(1, 13))
    + " FROM orders GROUP BY 1",
    digits=" ".join(f"m{m}:1" for m in range(1, 13)),
)
def pivot_months(t):
    named = t.orders.withColumn("m", F.concat(F.lit("m"), F.month("o_orderdate")))
    return named.groupBy("o_orderstatus").pivot("m", [f"m{m}" for m in range(1, 13)]).agg(F.sum("o_totalprice"))


@query(
    "json_array_agg",
    """
    SELECT o_orderkey, '[' || string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || ',"supp":' || l_suppkey || '}', ','
      ORDER BY l_linenumber, l_partkey, l_suppkey) || ']' AS items
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def json_array_agg(t):
    lines = t.lineitem.select(
        "l_orderkey",
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
    )
    packed = A.json_rows(lines, ["l_orderkey"], ["line", "part", "supp"], ["line", "part", "supp"])
    return t.orders.select("o_orderkey").join(packed, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "items")


@query(
    "top_values",
    """
    WITH v AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL
      SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders),
    c AS (SELECT "column", value, count(*) AS count FROM v WHERE value IS NOT NULL GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value)::INT AS rank FROM c) WHERE rank <= 5
    """,
)
def top_values(t):
    return A.top_values(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    "weighted_portfolio",
    "SELECT l_returnflag, sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS discount_rate, "
    "sum(l_extendedprice * l_tax) / sum(l_extendedprice) AS tax_rate, sum(l_extendedprice) / sum(l_quantity) AS unit_price "
    "FROM lineitem GROUP BY 1",
    digits="discount_rate:6 tax_rate:6 unit_price",
)
def weighted_portfolio(t):
    price = F.col("l_extendedprice")
    return A.ratio_of_totals(
        t.lineitem,
        ["l_returnflag"],
        {
            "discount_rate": (price * F.col("l_discount"), price),
            "tax_rate": (price * F.col("l_tax"), price),
            "unit_price": (price, F.col("l_quantity")),
        },
    )


@query(
    "percentile_linear",
    "SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, "
    "quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1",
    digits="p50 p95 p99",
)
def percentile_linear(t):
    return A.percentiles_linear(t.events, ["event_type"], "value")


@query(
    "quartile_index",
    """
    WITH s AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderstatus, max(n) AS n, max(CASE WHEN i = n // 4 THEN o_totalprice END) AS q1,
      max(CASE WHEN i = 3 * n // 4 THEN o_totalprice END) AS q3 FROM s GROUP BY 1
    """,
)
def quartile_index(t):
    return A.quartiles_by_index(t.orders, ["o_orderstatus"], "o_totalprice")


def forecast(t):
    """Monthly actuals by priority with the month before as forecast."""
    from pyspark.sql import Window

    m = t.orders.groupBy("o_orderpriority", F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(
        F.sum("o_totalprice").alias("actual")
    )
    w = Window.partitionBy("o_orderpriority").orderBy("month")
    return m.withColumn("forecast", F.lag("actual").over(w)).where("forecast IS NOT NULL")


FORECAST = """
    m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS actual FROM orders GROUP BY ALL),
    f AS (SELECT * FROM (SELECT *, lag(actual) OVER (PARTITION BY o_orderpriority ORDER BY month) AS forecast FROM m) WHERE forecast IS NOT NULL)
"""


@query(
    "mape",
    f"WITH {FORECAST} SELECT o_orderpriority, avg(abs(actual - forecast) / abs(actual)) FILTER (WHERE actual <> 0) * 100 AS mape FROM f GROUP BY 1",
    digits="mape",
)
def mape(t):
    return A.forecast_errors(forecast(t), ["o_orderpriority"], "forecast", "actual").select("o_orderpriority", "mape")


@query(
    "weighted_mape",
    f"WITH {FORECAST} SELECT o_orderpriority, sum(abs(actual - forecast)) FILTER (WHERE actual <> 0) / sum(abs(actual)) * 100 AS weighted_mape FROM f GROUP BY 1",
    digits="weighted_mape",
)
def weighted_mape(t):
    return A.forecast_errors(forecast(t), ["o_orderpriority"], "forecast", "actual").select("o_orderpriority", "weighted_mape")


@query(
    "forecast_bias",
    f"""WITH {FORECAST}, b AS (SELECT o_orderpriority, count(*) FILTER (WHERE forecast > actual) AS over_count,
      count(*) FILTER (WHERE forecast < actual) AS under_count, count(*) FILTER (WHERE forecast = actual) AS exact_count,
      sum(forecast - actual) / count(*) AS avg_bias, sum(forecast - actual) / sum(actual) * 100 AS bias_pct FROM f GROUP BY 1)
    SELECT *, over_count / (over_count + under_count) AS bias_ratio, CASE WHEN over_count > under_count THEN 'Over-forecasting'
      WHEN under_count > over_count THEN 'Under-forecasting' ELSE 'Balanced' END AS direction FROM b""",
    digits="avg_bias:2 bias_pct bias_ratio",
)
def forecast_bias(t):
    return A.forecast_errors(forecast(t), ["o_orderpriority"], "forecast", "actual").select(
        "o_orderpriority", "over_count", "under_count", "exact_count", "avg_bias", "bias_pct", "bias_ratio", "direction"
    )


@query(
    "category_accuracy",
    f"""WITH {FORECAST}, c AS (SELECT o_orderpriority, sum(actual) AS actual, sum(forecast) AS forecast FROM f GROUP BY 1),
    e AS (SELECT *, CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) * 100 ELSE 0 END AS error_pct FROM c)
    SELECT o_orderpriority, error_pct, CASE WHEN forecast > actual THEN 'Over' WHEN forecast < actual THEN 'Under' ELSE 'Exact' END AS bias,
      forecast - actual AS variance, CASE WHEN error_pct < 10 THEN 'Excellent' WHEN error_pct < 15 THEN 'Good' WHEN error_pct < 25 THEN 'Fair' ELSE 'Poor' END AS rating FROM e""",
    digits="error_pct variance:2",
)
def category_accuracy(t):
    c = forecast(t).groupBy("o_orderpriority").agg(F.sum("actual").alias("actual"), F.sum("forecast").alias("forecast"))
    return A.category_accuracy(c, "o_orderpriority", "forecast", "actual").select(
        "o_orderpriority", "error_pct", "bias", "variance", "rating"
    )


AS_OF = "2001-09-01"


@query(
    "aging_buckets",
    f"""
    WITH d AS (SELECT o_orderpriority, date_diff('day', o_orderdate, DATE '{AS_OF}') AS days FROM orders WHERE o_orderstatus = 'O')
    SELECT o_orderpriority, CASE WHEN days <= 30 THEN '0-30 days' WHEN days <= 60 THEN '31-60 days' WHEN days <= 90 THEN '61-90 days'
      WHEN days <= 120 THEN '91-120 days' ELSE '>120 days' END AS bucket, count(*) AS items FROM d GROUP BY ALL
    """,
)
def aging_buckets(t):
    days = F.datediff(F.lit(AS_OF).cast("date"), F.to_date("o_orderdate"))
    return A.aging_buckets(t.orders.where("o_orderstatus = 'O'"), days, ["o_orderpriority"])


@query(
    "status_rollup",
    f"""
    WITH d AS (SELECT o_orderstatus, o_orderpriority, o_orderstatus <> 'F' AS is_open, o_orderdate < TIMESTAMP '2001-01-01' AS late,
      date_diff('day', o_orderdate, DATE '{AS_OF}') AS days FROM orders),
    g AS (SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS g, count(*) AS total,
      count(*) FILTER (WHERE is_open) AS open, count(*) FILTER (WHERE is_open AND late) AS overdue,
      coalesce(avg(days) FILTER (WHERE NOT is_open), 0) AS avg_cycle FROM d GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority)))
    SELECT CASE g WHEN 1 THEN 'o_orderstatus' WHEN 2 THEN 'o_orderpriority' ELSE 'all' END AS dimension,
      CASE g WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderpriority ELSE 'all' END AS value, total, open, overdue, avg_cycle FROM g
    """,
    digits="avg_cycle",
)
def status_rollup(t):
    late = F.to_date("o_orderdate") < F.lit("2001-01-01").cast("date")
    days = F.datediff(F.lit(AS_OF).cast("date"), F.to_date("o_orderdate"))
    return A.status_rollup(t.orders, ["o_orderstatus", "o_orderpriority"], F.col("o_orderstatus") != "F", late, days)


@query(
    "matrix_count",
    """
    WITH g AS (SELECT p.i AS probability, q.i AS impact FROM range(1, 6) p(i), range(1, 6) q(i)),
    r AS (SELECT o_custkey % 5 + 1 AS p, CASE WHEN o_totalprice > 400000 THEN 5 WHEN o_totalprice > 200000 THEN 3 ELSE 1 END AS i FROM orders)
    SELECT probability, impact, count(p) AS items FROM g LEFT JOIN r ON p = probability AND i = impact GROUP BY ALL
    """,
)
def matrix_count(t):
    price = F.col("o_totalprice")
    impact = F.when(price > 400000, 5).when(price > 200000, 3).otherwise(1)
    return A.matrix_count(t.orders, F.col("o_custkey") % 5 + 1, impact)


@query(
    "linear_trend",
    """
    WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
    x AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) - 1 AS i FROM m),
    r AS (SELECT o_orderpriority, count(*) AS points, regr_slope(total, i) AS slope, regr_intercept(total, i) AS intercept,
      corr(total, i) AS correlation, regr_r2(total, i) AS r2, regr_slope(total, i) / greatest(avg(total), 1) AS rel FROM x GROUP BY 1)
    SELECT o_orderpriority, points, slope, intercept, correlation, r2, CASE WHEN rel > 0.15 THEN 'strong_improvement' WHEN rel > 0.08 THEN 'improvement'
      WHEN rel > -0.05 THEN 'stable' WHEN rel > -0.08 THEN 'decline' ELSE 'strong_decline' END AS trend FROM r
    """,
    digits="slope:2 intercept:1 correlation:6 r2:6",
)
def linear_trend(t):
    m = t.orders.groupBy("o_orderpriority", F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(
        F.sum("o_totalprice").alias("total")
    )
    return A.linear_trend(m, ["o_orderpriority"], "month", "total").drop("mean", "relative_slope")


@query(
    "cv_volatility",
    """
    WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS low, max(value) AS high FROM events GROUP BY 1)
    SELECT *, std / mean AS cv, (high - low) / mean AS range_ratio, CASE WHEN std / mean <= 0.15 THEN 'low' WHEN std / mean <= 0.25 THEN 'moderate'
      WHEN std / mean <= 0.4 THEN 'high' ELSE 'very_high' END AS level FROM s
    """,
    digits="mean std cv range_ratio",
)
def cv_volatility(t):
    return A.volatility(t.events, ["event_type"], "value")
