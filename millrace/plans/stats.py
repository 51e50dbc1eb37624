"""Tests, intervals and rater statistics on the test tables."""

from pyspark.sql import functions as F

from millrace.operators import stats as S
from millrace.plans.registry import query
from millrace.plans.scalars import phi_sql, t_sql

Z95 = "1.959963984540054"


def counts(t):
    """Five tests by the props key, variant by user parity, conversion = purchase."""
    test = (F.get_json_object("props", "$.k").cast("int") % 5).alias("test")
    rows = t.events.select(test, "user_id", "event_type", "value")
    return S.variant_counts(rows, ["test"], F.col("user_id") % 2 == 1, (F.col("event_type") == "purchase") & (F.col("value") > 10))


COUNTS = """
    e AS (SELECT json_extract_string(props, '$.k')::INT % 5 AS test, user_id % 2 = 1 AS treated, event_type = 'purchase' AND value > 10 AS hit FROM events),
    c AS (SELECT test, count(*) FILTER (WHERE NOT treated)::DOUBLE AS cn, count(*) FILTER (WHERE NOT treated AND hit)::DOUBLE AS cx, count(*) FILTER (WHERE treated)::DOUBLE AS tn, count(*) FILTER (WHERE treated AND hit)::DOUBLE AS tx FROM e GROUP BY 1),
    p AS (SELECT *, cx / cn AS pc, tx / tn AS pt, (cx + tx) / (cn + tn) AS pp FROM c),
    z AS (SELECT *, (pt - pc) / sqrt(pp * (1 - pp) * (1 / cn + 1 / tn)) AS z, sqrt(pc * (1 - pc) / cn + pt * (1 - pt) / tn) AS spread, abs(2 * asin(sqrt(pt)) - 2 * asin(sqrt(pc))) AS effect FROM p)
"""
ZTEST = f"""
    SELECT test, pc AS control_rate, pt AS treatment_rate, pt - pc AS difference, (pt - pc) / pc * 100 AS lift_pct, z, pt - pc - {Z95} * spread AS lower, pt - pc + {Z95} * spread AS upper, effect,
      2 * (1 - {phi_sql('abs(z)')}) AS p_value, 2 * (1 - {phi_sql('abs(z)')}) < 0.05 AS significant,
      CASE WHEN effect < 0.2 THEN 'negligible' WHEN effect < 0.5 THEN 'small' WHEN effect < 0.8 THEN 'medium' ELSE 'large' END AS effect_label FROM z
"""


@query("two_prop_ztest", f"WITH {COUNTS} {ZTEST}", digits="control_rate:6 treatment_rate:6 difference:6 lift_pct z:6 lower:6 upper:6 effect:6 p_value:6")
def two_prop_ztest(t):
    return S.proportion_ztest(counts(t), ["test"])


@query(
    "welch_ttest",
    f"""
    WITH m AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS cm, stddev_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS cs, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS cn,
      avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') AS tm, stddev_samp(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') AS ts, count(*) FILTER (WHERE o_orderstatus <> 'F')::DOUBLE AS tn FROM orders GROUP BY 1),
    v AS (SELECT *, cs ** 2 / cn AS va, ts ** 2 / tn AS vb FROM m),
    w AS (SELECT o_orderpriority, tm - cm AS difference, (tm - cm) / cm * 100 AS lift_pct, (tm - cm) / sqrt(va + vb) AS t, (va + vb) ** 2 / (va ** 2 / (cn - 1) + vb ** 2 / (tn - 1)) AS df,
      tm - cm - {Z95} * sqrt(va + vb) AS lower, tm - cm + {Z95} * sqrt(va + vb) AS upper, abs((tm - cm) / sqrt(((tn - 1) * ts ** 2 + (cn - 1) * cs ** 2) / (cn + tn - 2))) AS effect FROM v)
    SELECT *, CASE WHEN effect < 0.2 THEN 'negligible' WHEN effect < 0.5 THEN 'small' WHEN effect < 0.8 THEN 'medium' ELSE 'large' END AS effect_label,
      2 * (1 - {t_sql('abs(t)', 'df')}) AS p_value,
      2 * (1 - {t_sql('abs(t)', 'df')}) < 0.05 AS significant FROM w
    """,
    digits="difference lift_pct t:6 df lower upper effect:6 p_value:6",
)
def welch_ttest(t):
    return S.welch_ttest(t.orders, ["o_orderpriority"], F.col("o_orderstatus") != "F", "o_totalprice")


@query(
    "chi2_gof",
    """
    WITH c AS (SELECT o_orderstatus, count(*) AS o FROM orders GROUP BY 1), n AS (SELECT sum(o)::BIGINT AS n FROM c),
    x AS (SELECT max(n) AS n, 2.0::DOUBLE AS df, sum((o - n * CASE o_orderstatus WHEN 'F' THEN 0.34 ELSE 0.33 END) ** 2 / (n * CASE o_orderstatus WHEN 'F' THEN 0.34 ELSE 0.33 END)) AS chi2 FROM c, n)
    SELECT n, df, chi2, NULL::VARCHAR AS warning, exp(-chi2 / 2) AS p_value, sqrt(chi2 / (n * 2)) AS cramers_v,
      CASE WHEN sqrt(chi2 / (n * 2)) < 0.1 THEN 'negligible' WHEN sqrt(chi2 / (n * 2)) < 0.3 THEN 'small' WHEN sqrt(chi2 / (n * 2)) < 0.5 THEN 'medium' ELSE 'large' END AS effect_label, exp(-chi2 / 2) < 0.05 AS significant FROM x
    """,
    digits="chi2:6 p_value:6 cramers_v:6",
)
def chi2_gof(t):
    return S.chi2_gof(t.orders, "o_orderstatus", {"F": 0.34, "O": 0.33, "P": 0.33})


@query(
    "wilson_ci",
    f"""
    WITH g AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS x FROM orders GROUP BY 1),
    c AS (SELECT *, {Z95} AS z, x / n AS p FROM g)
    SELECT o_orderpriority, n::BIGINT AS n, p AS rate, greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) AS lower,
      least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) AS upper FROM c
    """,
    digits="rate:6 lower:6 upper:6",
)
def wilson_ci(t):
    g = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("x"))
    lo, hi = S.wilson_interval(F.col("n"), F.col("x"))
    return g.select("o_orderpriority", "n", (F.col("x") / F.col("n")).alias("rate"), lo.alias("lower"), hi.alias("upper"))


@query(
    "mean_ci",
    f"""
    WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean, {Z95} * stddev_samp(o_totalprice) / sqrt(count(*)) AS half FROM orders GROUP BY 1)
    SELECT o_orderpriority, n, mean, mean - half AS lower, mean + half AS upper, half / abs(mean) * 100 AS relative_margin_pct FROM g
    """,
    digits="mean lower upper relative_margin_pct:6",
)
def mean_ci(t):
    return S.mean_interval(t.orders, ["o_orderpriority"], "o_totalprice")


@query(
    "ab_significance",
    f"""
    WITH {COUNTS}, u AS (SELECT test, pt - pc AS absolute, (pt - pc) / pc * 100 AS relative_pct, (pt - pc) / spread AS z FROM z),
    q AS (SELECT *, 2 * (1 - {phi_sql('abs(z)')}) AS p_value FROM u)
    SELECT *, CASE WHEN p_value < 0.05 THEN '95%' WHEN p_value < 0.1 THEN '90%' ELSE 'Not significant' END AS confidence_level FROM q
    """,
    digits="absolute:6 relative_pct z:6 p_value:6",
)
def ab_significance(t):
    return S.ab_significance(counts(t), ["test"])


@query(
    "srm_check",
    """
    WITH g AS (SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0) AS control, count(*) FILTER (WHERE user_id % 2 = 1) AS treatment FROM events GROUP BY 1)
    SELECT *, abs(control - treatment) / ((control + treatment) / 2) AS imbalance, abs(control - treatment) / ((control + treatment) / 2) >= 0.01 AS mismatch FROM g
    """,
    digits="imbalance:6",
)
def srm_check(t):
    return S.srm_check(t.events, ["event_type"], F.col("user_id") % 2 == 1)


@query(
    "bonferroni",
    f"""
    WITH {COUNTS}, q AS ({ZTEST}) SELECT test, p_value, (SELECT count(*) FROM q) AS tests, 0.05 / (SELECT count(*) FROM q) AS alpha_adjusted, p_value < 0.05 / (SELECT count(*) FROM q) AS significant_adjusted FROM q
    """,
    digits="p_value:6 alpha_adjusted:6",
)
def bonferroni(t):
    tests = S.proportion_ztest(counts(t), ["test"]).select("test", "p_value")
    return S.bonferroni(tests, "p_value")


def ratings(t):
    """Line items as ratings: part = item, supplier = rater, three measures scaled to 1-4."""
    q = 1 + (F.col("l_quantity") - 1) / 49 * 3
    d = 1 + F.col("l_discount") * 30
    x = 1 + F.col("l_tax") * 37.5
    return t.lineitem.select(
        F.col("l_partkey").alias("item"),
        F.col("l_suppkey").alias("rater"),
        F.col("l_shipdate").alias("day"),
        F.create_map(F.lit("quantity"), q, F.lit("discount"), d, F.lit("tax"), x).alias("scores"),
        ((q + d + x) / 3).alias("score"),
        (F.col("l_returnflag") == "A").alias("hit"),
    )


R = """
    m AS (SELECT l_partkey AS item, l_suppkey AS rater, l_shipdate AS day, 1 + (l_quantity - 1) / 49 * 3 AS q, 1 + l_discount * 30 AS d, 1 + l_tax * 37.5 AS x, l_returnflag = 'A' AS hit FROM lineitem),
    r AS (SELECT *, (q + d + x) / 3 AS score FROM m)
"""


@query(
    "score_distribution",
    f"""
    WITH {R}, c AS (SELECT floor(q)::INT AS score, count(*) AS n FROM r GROUP BY 1), e AS (SELECT unnest([1, 2, 3, 4]) AS score, unnest([0.1, 0.25, 0.45, 0.2])::DOUBLE AS expected)
    SELECT score, expected, coalesce(n / (SELECT sum(n) FROM c), 0) AS actual, coalesce(n / (SELECT sum(n) FROM c), 0) - expected AS difference, abs(coalesce(n / (SELECT sum(n) FROM c), 0) - expected) > 0.05 AS deviates FROM e LEFT JOIN c USING (score)
    """,
    digits="actual:6 difference:6",
)
def score_distribution(t):
    return S.score_distribution(t.lineitem, 1 + (F.col("l_quantity") - 1) / 49 * 3)


@query(
    "group_disparity",
    """
    WITH g AS (SELECT c_mktsegment, count(*) AS n, avg((o_orderstatus = 'F')::INT) AS rate, avg(o_totalprice / 100000) AS mean FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) >= 5),
    a AS (SELECT count(*) AS groups, max(rate) - min(rate) AS rate_gap, max(mean) - min(mean) AS score_gap FROM g)
    SELECT *, groups >= 2 AND (rate_gap > 0.1 OR score_gap > 0.5) AS detected FROM a
    """,
    digits="rate_gap:6 score_gap:6",
)
def group_disparity(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_mktsegment", (F.col("o_totalprice") / 100000).alias("score"), (F.col("o_orderstatus") == "F").alias("hit")
    )
    return S.group_disparity(rows, "c_mktsegment", "score", "hit")


@query(
    "competency_disparity",
    f"""
    WITH {R}, l AS (SELECT rater, unnest(['quantity', 'discount', 'tax']) AS competency, unnest([q, d, x]) AS s FROM r),
    b AS (SELECT competency, rater, avg(s) AS m FROM l GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT competency, avg(m) AS center FROM b GROUP BY 1),
    o AS (SELECT competency, count(*) FILTER (WHERE abs(m - center) > 0.5) AS raters_off FROM b JOIN c USING (competency) GROUP BY 1),
    s AS (SELECT competency, count(*) AS total, avg(s) AS mean, var_samp(s) AS variance FROM l GROUP BY 1)
    SELECT *, raters_off > 0 AS bias_detected FROM s JOIN o USING (competency)
    """,
    digits="mean:6 variance:6",
)
def competency_disparity(t):
    return S.competency_disparity(ratings(t), "rater", "scores")


CONS = f"""
    {R}, a AS (SELECT rater, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS std, var_samp(score) AS var, avg(hit::INT) AS rate, avg(score) FILTER (WHERE hit) AS yes, avg(score) FILTER (WHERE NOT hit) AS no,
      avg((floor(score) = 4)::INT) AS four_share FROM r GROUP BY 1),
    k AS (SELECT *, CASE WHEN n < 3 THEN 0.5 ELSE (coalesce(greatest(0, least(1, (yes - no) / 2)), 0.5) + greatest(0, 1 - var / 2)) / 2 END AS consistency FROM a)
"""


@query("rater_consistency", f"WITH {CONS} SELECT rater, n, consistency FROM k", digits="consistency:6")
def rater_consistency(t):
    return S.rater_consistency(ratings(t), "rater", "score", "hit").select("rater", "n", "consistency")


@query(
    "rater_bias",
    f"""
    WITH {CONS}, c AS (SELECT avg(mean) AS center, avg(rate) AS center_rate FROM k WHERE n >= 5),
    i AS (SELECT rater, n, mean, rate, consistency, list_filter([CASE WHEN mean > center * 1.3 THEN 'score_inflation' WHEN mean < center * 0.7 THEN 'score_deflation' END,
      CASE WHEN abs(rate - center_rate) > 0.15 THEN 'hire_rate_deviation' END, CASE WHEN consistency < 0.8 THEN 'low_consistency' END], lambda x: x IS NOT NULL) AS l FROM k, c WHERE n >= 5)
    SELECT rater, n, mean, rate, consistency, array_to_string(l, ',') AS issues, len(l) AS severity FROM i
    """,
    digits="mean:6 rate:6 consistency:6",
)
def rater_bias(t):
    return S.rater_bias(ratings(t), "rater", "score", "hit")


@query(
    "rater_agreement",
    f"""
    WITH {R}, p AS (SELECT item, stddev_samp(score) AS std, max(score) - min(score) AS span FROM r GROUP BY 1 HAVING count(*) > 1),
    a AS (SELECT count(*) AS items, avg(std) AS mean_std, avg((span <= 1)::INT) AS agreement FROM p)
    SELECT *, CASE WHEN mean_std > 0.8 THEN 'poor' WHEN agreement < 0.75 THEN 'fair' ELSE 'good' END AS quality FROM a
    """,
    digits="mean_std:6 agreement:6",
)
def rater_agreement(t):
    return S.rater_agreement(ratings(t), "item", "score")


@query(
    "score_inflation",
    f"""
    WITH {R}, a AS (SELECT rater, count(*) AS n, avg(q) AS mean, stddev_samp(q) AS std, avg((floor(q) = 4)::INT) AS four_share FROM r GROUP BY 1 HAVING count(*) >= 5)
    SELECT *, mean - 2.8 > 0.3 OR (mean > 3.2 AND std < 0.5) OR four_share > 0.4 AS inflated FROM a
    """,
    digits="mean:6 std:6 four_share:6",
)
def score_inflation(t):
    rows = ratings(t).select("rater", F.col("scores")["quantity"].alias("q"))
    return S.score_inflation(rows, "rater", "q")


@query(
    "period_trend",
    """
    WITH p AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS period, avg(o_totalprice / 100000) AS mean_score, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY ALL HAVING count(*) >= 3),
    i AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY period) AS i FROM p),
    s AS (SELECT o_orderpriority, count(*) AS periods, regr_slope(mean_score, i) AS score_slope, regr_slope(rate, i) AS rate_slope FROM i GROUP BY 1 HAVING count(*) >= 3)
    SELECT *, CASE WHEN score_slope > 0.01 THEN 'increasing' WHEN score_slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS score_direction,
      CASE WHEN rate_slope > 0.005 THEN 'increasing' WHEN rate_slope < -0.005 THEN 'decreasing' ELSE 'stable' END AS rate_direction FROM s
    """,
    digits="score_slope:6 rate_slope:6",
)
def period_trend(t):
    rows = t.orders.withColumn("score", F.col("o_totalprice") / 100000)
    return S.period_trend(rows, ["o_orderpriority"], F.date_format("o_orderdate", "yyyy-MM"), "score", F.col("o_orderstatus") == "F")


@query(
    "best_run_stats",
    """
    WITH r AS (SELECT user_id, ts, event_id, value, CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'error' THEN 'crash' ELSE 'discard' END AS status FROM events),
    a AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'keep') AS keeps, count(*) FILTER (WHERE status = 'discard') AS discards, count(*) FILTER (WHERE status = 'crash') AS crashes,
      arg_min(value, (ts, event_id)) FILTER (WHERE status = 'keep') AS baseline, min(value) FILTER (WHERE status = 'keep') AS best FROM r GROUP BY 1)
    SELECT *, (baseline - best) / baseline * 100 AS pct_change FROM a
    """,
    digits="pct_change",
)
def best_run_stats(t):
    status = F.when(F.col("event_type") == "purchase", "keep").when(F.col("event_type") == "error", "crash").otherwise("discard")
    return S.best_run(t.events.withColumn("status", status), ["user_id"], "status", "value", ["ts", "event_id"], lower=True)
