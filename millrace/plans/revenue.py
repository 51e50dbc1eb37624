"""Customers, revenue and finance. Customers and orders stand in for accounts and deals."""

from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.operators import revenue as V
from millrace.plans.registry import query

SEGMENTS = ["enterprise", "mid-market", "smb"]


def pick(expr: str, names):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.expr(expr) % len(names) + 1).cast("int"))


# Account attributes as (name, Spark and DuckDB expression) over customer c and its order summary o.
HEALTH = {
    "login_frequency": "coalesce(n, 0) * 6.0", "feature_adoption": "c_acctbal / 120", "dau_mau_ratio": "coalesce(f, 0) / 20.0", "ticket_volume": "coalesce(u, 0)",
    "meeting_attendance": "c_custkey % 100", "nps": "c_custkey % 11", "csat": "1 + (c_custkey % 41) / 10.0", "open_tickets": "coalesce(n - f, 0)",
    "escalation_rate": "coalesce(u, 0) / 20.0", "resolution_hours": "c_custkey % 130", "sponsor_engagement": "c_custkey % 90", "threads": "c_custkey % 6",
}
SENTIMENTS = ["positive", "neutral", "negative", "unknown", "other"]


def accounts(t):
    o = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u")
    )
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")


ACC = "a AS (SELECT * FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1) ON o_custkey = c_custkey)"


def _b(key):
    return "CASE segment " + " ".join(f"WHEN '{s}' THEN {float(r[key])}" for s, r in V.HEALTH_BENCHMARKS.items()) + " END"


def _up(col, key):
    return f"greatest(0, least(100, {col} / ({_b(key)}) * 100))"


def _dn(col, key):
    return f"greatest(0, least(100, (1 - {col} / ({_b(key)})) * 100))"


@query(
    "health_score",
    f"""
    WITH {ACC}, h AS (SELECT c_custkey, {SEGMENTS}[c_custkey % 3 + 1] AS segment, {', '.join(f'({e})::DOUBLE AS {k}' for k, e in HEALTH.items())}, {SENTIMENTS}[c_custkey % 5 + 1] AS sentiment FROM a),
    d AS (SELECT c_custkey, segment,
      round_even(round({_up('login_frequency', 'login')} * 0.35 + {_up('feature_adoption', 'adoption')} * 0.4 + {_up('dau_mau_ratio', 'dau_mau')} * 0.25, 8), 1) AS usage,
      round_even(round({_dn('ticket_volume', 'tickets')} * 0.2 + {_up('meeting_attendance', 'attendance')} * 0.3 + {_up('nps', 'nps')} * 0.25 + {_up('csat', 'csat')} * 0.25, 8), 1) AS engagement,
      round_even(round({_dn('open_tickets', 'open')} * 0.35 + {_dn('escalation_rate', 'escalation')} * 0.35 + {_dn('resolution_hours', 'hours')} * 0.3, 8), 1) AS support,
      round_even(round({_up('sponsor_engagement', 'sponsor')} * 0.35 + {_up('threads', 'threads')} * 0.3 + CASE sentiment WHEN 'positive' THEN 100 WHEN 'neutral' THEN 60 WHEN 'negative' THEN 20 ELSE 50 END * 0.35, 8), 1) AS relationship FROM h),
    s AS (SELECT *, round_even(round(usage * 0.3 + engagement * 0.25 + support * 0.2 + relationship * 0.25, 8), 1) AS overall FROM d)
    SELECT c_custkey, usage, engagement, support, relationship, overall, CASE WHEN overall >= {_b('green')} THEN 'green' WHEN overall >= {_b('yellow')} THEN 'yellow' ELSE 'red' END AS classification FROM s
    """,
    digits="usage:1 engagement:1 support:1 relationship:1 overall:1",
)
def health_score(t):
    rows = accounts(t).select(
        "c_custkey", pick("c_custkey", SEGMENTS).alias("segment"), *[F.expr(e).cast("double").alias(k) for k, e in HEALTH.items()], pick("c_custkey", SENTIMENTS).alias("sentiment")
    )
    return V.health_score(rows).select("c_custkey", "usage", "engagement", "support", "relationship", "overall", "classification")


RISK = {
    "login_trend": "c_custkey % 61 - 40", "feature_change": "c_custkey % 37 - 25", "dau_mau_change": "(c_custkey % 41 - 30) / 100.0", "cancellations": "c_custkey % 5",
    "response_days": "c_custkey % 9", "nps_change": "c_custkey % 9 - 6", "escalations": "c_custkey % 3", "critical_open": "c_custkey % 4", "competitors": "c_custkey % 5",
    "champion_left": "c_custkey % 6 = 0", "sponsor_change": "c_custkey % 8 = 0", "pricing_complaints": "c_custkey % 7 = 0", "budget_cuts": "c_custkey % 10 = 0", "days_left": "c_custkey % 300",
}
SATISFACTION = ["improving", "stable", "declining", "critical", "odd"]
CONTRACTS = ["annual", "quarterly", "month-to-month"]


def _drop(c, k):
    return f"greatest(0, least(100, abs(least({c}, 0)) * {k}))"


@query(
    "churn_risk",
    f"""
    WITH r AS (SELECT c_custkey, {', '.join(f'{e} AS {k}' for k, e in RISK.items())}, {SATISFACTION}[c_custkey % 5 + 1] AS satisfaction, {CONTRACTS}[c_custkey % 3 + 1] AS contract_type FROM customer),
    p AS (SELECT *, round_even(round(({_drop('login_trend', 3)} * 0.4 + {_drop('feature_change', 4)} * 0.35 + {_drop('dau_mau_change', 500)} * 0.25)::DOUBLE, 8), 1) AS usage,
      round_even(round((least(100, cancellations * 25) * 0.3 + greatest(0, least(100, (response_days - 1) * 15)) * 0.35 + {_drop('nps_change', 20)} * 0.35)::DOUBLE, 8), 1) AS engagement,
      round_even(round((least(100, escalations * 35) * 0.35 + least(100, critical_open * 50) * 0.35 + CASE satisfaction WHEN 'improving' THEN 10 WHEN 'declining' THEN 70 WHEN 'critical' THEN 95 ELSE 30 END * 0.3)::DOUBLE, 8), 1) AS support,
      least(100, CASE WHEN champion_left THEN 45 ELSE 0 END + CASE WHEN sponsor_change THEN 30 ELSE 0 END + CASE WHEN competitors >= 3 THEN 35 ELSE competitors * 12 END)::DOUBLE AS relationship,
      least(100, CASE contract_type WHEN 'month-to-month' THEN 30 WHEN 'quarterly' THEN 15 ELSE 0 END + CASE WHEN pricing_complaints THEN 35 ELSE 0 END + CASE WHEN budget_cuts THEN 40 ELSE 0 END)::DOUBLE AS commercial FROM r),
    q AS (SELECT *, (usage * 0.3 + engagement * 0.25 + support * 0.2 + relationship * 0.15 + commercial * 0.1)::DOUBLE AS raw_score, CASE WHEN days_left <= 30 THEN 1.5 WHEN days_left <= 60 THEN 1.35 WHEN days_left <= 90 THEN 1.2 WHEN days_left <= 180 THEN 1.1 ELSE 1 END::DOUBLE AS multiplier FROM p),
    z AS (SELECT *, least(100, round_even(round(raw_score * multiplier, 8), 1)) AS risk_score FROM q)
    SELECT c_custkey, usage, engagement, support, relationship, commercial, raw_score, multiplier, risk_score,
      CASE WHEN risk_score BETWEEN 80 AND 100 THEN 'critical' WHEN risk_score BETWEEN 60 AND 79 THEN 'high' WHEN risk_score BETWEEN 40 AND 59 THEN 'medium' ELSE 'low' END AS tier,
      (login_trend < -5)::INT + (feature_change < -5)::INT + (dau_mau_change <= -0.1)::INT + (cancellations >= 2)::INT + (response_days >= 4)::INT + (nps_change <= -2)::INT + (critical_open >= 1)::INT + (escalations >= 1)::INT
      + (satisfaction IN ('critical', 'declining'))::INT + champion_left::INT + sponsor_change::INT + (competitors >= 1)::INT + (contract_type = 'month-to-month')::INT + pricing_complaints::INT + budget_cuts::INT AS warnings FROM z
    """,
    digits="usage:1 engagement:1 support:1 relationship:1 commercial:1 raw_score:3 multiplier:2 risk_score:1",
)
def churn_risk(t):
    rows = t.customer.select(
        "c_custkey", *[F.expr(e).alias(k) for k, e in RISK.items()], pick("c_custkey", SATISFACTION).alias("satisfaction"), pick("c_custkey", CONTRACTS).alias("contract_type")
    )
    out = V.churn_risk(rows, "days_left")
    return out.select(
        "c_custkey", "usage", "engagement", "support", "relationship", "commercial", "raw_score", "multiplier", "risk_score", "tier", F.size("warnings").alias("warnings")
    )


PLANS = ["starter", "professional", "enterprise", "enterprise_plus"]
MODULES = ["core_platform", "analytics_module", "api_access", "custom_workflows", "unlisted"]
DEPTS = ["Sales", "Finance", "Legal", "Support"]


@query(
    "expansion_score",
    f"""
    WITH e AS (SELECT c_custkey, (abs(c_acctbal) + 1000) * 20 AS arr, {SEGMENTS}[c_custkey % 3 + 1] AS segment, 10 + c_custkey % 50 AS licensed, 5 + c_custkey % 55 AS active, c_custkey % 4 AS plan, c_custkey % 3 + 1 AS nd FROM customer),
    x AS (SELECT c_custkey, 'seat_expansion' AS category, 'seats' AS target, round(arr * CASE segment WHEN 'enterprise' THEN 0.25 WHEN 'mid-market' THEN 0.2 ELSE 0.15 END) AS revenue, 3 AS effort FROM e WHERE active / licensed >= 0.9
      UNION ALL SELECT c_custkey, 'tier_upgrade', {PLANS}[plan + 2], round(arr / [1.0, 1.8, 3.0, 4.5][plan + 1] * [1.0, 1.8, 3.0, 4.5][plan + 2] - arr), 2 FROM e WHERE plan < 3
      UNION ALL SELECT c_custkey, 'module_cross_sell', m.name, round(arr * m.s), 3 FROM e, (VALUES (1, 'analytics_module', 0.15), (2, 'api_access', 0.10), (3, 'custom_workflows', 0.22), (4, 'unlisted', 0.10)) m(i, name, s) WHERE (c_custkey + m.i) % 2 = 0
      UNION ALL SELECT c_custkey, 'department_expansion', {DEPTS}[j], round(arr / nd * 0.8), 1 FROM e, range(1, 5) r(j) WHERE j > nd)
    SELECT c_custkey, category, target, revenue, round_even(round(least(100, revenue / 2000) * effort, 8), 1) AS priority FROM x
    """,
    digits="revenue:0 priority:1",
)
def expansion_score(t):
    k = F.col("c_custkey")
    plan = (k % 4 + 1).cast("int")
    rows = t.customer.select(
        "c_custkey", ((F.abs("c_acctbal") + 1000) * 20).alias("arr"), pick("c_custkey", SEGMENTS).alias("segment"), (10 + k % 50).alias("licensed"), (5 + k % 55).alias("active"),
        F.element_at(F.array(*[F.lit(p) for p in PLANS]), plan).alias("plan"), F.array(*[F.lit(p) for p in PLANS]).alias("plans"),
        F.create_map(*[x for i, m in enumerate(MODULES) for x in (F.lit(m), (k + i) % 2 == 1)]).alias("modules"),
        F.slice(F.array(*[F.lit(d) for d in DEPTS]), 1, (k % 3 + 1).cast("int")).alias("departments"), F.array(*[F.lit(d) for d in DEPTS]).alias("potential"),
    )
    return V.expansion_rows(rows, ["c_custkey"]).drop("effort")


def subscriptions(t):
    """Customers with first order as start; every fourth one churns at its last order."""
    o = t.orders.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("start_date"), F.to_date(F.max("o_orderdate")).alias("last"))
    k = F.col("c_custkey")
    j = t.customer.join(o, k == F.col("o_custkey"))
    arr = F.abs("c_acctbal") + 1000
    return j.select(
        "c_custkey", "c_mktsegment", "start_date", F.when(k % 4 == 0, F.col("last")).alias("churn_date"), arr.alias("arr"),
        F.when(k % 3 == 0, arr * 0.1).otherwise(0.0).alias("expansion"), F.when(k % 5 == 0, arr * 0.05).otherwise(0.0).alias("contraction"), F.when(k % 2 == 0, k % 101).alias("health"),
    )


SUBS = """
    s AS (SELECT c_custkey, c_mktsegment, start_date, CASE WHEN c_custkey % 4 = 0 THEN last END AS churn_date, abs(c_acctbal) + 1000 AS arr, CASE WHEN c_custkey % 3 = 0 THEN (abs(c_acctbal) + 1000) * 0.1 ELSE 0 END AS expansion,
      CASE WHEN c_custkey % 5 = 0 THEN (abs(c_acctbal) + 1000) * 0.05 ELSE 0 END AS contraction, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 101 END AS health
      FROM customer JOIN (SELECT o_custkey, min(o_orderdate)::DATE AS start_date, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey)
"""
PERIODS = [(f"{y}-01-01", f"{y}-12-31") for y in range(1996, 2002)]
FALL = f"""
    per(period_start, period_end) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in PERIODS)}),
    w AS (SELECT period_start, period_end, s.*, start_date <= period_start::DATE AND (churn_date IS NULL OR churn_date > period_start::DATE) AS op, churn_date > period_start::DATE AND churn_date <= period_end::DATE AS ch FROM per, s),
    g AS (SELECT period_start, period_end, coalesce(sum(arr) FILTER (WHERE op), 0) AS opening, coalesce(sum(arr) FILTER (WHERE start_date > period_start::DATE AND start_date <= period_end::DATE), 0) AS new,
      coalesce(sum(arr) FILTER (WHERE op AND ch), 0) AS churned, coalesce(sum(expansion) FILTER (WHERE op AND (churn_date IS NULL OR churn_date > period_end::DATE)), 0) AS expansion,
      coalesce(sum(contraction) FILTER (WHERE op AND (churn_date IS NULL OR churn_date > period_end::DATE)), 0) AS contraction, coalesce(sum(contraction) FILTER (WHERE op), 0) AS allc,
      count(*) FILTER (WHERE op) AS logos, count(*) FILTER (WHERE op AND ch) AS lost FROM w GROUP BY 1, 2)
"""


@query(
    "arr_waterfall",
    f"""WITH {SUBS}, {FALL} SELECT period_start, period_end, opening, new, expansion, contraction, churned, opening + new + expansion - contraction - churned AS closing,
      CASE WHEN opening > 0 THEN greatest(0, (opening - contraction - churned) / opening) ELSE 0 END AS grr, CASE WHEN opening > 0 THEN greatest(0, (opening + expansion - contraction - churned) / opening) ELSE 0 END AS nrr FROM g""",
    digits="opening:2 new:2 expansion:2 contraction:2 churned:2 closing:2 grr:6 nrr:6",
)
def arr_waterfall(t):
    return V.arr_waterfall(subscriptions(t), PERIODS).drop("logo_churn", "revenue_churn")


@query(
    "logo_revenue_churn",
    f"WITH {SUBS}, {FALL} SELECT period_start, CASE WHEN logos > 0 THEN lost / logos ELSE 0 END AS logo_churn, CASE WHEN opening > 0 THEN (churned + allc) / opening ELSE 0 END AS revenue_churn FROM g",
    digits="logo_churn:6 revenue_churn:6",
)
def logo_revenue_churn(t):
    return V.arr_waterfall(subscriptions(t), PERIODS).select("period_start", "logo_churn", "revenue_churn")


@query(
    "arr_cohort_retention",
    f"""
    WITH {SUBS}, c AS (SELECT strftime(start_date, '%Y-%m') AS cohort, min(start_date) AS first, sum(arr) AS opening FROM s GROUP BY 1),
    m AS (SELECT cohort, opening, month, first + floor(month * 30.44)::INT AS day FROM c, (VALUES (0), (3), (6), (9), (12), (18), (24)) v(month)),
    r AS (SELECT cohort, month, coalesce(sum(arr) FILTER (WHERE start_date <= day AND (churn_date IS NULL OR churn_date > day)), 0) / max(opening) AS retention FROM m JOIN s ON strftime(start_date, '%Y-%m') = cohort WHERE day <= DATE '2001-09-01' GROUP BY 1, 2)
    SELECT * FROM r
    """,
    digits="retention:6",
)
def arr_cohort_retention(t):
    return V.cohort_retention(subscriptions(t), "2001-09-01")


@query(
    "at_risk_rules",
    f"""
    WITH {SUBS}, r AS (SELECT c_custkey, date_diff('day', start_date, DATE '2001-09-01') / 30.44 AS tenure_months, coalesce(health < 60, false) AS a, date_diff('day', start_date, DATE '2001-09-01') / 30.44 < 6 AS b, contraction > 0 AS c, date_diff('day', start_date, DATE '2001-09-01') / 30.44 > 12 AND expansion = 0 AS d FROM s WHERE churn_date IS NULL),
    z AS (SELECT c_custkey, tenure_months, 40 * a::INT + 20 * b::INT + 30 * c::INT + 10 * d::INT AS risk_score, concat_ws(',', CASE WHEN a THEN 'health' END, CASE WHEN b THEN 'tenure' END, CASE WHEN c THEN 'contraction' END, CASE WHEN d THEN 'stagnant' END) AS reasons FROM r)
    SELECT * FROM z WHERE risk_score > 0
    """,
    digits="tenure_months",
)
def at_risk_rules(t):
    return V.at_risk(subscriptions(t), "2001-09-01").select("c_custkey", "tenure_months", "risk_score", "reasons")


@query(
    "expansion_by_segment",
    f"WITH {SUBS} SELECT c_mktsegment AS segment, count(*) AS customers, sum(arr) AS arr, sum(expansion) AS expansion, sum(contraction) AS contraction, sum(expansion) / sum(arr) AS expansion_rate, (sum(arr) + sum(expansion) - sum(contraction)) / sum(arr) AS net_contribution FROM s WHERE churn_date IS NULL GROUP BY 1",
    digits="arr:2 expansion:2 contraction:2 expansion_rate:6 net_contribution:6",
)
def expansion_by_segment(t):
    return V.expansion_by_segment(subscriptions(t), "c_mktsegment")


STAGES = ["Discovery", "Qualification", "Proposal", "Negotiation", "Closed Won"]


def deals(t):
    return t.orders.select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("value"), pick("o_orderkey * 7 + o_custkey", STAGES).alias("stage"), (F.col("o_orderkey") % 200).alias("age_days"),
        F.to_date("o_orderdate").alias("close_date"), (F.col("o_custkey") % 10).alias("rep"), F.col("o_orderpriority").alias("segment"),
    )


DEALS = f"d AS (SELECT o_orderkey, o_custkey, o_totalprice AS value, {STAGES}[(o_orderkey * 7 + o_custkey) % 5 + 1] AS stage, o_orderkey % 200 AS age_days, o_orderdate::DATE AS close_date, o_custkey % 10 AS rep, o_orderpriority AS segment FROM orders)"


@query(
    "pipeline_coverage",
    f"""WITH {DEALS}, p AS (SELECT rep, sum(value) FILTER (WHERE stage <> 'Closed Won') AS pipeline FROM d GROUP BY 1)
    SELECT *, pipeline / 1e8 AS coverage, CASE WHEN pipeline / 1e8 >= 4 THEN 'Strong' WHEN pipeline / 1e8 >= 3 THEN 'Healthy' WHEN pipeline / 1e8 >= 2 THEN 'At Risk' ELSE 'Critical' END AS rating FROM p""",
    digits="pipeline:2 coverage:6",
)
def pipeline_coverage(t):
    return V.pipeline_coverage(deals(t), ["rep"], 1e8)


@query(
    "stage_conversion",
    f"""WITH {DEALS}, c AS (SELECT list_position({STAGES}, stage) AS p FROM d), n AS (SELECT i, (SELECT count(*) FROM c WHERE p >= i) AS k FROM range(1, 6) r(i))
    SELECT {STAGES}[a.i] AS from_stage, {STAGES}[b.i] AS to_stage, a.k AS from_count, b.k AS to_count, b.k / a.k * 100 AS conversion_pct FROM n a JOIN n b ON b.i = a.i + 1""",
    digits="conversion_pct",
)
def stage_conversion(t):
    return V.stage_conversion(deals(t), STAGES)


@query(
    "sales_velocity",
    f"""WITH {DEALS}, v AS (SELECT segment, count(*) AS deals, avg(value) AS avg_size, avg((stage = 'Closed Won')::INT) AS win_rate, avg(age_days) AS avg_cycle FROM d GROUP BY 1)
    SELECT *, deals * avg_size * win_rate / avg_cycle AS per_day, deals * avg_size * win_rate / avg_cycle * 30 AS per_month FROM v""",
    digits="avg_size win_rate:6 avg_cycle per_day:2 per_month:2",
)
def sales_velocity(t):
    return V.sales_velocity(deals(t), ["segment"])


@query(
    "deal_aging",
    f"""WITH {DEALS}, l AS (SELECT *, CASE stage WHEN 'Discovery' THEN 120 WHEN 'Qualification' THEN 105 WHEN 'Proposal' THEN 90 WHEN 'Negotiation' THEN 75 END AS threshold_days FROM d WHERE stage <> 'Closed Won')
    SELECT o_orderkey, stage, age_days, threshold_days, age_days - threshold_days AS days_over FROM l WHERE age_days > threshold_days""",
)
def deal_aging(t):
    return V.deal_aging(deals(t), 60, STAGES).select("o_orderkey", "stage", "age_days", "threshold_days", "days_over")


@query(
    "pipeline_risk",
    f"""WITH {DEALS}, o AS (SELECT * FROM d WHERE stage <> 'Closed Won'), w AS (SELECT o_custkey, sum(value) AS pipeline, max(value) AS largest, count(DISTINCT stage) AS stages_used FROM o GROUP BY 1),
    q AS (SELECT o_custkey, year(close_date), quarter(close_date), sum(value) AS v FROM o GROUP BY 1, 2, 3), t AS (SELECT o_custkey, count(*) FILTER (WHERE v / 100000 < 3) AS thin_quarters FROM q GROUP BY 1),
    j AS (SELECT o_custkey, pipeline, stages_used, thin_quarters, largest / pipeline * 100 AS top_share FROM w JOIN t USING (o_custkey)),
    k AS (SELECT *, CASE WHEN top_share > 40 THEN 'HIGH' WHEN top_share > 25 THEN 'MEDIUM' END AS concentration, CASE WHEN top_share > 40 THEN 2 ELSE 0 END + (stages_used < 4)::INT + (thin_quarters > 0)::INT + CASE WHEN pipeline / 400000 < 3 THEN 2 ELSE 0 END AS risk_factors FROM j)
    SELECT *, CASE WHEN risk_factors >= 4 THEN 'HIGH' WHEN risk_factors >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk FROM k""",
    digits="pipeline:2 top_share",
)
def pipeline_risk(t):
    return V.pipeline_risk(deals(t), ["o_custkey"], 400000, STAGES).drop("largest")


FULL = list(V.STAGE_PROBABILITY)


def pipeline(t):
    return deals(t).withColumn("stage", pick("o_orderkey + o_custkey * 3", FULL))


PIPE = f"""
    d AS (SELECT o_orderkey, o_totalprice AS value, {FULL}[(o_orderkey + o_custkey * 3) % 9 + 1] AS stage, [0.10, 0.25, 0.40, 0.55, 0.65, 0.80, 0.92, 1.00, 0.00][(o_orderkey + o_custkey * 3) % 9 + 1]::DOUBLE AS p,
      o_orderdate::DATE AS close_date, o_custkey % 10 AS rep, o_orderpriority AS segment FROM orders),
    o AS (SELECT * FROM d WHERE stage NOT IN ('closed_won', 'closed_lost'))
"""


@query(
    "weighted_pipeline",
    f"WITH {PIPE} SELECT strftime(close_date, '%Y-%m') AS period, count(*) AS deals, sum(value) AS open_pipeline, sum(value * least(1, p * 0.85)) AS conservative, sum(value * least(1, p)) AS base, sum(value * least(1, p * 1.15)) AS upside FROM o GROUP BY 1",
    digits="open_pipeline:2 conservative:2 base:2 upside:2",
)
def weighted_pipeline(t):
    return V.weighted_pipeline(pipeline(t), D.month_key("close_date"))


@query(
    "win_rate_calibration",
    f"""WITH {PIPE}, w AS (SELECT avg((stage = 'closed_won')::INT) AS win_rate FROM d WHERE stage IN ('closed_won', 'closed_lost')), s AS (SELECT DISTINCT stage, p AS default_probability FROM d)
    SELECT win_rate, stage, default_probability, least(1, default_probability * win_rate / 0.25) AS calibrated FROM s, w""",
    digits="win_rate:6 default_probability calibrated:6",
)
def win_rate_calibration(t):
    return V.win_rate_calibration(pipeline(t))


@query(
    "rep_segment_rollup",
    f"WITH {PIPE} "
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}::VARCHAR AS name, count(*) AS deals, sum(value) AS pipeline, sum(value * p) AS weighted, avg(value) AS avg_size FROM o GROUP BY 2" for d in ("rep", "segment", "stage")),
    digits="pipeline:2 weighted:2 avg_size",
)
def rep_segment_rollup(t):
    return V.rep_segment_rollup(pipeline(t), ["rep", "segment", "stage"])


MONTHS24 = "month_no < 24"


def cohorts(t):
    """Customers by first order quarter: revenue of the months after, as an array."""
    first = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("first"))
    rows = t.orders.join(first, F.col("o_custkey") == F.col("k"))
    no = (F.year("o_orderdate") - F.year("first")) * 12 + F.month("o_orderdate") - F.month("first")
    rows = rows.withColumn("cohort", D.quarter_key("first")).withColumn("month_no", no)
    size = rows.groupBy("cohort").agg(F.countDistinct("o_custkey").alias("customers"))
    m = rows.where(MONTHS24).groupBy("cohort", "month_no").agg(F.sum("o_totalprice").alias("r"))
    grid = size.select("cohort", "customers", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("month_no"))
    filled = grid.join(m, ["cohort", "month_no"], "left").groupBy("cohort", "customers").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("month_no", F.coalesce("r", F.lit(0.0)).alias("r")))), lambda x: x["r"]).alias("monthly_revenue")
    )
    return filled.withColumn("cac_spend", F.col("customers") * 5000.0).withColumn("gross_margin", F.lit(0.7))


COHORTS = """
    f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1),
    r AS (SELECT 'Q' || quarter(first) || ' ' || year(first) AS cohort, (year(o_orderdate) - year(first)) * 12 + month(o_orderdate) - month(first) AS m, o_custkey, o_totalprice FROM orders JOIN f USING (o_custkey)),
    s AS (SELECT cohort, count(DISTINCT o_custkey) AS n, sum(o_totalprice) FILTER (WHERE m = 0) AS m1, coalesce(sum(o_totalprice) FILTER (WHERE m = 5), 0) AS m6, coalesce(sum(o_totalprice) FILTER (WHERE m = 11), 0) AS m12, sum(o_totalprice) FILTER (WHERE m < 12) AS y FROM r GROUP BY 1),
    c AS (SELECT *, 5000.0 AS cac, m1 / n AS arpa, greatest(0.001, least(0.3, CASE WHEN m1 > 0 AND m12 > 0 THEN 1 - (m12 / m1) ** (1.0 / 11) ELSE 0.02 END)) AS churn FROM s)
"""


@query(
    "cohort_unit_economics",
    f"WITH {COHORTS} SELECT cohort, n AS customers, cac, arpa, churn AS monthly_churn, arpa * 0.7 / churn AS ltv, cac / (arpa * 0.7) AS payback_months, arpa * 0.7 / churn / cac AS ltv_cac, m6 / m1 AS retention_m6, m12 / m1 AS retention_m12, y * 0.7 AS realized_m12 FROM c",
    digits="cac arpa:2 monthly_churn:6 ltv:1 payback_months:6 ltv_cac retention_m6:6 retention_m12:6 realized_m12:1",
)
def cohort_unit_economics(t):
    return V.cohort_unit_economics(cohorts(t)).drop("monthly_revenue", "cac_spend", "gross_margin")


@query(
    "channel_unit_economics",
    """
    WITH c AS (SELECT o_orderpriority AS channel, sum(o_totalprice) / 100 AS spend, count(DISTINCT o_custkey) AS customers, avg(o_totalprice) AS arpa, avg((o_orderstatus = 'P')::INT) / 10 AS churn FROM orders GROUP BY 1),
    r AS (SELECT channel, spend, customers, spend / customers AS cac, arpa * 0.7 / churn AS ltv, spend / customers / (arpa * 0.7) AS payback_months FROM c),
    u AS (SELECT * FROM r UNION ALL SELECT 'blended', sum(spend), sum(customers)::BIGINT, sum(spend) / sum(customers), sum(ltv * customers) / sum(customers), NULL FROM r)
    SELECT *, ltv / cac AS ltv_cac FROM u
    """,
    digits="spend:2 cac ltv:2 payback_months:6 ltv_cac",
)
def channel_unit_economics(t):
    c = t.orders.groupBy(F.col("o_orderpriority").alias("channel")).agg(
        (F.sum("o_totalprice") / 100).alias("spend"), F.countDistinct("o_custkey").alias("customers"), F.avg("o_totalprice").alias("arpa"),
        (F.avg((F.col("o_orderstatus") == "P").cast("int")) / 10).alias("monthly_churn"),
    )
    return V.channel_unit_economics(c.withColumn("gross_margin", F.lit(0.7)))


def monthly_book(t):
    """Month rows by priority: revenue parts and customer counts."""
    from pyspark.sql import Window

    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    m = t.orders.groupBy("o_orderpriority", F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(
        F.round(F.sum(p), 2).alias("mrr"), F.countDistinct("o_custkey").alias("customers"), F.count_if(s == "P").alias("churned"), F.count_if(s == "O").alias("new_customers"),
        F.round(F.sum(F.when(s == "O", p)) * 0.2, 2).alias("expansion_mrr"), F.round(F.sum(F.when(s == "P", p)) * 0.1, 2).alias("churned_mrr"), F.round(F.sum(F.when(s == "F", p)) * 0.05, 2).alias("contraction_mrr"),
    )
    return m.withColumn("mrr_last", F.lag("mrr").over(Window.partitionBy("o_orderpriority").orderBy("month"))).withColumn("sm_spend", F.round(F.col("mrr") * 0.15, 2))


BOOK = """
    m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-01') AS month, round(sum(o_totalprice), 2) AS mrr, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'P') AS churned, count(*) FILTER (WHERE o_orderstatus = 'O') AS new_customers,
      round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') * 0.2, 2) AS expansion_mrr, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P') * 0.1, 2) AS churned_mrr, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') * 0.05, 2) AS contraction_mrr FROM orders GROUP BY ALL),
    b AS (SELECT *, lag(mrr) OVER (PARTITION BY o_orderpriority ORDER BY month) AS mrr_last, round(mrr * 0.15, 2) AS sm_spend FROM m)
"""


@query(
    "saas_metrics",
    f"""WITH {BOOK}, x AS (SELECT *, round(mrr / customers, 2) AS arpa, CASE WHEN mrr_last > 0 THEN round((mrr - mrr_last) / mrr_last * 100, 2) END AS growth_pct, round(churned / customers * 100, 2) AS churn_pct, CASE WHEN new_customers > 0 THEN round(sm_spend / new_customers, 2) END AS cac FROM b),
    y AS (SELECT *, CASE WHEN churn_pct > 0 THEN round(arpa / (churn_pct / 100) * 0.7, 2) END AS ltv FROM x)
    SELECT o_orderpriority, month, round(mrr * 12, 2) AS arr, arpa, growth_pct, churn_pct, cac, ltv, CASE WHEN cac > 0 THEN round(ltv / cac, 2) END AS ltv_cac, CASE WHEN cac <> 0 THEN round(cac / (arpa * 0.7), 1) END AS payback_months,
      CASE WHEN mrr_last > 0 AND (coalesce(expansion_mrr, 0) <> 0 OR coalesce(churned_mrr, 0) <> 0 OR coalesce(contraction_mrr, 0) <> 0) THEN round((mrr_last + expansion_mrr - churned_mrr - contraction_mrr) / mrr_last * 100, 2) WHEN churn_pct <> 0 THEN round(100 - churn_pct, 2) END AS nrr_pct FROM y""",
    digits="arr:1 arpa:1 growth_pct:1 churn_pct:1 cac:1 ltv:0 ltv_cac:1 payback_months:0 nrr_pct:1",
)
def saas_metrics(t):
    return V.saas_metrics(monthly_book(t)).select("o_orderpriority", "month", "arr", "arpa", "growth_pct", "churn_pct", "cac", "ltv", "ltv_cac", "payback_months", "nrr_pct")


@query(
    "quick_ratio",
    f"""WITH {BOOK}, q AS (SELECT o_orderpriority, month, coalesce(sm_spend, 0) + coalesce(expansion_mrr, 0) AS gain, coalesce(churned_mrr, 0) + CASE WHEN month < '1996-01-01' THEN 0 ELSE coalesce(contraction_mrr, 0) END AS loss FROM b)
    SELECT o_orderpriority, month, CASE WHEN loss <> 0 THEN gain / loss WHEN gain > 0 THEN NULL ELSE 0 END AS ratio, loss = 0 AND gain > 0 AS endless,
      CASE WHEN (loss = 0 AND gain > 0) OR gain / loss >= 4 THEN 'EXCELLENT' WHEN gain / loss >= 2 THEN 'HEALTHY' WHEN gain / loss >= 1 THEN 'WATCH' ELSE 'CRITICAL' END AS status FROM q""",
    digits="ratio",
)
def quick_ratio(t):
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    shrunk = F.when(F.col("month") < F.lit("1996-01-01").cast("date"), 0.0).otherwise(z("contraction_mrr"))
    r, endless, status = V.quick_ratio(z("sm_spend"), z("expansion_mrr"), z("churned_mrr"), shrunk)
    return monthly_book(t).select("o_orderpriority", "month", r.alias("ratio"), endless.alias("endless"), status.alias("status"))


GTM_IN = {
    "net_new_arr": "(mrr - mrr_last) * 12", "sm_spend": "mrr_last * 0.3", "arpa_monthly": "mrr / customers", "gross_margin_pct": "70.0", "churn_pct": "churned * 100.0 / customers / 10", "cac": "mrr * 2 / customers",
    "net_burn": "mrr * 0.2", "growth_pct": "(mrr - mrr_last) * 100.0 / mrr_last", "fcf_margin_pct": "10.0", "begin_arr": "mrr_last * 12", "expansion": "coalesce(expansion_mrr, 0) * 12", "contraction": "coalesce(contraction_mrr, 0) * 6", "churned_arr": "coalesce(churned_mrr, 0) * 6",
}


@query(
    "gtm_metrics",
    f"""WITH {BOOK}, i AS (SELECT o_orderpriority, month, {', '.join(f'({e})::DOUBLE AS {k}' for k, e in GTM_IN.items())} FROM b WHERE mrr_last > 0),
    v AS (SELECT o_orderpriority, month, net_new_arr / sm_spend AS magic_number, CASE WHEN churn_pct = 0 THEN 0 ELSE arpa_monthly * 12 * 0.7 / (churn_pct / 100) / cac END AS ltv_cac_ratio, cac / (arpa_monthly * 0.7) AS cac_payback_months,
      CASE WHEN net_new_arr = 0 THEN 0 ELSE net_burn / net_new_arr END AS burn_multiple, growth_pct + fcf_margin_pct AS rule_of_40, (begin_arr + expansion - contraction - churned_arr) / begin_arr * 100 AS ndr_pct FROM i)
    SELECT *, CASE WHEN magic_number >= 0.75 THEN 'Green' WHEN magic_number >= 0.5 THEN 'Yellow' ELSE 'Red' END AS magic_number_rating, CASE WHEN burn_multiple <= 2 THEN 'Green' WHEN burn_multiple <= 4 THEN 'Yellow' ELSE 'Red' END AS burn_multiple_rating,
      CASE WHEN ndr_pct >= 110 THEN 'Green' WHEN ndr_pct >= 100 THEN 'Yellow' ELSE 'Red' END AS ndr_pct_rating FROM v""",
    digits="magic_number ltv_cac_ratio cac_payback_months burn_multiple:2 rule_of_40 ndr_pct",
)
def gtm_metrics(t):
    rows = monthly_book(t).where("mrr_last > 0").select("o_orderpriority", "month", *[F.expr(e).cast("double").alias(k) for k, e in GTM_IN.items()])
    out = V.gtm_metrics(rows.withColumnRenamed("churned_arr", "churned"))
    return out.select("o_orderpriority", "month", *V.GTM_BOUNDS, "magic_number_rating", "burn_multiple_rating", "ndr_pct_rating")


def budget(t):
    """Monthly lines by priority: the year before as budget and prior year; urgent and high lines are revenue."""
    from pyspark.sql import Window

    m = t.orders.groupBy("o_orderpriority", F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.sum("o_totalprice").alias("actual"))
    prior = F.lag("actual", 12).over(Window.partitionBy("o_orderpriority").orderBy("month"))
    kind = F.when(F.col("o_orderpriority") < "3", "revenue").otherwise("expense")
    return m.withColumn("prior_year", prior).where("prior_year IS NOT NULL").withColumn("budget", F.col("prior_year") * 1.05).withColumn("type", kind).withColumn("department", F.quarter("month").cast("string")).withColumn("category", F.col("o_orderpriority"))


BUDGET = """
    m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS actual FROM orders GROUP BY ALL),
    p AS (SELECT *, lag(actual, 12) OVER (PARTITION BY o_orderpriority ORDER BY month) AS prior_year FROM m),
    v AS (SELECT *, prior_year * 1.05 AS budget, actual - prior_year * 1.05 AS variance, (actual - prior_year * 1.05) / (prior_year * 1.05) * 100 AS variance_pct, actual - prior_year AS prior_variance, (actual - prior_year) / prior_year * 100 AS prior_variance_pct,
      CASE WHEN (o_orderpriority < '3' AND actual > prior_year * 1.05) OR (o_orderpriority >= '3' AND actual < prior_year * 1.05) THEN 'Favorable' ELSE 'Unfavorable' END AS favorability FROM p WHERE prior_year IS NOT NULL)
"""


@query(
    "budget_variance",
    f"WITH {BUDGET} SELECT o_orderpriority, strftime(month, '%Y-%m-%d') AS month, variance, variance_pct, prior_variance, prior_variance_pct, favorability, abs(variance_pct) >= 10 OR abs(variance) >= 50000 AS is_material FROM v",
    digits="variance:2 variance_pct prior_variance:2 prior_variance_pct",
)
def budget_variance(t):
    return V.budget_variance(budget(t)).select("o_orderpriority", "month", "variance", "variance_pct", "prior_variance", "prior_variance_pct", "favorability", "is_material")


@query(
    "variance_rollup",
    f"WITH {BUDGET}, d AS (SELECT *, quarter(month)::VARCHAR AS department, o_orderpriority AS category FROM v) "
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS name, sum(actual) AS total_actual, sum(budget) AS total_budget, sum(variance) AS total_variance, count(*) FILTER (WHERE favorability = 'Favorable') AS favorable, count(*) FILTER (WHERE favorability <> 'Favorable') AS unfavorable, sum(variance) / sum(budget) * 100 AS variance_pct FROM d GROUP BY 2"
        for d in ("department", "category")
    ),
    digits="total_actual:1 total_budget:1 total_variance:1 variance_pct",
)
def variance_rollup(t):
    return V.variance_rollup(V.budget_variance(budget(t)), ["department", "category"])


STATEMENT = {
    "revenue": "sum(l_extendedprice)", "cogs": "sum(l_extendedprice) * 0.6", "operating_income": "sum(l_extendedprice * l_discount)", "net_income": "sum(l_extendedprice * l_tax)", "ebitda": "sum(l_extendedprice * l_discount) * 1.2", "interest": "sum(l_quantity) * 10.0",
    "assets": "sum(l_extendedprice) * 1.5", "equity": "sum(l_extendedprice) * 0.7", "debt": "sum(l_extendedprice) * 0.3", "current_assets": "sum(l_extendedprice) * 0.5", "inventory": "sum(l_quantity) * 300.0", "cash": "sum(l_quantity) * 100.0",
    "receivables": "sum(l_extendedprice) * 0.1", "current_liabilities": "sum(l_extendedprice) * 0.25", "operating_cash": "sum(l_extendedprice * l_discount) * 1.1", "debt_service": "sum(l_quantity) * 20.0", "share_price": "avg(l_extendedprice) / 1000", "shares": "count(*) * 1000.0", "market_cap": "0.0", "growth": "avg(l_tax) * 2",
}


@query(
    "financial_ratios",
    f"""WITH s AS (SELECT l_suppkey, {', '.join(f'({e})::DOUBLE AS {k}' for k, e in STATEMENT.items())} FROM lineitem GROUP BY 1), c AS (SELECT *, share_price * shares AS cap, share_price / (net_income / shares) AS pe FROM s)
    SELECT l_suppkey, net_income / equity AS roe, net_income / assets AS roa, (revenue - cogs) / revenue AS gross_margin, operating_income / revenue AS operating_margin, net_income / revenue AS net_margin, current_assets / current_liabilities AS current_ratio,
      (current_assets - inventory) / current_liabilities AS quick_ratio, cash / current_liabilities AS cash_ratio, debt / equity AS debt_to_equity, operating_income / interest AS interest_coverage, operating_cash / debt_service AS dscr, revenue / assets AS asset_turnover,
      cogs / inventory AS inventory_turnover, revenue / receivables AS receivables_turnover, 365 / (revenue / receivables) AS days_sales, pe, share_price / (equity / shares) AS pb, cap / revenue AS ps, (cap + debt - cash) / ebitda AS ev_ebitda, pe / (growth * 100) AS peg FROM c""",
    digits=" ".join(f"{k}:6" for k in "roe roa gross_margin operating_margin net_margin current_ratio quick_ratio cash_ratio debt_to_equity interest_coverage dscr asset_turnover inventory_turnover receivables_turnover days_sales pe pb ps ev_ebitda peg".split()),
)
def financial_ratios(t):
    """Suppliers as companies with statements from their lines."""
    s = t.lineitem.groupBy("l_suppkey").agg(*[F.expr(e).cast("double").alias(k) for k, e in STATEMENT.items()])
    return V.financial_ratios(s).drop(*STATEMENT)


@query(
    "compa_ratio",
    """
    WITH b AS (SELECT c_mktsegment, avg(c_acctbal + 2000) AS mid FROM customer GROUP BY 1), p AS (SELECT c_custkey, c_acctbal + 2000 AS s, mid * 0.8 AS lo, mid, mid * 1.2 AS hi, c_custkey % 5 + 1 AS rating FROM customer JOIN b USING (c_mktsegment)), r AS (SELECT *, s / mid AS cr FROM p)
    SELECT c_custkey, cr AS compa_ratio, (s - lo) / (hi - lo) AS band_position, CASE WHEN cr < 0.85 THEN 'below band' WHEN cr < 0.95 THEN 'developing' WHEN cr <= 1.05 THEN 'target zone' WHEN cr <= 1.15 THEN 'senior in role' ELSE 'above band' END AS bucket,
      concat_ws(',', CASE WHEN s < lo THEN 'below minimum' WHEN cr < 0.88 THEN 'far below middle' WHEN cr < 0.93 THEN 'below target' END, CASE WHEN s > hi THEN 'above maximum' END, CASE WHEN rating >= 4 AND cr < 0.95 THEN 'underpaid performer' END) AS flags FROM r
    """,
    digits="compa_ratio:6 band_position:6",
)
def compa_ratio(t):
    salary = F.col("c_acctbal") + 2000
    b = t.customer.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.avg(salary).alias("band_mid"))
    j = t.customer.join(b, F.col("c_mktsegment") == F.col("seg"))
    rows = j.select("c_custkey", salary.alias("salary"), (F.col("band_mid") * 0.8).alias("band_min"), "band_mid", (F.col("band_mid") * 1.2).alias("band_max"), (F.col("c_custkey") % 5 + 1).alias("rating"))
    return V.compa_ratio(rows).select("c_custkey", "compa_ratio", "band_position", "bucket", "flags")
