"""Product and marketing analytics on the test tables."""

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import product as P
from millrace.plans.registry import query
from millrace.plans.sets import ALNUM

STAGES = ["view", "click", "signup", "purchase"]


@query(
    "retention_curve",
    """
    WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), f AS (SELECT user_id, min(day) AS first FROM d GROUP BY 1),
    a AS (SELECT day - first AS period, count(DISTINCT user_id) AS n FROM d JOIN f USING (user_id) GROUP BY 1)
    SELECT period, coalesce(n, 0) AS active_users, coalesce(n, 0) / (SELECT count(*) FROM f) AS retention_rate FROM range(0, 29) r(period) LEFT JOIN a USING (period)
    """,
    digits="retention_rate:6",
)
def retention_curve(t):
    return P.retention_curve(t.events, "user_id", "ts", 28)


@query(
    "cohort_matrix",
    """
    WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
    f AS (SELECT user_id, min(day) AS first, isoyear(min(day)) || '-W' || lpad(weekofyear(min(day))::VARCHAR, 2, '0') AS cohort FROM d GROUP BY 1),
    s AS (SELECT cohort, count(*) AS cohort_size FROM f GROUP BY 1), a AS (SELECT cohort, day - first AS age_days, count(DISTINCT user_id) AS n FROM d JOIN f USING (user_id) GROUP BY ALL)
    SELECT cohort, age_days, coalesce(n, 0) AS active_users, cohort_size, coalesce(n, 0) / cohort_size AS retention_rate FROM s CROSS JOIN range(0, 15) r(age_days) LEFT JOIN a USING (cohort, age_days)
    """,
    digits="retention_rate:6",
)
def cohort_matrix(t):
    return P.cohort_matrix(t.events, "user_id", "ts", 14)


@query(
    "stage_funnel",
    """
    WITH s AS (SELECT unnest(['view', 'click', 'signup', 'purchase']) AS stage, unnest([0, 1, 2, 3]) AS pos),
    c AS (SELECT event_type AS stage, count(DISTINCT user_id) AS users FROM events GROUP BY 1), j AS (SELECT pos, stage, coalesce(users, 0) AS users FROM s LEFT JOIN c USING (stage))
    SELECT stage, users, CASE WHEN lag(users) OVER (ORDER BY pos) > 0 THEN users / lag(users) OVER (ORDER BY pos) ELSE 1 END AS conversion_from_previous,
      CASE WHEN first(users) OVER (ORDER BY pos) > 0 THEN users / first(users) OVER (ORDER BY pos) ELSE 0 END AS conversion_from_first FROM j
    """,
    digits="conversion_from_previous:6 conversion_from_first:6",
)
def stage_funnel(t):
    return P.stage_funnel(P.stage_counts(t.events, "user_id", "event_type", STAGES))


LIMITS = {"view landing": ("view", 0), "click cta": ("click", 60), "fill form": ("signup", 90), "email verified": ("purchase", 110), "done": ("purchase", 160)}


def steps(t, *keys):
    """Named steps: an event type above a value, so that counts fall along the funnel."""
    reached = [F.when((F.col("event_type") == kind) & (F.col("value") > low), F.lit(name)) for name, (kind, low) in LIMITS.items()]
    named = t.events.select("user_id", F.explode(F.array_compact(F.array(*reached))).alias("step"))
    if keys:
        seg = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
        named = named.join(seg, "user_id")
    return P.stage_counts(named, "user_id", "step", list(LIMITS), list(keys))


CASES = " UNION ALL ".join(f"SELECT user_id, '{n}' AS stage, {i} AS pos FROM events WHERE event_type = '{k}' AND value > {v}" for i, (n, (k, v)) in enumerate(LIMITS.items()))
NAMES = "unnest(['" + "', '".join(LIMITS) + "'])"
STEPS = f"""
    u AS ({CASES}), s AS (SELECT {NAMES} AS stage, unnest([0, 1, 2, 3, 4]) AS pos), n AS (SELECT stage, count(DISTINCT user_id) AS users FROM u GROUP BY 1),
    c AS (SELECT pos, stage, coalesce(users, 0) AS users FROM s LEFT JOIN n USING (stage)),
    l AS (SELECT *, lag(users) OVER (ORDER BY pos) AS before, first(users) OVER (ORDER BY pos) AS first FROM c)
"""


@query(
    "count_funnel",
    f"""
    WITH {STEPS}, m AS (SELECT pos, stage, users, users / first * 100 AS cumulative_conversion, CASE WHEN before IS NULL THEN 100 WHEN before = 0 THEN 0 ELSE users / before * 100 END AS conversion_rate, coalesce(before - users, 0) AS dropoff FROM l),
    d AS (SELECT *, CASE WHEN pos = 0 THEN 0 ELSE 100 - conversion_rate END AS dropoff_rate FROM m)
    SELECT *, dropoff > 0 AND row_number() OVER (ORDER BY dropoff DESC, pos) = 1 AS bottleneck_absolute, dropoff_rate > 0 AND row_number() OVER (ORDER BY dropoff_rate DESC, pos) = 1 AS bottleneck_relative FROM d
    """,
    digits="cumulative_conversion conversion_rate dropoff_rate",
)
def count_funnel(t):
    return P.count_funnel(steps(t))


@query(
    "segment_funnel",
    f"""
    WITH u AS ({CASES}), x AS (SELECT c_mktsegment AS segment, pos, count(DISTINCT user_id) AS users FROM u JOIN customer ON c_custkey = user_id GROUP BY ALL),
    e AS (SELECT segment, coalesce(max(users) FILTER (WHERE pos = 0), 0) AS total_entries, coalesce(max(users) FILTER (WHERE pos = 4), 0) AS total_conversions FROM x GROUP BY 1),
    o AS (SELECT *, CASE WHEN total_entries > 0 THEN total_conversions / total_entries * 100 ELSE 0 END AS overall_conversion FROM e)
    SELECT *, row_number() OVER (ORDER BY overall_conversion DESC, segment)::INT AS rank FROM o
    """,
    digits="overall_conversion",
)
def segment_funnel(t):
    return P.segment_funnel(steps(t, "segment"), "segment")


@query(
    "activation_funnel",
    f"""
    WITH {STEPS}, d AS (SELECT *, CASE WHEN before > 0 THEN (before - users) / before ELSE 0 END AS drop FROM l), w AS (SELECT * FROM d ORDER BY drop DESC, pos LIMIT 1),
    a AS (SELECT max(users) FILTER (WHERE pos = 0) AS "start", max(users) FILTER (WHERE pos = 4) AS activated FROM c),
    v AS (SELECT "start", activated, activated / "start" * 100 AS overall_conversion, stage AS worst_step, drop * 100 AS worst_drop_rate, floor(before * round_even(drop * 100, 1) / 200)::BIGINT AS users_saved, users FROM a, w)
    SELECT "start", activated, overall_conversion, worst_step, worst_drop_rate, users_saved, CASE WHEN users > 0 THEN floor(users_saved * activated / users)::BIGINT ELSE 0 END AS additional_activated,
      CASE WHEN overall_conversion < 5 THEN floor(overall_conversion * 10) ELSE least(100, floor(overall_conversion * 5)) END::BIGINT AS score FROM v
    """,
    digits="overall_conversion worst_drop_rate",
)
def activation_funnel(t):
    return P.activation_funnel(steps(t))


@query(
    "step_drop_rules",
    f"""
    WITH {STEPS}, d AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN before = 0 THEN 1 ELSE 1 - users / before END AS drop FROM l),
    sc AS (SELECT greatest(0, round_even(least(100, ln(1 + max(users) FILTER (WHERE pos = 4) / max(users) FILTER (WHERE pos = 0)) / ln(1.1) * 100) - sum(CASE WHEN drop > 0.6 THEN 10 WHEN drop > 0.4 THEN 5 ELSE 0 END), 0))::BIGINT AS score FROM d)
    SELECT stage, users, drop * 100 AS drop_pct, CASE pos WHEN 0 THEN 'landing_page' WHEN 1 THEN 'clicked_sign_up' WHEN 2 THEN 'filled_form' WHEN 3 THEN 'email_verified' ELSE 'default' END AS step_class,
      CASE WHEN drop > 0.5 THEN 'high_drop' WHEN drop > 0.25 THEN 'medium_drop' ELSE 'healthy' END AS drop_level, score,
      CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' WHEN score >= 20 THEN 'Poor' ELSE 'Critical' END AS label FROM d, sc
    """,
    digits="drop_pct",
)
def step_drop_rules(t):
    return P.step_drop_rules(steps(t))


def touches(t):
    return t.events.select("user_id", "event_type", "ts", "event_id", "value")


def journeys(t):
    bought = F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), F.col("value"))
    return P.journeys(touches(t), "user_id", "event_type", "ts", "event_id", bought, (F.col("event_type") == "purchase") & (F.col("value") > 60))


J = """
    j AS (SELECT user_id, count(*) AS touches, arg_min(event_type, (ts, event_id)) AS first_channel, arg_max(event_type, (ts, event_id)) AS last_channel, max(ts) AS last_ts,
      sum(value) FILTER (WHERE event_type = 'purchase' AND value > 60) AS revenue, bool_or(event_type = 'purchase' AND value > 60) AS converted FROM events GROUP BY 1),
    e AS (SELECT event_type AS channel, ts, event_id, revenue, touches, last_ts, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events JOIN j USING (user_id) WHERE converted)
"""


@query(
    "touch_first_last",
    f"""WITH {J}, f AS (SELECT first_channel AS channel, sum(revenue) AS first_credit FROM j WHERE converted GROUP BY 1), l AS (SELECT last_channel AS channel, sum(revenue) AS last_credit FROM j WHERE converted GROUP BY 1)
    SELECT * FROM f FULL JOIN l USING (channel)""",
    digits="first_credit last_credit",
)
def touch_first_last(t):
    j = journeys(t)
    first = P.touch_edge(j, "first").withColumnRenamed("credit", "first_credit")
    return first.join(P.touch_edge(j, "last").withColumnRenamed("credit", "last_credit"), "channel", "full")


@query("touch_linear", f"WITH {J} SELECT channel, sum(revenue / touches) AS credit FROM e GROUP BY 1", digits="credit")
def touch_linear(t):
    return P.touch_linear(touches(t), journeys(t), "user_id", "event_type")


DECAY = """
    w AS (SELECT channel, revenue, exp(-ln(2) / 7 * date_diff('microsecond', ts, last_ts) / 86400000000.0) AS w, user_id FROM e),
    s AS (SELECT channel, revenue * w / sum(w) OVER (PARTITION BY user_id) AS c FROM w)
"""


@query("touch_time_decay", f"WITH {J}, {DECAY} SELECT channel, sum(c) AS credit FROM s GROUP BY 1", digits="credit")
def touch_time_decay(t):
    return P.touch_time_decay(touches(t), journeys(t), "user_id", "event_type", "ts")


POSITION = "CASE WHEN touches = 1 THEN 1 WHEN touches = 2 THEN 0.5 WHEN i = 1 OR i = touches THEN 0.4 ELSE 0.2 / (touches - 2) END"


@query("touch_position", f"WITH {J} SELECT channel, sum(revenue * {POSITION}) AS credit FROM e GROUP BY 1", digits="credit")
def touch_position(t):
    return P.touch_position(touches(t), journeys(t), "user_id", "event_type")


@query(
    "metric_dispatch",
    f"""WITH {J}, {DECAY} SELECT 'first-touch' AS model, first_channel AS channel, sum(revenue) AS credit FROM j WHERE converted GROUP BY 2
    UNION ALL SELECT 'last-touch', last_channel, sum(revenue) FROM j WHERE converted GROUP BY 2 UNION ALL SELECT 'linear', channel, sum(revenue / touches) FROM e GROUP BY 2
    UNION ALL SELECT 'time-decay', channel, sum(c) FROM s GROUP BY 2 UNION ALL SELECT 'position-based', channel, sum(revenue * {POSITION}) FROM e GROUP BY 2""",
    digits="credit",
)
def metric_dispatch(t):
    out = None
    for name in P.MODELS:
        part = P.run_model(name, touches(t), journeys(t), "user_id", "event_type", "ts").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "journey_summary",
    f"WITH {J} SELECT count(*) AS total_journeys, count(*) FILTER (WHERE converted) AS converted_journeys, sum(revenue) AS total_revenue, count(*) FILTER (WHERE converted) / count(*) * 100 AS conversion_rate, 'click,error,purchase,signup,view' AS channels FROM j",
    digits="total_revenue:2 conversion_rate",
)
def journey_summary(t):
    return P.journey_summary(touches(t), journeys(t), "event_type")


CHANNELS = ["email", "paid_search", "paid_social", "display", "organic_search", "organic_social", "referral", "direct", "billboard"]


def campaigns(t):
    """Suppliers as campaigns, channel by nation; measures from their lines."""
    chan = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("s_nationkey") % 9 + 1).cast("int"))
    price = F.col("l_extendedprice")
    lines = t.lineitem.groupBy("l_suppkey").agg(
        F.sum(price * F.col("l_tax")).alias("spend"), F.sum(price * F.col("l_discount") * 3).alias("revenue"), F.sum(F.col("l_quantity") * 400).alias("impressions"),
        F.sum("l_quantity").alias("clicks"), F.count_if(F.col("l_returnflag") != "N").alias("leads"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("customers"),
    )
    return t.supplier.select("s_suppkey", chan.alias("channel")).join(lines, F.col("s_suppkey") == F.col("l_suppkey")).drop("l_suppkey")


CAMP = f"""
    l AS (SELECT l_suppkey, sum(l_extendedprice * l_tax) AS spend, sum(l_extendedprice * l_discount * 3) AS revenue, sum(l_quantity * 400) AS impressions, sum(l_quantity) AS clicks,
      count(*) FILTER (WHERE l_returnflag <> 'N') AS leads, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS customers FROM lineitem GROUP BY 1),
    c AS (SELECT s_suppkey, {CHANNELS}[s_nationkey % 9 + 1] AS channel, l.* EXCLUDE (l_suppkey) FROM supplier JOIN l ON l_suppkey = s_suppkey),
    m AS (SELECT *, revenue - spend AS profit, CASE WHEN spend <> 0 THEN (revenue - spend) / spend * 100 ELSE 0 END AS roi, CASE WHEN spend <> 0 THEN revenue / spend ELSE 0 END AS roas, CASE WHEN customers > 0 THEN spend / customers END AS cpa,
      CASE WHEN leads > 0 THEN spend / leads END AS cpl, CASE WHEN impressions > 0 THEN clicks / impressions * 100 END AS ctr, CASE WHEN leads > 0 THEN customers / leads * 100 END AS cvr,
      CASE WHEN clicks > 0 THEN spend / clicks END AS cpc, CASE WHEN impressions > 0 THEN spend / impressions * 1000 END AS cpm, CASE WHEN clicks > 0 THEN leads / clicks * 100 END AS lead_rate FROM c)
"""


@query("campaign_metrics", f"WITH {CAMP} SELECT * FROM m", digits="spend:2 revenue:2 impressions clicks profit:2 roi roas cpa cpl ctr cvr cpc cpm lead_rate")
def campaign_metrics(t):
    return P.campaign_metrics(campaigns(t))


def _bench_values():
    return ", ".join(f"('{m}', '{c}', {v[0]}, {v[1]}, {v[2]})" for m, d in P.BENCHMARKS.items() for c, v in d.items())


@query(
    "benchmark_assess",
    f"""
    WITH {CAMP}, b(metric, bench, low, target, high) AS (VALUES {_bench_values()}),
    v AS (SELECT s_suppkey, CASE WHEN channel = 'billboard' THEN 'default' ELSE channel END AS bench, unnest(['ctr', 'roas', 'cpa']) AS metric, unnest([ctr, roas, cpa]) AS value FROM m)
    SELECT s_suppkey, metric, value, CASE WHEN metric = 'cpa' THEN CASE WHEN value <= low THEN 'excellent' WHEN value <= target THEN 'good' WHEN value <= high THEN 'below_target' ELSE 'underperforming' END
      WHEN value >= high THEN 'excellent' WHEN value >= target THEN 'good' WHEN value >= low THEN 'below_target' ELSE 'underperforming' END AS assessment
    FROM v JOIN b USING (metric, bench) WHERE value IS NOT NULL AND (metric <> 'roas' OR value > 0)
    """,
    digits="value",
)
def benchmark_assess(t):
    return P.benchmark_assess(P.campaign_metrics(campaigns(t)), "channel").select("s_suppkey", "metric", "value", "assessment")


@query(
    "channel_cac",
    """
    WITH c AS (SELECT o_orderpriority AS channel, sum(o_totalprice / 1000) AS spend, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1),
    u AS (SELECT * FROM c UNION ALL SELECT 'blended', sum(spend), sum(customers)::BIGINT FROM c) SELECT *, spend / customers AS cac FROM u
    """,
    digits="spend cac",
)
def channel_cac(t):
    return P.channel_cac(t.orders, "o_orderpriority", F.col("o_totalprice") / 1000, "o_custkey")


@query(
    "engagement_rate",
    """
    SELECT user_id, CASE WHEN sum(value) = 0 THEN 0 ELSE (count(*) FILTER (WHERE event_type = 'click') + count(*) FILTER (WHERE event_type = 'signup') + count(*) FILTER (WHERE event_type = 'view')
      + count(*) FILTER (WHERE event_type = 'purchase')) / sum(value) * 100 END AS rate FROM events GROUP BY 1
    """,
    digits="rate",
)
def engagement_rate(t):
    counts = [F.count_if(F.col("event_type") == k) for k in ("click", "signup", "view", "purchase")]
    return t.events.groupBy("user_id").agg(P.engagement_rate(counts, F.sum("value")).alias("rate"))


def snapshots(t):
    """Cumulative events by type and day."""
    from pyspark.sql import Window

    d = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("rate"))
    return d.withColumn("size", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")))


SNAP = """
    d AS (SELECT event_type, ts::DATE AS day, count(*) AS n, avg(value) AS rate FROM events GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY day)::BIGINT AS size, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS k FROM d),
    g AS (SELECT event_type, count(*) AS data_points, arg_min(size, day) AS first, arg_max(size, day) AS last, greatest(max(day) - min(day), 1)::INT AS days, avg(rate) FILTER (WHERE i <= k // 2) AS early, avg(rate) FILTER (WHERE i > k // 2) AS late FROM s GROUP BY 1),
    r AS (SELECT event_type, data_points, last, days, (last - first) / days AS daily_growth, (last - first) / days * 7 AS weekly_growth, (last - first) / days * 30 AS monthly_projection,
      (last - first) / first * 100 AS growth_percent, CASE WHEN late > early THEN 'improving' ELSE 'declining' END AS engagement_trend FROM g)
"""


@query("growth_snapshot", f"WITH {SNAP} SELECT * FROM r", digits="daily_growth weekly_growth monthly_projection growth_percent")
def growth_snapshot(t):
    return P.growth_snapshot(snapshots(t), ["event_type"], "day", "size", "rate")


@query(
    "milestone_eta",
    f"WITH {SNAP} SELECT event_type, CASE WHEN last >= 2010 THEN 'reached' WHEN daily_growth <= 0 THEN 'not growing' ELSE 'projected' END AS status, CASE WHEN last < 2010 AND daily_growth > 0 THEN (2010 - last) / daily_growth END AS days_needed FROM r",
    digits="days_needed",
)
def milestone_eta(t):
    return P.milestone_eta(P.growth_snapshot(snapshots(t), ["event_type"], "day", "size", "rate"), ["event_type"], 2010)


@query(
    "keyword_scores",
    f"""
    WITH w AS (SELECT doc_id, lang, unnest({ALNUM}) AS term FROM documents),
    k AS (SELECT term, count(*) * 50 AS volume, count(DISTINCT doc_id) * 20 AS competing, avg((lang = 'en')::INT) AS relevance FROM w GROUP BY 1)
    SELECT *, CASE WHEN competing < 1000 THEN 'low' WHEN competing < 5000 THEN 'medium' WHEN competing < 10000 THEN 'high' ELSE 'very_high' END AS competition_level,
      CASE WHEN volume < 1000 THEN 'very_low' WHEN volume < 5000 THEN 'low' WHEN volume < 20000 THEN 'medium' WHEN volume < 100000 THEN 'high' ELSE 'very_high' END AS volume_category,
      (least(competing / 50000, 1) * 0.7 + least(volume / 1000000, 1) * 0.3) * 100 AS difficulty, least(100, least(volume / 100000 * 40, 40) + greatest(30 - competing / 500, 0) + relevance * 30) AS potential FROM k
    """,
    digits="relevance:6 difficulty:6 potential:6",
)
def keyword_scores(t):
    w = t.documents.select("doc_id", "lang", F.explode(X.tokens("text", "alnum")).alias("term"))
    k = w.groupBy("term").agg((F.count(F.lit(1)) * 50).alias("volume"), (F.countDistinct("doc_id") * 20).alias("competing"), F.avg((F.col("lang") == "en").cast("int")).alias("relevance"))
    return P.keyword_scores(k, "volume", "competing", "relevance")


def _pick(col, names):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (col % len(names) + 1).cast("int"))


@query(
    "rice_rank",
    """
    WITH f AS (SELECT p_partkey, p_retailprice AS reach, ['massive', 'high', 'medium', 'low', 'minimal', 'odd'][p_size % 6 + 1] AS impact, ['high', 'medium', 'low'][p_partkey % 3 + 1] AS confidence, ['xl', 'l', 'm', 's', 'xs'][p_partkey % 5 + 1] AS effort FROM part),
    s AS (SELECT *, reach * CASE impact WHEN 'massive' THEN 3 WHEN 'high' THEN 2 WHEN 'low' THEN 0.5 WHEN 'minimal' THEN 0.25 ELSE 1 END * CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 0.8 ELSE 0.5 END
      / CASE effort WHEN 'xl' THEN 13 WHEN 'l' THEN 8 WHEN 'm' THEN 5 WHEN 's' THEN 3 ELSE 1 END AS score FROM f),
    r AS (SELECT *, round(score, 2) AS rs FROM s)
    SELECT p_partkey, score, rank() OVER (ORDER BY rs DESC) AS rank, CASE WHEN impact IN ('massive', 'high') AND effort IN ('xs', 's') THEN 'quick_win' WHEN impact IN ('massive', 'high') AND effort IN ('l', 'xl') THEN 'big_bet' ELSE 'other' END AS kind FROM r
    """,
    digits="score",
)
def rice_rank(t):
    from millrace.operators.ordered import ranked

    f = t.part.select(
        "p_partkey", F.col("p_retailprice").alias("reach"), _pick(F.col("p_size"), ["massive", "high", "medium", "low", "minimal", "odd"]).alias("impact"),
        _pick(F.col("p_partkey"), ["high", "medium", "low"]).alias("confidence"), _pick(F.col("p_partkey"), ["xl", "l", "m", "s", "xs"]).alias("effort"),
    )
    s = f.withColumn("score", P.rice_score(F.col("reach"), F.col("impact"), F.col("confidence"), F.col("effort"))).withColumn("rs", F.round("score", 2))
    s = s.withColumn("kind", P.rice_kind(F.col("impact"), F.col("effort")))
    return ranked(s, [], "rs", rank="rank").select("p_partkey", "score", "rank", "kind")


@query(
    "priority_frameworks",
    """
    WITH p AS (SELECT p_partkey, (p_partkey % 10 + 1)::DOUBLE AS cu, (p_size % 10 + 1)::DOUBLE AS re, (p_partkey % 7 + 1)::DOUBLE AS qu, (p_size % 5 + 1)::DOUBLE AS ve, (p_partkey % 4 + 1)::DOUBLE AS se,
      p_retailprice / 20 AS hours, 1.2::DOUBLE AS risk, (p_size % 13)::DOUBLE AS points, 0.8::DOUBLE AS conf, p_size / 30.0 AS daily, p_retailprice / 15 AS delay FROM part)
    SELECT p_partkey, ((cu * 0.3 + re * 0.3 + qu * 0.2 + ve * 0.2) * 0.3 + least(10, greatest(1, daily * 10)) * 0.3 + (se * 0.6 + qu * 0.4) * 0.2 + ve * 0.2) / greatest(1, hours * risk / 8) AS cost_of_delay_score,
      (cu * 0.4 + re * 0.6 + least(10, greatest(1, delay / 10)) + se * 0.5 + qu * 0.5) / greatest(1, points) AS wsjf_score,
      least(10, 6 * ve / 5) * (cu * 0.3 + re * 0.3 + qu * 0.4) * conf * 10 / greatest(1, points) AS rice_score FROM p
    """,
    digits="cost_of_delay_score:6 wsjf_score:6 rice_score:6",
)
def priority_frameworks(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    i = {"customer": k % 10 + 1.0, "revenue": s % 10 + 1.0, "quality": k % 7 + 1.0, "velocity": s % 5 + 1.0, "security": k % 4 + 1.0}
    e = {"hours": F.col("p_retailprice") / 20, "risk": F.lit(1.2), "points": s % 13, "confidence": F.lit(0.8)}
    out = P.priority_frameworks(t.part, i, e, s / 30.0, F.col("p_retailprice") / 15, 6)
    return out.select("p_partkey", "cost_of_delay_score", "wsjf_score", "rice_score")


@query(
    "bcg_quadrant",
    """
    WITH b AS (SELECT p_brand, sum(l_extendedprice) FILTER (WHERE year(l_shipdate) = 1999) AS revenue, sum(l_extendedprice) FILTER (WHERE year(l_shipdate) = 1998) AS before FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
    g AS (SELECT p_brand, revenue, (revenue - before) / before * 100 AS growth_pct, (SELECT max(x.revenue) FROM b x WHERE x.p_brand <> b.p_brand) AS other, (SELECT sum(revenue) FROM b) AS total FROM b)
    SELECT p_brand, revenue, growth_pct, revenue / other AS share_ratio, CASE WHEN growth_pct >= 10 AND revenue / other >= 1 THEN 'Star' WHEN revenue / other >= 1 THEN 'Cash Cow' WHEN growth_pct >= 10 THEN 'Question Mark' ELSE 'Dog' END AS quadrant,
      revenue / total AS revenue_share FROM g
    """,
    digits="revenue:1 growth_pct share_ratio:6 revenue_share:6",
)
def bcg_quadrant(t):
    y, p = F.year("l_shipdate"), F.col("l_extendedprice")
    j = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    b = j.groupBy("p_brand").agg(F.sum(F.when(y == 1999, p)).alias("revenue"), F.sum(F.when(y == 1998, p)).alias("before"))
    b = b.select("p_brand", "revenue", ((F.col("revenue") - F.col("before")) / F.col("before") * 100).alias("growth_pct"))
    return P.bcg_quadrant(b, "p_brand", "revenue", "growth_pct")
