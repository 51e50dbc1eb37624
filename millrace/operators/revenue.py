"""Customer health, churn, expansion, recurring revenue, pipeline and finance tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import numeric as N

# Health benchmarks and colour bounds by segment.
HEALTH_BENCHMARKS = {
    "enterprise": dict(login=90, adoption=80, dau_mau=0.50, tickets=5, attendance=95, nps=9, csat=4.5, open=10, escalation=0.25, hours=72, sponsor=90, threads=5, green=75, yellow=50),
    "mid-market": dict(login=80, adoption=70, dau_mau=0.40, tickets=8, attendance=85, nps=8, csat=4.0, open=15, escalation=0.30, hours=96, sponsor=75, threads=3, green=70, yellow=45),
    "smb": dict(login=70, adoption=60, dau_mau=0.30, tickets=10, attendance=75, nps=7, csat=3.8, open=20, escalation=0.40, hours=120, sponsor=60, threads=2, green=65, yellow=40),
}
SENTIMENT = {"positive": 100.0, "neutral": 60.0, "negative": 20.0, "unknown": 50.0}
HEALTH_WEIGHTS = {"usage": 0.30, "engagement": 0.25, "support": 0.20, "relationship": 0.25}
# Churn signal weights and satisfaction scores.
RISK_WEIGHTS = {"usage": 0.30, "engagement": 0.25, "support": 0.20, "relationship": 0.15, "commercial": 0.10}
SATISFACTION = {"improving": 10.0, "stable": 30.0, "declining": 70.0, "critical": 95.0}
# Plan multipliers, seat growth, module shares of revenue.
TIER_UPLIFT = {"starter": 1.0, "professional": 1.8, "enterprise": 3.0, "enterprise_plus": 4.5}
SEAT_GROWTH = {"enterprise": 0.25, "mid-market": 0.20, "smb": 0.15}
MODULE_SHARE = {
    "core_platform": 0.00, "analytics_module": 0.15, "integrations_module": 0.12, "api_access": 0.10, "advanced_reporting": 0.18, "security_module": 0.20,
    "automation_module": 0.15, "collaboration_module": 0.10, "data_export": 0.08, "custom_workflows": 0.22, "sso_module": 0.08, "audit_module": 0.10,
}
# Stage probabilities and scenario multipliers of the forecast.
STAGE_PROBABILITY = {
    "discovery": 0.10, "qualification": 0.25, "demo": 0.40, "proposal": 0.55, "poc": 0.65, "negotiation": 0.80, "verbal_commit": 0.92, "closed_won": 1.00, "closed_lost": 0.00,
}
SCENARIOS = {"conservative": 0.85, "base": 1.00, "upside": 1.15}
# Green and yellow bound of the efficiency metrics; the two cost metrics read downwards.
GTM_BOUNDS = {
    "magic_number": (0.75, 0.50), "ltv_cac_ratio": (3.0, 1.0), "cac_payback_months": (18, 24), "burn_multiple": (2.0, 4.0), "rule_of_40": (40, 20), "ndr_pct": (110, 100),
}


def _bench(segment: Column, key: str) -> Column:
    """Benchmark of the segment, mid-market for unknown ones."""
    pairs = [F.lit(x) for s, row in HEALTH_BENCHMARKS.items() for x in (s, float(row[key]))]
    return F.coalesce(F.create_map(*pairs)[F.lower(segment)], F.lit(float(HEALTH_BENCHMARKS["mid-market"][key])))


def _share(value: str, segment: Column, key: str) -> Column:
    return N.clamp(N.safe_divide(F.col(value), _bench(segment, key)) * 100)


def _inverse(value: str, segment: Column, key: str) -> Column:
    return N.clamp((1 - N.safe_divide(F.col(value), _bench(segment, key))) * 100)


def health_score(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Four dimension scores, the weighted total, and its colour.

    Needs the columns login_frequency, feature_adoption, dau_mau_ratio, ticket_volume, meeting_attendance,
    nps, csat, open_tickets, escalation_rate, resolution_hours, sponsor_engagement, threads, sentiment.
    """
    s = F.col(segment)
    usage = _share("login_frequency", s, "login") * 0.35 + _share("feature_adoption", s, "adoption") * 0.40 + _share("dau_mau_ratio", s, "dau_mau") * 0.25
    engagement = (
        _inverse("ticket_volume", s, "tickets") * 0.20 + _share("meeting_attendance", s, "attendance") * 0.30 + _share("nps", s, "nps") * 0.25 + _share("csat", s, "csat") * 0.25
    )
    support = _inverse("open_tickets", s, "open") * 0.35 + _inverse("escalation_rate", s, "escalation") * 0.35 + _inverse("resolution_hours", s, "hours") * 0.30
    relation = _share("sponsor_engagement", s, "sponsor") * 0.35 + _share("threads", s, "threads") * 0.30 + N.level_value("sentiment", SENTIMENT, 50.0) * 0.35
    parts = {"usage": usage, "engagement": engagement, "support": support, "relationship": relation}
    out = df.select("*", *[N.python_round(c, 1).alias(k) for k, c in parts.items()])
    out = out.withColumn("overall", N.python_round(N.weighted_score(HEALTH_WEIGHTS, bound=False), 1))
    colour = F.when(F.col("overall") >= _bench(s, "green"), "green").when(F.col("overall") >= _bench(s, "yellow"), "yellow").otherwise("red")
    return out.withColumn("classification", colour)


def _drop(value: str, scale: float) -> Column:
    return N.clamp(F.abs(F.least(F.col(value), F.lit(0))) * scale)


def _warn(*steps: tuple[Column, str, str]) -> Column:
    """First severity whose test holds, as a struct."""
    out = None
    for test, severity, signal in steps:
        item = F.struct(F.lit(severity).alias("severity"), F.lit(signal).alias("signal"))
        out = F.when(test, item) if out is None else out.when(test, item)
    return out


def churn_risk(df: DataFrame, days_left: str) -> DataFrame:
    """Five weighted signals times the renewal multiplier, tier and warnings.

    A score between two tier bounds (for example 79.5) falls through to ``low``, as the tiers are whole-number ranges.
    """
    c = F.col
    usage = _drop("login_trend", 3.0) * 0.40 + _drop("feature_change", 4.0) * 0.35 + _drop("dau_mau_change", 500) * 0.25
    engagement = N.clamp(c("cancellations") * 25.0) * 0.30 + N.clamp((c("response_days") - 1) * 15.0) * 0.35 + _drop("nps_change", 20.0) * 0.35
    support = N.clamp(c("escalations") * 35.0) * 0.35 + N.clamp(c("critical_open") * 50.0) * 0.35 + N.level_value("satisfaction", SATISFACTION, 30.0) * 0.30
    rivals = F.when(c("competitors") >= 3, 35.0).when(c("competitors") >= 1, c("competitors") * 12.0).otherwise(0.0)
    relation = N.clamp(F.when(c("champion_left"), 45.0).otherwise(0.0) + F.when(c("sponsor_change"), 30.0).otherwise(0.0) + rivals)
    contract = F.when(c("contract_type") == "month-to-month", 30.0).when(c("contract_type") == "quarterly", 15.0).otherwise(0.0)
    money = N.clamp(contract + F.when(c("pricing_complaints"), 35.0).otherwise(0.0) + F.when(c("budget_cuts"), 40.0).otherwise(0.0))
    parts = {"usage": usage, "engagement": engagement, "support": support, "relationship": relation, "commercial": money}
    warnings = [
        _warn((c("login_trend") <= -20, "critical", "login"), (c("login_trend") <= -10, "high", "login"), (c("login_trend") < -5, "medium", "login")),
        _warn((c("feature_change") <= -15, "high", "adoption"), (c("feature_change") < -5, "medium", "adoption")),
        _warn((c("dau_mau_change") <= -0.10, "high", "dau_mau")),
        _warn((c("cancellations") >= 3, "critical", "cancellations"), (c("cancellations") >= 2, "high", "cancellations")),
        _warn((c("response_days") >= 7, "critical", "response"), (c("response_days") >= 4, "high", "response")),
        _warn((c("nps_change") <= -4, "critical", "nps"), (c("nps_change") <= -2, "high", "nps")),
        _warn((c("critical_open") >= 2, "critical", "critical tickets"), (c("critical_open") >= 1, "high", "critical tickets")),
        _warn((c("escalations") >= 2, "high", "escalations"), (c("escalations") >= 1, "medium", "escalations")),
        _warn((c("satisfaction") == "critical", "critical", "satisfaction"), (c("satisfaction") == "declining", "high", "satisfaction")),
        _warn((c("champion_left"), "critical", "champion")),
        _warn((c("sponsor_change"), "high", "sponsor")),
        _warn((c("competitors") >= 3, "critical", "competitors"), (c("competitors") >= 1, "medium", "competitors")),
        _warn((c("contract_type") == "month-to-month", "medium", "contract")),
        _warn((c("pricing_complaints"), "high", "pricing")),
        _warn((c("budget_cuts"), "high", "budget")),
    ]
    out = df.select(
        "*", *[N.python_round(v, 1).alias(k) for k, v in parts.items()], F.filter(F.array(*warnings), lambda w: w.isNotNull()).alias("warnings")
    )
    d = c(days_left)
    urgency = F.when(d <= 30, 1.5).when(d <= 60, 1.35).when(d <= 90, 1.2).when(d <= 180, 1.1).otherwise(1.0)
    out = out.withColumn("raw_score", N.weighted_score(RISK_WEIGHTS, bound=False)).withColumn("multiplier", urgency)
    out = out.withColumn("risk_score", N.clamp(N.python_round(c("raw_score") * c("multiplier"), 1)))
    r = c("risk_score")
    return out.withColumn("tier", F.when(r.between(80, 100), "critical").when(r.between(60, 79), "high").when(r.between(40, 59), "medium").otherwise("low"))


def expansion_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per opportunity: seats, next plan, modules, departments, with revenue and priority.

    Needs arr, segment, licensed, active, plan, plans (array), modules (map of adopted flags),
    departments and potential (arrays).
    """
    arr, c = F.col("arr"), F.col
    near_full = N.safe_divide("active", "licensed") >= 0.90
    seat = F.when(near_full, F.round(arr * N.level_value("segment", SEAT_GROWTH, 0.15)))
    mult = F.create_map(*[F.lit(x) for kv in TIER_UPLIFT.items() for x in kv])
    now = F.coalesce(mult[F.lower(c("plan"))], F.lit(1.0))
    above = F.filter(F.transform("plans", lambda p: F.struct(F.coalesce(mult[F.lower(p)], F.lit(1.0)).alias("m"), p.alias("name"))), lambda s: s["m"] > now)
    # only the first listed higher plan can win: a later one with a smaller uplift also has a smaller gain
    plan_gain = F.when(F.size(above) > 0, F.round(arr / now * above[0]["m"] - arr))
    share = F.create_map(*[F.lit(x) for kv in MODULE_SHARE.items() for x in kv])
    fraction = lambda name: F.coalesce(share[F.lower(name)], F.lit(0.10))
    modules = F.transform(
        F.filter(F.map_entries("modules"), lambda e: ~e["value"] & (fraction(e["key"]) > 0)),
        lambda e: F.struct(F.lit("module_cross_sell").alias("category"), e["key"].alias("target"), F.round(arr * fraction(e["key"])).alias("revenue"), F.lit(3.0).alias("effort")),
    )
    each = N.safe_divide(arr, F.greatest(F.size("departments"), F.lit(1)))
    known = F.transform("departments", lambda x: F.lower(x))
    depts = F.transform(
        F.filter("potential", lambda x: ~F.array_contains(known, F.lower(x))),
        lambda x: F.struct(F.lit("department_expansion").alias("category"), x.alias("target"), F.round(each * 0.8).alias("revenue"), F.lit(1.0).alias("effort")),
    )
    single = F.array(
        F.when(seat > 0, F.struct(F.lit("seat_expansion").alias("category"), F.lit("seats").alias("target"), seat.alias("revenue"), F.lit(3.0).alias("effort"))),
        F.when(plan_gain > 0, F.struct(F.lit("tier_upgrade").alias("category"), above[0]["name"].alias("target"), plan_gain.alias("revenue"), F.lit(2.0).alias("effort"))),
    )
    rows = df.select(*keys, F.inline(F.concat(F.filter(single, lambda s: s.isNotNull()), modules, depts)))
    return rows.withColumn("priority", N.python_round(N.clamp(F.col("revenue") / 2000.0) * F.col("effort"), 1))


# ---- recurring revenue ------------------------------------------------------


def active_at(day: Column) -> Column:
    """Started by the day and not churned by it."""
    return (F.col("start_date") <= day) & (F.col("churn_date").isNull() | (F.col("churn_date") > day))


def arr_waterfall(df: DataFrame, periods: Sequence[tuple[str, str]]) -> DataFrame:
    """Opening, new, expansion, contraction, churned and closing revenue, GRR and NRR, logo and revenue churn.

    All periods are conditional sums of one scan. Expansion and contraction of customers churned by the end
    are left out of the waterfall, while the revenue churn rate counts the contraction of all opening customers.
    """
    aggs = []
    for i, (a, b) in enumerate(periods):
        start, end = F.lit(a).cast("date"), F.lit(b).cast("date")
        opening = active_at(start)
        churned = opening & (F.col("churn_date") > start) & (F.col("churn_date") <= end)
        stays = opening & (F.col("churn_date").isNull() | (F.col("churn_date") > end))
        fresh = (F.col("start_date") > start) & (F.col("start_date") <= end)

        def total(test: Column, column: str = "arr") -> Column:
            return F.coalesce(F.sum(F.when(test, F.col(column))), F.lit(0.0))

        aggs.append(
            F.struct(
                F.lit(a).alias("period_start"), F.lit(b).alias("period_end"), total(opening).alias("opening"), total(fresh).alias("new"), total(churned).alias("churned"),
                total(stays, "expansion").alias("expansion"), total(stays, "contraction").alias("contraction"), total(opening, "contraction").alias("all_contraction"),
                F.count_if(opening).alias("opening_logos"), F.count_if(churned).alias("churned_logos"),
            ).alias(f"p{i}")
        )
    rows = df.agg(*aggs).select(F.inline(F.array(*[f"p{i}" for i in range(len(periods))])))
    o = F.col("opening")
    lost = F.col("contraction") + F.col("churned")
    return rows.select(
        "period_start", "period_end", "opening", "new", "expansion", "contraction", "churned",
        (o + F.col("new") + F.col("expansion") - lost).alias("closing"),
        F.greatest(F.lit(0.0), N.safe_divide(o - lost, o)).alias("grr"),
        F.greatest(F.lit(0.0), N.safe_divide(o + F.col("expansion") - lost, o)).alias("nrr"),
        N.safe_divide("churned_logos", "opening_logos").alias("logo_churn"),
        N.safe_divide(F.col("churned") + F.col("all_contraction"), o).alias("revenue_churn"),
    )


CHECKPOINTS = (0, 3, 6, 9, 12, 18, 24)


def cohort_retention(df: DataFrame, as_of: str) -> DataFrame:
    """Share of a start-month cohort's revenue kept at the checkpoints; future points are left out.

    Customers are summed by start and churn day first, so a large cohort meets its start row as day pairs.
    """
    days = df.groupBy(F.date_format("start_date", "yyyy-MM").alias("cohort"), "start_date", "churn_date").agg(F.sum("arr").alias("arr"))
    first = df.groupBy(F.date_format("start_date", "yyyy-MM").alias("cohort")).agg(F.min("start_date").alias("first"), F.sum("arr").alias("opening"))
    points = F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.lit(int(m * 30.44)).alias("shift")) for m in CHECKPOINTS]))
    marks = first.select("cohort", "first", "opening", points.alias("p")).select("cohort", "opening", "p.month", F.date_add("first", F.col("p.shift")).alias("day"))
    marks = marks.where((F.col("day") <= F.lit(as_of).cast("date")) & (F.col("opening") != 0))
    kept = F.when(active_at(F.col("day")), F.col("arr"))
    return marks.join(days, "cohort").groupBy("cohort", "month").agg((F.coalesce(F.sum(kept), F.lit(0.0)) / F.max("opening")).alias("retention"))


def at_risk(df: DataFrame, as_of: str, tenure_months: float = 6, health_limit: float = 60) -> DataFrame:
    """Additive rules over active customers, with reasons."""
    tenure = F.datediff(F.lit(as_of).cast("date"), "start_date") / 30.44
    rules = [
        (F.col("health") < health_limit, 40, "health"), (tenure < tenure_months, 20, "tenure"), (F.col("contraction") > 0, 30, "contraction"),
        ((tenure > 12) & (F.col("expansion") == 0), 10, "stagnant"),
    ]
    score, reasons = F.lit(0), []
    for test, points, name in rules:
        hit = F.coalesce(test, F.lit(False))
        score = score + F.when(hit, points).otherwise(0)
        reasons.append(F.when(hit, F.lit(name)))
    out = df.where("churn_date IS NULL").withColumn("risk_score", score).withColumn("reasons", F.concat_ws(",", *reasons))
    return out.where("risk_score > 0").withColumn("tenure_months", tenure)


def expansion_by_segment(df: DataFrame, segment: str) -> DataFrame:
    name = F.when(F.col(segment) != "", F.col(segment))
    out = df.where("churn_date IS NULL").groupBy(F.coalesce(name, F.lit("Unspecified")).alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("arr").alias("arr"), F.sum("expansion").alias("expansion"), F.sum("contraction").alias("contraction")
    )
    return out.withColumn("expansion_rate", N.safe_divide("expansion", "arr")).withColumn(
        "net_contribution", N.safe_divide(F.col("arr") + F.col("expansion") - F.col("contraction"), "arr")
    )


# ---- pipeline ---------------------------------------------------------------


def pipeline_coverage(df: DataFrame, keys: Sequence[str], quota: float) -> DataFrame:
    out = df.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("stage") != "Closed Won", F.col("value"))), F.lit(0.0)).alias("pipeline"))
    out = out.withColumn("coverage", F.col("pipeline") / quota)
    return out.withColumn("rating", N.threshold_label("coverage", [(4.0, "Strong"), (3.0, "Healthy"), (2.0, "At Risk")], "Critical"))


def stage_conversion(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """A deal at stage n counts for every stage up to n: one conditional count per stage, in one aggregate."""
    place = F.create_map(*[F.lit(x) for i, s in enumerate(stages) for x in (s, i)])[F.col("stage")]
    counts = df.select(place.alias("p")).agg(*[F.count_if(F.col("p") >= i).alias(f"n{i}") for i in range(len(stages))])
    rows = F.array(
        *[F.struct(F.lit(stages[i]).alias("from_stage"), F.lit(stages[i + 1]).alias("to_stage"), F.col(f"n{i}").alias("from_count"), F.col(f"n{i + 1}").alias("to_count")) for i in range(len(stages) - 1)]
    )
    return counts.select(F.inline(rows)).withColumn("conversion_pct", N.safe_divide("to_count", "from_count") * 100)


def sales_velocity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("deals"), F.avg("value").alias("avg_size"), F.avg((F.col("stage") == "Closed Won").cast("int")).alias("win_rate"), F.avg("age_days").alias("avg_cycle")
    )
    return out.withColumn("per_day", N.safe_divide(F.col("deals") * F.col("avg_size") * F.col("win_rate"), "avg_cycle")).withColumn("per_month", F.col("per_day") * 30)


def deal_aging(df: DataFrame, cycle_days: int, stages: Sequence[str]) -> DataFrame:
    """Open deals past the limit of their stage; the limit falls from two cycles to one along the stages."""
    last = len(stages) - 1
    limits = {s: int(cycle_days * (2.0 - (i / last if last else 0.0))) for i, s in enumerate(stages) if s != "Closed Won"}
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("stage")], F.lit(cycle_days * 2))
    out = df.where("stage <> 'Closed Won'").withColumn("threshold_days", limit).withColumn("days_over", F.col("age_days") - limit)
    return out.where("days_over > 0")


def pipeline_risk(df: DataFrame, keys: Sequence[str], quota: float, stages: Sequence[str]) -> DataFrame:
    """Risk points by pipeline: one deal over 40% (2), empty stages (1), thin quarters (1), coverage under 3x (2)."""
    opened = df.where("stage <> 'Closed Won'")
    listed = [s for s in stages if s != "Closed Won"]
    whole = opened.groupBy(*keys).agg(
        F.sum("value").alias("pipeline"), F.max("value").alias("largest"), F.countDistinct(F.when(F.col("stage").isin(listed), F.col("stage"))).alias("stages_used")
    )
    quarter = F.concat(F.year("close_date"), F.lit("-Q"), F.quarter("close_date"))
    by_quarter = opened.where("close_date IS NOT NULL").groupBy(*keys, quarter.alias("q")).agg(F.sum("value").alias("v"))
    thin = by_quarter.groupBy(*keys).agg(F.count_if(F.col("v") / (quota / 4) < 3.0).alias("thin_quarters"))
    out = whole.join(thin, list(keys), "left")
    top = F.col("largest") / F.col("pipeline") * 100
    points = (
        F.when(top > 40, 2).otherwise(0) + F.when(F.col("stages_used") < len(listed), 1).otherwise(0)
        + F.when(F.col("thin_quarters") > 0, 1).otherwise(0) + F.when(F.col("pipeline") / quota < 3.0, 2).otherwise(0)
    )
    out = out.withColumn("top_share", top).withColumn("concentration", F.when(top > 40, "HIGH").when(top > 25, "MEDIUM")).withColumn("risk_factors", points)
    return out.withColumn("overall_risk", F.when(F.col("risk_factors") >= 4, "HIGH").when(F.col("risk_factors") >= 2, "MEDIUM").otherwise("LOW"))


def weighted_value(scenario: str = "base", probability: Column | None = None) -> Column:
    """Deal value times its bounded stage probability under a scenario."""
    p = probability if probability is not None else N.level_value("stage", STAGE_PROBABILITY, 0.0)
    return F.col("value") * N.clamp(p * SCENARIOS[scenario], 0, 1)


def open_deals(df: DataFrame) -> DataFrame:
    return df.where(~F.col("stage").isin("closed_won", "closed_lost"))


def weighted_pipeline(df: DataFrame, period: Column) -> DataFrame:
    return open_deals(df).groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("deals"), F.sum("value").alias("open_pipeline"), *[F.sum(weighted_value(s)).alias(s) for s in SCENARIOS]
    )


def win_rate_calibration(df: DataFrame) -> DataFrame:
    """Stage probabilities scaled by the actual win rate over 0.25, at most 1."""
    rate = df.where(F.col("stage").isin("closed_won", "closed_lost")).agg(F.avg((F.col("stage") == "closed_won").cast("int")).alias("win_rate"))
    stages = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(p).alias("default_probability")) for s, p in STAGE_PROBABILITY.items()]))
    out = rate.select("win_rate", stages.alias("s")).select("win_rate", "s.*")
    scaled = F.least(F.lit(1.0), F.col("default_probability") * (F.col("win_rate") / 0.25))
    return out.withColumn("calibrated", F.when(F.col("win_rate") > 0, scaled).otherwise(F.col("default_probability")))


def rep_segment_rollup(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Open pipeline, weighted value and mean size by each dimension, in one pass over grouping sets."""
    rows = open_deals(df).withColumn("w", weighted_value())
    out = rows.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().cast("long").alias("g"), F.count(F.lit(1)).alias("deals"), F.sum("value").alias("pipeline"), F.sum("w").alias("weighted"), F.avg("value").alias("avg_size")
    )
    label, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    full = 2 ** len(dims) - 1
    for i, d in enumerate(dims):
        here = F.col("g") == full - 2 ** (len(dims) - 1 - i)
        label, value = F.when(here, F.lit(d)).otherwise(label), F.when(here, F.col(d).cast("string")).otherwise(value)
    return out.select(label.alias("dimension"), value.alias("name"), "deals", "pipeline", "weighted", "avg_size")


# ---- unit economics and finance ---------------------------------------------


def cohort_unit_economics(df: DataFrame) -> DataFrame:
    """CAC, ARPA, implied churn, LTV and payback from an array of monthly revenue.

    Needs customers, cac_spend, monthly_revenue (array) and gross_margin. Endless values are null.
    """
    rev = F.col("monthly_revenue")
    months, m1 = F.size(rev), F.coalesce(F.get(rev, 0), F.lit(0.0))

    def implied(index: int) -> Column:
        later = F.get(rev, index)
        return F.when((m1 > 0) & (later > 0), 1 - F.pow(later / m1, F.lit(1.0 / index))).otherwise(0.02)

    churn = N.clamp(F.when(months >= 12, implied(11)).when(months >= 6, implied(5)).otherwise(0.02), 0.001, 0.30)
    out = df.withColumn("cac", F.col("cac_spend") / F.col("customers")).withColumn("arpa", m1 / F.col("customers")).withColumn("monthly_churn", churn)
    margin = F.col("arpa") * F.col("gross_margin")
    out = out.withColumn("ltv", margin / F.col("monthly_churn")).withColumn("payback_months", F.when(margin > 0, F.col("cac") / margin))
    out = out.withColumn("ltv_cac", N.ratio_or_null("ltv", "cac"))
    kept = lambda i: F.when(m1 > 0, F.get(rev, i) / m1)
    first_year = F.aggregate(F.slice(rev, 1, 12), F.lit(0.0), lambda a, x: a + x) * F.col("gross_margin")
    return out.withColumn("retention_m6", kept(5)).withColumn("retention_m12", kept(11)).withColumn("realized_m12", F.when(months >= 12, first_year))


def channel_unit_economics(df: DataFrame) -> DataFrame:
    """LTV, CAC and payback by channel, and a blended row weighted by customers.

    Needs channel, spend, customers, arpa, gross_margin, monthly_churn.
    """
    ltv = F.when(F.col("monthly_churn") > 0, F.col("arpa") * F.col("gross_margin") / F.col("monthly_churn"))
    rows = df.withColumn("cac", N.ratio_or_null("spend", "customers")).withColumn("ltv", ltv)
    rows = rows.withColumn("payback_months", N.ratio_or_null("cac", F.col("arpa") * F.col("gross_margin")))
    blend = rows.agg(
        F.lit("blended").alias("channel"), F.sum("spend").alias("spend"), F.sum("customers").alias("customers"), N.safe_divide(F.sum("spend"), F.sum("customers")).alias("cac"),
        N.safe_divide(F.sum(F.col("ltv") * F.col("customers")), F.sum("customers")).alias("ltv"), F.lit(None).cast("double").alias("payback_months"),
    )
    cols = ["channel", "spend", "customers", "cac", "ltv", "payback_months"]
    return rows.select(*cols).unionByName(blend.select(*cols)).withColumn("ltv_cac", N.ratio_or_null("ltv", "cac"))


def _has(x: Column) -> Column:
    """Present and not zero."""
    return F.coalesce(x != 0, F.lit(False))


def saas_metrics(df: DataFrame, gross_margin: float = 0.70) -> DataFrame:
    """ARR, ARPA, growth, churn, CAC, LTV, payback, NRR by row; null where inputs lack.

    Steps are rounded to two places as the later ones build on the rounded values.
    """
    c = F.col
    out = df.withColumn("arr", F.round(c("mrr") * 12, 2))
    out = out.withColumn("arpa", F.when(_has(c("mrr")) & _has(c("customers")), F.round(c("mrr") / c("customers"), 2)))
    out = out.withColumn("growth_pct", F.when(_has(c("mrr")) & (c("mrr_last") > 0), F.round((c("mrr") - c("mrr_last")) / c("mrr_last") * 100, 2)))
    out = out.withColumn("churn_pct", F.when(c("churned").isNotNull() & _has(c("customers")), F.round(c("churned") / c("customers") * 100, 2)))
    out = out.withColumn("cac", F.when(_has(c("sm_spend")) & (c("new_customers") > 0), F.round(c("sm_spend") / c("new_customers"), 2)))
    out = out.withColumn("ltv", F.when(_has(c("arpa")) & (c("churn_pct") > 0), F.round(c("arpa") / (c("churn_pct") / 100) * gross_margin, 2)))
    out = out.withColumn("ltv_cac", F.when(_has(c("ltv")) & (c("cac") > 0), F.round(c("ltv") / c("cac"), 2)))
    out = out.withColumn("payback_months", F.when(_has(c("cac")) & (c("arpa") > 0), F.round(c("cac") / (c("arpa") * gross_margin), 1)))
    moved = _has(c("expansion_mrr")) | _has(c("churned_mrr")) | _has(c("contraction_mrr"))
    net = (c("mrr_last") + c("expansion_mrr") - c("churned_mrr") - c("contraction_mrr")) / c("mrr_last") * 100
    full = (c("mrr_last") > 0) & moved
    return out.withColumn("nrr_pct", F.when(full, F.round(net, 2)).when(_has(c("churn_pct")), F.round(100 - c("churn_pct"), 2)))


def quick_ratio(new: Column, expansion: Column, churned: Column, contraction: Column) -> tuple[Column, Column, Column]:
    """Ratio (null when endless), the endless flag, and the status."""
    gain, loss = new + expansion, churned + contraction
    endless = (loss == 0) & (gain > 0)
    ratio = F.when(loss != 0, gain / loss).when(gain > 0, F.lit(None).cast("double")).otherwise(0.0)
    status = F.when(endless | (ratio >= 4), "EXCELLENT").when(ratio >= 2, "HEALTHY").when(ratio >= 1, "WATCH").otherwise("CRITICAL")
    return ratio, endless, status


def gtm_rating(metric: str, value: Column) -> Column:
    green, yellow = GTM_BOUNDS[metric]
    if metric in ("cac_payback_months", "burn_multiple"):
        return F.when(value <= green, "Green").when(value <= yellow, "Yellow").otherwise("Red")
    return F.when(value >= green, "Green").when(value >= yellow, "Yellow").otherwise("Red")


def gtm_metrics(df: DataFrame) -> DataFrame:
    """Magic number, LTV:CAC, payback, burn multiple, rule of 40 and NDR with their ratings.

    Needs net_new_arr, sm_spend, arpa_monthly, gross_margin_pct, churn_pct, cac, net_burn, growth_pct,
    fcf_margin_pct, begin_arr, expansion, contraction, churned.
    """
    c = F.col
    margin = c("gross_margin_pct") / 100
    ltv = N.safe_divide(c("arpa_monthly") * 12 * margin, c("churn_pct") / 100)
    values = {
        "magic_number": N.safe_divide("net_new_arr", "sm_spend"),
        "ltv_cac_ratio": N.safe_divide(ltv, "cac"),
        "cac_payback_months": N.safe_divide("cac", c("arpa_monthly") * margin),
        "burn_multiple": N.safe_divide("net_burn", "net_new_arr"),
        "rule_of_40": c("growth_pct") + c("fcf_margin_pct"),
        "ndr_pct": N.safe_divide(c("begin_arr") + c("expansion") - c("contraction") - c("churned"), "begin_arr") * 100,
    }
    out = df.select("*", *[v.alias(k) for k, v in values.items()])
    return out.select("*", *[gtm_rating(k, c(k)).alias(f"{k}_rating") for k in values])


def budget_variance(df: DataFrame, pct_limit: float = 10.0, amount_limit: float = 50000.0) -> DataFrame:
    """Variance against budget and prior year, favorability by line type, materiality.

    Needs type, actual, budget and prior_year.
    """
    var = F.col("actual") - F.col("budget")
    pct = N.safe_divide(var, "budget") * 100
    income = F.lower("type").isin("revenue", "income", "sales")
    good = F.when(income, var > 0).otherwise(var < 0)
    before = F.col("actual") - F.col("prior_year")
    return (
        df.withColumn("variance", var)
        .withColumn("variance_pct", pct)
        .withColumn("prior_variance", before)
        .withColumn("prior_variance_pct", F.when(F.col("prior_year").isNotNull(), N.safe_divide(before, "prior_year") * 100))
        .withColumn("favorability", F.when(good, "Favorable").otherwise("Unfavorable"))
        .withColumn("is_material", (F.abs(pct) >= pct_limit) | (F.abs(var) >= amount_limit))
    )


def variance_rollup(variances: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Totals by department and by category from one pass."""
    out = variances.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().cast("long").alias("g"), F.sum("actual").alias("total_actual"), F.sum("budget").alias("total_budget"), F.sum("variance").alias("total_variance"),
        F.count_if(F.col("favorability") == "Favorable").alias("favorable"), F.count(F.lit(1)).alias("lines"),
    )
    label, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    full = 2 ** len(dims) - 1
    for i, d in enumerate(dims):
        here = F.col("g") == full - 2 ** (len(dims) - 1 - i)
        label, value = F.when(here, F.lit(d)).otherwise(label), F.when(here, F.col(d).cast("string")).otherwise(value)
    return out.select(
        label.alias("dimension"), value.alias("name"), "total_actual", "total_budget", "total_variance", "favorable", (F.col("lines") - F.col("favorable")).alias("unfavorable"),
        (N.safe_divide("total_variance", "total_budget") * 100).alias("variance_pct"),
    )


def financial_ratios(df: DataFrame) -> DataFrame:
    """Profitability, liquidity, leverage, efficiency and valuation ratios of statement rows; 0 on a zero base."""
    c, d = F.col, N.safe_divide
    cap = F.when((c("market_cap") == 0) & (c("share_price") > 0) & (c("shares") > 0), c("share_price") * c("shares")).otherwise(c("market_cap"))
    pe = d("share_price", d("net_income", "shares"))
    turns = d("revenue", "receivables")
    ratios: Mapping[str, Column] = {
        "roe": d("net_income", "equity"), "roa": d("net_income", "assets"), "gross_margin": d(c("revenue") - c("cogs"), "revenue"),
        "operating_margin": d("operating_income", "revenue"), "net_margin": d("net_income", "revenue"),
        "current_ratio": d("current_assets", "current_liabilities"), "quick_ratio": d(c("current_assets") - c("inventory"), "current_liabilities"), "cash_ratio": d("cash", "current_liabilities"),
        "debt_to_equity": d("debt", "equity"), "interest_coverage": d("operating_income", "interest"), "dscr": d("operating_cash", "debt_service"),
        "asset_turnover": d("revenue", "assets"), "inventory_turnover": d("cogs", "inventory"), "receivables_turnover": turns, "days_sales": d(F.lit(365.0), turns),
        "pe": pe, "pb": d("share_price", d("equity", "shares")), "ps": d(cap, "revenue"), "ev_ebitda": d(cap + c("debt") - c("cash"), "ebitda"), "peg": d(pe, c("growth") * 100),
    }
    return df.select("*", *[v.alias(k) for k, v in ratios.items()])


COMPA_STEPS = [(0.85, "below band"), (0.95, "developing")]


def compa_ratio(df: DataFrame) -> DataFrame:
    """Salary over the band middle, position in the band, bucket and flags; needs salary, band_min, band_mid, band_max, rating."""
    s = F.col("salary")
    cr = N.safe_divide(s, "band_mid")
    place = F.when(F.col("band_max") == F.col("band_min"), 0.5).otherwise((s - F.col("band_min")) / (F.col("band_max") - F.col("band_min")))
    bucket = F.when(cr < 0.85, "below band").when(cr < 0.95, "developing").when(cr <= 1.05, "target zone").when(cr <= 1.15, "senior in role").otherwise("above band")
    flags = F.concat_ws(
        ",",
        F.when(s < F.col("band_min"), "below minimum").when(cr < 0.88, "far below middle").when(cr < 0.93, "below target"),
        F.when(s > F.col("band_max"), "above maximum"),
        F.when((F.col("rating") >= 4) & (cr < 0.95), "underpaid performer"),
    )
    return df.withColumn("compa_ratio", cr).withColumn("band_position", place).withColumn("bucket", bucket).withColumn("flags", flags)
