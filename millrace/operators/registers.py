"""Registers, delivery and compliance tables: due dates, risks, actions, page audits, caseloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.operators.narrowing import exact_quantiles
from millrace.operators.ordered import null_safe_join, running_sum

# Rotation defaults in days, risk weights, risk bounds, theme words, page limits.
ROTATION_DAYS = {"database": 30, "api-key": 90, "tls-certificate": 60, "ssh-key": 90, "service-token": 1, "encryption-key": 90, "oauth-secret": 90, "password": 30}
RISK_WEIGHT = {"technical": 1.2, "resource": 1.1, "schedule": 1.0, "business": 1.3, "financial": 1.4, "regulatory": 1.5}
RISK_STEPS = [(8, "low"), (15, "medium"), (20, "high")]
THEMES = {
    "communication": ["communication", "meeting", "standup", "discussion", "feedback", "information", "clarity", "understanding", "alignment", "sync", "reporting", "updates", "transparency", "visibility"],
    "process": ["process", "procedure", "workflow", "methodology", "framework", "scrum", "agile", "ceremony", "planning", "retrospective", "review", "estimation", "refinement", "definition of done"],
    "technical": ["technical", "code", "development", "bug", "testing", "deployment", "architecture", "infrastructure", "tools", "technology", "performance", "quality", "automation", "ci/cd", "devops"],
    "team_dynamics": ["team", "collaboration", "cooperation", "support", "morale", "motivation", "engagement", "culture", "relationship", "trust", "conflict", "personality", "workload", "capacity", "burnout"],
    "external": ["customer", "stakeholder", "management", "product owner", "business", "requirement", "priority", "deadline", "budget", "resource", "dependency", "vendor", "third party", "integration"],
}
ACTIVE = ("open", "identified", "monitoring", "mitigating")


def due_status(status: Column, due: Column, as_of: str) -> Column:
    """Named status and due date to not_applicable, collected, pending, overdue or not_started."""
    s = F.trim(F.lower(F.coalesce(status, F.lit("Not Started"))))
    late = F.coalesce(due < F.lit(as_of).cast("date"), F.lit(False))
    return (
        F.when(s.isin("not_applicable", "n/a", "not applicable"), "not_applicable")
        .when(s.isin("collected", "complete", "done"), "collected")
        .when(s.isin("pending", "in progress", "in_progress"), F.when(late, "overdue").otherwise("pending"))
        .when(s.isin("overdue", "late"), "overdue")
        .otherwise("not_started")
    )


def readiness(df: DataFrame, category: str, status: str) -> DataFrame:
    """Collected over applicable in percent by category and for all, with the rating."""
    out = df.rollup(category).agg(
        F.grouping(category).cast("int").alias("is_total"), F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == "collected").alias("collected"), F.count_if(F.col(status) == "overdue").alias("overdue"),
        F.count_if(F.col(status) != "not_applicable").alias("applicable"),
    )
    out = out.withColumn("readiness_pct", N.python_round(N.safe_divide("collected", "applicable") * 100, 1))
    return out.withColumn("rating", N.threshold_label("readiness_pct", [(90, "Audit Ready"), (75, "Minor Gaps"), (50, "Significant Gaps")], "Not Ready"))


def rotation_schedule(df: DataFrame, kind: str, last: str, policy_days: int, as_of: str) -> DataFrame:
    """Next date = last + min(policy, default of the type); a missing last date is due now."""
    table = F.create_map(*[F.lit(x) for k, v in ROTATION_DAYS.items() for x in (k, min(v, policy_days))])
    days = F.coalesce(table[F.col(kind)], F.lit(min(90, policy_days)))
    now = F.lit(as_of).cast("date")
    out = df.withColumn("interval_days", days).withColumn("next_rotation", F.coalesce(F.date_add(F.col(last), days), now))
    out = out.withColumn("days_until", F.when(F.col(last).isNull(), -999).otherwise(F.datediff("next_rotation", now)))
    d = F.col("days_until")
    return out.withColumn("urgency", F.when(d <= 0, "CRITICAL").when(d <= 7, "HIGH").when(d <= 14, "MEDIUM").otherwise("LOW"))


def fmea(df: DataFrame, severity: str, occurrence: str, detection: str) -> DataFrame:
    """Risk priority number and its class."""
    rpn = F.col(severity) * F.col(occurrence) * F.col(detection)
    label = F.when(F.col(severity) >= 8, "CRITICAL").when(rpn >= 200, "HIGH").when(rpn >= 100, "MEDIUM").otherwise("LOW")
    return df.withColumn("rpn", rpn).withColumn("criticality", label)


def fmea_summary(rated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Min, max, mean and upper median of the positive numbers, and the class counts."""
    pos = F.when(F.col("rpn") > 0, F.col("rpn"))
    base = rated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.min(pos).alias("rpn_min"), F.max(pos).alias("rpn_max"), F.avg(pos).alias("rpn_mean"),
        *[F.count_if(F.col("criticality") == c).alias(c.lower()) for c in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
    )
    mid = exact_quantiles(rated.where("rpn > 0"), keys, "rpn", {"rpn_median": 0.5}, method="index").drop("n")
    return null_safe_join(base, mid, list(keys), "left")


def risk_score(df: DataFrame) -> DataFrame:
    """Probability x impact x category weight, level and response; needs category, probability, impact."""
    p, i = F.col("probability"), F.col("impact")
    score = p * i * N.level_value("category", RISK_WEIGHT, 1.0)
    out = df.withColumn("risk_score", score).withColumn("risk_level", N.upto_label("risk_score", RISK_STEPS, "critical"))
    answer = F.when(F.col("risk_level") == "low", "accept").when((p >= 4) & (i <= 2), "mitigate").when((p <= 2) & (i >= 4), "contingency").when(i >= 4, "avoid").otherwise("mitigate")
    return out.withColumn("response", answer)


def risk_categories(scored: DataFrame) -> DataFrame:
    active = scored.where(F.col("status").isin(list(ACTIVE)))
    return active.groupBy("category").agg(F.count(F.lit(1)).alias("risks"), F.sum("risk_score").alias("total_score"), F.avg("risk_score").alias("mean_score"), F.max("risk_score").alias("max_score"))


def mitigation_effect(scored: DataFrame, as_of: str) -> DataFrame:
    """Active risks by strategy and for all: mean score, share with actions, actions per risk, overdue share.

    Needs status, strategy, actions (array), target (date).
    """
    active = scored.where(F.col("status").isin(list(ACTIVE)))
    late = F.coalesce(F.lit(as_of).cast("date") > F.col("target"), F.lit(False))
    return active.rollup("strategy").agg(
        F.grouping("strategy").cast("int").alias("is_total"), F.count(F.lit(1)).alias("risks"), F.avg("risk_score").alias("mean_score"), F.avg((F.size("actions") > 0).cast("int")).alias("coverage"),
        F.avg(F.size("actions")).alias("actions_per_risk"), F.avg(late.cast("int")).alias("overdue_rate"),
    )


def limit_forecast(df: DataFrame, metric: str, period: str, value: str, target: Column, upper: Column) -> DataFrame:
    """Last value plus slope against 1.2 x target or 0.9 x limit, for metrics with five periods or more."""
    w = Window.partitionBy(metric).orderBy(period)
    rows = df.withColumn("__i", F.row_number().over(w).cast("double"))
    out = rows.groupBy(metric).agg(F.count(F.lit(1)).alias("points"), F.max_by(value, period).alias("current"), F.coalesce(F.regr_slope(F.col(value).cast("double"), "__i"), F.lit(0.0)).alias("slope"), F.max(target).alias("target"), F.max(upper).alias("upper"))
    out = out.where("points >= 5 AND slope <> 0").withColumn("forecast", F.col("current") + F.col("slope"))
    hit = (F.col("forecast") > F.col("target") * 1.2) | (F.col("forecast") > F.col("upper") * 0.9)
    return out.where(hit).withColumn("risk_level", F.when(F.col("forecast") > F.col("upper"), "high").otherwise("medium"))


def control_limits(df: DataFrame, value: str, lower: str, upper: str, category: str) -> DataFrame:
    """Values outside their limits; critical for customer and regulatory metrics."""
    v = F.col(value)
    issue = F.when((F.col(upper) != 0) & (v > F.col(upper)), "exceeds_upper_limit").when((F.col(lower) != 0) & (v < F.col(lower)), "below_lower_limit")
    out = df.withColumn("issue", issue).where("issue IS NOT NULL")
    return out.withColumn("severity", F.when(F.col(category).isin("Customer", "Regulatory"), "critical").otherwise("high"))


def action_completion(retros: DataFrame, actions: str, as_of: str) -> DataFrame:
    """Completion, mean sprints to close and overdue share: all, by priority and by owner, in one pass.

    ``actions`` is an array of structs with owner, priority, status, created, completed, due.
    """
    a = retros.select(F.inline(actions))
    done = F.col("status") == "completed"
    span = F.col("completed") - F.col("created")
    late = F.coalesce((F.lit(as_of).cast("date") > F.col("due")) & ~done, F.lit(False))
    rows = a.select("priority", "owner", done.alias("done"), F.when(done & (span >= 0), span).alias("span"), late.alias("late"))
    out = rows.groupingSets([[], ["priority"], ["owner"]], "priority", "owner").agg(
        F.grouping_id().cast("long").alias("g"), F.count(F.lit(1)).alias("total"), F.count_if("done").alias("completed"), F.avg("span").alias("mean_sprints"), F.count_if("late").alias("overdue")
    )
    label = F.when(F.col("g") == 1, "priority").when(F.col("g") == 2, "owner").otherwise("all")
    name = F.when(F.col("g") == 1, F.col("priority")).when(F.col("g") == 2, F.col("owner")).otherwise("all")
    return out.select(label.alias("dimension"), name.alias("name"), "total", "completed", "mean_sprints", "overdue", (F.col("completed") / F.col("total")).alias("completion_rate"), (F.col("overdue") / F.col("total")).alias("overdue_rate"))


def recurring_themes(df: DataFrame, retro: str, text: str, share: float = 0.5) -> DataFrame:
    """Themes seen in the given share of the retrospectives or more (half by default), with mentions and trend.

    Words are looked for in every row and merged by retrospective as flags, so texts are never joined together.
    """
    low = F.lower(F.col(text))
    flags = {f"{name}__{i}": low.contains(w) for name, words in THEMES.items() for i, w in enumerate(words)}
    per = df.groupBy(retro).agg(*[F.max(v).alias(k) for k, v in flags.items()])
    items = F.array(
        *[F.struct(F.lit(name).alias("theme"), sum([F.col(f"{name}__{i}").cast("int") for i in range(len(words))], F.lit(0)).alias("mentions")) for name, words in THEMES.items()]
    )
    rows = per.select(retro, F.inline(items)).where("mentions > 0")
    total = per.agg(F.count(F.lit(1)).alias("retros"))
    placed = running_sum(rows.withColumn("__one", F.lit(1)), ["theme"], [retro], "__one", F.floor(F.col(retro) / 1000), "__i")
    out = placed.groupBy("theme").agg(
        F.count(F.lit(1)).alias("seen"), F.avg("mentions").alias("mean_mentions"), F.sum("mentions").cast("long").alias("total_mentions"), F.min(retro).alias("first_seen"), F.max(retro).alias("last_seen"),
        F.coalesce(F.regr_slope(F.col("mentions").cast("double"), F.col("__i").cast("double")), F.lit(0.0)).alias("slope"),
    )
    out = out.crossJoin(F.broadcast(total)).where(F.col("seen") >= F.col("retros") * share)
    way = F.when(F.abs("slope") < 0.01, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return out.withColumn("frequency", F.col("seen") / F.col("retros")).withColumn("direction", way).drop("retros")


def content_checks(df: DataFrame) -> DataFrame:
    """Organisation, size and completeness scores of a page table; needs labels (array), words, title, last_modified, author."""
    gap = F.lit(False)
    for c in ("title", "last_modified", "author"):
        gap = gap | F.col(c).isNull() | (F.col(c).cast("string") == "")
    n = F.count(F.lit(1))
    out = df.agg(
        n.alias("pages"), F.count_if(F.coalesce(F.size("labels") <= 0, F.lit(True))).alias("unlabelled"), F.count_if(F.col("words") > 5000).alias("oversized"),
        F.count_if((F.col("words") < 50) & (F.col("words") > 0)).alias("undersized"), F.count_if(gap).alias("incomplete"), F.avg("words").alias("mean_words"),
    )
    good = lambda bad: F.when(F.col("pages") > 0, (1 - bad / F.col("pages")) * 100).otherwise(100.0)
    return out.withColumn("organization", good(F.col("unlabelled"))).withColumn("size_balance", good(F.col("oversized") + F.col("undersized"))).withColumn("completeness", good(F.col("incomplete")))


def content_staleness(df: DataFrame, modified: str, views: str, as_of: str) -> DataFrame:
    """Stale over 90 days, outdated over 180, low views under 5, with both scores."""
    age = F.datediff(F.lit(as_of).cast("date"), modified)
    out = df.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if((age > 90) & (age <= 180)).alias("stale"), F.count_if(age > 180).alias("outdated"),
        F.count_if(F.coalesce(F.col(views), F.lit(0)) < 5).alias("low_engagement"), F.avg(F.coalesce(F.col(views), F.lit(0))).alias("mean_views"),
    )
    good = lambda bad: F.when(F.col("pages") > 0, (1 - bad / F.col("pages")) * 100).otherwise(100.0)
    return out.withColumn("freshness", good(F.col("stale") + F.col("outdated"))).withColumn("engagement", good(F.col("low_engagement")))


def caseload(people: DataFrame, scores: DataFrame, sessions: DataFrame, plans: DataFrame, person: str, now: str) -> DataFrame:
    """Attempts, adherence over 7 days, mean and 30-day change of the latest score per cell, last activity, latest plan.

    scores: person, cell, ts, tie, score. sessions: person, ts. plans: person, ts, status. One aggregate per
    table, joined by person; no query per person.
    """
    at = F.lit(now).cast("timestamp_ntz")
    week, month = at - F.expr("INTERVAL 6 DAYS"), at - F.expr("INTERVAL 30 DAYS")
    both = scores.select(person, "ts").unionByName(sessions.select(person, "ts"))
    act = both.groupBy(person).agg(F.countDistinct(F.when(F.col("ts") >= week, F.to_date("ts"))).alias("days"), F.max("ts").alias("last_activity"))
    tries = scores.groupBy(person).agg(F.count(F.lit(1)).alias("attempts"))
    order = F.struct("ts", "tie")
    cells = scores.where(F.col("ts") >= month).groupBy(person, "cell").agg(F.max_by("score", order).alias("last"), F.min_by("score", order).alias("first"))
    mean = cells.groupBy(person).agg(N.python_round(F.avg("last"), 0).alias("score_mean"), N.python_round(F.avg("last") - F.avg("first"), 0).alias("score_delta_30d"))
    plan = plans.groupBy(person).agg(F.max_by("status", F.col("ts")).alias("plan_status"))
    out = people.select(person)
    for part in (tries, act, mean, plan):
        out = out.join(part, person, "left")
    return out.select(
        person, F.coalesce("attempts", F.lit(0)).alias("attempts"), N.python_round(F.coalesce("days", F.lit(0)) / 7.0, 2).alias("adherence"), "score_mean", "score_delta_30d", "plan_status", "last_activity"
    )


def target_ranking(scores: DataFrame, person: str, sound: str, tiers: Mapping[str, tuple[int, int]], limit: float = 70, size: int = 3) -> DataFrame:
    """Failing sounds by tier, then closeness to the goal, then place in the tier; the first ``size`` per person.

    scores: person, sound, position, ts, tie, score.
    """
    last = scores.groupBy(person, sound, "position").agg(F.max_by("score", F.struct("ts", "tie")).alias("score"))
    fail = last.where(F.col("score") < limit).groupBy(person, sound).agg(N.python_round(F.avg("score"), 0).alias("baseline"), F.count(F.lit(1)).alias("positions"))
    tier = F.create_map(*[F.lit(x) for s, (t, _) in tiers.items() for x in (s, t)])[F.col(sound)]
    place = F.create_map(*[F.lit(x) for s, (_, p) in tiers.items() for x in (s, p)])[F.col(sound)]
    rows = fail.withColumn("tier", F.coalesce(tier, F.lit(max(t for t, _ in tiers.values()) + 1))).withColumn("place", F.coalesce(place, F.lit(0)))
    w = Window.partitionBy(person).orderBy("tier", F.desc("baseline"), "place")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).drop("place")

