"""Ordered results: neighbours, running values, runs, phases, streaks.

Row-level order over a possibly hot key goes through ``ordered`` (block by block);
plain windows are used only over rows already reduced to periods.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.operators.ordered import neighbour, null_safe_join, running_sum

# Phase keywords, event types and order of the incident timeline.
PHASES: dict[str, tuple[list[str], list[str]]] = {
    "detection": (
        ["alert", "alarm", "triggered", "fired", "detected", "noticed", "monitoring", "threshold exceeded",
         "anomaly", "spike", "error rate", "latency increase", "timeout", "failure"],
        ["alert", "monitoring", "notification"],
    ),
    "triage": (
        ["investigating", "triaging", "assessing", "evaluating", "checking", "looking into", "analyzing",
         "reviewing", "diagnosis", "troubleshooting", "examining"],
        ["investigation", "communication", "action"],
    ),
    "escalation": (
        ["escalating", "paging", "calling in", "requesting help", "engaging", "involving", "notifying",
         "alerting team", "incident commander", "war room", "all hands"],
        ["escalation", "communication", "notification"],
    ),
    "mitigation": (
        ["fixing", "patching", "deploying", "rolling back", "restarting", "scaling", "rerouting", "bypassing",
         "workaround", "implementing fix", "applying solution", "remediation"],
        ["deployment", "action", "fix"],
    ),
    "resolution": (
        ["resolved", "fixed", "restored", "recovered", "back online", "working", "normal", "stable", "healthy",
         "operational", "incident closed", "service restored"],
        ["resolution", "confirmation"],
    ),
    "review": (
        ["post-mortem", "retrospective", "review", "lessons learned", "pir", "post-incident", "analysis",
         "follow-up", "action items", "improvements"],
        ["review", "documentation"],
    ),
}
# Minutes allowed between phases and between messages.
GAP_MINUTES = {
    "detection_to_triage": 15,
    "triage_to_mitigation": 30,
    "mitigation_to_resolution": 120,
    "communication_gap": 30,
    "phase_transition": 45,
}


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(60_000_000.0)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key as a combinable aggregate instead of a sorted group."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__best"))
    return best.select(*keys, "__best.*")


def latest_and_earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    o = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.max_by(value, o).alias("latest"), F.min_by(value, o).alias("earliest"), F.count(F.lit(1)).alias("n")
    )


def moving_average(periods: DataFrame, keys: Sequence[str], order: str, value: str, size: int, at_least: int = 1) -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(size - 1), 0)
    return F.when(F.count(value).over(w) >= at_least, F.avg(value).over(w))


def sequence_gaps(df: DataFrame, number: str, width: int = 1_000_000) -> DataFrame:
    """Rows whose number is more than one above the number before; blocks of ``width`` numbers."""
    near = neighbour(df, [], [number], {"previous": number}, F.floor(F.col(number) / width))
    return near.where(F.col(number) - F.col("previous") > 1)


def streak_days(df: DataFrame, user: str, ts: str, today: str) -> DataFrame:
    """Consecutive active days ending today or yesterday; 0 when there is no such run."""
    days = df.select(user, F.to_date(ts).alias("day")).distinct()
    w = Window.partitionBy(user).orderBy("day")
    runs = (
        days.withColumn("run", F.date_sub("day", F.row_number().over(w)))
        .groupBy(user, "run")
        .agg(F.max("day").alias("last"), F.count(F.lit(1)).alias("length"))
    )
    end = F.lit(today).cast("date")
    current = (F.col("last") == end) | (F.col("last") == F.date_sub(end, 1))
    return runs.groupBy(user).agg(F.coalesce(F.max(F.when(current, F.col("length"))), F.lit(0)).alias("streak_days"))


def zero_filled_daily(df: DataFrame, key: str, ts: str, value: str, today: str, days: int = 7) -> DataFrame:
    """Totals of the last days for every key, missing days as 0."""
    end = F.lit(today).cast("date")
    spine = F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day")
    keys = df.select(key).distinct().select(key, spine)
    recent = df.where(F.to_date(ts).between(F.date_sub(end, days - 1), end))
    totals = recent.groupBy(F.col(key).alias("__k"), F.to_date(ts).alias("__d")).agg(F.sum(value).alias("__v"))
    joined = keys.join(totals, (F.col(key) == F.col("__k")) & (F.col("day") == F.col("__d")), "left")
    return joined.select(key, "day", F.coalesce("__v", F.lit(0.0)).alias("total"))


def trend_direction(current: Column, previous: Column, band: float = 5) -> Column:
    diff = current - previous
    return (
        F.when(previous.isNull(), "no_data").when(diff > band, "improving").when(diff < -band, "declining").otherwise("stable")
    )


def half_split(df: DataFrame, keys: Sequence[str], order: str, tie: str, value: str, block: Column) -> DataFrame:
    """Mean of the first n//2 rows against the mean of the rest, in time order."""
    one = df.withColumn("__one", F.lit(1))
    placed = running_sum(one, keys, [order, tie], "__one", block, "__pos")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows = null_safe_join(placed, sizes, list(keys))
    first = F.col("__pos") <= F.floor(F.col("__n") / 2)
    out = rows.groupBy(*keys).agg(
        F.avg(F.when(first, F.col(value))).alias("first_mean"), F.avg(F.when(~first, F.col(value))).alias("second_mean")
    )
    return out.withColumn("trend", F.when(F.col("second_mean") > F.col("first_mean"), "improving").otherwise("declining"))


def improving_counts(periods: DataFrame, keys: Sequence[str], order: str, forecast: str, actual: str) -> DataFrame:
    """Periods whose error fell or rose against the period before; zero actuals count as no error."""
    a, f = F.col(actual), F.col(forecast)
    err = F.round(F.when(a != 0, F.abs(a - f) / F.abs(a) * 100).otherwise(0.0), 1)
    before = F.lag("__e").over(Window.partitionBy(*keys).orderBy(order))
    rows = periods.withColumn("__e", err).withColumn("__p", before)
    out = rows.groupBy(*keys).agg(
        F.count_if(F.col("__e") < F.col("__p")).alias("improving"),
        F.count_if(F.col("__e") > F.col("__p")).alias("declining"),
    )
    up, down = F.col("improving"), F.col("declining")
    return out.withColumn("trend", F.when(up > down, "Improving").when(down > up, "Declining").otherwise("Stable"))


def phase_of(message: Column, kind: Column, severity: Column) -> Column:
    """Best scoring phase: 2 per keyword, 3 for the event type, 2 for severe escalations; triage when nothing scores."""
    text = F.lower(message)
    scored = []
    for place, (name, (words, kinds)) in enumerate(PHASES.items()):
        score = F.lit(0)
        for word in words:
            score = score + F.when(text.contains(word), 2).otherwise(0)
        score = score + F.when(kind.isin(kinds), 3).otherwise(0)
        if name == "escalation":
            score = score + F.when(severity >= 4, 2).otherwise(0)
        scored.append(F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["name"]).otherwise(F.lit("triage"))


def phase_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, phase: str) -> DataFrame:
    """Runs of the same phase by key in time order, one row per run; days are numbered inside, then carried on.

    Neighbouring runs always differ in phase, so there is nothing left to merge after this step.
    """
    inside = Window.partitionBy(*keys, "__day").orderBy(*order)
    changed = F.when(F.row_number().over(inside) == 1, 0).when(F.col(phase).eqNullSafe(F.lag(phase).over(inside)), 0).otherwise(1)
    rows = df.select(*dict.fromkeys((*keys, *order, ts, phase))).withColumn("__day", F.to_date(ts)).withColumn("__new", changed)
    rows = rows.withColumn("__run", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # one row per key and day: what it begins and ends with, and how often it changes between
    at = F.struct(*order)
    days = rows.groupBy(*keys, "__day").agg(F.min_by(phase, at).alias("__first"), F.max_by(phase, at).alias("__last"), F.sum("__new").alias("__changes"))
    by_day = Window.partitionBy(*keys).orderBy("__day")
    starts = F.when(F.col("__first").eqNullSafe(F.lag("__last").over(by_day)), 0).otherwise(1)
    days = days.withColumn("__starts", starts)
    upto = F.sum(F.col("__starts") + F.col("__changes")).over(by_day.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__changes")
    runs = null_safe_join(rows, days.select(*keys, "__day", upto.alias("__upto")), [*keys, "__day"]).withColumn("run", F.col("__upto") + F.col("__run"))
    out = runs.groupBy(*keys, "run").agg(
        F.first(phase).alias("phase"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("events")
    )
    return out.withColumn("minutes", minutes_between(F.col("start"), F.col("end")))


def event_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, limit: float) -> DataFrame:
    """Gaps of at least ``limit`` minutes to the next event; critical from twice the limit."""
    near = neighbour(df, keys, order, {"next_ts": ts}, F.to_date(ts), forward=True)
    gap = near.withColumn("gap_minutes", minutes_between(F.col(ts), F.col("next_ts")))
    return gap.where(F.col("gap_minutes") >= limit).withColumn(
        "severity", F.when(F.col("gap_minutes") >= 2 * limit, "critical").otherwise("warning")
    )


def phase_gaps(segments: DataFrame, keys: Sequence[str], limits: Mapping[str, int] = GAP_MINUTES) -> DataFrame:
    """Pauses between neighbouring phases over the limit of that transition."""
    near = neighbour(
        segments, keys, ["run"], {"next_phase": "phase", "next_start": "start"}, F.floor(F.col("run") / 1000), forward=True
    ).where("next_phase IS NOT NULL")
    named = {k: v for k, v in limits.items() if "_to_" in k}
    table = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
    limit = F.coalesce(table[F.concat_ws("_to_", "phase", "next_phase")], F.lit(limits["phase_transition"]))
    out = near.withColumn("threshold", limit).withColumn("gap_minutes", minutes_between(F.col("end"), F.col("next_start")))
    return out.where("gap_minutes > threshold").withColumn(
        "severity", F.when(F.col("gap_minutes") < F.col("threshold") * 2, "warning").otherwise("critical")
    )


def response_metrics(df: DataFrame, keys: Sequence[str], ts: str, phase: str) -> DataFrame:
    """Minutes from the first event to detection, mitigation and resolution, by key."""
    first = {p: F.min(F.when(F.col(phase) == p, F.col(ts))).alias(p) for p in ("detection", "mitigation", "resolution")}
    out = df.groupBy(*keys).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), *first.values())
    s = F.col("started")
    return out.select(
        *keys,
        minutes_between(s, F.col("detection")).alias("to_detection"),
        minutes_between(s, F.col("mitigation")).alias("to_mitigation"),
        minutes_between(s, F.col("resolution")).alias("to_resolution"),
        minutes_between(F.col("detection"), F.col("resolution")).alias("detection_to_resolution"),
        minutes_between(s, F.col("ended")).alias("duration"),
    )


def zscore_rows(df: DataFrame, keys: Sequence[str], value: str, outlier: float = 2.0, extreme: float = 3.0) -> DataFrame:
    """Rows at least ``outlier`` sample deviations from their group mean."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    rows = null_safe_join(df, stats, list(keys)).where("n >= 3 AND std > 0")
    rows = rows.withColumn("z", F.abs(F.col(value) - F.col("mean")) / F.col("std")).where(F.col("z") >= outlier)
    return rows.withColumn("kind", F.when(F.col("z") >= extreme, "extreme_outlier").otherwise("outlier")).withColumn(
        "deviation_pct", N.ratio_or_null(F.col(value) - F.col("mean"), "mean") * 100
    )
