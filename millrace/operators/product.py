"""Retention, funnels, attribution, campaigns, growth, prioritisation."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import numeric as N

# Low, target and high benchmark by metric and channel.
BENCHMARKS = {
    "ctr": {
        "email": (1.0, 2.5, 5.0), "paid_search": (1.5, 3.5, 7.0), "paid_social": (0.5, 1.2, 3.0), "display": (0.05, 0.1, 0.5),
        "organic_search": (1.5, 3.0, 8.0), "organic_social": (0.5, 1.5, 4.0), "referral": (1.0, 3.0, 6.0), "direct": (2.0, 4.0, 8.0),
        "default": (0.5, 2.0, 5.0),
    },
    "roas": {
        "email": (30.0, 42.0, 60.0), "paid_search": (2.0, 4.0, 8.0), "paid_social": (1.5, 3.0, 6.0), "display": (0.5, 1.5, 3.0),
        "organic_search": (5.0, 10.0, 20.0), "organic_social": (3.0, 6.0, 12.0), "referral": (3.0, 5.0, 10.0), "direct": (4.0, 8.0, 15.0),
        "default": (2.0, 4.0, 8.0),
    },
    "cpa": {
        "email": (5.0, 15.0, 40.0), "paid_search": (20.0, 50.0, 150.0), "paid_social": (15.0, 40.0, 100.0), "display": (30.0, 75.0, 200.0),
        "organic_search": (5.0, 20.0, 60.0), "organic_social": (10.0, 30.0, 80.0), "referral": (10.0, 25.0, 70.0), "direct": (5.0, 15.0, 50.0),
        "default": (15.0, 45.0, 120.0),
    },
}
# Words that place a step name in a class, in the order they are tried.
STEP_CLASSES = {
    "landing_page": ["land", "visit", "page", "home"],
    "clicked_sign_up": ["cta", "click", "signup", "sign up", "register", "start"],
    "filled_form": ["form", "fill", "detail", "info", "enter"],
    "email_verified": ["email", "verif", "confirm", "activate"],
}
# Level weights of the reach-impact-confidence-effort score.
IMPACT = {"massive": 3.0, "high": 2.0, "medium": 1.0, "low": 0.5, "minimal": 0.25}
CONFIDENCE = {"high": 100, "medium": 80, "low": 50}
EFFORT = {"xl": 13, "l": 8, "m": 5, "s": 3, "xs": 1}


# ---- retention --------------------------------------------------------------


def _active_days(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Distinct (user, day): a hot user shrinks to its days before any join."""
    return df.select(F.col(user).alias("user"), F.to_date(ts).alias("day")).distinct()


def retention_curve(df: DataFrame, user: str, ts: str, max_period: int) -> DataFrame:
    """Share of users active n days after their first day."""
    days = _active_days(df, user, ts)
    first = days.groupBy("user").agg(F.min("day").alias("first"))
    active = days.join(first, "user").groupBy(F.datediff("day", "first").cast("long").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    base = first.agg(F.count(F.lit(1)).alias("base"))
    spine = df.sparkSession.range(max_period + 1).select(F.col("id").alias("period"))
    out = spine.join(active, "period", "left").crossJoin(F.broadcast(base))
    n = F.coalesce("n", F.lit(0))
    return out.select("period", n.alias("active_users"), (n / F.col("base")).alias("retention_rate"))


def cohort_matrix(df: DataFrame, user: str, ts: str, max_period: int, grain: str = "week") -> DataFrame:
    """Cohort by first active week or month and age in days: active users, cohort size, rate."""
    key = D.iso_week_key("first") if grain == "week" else D.month_key("first")
    days = _active_days(df, user, ts)
    first = days.groupBy("user").agg(F.min("day").alias("first")).withColumn("cohort", key)
    sizes = first.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"))
    aged = days.join(first, "user").withColumn("age_days", F.datediff("day", "first").cast("long"))
    active = aged.groupBy("cohort", "age_days").agg(F.count(F.lit(1)).alias("n"))
    grid = sizes.select("cohort", "cohort_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_period).cast("long"))).alias("age_days"))
    out = grid.join(active, ["cohort", "age_days"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("cohort", "age_days", n.alias("active_users"), "cohort_size", (n / F.col("cohort_size")).alias("retention_rate"))


# ---- funnels ----------------------------------------------------------------


def stage_counts(df: DataFrame, user: str, stage: str, stages: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Distinct users of every listed stage (and key), missing stages as 0."""
    spine = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], "pos int, stage string")
    counts = df.where(F.col(stage).isin(list(stages))).groupBy(*keys, F.col(stage).alias("stage")).agg(F.countDistinct(user).alias("users"))
    grid = F.broadcast(spine) if not keys else counts.select(*keys).distinct().crossJoin(F.broadcast(spine))
    out = grid.join(counts, [*keys, "stage"], "left")
    return out.select(*keys, "pos", "stage", F.coalesce("users", F.lit(0)).alias("users"))


def stage_funnel(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Conversion from the previous and the first stage; a missing base gives 1 and 0."""
    w = Window.partitionBy(*keys).orderBy("pos")
    before, first = F.lag("users").over(w), F.first("users").over(w)
    return counts.select(
        *keys,
        "stage",
        "users",
        F.when(before > 0, F.col("users") / before).otherwise(1.0).alias("conversion_from_previous"),
        F.when(first > 0, F.col("users") / first).otherwise(0.0).alias("conversion_from_first"),
    )


def count_funnel(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Conversion, drop-off and the marks of the largest absolute and relative drop."""
    w = Window.partitionBy(*keys).orderBy("pos")
    whole = Window.partitionBy(*keys)
    rows = counts.withColumn("before", F.lag("users").over(w)).withColumn("first", F.first("users").over(w))
    rate = F.when(F.col("before").isNull(), 100.0).otherwise(N.safe_divide("users", "before") * 100)
    rows = rows.withColumn("conversion_rate", rate)
    rows = rows.withColumn("dropoff", F.coalesce(F.col("before") - F.col("users"), F.lit(0)))
    rows = rows.withColumn("dropoff_rate", F.when(F.col("before").isNull(), 0.0).otherwise(100 - F.col("conversion_rate")))

    def worst(c: str) -> Column:
        place = F.max(F.struct(F.col(c), -F.col("pos"))).over(whole)
        return (F.col(c) > 0) & (place == F.struct(F.col(c), -F.col("pos")))

    return rows.select(
        *keys, "pos", "stage", "users", (N.safe_divide("users", "first") * 100).alias("cumulative_conversion"), "conversion_rate", "dropoff", "dropoff_rate",
        worst("dropoff").alias("bottleneck_absolute"), worst("dropoff_rate").alias("bottleneck_relative"),
    )


def segment_funnel(counts: DataFrame, segment: str) -> DataFrame:
    """Overall conversion by segment and its rank."""
    w = counts.groupBy(segment).agg(
        F.min_by("users", "pos").alias("total_entries"), F.max_by("users", "pos").alias("total_conversions")
    )
    w = w.withColumn("overall_conversion", N.safe_divide("total_conversions", "total_entries") * 100)
    return w.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overall_conversion"), segment)))


def activation_funnel(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst step and the users gained at the end if its drop-off is halved."""
    w = Window.partitionBy(*keys).orderBy("pos")
    rows = counts.withColumn("before", F.lag("users").over(w))
    rows = rows.withColumn("drop", F.when(F.col("before") > 0, (F.col("before") - F.col("users")) / F.col("before")).otherwise(0.0))
    out = rows.groupBy(*keys).agg(
        F.min_by("users", "pos").alias("start"),
        F.max_by("users", "pos").alias("activated"),
        F.max(F.struct(F.col("drop"), (-F.col("pos")).alias("npos"), F.col("stage"), F.col("before"), F.col("users"))).alias("w"),
    )
    worst = F.col("w.drop") > 0
    # the reference rounds the worst drop to a tenth of a percent before halving it
    half = F.bround(F.col("w.drop") * 100, 1) / 200
    saved = F.floor(F.col("w.before") * half)
    # the product of the later step rates telescopes to the last count over the count at the worst step
    later = N.safe_divide("activated", F.col("w.users"))
    overall = N.safe_divide("activated", "start") * 100
    score = F.when(overall < 5, F.floor(overall * 10)).otherwise(N.clamp(F.floor(overall * 5)))
    return out.select(
        *keys, "start", "activated", overall.alias("overall_conversion"),
        F.when(worst, F.col("w.stage")).alias("worst_step"),
        (F.col("w.drop") * 100).alias("worst_drop_rate"),
        F.when(worst, saved).cast("long").alias("users_saved"),
        F.when(worst, F.floor(saved * later)).cast("long").alias("additional_activated"),
        score.cast("long").alias("score"),
    )


def step_class(name: Column) -> Column:
    text, out = F.lower(name), None
    for label, words in STEP_CLASSES.items():
        test = F.lit(False)
        for word in words:
            test = test | text.contains(word)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("default")


def step_drop_rules(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Class of every step, drop level and the funnel score with its label."""
    w = Window.partitionBy(*keys).orderBy("pos")
    whole = Window.partitionBy(*keys)
    rows = counts.withColumn("before", F.lag("users").over(w))
    drop = F.when(F.col("before").isNull(), 0.0).otherwise(1 - N.safe_divide("users", "before"))
    rows = rows.withColumn("drop", drop).withColumn("first", F.min_by("users", "pos").over(whole)).withColumn("last", F.max_by("users", "pos").over(whole))
    fine = F.when(F.col("drop") > 0.6, 10).when(F.col("drop") > 0.4, 5).otherwise(0)
    base = F.least(F.lit(100.0), F.log1p(N.safe_divide("last", "first")) / math.log1p(0.10) * 100)
    rows = rows.withColumn("score", F.greatest(F.lit(0.0), F.bround(base - F.sum(fine).over(whole), 0)).cast("long"))
    level = F.when(F.col("drop") > 0.50, "high_drop").when(F.col("drop") > 0.25, "medium_drop").otherwise("healthy")
    label = N.threshold_label("score", [(80, "Excellent"), (60, "Good"), (40, "Fair"), (20, "Poor")], "Critical")
    return rows.select(*keys, "stage", "users", (F.col("drop") * 100).alias("drop_pct"), step_class(F.col("stage")).alias("step_class"), level.alias("drop_level"), "score", label.alias("label"))


# ---- attribution ------------------------------------------------------------


def journeys(touches: DataFrame, journey: str, channel: str, ts: str, tie: str, revenue: Column, converted: Column) -> DataFrame:
    """One row per journey: touches, first and last channel, revenue, conversion. All parts are combinable aggregates."""
    order = F.struct(ts, tie)
    return touches.groupBy(F.col(journey).alias("journey")).agg(
        F.count(F.lit(1)).alias("touches"),
        F.min_by(channel, order).alias("first_channel"),
        F.max_by(channel, order).alias("last_channel"),
        F.max(ts).alias("last_ts"),
        F.sum(revenue).alias("revenue"),
        F.max(converted).alias("converted"),
    )


def _credit(rows: DataFrame, channel: str, credit: Column) -> DataFrame:
    return rows.groupBy(F.col(channel).alias("channel")).agg(F.sum(credit).alias("credit"))


def touch_edge(j: DataFrame, edge: str) -> DataFrame:
    """All credit to the first or last touch; a missing revenue counts as 1."""
    return _credit(j.where("converted"), f"{edge}_channel", F.coalesce("revenue", F.lit(1.0)))


def _by_channel(touches: DataFrame, journey: str, channel: str) -> DataFrame:
    return touches.groupBy(F.col(journey).alias("journey"), F.col(channel).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


def touch_linear(touches: DataFrame, j: DataFrame, journey: str, channel: str) -> DataFrame:
    """Equal split: touches are counted by journey and channel before the join."""
    rows = _by_channel(touches, journey, channel).join(j.where("converted"), "journey")
    return _credit(rows, "channel", F.coalesce("revenue", F.lit(1.0)) * F.col("n") / F.col("touches"))


def touch_position(touches: DataFrame, j: DataFrame, journey: str, channel: str) -> DataFrame:
    """40/20/40; two touches half each, one touch all."""
    rows = _by_channel(touches, journey, channel).join(j.where("converted"), "journey")
    rev = F.coalesce("revenue", F.lit(1.0))
    first = (F.col("channel") == F.col("first_channel")).cast("int")
    last = (F.col("channel") == F.col("last_channel")).cast("int")
    middle = F.col("n") - first - last
    share = (
        F.when(F.col("touches") == 1, F.lit(1.0))
        .when(F.col("touches") == 2, (first + last) * 0.5)
        .otherwise((first + last) * 0.4 + 0.2 * middle / F.greatest(F.col("touches") - 2, F.lit(1)))
    )
    return _credit(rows, "channel", rev * share)


def touch_time_decay(touches: DataFrame, j: DataFrame, journey: str, channel: str, ts: str, half_life_days: float = 7.0) -> DataFrame:
    """Weight halves every ``half_life_days`` before the last touch, normalised by journey.

    Weights are first summed by journey, channel and 30-day block relative to the block end,
    then moved to the journey's last touch: only block sums meet the journey row.
    """
    rate = math.log(2) / half_life_days
    day = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(86_400_000_000.0)
    rows = touches.select(F.col(journey).alias("journey"), F.col(channel).alias("channel"), day.alias("d"))
    rows = rows.withColumn("b", F.floor(F.col("d") / 30) * 30 + 30)
    sums = rows.groupBy("journey", "channel", "b").agg(F.sum(F.exp(-rate * (F.col("b") - F.col("d")))).alias("s"))
    last = F.unix_micros(F.col("last_ts").cast("timestamp")) / F.lit(86_400_000_000.0)
    moved = sums.join(j.where("converted"), "journey").withColumn("w", F.col("s") * F.exp(-rate * (last - F.col("b"))))
    per = moved.groupBy("journey", "channel").agg(F.sum("w").alias("w"), F.first(F.coalesce("revenue", F.lit(1.0))).alias("rev"))
    total = per.groupBy("journey").agg(F.sum("w").alias("total"))
    return _credit(per.join(total, "journey"), "channel", N.safe_divide("w", "total") * F.col("rev"))


MODELS: dict[str, Callable[..., DataFrame]] = {
    "first-touch": lambda touches, j, journey, channel, ts, half: touch_edge(j, "first"),
    "last-touch": lambda touches, j, journey, channel, ts, half: touch_edge(j, "last"),
    "linear": lambda touches, j, journey, channel, ts, half: touch_linear(touches, j, journey, channel),
    "time-decay": lambda touches, j, journey, channel, ts, half: touch_time_decay(touches, j, journey, channel, ts, half),
    "position-based": lambda touches, j, journey, channel, ts, half: touch_position(touches, j, journey, channel),
}


def run_model(name: str, touches: DataFrame, j: DataFrame, journey: str, channel: str, ts: str, half_life_days: float = 7.0) -> DataFrame:
    """Attribution model by name."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; choose from {', '.join(MODELS)}")
    return MODELS[name](touches, j, journey, channel, ts, half_life_days)


def journey_summary(touches: DataFrame, j: DataFrame, channel: str) -> DataFrame:
    """Journeys, conversions, revenue (missing as 0), and the channels seen."""
    seen = touches.select(channel).distinct().agg(F.array_join(F.array_sort(F.collect_set(channel)), ",").alias("channels"))
    out = j.agg(
        F.count(F.lit(1)).alias("total_journeys"), F.count_if("converted").alias("converted_journeys"),
        F.coalesce(F.sum(F.when(F.col("converted"), F.coalesce("revenue", F.lit(0.0)))), F.lit(0.0)).alias("total_revenue"),
    )
    out = out.withColumn("conversion_rate", N.safe_divide("converted_journeys", "total_journeys") * 100)
    return out.crossJoin(F.broadcast(seen))


# ---- campaigns --------------------------------------------------------------


def campaign_metrics(df: DataFrame) -> DataFrame:
    """Rates over spend, revenue, impressions, clicks, leads, customers; null on a zero base, 0 for ROI and ROAS."""
    s, r = F.col("spend"), F.col("revenue")
    out = df.withColumn("profit", r - s).withColumn("roi", N.safe_divide(r - s, s) * 100).withColumn("roas", N.safe_divide(r, s))
    rates = {
        "cpa": (s, "customers", 1), "cpl": (s, "leads", 1), "ctr": (F.col("clicks"), "impressions", 100), "cvr": (F.col("customers"), "leads", 100),
        "cpc": (s, "clicks", 1), "cpm": (s, "impressions", 1000), "lead_rate": (F.col("leads"), "clicks", 100),
    }
    for name, (top, base, scale) in rates.items():
        out = out.withColumn(name, F.when(F.col(base) > 0, top / F.col(base) * scale))
    return out


def benchmark_assess(df: DataFrame, channel: str, metrics: Sequence[str] = ("ctr", "roas", "cpa")) -> DataFrame:
    """Band of every metric against its channel benchmark, the default channel for unknown ones; cost metrics read downwards."""
    rows = [(m, c, *v) for m in metrics for c, v in BENCHMARKS[m].items()]
    table = df.sparkSession.createDataFrame(rows, "metric string, bench string, low double, target double, high double")
    known = list(BENCHMARKS["ctr"])
    long = df.select(
        *[c for c in df.columns if c not in metrics],
        F.when(F.col(channel).isin(known), F.col(channel)).otherwise("default").alias("bench"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])),
    )
    keep = F.col("value").isNotNull() & ((F.col("metric") != "roas") | (F.col("value") > 0))
    rated = long.where(keep).join(F.broadcast(table), ["metric", "bench"])
    v, low, mid, high = F.col("value"), F.col("low"), F.col("target"), F.col("high")
    up = F.when(v >= high, "excellent").when(v >= mid, "good").when(v >= low, "below_target").otherwise("underperforming")
    down = F.when(v <= low, "excellent").when(v <= mid, "good").when(v <= high, "below_target").otherwise("underperforming")
    return rated.withColumn("assessment", F.when(F.col("metric") == "cpa", down).otherwise(up))


def channel_cac(df: DataFrame, channel: str, spend: Column, customer: str) -> DataFrame:
    """Cost per customer by channel, and blended over the channel sums."""
    by = df.groupBy(F.col(channel).alias("channel")).agg(F.sum(spend).alias("spend"), F.countDistinct(customer).alias("customers"))
    total = by.agg(F.lit("blended").alias("channel"), F.sum("spend").alias("spend"), F.sum("customers").alias("customers"))
    return by.unionByName(total).withColumn("cac", N.safe_divide("spend", "customers"))


def engagement_rate(parts: Sequence[Column], reach: Column) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
    return N.safe_divide(total, reach) * 100


def growth_snapshot(snapshots: DataFrame, keys: Sequence[str], ts: str, size: str, rate: str) -> DataFrame:
    """Growth between the first and last snapshot of every key; snapshots are one row per key and period."""
    w = Window.partitionBy(*keys)
    rated = snapshots.withColumn("__r", F.when(F.col(rate) > 0, 1).otherwise(0))
    rated = rated.withColumn("__i", F.sum("__r").over(w.orderBy(ts))).withColumn("__n", F.sum("__r").over(w))
    early = (F.col("__r") == 1) & (F.col("__i") <= F.floor(F.col("__n") / 2))
    late = (F.col("__r") == 1) & (F.col("__i") > F.floor(F.col("__n") / 2))
    out = rated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("data_points"), F.min_by(size, ts).alias("first"), F.max_by(size, ts).alias("last"),
        F.greatest(F.datediff(F.max(ts), F.min(ts)), F.lit(1)).alias("days"), F.max("__n").alias("__n"),
        F.avg(F.when(early, F.col(rate))).alias("early"), F.avg(F.when(late, F.col(rate))).alias("late"),
    )
    daily = (F.col("last") - F.col("first")) / F.col("days")
    return out.where("data_points >= 2").select(
        *keys, "data_points", "last", "days", daily.alias("daily_growth"), (daily * 7).alias("weekly_growth"), (daily * 30).alias("monthly_projection"),
        (N.ratio_or_null(F.col("last") - F.col("first"), "first") * 100).alias("growth_percent"),
        F.when(F.col("__n") >= 2, F.when(F.col("late") > F.col("early"), "improving").otherwise("declining")).alias("engagement_trend"),
    )


def milestone_eta(growth: DataFrame, keys: Sequence[str], target: float) -> DataFrame:
    """Days to the target at the current slope."""
    status = F.when(F.col("last") >= target, "reached").when(F.col("daily_growth") <= 0, "not growing").otherwise("projected")
    return growth.select(
        *keys, status.alias("status"), F.when(status == "projected", (F.lit(float(target)) - F.col("last")) / F.col("daily_growth")).alias("days_needed")
    )


def keyword_scores(df: DataFrame, volume: str, competing: str, relevance: str) -> DataFrame:
    """Competition, volume class, difficulty and potential of keyword rows."""
    v, c, r = F.col(volume), F.col(competing), F.col(relevance)
    level = N.threshold_label(c, [(1000, "low"), (5000, "medium"), (10000, "high")], "very_high", descending=False)
    size = N.threshold_label(v, [(1000, "very_low"), (5000, "low"), (20000, "medium"), (100000, "high")], "very_high", descending=False)
    hard = F.when(c == 0, 0.0).otherwise((F.least(c / 50000, F.lit(1.0)) * 0.7 + F.least(v / 1000000, F.lit(1.0)) * 0.3) * 100)
    room = F.when(c > 0, F.greatest(30 - c / 500, F.lit(0.0))).otherwise(30.0)
    potential = F.least(F.least(v / 100000 * 40, F.lit(40.0)) + room + r * 30, F.lit(100.0))
    return df.withColumn("competition_level", level).withColumn("volume_category", size).withColumn("difficulty", hard).withColumn("potential", potential)


# ---- prioritisation ---------------------------------------------------------


def rice_score(reach: Column, impact: Column, confidence: Column, effort: Column) -> Column:
    i, c = N.level_value(impact, IMPACT, 1.0), N.level_value(confidence, CONFIDENCE, 50) / 100
    return N.safe_divide(reach * i * c, N.level_value(effort, EFFORT, 5))


def rice_kind(impact: Column, effort: Column) -> Column:
    """Quick wins: strong impact at little effort; big bets: strong impact at much effort."""
    strong = F.lower(impact).isin("massive", "high")
    return F.when(strong & F.lower(effort).isin("xs", "s"), "quick_win").when(strong & F.lower(effort).isin("l", "xl"), "big_bet").otherwise("other")


def priority_frameworks(df: DataFrame, i: Mapping[str, Column], e: Mapping[str, Column], daily_cost: Column, delay_cost: Column, team_size: int) -> DataFrame:
    """Cost-of-delay, weighted-shortest-job and RICE scores from impact columns ``i`` and effort columns ``e``."""
    urgency = N.clamp(daily_cost * 10, 1, 10)
    value = i["customer"] * 0.3 + i["revenue"] * 0.3 + i["quality"] * 0.2 + i["velocity"] * 0.2
    risk = i["security"] * 0.6 + i["quality"] * 0.4
    cod = (value * 0.3 + urgency * 0.3 + risk * 0.2 + i["velocity"] * 0.2) / F.greatest(F.lit(1.0), e["hours"] * e["risk"] / 8)
    points = F.greatest(F.lit(1.0), e["points"].cast("double"))
    wsjf = (i["customer"] * 0.4 + i["revenue"] * 0.6 + N.clamp(delay_cost / 10, 1, 10) + i["security"] * 0.5 + i["quality"] * 0.5) / points
    reach = F.least(F.lit(10.0), F.lit(float(team_size)) * i["velocity"] / 5)
    rice = reach * (i["customer"] * 0.3 + i["revenue"] * 0.3 + i["quality"] * 0.4) * (e["confidence"] * 10) / points
    return df.withColumn("cost_of_delay_score", cod).withColumn("wsjf_score", wsjf).withColumn("rice_score", rice)


def bcg_quadrant(df: DataFrame, item: str, revenue: str, growth_pct: str) -> DataFrame:
    """Growth and relative share (own over the largest other) to a quadrant, with its share of all revenue.

    The largest two rows are enough to know every row's largest other, so no global window is needed.
    """
    top = df.groupBy().agg(F.max(F.struct(F.col(revenue).alias("r"), F.col(item).alias("i"))).alias("t"), F.sum(revenue).alias("total"))
    rows = df.crossJoin(F.broadcast(top.select("t.i", "t.r", "total")))
    second = rows.where(F.col(item) != F.col("i")).agg(F.max(revenue).alias("second"))
    rows = rows.crossJoin(F.broadcast(second))
    other = F.when(F.col(item) == F.col("i"), F.col("second")).otherwise(F.col("r"))
    share = N.safe_divide(revenue, other)
    fast, leads = F.col(growth_pct) >= 10.0, share >= 1.0
    quadrant = F.when(fast & leads, "Star").when(~fast & leads, "Cash Cow").when(fast & ~leads, "Question Mark").otherwise("Dog")
    return rows.select(*df.columns, share.alias("share_ratio"), quadrant.alias("quadrant"), N.safe_divide(revenue, "total").alias("revenue_share"))
