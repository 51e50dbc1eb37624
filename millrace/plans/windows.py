"""Window functions and timelines on the test tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.operators import windows as W
from millrace.operators.narrowing import cut_by_rank
from millrace.operators.ordered import ranked, running_sum
from millrace.session import written
from millrace.plans.aggregates import FORECAST, forecast
from millrace.plans.registry import query


@query(
    "row_number",
    "SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
)
def row_number(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranked(rows, ["o_orderpriority"], "o_totalprice", tie="o_orderkey", row_number="rank")


@query(
    "rank_dense_rank",
    "SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice DESC) AS rank, dense_rank() OVER (ORDER BY p_retailprice DESC) AS dense_rank FROM part",
)
def rank_dense_rank(t):
    rows = t.part.select("p_partkey", "p_retailprice")
    return ranked(rows, [], "p_retailprice", rank="rank", dense_rank="dense_rank")


@query(
    "running_total",
    "SELECT o_orderkey, o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS running_total FROM orders",
    digits="running_total:2",
)
def running_total(t):
    """By customer in date order, in blocks of one month, so a hot customer spreads over its months."""
    block = F.trunc(F.to_date("o_orderdate"), "month")
    out = running_sum(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", block, "running_total")
    return out.select("o_orderkey", "o_custkey", "running_total")


def daily(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("amount"))


DAILY = "d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(value) AS amount FROM events GROUP BY 1)"


@query(
    "moving_avg",
    f"WITH {DAILY} SELECT day, amount, avg(amount) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving_avg_7d FROM d",
    digits="amount:2 moving_avg_7d",
)
def moving_avg(t):
    d = daily(t)
    return d.withColumn("moving_avg_7d", W.moving_average(d, [], "day", "amount", 7))


@query(
    "rolling_partial",
    f"WITH {DAILY} SELECT day, "
    + ", ".join(
        f"CASE WHEN count(*) OVER (ORDER BY day ROWS {w - 1} PRECEDING) >= 3 THEN avg(amount) OVER (ORDER BY day ROWS {w - 1} PRECEDING) END AS avg_{w}"
        for w in (3, 5, 8)
    )
    + " FROM d",
    digits="avg_3 avg_5 avg_8",
)
def rolling_partial(t):
    d = daily(t)
    return d.select("day", *[W.moving_average(d, [], "day", "amount", w, min(3, w)).alias(f"avg_{w}") for w in (3, 5, 8)])


def by_month(t):
    return A.monthly(t.orders, "o_orderdate", "o_totalprice")


MONTHS = "m AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)"


@query(
    "lag_lead",
    f"WITH {MONTHS} SELECT month, lag(total) OVER w AS previous, lead(total) OVER w AS following, total - lag(total) OVER w AS change FROM m WINDOW w AS (ORDER BY month)",
    digits="previous:1 following:1 change:1",
)
def lag_lead(t):
    w = Window.orderBy("month")
    prev = F.lag("total").over(w)
    return by_month(t).select(
        "month", prev.alias("previous"), F.lead("total").over(w).alias("following"), (F.col("total") - prev).alias("change")
    )


@query(
    "growth_pct",
    f"WITH {MONTHS} SELECT month, (total - lag(total) OVER w) / lag(total) OVER w * 100 AS growth_pct FROM m WINDOW w AS (ORDER BY month)",
    digits="growth_pct",
)
def growth_pct(t):
    prev = F.lag("total").over(Window.orderBy("month"))
    return by_month(t).select("month", ((F.col("total") - prev) / prev * 100).alias("growth_pct"))


@query(
    "ntile",
    "WITH s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1) SELECT o_custkey, ntile(4) OVER (ORDER BY spend DESC, o_custkey) AS quartile FROM s",
)
def ntile(t):
    """Quartile by the rows at which tiles start: the first n % 4 tiles hold one more row."""
    spend = written(t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spend")), "spend")
    starts = [(i / 4, lambda n, i=i: F.floor(n / 4) * i + F.least(n % 4, F.lit(i))) for i in (1, 2, 3)]
    out = cut_by_rank(spend, [], "spend", "o_custkey", starts, "tile", descending=True)
    return out.select("o_custkey", (F.col("tile") + 1).cast("long").alias("quartile"))


@query(
    "first_last_value",
    """
    SELECT p_partkey, p_brand, first_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS highest_priced,
      last_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lowest_priced FROM part
    """,
)
def first_last_value(t):
    """First and last by group are one aggregate row, joined back."""
    order = F.struct(F.col("p_retailprice"), -F.col("p_partkey"))
    ends = t.part.groupBy(F.col("p_brand").alias("__b")).agg(
        F.max_by("p_name", order).alias("highest_priced"), F.min_by("p_name", order).alias("lowest_priced")
    )
    return t.part.join(ends, F.col("p_brand") == F.col("__b")).select("p_partkey", "p_brand", "highest_priced", "lowest_priced")


@query(
    "sequence_gaps",
    "SELECT l_orderkey, previous FROM (SELECT l_orderkey, lag(l_orderkey) OVER (ORDER BY l_orderkey) AS previous FROM (SELECT DISTINCT l_orderkey FROM lineitem)) WHERE l_orderkey - previous > 1",
)
def sequence_gaps(t):
    """Order numbers without any line."""
    return W.sequence_gaps(t.lineitem.select("l_orderkey").distinct(), "l_orderkey", 10_000)


@query(
    "dedupe_latest",
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def dedupe_latest(t):
    rows = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    return W.latest_per_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value"
    )


@query(
    "latest_earliest_per_cell",
    "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS latest, arg_min(value, (ts, event_id)) AS earliest, count(*) AS n FROM events GROUP BY ALL",
)
def latest_earliest_per_cell(t):
    return W.latest_and_earliest(t.events, ["user_id", "event_type"], ["ts", "event_id"], "value")


TODAY = "2024-01-30"


@query(
    "streak_days",
    f"""
    WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events),
    r AS (SELECT user_id, max(day) AS last, count(*) AS length FROM (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS run FROM d) GROUP BY user_id, run)
    SELECT user_id, coalesce(max(length) FILTER (WHERE last >= DATE '{TODAY}' - 1 AND last <= DATE '{TODAY}'), 0) AS streak_days FROM r GROUP BY 1
    """,
)
def streak_days(t):
    return W.streak_days(t.events, "user_id", "ts", TODAY)


@query(
    "zero_filled_daily",
    f"""
    WITH u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, DATE '{TODAY}' - i::INT AS day FROM u, range(7) r(i)),
    s AS (SELECT user_id, ts::DATE AS day, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, coalesce(v, 0) AS total FROM g LEFT JOIN s USING (user_id, day)
    """,
    digits="total",
)
def zero_filled_daily(t):
    bought = t.events.withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return W.zero_filled_daily(bought, "user_id", "ts", "value", TODAY)


@query(
    "period_delta",
    f"""WITH {MONTHS}, p AS (SELECT month, total / n / 1000 AS current, lag(total / n / 1000) OVER (ORDER BY month) AS previous FROM m)
    SELECT month, current - previous AS delta, CASE WHEN previous IS NULL THEN 'no_data' WHEN current - previous > 5 THEN 'improving'
      WHEN current - previous < -5 THEN 'declining' ELSE 'stable' END AS direction FROM p""",
    digits="delta",
)
def period_delta(t):
    cur = F.col("total") / F.col("n") / 1000
    rows = by_month(t).select("month", cur.alias("current"))
    prev = F.lag("current").over(Window.orderBy("month"))
    rows = rows.withColumn("previous", prev)
    c, p = F.col("current"), F.col("previous")
    return rows.select("month", (c - p).alias("delta"), W.trend_direction(c, p).alias("direction"))


@query(
    "half_split_compare",
    """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    h AS (SELECT event_type, avg(value) FILTER (WHERE i <= n // 2) AS first_mean, avg(value) FILTER (WHERE i > n // 2) AS second_mean FROM r GROUP BY 1)
    SELECT *, CASE WHEN second_mean > first_mean THEN 'improving' ELSE 'declining' END AS trend FROM h
    """,
    digits="first_mean second_mean",
)
def half_split_compare(t):
    return W.half_split(t.events, ["event_type"], "ts", "event_id", "value", F.to_date("ts"))


@query(
    "improving_counts",
    f"""WITH {FORECAST}, e AS (SELECT o_orderpriority, month, round(CASE WHEN actual <> 0 THEN abs(actual - forecast) / abs(actual) * 100 ELSE 0 END, 1) AS err FROM f),
    l AS (SELECT *, lag(err) OVER (PARTITION BY o_orderpriority ORDER BY month) AS prev FROM e),
    c AS (SELECT o_orderpriority, count(*) FILTER (WHERE err < prev) AS improving, count(*) FILTER (WHERE err > prev) AS declining FROM l GROUP BY 1)
    SELECT *, CASE WHEN improving > declining THEN 'Improving' WHEN declining > improving THEN 'Declining' ELSE 'Stable' END AS trend FROM c""",
)
def improving_counts(t):
    return W.improving_counts(forecast(t), ["o_orderpriority"], "month", "forecast", "actual")


KINDS = {"error": "alert", "click": "investigation", "view": "communication", "purchase": "deployment", "signup": "confirmation"}
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
#: What an event says, by its id: plain words, one keyword, several phases in one message.
MESSAGES = ("Routine entry", "Alert triggered by a latency increase", "Looking into it, checking the logs", "Paging the incident commander", "Rollback deployed, restarting", "Error rate is back, resolved and verified", "Alarm fired; escalating to the war room")
MESSAGE_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END"


def _phase_sql():
    """The best of the phases' scores, by the lists of the operator."""
    parts = []
    for place, (name, (words, kinds)) in enumerate(W.PHASES.items()):
        score = " + ".join([f"contains(lower({MESSAGE_SQL}), '{w}')::INT * 2" for w in words] + [f"coalesce(({KIND_SQL}) IN ({', '.join(repr(k) for k in kinds)}), false)::INT * 3"])
        parts.append(f"{{'score': {score}{' + (value > 150)::INT * 2' if name == 'escalation' else ''}, 'place': {-place}, 'name': '{name}'}}")
    return f"list_max([{', '.join(parts)}])"


def timeline(t):
    """Events of a user as one incident: message from the id, kind from the event type, severity from the value."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    rows = t.events.withColumn("kind", kind).withColumn("severity", F.when(F.col("value") > 150, 4).otherwise(1))
    message = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    # the phase is read in several passes: its keywords are looked for once
    phase = W.phase_of(message, F.col("kind"), F.col("severity")).alias("phase")
    return written(rows.select("event_id", "user_id", "ts", "kind", phase), "timeline")


PHASE_CTE = f"""
    b AS (SELECT *, {_phase_sql()} AS best, {KIND_SQL} AS kind FROM events), e AS (SELECT * EXCLUDE (best), CASE WHEN best.score > 0 THEN best.name ELSE 'triage' END AS phase FROM b),
    c AS (SELECT *, CASE WHEN phase IS DISTINCT FROM lag(phase) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS fresh FROM e),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM c),
    s AS (SELECT user_id, run, any_value(phase) AS phase, min(ts) AS "start", max(ts) AS "end", count(*) AS events, date_diff('microsecond', min(ts), max(ts)) / 60000000.0 AS minutes FROM r GROUP BY 1, 2)
"""


@query("phase_segments", f'WITH {PHASE_CTE} SELECT user_id, run, phase, "start", "end", events, minutes FROM s', digits="minutes")
def phase_segments(t):
    return W.phase_segments(timeline(t), ["user_id"], ["ts", "event_id"], "ts", "phase")


@query(
    "event_gaps",
    f"""WITH {PHASE_CTE},
    g AS (SELECT user_id, ts AS at_ts, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 60000000.0 AS gap_minutes, 15 AS threshold, 'event' AS kind FROM events),
    m AS (SELECT user_id, ts AS at_ts, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 60000000.0 AS gap_minutes, 30 AS threshold, 'communication' AS kind FROM e WHERE kind = 'communication'),
    p AS (SELECT user_id, "end" AS at_ts, date_diff('microsecond', "end", lead("start") OVER w) / 60000000.0 AS gap_minutes,
      CASE phase || '_to_' || lead(phase) OVER w WHEN 'detection_to_triage' THEN 15 WHEN 'triage_to_mitigation' THEN 30 WHEN 'mitigation_to_resolution' THEN 120 ELSE 45 END AS threshold, 'phase' AS kind
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY run)),
    a AS (SELECT * FROM g WHERE gap_minutes >= 15 UNION ALL SELECT * FROM m WHERE gap_minutes >= 30 UNION ALL SELECT * FROM p WHERE gap_minutes > threshold)
    SELECT user_id, at_ts, kind, gap_minutes, CASE WHEN gap_minutes >= 2 * threshold THEN 'critical' ELSE 'warning' END AS severity FROM a""",
    digits="gap_minutes",
)
def event_gaps(t):
    rows = timeline(t)
    order = ["ts", "event_id"]
    cols = ["user_id", F.col("ts").alias("at_ts")]
    all_gaps = W.event_gaps(rows, ["user_id"], order, "ts", 15).select(*cols, F.lit("event").alias("kind"), "gap_minutes", "severity")
    talk = W.event_gaps(rows.where("kind = 'communication'"), ["user_id"], order, "ts", 30)
    talk = talk.select(*cols, F.lit("communication").alias("kind"), "gap_minutes", "severity")
    phases = W.phase_gaps(W.phase_segments(rows, ["user_id"], order, "ts", "phase"), ["user_id"])
    phases = phases.select("user_id", F.col("end").alias("at_ts"), F.lit("phase").alias("kind"), "gap_minutes", "severity")
    return all_gaps.unionByName(talk).unionByName(phases)


def _span(a, b):
    return f"date_diff('microsecond', {a}, {b}) / 60000000.0"


@query(
    "response_metrics",
    f"""WITH {PHASE_CTE}, f AS (SELECT user_id, min(ts) AS a, max(ts) AS z, min(ts) FILTER (WHERE phase = 'detection') AS d,
      min(ts) FILTER (WHERE phase = 'mitigation') AS m, min(ts) FILTER (WHERE phase = 'resolution') AS r FROM e GROUP BY 1)
    SELECT user_id, {_span('a', 'd')} AS to_detection, {_span('a', 'm')} AS to_mitigation, {_span('a', 'r')} AS to_resolution,
      {_span('d', 'r')} AS detection_to_resolution, {_span('a', 'z')} AS duration FROM f""",
    digits="to_detection to_mitigation to_resolution detection_to_resolution duration",
)
def response_metrics(t):
    return W.response_metrics(timeline(t), ["user_id"], "ts", "phase")


@query(
    "zscore_rows",
    """
    WITH s AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM events GROUP BY 1)
    SELECT event_id, event_type, abs(value - mean) / std AS z, CASE WHEN abs(value - mean) / std >= 3 THEN 'extreme_outlier' ELSE 'outlier' END AS kind,
      (value - mean) / mean * 100 AS deviation_pct FROM events JOIN s USING (event_type) WHERE n >= 3 AND abs(value - mean) / std >= 2
    """,
    digits="z deviation_pct",
)
def zscore_rows(t):
    return W.zscore_rows(t.events, ["event_type"], "value").select("event_id", "event_type", "z", "kind", "deviation_pct")
