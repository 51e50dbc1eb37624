"""Registers, delivery and compliance tables. Orders stand in for controls, secrets, risks and actions."""

from pyspark.sql import functions as F

from millrace.operators import registers as G
from millrace.plans.ops import at
from millrace.plans.registry import query

STATUS = ["Collected", "pending", "in progress", "Late", "N/A", "unknown", "done"]
NOW = "2000-01-01"


def controls(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(k, at(STATUS, k + F.col("o_custkey")).alias("status"), F.to_date("o_orderdate").alias("due"), F.col("o_orderpriority").alias("category"))
    return rows.withColumn("evidence", G.due_status(F.col("status"), F.col("due"), NOW))


CONTROLS = f"""
    c AS (SELECT o_orderkey, {STATUS}[(o_orderkey + o_custkey) % 7 + 1] AS status, o_orderdate::DATE AS due, o_orderpriority AS category FROM orders),
    e AS (SELECT *, CASE status WHEN 'Collected' THEN 'collected' WHEN 'done' THEN 'collected' WHEN 'N/A' THEN 'not_applicable' WHEN 'Late' THEN 'overdue' WHEN 'unknown' THEN 'not_started' ELSE CASE WHEN due < DATE '{NOW}' THEN 'overdue' ELSE 'pending' END END AS evidence FROM c)
"""


@query("due_classify", f"WITH {CONTROLS} SELECT o_orderkey, evidence FROM e")
def due_classify(t):
    return controls(t).select("o_orderkey", "evidence")


@query(
    "readiness_pct",
    f"""WITH {CONTROLS}, g AS (SELECT category, grouping(category)::INT AS is_total, count(*) AS total, count(*) FILTER (WHERE evidence = 'collected') AS collected, count(*) FILTER (WHERE evidence = 'overdue') AS overdue, count(*) FILTER (WHERE evidence <> 'not_applicable') AS applicable FROM e GROUP BY ROLLUP (category)),
    p AS (SELECT *, round_even(round(collected / applicable * 100, 8), 1) AS readiness_pct FROM g)
    SELECT *, CASE WHEN readiness_pct >= 90 THEN 'Audit Ready' WHEN readiness_pct >= 75 THEN 'Minor Gaps' WHEN readiness_pct >= 50 THEN 'Significant Gaps' ELSE 'Not Ready' END AS rating FROM p""",
    digits="readiness_pct:1",
)
def readiness_pct(t):
    return G.readiness(controls(t), "category", "evidence")


SECRETS = ["database", "api-key", "tls-certificate", "ssh-key", "service-token", "oauth-secret", "other"]


@query(
    "rotation_schedule",
    f"""
    WITH s AS (SELECT o_orderkey, {SECRETS}[o_orderkey % 7 + 1] AS kind, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS last FROM orders),
    d AS (SELECT *, CASE kind WHEN 'database' THEN 30 WHEN 'tls-certificate' THEN 60 WHEN 'service-token' THEN 1 ELSE 60 END AS interval_days FROM s),
    u AS (SELECT *, coalesce(last + interval_days, DATE '{NOW}') AS nr, CASE WHEN last IS NULL THEN -999 ELSE (last + interval_days) - DATE '{NOW}' END::INT AS days_until FROM d)
    SELECT o_orderkey, interval_days, strftime(nr, '%Y-%m-%d') AS next_rotation, days_until, CASE WHEN days_until <= 0 THEN 'CRITICAL' WHEN days_until <= 7 THEN 'HIGH' WHEN days_until <= 14 THEN 'MEDIUM' ELSE 'LOW' END AS urgency FROM u
    """,
)
def rotation_schedule(t):
    k = F.col("o_orderkey")
    s = t.orders.select(k, at(SECRETS, k).alias("kind"), F.when(k % 11 != 0, F.to_date("o_orderdate")).alias("last"))
    return G.rotation_schedule(s, "kind", "last", 60, NOW).select("o_orderkey", "interval_days", "next_rotation", "days_until", "urgency")


FMEA = "f AS (SELECT l_returnflag, (l_quantity % 10 + 1)::INT AS sev, (l_linenumber + 2)::INT AS occ, (l_suppkey % 10 + 1)::INT AS det FROM lineitem), r AS (SELECT *, sev * occ * det AS rpn, CASE WHEN sev >= 8 THEN 'CRITICAL' WHEN sev * occ * det >= 200 THEN 'HIGH' WHEN sev * occ * det >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS criticality FROM f)"


@query(
    "fmea_rpn",
    f"""WITH {FMEA}, o AS (SELECT l_returnflag, rpn, row_number() OVER (PARTITION BY l_returnflag ORDER BY rpn) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM r WHERE rpn > 0),
    m AS (SELECT l_returnflag, max(rpn) FILTER (WHERE i = n // 2)::DOUBLE AS rpn_median FROM o GROUP BY 1)
    SELECT l_returnflag, count(*) AS entries, min(rpn) AS rpn_min, max(rpn) AS rpn_max, avg(rpn) AS rpn_mean, count(*) FILTER (WHERE criticality = 'CRITICAL') AS critical, count(*) FILTER (WHERE criticality = 'HIGH') AS high,
      count(*) FILTER (WHERE criticality = 'MEDIUM') AS medium, count(*) FILTER (WHERE criticality = 'LOW') AS low, max(rpn_median) AS rpn_median FROM r JOIN m USING (l_returnflag) GROUP BY 1""",
    digits="rpn_mean",
)
def fmea_rpn(t):
    f = t.lineitem.select("l_returnflag", (F.col("l_quantity") % 10 + 1).cast("int").alias("sev"), (F.col("l_linenumber") + 2).cast("int").alias("occ"), (F.col("l_suppkey") % 10 + 1).cast("int").alias("det"))
    return G.fmea_summary(G.fmea(f, "sev", "occ", "det"), ["l_returnflag"])


CATS = ["technical", "resource", "schedule", "business", "financial", "regulatory", "other"]
RSTAT = ["open", "identified", "closed", "mitigating"]
STRATS = ["avoid", "mitigate", "transfer", "accept", "contingency"]


def risks(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(
        k, at(CATS, k).alias("category"), (c % 5 + 1).alias("probability"), (F.expr("o_custkey div 5") % 5 + 1).alias("impact"), at(RSTAT, k + c).alias("status"), at(STRATS, c + k * 2).alias("strategy"),
        F.slice(F.array(*[F.lit(x) for x in "abc"]), 1, (k % 4).cast("int")).alias("actions"), F.to_date("o_orderdate").alias("target"),
    )
    return G.risk_score(rows)


RISKS = f"""
    k AS (SELECT o_orderkey, {CATS}[o_orderkey % 7 + 1] AS category, o_custkey % 5 + 1 AS probability, o_custkey // 5 % 5 + 1 AS impact, {RSTAT}[(o_orderkey + o_custkey) % 4 + 1] AS status, {STRATS}[(o_custkey + o_orderkey * 2) % 5 + 1] AS strategy, o_orderkey % 4 AS actions, o_orderdate::DATE AS target FROM orders),
    s AS (SELECT *, probability * impact * CASE category WHEN 'technical' THEN 1.2 WHEN 'resource' THEN 1.1 WHEN 'business' THEN 1.3 WHEN 'financial' THEN 1.4 WHEN 'regulatory' THEN 1.5 ELSE 1 END::DOUBLE AS risk_score FROM k),
    l AS (SELECT *, CASE WHEN risk_score <= 8 THEN 'low' WHEN risk_score <= 15 THEN 'medium' WHEN risk_score <= 20 THEN 'high' ELSE 'critical' END AS risk_level FROM s)
"""


@query(
    "risk_score",
    f"WITH {RISKS} SELECT o_orderkey, risk_score, risk_level, CASE WHEN risk_level = 'low' THEN 'accept' WHEN probability >= 4 AND impact <= 2 THEN 'mitigate' WHEN probability <= 2 AND impact >= 4 THEN 'contingency' WHEN impact >= 4 THEN 'avoid' ELSE 'mitigate' END AS response FROM l",
    digits="risk_score",
)
def risk_score(t):
    return risks(t).select("o_orderkey", "risk_score", "risk_level", "response")


@query(
    "risk_categories",
    f"WITH {RISKS} SELECT category, count(*) AS risks, sum(risk_score) AS total_score, avg(risk_score) AS mean_score, max(risk_score) AS max_score FROM l WHERE status IN ('open', 'identified', 'mitigating') GROUP BY 1",
    digits="total_score mean_score max_score",
)
def risk_categories(t):
    return G.risk_categories(risks(t))


@query(
    "mitigation_effect",
    f"WITH {RISKS} SELECT strategy, grouping(strategy)::INT AS is_total, count(*) AS risks, avg(risk_score) AS mean_score, avg((actions > 0)::INT) AS coverage, avg(actions) AS actions_per_risk, avg((target < DATE '{NOW}')::INT) AS overdue_rate FROM l WHERE status IN ('open', 'identified', 'mitigating') GROUP BY ROLLUP (strategy)",
    digits="mean_score coverage:6 actions_per_risk:6 overdue_rate:6",
)
def mitigation_effect(t):
    return G.mitigation_effect(risks(t), NOW)


@query(
    "limit_forecast",
    """
    WITH d AS (SELECT user_id % 20 AS metric, ts::DATE AS day, avg(value) AS v FROM events GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day) AS i FROM d),
    g AS (SELECT metric, count(*) AS points, arg_max(v, day) AS current, regr_slope(v, i) AS slope, 22.0::DOUBLE AS target, 28.0::DOUBLE AS upper FROM i GROUP BY 1)
    SELECT metric, points, current, slope, target, upper, current + slope AS forecast, CASE WHEN current + slope > upper THEN 'high' ELSE 'medium' END AS risk_level FROM g WHERE points >= 5 AND slope <> 0 AND (current + slope > 26.4 OR current + slope > 25.2)
    """,
    digits="current slope:6 target upper forecast",
)
def limit_forecast(t):
    d = t.events.groupBy((F.col("user_id") % 20).alias("metric"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return G.limit_forecast(d, "metric", "day", "v", F.lit(22.0), F.lit(28.0))


@query(
    "control_limits",
    """SELECT event_id, CASE WHEN value > 60 THEN 'exceeds_upper_limit' ELSE 'below_lower_limit' END AS issue, CASE WHEN event_type IN ('error', 'purchase') THEN 'critical' ELSE 'high' END AS severity FROM events WHERE value > 60 OR value < 0.5""",
)
def control_limits(t):
    cat = F.when(F.col("event_type") == "error", "Regulatory").when(F.col("event_type") == "purchase", "Customer").otherwise("Process")
    rows = t.events.select("event_id", "value", F.lit(0.5).alias("lo"), F.lit(60.0).alias("hi"), cat.alias("category"))
    return G.control_limits(rows, "value", "lo", "hi", "category").select("event_id", "issue", "severity")


@query(
    "action_completion",
    f"""
    WITH a AS (SELECT ['high', 'medium', 'low'][o_orderkey % 3 + 1] AS priority, 'own' || (o_custkey % 9) AS owner, o_orderstatus = 'F' AS done, o_custkey % 8 - 1 AS span, o_orderdate::DATE < DATE '{NOW}' AND o_orderstatus <> 'F' AS late FROM orders),
    g AS (SELECT priority, owner, grouping_id(priority, owner) AS g, count(*) AS total, count(*) FILTER (WHERE done) AS completed, avg(span) FILTER (WHERE done AND span >= 0) AS mean_sprints, count(*) FILTER (WHERE late) AS overdue FROM a GROUP BY GROUPING SETS ((), (priority), (owner)))
    SELECT CASE g WHEN 1 THEN 'priority' WHEN 2 THEN 'owner' ELSE 'all' END AS dimension, CASE g WHEN 1 THEN priority WHEN 2 THEN owner ELSE 'all' END AS name, total, completed, mean_sprints, overdue, completed / total AS completion_rate, overdue / total AS overdue_rate FROM g
    """,
    digits="mean_sprints:6 completion_rate:6 overdue_rate:6",
)
def action_completion(t):
    """Orders as action items, one item array per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    item = F.struct(
        F.concat(F.lit("own"), c % 9).alias("owner"), at(["high", "medium", "low"], k).alias("priority"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"),
        F.lit(1).cast("long").alias("created"), (c % 8).alias("completed"), F.to_date("o_orderdate").alias("due"),
    )
    return G.action_completion(t.orders.select(F.array(item).alias("actions")), "actions", NOW)


def _theme_sql():
    return ", ".join("{'theme': '" + n + "', 'mentions': " + " + ".join(f"bool_or(contains(l, '{w}'))::INT" for w in ws) + "}" for n, ws in G.THEMES.items())


@query(
    "recurring_themes",
    f"""
    WITH x AS (SELECT doc_id % 30 AS retro, lower(text) AS l FROM documents), p AS (SELECT retro, [{_theme_sql()}] AS items FROM x GROUP BY 1),
    r AS (SELECT retro, unnest(items, recursive := true) FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY retro) AS i FROM r WHERE mentions > 0)
    SELECT theme, count(*) AS seen, avg(mentions) AS mean_mentions, sum(mentions)::BIGINT AS total_mentions, min(retro) AS first_seen, max(retro) AS last_seen, coalesce(regr_slope(mentions, i), 0) AS slope, count(*) / (SELECT count(*) FROM p) AS frequency,
      CASE WHEN abs(coalesce(regr_slope(mentions, i), 0)) < 0.01 THEN 'stable' WHEN regr_slope(mentions, i) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction
    FROM f GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM p) * 0.01
    """,
    digits="mean_mentions:6 slope:6 frequency:6",
)
def recurring_themes(t):
    """Documents grouped into thirty retrospectives."""
    return G.recurring_themes(t.documents.withColumn("retro", F.col("doc_id") % 30), "retro", "text", 0.01)


def pages(t):
    d = F.col("doc_id")
    w = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return t.documents.select(
        F.filter(F.array(F.when(d % 3 == 0, F.col("lang")), F.when(d % 5 == 0, F.col("source"))), lambda x: x.isNotNull()).alias("labels"), w.alias("words"),
        F.when(d % 17 != 0, F.concat(F.lit("Page "), d)).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (d % 365).cast("int")).alias("last_modified"), F.when(d % 13 != 0, F.col("source")).otherwise("").alias("author"), (d % 40).alias("views"),
    )


@query(
    "content_checks",
    """
    WITH p AS (SELECT doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS bare, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words, doc_id % 17 = 0 OR doc_id % 13 = 0 AS gap FROM documents),
    a AS (SELECT count(*) AS pages, count(*) FILTER (WHERE bare) AS unlabelled, count(*) FILTER (WHERE words > 5000) AS oversized, count(*) FILTER (WHERE words < 50 AND words > 0) AS undersized, count(*) FILTER (WHERE gap) AS incomplete, avg(words) AS mean_words FROM p)
    SELECT *, (1 - unlabelled / pages) * 100 AS organization, (1 - (oversized + undersized) / pages) * 100 AS size_balance, (1 - incomplete / pages) * 100 AS completeness FROM a
    """,
    digits="mean_words organization size_balance completeness",
)
def content_checks(t):
    return G.content_checks(pages(t))


@query(
    "content_staleness",
    """
    WITH p AS (SELECT date_diff('day', DATE '2024-01-01' + (doc_id % 365)::INT, DATE '2024-12-31') AS age, doc_id % 40 AS views FROM documents),
    a AS (SELECT count(*) AS pages, count(*) FILTER (WHERE age > 90 AND age <= 180) AS stale, count(*) FILTER (WHERE age > 180) AS outdated, count(*) FILTER (WHERE views < 5) AS low_engagement, avg(views) AS mean_views FROM p)
    SELECT *, (1 - (stale + outdated) / pages) * 100 AS freshness, (1 - low_engagement / pages) * 100 AS engagement FROM a
    """,
    digits="mean_views freshness engagement",
)
def content_staleness(t):
    return G.content_staleness(pages(t), "last_modified", "views", "2024-12-31")


def scores(t):
    """Views, clicks and errors as scored attempts: sound = event type, position by the props key."""
    pos = F.get_json_object("props", "$.k").cast("int") % 3
    return t.events.where("event_type IN ('view', 'click', 'error')").select(
        "user_id", F.col("event_type").alias("sound"), pos.alias("position"), F.concat_ws("/", "event_type", pos).alias("cell"), "ts", F.col("event_id").alias("tie"), F.least(F.lit(100.0), F.col("value") * 2).alias("score")
    )


SCORES = "s AS (SELECT user_id, event_type AS sound, json_extract_string(props, '$.k')::INT % 3 AS position, ts, event_id AS tie, least(100, value * 2) AS score FROM events WHERE event_type IN ('view', 'click', 'error'))"


@query(
    "caseload",
    f"""
    WITH {SCORES}, se AS (SELECT user_id, ts FROM events WHERE event_type = 'signup'), pl AS (SELECT user_id, arg_max(props, ts) AS plan_status FROM events WHERE event_type = 'purchase' GROUP BY 1),
    ac AS (SELECT user_id, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 6 DAY THEN ts::DATE END) AS days, max(ts) AS last_activity FROM (SELECT user_id, ts FROM s UNION ALL SELECT * FROM se) GROUP BY 1),
    ce AS (SELECT user_id, sound, position, arg_max(score, (ts, tie)) AS l, arg_min(score, (ts, tie)) AS f FROM s WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAY GROUP BY ALL),
    me AS (SELECT user_id, round_even(round(avg(l), 7), 0) AS score_mean, round_even(round(avg(l) - avg(f), 7), 0) AS score_delta_30d FROM ce GROUP BY 1), tr AS (SELECT user_id, count(*) AS attempts FROM s GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events)
    SELECT user_id, coalesce(attempts, 0) AS attempts, round(coalesce(days, 0) / 7, 2) AS adherence, score_mean, score_delta_30d, plan_status, last_activity
    FROM u LEFT JOIN tr USING (user_id) LEFT JOIN ac USING (user_id) LEFT JOIN me USING (user_id) LEFT JOIN pl USING (user_id)
    """,
    digits="adherence:2 score_mean:0 score_delta_30d:0",
)
def caseload(t):
    e = t.events
    plans = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("props").alias("status"))
    return G.caseload(e.select("user_id").distinct(), scores(t), e.where("event_type = 'signup'"), plans, "user_id", "2024-01-31 00:00:00")


@query(
    "target_ranking",
    f"""
    WITH {SCORES}, l AS (SELECT user_id, sound, position, arg_max(score, (ts, tie)) AS score FROM s GROUP BY 1, 2, 3),
    f AS (SELECT user_id, sound, round_even(round(avg(score), 7), 0) AS baseline, count(*) AS positions FROM l WHERE score < 70 GROUP BY 1, 2),
    t AS (SELECT *, CASE sound WHEN 'view' THEN 0 WHEN 'click' THEN 0 ELSE 1 END AS tier, CASE sound WHEN 'click' THEN 1 ELSE 0 END AS place FROM f),
    r AS (SELECT user_id, sound, baseline, positions, tier, row_number() OVER (PARTITION BY user_id ORDER BY tier, baseline DESC, place)::INT AS rank FROM t)
    SELECT * FROM r WHERE rank <= 2
    """,
    digits="baseline:0",
)
def target_ranking(t):
    return G.target_ranking(scores(t), "user_id", "sound", {"view": (0, 0), "click": (0, 1)}, 70, 2)
