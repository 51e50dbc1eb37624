"""Operations and security logs on the test tables. Events stand in for execution and access logs."""

from pyspark.sql import functions as F

from millrace.operators import ops as O
from millrace.plans.registry import query

K = "json_extract_string(props, '$.k')::BIGINT"
MESSAGES = ["request timed out", "Rate limit hit", "Unauthorized call", "connection refused by peer", "invalid input given", "Out of memory", "odd thing", "deadline exceeded"]
TOOLS = ["search", "fetch", "parse", "store"]


def k():
    return F.get_json_object("props", "$.k").cast("long")


def at(names, index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index % len(names) + 1).cast("int"))


def logs(t):
    e, v = F.col("event_type"), F.col("value")
    status = F.when(e == "error", "failure").when(v < 2, "timeout").when(k() < 10, "partial").otherwise("success")
    return t.events.select(
        "event_id", F.concat(F.lit("a"), F.col("user_id") % 12).alias("agent"), e.alias("task"), status.alias("status"), (v * 500).alias("duration_ms"), (k() * 37).alias("tokens"), (v / 1000).alias("cost"),
        F.col("ts").alias("started"), F.when(e == "error", at(MESSAGES, k())).alias("error"), (k() % 4).alias("retries"), at(TOOLS, k()).alias("tool"),
    )


LOGS = f"""
    l AS (SELECT event_id, 'a' || (user_id % 12) AS agent, event_type AS task, CASE WHEN event_type = 'error' THEN 'failure' WHEN value < 2 THEN 'timeout' WHEN {K} < 10 THEN 'partial' ELSE 'success' END AS status,
      value * 500 AS duration_ms, {K} * 37 AS tokens, value / 1000 AS cost, ts AS started, CASE WHEN event_type = 'error' THEN {MESSAGES}[{K} % 8 + 1] END AS error, {K} % 4 AS retries, {TOOLS}[{K} % 4 + 1] AS tool FROM events)
"""


def metric_sql(key):
    return f"""SELECT {key} AS agent, {int(key.startswith('NULL'))} AS is_total, count(*) AS total_tasks, avg((status = 'success')::INT) AS success_rate, avg((status IN ('failure', 'timeout'))::INT) AS failure_rate, avg(duration_ms) FILTER (WHERE duration_ms > 0) AS avg_duration,
      min(duration_ms) FILTER (WHERE duration_ms > 0) AS min_duration, max(duration_ms) FILTER (WHERE duration_ms > 0) AS max_duration, sum(tokens)::BIGINT AS tokens, sum(cost) AS cost, avg((error IS NOT NULL)::INT) AS error_rate, avg((retries > 0)::INT) AS retry_rate,
      quantile_cont(duration_ms, 0.5) FILTER (WHERE duration_ms > 0) AS median_duration, quantile_cont(duration_ms, 0.95) FILTER (WHERE duration_ms > 0) AS p95_duration, sum(cost) / sum(tokens) AS cost_per_token,
      count(*) / (date_diff('microsecond', min(started), max(started)) / 3600000000.0) AS tasks_per_hour FROM l GROUP BY 1"""


METRICS = f"m AS ({metric_sql('agent')} UNION ALL {metric_sql('NULL::VARCHAR')})"


@query("execution_metrics", f"WITH {LOGS}, {METRICS} SELECT * FROM m", digits="success_rate:6 failure_rate:6 avg_duration:2 min_duration:2 max_duration:2 cost error_rate:6 retry_rate:6 median_duration:2 p95_duration:2 cost_per_token:8 tasks_per_hour")
def execution_metrics(t):
    return O.execution_metrics(logs(t), "agent")


def _class_sql():
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(error), '{p}') THEN '{n}'" for n, (p, _) in O.ERROR_CLASSES.items()) + " ELSE 'unclassified' END"


@query(
    "error_classes",
    f"""WITH {LOGS}, c AS (SELECT {_class_sql()} AS error_type, count(*) AS count FROM l WHERE error IS NOT NULL GROUP BY 1), p AS (SELECT *, count / (SELECT sum(count) FROM c) * 100 AS percentage FROM c)
    SELECT *, CASE WHEN error_type = 'unclassified' THEN CASE WHEN percentage > 10 THEN 'medium' ELSE 'low' END WHEN percentage > 20 OR error_type = 'resource' THEN 'high'
      WHEN percentage > 10 OR error_type IN ('timeout', 'authentication', 'network') THEN 'medium' ELSE 'low' END AS impact FROM p""",
    digits="percentage",
)
def error_classes(t):
    return O.error_classes(logs(t), "error")


@query(
    "daily_trends",
    f"WITH {LOGS} SELECT strftime(started, '%Y-%m-%d') AS day, avg((status = 'success')::INT) AS success_rate, avg(duration_ms) FILTER (WHERE duration_ms > 0) AS avg_duration, sum(cost) AS cost FROM l GROUP BY 1",
    digits="success_rate:6 avg_duration:2 cost",
)
def daily_trends(t):
    return O.daily_trends(logs(t), "started")


@query(
    "cost_breakdown",
    f"WITH {LOGS} SELECT 'all' AS dimension, 'all' AS name, sum(cost) AS cost, sum(cost) / sum(tokens) AS cost_per_token FROM l UNION ALL SELECT 'agent', agent, sum(cost), sum(cost) / sum(tokens) FROM l GROUP BY 2 UNION ALL SELECT 'task', task, sum(cost), sum(cost) / sum(tokens) FROM l GROUP BY 2",
    digits="cost cost_per_token:8",
)
def cost_breakdown(t):
    return O.cost_breakdown(logs(t), ["agent", "task"])


@query(
    "sla_check",
    f"""WITH {LOGS}, {METRICS} SELECT agent, greatest(0, 0.95 - success_rate) AS success_gap, greatest(0, avg_duration - 10000) AS latency_gap, greatest(0, error_rate - 0.05) AS error_gap,
      success_rate >= 0.95 AND avg_duration <= 10000 AND error_rate <= 0.05 AS compliant, ((success_rate >= 0.95)::INT + (avg_duration <= 10000)::INT + (error_rate <= 0.05)::INT) / 3 AS compliance_score FROM m""",
    digits="success_gap:6 latency_gap:2 error_gap:6 compliance_score",
)
def sla_check(t):
    return O.sla_check(O.execution_metrics(logs(t), "agent")).select("agent", "success_gap", "latency_gap", "error_gap", "compliant", "compliance_score")


KINDS = ["message", "tool_call", "delegate", "respond"]


def actions(t):
    """Three actions per log row as an array of structs."""
    d = F.col("value") * 60
    one = [F.struct(at(KINDS, k() + i).alias("type"), (d * (i + 1)).alias("duration_ms")) for i in range(3)]
    return t.events.select(F.col("event_type").alias("task"), F.array(*one).alias("actions"))


TALK = f"""
    x AS (SELECT event_type AS task, {KINDS}[({K} + i) % 4 + 1] AS type, value * 60 * (i + 1) AS d FROM events, range(3) r(i)),
    talk AS (SELECT task, count(*) AS communications, avg(d) AS avg_latency, count(*) FILTER (WHERE d > 5000) AS high_latency FROM x WHERE type <> 'tool_call' GROUP BY 1)
"""


@query("communication_latency", f"WITH {TALK} SELECT * FROM talk", digits="avg_latency")
def communication_latency(t):
    return O.communication_latency(actions(t), "actions", ["task"])


@query(
    "bottlenecks",
    f"""WITH {LOGS}, {METRICS}, {TALK}, tools AS (SELECT tool, avg((error IS NOT NULL)::INT) AS error_rate FROM l GROUP BY 1), u AS (SELECT count(*) FILTER (WHERE tokens > 1.5 * (SELECT avg(tokens) FROM l)) AS n FROM l)
    SELECT 'agent_success' AS kind, agent AS location, CASE WHEN success_rate < 0.5 THEN 'critical' ELSE 'high' END AS severity FROM m WHERE is_total = 0 AND success_rate < 0.8
    UNION ALL SELECT 'agent_latency', agent, CASE WHEN avg_duration > 60000 THEN 'high' ELSE 'medium' END FROM m WHERE is_total = 0 AND avg_duration > 30000
    UNION ALL SELECT 'tool', tool, CASE WHEN error_rate > 0.4 THEN 'high' ELSE 'medium' END FROM tools WHERE error_rate > 0.2
    UNION ALL SELECT 'communication', 'inter_agent', 'medium' FROM (SELECT sum(high_latency) AS h FROM talk) WHERE h > 5
    UNION ALL SELECT 'resource', 'token_usage', 'medium' FROM (SELECT count(*) FILTER (WHERE tokens > 2 * (SELECT avg(tokens) FROM l)) AS n FROM l) WHERE n > 10""",
)
def bottlenecks(t):
    rows = logs(t)
    tools = rows.groupBy("tool").agg(F.avg(F.col("error").isNotNull().cast("int")).alias("error_rate"))
    metrics = O.execution_metrics(rows, "agent").where("is_total = 0")
    return O.bottlenecks(metrics, "agent", tools, O.communication_latency(actions(t), "actions"), O.resource_excess(rows, "tokens"))


@query(
    "resource_excess",
    f"WITH {LOGS}, a AS (SELECT avg(cost) AS m FROM l) SELECT max(m) AS mean_usage, count(*) FILTER (WHERE cost > 2 * m) AS high_usage, sum(greatest(0, cost - m)) * 0.00002 AS excess_cost FROM l, a",
    digits="mean_usage:8 excess_cost:8",
)
def resource_excess(t):
    return O.resource_excess(logs(t), "cost")


@query(
    "latency_summary",
    """
    SELECT user_id % 5 AS target, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failed, avg(value) FILTER (WHERE event_type <> 'error') AS mean, stddev_samp(value) FILTER (WHERE event_type <> 'error') AS std,
      quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error') AS p50, quantile_cont(value, 0.9) FILTER (WHERE event_type <> 'error') AS p90, quantile_cont(value, 0.95) FILTER (WHERE event_type <> 'error') AS p95,
      quantile_cont(value, 0.99) FILTER (WHERE event_type <> 'error') AS p99, count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6) AS rps FROM events GROUP BY 1
    """,
    digits="mean std p50 p90 p95 p99 rps:8",
)
def latency_summary(t):
    rows = t.events.withColumn("target", F.col("user_id") % 5)
    return O.latency_summary(rows, ["target"], F.col("event_type") != "error", "value", "ts")


def raw_audit(t):
    """Nested JSON access log lines in two shapes."""
    u = F.concat(F.lit("u"), F.col("user_id"))
    ip = F.concat(F.lit("10.0.0."), k() % 7)
    path = F.concat(F.lit("/secret/"), k() % 13)
    status = F.when(F.col("event_type") == "error", 403).otherwise(200)
    a = F.to_json(F.struct(F.struct(u.alias("display_name")).alias("auth"), F.struct(path.alias("path"), F.lit("read").alias("operation")).alias("request"), F.struct(status.alias("status_code")).alias("response"), ip.alias("remote_address")))
    b = F.to_json(F.struct(F.struct(u.alias("entity_id")).alias("auth"), path.alias("path"), status.alias("status_code"), ip.alias("source_address")))
    return t.events.select("event_id", "ts", F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias("raw"))


def audit(t):
    return O.audit_normalise(raw_audit(t), "raw")


AUDIT = f"a AS (SELECT event_id, ts, 'u' || user_id AS identity, '/secret/' || ({K} % 13) AS path, CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'unknown' END AS operation, CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS status, '10.0.0.' || ({K} % 7) AS ip FROM events)"


@query("audit_normalise", f"WITH {AUDIT} SELECT * FROM a")
def audit_normalise(t):
    return audit(t)


@query(
    "audit_volume_spike",
    f"WITH {AUDIT}, c AS (SELECT identity, count(*) AS access_count FROM a GROUP BY 1), m AS (SELECT greatest(avg(access_count) * 1.2, 1.2) AS threshold FROM c) SELECT * FROM c, m WHERE access_count >= threshold",
    digits="threshold",
)
def audit_volume_spike(t):
    return O.audit_volume_spike(audit(t), "identity", 1.2)


@query("audit_multi_ip", f"WITH {AUDIT} SELECT identity, count(DISTINCT ip) AS ip_count FROM a GROUP BY 1 HAVING count(DISTINCT ip) >= 7")
def audit_multi_ip(t):
    return O.audit_distinct(audit(t), "identity", "ip", 7, "ip_count")


@query("audit_failed_access", f"WITH {AUDIT} SELECT identity || '@' || ip AS source, count(*) AS failures FROM a WHERE status >= 400 OR status = 0 GROUP BY 1 HAVING count(*) >= 4")
def audit_failed_access(t):
    return O.audit_failed(audit(t), "identity", "ip", "status", 4)


@query("audit_off_hours", f"WITH {AUDIT} SELECT identity, count(*) AS access_count FROM a WHERE hour(ts) < 6 OR hour(ts) >= 22 GROUP BY 1 HAVING count(*) >= 20")
def audit_off_hours(t):
    return O.audit_off_hours(audit(t), "identity", "ts", 20)


@query("audit_broad_access", f"WITH {AUDIT} SELECT identity, count(DISTINCT path) AS path_count FROM a GROUP BY 1 HAVING count(DISTINCT path) >= 12")
def audit_broad_access(t):
    return O.audit_distinct(audit(t), "identity", "path", 12, "path_count")


@query(
    "entity_zscore",
    """
    WITH z AS (SELECT event_id, user_id, (value - 30) / 25.0 AS z, hour(ts) < 6 OR hour(ts) >= 22 AS time_anomaly FROM events)
    SELECT event_id, user_id, z, z >= 3 AS hard_flag, z >= 2 AND z < 3 AS soft_flag, time_anomaly FROM z WHERE z >= 2 OR time_anomaly
    """,
    digits="z",
)
def entity_zscore(t):
    return O.entity_zscore(t.events, "value", "ts", 30, 25).select("event_id", "user_id", "z", "hard_flag", "soft_flag", "time_anomaly")


KW = list(O.HUNT_KEYWORDS)


@query(
    "hunt_score",
    f"""
    WITH w(kw, tactic) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in O.HUNT_KEYWORDS.items())}),
    m AS (SELECT doc_id, kw, tactic FROM documents JOIN w ON contains(lower(text), kw)), s AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT tactic, ',' ORDER BY tactic) AS tactics FROM m GROUP BY 1),
    d AS (SELECT doc_id, coalesce(n, 0) AS keywords, len(list_distinct(regexp_extract_all(text, '[Tt]\\d{{4}}(?:\\.\\d{{3}})?'))) AS codes, coalesce(tactics, '') AS tactics FROM documents LEFT JOIN s USING (doc_id))
    SELECT *, keywords * 2 + codes * 3 + 7 AS priority_score, keywords * 2 + codes * 3 + 7 >= 5 AS pursue FROM d
    """,
)
def hunt_score(t):
    out = O.hunt_score(t.documents, "text")
    return out.select("doc_id", F.size("keywords").cast("long").alias("keywords"), "codes", "tactics", F.col("priority_score").cast("long").alias("priority_score"), "pursue")


IOC_EMAIL = "[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+"


@query(
    "ioc_sweep",
    f"""
    WITH i AS (SELECT 'domain' AS type, 'mail' || (s_suppkey % 12) || '.example.com' AS value, DATE '2024-01-01' + (s_suppkey % 60)::INT AS seen FROM supplier
      UNION ALL SELECT 'ip', '10.' || (s_suppkey % 4) || '.0.1', DATE '2024-01-01' FROM supplier),
    kn AS (SELECT type, value, max(seen) AS seen FROM i GROUP BY 1, 2),
    f AS (SELECT doc_id, 'domain' AS type, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]{{2,}}'))) AS value FROM documents
      UNION ALL SELECT doc_id, 'ip', unnest(list_distinct(regexp_extract_all(lower(text), '\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}'))) FROM documents),
    h AS (SELECT type, value, count(*) AS hits FROM f GROUP BY 1, 2)
    SELECT type, count(*) AS indicators, count(*) FILTER (WHERE hits > 0) AS matched, coalesce(sum(hits), 0)::BIGINT AS documents, count(*) FILTER (WHERE date_diff('day', seen, DATE '2024-02-15') > 30) AS stale, 2 / 6.0 AS coverage
    FROM kn LEFT JOIN h USING (type, value) GROUP BY 1
    """,
    digits="coverage:6",
)
def ioc_sweep(t):
    s = F.col("s_suppkey")
    a = t.supplier.select(F.lit("domain").alias("type"), F.concat(F.lit("mail"), s % 12, F.lit(".example.com")).alias("value"), F.date_add(F.lit("2024-01-01").cast("date"), (s % 60).cast("int")).alias("seen"))
    b = t.supplier.select(F.lit("ip").alias("type"), F.concat(F.lit("10."), s % 4, F.lit(".0.1")).alias("value"), F.lit("2024-01-01").cast("date").alias("seen"))
    return O.ioc_sweep(t.documents, "text", a.unionByName(b), "2024-02-15")


def _incident_sql():
    rows = []
    for i, (name, words) in enumerate(O.INCIDENT_WORDS.items()):
        parts = [f"2 * contains(l, '{w}')::INT" for w in name.split("_")] + [f"contains(l, '{w}')::INT" for w in words]
        rows.append("{'s': " + " + ".join(parts) + f", 'p': {-i}, 'n': '{name}'}}")
    fp = ", ".join("CASE WHEN " + " OR ".join(f"contains(l, '{w}')" for w in words) + f" THEN '{n}' END" for n, words in O.FALSE_POSITIVE.items())
    return f"""
      t AS (SELECT conv_id, turn, lower(text) AS l FROM conversations),
      s AS (SELECT conv_id, turn, [{', '.join(rows)}] AS x, concat_ws(',', {fp}) AS false_positive_signs FROM t),
      b AS (SELECT *, list_max(x) AS best, list_sum(list_transform(x, lambda e: e.s)) AS total FROM s)
      SELECT conv_id, turn, CASE WHEN best.s > 0 THEN best.n ELSE 'unknown' END AS incident_type,
        CASE WHEN best.s > 0 THEN round(least(1, least(1, best.s / greatest(total, 1)) + 0.1 * least(best.s, 5)), 2) ELSE 0 END AS confidence, false_positive_signs FROM b
    """


@query("incident_class", "WITH " + _incident_sql(), digits="confidence:2")
def incident_class(t):
    return O.incident_class(t.conversations, "text").select("conv_id", "turn", "incident_type", "confidence", "false_positive_signs")


LEVELS = ["critical", "high", "medium", "low", "none"]
DEGR = ["complete", "major", "partial", "minor", "none"]
SEV_IN = {
    "customer_facing": "user_id % 2 = 0", "workaround": "user_id % 3 = 0", "users_pct": "value", "customer_reports": "user_id % 30", "breach": "event_id % 97 = 0", "integrity_risk": "event_id % 31 = 0",
    "dependents": "event_id % 7", "endpoints": "event_id % 6", "regions": "event_id % 4", "error_rate": "value / 3", "latency_p99": "value * 60", "alerts": "user_id % 25",
}


@query(
    "severity_score",
    f"""
    WITH i AS (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in SEV_IN.items())}, {LEVELS}[event_id % 5 + 1] AS revenue_impact, {DEGR}[user_id % 5 + 1] AS degradation FROM events),
    a AS (SELECT *, CASE revenue_impact WHEN 'critical' THEN 1 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.2 ELSE 0 END::DOUBLE AS r0, CASE WHEN users_pct >= 75 THEN 1 WHEN users_pct >= 50 THEN 0.85 WHEN users_pct >= 25 THEN 0.65 WHEN users_pct >= 10 THEN 0.45 WHEN users_pct >= 1 THEN 0.25 ELSE 0.1 END::DOUBLE AS u0,
      CASE WHEN breach THEN 1 WHEN integrity_risk THEN 0.8 ELSE 0 END::DOUBLE AS s0, CASE WHEN dependents >= 5 THEN 1 WHEN dependents >= 3 THEN 0.75 WHEN dependents >= 1 THEN 0.5 ELSE 0.2 END::DOUBLE AS c0,
      greatest(CASE regions WHEN 3 THEN 0.9 WHEN 2 THEN 0.6 WHEN 1 THEN 0.3 ELSE 0 END, CASE WHEN error_rate >= 50 THEN 1 WHEN error_rate >= 25 THEN 0.8 WHEN error_rate >= 10 THEN 0.6 WHEN error_rate >= 5 THEN 0.4 WHEN error_rate >= 1 THEN 0.2 ELSE 0 END,
        CASE WHEN latency_p99 >= 10000 THEN 1 WHEN latency_p99 >= 5000 THEN 0.8 WHEN latency_p99 >= 2000 THEN 0.6 WHEN latency_p99 >= 1000 THEN 0.4 WHEN latency_p99 >= 500 THEN 0.2 ELSE 0 END)::DOUBLE AS b0 FROM i),
    b AS (SELECT *, CASE WHEN customer_facing AND r0 >= 0.5 THEN least(1, r0 + 0.1) ELSE r0 END AS r1 FROM a),
    c AS (SELECT *, CASE WHEN NOT workaround AND r1 >= 0.5 THEN least(1, r1 + 0.1) ELSE r1 END AS revenue, least(1, least(1, u0 + CASE WHEN customer_reports > 20 THEN 0.15 WHEN customer_reports > 5 THEN 0.08 ELSE 0 END) + 0.15 * CASE degradation WHEN 'complete' THEN 1 WHEN 'major' THEN 0.75 WHEN 'partial' THEN 0.5 WHEN 'minor' THEN 0.25 ELSE 0 END) AS users,
      CASE WHEN customer_facing AND integrity_risk THEN least(1, s0 + 0.1) ELSE s0 END AS security, least(1, c0 + CASE WHEN endpoints >= 5 THEN 0.15 WHEN endpoints >= 2 THEN 0.08 ELSE 0 END) AS criticality, least(1, b0 + CASE WHEN alerts >= 20 THEN 0.15 WHEN alerts >= 10 THEN 0.08 ELSE 0 END) AS blast FROM b),
    d AS (SELECT *, round_even(round(revenue * 0.25, 10), 3) + round_even(round(users * 0.25, 10), 3) + round_even(round(security * 0.2, 10), 3) + round_even(round(criticality * 0.15, 10), 3) + round_even(round(blast * 0.15, 10), 3) AS s FROM c),
    e AS (SELECT event_id, least(1, greatest(s, CASE WHEN breach THEN 0.85 ELSE 0 END, CASE WHEN integrity_risk AND customer_facing THEN 0.76 ELSE 0 END, CASE WHEN users_pct >= 50 AND degradation = 'complete' THEN 0.8 ELSE 0 END)) AS composite FROM d)
    SELECT event_id, composite, CASE WHEN round(composite, 3) >= 0.75 THEN 'SEV1' WHEN round(composite, 3) >= 0.5 THEN 'SEV2' WHEN round(composite, 3) >= 0.25 THEN 'SEV3' ELSE 'SEV4' END AS level FROM e
    """,
    digits="composite:3",
)
def severity_score(t):
    rows = t.events.select("event_id", *[F.expr(e).alias(n) for n, e in SEV_IN.items()], at(LEVELS, F.col("event_id")).alias("revenue_impact"), at(DEGR, F.col("user_id")).alias("degradation"))
    return O.severity_score(rows).select("event_id", "composite", "level")


SOURCES = ["Prometheus", "app-server", "Slack", "Jenkins CI", "operator", "PagerDuty", "mystery"]
SEVS = ["P1", "major", "Medium", "sev4", "info", "strange"]


def _typing_sql():
    out = "CASE WHEN lower(event_type) IN ('alert', 'log', 'communication', 'deployment', 'action', 'escalation') THEN lower(event_type) "
    for name, (sources, words) in O.EVENT_TYPES.items():
        tests = [f"contains(s, '{w}')" for w in sources] + [f"contains(m, '{w}')" for w in words]
        out += f"WHEN {' OR '.join(tests)} THEN '{name}' "
    return out + "ELSE 'unknown' END"


@query(
    "event_typing",
    f"""WITH e AS (SELECT event_id, event_type, lower({SOURCES}[{K} % 7 + 1]) AS s, lower({MESSAGES}[event_id % 8 + 1]) AS m, {SEVS}[{K} % 6 + 1] AS v FROM events)
    SELECT event_id, {_typing_sql()} AS event_class, CASE v WHEN 'P1' THEN 5 WHEN 'major' THEN 4 WHEN 'Medium' THEN 3 WHEN 'sev4' THEN 2 WHEN 'info' THEN 1 ELSE 0 END AS severity_level FROM e""",
)
def event_typing(t):
    rows = t.events.select("event_id", "event_type", at(SOURCES, k()).alias("source"), at(MESSAGES, F.col("event_id")).alias("message"), at(SEVS, k()).alias("severity"))
    return O.event_typing(rows, "source", "message", "event_type", "severity").select("event_id", "event_class", "severity_level")


RULES = ["disk_usage_percent > 85%", "cpu_load > 75%", "cpu_load > 55%", "response_time > 120ms", "error_rate > 0.1%", "up == 0", "queue_rate  >  40", "latency_p99 > 150ms"]
WAITS = ["5m", "30s", "0s", "1h"]


def alerts(t):
    """Customers as alert rules."""
    c = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", at(RULES, c).alias("expr"), at(WAITS, F.expr("c_custkey div 8")).alias("wait"), (c % 21).alias("fires_per_day"), (c % 10 / 10.0).alias("false_positive_rate"),
        F.concat(F.lit("svc"), c % 40).alias("service"), at(["critical", "high", "warning"], c).alias("severity"), F.concat(F.lit("team"), c % 3).alias("team"), F.col("c_name").alias("name"),
    )


ALERTS = f"""
    a AS (SELECT c_custkey, {RULES}[c_custkey % 8 + 1] AS expr, {WAITS}[(c_custkey // 8) % 4 + 1] AS wait, c_custkey % 21 AS fires_per_day, c_custkey % 10 / 10.0 AS fp, 'svc' || (c_custkey % 40) AS service,
      ['critical', 'high', 'warning'][c_custkey % 3 + 1] AS severity, 'team' || (c_custkey % 3) AS team, c_name AS name FROM customer)
"""


@query(
    "alert_noise",
    f"""WITH {ALERTS}, s AS (SELECT c_custkey, {' + '.join(f"3 * regexp_matches(lower(expr), '{p}')::INT" for p in O.NOISY)} + CASE WHEN wait IN ('30s', '0s') THEN 2 ELSE 0 END + CASE WHEN wait = '0s' THEN 2 ELSE 0 END
      + 2 * ({' OR '.join(f"regexp_matches(lower(expr), '{p}')" for p in O.SENSITIVE)})::INT + CASE WHEN fires_per_day > 10 THEN 3 ELSE 0 END + CASE WHEN fp > 0.3 THEN 4 ELSE 0 END AS noise_score FROM a)
    SELECT * FROM s WHERE noise_score >= 3""",
)
def alert_noise(t):
    return O.alert_noise(alerts(t)).select("c_custkey", "noise_score")


@query(
    "alert_duplicates",
    f"""WITH {ALERTS}, m AS (SELECT *, CASE WHEN contains(expr, 'up') THEN 'availability' WHEN contains(expr, 'latency') OR contains(expr, 'response_time') OR contains(expr, 'duration') THEN 'latency' WHEN contains(expr, 'error') THEN 'error_rate' WHEN contains(expr, 'cpu') OR contains(expr, 'disk') THEN 'resource' ELSE 'other' END AS mt,
      coalesce(nullif(regexp_extract(expr, '(>|<|==)\\s*([0-9.]+)', 2), ''), 'unknown') AS lim FROM a)
    SELECT 'exact' AS kind, concat_ws('|', regexp_replace(expr, '\\s+', ' ', 'g'), service, severity, team) AS signature, count(*) AS alerts FROM m GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'semantic', concat_ws('|', service, mt, lim, severity), count(*) FROM m GROUP BY 2 HAVING count(*) > 1""",
)
def alert_duplicates(t):
    return O.alert_duplicates(alerts(t))


def _case(words_by, text):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in words_by.items()) + " END"


@query(
    "alert_coverage",
    f"""WITH {ALERTS}, x AS (SELECT service, coalesce({_case(O.ALERT_CATEGORIES, "lower(expr || ' ' || name)")}, 'other') AS cat, {_case(O.GOLDEN_SIGNALS, 'lower(expr)')} AS sig FROM a),
    sv AS (SELECT DISTINCT 'svc' || (s_suppkey % 45) AS service FROM supplier)
    SELECT 'category' AS kind, 'all' AS service, c AS item FROM (SELECT unnest({list(O.ALERT_CATEGORIES)}) AS c) WHERE c NOT IN (SELECT cat FROM x)
    UNION ALL SELECT 'signal', 'all', g FROM (SELECT unnest({list(O.GOLDEN_SIGNALS)}) AS g) WHERE g NOT IN (SELECT sig FROM x WHERE sig IS NOT NULL)
    UNION ALL SELECT 'service_signal', service, g FROM sv, (SELECT unnest({list(O.GOLDEN_SIGNALS)}) AS g) y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.service = sv.service AND x.sig = y.g)""",
)
def alert_coverage(t):
    services = t.supplier.select(F.concat(F.lit("svc"), F.col("s_suppkey") % 45).alias("service"))
    return O.alert_coverage(alerts(t), services)


@query(
    "error_budget",
    """WITH s AS (SELECT event_type, 1 - avg((value > 100)::INT) AS target FROM events GROUP BY 1)
    SELECT event_type, target, w AS window, 1 - target AS budget_rate, sec * (1 - target) AS budget_seconds FROM s, (VALUES ('1h', 3600), ('1d', 86400), ('7d', 604800), ('30d', 2592000)) v(w, sec)""",
    digits="target:6 budget_rate:6 budget_seconds:2",
)
def error_budget(t):
    s = t.events.groupBy("event_type").agg((1 - F.avg((F.col("value") > 100).cast("int"))).alias("target"))
    return O.error_budget(s, "target")


@query(
    "burn_rate",
    """
    WITH c AS (SELECT user_id % 3 AS service, (floor(epoch(ts) / 300) * 300)::BIGINT AS slot, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS b FROM events GROUP BY ALL),
    w(short_minutes, long_minutes, burn_limit) AS (VALUES (5, 60, 14.4::DOUBLE), (30, 360, 6), (120, 1440, 3), (360, 4320, 1)),
    j AS (SELECT c.service, c.slot, w.*, sum(d.b) FILTER (WHERE d.slot >= c.slot - short_minutes * 60 + 300) / sum(d.n) FILTER (WHERE d.slot >= c.slot - short_minutes * 60 + 300) / 0.05 AS short_burn, sum(d.b) / sum(d.n) / 0.05 AS long_burn
      FROM c, w, c d WHERE d.service = c.service AND d.slot <= c.slot AND d.slot >= c.slot - long_minutes * 60 + 300 GROUP BY ALL)
    SELECT * FROM j WHERE short_burn > burn_limit AND long_burn > burn_limit
    """,
    digits="short_burn long_burn",
)
def burn_rate(t):
    return O.burn_rate(t.events.withColumn("service", F.col("user_id") % 3), ["service"], "ts", F.col("event_type") == "error", 0.95)


DEBT = ["large_function", "high_complexity", "duplicate_code", "todo_comment", "security_risk", "test_debt", "architecture_debt", "missing_docstring", "outdated_docs", "mystery"]
DSEV = ["low", "medium", "high", "critical"]


@query(
    "debt_snapshots",
    f"""
    WITH i AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, {DEBT}[o_orderkey % 10 + 1] AS type, {DSEV}[o_custkey % 4 + 1] AS severity, o_custkey % 70 AS file FROM orders),
    s AS (SELECT month, count(*) AS items, sum(CASE type WHEN 'todo_comment' THEN 2 WHEN 'missing_docstring' THEN 2 WHEN 'large_function' THEN 8 WHEN 'high_complexity' THEN 16 WHEN 'duplicate_code' THEN 12 WHEN 'security_risk' THEN 20 WHEN 'architecture_debt' THEN 80 WHEN 'test_debt' THEN 16 ELSE 8 END
        * CASE severity WHEN 'low' THEN 0.5 WHEN 'high' THEN 1.5 WHEN 'critical' THEN 2 ELSE 1 END)::DOUBLE AS effort, count(*) FILTER (WHERE severity IN ('high', 'critical') OR type IN ('security_risk', 'architecture_debt')) AS high_priority, count(*) FILTER (WHERE type = 'security_risk') AS sec,
      count(*) FILTER (WHERE type IN ('high_complexity', 'large_function')) AS cx, count(*) FILTER (WHERE type = 'test_debt') AS te, count(*) FILTER (WHERE type = 'outdated_docs') AS d,
      count(*) FILTER (WHERE type IN ('large_function', 'high_complexity', 'duplicate_code', 'missing_docstring', 'architecture_debt')) AS ma, count(*) FILTER (WHERE type = 'architecture_debt') AS ar, count(*) / count(DISTINCT file) AS dr FROM i GROUP BY 1)
    SELECT month, items, effort, high_priority, greatest(0, 100 - dr * 20) * 0.25 + greatest(0, 100 - cx / items * 100) * 0.2 + greatest(0, 100 - te / items * 150) * 0.15 + greatest(0, 100 - d / items * 100) * 0.1 + greatest(0, 100 - sec / items * 200) * 0.15 + greatest(0, 100 - ma / items * 120) * 0.15 AS overall,
      least(50, high_priority / items * 30 + dr * 5) AS velocity_impact, least(100, (sec + ar) * 10 + 100 - greatest(0, 100 - sec / items * 200)) AS technical_risk, items - lag(items) OVER (ORDER BY month) AS net_change, effort - lag(effort) OVER (ORDER BY month) AS net_effort_change FROM s
    """,
    digits="effort:1 overall velocity_impact technical_risk net_effort_change:1",
)
def debt_snapshots(t):
    i = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), at(DEBT, F.col("o_orderkey")).alias("type"), at(DSEV, F.col("o_custkey")).alias("severity"), (F.col("o_custkey") % 70).alias("file"))
    return O.debt_snapshots(i, "month")
