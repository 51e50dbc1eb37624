"""Execution logs, audit logs, anomalies, incidents, alerts, error budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import numeric as N
from millrace.functions import text as X
from millrace.operators.narrowing import exact_quantiles
from millrace.operators.ordered import null_safe_join
from millrace.operators.windows import minutes_between

# Error classes with their patterns and severity, in the order they are tried.
ERROR_CLASSES = {
    "timeout": ("timeout|timed out|deadline exceeded", "high"),
    "rate_limit": ("rate limit|too many requests|quota exceeded", "medium"),
    "authentication": ("unauthorized|authentication failed|invalid credentials", "high"),
    "network": ("connection refused|network error|dns resolution", "high"),
    "validation": ("validation error|invalid input|schema violation", "medium"),
    "resource": ("out of memory|disk full|cpu overload", "critical"),
}
# Hunt keywords and their tactic.
HUNT_KEYWORDS = {
    "wmi": "lateral_movement", "powershell": "execution", "lolbin": "defense_evasion", "lolbas": "defense_evasion", "pass-the-hash": "lateral_movement", "pth": "lateral_movement",
    "credential dump": "credential_access", "mimikatz": "credential_access", "lateral": "lateral_movement", "persistence": "persistence", "exfil": "exfiltration",
    "beacon": "command_and_control", "c2": "command_and_control", "ransomware": "impact", "privilege": "privilege_escalation", "injection": "defense_evasion",
    "apt": "initial_access", "supply chain": "initial_access", "phishing": "initial_access", "scheduled task": "persistence",
}
# Incident classes with the words that count one point; the words of the name count two.
INCIDENT_WORDS = {
    "ransomware": ["encrypt", "ransom", "locked", "decrypt", "wiper", "crypto"],
    "data_exfiltration": ["exfil", "upload", "transfer", "leak", "dump", "steal", "exfiltrate"],
    "apt_intrusion": ["apt", "nation-state", "targeted", "backdoor", "persistence", "c2", "c&c"],
    "supply_chain_compromise": ["supply chain", "dependency", "package", "solarwinds", "xz", "npm"],
    "credential_compromise": ["credential", "password", "brute force", "spray", "stuffing", "stolen"],
    "lateral_movement": ["lateral", "pivot", "pass-the-hash", "wmi", "psexec", "rdp movement"],
    "privilege_escalation": [],
    "malware_detected": ["malware", "trojan", "virus", "worm", "keylogger", "spyware", "rat"],
    "phishing": ["phish", "spear", "bec", "email", "lure", "credential harvest"],
    "unauthorized_access": ["unauthorized", "unauthenticated", "brute", "login failed", "access denied"],
    "policy_violation": ["policy", "dlp", "data loss", "violation", "compliance"],
    "vulnerability_discovered": ["vulnerability", "cve", "exploit", "patch", "zero-day", "rce"],
    "dos_attack": ["dos", "ddos", "flood", "amplification", "bandwidth", "exhaustion"],
    "insider_threat": ["insider", "employee", "contractor", "abuse", "privilege misuse"],
}
# Signs of harmless activity.
FALSE_POSITIVE = {
    "ci_cd_automation": ["jenkins", "github-actions", "gitlab-ci", "terraform", "ansible", "circleci", "codepipeline"],
    "test_environment": ["test", "dev", "staging", "sandbox", "qa", "nonprod", "non-prod"],
    "scheduled_scanner": ["nessus", "qualys", "rapid7", "tenable", "crowdstrike", "defender", "sentinel"],
    "scheduled_batch_job": ["backup", "sync", "batch", "cron", "scheduled", "nightly", "weekly"],
    "whitelisted_identity": ["svc-", "sa-", "system@", "automation@", "monitor@", "health-check"],
}
# Event type by source and message word, severity names.
EVENT_TYPES = {
    "alert": (["monitoring", "nagios", "datadog", "newrelic", "prometheus"], ["alert", "alarm", "threshold", "metric"]),
    "log": (["application", "server", "container", "system"], ["error", "exception", "warn", "fail"]),
    "communication": (["slack", "teams", "email", "chat"], ["message", "notification", "update"]),
    "deployment": (["ci/cd", "jenkins", "github", "gitlab", "deploy"], ["deploy", "release", "build", "merge"]),
    "action": (["manual", "script", "automation", "operator"], ["executed", "ran", "performed", "applied"]),
    "escalation": (["pagerduty", "opsgenie", "oncall", "escalation"], ["paged", "escalated", "notified", "assigned"]),
}
SEVERITY_NAMES = {
    "critical": 5, "crit": 5, "sev1": 5, "p1": 5, "high": 4, "major": 4, "sev2": 4, "p2": 4, "medium": 3, "moderate": 3, "sev3": 3, "p3": 3,
    "low": 2, "minor": 2, "sev4": 2, "p4": 2, "info": 1, "informational": 1, "debug": 1, "unknown": 0,
}
# Alert rule patterns that tend to be noisy, and thresholds that are too sensitive.
NOISY = [r"disk.*usage.*>.*[89]\d%", r"memory.*>.*[89]\d%", r"cpu.*>.*[789]\d%", r"response.*time.*>.*\d+ms", r"error.*rate.*>.*0\.[01]%"]
SENSITIVE = [r"error.*rate.*>.*0\.0[01]", r"latency.*>.*[12]\d\d?ms", r"response.*time.*>.*0\.[12]", r"cpu.*>.*[456]\d%"]
ALERT_CATEGORIES = {
    "availability": ["up", "down", "available", "reachable"], "latency": ["latency", "response_time", "duration"], "error_rate": ["error", "fail", "5xx", "4xx"],
    "resource_utilization": ["cpu", "memory", "disk", "network", "utilization"], "security": ["security", "auth", "login", "breach"], "business_metrics": ["revenue", "conversion", "user", "business"],
}
GOLDEN_SIGNALS = {
    "latency": ["latency", "response_time", "duration"], "traffic": ["rate", "rps", "qps", "throughput"], "errors": ["error", "fail", "5xx"], "saturation": ["cpu", "memory", "disk", "utilization"],
}
METRIC_TYPES = {"availability": ["up"], "latency": ["latency", "duration", "response_time"], "error_rate": ["error", "fail", "5xx"], "resource": ["cpu", "memory", "disk"]}
# Short and long window in minutes with the burn rate limit.
BURN_WINDOWS = [(5, 60, 14.4), (30, 360, 6.0), (120, 1440, 3.0), (360, 4320, 1.0)]


def first_match(text: Column, table: Mapping[str, Sequence[str]], other: str | None) -> Column:
    """First class with a word in the text."""
    out = None
    for name, words in table.items():
        test = X.any_of(text, words)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.lit(other))


# ---- execution logs ---------------------------------------------------------


def execution_metrics(df: DataFrame, agent: str) -> DataFrame:
    """Rates, durations, tokens, cost and throughput by agent and for all (agent null), from one rollup.

    Needs status, duration_ms, tokens, cost, started, error, retries. Median and p95 are exact and
    come from the block quantiles.
    """
    d = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    n = F.count(F.lit(1))
    base = df.rollup(agent).agg(
        F.grouping(agent).cast("int").alias("is_total"), n.alias("total_tasks"), F.avg((F.col("status") == "success").cast("int")).alias("success_rate"),
        F.avg(F.col("status").isin("failure", "timeout").cast("int")).alias("failure_rate"), F.avg(d).alias("avg_duration"), F.min(d).alias("min_duration"), F.max(d).alias("max_duration"),
        F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.avg(F.col("error").isNotNull().cast("int")).alias("error_rate"), F.avg((F.col("retries") > 0).cast("int")).alias("retry_rate"),
        (minutes_between(F.min("started"), F.max("started")) / 60).alias("hours"),
    )
    both = df.select(agent, F.lit(0).alias("is_total"), d.alias("d")).unionByName(df.select(F.lit(None).cast(df.schema[agent].dataType).alias(agent), F.lit(1).alias("is_total"), d.alias("d")))
    q = exact_quantiles(both, [agent, "is_total"], "d", {"median_duration": 0.5, "p95_duration": 0.95}).drop("n")
    out = null_safe_join(base, q, [agent, "is_total"], "left")
    return out.withColumn("cost_per_token", N.safe_divide("cost", "tokens")).withColumn("tasks_per_hour", N.safe_divide("total_tasks", "hours")).drop("hours")


def error_classes(df: DataFrame, message: str) -> DataFrame:
    """First matching class of every error, its share and impact; unclassified last."""
    text, label = F.lower(F.col(message)), None
    for name, (pattern, _) in ERROR_CLASSES.items():
        label = F.when(text.rlike(pattern), name) if label is None else label.when(text.rlike(pattern), name)
    counts = df.where(F.col(message).isNotNull()).groupBy(label.otherwise("unclassified").alias("error_type")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("t"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("percentage", F.col("count") / F.col("t") * 100).drop("t")
    severity = F.create_map(*[F.lit(x) for k, (_, s) in ERROR_CLASSES.items() for x in (k, s)])[F.col("error_type")]
    p = F.col("percentage")
    known = F.when((p > 20) | (severity == "critical"), "high").when((p > 10) | (severity == "high"), "medium").otherwise("low")
    impact = F.when(F.col("error_type") == "unclassified", F.when(p > 10, "medium").otherwise("low")).otherwise(known)
    return out.withColumn("impact", impact)


def daily_trends(df: DataFrame, started: str) -> DataFrame:
    d = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    return df.groupBy(F.to_date(started).alias("day")).agg(F.avg((F.col("status") == "success").cast("int")).alias("success_rate"), F.avg(d).alias("avg_duration"), F.sum("cost").alias("cost"))


def cost_breakdown(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Cost by each dimension and in total, one pass; cost per token alongside."""
    full = 2 ** len(dims) - 1
    out = df.groupingSets([[], *[[d] for d in dims]], *dims).agg(F.grouping_id().cast("long").alias("g"), F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"))
    label, value = F.lit("all"), F.lit("all")
    for i, d in enumerate(dims):
        here = F.col("g") == full - 2 ** (len(dims) - 1 - i)
        label, value = F.when(here, F.lit(d)).otherwise(label), F.when(here, F.col(d).cast("string")).otherwise(value)
    return out.select(label.alias("dimension"), value.alias("name"), "cost", N.safe_divide("cost", "tokens").alias("cost_per_token"))


def sla_check(metrics: DataFrame) -> DataFrame:
    """Success, latency and error rate against their targets."""
    ok = [F.col("success_rate") >= 0.95, F.coalesce("avg_duration", F.lit(0.0)) <= 10000, F.col("error_rate") <= 0.05]
    score = sum([t.cast("int") for t in ok], F.lit(0)) / 3
    out = metrics.withColumn("success_gap", F.greatest(F.lit(0.0), 0.95 - F.col("success_rate")))
    out = out.withColumn("latency_gap", F.greatest(F.lit(0.0), F.coalesce("avg_duration", F.lit(0.0)) - 10000)).withColumn("error_gap", F.greatest(F.lit(0.0), F.col("error_rate") - 0.05))
    return out.withColumn("compliant", ok[0] & ok[1] & ok[2]).withColumn("compliance_score", score)


def communication_latency(df: DataFrame, actions: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean duration and share over five seconds of message, delegate, coordinate and respond actions."""
    a = df.select(*keys, F.inline(actions)).where(F.col("type").isin("message", "delegate", "coordinate", "respond"))
    return a.groupBy(*keys).agg(F.count(F.lit(1)).alias("communications"), F.avg("duration_ms").alias("avg_latency"), F.count_if(F.col("duration_ms") > 5000).alias("high_latency"))


def bottlenecks(metrics: DataFrame, agent: str, tools: DataFrame, talk: DataFrame, resources: DataFrame) -> DataFrame:
    """Weak or slow agents, failing tools, slow communication, high use: one row per finding with its severity."""
    m = metrics
    weak = m.where("success_rate < 0.8").select(F.lit("agent_success").alias("kind"), F.col(agent).cast("string").alias("location"), F.when(F.col("success_rate") < 0.5, "critical").otherwise("high").alias("severity"))
    slow = m.where("avg_duration > 30000").select(F.lit("agent_latency").alias("kind"), F.col(agent).cast("string").alias("location"), F.when(F.col("avg_duration") > 60000, "high").otherwise("medium").alias("severity"))
    fail = tools.where("error_rate > 0.2").select(F.lit("tool").alias("kind"), F.col("tool").alias("location"), F.when(F.col("error_rate") > 0.4, "high").otherwise("medium").alias("severity"))
    chat = talk.where("high_latency > 5").select(F.lit("communication").alias("kind"), F.lit("inter_agent").alias("location"), F.lit("medium").alias("severity"))
    use = resources.where("high_usage > 10").select(F.lit("resource").alias("kind"), F.lit("token_usage").alias("location"), F.lit("medium").alias("severity"))
    return weak.unionByName(slow).unionByName(fail).unionByName(chat).unionByName(use)


def resource_excess(df: DataFrame, tokens: str) -> DataFrame:
    """Rows over twice the mean, and the sum of what lies above the mean."""
    mean = df.agg(F.avg(tokens).alias("mean"))
    rows = df.select(tokens).crossJoin(F.broadcast(mean))
    return rows.agg(
        F.max("mean").alias("mean_usage"), F.count_if(F.col(tokens) > 2 * F.col("mean")).alias("high_usage"), (F.sum(F.greatest(F.lit(0.0), F.col(tokens) - F.col("mean"))) * 0.00002).alias("excess_cost")
    )


def latency_summary(df: DataFrame, keys: Sequence[str], ok: Column, latency: str, ts: str) -> DataFrame:
    """Requests per second, failures, and exact latency percentiles of the successful requests."""
    rows = df.withColumn("__ok", ok).withColumn("__l", F.when(ok, F.col(latency)))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("__ok")).alias("failed"), F.avg("__l").alias("mean"), F.stddev_samp("__l").alias("std"), (minutes_between(F.min(ts), F.max(ts)) * 60).alias("seconds")
    )
    q = exact_quantiles(rows, keys, "__l", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).drop("n")
    return null_safe_join(base, q, list(keys), "left").withColumn("rps", N.safe_divide("requests", "seconds")).drop("seconds")


# ---- audit logs and anomalies -----------------------------------------------


def audit_normalise(df: DataFrame, raw: str) -> DataFrame:
    """Field fallbacks over nested JSON log lines."""
    g = lambda p: F.get_json_object(raw, p)
    return df.select(
        *[c for c in df.columns if c != raw],
        F.coalesce(g("$.auth.display_name"), g("$.auth.entity_id"), F.lit("unknown")).alias("identity"),
        F.coalesce(g("$.request.path"), g("$.path"), F.lit("unknown")).alias("path"),
        F.coalesce(g("$.request.operation"), g("$.operation"), F.lit("unknown")).alias("operation"),
        F.coalesce(g("$.response.status_code"), g("$.status_code")).try_cast("int").alias("status"),
        F.coalesce(g("$.remote_address"), g("$.source_address"), F.lit("unknown")).alias("ip"),
    )


def audit_volume_spike(df: DataFrame, identity: str, t: float) -> DataFrame:
    """Identities with at least max(t x mean, t) rows; the mean is over identities."""
    counts = df.groupBy(identity).agg(F.count(F.lit(1)).alias("access_count"))
    limit = counts.agg(F.greatest(F.avg("access_count") * t, F.lit(float(t))).alias("threshold"))
    return counts.crossJoin(F.broadcast(limit)).where("access_count >= threshold")


def audit_distinct(df: DataFrame, identity: str, thing: str, least: int, out: str) -> DataFrame:
    """Identities seen with at least ``least`` different addresses or paths."""
    return df.groupBy(identity).agg(F.countDistinct(thing).alias(out)).where(F.col(out) >= least)


def audit_failed(df: DataFrame, identity: str, ip: str, status: str, t: int) -> DataFrame:
    bad = (F.col(status) >= 400)
    return df.where(bad).groupBy(F.concat(identity, F.lit("@"), ip).alias("source")).agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= t)


def audit_off_hours(df: DataFrame, identity: str, ts: str, t: int) -> DataFrame:
    return df.where(D.off_hours(ts)).groupBy(identity).agg(F.count(F.lit(1)).alias("access_count")).where(F.col("access_count") >= max(t, 2))


def entity_zscore(df: DataFrame, volume: str, ts: str, mean: float, std: float) -> DataFrame:
    """One-sided z against a given baseline: soft from 2, hard from 3; hours 22 to 5 are suspicious."""
    z = (F.col(volume).cast("double") - mean) / std
    out = df.withColumn("z", z).withColumn("hard_flag", F.coalesce(F.col("z") >= 3, F.lit(False)))
    out = out.withColumn("soft_flag", F.coalesce((F.col("z") >= 2) & (F.col("z") < 3), F.lit(False))).withColumn("time_anomaly", F.coalesce(D.off_hours(ts), F.lit(False)))
    return out.where("hard_flag OR soft_flag OR time_anomaly")


def hunt_score(df: DataFrame, text: str, actor: int = 1, gap: int = 1, data: int = 2) -> DataFrame:
    """2 per keyword, 3 per distinct technique code, plus context points; pursue from 5."""
    low = F.lower(F.col(text))
    codes = F.size(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"[Tt]\d{4}(?:\.\d{3})?"), F.lit(0))))
    words = F.filter(F.array(*[F.when(low.contains(k), F.lit(k)) for k in HUNT_KEYWORDS]), lambda w: w.isNotNull())
    table = F.create_map(*[F.lit(x) for kv in HUNT_KEYWORDS.items() for x in kv])
    out = df.withColumn("keywords", words).withColumn("codes", codes.cast("long"))
    out = out.withColumn("tactics", F.array_join(F.array_sort(F.array_distinct(F.transform("keywords", lambda w: table[w]))), ","))
    score = F.size("keywords") * 2 + F.col("codes") * 3 + actor * 3 + gap * 2 + data
    return out.withColumn("priority_score", score).withColumn("pursue", F.col("priority_score") >= 5)


def ioc_sweep(docs: DataFrame, text: str, indicators: DataFrame, as_of: str, max_age_days: int = 30) -> DataFrame:
    """Indicator (type, value, seen) hits by type, with staleness and type coverage.

    Tokens that can be indicators are cut from the text by type and met by an equi join; nothing is
    compared pair by pair.
    """
    low = F.lower(F.col(text))
    cuts = {
        "ip": r"\d{1,3}(?:\.\d{1,3}){3}", "url": r"https?://[^\s<>]+", "email": r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", "domain": r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}", "hash": r"[0-9a-f]{32,64}",
    }

    def tagged(kind: str, pattern: str) -> Column:
        values = F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    found = F.concat(*[tagged(k, p) for k, p in cuts.items()])
    hits = docs.select(F.inline(found)).groupBy("type", "value").agg(F.count(F.lit(1)).alias("hits"))
    known = indicators.groupBy("type", "value").agg(F.max("seen").alias("seen"))
    rows = known.join(hits, ["type", "value"], "left")
    age = F.datediff(F.lit(as_of).cast("date"), "seen")
    out = rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("indicators"), F.count_if(F.col("hits") > 0).alias("matched"), F.coalesce(F.sum("hits"), F.lit(0)).alias("documents"), F.count_if(age > max_age_days).alias("stale")
    )
    n = out.agg((F.count(F.lit(1)) / 6.0).alias("coverage"))
    return out.crossJoin(F.broadcast(n))


def incident_class(df: DataFrame, text: str, event_type: str | None = None) -> DataFrame:
    """Best scoring incident class with its confidence, and the signs of harmless activity."""
    low = F.lower(F.col(text))
    scored, total = [], F.lit(0)
    for i, (name, words) in enumerate(INCIDENT_WORDS.items()):
        score = X.hits(low, name.split("_")) * 2 + X.hits(low, words)
        scored.append(F.struct(score.alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")))
        total = total + score
    out = df.withColumn("__best", F.array_max(F.array(*scored))).withColumn("__total", total)
    top = F.col("__best.score")
    kind = F.lower(F.col(event_type)) if event_type else F.lit("")
    raw = top / F.greatest(F.col("__total"), F.lit(1)) + F.when(kind == F.col("__best.name"), 0.25).otherwise(0.0)
    conf = F.least(F.lit(1.0), F.least(F.lit(1.0), raw) + 0.1 * F.least(top, F.lit(5)))
    hit = top > 0
    harmless = F.concat_ws(",", *[F.when(X.any_of(low, words), F.lit(n)) for n, words in FALSE_POSITIVE.items()])
    return out.select(
        *df.columns, F.when(hit, F.col("__best.name")).otherwise("unknown").alias("incident_type"), F.when(hit, F.round(conf, 2)).otherwise(0.0).alias("confidence"), harmless.alias("false_positive_signs")
    )


def event_typing(df: DataFrame, source: str, message: str, kind: str, severity: str) -> DataFrame:
    """Explicit type, else the first type whose source or message word fits; severity name to number."""
    s, m, k = F.lower(F.col(source)), F.lower(F.col(message)), F.lower(F.col(kind))
    label = F.when(k.isin(list(EVENT_TYPES)), k)
    for name, (sources, words) in EVENT_TYPES.items():
        label = label.when(X.any_of(s, sources) | X.any_of(m, words), name)
    return df.withColumn("event_class", label.otherwise("unknown")).withColumn("severity_level", N.level_value(F.trim(F.col(severity)), SEVERITY_NAMES, 0).cast("int"))


# ---- alerts and budgets -----------------------------------------------------


def alert_noise(df: DataFrame) -> DataFrame:
    """Noise points from rule text, short or missing wait, firing and false positive rate; kept from 3.

    Needs expr, wait (duration text), fires_per_day, false_positive_rate.
    """
    e = F.lower(F.col("expr"))
    score = F.lit(0)
    for p in NOISY:
        score = score + F.when(e.rlike(p), 3).otherwise(0)
    wait = F.coalesce("wait", F.lit("0s"))
    score = score + F.when(D.duration_seconds(wait) < 60, 2).otherwise(0) + F.when(wait.isin("", "0s"), 2).otherwise(0)
    tight = F.lit(False)
    for p in SENSITIVE:
        tight = tight | e.rlike(p)
    score = score + F.when(tight, 2).otherwise(0) + F.when(F.col("fires_per_day") > 10, 3).otherwise(0) + F.when(F.col("false_positive_rate") > 0.3, 4).otherwise(0)
    return df.withColumn("noise_score", score).where("noise_score >= 3")


def alert_duplicates(df: DataFrame) -> DataFrame:
    """Groups with the same expression and labels, and groups alike in service, metric type, threshold and severity.

    Needs expr, service, severity, team.
    """
    e = F.trim(F.regexp_replace("expr", r"\s+", " "))
    exact = df.groupBy(e.alias("e"), "service", "severity", "team").agg(F.count(F.lit(1)).alias("alerts"))
    exact = exact.where("alerts > 1").select(F.lit("exact").alias("kind"), F.concat_ws("|", "e", "service", "severity", "team").alias("signature"), "alerts")
    metric = first_match(F.lower("expr"), METRIC_TYPES, "other")
    limit = F.regexp_extract("expr", r">[\s]*([0-9.]+)", 1)
    for p in (r"<[\s]*([0-9.]+)", r">=[\s]*([0-9.]+)", r"<=[\s]*([0-9.]+)", r"==[\s]*([0-9.]+)"):
        limit = F.when(limit != "", limit).otherwise(F.regexp_extract("expr", p, 1))
    limit = F.when(limit != "", limit).otherwise("unknown")
    like = df.groupBy("service", metric.alias("m"), limit.alias("l"), "severity").agg(F.count(F.lit(1)).alias("alerts"))
    like = like.where("alerts > 1").select(F.lit("semantic").alias("kind"), F.concat_ws("|", "service", "m", "l", "severity").alias("signature"), "alerts")
    return exact.unionByName(like)


def alert_coverage(df: DataFrame, services: DataFrame) -> DataFrame:
    """Missing categories overall, missing golden signals overall and by service.

    Needs expr, name, service; the grid is services by four signals.
    """
    spark = df.sparkSession
    both = F.lower(F.concat_ws(" ", "expr", "name"))
    seen = df.select(first_match(both, ALERT_CATEGORIES, "other").alias("item")).distinct()
    cats = spark.createDataFrame([(c,) for c in ALERT_CATEGORIES], "item string").join(seen, "item", "left_anti").select(F.lit("category").alias("kind"), F.lit("all").alias("service"), "item")
    signal = first_match(F.lower("expr"), GOLDEN_SIGNALS, None)
    have = df.select("service", signal.alias("item")).where("item IS NOT NULL").distinct()
    names = spark.createDataFrame([(s,) for s in GOLDEN_SIGNALS], "item string")
    overall = names.join(have.select("item").distinct(), "item", "left_anti").select(F.lit("signal").alias("kind"), F.lit("all").alias("service"), "item")
    grid = services.select("service").distinct().crossJoin(F.broadcast(names))
    by = grid.join(have, ["service", "item"], "left_anti").select(F.lit("service_signal").alias("kind"), "service", "item")
    return cats.unionByName(overall).unionByName(by)


def error_budget(df: DataFrame, target: str) -> DataFrame:
    """Seconds of allowed failure per window from an availability target."""
    windows = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(s).alias("seconds")) for w, s in (("1h", 3600), ("1d", 86400), ("7d", 604800), ("30d", 2592000))]))
    out = df.select("*", windows.alias("w")).select(*df.columns, "w.window", "w.seconds")
    return out.withColumn("budget_rate", 1 - F.col(target)).withColumn("budget_seconds", F.col("seconds") * F.col("budget_rate")).drop("seconds")


def burn_rate(df: DataFrame, keys: Sequence[str], ts: str, bad: Column, target: float, step_minutes: int = 5) -> DataFrame:
    """Alert points where the short and the long window both burn faster than the limit.

    Events are counted by key and step first; windows run over those counts with range frames, so the
    window input grows with time, not with traffic.
    """
    step = step_minutes * 60
    slot = (F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / step) * step).alias("slot")
    counts = df.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("b"))
    allowed = 1 - target
    w = Window.partitionBy(*keys).orderBy("slot")
    parts = []
    for short, long, limit in BURN_WINDOWS:
        def rate(minutes: int) -> Column:
            frame = w.rangeBetween(-(minutes * 60 - step), 0)
            return F.sum("b").over(frame) / F.sum("n").over(frame) / allowed

        parts.append(F.struct(F.lit(short).alias("short_minutes"), F.lit(long).alias("long_minutes"), rate(short).alias("short_burn"), rate(long).alias("long_burn"), F.lit(limit).alias("burn_limit")))
    rows = counts.select(*keys, "slot", F.array(*parts).alias("p")).select(*keys, "slot", F.inline("p"))
    return rows.where("short_burn > burn_limit AND long_burn > burn_limit")


# Weights, level scores and bounds of the incident severity.
SEVERITY_WEIGHTS = {"revenue": 0.25, "users": 0.25, "security": 0.20, "criticality": 0.15, "blast": 0.15}
REVENUE_LEVEL = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2, "none": 0.0}
DEGRADATION = {"complete": 1.0, "major": 0.75, "partial": 0.50, "minor": 0.25, "none": 0.0}
ERROR_RATE_STEPS = [(50.0, 1.0), (25.0, 0.8), (10.0, 0.6), (5.0, 0.4), (1.0, 0.2)]
LATENCY_STEPS = [(10000, 1.0), (5000, 0.8), (2000, 0.6), (1000, 0.4), (500, 0.2)]
SEVERITY_STEPS = [(0.75, "SEV1"), (0.50, "SEV2"), (0.25, "SEV3")]


def _ladder(x: Column, steps: Sequence[tuple[float, float]], other: float) -> Column:
    out = None
    for bound, value in steps:
        out = F.when(x >= bound, F.lit(float(value))) if out is None else out.when(x >= bound, F.lit(float(value)))
    return out.otherwise(F.lit(float(other)))


def severity_score(df: DataFrame) -> DataFrame:
    """Five weighted dimensions, floors for breaches and full outages, and the level.

    Needs revenue_impact, customer_facing, workaround, users_pct, customer_reports, degradation, breach,
    integrity_risk, dependents, endpoints, regions, error_rate, latency_p99, alerts.
    """
    c, one = F.col, F.lit(1.0)
    rev = N.level_value("revenue_impact", REVENUE_LEVEL, 0.0)
    rev = F.when(c("customer_facing") & (rev >= 0.5), F.least(one, rev + 0.1)).otherwise(rev)
    rev = F.when(~c("workaround") & (rev >= 0.5), F.least(one, rev + 0.1)).otherwise(rev)
    users = _ladder(c("users_pct"), [(75, 1.0), (50, 0.85), (25, 0.65), (10, 0.45), (1, 0.25)], 0.1)
    users = F.least(one, users + F.when(c("customer_reports") > 20, 0.15).when(c("customer_reports") > 5, 0.08).otherwise(0.0))
    users = F.least(one, users + N.level_value("degradation", DEGRADATION, 0.0) * 0.15)
    sec = F.when(c("breach"), 1.0).when(c("integrity_risk"), 0.8).otherwise(0.0)
    sec = F.when(c("customer_facing") & c("integrity_risk"), F.least(one, sec + 0.1)).otherwise(sec)
    crit = _ladder(c("dependents"), [(5, 1.0), (3, 0.75), (1, 0.5)], 0.2)
    crit = F.least(one, crit + F.when(c("endpoints") >= 5, 0.15).when(c("endpoints") >= 2, 0.08).otherwise(0.0))
    blast = _ladder(c("regions"), [(3, 0.9), (2, 0.6), (1, 0.3)], 0.0)
    blast = F.greatest(blast, _ladder(c("error_rate"), ERROR_RATE_STEPS, 0.0), _ladder(c("latency_p99"), LATENCY_STEPS, 0.0))
    blast = F.least(one, blast + F.when(c("alerts") >= 20, 0.15).when(c("alerts") >= 10, 0.08).otherwise(0.0))
    parts = {"revenue": rev, "users": users, "security": sec, "criticality": crit, "blast": blast}
    out = df.select("*", *[v.alias(k) for k, v in parts.items()])
    score = sum([N.python_round(c(k) * w, 3) for k, w in SEVERITY_WEIGHTS.items()], F.lit(0.0))
    score = F.when(c("breach"), F.greatest(score, F.lit(0.85))).otherwise(score)
    score = F.when(c("integrity_risk") & c("customer_facing"), F.greatest(score, F.lit(0.76))).otherwise(score)
    score = F.when((c("users_pct") >= 50) & (c("degradation") == "complete"), F.greatest(score, F.lit(0.80))).otherwise(score)
    out = out.withColumn("composite", F.least(one, N.python_round(score, 3)))
    return out.withColumn("level", N.threshold_label("composite", SEVERITY_STEPS, "SEV4"))


# Debt categories, base effort, severity factors, health weights.
DEBT_CATEGORIES = {
    "code_quality": ["large_function", "high_complexity", "duplicate_code", "long_line", "missing_docstring"], "architecture": ["architecture_debt", "large_file"],
    "security": ["security_risk", "hardcoded_secrets", "sql_injection_risk"], "testing": ["test_debt", "missing_tests", "low_coverage"], "maintenance": ["todo_comment", "commented_code"],
    "dependencies": ["dependency_debt", "outdated_packages"], "infrastructure": ["deployment_debt", "monitoring_gaps"], "documentation": ["outdated_docs"],
}
DEBT_EFFORT = {
    "todo_comment": 2, "missing_docstring": 2, "long_line": 1, "large_function": 8, "high_complexity": 16, "duplicate_code": 12, "large_file": 32, "syntax_error": 4, "security_risk": 20, "architecture_debt": 80, "test_debt": 16,
}
DEBT_FACTOR = {"low": 0.5, "medium": 1.0, "high": 1.5, "critical": 2.0}
DEBT_WEIGHTS = {"density": 0.25, "complexity": 0.20, "testing": 0.15, "documentation": 0.10, "security": 0.15, "maintainability": 0.15}


def debt_snapshots(df: DataFrame, snapshot: str) -> DataFrame:
    """Totals, health and change between snapshots; needs type, severity, file."""
    kind, sev = F.col("type"), F.col("severity")
    cat = F.create_map(*[F.lit(x) for c, types in DEBT_CATEGORIES.items() for t in types for x in (t, c)])[kind]
    secure = kind.isin(DEBT_CATEGORIES["security"])
    high = sev.isin("high", "critical") | kind.isin("security_risk", "syntax_error", "architecture_debt")
    s = df.groupBy(snapshot).agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("file").alias("files"), F.sum(N.level_value(kind, DEBT_EFFORT, 8) * N.level_value(sev, DEBT_FACTOR, 1.0)).alias("effort"),
        F.count_if(high).alias("high_priority"), F.count_if(secure).alias("sec"), F.count_if(kind.isin("high_complexity", "large_function")).alias("cx"), F.count_if(cat == "testing").alias("te"),
        F.count_if(cat == "documentation").alias("do"), F.count_if(cat.isin("architecture", "code_quality")).alias("ma"), F.count_if(kind == "architecture_debt").alias("ar"),
    )
    n = F.greatest(F.col("items"), F.lit(1))
    less = lambda c, k: F.greatest(F.lit(0.0), 100 - F.col(c) / n * k)
    s = s.withColumn("density_raw", F.col("items") / F.greatest(F.col("files"), F.lit(1)))
    s = s.withColumn("density", F.greatest(F.lit(0.0), 100 - F.col("density_raw") * 20)).withColumn("complexity", less("cx", 100)).withColumn("testing", less("te", 150))
    s = s.withColumn("documentation", less("do", 100)).withColumn("security", less("sec", 200)).withColumn("maintainability", less("ma", 120))
    s = s.withColumn("overall", N.weighted_score(DEBT_WEIGHTS, bound=False))
    s = s.withColumn("velocity_impact", F.least(F.lit(50.0), F.col("high_priority") / n * 30 + F.col("density_raw") * 5))
    s = s.withColumn("technical_risk", F.least(F.lit(100.0), (F.col("sec") + F.col("ar")) * 10 + 100 - F.col("security")))
    w = Window.orderBy(snapshot)
    s = s.withColumn("net_change", F.col("items") - F.lag("items").over(w)).withColumn("net_effort_change", F.col("effort") - F.lag("effort").over(w))
    return s.select(snapshot, "items", "effort", "high_priority", "overall", "velocity_impact", "technical_risk", "net_change", "net_effort_change")
