"""Table maintenance and reconciliation on the test tables; the second version of a table is derived from the first."""

from pyspark.sql import functions as F

from millrace.operators import reconcile as C
from millrace.operators import warehouse as W
from millrace.plans.registry import query
from millrace.session import work_folder


def base(t):
    return t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")


def delta(t):
    """Changed balances for every fifth customer, changed segment for every seventh, new keys for every tenth."""
    k = F.col("c_custkey")
    seg = F.when(k % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment"))
    old = t.customer.where("c_custkey % 5 = 0 OR c_custkey % 7 = 0").select(k, seg.alias("c_mktsegment"), (F.col("c_acctbal") + F.when(k % 5 == 0, 10.0).otherwise(0.0)).alias("c_acctbal"))
    new = t.customer.where("c_custkey % 10 = 0").select((k + 10_000_000).alias("c_custkey"), "c_mktsegment", "c_acctbal")
    return old.unionByName(new)


B = """
    b AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer),
    d AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 10.0 ELSE 0 END AS c_acctbal FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0
      UNION ALL SELECT c_custkey + 10000000, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 10 = 0)
"""


@query(
    "upsert_merge",
    f"WITH {B} SELECT coalesce(d.c_custkey, b.c_custkey) AS c_custkey, coalesce(d.c_mktsegment, b.c_mktsegment) AS c_mktsegment, coalesce(d.c_acctbal, b.c_acctbal) AS c_acctbal FROM b FULL JOIN d USING (c_custkey)",
    digits="c_acctbal:2",
)
def upsert_merge(t):
    return W.upsert(base(t), delta(t), "c_custkey")


@query(
    "scd1",
    f"WITH {B} SELECT coalesce(d.c_custkey, b.c_custkey) AS c_custkey, coalesce(d.c_mktsegment, b.c_mktsegment) AS c_mktsegment, coalesce(b.c_acctbal, d.c_acctbal) AS c_acctbal FROM b FULL JOIN d USING (c_custkey)",
    digits="c_acctbal:2",
)
def scd1(t):
    """Only the segment is overwritten."""
    return W.upsert(base(t), delta(t), "c_custkey", ["c_mktsegment"])


@query(
    "merge_newer_only",
    """
    WITH o AS (SELECT o_custkey AS k, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS v, min(o_orderdate) AS ts FROM orders GROUP BY 1),
    s AS (SELECT user_id AS k, value AS v, ts - INTERVAL (user_id % 3 * 3650) DAY AS ts FROM events), n AS (SELECT k, arg_max(v, ts) AS v, max(ts) AS ts FROM s GROUP BY 1)
    SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL OR n.ts > o.ts THEN n.v ELSE o.v END AS v, CASE WHEN o.k IS NULL OR n.ts > o.ts THEN n.ts ELSE o.ts END AS ts FROM o FULL JOIN n ON n.k = o.k
    """,
)
def merge_newer_only(t):
    """First orders as target, user events (shifted by 0, 10 or 20 years) as source."""
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("v"), F.min("o_orderdate").alias("ts"))
    shift = F.make_dt_interval((F.col("user_id") % 3 * 3650).cast("int"))
    s = t.events.select(F.col("user_id").alias("k"), F.col("value").alias("v"), (F.col("ts") - shift).alias("ts"))
    return W.merge_newer(o, s, "k", "ts")


SCD2 = f"""
    {B}, v AS (
      SELECT b.c_custkey, b.c_mktsegment, '2000-01-01' AS valid_from, CASE WHEN d.c_mktsegment <> b.c_mktsegment THEN '2001-01-01' END AS valid_to, d.c_mktsegment IS NULL OR d.c_mktsegment = b.c_mktsegment AS is_current FROM b LEFT JOIN d USING (c_custkey)
      UNION ALL SELECT d.c_custkey, d.c_mktsegment, '2001-01-01', NULL, true FROM d LEFT JOIN b USING (c_custkey) WHERE b.c_mktsegment IS NULL OR b.c_mktsegment <> d.c_mktsegment)
"""


def versions(t):
    start = W.scd2_start(base(t), "c_custkey", ["c_mktsegment"], "2000-01-01")
    return W.scd2(start, delta(t), "c_custkey", ["c_mktsegment"], "2001-01-01")


@query("scd2", f"WITH {SCD2} SELECT * FROM v")
def scd2(t):
    return versions(t).drop("row_hash")


@query(
    "scd3",
    f"WITH {B} SELECT b.c_custkey, coalesce(d.c_mktsegment, b.c_mktsegment) AS c_mktsegment, CASE WHEN d.c_mktsegment <> b.c_mktsegment THEN b.c_mktsegment END AS previous_c_mktsegment FROM b LEFT JOIN d USING (c_custkey)",
)
def scd3(t):
    return W.scd3(base(t).select("c_custkey", "c_mktsegment"), delta(t), "c_custkey", "c_mktsegment")


@query(
    "scd4",
    """
    WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS balance_band, CASE WHEN c_custkey % 4 = 0 THEN 'old' ELSE 'new' END AS age_band FROM customer)
    SELECT balance_band, age_band, md5(length(balance_band) || ':' || balance_band || length(age_band) || ':' || age_band) AS mini_key, count(*) AS customers FROM x GROUP BY 1, 2
    """,
)
def scd4(t):
    bal = F.col("c_acctbal")
    bands = {"balance_band": F.when(bal < 0, "debt").when(bal < 5000, "mid").otherwise("high"), "age_band": F.when(F.col("c_custkey") % 4 == 0, "old").otherwise("new")}
    mini, link = W.scd4(t.customer, "c_custkey", bands)
    return mini.join(link, "mini_key").groupBy("balance_band", "age_band", "mini_key").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "scd6",
    f"WITH {SCD2} SELECT *, lag(c_mktsegment) OVER (PARTITION BY c_custkey ORDER BY valid_from) AS previous_c_mktsegment, last_value(c_mktsegment) OVER (PARTITION BY c_custkey ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current_c_mktsegment FROM v",
)
def scd6(t):
    start = W.scd2_start(base(t), "c_custkey", ["c_mktsegment"], "2000-01-01")
    return W.scd6(start, delta(t), "c_custkey", "c_mktsegment", "2001-01-01").drop("row_hash")


@query(
    "vault_hub",
    f"WITH {B} SELECT md5(c_custkey::VARCHAR) AS hub_key, c_custkey, '2000-01-01' AS loaded, 'base' AS record_source FROM b UNION ALL SELECT md5(c_custkey::VARCHAR), c_custkey, '2001-01-01', 'delta' FROM d WHERE c_custkey >= 10000000",
)
def vault_hub(t):
    empty = t.customer.limit(0).select(F.lit("").alias("hub_key"), "c_custkey", F.lit(None).cast("date").alias("loaded"), F.lit("").alias("record_source"))
    first = W.vault_hub(empty, base(t), "c_custkey", "2000-01-01", "base")
    return W.vault_hub(first, delta(t), "c_custkey", "2001-01-01", "delta")


@query("vault_satellite", f"WITH {SCD2} SELECT c_custkey, c_mktsegment, md5(length(c_mktsegment) || ':' || c_mktsegment) AS row_hash, valid_from, valid_to, is_current FROM v")
def vault_satellite(t):
    start = W.scd2_start(base(t), "c_custkey", ["c_mktsegment"], "2000-01-01")
    return W.vault_satellite(start, delta(t), "c_custkey", ["c_mktsegment"], "2001-01-01")


@query(
    "vault_link",
    """
    WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    SELECT md5(length(l_partkey::VARCHAR) || ':' || l_partkey || length(l_suppkey::VARCHAR) || ':' || l_suppkey) AS link_key, l_partkey, l_suppkey, CASE WHEN (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM a) THEN '1998-01-01' ELSE '2001-01-01' END AS loaded FROM b
    """,
)
def vault_link(t):
    keys = ["l_partkey", "l_suppkey"]
    empty = t.lineitem.limit(0).select(F.lit("").alias("link_key"), *keys, F.lit(None).cast("date").alias("loaded"))
    first = W.vault_link(empty, t.lineitem.where("l_shipdate < '1998-01-01'"), keys, "1998-01-01")
    return W.vault_link(first, t.lineitem, keys, "2001-01-01")


@query(
    "incremental_load",
    """
    WITH t AS (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
    s AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM t)),
    n AS (SELECT o_orderkey, max(o_orderdate) AS o_orderdate, arg_max(o_totalprice, o_orderdate) AS o_totalprice FROM s GROUP BY 1)
    SELECT coalesce(n.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(n.o_orderdate, t.o_orderdate) AS o_orderdate FROM t FULL JOIN n USING (o_orderkey)
    """,
)
def incremental_load(t):
    cols = ["o_orderkey", "o_totalprice", "o_orderdate"]
    target = t.orders.where("o_orderdate < '1999-01-01'").select(*cols)
    k = F.col("o_orderkey")
    source = t.orders.select(F.when(k % 6 == 0, k - 1).otherwise(k).alias("o_orderkey"), "o_totalprice", "o_orderdate")
    return W.incremental(target, source, "o_orderkey", "o_orderdate").select("o_orderkey", "o_orderdate")


@query(
    "medallion",
    """
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) AS revenue, max(ts) AS last_activity FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL
    """,
    digits="revenue",
)
def medallion(t):
    """The raw feed holds every event twice, as after a repeated delivery."""
    raw = t.events.unionByName(t.events)
    return W.medallion(raw, "event_id", "event_type", ["view", "click", "purchase"], "ts", "user_id", "value")


@query(
    "cdc_apply",
    """
    WITH c AS (SELECT user_id AS c_custkey, CASE event_type WHEN 'error' THEN 'd' WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' ELSE 'u' END AS op, value AS c_acctbal, ts, event_id FROM events),
    l AS (SELECT c_custkey, arg_max(op, (ts, event_id)) AS op, arg_max(c_acctbal, (ts, event_id)) AS c_acctbal FROM c GROUP BY 1)
    SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM l) UNION ALL SELECT c_custkey, c_acctbal FROM l WHERE op <> 'd'
    """,
)
def cdc_apply(t):
    e = F.col("event_type")
    op = F.when(e == "error", "d").when(e == "signup", "c").when(e == "view", "r").otherwise("u")
    changes = t.events.select(F.col("user_id").alias("c_custkey"), op.alias("op"), F.col("value").alias("c_acctbal"), "ts", "event_id")
    return W.apply_changes(t.customer.select("c_custkey", "c_acctbal"), changes, "c_custkey", "op", ["ts", "event_id"])


@query(
    "dead_letter_split",
    """SELECT event_id, CASE WHEN value < 1 THEN 'too_small' WHEN event_type = 'error' THEN 'bad_type' END AS error_type, 0 AS retry_count FROM events WHERE value < 1 OR event_type = 'error'""",
)
def dead_letter_split(t):
    _, bad = W.dead_letters(t.events, {"too_small": F.col("value") >= 1, "bad_type": F.col("event_type") != "error"})
    return bad.select("event_id", "error_type", "retry_count")


@query(
    "backfill_dates",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1",
    digits="total:2",
)
def backfill_dates(t):
    """All dates are written, then two of them are written again: the result must not change."""
    path = work_folder(t.spark, "backfill")
    rows = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    rows.write.partitionBy("day").parquet(path)
    for _ in range(2):
        W.backfill(rows, path, "day", ["2024-01-03", "2024-01-04"])
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("day").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(
    "date_dimension",
    """
    WITH d AS (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)
    SELECT strftime(d, '%Y%m%d')::INT AS date_key, strftime(d, '%Y-%m-%d') AS day, year(d) AS year, quarter(d) AS quarter, month(d) AS month, monthname(d) AS month_name, weekofyear(d) AS week, day(d) AS day_of_month, dayofweek(d) + 1 AS day_of_week, dayname(d) AS day_name, dayofweek(d) IN (0, 6) AS is_weekend FROM d
    """,
)
def date_dimension(t):
    return W.date_dimension(t.orders, "o_orderdate")


# ---- reconciliation ---------------------------------------------------------

COLS = ["o_custkey", "o_orderstatus", "o_totalprice"]


def copy(t):
    """Orders with changed prices and states, lost rows and extra rows."""
    k = F.col("o_orderkey")
    rows = t.orders.where("o_orderkey % 101 <> 0").select(
        k, "o_custkey", F.when(k % 89 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") + F.when(k % 97 == 0, 10.0).otherwise(0.0)).alias("o_totalprice"), "o_orderdate"
    )
    extra = t.orders.where("o_orderkey % 103 = 0").select((k + 10_000_000).alias("o_orderkey"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return rows.unionByName(extra)


CP = """
    c AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 97 = 0 THEN 10.0 ELSE 0 END AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 101 <> 0
      UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 103 = 0)
"""


@query("count_compare", f"WITH {CP} SELECT 'source' AS side, count(*) AS rows FROM orders UNION ALL SELECT 'target', count(*) FROM c")
def count_compare(t):
    return C.count_compare(t.orders, copy(t))


@query(
    "group_count_diff",
    f"""WITH {CP}, a AS (SELECT o_orderstatus, o_orderdate, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_orderstatus, o_orderdate, count(*) AS n FROM c GROUP BY ALL)
    SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day, coalesce(a.n, 0) AS source_rows, coalesce(b.n, 0) AS target_rows, coalesce(a.n, 0) - coalesce(b.n, 0) AS difference FROM a FULL JOIN b USING (o_orderstatus, o_orderdate) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def group_count_diff(t):
    day = F.to_date("o_orderdate")
    return C.group_count_diff(t.orders.withColumn("day", day), copy(t).withColumn("day", day), ["o_orderstatus", "day"])


DIFF = "o_orderkey % 89 = 0 OR o_orderkey % 97 = 0"


@query(
    "row_checksum_diff",
    f"SELECT o_orderkey, 'missing' AS kind FROM orders WHERE o_orderkey % 101 = 0 UNION ALL SELECT o_orderkey + 10000000, 'extra' FROM orders WHERE o_orderkey % 103 = 0 UNION ALL SELECT o_orderkey, 'mismatch' FROM orders WHERE o_orderkey % 101 <> 0 AND ({DIFF})",
)
def row_checksum_diff(t):
    return C.row_checksum_diff(t.orders, copy(t), "o_orderkey", COLS)


def _checksum(alias):
    text = " || ".join(f"coalesce(length({v}) || ':' || {v}, '-')" for v in (f"{alias}.o_custkey::VARCHAR", f"{alias}.o_orderstatus", f"({alias}.o_totalprice::DECIMAL(12, 2))::VARCHAR"))
    half = lambda a: f"sum(('0x' || substr(md5({text}), {a}, 16))::UBIGINT::HUGEINT)::VARCHAR"
    return f"{half(1)} || ':' || {half(17)}"


@query(
    "group_checksum",
    f"""WITH {CP}, a AS (SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s, {_checksum('orders')} AS h FROM orders GROUP BY 1), b AS (SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s, {_checksum('c')} AS h FROM c GROUP BY 1)
    SELECT o_orderstatus, a.n AS source_rows, b.n AS target_rows, a.s AS source_total, b.s AS target_total, a.h AS source_checksum, b.h AS target_checksum FROM a FULL JOIN b USING (o_orderstatus) WHERE a.h IS DISTINCT FROM b.h OR a.n IS DISTINCT FROM b.n""",
    digits="source_total:1 target_total:1",
)
def group_checksum(t):
    price = F.col("o_totalprice").cast("decimal(12,2)")
    return C.group_checksum(t.orders.withColumn("o_totalprice", price), copy(t).withColumn("o_totalprice", price), ["o_orderstatus"], COLS, "o_totalprice")


@query(
    "rule_totals_tolerance",
    f"""WITH {CP}, a AS (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS s FROM c GROUP BY 1, 2),
    j AS (SELECT o_custkey, o_orderstatus, a.s AS source_total, b.s AS target_total, CASE WHEN b.s IS NULL THEN 'missing' WHEN a.s IS NULL THEN 'extra' WHEN abs(a.s - b.s) > 0.01 THEN 'mismatch' END AS kind FROM a FULL JOIN b USING (o_custkey, o_orderstatus)) SELECT * FROM j WHERE kind IS NOT NULL""",
    digits="source_total:2 target_total:2",
)
def rule_totals_tolerance(t):
    return C.rule_totals(t.orders, copy(t), ["o_custkey", "o_orderstatus"], "o_totalprice")


@query("missing_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 101 = 0")
def missing_rows(t):
    return C.missing_rows(t.orders, copy(t), "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "field_mismatches",
    "SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS source_value, 'X' AS target_value FROM orders WHERE o_orderkey % 101 <> 0 AND o_orderkey % 89 = 0 UNION ALL "
    "SELECT o_orderkey, 'price', o_totalprice::DECIMAL(12, 2)::VARCHAR, (o_totalprice + 10)::DECIMAL(12, 2)::VARCHAR FROM orders WHERE o_orderkey % 101 <> 0 AND o_orderkey % 97 = 0",
)
def field_mismatches(t):
    price = F.col("o_totalprice").cast("decimal(12,2)")
    return C.field_mismatches(t.orders.withColumn("price", price), copy(t).withColumn("price", price), "o_orderkey", ["o_custkey", "o_orderstatus", "price"])


@query(
    "cdc_missed_changes",
    "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_type = 'error'",
)
def cdc_missed_changes(t):
    return C.missed_changes(t.events, t.events.where("event_type <> 'error'"), "event_id", "ts", "2024-01-10 00:00:00", "2024-01-20 00:00:00").select("event_id", "event_type")


@query(
    "sampled_validation",
    f"""WITH {CP}, n AS (SELECT count(*) AS n FROM orders), z AS (SELECT n, ceil(CASE WHEN n < 10000 THEN 384.16 / (1 + 383.16 / n) ELSE 384.16 END) AS k FROM n),
    r AS (SELECT o_orderkey, row_number() OVER (ORDER BY ('0x' || left(md5(o_orderkey::VARCHAR), 13))::BIGINT, o_orderkey) AS rn FROM orders), s AS (SELECT o_orderkey FROM r, z WHERE rn <= k),
    e AS (SELECT count(*) AS sample_size, count(*) FILTER (WHERE o_orderkey % 101 = 0 OR {DIFF}) AS errors FROM s), p AS (SELECT n AS population, sample_size, errors, errors / sample_size AS error_rate FROM e, n)
    SELECT *, greatest(0, error_rate - 1.96 * sqrt(error_rate * (1 - error_rate) / sample_size)) AS lower, least(1, error_rate + 1.96 * sqrt(error_rate * (1 - error_rate) / sample_size)) AS upper, floor(error_rate * population)::BIGINT AS estimated_errors FROM p""",
    digits="error_rate:6 lower:6 upper:6",
)
def sampled_validation(t):
    return C.sampled_validation(t.orders, copy(t), "o_orderkey", COLS)


@query(
    "drift_report",
    """
    WITH f AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 101 = 0 THEN 'missing' ELSE 'mismatch' END AS kind, o_custkey % 3 = 0 AS fixed, o_orderdate AS day FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 89 = 0 OR o_orderkey % 97 = 0),
    g AS (SELECT o_orderpriority, kind, count(*) AS findings, avg(fixed::INT) AS corrected_share, count(*) FILTER (WHERE day < TIMESTAMP '1998-06-01') / greatest(count(DISTINCT CASE WHEN day < TIMESTAMP '1998-06-01' THEN day END), 1) AS daily_before,
      count(*) FILTER (WHERE day >= TIMESTAMP '1998-06-01') / greatest(count(DISTINCT CASE WHEN day >= TIMESTAMP '1998-06-01' THEN day END), 1) AS daily_after FROM f GROUP BY 1, 2)
    SELECT *, CASE WHEN daily_after > daily_before * 1.2 THEN 'increasing' ELSE 'stable' END AS trend FROM g
    """,
    digits="corrected_share:6 daily_before:6 daily_after:6",
)
def drift_report(t):
    diffs = C.row_checksum_diff(t.orders, copy(t), "o_orderkey", COLS).where("kind <> 'extra'")
    rows = diffs.join(t.orders, "o_orderkey").select("o_orderpriority", "kind", (F.col("o_custkey") % 3 == 0).alias("fixed"), F.to_date("o_orderdate").alias("day"))
    return C.drift_report(rows, "o_orderpriority", "kind", "fixed", "day", "1998-06-01")
