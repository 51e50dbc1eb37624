"""Set operations, series and hierarchies on the test tables."""

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import sets as S
from millrace.plans.registry import query

#: DuckDB words of the rule "alnum".
ALNUM = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))"


@query(
    "union_all",
    "SELECT user_id AS id, ts AS at_ts, 'event' AS kind FROM events UNION ALL SELECT o_custkey, o_orderdate, 'order' FROM orders",
)
def union_all(t):
    a = t.events.select(F.col("user_id").alias("id"), F.col("ts").alias("at_ts"), F.lit("event").alias("kind"))
    return a.unionByName(t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at_ts"), F.lit("order").alias("kind")))


@query(
    "union_distinct",
    "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'view' UNION SELECT user_id, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'purchase'",
)
def union_distinct(t):
    day = F.to_date("ts").alias("day")
    a = t.events.where("event_type = 'view'").select("user_id", day)
    return a.union(t.events.where("event_type = 'purchase'").select("user_id", day)).distinct()


def _terms(t):
    return t.documents.select("lang", F.explode(F.array_distinct(X.tokens("text", "alnum"))).alias("term")).distinct()


TERMS = f"t AS (SELECT DISTINCT lang, unnest({ALNUM}) AS term FROM documents)"


@query(
    "set_difference",
    f"WITH {TERMS} SELECT term, count(DISTINCT lang) AS used_by FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE lang = 'en') = 0",
)
def set_difference(t):
    return S.missing_terms(_terms(t), "term", "lang", "en")


@query(
    "set_intersection",
    f"WITH {TERMS} SELECT term, count(DISTINCT lang) AS used_by, count(DISTINCT lang) < 4 AS gap FROM t GROUP BY 1 HAVING count(DISTINCT lang) >= 2",
)
def set_intersection(t):
    return S.shared_terms(_terms(t), "term", "lang", 4)


@query(
    "distinct_rows",
    "WITH g AS (SELECT user_id, event_type, props, count(*) AS n FROM events GROUP BY ALL) SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, sum(n - 1)::BIGINT AS duplicate_rows FROM g",
)
def distinct_rows(t):
    return S.duplicate_rows(t.events, ["user_id", "event_type", "props"])


@query("dedupe_min_id", "SELECT user_id, event_type, props, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedupe_min_id(t):
    return S.dedupe_min_id(t.events, ["user_id", "event_type", "props"], "event_id")


@query(
    "generate_series",
    """
    WITH d AS (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS day FROM orders),
    o AS (SELECT date_trunc('day', o_orderdate) AS day, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)
    SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM d LEFT JOIN o USING (day)
    """,
    digits="total:2",
)
def generate_series(t):
    return S.fill_gaps(t.orders, "o_orderdate", F.sum("o_totalprice"))


TREE = """
    n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN c_custkey // 10 END AS parent_id, c_mktsegment AS label FROM customer),
    tree AS (SELECT id, 0 AS depth, label AS path FROM n WHERE parent_id IS NULL
      UNION ALL SELECT n.id, tree.depth + 1, tree.path || ' > ' || n.label FROM n JOIN tree ON n.parent_id = tree.id)
"""


def _tree(t):
    parent = F.when(F.col("c_custkey") > 0, F.expr("c_custkey div 10"))
    return S.hierarchy(t.customer.withColumn("parent", parent), "c_custkey", "parent", "c_mktsegment")


@query("recursive_hierarchy", f"WITH RECURSIVE {TREE} SELECT id, depth FROM tree")
def recursive_hierarchy(t):
    return _tree(t).select("id", "depth")


@query("recursive_path", f"WITH RECURSIVE {TREE} SELECT id, path FROM tree WHERE depth >= 2")
def recursive_path(t):
    return _tree(t).where("depth >= 2").select("id", "path")
