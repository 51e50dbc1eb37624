"""Filters, projections, joins and subqueries on the test tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import numeric as N
from millrace.operators import relational as R
from millrace.plans.registry import query


@query(
    "nested_path_get",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
    "json_extract_string(props, '$.a.b') AS missing FROM events",
)
def nested_path_get(t):
    v = F.parse_json("props")
    return t.events.select(
        "event_id",
        F.try_variant_get(v, "$.k", "bigint").alias("k"),
        F.try_variant_get(v, "$.a.b", "string").alias("missing"),
    )


@query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def filter_contains(t):
    return R.contains_filter(t.part, "p_name", "RING").select("p_partkey", "p_name")


@query("project_fields", "SELECT p_partkey, p_brand, NULL::VARCHAR AS p_colour FROM part")
def project_fields(t):
    return R.project(t.part, ["p_partkey", "p_brand", "p_colour"])


@query(
    "isin_notnull_filter",
    "SELECT event_id, event_type FROM events WHERE user_id IS NOT NULL AND event_type IN ('view', 'click', 'purchase')",
)
def isin_notnull_filter(t):
    return R.allowed_rows(t.events, "user_id", "event_type", ["view", "click", "purchase"]).select(
        "event_id", "event_type"
    )


@query(
    "clean_strings",
    "SELECT c_custkey, trim(lower(c_name)) AS c_name, trim(lower(c_mktsegment)) AS c_mktsegment "
    "FROM customer WHERE c_name IS NOT NULL AND c_mktsegment IS NOT NULL",
)
def clean_strings(t):
    return R.clean_text(t.customer, ["c_name", "c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


@query(
    "safe_divide",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax IS NULL OR l_tax = 0 THEN 0.0 "
    "ELSE l_discount / l_tax END AS ratio FROM lineitem",
    digits="ratio",
)
def safe_divide(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", N.safe_divide("l_discount", "l_tax").alias("ratio")
    )


@query(
    "threshold_label",
    "SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'platinum' WHEN o_totalprice >= 250000 THEN 'gold' "
    "WHEN o_totalprice >= 100000 THEN 'silver' ELSE 'bronze' END AS tier FROM orders",
)
def threshold_label(t):
    steps = [(400000, "platinum"), (250000, "gold"), (100000, "silver")]
    return t.orders.select("o_orderkey", N.threshold_label("o_totalprice", steps, "bronze").alias("tier"))


@query(
    "clamp",
    "SELECT c_custkey, greatest(0.0, least(100.0, c_acctbal / 50)) AS score FROM customer WHERE c_acctbal IS NOT NULL",
    digits="score",
)
def clamp(t):
    return t.customer.where("c_acctbal IS NOT NULL").select("c_custkey", N.clamp(F.col("c_acctbal") / 50).alias("score"))


@query(
    "weighted_score",
    """
    WITH o AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS a FROM orders GROUP BY 1)
    SELECT c_custkey,
           0.5 * greatest(0, least(100, c_acctbal / 100)) + 0.3 * greatest(0, least(100, coalesce(n, 0) * 5.0))
           + 0.2 * greatest(0, least(100, coalesce(a, 0) / 5000)) AS score
    FROM customer LEFT JOIN o ON o_custkey = c_custkey
    """,
    digits="score",
)
def weighted_score(t):
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("a"))
    parts = [
        (F.col("c_acctbal") / 100, 0.5),
        (F.coalesce("n", F.lit(0)) * 5.0, 0.3),
        (F.coalesce("a", F.lit(0)) / 5000, 0.2),
    ]
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", N.weighted_score(parts).alias("score")
    )


@query(
    "min_max_normalize",
    "SELECT p_partkey, greatest(0.0, least(100.0, (p_retailprice - 900) / 1000.0 * 100)) AS score FROM part",
    digits="score",
)
def min_max_normalize(t):
    return t.part.select("p_partkey", N.min_max_normalize("p_retailprice", 900, 1900).alias("score"))


@query(
    "compat_view",
    "SELECT o_orderkey AS order_id, coalesce(o_orderstatus, 'unknown') AS status, coalesce(o_totalprice, 0.0) AS amount, "
    "'USD' AS currency FROM orders",
)
def compat_view(t):
    view = t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.coalesce("o_orderstatus", F.lit("unknown")).alias("status"),
        F.coalesce("o_totalprice", F.lit(0.0)).alias("amount"),
        F.lit("USD").alias("currency"),
    )
    view.createOrReplaceTempView("orders_v1")
    return t.spark.table("orders_v1")


@query(
    "surrogate_key",
    "SELECT c_custkey, md5(coalesce(length(c_custkey::VARCHAR) || ':' || c_custkey, '-') || coalesce(length(c_name) || ':' || c_name, '-') || "
    "coalesce(length(c_mktsegment) || ':' || c_mktsegment, '-')) AS customer_key FROM customer",
)
def surrogate_key(t):
    return t.customer.select("c_custkey", R.surrogate_key(["c_custkey", "c_name", "c_mktsegment"]).alias("customer_key"))


@query(
    "conditional_map_lookup",
    "SELECT o_orderkey, CASE lower(o_orderpriority) WHEN '1-urgent' THEN 3.0 WHEN '2-high' THEN 2.0 "
    "WHEN '3-medium' THEN 1.0 ELSE 0.5 END AS weight FROM orders",
    digits="weight",
)
def conditional_map_lookup(t):
    levels = {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1}
    return t.orders.select("o_orderkey", N.level_value("o_orderpriority", levels, 0.5).alias("weight"))


@query(
    "inner_join",
    "SELECT c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'",
)
def inner_join(t):
    done = t.orders.where(F.col("o_orderstatus") == "F")
    return t.customer.join(done, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "o_orderkey", "o_totalprice")


@query(
    "left_join_count",
    "SELECT c_custkey, c_name, count(o_orderkey) AS order_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
)
def left_join_count(t):
    return R.children_per_parent(t.customer, t.orders, "c_custkey", "o_custkey", "order_count").select(
        "c_custkey", "c_name", "order_count"
    )


@query(
    "self_join_theta",
    "SELECT e.p_partkey, m.p_partkey AS parent_key, e.p_retailprice, m.p_retailprice AS parent_price "
    "FROM part e JOIN part m ON m.p_partkey = e.p_partkey // 10 WHERE e.p_retailprice > m.p_retailprice",
)
def self_join_theta(t):
    m = t.part.select(F.col("p_partkey").alias("parent_key"), F.col("p_retailprice").alias("parent_price"))
    e = t.part.withColumn("boss", F.expr("p_partkey div 10"))
    return e.join(m, (F.col("boss") == F.col("parent_key")) & (F.col("p_retailprice") > F.col("parent_price"))).select(
        "p_partkey", "parent_key", "p_retailprice", "parent_price"
    )


@query(
    "cross_join",
    "SELECT r_name, o_orderpriority FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)",
)
def cross_join(t):
    """Grid of two reduced sides: five regions by the distinct priorities."""
    return t.region.select("r_name").crossJoin(t.orders.select("o_orderpriority").distinct())


TOP3 = """
    SELECT c_custkey, c_name, x.o_orderkey, x.o_totalprice FROM customer, LATERAL (
      SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey
      ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) x
"""


@query("lateral_topn", TOP3)
def lateral_topn(t):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    best = R.top_per_outer(t.customer, t.orders, "c_custkey", "o_custkey", order, 3)
    return best.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query(
    "semi_join_exists",
    "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
def semi_join_exists(t):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    return t.customer.join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query(
    "anti_join_not_exists",
    "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
)
def anti_join_not_exists(t):
    big = t.orders.where(F.col("o_totalprice") > 450000)
    return t.customer.join(big, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "null_aware_anti",
    "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def null_aware_anti(t):
    t.orders.createOrReplaceTempView("na_orders")
    t.customer.createOrReplaceTempView("na_customer")
    return t.spark.sql(
        "SELECT o_orderkey FROM na_orders WHERE o_custkey NOT IN (SELECT c_custkey FROM na_customer WHERE c_acctbal > 0)"
    )


@query(
    "scalar_subquery",
    "SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS diff_from_avg FROM orders",
    digits="diff_from_avg",
)
def scalar_subquery(t):
    mean = t.orders.agg(F.avg("o_totalprice").alias("m"))
    return t.orders.crossJoin(F.broadcast(mean)).select(
        "o_orderkey", (F.col("o_totalprice") - F.col("m")).alias("diff_from_avg")
    )


@query(
    "derived_table",
    "SELECT * FROM (SELECT o_custkey, avg(o_totalprice) AS avg_price FROM orders GROUP BY 1) WHERE avg_price > 250000",
    digits="avg_price",
)
def derived_table(t):
    return t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("avg_price")).where("avg_price > 250000")


@query(
    "cte_chain",
    """
    WITH clean AS (SELECT trim(lower(c_mktsegment)) AS segment, c_custkey FROM customer WHERE c_mktsegment IS NOT NULL),
    spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    joined AS (SELECT segment, total FROM clean JOIN spend ON o_custkey = c_custkey)
    SELECT segment, count(*) AS customers, sum(total) AS revenue FROM joined GROUP BY 1
    """,
    digits="revenue:1",
)
def cte_chain(t):
    clean = t.customer.where("c_mktsegment IS NOT NULL").select(
        F.trim(F.lower("c_mktsegment")).alias("segment"), "c_custkey"
    )
    spend = t.orders.where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    joined = clean.join(spend, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.sum("total").alias("revenue"))


@query(
    "broadcast_join",
    "SELECT p_brand, sum(l_quantity) AS qty FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    digits="qty",
)
def broadcast_join(t):
    """The brand side is hinted only after its size is checked."""
    side = R.lookup_side(t.part.select("p_partkey", "p_brand"))
    joined = t.lineitem.join(side, F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy("p_brand").agg(F.sum("l_quantity").alias("qty"))


@query(
    "sort_merge_prepartition",
    "SELECT o_orderpriority, count(*) AS lines, sum(l_extendedprice) AS amount FROM lineitem JOIN orders "
    "ON l_orderkey = o_orderkey GROUP BY 1",
    digits="amount:1",
)
def sort_merge_prepartition(t):
    left = t.lineitem.select("l_orderkey", "l_extendedprice").repartition("l_orderkey")
    right = t.orders.select("o_orderkey", "o_orderpriority").repartition("o_orderkey").hint("merge")
    joined = left.join(right, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("amount")
    )


@query(
    "star_join",
    """
    SELECT n_name, c_mktsegment, p_brand, count(*) AS lines,
           sum(l_extendedprice * (1 - coalesce(l_discount, 0))) AS net_amount
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey GROUP BY ALL
    """,
    digits="net_amount:1",
)
def star_join(t):
    net = F.col("l_extendedprice") * (1 - F.coalesce("l_discount", F.lit(0.0)))
    facts = t.lineitem.select("l_orderkey", "l_partkey", net.alias("net"))
    return (
        facts.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation.select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
        .groupBy("n_name", "c_mktsegment", "p_brand")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("net").alias("net_amount"))
    )


@query(
    "point_in_time_dim_join",
    """
    WITH v AS (
      SELECT c_custkey, c_mktsegment || '/1' AS version, TIMESTAMP '1900-01-01' AS valid_from, TIMESTAMP '1998-01-01' AS valid_to FROM customer
      UNION ALL
      SELECT c_custkey, c_mktsegment || '/2', TIMESTAMP '1998-01-01', NULL FROM customer)
    SELECT o_orderkey, version FROM orders LEFT JOIN v ON c_custkey = o_custkey AND o_orderdate >= valid_from
      AND (valid_to IS NULL OR o_orderdate < valid_to)
    """,
)
def point_in_time_dim_join(t):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    old = t.customer.select(
        "c_custkey",
        F.concat("c_mktsegment", F.lit("/1")).alias("version"),
        F.lit("1900-01-01").cast("timestamp_ntz").alias("valid_from"),
        cut.alias("valid_to"),
    )
    new = t.customer.select(
        "c_custkey",
        F.concat("c_mktsegment", F.lit("/2")).alias("version"),
        cut.alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
    )
    return R.point_in_time(
        t.orders, old.unionByName(new), ("o_custkey", "c_custkey"), "o_orderdate", "valid_from", "valid_to"
    ).select("o_orderkey", "version")


@query(
    "parent_child_orphans",
    """
    WITH child AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS parent FROM orders),
    parents AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
    SELECT o_orderkey, parent, CASE WHEN parent IS NULL THEN 'no parent' ELSE 'unknown parent' END AS reason
    FROM child WHERE NOT EXISTS (SELECT 1 FROM parents WHERE c_custkey = parent)
    """,
)
def parent_child_orphans(t):
    child = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("parent"))
    return R.orphans(child, t.customer.where("c_mktsegment <> 'BUILDING'"), "parent", "c_custkey")


@query(
    "coverage_gaps",
    """
    WITH n AS (SELECT c_custkey, count(o_orderkey) AS supporting FROM customer
      LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1)
    SELECT c_custkey, supporting, CASE WHEN supporting = 0 THEN 'gap' ELSE 'over_indexed' END AS kind
    FROM n WHERE supporting = 0 OR supporting >= 4
    """,
)
def coverage_gaps(t):
    big = t.orders.where("o_totalprice > 400000")
    return R.coverage_gaps(t.customer, big, "c_custkey", "o_custkey").select("c_custkey", "supporting", "kind")


@query(
    "conflict_pairs",
    """
    WITH raw AS (SELECT p_partkey AS x, unnest([p_partkey // 2, p_partkey * 2, p_partkey + 1]) AS y FROM part),
    pairs AS (SELECT DISTINCT least(x, y) AS item_a, greatest(x, y) AS item_b FROM raw WHERE x <> y)
    SELECT item_a, item_b, a.p_brand AS label_a, b.p_brand AS label_b FROM pairs
    JOIN part a ON a.p_partkey = item_a JOIN part b ON b.p_partkey = item_b
    """,
)
def conflict_pairs(t):
    k = F.col("p_partkey")
    items = t.part.select("p_partkey", "p_brand", F.array(F.expr("p_partkey div 2"), k * 2, k + 1).alias("conflicts"))
    return R.conflict_pairs(items, "p_partkey", "conflicts", "p_brand")


@query(
    "band_lookup_join",
    """
    WITH b AS (SELECT n_regionkey % 3 AS level, n_nationkey % 2 AS function, n_nationkey AS zone, n_nationkey AS band_id,
               1000.0 * (n_nationkey + 1) AS band_mid FROM nation WHERE n_nationkey % 3 <> 0),
    e AS (SELECT c_custkey, c_custkey % 4 AS level, c_custkey % 3 AS function, c_nationkey AS zone FROM customer),
    b1 AS (SELECT level, function, zone, arg_min(band_mid, band_id) AS m FROM b GROUP BY ALL),
    b2 AS (SELECT level, function, arg_min(band_mid, band_id) AS m FROM b GROUP BY ALL),
    b3 AS (SELECT level, arg_min(band_mid, band_id) AS m FROM b GROUP BY ALL)
    SELECT c_custkey, coalesce(b1.m, b2.m, b3.m) AS band_mid,
      CASE WHEN b1.m IS NOT NULL THEN 0 WHEN b2.m IS NOT NULL THEN 1 WHEN b3.m IS NOT NULL THEN 2 END AS match_level
    FROM e LEFT JOIN b1 USING (level, function, zone) LEFT JOIN b2 USING (level, function) LEFT JOIN b3 USING (level)
    """,
    digits="band_mid",
)
def band_lookup_join(t):
    bands = t.nation.where("n_nationkey % 3 <> 0").select(
        (F.col("n_regionkey") % 3).cast("long").alias("level"),
        (F.col("n_nationkey") % 2).cast("long").alias("function"),
        F.col("n_nationkey").alias("zone"),
        F.col("n_nationkey").alias("band_id"),
        (1000.0 * (F.col("n_nationkey") + 1)).alias("band_mid"),
    )
    people = t.customer.select(
        "c_custkey",
        (F.col("c_custkey") % 4).alias("level"),
        (F.col("c_custkey") % 3).alias("function"),
        F.col("c_nationkey").alias("zone"),
    )
    keys = [["level", "function", "zone"], ["level", "function"], ["level"]]
    return R.band_lookup(people, bands, keys, ["band_mid"]).select("c_custkey", "band_mid", "match_level")


@query(
    "batch_update_values",
    "SELECT p_partkey, CASE WHEN p_size > 45 THEN 29.99 ELSE p_retailprice END AS p_retailprice FROM part",
)
def batch_update_values(t):
    new = t.part.where("p_size > 45").select("p_partkey", F.lit(29.99).alias("p_retailprice"))
    return R.update_from_values(t.part, new, "p_partkey", "p_retailprice").select("p_partkey", "p_retailprice")


@query(
    "delete_by_subquery",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def delete_by_subquery(t):
    return R.delete_where_in(t.orders, t.customer.where("c_acctbal < 0"), "o_custkey", "c_custkey").select(
        "o_orderkey", "o_custkey"
    )


@query(
    "insert_if_absent",
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL "
    "SELECT c_custkey, c_name || '*' FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'",
)
def insert_if_absent(t):
    target = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    source = t.customer.where("c_acctbal > 5000").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"))
    return R.insert_if_absent(target, source, "c_custkey")


@query(
    "sort_mixed",
    """
    SELECT p_partkey, v FROM (
      SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_size::VARCHAR END AS v FROM part)
    ORDER BY try_cast(v AS DOUBLE) NULLS FIRST, lower(coalesce(v, '')), p_partkey
    """,
)
def sort_mixed(t):
    v = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(
        F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")
    )
    return R.sort_mixed(t.part.select("p_partkey", v.alias("v")), "v", ties=["p_partkey"])


@query("limit_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def limit_offset(t):
    return t.part.select("p_partkey", "p_name").orderBy("p_partkey").offset(40).limit(20)


@query("keyset_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 20")
def keyset_page(t):
    return R.keyset_after(t.orders.select("o_orderkey"), [("o_orderkey", 100)], 20)


@query(
    "keyset_composite",
    "SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-06-01', 700) "
    "ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
)
def keyset_composite(t):
    import datetime

    last = [("o_orderdate", datetime.datetime(1998, 6, 1)), ("o_orderkey", 700)]
    rows = t.orders.select("o_orderdate", "o_orderkey")
    rows = rows.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    page = R.keyset_after(rows, [("o_orderdate", F.lit(last[0][1]).cast(T.TimestampNTZType())), last[1]], 20, descending=True)
    return page


@query(
    "topk_global",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def topk_global(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "topk_per_group",
    "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority "
    "ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5",
)
def topk_per_group(t):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return R.top_n(t.orders, ["o_orderpriority"], order, 5).select("o_orderpriority", "o_orderkey", "o_totalprice")


@query(
    "severity_order",
    """
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END,
             o_totalprice DESC, o_orderkey
    """,
)
def severity_order(t):
    rank = R.severity_rank("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return t.orders.orderBy(rank, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice")
