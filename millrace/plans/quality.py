"""Data quality on the test tables. Orders are read as text with injected null words."""

from pyspark.sql import functions as F

from millrace.operators import quality as Q
from millrace.operators import relational as R
from millrace.plans.registry import query

COLS = ["cust", "status", "price", "prio", "odate"]


def dirty(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey",
        F.when(c % 17 == 0, "N/A").otherwise(c.cast("string")).alias("cust"),
        F.when((c % 17 == 0) | (k % 101 == 0), "").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 31 != 0, F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("price"),
        F.when((k < 600) & (k % 2 == 0), "nil").otherwise(F.col("o_orderpriority")).alias("prio"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("odate"),
    )


DIRTY = """
    dirty AS (SELECT o_orderkey, CASE WHEN o_custkey % 17 = 0 THEN 'N/A' ELSE o_custkey::VARCHAR END AS cust,
      CASE WHEN o_custkey % 17 = 0 OR o_orderkey % 101 = 0 THEN '' ELSE o_orderstatus END AS status,
      CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice::DECIMAL(12, 2)::VARCHAR END AS price,
      CASE WHEN o_orderkey < 600 AND o_orderkey % 2 = 0 THEN 'nil' ELSE o_orderpriority END AS prio, strftime(o_orderdate, '%Y-%m-%d') AS odate FROM orders),
    long AS (SELECT unnest(['cust', 'status', 'price', 'prio', 'odate']) AS "column", unnest([cust, status, price, prio, odate]) AS value FROM dirty)
"""
NULL7 = "(value IS NULL OR lower(trim(value)) IN ('', 'null', 'none', 'n/a', 'na', 'nan', 'nil'))"
INT = "regexp_full_match(trim(value), '[+-]?[0-9]+')"
FLT = "regexp_full_match(trim(value), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
TYPES = f"""
    ty AS (SELECT "column", count(*) FILTER (WHERE NOT {NULL7} AND {INT}) AS n_int, count(*) FILTER (WHERE NOT {NULL7} AND {FLT} AND NOT {INT}) AS n_float,
      count(*) FILTER (WHERE NOT {NULL7} AND lower(trim(value)) IN ('true', 'false')) AS n_bool,
      count(*) FILTER (WHERE NOT {NULL7} AND NOT {FLT} AND lower(trim(value)) NOT IN ('true', 'false')) AS n_string FROM long GROUP BY 1),
    types AS (SELECT *, CASE greatest(n_int, n_float, n_bool, n_string) WHEN n_int THEN 'int' WHEN n_float THEN 'float' WHEN n_bool THEN 'bool' ELSE 'string' END AS inferred_type FROM ty)
"""
PROFILE = f"""
    prof AS (SELECT "column", inferred_type, count(*) AS total_rows, count(*) FILTER (WHERE {NULL7}) AS null_count, count(DISTINCT value) FILTER (WHERE NOT {NULL7}) AS unique_count,
      CASE WHEN inferred_type IN ('int', 'float') THEN min(try_cast(value AS DOUBLE)) END AS min, CASE WHEN inferred_type IN ('int', 'float') THEN max(try_cast(value AS DOUBLE)) END AS max,
      CASE WHEN inferred_type IN ('int', 'float') THEN avg(try_cast(value AS DOUBLE)) END AS mean, CASE WHEN inferred_type IN ('int', 'float') THEN stddev_samp(try_cast(value AS DOUBLE)) END AS std
      FROM long JOIN types USING ("column") GROUP BY "column", inferred_type),
    profile AS (SELECT "column", total_rows, null_count, null_count / total_rows * 100 AS null_pct, unique_count, unique_count * 100 / (total_rows - null_count) AS cardinality_pct, inferred_type,
      unique_count = 1 AS is_constant, total_rows - null_count > 10 AND unique_count > (total_rows - null_count) * 0.9 AS is_high_cardinality, min, max, mean, std FROM prof)
"""
W = f"WITH {DIRTY}, {TYPES}, {PROFILE}"


@query("infer_column_type", f'WITH {DIRTY}, {TYPES} SELECT "column", n_int, n_float, n_bool, n_string, inferred_type FROM types')
def infer_column_type(t):
    return Q.infer_types(dirty(t), COLS)


def _sem_sql():
    full = {k: p.replace("^", "", 1) for k, p in Q.SEMANTIC_PATTERNS.items()}
    counts = ", ".join(f"count(*) FILTER (WHERE trim(value) <> '' AND regexp_matches(trim(value), '(?i)^{p}')) AS {k}" for k, p in full.items())
    tests = " ".join(f"WHEN {k} > n * 0.9 THEN '{k}'" for k in [*Q.SEMANTIC_PATTERNS, "boolean", "integer", "float"])
    pats = " ".join(f"WHEN n >= 10 AND {k} > n * 0.8 THEN '{k}'" for k in Q.SEMANTIC_PATTERNS)
    return f"""
      sem AS (SELECT "column", count(*) FILTER (WHERE trim(value) <> '') AS n, {counts},
        count(*) FILTER (WHERE lower(trim(value)) IN ('true', 'false', 'yes', 'no', '1', '0')) AS boolean,
        count(*) FILTER (WHERE {INT}) AS integer, count(*) FILTER (WHERE {FLT}) AS float FROM long GROUP BY 1),
      semantic AS (SELECT "column", n, CASE {tests} ELSE 'string' END AS semantic_type, CASE {pats} END AS pattern FROM sem)
    """


SEM = _sem_sql()


@query("detect_semantic_type", f"WITH {DIRTY}, {SEM} SELECT * FROM semantic")
def detect_semantic_type(t):
    return Q.semantic_types(dirty(t), COLS)


@query("profile_columns", f"{W} SELECT * FROM profile", digits="null_pct cardinality_pct min max mean std")
def profile_columns(t):
    return Q.profile_columns(dirty(t), COLS)


EXT = f"""
    v AS (SELECT "column", value, CASE WHEN {FLT} THEN try_cast(value AS DOUBLE) END AS x FROM long WHERE value IS NOT NULL AND value <> ''),
    r AS (SELECT "column", x, row_number() OVER (PARTITION BY "column" ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY "column") AS n FROM v WHERE x IS NOT NULL),
    qi AS (SELECT "column", median(x) AS median, max(CASE WHEN i = n // 4 THEN x END) AS p25, max(CASE WHEN i = 3 * n // 4 THEN x END) AS p75 FROM r GROUP BY 1),
    le AS (SELECT "column", min(length(value)) AS min_length, max(length(value)) AS max_length, avg(length(value)) AS avg_length FROM v GROUP BY 1),
    ext AS (SELECT "column", semantic_type, CASE WHEN semantic_type IN ('integer', 'float') THEN median END AS median, CASE WHEN semantic_type IN ('integer', 'float') THEN p25 END AS p25,
      CASE WHEN semantic_type IN ('integer', 'float') THEN p75 END AS p75, CASE WHEN semantic_type = 'string' THEN min_length END AS min_length,
      CASE WHEN semantic_type = 'string' THEN max_length END AS max_length, CASE WHEN semantic_type = 'string' THEN avg_length END AS avg_length
      FROM semantic LEFT JOIN le USING ("column") LEFT JOIN qi USING ("column"))
"""


@query("profile_columns_ext", f"WITH {DIRTY}, {SEM}, {EXT} SELECT * FROM ext", digits="median p25 p75 avg_length")
def profile_columns_ext(t):
    return Q.profile_extended(dirty(t), COLS)


FIVE = """
    five AS (SELECT greatest(0, 100 - avg(null_pct)) AS completeness, greatest(0, 100 - avg(is_constant::INT) * 100) AS consistency,
      greatest(0, 100 - avg((is_high_cardinality AND inferred_type = 'string')::INT) * 60) AS validity, 90.0 AS uniqueness, 85.0 AS timeliness FROM profile)
"""


@query(
    "dq_score_5dim",
    f"{W}, {FIVE} SELECT *, completeness * 0.3 + consistency * 0.25 + validity * 0.2 + uniqueness * 0.15 + timeliness * 0.1 AS score FROM five",
    digits="completeness consistency validity uniqueness timeliness score",
)
def dq_score_5dim(t):
    return Q.score_five(Q.profile_columns(dirty(t), COLS))


RULES = [
    Q.ColumnRule("cust", "integer", nullable=False),
    Q.ColumnRule("status", nullable=False, allowed=("F", "O")),
    Q.ColumnRule("price", "float", min_value=5000, max_value=450000),
    Q.ColumnRule("prio", min_length=4, max_length=10, pattern=r"^[0-9]-"),
    Q.ColumnRule("odate", "date", unique=True),
    Q.ColumnRule("missing_one"),
]
CHECKS = """
    agg AS (SELECT count(*) FILTER (WHERE cust IS NULL OR cust = '') AS c0, count(*) FILTER (WHERE cust <> '' AND NOT regexp_full_match(cust, '[+-]?[0-9]+')) AS c1,
      count(*) FILTER (WHERE status IS NULL OR status = '') AS c2, count(*) FILTER (WHERE status <> '' AND status NOT IN ('F', 'O')) AS c3,
      count(*) FILTER (WHERE price <> '' AND try_cast(price AS DOUBLE) IS NULL) AS c4, count(*) FILTER (WHERE try_cast(price AS DOUBLE) < 5000 OR try_cast(price AS DOUBLE) > 450000) AS c5,
      count(*) FILTER (WHERE prio <> '' AND (length(prio) < 4 OR length(prio) > 10)) AS c6, count(*) FILTER (WHERE prio <> '' AND NOT regexp_matches(prio, '^[0-9]-')) AS c7,
      count(*) FILTER (WHERE odate <> '' AND NOT regexp_full_match(odate, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS c8, count(odate) - count(DISTINCT odate) AS c9, count(*) AS n FROM dirty),
    res AS (SELECT unnest([{'check': 'not_null', 'column': 'cust', 'severity': 'error', 'failed': c0}, {'check': 'data_type', 'column': 'cust', 'severity': 'error', 'failed': c1},
      {'check': 'not_null', 'column': 'status', 'severity': 'error', 'failed': c2}, {'check': 'allowed_values', 'column': 'status', 'severity': 'error', 'failed': c3},
      {'check': 'data_type', 'column': 'price', 'severity': 'error', 'failed': c4}, {'check': 'value_range', 'column': 'price', 'severity': 'error', 'failed': c5},
      {'check': 'string_length', 'column': 'prio', 'severity': 'warning', 'failed': c6}, {'check': 'pattern_match', 'column': 'prio', 'severity': 'error', 'failed': c7},
      {'check': 'data_type', 'column': 'odate', 'severity': 'error', 'failed': c8}, {'check': 'unique', 'column': 'odate', 'severity': 'error', 'failed': c9},
      {'check': 'row_count_min', 'column': NULL, 'severity': 'error', 'failed': (n < 100)::BIGINT}, {'check': 'row_count_max', 'column': NULL, 'severity': 'warning', 'failed': (n > 1000)::BIGINT},
      {'check': 'column_exists', 'column': 'missing_one', 'severity': 'error', 'failed': 1}], recursive := true) FROM agg),
    checks AS (SELECT *, failed = 0 AS passed FROM res)
"""


def checks(t):
    return Q.validate(dirty(t), RULES, min_rows=100, max_rows=1000)


@query("validate_schema", f"WITH {DIRTY}, {CHECKS} SELECT * FROM checks")
def validate_schema(t):
    return checks(t)


@query(
    "validate_schema_failed_rows",
    f"""WITH {DIRTY}, b AS (SELECT o_orderkey, concat_ws(',', CASE WHEN cust = '' THEN 'not_null:cust' END, CASE WHEN cust <> '' AND NOT regexp_full_match(cust, '[+-]?[0-9]+') THEN 'data_type:cust' END,
      CASE WHEN status = '' THEN 'not_null:status' END, CASE WHEN status <> '' AND status NOT IN ('F', 'O') THEN 'allowed_values:status' END,
      CASE WHEN try_cast(price AS DOUBLE) < 5000 OR try_cast(price AS DOUBLE) > 450000 THEN 'value_range:price' END,
      CASE WHEN length(prio) < 4 OR length(prio) > 10 THEN 'string_length:prio' END, CASE WHEN NOT regexp_matches(prio, '^[0-9]-') THEN 'pattern_match:prio' END) AS broken FROM dirty)
    SELECT * FROM b WHERE broken <> ''""",
)
def validate_schema_failed_rows(t):
    return Q.failed_rows(dirty(t), RULES, ["o_orderkey"])


@query(
    "dq_score_validated",
    f"""{W}, {SEM}, {CHECKS}, p AS (SELECT 100 - avg(null_pct) AS completeness, coalesce(avg(cardinality_pct) FILTER (WHERE cardinality_pct > 90), 100) AS uniqueness FROM profile),
    a AS (SELECT least(100, 50 + avg((pattern IS NOT NULL)::INT) * 50) AS accuracy FROM semantic),
    v AS (SELECT avg(passed::INT) * 100 AS validity, (1 - avg((NOT passed AND severity = 'error')::INT)) * 100 AS consistency FROM checks)
    SELECT *, completeness * 0.25 + uniqueness * 0.15 + validity * 0.3 + consistency * 0.2 + accuracy * 0.1 AS overall FROM p, a, v""",
    digits="completeness uniqueness accuracy validity consistency overall",
)
def dq_score_validated(t):
    d = dirty(t)
    return Q.score_validated(Q.profile_columns(d, COLS), Q.semantic_types(d, COLS), checks(t))


NULL9 = "lower(trim(coalesce({c}, ''))) IN ('', 'null', 'none', 'n/a', 'na', 'nan', 'nil', 'undefined', 'missing')"


@query(
    "null_token_mask",
    f"WITH {DIRTY} SELECT o_orderkey, " + ", ".join(f"{NULL9.format(c=c)} AS {c}" for c in COLS) + " FROM dirty",
)
def null_token_mask(t):
    return dirty(t).select("o_orderkey", *[Q.null_word(c).alias(c) for c in COLS])


MASK = "m AS (SELECT o_orderkey, " + ", ".join(f"{NULL9.format(c=c)} AS {c}" for c in COLS) + " FROM dirty)"


def _pairs_sql():
    parts = []
    for i, a in enumerate(COLS):
        for b in COLS[i + 1 :]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) FILTER (WHERE {a} AND {b}) AS co_null_rows, count(*) FILTER (WHERE {a} OR {b}) AS either FROM m")
    return "pairs AS (" + " UNION ALL ".join(parts) + ")"


@query(
    "null_cooccurrence",
    f"WITH {DIRTY}, {MASK}, {_pairs_sql()} SELECT col_a, col_b, co_null_rows FROM pairs WHERE co_null_rows > 0 ORDER BY co_null_rows DESC, col_a, col_b LIMIT 5",
)
def null_cooccurrence(t):
    return Q.null_cooccurrence(dirty(t), COLS)


@query(
    "missing_mechanism",
    f"""WITH {DIRTY}, {MASK}, {_pairs_sql()},
    pos AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM m),
    s AS ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c}) AS nulls, max(i) FILTER (WHERE {c}) - min(i) FILTER (WHERE {c}) AS span, max(n) AS n FROM pos" for c in COLS)}),
    o AS (SELECT col_a AS "column", col_b AS other FROM pairs WHERE either > 0 AND co_null_rows / either > 0.5 UNION ALL SELECT col_b, col_a FROM pairs WHERE either > 0 AND co_null_rows / either > 0.5),
    l AS (SELECT "column", string_agg(other, ', ' ORDER BY list_position({COLS}, other)) AS with_columns FROM o GROUP BY 1)
    SELECT "column", nulls, CASE WHEN nulls = 0 THEN 'None' WHEN n < 10 THEN 'Insufficient data' WHEN with_columns IS NOT NULL THEN 'MAR (likely)'
      WHEN nulls > 2 AND span / (nulls - 1) < n / nulls * 0.5 THEN 'MNAR (possible)' ELSE 'MCAR (likely)' END AS mechanism, with_columns FROM s LEFT JOIN l USING ("column")""",
)
def missing_mechanism(t):
    return Q.missing_mechanism(dirty(t), COLS, "o_orderkey")


@query(
    "impute_strategy",
    f"""{W} SELECT "column", null_pct, CASE WHEN null_pct = 0 THEN 'no action' WHEN null_pct < 1 THEN 'drop rows' WHEN null_pct < 10 THEN
      CASE WHEN inferred_type IN ('int', 'float') THEN 'median + indicator' WHEN inferred_type = 'string' THEN 'mode or Unknown + indicator' WHEN inferred_type = 'bool' THEN 'mode' END
      WHEN null_pct < 30 THEN 'impute cautiously + indicator' ELSE 'do not impute' END AS advice FROM profile""",
    digits="null_pct",
)
def impute_strategy(t):
    p = Q.profile_columns(dirty(t), COLS)
    return p.select("column", "null_pct", Q.impute_strategy(F.col("null_pct"), F.col("inferred_type")).alias("advice"))


@query(
    "outlier_iqr",
    """
    WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q),
    o AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value < lower OR value > upper) AS outlier_count, max(q1) AS q1, max(q3) AS q3, max(lower) AS lower, max(upper) AS upper
      FROM events JOIN f USING (event_type) GROUP BY 1)
    SELECT *, outlier_count / n * 100 AS outlier_pct FROM o
    """,
    digits="q1 q3 lower upper outlier_pct",
)
def outlier_iqr(t):
    return Q.outlier_iqr(t.events, ["event_type"], "value")


@query(
    "outlier_zscore",
    """
    WITH s AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std FROM events GROUP BY 1),
    o AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE abs(value - mean) > 3 * std) AS outlier_count, max(mean) AS mean, max(std) AS std FROM events JOIN s USING (event_type) GROUP BY 1)
    SELECT *, outlier_count / n * 100 AS outlier_pct FROM o
    """,
    digits="mean std outlier_pct",
)
def outlier_zscore(t):
    return Q.outlier_zscore(t.events, ["event_type"], "value")


@query(
    "outlier_mad",
    """
    WITH s AS (SELECT event_type, median(value) AS median, mad(value) AS mad FROM events GROUP BY 1),
    o AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE 0.6745 * abs(value - median) / mad > 3.5) AS outlier_count, max(median) AS median, max(mad) AS mad FROM events JOIN s USING (event_type) GROUP BY 1)
    SELECT *, outlier_count / n * 100 AS outlier_pct FROM o
    """,
    digits="median mad outlier_pct",
)
def outlier_mad(t):
    return Q.outlier_mad(t.events, ["event_type"], "value")


@query(
    "outlier_quartile_index",
    """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    q AS (SELECT event_type, max(CASE WHEN i = n // 4 THEN value END) AS q1, max(CASE WHEN i = 3 * n // 4 THEN value END) AS q3 FROM r GROUP BY 1),
    f AS (SELECT event_type, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q),
    o AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value < lower OR value > upper) AS outlier_count, max(lower) AS lower, max(upper) AS upper FROM events JOIN f USING (event_type) GROUP BY 1)
    SELECT *, outlier_count / n * 100 AS outlier_pct FROM o
    """,
    digits="lower upper outlier_pct",
)
def outlier_quartile_index(t):
    return Q.anomalies_by_index(t.events, ["event_type"], "value")


@query("validate_primary_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def validate_primary_key(t):
    return Q.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "row_count_bounds",
    "SELECT count(*) AS rows, count(*) >= 100 AS min_ok, count(*) <= 10000 AS max_ok FROM orders",
)
def row_count_bounds(t):
    n = F.count(F.lit(1))
    return t.orders.agg(n.alias("rows"), (n >= 100).alias("min_ok"), (n <= 10000).alias("max_ok"))


@query(
    "validate_contract",
    f"""WITH {DIRTY}, {SEM}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE status IS NULL OR status = '') AS s FROM dirty),
    c AS (SELECT 'contract_data_type' AS "check", "column", 'error' AS severity, CASE "column" WHEN 'cust' THEN semantic_type NOT IN ('integer', 'float') WHEN 'price' THEN semantic_type NOT IN ('integer', 'float')
      WHEN 'odate' THEN semantic_type <> 'date_iso' ELSE semantic_type <> 'string' END::BIGINT AS failed FROM semantic WHERE "column" <> 'prio'
      UNION ALL SELECT 'not_null', 'status', 'error', s FROM n UNION ALL SELECT 'row_count_min', NULL, 'error', (n < 100000)::BIGINT FROM n UNION ALL SELECT 'column_exists', 'gone', 'error', 1)
    SELECT *, failed = 0 AS passed FROM c""",
)
def validate_contract(t):
    contract = {"cust": ("int", True), "status": ("varchar", False), "price": ("decimal", True), "odate": ("date", True), "gone": ("string", True)}
    return Q.contract_checks(dirty(t), contract, min_rows=100000)


@query(
    "expectation_suite",
    f"""{W}, {SEM}, {EXT}, j AS (SELECT * FROM profile JOIN ext USING ("column")),
    e AS (SELECT "column", 'exists' AS expectation, NULL AS low, NULL AS high FROM j
      UNION ALL SELECT "column", 'not_null', CASE WHEN null_pct < 1 THEN 1 ELSE 1 - null_pct / 100 * 1.5 END, NULL FROM j WHERE null_pct < 50
      UNION ALL SELECT "column", 'unique', NULL, NULL FROM j WHERE cardinality_pct > 99
      UNION ALL SELECT "column", 'type', NULL, NULL FROM j WHERE semantic_type IN ('integer', 'float')
      UNION ALL SELECT "column", 'between', min, max FROM j WHERE semantic_type IN ('integer', 'float') AND min IS NOT NULL
      UNION ALL SELECT "column", 'date_format', NULL, NULL FROM j WHERE semantic_type = 'date_iso'
      UNION ALL SELECT "column", 'length', greatest(1, min_length), max_length * 2 FROM j WHERE min_length IS NOT NULL) SELECT * FROM e""",
    digits="low high",
)
def expectation_suite(t):
    d = dirty(t)
    return Q.expectations(Q.profile_columns(d, COLS), Q.profile_extended(d, COLS))


@query(
    "check_not_null_rate",
    f"WITH {DIRTY} SELECT avg((price IS NULL)::INT) AS null_rate, avg((price IS NULL)::INT) <= 0.05 AS passed FROM dirty",
    digits="null_rate:6",
)
def check_not_null_rate(t):
    rate = F.avg(F.col("price").isNull().cast("int"))
    return dirty(t).agg(rate.alias("null_rate"), (rate <= 0.05).alias("passed"))


@query(
    "check_unique_rate",
    "SELECT count(*) AS total, count(DISTINCT o_custkey) AS distinct_count, 1 - count(DISTINCT o_custkey) / count(*) AS duplicate_rate, count(*) = count(DISTINCT o_custkey) AS passed FROM orders",
    digits="duplicate_rate:6",
)
def check_unique_rate(t):
    n, d = F.count(F.lit(1)), F.countDistinct("o_custkey")
    return t.orders.agg(n.alias("total"), d.alias("distinct_count"), (1 - d / n).alias("duplicate_rate"), (n == d).alias("passed"))


@query(
    "check_freshness",
    "SELECT date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 3600000000.0 AS hours_old, max(ts) >= TIMESTAMP '2024-01-31' AS passed FROM events",
    digits="hours_old:6",
)
def check_freshness(t):
    from millrace.operators.windows import minutes_between

    hours = minutes_between(F.max("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")) / 60
    return t.events.agg(hours.alias("hours_old"), (hours <= 24).alias("passed"))


@query(
    "check_range",
    "SELECT count(*) FILTER (WHERE l_discount < 0.01 OR l_discount > 0.09) AS violations, count(*) FILTER (WHERE l_returnflag = 'R' AND (l_quantity < 5 OR l_quantity > 45)) AS conditional_violations FROM lineitem",
)
def check_range(t):
    d, q = F.col("l_discount"), F.col("l_quantity")
    return t.lineitem.agg(
        F.count_if((d < 0.01) | (d > 0.09)).alias("violations"),
        F.count_if((F.col("l_returnflag") == "R") & ((q < 5) | (q > 45))).alias("conditional_violations"),
    )


@query(
    "check_referential",
    "SELECT count(*) AS orphan_count FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 1000)",
)
def check_referential(t):
    lost = R.orphans(t.orders.where("o_custkey IS NOT NULL"), t.customer.where("c_acctbal > 1000"), "o_custkey", "c_custkey")
    return lost.agg(F.count(F.lit(1)).alias("orphan_count"))


@query(
    "check_recency_expr",
    "SELECT count(*) FILTER (WHERE NOT (l_extendedprice >= l_quantity * 900)) AS broken, count(*) = (SELECT count(*) FROM orders) * 4 AS equal_counts FROM lineitem",
)
def check_recency_expr(t):
    n = t.orders.agg((F.count(F.lit(1)) * 4).alias("want"))
    a = t.lineitem.agg(F.count_if(~(F.col("l_extendedprice") >= F.col("l_quantity") * 900)).alias("broken"), F.count(F.lit(1)).alias("have"))
    return a.crossJoin(n).select("broken", (F.col("have") == F.col("want")).alias("equal_counts"))


@query(
    "monitor_thresholds",
    f'{W} SELECT "column", CASE WHEN null_pct > 0 THEN least(null_pct * 1.5, 100) END AS max_null_pct, mean - 2 * std AS mean_low, mean + 2 * std AS mean_high FROM profile',
    digits="max_null_pct mean_low mean_high",
)
def monitor_thresholds(t):
    return Q.monitor_thresholds(Q.profile_columns(dirty(t), COLS))


@query(
    "partition_advice",
    f"""{W}, a AS (SELECT "column", CASE WHEN "column" = 'odate' THEN 'range' WHEN unique_count <= 100 THEN 'list' WHEN unique_count <= 10000 THEN 'hash' END AS kind, unique_count FROM profile WHERE null_pct <= 20)
    SELECT "column", kind, CASE kind WHEN 'range' THEN 365 WHEN 'list' THEN unique_count ELSE 1024 END AS partitions,
      137438953472 / CASE kind WHEN 'range' THEN 365 WHEN 'list' THEN unique_count ELSE 1024 END / 1048576 AS partition_mb FROM a WHERE kind IS NOT NULL""",
    digits="partitions partition_mb",
)
def partition_advice(t):
    return Q.partition_advice(Q.profile_columns(dirty(t), COLS), ["odate"], 128 * 1024**3)


@query(
    "ks_drift",
    """
    WITH a AS (SELECT o_totalprice AS v FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT o_totalprice AS v FROM orders WHERE year(o_orderdate) = 1999 AND o_totalprice > 20000),
    u AS (SELECT v, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM (SELECT v, 1 AS a, 0 AS b FROM a UNION ALL SELECT v, 0, 1 FROM b) GROUP BY 1),
    c AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM u),
    k AS (SELECT max(abs(ca / na - cb / nb)) AS ks, max(na)::BIGINT AS n_reference, max(nb)::BIGINT AS n_current FROM c),
    l AS (SELECT *, sqrt(n_reference::DOUBLE * n_current / (n_reference + n_current)) * ks AS l FROM k),
    p AS (SELECT ks, n_reference, n_current, least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda i: CASE WHEN i % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * i * i * l * l))))) AS p_value FROM l),
    d AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM a),
    sa AS (SELECT len(list_filter(e, lambda x: x < v)) AS bucket, count(*) / (SELECT count(*) FROM a) AS s FROM a, d GROUP BY 1),
    sb AS (SELECT len(list_filter(e, lambda x: x < v)) AS bucket, count(*) / (SELECT count(*) FROM b) AS s FROM b, d GROUP BY 1),
    ps AS (SELECT sum((greatest(coalesce(sb.s, 0), 0.0001) - greatest(coalesce(sa.s, 0), 0.0001)) * ln(greatest(coalesce(sb.s, 0), 0.0001) / greatest(coalesce(sa.s, 0), 0.0001))) AS psi
      FROM range(10) r(bucket) LEFT JOIN sa USING (bucket) LEFT JOIN sb USING (bucket))
    SELECT ks, n_reference, n_current, p_value, p_value < 0.05 AS drift, psi, psi > 0.2 AS shifted FROM p, ps
    """,
    digits="ks:6 p_value:6 psi:6",
)
def ks_drift(t):
    a = t.orders.where("year(o_orderdate) = 1996")
    b = t.orders.where("year(o_orderdate) = 1999 AND o_totalprice > 20000")
    return Q.ks_statistic(a, b, "o_totalprice").crossJoin(Q.population_shift(a, b, "o_totalprice"))
