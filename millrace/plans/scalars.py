"""Scalar functions: dates, text, JSON, nested values."""

from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import probability as P
from millrace.functions import text as X
from millrace.operators import aggregates as A
from millrace.operators import plugins as U
from millrace.plans.registry import query
from millrace.plans.sets import ALNUM


@query(
    "parse_date_multi",
    """
    WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
      WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE 'n/a' END AS d FROM orders)
    SELECT o_orderkey, strftime(coalesce(try_strptime(d, '%Y-%m-%d'), try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%Y/%m/%d')), '%Y-%m-%d') AS day FROM s
    """,
)
def parse_date_multi(t):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(d, "MM/dd/yyyy"))
        .when(k == 2, F.date_format(d, "yyyy/MM/dd"))
        .otherwise("n/a")
    )
    return t.orders.select("o_orderkey", F.to_date(D.parse_first(text)).alias("day"))


@query(
    "period_keys",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, isoyear(o_orderdate) || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') AS week,
      'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter, strftime(o_orderdate, '%U')::INT AS sunday_week FROM orders
    """,
)
def period_keys(t):
    d = "o_orderdate"
    return t.orders.select(
        "o_orderkey",
        D.month_key(d).alias("month"),
        D.iso_week_key(d).alias("week"),
        D.quarter_key(d).alias("quarter"),
        D.sunday_week(d).alias("sunday_week"),
    )


@query("days_until", "SELECT o_orderkey, greatest(date_diff('day', DATE '1998-06-01', o_orderdate), 0) AS days FROM orders")
def days_until(t):
    return t.orders.select("o_orderkey", D.days_until("o_orderdate", "1998-06-01").alias("days"))


@query(
    "age_in_months",
    "SELECT o_orderkey, (2001 - year(o_orderdate)) * 12 + 9 - month(o_orderdate) AS months FROM orders",
)
def age_in_months(t):
    return t.orders.select("o_orderkey", D.age_in_months("o_orderdate", "2001-09-15").alias("months"))


@query("hour_flag", "SELECT event_id, hour(ts) < 6 OR hour(ts) >= 22 AS off_hours FROM events")
def hour_flag(t):
    return t.events.select("event_id", D.off_hours("ts").alias("off_hours"))


@query(
    "duration_parse",
    """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN k WHEN 1 THEN k * 60 WHEN 2 THEN k * 3600 WHEN 3 THEN k * 86400 ELSE 0 END AS seconds
    FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
    """,
)
def duration_parse(t):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("s", "m", "h", "d", " weeks")]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", D.duration_seconds(F.concat(F.get_json_object("props", "$.k"), unit)).alias("seconds"))


EVAL_SQL = "'" + "', '".join(X.EVAL_STOP) + "'"
SEARCH_SQL = "'" + "', '".join(X.SEARCH_STOP) + "'"
TOPIC_SQL = "'" + "', '".join(X.TOPIC_STOP) + "'"
WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query(
    "word_tokens",
    f"""
    SELECT doc_id, len({ALNUM}) AS alnum, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-'']+'), lambda w: w NOT IN ({SEARCH_SQL}))) AS search,
      len(list_filter({WORDS}, lambda w: length(w) > 2 AND w NOT IN ({EVAL_SQL}))) AS eval,
      len(list_filter({WORDS}, lambda w: regexp_full_match(w, '[a-z]+'))) AS alpha,
      len(list_filter({WORDS}, lambda w: regexp_full_match(w, '[a-z]+') AND length(w) > 2 AND w NOT IN ({TOPIC_SQL}))) AS topic FROM documents
    """,
)
def word_tokens(t):
    return t.documents.select("doc_id", *[F.size(X.tokens("text", r)).cast("long").alias(r) for r in X.TOKEN_RULES])


@query(
    "sentence_split",
    """
    SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, E' \\t\\n\\r') <> '')) AS after_mark,
      len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: trim(s, E' \\t\\n\\r') <> '')) AS marks,
      len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]+'), lambda s: trim(s, E' \\t\\n\\r') <> '')) AS closed FROM documents
    """,
)
def sentence_split(t):
    rules = ("after_mark", "marks", "closed")
    return t.documents.select("doc_id", *[F.size(X.sentences("text", r)).cast("long").alias(r) for r in rules])


SYLL = "greatest(1, len(regexp_extract_all(CASE WHEN w LIKE '%e' AND length(w) > 2 THEN left(w, length(w) - 1) ELSE w END, '[aeiou]+')))"


@query(
    "syllable_count",
    f"""
    WITH w AS (SELECT doc_id, unnest(list_filter({WORDS}, lambda w: regexp_full_match(w, '[a-z]+'))) AS w FROM documents)
    SELECT doc_id, sum({SYLL})::BIGINT AS syllables FROM w GROUP BY 1
    """,
)
def syllable_count(t):
    words = X.tokens("text", "alpha")
    total = F.aggregate(F.transform(words, X.syllables), F.lit(0), lambda a, x: a + x)
    return t.documents.where(F.size(words) > 0).select("doc_id", total.cast("long").alias("syllables"))


STEM = (
    "CASE WHEN length(w) <= 3 THEN w "
    + " ".join(f"WHEN w LIKE '%{s}' AND length(w) >= {len(s) + 3} THEN left(w, length(w) - {len(s)})" for s in X.SUFFIXES)
    + " ELSE w END"
)


@query(
    "suffix_stem",
    f"""
    WITH w AS (SELECT DISTINCT unnest(list_filter({WORDS}, lambda w: regexp_full_match(w, '[a-z]+'))) AS w FROM documents)
    SELECT w AS word, {STEM} AS stem FROM w
    """,
)
def suffix_stem(t):
    words = t.documents.select(F.explode(F.array_distinct(X.tokens("text", "alpha"))).alias("word")).distinct()
    return words.select("word", X.stem(F.col("word")).alias("stem"))


@query(
    "ngram_2",
    f"""
    WITH w AS (SELECT doc_id, {ALNUM} AS w FROM documents),
    p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM w)
    SELECT pair, count(*) AS n FROM p GROUP BY 1
    """,
)
def ngram_2(t):
    pairs = t.documents.select(F.explode(X.bigrams(X.tokens("text", "alnum"))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query(
    "token_estimate",
    "SELECT doc_id, floor(length(text) / 3.5)::BIGINT AS tokens, floor(length(text) / 3.5) / 1000 * 0.003 AS cost FROM documents",
    digits="cost:8",
)
def token_estimate(t):
    n = X.estimated_tokens("text", 3.5)
    return t.documents.select("doc_id", n.alias("tokens"), X.estimated_cost(n, 0.003).alias("cost"))


@query(
    "url_parts",
    """
    WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
    SELECT page_id, len(parts) AS depth, '/' || array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_full_match(x, '[a-z][-a-z]+') AND length(x) < 30 THEN x ELSE '{slug}' END), '/') AS pattern,
      contains(url, '?') AS has_query, parts[1] AS top_directory FROM s
    """,
)
def url_parts(t):
    path = X.url_path("url")
    return t.pages.select(
        "page_id",
        F.size(X.path_parts(path)).cast("long").alias("depth"),
        X.path_pattern(path).alias("pattern"),
        F.col("url").contains("?").alias("has_query"),
        F.get(X.path_parts(path), 0).alias("top_directory"),
    )


def phi_sql(z: str) -> str:
    """Normal probability by Simpson's rule, for the SQL side."""
    steps = "list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(((Z) * i / 2000.0) ** 2 / 2))))"
    return "(0.5 + " + steps.replace("(Z)", f"({z})") + f" * ({z}) / 6000.0 / sqrt(2 * pi()))"


def t_sql(t: str, df: str) -> str:
    """Student t probability by Simpson's rule over the angle."""
    edge = f"atan(({t}) / sqrt({df}))"
    steps = f"list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * cos({edge} * i / 2000.0) ** (({df}) - 1)))"
    return f"(0.5 + {steps} * {edge} / 6000.0 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi()))"


@query(
    "normal_cdf_ppf",
    f"""
    WITH s AS (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part),
    z AS (SELECT p_brand, (avg(p_retailprice) - max(m)) / (max(s) / sqrt(count(*))) AS z FROM part, s GROUP BY 1)
    SELECT p_brand, z, {phi_sql('z')} AS p, z AS z_back FROM z
    """,
    digits="z:6 p:6 z_back:6",
)
def normal_cdf_ppf(t):
    """Standard scores of the mean price of every brand, their probability, and the quantile back."""
    stats = t.part.agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s"), F.count(F.lit(1)).alias("n"))
    brands = t.part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("b"), F.count(F.lit(1)).alias("k"))
    z = brands.crossJoin(F.broadcast(stats)).select("p_brand", ((F.col("b") - F.col("m")) / (F.col("s") / F.sqrt("k"))).alias("z"))
    z = z.withColumn("p", P.normal_cdf("z"))
    return z.withColumn("z_back", P.normal_ppf("p"))


@query(
    "t_chi2_cdf",
    f"""
    WITH g AS (SELECT o_orderpriority, (avg(o_totalprice) - 250000) / (stddev_samp(o_totalprice) / sqrt(count(*))) AS stat, count(*) / 100.0 AS df FROM orders GROUP BY 1)
    SELECT o_orderpriority, stat, df, {t_sql('stat', 'df')} AS t_p,
      list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 2 * (sqrt(abs(stat) * 1.5) * i / 2000.0) ** (df - 1) * exp(-(abs(stat) * 1.5 * i * i / 4000000.0))))
        * sqrt(abs(stat) * 1.5) / 6000.0 / exp(lgamma(df / 2)) AS chi2_p FROM g
    """,
    digits="stat:6 df t_p:6 chi2_p:8",
)
def t_chi2_cdf(t):
    """t and chi-square probabilities of grouped order prices."""
    g = t.orders.groupBy("o_orderpriority").agg(
        F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n")
    )
    g = g.withColumn("stat", (F.col("m") - 250000) / (F.col("s") / F.sqrt("n"))).withColumn("df", F.col("n") / 100.0)
    return g.select(
        "o_orderpriority", "stat", "df", P.t_cdf("stat", "df").alias("t_p"), P.chi2_cdf(F.abs("stat") * 3, "df").alias("chi2_p")
    )


@query(
    "effect_sizes",
    """
    WITH g AS (SELECT event_type, avg(value) FILTER (WHERE user_id % 2 = 0) AS m1, stddev_samp(value) FILTER (WHERE user_id % 2 = 0) AS s1, count(*) FILTER (WHERE user_id % 2 = 0) AS n1,
      avg(value) FILTER (WHERE user_id % 2 = 1) AS m2, stddev_samp(value) FILTER (WHERE user_id % 2 = 1) AS s2, count(*) FILTER (WHERE user_id % 2 = 1) AS n2,
      avg((value > 20)::INT) FILTER (WHERE user_id % 2 = 0) AS p1, avg((value > 20)::INT) FILTER (WHERE user_id % 2 = 1) AS p2 FROM events GROUP BY 1),
    e AS (SELECT event_type, 2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)) AS cohens_h, (m1 - m2) / sqrt(((n1 - 1) * s1 ** 2 + (n2 - 1) * s2 ** 2) / (n1 + n2 - 2)) AS cohens_d FROM g)
    SELECT *, CASE WHEN abs(cohens_d) < 0.2 THEN 'negligible' WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM e
    """,
    digits="cohens_h:6 cohens_d:6",
)
def effect_sizes(t):
    from millrace.operators import stats as ST

    a, b = F.col("user_id") % 2 == 0, F.col("user_id") % 2 == 1

    def side(test, name):
        v = F.when(test, F.col("value"))
        return [
            F.avg(v).alias(f"m{name}"),
            F.stddev_samp(v).alias(f"s{name}"),
            F.count(v).alias(f"n{name}"),
            F.avg(F.when(test, (F.col("value") > 20).cast("int"))).alias(f"p{name}"),
        ]

    g = t.events.groupBy("event_type").agg(*side(a, 1), *side(b, 2))
    d = ST.cohens_d(F.col("m1"), F.col("s1"), F.col("n1"), F.col("m2"), F.col("s2"), F.col("n2"))
    return g.select(
        "event_type", ST.cohens_h(F.col("p1"), F.col("p2")).alias("cohens_h"), d.alias("cohens_d"), ST.effect_label(d, "d").alias("label")
    )


@query(
    "jaccard",
    f"""
    WITH d AS (SELECT doc_id, list_distinct({ALNUM}) AS w FROM documents)
    SELECT a.doc_id, CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) ELSE 0 END AS similarity
    FROM d a JOIN d b ON b.doc_id = a.doc_id + 1
    """,
    digits="similarity:6",
)
def jaccard(t):
    d = t.documents.select("doc_id", F.array_distinct(X.tokens("text", "alnum")).alias("w"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(b, "doc_id").select("doc_id", X.jaccard(F.col("w"), F.col("v")).alias("similarity"))


@query("json_extract", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE event_type = 'purchase'")
def json_extract(t):
    return t.events.where("event_type = 'purchase'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "json_array_contains",
    """
    SELECT event_id FROM (SELECT event_id, '{"tags":["t' || (event_id % 7) || '","' || event_type || '"]}' AS doc FROM events)
    WHERE list_contains(from_json(doc, '{"tags":["VARCHAR"]}').tags, 't3')
    """,
)
def json_array_contains(t):
    tags = F.array(F.concat(F.lit("t"), F.col("event_id") % 7), F.col("event_type"))
    docs = t.events.select("event_id", F.to_json(F.struct(tags.alias("tags"))).alias("doc"))
    return docs.where(F.array_contains(F.from_json("doc", "tags array<string>")["tags"], "t3")).select("event_id")


@query(
    "json_set",
    "SELECT event_id, '{\"k\":' || (json_extract_string(props, '$.k')::BIGINT + 1) || ',\"price\":29.99}' AS props FROM events",
)
def json_set(t):
    doc = F.from_json("props", "k bigint")
    changed = doc.withField("k", doc["k"] + 1).withField("price", F.lit(29.99))
    return t.events.select("event_id", F.to_json(changed).alias("props"))


@query(
    "flatten",
    "SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
)
def flatten(t):
    """Orders with their lines as an array of structs, opened again row by row."""
    nested = U.nested_orders(t.orders, t.lineitem)
    return nested.select("o_orderkey", F.inline("lines")).select("o_orderkey", "l_partkey", "l_quantity")


@query(
    "flatten_nested",
    "SELECT o_custkey, o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
)
def flatten_nested(t):
    nested = U.nested_orders(t.orders, t.lineitem)
    halves = nested.select(
        "o_custkey", "o_orderkey", F.array(F.filter("lines", lambda r: r["l_partkey"] % 2 == 0), F.filter("lines", lambda r: r["l_partkey"] % 2 == 1)).alias("groups")
    )
    outer = halves.select("o_custkey", "o_orderkey", F.explode("groups").alias("g"))
    return outer.select("o_custkey", "o_orderkey", F.explode("g").alias("r")).select("o_custkey", "o_orderkey", "r.l_partkey")


@query(
    "object_construct",
    "SELECT o_orderkey, '{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\",\"customer\":' || o_custkey || '}' AS doc FROM orders",
)
def object_construct(t):
    doc = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    return t.orders.select("o_orderkey", F.to_json(doc).alias("doc"))


@query(
    "map_group_tools",
    """
    WITH x AS (SELECT event_type, value, user_id, unnest(['k' || (json_extract_string(props, '$.k')::INT % 5), event_type]) AS tool FROM events)
    SELECT tool, count(*) AS usage_count, avg((event_type = 'error')::INT) AS error_rate, avg(value) AS avg_duration, count(DISTINCT user_id) AS workflows FROM x GROUP BY 1
    """,
    digits="error_rate:6 avg_duration",
)
def map_group_tools(t):
    tools = F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 5), F.col("event_type"))
    x = t.events.select("event_type", "value", "user_id", F.explode(tools).alias("tool"))
    return x.groupBy("tool").agg(
        F.count(F.lit(1)).alias("usage_count"),
        F.avg((F.col("event_type") == "error").cast("int")).alias("error_rate"),
        F.avg("value").alias("avg_duration"),
        F.countDistinct("user_id").alias("workflows"),
    )


@query(
    "text_case_modes",
    """
    SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, reverse(p_name) AS rev,
      array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title FROM part
    """,
)
def text_case_modes(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", F.upper(n).alias("up"), F.lower(n).alias("low"), F.reverse(n).alias("rev"), F.initcap(n).alias("title"))


@query(
    "word_stats",
    """
    WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY ALL),
    b AS (SELECT doc_id, max((n, x)) AS top FROM c GROUP BY 1)
    SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS unique_words, length(text) AS chars, len(string_split(text, E'\\n')) AS lines,
      CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END AS avg_len, top[1] AS top_count, top[2] AS top_word
    FROM w LEFT JOIN b USING (doc_id)
    """,
    digits="avg_len:6",
)
def word_stats(t):
    """Ties of the most frequent word go to the last one by code point."""
    w = X.white_words(F.lower("text"))
    base = t.documents.select("doc_id", "text", w.alias("w"))
    counts = base.select("doc_id", F.explode("w").alias("x")).groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("doc_id").agg(F.max(F.struct("n", "x")).alias("top"))
    letters = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))
    return base.join(best, "doc_id", "left").select(
        "doc_id",
        F.size("w").cast("long").alias("words"),
        F.size(F.array_distinct("w")).cast("long").alias("unique_words"),
        F.length("text").alias("chars"),
        F.size(F.split("text", "\n")).cast("long").alias("lines"),
        F.when(F.size("w") > 0, letters / F.size("w")).otherwise(0.0).alias("avg_len"),
        F.col("top.n").alias("top_count"),
        F.col("top.x").alias("top_word"),
    )


@query(
    "check_plugin",
    """
    WITH f AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) AS a, count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('F', 'O', 'P'), false)) AS b, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 50000, false)) AS c FROM orders),
    r AS (SELECT 'positive_price' AS "check", 'critical' AS severity, 0.0::DOUBLE AS threshold, a AS failed, n FROM f UNION ALL SELECT 'known_status', 'warning', 0.01, b, n FROM f UNION ALL SELECT 'not_cheap', 'info', 0.1, c, n FROM f)
    SELECT "check", severity, threshold, failed, failed / n AS share, failed / n <= threshold AS passed FROM r
    """,
    digits="share:6",
)
def check_plugin(t):
    """User-supplied rules with severity and threshold, all in one scan."""
    checks = U.CheckSet()
    checks.add("positive_price", "critical", 0.0)(lambda: F.col("o_totalprice") > 0)
    checks.add("known_status", "warning", 0.01)(lambda: F.col("o_orderstatus").isin("F", "O", "P"))
    checks.add("not_cheap", "info", 0.10)(lambda: F.col("o_totalprice") > 50000)
    return checks.run(t.orders)


@query(
    "sql_macro",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 OR l_tax IS NULL THEN 0 ELSE l_discount / l_tax END AS ratio, l_extendedprice / 100.0 AS dollars FROM lineitem",
    digits="ratio dollars",
)
def sql_macro(t):
    U.register_macros(t.spark)
    t.lineitem.createOrReplaceTempView("macro_lineitem")
    return t.spark.sql(
        "SELECT l_orderkey, l_linenumber, l_partkey, macro_safe_divide(l_discount, l_tax, 0D) AS ratio, macro_cents(l_extendedprice) AS dollars FROM macro_lineitem"
    )
