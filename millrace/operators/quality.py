"""Profiles, rule checks, outliers, missing values and drift.

Every check is a column expression; all rules of a table share one aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.operators.narrowing import exact_quantiles, largest_gap
from millrace.operators.ordered import null_safe_join

# Words read as null by the profiler, and by the missing-value and outlier checks.
NULL_WORDS = ("", "null", "none", "n/a", "na", "nan", "nil")
NULL_WORDS_WIDE = NULL_WORDS + ("undefined", "missing")
# Semantic type patterns in the order they are tried.
SEMANTIC_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "phone": r"^\+?[\d\s\-\(\)]{10,}$",
    "url": r"^https?://[^\s]+$",
    "ipv4": r"^(\d{1,3}\.){3}\d{1,3}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "datetime_iso": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    "credit_card": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
}
# Type names that agree with each other in a contract.
TYPE_GROUPS = {
    "numeric": ("integer", "int", "float", "double", "decimal", "number"),
    "string": ("string", "varchar", "char", "text"),
    "boolean": ("boolean", "bool"),
    "date": ("date", "date_iso"),
    "datetime": ("datetime", "datetime_iso", "timestamp"),
}
INT_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def null_word(x, words: Sequence[str] = NULL_WORDS_WIDE) -> Column:
    c = x if isinstance(x, Column) else F.col(x)
    return c.isNull() | F.lower(F.trim(c)).isin(list(words))


def number(x) -> Column:
    """The value when the text reads as a number, else null."""
    c = F.trim(x if isinstance(x, Column) else F.col(x))
    return F.when(c.rlike(FLOAT_TEXT), c.try_cast("double"))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the listed columns as text, from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs))


def infer_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dominant type by column; ties in the order int, float, bool, string."""
    v = F.trim(F.col("value"))
    is_bool = F.lower(v).isin("true", "false")
    is_int = v.rlike(INT_TEXT)
    is_float = v.rlike(FLOAT_TEXT) & ~is_int
    rows = _long(df, columns)
    kept = ~null_word("value", NULL_WORDS)
    tests = {"int": is_int, "float": is_float, "bool": is_bool, "string": ~is_int & ~is_float & ~is_bool}
    out = rows.groupBy("column").agg(*[F.count_if(kept & test).alias(f"n_{k}") for k, test in tests.items()])
    best = F.array_max(
        F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(tests)])
    )
    return out.withColumn("inferred_type", F.when(best["n"] > 0, best["k"]).otherwise("string"))


def semantic_types(df: DataFrame, columns: Sequence[str], share: float = 0.9) -> DataFrame:
    """First pattern over the share of non-empty values, then boolean, integer, float, string."""
    v = F.trim(F.col("value"))
    filled = F.col("value").isNotNull() & (v != "")
    aggs = [F.count_if(filled).alias("n")]
    aggs += [F.count_if(filled & v.rlike("(?i)" + p)).alias(k) for k, p in SEMANTIC_PATTERNS.items()]
    aggs += [
        F.count_if(filled & F.lower(v).isin("true", "false", "yes", "no", "1", "0")).alias("boolean"),
        F.count_if(filled & v.rlike(INT_TEXT)).alias("integer"),
        F.count_if(filled & v.rlike(FLOAT_TEXT)).alias("float"),
    ]
    out = _long(df, columns).groupBy("column").agg(*aggs)
    label = None
    for k in [*SEMANTIC_PATTERNS, "boolean", "integer", "float"]:
        test = F.col(k) > F.col("n") * share
        label = F.when(test, k) if label is None else label.when(test, k)
    pattern = None
    for k in SEMANTIC_PATTERNS:
        test = (F.col("n") >= 10) & (F.col(k) > F.col("n") * 0.8)
        pattern = F.when(test, k) if pattern is None else pattern.when(test, k)
    return out.select("column", "n", label.otherwise("string").alias("semantic_type"), pattern.alias("pattern"))


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, distinct values, cardinality flags, type and numeric moments by column.

    Distinct values come from counts by (column, value): a map-side reduced table that
    no single task has to hold.
    """
    rows = _long(df, columns)
    counts = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    kept = ~null_word("value", NULL_WORDS)
    base = counts.groupBy("column").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(kept).alias("unique_count"),
    )
    x = F.when(kept, number("value"))
    moments = rows.groupBy("column").agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")
    )
    types = infer_types(df, columns).select("column", "inferred_type")
    out = base.join(types, "column").join(moments, "column")
    filled = F.col("total_rows") - F.col("null_count")
    numeric = F.col("inferred_type").isin("int", "float")
    return out.select(
        "column",
        "total_rows",
        "null_count",
        (F.col("null_count") / F.col("total_rows") * 100).alias("null_pct"),
        "unique_count",
        N.safe_divide(F.col("unique_count") * 100, filled).alias("cardinality_pct"),
        "inferred_type",
        (F.col("unique_count") == 1).alias("is_constant"),
        ((filled > 10) & (F.col("unique_count") > filled * 0.9)).alias("is_high_cardinality"),
        *[F.when(numeric, F.col(c)).alias(c) for c in ("min", "max", "mean", "std")],
    )


def profile_extended(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds median, quartiles by index and text lengths; null is None or empty here."""
    rows = _long(df, columns).where("value IS NOT NULL AND value <> ''").withColumn("x", number("value"))
    spots = exact_quantiles(rows, ["column"], "x", {"median": 0.5, "p25": (0.25, "index"), "p75": (0.75, "index")}).drop("n")
    size = F.length("value")
    lengths = rows.groupBy("column").agg(
        F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("avg_length")
    )
    types = semantic_types(df, columns)
    out = types.join(lengths, "column", "left").join(spots, "column", "left")
    numeric, text = F.col("semantic_type").isin("integer", "float"), F.col("semantic_type") == "string"
    return out.select(
        "column",
        "semantic_type",
        *[F.when(numeric, F.col(c)).alias(c) for c in ("median", "p25", "p75")],
        *[F.when(text, F.col(c)).alias(c) for c in ("min_length", "max_length", "avg_length")],
    )


def score_five(profile: DataFrame, uniqueness: float = 90.0, timeliness: float = 85.0) -> DataFrame:
    """Completeness 30, consistency 25, validity 20, uniqueness 15, timeliness 10.

    The last two are fixed unless measured values are passed in.
    """
    text_keys = F.col("is_high_cardinality") & (F.col("inferred_type") == "string")
    dims = profile.agg(
        (100 - F.avg("null_pct")).alias("completeness"),
        (100 - F.avg(F.col("is_constant").cast("int")) * 100).alias("consistency"),
        (100 - F.avg(text_keys.cast("int")) * 60).alias("validity"),
    )
    dims = dims.select(*[F.greatest(F.lit(0.0), F.col(c)).alias(c) for c in dims.columns])
    dims = dims.withColumn("uniqueness", F.lit(float(uniqueness))).withColumn("timeliness", F.lit(float(timeliness)))
    weights = {"completeness": 0.30, "consistency": 0.25, "validity": 0.20, "uniqueness": 0.15, "timeliness": 0.10}
    return dims.withColumn("score", N.weighted_score(weights, bound=False))


def score_validated(profile: DataFrame, types: DataFrame, results: DataFrame) -> DataFrame:
    """Completeness 25, uniqueness 15, validity 30, consistency 20, accuracy 10."""
    key_like = F.when(F.col("cardinality_pct") > 90, F.col("cardinality_pct"))
    p = profile.agg((100 - F.avg("null_pct")).alias("completeness"), F.coalesce(F.avg(key_like), F.lit(100.0)).alias("uniqueness"))
    a = types.agg(F.least(F.lit(100.0), 50 + F.avg(F.col("pattern").isNotNull().cast("int")) * 50).alias("accuracy"))
    errors = (~F.col("passed")) & (F.col("severity") == "error")
    r = results.agg(
        F.coalesce(F.avg(F.col("passed").cast("int")) * 100, F.lit(100.0)).alias("validity"),
        F.coalesce((1 - F.avg(errors.cast("int"))) * 100, F.lit(100.0)).alias("consistency"),
    )
    weights = {"completeness": 0.25, "uniqueness": 0.15, "validity": 0.30, "consistency": 0.20, "accuracy": 0.10}
    return p.crossJoin(a).crossJoin(r).withColumn("overall", N.weighted_score(weights, bound=False))


# ---- missing values ---------------------------------------------------------


def null_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows null together and null in either, for every column pair, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    masks = df.select(*[null_word(F.col(c).cast("string")).alias(c) for c in columns])
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [F.count_if(F.col(a) & F.col(b)).alias(f"b{i}"), F.count_if(F.col(a) | F.col(b)).alias(f"e{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"b{i}").alias("co_null_rows"), F.col(f"e{i}").alias("either"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return masks.agg(*aggs).select(F.inline(rows))


def null_cooccurrence(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    out = null_pairs(df, columns).where("co_null_rows > 0").drop("either")
    return out.orderBy(F.desc("co_null_rows"), "col_a", "col_b").limit(top)


def missing_mechanism(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """MAR, MNAR or MCAR by null overlap and by how close the nulls lie in ``order``.

    The mean gap between null positions is (last - first) / (nulls - 1), so only the first
    and last null position of a column are needed: two aggregates, no sort.
    """
    masks = df.select(F.col(order).alias("__o"), *[null_word(F.col(c).cast("string")).alias(c) for c in columns])
    ends = []
    for i, c in enumerate(columns):
        at = F.when(F.col(c), F.col("__o"))
        ends += [F.min(at).alias(f"lo{i}"), F.max(at).alias(f"hi{i}"), F.count_if(F.col(c)).alias(f"k{i}")]
    first = masks.agg(F.count(F.lit(1)).alias("rows"), *ends)
    placed = masks.crossJoin(F.broadcast(first))
    spans = placed.agg(
        F.max("rows").alias("rows"),
        *[F.max(f"k{i}").alias(f"k{i}") for i in range(len(columns))],
        *[F.count_if((F.col("__o") >= F.col(f"lo{i}")) & (F.col("__o") < F.col(f"hi{i}"))).alias(f"s{i}") for i in range(len(columns))],
    )
    rows = F.array(
        *[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(f"k{i}").alias("nulls"), F.col(f"s{i}").alias("span")) for i, c in enumerate(columns)]
    )
    base = spans.select("rows", F.inline(rows))
    pairs = null_pairs(df, columns).where("either > 0 AND co_null_rows / either > 0.5")
    both = pairs.select(F.col("col_a").alias("column"), F.col("col_b").alias("other")).unionByName(
        pairs.select(F.col("col_b").alias("column"), F.col("col_a").alias("other"))
    )
    place = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    listed = both.groupBy("column").agg(F.array_sort(F.collect_list(F.struct(place[F.col("other")].alias("i"), "other"))).alias("l"))
    names = F.array_join(F.transform(F.slice("l", 1, 3), lambda r: r["other"]), ", ")
    out = base.join(listed.select("column", names.alias("with_columns")), "column", "left")
    k, n = F.col("nulls"), F.col("rows")
    clustered = (k > 2) & (F.col("span") / (k - 1) < n / k * 0.5)
    label = (
        F.when(k == 0, "None")
        .when(n < 10, "Insufficient data")
        .when(F.col("with_columns").isNotNull(), "MAR (likely)")
        .when(clustered, "MNAR (possible)")
        .otherwise("MCAR (likely)")
    )
    return out.select("column", "nulls", label.alias("mechanism"), "with_columns")


def impute_strategy(pct: Column, kind: Column) -> Column:
    """Advice by null share and type."""
    small = (
        F.when(kind.isin("int", "float"), "median + indicator")
        .when(kind == "string", "mode or Unknown + indicator")
        .when(kind == "bool", "mode")
        .otherwise("median/mode + indicator")
    )
    return (
        F.when(pct == 0, "no action")
        .when(pct < 1, "drop rows")
        .when(pct < 10, small)
        .when(pct < 30, "impute cautiously + indicator")
        .otherwise("do not impute")
    )


# ---- outliers ---------------------------------------------------------------


def _outlier_summary(rows: DataFrame, keys: Sequence[str], is_out: Column, extra: Sequence[str]) -> DataFrame:
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_out).alias("outlier_count"), *[F.max(c).alias(c) for c in extra]
    )
    return out.where("n >= 4").withColumn("outlier_pct", F.col("outlier_count") / F.col("n") * 100)


def outlier_iqr(df: DataFrame, keys: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """Fences k x IQR outside the interpolated quartiles, by key; under 4 values a key is skipped."""
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75}).drop("n")
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("lower", F.col("q1") - k * iqr).withColumn("upper", F.col("q3") + k * iqr)
    rows = null_safe_join(df.select(*keys, value).where(F.col(value).isNotNull()), q, list(keys))
    test = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return _outlier_summary(rows, keys, test, ["q1", "q3", "lower", "upper"])


def outlier_zscore(df: DataFrame, keys: Sequence[str], value: str, limit: float = 3.0) -> DataFrame:
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    rows = null_safe_join(df.select(*keys, value).where(F.col(value).isNotNull()), s, list(keys))
    test = (F.col("std") > 0) & (F.abs(F.col(value) - F.col("mean")) > limit * F.col("std"))
    return _outlier_summary(rows, keys, test, ["mean", "std"])


def outlier_mad(df: DataFrame, keys: Sequence[str], value: str, limit: float = 3.5) -> DataFrame:
    """0.6745 x deviation / MAD over the limit; nothing is an outlier when the MAD is 0."""
    med = exact_quantiles(df, keys, value, {"median": 0.5}).drop("n")
    rows = null_safe_join(df.select(*keys, value).where(F.col(value).isNotNull()), med, list(keys))
    rows = rows.withColumn("dev", F.abs(F.col(value) - F.col("median")))
    mad = exact_quantiles(rows, keys, "dev", {"mad": 0.5}).drop("n")
    rows = null_safe_join(rows, mad, list(keys))
    test = (F.col("mad") > 0) & (0.6745 * F.col("dev") / F.col("mad") > limit)
    return _outlier_summary(rows, keys, test, ["median", "mad"])


def anomalies_by_index(df: DataFrame, keys: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """IQR fences from the quartiles taken by index."""
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75}, method="index").drop("n")
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumn("lower", F.col("q1") - k * iqr).withColumn("upper", F.col("q3") + k * iqr)
    rows = null_safe_join(df.select(*keys, value).where(F.col(value).isNotNull()), q, list(keys))
    test = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return _outlier_summary(rows, keys, test, ["lower", "upper"])


# ---- rules ------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnRule:
    """Declared properties of one text column."""

    name: str
    data_type: str = "string"
    nullable: bool = True
    unique: bool = False
    min_value: float | None = None
    max_value: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed: tuple[str, ...] = ()


def _bad_type(c: Column, kind: str) -> Column:
    if kind == "integer":
        return ~F.trim(c).rlike(INT_TEXT)
    if kind == "float":
        return ~F.trim(c).rlike(FLOAT_TEXT)
    if kind == "boolean":
        return ~F.lower(c).isin("true", "false", "yes", "no", "1", "0")
    name = {"date": "date_iso", "datetime": "datetime_iso"}.get(kind, kind)
    if name in SEMANTIC_PATTERNS:
        flag = "(?i)" if name in ("email", "uuid") else ""
        return ~c.rlike(flag + SEMANTIC_PATTERNS[name])
    return F.lit(False)


def row_rules(rules: Sequence[ColumnRule], present: Sequence[str]) -> list[tuple[str, str, str, Column]]:
    """(check, column, severity, condition of a failing row) for the rules that look at one row."""
    out = []
    for r in rules:
        if r.name not in present:
            continue
        c = F.col(r.name).cast("string")
        empty = c.isNull() | (c == "")
        if not r.nullable:
            out.append(("not_null", r.name, "error", empty))
        if r.data_type != "string":
            out.append(("data_type", r.name, "error", ~empty & _bad_type(c, r.data_type)))
        if r.min_value is not None or r.max_value is not None:
            x = number(c)
            low = (x < r.min_value) if r.min_value is not None else F.lit(False)
            high = (x > r.max_value) if r.max_value is not None else F.lit(False)
            out.append(("value_range", r.name, "error", ~empty & F.coalesce(low | high, F.lit(False))))
        if r.min_length is not None or r.max_length is not None:
            size = F.length(c)
            out.append(("string_length", r.name, "warning", ~empty & ((size < (r.min_length or 0)) | (size > (r.max_length or 2**31 - 1)))))
        if r.pattern:
            out.append(("pattern_match", r.name, "error", ~empty & ~c.rlike(r.pattern)))
        if r.allowed:
            out.append(("allowed_values", r.name, "error", ~empty & ~c.isin(list(r.allowed))))
    return out


_RESULT = "check string, column string, severity string, failed bigint"


def validate(
    df: DataFrame,
    rules: Sequence[ColumnRule],
    *,
    min_rows: int | None = None,
    max_rows: int | None = None,
    primary_key: Sequence[str] = (),
) -> DataFrame:
    """One row per check with the number of failing rows; all row rules in one aggregate."""
    checks = row_rules(rules, df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(test).alias(f"c{i}") for i, (_, _, _, test) in enumerate(checks)]
    )
    items = [
        F.struct(F.lit(k).alias("check"), F.lit(c).alias("column"), F.lit(s).alias("severity"), F.col(f"c{i}").alias("failed"))
        for i, (k, c, s, _) in enumerate(checks)
    ]
    if min_rows:
        items.append(F.struct(F.lit("row_count_min").alias("check"), F.lit(None).cast("string").alias("column"), F.lit("error").alias("severity"), F.when(F.col("rows") < min_rows, F.lit(1)).otherwise(0).cast("long").alias("failed")))
    if max_rows:
        items.append(F.struct(F.lit("row_count_max").alias("check"), F.lit(None).cast("string").alias("column"), F.lit("warning").alias("severity"), F.when(F.col("rows") > max_rows, F.lit(1)).otherwise(0).cast("long").alias("failed")))
    out = wide.select(F.inline(F.array(*items)))
    missing = [(r.name) for r in rules if r.name not in df.columns]
    if missing:
        gone = F.array(*[F.struct(F.lit("column_exists").alias("check"), F.lit(m).alias("column"), F.lit("error").alias("severity"), F.lit(1).cast("long").alias("failed")) for m in missing])
        out = out.unionByName(wide.select(F.inline(gone)))
    for r in rules:
        if r.unique and r.name in df.columns:
            c = F.col(r.name)
            counts = df.where(c.isNotNull() & (c.cast("string") != "")).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            dup = counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failed"))
            out = out.unionByName(dup.select(F.lit("unique").alias("check"), F.lit(r.name).alias("column"), F.lit("error").alias("severity"), "failed"))
    if primary_key:
        out = out.unionByName(
            duplicate_keys(df, primary_key)
            .agg(F.count(F.lit(1)).alias("failed"))
            .select(F.lit("primary_key_unique").alias("check"), F.lit(",".join(primary_key)).alias("column"), F.lit("error").alias("severity"), "failed")
        )
    return out.withColumn("passed", F.col("failed") == 0)


def failed_rows(df: DataFrame, rules: Sequence[ColumnRule], key: Sequence[str]) -> DataFrame:
    """Rows that break a row rule, with the names of the broken rules."""
    names = F.filter(
        F.array(*[F.when(test, F.lit(f"{check}:{c}")) for check, c, _, test in row_rules(rules, df.columns)]), lambda x: x.isNotNull()
    )
    return df.select(*key, F.array_join(names, ",").alias("broken")).where("broken <> ''")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def contract_checks(df: DataFrame, columns: Mapping[str, tuple[str, bool]], min_rows: int | None = None, max_rows: int | None = None) -> DataFrame:
    """Contract ``{column: (type, nullable)}`` plus row bounds: one row per check.

    The found type comes from the values of all rows, as the contract is about content.
    """
    present = [c for c in columns if c in df.columns]
    found = semantic_types(df, present).select("column", "semantic_type")
    group = {t: g for g, names in TYPE_GROUPS.items() for t in names}
    table = F.create_map(*[F.lit(x) for kv in group.items() for x in kv])
    wanted = F.create_map(*[F.lit(x) for c in present for x in (c, columns[c][0].lower())])
    w, t = wanted[F.col("column")], F.col("semantic_type")
    ok = (w == t) | F.coalesce(table[w] == table[t], F.lit(False))
    types = found.select(F.lit("contract_data_type").alias("check"), "column", F.lit("error").alias("severity"), F.when(ok, 0).otherwise(1).cast("long").alias("failed"))
    rules = [ColumnRule(c, nullable=columns[c][1]) for c in columns]
    rest = validate(df, rules, min_rows=min_rows, max_rows=max_rows).drop("passed")
    return types.unionByName(rest).withColumn("passed", F.col("failed") == 0)


def expectations(profile: DataFrame, ext: DataFrame) -> DataFrame:
    """Expectation rows derived from a profile: not null, unique, type, bounds, lengths."""
    p = profile.join(ext, "column")
    kind, nulls = F.col("semantic_type"), F.col("null_pct")
    none = F.lit(None).cast("double")

    def item(test: Column, name: str, low: Column = none, high: Column = none) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("expectation"), low.cast("double").alias("low"), high.cast("double").alias("high")))

    items = [
        item(F.lit(True), "exists"),
        item(nulls < 1, "not_null", F.lit(1.0)),
        item((nulls >= 1) & (nulls < 50), "not_null", 1 - nulls / 100 * 1.5),
        item(F.col("cardinality_pct") > 99, "unique"),
        item(kind.isin("integer", "float"), "type"),
        item(kind.isin("integer", "float") & F.col("min").isNotNull(), "between", F.col("min"), F.col("max")),
        item(kind == "email", "regex"),
        item(kind == "date_iso", "date_format"),
        item(F.col("min_length").isNotNull(), "length", F.greatest(F.lit(1), F.col("min_length")), F.col("max_length") * 2),
    ]
    rows = p.select("column", F.explode(F.filter(F.array(*items), lambda r: r.isNotNull())).alias("e"))
    return rows.select("column", "e.expectation", "e.low", "e.high")


def monitor_thresholds(profile: DataFrame) -> DataFrame:
    """Limits for the next batch: 1.5 x null share, and mean within two deviations."""
    return profile.select(
        "column",
        F.when(F.col("null_pct") > 0, F.least(F.col("null_pct") * 1.5, F.lit(100.0))).alias("max_null_pct"),
        (F.col("mean") - 2 * F.coalesce("std", F.lit(0.0))).alias("mean_low"),
        (F.col("mean") + 2 * F.coalesce("std", F.lit(0.0))).alias("mean_high"),
    )


def partition_advice(profile: DataFrame, date_columns: Sequence[str], total_bytes: int, target: int = 128 * 1024 * 1024) -> DataFrame:
    """Range for dates, list up to 100 values, hash up to 10000 values; columns over 20% null are left out."""
    card = F.col("unique_count")
    is_date = F.col("column").isin(list(date_columns))
    kind = F.when(is_date, "range").when((card > 0) & (card <= 100), "list").when((card > 100) & (card <= 10000), "hash")
    parts = max(1, total_bytes // target)
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.lit(float(parts))) + 0.5))
    count = F.when(is_date, F.lit(365.0)).when(F.col("kind") == "list", card.cast("double")).otherwise(power)
    out = profile.where("null_pct <= 20").withColumn("kind", kind).where("kind IS NOT NULL")
    out = out.withColumn("partitions", count)
    return out.select("column", "kind", "partitions", (F.lit(float(total_bytes)) / F.col("partitions") / (1024 * 1024)).alias("partition_mb"))


# ---- drift ------------------------------------------------------------------


def ks_statistic(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Largest distance of the two cumulative shares, with the asymptotic p-value.

    Only cells of values that can hold the largest distance are summed value by value.
    """
    gap = largest_gap(reference, current, value)
    out = gap.select(F.col("gap").alias("ks"), F.col("na").alias("n_reference"), F.col("nb").alias("n_current"))
    scaled = F.sqrt(F.col("n_reference") * F.col("n_current") / (F.col("n_reference") + F.col("n_current"))) * F.col("ks")
    out = out.withColumn("__l", scaled)
    term = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * F.col("__l") * F.col("__l")),
    )
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * F.aggregate(term, F.lit(0.0), lambda x, y: x + y)))
    return out.withColumn("p_value", p).withColumn("drift", F.col("p_value") < 0.05).drop("__l")


def population_shift(reference: DataFrame, current: DataFrame, value: str, floor: float = 1e-4) -> DataFrame:
    """PSI over the reference deciles; over 0.2 counts as drift."""
    probs = {f"d{i}": i / 10 for i in range(1, 10)}
    cuts = exact_quantiles(reference, [], value, probs).drop("n")
    edges = F.array(*[F.col(c) for c in probs])

    def shares(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(cuts))
        bucket = F.size(F.filter(edges, lambda e: e < F.col(value)))
        counts = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        return counts.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")

    spine = reference.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket"))
    both = spine.join(shares(reference, "e"), "bucket", "left").join(shares(current, "a"), "bucket", "left")
    e = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(floor))
    a = F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(floor))
    return both.agg(F.sum((a - e) * F.log(a / e)).alias("psi")).withColumn("shifted", F.col("psi") > 0.2)
