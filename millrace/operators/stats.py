"""Tests, intervals and rater statistics over grouped counts and moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import probability as P

#: Bounds between negligible, small, medium and large effects.
EFFECT_BOUNDS = {"h": (0.2, 0.5, 0.8), "d": (0.2, 0.5, 0.8), "v": (0.1, 0.3, 0.5)}


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def cohens_d(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    pooled = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))
    return N.safe_divide(m1 - m2, pooled)


def cramers_v(chi2: Column, n: Column, k: Column) -> Column:
    return F.when((n > 0) & (k > 1), F.sqrt(chi2 / (n * (k - 1)))).otherwise(0.0)


def effect_label(value: Column, metric: str) -> Column:
    low, mid, high = EFFECT_BOUNDS[metric]
    steps = [(low, "negligible"), (mid, "small"), (high, "medium")]
    return N.threshold_label(F.abs(value), steps, "large", descending=False)


def two_sided(z: Column) -> Column:
    """Two-sided normal p-value."""
    return 2 * P.normal_sf(F.abs(z))


def variant_counts(df: DataFrame, keys: Sequence[str], treated: Column, converted: Column) -> DataFrame:
    """Visitors and conversions of control and treatment by test, one row per test."""
    t, c = treated, F.coalesce(converted, F.lit(False))
    return df.groupBy(*keys).agg(
        F.count_if(~t).alias("cn"), F.count_if(~t & c).alias("cx"), F.count_if(t).alias("tn"), F.count_if(t & c).alias("tx")
    )


def proportion_ztest(counts: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Pooled z, unpooled interval, lift and effect size for every test at once."""
    pc, pt = F.col("cx") / F.col("cn"), F.col("tx") / F.col("tn")
    pool = (F.col("cx") + F.col("tx")) / (F.col("cn") + F.col("tn"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("cn") + 1 / F.col("tn")))
    spread = F.sqrt(pc * (1 - pc) / F.col("cn") + pt * (1 - pt) / F.col("tn"))
    crit = P.normal_quantile(1 - alpha / 2)
    out = counts.where("cn > 0 AND tn > 0").select(
        *keys,
        pc.alias("control_rate"),
        pt.alias("treatment_rate"),
        (pt - pc).alias("difference"),
        (N.safe_divide(pt - pc, pc) * 100).alias("lift_pct"),
        F.when(se > 0, (pt - pc) / se).alias("z"),
        (pt - pc - crit * spread).alias("lower"),
        (pt - pc + crit * spread).alias("upper"),
        F.abs(cohens_h(pt, pc)).alias("effect"),
    )
    out = out.withColumn("p_value", two_sided(F.col("z")))
    return out.withColumn("significant", F.col("p_value") < alpha).withColumn("effect_label", effect_label(F.col("effect"), "h"))


def ab_significance(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unpooled z test with the 90% and 95% marks."""
    pc, pt = N.safe_divide("cx", "cn"), N.safe_divide("tx", "tn")
    se = F.sqrt(N.safe_divide(pc * (1 - pc), "cn") + N.safe_divide(pt * (1 - pt), "tn"))
    out = counts.select(*keys, (pt - pc).alias("absolute"), (N.safe_divide(pt - pc, pc) * 100).alias("relative_pct"), N.safe_divide(pt - pc, se).alias("z"))
    out = out.withColumn("p_value", two_sided(F.col("z")))
    level = F.when(F.col("p_value") < 0.05, "95%").when(F.col("p_value") < 0.10, "90%").otherwise("Not significant")
    return out.withColumn("confidence_level", level)


def welch_ttest(df: DataFrame, keys: Sequence[str], treated: Column, value: str, alpha: float = 0.05) -> DataFrame:
    """Welch's t by key; the interval uses the normal quantile, the p-value Student's t."""
    a, b = F.when(~treated, F.col(value)), F.when(treated, F.col(value))
    m = df.groupBy(*keys).agg(
        F.avg(a).alias("cm"), F.stddev_samp(a).alias("cs"), F.count(a).alias("cn"), F.avg(b).alias("tm"), F.stddev_samp(b).alias("ts"), F.count(b).alias("tn")
    )
    va, vb = F.pow("cs", F.lit(2)) / F.col("cn"), F.pow("ts", F.lit(2)) / F.col("tn")
    se = F.sqrt(va + vb)
    df_ = F.pow(va + vb, F.lit(2)) / (va * va / (F.col("cn") - 1) + vb * vb / (F.col("tn") - 1))
    diff = F.col("tm") - F.col("cm")
    crit = P.normal_quantile(1 - alpha / 2)
    d = cohens_d(F.col("tm"), F.col("ts"), F.col("tn"), F.col("cm"), F.col("cs"), F.col("cn"))
    out = m.where("cn >= 2 AND tn >= 2").select(
        *keys,
        diff.alias("difference"),
        (N.safe_divide(diff, "cm") * 100).alias("lift_pct"),
        F.when(se > 0, diff / se).alias("t"),
        df_.alias("df"),
        (diff - crit * se).alias("lower"),
        (diff + crit * se).alias("upper"),
        F.abs(d).alias("effect"),
        effect_label(d, "d").alias("effect_label"),
    )
    out = out.withColumn("p_value", 2 * P.t_sf(F.abs("t"), F.col("df")))
    return out.withColumn("significant", F.col("p_value") < alpha)


def chi2_gof(df: DataFrame, category: str, shares: dict[str, float], alpha: float = 0.05) -> DataFrame:
    """Observed counts against expected shares; a warning row without statistic when an expected count is under 5."""
    table = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    counts = df.where(F.col(category).isin(list(shares))).groupBy(category).agg(F.count(F.lit(1)).alias("o"))
    total = counts.agg(F.sum("o").alias("n"))
    rows = counts.crossJoin(F.broadcast(total)).withColumn("e", F.col("n") * table[F.col(category)])
    out = rows.agg(
        F.max("n").alias("n"),
        (F.lit(float(len(shares) - 1))).alias("df"),
        F.min("e").alias("least"),
        (F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2)) / F.col("e")) + F.max("n") * (1 - F.sum("e") / F.max("n"))).alias("s"),
    )
    ok = F.col("least") >= 5
    out = out.select("n", "df", F.when(ok, F.col("s")).alias("chi2"), F.when(~ok, "expected count under 5").alias("warning"))
    out = out.withColumn("p_value", F.when(F.col("chi2").isNotNull(), P.chi2_sf(F.coalesce("chi2", F.lit(0.0)), F.col("df"))))
    v = cramers_v(F.col("chi2"), F.col("n"), F.col("df") + 1)
    return out.withColumn("cramers_v", v).withColumn("effect_label", effect_label(v, "v")).withColumn("significant", F.col("p_value") < alpha)


def wilson_interval(n: Column, x: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    z = P.normal_quantile(1 - (1 - confidence) / 2)
    p, z2 = x / n, z * z
    center = (p + z2 / (2 * n)) / (1 + z2 / n)
    margin = z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), center - margin), F.least(F.lit(1.0), center + margin)


def mean_interval(df: DataFrame, keys: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    z = P.normal_quantile(1 - (1 - confidence) / 2)
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    half = z * F.col("std") / F.sqrt("n")
    return out.where("n > 1").select(
        *keys, "n", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"),
        (N.ratio_or_null(half, F.abs("mean")) * 100).alias("relative_margin_pct"),
    )


def srm_check(df: DataFrame, keys: Sequence[str], treated: Column, limit: float = 0.01) -> DataFrame:
    """Sample ratio mismatch: distance of control and treatment counts over the expected half."""
    out = df.groupBy(*keys).agg(F.count_if(~treated).alias("control"), F.count_if(treated).alias("treatment"))
    half = (F.col("control") + F.col("treatment")) / 2
    out = out.withColumn("imbalance", F.abs(F.col("control") - F.col("treatment")) / half)
    return out.withColumn("mismatch", F.col("imbalance") >= limit)


def bonferroni(tests: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Every test against alpha over the number of tests."""
    n = tests.agg(F.count(F.lit(1)).alias("tests"))
    out = tests.crossJoin(F.broadcast(n)).withColumn("alpha_adjusted", F.lit(alpha) / F.col("tests"))
    return out.withColumn("significant_adjusted", F.col(p) < F.col("alpha_adjusted"))


# Calibration limits of the rater statistics.
MIN_SAMPLE = 5
RATE_GAP = 0.10
RATE_DEVIATION = 0.15
INFLATION = 0.3
TARGET_MEAN = 2.8
EXPECTED_SHARES = {1: 0.10, 2: 0.25, 3: 0.45, 4: 0.20}
MAX_ITEM_STD = 0.8
MIN_AGREEMENT = 0.75
MIN_CONSISTENCY = 0.8


def score_distribution(df: DataFrame, score: Column) -> DataFrame:
    """Share of each whole score against the expected share; over 5 points apart is marked."""
    counts = df.groupBy(F.floor(score).cast("int").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    spine = df.sparkSession.createDataFrame(list(EXPECTED_SHARES.items()), "score int, expected double")
    out = spine.join(counts, "score", "left").crossJoin(F.broadcast(total))
    actual = F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))
    return out.select("score", "expected", actual.alias("actual"), (actual - F.col("expected")).alias("difference"), (F.abs(actual - F.col("expected")) > 0.05).alias("deviates"))


def group_disparity(df: DataFrame, group: str, score: str, hit: str) -> DataFrame:
    """Spread of rate and mean over groups with enough rows."""
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("int")).alias("rate"), F.avg(score).alias("mean"))
    out = g.where(F.col("n") >= MIN_SAMPLE).agg(
        F.count(F.lit(1)).alias("groups"), (F.max("rate") - F.min("rate")).alias("rate_gap"), (F.max("mean") - F.min("mean")).alias("score_gap")
    )
    return out.withColumn("detected", (F.col("groups") >= 2) & ((F.col("rate_gap") > RATE_GAP) | (F.col("score_gap") > 0.5)))


def competency_disparity(df: DataFrame, rater: str, scores: str) -> DataFrame:
    """Mean and variance by competency of a score map, and raters over half a point off the mean of rater means."""
    long = df.select(rater, F.explode(scores).alias("competency", "score"))
    by_rater = long.groupBy("competency", rater).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m")).where("n >= 3")
    center = by_rater.groupBy("competency").agg(F.avg("m").alias("center"), F.count(F.lit(1)).alias("raters"))
    off = by_rater.join(center, "competency").where("raters > 1").groupBy("competency").agg(F.count_if(F.abs(F.col("m") - F.col("center")) > 0.5).alias("raters_off"))
    stats = long.groupBy("competency").agg(F.count(F.lit(1)).alias("total"), F.avg("score").alias("mean"), F.var_samp("score").alias("variance"))
    out = stats.where(F.col("total") >= MIN_SAMPLE).join(off, "competency", "left")
    return out.withColumn("raters_off", F.coalesce("raters_off", F.lit(0))).withColumn("bias_detected", F.col("raters_off") > 0)


def rater_consistency(df: DataFrame, rater: str, score: str, hit: str) -> DataFrame:
    """Half variance term, half gap between accepted and rejected means, each within 0-1; 0.5 under three rows."""
    s, h = F.col(score), F.col(hit)
    out = df.groupBy(rater).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.var_samp(s).alias("var"),
        F.avg(h.cast("int")).alias("rate"), F.avg(F.when(h, s)).alias("yes"), F.avg(F.when(~h, s)).alias("no"),
        F.avg((F.floor(s) == 4).cast("int")).alias("four_share"),
    )
    gap = F.coalesce(N.clamp((F.col("yes") - F.col("no")) / 2, 0, 1), F.lit(0.5))
    spread = F.greatest(F.lit(0.0), 1 - F.col("var") / 2)
    return out.withColumn("consistency", F.when(F.col("n") < 3, 0.5).otherwise((gap + spread) / 2))


def rater_bias(df: DataFrame, rater: str, score: str, hit: str) -> DataFrame:
    """Raters with enough rows against the mean of raters: inflation, deflation, rate deviation, low consistency."""
    r = rater_consistency(df, rater, score, hit).where(F.col("n") >= MIN_SAMPLE)
    center = r.agg(F.avg("mean").alias("center"), F.avg("rate").alias("center_rate"))
    out = r.crossJoin(F.broadcast(center))
    issues = F.array(
        F.when(F.col("mean") > F.col("center") * (1 + INFLATION), F.lit("score_inflation")).when(F.col("mean") < F.col("center") * (1 - INFLATION), F.lit("score_deflation")),
        F.when(F.abs(F.col("rate") - F.col("center_rate")) > RATE_DEVIATION, F.lit("hire_rate_deviation")),
        F.when(F.col("consistency") < MIN_CONSISTENCY, F.lit("low_consistency")),
    )
    issues = F.filter(issues, lambda x: x.isNotNull())
    return out.select(rater, "n", "mean", "rate", "consistency", F.array_join(issues, ",").alias("issues"), F.size(issues).cast("long").alias("severity"))


def rater_agreement(df: DataFrame, item: str, score: str) -> DataFrame:
    """Spread of scores per item seen by two or more raters, and the overall quality."""
    per = df.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(score).alias("std"), (F.max(score) - F.min(score)).alias("span")).where("n > 1")
    out = per.agg(F.count(F.lit(1)).alias("items"), F.avg("std").alias("mean_std"), F.avg((F.col("span") <= 1).cast("int")).alias("agreement"))
    quality = F.when(F.col("mean_std") > MAX_ITEM_STD, "poor").when(F.col("agreement") < MIN_AGREEMENT, "fair").otherwise("good")
    return out.withColumn("quality", quality)


def score_inflation(df: DataFrame, rater: str, score: str) -> DataFrame:
    s = F.col(score)
    out = df.groupBy(rater).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.avg((F.floor(s) == 4).cast("int")).alias("four_share")).where("n >= 5")
    tight = (F.col("mean") > 3.2) & (F.col("std") < 0.5)
    return out.withColumn("inflated", (F.col("mean") - TARGET_MEAN > 0.3) | tight | (F.col("four_share") > 0.4))


def period_trend(df: DataFrame, keys: Sequence[str], period: Column, score: str, hit: Column) -> DataFrame:
    """Slope of mean score and rate over periods with three rows or more."""
    p = df.groupBy(*keys, period.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(hit.cast("int")).alias("rate")).where("n >= 3")
    p = p.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("period")).cast("double"))
    out = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("periods"), F.regr_slope("mean_score", "i").alias("score_slope"), F.regr_slope("rate", "i").alias("rate_slope")).where("periods >= 3")

    def way(c: str, band: float) -> Column:
        return F.when(F.col(c) > band, "increasing").when(F.col(c) < -band, "decreasing").otherwise("stable")

    return out.withColumn("score_direction", way("score_slope", 0.01)).withColumn("rate_direction", way("rate_slope", 0.005))


def best_run(df: DataFrame, keys: Sequence[str], status: str, metric: str, order: Sequence[str], *, lower: bool) -> DataFrame:
    """Keep, discard and crash counts; first kept metric as baseline, the best one, and the change in percent."""
    s = F.col(status)
    kept = F.when((s == "keep") & F.col(metric).isNotNull(), F.col(metric))
    first = F.min_by(F.col(metric), F.when(kept.isNotNull(), F.struct(*order)))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "keep").alias("keeps"), F.count_if(s == "discard").alias("discards"), F.count_if(s == "crash").alias("crashes"),
        first.alias("baseline"), (F.min(kept) if lower else F.max(kept)).alias("best"),
    )
    gain = (F.col("baseline") - F.col("best")) if lower else (F.col("best") - F.col("baseline"))
    return out.withColumn("pct_change", N.ratio_or_null(gain, "baseline") * 100)
