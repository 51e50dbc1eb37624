"""Selection by narrowing against sorted lists: narrow bands, hot values, null keys, ties and few rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.operators import narrowing as N


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(6000):
        key = None if i % 7 == 0 else "hot" if i % 3 else rng.choice("abc")
        value = 1000.0 if rng.random() < 0.33 else 1000 + rng.random() / 1e6  # all in one narrow band
        out.append((key, i, value))
    return out + [("one", 9000, 5.0), ("none", 9001, None), ("two", 9002, -1.0), ("two", 9003, 1.0)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, i bigint, v double")


def groups(rows):
    out = {}
    for k, i, v in rows:
        if v is not None:
            out.setdefault(k, []).append((v, i))
    return {k: sorted(x) for k, x in out.items()}


def linear(s, p):
    at = p * (len(s) - 1)
    lo = int(at)
    return s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (at - lo)


@pytest.mark.parametrize(("accuracy", "most"), [(10_000, 1 << 16), (100, 1 << 16), (100, 8), (10, 3)])
def test_quantiles(df, rows, accuracy, most):
    probs = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in N.exact_quantiles(df, ["k"], "v", probs | {"q1": (0.25, "index")}, accuracy=accuracy, most=most).collect()}
    assert set(got) == set(groups(rows))
    for k, pairs in groups(rows).items():
        s = [v for v, _ in pairs]
        assert got[k].n == len(s)
        for name, p in probs.items():
            assert got[k][name] == linear(s, p)
        assert got[k].q1 == s[min(len(s) // 4, len(s) - 1)]
    assert got["two"].p50 == statistics.median([-1.0, 1.0])


def test_few_values_are_kept(spark):
    """Of many rows in a narrow band only the values near the wanted ranks are kept, and few are sorted together."""
    rows = spark.range(200_000).select(F.lit("k").alias("k"), (1 + F.rand(3) / 1e9).alias("__v"))
    inside = N._counted(rows, ["k"], [0.5, 0.9], 1000).where("__v is not null").count()
    assert inside <= 2 * 200_000 * 8 / 1000
    base = N.written(rows.withColumnRenamed("__v", "v"), "t")
    whole = sorted(r.v for r in base.collect())
    got = N.values_at(base, ["k"], "v", {"a": (0.5, lambda n: F.floor(n / 2)), "b": (0.9, lambda n: F.floor(n * 0.9))}, accuracy=1000, most=10).first()
    assert (got.a.value, got.b.value) == (whole[100_000], whole[180_000])
    assert whole[got.a.before] == got.a.value and (got.a.before == 0 or whole[got.a.before - 1] < got.a.value)


def test_without_keys_and_rows(spark, df, rows):
    s = sorted(v for _, _, v in rows if v is not None)
    got = N.exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert got.m == linear(s, 0.5) and got.n == len(s)
    assert N.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    assert N.exact_quantiles(df.where("v is null"), [], "v", {"m": 0.5}).first().m is None


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("descending", [False, True])
def test_cuts(df, rows, keys, descending):
    starts = [(i / 5, lambda n, i=i: F.floor(n * i / 5)) for i in range(1, 5)]
    got = {r.i: r.part for r in N.cut_by_rank(df, keys, "v", "i", starts, "part", descending=descending).collect()}
    by = groups(rows) if keys else {0: sorted((v, i) for _, i, v in rows if v is not None)}
    for pairs in by.values():
        order = sorted(pairs, key=lambda x: (-x[0] if descending else x[0], x[1]))
        n = len(order)
        for place, (_, i) in enumerate(order):
            assert got[i] == sum(n * s // 5 <= place for s in range(1, 5)), (n, place)
    assert got[9001] is None


def test_largest_gap(spark):
    rng = random.Random(12)
    for size in (0, 1, 400, 5000):
        a = [rng.gauss(0, 1) for _ in range(size)]
        b = [round(rng.gauss(0.2, 1), 1) for _ in range(size // 2 + 1)]
        frames = [spark.createDataFrame([(x,) for x in v], "x double") for v in (a, b)]
        got = N.largest_gap(*frames, "x", cells=50).first()
        if not size:
            assert got.na == 0 or got.gap is None
            continue
        plain = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in sorted({*a, *b}))
        assert got.gap == pytest.approx(plain, abs=1e-12)
        assert (got.na, got.nb) == (len(a), len(b))
