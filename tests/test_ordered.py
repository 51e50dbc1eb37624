"""Block-wise order statistics against plain Python, with a hot key and hot values."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.functions.numeric import magnitude_block
from millrace.operators.narrowing import exact_quantiles
from millrace.operators.ordered import neighbour, ranked, running_sum


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(3000):
        key = "hot" if i % 3 else rnd.choice("abc")
        value = 5.0 if rnd.random() < 0.33 else rnd.choice([rnd.uniform(-1000, 1000), rnd.uniform(-1, 1), 0.0, 10.0**3, 999.9999999])
        out.append((key, i, round(value, 6)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, i bigint, v double")


def groups(rows):
    g = {}
    for k, i, v in rows:
        g.setdefault(k, []).append((v, i))
    return g


def test_blocks_never_fall(spark, rows):
    values = sorted({v for _, _, v in rows} | {999.99999999, 1000.0, 1e-9, -1e-9, 9.999999999999998})
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", magnitude_block("v").alias("b")).orderBy("v").collect()
    blocks = [r.b for r in got]
    assert blocks == sorted(blocks)


def test_quantiles_linear_and_index(df, rows):
    lin = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    idx = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"q1": 0.25, "q3": 0.75}, method="index").collect()}
    for k, vs in groups(rows).items():
        s = sorted(v for v, _ in vs)
        assert lin[k].p50 == pytest.approx(statistics.median(s))
        pos = 0.9 * (len(s) - 1)
        lo = int(pos)
        assert lin[k].p90 == pytest.approx(s[lo] + (pos - lo) * (s[min(lo + 1, len(s) - 1)] - s[lo]))
        assert idx[k].q1 == s[len(s) // 4] and idx[k].q3 == s[3 * len(s) // 4]


def test_ranks(df, rows):
    got = {r.i: r for r in ranked(df, ["k"], "v", tie="i", row_number="rn", rank="rk", dense_rank="dr", total="n").collect()}
    for vs in groups(rows).values():
        order = sorted(vs, key=lambda x: (-x[0], x[1]))
        distinct = sorted({v for v, _ in vs}, reverse=True)
        for n, (v, i) in enumerate(order):
            assert got[i].rn == n + 1
            assert got[i].rk == 1 + sum(x > v for x, _ in vs)
            assert got[i].dr == distinct.index(v) + 1
            assert got[i].n == len(vs)


def test_running_sum_and_neighbours(df, rows):
    block = F.floor(F.col("i") / 50)
    total = {r.i: r.s for r in running_sum(df, ["k"], ["i"], "v", block, "s").collect()}
    prev = {r.i: r.p for r in neighbour(df, ["k"], ["i"], {"p": "v"}, block).collect()}
    nxt = {r.i: r.p for r in neighbour(df, ["k"], ["i"], {"p": "v"}, block, forward=True).collect()}
    for vs in groups(rows).values():
        order = sorted(vs, key=lambda x: x[1])
        run = 0.0
        for n, (v, i) in enumerate(order):
            run += v
            assert total[i] == pytest.approx(run)
            assert prev[i] == (order[n - 1][0] if n else None)
            assert nxt[i] == (order[n + 1][0] if n + 1 < len(order) else None)
