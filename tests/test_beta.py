"""Probabilities against exact sums and tabulated values."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from caseflow.functions import beta as B


def binomial_tail(k, n, p):
    """P(X >= k), exactly."""
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1)))


CASES = [(1, 1, 0.5), (1, 20, 0.05), (7, 20, 0.25), (20, 20, 0.9), (50, 100, 0.5), (63, 100, 0.5), (130, 400, 0.3), (1200, 2500, 0.48), (2600, 5000, 0.5), (1100, 100_000, 0.01)]


def test_beta_is_the_binomial_tail(spark):
    df = spark.createDataFrame([(float(k), float(n), p) for k, n, p in CASES], "k double, n double, p double").coalesce(1)
    got = {(int(r.k), int(r.n)): r.x for r in df.withColumn("x", B.binomial_at_least(F.col("k"), F.col("n"), F.col("p"))).collect()}
    for k, n, p in CASES:
        if n <= 5000:
            want = binomial_tail(k, n, p)
            assert abs(got[(k, n)] / want - 1) < 1e-9, (k, n)
        assert abs(B.betainc(k, n - k + 1, p) - got[(k, n)]) < 1e-12


def test_both_ways_agree_where_they_meet(monkeypatch):
    for a, b, x in [(1500, 1800, 0.45), (1500, 1800, 0.47), (1100, 90_000, 0.0125), (5000, 5000, 0.5), (5000, 5000, 0.47)]:
        direct = B.betainc(a, b, x)
        with monkeypatch.context() as m:
            m.setattr(B, "LARGE", 1e9)
            m.setattr(B, "STEPS", 3000)
            assert abs(B.betainc(a, b, x) / direct - 1) < 1e-9


def test_large_counts():
    n = 10 ** 10  # normal limit: one standard deviation below the mean
    x = 0.5 - 0.5 / math.sqrt(n)
    assert abs(B.betainc(n / 2, n / 2, x) - 0.15865525393) < 1e-7
    assert abs(B.betainc(n / 2, n / 2, 0.5) - 0.5) < 1e-9


def test_exact_intervals(spark):
    """The ends have exactly the outer probabilities; tabulated: 8 of 10 and 0 of 10."""
    df = spark.createDataFrame([(8.0, 10.0), (0.0, 10.0), (10.0, 10.0), (855.0, 1000.0), (3.0e9, 4.0e9)], "k double, n double").coalesce(1)
    low, high = B.binomial_interval(F.col("k"), F.col("n"))
    got = {(r.k, r.n): (r.low, r.high) for r in df.withColumn("low", low).withColumn("high", high).collect()}
    assert got[(8.0, 10.0)] == pytest.approx((0.44390454, 0.97478927), abs=1e-8)
    assert got[(0.0, 10.0)] == pytest.approx((0.0, 0.30849711), abs=1e-8)
    assert got[(10.0, 10.0)] == pytest.approx((0.69150289, 1.0), abs=1e-8)
    low, high = got[(855.0, 1000.0)]
    assert binomial_tail(855, 1000, low) == pytest.approx(0.025, abs=1e-10) and 1 - binomial_tail(856, 1000, high) == pytest.approx(0.025, abs=1e-10)
    low, high = got[(3.0e9, 4.0e9)]
    half = 1.959963984540054 * math.sqrt(0.75 * 0.25 / 4e9)
    assert low == pytest.approx(0.75 - half, abs=1e-9) and high == pytest.approx(0.75 + half, abs=1e-9)


def test_tabulated_quantiles(spark):
    t = {1: 12.706204736, 2: 4.302652730, 4: 2.776445105, 9: 2.262157163, 30: 2.042272456, 120: 1.979930405}
    rows = spark.createDataFrame([(float(d),) for d in t], "d double").coalesce(1).withColumn("t", B.student_quantile(F.lit(0.05), F.col("d"))).collect()
    assert {int(r.d): r.t for r in rows} == pytest.approx(t, abs=1e-8)
    z = [0.0, 0.5, 1.0, 1.959963984540054, 3.0, 8.0, 20.0]
    rows = spark.createDataFrame([(v,) for v in z], "z double").coalesce(1).withColumn("p", B.normal_beyond(F.col("z"))).collect()
    for r in rows:
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-11)
