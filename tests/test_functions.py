"""Column builders and distributions against pandas and known values."""

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import distributions as D


def frame(spark, values, **more):
    rows = [("a", i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date int, x double")


def listed(df, column):
    return [r.v for r in df.select("date", column.alias("v")).orderBy("date").collect()]




def test_pct_rank_with_ties_and_missing(spark):
    df = frame(spark, [1.0, None, 3.0, 3.0, 5.0])
    assert listed(df, C.pct_rank(F.col("x"), ["symbol"])) == [0.25, None, 0.625, 0.625, 1.0]


def test_rolling_pct_rank(spark):
    got = listed(frame(spark, [1.0, 2.0, 2.0, 4.0]), C.rolling_pct_rank(F.col("x"), C.series(), 3))
    assert got[:2] == [None, None] and got[2] == pytest.approx(2.5 / 3) and got[3] == 1.0


def test_pct_change_over_a_gap(spark):
    df = frame(spark, [1.0, None, 2.0]).withColumn("y", C.carried(F.col("x"), C.series()))
    assert listed(df, C.pct_change_of(F.col("y"), C.series())) == [None, 0.0, 1.0]


def test_strict_windows_and_flags(spark):
    df = frame(spark, [1.0, None, 3.0, 4.0])
    assert listed(df, C.rolling_mean(F.col("x"), C.series(), 2)) == [None, None, None, 3.5]
    assert listed(df, C.flag(F.col("x") > 2)) == [0, 0, 1, 1]
    assert listed(df, C.over_zero(F.col("x"), F.lit(0.0))) == [None] * 4


def test_nan_becomes_missing(spark):
    df = C.clean(frame(spark, [1.0, float("nan"), float("inf"), -2.0]))
    assert listed(df, F.col("x")) == [1.0, None, None, -2.0]


@pytest.mark.parametrize(("n", "shift"), [(5, 0), (5, 1), (14, 2)])
def test_rolling_against_pandas(spark, n, shift):
    rng = np.random.default_rng(n)
    x = pd.Series(rng.normal(size=80))
    x[rng.integers(0, 80, 6)] = np.nan
    df = frame(spark, [None if math.isnan(v) else float(v) for v in x])
    w = C.series()
    pairs = [(C.rolling_mean, "mean"), (C.rolling_std, "std"), (C.rolling_max, "max"), (C.rolling_min, "min"), (C.rolling_sum, "sum")]
    for build, name in pairs:
        got = pd.Series(listed(df, build(F.col("x"), w, n, shift)), dtype=float)
        pd.testing.assert_series_equal(got, getattr(x.rolling(n), name)().shift(shift), check_names=False, rtol=1e-9)


def test_business_days(spark):
    d = spark.createDataFrame([("2024-01-05",), ("2024-01-06",), ("2024-01-08",)], "d string").select(F.col("d").cast("date").alias("d"))
    got = [(str(r[0]), str(r[1])) for r in d.select(C.business_day(F.col("d"), 1), C.business_day(F.col("d"), -1)).collect()]
    assert got == [("2024-01-08", "2024-01-04"), ("2024-01-08", "2024-01-05"), ("2024-01-09", "2024-01-05")]


def test_normal_cdf_column(spark):
    xs = [-5.0, -1.3, 0.0, 0.7, 4.0]
    got = listed(frame(spark, xs), C.normal_cdf(F.col("x")))
    assert got == pytest.approx([NormalDist().cdf(x) for x in xs], abs=8e-8)


@given(st.floats(-30, 30), st.integers(1, 300))
@settings(max_examples=60, deadline=None)
def test_t_tail_is_a_probability_and_symmetric(t, df):
    p = float(D.t_two_sided(t, df))
    assert 0 <= p <= 1 and p == pytest.approx(float(D.t_two_sided(-t, df)))


def test_t_tail_known_values():
    # Closed forms for one and two degrees of freedom; the normal limit.
    for t in (0.3, 1.0, 2.5, 12.0):
        assert float(D.t_two_sided(t, 1)) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)
        assert float(D.t_two_sided(t, 2)) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
    assert float(D.t_two_sided(1.96, 10**6)) == pytest.approx(0.05, abs=1e-4)
    assert math.isnan(float(D.t_two_sided(float("nan"), 5)))
    assert D.normal_cdf([0.0, 1.0]).tolist() == pytest.approx([0.5, 0.8413447461])


def test_cusum_windows_equal_the_recursion(spark):
    from tidemark.config import Settings
    from tidemark.operators.regimes import cusum_path

    rng = random.Random(1)
    x = [rng.gauss(0.1, 1) for _ in range(60)] + [rng.gauss(-0.2, 1) for _ in range(120)]
    rows = [("r", f"{2021 if i < 60 else 2022}-{1 + (i % 12):02d}-{1 + i // 12 % 28:02d}", i, v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "rule string, d string, i int, net double").withColumn("date", F.to_date("d"))
    s = Settings()
    train = [v for r, v in zip(rows, x, strict=True) if r[1] <= s.train_end]
    mu, sd = float(np.mean(train)), float(np.std(train, ddof=1))
    level, want = 0.0, {}
    for r in sorted((r for r in rows if r[1] > s.train_end), key=lambda r: (r[1], r[2])):
        level = max(0.0, level + mu - r[3] - s.cusum_drift * sd)
        want[r[2]] = level
    got = {r.i: r.cusum for r in cusum_path(df, s, ("date", "i")).collect()}
    assert got == pytest.approx(want, abs=1e-9)
