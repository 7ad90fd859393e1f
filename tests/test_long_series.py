"""Series, value ranges and files that are many times longer than a block, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import fourier, series


def long_rows(spark, named):
    rows = [(k, t, float(v)) for k, x in named.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, t long, value double").repartition(7)


@pytest.mark.parametrize("max_lag", [None, 700])
def test_autocorrelation_of_a_hundred_blocks(spark, max_lag):
    rng = np.random.default_rng(0)
    named = {"long": np.sin(np.arange(6400) / 9) + rng.normal(size=6400), "prime": rng.normal(size=2503).cumsum(), "short": rng.normal(size=50), "flat": np.ones(40)}
    got = {}
    for r in series.autocorrelation(long_rows(spark, named), ["k"], max_lag=max_lag, block_rows=64).collect():
        got.setdefault(r.k, {})[r.lag] = r.acf
    for k, x in named.items():
        d = x - x.mean()
        most = len(x) // 2 if max_lag is None else min(max_lag, len(x) // 2)
        assert sorted(got[k]) == list(range(1, most + 1))
        if k == "flat":
            assert all(v is None for v in got[k].values())
        else:
            want = [(d[:-lag] * d[lag:]).sum() / (d * d).sum() for lag in range(1, most + 1)]
            assert np.allclose([got[k][lag] for lag in range(1, most + 1)], want, atol=1e-9)


@pytest.mark.parametrize("n", [4096, 5003, 6000])
def test_spectrum_far_above_a_block(spark, n):
    x = np.sin(np.arange(n) * 2 * np.pi / 37) + np.random.default_rng(1).normal(size=n)
    rows = long_rows(spark, {"a": x, "b": x[:60]})
    out = series.spectrum(rows, ["k"], block_rows=64).collect()
    for name, length in (("a", n), ("b", 60)):
        got = {r.freq: complex(r.re, r.im) for r in out if r.k == name}
        want = np.fft.fft(x[:length])
        assert sorted(got) == list(range(1, length // 2 + 1))
        assert np.allclose([got[i] for i in sorted(got)], want[1 : length // 2 + 1], atol=1e-7)
    periods = {r.k: r.period for r in series.spectrum_period(rows.where("k = 'a'"), ["k"], 100, block_rows=64).collect()}
    assert periods == {"a": 37}


def test_no_task_of_the_transform_holds_more_than_a_block(spark):
    for m in range(2, 40):
        rows, columns, wide, high = fourier._grid(m, 4096)
        assert rows * columns == 1 << m and columns % wide == 0 and rows % high == 0
        assert rows * wide <= max(4096, rows) and columns * high <= max(4096, columns)


def test_quantiles_of_a_million_values_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    n = 1_000_000
    values = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("skew").alias("k"), F.col("id"))
    made = values.withColumn("v", F.when(F.col("k") == "hot", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double")).otherwise(F.exp(F.pmod(F.xxhash64("id"), F.lit(4000)) / 10.0)))
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    local = made.select("k", "v").toPandas()
    got = {r.k: r for r in series.exact_quantiles(made, ["k"], "v", probs, block_rows=1000, fan=16).collect()}
    for k, part in local.groupby("k"):
        assert np.allclose([got[k][f"q{i}"] for i in range(len(probs))], np.quantile(part["v"], probs), rtol=1e-12)
    small = spark.createDataFrame([(1, float(v)) for v in rng.integers(0, 5, 200)] + [(2, None), (3, 7.0)], "k int, v double")
    whole = small.where("v is not null").toPandas()
    for block in (2, 1000):
        got = {r.k: [r.q0, r.q1] for r in series.exact_quantiles(small, ["k"], "v", [0.3, 0.5], block_rows=block).collect()}
        assert got == {k: pytest.approx(list(np.quantile(p["v"], [0.3, 0.5]))) for k, p in whole.groupby("k")}
    assert series.exact_quantiles(small.select("v"), [], "v", [0.5]).first()["q0"] == pytest.approx(np.quantile(whole["v"], 0.5))
