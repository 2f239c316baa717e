"""Stages that spread one series over tasks equal the plain ones."""

import numpy as np
import pytest
from pyspark.sql import DataFrame, functions as F

from tidewave.operators import entropy, frames, resample, slices, windows
from tidewave.sources import Signal


@pytest.fixture(scope="module")
def giant(spark):
    """One series with almost all rows, a short one, one without a key; values by a hash, times uneven."""
    i = F.col("id")
    n = F.when(i < 20_000, i)
    df = spark.range(20_030).select(
        F.when(i < 20_000, "a").when(i < 20_010, "b").alias("k"),
        F.coalesce(n, i - 20_000).alias("n"),
        F.timestamp_micros(i * 1_000_000 + F.pmod(F.xxhash64("id"), F.lit(700_000))).alias("ts"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2000)) / 1000.0 - 1).alias("value"),
    )
    return Signal.of(df.repartition(5), ["k"], ["ts", "n"], ts="ts")


@pytest.fixture(scope="module")
def numbered(giant):
    s = slices.numbered(giant, 8)
    return s.with_(s.df.cache())


def table(df, on):
    f = df.toPandas()
    return f.sort_values(on, na_position="first").reset_index(drop=True)


def equal(got, want, on, columns):
    a, b = table(got, on), table(want, on)
    assert len(a) == len(b) and sorted(got.columns) == sorted(want.columns)
    for c in columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], atol=1e-9, equal_nan=True)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist()


def test_row_numbers(spark, giant, numbered):
    f = table(numbered.df, ["k", slices.INDEX])
    for _, g in f.groupby("k", dropna=False):
        assert g[slices.INDEX].tolist() == list(range(len(g))) and g["ts"].is_monotonic_increasing
    assert slices.numbered(giant.with_(giant.df.where("false"))).df.count() == 0
    with pytest.raises(ValueError, match="taken"):
        slices.numbered(numbered)
    with pytest.raises(ValueError, match="number"):
        slices.in_row_slices(giant, lambda s: s.v, 0, 10)
    with pytest.raises(ValueError, match="wide"):
        slices.in_row_slices(numbered, lambda s: s.v, 11, 10)


@pytest.mark.parametrize("width", [4, 1000])
def test_windows_and_regressions_in_slices(giant, numbered, width):
    for stage in (lambda s: windows.moving_average(s, 5), lambda s: windows.linear_regression(s, 5, "slope"), lambda s: windows.z_score(s, 3)):
        got = slices.in_row_slices(numbered, stage, 4, width).drop(slices.INDEX)
        plain = stage(giant)
        want = plain if isinstance(plain, DataFrame) else giant.df.withColumn("y", plain)
        equal(got, want, ["k", "ts"], ["y", "n"])


@pytest.mark.parametrize("up, down, ts", [(3, 2, True), (1, 4, True), (5, 1, True), (2, 7, False), (4, 6, True)])
def test_resampling_in_slices(giant, numbered, up, down, ts):
    g = giant if ts else giant.with_(giant.df, ts=None)
    s = numbered if ts else numbered.with_(numbered.df, ts=None)
    got, want = slices.resample_sliced(s, up, down, 9, 64), resample.resample(g, up, down, 9)
    equal(got, want, ["k", "idx"], ["idx", "y", *(["ts"] if ts else [])])


def test_a_hot_series_spreads(spark, numbered):
    """Every exchange deals by more than the key: the windows' by slice, the numbers' by range and piece; at least eight tasks have rows."""
    df = slices.in_row_slices(numbered, lambda s: windows.moving_average(s, 5), 4, 200)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in plan and "hashpartitioning(k" in plan and "RangePartitioning" not in plan.split("InMemoryRelation")[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = df.where("k = 'a' and y is not null").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 8 and max(r["count"] for r in parts) < 0.45 * 20_000


@pytest.mark.parametrize("tile, lags", [(64, 50), (7000, 1 << 14)])
def test_all_lags_in_tiles(spark, giant, numbered, monkeypatch, tile, lags):
    monkeypatch.setattr(windows, "LAGS", lags)
    small = numbered.with_(numbered.df.where("k is null or k = 'b' or row_index < 700") if tile == 64 else numbered.df)
    df = small.df.withColumn("z", F.col("value") * F.col("value") + F.col("n") / 1000)
    got = table(windows.correlation_tiles(small.with_(df), "z", tile), ["k", "lag"])
    f = table(df, ["k", "row_index"])
    for k, g in f.groupby("k", dropna=False):
        x, z = g["value"].to_numpy(), g["z"].to_numpy()
        r = got[got["k"].isna() if k is None or k != k else got["k"] == k]
        n = len(x)
        size = 1 << (2 * n).bit_length()
        want = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(z, size), size)[:n]
        assert r["lag"].tolist() == list(range(n)) and np.allclose(r["r"], want, atol=1e-7)
    assert windows.correlation_tiles(numbered.with_(numbered.df.where("false"))).count() == 0


def entropies(x, m, tol):
    x, n = np.asarray(x), len(x)
    if n < m + 2:
        return None, None
    t = lambda k, stop: np.lib.stride_tricks.sliding_window_view(x, k)[:stop]
    near = lambda k, stop: (np.abs(t(k, stop)[:, None] - t(k, stop)[None]).max(2) <= tol).sum(1)
    b, a = (near(m, n - m) - 1).sum(), (near(m + 1, n - m) - 1).sum()
    return (-np.log(a / b) if a and b else np.inf), np.log(near(m, n) / (n - m + 1)).mean() - np.log(near(m + 1, n) / (n - m)).mean()


@pytest.mark.parametrize("m, r, chunk", [(2, None, 2048), (1, 0.05, 16), (3, 0.3, 64), (2, 0.0, 8)])
def test_entropies_of_series(spark, monkeypatch, m, r, chunk):
    """Also constant, short and null-keyed series, and equal templates; chunks of cells."""
    monkeypatch.setattr(entropy, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    series = {"long": rng.standard_normal(600).cumsum() % 3, "steps": rng.integers(0, 3, 400).astype(float), "flat": np.ones(200), "two": np.array([1.0, 2.0]), "five": np.arange(5.0), None: rng.standard_normal(80) + 1e6}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    s = slices.numbered(Signal.of(spark.createDataFrame(rows, "k string, i bigint, value double").repartition(3), ["k"], ["i"]), 4)
    got = {x.k: x for x in entropy.series_entropies(s, m, r, 50).collect()}
    assert set(got) == set(series)
    for k, x in series.items():
        want = entropies(x, m, 0.2 * x.std() if r is None else r)
        have = (got[k].sample_entropy, got[k].approximate_entropy)
        assert got[k].samples == len(x) and (want == have == (None, None) or np.allclose(np.array(have), np.array(want), atol=1e-9)), k
    assert entropy.series_entropies(s.with_(s.df.where("false"))).count() == 0


def test_entropies_of_null_and_short_frames(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 1.0, 2.0, 1.0])], "i int, values array<double>")
    got = [(r.sample_entropy, r.approximate_entropy) for r in frames.entropies(df).orderBy("i").collect()]
    assert got[:3] == [(None, None)] * 3 and got[3][0] is not None


def test_few_samples_are_one_cell(spark, monkeypatch):
    """Entropies do not depend on whether a short series is cut into cells; also of repeated values, a constant and infinite results."""
    rng = np.random.default_rng(8)
    series = {1: rng.standard_normal(60), 2: np.repeat(rng.integers(0, 4, 30), 2).astype(float), 3: np.ones(20), 4: rng.standard_normal(3), 5: np.arange(8.0) * 100}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    s = slices.numbered(Signal.of(spark.createDataFrame(rows, "k bigint, n bigint, value double"), ["k"], ["n"]))
    got = []
    for whole in (entropy.WHOLE, 20, 0):
        monkeypatch.setattr(entropy, "WHOLE", whole)
        got.append(entropy.series_entropies(s, width=50).orderBy("k").toPandas().to_numpy(float))
    assert entropy.WHOLE == 0 and len(got[0]) == 5
    assert all(np.allclose(got[0], x, atol=1e-12, equal_nan=True) for x in got[1:])
