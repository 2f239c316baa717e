"""Small vectors with known answers (fixed values: short inputs and results of common examples), chunk and permutation invariance, parameter checks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave.functions import design, expr, kernels as K
from tidewave.operators import channels, frames, logs, models, quality, recursive, resample, windows
from tidewave.plans import Pipeline
from tidewave.sources import Signal, deinterleave, interleave


def signal(spark, values, ts=None, series=("a",)):
    rows = [(s, i, float(v), None if ts is None else pd.Timestamp(ts[i], unit="ms").to_pydatetime()) for s in series for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, idx long, value double, ts timestamp")
    return Signal.of(df.repartition(3), ["series"], ["idx"], ts="ts" if ts is not None else None)


def values(df, y="y", order="idx"):
    return [r[0] for r in df.orderBy(order).select(y).collect()]


def column(s, c):
    return values(s.df.withColumn("y", c))


@pytest.mark.parametrize(
    "name, x, build, want",
    [
        ("mean", [1, 2, 3, 4, 5], lambda s: windows.moving_average(s), [3] * 5),
        ("rms", [3, 4, 0, 6, 8], lambda s: windows.rms(s, 3), [3, 3.5355, 2.8867, 4.1633, 5.7735]),
        ("variance", [1, 2, 3, 4, 5], lambda s: windows.variance(s), [2] * 5),
        ("z", [1, 2, 3, 4, 5], lambda s: windows.z_score(s), [-1.41421, -0.707107, 0, 0.707107, 1.41421]),
        ("cumulative", [10, 20, 30, 40, 50], windows.cumulative_average, [10, 15, 20, 25, 30]),
        ("mav", [1, -2, 3, -4, 5], lambda s: windows.mean_absolute_value(s, 3), [1, 1.5, 2, 3, 4]),
        ("difference", [1, 3, 6, 10, 15], windows.difference, [1, 2, 3, 4, 5]),
        ("clip", [0.5, 0.9, -0.95, 0.7, 1, -0.5, 0.85], lambda s: expr.clip_detection(s.v, 0.8), [0, 1, 1, 0, 1, 0, 1]),
        ("large", [1, 2, 3, 4, 5], lambda s: windows.large_moving_average(s, 2), [1, 1.5, 2.5, 3.5, 4.5]),
    ],
)
def test_columns(spark, name, x, build, want):
    s = signal(spark, x)
    assert column(s, build(s)) == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize(
    "x, build, want",
    [
        ([1, 2, 4, 3, 5], lambda s: windows.waveform_length(s, 3), [0, 1, 3, 4, 5]),
        ([1, 3, 2, 4, 3, 5], lambda s: windows.slope_sign_changes(s, 5), [0, 0, 1, 2, 3, 4]),
        ([1, 3, 2, 4, 3, 5], lambda s: windows.slope_sign_changes(s, 5, compat=True), [0, 0, 0, 1, 1, 1]),
        ([0, 0.5, 2, 2.5, 1, 3], lambda s: windows.willison_amplitude(s, 5, 1), [0, 0, 1, 1, 2, 3]),
        ([0, 0.5, 2, 2.5, 1, 3], lambda s: windows.willison_amplitude(s, 5, 1, compat=True), [0, 0, 1, 1, 1, 1]),
        ([1, 2, 3, 4, 5], lambda s: recursive.ema(s, 0.5), [1, 1.5, 2.25, 3.125, 4.0625]),
        ([1] * 5, lambda s: recursive.integrate(s, 0.9), [1, 1.9, 2.71, 3.439, 4.0951]),
        ([0, 2, 4, 6, 8, 10], lambda s: windows.linear_regression(s, 5), [0, 2, 2, 2, 2, 2]),
        ([5, 7, 9], lambda s: windows.detrend(s), [0, 0, 0]),
        ([0, 5, 2, 6, 3, 8, 2, 4, 1, 9, 2, 0], lambda s: recursive.spaced_peaks(s, 4), [0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0]),
    ],
)
def test_frames_of_values(spark, x, build, want):
    assert values(build(signal(spark, x))) == pytest.approx(want, abs=1e-6)


def test_valid_correlation(spark):
    s = signal(spark, [1, 3, 2, 5, 4])
    assert values(windows.valid_correlation(s, [1, -1])) == [-2, 1, -3, 1]
    assert values(windows.valid_correlation(s, [1, -1], flip=True)) == [2, -1, 3, -1]


def test_time_window_is_half_open(spark):
    s = signal(spark, [10, 20, 30, 40], [0, 50, 600, 650])
    assert column(s, windows.moving_average(s, duration_ms=500)) == [10, 15, 30, 35]
    s = signal(spark, [10, 20], [0, 500])
    assert column(s, windows.moving_average(s, duration_ms=500)) == [10, 20]


def test_peaks(spark):
    x = [0, 1, 5, 2, 3, 6, 1, 0, 4, 9, 8, 2, 7, 3, 0]
    assert [i for i, v in enumerate(values(windows.peaks(signal(spark, x), 3, 0.5))) if v] == [2, 5, 9, 12]


def test_autocorrelation(spark):
    got = windows.autocorrelation(signal(spark, [1, 2, 3, 4, 5]), 10)
    assert values(got, "r", "lag") == [55, 40, 26, 14, 5]


@pytest.mark.parametrize("max_lag", [None, 7, 12_000])
def test_correlations_equal_numpy(spark, max_lag):
    x, y = np.random.default_rng(7).standard_normal((2, 15_000))
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(15_000), "x": x, "y": y})).union(spark.createDataFrame([(None, 0, 2.0, 3.0)], "k bigint, i bigint, x double, y double"))
    got = windows.autocorrelation(Signal.of(df, ["k"], ["i"], "x"), max_lag, "y").toPandas()
    assert got[got["k"].isna()]["r"].tolist() == [6.0]
    n = 15_000 if max_lag is None else max_lag + 1
    want = np.fft.irfft(np.conj(np.fft.rfft(x, 40_000)) * np.fft.rfft(y, 40_000), 40_000)[:n]
    assert np.allclose(got[got["k"] == 1].sort_values("lag")["r"], want, atol=1e-7)


@pytest.mark.parametrize(
    "t, v, rate, options, want",
    [
        ([0, 50, 200, 350, 500], [1, 2, 3, 4, 5], 10, {}, [1, 7 / 3, 3, 11 / 3, 13 / 3, 5]),
        ([0, 100, 400, 500], [1, 2, 5, 6], 10, {"gap_ms": 200, "gap_policy": "zero-fill"}, [1, 2, 0, 0, 5, 6]),
        ([0, 100, 400, 500], [1, 2, 5, 6], 10, {"gap_ms": 200, "gap_policy": "hold"}, [1, 2, 2, 2, 5, 6]),
        ([0, 100, 400, 500], [1, 3, 5, 6], 10, {"gap_ms": 200, "gap_policy": "extrapolate"}, [1, 3, 5, 7, 5, 6]),
        ([0, 10, 20, 30], [1, 2, 3, 4], 100, {"method": "cubic"}, [1, 2, 3, 4]),
        ([0, 10, 20, 30], [1, 2, 3, 4], 100, {"method": "sinc"}, [1, 2, 3, 4]),
        ([5], [7], 10, {}, [7]),
    ],
)
def test_align(spark, t, v, rate, options, want):
    assert values(resample.align(signal(spark, v, t), rate, **options)) == pytest.approx(want)


def test_align_error_policy(spark):
    with pytest.raises(Exception, match="gap"):
        resample.align(signal(spark, [1, 2], [0, 1000]), 10, gap_policy="error", gap_ms=200).collect()


@pytest.mark.parametrize("up, down", [(1, 4), (3, 1), (3, 2), (4, 6)])
def test_resample_against_stuffing(spark, up, down):
    x = np.random.default_rng(0).standard_normal(50)
    g = math.gcd(up, down)
    u, d = up // g, down // g
    taps = resample.lowpass_taps(21, min(u, d) / (2 * u * d) if u > 1 else 1 / (2 * d), u)
    stuffed = np.zeros(len(x) * u)
    stuffed[::u] = x
    want = np.convolve(stuffed, taps)[: len(stuffed)][d - 1 :: d]
    got = resample.resample(signal(spark, x), up, down, 21)
    assert values(got) == pytest.approx(want.tolist())
    assert values(got, "idx") == list(range(len(want)))


def test_resample_renews_timestamps(spark):
    t = [0, 10, 20, 30, 40, 55]
    ms = lambda df: [(r[0] - pd.Timestamp(0)).total_seconds() * 1000 for r in df.orderBy("idx").select(F.col("ts").cast("timestamp_ntz")).collect()]
    s = signal(spark, range(6), t)
    assert ms(resample.resample(s, 1, 2)) == [0, 20, 40]
    assert ms(resample.resample(s, 2, 1)) == pytest.approx([0, 5, 10, 15, 20, 25, 30, 35, 40, 47.5, 55, 62.5])
    n = 4
    assert ms(resample.resample(s, 2, 3)) == pytest.approx(np.interp(np.arange(n) * 1.5, range(6), t).tolist())
    again = resample.resample(s, 2, 1)
    assert column(Signal.of(again, ["series"], ["idx"], "y", "ts"), F.lit(1.0)) == [1.0] * 12


def test_align_keeps_the_exact_rate(spark):
    t = np.arange(0, 2001, 1000)
    got = resample.align(signal(spark, t / 1000.0, t.tolist()), 44_100)
    assert got.count() == 88_201
    k = np.array(values(got, "t_us", "idx"))
    assert np.abs(k - np.arange(len(k)) * 1e6 / 44_100).max() <= 0.5
    assert np.allclose(values(got, "y", "idx"), k / 1e6)
    assert resample.align(signal(spark, [1, 2], [0, 1]), 4_000_000).count() == 4_001
    st = resample.alignment_statistics(signal(spark, range(4), [0, 10, 20, 50]), 100, 20, "regression").first()
    assert (st.input_samples, st.output_samples, st.span_ms, st.gaps) == (4, 6, 50.0, 1) and st.estimated_rate == pytest.approx(1000 / 16)
    st = resample.alignment_statistics(signal(spark, range(3), [0, 10, 20]), 100, 20, "pll").first()
    assert st.estimated_rate == pytest.approx(1000 / 1.9)


@pytest.mark.parametrize(
    "kernel, width",
    [(K.Ema(0.3), 1), (K.LeakyIntegrator(0.9), 1), (K.Iir((0.2, 0.3, 0.1), (-0.4, 0.2)), 1), (K.Fir((0.5, 0.3, 0.2)), 1), (K.Lms(4, 0.1), 2), (K.Lms(4, 0.1, normalized=True), 2), (K.Rls(4), 2), (K.Kalman(2), 3), (K.Cooldown(3), 1), (K.IntervalPll(), 1)],
)
def test_kernels_are_chunk_invariant(kernel, width):
    x = np.abs(np.random.default_rng(1).standard_normal((60, width)))
    whole, _ = kernel.run(kernel.start(), x)
    state, parts = kernel.start(), []
    for a, b in [(0, 1), (1, 7), (7, 7), (7, 40), (40, 60)]:
        y, state = kernel.run(state, x[a:b])
        parts += [np.asarray(y).reshape(b - a, -1)] if b > a else []
    assert np.allclose(np.concatenate(parts), np.asarray(whole).reshape(60, -1))


def test_adaptive_filters_learn():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(2000)
    d = np.convolve(x, [0.5, -0.3, 0.2])[:2000]
    for k in (K.Lms(3, 0.05), K.Lms(3, 0.5, normalized=True), K.Rls(3, 1.0, 100.0)):
        e, _ = k.run(k.start(), np.column_stack([x, d]))
        assert np.abs(e[-100:]).max() < 1e-2


def test_kalman_starts_at_the_first_measurement(spark):
    df = spark.createDataFrame([("a", 0, 10.0, 20.0), ("a", 1, 10.1, 20.1), ("a", 2, 10.2, 20.2)], "s string, i long, x double, y double")
    got = recursive.kalman(Signal.of(df, ["s"], ["i"], "x"), ["x", "y"]).orderBy("i").first()
    assert (got.kf_x, got.kf_y) == pytest.approx((10.0, 20.0), abs=1e-3)


def test_kalman_equals_the_matrix_form():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.standard_normal((30, 2)).cumsum(0), rng.uniform(0.5, 2, 30)])
    k = K.Kalman(2, 0.01, 0.5, 2.0)
    got, _ = k.run(k.start(), x)
    s, p, h = np.concatenate([x[0, :2], [0, 0]]), np.eye(4) * 2.0, np.hstack([np.eye(2), np.zeros((2, 2))])
    for i, row in enumerate(x):
        f = np.eye(4)
        f[:2, 2:] = np.eye(2) * (row[2] if i else 0)
        s, p = f @ s, f @ p @ f.T + 0.01 * np.eye(4)
        gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + 0.5 * np.eye(2))
        s, p = s + gain @ (row[:2] - h @ s), (np.eye(4) - gain @ h) @ p
        assert np.allclose(got[i], s[:2])


def test_long_series_pass_batches(spark):
    x = np.random.default_rng(3).standard_normal(30_000)
    s = signal(spark, x, series=("a", "b"))
    got = recursive.apply_filter(s, [0.1, 0.2], [-0.5]).where("series = 'b'")
    want, _ = K.Iir((0.1, 0.2), (-0.5,)).run(K.Iir((0.1, 0.2), (-0.5,)).start(), x[:, None])
    assert np.allclose(values(got), want)


def test_designs():
    rate = 1000.0
    for c, low, high in [
        (design.butterworth_lowpass(4, 100, rate), 1, 0),
        (design.chebyshev_lowpass(3, 100, rate), 1, 0),
        (design.fir_lowpass(51, 100, rate), 1, 0),
        (design.butterworth_highpass(3, 100, rate), 0, 1),
        (design.chebyshev_highpass(3, 100, rate), 0, 1),
        (design.fir_highpass(51, 100, rate), 0, 1),
        (design.optimal_lowpass(51, 100, rate, 0.3), 1, 0),
        (design.fir_bandstop(101, 100, 300, rate), 1, 1),
        (design.low_shelf(100, rate, 6.0206), 2, 1),
        (design.high_shelf(100, rate, 6.0206), 1, 2),
    ]:
        assert c.is_stable()
        assert abs(c.response(0, rate)) == pytest.approx(low, abs=2e-2) and abs(c.response(499.99, rate)) == pytest.approx(high, abs=2e-2)
    assert abs(design.butterworth_lowpass(5, 100, rate).response(100, rate)) == pytest.approx(math.sqrt(0.5))
    assert abs(design.chebyshev_lowpass(4, 100, rate, 1.0).response(100, rate)) == pytest.approx(10 ** (-1 / 20))
    assert abs(design.peaking_eq(100, rate, 1, 6).response(100, rate)) == pytest.approx(10 ** (6 / 20))
    assert abs(design.butterworth_bandpass(2, 50, 200, rate).response(100, rate)) > 0.8
    assert abs(design.power_line_notch(rate).response(50, rate)) < 0.3
    assert not design.Coefficients((1.0,), (-1.1,)).is_stable()
    with pytest.raises(ValueError):
        design.butterworth_lowpass(2, 600, rate)
    with pytest.raises(ValueError):
        design.chebyshev_lowpass(2, 100, rate, 4)


@pytest.mark.parametrize("scale", ["mel", "bark", "log", "linear"])
def test_bank_boundaries(scale):
    b = design.bank_boundaries(scale, 8, 0 if scale == "mel" else 20, 4000)
    assert len(b) == 9 and b == sorted(b) and b[-1] == pytest.approx(4000)
    assert len(design.filter_bank(scale, 8, 20, 4000, 16000)) == 8


def test_wavelets_are_orthonormal():
    for p in range(1, 11):
        h = design.daubechies(p)
        assert len(h) == 2 * p and h.sum() == pytest.approx(math.sqrt(2)) and (h * h).sum() == pytest.approx(1, abs=1e-6)
        for k in range(1, p):
            assert (h[2 * k :] * h[: -2 * k]).sum() == pytest.approx(0, abs=1e-6)


def test_transforms_round_trip(spark):
    x = np.random.default_rng(4).standard_normal((5, 15))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, values array<double>")
    df = df.withColumn("z", frames.rfft("values")).withColumn("f", frames.fft("values"))
    df = df.withColumn("back", frames.irfft("z", 15)).withColumn("g", frames.ifft("f")).withColumn("c", frames.idct(frames.dct("values")))
    for r in df.orderBy("i").collect():
        assert np.allclose(r.back, x[r.i]) and np.allclose(r.g.real, x[r.i]) and np.allclose(r.c, x[r.i])
        assert np.allclose(r.z.real, np.fft.rfft(x[r.i]).real)


def test_frames_and_envelope(spark):
    t = np.arange(64)
    s = signal(spark, np.cos(2 * np.pi * t / 8))
    assert frames.frames(s, 10).count() == 6 and frames.frames(s, 16, 4).count() == 13
    env = frames.frames(s, 64).select(F.explode(frames.envelope("values"))).toPandas().iloc[:, 0]
    assert np.allclose(env, 1.0)
    assert np.allclose(values(frames.hilbert_envelope(s, 16, 16), "envelope", "frame_idx"), 1.0)


def test_mel_spectrogram(spark):
    bank = [[0.5, 1, 0.5, 0, 0], [0, 0.5, 1, 0.5, 0], [0, 0, 0.5, 1, 0.5]]
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, [5.0, 4.0, 3.0, 2.0, 1.0])], "i long, spectrum array<double>")
    got = frames.mel_spectrogram(df, bank).orderBy("i").collect()
    assert [list(r.mel) for r in got] == [[4, 6, 8], [8, 6, 4]]
    assert len(frames.mfcc(frames.mel_spectrogram(df, bank), 2).first().mfcc) == 2


def test_entropies(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(0, np.sin(np.arange(200) / 5).tolist()), (1, rng.standard_normal(200).tolist())], "i long, values array<double>")
    a, b = frames.entropies(df).orderBy("i").collect()
    assert a.sample_entropy < b.sample_entropy and a.approximate_entropy < b.approximate_entropy
    s = signal(spark, [1.0] * 8)
    assert windows.shannon_entropy(s).first().entropy == 0
    assert values(windows.entropy_tracker(s, 4)) == [None] * 3 + [0.0] * 5


def test_models(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0.3], [0, 0, 0.5]]) + 5
    df = spark.createDataFrame([(i, i % 2, *map(float, r)) for i, r in enumerate(x)], "i long, label int, a double, b double, c double").repartition(4)
    cols = ["a", "b", "c"]
    m = models.pca(df, cols)
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.values, np.linalg.eigvalsh(np.cov(x.T))[::-1])
    y = m.transform(df).select("y0", "y1", "y2").toPandas().to_numpy()
    assert np.allclose(np.cov(y.T), np.diag(m.values), atol=1e-8)
    w = models.whitening(df, cols, 0.0).transform(df).select("y0", "y1", "y2").toPandas().to_numpy()
    assert np.allclose(np.cov(w.T), np.eye(3), atol=1e-8)
    back = models.Model.load(m.save(spark))
    assert np.allclose(back.matrix, m.matrix) and back.columns == m.columns
    weights, block = models.beamformer(4)
    assert np.allclose(block.T @ weights, 0) and np.allclose(block.T @ block, np.eye(3))
    c = models.csp(df, cols, "label", 0, 1)
    assert np.all((c.values > 0) & (c.values < 1))
    zero = m.transform(df, 1, zero_fill=True).first()
    assert zero.y1 == 0 and zero.y2 == 0


def test_ica_separates(spark):
    t = np.arange(2000)
    sources = np.column_stack([np.sign(np.sin(t / 7)), (t % 50) / 25 - 1])
    x = sources @ np.array([[1, 0.6], [0.4, 1]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, a double, b double")
    y = models.ica(df, ["a", "b"]).transform(df).orderBy("i").select("y0", "y1").toPandas().to_numpy()
    r = np.abs(np.corrcoef(y.T, sources.T)[:2, 2:])
    assert r.max(1).min() > 0.97


def test_layouts(spark):
    df = spark.createDataFrame([("a", i, float(i), float(10 * i)) for i in range(3)], "s string, i long, x double, y double")
    flat = interleave(df, ["s"], ["i"], ["x", "y"])
    assert values(flat, "value") == [0, 0, 1, 10, 2, 20]
    assert [(r.c0, r.c1) for r in deinterleave(flat, ["s"], 2).orderBy("sample").collect()] == [(0, 0), (1, 10), (2, 20)]
    with pytest.raises(Exception, match="multiple"):
        deinterleave(flat.where("idx < 5"), ["s"], 2).collect()
    long = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i long, channel int, value double")
    assert [r.value for r in channels.channel_select(long, [1, 0, 1]).orderBy("channel").collect()] == [2, 1, 2]
    with pytest.raises(ValueError):
        channels.channel_select(long, [2], 2)


def test_timing(spark):
    s = signal(spark, [0] * 5, [1000, 1005, 1020, 1025, 1040])
    m = quality.drift_metrics(s, 100).first()
    assert (m.min_delta, m.max_delta, m.avg_delta, m.events) == (5, 15, 10, 4)
    g = quality.gaps(signal(spark, [0] * 3, [0, 10, 60]), 100).first()
    assert g.delta_ms == 50 and g.expected_samples == 4
    bad = quality.monotonicity(signal(spark, [0] * 4, [0, 20, 10, 10]), "idx").orderBy("idx").collect()
    assert [r.violation for r in bad] == ["backwards", "duplicate"]
    assert quality.sample_rate(signal(spark, [0] * 4, [0, 10, 20, 30])).first().regularity == "excellent"


def test_nulls(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0)], "s string, i long, value double")
    of = lambda how: values(Signal.of(df, ["s"], ["i"], on_null=how).df, "value", "i")
    assert of("drop") == [1, 3] and of("zero") == [1, 0, 3] and of("hold") == [1, 1, 3]
    with pytest.raises(Exception, match="null sample"):
        of("error")
    with pytest.raises(ValueError):
        Signal.of(df, ["s"], ["nowhere"])


def test_pipeline(spark):
    s = signal(spark, [-1, 2, -3, 4])
    seen = []
    p = Pipeline().amplify(gain=2).amplify(gain=3).rectify().tap(lambda df: seen.append(df.count())).moving_average(size=2).ema(alpha=0.5)
    assert [x.name for x in p.optimized().stages] == ["amplify", "rectify", "tap", "moving_average", "ema"]
    assert values(p.run(s), "value") == [6, 7.5, 11.25, 16.125] and seen == [4]
    assert p.describe(spark).count() == 6
    with pytest.raises(ValueError):
        Pipeline().amplify(gain=-1).run(s)
    with pytest.raises(AttributeError):
        Pipeline().nonsense()


def test_windows_share_an_exchange(spark):
    s = signal(spark, [1, 2, 3])
    plan = Pipeline().moving_average(size=2).rms(size=3).run(s)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_logs(spark):
    df = spark.createDataFrame(
        [(i, t, lv, "m", pd.Timestamp(i, unit="s").to_pydatetime()) for i, (t, lv) in enumerate([("pipeline.stage.fft.done", "info"), ("pipeline.error", "error"), ("x", "debug"), ("pipeline.error.deep", "warn")])],
        "i long, topic string, level string, message string, ts timestamp",
    ).withColumn("priority", logs.priority())
    got = logs.Router().errors().stage("fft").custom("urgent", "**", low=8).debug().default().route(df)
    assert sorted((r.i, r.route) for r in got.collect()) == [(0, "default"), (0, "stage-fft"), (1, "default"), (1, "errors"), (1, "urgent"), (2, "default"), (3, "default")]
    assert {r.i for r in df.where(logs.topic_matches("topic", ["pipeline.*"])).collect()} == {1}
    assert {r.i for r in logs.latest(df, ["topic"], ["i"], 1).collect()} == {0, 1, 2, 3}
    text = df.orderBy("i").select(logs.as_text()).first()[0]
    assert text.endswith("INFO pipeline.stage.fft.done: m")
    rows = [r.asDict() for r in df.collect()]
    for sink in ("loki", "prometheus", "pagerduty", "cloudwatch", "datadog", "console"):
        assert logs.payload(sink, rows)
    assert len(logs.traceparent().split("-")) == 4


def test_router_presets(spark):
    topics = ["pipeline.error", "pipeline.fft.error", "pipeline.error.x", "pipeline.performance", "pipeline.a.b.performance", "pipeline.alert", "pipeline.alerts.high", "pipeline.stage.fft.x", "pipeline.stage.fftx.x", "pipeline.debug", "pipeline.debugger", "other"]
    df = spark.createDataFrame([(t, 5) for t in topics], "topic string, priority int")
    met = {}
    for r in logs.Router().errors().performance().stage("fft").alerts().debug().route(df).collect():
        met.setdefault(r.route, []).append(r.topic)
    assert {k: sorted(v) for k, v in met.items()} == {
        "errors": ["pipeline.error", "pipeline.fft.error"],
        "performance": ["pipeline.a.b.performance"],
        "stage-fft": ["pipeline.stage.fft.x"],
        "alerts": ["pipeline.alert", "pipeline.alerts.high"],
        "debug": ["pipeline.debug", "pipeline.debugger"],
    }


def test_levels(spark):
    df = spark.createDataFrame([(i, logs.LEVELS[i % 6]) for i in range(600)], "i int, level string")
    assert df.where(logs.at_least("warn")).count() == 300
    got = {r.level: r["count"] for r in logs.sampled(df, {"info": 0.0, "debug": 0.5}).groupBy("level").count().collect()}
    assert "info" not in got and 20 < got["debug"] < 80 and got["fatal"] == 100
    assert {r[0] for r in df.where("level = 'fatal'").select(logs.severity("syslog")).collect()} == {"0"}


def test_spectral_expressions(spark):
    df = spark.createDataFrame([([0.0, 0.0, 4.0, 0.0], [0.0, 3.0, 0.0, 0.0])], "m array<double>, p array<double>")
    r = df.select(expr.spectral_centroid("m", 8.0), expr.spectral_rolloff("m", 8.0), expr.spectral_flux("m", "p"), expr.peak_frequency("m", 8.0, 8)).first()
    assert tuple(r) == (2.0, 2.0, 5.0, 2.0)


def test_deinterleave_sorts_instead_of_hashing(spark):
    """No hash map of all samples of a task; repeated and null positions of a sample as a grouping has them."""
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0), (None, 0, 5.0), (None, 1, 6.0), ("b", 0, 7.0), ("b", 0, 8.0)], "s string, idx bigint, value double")
    got = deinterleave(df, ["s"], 2)
    assert "HashAggregate" not in got._jdf.queryExecution().toString()
    assert got.columns == ["s", "sample", "c0", "c1"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted([("a", 0, 1.0, 2.0), ("a", 1, None, 4.0), (None, 0, 5.0, 6.0), ("b", 0, 8.0, None)], key=str)
