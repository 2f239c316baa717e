"""Stages of all kinds one after the other: another grid, frames, channels, models, fused scans, watchers and stream callbacks."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave.functions import design
from tidewave.operators import models, recursive, windows
from tidewave.plans import Pipeline
from tidewave.sources import Signal
from tidewave.streaming.stateful import Callbacks


@pytest.fixture(scope="module")
def s(spark):
    t = pd.date_range("2024-01-01", periods=64, freq="10ms")
    rows = [(k, i, t[i].to_pydatetime(), float(np.sin(i / 3) + i % 5)) for k in ("a", "b") for i in range(64)]
    return Signal.of(spark.createDataFrame(rows, "k string, i bigint, ts timestamp, value double").repartition(3), ["k"], ["i"], ts="ts")


@pytest.mark.parametrize(
    "p, rows",
    [
        (Pipeline().decimate(factor=2).interpolate(factor=2).rms(duration_ms=50), 128),
        (Pipeline().align(rate=200).ema(alpha=0.5).moving_average(duration_ms=30), 254),
        (Pipeline().filter_bank(bands=[design.butterworth_lowpass(2, 0.1, 1.0), design.butterworth_highpass(2, 0.2, 1.0)]).rms(size=2), 256),
        (Pipeline().hilbert(size=8, hop=4).ema(alpha=0.5), 30),
        (Pipeline().wavelet(size=8).flatten().square(), 128),
        (Pipeline().fft(size=8, form="power").flatten().moving_average(size=5), 80),
        (Pipeline().stft(size=16, hop=8, form="power").mel(bank=design.mel_bank(4, 9, 100.0)).mfcc(coefficients=3).flatten().rectify(), 42),
        (Pipeline().kalman().difference().entropy_tracker(size=4), 128),
        (Pipeline().filter(b=design.butterworth_lowpass(4, 0.1, 1.0)).convolve(b=[0.5, 0.5]).integrate(alpha=0.9).detrend(), 128),
        (Pipeline().frames(size=8, hop=4).dct().flatten(), 240),
        (Pipeline().spaced_peaks(distance=3).cumulative_average(), 128),
    ],
)
def test_chains(s, p, rows):
    got = p.run(s).toPandas()
    assert len(got) == rows and np.isfinite(got["value"].fillna(0)).all()
    assert p.describe(s.df.sparkSession).count() == len(p.stages)


def test_a_chain_equals_its_steps(s):
    c = design.butterworth_lowpass(3, 0.1, 1.0)
    got = Pipeline().filter(b=c).ema(alpha=0.3).rms(size=4).run(s)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 2  # one for both kernels, one for the window
    step = s.with_(recursive.apply_filter(s, c, out="f"), value="f")
    step = step.with_(recursive.ema(step, 0.3, "e"), value="e")
    want = step.df.withColumn("w", windows.rms(step, 4))
    assert {(r.k, r.i): r.value for r in got.collect()} == pytest.approx({(r.k, r.i): r.w for r in want.collect()})


def test_wide_stages(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("a", i, *map(float, rng.standard_normal(3))) for i in range(50)], "k string, i bigint, x double, y double, z double")
    w = Signal.of(df, ["k"], ["i"], "x")
    got = Pipeline().transform(model=models.pca(df, ["x", "y", "z"]), components=2, output=1).ema(alpha=0.2).run(w)
    assert {"y0", "y1"} <= set(got.columns) and got.count() == 50
    assert Pipeline().snr(signal="x", noise="y", size=5).run(w).count() == 50
    weights, block = models.beamformer(3)
    assert Pipeline().gsc(columns=["x", "y", "z"], weights=weights, blocking=block).rms(size=3).run(w).count() == 50


def test_selection_moves_only_along_the_channel_key(spark):
    df = spark.createDataFrame([("a", c, i, float(i + 10 * c)) for i in range(4) for c in range(2)], "k string, channel int, i bigint, value double")
    p = Pipeline().moving_average(size=2).channel_select([1])
    whole = Signal.of(df, ["k"], ["i", "channel"])
    by_channel = Signal.of(df, ["k", "channel"], ["i"])
    assert [x.name for x in p.optimized(whole).stages] == ["moving_average", "channel_select"]
    assert [x.name for x in p.optimized(by_channel).stages] == ["channel_select", "moving_average"]
    got = [r.value for r in p.run(whole).orderBy("i").collect()]
    assert got == [5.0, 6.0, 7.0, 8.0]  # of both channels' samples, as asked for
    assert [r.value for r in p.run(by_channel).orderBy("i").collect()] == [10.0, 10.5, 11.5, 12.5]


def test_watchers(s):
    seen = []
    Pipeline().on_stage(lambda name, df: seen.append((name, df.columns))).rectify().ema(alpha=0.5).integrate(alpha=0.9).rms(size=2).run(s)
    assert [n for n, _ in seen] == ["rectify", "integrate", "rms"]


def test_stream_callbacks(spark, tmp_path):
    batches, errors, lines = [], [], []
    cb = Callbacks(batches.append, errors.append, lines.append, ["pipeline.*.performance", "pipeline.error"])
    spark.streams.addListener(cb)
    try:
        spark.range(5).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
        stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        bad = stream.select(F.raise_error(F.lit("broken")).alias("x")).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            bad.awaitTermination()
        end = time.time() + 20
        while time.time() < end and not (batches and errors):
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(cb)
    assert batches[0].numInputRows == 5 and "broken" in errors[0]
    assert {x["topic"] for x in lines} == {"pipeline.batch.performance", "pipeline.error"}
