"""Pipelines on streams: steps cut anywhere equal batch; restarts, state hand-off, rows out of order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave.functions import design, kernels as K, states
from tidewave.plans import Pipeline
from tidewave.sources import Signal
from tidewave.streaming import pieces, pipelines, steps as S

KEYS = "user bigint, n bigint, ts timestamp, value double, other double, tag string"


@pytest.fixture(scope="module")
def table(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(5)
    parts = []
    for user, n in ((1, 90), (2, 41), (3, 7), (None, 30)):
        t = np.datetime64("2024-03-30T22:00:00") + np.cumsum(rng.integers(1, 90_000, n)).astype("timedelta64[ms]")
        parts.append(pd.DataFrame({"user": [user] * n, "n": np.arange(n), "ts": t, "value": rng.standard_normal(n), "other": rng.standard_normal(n), "tag": [f"t{i % 3}" for i in range(n)]}))
    f = pd.concat(parts)
    f["user"] = f["user"].astype("Int64")
    f["ts"] = f["ts"].astype("datetime64[us]")
    return f.reset_index(drop=True)


def frame(spark, f):
    rows = [(None if pd.isna(r.user) else int(r.user), int(r.n), r.ts.to_pydatetime(), float(r.value), float(r.other), r.tag) for r in f.itertuples()]
    return spark.createDataFrame(rows, KEYS)


def signal(df, ts=True):
    return Signal.of(df, ["user"], ["ts", "n"], ts="ts" if ts else None)


class Feed:
    """A folder that a stream reads, one file a micro-batch, and what it has given out."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def put(self, f):
        frame(self.spark, f).coalesce(1).write.mode("append").parquet(self.folder + "/in")

    def run(self, build, check="check", out="out"):
        stream = self.spark.readStream.schema(KEYS).option("maxFilesPerTrigger", 1).parquet(self.folder + "/in")
        df = build(stream)
        q = df.writeStream.format("parquet").option("path", f"{self.folder}/{out}").option("checkpointLocation", f"{self.folder}/{check}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{out}")


def cut(f, at):
    """Rows before and after a share of each series."""
    first = f["n"] < f.groupby("user", dropna=False)["n"].transform("max") * at
    return f[first], f[~first]


def same(got, want, on):
    assert sorted(got.columns) == sorted(want.columns)
    cols = list(got.columns)
    a, b = (df.select(*cols).toPandas().sort_values(on).reset_index(drop=True) for df in (got, want))
    assert len(a) == len(b)
    for c in cols:
        if len(a) and isinstance(a[c].iloc[0], (list, np.ndarray)):
            assert np.allclose(np.stack(a[c]), np.stack(b[c]), atol=1e-9)
        elif a[c].dtype.kind == "f":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-9, equal_nan=True), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


BANK = design.mel_bank(4, 9, 16.0, 0.0, 8.0) if hasattr(design, "mel_bank") else np.eye(4, 9)
CHAINS = {
    "windows": Pipeline().rectify().moving_average(size=5).square().rms(duration_ms=200_000).z_score(size=9).amplify(gain=2.0),
    "kernels": Pipeline().ema(alpha=0.3).integrate(alpha=0.9).filter(b=design.butterworth_lowpass(4, 0.2, 1.0)).difference().cumulative_average(),
    "features": Pipeline().waveform_length(size=4).slope_sign_changes(size=6).linear_regression(size=5, output="residuals"),
    "adaptive": Pipeline().lms(x="value", desired="other", taps=3, mu=0.05).kalman().variance(size=3).willison_amplitude(size=4, threshold=0.01),
    "frames": Pipeline().moving_average(size=2).stft(size=16, hop=4, form="power").mel(bank=BANK).mfcc(coefficients=3),
    "moving_fft": Pipeline().stft(size=8, hop=1, window="none"),
    "hilbert": Pipeline().hilbert(size=8, hop=3).moving_average(size=2),
    "flat": Pipeline().frames(size=6, hop=9).flatten().ema(alpha=0.5),
}


@pytest.mark.parametrize("name", CHAINS)
def test_chains_equal_batch(spark, table, tmp_path, name):
    """Three micro-batches with a restart between; one state store."""
    p, feed = CHAINS[name], Feed(spark, tmp_path)
    a, rest = cut(table, 0.3)
    b, c = cut(rest, 0.8)
    feed.put(a)
    feed.run(lambda df: p.run(signal(df)))
    feed.put(b)
    feed.put(c)
    got = feed.run(lambda df: p.run(signal(df)))
    batch = frame(spark, table)
    order = [c for c in ("user", "n", "frame_idx", "idx") if c in got.columns]
    same(got, p.run(signal(batch)), order)
    stores = spark.read.format("statestore").option("stateVarName", "state").load(f"{feed.folder}/check")
    assert stores.select("key").distinct().count() == table["user"].nunique(dropna=False)


@pytest.mark.parametrize("up, down, ts", [(3, 2, False), (1, 3, True), (3, 2, True), (4, 1, True), (2, 7, True)])
def test_resampling_equals_batch(spark, table, tmp_path, up, down, ts):
    """Without timestamps, and where times lie before their samples, all rows; else all but those of the last sample."""
    p, feed = Pipeline().resample(up=up, down=down, order=11).moving_average(size=2), Feed(spark, tmp_path)
    for part in (*cut(table, 0.5),):
        feed.put(part)
    got = feed.run(lambda df: p.run(signal(df, ts)))
    want = p.run(signal(frame(spark, table), ts))
    if ts and up > down:
        last = want.groupBy("user").agg(F.count("*").alias("c"))
        n = got.groupBy("user").count()
        gone = {r.user: r.c for r in last.collect()}
        assert all(0 <= gone[r.user] - r["count"] <= up for r in n.collect())
        want = want.join(n.withColumnRenamed("user", "u"), F.col("user").eqNullSafe(F.col("u"))).where("idx < count").drop("u", "count")
    same(got, want, ["user", "idx"])


@pytest.mark.parametrize("policy", ["interpolate", "hold", "zero-fill", "extrapolate"])
def test_alignment_equals_batch(spark, table, tmp_path, policy):
    """All points but those past the last sample."""
    p, feed = Pipeline().align(rate=0.05, gap_policy=policy, gap_ms=60_000).ema(alpha=0.5), Feed(spark, tmp_path)
    again = table.copy()
    again.loc[again["n"] == 5, "ts"] = again.loc[again["n"] == 4, "ts"].to_numpy()  # a time that repeats
    for part in (*cut(again, 0.5),):
        feed.put(part)
    got = feed.run(lambda df: p.run(signal(df)))
    want = p.run(signal(frame(spark, again)))
    n = got.groupBy("user").count().withColumnRenamed("user", "u")
    kept = want.join(n, F.col("user").eqNullSafe(F.col("u"))).where("idx < count").drop("u", "count")
    assert want.count() - kept.count() <= 2 * 4
    same(got, kept, ["user", "idx"])


STEPS = [
    S.Window("variance", 7), S.Window("mean", None, 3000), S.Cumulative(), S.Difference(), S.Marks("turns", 4), S.Marks("turns", 4, any_=True), S.Marks("length", 3), S.Regression(6, "intercept"),
    S.Kernel(K.Cooldown(3)), S.Timed(K.Kalman(1)), S.Frames(5, 7), S.Frames(8, 2, lambda x: np.abs(np.fft.rfft(x))), S.Resample.of(5, 3, 9), S.Align(700.0, "hold", 2500),
]


@pytest.mark.parametrize("step", STEPS, ids=lambda s: type(s).__name__)
def test_steps_are_cut_anywhere(step):
    """Also one sample at a time, with the state as bytes between."""
    rng = np.random.default_rng(2)
    x, us = rng.standard_normal(60), np.cumsum(rng.integers(1, 3000, 60))
    whole, _ = step.run(step.start(), S.Rows(x, us, np.arange(60)))
    for cuts in ([0, 1, 2, 17, 18, 60], list(range(61))):
        state, parts = step.start(), []
        for a, b in zip(cuts, cuts[1:]):
            r, state = step.run(states.unpack(states.pack(state)), S.Rows(x[a:b], us[a:b], np.arange(b - a)))
            parts.append(r)
        assert np.allclose(np.concatenate([r.value for r in parts]), whole.value, atol=1e-12)
        if whole.index is not None:
            assert np.concatenate([r.index for r in parts]).tolist() == whole.index.tolist()


def test_state_layout():
    x = (None, 1.5, -3, np.arange(6.0).reshape(2, 3), np.array([1, -(2**40)]), (), b"ab", (np.zeros(0), (True,)))
    y = states.unpack(states.pack(x))
    assert y[:3] == x[:3] and (y[3] == x[3]).all() and y[3].shape == (2, 3) and y[4].tolist() == x[4].tolist() and y[5:7] == ((), b"ab") and y[7][1] == (1,)
    for bad in (b"", b"TW2n", states.pack(1.0) + b"x"):
        with pytest.raises(ValueError):
            states.unpack(bad)
    with pytest.raises(TypeError):
        states.pack({"a": 1})


def test_batch_states_go_on_in_a_stream(spark, table, tmp_path):
    """Batch to the middle, stream to the end: one pass. The stream's own states go on in another stream."""
    p = Pipeline().ema(alpha=0.2).moving_average(duration_ms=100_000).stft(size=8, hop=3, form="power")
    a, rest = cut(table, 0.4)
    b, c = cut(rest, 0.8)
    batch = lambda f: signal(frame(spark, f))
    first = p.states(batch(a))
    one, two = Feed(spark, tmp_path / "one"), Feed(spark, tmp_path / "two")
    one.put(b)
    got = one.run(lambda df: p.stream(signal(df), initial=first))
    saved = pipelines.saved_states(spark, one.folder + "/check", ["user"])
    listed = {r.user: (r.steps, r.waiting) for r in pipelines.describe_states(saved).collect()}
    assert len(listed) == table["user"].nunique(dropna=False) and all(x == (3, 0) for x in listed.values())
    two.put(c)
    got = p.run(batch(a)).unionByName(got).unionByName(two.run(lambda df: p.stream(signal(df), initial=saved)))
    same(got, p.run(batch(table)), ["user", "frame_idx"])


def test_reset_starts_a_series_anew(spark, table, tmp_path):
    f = table[table["user"] == 1].copy()
    f["tag"] = np.where(f["n"].isin([20, 60]), "again", "on")
    feed, p = Feed(spark, tmp_path), Pipeline().integrate(alpha=0.9)
    for part in cut(f, 0.5):
        feed.put(part)
    got = feed.run(lambda df: p.stream(signal(df.withColumn("again", F.col("tag") == "again")), reset="again")).orderBy("n").toPandas()["value"].to_numpy()
    x = f["value"].to_numpy()
    k = K.LeakyIntegrator(0.9)
    assert np.allclose(got, np.concatenate([k.run(k.start(), x[a:b, None])[0] for a, b in ((0, 20), (20, 60), (60, len(x)))]))


def test_rows_out_of_order(spark, table, tmp_path):
    """Shuffled within the wait, a stream equals the sorted table; later rows are told apart; the state holds the wait's rows only."""
    f = table[table["user"].isin([1, 2])].copy()
    rng = np.random.default_rng(3)
    arrives = f["ts"] + pd.to_timedelta(rng.integers(0, 150_000, len(f)), unit="ms")
    shuffled = f.loc[arrives.sort_values().index]
    late = f[(f["user"] == 1) & (f["n"] == 2)]
    shuffled = shuffled.drop(late.index)
    end = f.groupby("user").tail(1).assign(ts=lambda x: x["ts"] + pd.Timedelta(days=1), n=10_000)
    p, feed = Pipeline().rectify().moving_average(size=4).integrate(alpha=0.9), Feed(spark, tmp_path)
    thirds = np.array_split(np.arange(len(shuffled)), 3)
    for k, at in enumerate(thirds):
        feed.put(shuffled.iloc[at])
        feed.run(lambda df: p.stream(signal(df), late_ms=150_000))
        held = pipelines.saved_states(spark, feed.folder + "/check", ["user"]).toPandas()
        assert (held["waiting"] < 20_000).all()
    feed.put(pd.concat([late, end]))
    got = feed.run(lambda df: p.stream(signal(df), late_ms=150_000))
    assert got.where("late").select("user", "n").collect() == [(1, 2)]
    want = p.run(signal(frame(spark, f.drop(late.index))))
    same(got.where("not late").drop("late"), want, ["user", "n"])
    write = pipelines.split_late(str(tmp_path / "kept"), str(tmp_path / "late"))
    write(got, 0)
    assert spark.read.parquet(str(tmp_path / "late")).count() == 1 and "late" not in spark.read.parquet(str(tmp_path / "kept")).columns


def test_expressions_stay_columns_and_what_cannot_stream_is_refused(spark, tmp_path, table):
    Feed(spark, tmp_path).put(table)
    df = spark.readStream.schema(KEYS).parquet(str(tmp_path / "in"))
    before, plan, after = pipelines.compile_(Pipeline().rectify().ema(alpha=0.1).square().rms(size=2).amplify(gain=3.0).stages, signal(df))
    assert ([s.name for s in before], len(plan.steps), [s.name for s in after]) == (["rectify"], 3, ["amplify"])
    for p in (Pipeline().moving_average(), Pipeline().detrend(), Pipeline().peaks(), Pipeline().align(rate=1.0, method="cubic"), Pipeline().stft(size=4).ema(alpha=0.1), Pipeline().ema(alpha=0.1).mel(bank=BANK), Pipeline().ema(alpha=0.1).square().rms(size=0)):
        with pytest.raises(ValueError):
            p.run(signal(df))


def test_rows_go_through_a_processor_in_pieces(spark, table):
    """One value for the rows of a series in a partition, so that a call does not cost by the row; rows, nulls and types come back as they were."""
    df = frame(spark, table).withColumn("more", F.create_map(F.lit("a"), F.struct(F.col("n"), F.array("tag"))))
    made = pieces.gathered(df, ["user"], pieces.to_arrow_schema(df.schema))
    assert made.count() == table["user"].nunique(dropna=False)
    text = lambda d: sorted(map(str, d.collect()))
    assert text(pieces.spread(made.select(pieces.ROWS), df.schema)) == text(df)
    b = pieces.ordered(pieces.pa.record_batch({"k": [3, None, 1, 3], "n": [1, 2, 3, 0]}), ["k", "n"])
    assert b.to_pydict() == {"k": [1, 3, 3, None], "n": [3, 0, 1, 2]}
