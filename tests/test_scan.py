"""Sequential stages: keys with nulls, columns passed through, one exchange, states handed on, stable filters of high order."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import design, kernels as K
from tidewave.operators import recursive
from tidewave.sources import Signal


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    """A null series, a long above 2**53 beside nulls, a timestamp beyond 2262."""
    rows = [(k, i, float(i), 9007199254740993 if i % 2 else None, datetime.datetime(3000, 1, 1)) for k in (None, 1, 2) for i in range(6)]
    return spark.createDataFrame(rows, "k bigint, i bigint, value double, big bigint, t timestamp").repartition(3)


def test_null_keys_are_one_series_and_other_columns_stay(odd):
    s = Signal.of(odd, ["k"], ["i"])
    got = recursive.ema(s, 0.5).orderBy("k", "i").collect()
    want, _ = K.Ema(0.5).run(K.Ema(0.5).start(), np.arange(6.0)[:, None])
    assert [r.y for r in got] == pytest.approx(want.tolist() * 3)
    assert {r.big for r in got} == {None, 9007199254740993} and {r.t.year for r in got} == {3000}
    two = recursive.ema(Signal.of(odd.withColumn("s", F.when(F.col("k") == 1, "a")), ["s", "k"], ["i"]), 0.5)
    assert sorted(r.y for r in two.collect()) == pytest.approx(sorted(want.tolist() * 3))


def test_bank_has_one_exchange(odd):
    bands = design.filter_bank("mel", 24, 20, 20_000, 44_100, order=4)
    df = recursive.filter_bank(Signal.of(odd, ["k"], ["i"]), bands)
    assert plan(df).count("Exchange hashpartitioning") == 1 and df.count() == 18 * 24


def test_states_go_on(odd):
    s = Signal.of(odd, ["k"], ["i"])
    for kernel, inputs in ((K.Iir((0.1, 0.2), (-0.5, 0.2)), None), (K.Lms(3, 0.1), ["value", "i"])):
        whole = {(r.k, r.i): r.y for r in recursive.scan(s, kernel, inputs).collect()}
        states = recursive.last_states(s.with_(s.df.where("i < 4")), kernel, inputs)
        late = recursive.scan(s.with_(s.df.where("i >= 4")), kernel, inputs, states=states)
        assert late.columns == [*s.df.columns, "y"]
        got = {(r.k, r.i): r.y for r in late.collect()}
        assert len(got) == 6 and got == pytest.approx({k: whole[k] for k in got})
    w = {r.k: r.weights for r in recursive.weights(states).collect()}
    assert set(w) == {None, 1, 2} and all(len(x) == 3 for x in w.values())
    fixed = K.Lms(3, adapt=False, weights=tuple(w[1]))
    e, _ = fixed.run(fixed.start(), np.array([[1.0, 2.0]]))
    assert e[0] == pytest.approx(2.0 - w[1][0])


@pytest.mark.parametrize("kernel", [K.Ema(0.1), K.LeakyIntegrator(0.99), K.Iir((0.2, 0.3), (-0.9, 0.2)), recursive.filter_kernel(design.butterworth_lowpass(5, 0.05, 1.0)), K.Chain((K.Ema(0.5), K.Fir((0.5, 0.25, 0.25)), K.IntervalPll()))])
def test_slices_of_a_series_equal_one_scan(spark, kernel):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(v)) for k in ("a", None) for i, v in enumerate(rng.standard_normal(400) + 3)]
    s = Signal.of(spark.createDataFrame(rows, "k string, i bigint, value double").repartition(4), ["k"], ["i"])
    whole = {(r.k, r.i): r.y for r in recursive.scan(s, kernel).collect()}
    sliced = recursive.scan_sliced(s, kernel, (F.col("i") / 37).cast("int"))
    assert sliced.columns == [*s.df.columns, "y"]
    assert {(r.k, r.i): r.y for r in sliced.collect()} == pytest.approx(whole)


def test_only_linear_kernels_are_sliced(odd):
    with pytest.raises(ValueError, match="linear"):
        recursive.scan_sliced(Signal.of(odd, ["k"], ["i"]), K.Lms(3), F.lit(1), ["value", "i"])


def sequential(f, a):
    y = []
    for i, v in enumerate(f):
        y.append(v - sum(c * y[i - 1 - k] for k, c in enumerate(a) if i > k))
    return np.array(y)


@pytest.mark.parametrize("a", [(), (-1.0,), (-0.5,), (-1.2, 0.5), (0.3, -0.2, 0.1)])
def test_blocks_equal_the_plain_recurrence(a):
    f = np.random.default_rng(0).standard_normal(1000)
    got, past = K.recur(f, a, (0.0,) * len(a))
    assert np.allclose(got, sequential(f, a)) and past == pytest.approx(tuple(got[::-1][: len(a)]))
    f[500] = np.nan
    got, _ = K.recur(f, a, (0.0,) * len(a))
    assert np.isfinite(got[:500]).all() and np.isnan(got[500])


@pytest.mark.parametrize("order", range(1, 9))
def test_high_orders_are_stable(order):
    x = np.random.default_rng(1).standard_normal(100_000)[:, None]
    made = [design.butterworth_lowpass(order, 20, 16_000), design.butterworth_highpass(order, 20, 16_000), design.butterworth_bandpass(order, 20, 40, 16_000), design.chebyshev_bandpass(order, 20, 40, 16_000)]
    for c in made:
        k = recursive.filter_kernel(c)
        y, _ = k.run(k.start(), x)
        assert c.is_stable() and np.abs(y).max() < 20
    assert abs(made[0].response(20, 16_000)) == pytest.approx(np.sqrt(0.5), rel=1e-6) and abs(made[1].response(20, 16_000)) == pytest.approx(np.sqrt(0.5), rel=1e-6)
    for scale in ("mel", "bark", "log", "linear"):
        assert all(c.is_stable() for c in design.filter_bank(scale, 24, 20, 20_000, 44_100, order=order))


def test_unstable_filters_are_refused(odd):
    with pytest.raises(ValueError, match="unstable"):
        recursive.apply_filter(Signal.of(odd, ["k"], ["i"]), [1.0], [-1.1])
