"""Kalman filters in slices, adaptive filters side by side, rules as a table."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import kernels as K
from tidewave.operators import logs, recursive, slices
from tidewave.sources import Signal


@pytest.mark.parametrize("dims", [1, 2])
def test_digests_of_kalman_filters(dims):
    """Digests of any cuts, joined in any grouping, lead to the states of one pass."""
    rng = np.random.default_rng(dims)
    x = np.column_stack([rng.standard_normal((400, dims)).cumsum(0), np.append(0.0, rng.exponential(2.0, 399))])
    k = K.Kalman(dims, 1e-3, 0.5)
    state = K.first_state(k, x)
    for cuts in ([0, 400], [0, 1, 2, 130, 131, 400]):
        at, e = state, None
        for a, b in zip(cuts, cuts[1:]):
            d = k.digest(x[a:b])
            e = d if e is None else k.join(e, d)
            at = k.after(at, d)
            want = K.flat(k.run(k.start(), x[:b])[1])
            assert np.allclose(K.flat(at), want, atol=1e-9) and np.allclose(K.flat(k.after(state, e)), want, atol=1e-9)


@pytest.mark.parametrize("ts, width", [(True, 7), (False, 100)])
def test_kalman_in_slices(spark, ts, width):
    i = F.col("id")
    df = spark.range(1200).select(
        F.when(i < 1000, "a").when(i < 1199, "b").alias("k"), i.alias("n"), F.timestamp_micros(i * 1_000_000 + F.pmod(F.xxhash64("id"), F.lit(900_000))).alias("ts"),
        F.sin(i / 50.0).alias("lat"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 500.0).alias("value"),
    )
    s = Signal.of(df.repartition(4), ["k"], ["ts", "n"], ts="ts" if ts else None)
    got = recursive.kalman_sliced(slices.numbered(s, 4), ["value", "lat"], 1e-4, 0.1, width=width).orderBy("n").toPandas()
    want = recursive.kalman(s, ["value", "lat"], 1e-4, 0.1).orderBy("n").toPandas()
    for c in ("kf_value", "kf_lat"):
        assert np.allclose(got[c], want[c], atol=1e-9)


@pytest.mark.parametrize("kernel", [K.Lms(4, 0.05), K.Lms(3, 0.1, 0.2, True), K.Rls(3), K.Lms(2, adapt=False, weights=(0.5, -1.0))], ids=str)
def test_adaptive_filters_side_by_side(spark, kernel, monkeypatch):
    """Many series of different lengths equal each by itself; weights and states in and out."""
    monkeypatch.setattr(recursive, "GATHER", 700)
    rng = np.random.default_rng(3)
    rows = [(k if k else None, i, float(a), float(b)) for k in range(60) for i, (a, b) in enumerate(rng.standard_normal((rng.integers(1, 40) if k else 500, 2)))]
    df = spark.createDataFrame(rows, "k bigint, i bigint, x double, d double")
    s = Signal.of(df, ["k"], ["i"], value="x")
    got = recursive.scan(s, kernel, ["x", "d"]).toPandas()
    states = {r.k: recursive.unpack(bytes(r.state)) for r in recursive.last_states(s, kernel, ["x", "d"]).collect()}
    for k, g in got.sort_values("i").groupby("k", dropna=False):
        y, end = kernel.run(kernel.start(), g[["x", "d"]].to_numpy())
        key = None if k != k else int(k)
        assert np.allclose(g["y"], y, atol=1e-10) and np.allclose(states[key][0], end[0], atol=1e-10)
    # each series starts from weights of its own
    own = df.select("k").distinct().withColumn("weights", F.array(*[F.coalesce(F.col("k"), F.lit(-1)) / (10.0 + j) for j in range(kernel.taps)]))
    got = recursive.scan(s, kernel, ["x", "d"], states=recursive.states_of_weights(own, ["k"], kernel)).toPandas()
    for k, g in got.sort_values("i").groupby("k", dropna=False):
        w = np.array([(-1 if k != k else k) / (10.0 + j) for j in range(kernel.taps)])
        assert np.allclose(g["y"], kernel.run((w, *kernel.start()[1:]), g[["x", "d"]].to_numpy())[0], atol=1e-10)
    with pytest.raises(Exception, match="a weight for each tap"):
        recursive.states_of_weights(own.withColumn("weights", F.array(F.lit(1.0))), ["k"], K.Lms(3)).collect()


def test_parameters_are_checked():
    for make in (lambda: K.Lms(4, leak=1.0), lambda: K.Lms(4, leak=-0.1), lambda: K.Rls(4, delta=0.0), lambda: K.Kalman(1, process=-1.0), lambda: K.Kalman(1, measure=0.0)):
        with pytest.raises(ValueError):
            make()


def test_long_convolutions_equal_direct():
    rng = np.random.default_rng(9)
    for taps, n in ((128, 128), (200, 5000), (4096, 9000), (300, 301)):
        b, x = tuple(rng.standard_normal(taps)), rng.standard_normal(n)
        k = K.Fir(b)
        got, state = [], k.start()
        for part in np.array_split(x, 3) if taps != 4096 else [x]:
            y, state = k.run(state, part[:, None])
            got.append(y)
        assert np.allclose(np.concatenate(got), np.convolve(x, b)[:n], atol=1e-9) and np.allclose(state[0], np.concatenate([np.zeros(taps), x])[-(taps - 1) :])
    x[50] = np.inf
    assert np.isfinite(K.Fir(b).run(K.Fir(b).start(), x[:, None])[0][:50]).all()


def test_rules_as_a_table(spark):
    rng = random.Random(11)
    segment = lambda: rng.choice(["a", "b", "c", "", "x*", "*"])
    topics = {".".join(segment() for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"", "a", ".", "a..b", "**.a"}
    patterns = {".".join(rng.choice(["a", "b", "*", "**", "", "x*"]) for _ in range(rng.randint(1, 4))) for _ in range(150)} | {"*", "**", "a.**", "**.b", "a.**.b", ""}
    rows = [(i, t, rng.randint(0, 10)) for i, t in enumerate(sorted(topics))] + [(999, None, 5)]
    rules = [(f"r{i}", p, rng.choice([None, 0, 4]), rng.choice([None, 5, 10])) for i, p in enumerate(sorted(patterns))] + [("none", None, 0, 10), ("r0", sorted(patterns)[0], 0, 10)]
    df = spark.createDataFrame(rows, "id bigint, topic string, priority int")
    got = logs.route_by_table(df, spark.createDataFrame(rules, "name string, pattern string, low int, high int"))
    want = [(i, n) for i, t, p in rows for n, q, lo, hi in rules if t is not None and q is not None and re.search(logs.topic_regex(q).replace("$", r"\Z"), t) and (lo or 0) <= p <= (10 if hi is None else hi)]
    assert sorted((r.id, r.route) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ten_thousand_rules(spark):
    rules = spark.range(10_000).select(F.concat(F.lit("r"), "id").alias("name"), F.concat(F.lit("svc."), F.col("id") % 500, F.lit(".*."), F.floor(F.col("id") / 500), F.when(F.col("id") % 7 == 0, ".**").otherwise("")).alias("pattern"), F.lit(None).cast("int").alias("low"), F.lit(9).alias("high"))
    rows = spark.range(3000).select("id", F.concat(F.lit("svc."), F.col("id") % 500, F.lit(".host."), F.col("id") % 20, F.when(F.col("id") % 2 == 0, ".a.b").otherwise("")).alias("topic"), F.lit(5).alias("priority"))
    got = logs.route_by_table(rows, rules).toPandas()
    want = {(i, f"r{j}") for i in range(3000) for j in (i % 500 + 500 * (i % 20),) if (j % 7 == 0) == (i % 2 == 0)}
    assert set(zip(got["id"], got["route"])) == want
