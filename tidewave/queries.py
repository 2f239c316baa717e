"""Registered queries of the signal operators over the driver's tables, with the SQL that they must equal.

Values are rounded to six places on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import design, expr
from .operators import channels, frames, logs, models, quality, recursive, resample, windows
from .plans import Pipeline
from .sources import Signal, deinterleave, get_channel, interleave, planar_to_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return put


def events(spark: SparkSession, sf_dir: str) -> Signal:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "ts", "value")
    return Signal.of(df, ["user_id"], ["ts", "event_id"], ts="ts")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


LINE = ["l_suppkey", "l_orderkey", "l_linenumber"]
FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def suppliers(spark: SparkSession, sf_dir: str) -> Signal:
    return Signal.of(lineitem(spark, sf_dir), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], value="l_quantity")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("values"))


#: Means of values of two decimals over powers of two lie on ties of rounding; both sides move off them by as much.
OFF_TIE = 1.23e-7


def r6(c: Column | str, name: str = "y") -> Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0).alias(name)


def on_events(name: str, column: Callable[[Signal], Column | DataFrame], sql: str | None, cast: str | None = None):
    """A query (event_id, y) of a column, or of a DataFrame with a column y, over each user's events."""

    def run(spark, sf_dir):
        s = events(spark, sf_dir)
        got = column(s)
        df = got if isinstance(got, DataFrame) else s.df.withColumn("y", got)  # a DataFrame has its column y
        return df.select("event_id", F.col("y").cast(cast).alias("y") if cast else r6(F.col("y") + (OFF_TIE if plain else 0.0)))

    plain = sql is not None and not sql.lstrip().upper().startswith(("SELECT", "WITH"))
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = f"SELECT event_id, round({sql} + {OFF_TIE}::DOUBLE, 6) + 0.0::DOUBLE AS y FROM events" if plain else sql


W = "PARTITION BY user_id ORDER BY ts, event_id"


def rows(k: int) -> str:
    return f"({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


ALL = "(PARTITION BY user_id)"
SPAN = "(PARTITION BY user_id ORDER BY epoch_us(ts::TIMESTAMP) RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
WEEK_MS = 7 * 86_400_000
WEEK = SPAN.format(WEEK_MS * 1000 - 1)

# element-wise
on_events("rectify_full", lambda s: expr.rectify(s.v - 50), "abs(value - 50)")
on_events("rectify_half", lambda s: expr.rectify(s.v - 50, "half"), "greatest(value - 50, 0.0::DOUBLE)")
on_events("square", lambda s: expr.square(s.v), "value * value")
on_events("amplify", lambda s: expr.amplify(s.v, 2.5), "value * 2.5::DOUBLE")
on_events("clip_detection", lambda s: expr.clip_detection(s.v, 80.0), "CASE WHEN abs(value) >= 80 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
on_events("to_decibels", lambda s: expr.to_decibels(s.v, 10.0), "20 * log10(greatest(value, 1e-10::DOUBLE) / 10::DOUBLE)")
on_events(
    "a_weighting",
    lambda s: expr.a_weighting(s.v * 100.0, F.lit(1.0)),
    """CASE WHEN value = 0 THEN 0.0::DOUBLE ELSE 1.2589::DOUBLE * (12194.0::DOUBLE ** 2) * ((value*100)**2)**2 /
       (((value*100)**2 + 20.6::DOUBLE**2) * sqrt(((value*100)**2 + 107.7::DOUBLE**2) * ((value*100)**2 + 737.9::DOUBLE**2)) * ((value*100)**2 + 12194.0::DOUBLE**2)) END""",
)


@query(
    "power_of_two",
    "SELECT event_id, (event_id > 0 AND bit_count(event_id) = 1) AS is_power, (CASE WHEN event_id <= 1 THEN 1 ELSE 1 << length(bin(event_id - 1)) END)::BIGINT AS next_power FROM events",
)
def _(spark, sf):
    return events(spark, sf).df.select("event_id", expr.is_power_of_two("event_id").alias("is_power"), expr.next_power_of_two("event_id").alias("next_power"))


@query(
    "pad_to_power_of_two",
    """WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
       p AS (SELECT user_id, v, (CASE WHEN len(v) <= 1 THEN 1 ELSE 1 << length(bin(len(v) - 1)) END)::BIGINT AS n FROM a)
       SELECT user_id, n AS padded, round(list_sum(v), 6) AS total, 0.0::DOUBLE AS last FROM p WHERE len(v) < n
       UNION ALL SELECT user_id, n, round(list_sum(v), 6), v[-1] FROM p WHERE len(v) = n""",
)
def _(spark, sf):
    s = events(spark, sf)
    a = s.df.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a")).select("user_id", F.transform("a", lambda x: x["value"]).alias("v"))
    p = a.select("user_id", expr.pad_to_power_of_two("v").alias("p"))
    return p.select("user_id", F.size("p").cast("bigint").alias("padded"), r6(F.aggregate("p", F.lit(0.0), lambda x, y: x + y), "total"), F.element_at("p", -1).alias("last"))


@query(
    "peak_frequency",
    "SELECT vec_id, round((list_position(embedding, list_max(embedding)) - 1) * (1000.0::DOUBLE / 126), 6) AS frequency FROM embeddings",
)
def _(spark, sf):
    return vectors(spark, sf).select("vec_id", r6(expr.peak_frequency("values", 1000.0, 126), "frequency"))


# channels
LONG = "SELECT l_suppkey, l_orderkey, l_linenumber, unnest([0, 1, 2, 3]) AS channel, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem"


@query("planar_to_long", LONG)
def _(spark, sf):
    return planar_to_long(lineitem(spark, sf), LINE, FOUR)


@query("channel_selector", f"SELECT * FROM ({LONG}) WHERE channel < 2")
def _(spark, sf):
    return channels.channel_selector(planar_to_long(lineitem(spark, sf), LINE, FOUR), 2)


@query("channel_select", f"SELECT l_suppkey, l_orderkey, l_linenumber, m.o AS channel, value FROM ({LONG}) JOIN (VALUES (0, 3), (1, 1), (2, 3)) m(o, i) ON channel = m.i")
def _(spark, sf):
    return channels.channel_select(planar_to_long(lineitem(spark, sf), LINE, FOUR), [3, 1, 3], 4)


@query("channel_merge", f"SELECT l_suppkey, l_orderkey, l_linenumber, m.o AS channel, value FROM ({LONG}) JOIN (VALUES (0, 0), (1, 0)) m(o, i) ON channel = m.i")
def _(spark, sf):
    return channels.channel_merge(planar_to_long(lineitem(spark, sf), LINE, FOUR), [0, 0], 4)


@query("get_channel", f"SELECT * FROM ({LONG}) WHERE channel = 2")
def _(spark, sf):
    return get_channel(planar_to_long(lineitem(spark, sf), LINE, FOUR), 2)


INTER = """SELECT l_suppkey, i * 2 + c AS idx, v AS value FROM (
    SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i, unnest([0, 1]) AS c, unnest([l_quantity, l_discount]) AS v FROM lineitem)"""


@query("interleave", INTER)
def _(spark, sf):
    return interleave(lineitem(spark, sf), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


@query(
    "deinterleave",
    "SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS sample, l_quantity AS c0, l_discount AS c1 FROM lineitem",
)
def _(spark, sf):
    return deinterleave(interleave(lineitem(spark, sf), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"]), ["l_suppkey"], 2)


# windowed statistics: whole series, rows, time
for _name, _fn, _sql in [
    ("moving_average", windows.moving_average, "avg(value) OVER {w}"),
    ("rms", windows.rms, "sqrt(avg(value * value) OVER {w})"),
    ("mean_absolute_value", windows.mean_absolute_value, "avg(abs(value)) OVER {w}"),
    ("variance", windows.variance, "var_pop(value) OVER {w}"),
    ("z_score", windows.z_score, "CASE WHEN stddev_pop(value) OVER {w} < 1e-6 THEN 0.0::DOUBLE ELSE (value - avg(value) OVER {w}) / stddev_pop(value) OVER {w} END"),
]:
    on_events(_name, lambda s, fn=_fn: fn(s, size=7), _sql.format(w=rows(7)))
    on_events(f"{_name}_time", lambda s, fn=_fn: fn(s, duration_ms=WEEK_MS), _sql.format(w=WEEK))
    on_events(f"{_name}_batch", lambda s, fn=_fn: fn(s), _sql.format(w=ALL))
on_events("rms_time_in_slices", lambda s: windows.in_slices(s, lambda t: windows.rms(t, duration_ms=WEEK_MS), WEEK_MS, 4 * WEEK_MS), SQL["rms_time"].removeprefix("SELECT event_id, round(").removesuffix(f" + {OFF_TIE}::DOUBLE, 6) + 0.0::DOUBLE AS y FROM events"))
on_events("cumulative_average", windows.cumulative_average, f"avg(value) OVER ({W} ROWS UNBOUNDED PRECEDING)")
on_events("large_moving_average", lambda s: windows.large_moving_average(s, 40), f"avg(value) OVER {rows(40)}")
on_events("differentiator", windows.difference, f"value - coalesce(lag(value) OVER ({W}), 0.0::DOUBLE)")
STEPS = f"WITH d AS (SELECT *, coalesce(abs(value - lag(value) OVER ({W})), 0.0::DOUBLE) AS d, lag(value) OVER ({W}) AS x1, lag(value, 2) OVER ({W}) AS x2 FROM events)"
on_events("waveform_length", lambda s: windows.waveform_length(s, 5), f"{STEPS} SELECT event_id, round(sum(d) OVER {rows(5)}, 6) AS y FROM d")
SQL["waveform_length"] = f"{STEPS} SELECT event_id, round(sum(d) OVER {rows(5)}, 6) AS y FROM d"
on_events("slope_sign_changes", lambda s: windows.slope_sign_changes(s, 5, 1.0), "SELECT", "bigint")
SQL["slope_sign_changes"] = f"{STEPS}, f AS (SELECT *, CASE WHEN (x1 - x2) * (x1 - value) > 1 THEN 1 ELSE 0 END AS f FROM d) SELECT event_id, (sum(f) OVER {rows(5)})::BIGINT AS y FROM f"
on_events("willison_amplitude", lambda s: windows.willison_amplitude(s, 5, 10.0), "SELECT", "bigint")
SQL["willison_amplitude"] = f"{STEPS}, f AS (SELECT *, CASE WHEN d > 10 THEN 1 ELSE 0 END AS f FROM d) SELECT event_id, (sum(f) OVER {rows(5)})::BIGINT AS y FROM f"
REG = f"WITH x AS (SELECT *, row_number() OVER ({W})::DOUBLE AS x FROM events), r AS (SELECT *, count(*) OVER {rows(8)} AS n, avg(value) OVER {rows(8)} AS m, regr_slope(value, x) OVER {rows(8)} AS b FROM x)"
for _out, _sql in [("slope", "b"), ("intercept", "m - b * (n - 1) / 2"), ("predictions", "m + b * (n - 1) / 2"), ("residuals", "value - (m + b * (n - 1) / 2)")]:
    on_events(f"linear_regression_{_out}", lambda s, out=_out: windows.linear_regression(s, 8, out), "SELECT")
    SQL[f"linear_regression_{_out}"] = f"{REG} SELECT event_id, round(CASE WHEN n < 2 THEN 0.0::DOUBLE ELSE {_sql} END, 6) + 0.0::DOUBLE AS y FROM r"


LW = "(PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(
    "snr",
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, avg(l_quantity * l_quantity) OVER {LW} AS s, avg(l_tax * l_tax) OVER {LW} AS n FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(CASE WHEN n < 1e-10 THEN 100.0::DOUBLE ELSE greatest(-100.0::DOUBLE, least(100.0::DOUBLE, 10 * log10((s + 1e-10) / (n + 1e-10)))) END, 6) AS y FROM p""",
)
def _(spark, sf):
    s = suppliers(spark, sf)
    return s.df.select("l_orderkey", "l_linenumber", r6(windows.snr(s, "l_quantity", "l_tax", 10)))


@query("vector_sums", "SELECT l_suppkey, round(sum(l_quantity), 4) AS total, round(sum(l_quantity * l_quantity), 4) AS squares, round(sum(l_quantity * l_discount), 4) AS dot FROM lineitem GROUP BY l_suppkey")
def _(spark, sf):
    return windows.vector_sums(suppliers(spark, sf), "l_discount").select("l_suppkey", *[F.round(c, 4).alias(c) for c in ("total", "squares", "dot")])


# analytic
on_events("detrend_constant", lambda s: windows.detrend(s, "constant"), f"value - avg(value) OVER {ALL}")
on_events("detrend_linear", lambda s: windows.detrend(s, "linear"), "SELECT")
SQL["detrend_linear"] = f"WITH i AS (SELECT *, (row_number() OVER ({W}) - 1)::DOUBLE AS i FROM events) SELECT event_id, round(value - (avg(value) OVER {ALL} + coalesce(regr_slope(value, i) OVER {ALL}, 0) * (i - avg(i) OVER {ALL})), 6) + 0.0::DOUBLE AS y FROM i"
on_events("peaks", lambda s: windows.peaks(s, 5, 20.0), "SELECT")
SQL["peaks"] = f"""WITH p AS (SELECT event_id, value, row_number() OVER ({W}) AS n, count(*) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a,
    max(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l, max(value) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r FROM events)
    SELECT event_id, CASE WHEN n > 2 AND a = 2 AND value > l AND value > r AND value >= 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM p"""
NUM = f"n AS (SELECT *, row_number() OVER ({W}) AS i FROM events)"
on_events("spaced_peaks", lambda s: recursive.spaced_peaks(s, 5), "SELECT")
SQL["spaced_peaks"] = f"""WITH RECURSIVE p AS (SELECT *, lag(value) OVER ({W}) AS l, lead(value) OVER ({W}) AS r, row_number() OVER ({W}) AS i FROM events),
    f AS (SELECT *, coalesce(value > l AND value > r AND value >= 0, false) AS hit FROM p),
    c AS (SELECT user_id, event_id, i, hit AS kept, CASE WHEN hit THEN 0 ELSE 1000000 END AS since FROM f WHERE i = 1
          UNION ALL SELECT f.user_id, f.event_id, f.i, f.hit AND c.since + 1 >= 5, CASE WHEN f.hit AND c.since + 1 >= 5 THEN 0 ELSE c.since + 1 END FROM c JOIN f ON f.user_id = c.user_id AND f.i = c.i + 1)
    SELECT event_id, CASE WHEN kept THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM c"""
on_events("ema", lambda s: recursive.ema(s, 0.3), "SELECT")
SQL["ema"] = f"""WITH RECURSIVE {NUM}, e AS (SELECT user_id, event_id, i, value AS y FROM n WHERE i = 1
    UNION ALL SELECT n.user_id, n.event_id, n.i, 0.3::DOUBLE * n.value + 0.7::DOUBLE * e.y FROM e JOIN n ON n.user_id = e.user_id AND n.i = e.i + 1) SELECT event_id, round(y, 6) AS y FROM e"""
on_events("integrator_leaky", lambda s: recursive.integrate(s, 0.9), "SELECT")
SQL["integrator_leaky"] = SQL["ema"].replace("0.3::DOUBLE * n.value + 0.7::DOUBLE * e.y", "n.value + 0.9::DOUBLE * e.y")
on_events("ema_in_slices", lambda s: recursive.scan_sliced(s, recursive.K.Ema(0.3), F.floor(F.unix_micros("ts") / (4000 * WEEK_MS))), "SELECT")
SQL["ema_in_slices"] = SQL["ema"]
on_events("integrator", lambda s: recursive.integrate(s, 1.0), f"sum(value) OVER ({W} ROWS UNBOUNDED PRECEDING)")


@query(
    "autocorrelation",
    f"WITH {NUM} SELECT a.user_id, b.i - a.i AS lag, round(sum(a.value * b.value), 4) AS r FROM n a JOIN n b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 0 AND 20 GROUP BY 1, 2",
)
def _(spark, sf):
    return windows.autocorrelation(events(spark, sf), 20).select("user_id", "lag", F.round("r", 4).alias("r"))


@query(
    "cross_correlation",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i FROM lineitem)
       SELECT a.l_suppkey, b.i - a.i AS lag, round(sum(a.l_quantity * b.l_discount), 4) AS r FROM n a JOIN n b ON a.l_suppkey = b.l_suppkey AND b.i - a.i BETWEEN 0 AND 5 GROUP BY 1, 2""",
)
def _(spark, sf):
    return windows.autocorrelation(suppliers(spark, sf), 5, "l_discount").select("l_suppkey", "lag", F.round("r", 4).alias("r"))


@query(
    "hjorth",
    f"""WITH a AS (SELECT *, lead(value) OVER ({W}) - value AS d1 FROM events), b AS (SELECT *, lead(d1) OVER ({W}) - d1 AS d2 FROM a),
        g AS (SELECT user_id, var_pop(value) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM b GROUP BY user_id)
        SELECT user_id, round(v0, 6) AS activity, round(sqrt(v1 / v0), 6) AS mobility, round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) AS complexity FROM g""",
)
def _(spark, sf):
    return windows.hjorth(events(spark, sf)).select("user_id", *[r6(c, c) for c in ("activity", "mobility", "complexity")])


@query(
    "hjorth_tracker",
    f"""WITH a AS (SELECT *, value - lag(value) OVER ({W}) AS d1, row_number() OVER ({W}) AS i FROM events), b AS (SELECT *, d1 - lag(d1) OVER ({W}) AS d2 FROM a),
        g AS (SELECT event_id, i, var_pop(value) OVER {rows(16)} AS v0, var_pop(d1) OVER {rows(15)} AS v1, var_pop(d2) OVER {rows(14)} AS v2 FROM b)
        SELECT event_id, CASE WHEN i >= 16 THEN round(v0 + 1.23e-7::DOUBLE, 6) END AS activity, CASE WHEN i >= 16 THEN round(sqrt(v1 / v0), 6) END AS mobility,
               CASE WHEN i >= 16 THEN round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) END AS complexity FROM g""",
)
def _(spark, sf):
    return windows.hjorth_tracker(events(spark, sf), 16).select("event_id", r6(F.col("activity") + OFF_TIE, "activity"), r6("mobility", "mobility"), r6("complexity", "complexity"))


ENT = "least(floor((value - lo) / (hi - lo) * {n}), {n} - 1)"


@query(
    "shannon_entropy",
    f"""WITH a AS (SELECT user_id, value, min(value) OVER {ALL} AS lo, max(value) OVER {ALL} AS hi FROM events), b AS (SELECT user_id, {ENT.format(n=32)} AS b, count(*) AS c FROM a GROUP BY 1, 2)
        SELECT user_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0::DOUBLE AS entropy FROM b GROUP BY user_id""",
)
def _(spark, sf):
    return windows.shannon_entropy(events(spark, sf), 32).select("user_id", r6("entropy", "entropy"))


@query(
    "entropy_tracker",
    f"""WITH {NUM}, a AS (SELECT x.event_id, x.i, y.value, min(y.value) OVER (PARTITION BY x.event_id) AS lo, max(y.value) OVER (PARTITION BY x.event_id) AS hi
            FROM n x JOIN n y ON x.user_id = y.user_id AND y.i BETWEEN x.i - 19 AND x.i),
        b AS (SELECT event_id, i, {ENT.format(n=8)} AS b, count(*) AS c FROM a WHERE i >= 20 GROUP BY 1, 2, 3)
        SELECT event_id, round(-sum(c / 20.0::DOUBLE * log2(c / 20.0::DOUBLE)), 6) + 0.0::DOUBLE AS y FROM b GROUP BY event_id
        UNION ALL SELECT event_id, NULL FROM n WHERE i < 20""",
)
def _(spark, sf):
    return windows.entropy_tracker(events(spark, sf), 20, 8).select("event_id", r6("y"))


@query(
    "sample_approximate_entropy",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT vec_id, e, 0.2::DOUBLE * list_aggregate(e, 'stddev_pop') AS tol FROM v),
        p AS (SELECT vec_id, i, j, greatest(abs(e[i] - e[j]), abs(e[i + 1] - e[j + 1])) <= tol AS two, abs(e[i + 2] - e[j + 2]) <= tol AS third FROM t, range(1, 64) a(i), range(1, 64) b(j)),
        c AS (SELECT vec_id, i, count(*) FILTER (two) AS c2, count(*) FILTER (two AND j <= 62) AS b2, count(*) FILTER (two AND third AND j <= 62) AS c3 FROM p GROUP BY 1, 2),
        s AS (SELECT vec_id, sum(c3 - 1) FILTER (i <= 62) AS a, sum(b2 - 1) FILTER (i <= 62) AS b, avg(ln(c2 / 63.0::DOUBLE)) - avg(ln(c3 / 62.0::DOUBLE)) FILTER (i <= 62) AS ae FROM c GROUP BY 1)
        SELECT vec_id, CASE WHEN a > 0 AND b > 0 THEN round(-ln(a::DOUBLE / b), 6) + 0.0::DOUBLE ELSE 'inf'::DOUBLE END AS sample_entropy, round(ae, 6) + 0.0::DOUBLE AS approximate_entropy FROM s""",
)
def _(spark, sf):
    return frames.entropies(vectors(spark, sf)).select("vec_id", r6("sample_entropy", "sample_entropy"), r6("approximate_entropy", "approximate_entropy"))


MAGS = "m AS (SELECT vec_id, k - 1 AS k, abs(embedding[k])::DOUBLE AS m FROM embeddings, range(1, 65) t(k))"


def _mags(spark, sf):
    return vectors(spark, sf).select("vec_id", F.transform("values", F.abs).alias("m"))


@query("spectral_centroid", f"WITH {MAGS} SELECT vec_id, round(sum(k * m) * 1000 / 128 / sum(m), 6) AS y FROM m GROUP BY vec_id")
def _(spark, sf):
    return _mags(spark, sf).select("vec_id", r6(expr.spectral_centroid("m", 1000.0)))


@query(
    "spectral_rolloff",
    f"""WITH {MAGS}, c AS (SELECT vec_id, k, sum(m) OVER (PARTITION BY vec_id ORDER BY k) AS c, sum(m) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t FROM m)
        SELECT vec_id, round(min(k) * 1000.0::DOUBLE / 128, 6) AS y FROM c WHERE c >= 0.85::DOUBLE * t GROUP BY vec_id""",
)
def _(spark, sf):
    return _mags(spark, sf).select("vec_id", r6(expr.spectral_rolloff("m", 1000.0)))


@query(
    "spectral_flux",
    """WITH p AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM embeddings)
       SELECT vec_id, CASE WHEN q IS NULL THEN 0.0::DOUBLE ELSE round(list_distance(list_transform(e, lambda x: abs(x)), list_transform(q, lambda x: abs(x))), 6) END AS y FROM p""",
)
def _(spark, sf):
    from pyspark.sql import Window

    d = vectors(spark, sf).select("vec_id", "label", F.transform("values", F.abs).alias("m"))
    return d.withColumn("p", F.lag("m").over(Window.partitionBy("label").orderBy("vec_id"))).select("vec_id", r6(expr.spectral_flux("m", "p")))


# filters
TAPS = [0.4, 0.3, 0.2, 0.1]
on_events("fir_filter", lambda s: recursive.apply_filter(s, TAPS), " + ".join(f"{h}::DOUBLE * coalesce(lag(value, {k}) OVER ({W}), 0.0::DOUBLE)" for k, h in enumerate(TAPS)))


# closed forms for the SQL, apart from the designs under test: a sinc times Hamming of unit sum; the bilinear second-order Butterworth sections
def closed_sinc(n: int, f: float) -> list[float]:
    h = [2 * f * (1.0 if 2 * k == n - 1 else math.sin(2 * math.pi * f * (k - (n - 1) / 2)) / (2 * math.pi * f * (k - (n - 1) / 2))) * (0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1))) for k in range(n)]
    return [x / math.fsum(h) for x in h]


def closed_butterworth(f: float, high: bool) -> design.Coefficients:
    k = math.tan(math.pi * f)
    norm = 1 / (1 + math.sqrt(2) * k + k * k)
    g = norm if high else k * k * norm
    return design.Coefficients((g, -2 * g if high else 2 * g, g), (2 * (k * k - 1) * norm, (1 - math.sqrt(2) * k + k * k) * norm))


_FIR = design.fir_lowpass(81, 0.1, 1.0)
on_events("fir_filter_long", lambda s: recursive.apply_filter(s, _FIR.b), "SELECT")
SQL["fir_filter_long"] = f"""WITH {NUM}, h AS (SELECT unnest(range(0, {len(_FIR.b)})) AS k, unnest([{', '.join(f'{x!r}::DOUBLE' for x in closed_sinc(81, 0.1))}]) AS h)
    SELECT a.event_id, round(sum(b.value * h.h), 6) + 0.0::DOUBLE AS y FROM n a JOIN n b ON a.user_id = b.user_id AND b.i <= a.i AND a.i - b.i < {len(_FIR.b)} JOIN h ON h.k = a.i - b.i GROUP BY a.event_id"""


def iir_sql(c: design.Coefficients) -> str:
    """Direct form of a second-order filter by recursion over each user's events."""
    b, a = [*c.b, *[0.0] * (3 - len(c.b))], [*c.a, *[0.0] * (2 - len(c.a))]
    f = " + ".join(f"({v!r}::DOUBLE) * {x}" for v, x in zip([*b, *[-v for v in a]], ["n.value", "e.x1", "e.x2", "e.y1", "e.y2"]))
    return f"""WITH RECURSIVE {NUM}, e AS (SELECT user_id, event_id, i, ({b[0]!r}::DOUBLE) * value AS y1, 0.0::DOUBLE AS y2, value AS x1, 0.0::DOUBLE AS x2 FROM n WHERE i = 1
        UNION ALL SELECT n.user_id, n.event_id, n.i, {f}, e.y1, n.value, e.x1 FROM e JOIN n ON n.user_id = e.user_id AND n.i = e.i + 1) SELECT event_id, round(y1, 6) + 0.0::DOUBLE AS y FROM e"""


for _name, _c in {
    "iir_butterworth_lowpass": design.butterworth_lowpass(2, 0.1, 1.0),
    "iir_butterworth_highpass": design.butterworth_highpass(2, 0.1, 1.0),
    "iir_chebyshev_lowpass": design.chebyshev_lowpass(2, 0.1, 1.0),
    "iir_chebyshev_highpass": design.chebyshev_highpass(2, 0.1, 1.0),
    "iir_first_order_lowpass": design.first_order_lowpass(0.1, 1.0),
    "iir_first_order_highpass": design.first_order_highpass(0.1, 1.0),
    "iir_peaking_eq": design.peaking_eq(0.2, 1.0, 1.0, 6.0),
    "iir_low_shelf": design.low_shelf(0.2, 1.0, 6.0),
    "iir_high_shelf": design.high_shelf(0.2, 1.0, 6.0),
}.items():
    on_events(_name, lambda s, c=_c: recursive.apply_filter(s, c.b, c.a), "SELECT")
    SQL[_name] = iir_sql(closed_butterworth(0.1, "high" in _name) if "butterworth" in _name else _c)


def sections_sql(c: design.Coefficients, rows: str = f"{NUM}", key: str = "user_id", out: str = "event_id") -> str:
    """Second-order sections one after the other by recursion; each keeps its last two inputs (x) and outputs (y)."""
    first, names, keep = "value", [], []
    steps, starts = [], []
    for k, part in enumerate(c.parts):
        b, a = [*part.b, *[0.0] * (3 - len(part.b))], [*part.a, *[0.0] * (2 - len(part.a))]
        steps.append((k, b, a))
    inner_start, inner_step = first, "n.value"
    start_cols, step_cols = [], []
    for k, b, a in steps:
        start_cols += [f"{inner_start} AS x1_{k}", f"0.0::DOUBLE AS x2_{k}", f"({b[0]!r}::DOUBLE) * ({inner_start}) AS y1_{k}", f"0.0::DOUBLE AS y2_{k}"]
        now = " + ".join(f"({v!r}::DOUBLE) * {x}" for v, x in zip([*b, *[-v for v in a]], [f"({inner_step})", f"e.x1_{k}", f"e.x2_{k}", f"e.y1_{k}", f"e.y2_{k}"]))
        step_cols += [inner_step, f"e.x1_{k}", now, f"e.y1_{k}"]
        inner_start, inner_step = f"({b[0]!r}::DOUBLE) * ({inner_start})", f"({now})"
    last = len(steps) - 1
    return f"""WITH RECURSIVE {rows}, e AS (SELECT {key}, {out}, i, {', '.join(start_cols)} FROM n WHERE i = 1
        UNION ALL SELECT n.{key}, n.{out}, n.i, {', '.join(step_cols)} FROM e JOIN n ON n.{key} = e.{key} AND n.i = e.i + 1)
        SELECT {key}, {out}, round(y1_{last}, 6) + 0.0::DOUBLE AS y FROM e"""


for _name, _c in {
    "iir_butterworth_lowpass_4": design.butterworth_lowpass(4, 0.1, 1.0),
    "iir_butterworth_highpass_3": design.butterworth_highpass(3, 0.2, 1.0),
    "iir_butterworth_bandpass": design.butterworth_bandpass(2, 0.05, 0.2, 1.0),
    "iir_chebyshev_bandpass": design.chebyshev_bandpass(2, 0.05, 0.2, 1.0),
}.items():
    on_events(_name, lambda s, c=_c: recursive.apply_filter(s, c), "SELECT")
    SQL[_name] = f"SELECT event_id, y FROM ({sections_sql(_c)})"

for _name, _c in {
    "fir_highpass": design.fir_highpass(15, 0.2, 1.0),
    "fir_bandpass": design.fir_bandpass(15, 0.1, 0.3, 1.0),
    "fir_bandstop": design.fir_bandstop(15, 0.1, 0.3, 1.0),
    "fir_optimal": design.optimal_lowpass(15, 0.2, 1.0, 0.3),
}.items():
    on_events(_name, lambda s, c=_c: recursive.apply_filter(s, c), " + ".join(f"({h!r}::DOUBLE) * coalesce(lag(value, {k}) OVER ({W}), 0.0::DOUBLE)" for k, h in enumerate(_c.b)))


#: Users as series, those divisible by five as the one null series.
NULLS = "n AS (SELECT event_id, value, CASE WHEN user_id % 5 <> 0 THEN user_id END AS k, row_number() OVER (PARTITION BY CASE WHEN user_id % 5 <> 0 THEN user_id END ORDER BY ts, event_id) AS i FROM events)"


@query(
    "ema_null_keys",
    f"""WITH RECURSIVE {NULLS}, e AS (SELECT k, event_id, i, value AS y FROM n WHERE i = 1
        UNION ALL SELECT n.k, n.event_id, n.i, 0.3::DOUBLE * n.value + 0.7::DOUBLE * e.y FROM e JOIN n ON n.k IS NOT DISTINCT FROM e.k AND n.i = e.i + 1) SELECT event_id, round(y, 6) AS y FROM e""",
)
def _(spark, sf):
    s = events(spark, sf)
    s = s.with_(s.df.withColumn("k", F.when(F.col("user_id") % 5 != 0, F.col("user_id"))), keys=("k",))
    return recursive.ema(s, 0.3).select("event_id", r6("y"))


@query("convolution_valid", f"SELECT event_id, round(y, 6) + 0.0::DOUBLE AS y FROM (SELECT event_id, value * 0.5::DOUBLE + lead(value) OVER ({W}) * 0.25::DOUBLE - lead(value, 2) OVER ({W}) AS y FROM events) WHERE y IS NOT NULL")
def _(spark, sf):
    return windows.valid_correlation(events(spark, sf), [0.5, 0.25, -1.0]).select("event_id", r6("y"))


@query(
    "filter_bank_boundaries",
    """SELECT s_suppkey, k AS band, round(700.0::DOUBLE * (10.0::DOUBLE ** ((a + (b - a) * k / 12) / 2595.0::DOUBLE) - 1), 4) AS hz
       FROM range(0, 13) t(k), (SELECT s_suppkey, 2595.0::DOUBLE * log10(1 + (100.0::DOUBLE + s_suppkey % 50) / 700) AS a, 2595.0::DOUBLE * log10(1 + (4000.0::DOUBLE + s_suppkey % 900) / 700) AS b FROM supplier)""",
)
def _(spark, sf):
    """Each supplier's own band: twelve bands between its two frequencies."""
    k = F.col("s_suppkey")
    d = spark.read.parquet(f"{sf}/supplier.parquet").select(k, F.posexplode(expr.bank_boundaries("mel", 12, 100.0 + k % 50, 4000.0 + k % 900)).alias("band", "hz"))
    return d.select("s_suppkey", F.col("band").cast("bigint").alias("band"), F.round("hz", 4).alias("hz"))


_BANDS = [design.butterworth_lowpass(2, 0.1, 1.0), design.butterworth_highpass(2, 0.1, 1.0)]


@query("filter_bank", " UNION ALL ".join(f"SELECT event_id, {i}::BIGINT AS out_channel, y FROM ({iir_sql(c)})" for i, c in enumerate(_BANDS)))
def _(spark, sf):
    return recursive.filter_bank(events(spark, sf), _BANDS).select("event_id", "out_channel", r6("y"))


def _pairs(spark, sf):
    return suppliers(spark, sf)


def adaptive_sql(power: str, step: str) -> str:
    """Four taps by recursion over each supplier's rows: weights w, history h (the newest first), running power p."""
    n = "n AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_discount AS v, l_tax AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i FROM lineitem)"
    seen = ["n.v", "e.h0", "e.h1", "e.h2"]
    err = "n.d - (" + " + ".join(f"e.w{k} * {seen[k]}" for k in range(4)) + ")"
    zero = ", ".join([*(f"0.0::DOUBLE AS w{k}" for k in range(4)), *(f"0.0::DOUBLE AS h{k}" for k in range(4))])
    start = f"SELECT l_suppkey, 0::BIGINT AS l_orderkey, 0::BIGINT AS l_linenumber, 0::BIGINT AS i, 0.0::DOUBLE AS y, 0.0::DOUBLE AS p, {zero} FROM (SELECT DISTINCT l_suppkey FROM n)"
    inner = f"SELECT n.*, e.w0, e.w1, e.w2, e.w3, {seen[0]} AS g0, {seen[1]} AS g1, {seen[2]} AS g2, {seen[3]} AS g3, {err} AS err, {power} AS q FROM e JOIN n ON n.l_suppkey = e.l_suppkey AND n.i = e.i + 1"
    after = ", ".join([*(f"w{k} + {step} * err * g{k}" for k in range(4)), "g0", "g1", "g2", "g3"])
    return f"""WITH RECURSIVE {n}, e AS ({start} UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, i, err, q, {after} FROM ({inner}))
        SELECT l_orderkey, l_linenumber, round(y, 6) + 0.0::DOUBLE AS y FROM e WHERE i > 0"""


@query("lms", adaptive_sql("0.0::DOUBLE", "0.05::DOUBLE"))
def _(spark, sf):
    return recursive.lms(_pairs(spark, sf), "l_discount", "l_tax", 4, 0.05).select("l_orderkey", "l_linenumber", r6("y"))


@query("nlms", adaptive_sql("0.99::DOUBLE * e.p + 0.01::DOUBLE * n.v * n.v", "(0.05::DOUBLE / (q * 4 + 1e-6::DOUBLE))"))
def _(spark, sf):
    return recursive.lms(_pairs(spark, sf), "l_discount", "l_tax", 4, 0.05, normalized=True).select("l_orderkey", "l_linenumber", r6("y"))


def rls_sql(forget: float, delta: float, n: int = 4) -> str:
    """Recursive least squares by recursion: weights w, history g (the oldest first), inverse correlations p."""
    rows = "n AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_discount AS v, l_tax AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i FROM lineitem)"
    k = range(n)
    zero = ", ".join([*(f"0.0::DOUBLE AS w{i}" for i in k), *(f"0.0::DOUBLE AS h{i}" for i in k), *(f"{delta if i == j else 0.0}::DOUBLE AS p{i}{j}" for i in k for j in k)])
    start = f"SELECT l_suppkey, 0::BIGINT AS l_orderkey, 0::BIGINT AS l_linenumber, 0::BIGINT AS i, 0.0::DOUBLE AS y, {zero} FROM (SELECT DISTINCT l_suppkey FROM n)"
    keep = ", ".join([*(f"e.w{i}" for i in k), *(f"e.h{i + 1} AS g{i}" for i in k if i + 1 < n), f"n.v AS g{n - 1}", *(f"e.p{i}{j}" for i in k for j in k)])
    one = f"SELECT n.*, {keep} FROM e JOIN n ON n.l_suppkey = e.l_suppkey AND n.i = e.i + 1"
    two = f"SELECT *, d - ({' + '.join(f'w{i} * g{i}' for i in k)}) AS err, {', '.join('(' + ' + '.join(f'p{i}{j} * g{j}' for j in k) + f') AS q{i}' for i in k)} FROM ({one})"
    three = f"SELECT *, {forget}::DOUBLE + {' + '.join(f'g{i} * q{i}' for i in k)} AS den FROM ({two})"
    after = ", ".join([*(f"w{i} + q{i} / den * err" for i in k), *(f"g{i}" for i in k), *(f"(p{i}{j} - q{i} / den * q{j}) / {forget}::DOUBLE" for i in k for j in k)])
    return f"""WITH RECURSIVE {rows}, e AS ({start} UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, i, err, {after} FROM ({three}))
        SELECT l_orderkey, l_linenumber, round(y, 6) + 0.0::DOUBLE AS y FROM e WHERE i > 0"""


@query("rls", rls_sql(0.99, 0.01))
def _(spark, sf):
    return recursive.rls(_pairs(spark, sf), "l_discount", "l_tax", 4).select("l_orderkey", "l_linenumber", r6("y"))


KALMAN = f"""WITH RECURSIVE {NUM}, d AS (SELECT n.*, coalesce((epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER ({W})) / 1e6::DOUBLE, 0.0::DOUBLE) AS dt FROM n),
    z AS (SELECT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS i, value AS place, 0.0::DOUBLE AS v, 1.0::DOUBLE AS c00, 0.0::DOUBLE AS c01, 1.0::DOUBLE AS c11 FROM d WHERE i = 1),
    e AS (SELECT * FROM z UNION ALL
        SELECT user_id, event_id, i, p + m00 / (m00 + 1) * (value - p), v + m01 / (m00 + 1) * (value - p), (1 - m00 / (m00 + 1)) * m00, (1 - m00 / (m00 + 1)) * m01, m11 - m01 / (m00 + 1) * m01
        FROM (SELECT d.user_id, d.event_id, d.i, d.value, e.place + e.v * d.dt AS p, e.v, e.c00 + d.dt * (2 * e.c01 + d.dt * e.c11) + 0.001::DOUBLE AS m00, e.c01 + d.dt * e.c11 AS m01, e.c11 + 0.001::DOUBLE AS m11
              FROM e JOIN d ON d.user_id = e.user_id AND d.i = e.i + 1))
    SELECT event_id, round(place + {OFF_TIE}::DOUBLE, 6) + 0.0::DOUBLE AS y FROM e WHERE i > 0"""


@query("kalman", KALMAN)
def _(spark, sf):
    return recursive.kalman(events(spark, sf), ["value"], 1e-3, 1.0).select("event_id", r6(F.col("kf_value") + OFF_TIE))


# spectra
ANGLE = "2 * pi() * k * n / 64"


@query(
    "rfft_power",
    f"""WITH x AS (SELECT vec_id, n - 1 AS n, embedding[n]::DOUBLE AS v FROM embeddings, range(1, 65) t(n))
        SELECT vec_id, k AS bin, round(sum(v * cos({ANGLE})) ** 2 + sum(v * sin({ANGLE})) ** 2, 6) + 0.0::DOUBLE AS power FROM x, range(0, 33) f(k) GROUP BY 1, 2""",
)
def _(spark, sf):
    return frames.spectrum(vectors(spark, sf)).select("vec_id", F.posexplode("spectrum").alias("bin", "power")).select("vec_id", F.col("bin").cast("bigint").alias("bin"), r6("power", "power"))


@query("fft_round_trip", "SELECT vec_id, k - 1 AS n, round(embedding[k]::DOUBLE, 6) + 0.0::DOUBLE AS v FROM embeddings, range(1, 65) t(k)")
def _(spark, sf):
    d = vectors(spark, sf).withColumn("z", frames.rfft("values")).withColumn("v", frames.irfft("z", 64))
    return d.select("vec_id", F.posexplode("v").alias("n", "v")).select("vec_id", F.col("n").cast("bigint").alias("n"), r6("v", "v"))


@query(
    "stft",
    f"""WITH {NUM}, f AS (SELECT user_id, i - 1 AS i, value, unnest(range(greatest(0, (i - 1 - 9) // 8)::BIGINT, (i - 1) // 8 + 1)) AS frame FROM n),
        g AS (SELECT user_id, frame, i - frame * 8 AS n, value * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i - frame * 8) / 15)) AS v FROM f WHERE i - frame * 8 BETWEEN 0 AND 15),
        c AS (SELECT user_id, frame FROM g GROUP BY 1, 2 HAVING count(*) = 16)
        SELECT user_id, frame AS frame_idx, k AS bin, round(sum(v * cos(2 * pi() * k * n / 16)) ** 2 + sum(v * sin(2 * pi() * k * n / 16)) ** 2, 4) + 0.0::DOUBLE AS power
        FROM g JOIN c USING (user_id, frame), range(0, 9) t(k) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    d = frames.stft(events(spark, sf), 16, 8, "hann", "power").select("user_id", "frame_idx", F.posexplode("spectrum").alias("bin", "p"))
    return d.select("user_id", "frame_idx", F.col("bin").cast("bigint").alias("bin"), (F.round("p", 4) + 0.0).alias("power"))


def closed_triangles(bands: int, bins: int, rate: float) -> list[list[float]]:
    """Triangles between mel-spaced edges from 0 to half the rate, apart from the design under test."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    edge = [700 * (10 ** (top * i / (bands + 1) / 2595) - 1) for i in range(bands + 2)]
    f = [rate / 2 * k / (bins - 1) for k in range(bins)]
    return [[round(max(0.0, min((x - a) / (b - a), (c - x) / (c - b))), 6) for x in f] for a, b, c in zip(edge, edge[1:], edge[2:])]


_BANK = np.round(design.mel_bank(6, 64, 8000.0), 6)
BANK = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in closed_triangles(6, 64, 8000.0)) + "]"
MEL = f"mel AS (SELECT vec_id, b - 1 AS b, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), {BANK}[b]) AS e FROM embeddings, range(1, 7) t(b))"


def _mel(spark, sf):
    return frames.mel_spectrogram(vectors(spark, sf).withColumn("p", F.transform("values", lambda x: x * x)), _BANK, "p")


@query("mel_spectrogram", f"WITH {MEL} SELECT vec_id, b AS band, round(e, 6) + 0.0::DOUBLE AS energy FROM mel")
def _(spark, sf):
    return _mel(spark, sf).select("vec_id", F.posexplode("mel").alias("band", "e")).select("vec_id", F.col("band").cast("bigint").alias("band"), r6("e", "energy"))


@query(
    "mfcc",
    f"""WITH {MEL} SELECT vec_id, k AS coefficient, round((1 + 11 * sin(pi() * k / 22)) * (CASE WHEN k = 0 THEN sqrt(1 / 6.0::DOUBLE) ELSE sqrt(2 / 6.0::DOUBLE) END) * sum(ln(e + 1e-10) * cos(pi() * k * (2 * b + 1) / 12)), 6) + 0.0::DOUBLE AS c
        FROM mel, range(0, 5) t(k) GROUP BY 1, 2""",
)
def _(spark, sf):
    return frames.mfcc(_mel(spark, sf), 5, lifter=22).select("vec_id", F.posexplode("mfcc").alias("k", "c")).select("vec_id", F.col("k").cast("bigint").alias("coefficient"), r6("c", "c"))


#: What the last sample of a 16-sample frame's quadrature is of its samples.
# of 16 samples the last one's quadrature: the discrete Hilbert kernel 2 / 16 * cot(pi n / 16) at odd distances
QUADRATURE = [2 / 16 / math.tan(math.pi * (15 - k) / 16) if (15 - k) % 2 else 0.0 for k in range(16)]
FRAMES16 = "f AS (SELECT user_id, i - 1 AS i, value, unnest(range(greatest(0, (i - 1 - 15 + {hop} - 1) // {hop})::BIGINT, (i - 1) // {hop} + 1)) AS frame FROM n), g AS (SELECT user_id, frame, i - frame * {hop} AS n, value AS v FROM f WHERE i - frame * {hop} BETWEEN 0 AND 15), c AS (SELECT user_id, frame FROM g GROUP BY 1, 2 HAVING count(*) = 16)"


@query(
    "hilbert_envelope",
    f"""WITH {NUM}, {FRAMES16.format(hop=8)}, h AS (SELECT unnest(range(0, 16)) AS n, unnest([{', '.join(f'{x!r}::DOUBLE' for x in QUADRATURE)}]) AS h)
        SELECT user_id, frame AS frame_idx, round(sqrt(max(v) FILTER (n = 15) ** 2 + sum(v * h) ** 2), 6) AS envelope FROM g JOIN c USING (user_id, frame) JOIN h USING (n) GROUP BY 1, 2""",
)
def _(spark, sf):
    return frames.hilbert_envelope(events(spark, sf), 16, 8).select("user_id", "frame_idx", r6("envelope", "envelope"))


@query(
    "haar",
    f"WITH {NUM} SELECT a.user_id, (a.i - 1) // 2 AS idx, round((a.value + b.value) * sqrt(0.5::DOUBLE), 6) AS approx, round((a.value - b.value) * sqrt(0.5::DOUBLE), 6) + 0.0::DOUBLE AS detail FROM n a JOIN n b ON a.user_id = b.user_id AND b.i = a.i + 1 AND a.i % 2 = 1",
)
def _(spark, sf):
    return frames.haar(events(spark, sf)).select("user_id", "idx", r6("approx", "approx"), r6("detail", "detail"))


def dwt_sql(name: str, n: int = 64) -> str:
    """Each coefficient as a weighted sum of a vector's elements, extended by reflection."""
    low, high = frames.wavelet(name)
    k = len(low)
    at = np.pad(np.arange(n), (k - 2 + n % 2, k - 1), mode="symmetric")
    half = (len(at) - k) // 2 + 1
    rows = ", ".join(f"({b * half + j}, {at[2 * j + t] + 1}, {float(f[t])!r}::DOUBLE)" for b, f in enumerate((low, high)) for j in range(half) for t in range(k))
    return f"SELECT vec_id, k, round(sum(embedding[i]::DOUBLE * h), 6) + 0.0::DOUBLE AS c FROM embeddings, (VALUES {rows}) w(k, i, h) GROUP BY 1, 2"


@query("dwt_db4", dwt_sql("db4"))
def _(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(frames.dwt("values", "db4")).alias("k", "c")).select("vec_id", F.col("k").cast("bigint").alias("k"), r6("c", "c"))


@query(
    "dct",
    "SELECT vec_id, k, round((CASE WHEN k = 0 THEN sqrt(1 / 64.0::DOUBLE) ELSE sqrt(2 / 64.0::DOUBLE) END) * sum(embedding[n]::DOUBLE * cos(pi() * k * (2 * n - 1) / 128)), 6) + 0.0::DOUBLE AS c FROM embeddings, range(1, 65) t(n), range(0, 64) f(k) GROUP BY 1, 2",
)
def _(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(frames.dct("values")).alias("k", "c")).select("vec_id", F.col("k").cast("bigint").alias("k"), r6("c", "c"))


@query(
    "spectral_tracker",
    f"""WITH {MAGS}, t AS (SELECT vec_id, k, m, sum(m) OVER (PARTITION BY vec_id ORDER BY k) AS c, sum(m) OVER (PARTITION BY vec_id) AS t FROM m),
        a AS (SELECT vec_id, round(sum(k * m) * 1000 / 128 / sum(m), 6) AS centroid, round(min(k) FILTER (c >= 0.85::DOUBLE * t) * 1000.0::DOUBLE / 128, 6) AS rolloff FROM t GROUP BY vec_id),
        p AS (SELECT vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM embeddings)
        SELECT vec_id, centroid, rolloff, CASE WHEN q IS NULL THEN 0.0::DOUBLE ELSE round(list_distance(list_transform(e, lambda x: abs(x)), list_transform(q, lambda x: abs(x))), 6) END AS flux FROM a JOIN p USING (vec_id)""",
)
def _(spark, sf):
    d = vectors(spark, sf).select("vec_id", "label", F.transform("values", F.abs).alias("spectrum"))
    return frames.spectral_tracker(d, ["label"], 1000.0, "vec_id").select("vec_id", *[r6(c, c) for c in ("centroid", "rolloff", "flux")])


@query(
    "moving_fft",
    f"""WITH {NUM}, {FRAMES16.format(hop=1)}
        SELECT user_id, frame AS frame_idx, k AS bin, round(sqrt(sum(v * cos(2 * pi() * k * n / 16)) ** 2 + sum(v * sin(2 * pi() * k * n / 16)) ** 2), 6) + 0.0::DOUBLE AS magnitude
        FROM g JOIN c USING (user_id, frame), range(0, 9) t(k) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    d = frames.moving_fft(events(spark, sf), 16, 1).select("user_id", "frame_idx", F.posexplode("spectrum").alias("bin", "m"))
    return d.select("user_id", "frame_idx", F.col("bin").cast("bigint").alias("bin"), r6("m", "magnitude"))


@query("batch_fft_distinct", SQL["rfft_power"])
def _(spark, sf):
    d = frames.distinct_spectra(vectors(spark, sf)).select("vec_id", F.posexplode("spectrum").alias("bin", "power"))
    return d.select("vec_id", F.col("bin").cast("bigint").alias("bin"), r6("power", "power"))


# grid
def resample_sql(up: int, down: int, order: int) -> str:
    taps = resample.lowpass_taps(order, min(up, down) / (2 * up * down) if up > 1 else 1 / (2 * down), up)
    return f"""WITH {NUM}, h AS (SELECT unnest(range(0, {len(taps)})) AS k, unnest([{', '.join(f'{x!r}::DOUBLE' for x in taps)}]) AS h),
        o AS (SELECT user_id, i - 1 AS i, unnest(range(0, {up})) AS p FROM n)
        SELECT o.user_id, ((o.i * {up} + o.p + 1) // {down} - 1)::BIGINT AS idx, round(sum(h.h * b.value), 6) + 0.0::DOUBLE AS y
        FROM o JOIN h ON h.k % {up} = o.p JOIN n b ON b.user_id = o.user_id AND b.i - 1 = o.i - (h.k - o.p) // {up}
        WHERE (o.i * {up} + o.p + 1) % {down} = 0 GROUP BY 1, 2"""


for _name, _up, _down in [("decimate", 1, 4), ("interpolate", 3, 1), ("resample", 3, 2)]:
    query(_name, resample_sql(_up, _down, 21))(
        lambda spark, sf, up=_up, down=_down: resample.resample(events(spark, sf), up, down, 21).select("user_id", "idx", r6("y"))
    )

DAY = 86_400_000_000
# each grid point's sample before (or at) it and the next one after that
ALIGN = f"""WITH s AS (SELECT user_id, epoch_us(ts::TIMESTAMP) AS t, value AS v FROM events),
    b AS (SELECT user_id, min(t) AS t0, max(t) AS t9 FROM s GROUP BY user_id),
    g AS (SELECT user_id, unnest(range(0, (t9 - t0 + {DAY} - 1) // {DAY} + 1)) AS idx, t0 FROM b),
    p AS (SELECT user_id, idx, t0 + idx * {DAY} AS g FROM g),
    q AS (SELECT user_id, t, v, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1, lead(v) OVER (PARTITION BY user_id ORDER BY t) AS v1,
          lag(t) OVER (PARTITION BY user_id ORDER BY t) AS tp, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS v0, lead(v, 2) OVER (PARTITION BY user_id ORDER BY t) AS v2 FROM s),
    m AS (SELECT p.user_id, p.idx, p.g, q.*  EXCLUDE (user_id), (p.g - q.t)::DOUBLE / (q.t1 - q.t) AS u FROM p ASOF JOIN q ON p.user_id = q.user_id AND p.g >= q.t)"""
LINEAR = "v + (v1 - v) * u"
GAP = "t1 - t > 3 * 86400000000 AND g > t"
for _method, _policy, _y in [
    ("linear", "interpolate", LINEAR),
    ("cubic", "interpolate", f"CASE WHEN v0 IS NULL OR v2 IS NULL THEN {LINEAR} ELSE v + 0.5::DOUBLE * u * (v1 - v0 + u * (2 * v0 - 5 * v + 4 * v1 - v2 + u * (3 * (v - v1) + v2 - v0))) END"),
    ("linear", "zero-fill", f"CASE WHEN {GAP} THEN 0.0::DOUBLE ELSE {LINEAR} END"),
    ("linear", "hold", f"CASE WHEN {GAP} THEN v ELSE {LINEAR} END"),
    ("linear", "extrapolate", f"CASE WHEN {GAP} THEN CASE WHEN v0 IS NULL THEN v ELSE v + (v - v0) / (t - tp) * (g - t) END ELSE {LINEAR} END"),
]:
    query(
        f"align_{_method}_{_policy.replace('-', '_')}",
        f"{ALIGN} SELECT user_id, idx, g AS t_us, round(CASE WHEN t1 IS NULL OR g = t THEN v ELSE {_y} END, 6) + 0.0::DOUBLE AS y FROM m",
    )(lambda spark, sf, m=_method, p=_policy: resample.align(events(spark, sf), 1 / 86_400, m, p, 3 * 86_400_000.0).select("user_id", "idx", "t_us", r6("y")))


def _sinc_sql() -> str:
    near = ["v_3", "v_2", "v_1", "v", "v1", "v2", "v3", "v4"]
    q = ", ".join([*(f"lag(v, {k}) OVER (PARTITION BY user_id ORDER BY t) AS v_{k}" for k in (1, 2, 3)), *(f"lead(v, {k}) OVER (PARTITION BY user_id ORDER BY t) AS v{k}" for k in (1, 2, 3, 4))])
    d = [f"(u - ({j - 3}))" for j in range(8)]
    weight = [f"(CASE WHEN {x} IS NULL THEN 0.0::DOUBLE ELSE (CASE WHEN abs({d[j]}) < 1e-9 THEN 1.0::DOUBLE ELSE sin(pi() * {d[j]}) / (pi() * {d[j]}) END) * (0.54::DOUBLE + 0.46::DOUBLE * cos(pi() * {d[j]} / 4)) END)" for j, x in enumerate(near)]
    total = " + ".join(f"{w} * coalesce({x}, 0.0::DOUBLE)" for w, x in zip(weight, near))
    norm = " + ".join(weight)
    head = ALIGN[: ALIGN.index("    q AS (")]
    return f"""{head} q AS (SELECT user_id, t, v, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS t1, {q} FROM s),
        m AS (SELECT p.user_id, p.idx, p.g, q.* EXCLUDE (user_id), (p.g - q.t)::DOUBLE / (q.t1 - q.t) AS u FROM p ASOF JOIN q ON p.user_id = q.user_id AND p.g >= q.t)
        SELECT user_id, idx, g AS t_us, round(CASE WHEN t1 IS NULL OR g = t THEN v WHEN abs({norm}) > 1e-9 THEN ({total}) / ({norm}) ELSE {LINEAR} END, 6) + 0.0::DOUBLE AS y FROM m"""


@query("align_sinc", _sinc_sql())
def _(spark, sf):
    return resample.align(events(spark, sf), 1 / 86_400, "sinc").select("user_id", "idx", "t_us", r6("y"))


@query(
    "clock_rate",
    f"WITH i AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM events) SELECT user_id, round(regr_slope(epoch_us(ts::TIMESTAMP)::DOUBLE, i::DOUBLE) / 1e6, 3) AS seconds_per_sample FROM i WHERE i < 100 GROUP BY user_id",
)
def _(spark, sf):
    return resample.clock_rate(events(spark, sf)).select("user_id", F.round(F.col("us_per_sample") / 1e6, 3).alias("seconds_per_sample"))


@query(
    "alignment_statistics",
    f"""WITH {NUM}, d AS (SELECT user_id, i - 1 AS i, epoch_us(ts::TIMESTAMP) AS t, epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER ({W}) AS d FROM n)
        SELECT user_id, count(*) AS input_samples, ceil((max(t) - min(t)) / 86400000000.0::DOUBLE)::BIGINT + 1 AS output_samples, (max(t) - min(t)) / 1000.0::DOUBLE AS span_ms,
               count(*) FILTER (d > 3 * 86400000000) AS gaps, round(1e12 / regr_slope(t::DOUBLE, i::DOUBLE) FILTER (i < 100), 6) AS estimated_rate FROM d GROUP BY user_id""",
)
def _(spark, sf):
    d = resample.alignment_statistics(events(spark, sf), 1 / 86_400, 3 * 86_400_000.0, "regression")
    return d.withColumn("estimated_rate", F.round(F.col("estimated_rate") * 1e6, 6))


PLL = f"""WITH RECURSIVE k AS (SELECT user_id, event_id, (epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER ({W}))::DOUBLE AS d, row_number() OVER ({W}) - 1 AS i FROM events),
    e AS (SELECT user_id, event_id, i, 0.1::DOUBLE * d AS y FROM k WHERE i = 1 UNION ALL SELECT k.user_id, k.event_id, k.i, 0.9::DOUBLE * e.y + 0.1::DOUBLE * k.d FROM e JOIN k ON k.user_id = e.user_id AND k.i = e.i + 1)
    SELECT event_id, round(y / 1e6, 6) AS interval_s FROM e"""


@query("clock_pll", PLL)
def _(spark, sf):
    return resample.clock_pll(events(spark, sf)).select("event_id", r6(F.col("interval_us") / 1e6, "interval_s"))


DELTA = f"d AS (SELECT *, (epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER ({W})) / 1000.0::DOUBLE AS d FROM events)"
HOURS12 = 43_200_000
RATE = 1000.0 / HOURS12


@query("interval_statistics", f"WITH {DELTA} SELECT user_id, count(d) AS intervals, min(d) AS min_ms, max(d) AS max_ms, round(avg(d), 3) AS avg_ms, round(stddev_pop(d), 3) AS std_ms FROM d WHERE d IS NOT NULL GROUP BY user_id")
def _(spark, sf):
    return resample.interval_statistics(events(spark, sf)).select("user_id", "intervals", "min_ms", "max_ms", F.round("avg_ms", 3).alias("avg_ms"), F.round("std_ms", 3).alias("std_ms"))


# timing
@query("drift", f"WITH {DELTA} SELECT event_id, d AS delta_ms, round(abs(d - {HOURS12}), 6) AS drift_ms, round(abs(d - {HOURS12}) / {HOURS12} * 100 + {OFF_TIE}::DOUBLE, 6) AS drift_percent, abs(d - {HOURS12}) / {HOURS12} * 100 > 10 AS is_drift FROM d WHERE d IS NOT NULL")
def _(spark, sf):
    return quality.drift(events(spark, sf), RATE).select("event_id", "delta_ms", r6("drift_ms", "drift_ms"), r6(F.col("drift_percent") + OFF_TIE, "drift_percent"), "is_drift")


@query(
    "drift_metrics",
    f"WITH {DELTA} SELECT user_id, count(*) AS intervals, count(*) FILTER (abs(d - {HOURS12}) / {HOURS12} * 100 > 10) AS events, min(d) AS min_delta, max(d) AS max_delta, round(avg(d), 3) AS avg_delta, round(stddev_pop(d), 3) AS std_delta FROM d WHERE d IS NOT NULL GROUP BY user_id",
)
def _(spark, sf):
    return quality.drift_metrics(events(spark, sf), RATE).select("user_id", "intervals", "events", "min_delta", "max_delta", F.round("avg_delta", 3).alias("avg_delta"), F.round("std_delta", 3).alias("std_delta"))


@query("gaps", f"WITH {DELTA} SELECT event_id, d AS delta_ms, (floor(d / {HOURS12}) - 1)::BIGINT AS expected_samples FROM d WHERE d > 2 * {HOURS12}")
def _(spark, sf):
    return quality.gaps(events(spark, sf), RATE).select("event_id", "delta_ms", "expected_samples")


@query("gap_statistics", f"WITH {DELTA} SELECT user_id, count(*) AS gaps, min(d) AS min_gap, max(d) AS max_gap FROM d WHERE d > 2 * {HOURS12} GROUP BY user_id")
def _(spark, sf):
    return quality.gap_statistics(events(spark, sf), RATE)


@query(
    "monotonicity",
    """WITH d AS (SELECT *, epoch_us(o_orderdate::TIMESTAMP) - lag(epoch_us(o_orderdate::TIMESTAMP)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d FROM orders)
       SELECT o_orderkey, d / 1000.0::DOUBLE AS delta_ms, CASE WHEN d < 0 THEN 'backwards' ELSE 'duplicate' END AS violation FROM d WHERE d <= 0""",
)
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return quality.monotonicity(Signal.of(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "o_orderdate"), "o_orderkey").select("o_orderkey", "delta_ms", "violation")


@query(
    "sample_rate",
    f"""WITH {DELTA}, g AS (SELECT user_id, avg(d) AS a, stddev_pop(d) AS s FROM d WHERE d IS NOT NULL GROUP BY user_id)
        SELECT user_id, round(1e6 / a, 6) AS rate_uhz, round(s / a, 6) AS cv, CASE WHEN s / a < 0.01 THEN 'excellent' WHEN s / a < 0.05 THEN 'good' WHEN s / a < 0.15 THEN 'fair' WHEN s / a < 0.3 THEN 'poor' ELSE 'very poor' END AS regularity FROM g""",
)
def _(spark, sf):
    return quality.sample_rate(events(spark, sf)).select("user_id", r6(F.col("rate") * 1e3, "rate_uhz"), r6("cv", "cv"), "regularity")


# models
COV = [(a, b) for i, a in enumerate(FOUR) for b in FOUR[i:]]


@query("pca_covariance", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) + 0.0::DOUBLE AS c FROM lineitem" for a, b in COV))
def _(spark, sf):
    _, _, cov = models.moments(lineitem(spark, sf), FOUR)
    at = {c: i for i, c in enumerate(FOUR)}
    return spark.createDataFrame([(a, b, float(cov[at[a], at[b]])) for a, b in COV], "a string, b string, c double").select("a", "b", (F.round("c", 4) + 0.0).alias("c"))


@query("pca_transform")
def _(spark, sf):
    d = lineitem(spark, sf)
    return models.pca(d, FOUR).transform(d, 2).select("l_orderkey", "l_linenumber", r6("y0", "y0"), r6("y1", "y1"))


@query("whitening_transform")
def _(spark, sf):
    d = lineitem(spark, sf)
    return models.whitening(d, FOUR).transform(d).select("l_orderkey", "l_linenumber", *[r6(f"y{i}", f"y{i}") for i in range(4)])


@query("ica_transform")
def _(spark, sf):
    d = lineitem(spark, sf)
    return models.ica(d, FOUR, iterations=20).transform(d).select("l_orderkey", "l_linenumber", *[r6(f"y{i}", f"y{i}") for i in range(4)])


@query("csp_transform")
def _(spark, sf):
    d = lineitem(spark, sf)
    return models.csp(d, FOUR, "l_returnflag", "A", "N").transform(d, 2).select("l_orderkey", "l_linenumber", r6("y0", "y0"), r6("y1", "y1"))


@query(
    "matrix_transform",
    "SELECT l_orderkey, l_linenumber, round((l_quantity - 25) * 0.5::DOUBLE + (l_discount - 0.05::DOUBLE) * 2, 6) + 0.0::DOUBLE AS y0, round((l_quantity - 25) * -0.25::DOUBLE + (l_discount - 0.05::DOUBLE) * 4, 6) + 0.0::DOUBLE AS y1 FROM lineitem",
)
def _(spark, sf):
    m = models.Model(("l_quantity", "l_discount"), np.array([25.0, 0.05]), np.array([[0.5, -0.25], [2.0, 4.0]]))
    return m.transform(lineitem(spark, sf)).select("l_orderkey", "l_linenumber", r6("y0", "y0"), r6("y1", "y1"))


#: Covariances of the outputs i <= j; of uncorrelated outputs of variance one.
UNIT = "SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM range(0, 4) a(i), range(0, 4) b(j) WHERE i <= j"


def _covariances(d: DataFrame, scale: float = 1.0) -> DataFrame:
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    one = d.agg(*[F.covar_samp(f"y{i}", f"y{j}").alias(f"c{i}{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"), (F.round(F.col(f"c{i}{j}") * scale, 6) + 0.0).alias("c")) for i, j in pairs])
    return one.select(F.inline(rows))


@query("whitening_identity", UNIT)
def _(spark, sf):
    d = lineitem(spark, sf)
    return _covariances(models.whitening(d, FOUR, 0.0).transform(d))


@query("ica_identity", UNIT)
def _(spark, sf):
    d = lineitem(spark, sf)
    return _covariances(models.ica(d, FOUR, iterations=5).transform(d))


@query("pca_identity", f"SELECT round({' + '.join(f'var_samp({c})' for c in FOUR)}, 2) AS total, 0.0::DOUBLE AS across, true AS ordered FROM lineitem")
def _(spark, sf):
    """The outputs' variances add up to the inputs', fall, and are uncorrelated."""
    d = lineitem(spark, sf)
    y = models.pca(d, FOUR).transform(d)
    v = [F.var_samp(f"y{i}") for i in range(4)]
    across = F.greatest(*[F.abs(F.corr(f"y{i}", f"y{j}")) for i in range(4) for j in range(i + 1, 4)])
    return y.agg(F.round(v[0] + v[1] + v[2] + v[3], 2).alias("total"), (F.round(across, 6) + 0.0).alias("across"), ((v[0] > v[1]) & (v[1] > v[2]) & (v[2] > v[3])).alias("ordered"))


@query("csp_identity", UNIT)
def _(spark, sf):
    """Both classes' covariances of the outputs add up to one on the diagonal and nothing beside it."""
    d = lineitem(spark, sf)
    y = models.csp(d, FOUR, "l_returnflag", "A", "N", 0.0).transform(d)
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    of = lambda i, j, k: F.covar_samp(F.when(F.col("l_returnflag") == k, F.col(f"y{i}")), F.when(F.col("l_returnflag") == k, F.col(f"y{j}")))
    one = y.agg(*[(of(i, j, "A") + of(i, j, "N")).alias(f"c{i}{j}") for i, j in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"), (F.round(f"c{i}{j}", 6) + 0.0).alias("c")) for i, j in pairs])))


_WEIGHTS, _BLOCK = models.beamformer(4)
NOISE = " + ".join(f"({x!r}::DOUBLE) * {c}" for x, c in zip(_BLOCK.sum(1).tolist(), FOUR))


@query("gsc", f"SELECT l_orderkey, l_linenumber, round({NOISE}, 6) + 0.0::DOUBLE AS noise_reference, round((l_quantity + l_extendedprice + l_discount + l_tax) / 2, 6) AS beam FROM lineitem")
def _(spark, sf):
    return models.gsc(lineitem(spark, sf), FOUR, _WEIGHTS, _BLOCK).select("l_orderkey", "l_linenumber", r6("noise_reference", "noise_reference"), r6("beam", "beam"))


# within a series: rows are numbered by a range of series and order, slices of them are partitions
SLICE = 32


def _numbered(spark, sf) -> Signal:
    from .operators import slices

    return slices.numbered(events(spark, sf))


@query("moving_average_in_slices", SQL["moving_average"])
def _(spark, sf):
    from .operators.slices import in_row_slices

    return in_row_slices(_numbered(spark, sf), lambda s: windows.moving_average(s, 7), 6, SLICE).select("event_id", r6(F.col("y") + OFF_TIE))


@query("linear_regression_in_slices", SQL["linear_regression_slope"])
def _(spark, sf):
    from .operators.slices import in_row_slices

    return in_row_slices(_numbered(spark, sf), lambda s: windows.linear_regression(s, 8, "slope"), 7, SLICE).select("event_id", r6("y"))


@query("resample_in_slices", SQL["resample"])
def _(spark, sf):
    from .operators.slices import resample_sliced

    return resample_sliced(_numbered(spark, sf), 3, 2, 21, SLICE).select("user_id", "idx", r6("y"))


@query("autocorrelation_all_lags", SQL["autocorrelation"].replace(" AND b.i - a.i BETWEEN 0 AND 20", " AND b.i >= a.i"))
def _(spark, sf):
    return windows.correlation_tiles(_numbered(spark, sf), tile=SLICE).select("user_id", "lag", F.round("r", 4).alias("r"))


@query("kalman_in_slices", SQL["kalman"])
def _(spark, sf):
    return recursive.kalman_sliced(_numbered(spark, sf), ["value"], 1e-3, 1.0, width=SLICE).select("event_id", r6(F.col("kf_value") + OFF_TIE))


@query(
    "series_entropies",
    f"""WITH {NUM}, t AS (SELECT user_id, count(*) AS samples, 0.2::DOUBLE * stddev_pop(value) AS tol FROM events GROUP BY user_id),
        w AS (SELECT user_id, i, value AS x0, lead(value) OVER (PARTITION BY user_id ORDER BY i) AS x1, lead(value, 2) OVER (PARTITION BY user_id ORDER BY i) AS x2 FROM n),
        p AS (SELECT a.user_id, a.i, b.i AS j, t.samples, greatest(abs(a.x0 - b.x0), abs(a.x1 - b.x1)) <= tol AS two, abs(a.x2 - b.x2) <= tol AS third
              FROM w a JOIN w b USING (user_id) JOIN t USING (user_id) WHERE a.x1 IS NOT NULL AND b.x1 IS NOT NULL AND t.samples >= 4),
        c AS (SELECT user_id, i, samples, count(*) FILTER (two) AS c2, count(*) FILTER (two AND j <= samples - 2) AS b2, count(*) FILTER (two AND third) AS c3 FROM p GROUP BY 1, 2, 3),
        s AS (SELECT user_id, samples, sum(c3 - 1) FILTER (i <= samples - 2) AS a, sum(b2 - 1) FILTER (i <= samples - 2) AS b,
                     avg(ln(c2 / (samples - 1)::DOUBLE)) - avg(ln(c3 / (samples - 2)::DOUBLE)) FILTER (i <= samples - 2) AS ae FROM c GROUP BY 1, 2)
        SELECT user_id, t.samples, CASE WHEN s.samples IS NULL THEN NULL WHEN a > 0 AND b > 0 THEN round(-ln(a::DOUBLE / b), 6) + 0.0::DOUBLE ELSE 'inf'::DOUBLE END AS sample_entropy,
               round(ae, 6) + 0.0::DOUBLE AS approximate_entropy FROM t LEFT JOIN s USING (user_id)""",
)
def _(spark, sf):
    from .operators.entropy import series_entropies

    return series_entropies(_numbered(spark, sf), width=SLICE).select("user_id", "samples", r6("sample_entropy", "sample_entropy"), r6("approximate_entropy", "approximate_entropy"))


# logs and chains
@query(
    "topic_routing",
    """WITH l AS (SELECT event_id, 'events.' || event_type AS topic, CASE WHEN value >= 90 THEN 9 WHEN value >= 70 THEN 7 ELSE 5 END AS priority FROM events)
       SELECT event_id, 'urgent' AS route FROM l WHERE priority BETWEEN 8 AND 10
       UNION ALL SELECT event_id, 'all' FROM l WHERE regexp_matches(topic, '^events\\.[^.]+$')""",
)
def _(spark, sf):
    e = events(spark, sf).df.select("event_id", F.concat(F.lit("events."), "event_type").alias("topic"), F.when(F.col("value") >= 90, "error").when(F.col("value") >= 70, "warn").otherwise("info").alias("level"))
    routed = logs.Router().custom("urgent", "**", low=8).custom("all", "events.*").route(e.withColumn("priority", logs.priority()))
    return routed.select("event_id", "route")


RULES = [("urgent", "**", 8, 10), ("all", "events.*", None, None), ("deep", "events.**.x", 0, 10), ("clicks", "events.click", 5, 7)]


@query(
    "topic_rules_table",
    """WITH l AS (SELECT event_id, 'events.' || event_type AS topic, CASE WHEN value >= 90 THEN 9 WHEN value >= 70 THEN 7 ELSE 5 END AS priority FROM events),
        u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT 'type-' || event_type AS name, 'events.' || event_type AS pattern, 6 AS low FROM (SELECT DISTINCT event_type FROM events))
        SELECT event_id, 'urgent' AS route FROM l WHERE priority >= 8
        UNION ALL SELECT event_id, 'all' FROM l WHERE regexp_full_match(topic, 'events\\.[^.]+')
        UNION ALL SELECT event_id, 'clicks' FROM l WHERE topic = 'events.click' AND priority BETWEEN 5 AND 7
        UNION ALL SELECT event_id, name FROM l JOIN r ON l.topic = r.pattern AND l.priority >= r.low""",
)
def _(spark, sf):
    """Rules as rows: some given, one for each type of event."""
    e = events(spark, sf).df.select("event_id", "event_type", F.concat(F.lit("events."), "event_type").alias("topic"), F.when(F.col("value") >= 90, "error").when(F.col("value") >= 70, "warn").otherwise("info").alias("level"))
    rules = spark.createDataFrame(RULES, "name string, pattern string, low int, high int")
    own = e.select("event_type").distinct().select(F.concat(F.lit("type-"), "event_type").alias("name"), F.concat(F.lit("events."), "event_type").alias("pattern"), F.lit(6).alias("low"), F.lit(None).cast("int").alias("high"))
    return logs.route_by_table(e.withColumn("priority", logs.priority()), rules.unionByName(own)).select("event_id", "route")


@query("log_buffer", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 32")
def _(spark, sf):
    return logs.latest(events(spark, sf).df, ["user_id"], ["ts", "event_id"]).select("event_id")


@query(
    "chain_emg",
    f"""WITH a AS (SELECT *, abs(value - 50) AS x FROM events), b AS (SELECT *, avg(x) OVER {rows(5)} AS m FROM a) SELECT event_id, round(sqrt(avg(m * m) OVER {rows(5)}), 6) AS y FROM b""",
)
def chain(spark, sf):
    s = events(spark, sf)
    s = s.with_(s.df.withColumn("value", F.col("value") - 50))
    return Pipeline().rectify().moving_average(size=5).rms(size=5).run(s).select("event_id", r6("value", "y"))


#: Resampled by 3 / 2 with timestamps on the line between neighbours, then a time window.
CHAIN_RESAMPLE = f"""WITH {resample_sql(3, 2, 21).removeprefix("WITH ").replace("SELECT o.user_id,", ", r AS (SELECT o.user_id,", 1).replace("round(sum(h.h * b.value), 6) + 0.0::DOUBLE AS y", "sum(h.h * b.value) AS y")}),
    t AS (SELECT user_id, i - 1 AS i, epoch_us(ts::TIMESTAMP)::DOUBLE AS t, (lead(epoch_us(ts::TIMESTAMP)) OVER ({W}))::DOUBLE AS t1, (lag(epoch_us(ts::TIMESTAMP)) OVER ({W}))::DOUBLE AS t0 FROM n),
    z AS (SELECT r.user_id, r.idx, r.y, round(t.t + ((r.idx * 2) % 3) / 3.0::DOUBLE * coalesce(t1 - t, t - t0, 0))::BIGINT AS us FROM r JOIN t ON t.user_id = r.user_id AND t.i = (r.idx * 2) // 3)
    SELECT user_id, idx, round(sqrt(avg(y * y) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {WEEK_MS * 1000 - 1} PRECEDING AND CURRENT ROW)) + {OFF_TIE}::DOUBLE, 6) AS y FROM z"""


@query("chain_resample_rms", CHAIN_RESAMPLE)
def _(spark, sf):
    return Pipeline().resample(up=3, down=2, order=21).rms(duration_ms=WEEK_MS).run(events(spark, sf)).select("user_id", "idx", r6(F.col("value") + OFF_TIE))


_BANK9 = np.round(design.mel_bank(4, 9, 2000.0), 6)
BANK9 = ", ".join(f"({b}, {k}, {float(x)!r}::DOUBLE)" for b, row in enumerate(_BANK9) for k, x in enumerate(row))


@query(
    "chain_stft_mel_mfcc",
    f"""WITH {NUM}, {FRAMES16.format(hop=8)}, w AS (SELECT user_id, frame, n, v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 15)) AS v FROM g JOIN c USING (user_id, frame)),
        p AS (SELECT user_id, frame, k, sum(v * cos(2 * pi() * k * n / 16)) ** 2 + sum(v * sin(2 * pi() * k * n / 16)) ** 2 AS p FROM w, range(0, 9) t(k) GROUP BY 1, 2, 3),
        m AS (SELECT user_id, frame, b, sum(p * x) AS e FROM p JOIN (VALUES {BANK9}) f(b, k, x) USING (k) GROUP BY 1, 2, 3)
        SELECT user_id, frame AS frame_idx, q AS coefficient, round((CASE WHEN q = 0 THEN sqrt(1 / 4.0::DOUBLE) ELSE sqrt(2 / 4.0::DOUBLE) END) * sum(ln(e + 1e-10) * cos(pi() * q * (2 * b + 1) / 8)), 6) + 0.0::DOUBLE AS c
        FROM m, range(0, 3) t(q) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    d = Pipeline().stft(size=16, hop=8, window="hann", form="power").mel(bank=_BANK9).mfcc(coefficients=3).run(events(spark, sf))
    return d.select("user_id", "frame_idx", F.posexplode("value").alias("k", "c")).select("user_id", "frame_idx", F.col("k").cast("bigint").alias("coefficient"), r6("c", "c"))


_LOW4 = design.butterworth_lowpass(4, 0.1, 1.0)
ALIGNED = f"{ALIGN.removeprefix('WITH ')}, n AS (SELECT user_id, idx, idx + 1 AS i, CASE WHEN t1 IS NULL OR g = t THEN v ELSE {LINEAR} END AS value FROM m)"


@query("chain_align_filter", sections_sql(_LOW4, ALIGNED, out="idx"))
def _(spark, sf):
    return Pipeline().align(rate=1 / 86_400).filter(b=_LOW4).run(events(spark, sf)).select("user_id", "idx", r6("value", "y"))


@query("chain_kernels", SQL["ema"].replace("round(y, 6) AS y FROM e", "event_id AS same, y FROM e").replace("SELECT event_id, event_id AS same, y FROM e", f", n2 AS (SELECT e.user_id, e.event_id, e.i, e.y AS value FROM e), g AS (SELECT user_id, event_id, i, value AS y FROM n2 WHERE i = 1 UNION ALL SELECT n2.user_id, n2.event_id, n2.i, n2.value + 0.9::DOUBLE * g.y FROM g JOIN n2 ON n2.user_id = g.user_id AND n2.i = g.i + 1) SELECT event_id, round(y + {OFF_TIE}::DOUBLE, 6) AS y FROM g"))
def _(spark, sf):
    """An EMA and a leaky sum in one scan."""
    return Pipeline().ema(alpha=0.3).integrate(alpha=0.9).run(events(spark, sf)).select("event_id", r6(F.col("value") + OFF_TIE))


# streams
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark, sf, build, mode="append"):
    from pyspark.sql.types import _parse_datatype_string

    from .streaming.replay import replay

    return replay(spark, f"{sf}/events.parquet", _parse_datatype_string(EVENTS), lambda d: build(d.withColumn("ts", F.col("ts").cast("timestamp"))), mode)


@query("stream_ema", SQL["ema"])
def _(spark, sf):
    from .functions.kernels import Ema
    from .streaming.stateful import stream

    return _stream(spark, sf, lambda d: stream(d, Ema(0.3), ["user_id"], ["ts", "event_id"], ["value"])).select("event_id", r6("y"))


@query("stream_moving_average", SQL["moving_average"])
def _(spark, sf):
    from .streaming.stateful import RowWindow, stream

    return _stream(spark, sf, lambda d: stream(d, RowWindow(7, np.mean), ["user_id"], ["ts", "event_id"], ["value"])).select("event_id", r6(F.col("y") + OFF_TIE))


@query("stream_moving_average_time", SQL["moving_average_time"])
def _(spark, sf):
    from .streaming.stateful import TimeWindow, stream

    def build(d):
        return stream(d.withColumn("us", F.unix_micros("ts").cast("double")), TimeWindow(WEEK_MS, np.mean), ["user_id"], ["ts", "event_id"], ["value", "us"])

    return _stream(spark, sf, build).select("event_id", r6(F.col("y") + OFF_TIE))


# pipelines on streams: events come in three parts, the stream starts again from its checkpoint for each
WAIT_MS = 3 * 86_400_000


def _stream_pipeline(spark, sf, pipeline: Pipeline, ts: bool = True, arrival: Column | None = None, source: DataFrame | None = None, **how) -> DataFrame:
    from .streaming.replay import replay_in_parts

    df = events(spark, sf).df if source is None else source
    us = F.unix_micros("ts") if arrival is None else arrival
    return replay_in_parts(spark, df, us, lambda d: pipeline.stream(Signal.of(d, ["user_id"], ["ts", "event_id"], ts="ts" if ts else None), **how))


def _emg(s: DataFrame) -> DataFrame:
    return s.withColumn("value", F.col("value") - 50)


@query("stream_chain_emg", SQL["chain_emg"])
def _(spark, sf):
    """``chain_emg`` in one stateful operator."""
    p = Pipeline().apply("centre", _emg).rectify().moving_average(size=5).rms(size=5)
    return _stream_pipeline(spark, sf, p).select("event_id", r6("value"))


@query("stream_chain_kernels", SQL["chain_kernels"])
def _(spark, sf):
    return _stream_pipeline(spark, sf, Pipeline().ema(alpha=0.3).integrate(alpha=0.9)).select("event_id", r6(F.col("value") + OFF_TIE))


@query("stream_stft", SQL["stft"])
def _(spark, sf):
    d = _stream_pipeline(spark, sf, Pipeline().stft(size=16, hop=8, form="power")).select("user_id", "frame_idx", F.posexplode("value").alias("bin", "p"))
    return d.select("user_id", "frame_idx", F.col("bin").cast("bigint").alias("bin"), (F.round("p", 4) + 0.0).alias("power"))


@query("stream_moving_fft", SQL["moving_fft"])
def _(spark, sf):
    d = _stream_pipeline(spark, sf, Pipeline().stft(size=16, hop=1, window="none")).select("user_id", "frame_idx", F.posexplode("value").alias("bin", "m"))
    return d.select("user_id", "frame_idx", F.col("bin").cast("bigint").alias("bin"), r6("m", "magnitude"))


@query("stream_resample", SQL["resample"])
def _(spark, sf):
    return _stream_pipeline(spark, sf, Pipeline().resample(up=3, down=2, order=21), ts=False).select("user_id", "idx", r6("value"))


@query("stream_align_hold", SQL["align_linear_hold"] + " WHERE t1 IS NOT NULL")
def _(spark, sf):
    """The points up to each user's last event; what lies beyond waits for the next."""
    d = _stream_pipeline(spark, sf, Pipeline().align(rate=1 / 86_400, gap_policy="hold", gap_ms=3 * 86_400_000.0))
    return d.select("user_id", "idx", F.unix_micros("ts").alias("t_us"), r6("value"))


@query("stream_out_of_order", SQL["chain_kernels"].replace("FROM events", f"FROM (SELECT * FROM (SELECT *, max(epoch_us(ts::TIMESTAMP)) OVER (PARTITION BY user_id) AS last FROM events) WHERE epoch_us(ts::TIMESTAMP) < last - {WAIT_MS * 1000}) events"))
def _(spark, sf):
    """Events arrive up to three days late, and wait as long: those before each user's last three days have gone on, in order."""
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(WAIT_MS * 1000))
    d = _stream_pipeline(spark, sf, Pipeline().ema(alpha=0.3).integrate(alpha=0.9), arrival=arrival, late_ms=WAIT_MS)
    return d.where("not late").select("event_id", r6(F.col("value") + OFF_TIE))


@query("stream_from_batch", SQL["chain_emg"])
def _(spark, sf):
    """The first half of each user's events as a batch; a stream goes on from its states."""
    p = Pipeline().apply("centre", _emg).rectify().moving_average(size=5).rms(size=5)
    df = events(spark, sf).df
    middle = df.select(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    before = Signal.of(df.where(F.unix_micros("ts") <= middle), ["user_id"], ["ts", "event_id"], ts="ts")
    after = _stream_pipeline(spark, sf, p, source=df.where(F.unix_micros("ts") > middle), initial=p.states(before))
    return p.run(before).unionByName(after).select("event_id", r6("value"))


@query("stream_tumbling", "SELECT user_id, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value) + 1.23e-7::DOUBLE, 6) AS mean, epoch_us(ts::TIMESTAMP) // 86400000000 AS day FROM events GROUP BY user_id, day")
def _(spark, sf):
    from .streaming.stateful import tumbling

    d = _stream(spark, sf, lambda d: tumbling(d, "ts", "1 day", ["user_id"]), "complete")
    return d.select("user_id", "n", "low", "high", r6(F.col("mean") + OFF_TIE, "mean"), F.floor(F.unix_micros("start") / 86_400_000_000).cast("bigint").alias("day"))


@query("stream_hopping", "SELECT user_id, w AS start_day, count(*) AS n, round(avg(value) + 1.23e-7::DOUBLE, 6) AS mean FROM (SELECT user_id, value, unnest([d, d - 1]) AS w FROM (SELECT *, epoch_us(ts::TIMESTAMP) // 86400000000 AS d FROM events)) GROUP BY user_id, w")
def _(spark, sf):
    """Windows of two days that start every day."""
    from .streaming.stateful import tumbling

    d = _stream(spark, sf, lambda d: tumbling(d, "ts", "2 days", ["user_id"], slide="1 day"), "complete")
    return d.select("user_id", F.floor(F.unix_micros("start") / 86_400_000_000).cast("bigint").alias("start_day"), "n", r6(F.col("mean") + OFF_TIE, "mean"))


@query(
    "session_windows",
    f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts::TIMESTAMP) - lag(epoch_us(ts::TIMESTAMP)) OVER ({W}) < 172800000000 THEN 0 ELSE 1 END AS b FROM events),
        s AS (SELECT *, sum(b) OVER ({W}) AS s FROM g) SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""",
)
def _(spark, sf):
    from .streaming.stateful import sessions

    return sessions(events(spark, sf).df, "ts", "2 days", ["user_id"]).select("user_id", "n", F.round("total", 4).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
