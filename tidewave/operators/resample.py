"""Stages that change the grid: decimation, interpolation, resampling, alignment of irregular timestamps."""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.design import window
from ..sources.signal import Signal


def lowpass_taps(order: int, cutoff: float, gain: float = 1.0) -> list[float]:
    """Hamming-windowed sinc with ``order`` taps (made odd) and a cutoff in cycles a sample; its sum is ``gain``."""
    n = order + 1 - order % 2
    m = np.arange(n) - n // 2
    h = 2 * cutoff * np.sinc(2 * cutoff * m) * window("hamming", n)
    return [float(x) for x in h / h.sum() * gain]


def _numbered(s: Signal) -> DataFrame:
    return s.df.withColumn("_i", (F.row_number().over(s.window()) - 1).cast("bigint"))


def decimate(s: Signal, factor: int, order: int = 51, out: str = "y") -> DataFrame:
    """Low-pass, then every factor-th sample (the last of each group): rows (keys, idx, y)."""
    return resample(s, 1, factor, order, out)


def interpolate(s: Signal, factor: int, order: int = 51, out: str = "y") -> DataFrame:
    """factor samples for each by polyphase filters: rows (keys, idx, y)."""
    return resample(s, factor, 1, order, out)


def resample(s: Signal, up: int, down: int, order: int = 51, out: str = "y", index: str | None = None) -> DataFrame:
    """The rate times up / down: rows (keys, idx, y), and before y, if the signal has timestamps, that column renewed.

    Sample i of the input stands for positions i * up to i * up + up - 1; of these only the positions p with p + 1 a multiple of ``down``
    are computed, each as a weighted sum of lags, so the input is sorted once and no zero is stuffed. Output n has the time at n * down / up
    samples from the start, on the line between neighbouring timestamps (past the end, on the last line). ``index`` names a column with the
    samples' numbers, unless they are to be counted.
    """
    if up < 1 or down < 1:
        raise ValueError("factors are positive")
    g = gcd(up, down)
    up, down = up // g, down // g
    taps = lowpass_taps(order, min(up, down) / (2 * up * down) if up > 1 else 1 / (2 * down), up)
    w = s.window()
    depth = -(-len(taps) // up)
    before = (1 - down) // up  # the time of a position lies between this many samples from its own and two more
    times = [F.unix_micros(F.lag(F.col(s.ts), -k).over(w) if k <= 0 else F.lead(F.col(s.ts), k).over(w)).cast("double") for k in range(before - 1, before + 3)] if s.ts else []
    lagged = (_numbered(s) if index is None else s.df.withColumn("_i", F.col(index))).select(
        *s.keys, "_i", F.array(*[F.coalesce(F.lag(s.v, k).over(w), F.lit(0.0)) if k else s.v for k in range(depth)]).alias("_x"), F.array(*times).cast("array<double>").alias("_t")
    )
    first = F.pmod(-1 - F.col("_i") * up, F.lit(down)).cast("int")  # the first phase that stays
    each = lagged.where(first < up).withColumn("_p", F.explode(F.sequence(first, F.lit(up - 1), F.lit(down))))
    table = F.array(*[F.array(*[F.lit(c) for c in taps[p::up]]) for p in range(up)])
    rows = each.select(*s.keys, "_i", "_x", "_t", "_p", F.get(table, F.col("_p")).alias("_h"))
    y = F.lit(0.0)
    for k in range(depth):
        y = y + F.get("_x", F.lit(k)) * F.coalesce(F.get("_h", F.lit(k)), F.lit(0.0))
    position = F.col("_i") * up + F.col("_p")
    idx = ((position + 1) / down - 1).cast("bigint").alias("idx")
    if not s.ts:
        return rows.select(*s.keys, idx, y.alias(out))
    place = F.col("_p") + 1 - down  # of the time, from the sample's own position
    low = F.floor(place / up).cast("int")
    near = lambda k: F.get("_t", low + k - (before - 1))
    step = F.coalesce(near(1) - near(0), near(0) - near(-1), F.lit(0.0))
    ts = F.timestamp_micros(F.round(near(0) + F.pmod(place, F.lit(up)) / up * step).cast("bigint")).alias(s.ts)
    return rows.select(*s.keys, idx, ts, y.alias(out))


#: Grid points of an interval that are made at a time.
PIECE = 4096
GAPS = ("interpolate", "error", "zero-fill", "hold", "extrapolate")


def align(s: Signal, rate: float, method: str = "linear", gap_policy: str = "interpolate", gap_ms: float | None = None, out: str = "y") -> DataFrame:
    """Samples on a uniform grid from each series' first timestamp: rows (keys, idx, t_us, y).

    method: linear, cubic (Catmull-Rom over four samples, linear at the ends and with fewer) or sinc (eight samples, Hamming).
    In an interval longer than ``gap_ms`` the policy holds: interpolate, error, zero-fill, hold, or extrapolate by the slope before.

    Each interval between neighbours makes its own grid points, so a sample is sorted once and nothing is joined; the points of a long
    gap come from pieces of a bounded size. Point k lies k / rate after the first timestamp, rounded to a microsecond by itself.
    A timestamp that repeats keeps its last sample.
    """
    if method not in ("linear", "cubic", "sinc") or gap_policy not in GAPS or not rate > 0:
        raise ValueError("unknown method, gap policy or rate")
    dt = 1e6 / rate
    dt = float(round(dt)) if abs(dt - round(dt)) < 1e-9 * dt else dt
    base = s.df.select(*s.keys, F.unix_micros(F.col(s.ts)).alias("_t"), s.v.alias("_v"), *[c for c in s.order if c not in s.keys])
    again = Window.partitionBy(*s.keys).orderBy(*s.order)
    base = base.withColumn("_next", F.lead("_t").over(again)).where("_next is null or _next <> _t").select(*s.keys, "_t", "_v")
    w = Window.partitionBy(*s.keys).orderBy("_t")
    whole = Window.partitionBy(*s.keys)
    at = lambda c, k: F.lag(c, -k).over(w) if k <= 0 else F.lead(c, k).over(w)
    reach = 4 if method == "sinc" else 2
    df = base.select(
        *s.keys, "_t", "_v", F.lead("_t").over(w).alias("_t1"), F.lead("_v").over(w).alias("_v1"), F.lag("_t").over(w).alias("_t0"), F.lag("_v").over(w).alias("_v0"),
        F.min("_t").over(whole).alias("_first"), F.max("_t").over(whole).alias("_last"),
        F.array(*[at("_v", k) for k in range(1 - reach, reach + 1)]).alias("_near"),
    )
    # the points k whose rounded time is in [t, t1), and at the end the point that reaches the last sample
    low = F.greatest(F.ceil((F.col("_t") - F.col("_first") - 0.5) / dt), F.lit(0)).cast("bigint")
    last_k = F.ceil((F.col("_last") - F.col("_first")) / dt).cast("bigint")
    high = F.when(F.col("_t1").isNull(), last_k).otherwise(F.ceil((F.col("_t1") - F.col("_first") - 0.5) / dt).cast("bigint") - 1)
    df = df.withColumn("_low", low).withColumn("_high", high).where("_high >= _low")
    piece = lambda c: F.floor(F.col(c) / PIECE).cast("bigint")
    df = df.withColumn("_piece", F.explode(F.sequence(piece("_low"), piece("_high"))))
    df = df.withColumn("idx", F.explode(F.sequence(F.greatest(F.col("_low"), F.col("_piece") * PIECE), F.least(F.col("_high"), F.col("_piece") * PIECE + PIECE - 1))))
    df = df.withColumn("t_us", F.col("_first") + F.floor(F.col("idx") * dt + 0.5).cast("bigint"))
    u = (F.col("t_us") - F.col("_t")) / (F.col("_t1") - F.col("_t"))
    v, v1 = F.col("_v"), F.col("_v1")
    linear = v + (v1 - v) * u
    if method == "cubic":
        a, d = F.get("_near", F.lit(0)), F.get("_near", F.lit(3))
        cubic = v + 0.5 * u * (v1 - a + u * (2 * a - 5 * v + 4 * v1 - d + u * (3 * (v - v1) + d - a)))
        y = F.when(a.isNull() | d.isNull(), linear).otherwise(cubic)
    elif method == "sinc":
        y = _sinc(u, linear)
    else:
        y = linear
    if gap_ms is not None and gap_policy != "interpolate":
        slope = F.when(F.col("_t0").isNull(), 0.0).otherwise((v - F.col("_v0")) / (F.col("_t") - F.col("_t0")))
        filled = {
            "error": F.raise_error(F.lit("a gap")).cast("double"),
            "zero-fill": F.lit(0.0),
            "hold": v,
            "extrapolate": v + slope * (F.col("t_us") - F.col("_t")),
        }[gap_policy]
        y = F.when((F.col("_t1") - F.col("_t") > round(gap_ms * 1000)) & (F.col("t_us") > F.col("_t")), filled).otherwise(y)
    return df.select(*s.keys, "idx", "t_us", F.when(F.col("_t1").isNull() | (F.col("t_us") == F.col("_t")), v).otherwise(y).alias(out))


def _sinc(u: Column, linear: Column) -> Column:
    """Eight neighbours weighted by sinc times Hamming, the weights normalised; missing neighbours are left out."""
    total, norm = F.lit(0.0), F.lit(0.0)
    for j in range(8):
        d = u - (j - 3)
        x = F.get("_near", F.lit(j))
        sinc = F.when(F.abs(d) < 1e-9, 1.0).otherwise(F.sin(np.pi * d) / (np.pi * d))
        weight = F.when(x.isNull(), 0.0).otherwise(sinc * (0.54 + 0.46 * F.cos(np.pi * d / 4)))
        total = total + weight * F.coalesce(x, F.lit(0.0))
        norm = norm + weight
    return F.when(F.abs(norm) > 1e-9, total / norm).otherwise(linear)


def clock_rate(s: Signal, first: int = 100) -> DataFrame:
    """Drift compensation by regression: microseconds a sample from the first timestamps of each series."""
    n = _numbered(s).where(F.col("_i") < first)
    return n.groupBy(*s.keys).agg(F.regr_slope(F.unix_micros(F.col(s.ts)).cast("double"), F.col("_i").cast("double")).alias("us_per_sample"))


def clock_pll(s: Signal, weight: float = 0.1, out: str = "interval_us") -> DataFrame:
    """Drift compensation by a loop: a running average of intervals, from zero."""
    from ..functions.kernels import IntervalPll
    from .recursive import scan

    us = F.unix_micros(F.col(s.ts))
    d = s.df.withColumn("_d", (us - F.lag(us).over(s.window())).cast("double")).where("_d is not null")
    return scan(s.with_(d), IntervalPll(weight), ["_d"], [out]).drop("_d")


def interval_statistics(s: Signal) -> DataFrame:
    us = F.unix_micros(F.col(s.ts))
    d = s.df.withColumn("_d", (us - F.lag(us).over(s.window())) / 1000.0).where("_d is not null")
    return d.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("intervals"), F.min("_d").alias("min_ms"), F.max("_d").alias("max_ms"), F.avg("_d").alias("avg_ms"), F.stddev_pop("_d").alias("std_ms"))


def alignment_statistics(s: Signal, rate: float, gap_ms: float, drift: str = "none", first: int = 100) -> DataFrame:
    """What ``align`` meets in each series: (keys, input_samples, output_samples, span_ms, gaps, estimated_rate).

    drift: none, regression (a line through the first timestamps) or pll (a running average of the first intervals, from zero).
    """
    if drift not in ("none", "regression", "pll"):
        raise ValueError("drift is none, regression or pll")
    us = F.unix_micros(F.col(s.ts))
    d = _numbered(s).withColumn("_us", us).withColumn("_d", us - F.lag(us).over(s.window()))
    early = F.col("_i") < first
    slope = F.regr_slope(F.when(early, F.col("_us") - F.lit(0)).cast("double"), F.when(early, F.col("_i")).cast("double"))
    # the loop's value after n intervals: a weighted sum of them, the latest with 0.1
    inside = (F.col("_i") >= 1) & (F.col("_i") <= first)
    n = F.max(F.when(inside, F.col("_i")))
    terms = F.sort_array(F.collect_list(F.when(inside, F.struct("_i", "_d"))))
    loop = F.aggregate(terms, F.lit(0.0), lambda a, x: 0.1 * x["_d"] + 0.9 * a)
    interval = {"none": F.lit(None).cast("double"), "regression": slope, "pll": F.when(n.isNotNull(), loop)}[drift]
    span = F.max("_us") - F.min("_us")
    return d.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("input_samples"),
        (F.ceil(span / (1e6 / rate)).cast("bigint") + 1).alias("output_samples"),
        (span / 1000.0).alias("span_ms"),
        F.sum((F.col("_d") > round(gap_ms * 1000)).cast("bigint")).alias("gaps"),
        (1e6 / interval).alias("estimated_rate"),
    ).withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("bigint"))
