"""Windowed statistics and analytic stages as Catalyst window functions.

All take a Signal and return a Column over its rows, so that several share one exchange and sort.
A stage without size and duration works on the whole series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.signal import Signal


def _frame(s: Signal, size, duration_ms):
    return s.whole() if size is None and duration_ms is None else s.frame(size, duration_ms)


def moving_average(s: Signal, size: int | None = None, duration_ms: float | None = None) -> Column:
    return F.avg(s.v).over(_frame(s, size, duration_ms))


def rms(s: Signal, size: int | None = None, duration_ms: float | None = None) -> Column:
    return F.sqrt(F.avg(s.v * s.v).over(_frame(s, size, duration_ms)))


def mean_absolute_value(s: Signal, size: int | None = None, duration_ms: float | None = None) -> Column:
    return F.avg(F.abs(s.v)).over(_frame(s, size, duration_ms))


def variance(s: Signal, size: int | None = None, duration_ms: float | None = None) -> Column:
    return F.var_pop(s.v).over(_frame(s, size, duration_ms))


def z_score(s: Signal, size: int | None = None, duration_ms: float | None = None, epsilon: float = 1e-6) -> Column:
    w = _frame(s, size, duration_ms)
    sd = F.stddev_pop(s.v).over(w)
    return F.when(sd < epsilon, 0.0).otherwise((s.v - F.avg(s.v).over(w)) / sd)


def cumulative_average(s: Signal) -> Column:
    return F.avg(s.v).over(s.window().rowsBetween(Window.unboundedPreceding, 0))


def in_slices(s: Signal, column, duration_ms: float, width_ms: float, out: str = "y") -> DataFrame:
    """``column`` (a function of a Signal, such as a time window's mean) over the last ``duration_ms``, parallel within a series.

    A series is cut into slices of ``width_ms``, at least the duration; samples of the last duration before a slice are copied into it and
    dropped after, so each slice is a partition of its own and a series with a third of all rows spreads over tasks.
    """
    d, w = round(duration_ms * 1000), round(width_ms * 1000)
    if not s.ts or not 1 <= d <= w:
        raise ValueError("slices need timestamps and are as wide as the duration at least")
    us = F.unix_micros(F.col(s.ts))
    own = F.floor(us / w).cast("bigint")
    parts = F.when(us + d - 1 >= (own + 1) * w, F.array(own, own + 1)).otherwise(F.array(own))
    rows = s.df.select("*", own.alias("_own"), F.explode(parts).alias("_part"))
    t = s.with_(rows, keys=(*s.keys, "_part"))
    return rows.withColumn(out, column(t)).where("_own = _part").drop("_own", "_part")


def large_moving_average(s: Signal, size: int) -> Column:
    """As ``moving_average`` by two running sums: constant work a row for large windows, less exact by rounding."""
    total = F.sum(s.v).over(s.window().rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(s.window())
    before = F.coalesce(F.sum(s.v).over(s.window().rowsBetween(Window.unboundedPreceding, -size)), F.lit(0.0))
    return (total - before) / F.least(n, F.lit(size))


def difference(s: Signal) -> Column:
    """x[n] - x[n-1], with x[-1] = 0."""
    return s.v - F.coalesce(F.lag(s.v).over(s.window()), F.lit(0.0))


def waveform_length(s: Signal, size: int, out: str = "y") -> DataFrame:
    d = F.coalesce(F.abs(s.v - F.lag(s.v).over(s.window())), F.lit(0.0))
    return s.df.withColumn("_d", d).withColumn(out, F.sum("_d").over(s.rows(size))).drop("_d")


def slope_sign_changes(s: Signal, size: int, threshold: float = 0.0, out: str = "y", compat: bool = False) -> DataFrame:
    """Samples of the window at which the slope before turned: a count; compat: 1 if any, from the fourth sample on."""
    w = s.window()
    one, two = F.lag(s.v, 1).over(w), F.lag(s.v, 2).over(w)
    flag = F.coalesce(F.when((one - two) * (one - s.v) > threshold, 1), F.lit(0))
    if compat:
        flag = F.when(F.row_number().over(w) <= 3, 0).otherwise(flag)
    agg = F.max if compat else F.sum
    return s.df.withColumn("_f", flag).withColumn(out, agg("_f").over(s.rows(size)).cast("bigint")).drop("_f")


def willison_amplitude(s: Signal, size: int, threshold: float = 0.0, out: str = "y", compat: bool = False) -> DataFrame:
    """Steps above a threshold in the window: a count; compat: 1 if any."""
    flag = F.coalesce(F.when(F.abs(s.v - F.lag(s.v).over(s.window())) > threshold, 1), F.lit(0))
    agg = F.max if compat else F.sum
    return s.df.withColumn("_f", flag).withColumn(out, agg("_f").over(s.rows(size)).cast("bigint")).drop("_f")


def linear_regression(s: Signal, size: int, output: str = "slope", out: str = "y") -> DataFrame:
    """Least squares over the last n <= size samples at x = 0 .. n-1; 0 with fewer than two.

    output: slope, intercept, predictions (at x = n-1) or residuals (value less prediction).
    """
    if size < 2:
        raise ValueError("a regression window holds at least two samples")
    if output not in ("slope", "intercept", "predictions", "residuals"):
        raise ValueError("unknown output")
    w = s.rows(size)
    df = s.df.withColumn("_x", F.row_number().over(s.window()).cast("double"))
    n = F.count(F.lit(1)).over(w)
    slope = F.regr_slope(s.v, F.col("_x")).over(w)
    mean = F.avg(s.v).over(w)
    first = mean - slope * (n - 1) / 2
    last = mean + slope * (n - 1) / 2
    y = {"slope": slope, "intercept": first, "predictions": last, "residuals": s.v - last}[output]
    return df.withColumn(out, F.when(n < 2, 0.0).otherwise(y)).drop("_x")


def snr(s: Signal, signal: str, noise: str, size: int | None = None, duration_ms: float | None = None) -> Column:
    """Decibels of two channel columns' mean powers, in -100 .. 100; 100 without noise."""
    w = _frame(s, size, duration_ms)
    eps = 1e-10
    ps, pn = (F.avg(F.col(c) * F.col(c)).over(w) for c in (signal, noise))
    db = 10.0 * F.log10((ps + eps) / (pn + eps))
    return F.when(pn < eps, 100.0).otherwise(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), db)))


def detrend(s: Signal, kind: str = "linear", out: str = "y") -> DataFrame:
    """Less the mean, or less the line through the whole series."""
    w = s.whole()
    if kind == "constant":
        return s.df.withColumn(out, s.v - F.avg(s.v).over(w))
    if kind != "linear":
        raise ValueError("kind is linear or constant")
    i = (F.row_number().over(s.window()) - 1).cast("double")
    df = s.df.withColumn("_i", i)
    slope = F.coalesce(F.regr_slope(s.v, F.col("_i")).over(w), F.lit(0.0))
    return df.withColumn(out, s.v - (F.avg(s.v).over(w) + slope * (F.col("_i") - F.avg("_i").over(w)))).drop("_i")


def peaks(s: Signal, window: int = 3, threshold: float = 0.0, out: str = "y") -> DataFrame:
    """1.0 at a value strictly above all others of a centred odd window and at least ``threshold``; the edges have none."""
    if window < 3 or window % 2 == 0:
        raise ValueError("the window is odd and at least 3")
    k = window // 2
    w = s.window()
    n = F.row_number().over(w)
    after = F.count(F.lit(1)).over(w.rowsBetween(1, k))
    left, right = F.max(s.v).over(w.rowsBetween(-k, -1)), F.max(s.v).over(w.rowsBetween(1, k))
    hit = (n > k) & (after == k) & (s.v > left) & (s.v > right) & (s.v >= threshold)
    return s.df.withColumn(out, F.when(hit, 1.0).otherwise(0.0))


def hjorth(s: Signal) -> DataFrame:
    """Activity, mobility and complexity of each series; null with fewer than three samples."""
    w = s.window()
    d = s.df.withColumn("_d1", F.lead(s.v).over(w) - s.v)
    d = d.withColumn("_d2", F.lead("_d1").over(w) - F.col("_d1"))
    g = d.groupBy(*s.keys).agg(F.var_pop(s.value).alias("v0"), F.var_pop("_d1").alias("v1"), F.var_pop("_d2").alias("v2"), F.count(F.lit(1)).alias("n"))
    return g.select(*s.keys, *hjorth_of(F.col("v0"), F.col("v1"), F.col("v2"), F.col("n") >= 3))


def hjorth_of(v0: Column, v1: Column, v2: Column, enough: Column) -> list[Column]:
    mobility = F.when(v0 > 0, F.sqrt(v1 / v0)).otherwise(0.0)
    complexity = F.when((v0 > 0) & (v1 > 0), F.sqrt(v2 / v1) / mobility).otherwise(0.0)
    return [F.when(enough, v0).alias("activity"), F.when(enough, mobility).alias("mobility"), F.when(enough, complexity).alias("complexity")]


def hjorth_tracker(s: Signal, size: int) -> DataFrame:
    """Hjorth parameters of each full window of ``size`` samples; null until it is full."""
    if size < 3:
        raise ValueError("a window holds at least three samples")
    w = s.window()
    d = s.df.withColumn("_d1", s.v - F.lag(s.v).over(w))
    d = d.withColumn("_d2", F.col("_d1") - F.lag("_d1").over(w))
    full = F.row_number().over(w) >= size
    v0 = F.var_pop(s.v).over(w.rowsBetween(-(size - 1), 0))
    v1 = F.var_pop("_d1").over(w.rowsBetween(-(size - 2), 0))
    v2 = F.var_pop("_d2").over(w.rowsBetween(-(size - 3), 0))
    return d.select(*s.df.columns, *hjorth_of(v0, v1, v2, full))


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    return F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))


def shannon_entropy(s: Signal, bins: int = 256) -> DataFrame:
    """Entropy in bits of a histogram over [min, max] of each series; 0 for a constant one."""
    w = s.whole()
    low, high = F.min(s.v).over(w), F.max(s.v).over(w)
    b = s.df.select(*s.keys, F.when(high > low, _bin(s.v, low, high, bins)).otherwise(0).alias("_b"))
    c = b.groupBy(*s.keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    g = c.groupBy(*s.keys).agg(F.sum("_c").alias("n"), F.sum(F.col("_c") * F.log2("_c")).alias("t"))
    # -sum(p log2 p) = log2(n) - sum(c log2 c) / n
    return g.select(*s.keys, (F.log2("n") - F.col("t") / F.col("n") + 0.0).alias("entropy"))


def entropy_tracker(s: Signal, size: int, bins: int = 16, out: str = "y") -> DataFrame:
    """The same of each full window; null until it is full."""
    w = s.window()
    df = s.df.withColumn("_w", F.collect_list(s.v).over(s.rows(size))).withColumn("_n", F.row_number().over(w))
    x = F.col("_w")
    low, high = F.array_min(x), F.array_max(x)
    df = df.select(*s.df.columns, "_n", F.inline_outer(F.array(F.struct(
        F.when(high > low, F.transform(x, lambda v: _bin(v, low, high, bins).cast("int"))).alias("_b")))))
    share = lambda k: F.size(F.filter("_b", lambda b: b == k)) / float(size)
    h = F.aggregate(F.transform(F.array_distinct("_b"), lambda k: -share(k) * F.log2(share(k))), F.lit(0.0), lambda a, v: a + v)
    return df.select(*s.df.columns, F.when(F.col("_n") >= size, F.coalesce(h, F.lit(0.0))).alias(out))


def autocorrelation(s: Signal, max_lag: int | None = None, other: str | None = None) -> DataFrame:
    """r[k] = sum x[i] y[i+k] for k = 0 .. max_lag (y = x, or another column): rows (keys, lag, r).

    Samples are sorted once; a task keeps the last ``max_lag`` values and the sums, and takes a batch by a product or a Fourier transform.
    Without ``max_lag`` all lags are given; then a task holds a series (16 bytes a sample), as each sample meets every other.
    """
    from .recursive import Cuts, doubles, sorted_rows

    keys, inputs = list(s.keys), [s.value, other or s.value]
    schema = T.StructType([*[s.df.schema[k] for k in keys], T.StructField("lag", T.LongType()), T.StructField("r", T.DoubleType())])

    def run(batches):
        cuts, row, held, past, total, seen = Cuts(keys), None, [], None, None, 0

        def take(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal past, total
            band = len(total) - 1
            whole = np.concatenate([past, x])
            if len(y) * band <= 1 << 22:
                total += np.correlate(whole, y, "valid")[::-1]
            else:
                n = 1 << (len(whole) + len(y) - 1).bit_length()
                total += np.fft.irfft(np.fft.rfft(whole, n) * np.conj(np.fft.rfft(y, n)), n)[band::-1]
            past = whole[len(whole) - band :]

        def ended():
            nonlocal past, total
            if max_lag is None:
                x = np.concatenate(held)
                past, total = np.zeros(len(x) - 1), np.zeros(len(x))
                take(x[:, 0], x[:, 1])
            n = min(len(total), seen)
            return pa.RecordBatch.from_arrays([*[c.take(pa.array(np.zeros(n, np.int64))) for c in row], pa.array(np.arange(n)), pa.array(total[:n])], names=[*keys, "lag", "r"])

        for b in batches:
            if not b.num_rows:
                continue
            x = doubles(b, inputs)
            for lo, hi, new in cuts(b):
                if new:
                    if row is not None:
                        yield ended()
                    row, held, seen = [b.column(b.schema.get_field_index(k)).slice(lo, 1) for k in keys], [], 0
                    past, total = np.zeros(max_lag or 0), np.zeros((max_lag or 0) + 1)
                seen += hi - lo
                if max_lag is None:
                    held.append(x[lo:hi])
                else:
                    take(x[lo:hi, 0], x[lo:hi, 1])
        if row is not None:
            yield ended()

    need = list(dict.fromkeys([*keys, *s.order, *inputs]))
    return sorted_rows(s.with_(s.df.select(*need))).mapInArrow(run, schema)


def weighted_lags(s: Signal, taps: list[float]) -> Column:
    """sum taps[k] x[n-k] with zeros before the start: a short FIR as one window expression."""
    w = s.window()
    total = None
    for k, h in enumerate(taps):
        term = F.lit(float(h)) * (s.v if k == 0 else F.coalesce(F.lag(s.v, k).over(w), F.lit(0.0)))
        total = term if total is None else total + term
    return total


def valid_correlation(s: Signal, kernel: list[float], flip: bool = False, out: str = "y") -> DataFrame:
    """sum kernel[k] x[n+k] at each n with a full frame; flip: true convolution."""
    taps = list(reversed(kernel)) if flip else list(kernel)
    w = s.window()
    total = F.lit(float(taps[0])) * s.v
    for k, h in enumerate(taps[1:], 1):
        total = total + F.lit(float(h)) * F.lead(s.v, k).over(w)
    return s.df.withColumn(out, total).where(F.col(out).isNotNull())


def vector_sums(s: Signal, other: str | None = None) -> DataFrame:
    """sum, sum of squares and, with another column, dot product of each series."""
    aggs = [F.sum(s.v).alias("total"), F.sum(s.v * s.v).alias("squares")]
    if other:
        aggs.append(F.sum(s.v * F.col(other)).alias("dot"))
    return s.df.groupBy(*s.keys).agg(*aggs)


#: Samples of a tile's side, and lags of a row that tiles give, of correlations over all lags.
TILE, LAGS = 1 << 20, 1 << 14


def correlation_tiles(s: Signal, other: str | None = None, tile: int = TILE) -> DataFrame:
    """``autocorrelation`` over all lags of a signal whose rows are ``numbered``: rows (keys, lag, r), no task with more than two tiles of a series.

    A series is cut into tiles of ``tile`` samples, and every tile meets each later one (and itself) by a Fourier transform; what a meeting adds to the lags is
    summed by blocks of lags. A series of n samples sends n / tile copies of itself, the price of meeting every sample with every other.
    """
    from .recursive import doubles
    from .slices import INDEX

    if INDEX not in s.df.columns:
        raise ValueError("number the rows first")
    keys = list(s.keys)
    x, y = s.v, F.col(other).cast("double") if other else s.v
    # a row for each run of samples of a tile; a sample's place in its tile is kept, so runs may come in any order
    own = F.floor(F.col(INDEX) / tile).cast("bigint")
    whole = s.df.groupBy(*keys).agg(F.max(INDEX).alias("_top")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_top") + 1).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = s.df.select(*keys, F.col(INDEX).alias("_i"), x.alias("_x"), y.alias("_y"), own.alias("_own")).join(whole, same or F.lit(True))
    # x of tile p meets y of the tiles q >= p
    as_x = rows.select(*keys, "_n", "_i", F.col("_x").alias("_v"), F.lit(0).alias("_side"), F.col("_own").alias("_p"), F.explode(F.sequence("_own", F.floor((F.col("_n") - 1) / tile).cast("bigint"))).alias("_q"))
    as_y = rows.select(*keys, "_n", "_i", F.col("_y").alias("_v"), F.lit(1).alias("_side"), F.explode(F.sequence(F.lit(0).cast("bigint"), "_own")).alias("_p"), F.col("_own").alias("_q"))
    kind = T.StructType([*[s.df.schema[k] for k in keys], T.StructField("block", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    width = LAGS

    def meet(batches):
        from .recursive import Cuts

        cuts, held, row, at = Cuts([*keys, "_p", "_q"]), None, None, (0, 0, 0)

        def ended():
            p, q, n = at
            a, b = held
            if len(a) * len(b) <= 1 << 16:
                r = np.correlate(np.concatenate([np.zeros(len(a) - 1), b, np.zeros(len(a) - 1)]), a, "valid")  # lags 1 - len(a) to len(b) - 1
            else:
                size = 1 << (len(a) + len(b) - 1).bit_length()
                z = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)
                r = np.concatenate([z[size - len(a) + 1 :], z[: len(b)]])
            lags = np.arange(1 - len(a), len(b)) + (q - p) * tile
            r, lags = r[lags >= 0], lags[lags >= 0]
            for block in range(int(lags[0]) // width, int(lags[-1]) // width + 1):
                sums = np.zeros(min(width, n - block * width))
                here = (lags >= block * width) & (lags < (block + 1) * width)
                sums[lags[here] - block * width] = r[here]
                yield pa.RecordBatch.from_arrays([*row, pa.array([block]), pa.array([sums], pa.list_(pa.float64()))], names=[*keys, "block", "sums"])

        for b in batches:
            if not b.num_rows:
                continue
            get = lambda c, b=b: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            v, side, i, p, q, n = doubles(b, ["_v"])[:, 0], get("_side"), get("_i"), get("_p"), get("_q"), get("_n")
            for lo, hi, new in cuts(b):
                if new:
                    if row is not None:
                        yield from ended()
                    at, row = (int(p[lo]), int(q[lo]), int(n[lo])), [b.column(b.schema.get_field_index(k)).slice(lo, 1) for k in keys]
                    held = [np.zeros(min(tile, at[2] - t * tile)) for t in at[:2]]
                for k in (0, 1):
                    mine = slice(lo, hi)
                    of = side[mine] == k
                    held[k][i[mine][of] - at[k] * tile] = v[mine][of]
        if row is not None:
            yield from ended()

    def add(batches):
        from .recursive import Cuts

        cuts, total, row, block = Cuts([*keys, "block"]), None, None, 0

        def ended():
            n = len(total)
            return pa.RecordBatch.from_arrays([*[c.take(pa.array(np.zeros(n, np.int64))) for c in row], pa.array(np.arange(n) + block * width), pa.array(total)], names=[*keys, "lag", "r"])

        for b in batches:
            if not b.num_rows:
                continue
            sums = b.column(b.schema.get_field_index("sums"))
            for lo, hi, new in cuts(b):
                if new:
                    if row is not None:
                        yield ended()
                    row, block, total = [b.column(b.schema.get_field_index(k)).slice(lo, 1) for k in keys], b.column(b.schema.get_field_index("block"))[lo].as_py(), None
                for j in range(lo, hi):
                    x = sums[j].values.to_numpy()
                    total = x.copy() if total is None else total + x
        if row is not None:
            yield ended()

    pairs = [*keys, "_p", "_q"]
    met = as_x.unionByName(as_y).repartition(*pairs).sortWithinPartitions(*pairs).mapInArrow(meet, kind)
    out = T.StructType([*[s.df.schema[k] for k in keys], T.StructField("lag", T.LongType()), T.StructField("r", T.DoubleType())])
    return met.repartition(*keys, "block").sortWithinPartitions(*keys, "block").mapInArrow(add, out)
