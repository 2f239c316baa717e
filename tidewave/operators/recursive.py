"""Sequential stages: one exchange and sort by series, then kernels over Arrow batches with the state carried on.

A series is never held whole: a task keeps a batch and one state, so a series of any length runs in bounded memory.
Parallel across series only; a single recurrence is sequential by nature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import kernels as K
from ..functions.design import Coefficients
from ..functions.states import pack, unpack
from ..sources.signal import Signal


def doubles(b: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Columns as one matrix; a null is NaN."""
    each = [pc.cast(b.column(b.schema.get_field_index(c)), pa.float64(), safe=False).to_numpy(zero_copy_only=False) for c in columns]
    return np.stack(each, 1) if each else np.empty((b.num_rows, 0))


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


class Cuts:
    """Cuts the batches of a sorted partition into runs of one series. Nulls are equal, as in a grouping; key values are compared, not converted."""

    def __init__(self, keys: Sequence[str]):
        self.keys, self.last = list(keys), None

    def __call__(self, b: pa.RecordBatch) -> Iterator[tuple[int, int, bool]]:
        """(from, to, whether a series starts here)."""
        cols = [b.column(b.schema.get_field_index(k)) for k in self.keys]
        codes = np.stack([c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in cols], 1)
        at = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(1)) + 1).tolist(), b.num_rows]
        scalar = lambda c, i: c[i].value if pa.types.is_temporal(c.type) else c[i].as_py()
        first = tuple(scalar(c, 0) for c in cols)
        for lo, hi in zip(at, at[1:]):
            yield lo, hi, lo > 0 or self.last is None or not _same(self.last, first)
        self.last = tuple(scalar(c, b.num_rows - 1) for c in cols)


def sorted_rows(s: Signal) -> DataFrame:
    """The one exchange and sort of sequential stages."""
    return s.df.repartition(*s.keys).sortWithinPartitions(*s.keys, *s.order)


#: Marks rows that hold a saved state; they come before a series' samples.
STATE = "_state"


#: Rows that are gathered for series to run side by side, and series from which they do.
GATHER, SIDE_BY_SIDE = 65_536, 8


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``GATHER`` rows."""
    held: list[pa.RecordBatch] = []

    def one():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        if held and sum(x.num_rows for x in held) + b.num_rows > GATHER:
            yield one()
            held = []
        held.append(b)
    if held:
        yield one()


def side_by_side(kernel, runs: list[tuple], x: np.ndarray, y: np.ndarray):
    """Run series (from, to, state) of ``x`` into ``y``, those of like lengths side by side; the state of the last."""
    ended: list = [None] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: runs[i][0] - runs[i][1])  # the longest first
    at = 0
    while at < len(order):
        longest = runs[order[at]][1] - runs[order[at]][0]
        some = [i for i in order[at : at + 4096] if 2 * (runs[i][1] - runs[i][0]) >= longest]  # at most half of the array is padding
        at += len(some)
        if len(some) < SIDE_BY_SIDE:
            for i in some:
                lo, hi, state = runs[i]
                got, ended[i] = kernel.run(state, x[lo:hi])
                y[lo:hi] = np.asarray(got).reshape(hi - lo, -1)
            continue
        lengths = np.array([runs[i][1] - runs[i][0] for i in some])
        wide = np.zeros((len(some), longest, x.shape[1]))
        for j, i in enumerate(some):
            wide[j, : lengths[j]] = x[runs[i][0] : runs[i][1]]
        got, states = kernel.run_many([runs[i][2] for i in some], wide, lengths)
        for j, i in enumerate(some):
            y[runs[i][0] : runs[i][1], 0] = got[j, : lengths[j]]
            ended[i] = states[j]
    return ended[-1]


def scan(s: Signal, kernel, inputs: Sequence[str] | None = None, outputs: Sequence[str] = ("y",), states: DataFrame | None = None) -> DataFrame:
    """``s.df`` with the kernel's outputs; ``inputs`` are the columns that it reads (the value, if none).

    ``states`` are rows (keys, state) of ``last_states``, from which series go on. Columns that the kernel does not read pass through as they are.
    """
    inputs, outputs, keys, handed = list(inputs or [s.value]), list(outputs), list(s.keys), states is not None
    schema = T.StructType([*s.df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outputs]])

    lockstep = hasattr(kernel, "run_many")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, state = Cuts(keys), None
        for b in gathered(batches) if lockstep else batches:
            if not b.num_rows:
                continue
            x, y = doubles(b, inputs), np.empty((b.num_rows, len(outputs)))
            saved = b.column(b.schema.get_field_index(STATE)) if handed else None
            runs = []
            for lo, hi, new in cuts(b):
                if new:
                    state = kernel.start()
                if saved is not None:
                    while lo < hi and saved[lo].is_valid:
                        state, lo = unpack(saved[lo].as_py()), lo + 1
                if lo < hi and lockstep:
                    runs.append((lo, hi, state))
                elif lo < hi:
                    got, state = kernel.run(state, x[lo:hi])
                    y[lo:hi] = np.asarray(got).reshape(hi - lo, -1)
            if runs:
                ended = side_by_side(kernel, runs, x, y)
                state = ended if runs[-1][1] == b.num_rows else state
            columns = [*(c for c, f in zip(b.columns, b.schema, strict=True) if f.name != STATE), *[pa.array(y[:, j]) for j in range(len(outputs))]]
            out = pa.RecordBatch.from_arrays(columns, names=[*(n for n in b.schema.names if n != STATE), *outputs])
            yield out if saved is None else out.filter(saved.is_null())

    if states is None:
        return sorted_rows(s).mapInArrow(run, schema)
    before = states.select(*keys, F.col("state").alias(STATE))
    whole = s.df.withColumn(STATE, F.lit(None).cast("binary")).unionByName(before, allowMissingColumns=True)
    rows = whole.repartition(*keys).sortWithinPartitions(*keys, F.col(STATE).isNull(), *s.order)
    return rows.mapInArrow(run, schema)


def last_states(s: Signal, kernel, inputs: Sequence[str] | None = None) -> DataFrame:
    """Rows (keys, state): what the kernel has kept at the end of each series, to save and to hand to a later ``scan``."""
    inputs, keys = list(inputs or [s.value]), list(s.keys)
    schema = T.StructType([*[s.df.schema[k] for k in keys], T.StructField("state", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, state, row = Cuts(keys), None, None

        def ended():
            return pa.RecordBatch.from_arrays([*row, pa.array([pack(state)], pa.binary())], names=[*keys, "state"])

        for b in batches:
            if not b.num_rows:
                continue
            x = doubles(b, inputs)
            for lo, hi, new in cuts(b):
                if new:
                    if row is not None:
                        yield ended()
                    state, row = kernel.start(), [b.column(b.schema.get_field_index(k)).slice(lo, 1) for k in keys]
                _, state = kernel.run(state, x[lo:hi])
        if row is not None:
            yield ended()

    need = list(dict.fromkeys([*keys, *s.order, *inputs]))
    return sorted_rows(s.with_(s.df.select(*need))).mapInArrow(run, schema)


def scan_sliced(s: Signal, kernel, part: Column, inputs: Sequence[str] | None = None, outputs: Sequence[str] = ("y",)) -> DataFrame:
    """As ``scan``, parallel within a series, of a linear kernel or one that can digest rows: ``part`` (never null, such as an hour of the timestamp) cuts a series into slices and does not fall in its order.

    A first pass runs every slice from rest and keeps its last state and length, or its digest. States are then carried from slice to slice, a row each; a
    second pass runs every slice from its own. So a series with a third of all rows spreads over tasks, at the price of two passes.
    """
    digests = hasattr(kernel, "digest")
    if not digests and not K.is_linear(kernel):
        raise ValueError("only linear kernels and those with digests can run in slices")
    inputs, keys = list(inputs or [s.value]), list(s.keys)
    t = s.with_(s.df.withColumn("_part", part), keys=(*keys, "_part"))
    width, rest = len(inputs), None if digests else K.at_rest(kernel)
    # of each slice: its last state from rest, its length, and what a series would start from with its first row
    kind = T.StructType([*[t.df.schema[k] for k in t.keys], T.StructField("n", T.LongType()), T.StructField("ended", T.BinaryType()), T.StructField("first", T.BinaryType())])

    def ends(batches):
        cuts, row, state, n, first = Cuts(t_keys), None, None, 0, None

        def made():
            return pa.RecordBatch.from_arrays([*row, pa.array([n]), pa.array([pack(state)], pa.binary()), pa.array([first], pa.binary())], names=[*t_keys, "n", "ended", "first"])

        for b in batches:
            if not b.num_rows:
                continue
            x = doubles(b, inputs)
            for lo, hi, new in cuts(b):
                if new:
                    if row is not None:
                        yield made()
                    state, n, row = rest, 0, [b.column(b.schema.get_field_index(k)).slice(lo, 1) for k in t_keys]
                    first = pack(K.first_state(kernel, x[lo : lo + 1]))
                if digests:
                    state = kernel.digest(x[lo:hi]) if state is None else kernel.join(state, kernel.digest(x[lo:hi]))
                else:
                    _, state = kernel.run(state, x[lo:hi])
                n += hi - lo
        if row is not None:
            yield made()

    def carry(batches):
        cuts, state = Cuts(keys), None
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda c, b=b: b.column(b.schema.get_field_index(c))
            starts = []
            for lo, hi, new in cuts(b):
                for i in range(lo, hi):
                    if new and i == lo:
                        state = unpack(col("first")[i].as_py())
                    starts.append(pack(kernel.start() if new and i == lo else state))
                    ended = unpack(col("ended")[i].as_py())
                    state = kernel.after(state, ended) if digests else K.advance(kernel, width, state, col("n")[i].as_py(), ended)
            yield pa.RecordBatch.from_arrays([*[col(k) for k in t_keys], pa.array(starts, pa.binary())], names=[*t_keys, "state"])

    t_keys = list(t.keys)
    need = list(dict.fromkeys([*t_keys, *s.order, *inputs]))
    summary = sorted_rows(t.with_(t.df.select(*need))).mapInArrow(ends, kind)
    states = summary.repartition(*keys).sortWithinPartitions(*keys, "_part").mapInArrow(carry, T.StructType([*[t.df.schema[k] for k in t_keys], T.StructField("state", T.BinaryType())]))
    return scan(t, kernel, inputs, outputs, states).drop("_part")


def weights(states: DataFrame) -> DataFrame:
    """Adaptive filters' states as rows (keys, weights)."""
    keys = [c for c in states.columns if c != "state"]

    def run(batches):
        for b in batches:
            w = [unpack(x.as_py())[0] for x in b.column(b.schema.get_field_index("state"))]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], pa.array(w, pa.list_(pa.float64()))], names=[*keys, "weights"])

    return states.mapInArrow(run, T.StructType([*[states.schema[k] for k in keys], T.StructField("weights", T.ArrayType(T.DoubleType()))]))


def states_of_weights(df: DataFrame, keys: Sequence[str], kernel: K.Lms | K.Rls) -> DataFrame:
    """Rows (keys, state) for ``scan`` of an adaptive filter from rows (keys, weights), so that each series starts from its own; a null or an array of another length is refused."""
    keys = list(keys)

    def run(batches):
        for b in batches:
            made = []
            for w in b.column(b.schema.get_field_index("weights")).to_pylist():
                if w is None or len(w) != kernel.taps or None in w:
                    raise ValueError("a weight for each tap")
                made.append(pack((np.array(w, np.float64), *kernel.start()[1:])))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in keys], pa.array(made, pa.binary())], names=[*keys, "state"])

    return df.select(*keys, "weights").mapInArrow(run, T.StructType([*[df.schema[k] for k in keys], T.StructField("state", T.BinaryType())]))


def ema(s: Signal, alpha: float, out: str = "y") -> DataFrame:
    return scan(s, K.Ema(alpha), outputs=[out])


def integrate(s: Signal, alpha: float = 0.99, out: str = "y") -> DataFrame:
    """A leaky sum; without a leak a running sum, as a window."""
    if alpha == 1:
        return s.df.withColumn(out, F.sum(s.v).over(s.window().rowsBetween(Window.unboundedPreceding, 0)))
    return scan(s, K.LeakyIntegrator(alpha), outputs=[out])


#: Longer FIRs run as one convolution a batch instead of a window expression.
LAG_TAPS = 64


def filter_kernel(b: Sequence[float] | Coefficients, a: Sequence[float] = ()):
    """The kernel of a filter: its sections in cascade. A pole outside the unit circle is refused."""
    c = b if isinstance(b, Coefficients) else Coefficients(tuple(b), tuple(a))
    if c.radius() > 1 + 1e-9:
        raise ValueError("an unstable filter: a pole lies outside the unit circle")
    made = tuple(K.Iir(p.b, p.a) if p.a else K.Fir(p.b) for p in c.parts)
    return made[0] if len(made) == 1 else K.Chain(made)


def apply_filter(s: Signal, b: Sequence[float] | Coefficients, a: Sequence[float] = (), out: str = "y") -> DataFrame:
    """FIR or IIR with zero history; a design of higher order runs as its second-order sections."""
    from .windows import weighted_lags

    if isinstance(b, Coefficients) and not b.a:
        b = b.b
    if not isinstance(b, Coefficients) and not a and len(b) <= LAG_TAPS:
        return s.df.withColumn(out, weighted_lags(s, list(b)))
    return scan(s, filter_kernel(b, a), outputs=[out])


convolve = apply_filter


def filter_bank(s: Signal, bands: Sequence[Coefficients], channel: str = "channel", out: str = "y") -> DataFrame:
    """Every series through every band in one scan: a row per band, numbered channel * bands + band (just the band without a channel)."""
    n = len(bands)
    place: Column = (F.col(channel) * n + F.col("band")) if channel in s.df.columns else F.col("band")
    wide = scan(s, K.Bank(tuple(filter_kernel(c) for c in bands)), outputs=[f"_b{i}" for i in range(n)])
    pairs = F.array(*[F.struct(F.lit(i).alias("band"), F.col(f"_b{i}").alias(out)) for i in range(n)])
    return wide.select(*s.df.columns, F.inline(pairs)).withColumn("out_channel", place.cast("bigint"))


def lms(s: Signal, x: str, desired: str, taps: int, mu: float = 0.01, leak: float = 0.0, normalized: bool = False, out: str = "y") -> DataFrame:
    return scan(s, K.Lms(taps, mu, leak, normalized), [x, desired], [out])


def rls(s: Signal, x: str, desired: str, taps: int, forget: float = 0.99, delta: float = 0.01, out: str = "y") -> DataFrame:
    return scan(s, K.Rls(taps, forget, delta), [x, desired], [out])


def kalman_sliced(s: Signal, columns: Sequence[str], process: float = 1e-5, measure: float = 1e-2, initial: float = 1.0, width: int = 100_000) -> DataFrame:
    """``kalman`` over a signal whose rows are numbered (``slices.numbered``), parallel within a series: slices of ``width`` rows are digested, and states carried over their digests."""
    from .slices import INDEX, in_row_slices

    def interval(t: Signal) -> Column:
        us = F.unix_micros(F.col(s.ts)) / 1e6
        return F.coalesce(us - F.lag(us).over(t.window()), F.lit(0.0))

    df = in_row_slices(s, interval, 1, width, "_dt") if s.ts else s.df.withColumn("_dt", F.lit(1.0))
    if not s.ts:
        df = df.withColumn("_dt", F.when(F.col(INDEX) == 0, 0.0).otherwise(F.col("_dt")))
    k = K.Kalman(len(columns), process, measure, initial)
    t = s.with_(df, order=(INDEX,))
    return scan_sliced(t, k, F.floor(F.col(INDEX) / width), [*columns, "_dt"], [f"kf_{c}" for c in columns]).drop("_dt")


def kalman(s: Signal, columns: Sequence[str], process: float = 1e-5, measure: float = 1e-2, initial: float = 1.0) -> DataFrame:
    """Columns named kf_* for each measured one; the interval is that of the timestamps, in seconds (1 without them)."""
    if s.ts:
        t = F.unix_micros(F.col(s.ts)) / 1e6
        dt = F.coalesce(t - F.lag(t).over(s.window()), F.lit(0.0))
    else:
        dt = F.lit(1.0)
    k = K.Kalman(len(columns), process, measure, initial)
    return scan(s.with_(s.df.withColumn("_dt", dt)), k, [*columns, "_dt"], [f"kf_{c}" for c in columns]).drop("_dt")


def spaced_peaks(s: Signal, distance: int, window: int = 3, threshold: float = 0.0, out: str = "y") -> DataFrame:
    """Peaks of ``windows.peaks``, each at least ``distance`` samples after the one kept before."""
    from .windows import peaks

    found = peaks(s, window, threshold, "_p")
    if distance <= 1:
        return found.withColumnRenamed("_p", out)
    return scan(s.with_(found), K.Cooldown(distance), ["_p"], [out]).drop("_p")
