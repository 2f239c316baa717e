"""Whole pipelines on streams: one stateful operator with the composed state of all stages.

A pipeline is cut in three. Stages before the first that needs a series' past run as columns, so do expressions after the last; all between become steps of one processor,
whose state of a series is one value in one store. Batch runs of the same steps give the states from which a stream goes on, and a stream's states are rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from ..functions import kernels as K
from ..functions.states import pack, unpack
from ..operators import frames, recursive
from ..sources.signal import Signal
from . import pieces, steps as S

#: Expression stages within the steps, as functions of arrays.
_MAPS: dict[str, Callable] = {
    "rectify": lambda mode="full": (np.abs if mode == "full" else lambda x: np.maximum(x, 0.0)),
    "square": lambda: lambda x: x * x,
    "amplify": lambda gain: lambda x: x * float(gain),
    "clip_detection": lambda threshold: lambda x: (np.abs(x) >= threshold) * 1.0,
    "to_decibels": lambda reference=1.0: lambda x: 20.0 * np.log10(np.maximum(x, 1e-10) / float(reference)),
}
_STATS = {"moving_average": "mean", "rms": "rms", "mean_absolute_value": "mean_absolute", "variance": "variance", "z_score": "z_score"}
_FRAMING = ("frames", "fft", "stft", "hilbert", "wavelet")
#: Names of the columns beside those of the signal: the state, and whether a row came too late.
STATE, LATE = "state", "late"


@dataclass(frozen=True)
class Plan:
    """The steps, and what their rows are: of the input (``rows``), of a grid (``idx``) or frames (``frame_idx``); whether a value is an array."""

    steps: tuple[S.Step, ...]
    shape: str
    arrays: bool
    more: tuple[str, ...]

    def start(self):
        return tuple(s.start() for s in self.steps)

    def run(self, state, r: S.Rows):
        new = []
        for step, s in zip(self.steps, state, strict=True):
            r, s = step.run(s, r)
            new.append(s)
        return r, tuple(new)


def _step(name: str, kind: str, build, p: dict, signal: Signal) -> tuple[S.Step, tuple[str, ...]]:
    """A stage as a step, and the further columns that it reads."""
    value = signal.value
    if name in _MAPS:
        build(signal, **p)  # checks the parameters
        return S.Map(_MAPS[name](**p)), ()
    if name in _STATS:
        size, ms = p.get("size"), p.get("duration_ms")
        if (size is None) == (ms is None):
            raise ValueError(f"{name} on a stream needs a size or a duration, as a stream has no whole series")
        if size is not None and size < 1 or ms is not None and round(ms * 1000) < 1:
            raise ValueError("a window holds at least one sample")
        return S.Window(_STATS[name], size, None if ms is None else round(ms * 1000), p.get("epsilon", 1e-6)), ()
    if name == "cumulative_average":
        return S.Cumulative(), ()
    if name == "difference":
        return S.Difference(), ()
    if name == "waveform_length":
        return S.Marks("length", p["size"]), ()
    if name in ("slope_sign_changes", "willison_amplitude"):
        return S.Marks("turns" if name[0] == "s" else "steps", p["size"], p.get("threshold", 0.0), p.get("compat", False)), ()
    if name == "linear_regression":
        if p["size"] < 2 or p.get("output", "slope") not in ("slope", "intercept", "predictions", "residuals"):
            raise ValueError("a regression window holds at least two samples; output is slope, intercept, predictions or residuals")
        return S.Regression(p["size"], p.get("output", "slope")), ()
    if kind == "kernel":
        return S.Kernel(build(**p)), ()
    if name in ("lms", "rls"):
        p = dict(p)
        columns = (p.pop("x"), p.pop("desired"))
        kernel = K.Lms(**p) if name == "lms" else K.Rls(**p)
        return S.Kernel(kernel, tuple(None if c == value else c for c in columns)), tuple(c for c in columns if c != value)
    if name == "kalman":
        return S.Timed(K.Kalman(1, **p)), ()
    if name in ("decimate", "interpolate", "resample"):
        order = p.get("order", 51)
        up, down = (1, p["factor"]) if name == "decimate" else (p["factor"], 1) if name == "interpolate" else (p["up"], p["down"])
        return S.Resample.of(up, down, order), ()
    if name == "align":
        gap = p.get("gap_ms")
        if p.get("method", "linear") != "linear":
            raise ValueError("align on a stream is linear: the other methods wait for later samples")
        if p.get("gap_policy", "interpolate") not in ("interpolate", "error", "zero-fill", "hold", "extrapolate") or not p["rate"] > 0:
            raise ValueError("unknown gap policy or rate")
        return S.Align(p["rate"], p.get("gap_policy", "interpolate"), None if gap is None else round(gap * 1000)), ()
    if name in _FRAMING:
        size, hop, fn = S.frame_fn(name, p)
        if size < 1 or hop < 1:
            raise ValueError("size and hop are positive")
        return S.Frames(size, hop, fn), ()
    if name == "flatten":
        return S.Flatten(), ()
    if name in ("mel", "mfcc", "dct"):
        return S.Map({"mel": lambda: frames.mel_fn(**p), "mfcc": lambda: frames.mfcc_fn(**p), "dct": lambda: frames.dct_fn}[name]()), ()
    raise ValueError(f"{name} needs a whole series or later samples and cannot run on a stream")


def compile_(stages: Sequence, signal: Signal) -> tuple[list, Plan, list]:
    """(stages before, as columns; the steps; stages after, as columns) of a pipeline's stages."""
    column = lambda st: st.kind in ("expression", "keys", "own", "tap")
    first = next((i for i, st in enumerate(stages) if not column(st)), len(stages))
    last = max((i for i, st in enumerate(stages) if not column(st)), default=first - 1)
    made, more, shape, arrays = [], [], "rows", False
    for st in stages[first : last + 1]:
        if st.kind in ("keys", "own", "tap"):
            raise ValueError(f"on a stream {st.name} comes before the first or after the last stage with a state")
        step, columns = _step(st.name, st.kind, st.build, st.params, signal)
        if columns and shape != "rows":
            raise ValueError(f"{st.name} reads columns that are gone on another grid")
        if st.name == "align" and not signal.ts or isinstance(step, S.Window) and step.span is not None and (not signal.ts or shape == "frame_idx"):
            raise ValueError("durations and alignment need timestamps")
        if arrays != (st.name in ("flatten", "mel", "mfcc", "dct")) and (arrays or st.name in ("flatten", "mel", "mfcc", "dct")):
            raise ValueError(f"{st.name} does not take {'frames' if arrays else 'samples'}")
        if isinstance(step, (S.Resample, S.Align, S.Flatten)):
            shape, arrays = "idx", False
        elif isinstance(step, S.Frames):
            shape, arrays = "frame_idx", st.name != "hilbert"
        made.append(step)
        more += columns
    return list(stages[:first]), Plan(tuple(made), shape, arrays, tuple(dict.fromkeys(more))), list(stages[last + 1 :])


def _fold(stages: Sequence, s: Signal) -> Signal:
    from ..plans.pipeline import Pipeline

    return Pipeline(tuple(stages)).signal(s) if stages else s


def _schema(plan: Plan, s: Signal, late: bool) -> T.StructType:
    value = T.StructField(s.value, T.ArrayType(T.DoubleType()) if plan.arrays else T.DoubleType())
    if plan.shape == "rows":
        fields = [value if f.name == s.value else f for f in s.df.schema]
    else:
        fields = [s.df.schema[k] for k in s.keys] + [T.StructField(plan.shape, T.LongType())]
        # timestamps are renewed by resampling and alignment; frames have none
        fields += [T.StructField(s.ts, T.LongType())] if _timed(plan, s) else []
        fields.append(value)
    return T.StructType(fields + ([T.StructField(LATE, T.BooleanType())] if late else []))


def _timed(plan: Plan, s: Signal) -> bool:
    return bool(s.ts) and plan.shape == "idx" and not any(isinstance(x, (S.Frames, S.Flatten)) for x in plan.steps)


class Runner:
    """Runs a plan over the rows of a series as a record batch."""

    def __init__(self, plan: Plan, s: Signal, reset: str | None):
        self.plan, self.keys, self.value, self.ts, self.columns, self.reset, self.order = plan, list(s.keys), s.value, s.ts, list(s.df.columns), reset, list(s.order)
        self.timed = _timed(plan, s)

    def us(self, f: pa.RecordBatch) -> np.ndarray:
        return f.column(self.ts).cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy()

    def rows(self, f: pa.RecordBatch) -> S.Rows:
        x = recursive.doubles(f, [self.value, *self.plan.more])
        return S.Rows(x[:, 0], self.us(f) if self.ts else None, np.arange(f.num_rows), None, {c: x[:, 1 + j] for j, c in enumerate(self.plan.more)})

    def run(self, state, f: pa.RecordBatch):
        """(columns out of each part, state); ``f`` is in order. A row whose ``reset`` is true starts its series anew."""
        cuts, again = [0, f.num_rows], set()
        if self.reset:
            again = set(np.flatnonzero(f.column(self.reset).fill_null(False).to_numpy(zero_copy_only=False)).tolist())
            cuts = sorted({*cuts, *again})
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            if state is None or lo in again:
                state = self.plan.start()
            part = f.slice(lo, hi - lo)
            r, state = self.plan.run(state, self.rows(part))
            if len(r):
                out.append(self.made(part, r))
        return out, state

    def made(self, f: pa.RecordBatch, r: S.Rows) -> list[pa.Array]:
        """The columns of ``_schema``, but for that of late rows."""
        value = pa.array(np.ascontiguousarray(r.value, np.float64).ravel())
        if r.value.ndim == 2:
            value = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * r.value.shape[1]), value)
        if self.plan.shape == "rows":
            return [value if c == self.value else f.column(c).take(pa.array(r.place)) for c in self.columns]
        first = pa.array(np.zeros(len(r), np.int64))
        return [*[f.column(k).take(first) for k in self.keys], pa.array(r.index, pa.int64()), *([pa.array(r.us, pa.int64())] if self.timed else []), value]

    def late(self, f: pa.RecordBatch) -> list[pa.Array]:
        """Of rows as they came: the columns that they have, no value of a step."""
        if self.plan.shape == "rows":
            return [f.column(c) for c in self.columns]
        nothing = pa.nulls(f.num_rows)
        return [*[f.column(k) for k in self.keys], nothing, *([pa.array(self.us(f))] if self.timed else []), nothing]


def _to_bytes(f: pa.RecordBatch) -> bytes:
    return f.serialize().to_pybytes()


class PipelineProcessor(pieces.PieceProcessor):
    """A series' rows in order through the steps, from the state that the last micro-batch left.

    With ``late_us``, rows wait until the series has got so far beyond them, then go on in order; a row that comes after its time has gone on is given out as it came, marked late.
    """

    def __init__(self, runner: Runner, late_us: int | None, read: T.StructType, made: T.StructType):
        super().__init__(read, made)
        self.runner, self.late_us = runner, late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(STATE, T.StructType([T.StructField("steps", T.BinaryType()), T.StructField("waiting", T.BinaryType()), T.StructField("horizon", T.LongType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((bytes(initialState[-1]), None, None))

    def _batch(self, columns: list[pa.Array], late: bool | None = None) -> pa.RecordBatch:
        return pieces.cast([*columns, *([] if late is None else [pa.array(np.full(len(columns[0]), late))])], self.made)

    def handle(self, f: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        run = self.runner
        steps, waiting, horizon = self.state.get() or (None, None, None)
        steps = None if steps is None else unpack(steps)
        if self.late_us is None:
            out, steps = run.run(steps, pieces.ordered(f, run.order))
            self.state.update((pack(steps), None, None))
            for columns in out:
                yield self._batch(columns)
            return
        if horizon is not None:
            gone = run.us(f) < horizon
            if gone.any():
                yield self._batch(run.late(f.filter(pa.array(gone))), True)
                f = f.filter(pa.array(~gone))
        if waiting is not None:
            f = pieces.join([pieces.read(bytes(waiting), self.read), f])
        if not f.num_rows:
            return
        f = pieces.ordered(f, run.order)
        us = run.us(f)
        # all before the horizon go on; rows of the horizon's own time may still come
        horizon = max(int(us.max()) - self.late_us, -(1 << 62) if horizon is None else horizon)
        n = int((us < horizon).sum())
        go, stay = f.slice(0, n), f.slice(n)
        if n:
            out, steps = run.run(steps, go)
            for columns in out:
                yield self._batch(columns, False)
        self.state.update((None if steps is None else pack(steps), _to_bytes(stay), horizon))


def run_stream(stages: Sequence, signal: Signal, late_ms: float | None = None, initial: DataFrame | None = None, reset: str | None = None) -> Signal:
    """The signal after all stages, on a stream.

    Rows of a series must come in order from one micro-batch to the next (in one they are sorted), unless ``late_ms`` is given: then rows wait until their series has
    got that much beyond them, and rows that come later still are marked in a column ``late``, with the value that they came with (on another grid: none); the last ``late_ms`` of a
    series stay in the state until more come. ``initial`` are rows (keys, state) of ``states`` or ``saved_states``, from which series go on. ``reset`` names a
    boolean column; a row where it is true starts its series anew. A null key is a series of its own. Needs the RocksDB state store provider.
    """
    before, plan, after = compile_(stages, signal)
    s = _fold(before, signal)
    if not plan.steps and late_ms is None:
        return _fold(after, s)
    late = late_ms is not None
    if late and (not s.ts or s.order[0] != s.ts or late_ms < 0):
        raise ValueError("rows out of order need timestamps first in the order, and a wait of zero or more")
    if late and LATE in s.df.columns:
        raise ValueError(f"the column {LATE} is taken")
    if pieces.ROWS in s.keys:
        raise ValueError(f"the column {pieces.ROWS} is taken")
    more = {} if initial is None else {"initialState": initial.select(*s.keys, STATE).groupBy(*s.keys)}
    made = _schema(plan, s, late)
    out = pieces.transform(s.df, s.keys, PipelineProcessor(Runner(plan, s, reset), round(late_ms * 1000) if late else None, s.df.schema, made), made, **more)
    if plan.shape != "rows" and s.ts in out.columns:
        out = out.withColumn(s.ts, F.timestamp_micros(F.col(s.ts)))
    order = s.order if plan.shape == "rows" else (plan.shape,)
    return _fold(after, s.with_(out, order=order, ts=s.ts if s.ts in out.columns else None))


def states(stages: Sequence, signal: Signal) -> DataFrame:
    """Rows (keys, state): what the steps have kept at the end of each series of a batch, for a stream (or another batch) to go on from."""
    before, plan, _ = compile_(stages, signal)
    s = _fold(before, signal)
    keys, schema = list(s.keys), T.StructType([*[s.df.schema[k] for k in s.keys], T.StructField(STATE, T.BinaryType())])
    need = list(dict.fromkeys([*keys, *s.order, s.value, *([s.ts] if s.ts else []), *plan.more]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, state, row = recursive.Cuts(keys), None, None

        def ended():
            return pa.RecordBatch.from_arrays([*row, pa.array([pack(state)], pa.binary())], names=[*keys, STATE])

        for b in batches:
            if not b.num_rows:
                continue
            x = recursive.doubles(b, [s_value, *plan.more])
            us = b.column(b.schema.get_field_index(ts)).cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy() if ts else None
            for lo, hi, new in cuts(b):
                if new:
                    if row is not None:
                        yield ended()
                    state, row = plan.start(), [b.column(b.schema.get_field_index(k)).slice(lo, 1) for k in keys]
                more = {c: x[lo:hi, 1 + j] for j, c in enumerate(plan.more)}
                _, state = plan.run(state, S.Rows(x[lo:hi, 0], None if us is None else us[lo:hi], np.arange(hi - lo), None, more))
        if row is not None:
            yield ended()

    s_value, ts = s.value, s.ts
    return recursive.sorted_rows(s.with_(s.df.select(*need))).mapInArrow(run, schema)


def saved_states(spark: SparkSession, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, state, waiting, horizon) of a stopped stream's checkpoint: each series' steps, how many bytes of rows wait, and the time before which rows have gone on."""
    rows = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    held = F.coalesce(F.octet_length("value.waiting"), F.lit(0)).alias("waiting")
    return rows.select(*[F.col(f"key.{k}").alias(k) for k in keys], F.col("value.steps").alias(STATE), held, F.col("value.horizon").alias("horizon"))


def describe_states(saved: DataFrame) -> DataFrame:
    """``saved`` with the number of steps, and of numbers kept, of each series' state."""

    def run(batches):
        for b in batches:
            each = [unpack(x.as_py()) for x in b.column(b.schema.get_field_index(STATE))]
            extra = [pa.array([len(x) for x in each], pa.int32()), pa.array([_numbers(x) for x in each], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "steps", "numbers"])

    schema = T.StructType([*saved.schema.fields, T.StructField("steps", T.IntegerType()), T.StructField("numbers", T.LongType())])
    return saved.mapInArrow(run, schema)


def _numbers(x) -> int:
    return sum(map(_numbers, x)) if isinstance(x, tuple) else x.size if isinstance(x, np.ndarray) else 0 if x is None else 1


def split_late(kept: str, late: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows of a stream with ``late_ms`` to the table at ``kept``, late ones to that at ``late``; a batch that runs again writes its own folder again."""

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        for path, rows in ((kept, df.where(~F.col(LATE))), (late, df.where(LATE))):
            rows.drop(LATE).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        df.unpersist()

    return write
