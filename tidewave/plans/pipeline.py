"""A pipeline is a list of stage specifications; ``signal`` folds it into one lazy DataFrame with its roles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import expr, kernels as K
from ..operators import channels, frames, models, recursive, resample, windows
from ..sources.signal import Signal


@dataclass(frozen=True)
class Stage:
    """kind: expression (a column of the value), window (a column over the window), kernel (a sequential kernel), frame (a DataFrame with the value),
    signal (a new Signal: another grid, frames or channels), array (a column of an array value), keys (a filter on channels), own or tap."""

    name: str
    kind: str
    build: Callable
    params: dict = field(default_factory=dict)


def _e(fn):
    return "expression", lambda s, **p: fn(s.v, **p)


def _w(fn):
    return "window", fn


def _f(fn):
    return "frame", lambda s, **p: fn(s, out="_out", **p)


def _regrid(fn):
    """A stage that makes rows (keys, idx, value) and, if there are timestamps, these renewed."""

    def build(s: Signal, **p) -> Signal:
        df = fn(s, out=s.value, **p)
        if s.ts and s.ts not in df.columns:
            df = df.withColumn(s.ts, F.timestamp_micros("t_us")).drop("t_us")
        return s.with_(df, order=("idx",))

    return "signal", build


def _framed(fn, value: str):
    """A stage that makes a row for each frame, in order of frame_idx."""
    return "signal", lambda s, **p: Signal(fn(s, **p).withColumnRenamed(value, s.value), s.keys, ("frame_idx",), s.value)


def _fft(s: Signal, size: int, form: str = "magnitude") -> DataFrame:
    return frames.stft(s, size, size, "none", form)


def _dwt(s: Signal, size: int, name: str = "haar") -> DataFrame:
    return frames.frames(s, size).withColumn("values", frames.dwt("values", name))


def _bank(s: Signal, bands: Sequence, channel: str = "channel") -> Signal:
    """Every band is a series of its own, named by out_channel."""
    df = recursive.filter_bank(s, bands, channel, "_out").drop(s.value).withColumnRenamed("_out", s.value)
    return s.with_(df.drop("band"), keys=(*s.keys, "out_channel"))


def _model(s: Signal, model: models.Model, components: int | None = None, output: int = 0) -> Signal:
    """Columns y0, y1, ... of a fitted PCA, whitening, ICA or CSP model; the value goes on as the column ``output``."""
    return s.with_(model.transform(s.df, components), value=f"y{output}")


def _gsc(s: Signal, columns: Sequence[str], weights, blocking) -> Signal:
    return s.with_(models.gsc(s.df, columns, weights, blocking), value="beam")


def _kalman(s: Signal, out: str, **p) -> DataFrame:
    return recursive.kalman(s, [s.value], **p).withColumnRenamed(f"kf_{s.value}", out)


def _flatten(s: Signal) -> Signal:
    """The elements of frames as samples, one after the other."""
    rows = s.df.select(*s.keys, "frame_idx", F.posexplode(s.value).alias("_p", "_v"), F.size(s.value).alias("_n"))
    idx = (F.col("frame_idx") * F.col("_n") + F.col("_p")).cast("bigint").alias("idx")
    return Signal(rows.select(*s.keys, idx, F.col("_v").alias(s.value)), s.keys, ("idx",), s.value)


#: Stage name -> kind and builder. Builders of kind frame put their value in the column _out.
STAGES: dict[str, tuple[str, Callable]] = {
    "rectify": _e(expr.rectify),
    "square": _e(expr.square),
    "amplify": _e(expr.amplify),
    "clip_detection": _e(expr.clip_detection),
    "to_decibels": _e(expr.to_decibels),
    "moving_average": _w(windows.moving_average),
    "rms": _w(windows.rms),
    "mean_absolute_value": _w(windows.mean_absolute_value),
    "variance": _w(windows.variance),
    "z_score": _w(windows.z_score),
    "cumulative_average": _w(windows.cumulative_average),
    "difference": _w(windows.difference),
    "snr": _w(windows.snr),
    "waveform_length": _f(windows.waveform_length),
    "slope_sign_changes": _f(windows.slope_sign_changes),
    "willison_amplitude": _f(windows.willison_amplitude),
    "linear_regression": _f(windows.linear_regression),
    "detrend": _f(windows.detrend),
    "entropy_tracker": _f(windows.entropy_tracker),
    "peaks": _f(windows.peaks),
    "spaced_peaks": _f(recursive.spaced_peaks),
    "ema": ("kernel", K.Ema),
    "integrate": ("kernel", K.LeakyIntegrator),
    "filter": ("kernel", recursive.filter_kernel),
    "convolve": ("kernel", recursive.filter_kernel),
    "lms": _f(recursive.lms),
    "rls": _f(recursive.rls),
    "kalman": _f(_kalman),
    "filter_bank": ("signal", _bank),
    "decimate": _regrid(resample.decimate),
    "interpolate": _regrid(resample.interpolate),
    "resample": _regrid(resample.resample),
    "align": _regrid(resample.align),
    "frames": _framed(frames.frames, "values"),
    "fft": _framed(_fft, "spectrum"),
    "stft": _framed(frames.stft, "spectrum"),
    "hilbert": _framed(frames.hilbert_envelope, "envelope"),
    "wavelet": _framed(_dwt, "values"),
    "flatten": ("signal", _flatten),
    "mel": ("array", frames.mel_spectrogram),
    "mfcc": ("array", frames.mfcc),
    "dct": ("array", lambda df, column, out: df.withColumn(out, frames.dct(column))),
    "transform": ("signal", _model),
    "gsc": ("signal", _gsc),
}
#: Of more taps a FIR runs as a convolution in the scan; shorter ones are a window expression that shares the exchange of the windows beside it.
SHORT = recursive.LAG_TAPS


class Pipeline:
    """Stages in order, e.g. ``Pipeline().rectify().moving_average(size=5)``; immutable, parameters are checked when a plan is made."""

    def __init__(self, stages: tuple[Stage, ...] = (), watchers: tuple[Callable, ...] = ()):
        self.stages, self.watchers = stages, watchers

    def _with(self, *stages: Stage) -> Pipeline:
        return Pipeline((*self.stages, *stages), self.watchers)

    def __getattr__(self, name: str):
        if name not in STAGES:
            raise AttributeError(name)
        kind, build = STAGES[name]
        return lambda **params: self._with(Stage(name, kind, build, params))

    def channel_select(self, selected: list[int]) -> Pipeline:
        return self._with(Stage("channel_select", "keys", lambda s, selected: channels.channel_select(s.df, selected), {"selected": selected}))

    def channel_merge(self, mapping: list[int]) -> Pipeline:
        return self._with(Stage("channel_merge", "keys", lambda s, mapping: channels.channel_merge(s.df, mapping), {"mapping": mapping}))

    def channel_selector(self, n: int) -> Pipeline:
        return self._with(Stage("channel_selector", "keys", lambda s, n: channels.channel_selector(s.df, n), {"n": n}))

    def apply(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """A stage of the user's own."""
        return self._with(Stage(name, "own", lambda s: fn(s.df)))

    def tap(self, fn: Callable[[DataFrame], None]) -> Pipeline:
        """Hand the DataFrame at this point to ``fn``."""
        return self._with(Stage("tap", "tap", lambda s: fn(s.df)))

    def observe(self, name: str) -> Pipeline:
        """Count, least and largest value at this point, by way of an observed metric of the running query."""
        return self._with(Stage("observe", "own", lambda s: s.df.observe(name, F.count(F.lit(1)).alias("n"), F.min(s.value).alias("low"), F.max(s.value).alias("high"))))

    def on_stage(self, fn: Callable[[str, DataFrame], None]) -> Pipeline:
        """``fn`` gets each stage's name and DataFrame as the plan is made."""
        return Pipeline(self.stages, (*self.watchers, fn))

    def optimized(self, signal: Signal | None = None) -> Pipeline:
        """Gains next to each other become one; a channel selection moves before stages that work on each channel by itself, if the signal's keys hold the channel."""
        out: list[Stage] = []
        for s in self.stages:
            if s.name == "amplify" and out and out[-1].name == "amplify":
                gain = expr_gain(out[-1]) * expr_gain(s)
                out[-1] = Stage("amplify", s.kind, s.build, {"gain": gain})
                continue
            at = len(out)
            if s.kind == "keys":
                while at and (out[at - 1].kind == "expression" or signal is not None and "channel" in signal.keys and out[at - 1].kind in ("window", "frame", "kernel")):
                    at -= 1
            out.insert(at, s)
        return Pipeline(tuple(out), self.watchers)

    def signal(self, signal: Signal) -> Signal:
        """The signal after all stages. Kernels next to each other run in one scan."""
        s = signal
        stages = self.optimized(signal).stages
        waiting: list = []
        for i, st in enumerate(stages):
            if st.kind == "kernel":
                kernel = st.build(**st.params)
                last = i + 1 == len(stages) or stages[i + 1].kind != "kernel"
                if not waiting and last and isinstance(kernel, K.Fir) and len(kernel.b) <= SHORT:
                    s = s.with_(s.df.withColumn(s.value, windows.weighted_lags(s, list(kernel.b))))
                else:
                    waiting.append(kernel)
                    if last:
                        s = self._put(s, recursive.scan(s, waiting[0] if len(waiting) == 1 else K.Chain(tuple(waiting)), outputs=["_out"]))
                        waiting = []
            elif st.kind in ("expression", "window"):
                s = s.with_(s.df.withColumn(s.value, st.build(s, **st.params)))
            elif st.kind == "frame":
                s = self._put(s, st.build(s, **st.params))
            elif st.kind == "signal":
                s = st.build(s, **st.params)
            elif st.kind == "array":
                s = s.with_(st.build(s.df, column=s.value, out=s.value, **st.params))
            elif st.kind == "tap":
                st.build(s)
            else:
                s = s.with_(st.build(s, **st.params))
            if not waiting:
                for fn in self.watchers:
                    fn(st.name, s.df)
        return s

    @staticmethod
    def _put(s: Signal, df: DataFrame) -> Signal:
        return s.with_(df.drop(s.value).withColumnRenamed("_out", s.value).select(*s.df.columns))

    def run(self, signal: Signal) -> DataFrame:
        return self.stream(signal) if signal.df.isStreaming else self.signal(signal).df

    def stream(self, signal: Signal, late_ms: float | None = None, initial: DataFrame | None = None, reset: str | None = None) -> DataFrame:
        """The same on a stream: all stages with a state in one stateful operator. See ``streaming.pipelines.run_stream``."""
        from ..streaming.pipelines import run_stream

        return run_stream(self.optimized(signal).stages, signal, late_ms, initial, reset).df

    def states(self, signal: Signal) -> DataFrame:
        """Rows (keys, state) at the end of each series of a batch, for ``stream`` to go on from."""
        from ..streaming.pipelines import states

        return states(self.optimized(signal).stages, signal)

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [(i, st.name, st.kind, {k: str(v) for k, v in st.params.items()}) for i, st in enumerate(self.stages)]
        return spark.createDataFrame(rows, "stage int, name string, kind string, params map<string,string>")


def expr_gain(stage: Stage) -> float:
    gain = float(stage.params["gain"])
    if not gain > 0:
        raise ValueError("gain must be positive")
    return gain
