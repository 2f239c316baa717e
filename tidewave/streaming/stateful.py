"""Kernels and row windows on streams: state by series, kept by Spark's state store and its checkpoints."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessorHandle, StreamingQueryListener

from ..functions.states import pack, unpack
from ..operators.recursive import doubles
from . import pieces


class RowWindow:
    """A kernel of trailing windows: ``fn`` of the last ``size`` samples, fewer at the start."""

    def __init__(self, size: int, fn):
        self.size, self.fn = size, fn

    def start(self):
        return (np.zeros(0),)

    def run(self, state, x):
        whole = np.concatenate([state[0], x[:, 0]])
        n = len(state[0])
        out = np.array([self.fn(whole[max(0, i + 1 - self.size) : i + 1]) for i in range(n, len(whole))])
        return out, (whole[max(0, len(whole) - self.size + 1) :],)


class TimeWindow:
    """The same of the samples in (t - d, t]; the inputs are the value and microseconds."""

    def __init__(self, duration_ms: float, fn):
        self.d, self.fn = round(duration_ms * 1000), fn

    def start(self):
        return np.zeros(0), np.zeros(0)

    def run(self, state, x):
        v, t = np.concatenate([state[0], x[:, 0]]), np.concatenate([state[1], x[:, 1]])
        n = len(state[0])
        low = np.searchsorted(t, t[n:] - self.d, "right")
        out = np.array([self.fn(v[a : i + 1]) for a, i in zip(low, range(n, len(v)))])
        keep = int(low[-1]) if len(low) else 0
        return out, (v[keep:], t[keep:])


class Processor(pieces.PieceProcessor):
    """Runs a kernel over a key's rows of a micro-batch in order, from the state that the last one left."""

    def __init__(self, kernel, order: list[str], inputs: list[str], outputs: list[str], read: T.StructType, made: T.StructType):
        super().__init__(read, made)
        self.kernel, self.order, self.inputs, self.outputs = kernel, order, inputs, outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("kernel", T.BinaryType())]))

    def handle(self, f):
        f = pieces.ordered(f, self.order)
        kept = self.state.get()
        state = self.kernel.start() if kept is None else unpack(kept[0])
        y, state = self.kernel.run(state, doubles(f, self.inputs))
        self.state.update((pack(state),))
        y = np.asarray(y, np.float64).reshape(f.num_rows, -1)
        yield pieces.cast([*f.columns, *[pa.array(y[:, j]) for j in range(len(self.outputs))]], self.made)


def stream(df: DataFrame, kernel, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: Sequence[str] = ("y",)) -> DataFrame:
    """A streaming DataFrame with the kernel's outputs.

    Rows of a series must come in order from one micro-batch to the next, as a sequential stage needs; within a
    batch they are sorted. Needs the RocksDB state store provider.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outputs]])
    return pieces.transform(df, keys, Processor(kernel, list(order), list(inputs), list(outputs), df.schema, schema), schema)


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str], value: str = "value", late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """Mean, least, largest and count of each window of event time; rows later than ``late`` are dropped by the watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (
        df.withWatermark(ts, late)
        .groupBy(*keys, w.alias("w"))
        .agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "low", "high", "n")
    )


def sessions(df: DataFrame, ts: str, gap: str, keys: Sequence[str], value: str = "value", late: str = "0 seconds") -> DataFrame:
    s = df.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return s.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def list_state(spark, checkpoint: str) -> DataFrame:
    """The saved state of a query, by the state data source."""
    return spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)


class Callbacks(StreamingQueryListener):
    """For ``spark.streams.addListener``: ``on_batch`` gets each micro-batch's progress, ``on_error`` a failed query's message, ``on_log`` a
    log row (topic, level, message) of either, if its topic matches one of ``topics``."""

    def __init__(self, on_batch=None, on_error=None, on_log=None, topics: Sequence[str] = ("**",)):
        from ..operators.logs import topic_regex

        self.on_batch, self.on_error, self.on_log = on_batch, on_error, on_log
        self.topics = [re.compile(topic_regex(t)) for t in topics]

    def log(self, topic: str, level: str, message: str) -> None:
        if self.on_log and any(t.match(topic) for t in self.topics):
            self.on_log({"topic": topic, "level": level, "message": message})

    def onQueryStarted(self, event) -> None:
        self.log("pipeline.started", "info", str(event.id))

    def onQueryProgress(self, event) -> None:
        if self.on_batch:
            self.on_batch(event.progress)
        self.log("pipeline.batch.performance", "info", f"{event.progress.numInputRows} rows in {event.progress.batchDuration} ms")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception and self.on_error:
            self.on_error(event.exception)
        self.log("pipeline.error" if event.exception else "pipeline.ended", "error" if event.exception else "info", event.exception or str(event.id))
