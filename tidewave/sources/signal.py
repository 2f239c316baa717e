"""A signal is a DataFrame with named roles: series keys, a total order, a value."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Signal:
    """``keys`` name a series (and channel), ``order`` is a total order in it, ``ts`` a timestamp for time windows.

    ``on_null`` says what a null sample means: "error" (checked when the plan runs), "drop", "zero" or "hold" (the last value).
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    value: str = "value"
    ts: str | None = None

    @classmethod
    def of(cls, df: DataFrame, keys, order, value: str = "value", ts: str | None = None, on_null: str = "error") -> Signal:
        keys, order = tuple(keys), tuple(order)
        missing = [c for c in (*keys, *order, value, *([ts] if ts else [])) if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        if not order:
            raise ValueError("a signal needs an order")
        if ts and dict(df.dtypes)[ts] == "timestamp_ntz":
            df = df.withColumn(ts, F.col(ts).cast("timestamp"))
        v = F.col(value).cast("double")
        if on_null == "drop":
            df = df.where(F.col(value).isNotNull())
        elif on_null == "zero":
            v = F.coalesce(v, F.lit(0.0))
        elif on_null == "hold":
            w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            v = F.last(v, ignorenulls=True).over(w)
        elif on_null == "error":
            v = F.coalesce(v, F.raise_error(F.lit(f"null sample in {value}")).cast("double"))
        else:
            raise ValueError("on_null is error, drop, zero or hold")
        return cls(df.withColumn(value, v), keys, order, value, ts)

    def with_(self, df: DataFrame, **roles) -> Signal:
        return replace(self, df=df, **roles)

    def window(self):
        """The one partition and order of all stages, so that their windows share an exchange and a sort."""
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, k: int):
        """The last k samples, this one included; fewer at the start."""
        if k < 1:
            raise ValueError("a window holds at least one sample")
        return self.window().rowsBetween(-(k - 1), 0)

    def span(self, milliseconds: float):
        """Samples in (t - d, t], by whole microseconds."""
        if not self.ts:
            raise ValueError("a time window needs a timestamp column")
        d = round(milliseconds * 1000)
        if d < 1:
            raise ValueError("a time window is longer than zero")
        return Window.partitionBy(*self.keys).orderBy(F.unix_micros(F.col(self.ts))).rangeBetween(-(d - 1), 0)

    def frame(self, size: int | None = None, duration_ms: float | None = None):
        if (size is None) == (duration_ms is None):
            raise ValueError("give either a size or a duration")
        return self.rows(size) if size is not None else self.span(duration_ms)

    def whole(self):
        return Window.partitionBy(*self.keys)

    @property
    def v(self) -> Column:
        return F.col(self.value)


def planar_to_long(df: DataFrame, keep: list[str], channels: list[str], channel: str = "channel", value: str = "value") -> DataFrame:
    """One row per sample and channel from one column per channel."""
    pairs = F.array(*[F.struct(F.lit(i).alias(channel), F.col(c).cast("double").alias(value)) for i, c in enumerate(channels)])
    return df.select(*keep, F.inline(pairs))


def interleave(df: DataFrame, keep: list[str], order: list[str], channels: list[str], value: str = "value") -> DataFrame:
    """Samples in the order s0c0, s0c1, s1c0, ...: position ``idx`` in each series of ``keep``."""
    w = Window.partitionBy(*keep).orderBy(*order)
    n = len(channels)
    numbered = df.withColumn("_i", (F.row_number().over(w) - 1).cast("bigint"))
    pairs = F.array(*[F.struct((F.col("_i") * n + i).alias("idx"), F.col(c).cast("double").alias(value)) for i, c in enumerate(channels)])
    return numbered.select(*keep, F.inline(pairs))


def deinterleave(df: DataFrame, keys: list[str], channels: int, idx: str = "idx", value: str = "value") -> DataFrame:
    """Rows (keys, sample, c0, c1, ...) from interleaved positions; an incomplete last sample is an error.

    Samples are dealt to tasks by themselves and come together in a sort, which spills; a grouping would hold each sample of a task in two hash maps, beside the sort of the
    stage before.
    """
    sample = F.floor(F.col(idx) / channels)
    rows = df.select(*keys, sample.alias("sample"), F.col(idx).alias("_idx"), F.col(value).alias("_value")).repartition(*keys, "sample")
    w = Window.partitionBy(*keys, "sample").orderBy("_idx")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda i: F.max(F.when(F.pmod("_idx", F.lit(channels)) == i, F.col("_value"))).over(every)
    made = rows.select("*", F.row_number().over(w).alias("_first"), F.count(F.lit(1)).over(every).alias("_n"), *[of(i).alias(f"c{i}") for i in range(channels)])
    whole = F.when(F.col("_n") == channels, F.col("c0")).otherwise(F.raise_error(F.lit("length is no multiple of the channels")).cast("double"))
    return made.where("_first = 1").select(*keys, "sample", whole.alias("c0"), *[f"c{i}" for i in range(1, channels)])


def get_channel(df: DataFrame, k: int, channel: str = "channel") -> DataFrame:
    return df.where(F.col(channel) == k)
