"""Timing quality of a signal: drift, gaps, order, rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.signal import Signal


def _deltas(s: Signal) -> DataFrame:
    us = F.unix_micros(F.col(s.ts))
    return s.df.withColumn("delta_ms", (us - F.lag(us).over(s.window())) / 1000.0)


def drift(s: Signal, rate: float, threshold_percent: float = 10.0) -> DataFrame:
    """Each interval with its drift from 1000 / rate ms, absolute and in percent, and whether it is an event."""
    expected = 1000.0 / rate
    d = _deltas(s).where("delta_ms is not null")
    d = d.withColumn("drift_ms", F.abs(F.col("delta_ms") - expected))
    d = d.withColumn("drift_percent", F.col("drift_ms") / expected * 100)
    return d.withColumn("is_drift", F.col("drift_percent") > threshold_percent)


def drift_metrics(s: Signal, rate: float, threshold_percent: float = 10.0) -> DataFrame:
    return drift(s, rate, threshold_percent).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("intervals"),
        F.sum(F.col("is_drift").cast("bigint")).alias("events"),
        F.min("delta_ms").alias("min_delta"),
        F.max("delta_ms").alias("max_delta"),
        F.avg("delta_ms").alias("avg_delta"),
        F.stddev_pop("delta_ms").alias("std_delta"),
    )


def gaps(s: Signal, rate: float, threshold: float = 2.0) -> DataFrame:
    """Intervals longer than ``threshold`` times the expected one, with the samples that are missing."""
    expected = 1000.0 / rate
    d = _deltas(s).where(F.col("delta_ms") > threshold * expected)
    return d.withColumn("expected_samples", (F.floor(F.col("delta_ms") / expected) - 1).cast("bigint"))


def gap_statistics(s: Signal, rate: float, threshold: float = 2.0) -> DataFrame:
    return gaps(s, rate, threshold).groupBy(*s.keys).agg(F.count(F.lit(1)).alias("gaps"), F.min("delta_ms").alias("min_gap"), F.max("delta_ms").alias("max_gap"))


def monotonicity(s: Signal, arrival: str) -> DataFrame:
    """Rows whose timestamp, in order of arrival, goes backwards or repeats the one before."""
    by_arrival = s.with_(s.df, order=(arrival,))
    d = _deltas(by_arrival).where(F.col("delta_ms") <= 0)
    return d.withColumn("violation", F.when(F.col("delta_ms") < 0, "backwards").otherwise("duplicate"))


def sample_rate(s: Signal) -> DataFrame:
    """Rate, spread and a class of regularity of each series."""
    g = _deltas(s).where("delta_ms is not null").groupBy(*s.keys).agg(F.avg("delta_ms").alias("avg_delta"), F.stddev_pop("delta_ms").alias("std_delta"))
    g = g.withColumn("rate", 1000.0 / F.col("avg_delta")).withColumn("cv", F.col("std_delta") / F.col("avg_delta"))
    cv = F.col("cv")
    return g.withColumn("regularity", F.when(cv < 0.01, "excellent").when(cv < 0.05, "good").when(cv < 0.15, "fair").when(cv < 0.3, "poor").otherwise("very poor"))
