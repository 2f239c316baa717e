"""Row windows, regressions and resampling within one giant series: a distributed row number, slices of rows, and copies of the rows before a slice.

Rows are range-partitioned by series and order, counted by partition, and numbered by offsets of those counts; a slice of a series is then a partition of its own,
with as many rows of the one before as its windows reach back. So a series with any share of all rows spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.signal import Signal

#: The row number in its series, from 0.
INDEX = "row_index"
_PIECE = "_piece"


def numbered(s: Signal, partitions: int | None = None) -> Signal:
    """``s`` with each row's number in its series, from 0, as the column ``row_index``; no task holds more of a series than a partition of the range.

    Rows are written once to the shared folder, as the bounds of the range come from a sample and would differ if it were drawn again. Rows that tie in the whole order
    are numbered in some order.
    """
    from ..streaming.replay import shared_folder

    if INDEX in s.df.columns or _PIECE in s.df.columns:
        raise ValueError(f"the column {INDEX} is taken")
    spark, by = s.df.sparkSession, [*s.keys, *s.order]
    n = [partitions] if partitions else []
    path = shared_folder(spark).replace("/stream-", "/rows-")
    ranged = s.df.repartitionByRange(*n, *[F.col(c).asc_nulls_first() for c in by]).withColumn(_PIECE, F.spark_partition_id())
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    # a row for each partition of the range and series in it
    counts = rows.groupBy(*s.keys, _PIECE).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*s.keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(s.keys)], F.col(_PIECE).alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*s.keys, _PIECE).orderBy(*s.order))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(s.keys)] + [F.col(_PIECE) == F.col("_p")]
    joined = rows.withColumn("_own", own).join(offsets, same)
    return s.with_(joined.select(*s.df.columns, (F.col("_before") + F.col("_own") - 1).alias(INDEX)))


def _sliced(s: Signal, back: int, width: int) -> Signal:
    """Rows of each slice of ``width`` and, in it too, the ``back`` rows before it: columns _slice, and _mine, where the row belongs."""
    if INDEX not in s.df.columns:
        raise ValueError("number the rows first")
    if not 0 <= back <= width or width < 1:
        raise ValueError("a slice is at least as wide as its windows reach back")
    mine = F.floor(F.col(INDEX) / width).cast("bigint")
    parts = F.when(F.col(INDEX) + back >= (mine + 1) * width, F.array(mine, mine + 1)).otherwise(F.array(mine))
    rows = s.df.select("*", mine.alias("_mine"), F.explode(parts).alias("_slice"))
    return s.with_(rows, keys=(*s.keys, "_slice"), order=(INDEX,))


def in_row_slices(s: Signal, stage: Callable[[Signal], Column | DataFrame], back: int, width: int, out: str = "y") -> DataFrame:
    """A stage that looks at a row and the ``back`` rows before it (a Column of a Signal, or a DataFrame with the column ``out``), over a ``numbered`` signal, parallel within a series.

    At most ``back`` rows are copied for each slice.
    """
    t = _sliced(s, back, width)
    got = stage(t)
    df = got if isinstance(got, DataFrame) else t.df.withColumn(out, got)
    return df.where("_mine = _slice").drop("_mine", "_slice")


def resample_sliced(s: Signal, up: int, down: int, order: int = 51, width: int = 100_000, out: str = "y") -> DataFrame:
    """``resample`` of a ``numbered`` signal, parallel within a series: rows (keys, idx, y), and before y, if there are timestamps, that column renewed."""
    from math import gcd

    from .resample import resample

    g = gcd(up, down)
    u, d = up // g, down // g
    taps = order + 1 - order % 2
    # an output needs the inputs of the filter before its own; its time, timestamps a few samples before and up to two after
    back = -(-taps // u) + 2 - (1 - d) // u
    ahead = 2 if s.ts else 0
    mine = F.floor(F.col(INDEX) / width).cast("bigint")
    if back + ahead > width:
        raise ValueError("a slice is at least as wide as the filter")
    near = [F.when(F.col(INDEX) + back >= (mine + 1) * width, mine + 1), F.when((mine > 0) & (F.col(INDEX) < mine * width + ahead), mine - 1)]
    parts = F.filter(F.array(mine, *near), lambda x: x.isNotNull())
    t = s.with_(s.df.select("*", F.explode(parts).alias("_slice")), keys=(*s.keys, "_slice"), order=(INDEX,))
    df = resample(t, u, d, order, out, index=INDEX)
    belongs = F.floor(F.floor(((F.col("idx") + 1) * d - 1) / u) / width)
    return df.where(belongs == F.col("_slice")).drop("_slice")
