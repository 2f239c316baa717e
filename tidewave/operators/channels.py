"""Channel projections on the long form (a channel column) and affine maps on the wide form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def channel_selector(df: DataFrame, n: int, channel: str = "channel") -> DataFrame:
    """The first n channels."""
    if n < 1:
        raise ValueError("at least one channel")
    return df.where(F.col(channel) < n)


def channel_select(df: DataFrame, channels: Sequence[int], available: int | None = None, channel: str = "channel") -> DataFrame:
    """Output channel i is input channel channels[i]; reorders and duplicates.

    The map is a literal in the plan: a narrow projection, no join.
    """
    if not channels or any(c < 0 or (available is not None and c >= available) for c in channels):
        raise ValueError("a channel is out of bounds")
    places = {c: [i for i, x in enumerate(channels) if x == c] for c in sorted(set(channels))}
    out = F.lit(None).cast("array<int>")
    for c, at in places.items():
        out = F.when(F.col(channel) == c, F.array(*[F.lit(i) for i in at])).otherwise(out)
    rest = [c for c in df.columns if c != channel]
    return df.where(F.col(channel).isin(*places)).select(*rest, F.explode(out).alias(channel)).select(*df.columns)


channel_merge = channel_select


def affine(columns: Sequence[str], mean: Sequence[float], matrix: Sequence[Sequence[float]]) -> list[Column]:
    """The columns of M^T (x - mean) as expressions, one for each column of M."""
    centred = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    out = []
    for j in range(len(matrix[0])):
        total = F.lit(0.0)
        for x, row in zip(centred, matrix, strict=True):
            total = total + x * F.lit(float(row[j]))
        out.append(total)
    return out
