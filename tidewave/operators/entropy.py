"""Sample and approximate entropy of whole series by counting neighbours in a grid.

A template is the m samples from a place and the one after them. Templates lie in cells of the tolerance's width by their first samples; those within the tolerance of one
are in its cell or a neighbouring one, so each cell's templates meet copies of the cells around it, and never the whole series. Equal templates are counted once with
their number. A full cell is cut into chunks of templates, and its neighbours' copies stream past each. A series of few samples is one cell, as its templates
would be copied to nine cells of about one template each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.signal import Signal
from .recursive import Cuts, doubles
from .slices import INDEX, in_row_slices

#: Templates of a cell that are held at a time.
CHUNK = 2048
#: A series of at most so many samples is one cell; fewer than ``CHUNK``.
WHOLE = 512
#: Rows of a slice in which templates are made.
WIDTH = 100_000


def series_entropies(s: Signal, m: int = 2, r: float | None = None, width: int = WIDTH) -> DataFrame:
    """Rows (keys, samples, sample_entropy, approximate_entropy) of each series of a signal whose rows are ``numbered``; r: 0.2 deviations unless given.

    Sample entropy is infinite where no pair of longer templates is near; both are null for a series of fewer than m + 2 samples, which has no pair of templates.
    """
    if m < 1 or r is not None and not r >= 0:
        raise ValueError("m is at least 1, r not negative")
    if INDEX not in s.df.columns:
        raise ValueError("number the rows first")
    keys = list(s.keys)
    dims = min(m, 2)
    xs = [f"_x{i}" for i in range(m + 1)]
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    tol = F.lit(float(r)) if r is not None else 0.2 * F.stddev_pop(s.v)
    whole = s.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.avg(s.v).alias("_mean"), tol.alias("_tol"))

    def template(t: Signal) -> DataFrame:
        w = t.window()
        return t.df.select("*", *[(F.lag(t.v, m - i).over(w) if i < m else t.v).alias(x) for i, x in enumerate(xs)])

    lags = in_row_slices(s, template, m, width).where(F.col(INDEX) >= m - 1).select(*keys, INDEX, *xs)
    # a row ends a template and the sample after it; the last row of a series also ends a template that none follows
    known = lags.join(whole.select(*named, "samples", "_mean", "_tol"), same or F.lit(True)).where(F.col("samples") >= m + 2)
    after = F.array(*xs[1:], F.lit(None).cast("double"))
    both = F.filter(F.array(F.when(F.col(INDEX) >= m, F.array(*xs)), F.when(F.col(INDEX) == F.col("samples") - 1, after)), lambda x: x.isNotNull())
    made = known.select(*keys, "samples", "_mean", "_tol", F.explode(both).alias("_t")).groupBy(*keys, "samples", "_mean", "_tol", "_t").agg(F.count(F.lit(1)).alias("_c"))
    # wider than the tolerance by more than a rounding, so that neighbours are at most a cell apart
    few = F.col("samples") <= WHOLE
    at = lambda i: F.when(few, F.lit(0)).when(F.col("_tol") > 0, F.floor((F.get("_t", F.lit(i)) - F.col("_mean")) / (F.col("_tol") * (1 + 1e-9)))).otherwise(F.xxhash64(F.get("_t", F.lit(i)) + 0.0))
    cells = [f"_cell{i}" for i in range(dims)]
    placed = made.select(*keys, "samples", "_tol", "_t", "_c", *[at(i).cast("bigint").alias(c) for i, c in enumerate(cells)])
    full = placed.groupBy(*keys, *cells).agg((F.floor((F.count(F.lit(1)) - 1) / CHUNK) + 1).cast("int").alias("_chunks"))
    near: list[Column] = [F.explode(F.when(~few & (F.col("_tol") > 0), F.array(*[F.col(c) + d for d in (-1, 0, 1)])).otherwise(F.array(F.col(c)))).alias(c) for c in cells]
    copies = placed
    for c, e in zip(cells, near, strict=True):
        copies = copies.select(*[x for x in copies.columns if x != c], e)
    here = full.select(*named, *[F.col(c).alias(f"{c}n") for c in cells], "_chunks")
    join = same + [F.col(c) == F.col(f"{c}n") for c in cells]
    chunk = F.pmod(F.xxhash64("_t"), F.col("_chunks")).cast("int")
    asks = placed.join(here, join).select(*keys, *cells, chunk.alias("_chunk"), F.lit(0).alias("_side"), "samples", "_tol", "_t", "_c")
    told = copies.join(here, join).select(*keys, *cells, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), F.lit(1).alias("_side"), "samples", "_tol", "_t", "_c")
    group = [*keys, *cells, "_chunk"]
    sums = T.StructType([*[s.df.schema[k] for k in keys], *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("b", T.DoubleType()), ("a", T.DoubleType()), ("p", T.DoubleType()), ("q", T.DoubleType()))]])

    def count(batches):
        cuts, row, ask = Cuts(group), None, None

        def ended():
            """Of a chunk: pairs of sample entropy that are near (b), also in the sample after (a); sums of the logarithms of approximate entropy's shares (p, q)."""
            c, few, most, longer = ask["c"], ask["few"], ask["most"], ask["longer"]
            has = ~np.isnan(ask["t"][:, m])
            n = ask["n"]
            b, a = (c * (few - 1))[has].sum(), (c * (longer - 1))[has].sum()
            p, q = (c * np.log(most / (n - m + 1))).sum(), (c[has] * np.log(longer[has] / (n - m))).sum()
            return pa.RecordBatch.from_arrays([*row, pa.array([n]), *[pa.array([float(x)]) for x in (b, a, p, q)]], names=sums.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            t = pc.list_flatten(col("_t")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, m + 1)
            c, side, tol = doubles(batch, ["_c"])[:, 0], col("_side").to_numpy(), doubles(batch, ["_tol"])[:, 0]
            for lo, hi, new in cuts(batch):
                if new:
                    if row is not None:
                        yield ended()
                    row = [col(k).slice(lo, 1) for k in keys]
                    ask = {"t": np.zeros((0, m + 1)), "c": np.zeros(0), "n": col("samples")[lo].as_py(), "few": None}
                mine, ours = np.arange(lo, hi)[side[lo:hi] == 0], np.arange(lo, hi)[side[lo:hi] == 1]
                ask["t"], ask["c"] = np.concatenate([ask["t"], t[mine]]), np.concatenate([ask["c"], c[mine]])
                if not len(ours):
                    continue
                q = ask["t"]
                if ask["few"] is None:
                    ask |= {k: np.zeros(len(q)) for k in ("few", "most", "longer")}
                step = max(1, (1 << 20) // max(len(q), 1))
                for begin in range(0, len(ours), step):
                    o = ours[begin : begin + step]
                    close = np.ones((len(q), len(o)), bool)
                    for k in range(m):
                        close &= np.abs(q[:, k, None] - t[o, k]) <= tol[lo]
                    followed = ~np.isnan(t[o, m])
                    ask["most"] += close @ c[o]
                    ask["few"] += close @ (c[o] * followed)
                    with np.errstate(invalid="ignore"):
                        close &= np.abs(q[:, m, None] - t[o, m]) <= tol[lo]
                    ask["longer"] += close @ c[o]
        if row is not None:
            yield ended()

    met = asks.unionByName(told).repartition(*group).sortWithinPartitions(*group, "_side").mapInArrow(count, sums)
    total = met.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in ("b", "a", "p", "q")])
    n = F.col("samples")
    total = total.select(*named, "_b", "_a", "_p", "_q")
    sample = F.when((F.col("_a") > 0) & (F.col("_b") > 0), -F.log(F.col("_a") / F.col("_b")) + 0.0).otherwise(F.lit(float("inf")))
    approximate = F.col("_p") / (n - m + 1) - F.col("_q") / (n - m)
    given = F.col("_p").isNotNull()
    joined = whole.select(*keys, "samples").join(total, same or F.lit(True), "left")
    return joined.select(*keys, "samples", F.when(given, sample).alias("sample_entropy"), approximate.alias("approximate_entropy"))
