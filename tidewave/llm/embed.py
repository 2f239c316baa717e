"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector, padded to ``width`` dimensions, is turned by a random rotation; the signs are its code x
and <x, v> (x scaled to length one) its correction factor f. For another turned unit vector q, <x, q> / f
is an unbiased estimate of <v, q>, off by more than WIDTH * sqrt((1 - f^2) / (f^2 (width - 1))) with a
chance that falls as exp(-WIDTH^2 / 2). Code, factor and the turned vector itself, rounded to four bits a dimension with a dither so that the
estimate stays unbiased, are made once and stored; only they go to the buckets. Pairs whose bound reaches the threshold are in doubt: for these the vectors
are fetched and recomputed in double precision; for no others.

Pairs are looked for among vectors whose codes agree in all bits of one of several random bit sets;
the number of bits follows the number of rows, so a bucket holds about as many rows at any size, and
the number of sets is such that a pair at the threshold is missed by all with a chance below ``MISS``,
where the sets are drawn from one code: a pair whose codes differ in more bits than most has a small chance in each.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, components, sized, sorted_groups

#: Bits of a code at least, and bits at least that keys are drawn from: the code's and, of a short code, those of further directions.
CODE_BITS, BITS = 128, 256
WIDTH = 5.0
MISS = 1e-4
#: Rows of a bucket that are compared in one task at a time; larger buckets are cut into chunks, each pair of chunks by itself.
CHUNK = 1024
BUCKET = 512
SEED = 20240229


def width(dim: int) -> int:
    """Bits of a code: at least ``CODE_BITS``, and one for each dimension, in whole bytes."""
    return max(CODE_BITS, -(-dim // 8) * 8)


def key_bits(dim: int) -> int:
    return max(BITS, width(dim))


@lru_cache(maxsize=16)
def rotation(dim: int, part: int = 0) -> np.ndarray:
    """``width`` orthonormal directions of the padded space, cut to the ``dim`` coordinates that a vector has; another rotation for each ``part``."""
    n = width(dim)
    q, r = np.linalg.qr(np.random.default_rng(SEED + 10 * part).standard_normal((n, n)))
    return (q * np.sign(np.diag(r)))[:dim, :]


@lru_cache(maxsize=8)
def dither(n: int) -> np.ndarray:
    return np.random.default_rng(SEED + 2).random(n)


def miss(bits: int, n: int, agree: float) -> float:
    """Chance that a pair agrees in no key: the mean over the number of bits in which its codes differ, as all keys are drawn from the same ``BITS``."""
    total = 0.0
    for d in range(BITS + 1):
        share = math.comb(BITS, d) * (1 - agree) ** d * agree ** (BITS - d)
        total += share * (1 - math.comb(BITS - d, bits) / math.comb(BITS, bits)) ** n
    return total


@lru_cache(maxsize=64)
def tables(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of keys: the least with a ``miss`` of at most ``MISS``, and four more."""
    agree = 1 - math.acos(min(threshold, 1.0)) / math.pi
    bits = max(4, math.ceil(math.log2(max(rows, 2) / BUCKET)))
    high = 1
    while miss(bits, high, agree) > MISS:
        high *= 2
    low = high // 2  # too few
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if miss(bits, mid, agree) <= MISS else (mid, high)
    return bits, high + 4


@lru_cache(maxsize=8)
def bit_sets(width: int, bits: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(SEED + 1)
    return np.stack([np.sort(rng.permutation(width)[:bits]) for _ in range(n)])


def signs_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The turned vectors, and their signs with those of further directions up to ``key_bits``, packed."""
    dim = unit.shape[1]
    y = unit @ rotation(dim)
    more = key_bits(dim) - width(dim)
    bits = np.concatenate([y >= 0, *([unit @ rotation(dim, 1)[:, :more] >= 0] if more else [])], 1)
    return y, np.packbits(bits, axis=1)


def keys(codes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """A long per vector and bit set."""
    bits = np.unpackbits(codes, axis=1).astype(np.int64)
    out = np.empty((len(codes), len(sets)), np.int64)
    for t, s in enumerate(sets):
        h = np.full(len(codes), t, np.int64)
        for at in range(0, len(s), 32):
            part = bits[:, s[at : at + 32]] @ (1 << np.arange(len(s[at : at + 32]), dtype=np.int64))
            h = (h * np.int64(0x100000001B3)) ^ part
        out[:, t] = h * np.int64(4096) + t if len(s) <= 32 else h
    return out


def clean(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of usable vectors and the vectors in double precision: not null or zero, all components finite."""
    at, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            a = np.array(v, np.float64)
            if np.isfinite(a).all() and a.any() and np.isfinite(a @ a) and a @ a > 0:
                at.append(i)
                rows.append(a)
    return np.array(at, np.int64), rows


class Codes:
    """Codes, factors and rounded turned vectors of unit vectors, as arrays and as a binary each."""

    def __init__(self, signs: np.ndarray, factor: np.ndarray, low: np.ndarray, step: np.ndarray, level: np.ndarray):
        self.signs, self.factor, self.low, self.step, self.level = signs, factor, low, step, level

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        y, signs = signs_of(unit)
        f = np.abs(y).sum(1) / math.sqrt(y.shape[1])
        low = y.min(1)
        step = np.maximum((y.max(1) - low) / 14.5, 1e-12)  # room for the dither below one whole step
        level = np.floor((y - low[:, None]) / step[:, None] + dither(y.shape[1])).clip(0, 15).astype(np.uint8)
        return cls(signs, *(a.astype(np.float32) for a in (f, low, step)), level)

    def pack(self) -> list[bytes]:
        rest = np.stack([self.factor, self.low, self.step], 1).astype("<f4").view(np.uint8)
        half = self.level[:, ::2] << 4 | self.level[:, 1::2]
        return [r.tobytes() for r in np.concatenate([self.signs, rest, half], 1)]

    @classmethod
    def unpack(cls, rows: list[bytes], dim: int) -> Codes:
        raw, n = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), key_bits(dim) // 8
        f, low, step = np.ascontiguousarray(raw[:, n : n + 12]).view("<f4").T
        half = raw[:, n + 12 :]
        return cls(raw[:, :n], f, low, step, np.stack([half >> 4, half & 15], 2).reshape(len(rows), -1))

    def take(self, at: np.ndarray) -> Codes:
        return Codes(self.signs[at], self.factor[at], self.low[at], self.step[at], self.level[at])


def bounds(x: Codes, q: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all inner products of ``x`` with ``q``, and by how much they may be off."""
    n = q.level.shape[1]
    sign = np.unpackbits(x.signs, axis=1)[:, :n].astype(np.float32) * 2 - 1
    # a level stands for low + step * (level - dither + dither's mean), its rounding is unbiased over the rotation
    dot = sign @ (q.level.astype(np.float32) + np.float32(0.5) - dither(n).astype(np.float32)).T
    estimate = (sign.sum(1)[:, None] * q.low + dot * q.step) / (math.sqrt(n) * x.factor[:, None])
    own = np.maximum(1 - x.factor.astype(np.float64) ** 2, 0) / (n - 1)
    return estimate, WIDTH * np.sqrt(own[:, None] + q.step.astype(np.float64) ** 2 / 12) / x.factor[:, None]


def newly(x: np.ndarray, y: np.ndarray, table: int, sets: np.ndarray) -> np.ndarray:
    """Whether no table before ``table`` has the pairs of packed codes, that is, all of its bits agree."""
    out = np.ones(len(x), bool)
    differ = x ^ y
    for s in sets[:table]:
        mask = np.zeros(8 * x.shape[1], np.uint8)
        mask[s] = 1
        out &= (differ & np.packbits(mask)).any(1)
    return out


def doubtful(codes: Codes, left: np.ndarray, right: np.ndarray, table: int, sets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) of a block whose bound reaches the threshold, first found in this table."""
    found = []
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        estimate, slack = bounds(codes.take(part), codes.take(right))
        i, j = np.nonzero(estimate + slack >= threshold)
        i, j = part[i], right[j]
        if left is right:
            i, j = i[i < j], j[i < j]
        ok = newly(codes.signs[i], codes.signs[j], table, sets)
        found.append((i[ok], j[ok]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def linked(x: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of rows reach the threshold in double precision; sums in the order of the components, as a plain loop has them."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[at : at + (1 << 16)] = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= threshold
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the same ids as the pairs do, fewer than ids."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := root.setdefault(v, v)) != v:
            root[v] = root[p]
            v = root[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        ru, rv = find(u), find(v)
        if ru != rv:
            root[max(ru, rv)] = min(ru, rv)
            out.append((u, v))
    return out


BLOCK = ("dim", "t", "k", "p", "q")


def sides(r: pa.Table, key: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two chunks of a block; the same array twice for a chunk with itself."""
    own = r.column("own").to_numpy()
    left = np.flatnonzero(own == key[3])
    return left, left if key[3] == key[4] else np.flatnonzero(own == key[4])


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do rows with
    a null id (their component is null and they are kept). Vectors of different lengths do not link. Equal vectors
    form one class before the comparison; rows that repeat an id and vector count as one vector, and an id
    with several vectors counts once for each. Blocks of a bucket give sums of links and a
    spanning forest, so results grow with rows and not with pairs. An empty table gives an empty result.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    result, scratch = Scratch(vectors.sparkSession, "embed"), Scratch(vectors.sparkSession, "embed-steps")

    def usable(batches):
        for b in batches:
            at, _ = clean(b.column(1))
            yield b.take(pa.array(at))

    good = rows.where("vec_id is not null and v is not null").distinct().mapInArrow(usable, f"vec_id bigint, v {kind}")
    classes = result.save(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size")))
    n = classes.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits, n_tables = tables(n, threshold)

    def code(batches):
        for b in batches:
            vs = b.column(0).to_pylist()
            dims = np.array([len(v) for v in vs], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.array([vs[i] for i in at])
                made = Codes.of(x / np.linalg.norm(x, axis=1, keepdims=True))
                k = keys(made.signs, bit_sets(key_bits(int(dim)), bits, n_tables))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.column(1).to_numpy()[at]), pa.array(np.full(len(at), dim, np.int64)), pa.array(list(k), pa.list_(pa.int64())), pa.array(made.pack(), pa.binary())],
                    names=["id", "dim", "ks", "code"],
                )

    codes = scratch.save(classes.select("v", "id").mapInArrow(code, "id bigint, dim bigint, ks array<bigint>, code binary"))
    entries = codes.select("id", "dim", "code", F.posexplode("ks").alias("t", "k"))
    large = scratch.save(entries.groupBy("dim", "t", "k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CHUNK))
    chunks = F.coalesce(F.ceil(F.col("c") / CHUNK), F.lit(1)).cast("int")
    placed = (
        entries.join(sized(large, large.count()), ["dim", "t", "k"], "left")
        .withColumn("own", F.pmod(F.xxhash64("id"), chunks).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("dim", "t", "k", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "id", "code")
    )

    def sift(batches):
        """Of each block the vectors that are in doubt with another."""
        for key, r in sorted_groups(batches, BLOCK):
            left, right = sides(r, key)
            if r.num_rows < 2 or not len(left) or not len(right):
                continue
            dim, table = key[:2]
            i, j = doubtful(Codes.unpack(r.column("code").to_pylist(), dim), left, right, table, bit_sets(key_bits(dim), bits, n_tables), threshold)
            some = np.union1d(i, j)
            if len(some):
                block = [pa.array(np.full(len(some), x, np.int64)) for x in key]
                yield pa.RecordBatch.from_arrays([*block, r.column("own").combine_chunks().take(pa.array(some)).cast(pa.int64()), r.column("id").combine_chunks().take(pa.array(some))], names=[*BLOCK, "own", "id"])

    doubt = scratch.save(placed.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(sift, "dim bigint, t bigint, k bigint, p bigint, q bigint, own bigint, id bigint"))

    def blocks(batches):
        for key, r in sorted_groups(batches, BLOCK):
            dim, table = key[:2]
            left, right = sides(r, key)
            x = r.column("v").combine_chunks()
            x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            i, j = doubtful(Codes.unpack(r.column("code").to_pylist(), dim), left, right, table, bit_sets(key_bits(dim), bits, n_tables), threshold)
            hit = linked(x, i, j, threshold)
            i, j = i[hit], j[hit]
            if not len(i):
                continue
            ids, size = r.column("id").to_numpy(), r.column("size").to_numpy()
            one, back = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
            links = np.bincount(back, weights=np.concatenate([size[j], size[i]])).astype(np.int64)
            tree = np.array(forest(ids[i], ids[j]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([one, tree[:, 0]])),
                    pa.array(np.concatenate([np.zeros(len(one), np.int64), tree[:, 1]]), mask=np.arange(len(one) + len(tree)) < len(one)),
                    pa.array(np.concatenate([links, np.zeros(len(tree), np.int64)])),
                ],
                names=["id", "other", "links"],
            )

    full = doubt.join(codes.select("id", "dim", "code"), ["id", "dim"]).join(classes.select("id", "v", "size", F.size("v").cast("bigint").alias("dim")), ["id", "dim"])
    found = scratch.save(full.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(blocks, "id bigint, other bigint, links bigint"))
    label = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    sums = found.groupBy("id").agg(F.sum("links").alias("far"))
    per_class = result.save(
        classes.join(sums, "id", "left")
        .join(label, "id", "left")
        .select(F.col("v").alias("w"), (F.coalesce("far", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
    )
    scratch.clear()
    root = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    joined = rows.join(per_class, (F.col("v") == F.col("w")) & F.col("vec_id").isNotNull(), "left")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept"))
