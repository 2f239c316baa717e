"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A shingle's hash is placed in a universe of 2**32 points by a first permutation. Coordinate k of a
signature is the least value of one second permutation over the points shifted k places round the
universe, so two permutations make all coordinates. ``ROWS`` coordinates make a band; documents that
share a band are candidates. Two bits of each coordinate make a sketch, by which candidates whose
similarity cannot be near the bound are left out before sets are compared.

With 36 bands of 4 a pair at the bound of 0.75 shares no band with probability 1.2e-6, and its sketch
is beyond ``FAR_BITS`` with probability 2e-7; both fall fast above the bound.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, components, sized, sorted_groups

WIDTH = 5
BANDS, ROWS = 36, 4
COORDINATES = BANDS * ROWS
#: Sketches of 256 bits differ in 32 on average at a similarity of 0.75, with a deviation of 6.3.
FAR_BITS = 68
#: Rounds of stars at most, before buckets are compared in blocks; they end early when a round links less than one in ``YIELD`` of its pairs.
ROUNDS, YIELD = 5, 20
#: Classes of a bucket that are compared in one block; of larger buckets, chunks of so many.
CHUNK = 512
#: Hashes of a dense block that are held at a time, about.
PART_HASHES = 2_000_000
#: A block sends its candidate pairs on if they are at most so many times its classes; a denser one is compared on full sets inside a task.
SPARSE = 4
#: Words of up to so many bytes are hashed side by side, eight bytes at a time; longer ones each by itself.
LONG_WORD = 64
#: Texts that are cut into words at once, in bytes; a longer text is cut by itself.
PIECE_BYTES = 250_000
#: Points that are shifted and permuted at once, so that they stay in a core's cache.
TILE = 32_768
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first bytes of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in their order, A-Z in lower case, and each text's number of words; null has none."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # spaces follow, so eight bytes can be taken from any place
    b = np.concatenate([raw, np.full(8, 32, np.uint8)])
    b += (b - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)
    inside = (b != 32) & (b - np.uint8(9) > 4)
    first, behind = inside.copy(), np.zeros(len(b), bool)
    first[1:] &= ~inside[:-1]
    behind[1:] = inside[:-1] & ~inside[1:]
    # no word goes on from text to text
    first[offsets] = inside[offsets]
    behind[offsets] = inside[offsets - 1]
    starts = np.flatnonzero(first)
    size = np.flatnonzero(behind) - starts
    eight = np.ndarray(len(b) - 7, np.dtype("<u8"), b, strides=(1,))
    h = _mix64((eight[starts] & FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * PRIME))
    long = np.flatnonzero(size > 8)
    for at in range(8, LONG_WORD, 8):
        long = long[size[long] > at]
        h[long] = _mix64(h[long] * PRIME + (eight[starts[long] + at] & FIRST[np.minimum(size[long] - at, 8)]))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(b[starts[i] : starts[i] + size[i]].tobytes())
    return h, np.diff(np.searchsorted(starts, offsets))


def pieces(*sizes: pa.Array | np.ndarray):
    """Ranges (first row, number of rows) of rows that have about ``PIECE_BYTES`` each, by columns of texts or of bytes."""
    of = lambda c: c if isinstance(c, np.ndarray) else pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sum(map(of, sizes)))
    lo, done = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, done + PIECE_BYTES, "right")))
        yield lo, hi - lo
        lo, done = hi, int(ends[hi - 1])


def shingle_sets(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles (five words each, or all of fewer words; empty without words), and each text's number of words."""
    w, n = word_hashes(texts)
    starts = np.cumsum(n) - n
    h = np.zeros(len(w), np.uint64)
    # at the first word of each; those that run into the next text are left out below
    x = w[: len(w) - WIDTH + 1] + np.uint64(WIDTH) if len(w) >= WIDTH else w[:0]
    for j in range(1, WIDTH):
        x = x * PRIME + w[j : len(x) + j]
    h[: len(x)] = x
    for size in range(1, WIDTH):
        at = starts[n == size]
        x = w[at] + np.uint64(size)
        for j in range(1, size):
            x = x * PRIME + w[at + j]
        h[at] = x
    h = _mix64(h)
    sets = []
    for lo, k in zip(starts.tolist(), np.where(n > WIDTH, n - WIDTH + 1, n > 0).tolist(), strict=True):
        s = np.sort(h[lo : lo + k])
        new = np.empty(k, bool)
        new[:1] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        sets.append(s[new])
    return sets, n


def shingles(text: str | None) -> np.ndarray:
    """A text's set of shingles."""
    return shingle_sets(pa.array([text], pa.string()))[0][0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """All coordinates of non-empty sets, a row for each.

    The last step of the permutation keeps the order of its upper half, so it is taken after the minimum.
    """
    out = np.full((COORDINATES, len(sets)), 0xFFFFFFFF, np.uint32)
    points = (_mix64(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])
    for lo in range(0, len(points), TILE):
        tile = points[lo : lo + TILE]
        i, j = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, lo + len(tile))
        cuts = np.maximum(starts[i:j] - lo, 0)
        z, part = np.empty_like(tile), np.empty_like(tile)
        for k in range(COORDINATES):
            np.subtract(tile, np.uint32(k), out=z)
            np.right_shift(z, np.uint32(16), out=part)
            np.bitwise_xor(z, part, out=z)
            np.multiply(z, np.uint32(0x85EBCA6B), out=z)
            np.right_shift(z, np.uint32(13), out=part)
            np.bitwise_xor(z, part, out=z)
            np.multiply(z, np.uint32(0xC2B2AE35), out=z)
            np.minimum(out[k, i:j], np.minimum.reduceat(z, cuts), out=out[k, i:j])
    return np.ascontiguousarray((out ^ out >> np.uint32(16)).T)


def signature(hashes: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set."""
    return signatures([hashes])[0]


def bands_and_sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bands and sketches of non-empty sets, a row for each."""
    sig = signatures(sets)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * PRIME
    for j in range(ROWS):
        h = _mix64(h ^ sig[:, j::ROWS].astype(np.uint64)) * PRIME
    bits = np.concatenate([sig[:, :128] & 1, sig[:, :128] >> 1 & 1], 1).astype(np.uint8)
    return h.view(np.int64), np.packbits(bits, 1).view(np.int64)


def signature_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of (doc_id, t, text, ...): the id, t, size, digest, sketch and bands; with further columns, these and n_words, the number of words, after them."""
    n, digest, sketch, bands, n_words = [], [], [np.zeros((0, 4), np.int64)], [np.zeros((0, BANDS), np.int64)], []
    texts = batch.column(2)
    for piece in pieces(texts):
        sets, words = shingle_sets(texts.slice(*piece))
        n += map(len, sets)
        n_words += words.tolist()
        digest += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        some = [s for s in sets if len(s)]
        k = np.zeros((len(sets), 4), np.int64)
        if some:
            b, k[words > 0] = bands_and_sketches(some)
            bands.append(b)
        sketch.append(k)
    sketch = np.concatenate(sketch)
    cuts = np.concatenate([[0], np.cumsum(BANDS * (np.array(n, np.int64) > 0))]).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(bands).ravel()))
    more, names = batch.columns[3:], batch.schema.names[3:]
    if more:
        more.append(pa.array(n_words, pa.int64()))
        names = [*names, "n_words"]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *[pa.array(sketch[:, j]) for j in range(4)], bands, *more],
        names=["doc_id", "t", "n", "d", "s0", "s1", "s2", "s3", "bands", *names],
    )


def similar_batch(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Pairs (a, b) of (a, b, text of a, text of b) whose full sets have 100 * intersection >= percent * union."""
    keep = []
    for piece in pieces(batch.column(2), batch.column(3)):
        x, y = (batch.column(i).slice(*piece) for i in (2, 3))
        # a text that stands in rows that follow each other is cut once
        new = np.concatenate([[True], pc.fill_null(pc.not_equal(x[1:], x[:-1]), True).to_numpy(zero_copy_only=False)])
        lefts, rights = shingle_sets(x.filter(pa.array(new)))[0], shingle_sets(y)[0]
        for i, right in zip((np.cumsum(new) - 1).tolist(), rights, strict=True):
            both = len(np.intersect1d(lefts[i], right, assume_unique=True))
            keep.append(100 * both >= percent * (len(lefts[i]) + len(right) - both))
    return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def candidates(sketch: np.ndarray, n: np.ndarray, root: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of ``left`` and ``right`` in different components whose sizes and sketches allow a link."""
    found = []
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        far = sum(np.bitwise_count(sketch[i, None, k] ^ sketch[None, right, k]).astype(np.uint16) for k in range(4))
        ok = (far <= FAR_BITS) & (root[i, None] != root[None, right])
        ok &= (100 * n[i, None] >= percent * n[None, right]) & (100 * n[None, right] >= percent * n[i, None])
        x, y = np.nonzero(ok)
        found.append((i[x], right[y]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


#: Rows of ``block_candidates``.
FOUND = ("h", "p", "q", "own", "a", "b", "root", "n", "parts")


def block_candidates(batches, percent: int, sparse: int):
    """Rows (a, b) of a block's candidate pairs or, of a dense block, rows (block, own, a, root, n, parts) of the classes that have some: parts is the
    number of ranges of hashes in which their sets are compared."""
    none = lambda k: pa.nulls(k, pa.int64())
    for block, r in sorted_groups(batches, ("h", "p", "q")):
        get = lambda c: r.column(c).to_numpy()
        ids, own = get("id"), get("own")
        sketch = np.stack([get(f"s{j}") for j in range(4)], 1).view(np.uint64)
        left, right = np.flatnonzero(own == block[1]), np.flatnonzero(own == block[2])
        if not len(left) or not len(right):
            continue
        i, j = candidates(sketch, get("n"), get("root"), left, right, percent)
        if block[1] == block[2]:
            i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]
        if not len(i):
            continue
        if len(i) <= sparse * len(ids):
            cols = [*[none(len(i))] * 4, pa.array(ids[i]), pa.array(ids[j]), *[none(len(i))] * 3]
        else:
            some = np.union1d(i, j)
            each = np.full(len(some), 1, np.int64)
            cols = [*[pa.array(each * x) for x in block], pa.array(own[some].astype(np.int64)), pa.array(ids[some]), none(len(some)), pa.array(get("root")[some])]
            cols += [pa.array(get("n")[some]), pa.array(each * (int(get("n")[some].sum()) // PART_HASHES + 1))]
        yield pa.RecordBatch.from_arrays(cols, names=list(FOUND))


def shingle_parts(batches):
    """Of rows (h, p, q, own, id, root, n, parts, text): a row for each of ``parts`` ranges of the hashes, with the text's hashes in that range."""
    for batch in batches:
        # a row has nine columns
        for lo, k in pieces(batch.column(8), 72 * batch.column(7).to_numpy()):
            rows = batch.slice(lo, k)
            sets, parts = shingle_sets(rows.column(8))[0], rows.column(7).to_numpy()
            cuts, at = [np.zeros(1, np.int64)], 0
            for s, n in zip(sets, parts.tolist(), strict=True):
                cuts.append(at + np.searchsorted((s >> np.uint64(33)) * np.uint64(n) >> np.uint64(31), np.arange(1, n + 1, dtype=np.uint64)))
                at += len(s)
            of = np.repeat(np.arange(k), parts)
            part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            hashes = pa.ListArray.from_arrays(pa.array(np.concatenate(cuts).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            cols = [rows.column(i).take(pa.array(of)) for i in range(7)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(part), hashes], names=["h", "p", "q", "own", "id", "root", "n", "part", "hashes"])


def overlaps(of: np.ndarray, every: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all of ``left`` with all of ``right`` of n sets, as products of membership matrices, some shingles at a time.

    ``every`` are hashes, ``of`` the sets that hold them.
    """
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    number = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]])) if len(every) else every
    often = np.bincount(number) > 1
    keep = often[number]
    number, of = (np.cumsum(often) - 1)[number[keep]], of[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, 1024):
        lo, hi = np.searchsorted(number, [at, at + 1024])
        has = np.zeros((n, 1024), np.float32)
        has[of[lo:hi], number[lo:hi] - at] = 1
        out += has[left] @ has[right].T
    return out


class Dense:
    """A block whose full sets are compared, one range of the hashes after the other: it holds a part of the sets and the counts."""

    def __init__(self, block: tuple[int, ...], first: pa.Table):
        get = lambda c: first.column(c).to_numpy()
        order = np.argsort(get("id"))
        self.ids, self.root, self.n, own = (get(c)[order] for c in ("id", "root", "n", "own"))
        self.left, self.right = np.flatnonzero(own == block[1]), np.flatnonzero(own == block[2])
        self.both = np.zeros((len(self.left), len(self.right)))

    def add(self, part: pa.Table) -> None:
        lists = part.column("hashes").chunk(0)
        of = np.repeat(np.searchsorted(self.ids, part.column("id").to_numpy()), np.diff(lists.offsets.to_numpy()))
        self.both += overlaps(of, lists.flatten().to_numpy(), len(self.ids), self.left, self.right)

    def links(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the links, as many as join the block's components."""
        left, right, both = self.left, self.right, self.both
        i, j = np.nonzero((100 * both >= percent * (self.n[left][:, None] + self.n[right] - both)) & (self.root[left][:, None] != self.root[right]))
        _, first = np.unique(np.stack([self.root[left[i]], self.root[right[j]]], 1), axis=0, return_index=True)
        return self.ids[left[i]][first], self.ids[right[j]][first]


def dense_links(batches, percent: int):
    """Links (a, b) of dense blocks, from full sets; of a block's links, as many as join its components."""
    last, dense = None, None

    def found():
        if dense is not None:
            a, b = dense.links(percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for key, part in sorted_groups(batches, ("h", "p", "q", "part")):
        if key[:3] != last:
            yield from found()
            last, dense = key[:3], Dense(key[:3], part)
        dense.add(part)
    yield from found()


def _close(percent: int) -> Column:
    """Sizes and sketches of x and y allow the bound."""
    size = (100 * F.col("x.n") >= percent * F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
    return size & (_far() <= FAR_BITS)


def _far() -> Column:
    return sum((F.bit_count(F.col(f"x.s{j}").bitwiseXOR(F.col(f"y.s{j}"))) for j in range(4)), F.lit(0))


def _blocks(entries: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows (h, p, q, own, id, root) of the blocks of open buckets.

    A bucket of up to ``CHUNK`` classes is one block. Of a larger one, the classes of its largest component M, which have nothing to
    compare among themselves, and the others R are cut into chunks; blocks pair chunks of R with those of M and of R. So an M of any size with
    a small R gives a row for each class. Buckets with the same members are compared once.
    """
    same = entries.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    once = same.join(open_, F.col("h") == F.col("g"), "left_semi").groupBy("c", "x", "y").agg(F.min("h").alias("g")).select("g", "c")
    each = entries.join(once, F.col("h") == F.col("g")).select("h", "c", "id", "root")
    small = each.where(F.col("c") <= CHUNK).select("h", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("own"), "id", "root")
    large = each.where(F.col("c") > CHUNK)
    most = (
        large.groupBy("h", "c", "root").agg(F.count(F.lit(1)).alias("m")).groupBy(F.col("h").alias("g"), "c").agg(F.max(F.struct("m", "root")).alias("x"))
        .select("g", F.col("x.root").alias("main"), F.ceil(F.col("x.m") / CHUNK).cast("int").alias("cm"), F.ceil((F.col("c") - F.col("x.m")) / CHUNK).cast("int").alias("cr"))
    )
    placed = large.drop("c").join(most, F.col("h") == F.col("g")).withColumn("in_main", F.col("root") == F.col("main"))
    # chunks of R are 0 to cr - 1, those of M follow
    placed = placed.withColumn("own", F.when(F.col("in_main"), F.col("cr") + F.pmod(F.xxhash64("id"), F.col("cm"))).otherwise(F.pmod(F.xxhash64("id"), F.col("cr"))).cast("int"))
    with_ = F.explode(F.sequence(F.lit(0), F.when(F.col("in_main"), F.col("cr")).otherwise(F.col("cr") + F.col("cm")) - 1))
    pairs = placed.select("h", "own", "id", "root", with_.alias("w")).select("h", F.least("own", "w").alias("p"), F.greatest("own", "w").alias("q"), "own", "id", "root")
    return small.unionByName(pairs)


def near_duplicates(docs: DataFrame, percent: int = 75, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept; with ``carry``, then these columns of ``docs`` and n_words.

    A null or empty text has no shingles and is its own component. Rows with a null id link with
    nothing, have a null component and are kept. Repeated rows have the same component. Rows that share an id but not a set of
    shingles are documents of their own: each has the component of its text. An empty table gives an empty result; columns that are not carried are not read.
    """
    s, grouped = _classes(docs, percent, carry, F.col("doc_id").isNotNull())
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return _labelled(s, grouped).select(
        "doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"), *carry, *(["n_words"] if carry else [])
    )


def clusters(docs: DataFrame, percent: int, carry: tuple[str, ...]) -> DataFrame:
    """One row per input row: the columns ``carry``, n_words and cluster, the number of its component (null where no other text is linked); rows with a null id take part as others."""
    s, grouped = _classes(docs, percent, carry, F.lit(True))
    return _labelled(s, grouped).select(*carry, "n_words", F.col("root").alias("cluster"))


def _labelled(s: DataFrame, grouped: DataFrame) -> DataFrame:
    return s.join(sized(grouped, grouped.count()), F.col("d") == F.col("e"), "left")


def _classes(docs: DataFrame, percent: int, carry: tuple[str, ...], named: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with their size and digest of shingles, and of the digests of several rows or in a component of several: (e, root, first), root the
    number of the component and first its least id.

    Equal sets of ``named`` rows form a class, which has a number of its own; only classes are compared. In each round, every bucket of a
    band that holds several components takes one of its classes as hub, and each class in another component is compared with the nearest of its
    hubs by sketch; linked classes are joined. What the rounds leave apart in a shared bucket is compared pair by pair, by sketch in blocks and
    then on full sets, so no link that joins components is left out. Rows grow with a bucket, not with its pairs: a round has one pair for
    a class, a block sends on a bounded number of pairs for a class or else compares full sets itself, a range of the hashes at a time. Many
    texts that are alike but below the bound cost their pairs in CPU time only.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"), *carry)
    more = "".join(f", {c} {t}" for c, t in rows.dtypes[3:]) + (", n_words bigint" if carry else "")
    # the text that stands for a class is found again by these two
    own = F.coalesce("doc_id", "t")
    result, scratch = Scratch(docs.sparkSession, "minhash"), Scratch(docs.sparkSession, "minhash-steps")
    save = scratch.save

    def sign(batches):
        for b in batches:
            yield signature_batch(b)

    s = result.save(rows.mapInArrow(sign, "doc_id bigint, t bigint, n bigint, d binary, s0 bigint, s1 bigint, s2 bigint, s3 bigint, bands array<bigint>" + more))
    classes = save(
        s.where(F.col("d").isNotNull() & named)
        .groupBy("d")
        .agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size"), F.min(F.struct(own.alias("k"), "t")).alias("of"), F.first(F.struct("n", "s0", "s1", "s2", "s3", "bands")).alias("x"))
        .select("d", F.monotonically_increasing_id().alias("id"), "first", "size", "of", "x.*")
    )
    bands = classes.select("id", F.explode("bands").alias("h"))
    shared = bands.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("h").alias("g"))
    members = save(bands.join(shared, F.col("h") == F.col("g")).select("h", "id"))
    ids = save(members.select("id").distinct())
    n_ids = ids.count()
    label, links, sparse = None, None, SPARSE

    def labelled(frame: DataFrame) -> DataFrame:
        """With the component so far as ``root``."""
        if label is None:
            return frame.withColumn("root", F.col("id"))
        known = label.select(F.col("id").alias("lid"), F.col("root").alias("lroot"))
        return frame.join(sized(known, n_ids), F.col("id") == F.col("lid"), "left").select(*frame.columns, F.coalesce("lroot", "id").alias("root"))

    def verify(batches):
        for b in batches:
            yield similar_batch(b, percent)

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
        return save(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint"))

    def joined(found: DataFrame) -> None:
        nonlocal label, links
        links = found if links is None else links.union(found)
        label = components(links, scratch)

    if n_ids:
        sketches = save(classes.join(sized(ids, n_ids), "id", "left_semi").select("id", "n", "s0", "s1", "s2", "s3", "first"))
        of = classes.join(sized(ids, n_ids), "id", "left_semi").select("id", F.col("of.k").alias("k"), F.col("of.t").alias("ct"))
        texts = save(rows.select(own.alias("own"), "t", "text").join(sized(of, n_ids), (F.col("own") == F.col("k")) & (F.col("t") == F.col("ct"))).select("id", "text"))
        if texts.count() > n_ids:  # rows that repeat an id and text are compared once
            texts = save(texts.distinct())
        near = sized(sketches, n_ids)
        for turn in range(ROUNDS):
            each = labelled(members)
            if not turn:  # the text of the least id is the first hub, as copies mostly come after what they copy
                each = each.join(near.select("id", "first"), "id")
            order = F.xxhash64("id", F.lit(turn)) if turn else F.coalesce("first", F.lit(2**63 - 1))
            first = F.min(F.struct(order.alias("o"), "id", "root")).alias("hub")
            hubs = each.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), first).where("lo <> hi").select(F.col("h").alias("g"), "hub")
            stars = each.join(hubs, F.col("h") == F.col("g")).where("root <> hub.root").select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()
            near_ones = stars.join(near.alias("x"), F.col("a") == F.col("x.id")).join(near.alias("y"), F.col("b") == F.col("y.id")).where(_close(percent))
            pairs = save(near_ones.groupBy("b").agg(F.min(F.struct(_far().alias("far"), "a")).alias("x")).select("x.a", "b"))
            n_pairs = pairs.count()
            if not n_pairs:
                break
            found = verified(pairs)
            n_found = found.count()
            if n_found:
                joined(found)
            if n_found * YIELD < n_pairs:
                break
        each = save(labelled(members))
        open_ = each.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("h").alias("g"))
        placed = save(_blocks(each, open_))
        block = ["h", "p", "q"]

        def sift(batches):
            yield from block_candidates(batches, percent, sparse)

        def compare(batches):
            yield from dense_links(batches, percent)

        rest = save(placed.join(near, "id").repartition(*block).sortWithinPartitions(*block).mapInArrow(sift, ", ".join(f"{c} bigint" for c in FOUND)))
        for found in (verified(rest.where("b is not null").select("a", "b").distinct()), None):
            if found is None:
                dense = rest.where("b is null").drop("b")
                if not dense.limit(1).count():
                    break
                full = dense.join(texts, F.col("a") == F.col("id")).select(*block, "own", "id", "root", "n", "parts", "text")
                full = full.mapInArrow(shingle_parts, "h bigint, p bigint, q bigint, own bigint, id bigint, root bigint, n bigint, part bigint, hashes array<bigint>")
                found = save(full.repartition(*block).sortWithinPartitions(*block, "part").mapInArrow(compare, "a bigint, b bigint"))
            if found.limit(1).count():
                joined(found)
    # a component's least id is taken over its classes, then given to each of them
    linked = classes.select(F.col("d").alias("e"), "id", "first", "size")
    if label is None:
        grouped = result.save(linked.where("size > 1").select("e", F.col("id").alias("root"), "first"))
    else:
        known = label.select(F.col("id").alias("lid"), F.col("root").alias("lroot"))
        linked = linked.join(sized(known, n_ids), F.col("id") == F.col("lid"), "left").where("size > 1 or lroot is not null")
        linked = save(linked.select("e", F.coalesce("lroot", "id").alias("root"), "first"))
        least = save(linked.groupBy("root").agg(F.min("first").alias("first")))
        grouped = result.save(linked.drop("first").join(sized(least, least.count()), "root").select("e", "root", "first"))
    scratch.clear()
    return s, grouped


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: one document of each group, the one with the smallest id.

    Rows are told apart by id and text, so of an id with two texts one may stay.
    """
    text = F.col("text").cast("string")
    found = near_duplicates(docs.select("doc_id", "text", F.xxhash64(text).alias("text_hash")), percent, carry=("text_hash",))
    gone = Scratch(docs.sparkSession, "minhash-gone").save(found.where("not kept").select(F.col("doc_id").alias("gone_id"), "text_hash").distinct())
    out = sized(gone, gone.count())
    same = (docs["doc_id"].cast("bigint") == out["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == out["text_hash"])
    return docs.join(out, same, "left_anti")
