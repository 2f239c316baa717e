"""Conflict-constrained best-fit packing of documents into sequences."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .minhash import clusters

#: Similarity from which documents are near-duplicates.
PERCENT = 75
#: Expected items of a shard, which is packed by one task at a time.
SHARD_ITEMS = 2048
#: Ordinals of a repeated row that are made at a time.
REPEATS = 4096


class Packer:
    """Bins of one shard, ordered by residual; each carries a bitmap of sources at their quota and one of clusters it holds."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.counts: list[dict[int, int]] = []
        self.bits: dict = {}

    def bit(self, kind: str | int, value) -> int:
        """The place of a source or cluster in its bitmap; a null has none and never conflicts."""
        return 0 if value is None else 1 << self.bits.setdefault((kind, value), len(self.bits))

    def place(self, size: int, source, *clusters) -> tuple[int, int]:
        """The bin taken and the offset in it: from the tightest bin that holds ``size``, successors are
        searched until one is compatible; if none is, a bin is opened."""
        s, c = self.bit("s", source), 0
        for kind, cluster in enumerate(clusters):
            c |= self.bit(kind, cluster)
        order = self.order
        for at in range(bisect_left(order, (size, -1)), len(order)):
            residual, b = order[at]
            if not (self.sources[b] & s or self.clusters[b] & c):
                del order[at]
                break
        else:
            residual, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
            self.counts.append({})
        if s:
            n = self.counts[b][s] = self.counts[b].get(s, 0) + 1
            if n >= self.per_source:
                self.sources[b] |= s
        self.clusters[b] |= c
        if residual > size:
            insort(order, (residual - size, b))
        return b, self.capacity - residual


def pack_items(items: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster of each kind), largest first and in the given order among equals."""
    packer = Packer(capacity, per_source)
    out: list = [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        out[i] = packer.place(*items[i])
    return out


def word_tokens(text: Column) -> Column:
    """Words and an end mark."""
    words = F.split(F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    return (F.when(F.get(words, 0) == "", 0).otherwise(F.size(words)) + 1).cast("bigint")


def pack(docs: DataFrame, capacity: int = 4096, per_source: int = 4, shard_items: int = SHARD_ITEMS, size: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """Rows (doc_id, piece, first_token, n_tokens, bin_id, position, source): where each piece of each document goes.

    ``size`` is a document's tokens (default: words and an end mark) and ``cluster`` its duplicate cluster. By default
    documents conflict if their texts are in one component of near-duplicates or if their texts are equal without regard to case
    (also texts without words). No bin holds two documents that conflict or more than ``per_source`` of a source. A document
    longer than ``capacity`` is cut into full pieces, each a bin of its own, and a remainder, so no token is dropped. Null and
    empty texts take one token; null sources conflict with nothing (a table without a source column has null ones); rows with a null id
    are packed, and conflict, as others; repeated rows are packed each by itself, and so, as one cluster, in different bins. An empty table gives an empty result.

    Documents are dealt to shards by a hash of their content, id and, of rows that repeat, their ordinal, so a hot source, group of copies or repeated row spreads over all shards;
    bins do not cross shards, whose number follows the number of rows. Only the lengths and keys are shuffled, not the texts.
    """
    n = docs.count()
    shards = max(1, -(-n // shard_items))
    text = F.col("text").cast("string")
    own = F.col("doc_id").cast("bigint")
    equal = F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))
    items = [own.alias("own_id"), (F.col("source") if "source" in docs.columns else F.lit(None)).cast("string").alias("source"), *([] if size is None else [size.cast("bigint").alias("size")])]
    if cluster is None:
        # words are counted where texts are cut into shingles
        keyed = docs.select(own.alias("doc_id"), text.alias("text"), *items, equal.alias("equal"))
        found = clusters(keyed, PERCENT, carry=tuple(keyed.columns[2:]))
        items = found.select("own_id", "source", (F.col("n_words") + 1 if size is None else F.col("size")).alias("size"), "cluster", "equal")
    else:
        items = docs.select(*items, *([word_tokens(text).alias("size")] if size is None else []), cluster.cast("bigint").alias("cluster"))
        items = items.select("own_id", "source", "size", "cluster", F.col("cluster").alias("equal"))
    # rows that repeat are counted before they are dealt, then numbered; the numbers come from pieces of a bounded size
    items = items.groupBy("own_id", "source", "size", "cluster", "equal").agg(F.count(F.lit(1)).alias("n"))
    items = items.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(REPEATS).cast("bigint"))))
    items = items.withColumn("copy", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + REPEATS, F.col("n")) - 1)))
    items = items.withColumnRenamed("own_id", "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "equal", "copy"), F.lit(shards)).cast("bigint"))
    names = ["doc_id", "piece", "first_token", "n_tokens", "bin_id", "position", "source"]

    def one(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[4] or 0, r[1] or "", r[2]))
        whole, rest = [], []
        for r in rows:
            full, left = divmod(r[2], capacity)
            whole += [(r, k) for k in range(full)]
            if left or not full:
                rest.append((r, full, left))
        placed = pack_items([(left, r[1], r[3], r[4]) for r, _, left in rest], capacity, per_source)
        used = max((b for b, _ in placed), default=-1) + 1
        out = [(r[0], k, k * capacity, left, (shard << 32) | b, at, r[1]) for (r, k, left), (b, at) in zip(rest, placed, strict=True)]
        out += [(r[0], k, k * capacity, capacity, (shard << 32) | (used + i), 0, r[1]) for i, (r, k) in enumerate(whole)]
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if x == "source" else pa.int64()) for x, c in zip(names, cols, strict=True)], names=names)

    def run(batches):
        held, last = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[0] != last:
                    yield one(last, held)
                    held = []
                last = row[0]
                held.append(row[1:])
        if held:
            yield one(last, held)

    return (
        items.select("shard", "doc_id", "source", "size", "cluster", "equal")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(run, "doc_id bigint, piece bigint, first_token bigint, n_tokens bigint, bin_id bigint, position bigint, source string")
    )
