"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Documents are tokenized once, into block files of a bounded number of tokens that hold local word numbers.
Each block sends its distinct words and bigrams, as slices of sorted 64-bit hashes with their
training counts, to the shard of their highest bits; a shard adds up the counts of all blocks and sends each
its slice back. So counts cover the whole corpus, each distinct n-gram of a block crosses the network once each
way, and a frequent word is one entry per block. No task holds more than a block or a shard.

The mixture weights of each bucket of context frequencies are learned by expectation-maximisation
on held-out counts made by deletion: each training occurrence is predicted from counts without itself.
Occurrences whose two estimates lie in the same half powers of two are gathered in one cell and stand there with their means, so what reaches
the driver is bounded whatever the corpus; scores differ from those of uncollected occurrences by less than half a percent.

Rows between blocks and shards are at most blocks times shards, and never more than the blocks' distinct n-grams, as empty slices are not sent.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import materialize, work_dir
from .files import create, opened

BLOCK_TOKENS = 2_000_000
#: Hash of the end mark, which also stands for the context before a document's first word.
END = np.uint64(0xD1B54A32D192ED03)
#: Context frequencies 0, 1, 2-3, 4-7 and so on share weights.
BUCKETS = 40
#: Estimates are gathered in half powers of two for the learning of weights.
STEPS = 120


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def pack_hashes(h: np.ndarray) -> bytes:
    """Differences of sorted hashes, byte plane by byte plane, so that the empty high planes vanish."""
    d = np.diff(h, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    c = c.astype(np.int64)
    return zstandard.compress(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(-1)


class Block:
    """Documents of a block: ids (with a mask of nulls), whether held out, tokens each, local word numbers and the words' sorted hashes."""

    NAMES = ("ids", "null", "held", "lens", "words", "tokens")
    KINDS = ("<i8", "u1", "u1", "<i8", "<u8", "<u4")

    def __init__(self, *arrays: np.ndarray):
        self.ids, self.null, self.held, self.lens, self.words, self.tokens = arrays

    @classmethod
    def build(cls, ids: list, hashes: list[np.ndarray]) -> Block:
        lens = np.array([len(h) for h in hashes], np.int64)
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        held = np.array([i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids], np.uint8)
        return cls(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), held, lens, words, tokens.astype(np.uint32))

    def save(self, uri: str) -> None:
        with create(uri) as f:
            for name, kind in zip(self.NAMES, self.KINDS, strict=True):
                z = zstandard.compress(np.ascontiguousarray(getattr(self, name), kind).tobytes(), 3)
                f.write(struct.pack("<Q", len(z)) + z)

    @classmethod
    def load(cls, uri: str) -> Block:
        with opened(uri) as f:
            return cls(*(np.frombuffer(zstandard.decompress(f.read(struct.unpack("<Q", f.read(8))[0])), kind) for kind in cls.KINDS))

    def train(self) -> np.ndarray:
        """Whether each token is of a training document."""
        return np.repeat(self.held == 0, self.lens)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs in order of their hash, as (hashes, context numbers, word numbers), and each token's pair."""
        end = np.searchsorted(self.words, END)
        context = np.empty(len(self.tokens), np.int64)
        context[1:] = self.tokens[:-1]
        context[:1] = end  # every document ends with the end mark, so this is the context of the next one's first word, too
        n = len(self.words)
        key, of = np.unique(context * n + self.tokens, return_inverse=True)
        u, v = key // n, key % n
        with np.errstate(over="ignore"):
            h = _mix(self.words[u] * np.uint64(0x9E3779B97F4A7C15) + _mix(self.words[v]))
        order = np.argsort(h, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return h[order], u[order], v[order], place[of]


def hashed(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    h = np.empty(len(words) + 1, np.uint64)
    h[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h[-1] = END
    return h


def slices(h: np.ndarray, bits: int):
    """(shard, from, to) of the non-empty slices of sorted hashes by their ``bits`` highest bits."""
    if not bits:
        yield 0, 0, len(h)
        return
    shard = h >> np.uint64(64 - bits)
    cut = np.flatnonzero(shard[1:] != shard[:-1]) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(h)]):
        if a < b:
            yield int(shard[a]), a, b


def total_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Add up a shard's slices and give each block the totals of its own."""
    hashes = [unpack_hashes(x) for x in frame["h"]]
    one, back = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.zeros(len(one), np.int64)
    np.add.at(total, back, np.concatenate([unpack_counts(x) for x in frame["c"]]))
    ends = np.cumsum([len(h) for h in hashes])
    out = [pack_counts(total[back[e - len(h) : e]]) for h, e in zip(hashes, ends, strict=True)]
    first = np.arange(len(frame)) == 0
    return pd.DataFrame({"uri": frame["uri"], "kind": key[0], "p": key[1], "c": out, "types": np.where(first, (total > 0).sum(), 0), "tokens": np.where(first, total.sum(), 0)})


def bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c.astype(np.float64))[1], BUCKETS - 1)


def log_bin(q: np.ndarray) -> np.ndarray:
    """0 for zero, else 1 and up as the estimate falls."""
    with np.errstate(divide="ignore"):
        return np.where(q > 0, 1 + np.clip(-2 * np.log2(np.where(q > 0, q, 1)), 0, STEPS - 2).astype(np.int64), 0)


def learn(cells: pd.DataFrame, types: int, rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by expectation-maximisation over the gathered cells."""
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    for b, g in cells.groupby("b"):
        n = g["n"].to_numpy(np.float64)
        q = np.stack([g["q2"].to_numpy() / n, g["q1"].to_numpy() / n, np.full(len(g), 1.0 / (types + 1))], 1)
        w = np.array([0.5, 0.4, 0.1])
        for _ in range(rounds):
            post = w * q
            post /= post.sum(1, keepdims=True)
            new = (n[:, None] * post).sum(0) / n.sum()
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        w = np.maximum(w, 1e-6)  # no event is impossible
        weights[b] = w / w.sum()
    weights[0] = weights[1]
    return weights


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents that are not held out. A null or empty text is the end mark alone. A null id is not
    held out; repeated rows are scored each and counted each; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "lm")
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")

    def blocks(batches):
        from pyspark import TaskContext

        t = TaskContext.get()
        made = 0

        def close(ids, hashes, n):
            b = Block.build(ids, hashes)
            uri = f"{folder}/block-{t.partitionId():06d}-{made:04d}-{t.taskAttemptId()}"
            b.save(uri)
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["uri", "n"])

        ids, hashes, n = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                hashes.append(hashed(text))
                n += len(hashes[-1])
                if n >= block_tokens:
                    yield close(ids, hashes, n)
                    made += 1
                    ids, hashes, n = [], [], 0
        if ids:
            yield close(ids, hashes, n)

    manifest = materialize(docs.mapInArrow(blocks, "uri string, n bigint"), "lm-blocks")
    n_blocks, n_tokens = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_blocks:
        return docs.selectExpr("doc_id", "false as held_out", "0L as n_tokens", "0L as n_known", "0L as train_tokens", "0D as base_score", "0D as score")
    bits = max(0, int(np.ceil(np.log2(max(n_tokens, 1) / 1_500_000))))  # a shard gets about as many entries as a block
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = manifest.select("uri").repartition(min(parts, n_blocks), F.rand(7)) if n_blocks > 1 else manifest.select("uri")

    def send(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                b = Block.load(uri)
                train = b.train()
                h, _, _, of = b.bigrams()
                rows = []
                for kind, keys, counts in ((0, b.words, np.bincount(b.tokens[train], minlength=len(b.words))), (1, h, np.bincount(of[train], minlength=len(h)))):
                    for p, lo, hi in slices(keys, bits):
                        rows.append((uri, kind, p, pack_hashes(keys[lo:hi]), pack_counts(counts[lo:hi])))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())],
                    names=["uri", "kind", "p", "h", "c"],
                )

    sent = spread.mapInArrow(send, "uri string, kind int, p bigint, h binary, c binary")
    # tasks of a bounded size: as many as there are shards, and blocks on the way back
    totals = materialize(sent.repartition(max(parts, 1 << bits), "kind", "p").groupBy("kind", "p").applyInPandas(total_group, "uri string, kind int, p bigint, c binary, types bigint, tokens bigint"), "lm-totals")
    types, train_tokens = totals.where("kind = 0").agg(F.sum("types"), F.sum("tokens")).first()

    def keep(batches):
        """Write the returned counts beside their block, words then bigrams in order of shard."""
        held, last = [], None

        def put(uri, rows):
            with create(f"{uri}.counts") as f:
                for kind in (0, 1):
                    z = pack_counts(np.concatenate([unpack_counts(c) for k, c in rows if k == kind]))
                    f.write(struct.pack("<Q", len(z)) + z)
            return pa.RecordBatch.from_arrays([pa.array([uri])], names=["uri"])

        for batch in batches:
            for uri, kind, _, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and uri != last:
                    yield put(last, held)
                    held = []
                last = uri
                held.append((kind, c))
        if held:
            yield put(last, held)

    counted = materialize(totals.select("uri", "kind", "p", "c").repartition(max(parts, n_blocks), "uri").sortWithinPartitions("uri", "kind", "p").mapInArrow(keep, "uri string"), "lm-counted")
    counted = counted.repartition(min(parts, n_blocks), F.rand(11)) if n_blocks > 1 else counted

    def load(uri):
        b = Block.load(uri)
        with opened(f"{uri}.counts") as f:
            words, pairs = (unpack_counts(f.read(struct.unpack("<Q", f.read(8))[0])) for _ in range(2))
        return b, words, pairs

    def gather(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                b, words, pairs = load(uri)
                _, u, v, of = b.bigrams()
                n = np.bincount(of[b.train()], minlength=len(u))
                on = n > 0
                u, v, n, cuv = u[on], v[on], n[on], pairs[on]
                cu = words[u].astype(np.float64)
                q2 = np.where(cu > 1, (cuv - 1) / np.maximum(cu - 1, 1), 0.0)
                q1 = (words[v] - 1) / max(train_tokens - 1, 1)
                cell = (bucket(words[u]) * STEPS + log_bin(q2)) * STEPS + log_bin(q1)
                one, back = np.unique(cell, return_inverse=True)
                add = lambda x: pa.array(np.bincount(back, weights=x, minlength=len(one)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array((one // STEPS**2).astype(np.int64)), add(n * 1.0), add(n * q2), add(n * q1)], names=["cell", "b", "n", "q2", "q1"])

    # at most BUCKETS * STEPS ** 2 cells, and far fewer in fact, whatever the corpus
    cells = counted.mapInArrow(gather, "cell bigint, b bigint, n double, q2 double, q1 double").groupBy("cell", "b").agg(F.sum("n").alias("n"), F.sum("q2").alias("q2"), F.sum("q1").alias("q1"))
    weights = learn(cells.orderBy("cell").toPandas(), types)

    def rate(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                b, words, pairs = load(uri)
                _, u, v, of = b.bigrams()
                w = weights[bucket(words[u])]
                p = w[:, 0] * pairs / np.maximum(words[u], 1) + w[:, 1] * words[v] / max(train_tokens, 1) + w[:, 2] / (types + 1)
                base = np.log10((words + 1) / (train_tokens + types + 1))
                starts = np.concatenate([[0], np.cumsum(b.lens)[:-1]])
                add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has a token
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.ids, mask=b.null.astype(bool)),
                        pa.array(b.held.astype(bool)),
                        pa.array(b.lens),
                        pa.array(add((words > 0).astype(np.int64)[b.tokens])),
                        pa.array(np.full(len(b.ids), train_tokens, np.int64)),
                        pa.array(add(base[b.tokens])),
                        pa.array(add(np.log10(p)[of])),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return counted.mapInArrow(rate, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
