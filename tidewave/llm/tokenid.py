"""Token-id shards: one zstandard dictionary for all, each document compressed by itself, with an offset index.

Shard layout (little-endian)::

    8 bytes  magic "TWTOKID1"
    32 bytes sha256 of the dictionary
    the documents' compressed id arrays, one after the other (ids of 16 bits if all fit, else 32)
    index, zstd-compressed: columns has_id u8, doc_id i64, offset u64, n_bytes u32, n_tokens u64, width u8
    24 bytes n_docs u64, index offset u64, magic "TWTOKIX1"
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, qualified, work_dir
from .files import create, opened_at
from .wordbpe import WordSplitter

MAGIC, TAIL = b"TWTOKID1", b"TWTOKIX1"
#: Entries of a worker's chunk cache; beyond, it restarts.
CACHE_ENTRIES = 500_000
INDEX = (("has_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("n_bytes", "<u4"), ("n_tokens", "<u8"), ("width", "u1"))


class ChunkEncoder(WordSplitter):
    """Ids by the tokenizers library, kept for each piece and each run without ASCII white space.

    The library's merges run once for each piece that is not in a worker's cache.
    """

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model  # keep: the library hands out a new object each time
        self.by_chunk: dict[bytes, bytes] = {}
        self.by_piece: dict[str, bytes] = {}
        self.special_ids = {s: struct.pack("<I", tokenizer.token_to_id(s)) for s in self.special}

    def chunk(self, chunk: bytes) -> bytes:
        out = []
        for p in self.split(chunk):
            got = self.by_piece.get(p)
            if got is None:
                got = self.special_ids.get(p)
                if got is None:
                    if len(self.by_piece) >= CACHE_ENTRIES:
                        self.by_piece.clear()
                    word = p if p.isascii() and p.isprintable() else "".join([self.letters[b] for b in p.encode()])
                    ids = [t.id for t in self.model.tokenize(word)]
                    got = self.by_piece[p] = struct.pack(f"<{len(ids)}I", *ids)
            out.append(got)
        return b"".join(out)

    def words(self, words: list[bytes]) -> list[bytes]:
        known = self.by_chunk
        out = list(map(known.get, words))
        if None in out:
            for i, w in enumerate(words):
                if out[i] is None:
                    got = known.get(w)
                    if got is None:
                        got = self.chunk(w)
                        if len(known) >= CACHE_ENTRIES:
                            known.clear()
                        if len(w) <= 64:
                            known[w] = got
                    out[i] = got
        return out

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        end = struct.pack("<I", end_id)
        return [np.frombuffer(b"".join([*self.words((t or "").encode().split()), end]), "<u4") for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def packed(ids: np.ndarray) -> tuple[int, bytes]:
    """Width in bytes and the serialized ids."""
    return (2, ids.astype("<u2").tobytes()) if not len(ids) or ids.max() < 65536 else (4, ids.astype("<u4").tobytes())


SAMPLE_CHARS = 100_000
#: Bytes of frames, and documents, after which a shard is closed and another begun, so that a shard's index fits a task's memory.
SHARD_BYTES, SHARD_DOCS = 1 << 28, 2_000_000


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample_docs: int, dict_bytes: int) -> bytes:
    """From about ``sample_docs`` documents, whole, of up to ``SAMPLE_CHARS`` characters, chosen and ordered by hashes of id and text (a bounded sample; it only steers compression)."""
    share = min(1.0, sample_docs / max(docs.count(), 1))
    chosen = F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    short = F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS
    rows = docs.where(chosen & short).select("text").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "text").limit(2 * sample_docs).collect()
    samples = [packed(x)[1] for x in encoder(path).encode([r.text for r in rows], end_id)]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples for a trained dictionary
        return b"".join(samples)[:dict_bytes]


def write_shard(uri: str, coded, dictionary: bytes, level: int, most: int) -> tuple[int, int]:
    """Write (doc_id, ids) of an iterator, already in order, as one shard of about ``most`` bytes; returns documents and ids."""
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
    cols: dict[str, list] = {k: [] for k, _ in INDEX}
    at, total = 0, 0
    with create(uri) as out:
        out.write(MAGIC + hashlib.sha256(dictionary).digest())
        for doc_id, ids in coded:
            width, raw = packed(ids)
            blob = squeeze.compress(raw)
            out.write(blob)
            for k, v in zip(cols, (doc_id is not None, doc_id or 0, at, len(blob), len(ids), width), strict=True):
                cols[k].append(v)
            at += len(blob)
            total += len(ids)
            if at >= most or len(cols["doc_id"]) >= SHARD_DOCS:
                break
        out.write(zstandard.compress(b"".join(np.array(cols[k], kind).tobytes() for k, kind in INDEX), 3))
        out.write(struct.pack("<QQ", len(cols["doc_id"]), 40 + at) + TAIL)
    return len(cols["doc_id"]), total


class Shard:
    """Random and sequential access to a shard."""

    def __init__(self, uri: str, dictionary: bytes):
        self.file = opened_at(uri)
        size = self.file.size()
        head = self.file.read_at(40, 0)
        if head[:8] != MAGIC or head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a shard of this dictionary")
        n, index_at, tail = struct.unpack("<QQ8s", self.file.read_at(24, size - 24))
        if tail != TAIL:
            raise ValueError(f"{uri}: incomplete shard")
        raw = zstandard.decompress(self.file.read_at(size - 24 - index_at, index_at), max_output_size=n * 30 + 1)
        self.index, at = {}, 0
        for k, kind in INDEX:
            step = np.dtype(kind).itemsize * n
            self.index[k] = np.frombuffer(raw[at : at + step], kind)
            at += step
        self.n = n
        self.expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def _ids(self, i: int, blob: bytes) -> np.ndarray:
        ids = np.frombuffer(self.expand.decompress(blob), "<u2" if self.index["width"][i] == 2 else "<u4").astype("<u4")
        if len(ids) != self.index["n_tokens"][i]:
            raise ValueError("index and ids differ")
        return ids

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by one short read."""
        return self._ids(i, self.file.read_at(int(self.index["n_bytes"][i]), 40 + int(self.index["offset"][i])))

    def documents(self, block: int = 1 << 22):
        """(position, ids) of every document in order, reading a few MB at a time."""
        i = 0
        while i < self.n:
            first, end = int(self.index["offset"][i]), i
            while end < self.n and (end == i or int(self.index["offset"][end]) - first < block):
                end += 1
            stop = int(self.index["offset"][end - 1]) + int(self.index["n_bytes"][end - 1])
            data = self.file.read_at(stop - first, 40 + first)
            for k in range(i, end):
                o = int(self.index["offset"][k]) - first
                yield k, self._ids(k, data[o : o + int(self.index["n_bytes"][k])])
            i = end


def read_dictionary(folder: str) -> bytes:
    with opened_at(f"{folder}/dictionary.zdict") as f:
        return f.read()


def write_ids(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None, sample_docs: int = 256, dict_bytes: int = 65_536, level: int = 3, shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order.

    Returns the folder and a manifest (shard, uri, n_docs, n_ids, start): start counts the ids of all
    shards before. Null texts are empty (the end id alone); null ids come first; equal ids are ordered
    by a hash of the text, then the text; other columns are not read; an empty table gives an empty manifest. Shards are parts of
    the partitions of a range partitioning on doc_id and that hash, so a frequent id spreads; a shard is closed at ``shard_bytes``.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    folder = qualified(spark, folder) if folder else work_dir(spark, "token-ids")
    dictionary = train_dictionary(docs, path, end_id, sample_docs, dict_bytes)
    with create(f"{folder}/dictionary.zdict") as f:
        f.write(dictionary)

    def run(batches):
        from pyspark import TaskContext

        import pyarrow as pa

        dictionary, context, made = read_dictionary(folder), TaskContext.get(), 0

        def coded():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), encoder(path).encode(b.column(1).to_pylist(), end_id), strict=True)

        docs = coded()
        first = next(docs, None)
        while first is not None:
            uri = f"{folder}/ids-{context.partitionId():06d}-{made:04d}-{context.taskAttemptId()}.bin"
            n, total = write_shard(uri, chain([first], docs), dictionary, level, shard_bytes)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId() << 20 | made], pa.int64()), "uri": [uri], "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([total], pa.int64())})
            made += 1
            first = next(docs, None)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("doc_id").asc_nulls_first()
    rows = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, key, F.col("h").asc()).sortWithinPartitions(key, "h", F.col("text").asc_nulls_first()).drop("h")
    manifest = materialize(rows.mapInArrow(run, "shard bigint, uri string, n_docs bigint, n_ids bigint"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return folder, manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint"))


def read_ids(folder: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of every document, from the files alone but for each shard's start."""

    def run(frames):
        dictionary = read_dictionary(folder)
        for frame in frames:
            for uri, start in zip(frame["uri"], frame["start"], strict=True):
                s = Shard(uri, dictionary)
                starts = int(start) + np.concatenate([[0], np.cumsum(s.index["n_tokens"].astype("i8"))])
                crcs = np.fromiter((zlib.crc32(ids.tobytes()) for _, ids in s.documents()), "i8", s.n)
                ids = pd.array(s.index["doc_id"].astype("i8"), dtype="Int64")
                ids[s.index["has_id"] == 0] = pd.NA
                for at in range(0, s.n, 20_000):
                    to = slice(at, at + 20_000)
                    yield pd.DataFrame({"doc_id": ids[to], "start": starts[:-1][to], "n_tokens": s.index["n_tokens"].astype("i8")[to], "ids_crc32": crcs[to]})

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("uri", "start").repartition(parts).mapInPandas(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
