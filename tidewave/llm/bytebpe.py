"""Byte-level BPE: words are found in Python, their merges are folded by Spark's higher-order functions.

The commonest words of a bounded sample of documents are folded first, once, and broadcast with their ids and bytes: a bounded
store that spares work and changes no result. A task's rows then go through three steps without a shuffle, in order. The first splits texts into words
and sends each word that is new to the store and the task, once, followed by the documents as word numbers.
The second, in the JVM, folds the ranked merges over the bytes of each new word, with the ranks in a literal
map, and concatenates the pieces of its ids again. The third puts documents together from its words.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import string
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

#: Buckets of the literal map, whose lookups go through a bucket's few entries one by one.
BUCKETS = 16384
#: Words that a task numbers, besides the shared ones, before it starts anew.
WORDS = 200_000
#: Chunks of text whose words a task remembers from one cut to the next.
CHUNKS = 100_000
#: Bytes of texts that are cut into words at a time.
TEXT_BYTES = 1 << 22
#: Documents of the sample, and words of at most so many bytes that are shared: at most so many, so the broadcast is bounded.
SAMPLE_DOCS, SHARED_WORDS, SHARED_BYTES = 20_000, 300_000, 24
#: Words of more bytes are folded in windows of so many, whose seams are then folded again with so many ids on either side until both ends of it hold.
WINDOW, SEAMS = 128, (2, 8, 24)
#: Unicode's white space, as the pattern's \\s has it.
SPACE = "\t-\r \x85\xa0  -     　"
#: No match of the pattern crosses the ends of one of these.
MARKS = frozenset(string.punctuation)
SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{SPACE}]", c))
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def read_ranks(path: str) -> list[bytes]:
    """Byte strings in order of rank."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                word, rank = line.split()
                ranks[int(rank)] = base64.b64decode(word)
    return [ranks[i] for i in range(len(ranks))]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


class Literals:
    """The rank map and the list of pieces as literals. Bytes stand as the letters U+0000 to U+00FF."""

    def __init__(self, pieces: list[bytes]):
        buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        for rank, p in enumerate(pieces):
            buckets[self.place(p)][p.decode("latin-1")] = rank
        # parsed once, when the plan is optimized: from_json of a literal is folded to a literal
        self.ranks = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
        self.pieces = F.from_json(F.lit(json.dumps([p.decode("latin-1") for p in pieces])), "array<string>")

    @staticmethod
    def place(p: bytes) -> int:
        return zlib.crc32(p.decode("latin-1").encode()) % BUCKETS

    @staticmethod
    def rank(table: Column, s: Column) -> Column:
        bucket = F.get(table, (F.crc32(s.cast("binary")) % BUCKETS).cast("int"))
        return F.try_element_at(bucket, s)


def encode_word(word: Column, tables: Literals) -> Column:
    """The ids of a non-empty word (bytes as letters): merge the adjacent pair of lowest rank, the first of equals, until no pair has a rank.

    A word of more than ``WINDOW`` bytes is folded in windows, and whole where no seam tells.
    """

    def of(t: Column) -> Column:  # the literals stand in the plan once
        table, pieces = t["ranks"], t["pieces"]
        long = _let(_windows(word, table), lambda w: F.coalesce(*[_joined(w, table, pieces, k) for k in SEAMS], _fold(word, table)))
        return F.when(F.length(word) > WINDOW, long).otherwise(_fold(word, table))

    return _let(F.struct(tables.ranks.alias("ranks"), tables.pieces.alias("pieces")), of)


def _windows(word: Column, table: Column) -> Column:
    """The ids of each window of a word."""
    last = F.floor((F.length(word) - 1) / WINDOW).cast("int")
    return F.transform(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(word, i * WINDOW + 1, F.lit(WINDOW))), lambda w: _fold(w, table))


def _joined(windows: Column, table: Column, pieces: Column, k: int) -> Column:
    """The ids of a word of any length from those of its windows, in work that grows with it; null where ``k`` ids on either side of a seam do not tell.

    Ids are those of the merges if any two neighbours are: if the bytes of the two, merged by themselves, give the two again. At each seam the last ids of one window and
    the first of the next are folded together, and hold if they are right beside their neighbours on both sides.
    """
    text = lambda ids: F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")
    folded = lambda bytes_: _let(bytes_, lambda w: _fold(w, table))

    def beside(a: Column, b: Column) -> Column:
        """Whether ids are right side by side; true if there is none."""
        return F.when(a.isNull() | b.isNull(), True).otherwise(F.get(folded(F.concat(F.get(pieces, a), F.get(pieces, b))), 0) == a)

    def add(acc: Column, then: Column) -> Column:
        kept = F.greatest(F.size(acc["open"]) - k, F.lit(0))
        before = F.when(kept > 0, F.get(acc["open"], kept - 1)).otherwise(acc["before"])
        placed = lambda m: F.struct(
            F.concat(acc["done"], F.array(F.slice(acc["open"], F.lit(1), kept))).alias("done"),
            before.alias("before"),
            F.concat(m, F.slice(then, F.lit(k + 1), F.greatest(F.size(then) - k, F.lit(0)))).alias("open"),
            (beside(before, F.get(m, 0)) & beside(F.get(m, F.size(m) - 1), F.get(then, F.lit(k)))).alias("holds"),
        )
        seam = folded(F.concat(text(F.slice(acc["open"], kept + 1, F.lit(k))), text(F.slice(then, F.lit(1), F.lit(k)))))
        return F.when(acc["holds"], _let(seam, placed)).otherwise(acc)

    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.lit(None).cast("int").alias("before"), F.array().cast("array<int>").alias("open"), F.lit(True).alias("holds"))
    return F.aggregate(windows, start, add, lambda x: F.when(x["holds"], F.flatten(F.concat(x["done"], F.array(x["open"])))))


def _fold(word: Column, table: Column) -> Column:
    """State: the starts of the parts and the word's end (b), and the ranks of adjacent pairs between two nulls (r), null where a pair has none.

    A step binds one value by an inner ``aggregate`` from the state, which, unlike ``transform``, does not copy its result.
    """
    known = lambda s: Literals.rank(table, s)
    span = lambda lo, hi: known(F.substr(word, lo, hi - lo))
    n = F.length(word)
    edge = F.array(F.lit(None).cast("int"))
    together = lambda *arrays: F.flatten(F.array(*arrays))  # noqa: E731  as concat of arrays goes through lazy lists when it is interpreted, several times slower
    start = F.struct(
        F.sequence(F.lit(1), n + 1).alias("b"),
        together(edge, F.transform(F.sequence(F.lit(1), n - 1), lambda i: span(i, i + 2)), edge).alias("r"),
    )

    def merge(acc: Column, q: Column) -> Column:  # the pair is parts q - 1 and q, counted from one, its rank the q-th of r; the start of part q goes
        b, r = acc["b"], acc["r"]
        left, right = span(F.get(b, q - 3), F.get(b, q)), span(F.get(b, q - 2), F.get(b, q + 1))  # null past an end of b
        return F.struct(
            F.array_remove(b, F.get(b, q - 1)).alias("b"),
            together(F.slice(r, F.lit(1), q - 2), F.array(left, right), F.slice(r, q + 2, F.size(r))).alias("r"),
        )

    def step(acc: Column, _: Column) -> Column:
        first = F.array_position(acc["r"], F.array_min(acc["r"])).cast("int")  # null if no pair has a rank
        return F.aggregate(F.array(first), acc, lambda a, q: F.when(q.isNull(), a).otherwise(merge(a, q)))

    def ids(acc: Column) -> Column:
        b = acc["b"]
        return F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: span(F.get(b, i), F.get(b, i + 1)))

    folded = F.aggregate(F.sequence(F.lit(1), n - 1), start, step, ids)
    return _let(known(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).when(n > 1, folded))


def decode_word(ids: Column, tables: Literals) -> Column:
    """The bytes of ids, their binary pieces concatenated."""
    return _let(tables.pieces, lambda pieces: F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1"))


STREAM = "kind tinyint, word string, doc_id bigint, words binary"


class Words(dict):
    """Chunks of text as numbers of their words (four bytes each), with the words that got a number since ``fresh`` was emptied. The ``shared`` words have the first numbers."""

    def __init__(self, pattern: str, shared: dict[str, int]):
        import regex

        super().__init__()
        self.find, self.shared = regex.compile(pattern).findall, shared
        # letters are one word, with a space before them or not, and a mark after them is another
        self.plain = all(self.find(x + m) == [x, *m] for x in ("ab", " ab") for m in ("", *MARKS))
        self.fresh: list[str] = []
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.number = dict(self.shared)

    def of(self, word: str) -> bytes:
        k = self.number.get(word)
        if k is None:
            k = self.number[word] = len(self.number)
            self.fresh.append(word if word.isascii() else word.encode().decode("latin-1"))
        return k.to_bytes(4, "little")

    def __missing__(self, chunk: str) -> bytes:
        core = chunk[:-1] if chunk[-1] in MARKS else chunk
        if self.plain and core and core.isascii() and (core.isalpha() or core[0] == " " and core[1:].isalpha()):
            out = self.of(core) if core is chunk else self.of(core) + self.of(chunk[-1])
        else:
            out = b"".join([self.of(p) for p in self.find(chunk)])
        self[chunk] = out
        return out

    def payload(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))

    def payloads(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Texts as numbers. They are cut at their spaces, where no match of ``CHUNK`` crosses if no other white space is beside one;
        each distinct piece is looked up once. Texts with a space at an end of a piece go through ``CHUNK`` whole."""
        if len(self) > CHUNKS:
            self.clear()
        pieces = pc.split_pattern(texts.fill_null(""), pattern=" ")
        at, flat = pieces.offsets.to_numpy().astype(np.int64), pieces.flatten()
        at -= at[0]
        coded = flat.dictionary_encode()
        distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(code), bool)
        first[at[:-1]] = True
        inner = np.zeros(len(distinct), bool)
        inner[code[~first]] = True
        odd = np.fromiter((not p or p[0] in SPACES or p[-1] in SPACES for p in distinct), bool, len(distinct))
        whole = np.logical_or.reduceat(odd[code], at[:-1])
        known = [self[" " + p] if i and not o else b"" for p, i, o in zip(distinct, inner.tolist(), odd.tolist(), strict=True)]
        # a text's first piece has no space before it
        starts = [self.payload(text or "") if w else self[distinct[c]] for text, w, c in zip(texts.to_pylist(), whole.tolist(), code[at[:-1]].tolist(), strict=True)] if len(texts) else []
        code[at[:-1]] = len(known) + np.arange(len(texts))
        if whole.any():
            code = code[first | ~np.repeat(whole, np.diff(at))]
            at = np.concatenate([[0], np.cumsum(np.where(whole, 1, np.diff(at)))])
        taken = pa.array([*known, *starts], pa.large_binary()).take(pa.array(code))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(code) + 1]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends[at])), taken.buffers()[2]]).cast(pa.binary())


def slices(batches):
    """Batches cut where their texts have some megabytes, or else after one row."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TEXT_BYTES)))
            yield batch.slice(lo, hi - lo)
            lo = hi


def split_batches(batches, pattern: str, shared: dict[str, int]):
    """New words (kind 0), documents as word numbers (kind 1); kind 2 starts the numbers after the shared ones anew."""
    words = Words(pattern, shared)

    def rows(kind, n, **columns):
        of = {"word": pa.nulls(n, pa.string()), "doc_id": pa.nulls(n, pa.int64()), "words": pa.nulls(n, pa.binary())} | columns
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *of.values()], names=["kind", *of])

    for part in slices(batches):
        if len(words.number) >= WORDS + len(shared):
            words.restart()
            yield rows(2, 1)
        payloads = words.payloads(part.column(1))
        fresh, words.fresh = words.fresh, []
        for i in range(0, len(fresh), 10_000):
            yield rows(0, len(fresh[i : i + 10_000]), word=pa.array(fresh[i : i + 10_000], pa.string()))
        yield rows(1, part.num_rows, doc_id=part.column(0), words=payloads)


def count_batches(batches, pattern: str):
    """Rows (word, n) of the short words of these batches, bytes as letters."""
    from collections import Counter

    words = Words(pattern, {})
    n: Counter = Counter()
    for part in slices(batches):
        number, often = np.unique(np.frombuffer(words.payloads(part.column(1)).buffers()[2] or b"", "<u4"), return_counts=True)
        n.update(dict(zip(number.tolist(), often.tolist(), strict=True)))
    names = [w if w.isascii() else w.encode().decode("latin-1") for w in words.number]
    rows = [(names[k], c) for k, c in n.items() if len(names[k]) <= SHARED_BYTES]
    for i in range(0, len(rows), 10_000):
        w, c = zip(*rows[i : i + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(c, pa.int64())], names=["word", "n"])


def shared_words(docs: DataFrame, tables: Literals, pattern: str) -> pa.Table:
    """Word, ids and decoded of words that are common in a sample by a hash of doc_id: at most ``SHARED_WORDS``."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "text")
    counted = chosen.mapInArrow(lambda b: count_batches(b, pattern), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    scratch = Scratch(docs.sparkSession, "bpe-words")
    counted = scratch.save(counted)
    least, total = 1 << 62, 0  # the count from which words are taken
    for r in counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect():
        total += r["count"]
        if total > SHARED_WORDS:
            break
        least = r.n
    store = folded(counted.where(F.col("n") >= least).select("word"), tables).toArrow()
    scratch.clear()
    return store


def folded(words: DataFrame, tables: Literals) -> DataFrame:
    """The columns of ``words`` with ids and decoded of ``word`` (null of null)."""
    rest = [c for c in words.columns]
    ids = F.when(F.col("word").isNotNull(), encode_word(F.col("word"), tables))
    return words.select(*rest, F.inline_outer(F.array(F.struct(ids.alias("ids"))))).select(*rest, "ids", decode_word(F.col("ids"), tables).alias("decoded"))


#: What this process has made of a broadcast store, by the store's name and the use; of one store only.
MADE: dict[tuple[str, str], object] = {}


def made_once(name: str, use: str, make):
    if (name, use) not in MADE:
        for key in [k for k in MADE if k[0] != name]:
            del MADE[key]
        MADE[name, use] = make()
    return MADE[name, use]


def store_numbers(table: pa.Table) -> dict[str, int]:
    return {w if w.isascii() else w.encode("latin-1").decode(): k for k, w in enumerate(table.column("word").to_pylist())}


def spelled(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Decimal ids, a space after each, and how many."""
    text = pc.binary_join_element_wise(column.flatten().cast(pa.string()), "", " ")
    at = column.offsets.to_numpy()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at - at[0]), text), "").cast(pa.binary()), np.diff(at)


class Results:
    """What words' numbers stand for: their ids in decimal, bytes and counts."""

    def __init__(self, shared: tuple[pa.Array, pa.Array, np.ndarray]):
        self.shared = shared
        self.restart()

    def restart(self) -> None:
        self.parts = [self.shared]

    def add(self, ids: pa.Array, decoded: pa.Array) -> None:
        text, counts = spelled(ids)
        self.parts.append((text, decoded, counts))

    def whole(self) -> tuple[pa.Array, pa.Array, np.ndarray]:
        if len(self.parts) > 1:
            a, b, c = zip(*self.parts, strict=True)
            self.parts = [(pa.concat_arrays(a), pa.concat_arrays(b), np.concatenate(c))]
        return self.parts[0]


def store_results(table: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray]:
    made = Results((pa.array([], pa.binary()), pa.array([], pa.binary()), np.zeros(0, np.int64)))
    for b in table.to_batches():
        made.add(b.column(b.schema.get_field_index("ids")), b.column(b.schema.get_field_index("decoded")))
    return made.whole()


def pieces_of(values: pa.Array, words: np.ndarray, cuts: np.ndarray):
    """Of each text, from cut to cut, its words' values one after the other."""
    taken = values.take(pa.array(words))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(words) + 1].astype(np.int64)[cuts]
    data = memoryview(taken.buffers()[2] or b"")
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        yield data[a:b]


def join_batches(batches, shared: tuple[pa.Array, pa.Array, np.ndarray]):
    made = Results(shared)
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if kinds[lo] == 2:
                made.restart()
            elif kinds[lo] == 0:
                made.add(part.column(3), part.column(4))
            else:
                ids, decoded, counts = made.whole()
                for texts in slices([part.select([1, 2])]):
                    payload = texts.column(1).to_pylist()
                    words = np.frombuffer(b"".join(payload), "<u4").astype(np.int64)
                    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in payload])])
                    total = np.concatenate([[0], np.cumsum(counts[words])])[at]
                    out_ids = [hashlib.sha256(x[:-1]).hexdigest() for x in pieces_of(ids, words, at)]
                    out_text = [hashlib.sha256(x).hexdigest() for x in pieces_of(decoded, words, at)]
                    yield pa.RecordBatch.from_arrays([texts.column(0), pa.array(np.diff(total)), pa.array(out_ids, pa.string()), pa.array(out_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def roundtrip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (of decimal ids, a space between), decoded_sha256 (of the decoded bytes).

    Null texts are empty: no ids, no bytes. Null and repeated ids keep their rows; texts are processed whole at
    any length; an empty table gives an empty result; other columns are not read. Documents are not shuffled.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    tables = Literals(read_ranks(path))
    store = shared_words(docs, tables, pattern)
    name = uuid.uuid4().hex
    known = docs.sparkSession.sparkContext.broadcast(store)

    def split(batches):
        return split_batches(batches, pattern, made_once(name, "numbers", lambda: store_numbers(known.value)))

    def join(batches):
        return join_batches(batches, made_once(name, "results", lambda: store_results(known.value)))

    stream = folded(docs.mapInArrow(split, STREAM), tables).select("kind", "doc_id", "words", "ids", "decoded")
    return stream.mapInArrow(join, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
