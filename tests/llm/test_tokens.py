"""Tokenizers: counts, ids, round trips, against the libraries."""

import base64
import hashlib
import random
import string
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewave.llm import bytebpe, tokenid
from tidewave.llm.wordbpe import HeapCounter, token_counts

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
LETTERS = "aAbZ éÉ 's't 12３ \n\t \x1c\x85 İΣς ß ǅ ́̈가 日本 👍🏽 <|endoftext|> don't !!.. ﬁ\r\n    　 the"


def texts(n=400, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*made, "", None, "<|endoftext|>x<|startoftext|>", "a" * 3000, "the cat " * 2000, "x"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "other", -1) for i, t in enumerate(texts())] + [(None, "null id", None, None), (7, "again", "x", 1), (7, "again", "x", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int").repartition(3)


def test_heap_counts_equal_the_library(library):
    h = HeapCounter(WORD)
    for t in texts():
        assert h.count((t or "").encode()) == len(library.encode(t or "", add_special_tokens=False).ids), t


def test_token_counts(spark, frame, library):
    got = token_counts(frame, WORD, 2048).collect()
    assert len(got) == frame.count()
    by = {(r.doc_id): r for r in got}
    for i, t in enumerate(texts()):
        if i != 7:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (by[i].n_bytes, by[i].n_tokens, by[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert by[None].n_tokens == 2
    assert token_counts(frame.where("false"), WORD).count() == 0


def test_id_shards_round_trip(spark, frame, library):
    folder, manifest = tokenid.write_ids(frame, WORD, 1, shard_bytes=2000)
    assert manifest.count() > 8
    got = sorted(tokenid.read_ids(folder, manifest).collect(), key=lambda r: r.start)
    rows = frame.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect()
    start = 0
    assert len(got) == len(rows)
    for g, r in zip(got, rows):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    m = manifest.orderBy("shard").first()
    shard = tokenid.Shard(m.uri, tokenid.read_dictionary(folder))
    assert shard.document(2).tolist() == [*library.encode(rows[2].text or "", add_special_tokens=False).ids, 1]
    with pytest.raises(ValueError):
        tokenid.Shard(m.uri, b"another dictionary")


def test_id_shards_of_an_empty_table(spark, frame):
    folder, manifest = tokenid.write_ids(frame.where("false"), WORD, 1)
    assert tokenid.read_ids(folder, manifest).count() == 0


def test_a_frequent_id_spreads_over_shards(spark):
    df = spark.range(4000).selectExpr("5L as doc_id", "string(id) as text").union(spark.createDataFrame([(1, "a"), (9, "b")], "doc_id bigint, text string"))
    folder, manifest = tokenid.write_ids(df, WORD, 1)
    assert manifest.count() > 4 and max(r.n_docs for r in manifest.collect()) < 1500
    got = tokenid.read_ids(folder, manifest).orderBy("start").collect()
    assert [got[0].doc_id, got[-1].doc_id] == [1, 9] and len(got) == 4002


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    spec = json.load(open(WORD, encoding="utf-8"))
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normalizer"):
        HeapCounter(str(tmp_path / "t.json"))


def test_wide_ids_take_four_bytes():
    assert tokenid.packed(np.array([1, 70000], "<u4"))[0] == 4 and tokenid.packed(np.array([1, 2], "<u4"))[0] == 2


@pytest.mark.parametrize("shared", [300_000, 40])
def test_byte_bpe_equals_the_library(spark, frame, monkeypatch, shared):
    monkeypatch.setattr(bytebpe, "SHARED_WORDS", shared)
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(
        (str(r.doc_id), len(ids := enc.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in frame.collect()
    )
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.roundtrip(frame, BYTE, P.PATTERN).collect())
    assert got == want
    assert bytebpe.roundtrip(frame.where("false"), BYTE, P.PATTERN).count() == 0


def test_byte_bpe_numbers_start_anew(monkeypatch):
    monkeypatch.setattr(bytebpe, "TEXT_BYTES", 8)
    import pyarrow as pa

    monkeypatch.setattr(bytebpe, "WORDS", 5)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a b c d e f", "g h", "a b"]})
    kinds = [k for b in bytebpe.split_batches([batch], P.PATTERN, {}) for k in b.column(0).to_pylist()]
    assert kinds.count(2) == 1 and kinds.count(1) == 3 and kinds.count(0) == 6 + 2 + 2


def test_byte_bpe_of_long_runs(spark):
    """Runs without an end equal tiktoken, in work that grows with them: letters, repeats, bytes of other scripts."""

    rng = random.Random(4)
    run = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [run(30_000, string.ascii_lowercase), "a" * 2001, "ha" * 700, run(900, "กะาเแ"), "=" * 1500, run(3000, "etaoin") + " " + run(200, "é"), run(129, "xyz"), run(128, "xyz")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    began = time.time()
    got = {r.doc_id: r for r in bytebpe.roundtrip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert time.time() - began < 120
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), i
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
