"""Vectors against brute force, archives as round trips."""

import gzip
import hashlib
import io

import numpy as np
import pytest

from tidewave.llm import embed, warc


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed, "CHUNK", 16)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, np.repeat(base[:4], 20, 0) + 0.12 * rng.standard_normal((80, 32)), base[5:6], base[5:6]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] * 32, [None] + [1.0] * 31, x[0, :16].tolist()]
    rows += [(n + k, v, None) for k, v in enumerate(odd)] + [(None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in embed.near_vectors(df).collect()}
    assert len(got) == len(rows)
    y = x.astype(np.float64)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == root:
            break
        root = new
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), root[i], root[i] == i), i
    for k in range(len(odd)):
        assert (got[n + k].n_links, got[n + k].component_id, got[n + k].kept) == (0, n + k, True)
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    assert embed.near_vectors(df.where("false")).count() == 0
    assert embed.near_vectors(df.where("embedding is null")).count() == 1


@pytest.mark.parametrize("dim", [64, 200])
def test_estimates_are_unbiased_and_bounded(dim):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, dim))
    q = v + 0.6 * rng.standard_normal((1500, dim))
    v, q = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (v, q))
    x, y = (embed.Codes.unpack(embed.Codes.of(a).pack(), dim) for a in (v, q))
    assert len(embed.Codes.of(v).pack()[0]) == embed.key_bits(dim) // 8 + 12 + embed.width(dim) // 2
    est, slack = embed.bounds(x, y)
    true = v @ q.T
    assert abs((est - true).mean()) < 0.002 and abs(np.diag(est - true).mean()) < 0.01
    assert (np.abs(est - true) <= slack).mean() > 1 - 1e-6


def test_recall_over_many_rows(spark):
    """Pairs near the bound among many rows: at least 0.99 of the links are found (in fact all, at a miss of 1e-4), and few pairs are recomputed."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6000, 64))
    near = base[:2000] + 0.42 * rng.standard_normal((2000, 64))
    x = np.concatenate([base, near]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embed.near_vectors(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, 0)
    want = (cos >= 0.9).sum(1)
    assert want.sum() > 1000 and sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want))
    c = embed.Codes.of(u[:2000])
    est, slack = embed.bounds(c, c)
    assert (est + slack >= 0.9).mean() < 0.05


def test_recall_bound():
    for n in (100, 10_000, 10_000_000):
        bits, t = embed.tables(n, 0.9)
        agree = 1 - np.arccos(0.9) / np.pi
        assert (1 - agree**bits) ** t <= embed.MISS


def test_tables_allow_for_keys_of_one_code():
    rng = np.random.default_rng(4)
    agree = 1 - np.arccos(0.9) / np.pi
    for n in (50_000, 500_000, 5_000_000):
        bits, t = embed.tables(n, 0.9)
        d = rng.binomial(embed.BITS, 1 - agree, 400_000)  # the bits in which the codes of a pair at the bound differ
        same = np.ones(len(d))
        for k in range(bits):
            same *= np.maximum(embed.BITS - d - k, 0) / (embed.BITS - k)
        assert ((1 - same) ** t).mean() <= 1.2 * embed.MISS


def pages(spark):
    big, other = "<p>" + "x" * 200, "é" * 60
    rows = [(5, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (1, "u\r\nWARC-Type: bad", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", other), (8, "u", other), (2, "again", big), (10, "u", "\r\n\r\n" * 100)]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    manifest = warc.write_pages(df)
    got = warc.read_pages(manifest).collect()
    assert len(got) == len(rows) and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    payload = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i, b in payload.items():
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    for r in got:
        b = payload[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
        again = r.page_id is not None and len(b) >= 100 and r.page_id > first[b]
        assert (r.record_type, r.refers_to) == (("revisit", first[b]) if again else ("response", None))
        assert r.payload == (None if again else b)
    assert sorted(str(r.page_id) for r in warc.roundtrip(df).collect()) == sorted(str(r[0]) for r in rows)
    assert warc.roundtrip(df.where("false")).count() == 0


def test_archives_of_a_table_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "x" * 200, 5, "a", 9), (2, "u", "x" * 200, 6, None, 8)], "page_id bigint, url string, html string, digest int, d string, first bigint")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.roundtrip(df).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1)}


def test_vectors_of_a_table_with_clashing_columns(spark):
    rows = [(i, [1.0, float(i % 2)], 7, "x", 1, 2) for i in range(4)]
    got = embed.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, links int, root string, w int, id int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1)]


def test_reader_checks_what_it_reads(spark):
    body = b"y" * 300
    data = warc.record("response", 1, "http://a", body, hashlib.sha256(body).hexdigest(), None)
    one = warc.member(data)
    assert gzip.decompress(one) == data
    rows = list(warc.read_archive(io.BytesIO(one + one)))
    assert len(rows) == 2 and rows[0]["payload"] == body
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.read_archive(io.BytesIO(one + one[:-5])))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_archive(io.BytesIO(warc.member(data.replace(b"yyyy", b"yyyz", 1)))))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(warc.member(data[:-10]))))
    small = io.BytesIO(one * 5)
    assert len(list(warc.members(small, 7))) == 5
