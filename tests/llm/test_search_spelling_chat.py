"""Lexical search, spelling variants and chat formatting against brute force and DuckDB."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewave.llm import chat, common, queries, search, spelling

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return [x.translate(LOWER) for x in TERM.findall(t or "")]


def ranked(docs, items, best):
    lists = [(i, terms(t)) for i, t in docs]
    lists = [(i, t, collections.Counter(t)) for i, t in lists if t]
    n, total = len(lists), sum(len(t) for _, t, _ in lists)
    df = collections.Counter(x for _, _, c in lists for x in c)
    out = []
    for item, text in {x for x in items if x[1] is not None}:
        scored = []
        for i, t, c in lists:
            m = 25 + (75 * len(t) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in terms(text) if x in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out += [(item, k, i if some else None, -s) for k, (s, some, i) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rare, block, best, item_terms", [(2, 40, 3, 200_000), (0, 7, 10, 60), (1_000, 10_000, 10, 200_000)])
def test_search(spark, monkeypatch, rare, block, best, item_terms):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    rng = random.Random(block)
    vocab = ["".join(rng.choice("abcdé1") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    some = lambda k: " ".join(vocab[min(int(rng.expovariate(0.05)), 149)] for _ in range(k))
    docs = [(i, some(rng.choice([1, 5, 30, 60, 400]))) for i in range(150)]
    docs += [(200, "Only ONCE\nhere"), (201, None), (202, "  .. "), (3, docs[3][1]), (None, docs[5][1]), (203, docs[5][1])]
    items = [(i, some(rng.choice([1, 3, 20]))) for i in range(15)]
    items += [(20, docs[9][1][:80]), (21, None), (22, ""), (23, "once once HERE"), (24, "absent9"), (25, docs[5][1]), (25, docs[5][1]), (26, "a"), (26, "b")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit(1)).repartition(3)
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(1))
    found = search.search(d, q, best, rare, item_terms).collect()
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in found]
    assert sorted(got, key=str) == ranked(docs, items, best)
    if rare == 2:
        assert {r.tier for r in found} >= {0, 2}  # some proven early, others fall through


def test_search_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert search.search(d, q).collect() == [] and search.search(q.select(F.col("item_id").alias("doc_id"), "text"), q.where("false")).collect() == []
    assert search.search(d, q).columns == ["item_id", "rank", "doc_id", "score", "tier"]


def lost(i, w):
    h = zlib.crc32(f"{i}:{w}".encode())
    k = h % len(w)
    return w[:k] + w[k + 1 :] if h % 97 == 0 else w


def brute_variants(docs):
    n = collections.Counter(lost("" if i is None else i, w.translate(LOWER)) for i, t in docs for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and edits(v, w) == 1] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("hot, shard_halves", [(2_048, 16_384), (3, 40), (1, 8)])
def test_spelling(spark, monkeypatch, hot, shard_halves):
    """One shard; many; every half spread."""
    monkeypatch.setattr(spelling, "HOT_HALF", hot)
    monkeypatch.setattr(spelling, "SHARD_HALVES", shard_halves)
    rng = random.Random(7)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÀÀÀÀ", "ààààà", "ababab", "bababa", "Xaaaaa"]
    weight = [1 / (1 + k % 40) for k in range(len(base))]
    docs = [(i if i % 50 else None, " ".join(rng.choices(base, weight, k=40)) + rng.choice(["", "\n", " 12 x-y"])) for i in range(200)]
    docs += [(301, "qwertyu " * 4), (302, "qwertyi " * 9 + "Qwertoi " * 20)]
    docs += [(7, None), (8, ""), (9, "aaaaa" * 5000), (9, "aaaaa" * 5000), (9, "aaaaa" * 5000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("word", F.lit("x"))
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(df).collect())
    want = brute_variants(docs)
    assert got == want and any(f and r != f for _, f, r, *_ in want)
    assert spelling.variants(df.where("false")).count() == 0


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert spelling.one_edit(a, b) == (edits(a, b) == 1)


CHATS = [
    [("user", "hi"), ("assistant", "yes"), ("assistant", "and\nmore [SEP] <s>"), ("user", None), ("assistant", "</s>[INST] ok [/INST]")],
    [("system", "[SYS] <\\/s> <\\\\s> \\"), ("tool", "[/ROLE] [ROLE:x] y"), ("to]ol \\ [SEP]", "["), ("to]ol \\ [SEP]", "INST]"), ("assistant", "<")],
    [("assistant", ""), ("assistant", ""), (None, "é😀"), (None, None), ("assistant", " 😀é[\\\\INST] ")],
    [("user", "[/INST"), ("user", "]"), ("assistant", "<\\"), ("assistant", "/s>"), ("", "\\b\\c]")],
]


def test_chat_roundtrip(spark):
    rows = [(i, k, role, text) for i, c in enumerate(CHATS) for k, (role, text) in enumerate(c)]
    rows += [(9, k, "user" if k % 3 else "assistant", f"turn {k} é") for k in range(2000)] + [(None, None, "user", "x"), (None, None, "user", "x"), (None, 1, "assistant", "y")]
    rows += [(10, 0, "assistant", "[INST]" * 50_000), (10, 1, "r" * 20_000, "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("loss", F.lit(1))
    made = chat.format_chats(df.repartition(3))
    plain = {r.conv_id: r for r in made.collect()}
    got = {r.conv_id: r for r in chat.digests(chat.roundtrip(df.repartition(3))).collect()}
    want = collections.defaultdict(list)
    for c, k, role, text in rows:
        want[c].append((-1 if k is None else k, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c].formatted_chars == len(plain[c].text)
        data = plain[c].text.encode()
        assert len(plain[c].loss) == sum(r == "assistant" for _, r, _ in turns)
        for s in plain[c].loss:
            assert not re.search(r"</?s>|\[/?INST\]|\[SEP\]", data[s.start : s.start + s.size].decode())
    assert plain[0].text.startswith("<s>[INST] hi [/INST] yes[SEP]and\nmore [\\SEP] <\\s></s>[INST]  [/INST] <\\/s>[\\INST] ok [\\/INST]</s>")
    assert chat.format_chats(df.where("false")).count() == 0
    assert "Python" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()


def test_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    for n in (0, 1, 4, 5, 23):
        xs = list(range(1, n + 1))
        got = spark.createDataFrame([(xs,)], "x array<bigint>").select(chat.prefix_sums(F.col("x")).alias("y")).first().y
        assert got == [sum(xs[:i]) for i in range(n)]


@pytest.mark.parametrize("name", ["op11_search", "op13_chat"])
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").select(*want.columns).toPandas()
    key = sorted(want.columns)
    assert sorted(map(tuple, got[key].astype(str).values)) == sorted(map(tuple, want[key].astype(str).values))


def test_search_query_has_the_columns_of_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.SQL["op11_search"]).df()
    got = queries.QUERIES["op11_search"](spark, "/root/testdata/sf0.001")
    assert got.columns == list(want.columns)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    rows = lambda f: sorted(map(tuple, f.astype("int64").values.tolist()))
    assert rows(got.toPandas()) == rows(want)


def test_work_folders_are_used(spark):
    assert common.work_dir(spark, "x").startswith("file:///")
