"""Near-duplicates, quality, personal data, packing, language model and pipeline against brute force."""

import collections
import hashlib
import importlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewave.llm import common, files, lm, minhash, packing, pii, quality

SPACE = "[\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, root int, kept boolean"


def words(t):
    return [w for w in re.split(SPACE, t or "") if w]


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 60, 200])))
        rows.append(t)
    base = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(3)]
    for b in base:
        for k in range(25):  # near copies, more and more edited
            w = b.split()
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    passage = " ".join(rng.choice(vocab) for _ in range(55))
    rows += [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows += [rows[0].upper(), rows[0], "", None, "   ", "one", "One", "a b c d", "A  b\tc d", "é É"]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 17 == 0 else f"s{i % 4}", len(t or ""), "x", 1, False) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x.translate(LOWER) for x in words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("rounds, sparse, one_task", [(5, 4, 500_000), (1, 0, 0), (0, 0, 500_000)])
def test_near_duplicates(docs, monkeypatch, rounds, sparse, one_task):
    """Stars and sparse blocks; one star and dense blocks; dense blocks alone."""
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "SPARSE", sparse)
    monkeypatch.setattr(minhash, "CHUNK", 8)
    monkeypatch.setattr(minhash, "PART_HASHES", 50)
    monkeypatch.setattr(minhash, "components", lambda e, n: common.components(e, n, one_task=one_task))
    sets, root = brute_components(corpus())
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert len(got) == len(root)
    for i, r in enumerate(root):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), r, r == i), i


def test_near_duplicate_edges(spark, docs):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("2", "2", True), ("3", "3", True), ("3", "3", True), ("None", "None", True), ("None", "None", True)]
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in enumerate(brute_components(corpus())[1]) if r == i}


@pytest.mark.parametrize("seed", range(4))
def test_ids_with_several_texts(spark, monkeypatch, seed):
    """Each row is a document under its id, in whatever order the rows come."""
    monkeypatch.setattr(minhash, "SPARSE", 4 if seed % 2 else 0)
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    x, y, z = (" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(3))
    rows = [(5, y), (1, x), (1, y), (7, y + " one"), (9, z), (5, z), (None, y + " two"), (None, z), (8, "two " + y), (3, "alone " * 3), (1, x)]
    rng.shuffle(rows)
    known = [r for r in rows if r[0] is not None]
    _, root = brute_components([t for _, t in known])
    least = [min(known[j][0] for j in range(len(known)) if root[j] == root[i]) for i in range(len(known))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = minhash.near_duplicates(df.withColumn("copy", F.col("text")), carry=("copy",) if seed < 2 else ()).collect()
    want = sorted((i, c, i == c) for (i, _), c in zip(known, least, strict=True))
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == want
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = [(r.doc_id, r.text) for r in minhash.drop_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[0] is None] + [r for r, c in zip(known, least, strict=True) if r[0] == c], key=str)


def test_rows_without_id_and_text_conflict_with_nothing(spark):
    """A row without id and text is no copy of the document whose id is the hash of nothing."""
    df = spark.createDataFrame([(42, "a b c"), (None, None), (None, "a b c"), (7, "a b c")], "doc_id bigint, text string")
    bins = collections.defaultdict(list)
    for r in packing.pack(df).collect():
        bins[r.bin_id].append(r.doc_id)
    assert len(bins) == 3 and sum(len(b) == 2 for b in bins.values()) == 1


def test_work_folder_is_qualified(spark):
    """A path without a scheme is on the default file system."""
    conf = spark._jsc.hadoopConfiguration()
    was = conf.get("fs.defaultFS")
    try:
        assert common.qualified(spark, "/tmp/x") == "file:///tmp/x"
        conf.set("fs.viewfs.mounttable.store.link./tmp", "file:///tmp")
        conf.set("fs.defaultFS", "viewfs://store/")
        assert common.qualified(spark, "/tmp/x") == "viewfs://store/tmp/x"
        assert common.qualified(spark, "file:///tmp/x") == "file:///tmp/x"
    finally:
        conf.set("fs.defaultFS", was)
    assert re.fullmatch(r"file:///.*/n-\w{12}", common.work_dir(spark, "n"))
    with pytest.raises(ValueError, match="file system"):
        files.resolve("/tmp/x")


def test_block_rows_grow_with_a_bucket(spark):
    """A large component with a few strangers gives each of its classes one row; two buckets with the same members are one."""
    for size in (10_000, 20_000):
        rows = [(h, i, 0 if i < size else i) for h in (1, 2) for i in range(size + 3)]
        entries = spark.createDataFrame(rows, "h bigint, id bigint, root bigint")
        open_ = spark.createDataFrame([(1,), (2,)], "g bigint")
        blocks = minhash._blocks(entries, open_)
        chunks = -(-size // minhash.CHUNK)
        assert blocks.count() == size + 3 * (chunks + 1)
        met = blocks.groupBy("p", "q").agg(F.count_distinct("root").alias("n")).collect()
        assert len(met) == chunks + 1


def test_circulant_signature_estimates():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    est = np.mean([np.mean(minhash.signature(np.unique(a + np.uint64(s))) == minhash.signature(np.unique(b + np.uint64(s)))) for s in range(20)])
    assert est == pytest.approx(1500 / 2500, abs=0.03)


def test_words_are_hashed_side_by_side(monkeypatch):
    """Texts are cut, hashed and signed many at a time, with the sets that each has by itself."""
    calls = []
    digest = minhash.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(minhash.xxhash, "xxh3_64_intdigest", lambda w: calls.append(bytes(w)) or digest(w))
    long = "x" * 64
    texts = [*corpus(), "a\0", "a", "\0", "ab cd", "abcd", long, long + "y", long + "Y", "1234567", "12345678", "123456789", "a\x0bb\x1cc\xa0d", "É é", "z" * 7 + " ", " q", "q"] * 2
    column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    monkeypatch.setattr(minhash, "PIECE_BYTES", 900)
    monkeypatch.setattr(minhash, "TILE", 100)
    b = minhash.signature_batch(pa.RecordBatch.from_arrays([pa.array(range(len(texts)))] * 2 + [column, column], names=["doc_id", "t", "text", "copy"]))
    assert set(calls) == {(long + "y").encode()}  # none for a word of up to 64 bytes
    sets = [frozenset(brute_components([t])[0][0]) for t in texts]
    assert b.column("n").to_pylist() == [len(s) for s in sets] and b.column("n_words").to_pylist() == [len(words(t)) for t in texts]
    of = collections.defaultdict(set)
    for s, d in zip(sets, b.column("d").to_pylist(), strict=True):
        of[s].add(d)
    assert all(len(d) == 1 for d in of.values()) and of.pop(frozenset()) == {None} and len(set().union(*of.values())) == len(of)
    for t, bands, *sketch in zip(texts, *(b.column(c).to_pylist() for c in ("bands", "s0", "s1", "s2", "s3")), strict=True):
        s = minhash.shingles(t)
        own = [x[0].tolist() for x in minhash.bands_and_sketches([s])] if len(s) else [[], [0] * 4]
        assert [bands, sketch] == own
    assert minhash.signature_batch(b.select(["doc_id", "t"]).append_column("text", column).slice(0, 0)).num_rows == 0


def test_similar_pairs_of_a_batch(monkeypatch):
    monkeypatch.setattr(minhash, "PIECE_BYTES", 3000)
    texts = [t for t in corpus() if words(t)]
    sets, _ = brute_components(texts)
    pairs = [(i, j) for i in range(0, len(texts), 7) for j in range(len(texts))]
    b = pa.RecordBatch.from_arrays([pa.array(c) for c in ([i for i, _ in pairs], [j for _, j in pairs], [texts[i] for i, _ in pairs], [texts[j] for _, j in pairs])], names=list("abxy"))
    got = minhash.similar_batch(b, 75)
    assert list(zip(*(c.to_pylist() for c in got.columns), strict=True)) == [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]


def test_ranges_of_sets_come_many_at_a_time(monkeypatch):
    monkeypatch.setattr(minhash, "PIECE_BYTES", 5000)
    texts = [t for t in corpus() if words(t)]
    parts = [1 + i % 4 for i in range(len(texts))]
    ids = pa.array(range(len(texts)))
    rows = pa.RecordBatch.from_arrays([ids] * 7 + [pa.array(parts), pa.array(texts)], names=["h", "p", "q", "own", "id", "root", "n", "parts", "text"])
    got = list(minhash.shingle_parts([rows]))
    assert 1 < len(got) < len(texts)
    got = pa.Table.from_batches(got).to_pylist()
    assert [(r[c], r["part"]) for r in got for c in ("h", "n")] == [(i, k) for i, n in enumerate(parts) for k in range(n) for _ in "hn"]
    for i, t in enumerate(texts):
        mine = [r["hashes"] for r in got if r["id"] == i]
        assert [x % 2**64 for part in mine for x in part] == minhash.shingles(t).tolist()
        assert all((x % 2**64 >> 33) * parts[i] >> 31 == k for k, part in enumerate(mine) for x in part)


def metrics(t):
    w = words(t)
    n = len(w)
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered = {j for i in range(n - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


ODD = ["a b c a b c", "x y z\nx y z\n\n \nq\nx y z ", "#*$ %& |<>", "é é  é", "a a a a a a", "b a a a b a a", "", None, "one two"]


def test_quality_metrics(spark, docs):
    rows = [(i, t) for i, t in enumerate([*ODD, *corpus(), "w " * 30000, "lorem ipsum dolor " * 900])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    for r in quality.quality(df, labels).collect():
        m = metrics(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        assert (r.base_failed, r.kept) == (failed, not failed)
    assert quality.quality(df.where("false"), labels).count() == 0


def test_binomial_tail(spark):
    for n, k, p in [(10, 0, 0.1), (500, 2, 0.01), (5000, 20, 0.01), (100000, 900, 0.01), (10, 5, 0.1), (10000, 64, 0.01), (10000, 65, 0.01), (3000000, 29000, 0.01)]:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) if k < n * p else 1.0
        from pyspark.sql import functions as F

        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), p)).first()[0]
        assert got == pytest.approx(want, rel=1e-6)


def test_certified_cutoffs(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        good = i % 5 > 0
        w = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(60)]
        if not good or i % 400 == 1:  # of the good ones in "en" one in 160 has symbols, too: too many to certify
            w = [x + "#" for x in w]
        rows.append((i, " ".join(w), "en" if i % 2 else None))
        labels.append((i, int(good)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (1, 0)], "doc_id bigint, quality int")
    got = {r.doc_id: r.kept for r in quality.quality(df, lab).collect()}
    good = [i for i, g in labels if g]
    assert sum(not got[i] for i in good) <= 0.04 * len(good)
    assert all(got[i] == (i % 2 == 1) for i, g in labels if not g)
    few = {r.doc_id: r.kept for r in quality.quality(df, lab.where("doc_id < 100")).collect()}
    assert all(few.values())  # too few labels to certify anything
    kept = quality.quality_filter(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def brute_cutoffs(rows, labels, risk=0.04, delta=0.05, price=10.0):
    """Per language and rule: the certified cutoff by exact binomials in rational arithmetic, or None."""
    from fractions import Fraction

    def tail(n, k, p):
        p = Fraction(p).limit_denominator(10**6)
        return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) if k < n * p else 1.0

    value = {
        "symbols": lambda m, n: m[2] / max(m[0], 1),
        "repeats": lambda m, n: m[4] / max(m[0], 1),
        "dup_lines": lambda m, n: m[3] / max(n, 1),
        "word_length": lambda m, n: m[1] / max(m[0], 1),
    }
    held = collections.defaultdict(list)
    for i, t, lang in rows:
        m = metrics(t)
        if i in labels and not (m[0] < 50 or 100 * m[4] > 50 * m[0]):
            held[lang].append((labels[i], m, len([x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)])))
    out = {}
    for lang, docs in held.items():
        for rule, grid in quality.GRID.items():
            best, low = None, 0.0
            n_good, n_bad = sum(g for g, *_ in docs), sum(1 - g for g, *_ in docs)
            for k, t in enumerate(grid):
                over = [g for g, m, n in docs if value[rule](m, n) > t]
                low = max(low, tail(n_good, sum(over), risk / 4))
                use = (len(over) - sum(over)) / max(n_bad, 1) - price * sum(over) / max(n_good, 1)
                if low <= delta / (len(held) * 4) and use > 0 and (best is None or use > best[0] + 1e-12):
                    best = (use, t)
            if best:
                out[lang, rule] = best[1]
    return out


def test_cutoffs_equal_exact_binomials(spark):
    rng = random.Random(11)
    rows, labels = [], {}
    for i in range(3600):
        good, lang = i % 4 > 0, ["en", None][i // 4 % 2]
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(rng.randint(52, 70))]
        if not good or rng.random() < 0.002:
            for _ in range(rng.randint(0, 40)):
                w[rng.randrange(len(w))] += "#"
        if not good and rng.random() < 0.5:
            w = w[:12] * 2 + w[:34] + ["x" * 40] * rng.randint(0, 9)
        rows.append((i, " ".join(w), lang))
        labels[i] = int(good)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    lab = spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int")
    got = {(r.lang, r.rule): r.cutoff for r in quality.certify(quality.metrics(df, ["doc_id", "lang"]), lab).collect()}
    want = brute_cutoffs(rows, labels)
    assert want and got == pytest.approx(want)
    kept = {r.doc_id: r.kept for r in quality.quality(df, lab).collect()}
    for i, t, lang in rows:
        m = metrics(t)
        bad = m[0] < 50 or 100 * m[4] > 50 * m[0]
        v = {"symbols": m[2] / max(m[0], 1), "repeats": m[4] / max(m[0], 1), "dup_lines": m[3] / 1, "word_length": m[1] / max(m[0], 1)}
        assert kept[i] == (not bad and not any(x > want.get((lang, r), math.inf) for r, x in v.items()))


def test_windows_of_one_hash_are_compared(spark, monkeypatch):
    """With all windows under one hash only equal words count as a repeat."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: quality.F.lit(7).cast("bigint"))
    rows = [(i, t) for i, t in enumerate(ODD)]
    made = quality.metrics(spark.createDataFrame(rows, "doc_id bigint, text string"))
    for r in made.collect():
        assert r.q_n_repeat_words == metrics(rows[r.doc_id][1])[4]


def test_quality_filter_takes_any_columns(spark):
    df = spark.createDataFrame([(1, "a " * 20, 3, "x", 5), (2, " ".join(f"w{i}" for i in range(60)), 4, "y", None)], "doc_id bigint, text string, q_kept int, q_row string, q_n_words int")
    got = quality.quality_filter(df, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert got.columns == df.columns and [tuple(r)[2:] for r in got.collect()] == [(4, "y", None)]


def plain_spans(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_patterns():
    rng = random.Random(0)
    for letters in ["ab.@-_%1 ", "0123.+ -()", "0.1", "a@.b", "0 -+1"]:
        for _ in range(3000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == plain_spans(t), t
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 100_000, "+1" * 100_000):
        pii.base_spans(t)  # in linear time


def test_personal_data(spark):
    rows = [(1, "mail a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111 and +1 (743) 555-3824", 5), (2, None, 1), (3, "", 1), (None, "x@y.zz", 2), (4, "nothing", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t, _ in rows:
        base = plain_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(got[i].spans.split(","))
    clean = {r.doc_id: r for r in pii.mask(df).collect()}
    assert clean[1].text == "mail [EMAIL] or [IP], card [CARD] and [PHONE]" and clean[1].n_chars == len(clean[1].text)
    assert clean[2].text is None and clean[4].text == "nothing"
    assert pii.find(df.where("false")).count() == 0 and pii.mask(df.where("false")).count() == 0


def test_field_enforces_consistency():
    model = pii.train([f"call +1 (743) 555-{i:04d} now and {i} more" for i in range(1000, 1200)])
    t = "call +1 (743) 555-3824 now. Later 743-555-3824 again."
    base, both = pii.all_spans(t, model, 0.5)
    assert set(base) <= set(both) and all(a < b for _, a, b in both)
    c = pii.Chain(t, base)
    assert len(c.skip) == 1  # the numbers with the same last digits
    apart = pii.Chain(t.replace("743-555-3824", "743-555-9999"), base)
    linked, alone = model.beliefs(c)[-1][4], model.beliefs(apart)[-1][4]
    assert linked > alone


def small_chain(n, near, skips, label=None):
    c = pii.Chain("", [])
    rng = np.random.default_rng(n)
    c.words = [(3 * i, 3 * i + 2, "x1") for i in range(n)]
    c.feats = rng.integers(0, 50, (n, 4))
    c.label = np.zeros(n, np.int64) if label is None else np.array(label)
    c.next, c.skip = np.array(near, np.int64), np.array(skips, np.int64).reshape(-1, 2)
    return c


@pytest.mark.parametrize(
    "n, near, skips, label, close",
    [(1, [], [], None, 1e-9), (4, [0, 1, 2], [], None, 1e-3), (5, [0, 1], [(2, 4), (0, 3)], [0, 2, 0, 0, 0], 1e-3), (4, [0, 1, 2], [(0, 2), (1, 3)], None, 0.08)],
)
def test_beliefs_against_enumeration(n, near, skips, label, close):
    """Exact on trees, near on loops."""
    import itertools

    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    skip = rng.normal(0, 0.5, (k, k))
    m = pii.Model(rng.normal(0, 0.5, (pii.N_FEATURES, k)), rng.normal(0, 0.5, (k, k)), skip + skip.T)
    c = small_chain(n, near, skips, label)
    u = m.unary[c.feats].sum(1)
    total = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        if any(c.label[i] and y[i] != c.label[i] for i in range(n)):
            continue
        e = sum(u[i, y[i]] for i in range(n)) + sum(m.step[y[i], y[i + 1]] for i in near) + sum(m.skip[y[i], y[j]] for i, j in skips)
        for i in range(n):
            total[i, y[i]] += math.exp(e)
    want = total / total.sum(1, keepdims=True)
    assert np.abs(m.beliefs(c, rounds=60) - want).max() <= close


def test_added_spans_stay(spark):
    """A phone without its plus, seen with it before; a number like it in no document stays."""
    rows = [(i, f"call +1 (743) 555-{i:04d} now, or 743-555-{i:04d}; {i} of {i * 7} sold") for i in range(1000, 1400)] + [(1, "ring +1 (212) 555-0199 or 212-555-0199, page 212-555-0147 of 9")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert got[1].split(",")[0] == "phone:5:22" and got == {r.doc_id: r.spans for r in pii.find(df.repartition(3)).collect()}
    for spans in got.values():
        each = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in spans.split(",")]
        assert each == sorted(each, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_field_links_short_repeats():
    rng = random.Random(8)
    texts = []
    for i in range(400):
        while not pii.luhn(d := "".join(rng.choice("0123456789") for _ in range(16))):
            pass
        texts.append(f"card {d[:4]} {d[4:8]} {d[8:12]} {d[12:]} ok, {i} seen, host 10.{i % 200}.3.4 and part {i} 2000 {i % 7} sold")
    model = pii.train(texts)
    t = "card 4111 1111 1111 1111 ok. Later 4111 1111 1111 1111 2 again"
    base, both = pii.all_spans(t, model, 0.9)  # the second card is followed by a digit, so no pattern has it
    assert [s[0] for s in base] == ["card"]
    assert any(k == "card" and a == t.rindex("4111") for k, a, _ in both)
    c = pii.Chain("from 1.2.3.4 to (1.2.3.4), +44 20 7946 0958 or +44 20 7946 0958", [])
    assert {(c.words[i][2].strip("(),"), c.words[j][2].strip("(),")) for i, j in c.skip} == {(w, w) for w in ("1.2.3.4", "+44", "20", "7946", "0958")}
    assert len(pii.Chain("5 mm or 5 cm", []).skip) == 1 and len(pii.Chain("1111 1111", []).skip) == 0


def test_packing(docs, spark):
    rows = docs.select("doc_id", "text", "source").collect()
    got = packing.pack(docs, capacity=100, per_source=2, shard_items=50).collect()
    tokens, at = collections.Counter(), collections.defaultdict(list)
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        at[r.bin_id].append(r)
        assert 0 < r.n_tokens <= 100
    by = {r.doc_id: r for r in rows}
    assert tokens == {i: len(words(r.text)) + 1 for i, r in by.items()}
    for items in at.values():
        items.sort(key=lambda r: r.position)
        place = 0
        for r in items:
            assert r.position == place
            place += r.n_tokens
        assert place <= 100
        if len(items) > 1:
            sources = collections.Counter(r.source for r in items if r.source)
            assert max(sources.values(), default=0) <= 2
            texts = [(by[r.doc_id].text or "").lower() for r in items]
            assert len(set(texts)) == len(texts)
    assert packing.pack(docs.where("false")).count() == 0


def test_packing_keeps_near_copies_apart(docs, spark):
    rows = [(r.doc_id, r.text, "s") for r in docs.select("doc_id", "text").collect()]
    long = [f"w{i}" for i in range(60)]
    spaced, edited = "  ".join(long), " ".join([*long[:-1], "other"])
    rows += [(9000, " ".join(long), "s"), (9001, spaced, "s"), (9002, edited, "s"), (None, spaced + " ", "s"), (9003, "É", "s"), (9004, "é", "s")]
    text = {i: t for i, t, _ in rows}
    _, root = brute_components(list(text.values()))
    cluster = dict(zip(text, root, strict=True))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = packing.pack(df, capacity=100_000, per_source=1000).collect()
    assert len(got) == len(rows)
    at = collections.defaultdict(list)
    for r in got:
        at[r.bin_id].append(r.doc_id)
    assert max(map(len, at.values())) > 1
    for ids in at.values():
        assert len({cluster[i] for i in ids}) == len(ids)
        assert len({(text[i] or "").lower() for i in ids}) == len(ids)


def test_packing_spreads_repeated_rows(spark):
    df = spark.range(20_000).selectExpr("7L as doc_id", "'one two three' as text", "'s' as source").union(spark.range(100).selectExpr("id", "string(id)", "'t'"))
    got = packing.pack(df, cluster=df.doc_id)
    shards = {r.s: r.n for r in got.where("doc_id = 7 and n_tokens = 4").groupBy(F.shiftright("bin_id", 32).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert sum(shards.values()) == 20_000 and len(shards) == 10 and max(shards.values()) < 2300
    assert got.groupBy("bin_id", "doc_id").count().where("count > 1").count() == 0
    assert packing.pack(df.drop("source"), cluster=df.doc_id).count() == 20_100  # no sources, no conflicts by them


def test_packing_fills_bins(spark):
    """Without conflicts nearly all of the bins' room is used."""
    rng = random.Random(6)
    df = spark.createDataFrame([(i, "w " * rng.randint(10, 900), f"s{i}") for i in range(3000)], "doc_id bigint, text string, source string")
    got = packing.pack(df, capacity=1000, cluster=df.doc_id)
    r = got.agg(F.sum("n_tokens"), F.count_distinct("bin_id")).first()
    assert r[0] / (1000 * r[1]) > 0.97


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(1)
    items = [(rng.randint(1, 60), rng.choice("abc") if rng.random() < 0.9 else None, rng.randint(0, 30)) for _ in range(400)]
    got = packing.pack_items(items, 100, 2)
    bins: list[dict] = []
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, source, cluster = items[i]
        fit = [b for b in range(len(bins)) if bins[b]["left"] >= size and cluster not in bins[b]["c"] and (source is None or bins[b]["s"][source] < 2)]
        b = min(fit, key=lambda b: (bins[b]["left"], b), default=len(bins))
        if b == len(bins):
            bins.append({"left": 100, "c": set(), "s": collections.Counter()})
        assert got[i] == (b, 100 - bins[b]["left"])
        bins[b]["left"] -= size
        bins[b]["c"].add(cluster)
        bins[b]["s"][source] += source is not None


def test_language_model(docs, spark):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in lm.score(df, block_tokens=500).collect()}
    whole = {r.doc_id: r for r in lm.score(df).collect()}
    tokens = {i: [w.translate(LOWER) for w in words(t)] + [None] for i, t in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score == pytest.approx(whole[i].score, abs=1e-6) and r.score < 0
    assert lm.score(df.where("false")).count() == 0


def test_scores_equal_plain_counting(spark):
    """Deleted interpolation by plain dictionaries: weights by expectation-maximisation over every training occurrence, left out of its own counts."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(60)]
    rows = []
    for i in range(250):
        w, t = rng.choice(vocab), []
        for _ in range(rng.randint(0, 40)):
            w = vocab[(vocab.index(w) * 7 + rng.choice([1, 2, 2, 3])) % 60] if rng.random() < 0.8 else rng.choice(vocab)
            t.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(t)))
    tokens = {i: [*[w.translate(LOWER) for w in words(t)], "</s>"] for i, t in rows}
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in tokens}
    one, two = collections.Counter(), collections.Counter()
    for i, ws in tokens.items():
        if train[i]:
            one.update(ws)
            two.update(zip(["</s>", *ws], ws))
    n, types = sum(one.values()), len(one)
    bucket = lambda c: min(c.bit_length(), lm.BUCKETS - 1)
    events = collections.defaultdict(list)
    for (u, v), c in two.items():
        q = ((c - 1) / (one[u] - 1) if one[u] > 1 else 0.0, (one[v] - 1) / (n - 1), 1 / (types + 1))
        events[bucket(one[u])].append((c, q))
    weight = {}
    for b, ev in events.items():
        w, total = np.array([0.5, 0.4, 0.1]), sum(c for c, _ in ev)
        for _ in range(200):
            new = np.zeros(3)
            for c, q in ev:
                p = w * q
                new += c * p / p.sum()
            w = new / total
        weight[b] = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
    weight[0] = weight.get(1, np.array([0.0, 0.9, 0.1]))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), block_tokens=400).collect()}
    for i, ws in tokens.items():
        want = 0.0
        for u, v in zip(["</s>", *ws], ws):
            w = weight.get(bucket(one[u]), np.array([0.0, 0.9, 0.1]))
            want += math.log10(w[0] * two[u, v] / max(one[u], 1) + w[1] * one[v] / n + w[2] / (types + 1))
        assert got[i].score == pytest.approx(want, rel=0.005), i


def test_scores_of_a_table_with_clashing_columns(spark):
    rows = [(i, "a b c", "x", 1, 2, 3) for i in range(20)]
    got = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string, uri string, n int, p int, kind int"))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and got.count() == 20


def test_interpolation_is_a_distribution_and_learns(spark):
    rng = random.Random(2)
    chain = {w: [rng.choice("abcdefghijklmnop") for _ in range(2)] for w in "abcdefghijklmnop"}
    rows = []
    for i in range(300):
        w, t = "a", []
        for _ in range(50):
            w = rng.choice(chain[w])
            t.append(w)
        rows.append((i, " ".join(t)))
    got = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").toPandas()
    assert got["score"].sum() > 0.5 * got["base_score"].sum()  # bigrams tell twice as much here


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    scratch = common.Scratch(spark, "test")
    one = {r.id: r.root for r in common.components(df, scratch).collect()}
    many = {r.id: r.root for r in common.components(df, scratch, one_task=0).collect()}
    assert {k: many[k] for k in many} == {k: one[k] for k in many}
    assert all(one[i] == 400 for i in range(400, 461))


def test_pipeline(spark, sf):
    p = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality rules", "MinHash near-dedup", "PII", "best-fit packing"]
    text = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = sorted(r.doc_id for r in quality.quality(docs, labels).where("kept").collect())
    _, root = brute_components([text[i] for i in kept])
    left = {kept[k] for k, r in enumerate(root) if r == k}
    got = p.run(spark, sf).collect()
    assert {r.doc_id for r in got} == left
    size = collections.Counter()
    for r in got:
        size[r.doc_id] += r.n_tokens
    for i in left:
        if not pii.ACTIVE.search(text[i]):
            assert size[i] == len(words(text[i])) + 1


@pytest.mark.parametrize("rows", [0, 4])
def test_pipeline_edges(spark, tmp_path, rows):
    """Null and empty texts fail the base rules; repeated rows count as copies; columns of any name pass; an empty table gives an empty result."""
    p = importlib.import_module("corpus_pipeline")
    good = " ".join(f"word{i}" for i in range(80))
    made = [(1, good, "en", "s", 9, 1, "a", 2), (1, good, "en", "s", 9, 1, "a", 2), (2, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 1, "b", 3), (None, good + " more", None, None, None, 7, None, 1)][: rows and 5]
    df = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint, q_kept int, gone_id string, own_id int")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == (["1", "1", "None"] if rows else [])
