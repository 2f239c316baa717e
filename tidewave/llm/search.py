"""Ranked lexical search over a tiered index.

The index holds, for blocks of documents, a file for each tier: posting lists by term, of impacts of at least ``TIERS[0]`` in the first, of at least
``TIERS[1]`` in the second and of all others in the last; a term held by few documents is in the first tier whole. Every term has a residual bound
for each tier: its greatest impact below. An item is scored on the first tiers alone: what a document may still gain is the sum of the residual bounds
of those terms of the item under which it was not met. If no document that was not met can reach the tenth score, the item is proven: only
documents that can reach that score are then scored in full. An item without that proof falls through to the next tier; the last has no residual.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch
from .files import create, opened_at

#: Least impacts of the tiers but the last; the greatest possible impact is a million.
TIERS = (650_000, 400_000)
#: A term in at most so many documents has all its postings in the first tier.
RARE = 1_000
#: A block of the index is closed at so many postings or documents.
BLOCK_POSTINGS, BLOCK_DOCS = 4_000_000, 32_768
#: Items are taken in blocks of about so many terms, which bounds what the driver holds and sends to the tasks.
ITEM_TERMS = 200_000
#: Tasks of a pass over the index at most.
MOST_TASKS = 20_000
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: runs of letters, digits and all code points from 128, A-Z lowered."""
    return TERM.findall((text or "").encode().lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def measure(n: int, n_docs: int, total: int) -> int:
    """m of a document of n terms."""
    return 25 + (75 * n * n_docs) // total


def _write(uri: str, table: pa.Table) -> None:
    with create(uri) as f:
        pq.write_table(table, f, compression="zstd")


def _read(uri: str) -> pa.Table:
    with opened_at(uri) as f:
        return pq.read_table(f)


class Postings:
    """Posting lists sorted by term: of term ``terms[i]`` the places and impacts from ``starts[i]`` to ``starts[i + 1]``."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, places: np.ndarray, impact: np.ndarray):
        self.terms, self.starts, self.places, self.impact = terms, starts, places, impact

    @classmethod
    def read(cls, uri: str, wanted: np.ndarray) -> Postings:
        """Of the wanted terms (sorted)."""
        t = _read(uri)
        terms = t.column("term").to_numpy()
        t = t.filter(pa.array(np.isin(terms, wanted)))
        lists = [t.column(c).combine_chunks() for c in ("place", "impact")]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        lengths = lists[0].value_lengths().to_numpy(zero_copy_only=False) if len(lists[0]) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return cls(t.column("term").to_numpy(), starts, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy().astype(np.int64))

    @staticmethod
    def write(uri: str, term: np.ndarray, place: np.ndarray, impact: np.ndarray) -> None:
        """Of postings sorted by term."""
        terms, first = np.unique(term, return_index=True)
        offsets = pa.array(np.append(first, len(term)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (place, impact)]
        _write(uri, pa.table({"term": pa.array(terms.astype(np.int32)), "place": lists[0], "impact": lists[1]}))


class Item:
    """An item as the tasks have it: its terms' numbers, and weights times repeats."""

    def __init__(self, key: int, terms: np.ndarray, weights: np.ndarray):
        self.key, self.terms, self.weights = key, terms, weights


def _forward(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """Rows (doc_id, n, ids, tfs): a document's number of terms, and of the terms in ``words`` their numbers and occurrences. Documents without terms have no row."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]):
        known = sent.value
        for b in batches:
            ids, n, terms, tfs = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                of = Counter(found)
                here = [(known[t], c) for t, c in of.items() if t in known]
                ids.append(i)
                n.append(len(found))
                terms.append(np.array([x for x, _ in here], np.int32))
                tfs.append(np.array([c for _, c in here], np.int32))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, lists), pa.array(tfs, lists)], names=["doc_id", "n", "ids", "tfs"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, ids array<int>, tfs array<int>")


def _by_term(df: DataFrame, column: str, n_terms: int) -> np.ndarray:
    """How many rows of ``df`` hold each term; a row for each term and task is summed."""

    def run(batches):
        held = np.zeros(n_terms, np.int64)
        for b in batches:
            held += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "c"])

    out = np.zeros(n_terms, np.int64)
    for r in df.select(column).mapInArrow(run, "term bigint, c bigint").groupBy("term").agg(F.sum("c").alias("c")).collect():  # at most n_terms rows
        out[r.term] = r.c
    return out


def build(forward: DataFrame, folder: str, df: np.ndarray, n_docs: int, total: int, rare: int) -> DataFrame:
    """Write the index of ``forward`` under ``folder``; a row (block) for each block. Its files: the tiers, the documents' ids, and for each tier but the
    last the terms with their residual bounds, the greatest impacts in lower tiers of the block."""

    def close(held: list[tuple]):
        name = f"{folder}/{held[0][4]}"
        lengths = [len(x[2]) for x in held]
        place = np.repeat(np.arange(len(held), dtype=np.int64), lengths)
        m = np.repeat(np.array([measure(x[1], n_docs, total) for x in held], np.int64), lengths)
        term, tf = (np.concatenate([x[j] for x in held]) for j in (2, 3))
        order = np.argsort(term, kind="stable")
        term, place = term[order], place[order]
        impact = impacts(tf[order].astype(np.int64), m[order])
        tier = np.searchsorted(-np.array(TIERS), -impact, side="left")
        tier[df[term] <= rare] = 0
        for k in range(len(TIERS) + 1):
            own, below = tier == k, tier > k
            Postings.write(f"{name}.{k}", term[own], place[own], impact[own])
            if k < len(TIERS):
                t, first = np.unique(term[below], return_index=True)
                rest = np.maximum.reduceat(impact[below], first) if len(t) else t
                _write(f"{name}.rest{k}", pa.table({"term": pa.array(t, pa.int64()), "rest": pa.array(rest, pa.int64())}))
        _write(f"{name}.docs", pa.table({"doc_id": pa.array([x[0] for x in held], pa.int64())}))
        return pa.RecordBatch.from_arrays([pa.array([name])], names=["block"])

    def run(batches):
        held, postings = [], 0
        for b in batches:
            for i, n, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                held.append((i, n, t.values.to_numpy(), c.values.to_numpy(), uuid.uuid4().hex if not held else ""))
                postings += len(held[-1][2])
                if postings >= BLOCK_POSTINGS or len(held) >= BLOCK_DOCS:
                    yield close(held)
                    held, postings = [], 0
        if held:
            yield close(held)

    return forward.mapInArrow(run, "block string")


class Best:
    """The documents of the highest scores of each item so far, equal scores by ascending id; a null id is the least."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, item: int, ids: list, scores: np.ndarray) -> None:
        rows = self.rows.setdefault(item, [])
        rows += [(-int(s), i is not None, i or 0) for i, s in zip(ids, scores, strict=True)]
        rows.sort()
        del rows[self.k :]

    def least(self, item: int) -> int:
        """A score that a document must reach to be among them."""
        rows = self.rows.get(item, ())
        return -rows[-1][0] if len(rows) == self.k else 1


def _scored(index: DataFrame, items: list[Item], upto: int, best: int, floors: dict[int, int] | None) -> DataFrame:
    """Rows (item, doc_id, score, bound) of the ``best`` highest scores of a task's blocks.

    Without ``floors``, on the tiers up to ``upto``; a row without a score has in ``bound`` the most that a document that was not met may score. With
    them, in full, for documents that by the tiers up to ``upto`` may reach the item's floor.
    """
    last = len(TIERS)
    sent = index.sparkSession.sparkContext.broadcast((items, floors))

    def add(into: np.ndarray, lists: Postings, item: Item, rest: np.ndarray | None) -> None:
        """Weight times impact of each posting, or where ``rest`` is given times what it exceeds the residual bound by."""
        at = np.searchsorted(lists.terms, item.terms)
        for j, (p, t) in enumerate(zip(at.tolist(), item.terms.tolist(), strict=True)):
            if p < len(lists.terms) and lists.terms[p] == t and item.weights[j]:
                lo, hi = lists.starts[p], lists.starts[p + 1]
                gain = lists.impact[lo:hi] if rest is None else lists.impact[lo:hi] - rest[j]
                into[lists.places[lo:hi]] += item.weights[j] * gain  # a document is once in a list

    def run(batches):
        every, floors = sent.value
        wanted = np.unique(np.concatenate([x.terms for x in every])) if every else np.zeros(0, np.int64)
        top, bounds = Best(best), {}
        for b in batches:
            for name in b.column(0).to_pylist():
                ids = _read(f"{name}.docs").column(0).to_pylist()
                tiers = [Postings.read(f"{name}.{k}", wanted) for k in range(upto + 1)]
                lower: list[Postings] | None = None
                if upto < last:
                    terms, least = (x.to_numpy() for x in _read(f"{name}.rest{upto}").columns)
                for item in every:
                    rest = np.zeros(len(item.terms), np.int64)
                    if upto < last and len(terms):
                        at = np.minimum(np.searchsorted(terms, item.terms), len(terms) - 1)
                        rest = np.where(terms[at] == item.terms, least[at], 0).astype(np.int64)
                    unmet = int((item.weights * rest).sum())
                    score = np.zeros(len(ids), np.int64)
                    if floors is None:
                        for lists in tiers:
                            add(score, lists, item, None)
                        bounds[item.key] = max(bounds.get(item.key, 0), unmet)
                    else:
                        floor = max(floors[item.key], top.least(item.key))
                        might = np.full(len(ids), unmet)
                        for lists in tiers:
                            add(might, lists, item, rest)
                        if not (might >= floor).any():
                            continue
                        if lower is None:
                            lower = [Postings.read(f"{name}.{k}", wanted) for k in range(upto + 1, last + 1)]
                        for lists in (*tiers, *lower):
                            add(score, lists, item, None)
                    hit = np.flatnonzero(score >= top.least(item.key))
                    if len(hit) > 4 * best:  # all that tie with the last stay
                        hit = hit[score[hit] >= np.partition(score[hit], -best)[-best]]
                    top.add(item.key, [ids[i] for i in hit], score[hit])
        out = [(k, i if some else None, -s, None) for k, rows in top.rows.items() for s, some, i in rows] + [(k, None, None, v) for k, v in bounds.items()]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score", "bound"])

    return index.mapInArrow(run, "item bigint, doc_id bigint, score bigint, bound bigint")


def _ranked(rows: DataFrame, best: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = 10, rare: int = RARE, item_terms: int = ITEM_TERMS) -> DataFrame:
    """Of each item (item_id, text) the ``best`` highest-scoring documents (doc_id, text): item_id, rank, doc_id, score, tier.

    ``tier`` is the one at which the item was proven or had no residual. Null and empty texts have no terms: such documents count nowhere and such items
    have no rows. Rows that repeat a document are documents of their own, and among equal scores a null id comes first; repeated items are taken once, an item_id
    with several texts once for each. An empty table of either gives an empty result. Other columns are not read.

    Items are taken in blocks of about ``item_terms`` terms; of a block, the terms and the results in the making are with the driver. Postings are of terms that an
    item of the block holds. A task holds one block of the index and ``best`` documents for each item.
    """
    spark = docs.sparkSession
    steps, result = Scratch(spark, "search-steps"), Scratch(spark, "search")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = steps.save(items)
    length = F.length("text").cast("double")
    blocks = max(1, math.ceil((items.agg(F.sum(length)).first()[0] or 0) / 2 / item_terms))
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # of bounded text: ``blocks`` follows the length of all
        part = _search_block(docs, rows, steps, best, rare)
        if part is not None:
            part = result.save(part)
            found = part if found is None else found.unionByName(part)
    steps.clear()
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint, tier int") if found is None else found


def _search_block(docs: DataFrame, rows: list, steps: Scratch, best: int, rare: int) -> DataFrame | None:
    spark = docs.sparkSession
    counts = [Counter(terms_of(r.text)) for r in rows]
    words = {t: i for i, t in enumerate(sorted(set().union(*counts)))} if counts else {}
    if not words:
        return None
    forward = steps.save(_forward(docs, words))
    n_docs, total = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = _by_term(forward, "ids", len(words))
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    index = steps.save(build(forward, steps.folder + "/index", df, n_docs, total, rare))
    index = index.repartition(min(max(1, index.count()), MOST_TASKS))
    items = []
    for key, c in enumerate(counts):
        ids = np.array(sorted(words[t] for t in c), np.int64)
        repeats = {words[t]: x for t, x in c.items()}
        items.append(Item(key, ids, weights[ids] * np.array([repeats[i] for i in ids.tolist()], np.int64)))
    open_, proven, out = [x for x in items if len(x.terms)], [], []
    for tier in range(len(TIERS) + 1):
        if not open_:
            break
        scored = steps.save(_scored(index, open_, tier, best, None))
        ranked = _ranked(scored, best)
        if tier == len(TIERS):
            out.append(ranked.withColumn("tier", F.lit(tier)))
            break
        floors = {r.item: r.floor for r in ranked.groupBy("item").agg(F.when(F.count(F.lit(1)) == best, F.min("score")).otherwise(0).alias("floor")).collect()}
        bounds = {r.item: r.bound for r in scored.groupBy("item").agg(F.max("bound").alias("bound")).collect()}
        proof = {x.key for x in open_ if bounds.get(x.key, 0) < max(1, floors.get(x.key, 0))}
        proven.append(([x for x in open_ if x.key in proof], tier, {k: max(1, floors.get(k, 0)) for k in proof}))
        open_ = [x for x in open_ if x.key not in proof]
    for some, tier, floors in proven:
        if some:
            out.append(_ranked(_scored(index, some, tier, best, floors), best).withColumn("tier", F.lit(tier)))
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item bigint, item_id bigint")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "tier")
