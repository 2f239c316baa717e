"""Personal data: exact patterns, and a skip-chain conditional random field that adds spans to theirs.

Nodes are the words with a digit or an at sign (no other word can hold these kinds). Neighbouring
words share a transition potential; repeated or similar words anywhere in the document share a skip
potential, so that a form that a pattern accepts once carries its label to the forms that it misses.
Words that a pattern covers are clamped to its kind. Beliefs come from loopy message passing.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
N_FEATURES = 1 << 12

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ACTIVE = re.compile(r"[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
NOT_DIGIT = re.compile(r"[^0-9]")
GROUP = re.compile(r"[^\w@]*[0-9]+[^\w@]*")


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign to the left as far as the local part goes, then the domain to the right; linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and text[left - 1] in LOCAL:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def small(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def shape(word: str) -> str:
    """Letters as a, digits as 9, the rest as it is, cut in the middle if long."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", word))
    s = re.sub(r"a+", "a", s)
    return s if len(s) <= 24 else s[:12] + "~" + s[-12:]


def similar_key(word: str) -> str | None:
    """Words with the same key are similar: the same last seven digits (or all of five or six), or else the same letters and digits."""
    digits = NOT_DIGIT.sub("", word)
    if len(digits) >= 5:
        return "d" + digits[-7:]
    plain = re.sub(r"[^a-z0-9]", "", word.lower())
    return "w" + plain if "@" in word and len(plain) >= 5 else None


def skip_keys(words: list[str], near: np.ndarray) -> list[tuple[str, ...]]:
    """Keys of each node: its similar key, or else itself without outer punctuation; a short group of digits that adjoins
    other nodes is too common by itself and has one key with the node before and one with the node after."""
    plain = [w.lower().strip(".,;:!?()[]<>\"'") for w in words]
    out: list[tuple[str, ...]] = []
    for i, w in enumerate(words):
        k = similar_key(w)
        if k is not None:
            out.append((k,))
            continue
        before, after = i > 0 and bool(near[i - 1]), i + 1 < len(words) and bool(near[i])
        if (before or after) and GROUP.fullmatch(w):
            out.append((*([f"p{plain[i - 1]} {plain[i]}"] if before else []), *([f"n{plain[i]} {plain[i + 1]}"] if after else [])))
        else:
            out.append(("=" + plain[i],))
    return out


class Chain:
    """A document's nodes and edges."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]]):
        self.words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
        n = len(self.words)
        self.label = np.zeros(n, np.int64)
        starts = np.array([w[0] for w in self.words], np.int64)
        ends = np.array([w[1] for w in self.words], np.int64)
        for kind, a, b in reversed(spans):  # earlier kinds win
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            self.label[lo:hi] = LABELS.index(kind)
        shapes = [shape(w[2]) for w in self.words]
        self.feats = np.zeros((n, 4), np.int64)
        near = (starts[1:] - ends[:-1] <= 1) if n else np.zeros(0, bool)
        for i, s in enumerate(shapes):
            prev = shapes[i - 1] if i and near[i - 1] else "^"
            after = shapes[i + 1] if i + 1 < n and near[i] else "$"
            for j, f in enumerate((f"s{s}", f"p{prev}|{s}", f"n{after}|{s}", f"l{min(len(NOT_DIGIT.sub('', self.words[i][2])), 20)}")):
                self.feats[i, j] = zlib.crc32(f.encode()) % N_FEATURES
        self.next = np.flatnonzero(near)
        last: dict[str, int] = {}
        skip = {}
        for i, ks in enumerate(skip_keys([w[2] for w in self.words], near)):
            for k in ks:
                if k in last and not (last[k] == i - 1 and near[i - 1]):
                    skip[last[k], i] = None  # occurrences are linked in a line, so edges stay linear in words
                last[k] = i
        self.skip = np.array(list(skip), np.int64).reshape(-1, 2)


class Model:
    def __init__(self, unary: np.ndarray, step: np.ndarray, skip: np.ndarray):
        self.unary, self.step, self.skip = unary, step, skip

    def beliefs(self, c: Chain, rounds: int = 12, damp: float = 0.3) -> np.ndarray:
        """Loopy sum-product in logarithms over all edges at once; pattern words are clamped."""
        n, k = len(c.words), len(LABELS)
        u = self.unary[c.feats].sum(1)
        u = u - np.logaddexp.reduce(u, axis=1, keepdims=True)
        fixed = c.label > 0
        u[fixed] = -30.0
        u[fixed, c.label[fixed]] = 0.0
        pairs = np.concatenate([np.stack([c.next, c.next + 1], 1), c.skip])
        if not len(pairs):
            return np.exp(u)
        pot = np.concatenate([np.repeat(self.step[None], len(c.next), 0), np.repeat(self.skip[None], len(c.skip), 0)])
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        msg = np.zeros((len(src), k))
        for _ in range(rounds):
            total = u.copy()
            np.add.at(total, dst, msg)
            out = total[src] - msg[back]
            new = np.logaddexp.reduce(out[:, :, None] + pot, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            if np.abs(new - msg).max() < 1e-4:
                msg = new
                break
            msg = damp * msg + (1 - damp) * new
        total = u.copy()
        np.add.at(total, dst, msg)
        return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))

    def added(self, text: str, base: list[tuple[str, int, int]], least: float) -> list[tuple[str, int, int]]:
        """Spans of free words whose belief in a kind is at least ``least``; they overlap no base span."""
        c = Chain(text, base)
        if not len(c.words) or not (c.label == 0).any():
            return []
        b = self.beliefs(c)
        pick = np.where((c.label == 0) & (b[:, 1:].max(1) >= least), b[:, 1:].argmax(1) + 1, 0)
        out, i, near = [], 0, set(c.next.tolist())
        while i < len(pick):
            if pick[i]:
                j = i
                while j + 1 < len(pick) and pick[j + 1] == pick[i] and j in near:
                    j += 1
                a, z = c.words[i][0], c.words[j][1]
                while a < z and not (text[a].isalnum() or text[a] in "+("):
                    a += 1
                while z > a and not text[z - 1].isalnum():
                    z -= 1
                if a < z:
                    out.append((LABELS[pick[i]], a, z))
                i = j
            i += 1
        return out


def train(texts: list[str | None], epochs: int = 60) -> Model:
    """Pseudo-likelihood training on documents labelled by the patterns: each word's label given its features and the labels of all its
    neighbours, along the chain and by skips, so that what an edge tells is not told again by the word's own weights."""
    k = len(LABELS)
    chains = [Chain(t, base_spans(t)) for t in texts if t and ACTIVE.search(t)]
    unary, step, skip = np.zeros((N_FEATURES, k)), np.zeros((k, k)), 2.0 * np.eye(k)
    start = np.cumsum([0, *(len(c.words) for c in chains)])
    if not start[-1]:
        return Model(unary, step, skip)
    x, y = np.concatenate([c.feats for c in chains]), np.concatenate([c.label for c in chains])
    left = np.concatenate([c.next + o for c, o in zip(chains, start)]).astype(np.int64)
    right = left + 1
    one, two = np.concatenate([c.skip + o for c, o in zip(chains, start)]).astype(np.int64).T
    prior = skip.copy()
    seen = [np.full_like(m, 1e-6) for m in (unary, step, skip)]
    for _ in range(epochs):
        z = unary[x].sum(1)
        np.add.at(z, right, step[y[left]])
        np.add.at(z, left, step[:, y[right]].T)
        np.add.at(z, one, skip[y[two]])
        np.add.at(z, two, skip[y[one]])
        p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        p[np.arange(len(y)), y] -= 1
        grads = [np.zeros_like(m) for m in (unary, step, skip)]
        for j in range(x.shape[1]):
            np.add.at(grads[0], x[:, j], p)
        np.add.at(grads[1], y[left], p[right])
        np.add.at(grads[1].T, y[right], p[left])
        np.add.at(grads[2], y[two], p[one])
        np.add.at(grads[2], y[one], p[two])
        grads[2] = (grads[2] + grads[2].T) / 2
        for m, g, s, toward, pull in zip((unary, step, skip), grads, seen, (0.0, 0.0, prior), (1e-6, 1e-5, 1e-5), strict=True):
            g = g / len(y) + pull * (m - toward)
            s += g * g
            m -= 0.5 * g / np.sqrt(s)
    return Model(unary, np.clip(step, -4, 4), np.clip(skip, -4, 4))


#: Longer texts are not taken into the sample, so that its bytes are bounded; they are searched like others.
SAMPLE_CHARS = 100_000


def fit(docs: DataFrame, sample_docs: int = 1000) -> Model:
    """Trained on about ``sample_docs`` (twice as many at most) of the documents with a digit or an at sign,
    chosen and ordered by hashes of their id and text, so that equal tables give equal weights: a bounded sample that decides weights only; patterns and inference cover all rows."""
    active = docs.where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, sample_docs / max(active.count(), 1))
    chosen = F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = active.where(chosen & (F.length("text") <= SAMPLE_CHARS)).select("text").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "text").limit(2 * sample_docs).collect()
    return train([r.text for r in rows])


def all_spans(text: str, model: Model, least: float) -> tuple[list, list]:
    """Base spans, and these with those added, in order of kind and start."""
    if not ACTIVE.search(text):
        return [], []
    base = base_spans(text)
    more = model.added(text, base, least)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted([*base, *more], key=lambda s: (order[s[0]], s[1], s[2]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list) -> str:
    """Each run of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_batch(batch: pa.RecordBatch, model: Model, least: float) -> pa.RecordBatch:
    rows = [all_spans(t or "", model, least) for t in batch.column(1).to_pylist()]
    counts = [[sum(s[0] == k for s in base) for base, _ in rows] for k in KINDS]
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            *[pa.array(c, pa.int64()) for c in counts],
            pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string()),
            pa.array([joined(spans) for _, spans in rows], pa.string()),
        ],
        names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
    )


def find(docs: DataFrame, sample_docs: int = 1000, least: float = 0.9) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans (all).

    Null texts are empty (no spans); null and repeated ids keep their rows; texts of any length are
    scanned whole in linear time; an empty table gives an empty result; other columns are not read.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_docs))  # a fixed number of weights

    def run(batches):
        for b in batches:
            yield find_batch(b, shared.value, least)

    return docs.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def mask(docs: DataFrame, sample_docs: int = 1000, least: float = 0.9) -> DataFrame:
    """``docs`` with every span replaced in ``text`` (null stays null); other columns as they are, n_chars, if there, renewed."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_docs))
    at = docs.columns.index("text")

    def clean(t: str | None) -> str | None:
        if not t or not ACTIVE.search(t):
            return t
        return redact(t, all_spans(t, shared.value, least)[1])

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([clean(t) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
