"""Token counts of a word-level BPE vocabulary by heap-and-linked-list merging."""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries of a worker's two caches; beyond, the cache restarts, which changes no result.
CACHE_ENTRIES = 600_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file (fixed values of the format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordSplitter:
    """Splits runs without ASCII white space, which no token crosses, as the vocabulary's normalizer and pre-tokenizer do."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = spec = json.load(f)
        self._known(spec)
        self.letters = _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")

    @staticmethod
    def _known(spec: dict) -> None:
        """Refuse a file whose steps are not those that are done here."""
        steps = [n if n["type"] != "Replace" else (n["type"], n["pattern"], n["content"]) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = spec["model"]
        ok = (
            steps == [{"type": "NFC"}, ("Replace", {"Regex": r"\s+"}, " "), {"type": "Lowercase"}]
            and [c["type"] for c in cut] == ["Split", "ByteLevel"]
            and cut[0]["behavior"] == "Removed" and cut[0]["invert"] and "Regex" in cut[0]["pattern"]
            and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and not spec.get("truncation") and not spec.get("padding")
        )
        if not ok:
            raise ValueError("a tokenizer file with other normalizer, pre-tokenizer or model settings than are implemented")

    def split(self, chunk: bytes) -> list[str]:
        """Lower-case pieces; a special string stands as itself, in which form no piece can be."""
        text = chunk.decode()
        if "<|" in text:
            return [p for i, part in enumerate(self.special_split.split(text)) for p in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
            if text.isalpha():
                return [text]
        else:  # lower-cased letter by letter, without regard to neighbours
            text = "".join(map(str.lower, self.space.sub(" ", unicodedata.normalize("NFC", text))))
        return self.pieces.findall(text)


class HeapCounter(WordSplitter):
    """Counts tokens of texts; emits no ids."""

    def __init__(self, path: str):
        super().__init__(path)
        spec = self.spec
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): (i, "".join(m if isinstance(m, list) else m.split(" "))) for i, m in enumerate(spec["model"]["merges"])}
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.by_chunk: dict[bytes, int] = {}
        self.by_piece: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Initial symbols minus merges: pop the lowest-rank adjacent pair until none is left."""
        letters = self.letters
        sym = [letters[b] for b in piece.encode()]
        n = len(sym)
        sym[-1] += self.suffix
        rank = self.rank
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get((sym[i], sym[i + 1]))
            if r is not None:
                heap.append((r[0], i, r[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i, whole = heapq.heappop(heap)
            j = after[i]
            # stale entries: the left symbol is gone or the pair has changed
            if sym[i] is None or j >= n:
                continue
            now = rank.get((sym[i], sym[j]))
            if now is None or now[0] != r:
                continue
            merges += 1
            sym[i] = whole
            sym[j] = None
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                new = rank.get((whole, sym[k]))
                if new is not None:
                    heapq.heappush(heap, (new[0], i, new[1]))
            h = before[i]
            if h >= 0:
                new = rank.get((sym[h], whole))
                if new is not None:
                    heapq.heappush(heap, (new[0], h, new[1]))
        return n - merges

    def chunk(self, chunk: bytes) -> int:
        total = 0
        for p in self.split(chunk):
            got = self.by_piece.get(p)
            if got is None:
                if p in self.special:
                    total += 1
                    continue
                if len(self.by_piece) >= CACHE_ENTRIES:
                    self.by_piece.clear()
                got = self.by_piece[p] = self.piece(p)
            total += got
        return total

    def count(self, data: bytes) -> int:
        by_chunk = self.by_chunk
        total = 0
        words = data.split()
        get = by_chunk.get
        counts = [get(w) for w in words]
        if None not in counts:
            return sum(counts)
        for w, c in zip(words, counts, strict=True):
            if c is None:
                c = get(w)
                if c is None:
                    if len(by_chunk) >= CACHE_ENTRIES:
                        by_chunk.clear()
                    c = self.chunk(w)
                    if len(w) <= 64:
                        by_chunk[w] = c
            total += c
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> HeapCounter:
    return HeapCounter(path)


def count_batch(batch: pa.RecordBatch, path: str, limit: int) -> pa.RecordBatch:
    c = counter(path)
    n_bytes, n_tokens = [], []
    for text in batch.column(1).to_pylist():
        data = (text or "").encode()
        n_bytes.append(len(data))
        n_tokens.append(c.count(data))
    tokens = pa.array(n_tokens, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(n_bytes, pa.int64()), tokens, pa.array([n > limit for n in n_tokens], pa.bool_())],
        names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
    )


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows are kept as they are;
    other columns are not read. Texts of any length are processed whole, a run without white
    space in O(n log n). Empty tables give empty results. One narrow pass, no shuffle.
    """

    def run(batches):
        for b in batches:
            yield count_batch(b, path, limit)

    return docs.selectExpr(f"cast({id_col} as bigint) as doc_id", f"cast({text_col} as string) as text").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
