"""Spelling variants: words at one edit, by the halves of words in Aho-Corasick automata.

A word is cut into two halves. One edit leaves a half of it as it was, as a prefix or a suffix of the other word. Shards hold the halves of all words in an automaton;
every word goes to the shards that may hold a half of its neighbours (its own prefixes and suffixes of the lengths that fit) and is scanned there. A hit counts at
the right offset only; what remains of both words is then looked up by its forms with one code point left out, and the distance verified.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, sized

MIN_LENGTH, MIN_COUNT = 5, 3
#: Of the pairs of a document and a word, one in so many loses a code point.
DROP = 97
#: A form has at least so many times the occurrences.
RATIO = 2
#: Halves of a shard, on average.
SHARD_HALVES = 16_384
#: A half of more words than this is spread over shards by what remains of the words.
HOT_HALF = 2_048
#: Rounds of pointer jumping; a chain of forms at least doubles its count at each step, so it has less than 64 words.
JUMPS = 7
PREFIX, SUFFIX = 0, 1


def occurrences(docs: DataFrame) -> DataFrame:
    """Rows (word, n): the words of ``MIN_LENGTH`` and ``MIN_COUNT``, with their occurrences."""
    text = F.col("text").cast("string")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("w"))
    runs = runs.where(F.length("w") >= MIN_LENGTH)  # a shorter run is no word, whole or not
    runs = runs.select("i", F.translate("w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("w"))
    h = F.crc32(F.concat("i", F.lit(":"), "w").cast("binary"))
    at = (F.col("h") % F.length("w")).cast("int")
    cut = F.when(F.col("h") % DROP == 0, F.concat(F.substring("w", F.lit(1), at), F.substr("w", at + 2))).otherwise(F.col("w"))
    words = runs.withColumn("h", h).select(cut.alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def halves(word: str) -> tuple[tuple[int, str, str], tuple[int, str, str]]:
    """(side, half, the rest) of both halves."""
    k = len(word) // 2
    return (PREFIX, word[:k], word[k:]), (SUFFIX, word[k:], word[:k])


def probes(word: str) -> set[tuple[int, str, str]]:
    """(side, part, the rest) of the word's parts that are the halves of a word one code point shorter, as long or longer."""
    out = set()
    for n in (len(word) - 1, len(word), len(word) + 1):
        k = n // 2
        out.add((PREFIX, word[:k], word[k:]))
        out.add((SUFFIX, word[len(word) - (n - k) :], word[: len(word) - (n - k)]))
    return out


def forms(rest: str) -> set[str]:
    """``rest``, and ``rest`` with one code point left out: words at one edit share one of these."""
    return {rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) != len(a) + 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :]


def _place(form: str, spread: int) -> int:
    return zlib.crc32(form.encode()) % spread


def _entries(kind: int):
    """Rows (side, half, word, n) of halves (kind 0) or probes (kind 1)."""
    of = halves if kind == 0 else probes

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = [(side, half, w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for side, half, _ in of(w)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["side", "half", "word", "n"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]):
    """Of (side, half, word, n, spread), with spread over 1 a row for each place of the forms of what remains."""
    for b in batches:
        out = []
        for side, half, w, n, spread in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rest = w[len(half) :] if side == PREFIX else w[: len(w) - len(half)]
            out += [(side, half, p, w, n, spread) for p in sorted({_place(f, spread) for f in forms(rest)} if spread > 1 else {0})]
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["side", "half", "place", "word", "n", "spread"])


class Shard:
    """An automaton of halves, and for each half the words that have it by the forms of what remains of them."""

    def __init__(self):
        self.automaton, self.held, self.ready = ahocorasick.Automaton(), {}, False

    def add(self, side: int, half: str, place: int, word: str, n: int, spread: int) -> None:
        rest = word[len(half) :] if side == PREFIX else word[: len(word) - len(half)]
        if half not in self.automaton:
            self.automaton.add_word(half, half)
        by_form, _ = self.held.setdefault((side, half), ({}, spread))
        for f in forms(rest):
            if spread == 1 or _place(f, spread) == place:
                by_form.setdefault(f, []).append((rest, word, n))

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The words (with their occurrences) of this shard at one edit of ``word``, each once among all shards."""
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        for end, half in self.automaton.iter(word):
            for side in (PREFIX, SUFFIX):
                if side == PREFIX and end != len(half) - 1 or side == SUFFIX and end != len(word) - 1:
                    continue
                found = self.held.get((side, half))
                if found is None:
                    continue
                by_form, spread = found
                rest = word[len(half) :] if side == PREFIX else word[: len(word) - len(half)]
                own, seen = forms(rest), set()
                for f in own:
                    for other, w, n in by_form.get(f, ()):
                        if w in seen or not one_edit(rest, other):
                            continue
                        # of a spread half, a pair that shares several forms counts where the least of them is
                        if spread > 1 and min(own & forms(other)) != f:
                            continue
                        seen.add(w)
                        # a pair that shares both halves counts at the first
                        if side == SUFFIX and word.startswith(w[: len(w) // 2]):
                            continue
                        yield w, n


def _scan(batches: Iterator[pa.RecordBatch]):
    """Rows (word, n, n_near, best_n, best) of sorted (shard, kind, side, half, place, word, n, spread): what a shard finds of a word's neighbours."""
    at, shard, last = None, None, None
    for b in batches:
        out = []
        for key, kind, side, half, place, word, n, spread in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != at:
                at, shard, last = key, Shard(), None
            if kind == 0:
                shard.add(side, half, place, word, n, spread)
            elif word != last and shard.held:
                last = word
                found = list(shard.near(word))
                if found:
                    best, most = min(found, key=lambda x: (-x[1], x[0]))
                    out.append((word, len(found), most, best))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["word", "n_near", "best_n", "best"])


def neighbours(words: DataFrame, scratch: Scratch, hot: int | None = None, shard_halves: int | None = None) -> DataFrame:
    """Rows (word, n_near, best_n, best) of the words (word, n) that have some at one edit: how many, and of those of the greatest n the least."""
    hot, shard_halves = hot or HOT_HALF, shard_halves or SHARD_HALVES
    schema = "side int, half string, word string, n bigint"
    held, probing = words.mapInArrow(_entries(0), schema), words.mapInArrow(_entries(1), schema)
    many = scratch.save(held.groupBy("side", "half").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("side", "half", F.ceil(F.col("c") / hot).cast("int").alias("spread")))
    n_many, shards = many.count(), max(1, -(-2 * words.count() // shard_halves))

    def dealt(entries: DataFrame, kind: int) -> DataFrame:
        with_ = entries.join(sized(many, n_many), ["side", "half"], "left").select("side", "half", "word", "n", F.coalesce("spread", F.lit(1)).alias("spread"))
        placed = with_.mapInArrow(_spread, "side int, half string, place int, word string, n bigint, spread int")
        shard = F.pmod(F.xxhash64("side", "half", "place"), F.lit(shards)).cast("int")
        placed = placed.select(shard.alias("shard"), F.lit(kind).alias("kind"), "*")
        # a word is scanned once in a shard, whatever parts brought it there
        return placed if kind == 0 else placed.select("shard", "kind", F.lit(0).alias("side"), F.lit("").alias("half"), F.lit(0).alias("place"), "word", "n", F.lit(1).alias("spread"))

    both = dealt(held, 0).unionByName(dealt(probing, 1)).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "word")
    found = both.select("shard", "kind", "side", "half", "place", "word", "n", "spread").mapInArrow(_scan, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("o"), "best")).alias("x")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("x.o")).alias("best_n"), F.col("x.best").alias("best"))


def variants(docs: DataFrame) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): the words of the whole texts of (doc_id, text) and the forms that they vary.

    Words are runs of letters (A-Z lowered, and U+00C0 to U+00FF), of which some lose a code point by a hash of id and run. A word's form is the word at one edit
    of greatest n (of equal ones the least), if it has at least twice the word's n; the root is the last of the forms from there. Null texts have no words;
    a null id is an empty one; repeated rows count each; an empty table gives an empty result. Other columns are not read.
    """
    steps, result = Scratch(docs.sparkSession, "spelling-steps"), Scratch(docs.sparkSession, "spelling")
    words = steps.save(occurrences(docs))
    near = neighbours(words, steps)
    known = words.join(near, "word", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    out = steps.save(
        known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    )
    up = steps.save(out.where("form is not null").select("word", F.col("form").alias("root")))
    n_up = up.count()
    for _ in range(JUMPS):
        further = up.select(F.col("word").alias("w"), F.col("root").alias("r"))
        step = steps.save(up.join(sized(further, n_up), up.root == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        up = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            break
    found = result.save(out.join(sized(up, n_up), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    steps.clear()
    return found
