r"""Conversations as text with a loss mask, and back: expressions only.

A conversation is ``<s>`` and its turns; adjacent rows of one role are one turn, their texts kept apart by ``[SEP]``:

    user         [INST] text [/INST]
    system       [SYS] text [/SYS]
    assistant    (a space) text</s>
    other roles  [ROLE:role] text [/ROLE]

Within texts a control string (one of these marks, or one with backslashes after its first character) gets a backslash after its first
character; in the name of another role, a backslash is ``\b`` and ``]`` is ``\c``. Both are taken away on reading, so every text comes back as it was.

The loss mask is a list of spans (start, size) in bytes of the UTF-8 text: the texts of the assistant, without marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

#: What follows the first character of a control string.
_REST = r"(s>|/s>|/?INST\]|/?SYS\]|ROLE:|/ROLE\]|SEP\])"
_CONTROL, _ESCAPED = r"([<\[])(\\*)" + _REST, r"([<\[])\\(\\*)" + _REST
SEP = "[SEP]"
#: Elements of a block of ``prefix_sums``.
BLOCK = 512
#: A turn as it is read: user, system, another role's name and text, assistant.
_TURN = r"(?s)\[INST\] (.*?) \[/INST\]|\[SYS\] (.*?) \[/SYS\]|\[ROLE:([^\]]*)\] (.*?) \[/ROLE\]| (.*?)</s>"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of ``value``, which is evaluated once however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), 0)


def prefix_sums(lengths: Column) -> Column:
    """The sum before each element of an array of longs: within blocks, and over the blocks, so that long arrays are not copied for each element."""
    zero = F.array(F.lit(0).cast("bigint"))

    def running(xs: Column) -> Column:
        """One element more than ``xs``: the last is the sum."""
        return F.aggregate(xs, zero, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def over(n: Column, all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: running(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))
        return let(
            blocks,
            lambda inner: let(
                running(F.transform(inner, lambda x: F.element_at(x, -1))),
                lambda before: F.flatten(F.transform(inner, lambda x, i: let(F.get(before, i), lambda y: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + y)))),
            ),
        )

    return let(lengths, lambda a: F.when(F.size(a) > 0, over(F.size(a), a)).otherwise(F.array().cast("array<bigint>")))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _marks(role: Column) -> tuple[Column, Column]:
    """What opens and closes a turn of a role."""
    name = F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("]"), F.lit("\\c"))
    opens = F.when(role == "user", "[INST] ").when(role == "system", "[SYS] ").when(role == "assistant", " ").otherwise(F.concat(F.lit("[ROLE:"), name, F.lit("] ")))
    closes = F.when(role == "user", " [/INST]").when(role == "system", " [/SYS]").when(role == "assistant", "</s>").otherwise(" [/ROLE]")
    return opens, closes


def format_chats(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, text, loss): of the rows (conv_id, turn, role, text) of each conversation its text and loss mask.

    Rows are ordered by turn (null first), equal turns by role and text; repeated rows stay. A null text or role is an empty one; null conv_ids are one
    conversation. An empty table gives an empty result; other columns are not read. A conversation is one row, so its text must fit one.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))))
    chats = rows.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(turns.alias("turns"))
    return chats.select("conv_id", let(F.col("turns"), _formatted).alias("x")).select("conv_id", "x.text", "x.loss")


def _formatted(turns: Column) -> Column:
    """The struct (text, loss) of sorted turns."""
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def merged(firsts: Column) -> Column:
        """Adjacent rows of one role as (role, texts)."""
        return F.transform(
            firsts,
            lambda lo, k: F.struct(
                F.get(turns, lo)["role"].alias("role"),
                F.transform(F.slice(turns, lo + 1, F.coalesce(F.get(firsts, k + 1), F.size(turns)) - lo), lambda t: escape(t["text"])).alias("texts"),
            ),
        )

    def pieces(turn: Column) -> Column:
        """A turn's marks and texts as (text, loss), in order."""
        opens, closes = _marks(turn["role"])
        loss = turn["role"] == "assistant"
        piece = lambda t, under: F.struct(t.alias("text"), under.alias("loss"))
        texts = F.flatten(F.transform(turn["texts"], lambda t, i: F.when(i == 0, F.array(piece(t, loss))).otherwise(F.array(piece(F.lit(SEP), F.lit(False)), piece(t, loss)))))
        return F.concat(F.array(piece(opens, F.lit(False))), texts, F.array(piece(closes, F.lit(False))))

    def whole(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.octet_length(p["text"]).cast("bigint"))
        spans = let(
            prefix_sums(sizes),
            lambda at: F.transform(
                F.filter(F.transform(parts, lambda p, i: F.struct(p["loss"].alias("loss"), F.get(at, i).alias("start"), F.octet_length(p["text"]).cast("bigint").alias("size"))), lambda p: p["loss"]),
                lambda p: F.struct((p["start"] + 3).alias("start"), p["size"].alias("size")),
            ),
        )
        return F.struct(F.concat(F.lit("<s>"), F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("text"), spans.alias("loss"))

    return let(F.flatten(let(let(starts, merged), lambda m: F.transform(m, pieces))), whole)


def read_chats(chats: DataFrame) -> DataFrame:
    """Rows (conv_id, turns, loss_text, formatted_chars) of formatted conversations: their rows (role, text) as they were, the text under the mask without escapes, and the size."""
    body = F.substr("text", F.lit(4))
    unnamed = lambda x: F.replace(F.replace(x, F.lit("\\c"), F.lit("]")), F.lit("\\b"), F.lit("\\"))

    def turns(found: Column) -> Column:
        """Every turn is taken apart by the mark that opens it."""
        inner = lambda t, opens, closes: F.substr(t, F.lit(opens + 1), F.length(t) - (opens + closes))
        name = lambda t: F.regexp_extract(t, r"^\[ROLE:([^\]]*)\] ", 1)
        role = lambda t: F.when(t.startswith("[INST] "), "user").when(t.startswith("[SYS] "), "system").when(t.startswith(" "), "assistant").otherwise(unnamed(name(t)))
        texts = lambda t: F.when(t.startswith("[INST] "), inner(t, 7, 8)).when(t.startswith("[SYS] "), inner(t, 6, 7)).when(t.startswith(" "), inner(t, 1, 4)).otherwise(
            F.substr(t, F.length(name(t)) + 9, F.length(t) - F.length(name(t)) - 16)
        )
        each = lambda t: let(role(t), lambda r: F.transform(F.split(texts(t), r"\[SEP\]", -1), lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))
        return F.flatten(F.transform(found, each))

    data = F.col("text").cast("binary")
    under = F.transform("loss", lambda s: unescape(F.substr(data, (s["start"] + 1).cast("int"), s["size"].cast("int")).cast("string")))
    return chats.select(
        "conv_id",
        let(F.regexp_extract_all(body, F.lit(_TURN), F.lit(0)), turns).alias("turns"),
        F.array_join(under, "").alias("loss_text"),
        F.length("text").cast("bigint").alias("formatted_chars"),
    )


def roundtrip(rows: DataFrame) -> DataFrame:
    """``read_chats`` of ``format_chats``, by way of Parquet files in the shared folder."""
    return read_chats(materialize(format_chats(rows), "chats"))


def digests(chats: DataFrame) -> DataFrame:
    """Of conversations that were read: n_turns (rows), turns_sha256 of role, newline, text and newline of each, loss_chars and loss_sha256 of the text under the mask, formatted_chars."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
