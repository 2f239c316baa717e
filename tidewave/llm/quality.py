"""Quality rules whose cutoffs are certified on labelled holdouts. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, sized

SPACE = r"[\x20\x09-\x0D]+"
#: Rule -> cutoffs from lenient to strict; a document is rejected if its value is above the chosen one.
GRID = {
    "symbols": [4.0 * 0.88**k for k in range(48)],
    "repeats": [1.0 - k / 50 for k in range(48)],
    "dup_lines": [1.0 - k / 50 for k in range(48)],
    "word_length": [24.0 * 0.965**k for k in range(48)],
}


def _repeat_words(words: Column) -> Column:
    """The 3-word windows of at least 3 words, as sorted longs: the high bits of a window's hash, then as many low bits as the position needs.

    Sorting brings equal windows together; no pairs are formed. Windows that share their high bits are then compared word for word.
    """
    bits = F.length(F.bin(F.size(words).cast("bigint"))).cast("int")
    # Column.__getitem__ with a column index reads an element
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    packed = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.call_function("shiftleft", F.call_function("shiftright", window(i), bits), bits).bitwiseOR(i.cast("bigint")),
    )
    return F.sort_array(packed)


def metrics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) with ``q_*`` metrics: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    A null text counts as empty. Each step's arrays pass through a generator so that they are computed
    once and not again for every element that a later function reads.
    """
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(
        *keep,
        F.inline_outer(
            F.array(
                F.struct(
                    words.alias("q_words"),
                    F.size(lines).alias("q_lines_i"),
                    F.size(F.array_distinct(lines)).alias("q_distinct_i"),
                    F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("q_symbols_i"),
                )
            )
        ),
    )
    w = F.col("q_words")
    two = one.select(
        *keep,
        F.size(w).cast("bigint").alias("q_n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("q_word_chars"),
        F.col("q_symbols_i").cast("bigint").alias("q_n_symbols"),
        (F.col("q_lines_i") - F.col("q_distinct_i")).cast("bigint").alias("q_n_dup_lines"),
        F.col("q_lines_i").cast("bigint").alias("q_n_lines"),
        "q_words",
        F.inline_outer(F.array(F.struct(F.when(F.size(w) >= 3, _repeat_words(w)).alias("q_sorted")))),
    )
    bits = F.length(F.bin(F.col("q_n_words"))).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
    s = F.col("q_sorted")
    key = lambda x: F.call_function("shiftright", x, bits)
    hit = F.filter(
        F.transform(
            s,
            lambda x, i: F.when(
                (key(F.get(s, i - 1)) == key(x)) | (key(F.get(s, i + 1)) == key(x)), x.bitwiseAND(mask)
            ).otherwise(F.lit(-1).cast("bigint")),
        ),
        lambda p: p >= 0,
    )
    at = lambda p: F.concat_ws("\n", *[F.get("q_words", (p + k).cast("int")) for k in range(3)])  # noqa: E731  no word holds a line break
    windows = F.sort_array(F.transform(hit, lambda p: F.struct(at(p).alias("w"), p.alias("p"))))
    keep_two = [c for c in two.columns if c not in ("q_sorted", "q_words")]
    three = two.select(*keep_two, F.inline_outer(F.array(F.struct(windows.alias("q_same")))))
    t = F.col("q_same")
    same = F.filter(t, lambda x, i: (F.get(t, i - 1)["w"] == x["w"]) | (F.get(t, i + 1)["w"] == x["w"]))
    four = three.select(*keep_two, F.inline_outer(F.array(F.struct(F.sort_array(F.transform(same, lambda x: x["p"])).alias("q_hit")))))
    h = F.col("q_hit")
    covered = F.aggregate(
        F.transform(h, lambda p, i: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(h, i + 1) - p, F.lit(3).cast("bigint")))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    return four.select(*keep_two, F.coalesce(covered, F.lit(0).cast("bigint")).alias("q_n_repeat_words"))


def base_failed() -> Column:
    return (F.col("q_n_words") < 50) | (100 * F.col("q_n_repeat_words") > 50 * F.col("q_n_words"))


def _values() -> dict[str, Column]:
    n = F.greatest(F.col("q_n_words"), F.lit(1))
    return {
        "symbols": F.col("q_n_symbols") / n,
        "repeats": F.col("q_n_repeat_words") / n,
        "dup_lines": F.col("q_n_dup_lines") / F.greatest(F.col("q_n_lines"), F.lit(1)),
        "word_length": F.col("q_word_chars") / n,
    }


#: Up to so many, factors of a binomial coefficient are taken one by one; beyond, factorials by Stirling's series, which is then right to twelve digits.
ONE_BY_ONE = 64


def _log_factorial(x: Column) -> Column:
    return x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact, for k < n * p; 1 where k is not below n * p.

    The largest term is summed in logarithms, the rest as ratios to it, which fall at least geometrically: beyond 12 deviations they vanish in a double,
    so what is summed grows with the square root of k.
    """
    none = F.array().cast("array<bigint>")
    few = F.aggregate(F.when((k >= 1) & (k <= ONE_BY_ONE), F.sequence(F.lit(1).cast("bigint"), k)).otherwise(none), F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i))
    x, y, z = (c.cast("double") for c in (n, k, n - k))
    many = _log_factorial(x) - _log_factorial(y) - _log_factorial(z)
    top = F.when(k <= ONE_BY_ONE, few).otherwise(many) + k * math.log(p) + (n - k) * math.log1p(-p)
    last = F.greatest(F.lit(1).cast("bigint"), k - 64 - F.ceil(12 * F.sqrt(y)).cast("bigint"))
    ratios = F.aggregate(
        F.when((k >= 1) & (k < n * p), F.sequence(k, last, F.lit(-1).cast("bigint"))).otherwise(none),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct(
            (a["t"] * i * ((1 - p) / p) / (n - i + 1)).alias("t"),
            (a["s"] + a["t"] * i * ((1 - p) / p) / (n - i + 1)).alias("s"),
        ),
    )["s"]
    return F.when(k < n * p, F.exp(top + F.log(ratios))).otherwise(F.lit(1.0))


def certify(measured: DataFrame, labels: DataFrame, risk: float = 0.04, delta: float = 0.05, price: float = 10.0) -> DataFrame:
    """Cutoffs per stratum (``lang``; null is one) and rule as rows (lang, rule, cutoff).

    ``measured`` has doc_id, lang and the metrics; ``labels`` doc_id and quality (1: good). Labelled
    documents that the base rules leave are the holdout. For each rule the cutoffs are tested from
    lenient to strict, stopping at the first that fails: the chance that Bin(n good, risk / rules)
    is at most the good ones rejected must be at most delta / (strata * rules). Then, with
    probability 1 - delta, all of the certified cutoffs in all strata together reject at most ``risk``
    of the good documents. Among them the one that rejects most of the bad, less ``price`` times the
    share of good ones, is taken; a rule without a certified, useful one is off in that stratum.
    Repeated labels of a document count once, as good if any says so; null labels are left out.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q_good"))
    held = measured.join(good, "doc_id").where(~base_failed())
    values = _values()
    place = F.lit(None).cast("array<double>")
    for name, grid in GRID.items():
        place = F.when(F.col("rule") == name, F.array(*[F.lit(x) for x in grid])).otherwise(place)
    counts = (
        held.select("lang", "q_good", F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("v")) for k, v in values.items()])))
        .select("lang", "rule", "q_good", F.size(F.filter(place, lambda t: t >= F.col("v"))).alias("k"))
        .groupBy("lang", "rule", "k")
        .agg(F.sum(F.when(F.col("q_good") == 1, 1).otherwise(0)).alias("g"), F.sum(F.when(F.col("q_good") == 1, 0).otherwise(1)).alias("b"))
    )
    counts = materialize(counts, "quality-counts")
    strata = max(counts.select("lang").distinct().count(), 1)
    each = Window.partitionBy("lang", "rule")
    upto = each.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = max(len(x) for x in GRID.values())

    def rejected_at(c: str) -> Column:
        return F.aggregate("at", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["k"] <= F.col("k"), x[c]).otherwise(0)).alias(f"{c}_rejected")

    table = (
        counts.groupBy("lang", "rule")
        .agg(F.sum("g").alias("n_good"), F.sum("b").alias("n_bad"), F.collect_list(F.struct("k", "g", "b")).alias("at"))
        .select("lang", "rule", "n_good", "n_bad", "at", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k"))
        .select(
            "lang", "rule", "n_good", "n_bad", "k",
            rejected_at("g"), rejected_at("b"),
            place.alias("grid"),
        )
    )
    level = delta / (strata * len(GRID))
    tested = table.withColumn("p", F.max(binomial_tail(F.col("n_good"), F.col("g_rejected"), risk / len(GRID))).over(upto))
    use = F.col("b_rejected") / F.greatest("n_bad", F.lit(1)) - price * F.col("g_rejected") / F.greatest("n_good", F.lit(1))
    return (
        tested.where((F.col("p") <= level) & (use > 0))
        .groupBy("lang", "rule")
        .agg(F.max_by(F.get("grid", F.col("k")), F.struct(use, -F.col("k"))).alias("cutoff"))
    )


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept."""
    wide = cuts.groupBy(F.col("lang").alias("q_lang")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"q_cut_{r}") for r in GRID])
    wide = materialize(wide, "quality-cuts")
    rejected = F.lit(False)
    for rule, value in _values().items():
        rejected = rejected | F.coalesce(value > F.col(f"q_cut_{rule}"), F.lit(False))
    joined = measured.join(sized(wide, wide.count()), F.col("lang").eqNullSafe(F.col("q_lang")), "left")
    return joined.withColumn("q_base_failed", base_failed()).withColumn("q_kept", ~F.col("q_base_failed") & ~rejected)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null texts are empty and so fail the base rules; null and repeated ids are judged row by row; an
    empty labels table switches the certified rules off; other columns are not read.
    """
    measured = materialize(metrics(docs, ["doc_id", "lang"] if "lang" in docs.columns else ["doc_id"]), "quality-metrics")
    if "lang" not in measured.columns:
        measured = measured.withColumn("lang", F.lit(None).cast("string"))
    out = judge(measured, certify(measured, labels, **options))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(f"q_{n}").alias(n) for n in names])


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their own columns, whatever these are called; without ``lang`` there is one stratum."""
    whole = docs.select(F.struct(*docs.columns).alias("q_row"), "doc_id", "text", (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))
    ids = labels.select("doc_id").distinct()
    measured = metrics(whole.drop("q_row").join(sized(ids, ids.count()), "doc_id", "left_semi"), ["doc_id", "lang"])
    cuts = certify(measured, labels, **options)
    return judge(metrics(whole, ["q_row", "lang"]), cuts).where("q_kept").select("q_row.*")
