"""Log rows (topic, level, message, context, ts): routing by topic patterns, priorities, bounded buffers, formats and sinks."""

from __future__ import annotations

import json
import re
import secrets
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Priorities of levels.
PRIORITY = {"debug": 2, "info": 5, "warn": 7, "error": 9}
#: Names of levels at sinks.
SEVERITY = {
    "pagerduty": {"trace": "info", "debug": "info", "info": "info", "warn": "warning", "error": "error", "fatal": "critical"},
    "loki": {"trace": "trace", "debug": "debug", "info": "info", "warn": "warn", "error": "error", "fatal": "fatal"},
    "cloudwatch": {"trace": "TRACE", "debug": "DEBUG", "info": "INFO", "warn": "WARN", "error": "ERROR", "fatal": "FATAL"},
    "datadog": {"trace": "debug", "debug": "debug", "info": "info", "warn": "warn", "error": "error", "fatal": "emergency"},
    "syslog": {"trace": "7", "debug": "7", "info": "6", "warn": "4", "error": "3", "fatal": "0"},
}
#: From the least to the most severe.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")


def at_least(least: str, level: str = "level") -> Column:
    """Whether a row's level is ``least`` or more severe."""
    return F.col(level).isin(*LEVELS[LEVELS.index(least) :])


def sampled(logs: DataFrame, rates: dict[str, float], level: str = "level", seed: int = 0) -> DataFrame:
    """A share of the rows of each level that has a rate; rows of other levels stay."""
    rate = F.lit(1.0)
    for name, share in rates.items():
        rate = F.when(F.col(level) == name, share).otherwise(rate)
    return logs.where(F.rand(seed) < rate)


def topic_regex(pattern: str) -> str:
    """A star stands for one dotted segment, two stars or a lone star for any."""
    if pattern in ("*", "**"):
        return "^.*$"
    parts = ["[^.]+" if p == "*" else ".+" if p == "**" else re.escape(p) for p in pattern.split(".")]
    return "^" + "\\.".join(parts) + "$"


def topic_matches(topic: str | Column, patterns: str | Iterable[str]) -> Column:
    t = F.col(topic) if isinstance(topic, str) else topic
    out = F.lit(False)
    for p in [patterns] if isinstance(patterns, str) else patterns:
        out = out | t.rlike(topic_regex(p))
    return out


def priority(level: str = "level") -> Column:
    out = F.lit(5)
    for name, p in PRIORITY.items():
        out = F.when(F.col(level) == name, p).otherwise(out)
    return out


@dataclass(frozen=True)
class Route:
    name: str
    regex: str
    low: int = 0
    high: int = 10


class Router:
    """Rules built up by ``errors``, ``performance``, ``stage``, ``alerts``, ``debug``, ``default`` and ``custom``."""

    def __init__(self, routes: tuple[Route, ...] = ()):
        self.routes = routes

    def custom(self, name: str, pattern: str | re.Pattern, low: int = 0, high: int = 10) -> Router:
        """Topics by a pattern with stars or a regular expression, of priorities from low to high."""
        return Router((*self.routes, Route(name, pattern.pattern if isinstance(pattern, re.Pattern) else topic_regex(pattern), low, high)))

    # fixed values: the topics of the presets
    def errors(self, name: str = "errors") -> Router:
        return self.custom(name, re.compile(r"^pipeline\.(.*\.)?error$"))

    def performance(self, name: str = "performance") -> Router:
        return self.custom(name, re.compile(r"^pipeline\..*\.performance$"))

    def stage(self, stage: str, name: str | None = None) -> Router:
        return self.custom(name or f"stage-{stage}", re.compile(rf"^pipeline\.stage\.{re.escape(stage)}\."))

    def alerts(self, name: str = "alerts") -> Router:
        return self.custom(name, re.compile(r"^pipeline\.alert"))

    def debug(self, name: str = "debug") -> Router:
        return self.custom(name, re.compile(r"^pipeline\.debug"))

    def default(self, name: str = "default") -> Router:
        return self.custom(name, "**")

    def route(self, logs: DataFrame, topic: str = "topic", rank: str = "priority") -> DataFrame:
        """A row for each log row and rule that it meets, in column ``route``. The rules are literals: no join."""
        met = [F.when(F.col(topic).rlike(r.regex) & F.col(rank).between(r.low, r.high), F.lit(r.name)) for r in self.routes]
        return logs.select("*", F.explode(F.array_compact(F.array(*met))).alias("route"))

    def metrics(self, logs: DataFrame, **o) -> DataFrame:
        return self.route(logs, **o).groupBy("route").agg(F.count(F.lit(1)).alias("matched"))


def route_by_table(logs: DataFrame, rules: DataFrame, topic: str = "topic", rank: str = "priority") -> DataFrame:
    """A row for each log row and rule of the table (name, pattern, low, high) that it meets, in column ``route``; patterns with stars as in ``topic_regex``.

    Patterns are a trie of their segments, as rows (node, segment, child). The distinct topics walk it together, a segment at a time: each step joins the nodes
    reached with the segment itself and both stars, by equality, so the work follows what matches and not rules times topics. Rules without bounds take all
    priorities. A null topic, pattern or name meets nothing; a rule that repeats counts each time; columns of ``logs`` stay.
    """
    if "route" in logs.columns:
        raise ValueError("the column route is taken")
    known = rules.where("name is not null and pattern is not null")
    # a lone star takes any topic, the empty one too: a node of its own that every topic reaches
    whole = F.when(F.col("pattern").isin("*", "**"), F.lit("")).otherwise(F.concat(F.lit("^."), "pattern"))
    ends = known.select(whole.alias("node"), F.col("name").alias("_route"), F.coalesce("low", F.lit(-(1 << 31))).alias("_low"), F.coalesce("high", F.lit((1 << 31) - 1)).alias("_high"))
    parts = F.split("pattern", r"\.", -1)
    prefix = lambda n: F.concat_ws(".", F.lit("^"), F.slice("_parts", F.lit(1), n))
    steps = known.where(~F.col("pattern").isin("*", "**")).select(parts.alias("_parts")).select("_parts", F.posexplode("_parts").alias("_n", "segment"))
    root = F.lit("^")
    trie = steps.select(F.when(F.col("_n") == 0, root).otherwise(prefix(F.col("_n"))).alias("node"), "segment", prefix(F.col("_n") + 1).alias("child")).distinct()
    topics = logs.select(F.col(topic).alias("_topic")).where("_topic is not null").distinct().withColumn("_segments", F.split("_topic", r"\.", -1))
    depth = topics.agg(F.max(F.size("_segments"))).first()[0] or 0
    # bare: two stars that took one empty segment so far, which is too little
    at = topics.select("_topic", "_segments", root.alias("node"), F.lit(False).alias("many"), F.lit(False).alias("bare"))
    reached = topics.select("_topic", F.lit("").alias("node"))
    edges = trie.select(F.col("node").alias("_from"), F.col("segment").alias("_segment"), "child")
    for n in range(depth):
        at = at.where(F.size("_segments") > n).withColumn("_s", F.get("_segments", F.lit(n)))
        takes = F.array_distinct(F.array(F.col("_s"), F.when(F.col("_s") != "", F.lit("*")), F.lit("**")))
        on = at.where(~F.col("bare")).select("_topic", "_segments", "_s", "node", F.explode(F.filter(takes, lambda x: x.isNotNull())).alias("_take"))
        on = on.join(edges, (F.col("node") == F.col("_from")) & (F.col("_take") == F.col("_segment")))
        many = F.col("_take") == "**"
        # a literal segment of two stars in a topic is taken by the stars
        went = on.select("_topic", "_segments", F.col("child").alias("node"), many.alias("many"), (many & (F.col("_s") == "")).alias("bare"))
        stays = at.where("many").select("_topic", "_segments", "node", F.lit(True).alias("many"), F.lit(False).alias("bare"))
        at = went.unionByName(stays).groupBy("_topic", "_segments", "node").agg(F.max("many").alias("many"), F.min("bare").alias("bare"))
        reached = reached.unionByName(at.where((F.size("_segments") == n + 1) & ~F.col("bare")).select("_topic", "node"))
    met = reached.join(ends, "node").select("_topic", "_route", "_low", "_high")
    return logs.join(met, F.col(topic) == F.col("_topic")).where(F.col(rank).between(F.col("_low"), F.col("_high"))).select(*[logs[c] for c in logs.columns], F.col("_route").alias("route"))


def latest(logs: DataFrame, keys: list[str], order: list[str], capacity: int = 32) -> DataFrame:
    """The last ``capacity`` rows of each key: a bounded buffer."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return logs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= capacity).drop("_k")


def as_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def as_text(ts: str = "ts", level: str = "level", topic: str = "topic", message: str = "message") -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("] "), F.upper(level), F.lit(" "), F.col(topic), F.lit(": "), F.col(message))


def severity(sink: str, level: str = "level") -> Column:
    out = F.col(level)
    for a, b in SEVERITY[sink].items():
        out = F.when(F.col(level) == a, b).otherwise(out)
    return out


def traceparent(trace_id: str | None = None, span_id: str | None = None, sampled: bool = True) -> str:
    return f"00-{trace_id or secrets.token_hex(16)}-{span_id or secrets.token_hex(8)}-{'01' if sampled else '00'}"


def payload(sink: str, rows: list[dict], **labels: str) -> str:
    """The body that a sink's HTTP interface takes."""
    if sink == "loki":
        return json.dumps({"streams": [{"stream": {"topic": r["topic"], "level": r["level"], **labels}, "values": [[str(int(r["ts"].timestamp() * 1e9)), r["message"]]]} for r in rows]})
    if sink == "prometheus":
        counts: dict[tuple[str, str], int] = {}
        for r in rows:
            counts[r["topic"], r["level"]] = counts.get((r["topic"], r["level"]), 0) + 1
        return "".join(f'log_rows_total{{topic="{t}",level="{lv}"}} {n}\n' for (t, lv), n in sorted(counts.items()))
    if sink == "pagerduty":
        return json.dumps([{"event_action": "trigger", "payload": {"summary": r["message"], "severity": SEVERITY[sink][r["level"]], "source": r["topic"]}, **labels} for r in rows])
    if sink == "cloudwatch":
        return json.dumps({"logEvents": [{"timestamp": int(r["ts"].timestamp() * 1000), "message": r["message"]} for r in rows], **labels})
    if sink == "datadog":
        return json.dumps([{"message": r["message"], "status": SEVERITY[sink][r["level"]], "ddsource": r["topic"], **labels} for r in rows])
    return "\n".join(json.dumps({k: str(v) for k, v in r.items()}) for r in rows)


def sink(kind: str, send: Callable[[str], None], batch: int = 500, **labels: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each task sends its rows in bodies of at most ``batch`` rows; nothing goes through the driver."""

    def part(rows) -> None:
        held = []
        for r in rows:
            held.append(r.asDict())
            if len(held) == batch:
                send(payload(kind, held, **labels))
                held = []
        if held:
            send(payload(kind, held, **labels))

    return lambda df, _: df.foreachPartition(part)
