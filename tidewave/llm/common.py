"""Shared pieces: the shared work folder, lineage cuts, size-checked joins and components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side of a join is broadcast up to this many rows (of a few longs each), beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, as a full URI; where that is unset, a local master (tests) sets one of its own and a cluster is refused.

    A path without a scheme is on the default file system, as it is for Spark.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewave-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{qualified(spark, base).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, by Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Lost executors then cost a reread of a file instead of a recomputation.
    """
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one run that cut lineage, in a folder of their own; ``clear`` deletes those that no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.made = spark, work_dir(spark, name), 0

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, self.folder)


def sized(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows stay in the bound; else leave it to a shuffle join."""
    return F.broadcast(df) if rows <= bound else df


def sorted_groups(batches, key: tuple[str, ...]):
    """(key, table) of each run of equal integer keys in a partition sorted by them; a group is held, not a partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in key], 1)
        cuts = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            now = tuple(cols[lo].tolist())
            if held and now != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(lo, hi - lo))
            last = now
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


#: Counted edges up to this many (16 bytes each) are joined by one task; beyond, by rounds of shuffles.
ONE_TASK_EDGES = 500_000


def union_find(batches):
    """Rows (id, root) of the edges (a, b) of all batches, root the smallest id."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := root.setdefault(v, v)) != v:
            root[v] = root[p]
            v = root[v]
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    ids = list(root)
    for at in range(0, len(ids), 10_000):
        part = ids[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(i) for i in part], pa.int64())], names=["id", "root"])


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 40, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as rows (id, root), root the smallest id; a table of ``scratch``.

    Edges that are counted to be at most ``one_task`` go through one task. More alternate a minimum over neighbours with pointer jumping, all in shuffled
    aggregates; each round's labels are written out. Nodes without edges are absent.
    A hub with many edges is pre-aggregated map-side, as only minima are taken.
    """
    if edges.count() <= one_task:
        return scratch.save(edges.select("a", "b").coalesce(1).mapInArrow(union_find, "id bigint, root bigint"))
    own = Scratch(scratch.spark, "components")
    both = own.save(edges.where("a <> b").select("a", "b").distinct().selectExpr("inline(array(struct(a, b), struct(b as a, a as b)))"))
    label = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"))
    label = own.save(label)
    for _ in range(max_rounds):
        near = (
            both.join(label, both.b == label.id)
            .groupBy("a")
            .agg(F.min("root").alias("m"))
            .join(label, F.col("a") == F.col("id"))
            .select("id", F.col("root").alias("old"), F.least("m", "root").alias("cand"))
        )
        # hook: the old root takes the best candidate seen by any of its members
        hook = near.groupBy(F.col("old").alias("o")).agg(F.min("cand").alias("h"))
        step = near.join(hook, near.old == hook.o).select("id", "old", F.least("cand", "h").alias("root"))
        # jump: follow the root's own root once
        up = step.select(F.col("id").alias("r"), F.col("root").alias("rr"))
        new = own.save(step.join(up, step.root == up.r, "left").select("id", "old", F.least("root", F.coalesce("rr", "root")).alias("root")))
        label = new.select("id", "root")
        if not new.where("root <> old").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    label = scratch.save(label)
    own.clear()
    return label
