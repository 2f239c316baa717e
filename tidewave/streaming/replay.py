"""Run a stream over what a path holds now and return its result as a table."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, as a full URI (a path without a scheme is on the default file system); where that is unset, a
    local master (tests) has one of its own and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewave-")
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return f"{uri.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def replay(spark: SparkSession, path: str, schema: T.StructType, build: Callable[[DataFrame], DataFrame], mode: str = "append", folder: str | None = None) -> DataFrame:
    """Read the Parquet at ``path`` as a stream through ``build`` until all is processed; called again with the same
    ``folder``, it goes on from the checkpoint there. mode "complete": the last result only."""
    folder = folder or shared_folder(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = f"{folder}/out"
    stream = build(spark.readStream.schema(schema).parquet(f"{path}*"))  # a pattern, as a plain path must be a folder
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        q = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def replay_in_parts(spark: SparkSession, rows: DataFrame, by: Column, build: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """As ``replay`` of ``rows``, which arrive in ``parts`` by the number ``by`` (cut at its quantiles): the stream stops after each and starts again from its checkpoint."""
    folder = shared_folder(spark)
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.select(F.percentile_approx(by, shares)).first()[0] if shares else []
    part = F.lit(0)
    for c in cuts or []:
        part = part + F.when(by > c, 1).otherwise(0)
    out = None
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(f"{folder}/source")
        out = replay(spark, f"{folder}/source", rows.schema, build, folder=folder)
    return out
