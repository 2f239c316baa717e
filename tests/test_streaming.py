"""A stream in micro-batches, with a restart from its checkpoint, equals one pass; windows of event time."""

import numpy as np
from pyspark.sql import functions as F

from tidewave.functions import kernels as K
from tidewave.streaming import stateful


def replay(spark, sf, folder, build, out, batches):
    src, check = f"{folder}/in", f"{folder}/check"
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value").where("user_id < 30")
    all_rows = e.orderBy("ts", "event_id").toPandas()
    size = -(-len(all_rows) // batches)
    for at in range(0, len(all_rows), size):
        spark.createDataFrame(all_rows.iloc[at : at + size]).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return all_rows


def test_kernel_stream_equals_batch(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = str(tmp_path / "out")
    rows = replay(spark, sf, str(tmp_path), lambda df: stateful.stream(df, K.Ema(0.3), ["user_id"], ["ts", "event_id"], ["value"]), out, 2)
    got = spark.read.parquet(out).toPandas().set_index("event_id")["y"]
    assert len(got) == len(rows)
    for _, g in rows.groupby("user_id"):
        want, _ = K.Ema(0.3).run(K.Ema(0.3).start(), g[["value"]].to_numpy())
        assert np.allclose(got.loc[g["event_id"]], want)


def test_row_and_time_windows_are_chunk_invariant():
    x = np.random.default_rng(0).standard_normal(50)
    t = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50)).astype(float) * 1000
    for k, data in [(stateful.RowWindow(5, np.mean), x[:, None]), (stateful.TimeWindow(3000.0, np.mean), np.column_stack([x, t]))]:
        whole, _ = k.run(k.start(), data)
        s, parts = k.start(), []
        for a, b in [(0, 3), (3, 4), (4, 30), (30, 50)]:
            y, s = k.run(s, data[a:b])
            parts.append(y)
        assert np.allclose(np.concatenate(parts), whole)
    want = [x[max(0, i - 4) : i + 1].mean() for i in range(50)]
    assert np.allclose(stateful.RowWindow(5, np.mean).run((np.zeros(0),), x[:, None])[0], want)


def test_event_time_windows(spark, sf, tmp_path):
    src = f"{sf}/events.parquet"
    e = spark.read.parquet(src).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    for build in (lambda d: stateful.tumbling(d, "ts", "7 days", ["user_id"]), lambda d: stateful.sessions(d, "ts", "2 days", ["user_id"])):
        batch = build(e)
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
        q = build(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{id(build)}")).start()
        q.awaitTermination()
        assert spark.table("w").count() == batch.count()
