"""Structured Streaming over event tables: windows, sessions, late data, retries.

Each function takes a streaming or a static DataFrame with a TIMESTAMP column (an NTZ
column cannot carry a watermark and is cast) and gives the same rows for both, apart
from rows later than the watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from dossia.session import shared_dir


def timed(df: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_counts(df: DataFrame, ts: str, by: list[str], value: str, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum of every tumbling (or, with slide, sliding) window and key."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = timed(df, ts, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, by: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("s"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *by, "n")


def once(df: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: repeated deliveries of a job are passed over."""
    return timed(df, ts, late).dropDuplicatesWithinWatermark(key)


def attempts(df: DataFrame, key: str, ts: str, failed: str, most: int = 3) -> DataFrame:
    """key, n_attempts, n_failed, status: DONE once an attempt succeeds, FAILED after `most` failures, else PENDING; state by key, in order of arrival."""
    kind = dict(df.dtypes)[key]

    def step(k, batches, state):
        n, bad, status = state.get if state.exists else (0, 0, "PENDING")
        rows = sorted((bool(x), t) for pdf in batches for t, x in zip(pdf[ts], pdf[failed]))
        for x, _ in sorted(rows, key=lambda r: r[1]):
            if status != "PENDING":
                break
            n, bad = n + 1, bad + x
            status = "DONE" if not x else "FAILED" if bad >= most else "PENDING"
        state.update((n, bad, status))
        yield pd.DataFrame({key: [k[0]], "n_attempts": [n], "n_failed": [bad], "status": [status]})

    return df.select(key, F.col(ts).cast("timestamp").alias(ts), failed).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n_attempts int, n_failed int, status string", "n int, bad int, status string", "update", "NoTimeout")


def attempts_batch(df: DataFrame, key: str, ts: str, failed: str, most: int = 3) -> DataFrame:
    """The same over a static table, with windows."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    bad = F.coalesce(F.sum(F.col(failed).cast("int")).over(w), F.lit(0))
    good = F.coalesce(F.sum((~F.col(failed)).cast("int")).over(w), F.lit(0))
    live = df.withColumn("_bad", bad).withColumn("_good", good).filter((F.col("_good") == 0) & (F.col("_bad") < most))
    out = live.groupBy(key).agg(F.count("*").cast("int").alias("n_attempts"), F.sum(F.col(failed).cast("int")).cast("int").alias("n_failed"))
    return out.withColumn("status", F.when(F.col("n_failed") < F.col("n_attempts"), "DONE").when(F.col("n_failed") >= most, "FAILED").otherwise("PENDING"))


def run_stream(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append", files_per_batch: int = 4) -> DataFrame:
    """The result of a plan over a folder or file of parquet read as a stream, run until all is read, as a static table in the shared folder; in mode update with the number of the batch each row is of."""
    static = spark.read.parquet(path)
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", at.getName()), str(at.getParent())
    stream = reader.parquet(path)
    out = plan(stream)
    if mode == "update":  # files take no updates: each batch is written under its number, a batch run again replaces itself
        q = out.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{base}/out/b{i}")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(StructType([*out.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out/b*")
    q = out.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
