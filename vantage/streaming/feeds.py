"""Streams of driver tables, run to the end of their input and returned as tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vantage.sources.shared import shared_root

#: A state of the ingest holds the fingerprints of 2 ** 8 neighbouring document ids at most.
BUCKET_BITS = 8


def source(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file stream over a table: a folder of Parquet files, or the one file of that name in its folder."""
    folder, name = os.path.split(path.rstrip("/"))
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{folder}/{name}*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Write the stream to the shared folder until its input ends, and read what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def ingest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """``(doc_id, fingerprint)``: each document as it was last read, by an append log that is folded on reading.

    State is the fingerprint of each document, so a replayed or unchanged document is not written again, a changed one
    replaces what was stored under its id, and no batch reads the store. Of two texts of an id in one batch the one of
    the greater fingerprint stays. Rows without an id are left out. A state holds the documents of ``2 ** BUCKET_BITS``
    neighbouring ids, so its bounds are fixed and a call of the function serves many documents.
    """
    base = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    rows = source(spark, path, schema).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"))

    def changed(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last = json.loads(state.get[0]) if state.exists else {}
        now: dict[str, str] = {}
        for pdf in batches:
            for i, fingerprint in zip(pdf["doc_id"].astype(str), pdf["fingerprint"], strict=True):
                now[i] = max(now.get(i, ""), fingerprint)
        fresh = {i: fingerprint for i, fingerprint in now.items() if last.get(i) != fingerprint}
        if fresh:
            state.update((json.dumps(last | fresh),))
            yield pd.DataFrame({"doc_id": [int(i) for i in fresh], "fingerprint": list(fresh.values())})

    buckets = rows.withColumn("bucket", F.shiftright("doc_id", BUCKET_BITS)).groupBy("bucket")
    fresh = buckets.applyInPandasWithState(changed, "doc_id long, fingerprint string", "fingerprints string", "update", "NoTimeout")
    log_schema = "doc_id long, fingerprint string, batch long"

    def add(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/log/run={number}")

    fresh.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema(log_schema).option("recursiveFileLookup", "true").parquet(f"{base}/log")
    return log.groupBy("doc_id").agg(F.max_by("fingerprint", "batch").alias("fingerprint"))


def refused(spark: SparkSession, path: str, schema: StructType, cap: int) -> DataFrame:
    """Hours, sliding by ten minutes, in which a user was over the cap. Events an hour late still count."""
    log = source(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    used = log.groupBy(F.window("ts", "1 hour", "10 minutes"), "user_id", F.col("event_type").alias("action")).agg(F.count("*").alias("used"))
    return run(used.where(F.col("used") > cap).select(F.col("window.start").alias("start"), "user_id", "action", "used"))


def changes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Changes of action per user. State is the last action and the count; rows of a trigger are taken in order of time."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for action in rows["event_type"]:
            if action != last:
                last, n = action, n + 1
        state.update((last, n))
        yield pd.DataFrame({"user_id": [key[0]], "changes": [n]})

    log = source(spark, path, schema).select("user_id", "event_type", "ts", "event_id")
    fed = log.groupBy("user_id").applyInPandasWithState(count, "user_id long, changes long", "last string, n long", "update", "NoTimeout")
    base = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    schema_out = "user_id long, changes long, batch long"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{base}/rows")

    fed.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema_out).parquet(f"{base}/rows").groupBy("user_id").agg(F.max_by("changes", "batch").alias("changes"))
