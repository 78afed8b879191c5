"""Streaming forms of batch operators, for event streams of ``event_id, ts, user_id, event_type, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import shared_dir


def stream_run_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in tumbling windows; a window is final once the watermark passes it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n")


def stream_gap_groups(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: runs of events whose gaps are below ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("end_ts"), "n")


def stream_dedup_spans(events: DataFrame, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The first event of each key and window (``window_start``); a key's state goes once the watermark passes its event.

    ``late`` must be at least ``window``: then equal keys of a window always meet.
    """
    x = events.withWatermark("ts", late).withColumn("window_start", F.window("ts", window)["start"])
    return x.dropDuplicatesWithinWatermark([*keys, "window_start"])


def stream_counts(events: DataFrame, keys: list[str], window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Running counts of each key and window, for an updating sink: state holds the windows that can still change."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return x.select(F.col("w.start").alias("window_start"), *keys, "n")


#: Batches of updates after which they are merged into one table.
COMPACT = 20


def upsert_counts(path: str, keys: list[str], every: int = COMPACT):
    """A ``foreachBatch`` function that keeps the newest count of each key: a folder a batch, and after
    every so many one with all keys, from which reading starts. A repeated batch writes the same folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*keys, "n").withColumn("batch_id", F.lit(batch_id).cast("long"))
        if batch_id % every == every - 1:
            before = upserted(batch.sparkSession, path, batch_id - 1)
            every_key = rows.unionByName(before) if before is not None else rows
            newest = every_key.groupBy(*keys).agg(F.max_by("n", "batch_id").alias("n"), F.max("batch_id").alias("batch_id"))
            newest.write.mode("overwrite").parquet(f"{path}/all-{batch_id}")
        else:
            rows.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")

    return write


def upserted(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """All rows since the newest folder of all keys, which may hold several counts a key; none before the first batch."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    found = sorted((int(n.split("-")[1]), n) for n in names if n.startswith(("all-", "batch-")))
    found = [x for x in found if upto is None or x[0] <= upto]
    start = max((i for i, n in found if n.startswith("all-")), default=-1)
    paths = [f"{path}/{n}" for i, n in found if i >= start]
    return spark.read.parquet(*paths) if paths else None


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return upserted(spark, path).groupBy(*keys).agg(F.max_by("n", "batch_id").alias("n"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all that is there, write it to the shared folder, and read it back."""
    import uuid

    base = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = stream.schema
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{base}/out")


def run_with_upserts(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an updating aggregation into an upserted table and read its latest rows."""
    import uuid

    base = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(upsert_counts(f"{base}/out", keys)).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    return latest(stream.sparkSession, f"{base}/out", keys)
