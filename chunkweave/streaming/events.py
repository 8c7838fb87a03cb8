"""Structured Streaming over the events table and over folders of files.

Each runner reads with `availableNow`, so it processes all there is and ends.
`run_append` gives a window once the watermark has passed it, which bounds its
state: that is the way for a stream without end, with a delay as short as the
source's rows are late.  `run_complete` gives every window, also the open ones,
and keeps them all: it is for streams that end, as the tables here.  Results land in a Parquet folder on shared
storage and are returned as a batch DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.session import Scratch

LATE = "365 days"


def source(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files at a path as a stream (a folder, or one file)."""
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    folder, name = (path, "*") if fs.getFileStatus(hadoop).isDirectory() else tuple(path.rsplit("/", 1))
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name != "*" else "*.parquet").parquet(folder)


def run_append(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Runs an append-mode query to its end and reads what it wrote."""
    scratch = Scratch(spark, label)
    out = f"{scratch.root}/out"
    q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Runs an aggregation to its end in complete mode; the last batch is the result."""
    scratch = Scratch(spark, label)
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{scratch.root}/batch-{number}"
        batch.write.mode("overwrite").parquet(path)
        last.append(path)

    q = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[-1]) if last else spark.createDataFrame([], stream.schema)


def tumbling(events: DataFrame, width: str, late: str = LATE) -> DataFrame:
    w = F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = LATE) -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Rows of keys not met before, as change detection by fingerprint does on a stream."""
    return events.withWatermark("ts", late).dropDuplicates(keys)


def watch_folder(spark: SparkSession, path: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str, suffixes: tuple[str, ...] = (".txt", ".md")):
    """Feeds new files of a folder, as (file_path, content), to a callback in batches; returns the running query."""
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.readStream.schema("value string").option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
    return named.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
