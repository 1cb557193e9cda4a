"""Event streams: counts in time windows, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.plans.shared import own_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of an event table as a stream, with event time ``at`` in UTC."""
    schema = spark.read.parquet(path).schema
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = spark.readStream.schema(schema)
    if files.getFileStatus(target).isFile():  # a stream watches a folder
        stream, path = stream.option("pathGlobFilter", target.getName()), target.getParent().toString()
    return stream.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def counts(stream: DataFrame, *, every: str = "1 hour", late: str = "30 days") -> DataFrame:
    """``window_start, workflow, n``: deliveries and different places per tumbling window and workflow.

    A place that comes again within the watermark counts once.
    """
    once = stream.withWatermark("at", late).dropDuplicates(["traj_id", "ord", "at"])
    named = once.withColumn("workflow", F.coalesce(F.get_json_object("metadata", "$.workflow"), F.lit("none")))
    return named.groupBy(F.window("at", every), "workflow").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "workflow", "n")


def sessions(stream: DataFrame, *, gap: str = "10 minutes", late: str = "30 days") -> DataFrame:
    """``traj_id, session_start, session_end, n``: events closer than the gap form a session."""
    timed = stream.withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "traj_id").agg(F.count(F.lit(1)).alias("n")).select(
        "traj_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"
    )


def drained(spark: SparkSession, out: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there and return its final table."""
    folder = own_folder(spark, f"stream-{label}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{folder}/out/batch={number}")

    query = out.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    written = spark.read.parquet(f"{folder}/out")
    last = written.agg(F.max("batch").alias("b"))
    # complete mode: the last batch holds the whole result
    return written.join(F.broadcast(last), F.col("batch") == F.col("b")).drop("batch", "b")
