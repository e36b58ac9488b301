"""Ingesting files as they arrive, each content once.

The stream reads whole files as they appear; one trigger handles what has come
since the last. Contents are told apart by digest; the digests seen live in the
state store, so a restart from the same checkpoint ingests nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources.scan import file_status


def digests(stream: DataFrame, text: str = "text", watermark: tuple[str, str] | None = None) -> DataFrame:
    """First arrivals of each content. With a watermark ``(column, delay)`` old digests leave the state."""
    rows = stream.filter(F.length(text) > 0).withColumn("digest", F.sha2(F.col(text), 256))
    if watermark:
        return rows.withWatermark(*watermark).dropDuplicatesWithinWatermark(["digest"])
    return rows.dropDuplicates(["digest"])


def ingest_once(spark: SparkSession, path: str, schema, text: str = "text", checkpoint: str | None = None) -> DataFrame:
    """Run over all that has arrived and stop; the digests ingested so far.

    A later run from the same checkpoint goes on where this one stopped, and
    writes to the same place.
    """
    checkpoint = checkpoint or scratch(spark, "stream")
    out = f"{checkpoint}/ingested"
    source = path.rsplit("/", 1)
    # A single file is read through its folder, a folder of files as it is.
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    stream = reader.parquet(path) if file_status(spark, path) == "folder" else reader.option("pathGlobFilter", source[1]).parquet(source[0])
    query = (
        digests(stream.select(text), text)
        .select("digest")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{checkpoint}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema("digest string").parquet(out)


def watch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds"):
    """Hand each micro-batch to ``handle`` (an anti-join with the index and a write, say)."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stable_files(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose size is above zero and the same as in the listing before."""
    before = seen.select("path", F.col("length").alias("length_before"))
    return listing.join(before, "path").filter("length > 0 and length = length_before").drop("length_before")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Arrivals by time window and kind; those later than the watermark are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
