"""Event streams: bounded history, tumbling and session windows, progress sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.sources.shared import new_folder


def history(events: DataFrame, key: str, order: list[str], most: int = 200) -> DataFrame:
    """The last ``most`` events of each key, for late joiners."""
    latest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= most).drop("_n")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, its time as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


#: The state store that processors with timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, mode: str = "complete", *, timers: bool = False) -> DataFrame:
    """All that the stream yields from the data at hand, as Parquet in the shared folder, so no row passes through the
    driver. In complete mode each batch's whole result takes the place of the one before; in the other modes rows add up,
    each batch in a folder of its number, so one that is replayed replaces itself."""
    spark = stream.sparkSession
    out, checkpoint = new_folder(spark, "drained"), new_folder(spark, "drained-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    if timers:
        spark.conf.set(provider, ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Number and sum of events per window and type."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    shown = counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
    return drained(shown) if events.isStreaming else shown


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Events per user and session; a session ends after ``gap`` without an event."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    shown = counted.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
    return drained(shown) if events.isStreaming else shown


def once_each(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def broadcast(events: DataFrame, send: Callable[[object], None], key: str, checkpoint: str):
    """Sends each batch's events in order per key, from the tasks that hold them; no event passes through the driver. A
    receiver that fails loses that event and does not stop the stream. ``send`` is shipped to the tasks."""

    def deliver(rows) -> None:
        for row in rows:
            try:
                send(row)
            except Exception as error:  # a dead receiver loses its event, the others go on
                print(f"dropped an event: {error}")

    def each(batch: DataFrame, _: int) -> None:
        batch.repartition(key).sortWithinPartitions(key, "ts").foreachPartition(deliver)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
