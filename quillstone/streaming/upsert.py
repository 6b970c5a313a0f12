"""Incremental upserts as a stream: batches replace rows by key in a versioned table, at least once and idempotently.

A batch writes its own rows and retires those they replace; what the table held before isn't written again.

The watermark is a high-water mark of modification dates, inclusive on the next pull; an event-time watermark would drop
late rows, which this must not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources.store import Store, scratch


def newest(rows: DataFrame, key: str = "id") -> DataFrame:
    """Of each key the row that was modified last."""
    return ingest.last_seen(rows, key, "modifiedDate", "event_id")


def into(store: Store, project: int, table: str = "items"):
    """A foreachBatch function that upserts into the store; a batch that comes again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        seen = store.meta(project) or {}
        if int(seen.get("batch", -1)) >= number:
            return
        stage = store.stage(project)
        try:
            delta = stage.temp("delta", newest(batch))
            if table in stage.tables:
                known = stage.read(table).select("id", F.struct("modifiedDate", "event_id").alias("known"))
                own = F.struct("modifiedDate", "event_id")
                later = delta.join(known, "id", "left").where(F.col("known").isNull() | (own > F.col("known"))).select(*delta.columns)
                delta = stage.temp("later", later)
                stage.retire(delta.select("id"), table)
            stage.add(table, delta)
            mark = ingest.watermark(delta, F.lit(seen.get("watermark", ""))).first()[0]
        except BaseException:
            stage.abandon()
            raise
        stage.commit({"watermark": mark, "batch": str(number)})

    return write


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one file after the other, run until nothing is left; gives the table that results."""
    root = scratch(spark, "stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("id"), "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("modifiedDate")
    )
    events.repartition(3, "event_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    store = Store(spark, f"{root}/store")
    run = stream.writeStream.foreachBatch(into(store, 1)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return store.read(1, "items")
