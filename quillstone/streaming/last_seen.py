"""Last-seen rows as a keyed state: a stream of rows becomes a stream of those that change what is known of their key.

The state of a key is the order of its last row (a date and a tie), nothing of the row itself, so it stays small however
wide rows are.  A row that comes late, or again, is below the state and goes no further; there is no event-time watermark,
which would drop late rows that are still the last of their key.  What goes on is upserted without looking at the table.

Cases: nulls in the order are smaller than any value; rows with a null key have one state together; of rows with equal order
the first of a batch is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.store import Store, scratch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastSeen(StatefulProcessor):
    """Keeps the order of each key's last row and gives rows that are above it."""

    def __init__(self, schema: StructType, order: tuple[str, ...]):
        self.names = schema.names
        self.order, self.kind = list(order), StructType([schema[o] for o in order])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, best = (_plain(self.last.get()) if self.last.exists() else None), None
        for frame in rows:
            for n, values in enumerate(zip(*(frame[o] for o in self.order), strict=True)):
                now = _plain(values)
                if known is None or _rank(now) > _rank(known):
                    known, best = now, frame.iloc[[n]]
        if best is not None:
            self.last.update(known)
            yield best[self.names]

    def close(self) -> None:
        pass


def _plain(values) -> tuple:
    return tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in values)


def _rank(values: tuple) -> tuple:
    return tuple((v is not None, v) if v is not None else (False,) for v in values)


def changed(rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("modifiedDate", "event_id")) -> DataFrame:
    """The rows of a stream that are above all earlier ones of their key; one a key and batch."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy(key).transformWithStateInPandas(LastSeen(rows.schema, order), rows.schema, "Update", "None")


def into(store: Store, project: int, table: str = "items", key: str = "id"):
    """A foreachBatch function for ``changed`` rows: they are added and their keys retired; the table isn't read."""

    def write(batch: DataFrame, number: int) -> None:
        seen = store.meta(project) or {}
        if int(seen.get("batch", -1)) >= number:
            return
        stage = store.stage(project)
        try:
            delta = stage.temp("delta", batch)
            if table in stage.tables:
                stage.retire(delta.select(key), table)
            stage.add(table, delta)
            stage.commit({"batch": str(number)})
        except BaseException:
            stage.abandon()
            raise

    return write


def replay(spark: SparkSession, sf_dir: str, files: int = 3) -> DataFrame:
    """The events as a stream of files, each of which holds rows of all times; gives the table that results."""
    root = scratch(spark, "last-seen")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("id"), "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("modifiedDate")
    )
    events.repartition(files, "event_id").write.parquet(f"{root}/in")
    stream = changed(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    store = Store(spark, f"{root}/store")
    run = stream.writeStream.outputMode("update").foreachBatch(into(store, 1)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return store.read(1, "items")
