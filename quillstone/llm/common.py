"""What the training-data operators share: the cluster's shared folder, files in it, Arrow batches and word splitting."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words where a word is any run of non-white-space; bytes.split() uses the same six.
ASCII_SPACE = b" \t\n\v\f\r"

#: Maps A-Z to a-z and every other ASCII byte that is neither a digit nor a letter to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(given)
        return given.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))
    return sc.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, empty place under the shared folder for one run of an operator; gone when the driver program ends."""
    at = f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append(at)
    return at


_made: list[str] = []


def _sweep() -> None:
    for at in _made:
        with contextlib.suppress(Exception):  # what can't be deleted now may stay
            system, path = filesystem(at)
            system.delete_dir(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path and the path in it; plain paths are local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def through_disk(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder once and reads it back: cuts the lineage and survives lost executors."""
    at = work_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows of a few numbers that are sent to all tasks at most (some 32 MB as a hash table); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, to be sent to all tasks of a join if they are counted to be at most ``most``; narrow rows only, materialized."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with pos (their number in their group from 0, by ``order``, nulls first) and members (how many the group has).

    No group is ever in one task: all rows are ranged by group and order (equal ones by where they stand), each task numbers
    its range, and what stands before a task's part of a group is added from one row a task and group.  The rows are
    written before they are ranged, so what they are made from is read once.  Columns at, copy, part and names that begin
    with known_ are the function's own.
    """
    keys = [group, *order, "copy"]
    rows = through_disk(rows.withColumn("copy", F.monotonically_increasing_id()), "unnumbered")
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = through_disk(sorted_rows.withColumn("at", F.monotonically_increasing_id()).drop("copy"), "numbered")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy(F.col(group).alias("known_group"), F.col("part").alias("known_part")).agg(F.min("at").alias("known_first"), F.count("*").alias("n"))
    every = Window.partitionBy("known_group")
    earlier = every.orderBy("known_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"known_before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "members": F.sum("n").over(every)}).drop("n")
    parts = few(through_disk(parts, "parts"))
    out = rows.join(parts, (F.col("part") == F.col("known_part")) & F.col(group).eqNullSafe(F.col("known_group")))
    out = out.withColumn("pos", F.col("at") - F.col("known_first") + F.col("known_before"))
    return out.drop("at", "part", "known_group", "known_part", "known_first", "known_before")


def hot_keys(rows: DataFrame, block: int) -> DataFrame | None:
    """key and blocks of the keys with more than ``block`` rows; None if there are none."""
    counts = rows.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > block)
    hot = through_disk(counts.select("key", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "hot-buckets")
    return None if hot.isEmpty() else few(hot)


def dealt(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """rows with a hot key replaced by one key for each pair of blocks: a row of block i meets block j in (min, max) and
    its own in (i, i).  Adds side: null, or in a pair of different blocks 0 or 1 for the block that the row is of."""
    blocks = F.coalesce("blocks", F.lit(1))
    out = rows.join(hot, key, "left").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pair = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") != F.col("other"), (F.col("own") > F.col("other")).cast("int"))
    return out.withColumn("side", side).withColumn(key, F.when(F.col("blocks").isNull(), F.col(key)).otherwise(pair)).drop("own", "other", "blocks")


def by_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a per-task set-up: ``make()`` runs once in each task and gives the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for batch in slices(whole):
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()  # the worker lives on after the task

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about ``most`` bytes, so that long texts don't add up in a worker."""
    n = batch.num_rows
    step = max(1, min(n, int(n * most / max(1, batch.nbytes)))) if n else 1
    for at in range(0, n, step):
        yield batch.slice(at, step)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
