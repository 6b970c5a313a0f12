"""Versioned snapshots: Parquet tables of a project, and a small file for each version that says which folders they are.

A table is one or several folders (parts) and the keys that were retired since: a row counts unless its key was retired
after the row's part was written.  An update therefore writes what has changed and the keys of it, nothing else; tables that
it doesn't touch are named again by the next version and never copied.  Reading is a union of the parts and, if anything was
retired, one anti-join with the retired keys, which are sent to all tasks while they are few; filters reach the parts' scans.
Parts that have become many are merged into one, and a table of which a fifth has changed is written anew, by the writer
that brings it there.

All file access goes through Hadoop's file systems.  The version in force is the highest that has a file commit-<n>.  The
file is written last, under another name, and then renamed where no such file is: at every moment some version is in force,
and a writer that fails leaves a folder that nobody reads.  Where renaming is one step that refuses an existing target
(local file systems, HDFS), of two writers that started from the same version only one can commit; in object stores whose
renaming is a copy (s3a) a project must have one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tables that are partitioned by a column, sorted by another within, and dealt over the partition's files by a third.
LAID_OUT = {"ann": ("list", ("chunk_id",), "item_id")}
#: Tables that are made in sorted runs and written as they come, without a shuffle; what their runs are sorted by.  Those in
#: FOLDERS have a folder for each value of a column, into all of which a task writes at once.
RUNS = {"postings": ("term", "id"), "impacts": ("term", "-impact"), "levels": ("term",), "grams": ("gram", "block")}
FOLDERS = {"postings": "bucket", "impacts": "bucket", "levels": "bucket"}
#: What a table's rows are retired by, where it isn't id; edges go with either end.
KEYS = {"fields_kv": ("itemId",), "relationships": ("fromItem", "toItem"), "chunks": ("item_id",), "ann": ("item_id",)}
#: Parts besides the first that are merged, and the share of a table's bytes in them at which it is written anew.
MANY_PARTS, CHANGED_SHARE = 8, 0.2
#: Retired keys (some 30 bytes each in a hash table) that are sent to all tasks at most, and bytes of a file of a part.
BROADCAST_KEYS, FILE_BYTES = 500_000, 128 << 20
#: Files that a task has open at once, and rows of a partition that one task writes.
WRITERS = 64
PART_ROWS = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for one run under the cluster's shared folder (a temporary one only in local mode without it), deleted
    when Spark ends."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        given = tempfile.gettempdir()
    at = f"{given.rstrip('/')}/quillstone-{name}-{uuid.uuid4().hex}"
    fs, p = Store(spark, at)._at(at)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return at


def written(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes rows under a name in a new scratch folder and reads them back: it cuts the lineage, and what it
    made survives lost executors."""
    at = scratch(spark, name)

    def through(df: DataFrame, part: str) -> DataFrame:
        df.write.parquet(f"{at}/{part}")
        return spark.read.schema(df.schema).parquet(f"{at}/{part}")

    return through


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # file system

    def _at(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _write(self, path: str, content: str, replace: bool = True) -> bool:
        """Writes a small file at once; without ``replace`` False if there is one already."""
        fs, p = self._at(path)
        fresh = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
        out = fs.create(fresh, True)
        out.write(bytearray(content.encode()))
        out.close()
        if fs.exists(p) and replace:
            fs.delete(p, False)
        if not fs.exists(p) and fs.rename(fresh, p):
            return True
        fs.delete(fresh, False)
        if replace:
            raise OSError(f"{path} couldn't be replaced")
        return False

    def _read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        source = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    # projects and versions

    def _home(self, project: int) -> str:
        return f"{self.root}/project_id={int(project)}"

    def projects(self) -> list[int]:
        """Projects that have a version in force."""
        found = (re.fullmatch(r"project_id=(\d+)", n) for n in self._names(self.root))
        return sorted(int(m[1]) for m in found if m and self.version(int(m[1])) is not None)

    def _commits(self, project: int) -> list[int]:
        return sorted(int(m[1]) for n in self._names(self._home(project)) if (m := re.fullmatch(r"commit-(\d+)", n)))

    def version(self, project: int) -> int | None:
        return max(self._commits(project), default=None)

    def manifest(self, project: int, version: int | None = None) -> dict:
        """What the version (that in force) says of itself: its tables, meta and vmeta."""
        v = self.version(project) if version is None else version
        said = None if v is None else self._read(f"{self._home(project)}/commit-{v}")
        if said is None:
            raise LookupError(f"project {project} has no snapshot")
        return json.loads(said)

    def tables(self, project: int) -> list[str]:
        if self.version(project) is None:
            return []
        try:
            said = self.manifest(project)
        except ValueError:
            return []
        return [*said["tables"], *(t for t in ("meta", "vmeta") if said[t] is not None)]

    def read(self, project: int, table: str, version: int | None = None) -> DataFrame:
        said = self.manifest(project, version)
        if table in ("meta", "vmeta"):
            return self.spark.createDataFrame(sorted(said[table].items()), "key string, value string")
        if table not in said["tables"]:
            raise LookupError(f"project {project} has no table {table}")
        return self._frame(project, table, said["tables"][table])

    def _part(self, project: int, part: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(part["schema"])).parquet(f"{self._home(project)}/{part['at']}")

    def _frame(self, project: int, table: str, said: dict) -> DataFrame:
        """The rows of a table's parts that weren't retired after their part was written."""
        names = [f["name"] for f in said["parts"][0]["schema"]["fields"]]
        parts = [(p["seq"], self._part(project, p).select(*names)) for p in said["parts"]]
        if not said["gone"]:
            return reduce(DataFrame.unionByName, (df for _, df in parts))
        every = reduce(DataFrame.unionByName, (df.withColumn("_seq", F.lit(seq)) for seq, df in parts))
        gone = reduce(DataFrame.unionByName, (self._part(project, g).select(F.col("key").alias("_key"), F.lit(g["seq"]).alias("_at")) for g in said["gone"]))
        if len(said["gone"]) > 1:
            gone = gone.groupBy("_key").agg(F.max("_at").alias("_at"))
        if sum(g["rows"] for g in said["gone"]) <= BROADCAST_KEYS:
            gone = F.broadcast(gone)
        for key in KEYS.get(table, ("id",)):
            every = every.join(gone, (F.col(key) == F.col("_key")) & (F.col("_seq") < F.col("_at")), "left_anti")
        return every.drop("_seq")

    def meta(self, project: int, table: str = "meta") -> dict[str, str] | None:
        """The key-value table as a dict; None if it is missing or the version's file is broken."""
        try:
            return self.manifest(project)[table] if self.version(project) is not None else None
        except (ValueError, KeyError):
            return None

    def stage(self, project: int) -> Stage:
        """A new version that isn't in force yet."""
        return Stage(self, project)

    def write(self, project: int, tables: dict[str, DataFrame], meta: dict[str, str], vmeta: dict[str, str] | None = None) -> int:
        """Writes a new version: the given tables anew, the others as they are."""
        stage = self.stage(project)
        for name, df in tables.items():
            stage.put(name, df)
        return stage.commit(meta, vmeta)

    def purge(self, project: int) -> bool:
        fs, p = self._at(self._home(project))
        return fs.exists(p) and fs.delete(p, True)

    def bytes_of(self, project: int) -> int:
        fs, p = self._at(self._home(project))
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


class Stage:
    """A version in the making.  Tables are put (anew) or added to, keys are retired; a table reads back as it will be in
    force, so what follows from one is made from what was written.  ``commit`` puts the version in force."""

    def __init__(self, store: Store, project: int):
        self.store, self.project, self.base = store, project, store.version(project)
        self.seq = (self.base or 0) + 1
        self.name = f"v={self.seq}-{uuid.uuid4().hex}"
        self.at = f"{store._home(project)}/{self.name}"
        self.old = store.manifest(project) if self.base is not None else {"tables": {}, "meta": None, "vmeta": None}
        self.tables = {t: {"parts": list(x["parts"]), "gone": list(x["gone"])} for t, x in self.old["tables"].items()}
        self.done: set[str] = set()
        self.wrote: set[str] = set()

    def _wrote(self, folder: str, df: DataFrame) -> dict:
        fs, p = self.store._at(f"{self.store._home(self.project)}/{folder}")
        self.wrote.add(folder)
        return {"at": folder, "seq": self.seq, "bytes": int(fs.getContentSummary(p).getLength()), "schema": df.schema.jsonValue()}

    def put(self, table: str, df: DataFrame) -> DataFrame:
        """Writes a table anew, sorted by its key in each file, so that few row groups hold a key.  One that comes in runs is
        written as it comes: the pages of each run say which terms they hold."""
        folder = f"{self.name}/{table}-{uuid.uuid4().hex[:8]}"
        key = KEYS.get(table, ("id",))[0]
        if table in LAID_OUT:
            part, order, spread = LAID_OUT[table]
            temp = self.temp(f"{table}-rows", df)
            # a partition in as many files as its rows need, each sorted, whatever share of the rows it holds
            files = temp.groupBy(F.col(part).alias("_part")).agg(F.ceil(F.count("*") / PART_ROWS).alias("_files"))
            laid = temp.join(F.broadcast(files), F.col(part) == F.col("_part")).repartition(part, F.pmod(F.xxhash64(spread), F.col("_files")))
            laid.sortWithinPartitions(part, *map(_ordered, order)).drop("_part", "_files").write.partitionBy(part).parquet(f"{self.store._home(self.project)}/{folder}")
            df = df.select(*(c for c in df.columns if c != part), part)
        elif table in RUNS:
            df = self._runs(table, df, f"{self.store._home(self.project)}/{folder}")
        else:
            (df.sortWithinPartitions(key) if key in df.columns else df).write.parquet(f"{self.store._home(self.project)}/{folder}")
        self.tables[table] = {"parts": [self._wrote(folder, df)], "gone": []}
        self.done.add(table)
        return self.read(table)

    def _runs(self, table: str, df: DataFrame, at: str) -> DataFrame:
        """Writes rows as they come; gives them with their columns in the order of the files."""
        if table not in FOLDERS:
            df.write.parquet(at)
            return df
        df = df.select(*(c for c in df.columns if c != FOLDERS[table]), FOLDERS[table])
        conf, several = self.store.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(several)
        try:
            conf.set(several, str(WRITERS))  # with one writer at a time the rows would be sorted by folder first
            df.write.partitionBy(FOLDERS[table]).parquet(at)
        finally:
            conf.set(several, before)
        return df

    def add(self, table: str, df: DataFrame) -> DataFrame:
        """Writes further rows of a table, in as few files as they need, and gives them as written."""
        if table not in self.tables:
            return self.put(table, df)
        folder, order = f"{self.name}/{table}-{uuid.uuid4().hex[:8]}", LAID_OUT[table][1] if table in LAID_OUT else RUNS.get(table) or (KEYS.get(table, ("id",))[0],)
        order = [o for o in order if o.lstrip("-") in df.columns] or df.columns[:1]
        temp = self.temp(f"{table}-rows", df)
        fs, p = self.store._at(f"{self.at}/_temp/{table}-rows")
        files = 1 + int(fs.getContentSummary(p).getLength()) // FILE_BYTES
        (temp.coalesce(1) if files == 1 else temp.repartitionByRange(files, *map(_ordered, order))).sortWithinPartitions(*map(_ordered, order)).write.parquet(f"{self.store._home(self.project)}/{folder}")
        part = self._wrote(folder, df)
        self.tables[table]["parts"].append(part)
        self.done.add(table)
        return self.store._part(self.project, part)

    def retire(self, keys: DataFrame, *tables: str) -> int:
        """The rows of these tables with one of the keys (one column), as written before this version, count no more.
        Gives the number of keys."""
        folder = f"{self.name}/gone-{uuid.uuid4().hex[:8]}"
        keys = keys.select(F.col(keys.columns[0]).alias("key")).where("key IS NOT NULL").distinct()
        keys.coalesce(1).write.parquet(f"{self.store._home(self.project)}/{folder}")
        gone = self._wrote(folder, keys)
        gone["rows"] = self.store._part(self.project, gone).count()
        for t in tables:
            if gone["rows"] and t in self.tables:
                self.tables[t]["gone"].append(gone)
                self.done.add(t)
        return gone["rows"]

    def drop(self, *tables: str) -> None:
        """The version has no such tables."""
        for t in tables:
            self.tables.pop(t, None)

    def temp(self, name: str, df: DataFrame) -> DataFrame:
        """Rows that are written for this version's making only."""
        df.write.mode("overwrite").parquet(f"{self.at}/_temp/{name}")
        return self.store.spark.read.schema(df.schema).parquet(f"{self.at}/_temp/{name}")

    def read(self, table: str) -> DataFrame:
        return self.store._frame(self.project, table, self.tables[table])

    def _compact(self, table: str) -> None:
        said = self.tables[table]
        first, more = said["parts"][0], said["parts"][1:]
        changed = sum(p["bytes"] for p in [*more, *said["gone"]])
        if changed > CHANGED_SHARE * first["bytes"] and len(more) + len(said["gone"]) > MANY_PARTS // 2:
            rows = self.read(table)  # of many parts, whose runs may be short
            self.put(table, rows.sortWithinPartitions(*map(_ordered, RUNS[table])) if table in RUNS else rows)
        elif len(more) > MANY_PARTS or len(said["gone"]) > MANY_PARTS:
            # all but the first become one part and one set of keys, which concern the first only
            gone = reduce(DataFrame.unionByName, (self.store._part(self.project, g) for g in said["gone"])) if said["gone"] else None
            rows = self.store._frame(self.project, table, {"parts": more, "gone": said["gone"]}) if more else None
            self.tables[table] = {"parts": [first], "gone": []}
            if rows is not None:
                self.add(table, rows)
            if gone is not None:
                self.retire(gone, table)

    def commit(self, meta: dict[str, str], vmeta: dict[str, str] | None = None, keep: int = 2) -> int:
        store, project = self.store, self.project
        for t in sorted(self.done & set(self.tables)):
            self._compact(t)
        text = lambda pairs: None if pairs is None else {k: str(v) for k, v in pairs.items()}
        said = {"tables": self.tables, "meta": text(meta), "vmeta": text(vmeta if vmeta is not None else self.old["vmeta"])}
        for unused in [*(self.wrote - _folders(said)), f"{self.name}/_temp"]:  # merged since, or for the making only
            self._delete(unused)
        if store.version(project) != self.base or not store._write(f"{store._home(project)}/commit-{self.seq}", json.dumps(said), replace=False):
            self.abandon()
            raise RuntimeError(f"project {project} was changed by someone else meanwhile")
        commits = store._commits(project)
        kept = [v for v in commits if v > self.seq - keep]
        named = {f for v in kept for f in _folders(store.manifest(project, v))}
        for v in commits:
            if v not in kept:
                for folder in _folders(store.manifest(project, v)) - named:
                    version = folder.split("/")[0]
                    self._delete(folder if any(n.startswith(f"{version}/") for n in named) else version)
                self._delete(f"commit-{v}")
        return self.seq

    def _delete(self, inner: str) -> None:
        fs, p = self.store._at(f"{self.store._home(self.project)}/{inner}")
        fs.delete(p, True)

    def abandon(self) -> None:
        self._delete(self.name)


def _ordered(name: str) -> Column:
    return F.desc(name[1:]) if name.startswith("-") else F.col(name)


def _folders(said: dict) -> set[str]:
    return {p["at"] for t in said["tables"].values() for p in [*t["parts"], *t["gone"]]}


def fresh_dimension(store: Store, name: str, load, ttl: int = 21_600) -> DataFrame:
    """A small table kept under the store's root for ``ttl`` seconds; a broken or old copy is loaded anew."""
    import time

    path, stamp = f"{store.root}/_dims/{name}", f"{store.root}/_dims/{name}.at"
    said = store._read(stamp)
    if said and said.strip().isdigit() and time.time() - int(said) < ttl:
        try:
            return store.spark.read.parquet(path)
        except Exception:  # noqa: BLE001  a broken copy counts as none
            pass
    load().select("*", F.lit(1).alias("_")).drop("_").write.mode("overwrite").parquet(path)
    store._write(stamp, str(int(time.time())))
    return store.spark.read.parquet(path)
