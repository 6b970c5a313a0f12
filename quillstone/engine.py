"""The engine: projects of items, kept in snapshots, searched and queried."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ann, filters, fulltext, grams, hierarchy, impacts, ingest, search, sketches, vectors
from .plans import boolexpr, sql
from .sources import paged
from .sources.store import KEYS, Stage, Store, fresh_dimension, written
from .streaming import gate

VERSION = "1.0"
VECTOR_SCHEMA = "2"
#: Columns of items that a filter of a text search may use.
KEPT = ("createdDate", "modifiedDate")
#: Names of the numbers of rows in the metadata, and the tables they count.
COUNTS = {"item_count": "items", "field_kv_count": "fields_kv", "picklist_count": "picklist", "relationship_count": "relationships"}
#: Tables whose columns have sketches.
SKETCHED = ("items", "fields_kv")
#: Projects that one name may stand for.
MOST_PROJECTS = 5


@dataclass
class Engine:
    """base: a server's address or a folder of <endpoint>.jsonl files; root: where snapshots lie."""

    spark: SparkSession
    root: str
    base: str
    token: str = ""
    embedder: vectors.Embedder = field(default_factory=vectors.HashingEmbedder)
    concurrency: int = 16  # tasks that ask the server for single records

    def __post_init__(self):
        self.store = Store(self.spark, self.root)
        self.client = paged.Client(self.base, self.token)

    # dimensions and projects

    def _since(self, mark: str) -> dict[str, str]:
        return {paged.SINCE: mark} if mark else {}

    def _scan(self, endpoint: str, **options) -> DataFrame:
        return paged.scan(self.spark, self.base, endpoint, token=self.token or None, **options)

    def _dim(self, endpoint: str, *paths: str) -> DataFrame:
        def load() -> DataFrame:
            rows = ingest.records(self._scan(endpoint))
            out = rows.select(ingest.scalar(F.col("r"), "id", "long").alias("id"), *(F.try_variant_get("r", f"$.{p}", "string").alias(p.split(".")[-1]) for p in paths))
            return out.where("id IS NOT NULL").dropDuplicates(["id"])

        return fresh_dimension(self.store, endpoint, load)

    def projects(self, pattern: str | None = None) -> DataFrame:
        """id, projectKey and name, by name; the pattern is a regular expression in any case."""
        found = self._dim("projects", "projectKey", "fields.name")
        return filters.named(found, pattern)

    def resolve(self, given: str | int) -> list[int]:
        """Numbers stand for themselves, other words for at most five projects by name."""
        out: list[int] = []
        for word in str(given).split(","):
            word = word.strip()
            ids = [int(word)] if word.isdigit() else [r.id for r in self.projects(re.escape(word)).limit(MOST_PROJECTS + 1).collect()]
            if len(ids) > MOST_PROJECTS:
                raise ValueError(f"{word!r} stands for more than {MOST_PROJECTS} projects")
            out += [i for i in ids if i not in out]
        return out

    def single(self, given: str | int) -> int:
        found = self.resolve(given)
        if len(found) != 1:
            raise ValueError(f"{given!r} must name one project; it names {found}")
        return found[0]

    # building and keeping current

    def _options(self, flat: DataFrame, stage: Stage, whole: bool) -> DataFrame:
        """The picklist options that items name: those the store has, and the others looked up one by one, each once."""
        wanted, old = ingest.option_ids(flat), None
        if not whole and "picklist" in stage.tables:
            old = stage.read("picklist")
            wanted = wanted.join(old, "id", "left_anti")
        r = F.col("r")
        found = ingest.records(paged.looked_up(wanted, self.client, paged.option, self.concurrency)).select(
            ingest.scalar(r, "id", "long").alias("id"), F.try_variant_get(r, "$.name", "string").alias("name"), F.try_variant_get(r, "$.pickList", "long").alias("pickList")
        )
        found = found.where("id IS NOT NULL").dropDuplicates(["id"])
        if old is None:
            return stage.put("picklist", found)
        new = stage.temp("options", found)
        if new.isEmpty():
            return old
        stage.add("picklist", new)
        return stage.read("picklist")

    def _flat(self, project: int, raw: DataFrame, stage: Stage, whole: bool = True) -> tuple[DataFrame, DataFrame]:
        """items and fields_kv of raw records; the picklist options go to the stage."""
        rows = ingest.latest(raw, "page")
        picks = self._options(ingest.items(rows), stage, whole)
        return ingest.items(rows, self._dim("itemtypes", "typeKey", "display"), picks), ingest.key_values(rows)

    def _indexed(self, stage: Stage) -> dict[str, str]:
        """Postings of the stage's token arrays, and what weights need of all items."""
        fts = stage.read("fts")
        size = fulltext.size_of(fts)
        buckets = fulltext.buckets_for(size["fts_rows"])
        stage.put("postings", fulltext.postings(fts, buckets))
        mean = size["fts_length"] / size["fts_rows"] if size["fts_length"] else 1.0
        stage.put("levels", impacts.level_runs(stage.put("impacts", impacts.impacts(fts, mean, buckets))))
        return {k: str(v) for k, v in size.items()} | {"fts_buckets": str(buckets), "impact_mean": repr(mean)}

    def _vmeta(self, mark: str) -> dict[str, str]:
        return {"embed_model": self.embedder.name, "dim": str(self.embedder.dim), "vec_schema": VECTOR_SCHEMA, "vec_watermark": mark, "built_at": repr(time.time())}

    def build(self, project: int, with_links: bool = False, link_cap: int = 0, with_vectors: bool = True) -> None:
        """One sweep of the source, written as it came; everything else is made from that, table by table."""
        stage, vmeta = self.store.stage(project), None
        try:
            raw = stage.temp("raw", self._scan("items", project=project))
            flat, kv = self._flat(project, raw, stage)
            flat, _ = stage.put("items", flat), stage.put("fields_kv", kv)
            mark = ingest.watermark(flat).first()[0]
            edges = paged.links(flat.select("id"), self.client, link_cap, self.concurrency) if with_links else self.spark.createDataFrame([], "record string")
            stage.put("relationships", ingest.relationships(edges, self._dim("relationshiptypes", "name") if with_links else None))
            stage.put("fts", fulltext.index(flat, keep=KEPT))
            index = self._indexed(stage)
            if "grams" in stage.tables:
                stage.put("grams", grams.grams(flat))
            stage.put("sketches", self._sketched({t: stage.read(t) for t in SKETCHED}))
            if with_vectors:
                self._embedded(stage, flat)
                vmeta = self._vmeta(mark)
            now = repr(time.time())
            meta = {"project_id": str(project), "watermark": mark, "with_links": str(int(with_links)), "fetched_at": now, "last_sync_at": now, "base_url": self.base, "engine_version": VERSION, "schema_version": ingest.SCHEMA_VERSION}
            found = {r.t: str(r.n) for r in ingest.counts({k: stage.read(t) for k, t in COUNTS.items() if t in stage.done}).collect()}
        except BaseException:
            stage.abandon()
            raise
        stage.commit(meta | index | {k: "0" for k in COUNTS} | found, vmeta)

    def sync(self, project: int, with_vectors: bool = True, force: bool = False, with_links: bool = False, link_cap: int = 0, prune_deleted: bool = False) -> str:
        """'built', 'updated' or 'unchanged'.  The delta is inclusive; if it only repeats what is stored, nothing is written.

        Only what has changed is analyzed and written: its rows in each table, and its keys, which retire the rows that
        stood there.  Tables that it doesn't touch (links, vectors) are named by the new version as they are.
        """
        meta = self.store.meta(project)
        if force or self.cache_state(project) != "ready":
            self.build(project, with_links, link_cap, with_vectors)
            return "built"
        mark, stage, did = meta["watermark"], self.store.stage(project), "unchanged"
        try:
            raw = stage.temp("raw", ingest.since(self._scan("items", project=project), mark))
            flat, kv = self._flat(project, raw, stage, whole=False)
            flat = stage.temp("delta", flat)
            before = ingest.among(self.store.read(project, "items"), flat, "id").select(*flat.columns)
            new = stage.temp("changed", flat.exceptAll(before))
            if not new.isEmpty():
                did, ids = "updated", new.select("id")
                old = self._of(self.store.read(project, "fts"), "fts", ids)
                lost, fresh = self._without(project, stage, ids, "items", "fields_kv", "fts", "postings", "impacts"), {}
                stage.add("items", new)
                fresh["fields_kv"] = stage.add("fields_kv", ingest.within(kv, ids, "itemId"))
                fresh["fts"] = stage.add("fts", fulltext.index(new, keep=KEPT))
                size = self._sized(meta, lost, fulltext.size_of(fresh["fts"]))
                if meta.get("fts_buckets") != str(fulltext.buckets_for(int(size["fts_rows"]))) or "postings" not in stage.tables:
                    size |= self._indexed(stage)
                else:
                    stage.add("postings", fulltext.postings(fresh["fts"], int(meta["fts_buckets"])))
                    more = stage.add("impacts", impacts.impacts(fresh["fts"], float(meta["impact_mean"]), int(meta["fts_buckets"])))
                    stage.add("levels", impacts.levels(more).unionByName(self._levels_off(old, meta)))
                if "grams" in stage.tables:
                    stage.add("grams", grams.grams(new))
                stage.add("sketches", self._sketched({"items": new, "fields_kv": fresh["fields_kv"]}))
                gained = ingest.counts({"item_count": new, "field_kv_count": fresh["fields_kv"]}).collect()
                counts = {r.t: str(int(meta[r.t]) - lost[r.t] + r.n) for r in gained}
                if "picklist" in stage.done:
                    counts["picklist_count"] = str(stage.read("picklist").count())
                counts |= size | {"watermark": ingest.watermark(new, F.lit(mark)).first()[0], "last_sync_at": repr(time.time())}
        except BaseException:
            stage.abandon()
            raise
        if did == "updated":
            stage.commit(meta | counts)
        else:
            stage.abandon()
        if with_vectors:
            self.refresh_vectors(project)
        if prune_deleted:
            self.reconcile(project)
        return did

    def _embedded(self, stage: Stage, flat: DataFrame) -> None:
        """The chunks of all items, and their index anew if there was one."""
        stage.put("chunks", vectors.embed(vectors.chunk_rows(flat), self.embedder))
        if "ann" in stage.tables:
            self._listed(stage)

    def _listed(self, stage: Stage) -> ann.Model:
        chunks = stage.read("chunks")
        model = ann.fit(chunks)
        stage.put("ann_model", model.rows(self.spark))
        stage.put("ann", ann.encode(chunks, model))
        return model

    def index_substrings(self, project: int) -> None:
        """Makes the index of pieces of texts that substring searches use; from then on updates keep it."""
        stage = self.store.stage(project)
        try:
            stage.put("grams", grams.grams(stage.read("items")))
        except BaseException:
            stage.abandon()
            raise
        stage.commit(self.store.meta(project))

    def index_vectors(self, project: int) -> dict[str, float]:
        """Makes the approximate index of the chunks; from then on updates keep it.  Gives its lists, how many of them a
        query probes, and the share of true neighbours that these held when it was made."""
        stage = self.store.stage(project)
        try:
            model = self._listed(stage)
        except BaseException:
            stage.abandon()
            raise
        stage.commit(self.store.meta(project))
        return {"lists": len(model.centroids), "probes": model.probes, "recall": model.recall}

    def _without(self, project: int, stage: Stage, ids: DataFrame, *tables: str) -> dict[str, int]:
        """Retires items from tables; gives how many rows each loses, and how many terms the index does."""
        lost = {"fts_rows": 0, "fts_length": 0} | dict.fromkeys(COUNTS, 0)
        counted = {k: t for k, t in COUNTS.items() if t in tables and t in stage.tables}
        if counted:
            read = {k: self._of(self.store.read(project, t), t, ids) for k, t in counted.items()}
            lost |= {r.t: r.n for r in ingest.counts(read).collect()}
        if "fts" in tables:
            lost |= fulltext.size_of(self._of(self.store.read(project, "fts"), "fts", ids))
        stage.retire(ids, *tables)
        return lost

    def _sketched(self, tables: dict[str, DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, (sketches.of(rows, t) for t, rows in tables.items()))

    def distinct(self, given: str | int) -> DataFrame:
        """t, field and n: about how many different values the columns of items and fields_kv have, without reading them."""
        project = self.single(given)
        self._ready(project, False, True, False)
        return sketches.distinct(self.store.read(project, "sketches"))

    def _levels_off(self, retired: DataFrame, meta: dict[str, str]) -> DataFrame:
        """What takes retired index rows off the counts of levels."""
        return impacts.levels(impacts.impacts(retired, float(meta["impact_mean"]), int(meta["fts_buckets"])), -1)

    def _of(self, rows: DataFrame, table: str, ids: DataFrame) -> DataFrame:
        """The rows of a table that retiring the ids takes."""
        first, *more = KEYS.get(table, ("id",))
        found = ingest.among(rows, ids, first)
        for key in more:
            found = found.unionByName(ingest.without(ingest.among(rows, ids, key), ids, first))
        return found

    def _sized(self, meta: dict[str, str], lost: dict[str, int], gained: dict[str, int]) -> dict[str, str]:
        return {k: str(int(meta[k]) - lost[k] + gained[k]) for k in ("fts_rows", "fts_length")}

    def vector_state(self, project: int) -> str:
        """absent, stale (another model, dimension or layout) or ready."""
        v = self.store.meta(project, "vmeta")
        if v is None or "chunks" not in self.store.tables(project):
            return "absent"
        same = (v.get("embed_model"), v.get("dim"), v.get("vec_schema")) == (self.embedder.name, str(self.embedder.dim), VECTOR_SCHEMA)
        return "ready" if same else "stale"

    def vector_lag(self, project: int) -> int:
        v = self.store.meta(project, "vmeta") or {}
        return self.store.read(project, "items").where(F.col("modifiedDate") > v.get("vec_watermark", "")).count()

    def refresh_vectors(self, project: int) -> None:
        """Embeds what has changed since the vectors' own watermark; all, if they are absent or stale."""
        meta, flat = self.store.meta(project), self.store.read(project, "items")
        ready = self.vector_state(project) == "ready"
        seen = self.store.meta(project, "vmeta")["vec_watermark"] if ready else ""
        if ready and seen == meta["watermark"]:
            return
        stage = self.store.stage(project)
        try:
            if ready:
                changed = ingest.since(flat, seen)
                stage.retire(changed.select("id"), "chunks", "ann")
                new = stage.add("chunks", vectors.embed(vectors.chunk_rows(changed), self.embedder))
                if "ann" in stage.tables:
                    stage.add("ann", ann.encode(new, ann.Model.read(stage.read("ann_model"))))
            else:
                self._embedded(stage, flat)
        except BaseException:
            stage.abandon()
            raise
        stage.commit(meta, self._vmeta(meta["watermark"]))

    def reconcile(self, project: int, full: bool = False) -> dict[str, object]:
        """Deletes what the server no longer has: first by counts, then (if there are too many here, or ``full``) by identifiers."""
        if self.cache_state(project) != "ready":
            return {"method": "none", "deleted": 0}
        meta, flat = self.store.meta(project), self.store.read(project, "items")
        local, server = flat.count(), self.client.count("items", {"project": str(project)})
        if server is None or local <= server and not full:
            return {"method": "count", "deleted": 0}
        # the sweep's answer is written first, so it is asked for once
        stage = self.store.stage(project)
        try:
            there = stage.temp("there", ingest.ids(self._scan("items", project=project)))
            gone = stage.temp("gone", ingest.without(flat.select("id"), there, "id"))
            n = ingest.reconciliation(flat, there).first()["deleted"]
            if n:
                old = self._of(self.store.read(project, "fts"), "fts", gone)
                lost = self._without(project, stage, gone, "items", "fields_kv", "relationships", "fts", "postings", "impacts", "chunks", "ann")
                stage.add("levels", self._levels_off(old, meta))
                counts = {k: str(int(meta[k]) - lost[k]) for k in COUNTS} | self._sized(meta, lost, {"fts_rows": 0, "fts_length": 0})
        except BaseException:
            stage.abandon()
            raise
        if n:
            stage.commit(meta | counts)
        else:
            stage.abandon()
        return {"method": "sweep", "deleted": n}

    # commands

    def init(self, given: str | int, **options) -> dict[int, str]:
        """Builds what isn't cached yet."""
        return {p: "present" if self.cache_state(p) == "ready" else self.sync(p, force=True, **options) for p in self.resolve(given)}

    def update(self, given: str | int, **options) -> dict[int, str]:
        """Brings cached projects up to date; others are left alone."""
        return {p: "missing" if self.cache_state(p) == "missing" else self.sync(p, **options) for p in self.resolve(given)}

    def rebuild(self, given: str | int, **options) -> dict[int, str]:
        return {p: self.sync(p, force=True, **options) for p in self.resolve(given)}

    def refresh(self, given: str | int, **options) -> dict[int, str]:
        return {p: self.sync(p, prune_deleted=True, **options) for p in self.resolve(given)}

    def cache_state(self, project: int) -> str:
        if self.store.version(project) is None:
            return "missing"
        meta = self.store.meta(project)
        return "ready" if meta and meta.get("schema_version") == ingest.SCHEMA_VERSION and "items" in self.store.tables(project) else "corrupt"

    def status(self, given: str | int | None = None) -> DataFrame:
        """A row for each project: state, counts, watermark, dates and megabytes."""
        rows = []
        for p in self.resolve(given) if given is not None else self.store.projects():
            m = self.store.meta(p) or {}
            at = m.get("last_sync_at")
            rows.append((p, self.cache_state(p), self.vector_state(p), int(m.get("item_count", 0)), m.get("watermark", "")[:19], time.strftime("%Y-%m-%d %H:%M", time.localtime(float(at))) if at else None, round(self.store.bytes_of(p) / 1e6, 2)))
        return self.spark.createDataFrame(rows, "project long, cache string, vectors string, items long, watermark string, synced string, mb double")

    def _ready(self, project: int, need_vectors: bool, offline: bool, force: bool) -> None:
        state = gate.State(self.cache_state(project), self.vector_state(project) if need_vectors else "ready")
        meta = self.store.meta(project) or {}

        def delta() -> int | None:
            query = {"project": str(project)} | self._since(meta.get("watermark", ""))
            return self.client.count("items", query)

        did = gate.check(state, need_vectors, offline, force, delta, lambda: self.vector_lag(project))
        if did != "serve":
            self.sync(project, with_vectors=need_vectors, force=did == "rebuild")

    def search(
        self, given: str | int, query: str | None = None, keywords: list[str] | None = None, expr: str | None = None, match: str = "any", field: str = "all", types: str | None = None,
        dates: filters.Dates | None = None, top: int = 0, max_distance: float = vectors.MAX_DISTANCE, offline: bool = False, force: bool = False, compat: bool = False,
    ) -> DataFrame:
        """Hybrid search.  An expression wins over keywords; with a query only, its comma-separated parts are the keywords.
        The vector leg takes the query, or else the expression's positive terms; without any it is left out."""
        tree = boolexpr.parse(expr) if expr else boolexpr.from_keywords(boolexpr.split_keywords(keywords or ([query] if query else [])), match)
        if tree is None and not query:
            raise ValueError("a query, keywords or an expression must be given")
        words = query or (" ".join(boolexpr.positive_terms(tree)) if tree is not None else "")
        project = self.single(given)
        self._ready(project, True, offline, force)
        read = lambda t: self.store.read(project, t)
        vector = self.embedder.query(words) if words else None
        pieces = read("grams") if "grams" in self.store.tables(project) else None
        return search.hybrid(read("items"), self.postings(project), tree, read("chunks"), vector, field, types, dates, top, max_distance, compat=compat, substrings=pieces)

    def semantic(self, given: str | int, query: str, types: str | None = None, dates: filters.Dates | None = None, top: int = 0, max_distance: float = vectors.MAX_DISTANCE, offline: bool = False, force: bool = False, approximate: bool = False) -> DataFrame:
        """The nearest items; ``approximate`` looks only into the lists of the index that are near (see ``index_vectors``)."""
        project = self.single(given)
        self._ready(project, True, offline, force)
        read = lambda t: self.store.read(project, t)
        if approximate and "ann" not in self.store.tables(project):
            raise ValueError(f"project {project} has no vector index")
        model = ann.Model.read(read("ann_model")) if approximate else None
        return search.semantic(read("items"), read("ann" if approximate else "chunks"), self.embedder.query(query), types, dates, top, max_distance, model)

    def tree(self, given: str | int, top: int | None = None) -> DataFrame:
        """id, root and depth of every item by its parents; with ``top`` id and depth of that item and all below it."""
        project = self.single(given)
        self._ready(project, False, True, False)
        flat, through = self.store.read(project, "items"), written(self.spark, "tree")
        return hierarchy.positions(flat, through) if top is None else hierarchy.below(flat, top, through)

    def query(self, given: str | int, statement: str, offline: bool = False, force: bool = False) -> DataFrame:
        """Read-only SQL over items, fields_kv, picklist, relationships, meta, fts and chunks, and fts_match('expression'):
        the id and bm25 of what a full-text search finds."""
        sql.check(self.spark, sql.without_match(statement))
        project = self.single(given)
        self._ready(project, False, offline, force)
        tables = {t: self.store.read(project, t) for t in self.store.tables(project) if t in sql.VIEWS}
        return sql.query(self.spark, statement, tables, lambda expression, field: self.match(project, expression, field, limit=None))

    def match(self, given: str | int, expression: str, field: str = "all", limit: int | None = fulltext.LEG) -> DataFrame:
        """What a full-text table would answer to MATCH, with its rank: id and bm25."""
        return fulltext.search(self.postings(self.single(given)), boolexpr.parse(expression), field, limit=limit)

    def postings(self, project: int) -> fulltext.Postings | DataFrame:
        """The project's stored index; its token arrays where a snapshot has no postings."""
        read = lambda t: self.store.read(project, t)
        if "postings" not in self.store.tables(project):
            return read("fts")
        meta = self.store.meta(project)
        early = impacts.Early(read("impacts"), read("levels"), read("fts"), float(meta["impact_mean"])) if "impact_mean" in meta else None
        return fulltext.Postings(read("postings"), fulltext.stats_row(self.spark, int(meta["fts_rows"]), int(meta["fts_length"])), int(meta["fts_buckets"]), read("items").select("id", *KEPT), early)

    def purge(self, given: str | int | None = None, everything: bool = False) -> list[int]:
        if given is None and not everything:
            raise ValueError("name a project or ask for everything")
        return [p for p in (self.store.projects() if everything else self.resolve(given)) if self.store.purge(p)]


def as_json(rows: DataFrame) -> str:
    """A result as a JSON array; for results of a size to be read by people."""
    import json

    return json.dumps([r.asDict(recursive=True) for r in rows.collect()], ensure_ascii=False, indent=2, default=str)


def as_text(rows: DataFrame, longest_name: int = 60) -> str:
    """A result as columns; names are cut, nulls are empty."""
    cut = [["" if v is None else str(v)[:longest_name] if k == "name" else str(v) for k, v in r.asDict().items()] for r in rows.collect()]
    width = [max(map(len, c)) for c in zip(rows.columns, *cut, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in [rows.columns, *cut])
