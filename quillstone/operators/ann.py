"""Approximate nearest neighbours: coarse lists, product-quantised codes, exact distances for the best candidates.

Centroids and codebooks are fitted by k-means on at most ``SAMPLE`` vectors (those with the smallest hashes of their
identifiers); every vector is put into the list of its nearest centroid, with a byte for each stretch of what is left of it.
Lists are partitions of the stored table, so a query reads the codes of the lists that it probes and no others, then the
vectors of the best candidates, whose identifiers are constants in the scan.  How many lists are probed and how many candidates
compared is found when the index is made: the fewest that reach ``RECALL`` for vectors of the sample.  Data without clusters need most lists,
clustered data few; the exact search stands beside it in ``vectors.nearest``.

Vectors that are null, have no direction (all zeros, numbers that aren't finite) or another length than the model are in
list -1 and are never found, as their cosine isn't defined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors

#: Vectors that a model is fitted on at most, numbers of a stretch, codes of a stretch, and rounds of k-means.
SAMPLE, STRETCH, CODES, ROUNDS = 32_768, 4, 256, 12
#: Share of the true neighbours that must be found, neighbours it is measured by, held-out queries, and how many candidates may
#: be compared exactly, as multiples of the wanted neighbours.
RECALL, NEIGHBOURS, QUERIES, RESCORED = 0.97, 20, 256, (10, 20, 50, 100, 200)
#: Rows of the stored model: kind, number and vector.
MODEL = "kind string, number int, vector array<float>"


@dataclass(frozen=True)
class Model:
    centroids: np.ndarray  # lists x dim, of unit length
    codebooks: np.ndarray  # stretches x codes x numbers of a stretch
    probes: int
    rescored: int  # candidates that are compared exactly, as a multiple of the wanted neighbours
    recall: float

    def rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table, a row for each centroid and code."""
        out = [("centroid", i, c.tolist()) for i, c in enumerate(self.centroids)]
        out += [("code", i, c.tolist()) for i, c in enumerate(self.codebooks.reshape(-1, self.codebooks.shape[-1]))]
        out += [("probes", self.probes, [self.recall]), ("rescored", self.rescored, []), ("stretches", len(self.codebooks), [])]
        return spark.createDataFrame(out, MODEL).coalesce(1)

    @classmethod
    def read(cls, table: DataFrame) -> Model:
        """From the table; some thousands of rows, whatever is indexed."""
        of = {"centroid": [], "code": [], "probes": [], "rescored": [], "stretches": []}
        for r in sorted(table.collect(), key=lambda r: r.number):
            of[r.kind].append(r)
        books = np.array([r.vector for r in of["code"]], np.float32)
        return cls(np.array([r.vector for r in of["centroid"]], np.float32), books.reshape(of["stretches"][0].number, -1, books.shape[-1]), of["probes"][0].number, of["rescored"][0].number, float(of["probes"][0].vector[0]))

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the codes of unit vectors."""
        lists = (x @ self.centroids.T).argmax(1)
        rest = _stretched(x - self.centroids[lists])
        return lists, np.stack([_nearest_code(rest[:, j], book) for j, book in enumerate(self.codebooks)], 1)

    def tables(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A unit query's products with the centroids and with every code of every stretch."""
        return self.centroids @ query, np.einsum("jcd,jd->jc", self.codebooks, _stretched(query[None])[0])


def _stretched(x: np.ndarray) -> np.ndarray:
    """Vectors cut into stretches, the last filled up with zeros."""
    short = -x.shape[1] % STRETCH
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), -1, STRETCH)


def _nearest_code(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1) - 2 * x @ book.T).argmin(1).astype(np.uint8)


def _kmeans(x: np.ndarray, k: int, seed: int, unit: bool) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1) if unit else ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def lists_for(n: int) -> int:
    """As many lists as the square root of the vectors, a power of two, at most 4,096."""
    return 1 << max(0, min(12, round(np.log2(max(n, 1)) / 2)))


def units(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that have a direction, as rows of unit length, and where they stand."""
    values = column.to_pylist()
    dim = dim or next((len(v) for v in values if v), 0)
    at = np.array([i for i, v in enumerate(values) if v is not None and len(v) == dim and None not in v], np.int64)
    x = np.array([values[i] for i in at], np.float32).reshape(len(at), dim)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good][:, None], at[good]


def fit(chunks: DataFrame, lists: int | None = None) -> Model:
    """A model of chunks (chunk_id, embedding); without any usable vector one list without a code that anything has."""
    chunks = chunks.where(F.col("embedding").isNotNull())
    n = chunks.count()
    drawn = chunks.select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(SAMPLE).select("embedding")
    x, _ = units(drawn.toArrow().column(0).combine_chunks(), None)
    if not len(x):
        return Model(np.zeros((1, 1), np.float32), np.zeros((1, 1, STRETCH), np.float32), 1, RESCORED[0], 1.0)
    lists = min(lists or lists_for(n), len(x))
    centroids = _kmeans(x, lists, 1, True)
    rest = _stretched(x - centroids[(x @ centroids.T).argmax(1)])
    books = np.stack([_kmeans(rest[:, j], min(CODES, len(x)), 2 + j, False) for j in range(rest.shape[1])])
    return Model(centroids, books, *_calibrated(Model(centroids, books, lists, 1, 1.0), x))


def _calibrated(model: Model, x: np.ndarray) -> tuple[int, int, float]:
    """The fewest candidates of all lists, then the fewest lists, that hold ``RECALL`` of the true neighbours, and what they
    hold."""
    queries = x[:: max(1, len(x) // QUERIES)][:QUERIES]
    wanted = min(NEIGHBOURS, len(x))
    near = np.argpartition(-(queries @ x.T), wanted - 1, axis=1)[:, :wanted]
    lists, codes = model.encoded(x)
    order = np.argsort(-(queries @ model.centroids.T), axis=1)
    scores = []
    for q in queries:
        coarse, fine = model.tables(q)
        scores.append(coarse[lists] + fine[np.arange(len(fine))[None], codes].sum(1))

    def recall(probes: int, rescored: int) -> float:
        hit = 0
        for i in range(len(queries)):
            rough = np.where(np.isin(lists, order[i, :probes]), scores[i], -np.inf)
            best = np.argpartition(-rough, min(len(x), wanted * rescored) - 1)[: wanted * rescored]
            hit += np.isin(near[i], best[np.isfinite(rough[best])]).sum()
        return hit / (len(queries) * wanted)

    every = len(model.centroids)
    rescored = next((r for r in RESCORED if recall(every, r) >= (1 + RECALL) / 2), RESCORED[-1])
    low, high = 1, every
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if recall(middle, rescored) >= RECALL else (middle + 1, high)
    return low, rescored, float(recall(low, rescored))


def encode(chunks: DataFrame, model: Model) -> DataFrame:
    """chunk_id, item_id, code, embedding and list of every chunk; no shuffle."""
    rows = chunks.select("chunk_id", "item_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = units(batch.column(2), model.dim)
            lists, codes = np.full(batch.num_rows, -1, np.int32), np.zeros((batch.num_rows, len(model.codebooks)), np.uint8)
            if len(at):
                lists[at], codes[at] = model.encoded(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(2), pa.array(lists)], ["chunk_id", "item_id", "code", "embedding", "list"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"chunk_id {kinds['chunk_id']}, item_id {kinds['item_id']}, code binary, embedding {kinds['embedding']}, list int")


def probed(model: Model, query: list[float], probes: int | None = None) -> list[int]:
    """The lists whose centroids are nearest."""
    q = np.asarray(query, np.float32)
    return np.argsort(-(model.centroids @ q), kind="stable")[: probes or model.probes].tolist()


def candidates(table: DataFrame, model: Model, query: list[float], n: int, probes: int | None = None) -> DataFrame:
    """chunk_id and rough (the product that the codes give) of the best n chunks of the probed lists: each task scores its
    codes and keeps its own best n."""
    q = np.asarray(query, np.float32)
    coarse, fine = model.tables(q / np.linalg.norm(q))
    rows = table.where(F.col("list").isin(*probed(model, query, probes))).select("chunk_id", "code", "list")
    place = np.arange(len(fine))[None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, len(fine))
            rough = coarse[batch.column(2).to_numpy()] + fine[place, codes].sum(1)
            best = np.argpartition(-rough, n - 1)[:n] if len(rough) > n else np.arange(len(rough))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(best)), pa.array(rough[best].astype(np.float64))], ["chunk_id", "rough"])

    return rows.mapInArrow(run, f"chunk_id {dict(table.dtypes)['chunk_id']}, rough double").orderBy(F.desc("rough"), "chunk_id").limit(n)


def nearest(table: DataFrame, model: Model, query: list[float], k: int | None = None, max_distance: float | None = vectors.MAX_DISTANCE, probes: int | None = None) -> DataFrame:
    """As ``vectors.nearest``, of the index's candidates: at most ``rescored`` times k of them, and never more than twice the
    most chunks of a search, have their distances computed."""
    k = vectors.MAX_CHUNKS if k is None else min(k, vectors.MAX_CHUNKS)
    ids = [r.chunk_id for r in candidates(table, model, query, min(k * model.rescored, 2 * vectors.MAX_CHUNKS), probes).collect()]
    rows = table.where(F.col("list").isin(*probed(model, query, probes)) & F.col("chunk_id").isin(*ids))
    return vectors.nearest(rows, query, k, max_distance)


#: Chunks and queries of a block that meet in one task.
BLOCK, QUERY_BLOCK = 8192, 1024


def _blocked(rows: DataFrame, size: int, block: str, blocks: str) -> tuple[DataFrame, DataFrame]:
    """rows with a block in their list, and the number of blocks of each list (a row a list)."""
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(blocks))
    return rows.join(F.broadcast(counts), "list").withColumn(block, F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")).drop(blocks), counts


def nearest_all(table: DataFrame, model: Model, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id and distance of the k nearest chunks of every query (query_id, embedding), by the lists that each
    probes.

    A list's chunks and the queries that probe it are cut into blocks, and each pair of blocks is one product of matrices,
    of which the best k of a query go on; so a list may hold any share of the chunks.
    """
    kinds = dict(table.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    probes = probes or model.probes

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = units(batch.column(1), model.dim)
            lists = np.argsort(-(x @ model.centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            own = pa.ListArray.from_arrays(np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32), pa.array(lists.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), own], ["query_id", "embedding", "lists"])

    asked = queries.select("query_id", "embedding").mapInArrow(probe, f"query_id {kinds['query_id']}, embedding {kinds['embedding']}, lists array<int>")
    asked = asked.select(F.col("query_id").alias("id"), "embedding", F.explode("lists").alias("list"))
    rows = table.where("list >= 0").select(F.col("chunk_id").alias("id"), "embedding", "list")
    rows, blocks = _blocked(rows, BLOCK, "block", "blocks")
    asked, asked_blocks = _blocked(asked, QUERY_BLOCK, "asked", "askeds")
    # every block of a list meets every block of the queries that probe it
    rows = rows.join(F.broadcast(asked_blocks), "list").withColumn("asked", F.explode(F.sequence(F.lit(0), F.col("askeds") - 1))).drop("askeds")
    asked = asked.join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ["list", "block", "asked"]

    def meet(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        x, at = units(chunks.column("embedding").combine_chunks(), model.dim)
        q, of = units(asked.column("embedding").combine_chunks(), model.dim)
        if not len(x) or not len(q):
            return pa.table({"query_id": asked.column("id").slice(0, 0), "chunk_id": chunks.column("id").slice(0, 0), "distance": pa.array([], pa.float64())})
        far = 1 - q.astype(np.float64) @ x.astype(np.float64).T
        best = np.argpartition(far, min(k, len(x)) - 1, axis=1)[:, :k]
        who = np.repeat(np.arange(len(q)), best.shape[1])
        return pa.table({"query_id": asked.column("id").take(pa.array(of[who])), "chunk_id": chunks.column("id").take(pa.array(at[best.ravel()])), "distance": pa.array(far[who, best.ravel()])})

    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, distance double"
    met = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, schema)
    # of a query a few rows for each pair of its blocks are left
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "chunk_id"))), 1, k)
    return met.groupBy("query_id").agg(best.alias("best")).select("query_id", F.inline("best")).select("query_id", "chunk_id", "distance")
