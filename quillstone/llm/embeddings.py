"""Embedding near-duplicates: sign hashing by random hyperplanes in several tables, exact verification, components.

Vectors are compared inside their label only.  Equal vectors form a class that takes part once and counts as often as
it has members.  The work goes in four steps, of which only the third moves vectors, and only those of candidates:

1. Each class gets the signs of its products with random hyperplanes: a bucket in each of several tables, and a sketch
   of ``CHECK`` further signs.  The number of planes of a table follows the number of classes, so that buckets stay
   small, and the number of tables follows from the planes, so that a pair exactly at the threshold is found with
   probability ``recall`` at every size.
2. In a bucket those sketches meet.  Pairs whose sketches differ in no more signs than a pair at the threshold does (and
   three standard deviations) are candidates; a spanning forest of them leaves the task, never all pairs.
3. The vectors of a component of candidates meet once, and all its pairs are verified by their cosine in double
   precision.  A component above ``MOST`` members takes the cheaper of two ways, by the number of pairs: all of its own,
   or those of its members' buckets in each table (there, a pair that meets in several tables counts in the first).
   Groups above ``BLOCK`` members are dealt over pairs of blocks; no task holds more than two blocks.
4. Each class gets its number of links, and a forest of the links goes on to the components.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing; vectors of different lengths aren't compared; repeated rows count as different vectors and link with each
other; different vectors that share an identifier are one node and answer with the sum of their links; rows without
vec_id are answered with null component, count as partners and lead from one vector to another; very long vectors make
smaller blocks; an empty table gives no rows; columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, dealt, few, hot_keys, table, through_disk
from .components import components

THRESHOLD, RECALL, SEED = 0.98, 0.99, 20240131
#: Signs of a sketch; members of a bucket on the average; members of a component that are compared without asking for
#: the cheaper way; members of a block.
CHECK, OCCUPANCY, MOST, BLOCK = 128, 32, 4096, 16384
#: Pairs of a tile of vectors that are compared at once; numbers of a block's vectors at most.
TILE, VALUES = 1 << 18, 1 << 21


def shape_of(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Planes a table and tables for n classes."""
    planes = min(60, max(6, math.ceil(math.log2(max(n, 2) / OCCUPANCY))))
    meet = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def apart(threshold: float = THRESHOLD) -> int:
    """Signs in which the sketches of candidates differ at most."""
    p = math.acos(threshold) / math.pi
    return math.ceil(CHECK * p + 3 * math.sqrt(CHECK * p * (1 - p)))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the places and the matrix of the vectors that can link: all components finite, not all zero."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null components are NaN here
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        m = flat.reshape(-1, dim) if len(at) * dim == len(flat) else flat[starts[at][:, None] + np.arange(dim)]
        ok = np.isfinite(m).all(1) & (m != 0).any(1)
        yield (at, m) if ok.all() else (at[ok], m[ok])


def unit(m: np.ndarray) -> np.ndarray:
    """The rows in double precision, of length one (scaled first, lest squares over- or underflow)."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


class Hyperplanes:
    """Signs of vectors: a number for each table, and a sketch of ``CHECK`` signs as two numbers."""

    def __init__(self, planes: int, tables: int):
        self.planes, self.tables, self.drawn = planes, tables, {}

    def __call__(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dim = m.shape[1]
        if dim not in self.drawn:
            normal = np.random.default_rng([SEED, dim]).standard_normal
            self.drawn[dim] = normal((self.tables * self.planes + CHECK, dim)).T.astype(np.float32)
        bits = unit(m).astype(np.float32) @ self.drawn[dim] > 0
        cut = self.tables * self.planes
        powers = np.ldexp(1.0, np.arange(self.planes))  # sums are exact up to 52 planes
        own = bits[:, :cut].reshape(len(m), self.tables, self.planes)
        signs = (own @ powers).astype(np.int64) if self.planes <= 52 else own @ (1 << np.arange(self.planes, dtype=np.int64))
        return signs, np.packbits(bits[:, cut:], axis=1).view("<i8")


def bucket_keys(label: np.ndarray, dim: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """A number for label, length, table and signs (rows by tables).  Others may share it: only sketches meet by it."""

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    at = mixed(label.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + dim.astype(np.uint64))
    which = mixed(np.arange(1, signs.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return mixed(mixed(signs.astype(np.uint64) + which) + at[:, None]).view(np.int64)


# step 1: classes and their sketches


def sketches(chosen: DataFrame, planes: int, tables: int) -> DataFrame:
    """node, label, dim, c0, c1 and signs (bytes) of every usable vector of chosen (node, label, vector)."""

    def make():
        hyperplanes = Hyperplanes(planes, tables)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            parts = []
            for at, m in matrices(batch.column(2)):
                signs, check = hyperplanes(m)
                packed = signs.astype("<i8")
                parts.append((at, np.full(len(at), m.shape[1], np.int32), check, [r.tobytes() for r in packed]))
            if not parts:
                return None
            at, dim, check = (np.concatenate([p[i] for p in parts]) for i in range(3))
            node, label = (batch.column(i).take(pa.array(at)) for i in (0, 1))
            cols = [node, label, pa.array(dim), *(pa.array(np.ascontiguousarray(check[:, i])) for i in (0, 1)), pa.array([b for p in parts for b in p[3]], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["node", "label", "dim", "c0", "c1", "signs"])

        return step

    return by_rows(chosen.select("node", "label", "vector"), make, "node long, label long, dim int, c0 long, c1 long, signs binary")


def keyed(drawn: DataFrame, tables: int, with_sketch: bool) -> DataFrame:
    """A row (key, node and, if wanted, c0 and c1) for each class and table of ``drawn`` (sketches)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, label, dim, c0, c1 = (batch.column(i).to_numpy() for i in range(5))
            signs = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<i8").reshape(-1, tables)
            keys = bucket_keys(label, dim, signs)
            cols = [keys.ravel(), np.repeat(node, tables), np.repeat(c0, tables), np.repeat(c1, tables)][: 4 if with_sketch else 2]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "node", "c0", "c1"][: len(cols)])

        return step

    schema = "key long, node long, c0 long, c1 long" if with_sketch else "key long, node long"
    return by_rows(drawn.select("node", "label", "dim", "c0", "c1", "signs"), make, schema)


# step 2: candidates


def candidates(drawn: DataFrame, n: int, tables: int, threshold: float, block: int) -> DataFrame:
    """Links (a, b) of a forest of the pairs whose sketches meet in a bucket and are near."""
    most = apart(threshold)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the parts of the last key, which may go on in the next batch
        for batch in batches:
            got = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cut = np.flatnonzero(np.r_[True, got[1:, 0] != got[:-1, 0]])
            if held and got[0, 0] == held[0][0, 0] and len(cut) == 1:
                held.append(got)
                continue
            head = cut[1] if held and got[0, 0] == held[0][0, 0] else 0
            if held:
                yield from _near_sketches(np.concatenate([*held, got[:head]]), most)
            yield from _near_sketches(got[head : cut[-1]], most)
            held = [got[cut[-1] :]]
        if held:
            yield from _near_sketches(np.concatenate(held), most)

    rows = keyed(drawn, tables, True)
    if n > block and (hot := hot_keys(keyed(drawn, tables, False), block)) is not None:
        rows = dealt(rows, hot, "key")
    return rows.select("key", "node", "c0", "c1").repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def _near_sketches(got: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Forests of near sketches of rows (key, node, c0, c1) in the order of their keys."""
    starts = np.flatnonzero(np.r_[True, got[1:, 0] != got[:-1, 0]]) if len(got) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(got)])
    check, links = got[:, 2:].view(np.uint64), []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 64)]).tolist():  # small buckets of one size at a time
        for some in np.array_split(starts[sizes == size], max(1, int((sizes == size).sum()) * size * size >> 20)):
            at = some[:, None] + np.arange(size)
            near = np.bitwise_count(check[at][:, :, None] ^ check[at][:, None]).sum(-1, dtype=np.uint16) <= most
            for g in np.flatnonzero(near.sum((1, 2)) > size):
                links += [(at[g, i], at[g, j]) for i, j in _forest(lambda a, left, near=near[g]: near[a, left], size)]
    for s, size in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        own = check[s : s + size]
        links += [(s + i, s + j) for i, j in _forest(lambda a, left, own=own: np.bitwise_count(own[left] ^ own[a]).sum(-1, dtype=np.uint16) <= most, size)]
    if links:
        nodes = got[:, 1][np.array(links)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(nodes[:, i])) for i in (0, 1)], ["a", "b"])


def _forest(near, n: int) -> list[tuple[int, int]]:
    """A spanning forest of 0 ... n - 1; near(i, left) says which of left are near i."""
    left, links = np.arange(n), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(at, left)
            if hit.any():
                links += [(at, x) for x in left[hit]]
                queue += list(left[hit])
                left = left[~hit]
    return links


# step 3: verification


def verify(vectors: np.ndarray, weight: np.ndarray, side: np.ndarray | None, signs: np.ndarray | None, which: int, threshold: float):
    """Numbers of links of each row, and links that connect what they connect.  side: only pairs across two blocks
    count; which: the table at hand (pairs that share a bucket of an earlier one were counted there)."""
    n, links = len(vectors), []
    counts, parent = np.zeros(n, np.int64), np.arange(n)
    rows = np.arange(n) if side is None else np.flatnonzero(side == 0)
    columns = rows if side is None else np.flatnonzero(side == 1)
    step = max(1, TILE // max(1, min(len(columns), 4096)))
    for a in range(0, len(rows), step):
        i = rows[a : a + step]
        for b in range(0 if side is not None else a, len(columns), 4096):
            j = columns[b : b + 4096]
            x, y = np.nonzero(vectors[i] @ vectors[j].T >= threshold)
            x, y = i[x], j[y]
            if side is None:
                x, y = x[x < y], y[x < y]
            for t in range(which):
                other = signs[x, t] != signs[y, t]
                x, y = x[other], y[other]
            counts += (np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)).astype(np.int64)
            while len(x):  # hook the larger of two roots to the smaller, until no link of the tile joins two
                while (up := parent[parent]).tobytes() != parent.tobytes():
                    parent = up
                p, q = parent[x], parent[y]
                some = np.flatnonzero(p != q)
                if not len(some):
                    break
                high, low = np.maximum(p, q)[some], np.minimum(p, q)[some]
                np.minimum.at(parent, high, low)
                won = np.flatnonzero(parent[high] == low)
                k = some[won[np.unique(high[won], return_index=True)[1]]]
                links += zip(x[k].tolist(), y[k].tolist(), strict=True)
    return counts, links


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def groups(drawn: DataFrame, linked: DataFrame, n: int, tables: int, most: int, block: int) -> DataFrame:
    """node, key, t, side and signs: where each candidate is to be verified.  t is 0 and signs are null where all pairs
    of a component meet."""
    sizes = linked.groupBy("component").agg(F.count("*").alias("size"))
    large = through_disk(sizes.where(F.col("size") > most), "large-components")
    if large.isEmpty():
        return linked.select("node", F.xxhash64("component").alias("key"), F.lit(0).alias("t"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("binary").alias("signs"))
    own = linked.join(few(large), "component", "left")
    small = own.where("size IS NULL").select("node", F.xxhash64("component").alias("key"), F.lit(0).alias("t"), F.lit(None).cast("int").alias("side"), F.lit(None).cast("binary").alias("signs"))
    members = through_disk(own.where("size IS NOT NULL"), "large-members")
    drawn = drawn.join(few(members.select("node", "component")), "node")
    met = keyed(drawn, tables, False).join(few(members.select("node", "component")), "node").groupBy("component", "key").agg(F.count("*").cast("double").alias("m"))
    cheaper = met.groupBy("component").agg(F.sum(F.col("m") * F.col("m")).alias("pairs")).join(large, "component")
    cheaper = through_disk(cheaper.select("component", (F.col("pairs") < F.col("size").cast("double") * F.col("size")).alias("by_bucket")), "ways")
    ways = few(cheaper)
    whole = members.join(ways, "component").where("NOT by_bucket").select("node", F.xxhash64("component").alias("key"), F.lit(0).alias("t"), F.lit(None).cast("binary").alias("signs"))
    bucketed = drawn.join(ways, "component").where("by_bucket")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, label, dim = (batch.column(i).to_numpy() for i in range(3))
            packed = batch.column(3)
            keys = bucket_keys(label, dim, np.frombuffer(b"".join(packed.to_pylist()), "<i8").reshape(-1, tables))
            cols = [pa.array(np.repeat(node, tables)), pa.array(keys.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(node))), packed.take(pa.array(np.repeat(np.arange(len(node)), tables)))]
            return pa.RecordBatch.from_arrays(cols, ["node", "key", "t", "signs"])

        return step

    rows = whole.unionByName(by_rows(bucketed.select("node", "label", "dim", "signs"), make, "node long, key long, t int, signs binary"))
    hot = hot_keys(rows, block)
    rows = dealt(rows, hot, "key") if hot is not None else rows.withColumn("side", F.lit(None).cast("int"))
    return small.unionByName(rows.select("node", "key", "t", "side", "signs"))


def verified(chosen: DataFrame, where: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, n): links of a forest with n null, and numbers n of links of a class with b null (to be summed)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if held and held[0].column(0)[0].as_py() != keys[a]:
                    yield from group(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from group(held)

    def group(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(p.num_rows for p in parts) < 2:
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        node, label, weight = (whole.column(c).to_numpy() for c in ("node", "label", "weight"))
        vector = whole.column("vector").chunk(0)
        which = whole.column("t")[0].as_py()
        side = whole.column("side").to_numpy() if whole.column("side").null_count == 0 else None
        for at, m in matrices(vector):
            for one in np.unique(label[at]):
                here = label[at] == one
                if here.sum() < 2:
                    continue
                own = at[here]
                signs = np.stack([np.frombuffer(x, "<i8") for x in whole.column("signs").take(pa.array(own)).to_pylist()]) if which else None
                got, links = verify(unit(m[here]), weight[own], None if side is None else side[own], signs, which, threshold)
                named = node[own]
                hit = np.flatnonzero(got)
                if len(hit):
                    a = np.r_[named[hit], named[[i for i, _ in links]]] if links else named[hit]
                    b = pa.array([None] * len(hit) + [int(named[j]) for _, j in links], pa.int64())
                    n = pa.array([*got[hit].tolist(), *[None] * len(links)], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(a), b, n], schema=_LINKS)

    rows = chosen.join(few(where), "node").select("key", "t", "side", "node", "label", "weight", "vector", "signs")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long, n long")


# step 4: answers


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links and component_id of every row of vectors (vec_id, embedding, label)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    hashes = [F.xxhash64(F.lit(i), "label", "vector").alias(f"h{i}") for i in (1, 2)]
    base = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), vector.alias("vector"))
    # equal vectors of a label: 128 bits of hash travel, the vectors don't
    same = through_disk(_usable(base.select("vec_id", "label", *hashes, "vector")), "vector-hashes")
    total = same.where("h1 IS NOT NULL").count()
    counts = same.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.count("*").alias("size"), F.min("vec_id").alias("first"))
    # a class is named by its smallest vec_id; without one, by its hash, above all identifiers
    many = through_disk(counts.where("size > 1").select("h1", "h2", "size", "first", _nameless("first").alias("node")), "vector-classes")
    n = total - (many.agg(F.sum(F.col("size") - 1)).first()[0] or 0)
    planes, tables = shape_of(n, threshold, recall)
    known = few(many)
    # of an equal vector the row with the smallest vec_id stands for all (one of them, if that identifier is repeated)
    chosen = base.where("label IS NOT NULL AND vector IS NOT NULL").select("*", *hashes).join(known, ["h1", "h2"], "left")
    single = chosen.where("size IS NULL").select(_nameless("vec_id").alias("node"), "label", F.lit(1).cast("long").alias("weight"), "vector")
    copied = chosen.where(F.col("size").isNotNull() & F.col("vec_id").eqNullSafe(F.col("first"))).dropDuplicates(["h1", "h2"])
    chosen = single.unionByName(copied.select("node", "label", F.col("size").alias("weight"), "vector"))
    drawn = through_disk(sketches(chosen, planes, tables), "sketches")
    linked = through_disk(components(candidates(drawn, n, tables, threshold, block)), "candidates")
    within = max(128, VALUES // (drawn.agg(F.max("dim")).first()[0] or 1))
    most, block = min(most, within), min(block, within)
    found = through_disk(verified(chosen, groups(drawn, linked, n, tables, most, block), threshold), "vector-links")
    others = found.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    joined = others.join(components(found.where("b IS NOT NULL").select("a", "b")), "node", "left")
    joined = through_disk(joined.select("node", "others", "component"), "vector-answers")
    out = same.join(known, ["h1", "h2"], "left").withColumn("node", F.when(F.col("h1").isNotNull(), F.coalesce("node", _nameless("vec_id"))))
    out = out.join(few(joined), "node", "left")
    links = F.coalesce("size", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))
    # the smallest node that can be reached is an identifier wherever one can be reached
    own = F.coalesce("component", "first", "vec_id")
    return out.select("vec_id", links.cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), own).alias("component_id"))


def _nameless(name: str) -> Column:
    """The identifier, or a number above all that are likely if there is none."""
    return F.coalesce(F.col(name), F.lit(1 << 62) + F.shiftrightunsigned("h1", 3))


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id, h1 and h2 of rows (vec_id, label, h1, h2, vector); the hashes null where the vector can't link."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = np.zeros(batch.num_rows, bool)
            for at, _ in matrices(batch.column(4)):
                ok[at] = True
            ok &= batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            ok = pa.array(ok)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pc.if_else(ok, batch.column(i), None) for i in (2, 3))], ["vec_id", "h1", "h2"])

        return step

    return by_rows(rows, make, "vec_id long, h1 long, h2 long")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: DuckDB: all pairs of a label, and reachability by a recursion.
OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
