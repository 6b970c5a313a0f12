"""SimHash near-duplicates: deletion-variant signatures, equality of keys, verification, connected components.

A fingerprint of 64 bits is cut into two halves: of two fingerprints that differ in at most three bits, one half
differs in at most one.  Each half therefore gets as keys itself and its variants with one bit as a wildcard, of which
those with a set bit deleted suffice; two fingerprints within the distance share at least one key.  Rows with equal
keys meet in one place and every pair is verified there by the bits that differ.  A fingerprint enters once, however many
documents have it, so a key's group holds different fingerprints only, and of a group only a spanning forest of its links
leaves the task, never all pairs.  A key with more than ``BLOCK`` fingerprints is dealt over pairs of blocks.

Cases: a null or wordless text has fingerprint 0 and is linked like any other; very long texts are read as a whole, their
shingles hashed part by part; fewer words than a shingle has make one shingle; repeated documents and identifiers share a fingerprint and component; rows without an identifier are answered
with a null component; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_rows, dealt, few, hot_keys, slices, table, through_disk, utf8
from .components import components

SEED, DISTANCE, SHINGLE = 42, 3, 3
#: Different fingerprints of a key that meet in one task at most (times two).
BLOCK = 16_384
#: Shingles (8 bytes each) of a block of candidates; two blocks are compared in a task.
BLOCK_SHINGLES = 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(grams)
    for at in range(0, n, 1 << 16):
        part = grams[at : at + (1 << 16)]
        h = np.fromiter((digest(g, SEED) for g in part), "<u8", len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row; no shuffle."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

        return step

    return by_rows(docs.select("doc_id", "text"), make, "doc_id long, fp long")


def wide_fingerprint(text: bytes, shingle: int, lanes: int) -> np.ndarray:
    """A fingerprint of 64 bits a lane, as numbers, over XXH3 hashes of the different shingles."""
    words = text.lower().split()
    grams = list(set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))) if len(words) >= shingle else [b" ".join(words)] * bool(words)
    digest, counts, n = xxhash.xxh3_128_digest, np.zeros(64 * lanes, np.int64), len(grams)
    for at in range(0, n, 1 << 15):
        part = grams[at : at + (1 << 15)]
        h = np.concatenate([np.frombuffer(b"".join(digest(g, seed) for g in part), np.uint8).reshape(-1, 16) for seed in range(-(-lanes // 2))], axis=1)
        counts += np.unpackbits(h[:, : 8 * lanes], axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n).view("<u8")


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the different shingles, in order; fewer words than a shingle has make one."""
    words = text.lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), "<u8"))


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A key a band: the smallest hashes under two orders; sets alike by s share it in s * s of the bands."""
    if not len(hashes):
        return np.zeros(bands, np.uint64)
    least = np.array([(hashes * np.uint64(xxhash.xxh3_64_intdigest(b"order", i) | 1)).min() for i in range(2 * bands)])
    return least[::2] * np.uint64(0x9E3779B97F4A7C15) + least[1::2]


def variants(fp: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints and the index of the fingerprint that each is of.

    Keys of a half are the half itself and what is left of it when one of its set bits is deleted: of two halves that
    differ in one bit, one is the other without it.  Lane and half stand in the key's upper bits.
    """
    keys, rows = [], []
    every = np.arange(len(fp))
    for half in (0, 1):
        value = fp >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(2 * lane + half) << np.uint64(32)
        keys.append(value | tag)
        rows.append(every)
        for bit in range(32):
            one = np.uint64(1 << bit)
            has = np.flatnonzero(value & one)
            keys.append((value[has] ^ one) | tag)
            rows.append(has)
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")  # a fingerprint's keys side by side pack better
    return keys[order], rows[order]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between rows of fingerprints (rows by lanes)."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _forest(checks: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Indices of links that connect what is connected by links within ``most`` bits: a breadth-first search whose
    frontier looks only at what is not reached yet."""
    left, links = np.arange(len(checks)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _apart(checks[left], checks[at]) <= most
            if near.any():
                new = left[near]
                links += [(at, x) for x in new]
                queue += list(new)
                left = left[~near]
    return links


def link(classes: DataFrame, keys: list[str], checks: list[str], distance: int, bands: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """classes: fingerprints, one row a different set of them.

    Rows meet if one half of one of the ``keys`` differs in at most one bit or one of the ``bands`` is equal; they are
    linked if the ``checks`` together differ in at most ``distance`` bits.  Gives links (a, b) between first checks (the nodes): enough of them to connect
    all that the verified links connect.
    """
    n, m, more = len(keys), len(checks), len(bands)

    def spread():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [variants(batch.column(i).to_numpy().view(np.uint64), i) for i in range(n)]
            found += [(batch.column(i).to_numpy().view(np.uint64), np.arange(batch.num_rows)) for i in range(n + m, n + m + more)]
            rows = np.concatenate([r for _, r in found])
            cols = [np.concatenate([k for k, _ in found]).view(np.int64), *(batch.column(i).to_numpy()[rows] for i in range(n, n + m))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", *(f"c{i}" for i in range(m))])

        return step

    def only_keys():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [variants(batch.column(i).to_numpy().view(np.uint64), i)[0] for i in range(n)]
            found += [batch.column(i).to_numpy().view(np.uint64) for i in range(n + m, n + m + more)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

        return step

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the last key, which may go on in the next batch
        for batch in batches:
            got = [batch.column(i).to_numpy() for i in range(1 + m)]
            last = int(np.searchsorted(got[0], got[0][-1]))
            if held and held[0][0][0] == got[0][-1]:
                held.append(got)
                continue
            yield from _pairs([np.concatenate(x) for x in zip(*held, [x[:last] for x in got], strict=True)], distance)
            held = [[x[last:] for x in got]]
        if held:
            yield from _pairs([np.concatenate(x) for x in zip(*held, strict=True)], distance)

    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)] + [F.col(c).alias(f"c{i}") for i, c in enumerate(checks)] + [F.col(c).alias(f"m{i}") for i, c in enumerate(bands)]
    known = classes.select(*columns)
    rows = by_rows(known, spread, ", ".join(["key long", *(f"c{i} long" for i in range(m))]))
    if known.count() > block and (hot := hot_keys(by_rows(known, only_keys, "key long"), block)) is not None:
        rows = dealt(rows.withColumn("node", F.col("c0")), hot, "key").select("key", *(f"c{i}" for i in range(m)))
    # keys of one fingerprint only are the rule; sorting lets a task hold one key's rows and not a whole partition
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def _pairs(got: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    key, node = got[:2]  # the first check names the node
    if len(key) < 2:
        return
    checks = np.stack(got[1:], axis=1).view(np.uint64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    two = starts[sizes == 2]
    ok = _apart(checks[two], checks[two + 1]) <= most
    a, b = [node[two][ok]], [node[two + 1][ok]]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        links = _forest(checks[s : s + n], most)
        if links:
            x, y = np.array(links).T
            a.append(node[s + x])
            b.append(node[s + y])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])


def _named(rows: DataFrame, prints: list[str], keys: list[str], checks: list[str], distance: int) -> DataFrame:
    """rows (doc_id and fingerprints, materialized) with component_id.

    Rows with an equal first check are a node (whether or not they share an identifier); a component's answer is the
    smallest doc_id of its nodes.
    """
    node = checks[0]
    classes = rows.where("doc_id IS NOT NULL").groupBy(*prints).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = through_disk(classes, "classes")
    firsts = classes.groupBy(F.col(node).alias("node")).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    return _answered(rows, firsts, link(classes, keys, checks, distance), node)


def _answered(rows: DataFrame, firsts: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """rows with component_id; firsts: each node's smallest doc_id (first) and number of rows (n)."""
    found = through_disk(components(links), "linked")
    least = found.join(firsts, "node").groupBy("component").agg(F.min("first").alias("least"))
    known = found.join(least, "component").select("node", "least")
    # a row alone in its node, and the node without a link, is its own component; only the others are looked up
    named = firsts.join(known, "node", "left").where("n > 1 OR least IS NOT NULL")
    named = through_disk(named.select(F.col("node").alias(node), F.coalesce("least", "first").alias("component_id")), "named")
    out = rows.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, node, "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row: fingerprints within ``distance`` bits."""
    if distance > 3:
        raise ValueError("two halves with one wildcard reach a distance of three bits")
    fps = through_disk(fingerprints(docs, shingle), "fingerprints")
    return _named(fps, ["fp"], ["fp"], ["fp"], distance)


#: For similar texts: words of a shingle that decides, the similarity (Jaccard) of these shingles, words of a shingle
#: that finds candidates, 64-bit lanes of either fingerprint, and keys of two smallest hashes that find candidates, too.
DECIDING, SIMILARITY, FINDING, LANES, DECIDING_LANES, BANDS = 5, 0.8, 1, 2, 2, 8


def similar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row (a hash of doc_id and text), doc_id and component_id of every row, for texts that are alike by ``similarity``
    or more in five-word shingles.

    Five-word fingerprints of such texts differ in more bits than halves with one wildcard can find, so fingerprints of
    their different words (of which an edit changes fewer) find the candidates: any of their halves within one bit, or
    one of the bands equal.  Candidates whose five-word fingerprints are clearly too far apart for that similarity are
    left out; of all others the sets of five-word shingles are compared.  A node is a different set of shingles.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * DECIDING_LANES
    most = math.ceil(bits * apart + 6 * math.sqrt(bits * apart * (1 - apart)))  # few shingles vary more than many
    keys, checks, bands = [f"k{i}" for i in range(LANES)], [f"v{i}" for i in range(DECIDING_LANES)], [f"m{i}" for i in range(BANDS)]
    prints = ["node", "size", *keys, *checks, *bands]

    def make():
        def one(text: bytes) -> np.ndarray:
            own = shingle_hashes(text, DECIDING)
            node = np.array([xxhash.xxh3_64_intdigest(own.tobytes()), len(own)], np.uint64)
            return np.concatenate([node, wide_fingerprint(text, FINDING, LANES), wide_fingerprint(text, DECIDING, DECIDING_LANES), band_keys(own, BANDS)])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            all_ = np.array([one(t) for t in utf8(batch.column(2))]).view(np.int64)
            cols = [batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(all_[:, i])) for i in range(all_.shape[1]))]
            return pa.RecordBatch.from_arrays(cols, ["row", "doc_id", *prints])

        return step

    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), "text")
    rows = through_disk(by_rows(texts, make, ", ".join(f"{c} long" for c in ("row", "doc_id", *prints))), "wide-fingerprints")
    classes = rows.where("doc_id IS NOT NULL").groupBy(*prints).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min(F.struct("row", "doc_id")).alias("of"))
    classes = through_disk(classes.select("*", "of.row", F.col("of.doc_id").alias("id")).drop("of"), "classes")
    near = through_disk(components(link(classes, keys, checks, most, tuple(bands))), "candidates")
    links = _compared(texts, classes, near.withColumnRenamed("node", checks[0]), checks[0], similarity)
    return _answered(rows, classes.select("node", "first", "n"), links, "node").select("row", "doc_id", "component_id")


def _compared(texts: DataFrame, classes: DataFrame, near: DataFrame, check: str, similarity: float) -> DataFrame:
    """Links (a, b) between nodes whose sets of shingles are alike by ``similarity``: enough of them to connect all that
    such links connect within a component of candidates (``near``, by the check; classes of an equal check are
    candidates, too).

    One text of a node travels.  A component with many shingles is cut into blocks and every pair of its blocks meets
    in a group, so no task holds more than two.
    """
    members = classes.select("node", "row", "id", "size", check).join(near, check, "left").withColumn("component", F.coalesce("component", check))
    sums = members.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("blocks")).where("n > 1")
    block, blocks = F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))), F.greatest("blocks", F.lit(1))
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: j != block)
    groups = F.when(blocks == 1, F.array(F.xxhash64("component"))).otherwise(F.transform(others, lambda j: F.xxhash64("component", F.least(block, j), F.greatest(block, j))))
    members = through_disk(members.join(sums, "component").select("row", F.col("id").alias("doc_id"), "node", groups.alias("groups")), "members")
    # if they are few, only the members' texts travel
    found = texts.join(few(members), ["row", "doc_id"]).select("groups", "node", "text")

    def make():
        seen = set()  # a row that the table repeats is sent once a task

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes = batch.column(1).to_pylist()
            new = [i for i, x in enumerate(nodes) if not (x in seen or seen.add(x))]
            batch = batch.take(pa.array(new, pa.int64()))
            sets = [shingle_hashes(t, DECIDING).tobytes() for t in utf8(batch.column(2))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["groups", "node", "shingles"])

        return step

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets, links = None, {}, []
        out = lambda x: pa.RecordBatch.from_arrays([pa.array([p[i] for p in x], pa.int64()) for i in (0, 1)], ["a", "b"])
        for whole in batches:
            for batch in slices(whole):
                for at, node, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at != group:
                        links += _alike(sets, similarity)
                        group, sets = at, {}
                        if len(links) > 10_000:
                            yield out(links)
                            links = []
                    sets[node] = np.frombuffer(shingles, "<u8")
        if links := links + _alike(sets, similarity):
            yield out(links)

    sets = by_rows(found, make, "groups array<long>, node long, shingles binary").select(F.explode("groups").alias("group"), "node", "shingles")
    return sets.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long")


def _alike(found: dict[int, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between nodes, given their sets, that connect what is connected by pairs alike by ``similarity``: a node is
    compared with all others, until those not yet compared are all connected."""
    nodes, sets = list(found), list(found.values())
    n, links = len(nodes), []
    if n < 2:
        return links
    sizes = np.array([len(x) for x in sets])
    if n == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return [(nodes[0], nodes[1])] if common / (sizes.sum() - common) >= similarity else links
    of, names = np.repeat(np.arange(n), sizes), np.unique(np.concatenate(sets), return_inverse=True)[1]
    order, begin = np.argsort(names, kind="stable"), np.r_[0, np.cumsum(sizes)]
    starts, have = np.r_[0, np.cumsum(np.bincount(names))], of[order]
    label, todo, at = np.arange(n), np.ones(n, bool), 0
    while True:
        todo[at] = False
        own = names[begin[at] : begin[at + 1]]
        many = starts[own + 1] - starts[own]
        places = np.repeat(starts[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(have[places], minlength=n)
        near = np.flatnonzero(common >= 1)
        near = near[common[near] / (sizes[at] + sizes[near] - common[near]) >= similarity]
        labels, first = np.unique(label[near], return_index=True)
        links += [(nodes[at], nodes[x]) for x in near[first[labels != label[at]]]]
        label[np.isin(label, labels)] = label[at]
        rest = np.flatnonzero(todo)
        others = rest[label[rest] != np.bincount(label[rest]).argmax()] if len(rest) else rest
        if not len(others):
            return links
        at = int(others[0])


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates, all columns: of each component of similar texts the row with the smallest
    identifier stays, once if it is repeated; rows without an identifier stay."""
    found = through_disk(similar(docs, similarity), "similar")
    name = "row"
    while name in docs.columns:
        name += "_"
    # a row is known by its hash and its identifier; if those that go are few, no text is shuffled
    gone = found.where("component_id <> doc_id").select(F.col("row").alias(name), "doc_id").distinct()
    kept = docs.withColumn(name, F.xxhash64("doc_id", "text")).join(few(gone), [name, "doc_id"], "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("row", "doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates([name, "doc_id"]).unionByName(kept.where("doc_id IS NULL"))
    return kept.select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
