"""A Merkle tree over a dataset: a digest of every row, a root of every source, one root of all.

Rows are hashed where they stand; only digests travel.  They are numbered in each source by ranges, not by one window of
a source, so a source may hold any share of the rows.  ``BLOCK`` consecutive nodes (three levels of sixteen) are then one
ordered array, which higher-order functions collapse level by level: ``sequence`` counts the runs of a level, ``transform``
and ``slice`` hash each, ``aggregate`` carries the levels.  The roots of blocks are the nodes of the next round, until each
source has one block; the roots of sources are collapsed in the same way.  Going down again each block learns what stands
beside its root in the blocks above, a few thousand bytes, and answers for its leaves.

Cases: a null in any column is hashed as ``-``, an empty text as ``0:``; very long texts are hashed whole; rows without a
doc_id come first in their source, equal doc_ids are ordered by their leaves, so repeated rows have a leaf each and equal
ones differ in their place only; rows without a source are a source of their own, the first; an empty table has no root
and gives no rows; columns other than the five are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, numbered, table, through_disk

#: Nodes that become one, levels of a block, and nodes of a block.
FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
#: Sources whose roots (some 200 bytes each in a hash table) are sent to all tasks at most.
BROADCAST_ROOTS = 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon and its text, so that no two rows are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def row_leaf(text: Column | None = None) -> Column:
    """The leaf of a row of documents (with another text in place of its own)."""
    return leaf(F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text") if text is None else text)


def joined(nodes: Column, start: Column, length: Column) -> Column:
    """Digests one after another, from a place (from 0)."""
    return F.array_join(F.slice(nodes, start + 1, F.greatest(length, F.lit(0))), "")


def collapse(nodes: Column) -> Column:
    """The next level: the digest of every run of sixteen nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(joined(nodes, i * FAN, F.lit(FAN))))


def levels(nodes: Column, height: Column) -> Column:
    """The nodes and ``height`` levels above them, an array of each."""
    steps = F.slice(F.array(*map(F.lit, range(LEVELS))), F.lit(1), height)
    return F.aggregate(steps, F.array(nodes), lambda done, _: F.concat(done, F.array(collapse(F.element_at(done, -1)))))


def height(nodes: Column, alone: Column) -> Column:
    """Levels of a block: all, or, if it is its group's only one, as many as leave one node."""
    n = F.size(nodes)
    least = F.when(n <= 1, 0)
    for k in range(1, LEVELS):
        least = least.when(n <= FAN**k, k)
    return F.when(alone, least.otherwise(LEVELS)).otherwise(LEVELS)


def beside(levels: Column, place: Column) -> Column:
    """What stands beside a node on its way up its block: (left, right) of each level, either may be empty."""

    def step(done: Column, nodes: Column) -> Column:
        at = done["at"]
        own = at % FAN
        pair = F.struct(joined(nodes, at - own, own).alias("left"), joined(nodes, at + 1, FAN - 1 - own).alias("right"))
        return F.struct(F.floor(at / FAN).cast("int").alias("at"), F.concat(done["way"], F.array(pair)).alias("way"))

    inner = F.slice(levels, F.lit(1), F.size(levels) - 1)  # the block's root has nothing beside it here
    empty = F.from_json(F.lit("[]"), _WAY)
    return F.aggregate(inner, F.struct(place.cast("int").alias("at"), empty.alias("way")), step)["way"]


def fold(node: Column, way: Column) -> Column:
    """The root that a node and what stands beside its way give."""
    return F.aggregate(way, node, lambda got, x: digest(F.concat(x["left"], got, x["right"])))


def proof(way: Column) -> Column:
    return digest(F.array_join(F.transform(way, lambda x: F.concat(x["left"], x["right"])), ""))


#: Blocks (their ways are some thousands of bytes each) that are sent to all tasks at most.
BROADCAST_WAYS = 4_000
_WAY = "array<struct<left:string,right:string>>"


def blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Nodes (tree, pos, members, node and what is carried with them) as blocks, written once: tree, block, members (blocks
    of the tree), rows (the nodes in order) and root."""
    one = F.struct("pos", "node", *carried)
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(one)).alias("rows"), F.ceil(F.max("members") / BLOCK).alias("members")
    )
    return through_disk(grouped.withColumn("root", F.element_at(F.element_at(_levels_of_block(), -1), 1)), "merkle-blocks")


def _levels_of_block() -> Column:
    nodes = F.col("rows.node")
    return levels(nodes, height(nodes, F.col("members") == 1))


def tree(nodes: DataFrame, *carried: str) -> list[DataFrame]:
    """Rounds of blocks from the leaves up, until each tree has one: a round has some thousandths of the last one's rows."""
    rounds = [blocks(nodes, *carried)]
    while not (more := rounds[-1].where("members > 1")).isEmpty():
        rounds.append(blocks(more.select("tree", F.col("block").alias("pos"), "members", F.col("root").alias("node"))))
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """tree and root of every tree."""
    return reduce(DataFrame.unionByName, (r.where("members = 1").select("tree", "root") for r in rounds))


def ways(rounds: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """tree, block and way of the lowest round's blocks: what stands beside the way from a block's root to the end.

    above: tree and way of the trees' roots, where they are nodes of another tree.
    """
    known = None
    for r in reversed(rounds):
        top = r.where("members = 1").select("tree", "block")
        top = top.withColumn("way", F.from_json(F.lit("[]"), _WAY)) if above is None else top.join(above, "tree")
        known = top if known is None else known.unionByName(top)
        if r is not rounds[0]:
            # a block's nodes are the blocks of the round below
            known = through_disk(below(r, known, lambda x, way: F.struct(x["pos"].alias("block"), way.alias("way"))), "merkle-ways")
    return known


def below(round_: DataFrame, known: DataFrame, answer) -> DataFrame:
    """tree and the fields that ``answer`` makes of each node of a round and of what stands beside its whole way."""
    known = F.broadcast(known) if known.limit(BROADCAST_WAYS + 1).count() <= BROADCAST_WAYS else known
    met = round_.join(known, ["tree", "block"]).withColumn("levels", _levels_of_block())

    def one(x: Column, i: Column) -> Column:
        whole = F.array(F.concat(beside(F.col("levels"), i), F.col("way")))
        return F.element_at(F.transform(whole, lambda way: answer(x, way)), 1)  # the way is made once

    return met.select("tree", F.inline(F.transform("rows", one)))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``tampered`` is a text to check in place of a row's own (null: its own is checked): the root is recomputed from that
    text's leaf and from what stands beside it in the tree of the rows as they are.
    """
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered != F.col("text"), row_leaf(tampered))
    # the name of a source's tree keeps the order of sources and is never null
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    leaves = docs.select(source.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), row_leaf().alias("node"), other.alias("other"))
    rounds = tree(numbered(leaves, "tree", "doc_id", "node"), "doc_id", "other")
    subroots = through_disk(roots(rounds), "merkle-subroots")
    tops = tree(numbered(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node")), "tree", "source"), "source")
    sources = below(tops[0], ways(tops), lambda x, way: F.struct(x["source"].alias("source"), way.alias("way")))
    sources = through_disk(sources.select(F.col("source").alias("tree"), "way"), "merkle-sources")
    answers = below(
        rounds[0], through_disk(ways(rounds, sources), "merkle-block-ways"),
        lambda x, way: F.struct(x["doc_id"].alias("doc_id"), x["node"].alias("leaf"), proof(way).alias("proof_sha256"), fold(F.coalesce(x["other"], x["node"]), way).alias("folded_root")),
    )
    known = few(subroots.withColumnRenamed("root", "subroot"), BROADCAST_ROOTS)
    answers = answers.join(known, "tree").crossJoin(F.broadcast(roots(tops).select("root")))
    return answers.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampers with the texts of the documents whose identifier's checksum five divides, for the check only."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), F.when(struck, lowered(F.col("text"))))


def _sql_levels(name: str, start: str, depth: int) -> str:
    """CTEs of the levels of trees over nodes (tree, pos, node): <name>0, <name>1 ... with what stands beside a node."""
    out = []
    for k in range(depth):
        source = start if k == 0 else f"SELECT DISTINCT tree, pos // {FAN} AS pos, sha256(l || node || r) AS node FROM {name}{k - 1} WHERE m > 1"
        run = f"PARTITION BY tree, pos // {FAN} ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}{k} AS (SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS m,
  coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({source}))""")
    return ",\n".join(out)


def _sql_way(name: str, base: str, key: str, depth: int) -> str:
    """CTEs <name>w0 ...: rows of ``base`` with proof, folded (a node on its way up) and own (the same of the row as it is)."""
    out = []
    for k in range(depth):
        before = base if k == 0 else f"{name}w{k - 1}"
        out.append(f"""{name}w{k} AS (SELECT b.* EXCLUDE (proof, folded, own), CASE WHEN x.m > 1 THEN proof || l || r ELSE proof END AS proof,
  CASE WHEN x.m > 1 THEN sha256(l || folded || r) ELSE folded END AS folded, CASE WHEN x.m > 1 THEN sha256(l || own || r) ELSE own END AS own
  FROM {before} b LEFT JOIN {name}{k} x ON x.tree = {key} AND x.pos = b.pos // {FAN**k})""")
    return ",\n".join(out)


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
#: DuckDB: the same level by level; five levels hold a million rows of a source and a million sources.
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format("text")} AS leaf,
  CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {_LEAF.format("text")} END AS folded FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS own, '' AS proof FROM d),
{_sql_levels("n", "SELECT tree, pos, leaf AS node FROM p", 5)},
{_sql_way("n", "p", "b.tree", 5)},
s AS (SELECT DISTINCT tree AS source, own AS node FROM nw4),
t AS (SELECT *, 'all' AS tree, row_number() OVER (ORDER BY encode(source)) - 1 AS pos FROM s),
{_sql_levels("a", "SELECT tree, pos, node FROM t", 5)},
u AS (SELECT n.* EXCLUDE (tree, pos), t.pos, own AS subroot FROM nw4 n JOIN t ON t.source = n.tree),
{_sql_way("a", "u", "'all'", 5)}
SELECT doc_id, leaf, subroot, own AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = own AS verified FROM aw4
"""
