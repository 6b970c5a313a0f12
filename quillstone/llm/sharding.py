"""Shards by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions only.

The ring has 65,536 places.  Each shard stands at many of them (its virtual nodes), a row at the place that its
identifier's digest says, and its home is the next shard clockwise.  A shard takes at most its capacity: places are served
in the order of their digests, what finds its home full goes on clockwise to the next shard with room.  With no slack the
capacities add up to the number of rows, so every shard ends full and counts are at most one apart; with a slack (a quarter,
say) fewer rows are displaced and fewer move when a shard is added, and no shard is above 1 + slack of the mean.

Only counts of places are balanced, in tables whose size the ring bounds whatever the rows are; rows are numbered within
their place by ranges (a place may hold any share of them) and joined with the runs of numbers that go to a shard, which
also give a row its slot without another shuffle.

Cases: rows without an identifier stand at one place and are spread from there like any others, so do repeated
identifiers (ordered by ``ties``, equal rows by where they stand); a null text has no bytes; very long texts are measured
whole and don't travel unless they are carried; an empty table gives no rows; other columns are carried in a struct, so
names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, table, through_disk

#: Places of the ring (four hexadecimal digits), virtual nodes of a shard and shards of the query.
PLACES, NODES, SHARDS = 1 << 16, 128, 40
#: Rows of one written file at most.
FILE_ROWS = 1 << 20


def place(name: Column) -> Column:
    return F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("int")


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """place, home (the next shard clockwise), turn (in which places are served) and node (the number of the virtual node
    that is met first) of all places."""
    stands = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("copy"))
    name = F.concat(F.lit("shard "), F.col("shard"), F.lit(" node "), F.col("copy")).cast("binary")
    stands = stands.select("shard", F.md5(name).alias("digest"), place(name).alias("place"))
    # of nodes at one place only the one with the smallest digest is met
    stands = stands.groupBy("place").agg(F.min_by("shard", "digest").alias("shard"))
    clockwise = F.array_sort(F.collect_list(F.struct("place", "shard")))
    arcs = stands.agg(clockwise.alias("stands")).select(F.posexplode("stands").alias("node", "at"), "stands")
    before = F.when(F.col("node") > 0, F.element_at("stands.place", F.greatest(F.col("node"), F.lit(1)))).otherwise(-1)
    arcs = arcs.select("node", F.col("at.shard").alias("home"), F.sequence(before + 1, F.col("at.place")).alias("places"), F.size("stands").alias("all"), F.element_at("stands.place", -1).alias("last"), F.element_at("stands.shard", 1).alias("first"))
    inner = arcs.select("node", "home", F.explode("places").alias("place"))
    # past the last node the ring begins again
    rest = arcs.where(f"node = all - 1 AND last < {PLACES - 1}").select(F.lit(0).alias("node"), F.col("first").alias("home"), F.explode(F.sequence(F.col("last") + 1, F.lit(PLACES - 1))).alias("place"))
    turn = F.md5(F.concat(F.lit("turn "), F.col("place")).cast("binary"))
    return inner.unionByName(rest).select("place", "home", "node", turn.alias("turn"))


def capacities(total: Column, shards: int, slack: float) -> Column:
    """The most rows of each shard: without slack the even shares, the first shards have one more if they don't come out."""
    even = F.sequence(F.lit(0), F.lit(shards - 1))
    if slack:
        return F.transform(even, lambda i: F.ceil(total * (1 + slack) / shards))
    return F.transform(even, lambda i: (F.floor(total / shards) + F.when(i < total % shards, 1).otherwise(0)).cast("long"))


def runs(counts: DataFrame, shards: int, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """Which of a place's rows go to which shard: place, start and end (numbers of rows), shard and slot (of the first).

    counts: place and n.  All tables here have a row a place at most, or one for each place that overflows and each shard
    that takes of it.
    """
    spark = counts.sparkSession
    met = through_disk(ring(spark, shards, nodes).join(counts, "place"), "ring")
    total = met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select(capacities(F.col("total"), shards, slack).alias("room"))
    served = Window.partitionBy("home").orderBy("turn")
    met = met.crossJoin(F.broadcast(total)).withColumn("before", F.sum("n").over(served) - F.col("n"))
    met = met.withColumn("kept", F.greatest(F.lit(0), F.least("n", F.element_at("room", F.col("home") + 1) - F.col("before"))))
    met = through_disk(met.drop("room"), "served")
    stands = ring(spark, shards, nodes).groupBy("node").agg(F.first("home").alias("home")).agg(F.array_sort(F.collect_list(F.struct("node", "home")))["home"].alias("clockwise"))
    over = met.where("kept < n").crossJoin(F.broadcast(stands))
    node = F.col("node")
    onward = F.array_distinct(F.concat(F.slice("clockwise", node + 1, F.size("clockwise")), F.slice("clockwise", F.lit(1), node)))
    over = over.select(F.struct("turn", "place", (F.col("n") - F.col("kept")).alias("n"), onward.alias("onward")).alias("x"))
    used = met.groupBy("home").agg(F.sum("kept").alias("used")).agg(F.map_from_entries(F.collect_list(F.struct("home", "used"))).alias("used"))
    room = total.crossJoin(used).select(F.transform("room", lambda r, i: r - F.coalesce(F.element_at("used", i), F.lit(0))).alias("room"))
    displaced = over.agg(F.array_sort(F.collect_list("x")).alias("over")).crossJoin(room).select(F.explode(_onward(F.col("over"), F.col("room"))["out"]).alias("x"))
    displaced = displaced.select("x.place", "x.hop", "x.shard", "x.n")
    pieces = met.where("kept > 0").select("place", F.lit(0).alias("hop"), F.col("home").alias("shard"), F.col("kept").alias("n")).unionByName(displaced)
    in_place, in_shard = Window.partitionBy("place").orderBy("hop"), Window.partitionBy("shard").orderBy("place", "hop")
    return through_disk(
        pieces.select("place", "shard", (F.sum("n").over(in_place) - F.col("n")).alias("start"), F.sum("n").over(in_place).alias("end"), (F.sum("n").over(in_shard) - F.col("n")).alias("slot")), "runs"
    )


def _onward(over: Column, room: Column) -> Column:
    """Serves the overflowing places one by one: each walks clockwise and takes what room it finds."""
    none = F.from_json(F.lit("[]"), "array<struct<place:int,hop:int,shard:int,n:bigint>>")

    def place_(done: Column, x: Column) -> Column:
        def stand(now: Column, shard: Column) -> Column:
            take = F.least(now["left"], F.element_at(now["room"], shard + 1))
            piece = F.struct(x["place"].alias("place"), (F.size(now["out"]) + 1).alias("hop"), shard.alias("shard"), take.alias("n"))
            after = F.struct(
                F.transform(now["room"], lambda r, i: F.when(i == shard, r - take).otherwise(r)).alias("room"), (now["left"] - take).alias("left"), F.concat(now["out"], F.array(piece)).alias("out")
            )
            return F.when(take > 0, after).otherwise(now)

        return F.aggregate(x["onward"], F.struct(done["room"].alias("room"), x["n"].alias("left"), done["out"].alias("out")), stand, lambda now: F.struct(now["room"].alias("room"), now["out"].alias("out")))

    return F.aggregate(over, F.struct(room.alias("room"), none.alias("out")), place_)


def assign(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = 0.0, key: str = "doc_id", ties: tuple[Column, ...] = ()) -> DataFrame:
    """docs with shard and slot (from 0, without gaps in each shard), its own columns in the struct ``row``.

    ``ties``: what orders rows with one key.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")
    named = {f"tie{i}": t for i, t in enumerate(ties)}
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), place(name).alias("place"), F.md5(name).alias("point"), *(t.alias(n) for n, t in named.items()))
    rows = numbered(rows, "place", "point", *named)
    to = runs(rows.groupBy("place").agg(F.count("*").alias("n")), shards, nodes, slack)
    # at most a row a place and each displaced run: the ring bounds it
    to = F.broadcast(to.withColumnRenamed("slot", "from"))
    met = rows.join(to, "place").where("pos >= start AND pos < end")
    return met.select("row", "shard", (F.col("from") + F.col("pos") - F.col("start")).alias("slot"))


def write_shards(assigned: DataFrame, at: str) -> DataFrame:
    """Writes the rows under at/_shard=<n>, in files of consecutive slots, and reads them back: their own columns, _slot and
    _shard."""
    rows = assigned.select("row.*", F.col("slot").alias("_slot"), F.col("shard").alias("_shard"))
    rows = rows.repartition("_shard", F.floor(F.col("_slot") / FILE_ROWS)).sortWithinPartitions("_shard", "_slot")
    rows.write.partitionBy("_shard").parquet(at)
    return assigned.sparkSession.read.parquet(at)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 16).cast("long"), F.crc32(text.cast("binary"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    placed = assign(docs, ties=(F.col("size"), F.col("text_crc32")))
    return placed.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB: the same, rows that find their home full walking on step by step; the checksum by a table of 256 made by rule.
OP13_SQL = f"""
WITH RECURSIVE c256 AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS point,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
d AS (SELECT doc_id, size, point, ('0x' || substr(point, 1, 4))::INT AS place,
  xor(4294967295, list_reduce([4294967295] || bytes, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) AS crc FROM b, c256),
p AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY point, size, crc) - 1 AS pos FROM d),
names AS (SELECT s::INT AS shard, md5('shard ' || s || ' node ' || c) AS digest FROM range({SHARDS}) t(s), range({NODES}) u(c)),
stands AS (SELECT place, min_by(shard, digest) AS shard, row_number() OVER (ORDER BY place) - 1 AS node FROM (SELECT *, ('0x' || substr(digest, 1, 4))::INT AS place FROM names) GROUP BY place),
counts AS (SELECT place, count(*) AS n, md5('turn ' || place) AS turn FROM p GROUP BY place),
met AS (SELECT c.*, coalesce(s.shard, z.shard) AS home, coalesce(s.node, 0) AS node FROM counts c ASOF LEFT JOIN stands s ON c.place <= s.place, (SELECT shard FROM stands WHERE node = 0) z),
caps AS (SELECT s::INT AS shard, t // {SHARDS} + (s < t % {SHARDS})::INT AS cap FROM range({SHARDS}) x(s), (SELECT count(*) AS t FROM documents)),
served AS (SELECT m.*, greatest(0, least(n, cap - (sum(n) OVER (PARTITION BY home ORDER BY turn) - n))) AS kept FROM met m JOIN caps ON home = shard),
over AS (SELECT place, node, n - kept AS n, row_number() OVER (ORDER BY turn) AS i FROM served WHERE kept < n),
hops AS (SELECT i, o.place, n, s.shard, min((s.node - o.node - 1 + v) % v) AS far FROM over o, stands s, (SELECT count(*) AS v FROM stands) WHERE s.node <> o.node GROUP BY ALL),
steps AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY i, far) AS k FROM hops),
room AS (SELECT list(cap - coalesce(u, 0) ORDER BY c.shard) AS room FROM caps c LEFT JOIN (SELECT home, sum(kept) AS u FROM served GROUP BY home) ON home = c.shard),
walk AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS i, 0::BIGINT AS rest, list_transform(room, lambda x: x::BIGINT) AS room, 0 AS place, 0 AS shard, 0::BIGINT AS n FROM room
  UNION ALL
  SELECT q.k, q.i, need - q.take, list_transform(q.room, lambda r, j: CASE WHEN j = q.shard + 1 THEN r - q.take ELSE r END), q.place, q.shard, q.take
  FROM (SELECT s.k, s.i, s.place, s.shard, w.room, (CASE WHEN s.i = w.i THEN w.rest ELSE s.n END)::BIGINT AS need, least(need, w.room[s.shard + 1])::BIGINT AS take FROM walk w JOIN steps s ON s.k = w.k + 1) q),
pieces AS (SELECT place, 0 AS hop, home AS shard, kept AS n FROM served WHERE kept > 0 UNION ALL SELECT place, k, shard, n FROM walk WHERE n > 0),
runs AS (SELECT place, shard, sum(n) OVER a - n AS first, sum(n) OVER a AS past, sum(n) OVER b - n AS slot FROM pieces WINDOW a AS (PARTITION BY place ORDER BY hop), b AS (PARTITION BY shard ORDER BY place, hop))
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard, (slot + pos - first)::BIGINT AS slot, NULL::INT AS grown_shard
FROM p JOIN runs USING (place) WHERE pos >= first AND pos < past
"""
