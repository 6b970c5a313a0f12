"""Benchmark decontamination by Wu-Manber search over words.

Every window of ten consecutive words of a benchmark item is a test string (an item of fewer words, but not none, is
one shorter string).  For each length of test string there are two tables: ``shift`` maps a block of up to three words
to the distance by which the search may jump ahead, and ``buckets`` maps the block that ends a test string to the
strings that end so, which are then compared word by word.  A block that stands in no test string lets the search jump
over as many words as a string has, less the block's own.

The benchmark is written to the shared folder in blocks of bounded size, and workers read their tables from there: it
never passes the driver, and a worker holds the tables of one block, which it keeps for the tasks that follow.  A
benchmark of one block is searched in one pass over the documents.  For a longer one there is a pass for each block, of
which only documents with hits come back (the ranges hit, by two hashes of the text), and these are joined to the
documents' counts of words; texts are never shuffled.

Cases: a null or wordless text has no words and no hits; very long texts are searched as a whole; an item without words
makes no test string; items without an identifier make hits but aren't named; repeated items count once by identifier;
repeated documents are answered row by row; an empty benchmark leaves every document clean, an empty table of documents
gives no rows; columns with other names pass through or are ignored.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, by_rows, few, filesystem, table, through_disk, utf8, work_dir

WINDOW = 10
#: Bytes of benchmark text whose tables a worker holds at a time; a longer benchmark is searched in blocks of this size.
BLOCK_TEXT = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Finds the occurrences of equally long word strings."""

    def __init__(self, length: int):
        self.length, self.size = length, min(3, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set]] = {}

    def add(self, words: tuple, item) -> None:
        b = self.size
        for end in range(b, self.length + 1):
            block = words[end - b : end]
            self.shift[block] = min(self.shift.get(block, self.length), self.length - end)
        self.buckets.setdefault(words[-b:], {}).setdefault(words, set()).add(item)

    def search(self, words: list[bytes], found) -> None:
        """Calls found(start, items) for every occurrence, from left to right."""
        b, m, n = self.size, self.length, len(words)
        jump, get, end = m - b + 1, self.shift.get, m
        while end <= n:
            step = get(tuple(words[end - b : end]), jump)
            if step:
                end += step
                continue
            strings = self.buckets[tuple(words[end - b : end])]
            if (items := strings.get(tuple(words[end - m : end]))) is not None:
                found(end - m, items)
            end += 1


def searchers(items: list[tuple]) -> list[WuManber]:
    """items: (identifier, text in UTF-8)."""
    by: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of(text)
        length = min(WINDOW, len(words))
        if length:
            s = by.setdefault(length, WuManber(length))
            for at in range(len(words) - length + 1):
                s.add(tuple(words[at : at + length]), item)
    return list(by.values())


def ranges_hit(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """The ranges of words that stand in any occurrence, apart and in order, and the items that occur."""
    ranges, items = [], set()
    for s in tables:

        def found(at: int, who: set, length: int = s.length) -> None:
            ranges.append((at, at + length))
            items.update(who)

        s.search(words, found)
    items.discard(None)
    return joined(ranges), items


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(words: list[bytes], tables: list[WuManber]) -> tuple[int, set]:
    """How many words stand in any occurrence, and the items that occur."""
    ranges, items = ranges_hit(words, tables)
    return sum(b - a for a, b in ranges), items


def write_blocks(benchmark: DataFrame, most: int = BLOCK_TEXT) -> list[str]:
    """The benchmark in the shared folder, a folder for each block of about ``most`` bytes of text (an item is never
    split); their paths."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")
    n = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // most)
    if not n:
        return []
    at = work_dir(benchmark.sparkSession, "benchmark")
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int").alias("block")
    rows.select("*", block).repartition(min(n, 200), "block").write.partitionBy("block").parquet(at)
    return [f"{at}/block={k}" for k in range(n)]


_held: dict[str, list[WuManber]] = {}


def tables_of(path: str) -> list[WuManber]:
    """The tables of a block; a worker keeps the last."""
    if path not in _held:
        _held.clear()
        system, root = filesystem(path)
        names = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))  # a block may be empty
        files = [pq.read_table(system.open_input_file(f.path), columns=["item_id", "text"]) for f in names if f.path.endswith(".parquet")]
        _held[path] = searchers([(r["item_id"], r["text"]) for f in files for r in f.to_pylist()])
    return _held[path]


def _identity(text: str = "text") -> list[Column]:
    return [F.xxhash64(F.lit(i), text).alias(f"h{i}") for i in (1, 2)]


def mark(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_TEXT) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted identifiers as text) of every row."""
    paths = write_blocks(benchmark, most)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if len(paths) <= 1:
        return by_rows(rows, lambda: _marker(tables_of(paths[0]) if paths else []), "doc_id long, n_words long, n_hit long, items array<string>")
    found = through_disk(_found(rows, paths).groupBy("h1", "h2").agg(F.collect_list("ranges").alias("ranges"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "hits")

    def count():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = pa.array([len(words_of(t)) for t in utf8(batch.column(1))], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), n, batch.column(2), batch.column(3)], ["doc_id", "n_words", "h1", "h2"])

        return step

    counted = by_rows(rows.select("doc_id", "text", *_identity()), count, "doc_id long, n_words long, h1 long, h2 long")
    # a text's ranges of all blocks, one after the other: how far each reaches beyond those before it
    ranges = F.array_sort(F.flatten("ranges"))
    covered = F.aggregate(
        ranges, F.struct(F.lit(0).alias("n"), F.lit(0).alias("reached")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], acc["reached"]))).alias("n"), F.greatest(r["b"], acc["reached"]).alias("reached")), lambda acc: acc["n"],
    )
    hit = found.select("h1", "h2", covered.cast("long").alias("n_hit"), "items")
    out = counted.join(hit, ["h1", "h2"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _marker(tables: list[WuManber]):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [words_of(t) for t in utf8(batch.column(1))]
        got = [hits(w, tables) for w in texts]
        cols = [pa.array([len(w) for w in texts], pa.int64()), pa.array([n for n, _ in got], pa.int64()), pa.array([sorted(items) for _, items in got], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_words", "n_hit", "items"])

    return step


def _found(rows: DataFrame, paths: list[str]) -> DataFrame:
    """h1, h2 (of the text), ranges and items of the texts that a block hits, a row for each such block."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def search(path: str):
        def make():
            tables = tables_of(path)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                got = [ranges_hit(words_of(t), tables) for t in utf8(batch.column(0))]
                hit = [i for i, (r, _) in enumerate(got) if r]
                ranges = pa.array([[{"a": a, "b": b} for a, b in got[i][0]] for i in hit], kind)
                h1, h2 = (batch.column(i).take(pa.array(hit, pa.int64())) for i in (1, 2))
                return pa.RecordBatch.from_arrays([h1, h2, ranges, pa.array([sorted(got[i][1]) for i in hit], pa.list_(pa.string()))], ["h1", "h2", "ranges", "items"])

            return step

        return by_rows(rows.select("text", *_identity()), make, "h1 long, h2 long, ranges array<struct<a int, b int>>, items array<string>")

    # copies of a text say the same
    return reduce(DataFrame.unionByName, (search(p).dropDuplicates(["h1", "h2"]) for p in paths))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most: int = BLOCK_TEXT) -> DataFrame:
    """The rows of docs in which no test string occurs, with all their columns."""
    paths = write_blocks(benchmark, most)
    if len(paths) <= 1:
        schema, at = docs.schema, docs.columns.index("text")

        def make():
            tables = tables_of(paths[0]) if paths else []

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                clean = [not hits(words_of(t), tables)[0] for t in utf8(batch.column(at))]
                return batch.filter(pa.array(clean, pa.bool_())) if not all(clean) else batch

            return step

        return by_rows(docs, make, schema)
    h1, h2 = "h1", "h2"
    while {h1, h2} & set(docs.columns):
        h1, h2 = f"{h1}_", f"{h2}_"
    hit = through_disk(_found(docs.select("text"), paths).select(F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct(), "hits")
    own = docs.select("*", *(c.alias(n) for c, n in zip(_identity(), (h1, h2), strict=True)))
    return own.join(few(hit), [h1, h2], "left_anti").select(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: DuckDB: the same by exploding windows and joining them on their words.
OP4_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hit AS (
  SELECT r, i, m, item_id FROM dw JOIN bw USING (m, s)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
