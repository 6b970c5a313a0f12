"""A substring index: three-letter pieces of the searched texts, and the items that have them.

A row is a piece, a block of 4,096 neighbouring identifiers and those of the block whose text has the piece; each batch of
items gives a run of rows, sorted by piece (of a block that lies in several runs, each has its own).  A search reads
the rows of some pieces of its terms' literal stretches (between wildcards), brings them together by block, and works the
boolean tree over them as sets.  What comes out holds every match and some more; the texts of these items alone are then
looked at.  A NOT, or a term without a stretch of three letters, may hold for any item: where such a branch decides, there
are no candidates and all texts are read.

Letters are compared in ASCII case, as LIKE does.  Items without a name have no pieces, since nothing finds them.  Items that
have changed or gone since leave their old pieces, which cost a look at an item or none.  Very long texts are taken whole;
repeated identifiers count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import boolexpr
from . import filters, fulltext, ingest

#: Letters of a piece, bits of an identifier within its block, buckets of pieces, and candidates that become constants.
SIZE, BITS, BUCKETS, FEW = 3, 12, 64, 5_000
#: Bytes of text, and with them about how many pieces, that are brought together at once.
TEXTS, PIECES = 8 << 20, 4_000_000


def pieces(text: str) -> np.ndarray:
    """The different pieces of a text as numbers."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters)
    if len(letters) < SIZE:
        return np.zeros(0, np.int64)
    return np.unique(letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def grams(items: DataFrame) -> DataFrame:
    """bucket, gram, block and ids (the lower bits, ascending) of items (id, name, description, stepsText).  The texts of a
    batch are brought together where they are, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in fulltext.slices(whole, TEXTS):
                found, ids, n = [], [], 0
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if text.is_valid and i is not None:
                        found.append(pieces(text.as_py()))
                        ids.append(i)
                        n += len(found[-1])
                        if n >= PIECES:
                            yield _together(found, ids)
                            found, ids, n = [], [], 0
                if n:
                    yield _together(found, ids)

    rows = items.select(F.col("id").cast("long").alias("id"), filters.searched_text().alias("text")).mapInArrow(run, "gram long, block long, ids array<smallint>")
    return rows.select(_bucket(F.col("gram")).alias("bucket"), "gram", "block", "ids")


def _together(found: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
    """gram, block and ids of the pieces of some texts, sorted by gram and block."""
    by_id = np.argsort(np.array(ids, np.int64), kind="stable")
    gram = np.concatenate([found[i] for i in by_id])
    own = np.repeat(np.array(ids, np.int64)[by_id], [len(found[i]) for i in by_id])
    order = np.argsort(gram, kind="stable")
    gram, own = gram[order], own[order]
    again = np.append(False, (gram[1:] == gram[:-1]) & (own[1:] == own[:-1]))  # of a repeated identifier
    gram, own = gram[~again], own[~again]
    block = own >> BITS
    first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])))
    lists = pa.ListArray.from_arrays(np.append(first, len(own)).astype(np.int32), pa.array((own & ((1 << BITS) - 1)).astype(np.int16)))
    return pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(block[first]), lists], ["gram", "block", "ids"])


def wanted(term: str, escape: bool = False) -> list[int]:
    """Some pieces that every text with the term has: side by side, and the last of each literal stretch."""
    out = []
    for stretch in [term] if escape else re.split("[%_]", term):
        starts = sorted({*range(0, len(stretch) - SIZE + 1, SIZE), len(stretch) - SIZE} - {*range(-SIZE, 0)})
        out += [int(pieces(stretch[s : s + SIZE])[0]) for s in starts]
    return out


def _having(node: boolexpr.Node, escape: bool, used: set[int]) -> Column | None:
    """The identifiers of a block that may match, from a map of pieces to identifiers; None for any."""
    if isinstance(node, boolexpr.Not):
        return None
    if isinstance(node, boolexpr.Term):
        found = wanted(node.text, escape)
        used.update(found)
        sets = [F.coalesce(F.element_at("has", F.lit(g)), F.array().cast("array<smallint>")) for g in dict.fromkeys(found)]
        return reduce(F.array_intersect, sets) if sets else None
    parts = [_having(c, escape, used) for c in node.children]
    if isinstance(node, boolexpr.Or):
        return None if any(p is None for p in parts) else reduce(F.array_union, parts)
    parts = [p for p in parts if p is not None]
    return reduce(F.array_intersect, parts) if parts else None


def candidates(table: DataFrame, tree: boolexpr.Node, escape: bool = False) -> DataFrame | None:
    """id of the items that may match; None if any may."""
    used: set[int] = set()
    having = _having(tree, escape, used)
    if having is None:
        return None
    folders = reduce(Column.__or__, (F.col("bucket") == _bucket(F.lit(g)) for g in sorted(used)))
    rows = table.where(folders & F.col("gram").isin(*sorted(used)))
    rows = rows.groupBy("block", "gram").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))  # of all parts
    blocks = rows.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("has"))
    return blocks.select("block", F.explode(having).alias("own")).select((F.shiftleft("block", BITS) + F.col("own")).alias("id"))


def narrowed(items: DataFrame, table: DataFrame | None, tree: boolexpr.Node, escape: bool = False) -> DataFrame:
    """items, or of them those that may match by the index."""
    found = None if table is None else candidates(table, tree, escape)
    return items if found is None else ingest.among(items, found, "id", FEW)
