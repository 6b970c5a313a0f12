"""Full-text search with BM25 ranking, over token arrays or stored postings.

``index`` has one row an item: its terms in each column and their number.  A query over it is two scans (one for the
counts that weights need, one for the scores), both with built-in functions, and a top-k.

``Postings`` is the index turned around and stored: a row for each term, item and column, in runs of some thousand items
that are each sorted by term.  A query then reads those pages of the runs that hold its own terms, groups the hits of their
items and takes the top-k.  Both give the same answers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem, text
from ..plans import boolexpr

if TYPE_CHECKING:
    from .impacts import Early

#: The usual constants of BM25, the least weight of a term, and the length of a leg.
K1, B, LEAST_IDF, LEG = 1.2, 0.75, 1e-6, 200
COLUMNS = ("name", "description", "stepsText")
#: Bytes of token arrays that are turned around at once, as one sorted run; rows of it that are given out at a time.
RUN, OUT = 16 << 20, 100_000


def index(items: DataFrame, stemmed: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, terms of each column (t_name ...), dl (terms in all columns), and the columns to keep for filters."""
    terms = {f"t_{c}": text.tokens(F.col(c)) for c in COLUMNS}
    if stemmed:
        terms = {k: stem.analyze(v) for k, v in terms.items()}
    rows = items.select("id", *keep, once(**terms))
    return rows.withColumn("dl", sum(F.size(k) for k in terms).cast("long"))


def once(**columns: Column) -> Column:
    """The columns, computed once a row: a generator of one row, into which later expressions aren't copied."""
    return F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))


def occurrences(terms: Column, phrase: list[str]) -> Column:
    """How often the phrase's terms stand side by side; 0 for an empty phrase."""
    k = len(phrase)
    if not k:
        return F.lit(0)
    if k == 1:
        return F.size(F.filter(terms, lambda t: t == phrase[0]))
    # whether the phrase starts at each place, word by word; past the end there is null, which is no match
    here = F.transform(terms, lambda t: t == phrase[0])
    for i, word in enumerate(phrase[1:], 1):
        here = _also(here, terms, i, word)
    return F.when((F.size(terms) >= k) & F.array_contains(terms, phrase[0]), F.size(F.filter(here, lambda x: x))).otherwise(0)


def _also(here: Column, terms: Column, i: int, word: str) -> Column:
    later = F.slice(terms, i + 1, F.greatest(F.size(terms), F.lit(1)))
    return F.zip_with(here, later, lambda x, t: x & (t == word))


class _Compiled:
    """A tree over columns h0, h1 ... (occurrences of its phrases)."""

    def __init__(self, tree: boolexpr.Node, analyze, compat: bool):
        self.analyze, self.compat, self.phrases = analyze, compat, []
        self.match, self.score = self.build(tree)

    def phrase(self, words: str) -> int | None:
        terms = self.analyze(words)
        if not terms:
            return None
        if terms not in self.phrases:
            self.phrases.append(terms)
        return self.phrases.index(terms)

    def build(self, node: boolexpr.Node) -> tuple[Column | None, Column]:
        """(whether it matches, what it adds); no condition at all for a phrase without terms."""
        if isinstance(node, boolexpr.Term):
            n = self.phrase(node.text)
            return (None, F.lit(0.0)) if n is None else (F.col(f"h{n}") > 0, self.weight(n))
        if isinstance(node, boolexpr.Or):
            parts = [p for p in map(self.build, node.children) if p[0] is not None]
            if not parts:
                return None, F.lit(0.0)
            match, score = parts[0][0], F.when(parts[0][0], parts[0][1]).otherwise(0.0)
            for m, s in parts[1:]:
                match, score = match | m, score + F.when(m, s).otherwise(0.0)
            return match, score
        positive = [self.build(c) for c in node.children if not isinstance(c, boolexpr.Not)]
        if any(m is None for m, _ in positive):
            return None, F.lit(0.0)
        match, score = positive[0]
        for m, s in positive[1:]:
            match, score = match & m, score + s
        for c in node.children:
            if isinstance(c, boolexpr.Not):
                match = self.without(match, c.child)
        return match, F.when(match, score).otherwise(0.0)

    def without(self, match: Column, node: boolexpr.Node) -> Column:
        if self.compat and isinstance(node, boolexpr.And):
            # unbracketed, as "a NOT b AND c" was once read: what the negated branch excludes is taken off, too
            for c in node.children:
                match = self.without(match, c.child if isinstance(c, boolexpr.Not) else c)
            return match
        m = self.build(node)[0]
        return match if m is None else match & ~m

    def weight(self, n: int) -> Column:
        f = F.col(f"h{n}").cast("double")
        idf = F.greatest(F.log((F.col("rows_in_index") - F.col(f"n{n}") + 0.5) / (F.col(f"n{n}") + 0.5)), F.lit(LEAST_IDF))
        return -(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("mean_length"))))


def search(idx: DataFrame | Postings, tree: boolexpr.Node, field: str = "all", where: Column | None = None, limit: int | None = LEG, stemmed: bool = True, compat: bool = False) -> DataFrame:
    """id and bm25 (smaller is better) of the best ``limit`` matches; ties by id.

    ``where`` is applied before the limit; it may use the columns that the index keeps (with postings: of their items).
    A tree that an index can't answer (see ``boolexpr.searchable``) gives no rows.  ``field``: "all" or "name".
    """
    none = (idx.table if isinstance(idx, Postings) else idx).select("id", F.lit(0.0).alias("bm25")).where("false")
    if not boolexpr.searchable(tree):
        return none
    plan = _Compiled(tree, stem.analyze_phrase if stemmed else plain_phrase, compat)
    if plan.match is None:
        return none
    columns = ("name",) if field == "name" else COLUMNS
    counts = [F.count_if(F.col(f"h{i}") > 0).alias(f"n{i}") for i in range(len(plan.phrases))]
    # one row of counts: a bound for broadcasting that no data can break
    words = _words(tree)
    if isinstance(idx, Postings) and idx.early is not None and limit is not None and where is None and field == "all" and words and all(len(p) == 1 for p in plan.phrases):
        size = idx.stats.first()
        times = Counter(t for w in words for t in plan.analyze(w))
        ids, n = idx.early.candidates(times, size.rows_in_index, size.mean_length, limit, idx.buckets)
        if ids is not None:
            numbers = {"rows_in_index": size.rows_in_index, "mean_length": size.mean_length} | {f"n{i}": n[p[0]] for i, p in enumerate(plan.phrases)}
            rows = idx.early.rows(ids).select("id", "dl", once(**{f"h{i}": sum(occurrences(F.col(f"t_{c}"), p) for c in columns) for i, p in enumerate(plan.phrases)}))
            rows = rows.where(plan.match).withColumns({k: F.lit(v) for k, v in numbers.items()})
            return rows.select("id", plan.score.alias("bm25")).orderBy("bm25", "id").limit(limit)
    if isinstance(idx, Postings):
        seen = idx.hits(plan.phrases, columns)
        stats = seen.agg(*counts).crossJoin(F.broadcast(idx.stats))
        found = seen.where(plan.match)
        found = found if where is None else found.join(idx.items.where(where).select("id"), "id", "left_semi")
    else:
        seen = idx.select("*", once(**{f"h{i}": sum(occurrences(F.col(f"t_{c}"), p) for c in columns) for i, p in enumerate(plan.phrases)}))
        stats = seen.agg(F.count("*").alias("rows_in_index"), (F.sum("dl") / F.count("*")).alias("mean_length"), *counts)
        found = seen.where(plan.match if where is None else plan.match & where)
    scored = found.crossJoin(F.broadcast(stats)).select("id", plan.score.alias("bm25"))
    return scored.orderBy("bm25", "id").limit(limit) if limit is not None else scored


def _words(tree: boolexpr.Node) -> list[str]:
    """The words of an OR of words only; none of any other tree."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, boolexpr.Or):
            todo += node.children
        elif isinstance(node, boolexpr.Term):
            out.append(node.text)
        else:
            return []
    return out


def plain_phrase(words: str) -> list[str]:
    import unicodedata

    return "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in words.lower()).split()


def slices(batch: pa.RecordBatch, most: int = RUN) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, as many as keep each below about ``most`` bytes, of equally many rows."""
    step = max(1, -(-batch.num_rows // max(1, -(-batch.nbytes // most))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def tokens_of(batch: pa.RecordBatch, columns) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All terms of some list columns, the row that each stands in and its place in the row's list."""
    words, parents, places = [], [], []
    for c in columns:
        lists = batch.column(c)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words.append(lists.flatten())
        parents.append(np.repeat(np.arange(batch.num_rows, dtype=np.int32), n))
        place = np.arange(n.sum(), dtype=np.int32)
        place -= np.repeat((n.cumsum() - n).astype(np.int32), n)
        places.append(place)
    if len(words) == 1:
        return words[0], parents[0], places[0]
    return pa.concat_arrays(words), np.concatenate(parents), np.concatenate(places)


def grouped(words: pa.Array, parent: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Equal terms of one row brought together, sorted by term and then row: codes and dictionary of the terms, the order,
    where in it each group begins, and how large it is."""
    encoded = words.dictionary_encode()
    by_term = pc.sort_indices(encoded.dictionary).to_numpy()
    place = np.empty(len(by_term), np.int32)
    place[by_term] = np.arange(len(by_term), dtype=np.int32)
    codes = place[encoded.indices.to_numpy(zero_copy_only=False)]
    dictionary = encoded.dictionary.take(pa.array(by_term))
    del encoded
    key = codes.astype(np.int64)
    key <<= 32
    key |= parent
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    fresh = np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1])
    del key
    first = np.flatnonzero(fresh)
    return codes, dictionary, order, first, np.diff(first, append=len(order))


def turned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of id, dl and the columns' terms turned around: each column's postings sorted by term, at most ``OUT`` at a time."""
    for i, field in enumerate(COLUMNS, 2):
        words, parent, place = tokens_of(batch, [i])
        codes, dictionary, order, first, n = grouped(words, parent)
        for at in range(0, len(first), OUT):
            begin, size = first[at : at + OUT], n[at : at + OUT]
            inside = order[begin[0] : begin[-1] + size[-1]]
            own = pa.array(parent[order[begin]])
            positions = pa.ListArray.from_arrays(np.append(begin - begin[0], len(inside)).astype(np.int32), pa.array(place[inside]))
            columns = [dictionary.take(pa.array(codes[order[begin]])), batch.column(0).take(own), pa.array([field]).take(pa.array(np.zeros(len(begin), np.int64))), batch.column(1).take(own), pa.array(size.astype(np.int32)), positions]
            yield pa.RecordBatch.from_arrays(columns, ["term", "id", "field", "dl", "n", "positions"])
        del words, parent, place, codes, dictionary, order, first, n


def postings(idx: DataFrame, buckets: int = 256) -> DataFrame:
    """The index turned around: bucket, term, id, field, dl, n (how often) and the ascending positions of the term in the
    field.  A row holds all terms of its item, so it is turned around by itself, without a shuffle; the items of a batch
    come out sorted by term, a run of about ``RUN`` bytes of tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield from turned(batch)
                pa.default_memory_pool().release_unused()  # the worker lives on, and others stand beside it

    rows = idx.select("id", "dl", *(f"t_{c}" for c in COLUMNS)).mapInArrow(run, "term string, id long, field string, dl long, n int, positions array<int>")
    return rows.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "id", "field", "dl", "n", "positions")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def in_buckets(terms: list[str], buckets: int) -> Column:
    """Whether a row's bucket is that of one of the terms: constants, so only these folders are read."""
    return reduce(Column.__or__, (F.col("bucket") == bucket_of(F.lit(t), buckets) for t in dict.fromkeys(terms)), F.lit(False))


def buckets_for(rows: int) -> int:
    """Buckets for so many items: 16, and 32 from a million on.  Each task writes a file of each, and the pages of a file
    that hold a term are found by its runs."""
    return 16 if rows < 1_000_000 else 32


def stats_of(idx: DataFrame) -> DataFrame:
    """One row: the number of rows and their mean length."""
    return idx.agg(F.count("*").alias("rows_in_index"), (F.sum("dl") / F.count("*")).alias("mean_length"))


def size_of(idx: DataFrame) -> dict[str, int]:
    """The number of rows and of terms, which add up and can be taken off again when rows come and go."""
    n, length = idx.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return {"fts_rows": int(n), "fts_length": int(length)}


def stats_row(spark: SparkSession, rows: int, length: int) -> DataFrame:
    """As ``stats_of``, from the two sums."""
    return spark.createDataFrame([(rows, length / rows if rows else None)], "rows_in_index long, mean_length double")


@dataclass(frozen=True)
class Postings:
    """table: as ``postings`` gives it, stored; stats: as ``stats_of``; items: id and what filters look at; early: what ends
    the search for the best of an OR early."""

    table: DataFrame
    stats: DataFrame
    buckets: int
    items: DataFrame | None = None
    early: Early | None = None

    def rows(self, terms: list[str], columns: tuple[str, ...]) -> DataFrame:
        """The rows of some terms: the buckets are constants, so only their folders are read."""
        found = self.table.where(in_buckets(terms, self.buckets) & F.col("term").isin(*dict.fromkeys(terms)))
        return found if columns == COLUMNS else found.where(F.col("field").isin(*columns))

    def hits(self, phrases: list[list[str]], columns: tuple[str, ...] = COLUMNS) -> DataFrame:
        """id, dl and the hits h0, h1 ... of the phrases, of the items that any of them hits."""
        single = {p[0]: i for i, p in enumerate(phrases) if len(p) == 1}
        parts = []
        if single:
            which = reduce(lambda c, x: c.when(F.col("term") == x[0], x[1]), list(single.items())[1:], F.when(F.col("term") == next(iter(single)), single[next(iter(single))]))
            parts.append(self.rows(list(single), columns).select("id", "dl", which.alias("phrase"), F.col("n").cast("long").alias("hits")))
        for i, terms in enumerate(phrases):
            if len(terms) > 1:
                parts.append(self.phrase(terms, columns).select("id", "dl", F.lit(i).alias("phrase"), "hits"))
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy("id", "dl").agg(*(F.sum(F.when(F.col("phrase") == i, F.col("hits")).otherwise(0)).alias(f"h{i}") for i in range(len(phrases))))

    def phrase(self, terms: list[str], columns: tuple[str, ...] = COLUMNS) -> DataFrame:
        """id, dl and hits of a phrase of several words: each word's positions say where the phrase would begin, and it
        does where all of them say so."""
        rows = self.rows(terms, columns)
        sets = {f"s{i}": F.flatten(F.collect_list(F.when(F.col("term") == t, F.transform("positions", _minus(i))))) for i, t in enumerate(terms)}
        met = rows.groupBy("id", "dl", "field").agg(*(c.alias(k) for k, c in sets.items()))  # a column of one item at a time
        hits = F.size(reduce(F.array_intersect, (F.col(k) for k in sets))).cast("long")
        return met.select("id", "dl", hits.alias("hits")).groupBy("id", "dl").agg(F.sum("hits").alias("hits")).where("hits > 0")


def phrase_hits(table: DataFrame, words: str, field: str = "all", buckets: int = 256, stemmed: bool = True) -> DataFrame:
    """id, dl and hits of a phrase, from postings."""
    terms = stem.analyze_phrase(words) if stemmed else plain_phrase(words)
    return Postings(table, table.limit(0), buckets).hits([terms], COLUMNS if field == "all" else (field,)).withColumnRenamed("h0", "hits")


def _minus(n: int):
    return lambda position: position - n
