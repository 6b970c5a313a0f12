"""Early-ending BM25: of an OR of words only the postings that can matter for the best k are read.

``impacts`` has a row for each term and item: what the term would add to the item's score for a weight of one.  It is stored
in runs sorted by term and falling impact, so the rows of a term above some impact are neighbours in each run.  ``levels``
counts them: how many items each term has on each of a few impact levels.  From the levels alone follows a score that at least k
items reach, and from that for every term an impact below which its rows can't lift an item into the best k on their own.
A search reads the rows above these, keeps the items whose sum with the most that the rest could add reaches the k-th best
sum, and scores these few exactly from their token arrays.  The answer is that of the full way, ties included.

Levels are counts that add up, so an update adds its own and takes those of retired items off again.  Impacts are of the
mean length when the index was made; a longer mean since then raises an impact by the same ratio at most.

Items without terms have no rows; a term that no item has adds nothing; an index without items finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fulltext, ingest

#: Width of a level; no impact is above K1 + 1.  What floating point may add to a sum.
LEVEL, SLACK = 0.1, 1e-9
#: Candidates whose identifiers become constants in the scan of token arrays; more are joined.
FEW = 5_000


def impacts(idx: DataFrame, mean: float, buckets: int) -> DataFrame:
    """bucket, term, id and impact of each term of an index's rows; made row by row, without a shuffle, and sorted in each
    batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in fulltext.slices(whole):
                words, parent, _ = fulltext.tokens_of(batch, range(2, batch.num_columns))
                codes, dictionary, order, first, n = fulltext.grouped(words, parent)
                dl = batch.column(1).to_numpy()[parent[order[first]]]
                out = n * (fulltext.K1 + 1) / (n + fulltext.K1 * (1 - fulltext.B + fulltext.B * dl / mean))
                falling = np.lexsort((-out, codes[order[first]]))
                first, out = first[falling], out[falling]
                yield pa.RecordBatch.from_arrays([dictionary.take(pa.array(codes[order[first]])), batch.column(0).take(pa.array(parent[order[first]])), pa.array(out, pa.float64())], ["term", "id", "impact"])
                pa.default_memory_pool().release_unused()

    rows = idx.select("id", "dl", *(f"t_{c}" for c in fulltext.COLUMNS)).mapInArrow(run, "term string, id long, impact double")
    return rows.select(fulltext.bucket_of(F.col("term"), buckets).alias("bucket"), "term", "id", "impact")


def levels(rows: DataFrame, sign: int = 1) -> DataFrame:
    """bucket, term, level and n of impacts (or, to take them off again, of retired ones)."""
    return rows.groupBy("bucket", "term", F.floor(F.col("impact") / LEVEL).cast("int").alias("level")).agg((F.count("*") * sign).alias("n"))


def level_runs(rows: DataFrame) -> DataFrame:
    """As ``levels``, of impacts that come sorted by term: counted as they come, without a shuffle, so a term has a row for
    each of its levels in each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = pa.array(np.floor(batch.column(2).to_numpy() / LEVEL).astype(np.int32))
            found = pa.table([batch.column(0), batch.column(1), level], ["bucket", "term", "level"]).group_by(["bucket", "term", "level"]).aggregate([([], "count_all")])
            found = found.rename_columns(["bucket", "term", "level", "n"]).sort_by("term").combine_chunks()
            yield from found.to_batches()

    return rows.select("bucket", "term", "impact").mapInArrow(run, "bucket int, term string, level int, n long")


@dataclass(frozen=True)
class Early:
    """impacts and levels: stored; forward: the index's rows of token arrays; mean: the length that impacts are of; worth: how
    many rows the terms must have in all for a search to end early, as reading fewer at once takes less than three short jobs
    (the answer is the same)."""

    impacts: DataFrame
    levels: DataFrame
    forward: DataFrame
    mean: float
    worth: int = 500_000

    def counted(self, terms: list[str], buckets: int) -> dict[str, np.ndarray]:
        """For each term the number of its items at or above each level."""
        wanted = self.levels.where(fulltext.in_buckets(terms, buckets) & F.col("term").isin(*terms))
        out = {t: np.zeros(int((fulltext.K1 + 1) / LEVEL) + 2, np.int64) for t in terms}
        for r in wanted.groupBy("term", "level").agg(F.sum("n").alias("n")).collect():  # some twenty rows a term
            out[r.term][r.level] += r.n
        return {t: n[::-1].cumsum()[::-1] for t, n in out.items()}

    def cuts(self, counts: dict[str, np.ndarray], weights: dict[str, float], k: int, ratio: float, lower: float) -> dict[str, float] | None:
        """For each term the impact from which its rows are read (above all impacts: none are); None if fewer than k items
        are sure to be found.  An impact is now at most ``ratio`` and at least ``lower`` times what is stored."""
        reached = [weights[t] * lower * LEVEL * np.flatnonzero(n >= k).max() for t, n in counts.items() if (n >= k).any()]
        least = max(reached, default=0.0)
        if least <= 0:
            return None
        out, left = {}, least * (1 - SLACK)
        by_weight = sorted(weights, key=weights.get)
        for i, t in enumerate(by_weight):
            most = weights[t] * (fulltext.K1 + 1)
            share = left / (len(by_weight) - i)
            out[t] = np.inf if most <= share else share / weights[t] / ratio
            left -= min(most, share)
        return out

    def candidates(self, times: dict[str, int], rows_in_index: int, mean: float, k: int, buckets: int) -> tuple[DataFrame | None, dict[str, int]]:
        """id of the items that may be among the best k (None: all that have one of the terms), and the terms' item counts.
        times: how often each term stands in the OR."""
        counts = self.counted(list(times), buckets)
        found = {t: int(n[0]) for t, n in counts.items()}
        if sum(found.values()) < self.worth:
            return None, found
        weights = {t: times[t] * max(float(np.log((rows_in_index - n + 0.5) / (n + 0.5))), fulltext.LEAST_IDF) for t, n in found.items() if n}
        ratio = max(1.0, mean / self.mean)
        lower = min(1.0, mean / self.mean)  # a shorter mean lowers impacts by this ratio at most
        cuts = self.cuts({t: counts[t] for t in weights}, weights, k, ratio, lower) if weights else None
        if cuts is None:
            return None, found
        read = [t for t in weights if np.isfinite(cuts[t])]
        some = F.lit(False)
        weight, cut = F.lit(0.0), F.lit(0.0)
        for t in read:
            some = some | ((F.col("term") == t) & (F.col("impact") >= float(cuts[t])))
            weight = F.when(F.col("term") == t, weights[t]).otherwise(weight)
            cut = F.when(F.col("term") == t, float(weights[t] * cuts[t] * ratio)).otherwise(cut)
        unread = sum(weights[t] * (fulltext.K1 + 1) for t in weights if t not in read)
        rest = sum(weights[t] * cuts[t] * ratio for t in read) + unread
        rows = self.impacts.where(fulltext.in_buckets(read, buckets) & F.col("term").isin(*read) & some)
        sums = rows.groupBy("id").agg(F.sum(weight * F.col("impact")).alias("sum"), F.sum(cut).alias("known"))
        kth = sums.orderBy(F.desc("sum")).limit(k).agg(F.min("sum").alias("least"), F.count("*").alias("n"))
        most = F.col("sum") * ratio + F.lit(rest) - F.col("known")
        return sums.crossJoin(F.broadcast(kth)).where((F.col("n") < k) | (most * (1 + SLACK) >= F.col("least") * lower)).select("id"), found

    def rows(self, ids: DataFrame) -> DataFrame:
        """The token arrays of some items."""
        return ingest.among(self.forward, ids, "id", FEW)
