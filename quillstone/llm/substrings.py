"""Substring dedup: word windows that also start in a document with a smaller identifier are removed.

The index is a compressed FM-index per shard over words.  A window of 13 words goes to the shard that its anchor names
(the five-word piece with the smallest hash in it, very common ones last), so equal windows always meet in one shard and the shards' total
size follows the input, whatever their number.  Consecutive windows with one anchor travel as one segment.

Equal texts are a class, of which the document with the smallest identifier passes the index for all; the others have
every window of it.  For the classes, in two steps:

1. Anchors that occur in one text only can be in no repeated window.  Tasks exchange anchors (a hash, a row's hash and a
   position); anchors that several rows of a batch share are settled before the exchange, and one of them stands for
   all, so a passage that a third of all documents hold costs a row a batch.
2. Segments of shared anchors go to the shards, again only one of equal ones in a batch (the one with the smallest
   identifier; for the others the answer is known).  A shard lays its different segments end to end, sorts their
   suffixes, keeps the Burrows-Wheeler transform in a wavelet matrix of packed bits with rank counts (all in all about
   five bytes a word, without the order of suffixes), and streams every segment through it by backward search.  After 13 words the interval gives the smallest document that has the
   window; dropping the last word leads to the interval of the first twelve, from which one more step gives the next
   window: matching statistics cut at the threshold.  Windows with a smaller document are reported as intervals.  Where
   one anchor's segments alone pass a shard's size, of equal ones only the smallest document's stays while they come, so
   a task holds an anchor's different segments at most.

Cases: a null or wordless text has no windows and nothing removed; texts of fewer than 13 words stay whole; repeated rows
with one identifier remove nothing from each other; rows without an identifier neither lose words nor take any from
others; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, table, through_disk, utf8

WINDOW, ANCHOR = 13, 5
#: Words of a shard's index at most; a partition of more is searched in parts by anchor.
SHARD_WORDS = 1 << 20
#: Texts that are looked at for common pieces, and how many of them must have one.
SAMPLE, OFTEN = 5000, 10
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).max


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pieces(h: np.ndarray, k: int = ANCHOR) -> np.ndarray:
    """A hash of the k words from each position, below 2**63."""
    g = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        g = (g ^ h[i : i + len(g)]) * _ODD
        g ^= g >> np.uint64(29)
    return g >> np.uint64(1)


def anchors(h: np.ndarray, lengths: np.ndarray, common: np.ndarray | None = None, window: int = WINDOW, k: int = ANCHOR):
    """For texts laid end to end (word hashes h, words of each text): runs of windows with one anchor, as arrays
    (text, first window, last window, anchor position, anchor hash); positions count from the text's start.

    A window's anchor is the piece with the smallest hash, ``common`` (sorted) pieces coming after all others.
    """
    m = len(h) - window + 1
    if m <= 0:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64))
    text = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    g = pieces(h, k)
    if common is not None and len(common):
        at = np.minimum(np.searchsorted(common, g), len(common) - 1)
        g = np.where(common[at] == g, g | np.uint64(1 << 63), g)
    best, at = g[:m].copy(), np.zeros(m, np.int8)
    for i in range(1, window - k + 1):
        less = g[i : i + m] < best
        best[less] = g[i : i + m][less]
        at[less] = i
    ok = text[:m] == text[window - 1 :]
    pos = np.arange(m) + at
    w = np.flatnonzero(ok)
    if not len(w):
        return anchors(h[:0], lengths[:0], None, window, k)
    new = np.r_[True, (pos[w][1:] != pos[w][:-1]) | (text[w][1:] != text[w][:-1])]
    first = w[new]
    last = np.r_[w[np.flatnonzero(new)[1:] - 1], w[-1]]
    t = text[first]
    return t, first - begin[t], last - begin[t], pos[first] - begin[t], best[first]


def keyed(docs: DataFrame) -> DataFrame:
    """row (a hash that tells a row from others, also from one with the same identifier and another text), doc_id, text.

    Both joins of the operator start from this frame, so Spark shuffles the texts once and reads that exchange twice.
    """
    base = docs.select(F.col("doc_id").cast("long"), "text")
    return base.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def copies(rows: DataFrame) -> DataFrame:
    """row and copy (its doc_id) of each text that a document with a smaller identifier has word for word: all its windows
    are repeated.  Who asks compares both, lest another document with the same row hash be taken for it.

    Two hashes of each text travel, not the text; the smallest identifiers are grouped with partial minima and joined as
    one row a text, so Spark can split a text that very many rows have.
    """
    slim = rows.select("row", "doc_id", *(F.xxhash64(F.lit(i), "text").alias(f"h{i}") for i in (1, 2))).where("doc_id IS NOT NULL")
    first = slim.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    return slim.join(first, ["h1", "h2"]).where("doc_id > first").select("row", F.col("doc_id").alias("copy")).distinct()


def _laid_out(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    return words, lengths, word_hashes(flat)


def common_pieces(rows: DataFrame) -> np.ndarray:
    """Pieces that stand in very many texts, sorted: of about ``SAMPLE`` different sampled texts in at least ``OFTEN``.

    They are bad anchors, as all that surrounds them would meet in one shard; a window takes another piece if it has
    one.  Any set gives right results; this one is bounded by the sample and so may be sent to all tasks.
    """
    every = max(1, rows.count() // SAMPLE)
    texts = rows.where(F.pmod("row", F.lit(every)) == 0).select("text").dropDuplicates()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.unique(pieces(word_hashes(t.split()))) for t in utf8(batch.column(0))]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["piece"])

        return step

    often = by_rows(texts, make, "piece long").groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(np.array([r.piece for r in often.select("piece").toLocalIterator()], np.int64).view(np.uint64))


def shared_anchors(rows: DataFrame, common) -> DataFrame:
    """rows: as ``keyed`` gives them, without copies.  (row, at): positions of anchors that rows other than this one have, too; may hold a position twice."""

    def emit():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            batch = batch.filter(batch.column(1).is_valid())
            _, lengths, h = _laid_out(utf8(batch.column(2)))
            t, _, _, at, g = anchors(h, lengths, common.value)
            row = batch.column(0).to_numpy()[t]
            order = np.lexsort((row, g))
            g, row, at = g[order], row[order], at[order]
            if len(g):  # a row says once that it has an anchor, however often it repeats it
                once = np.r_[True, (g[1:] != g[:-1]) | (row[1:] != row[:-1])]
                g, row, at = g[once], row[once], at[once]
            first = np.r_[True, g[1:] != g[:-1]][: len(g)]
            group = np.cumsum(first) - 1
            mixed = np.zeros(group[-1] + 1 if len(g) else 0, bool)
            if len(g):
                np.logical_or.at(mixed, group[1:], ~first[1:] & (row[1:] != row[:-1]))
            known = mixed[group] if len(g) else np.zeros(0, bool)
            # a settled anchor goes to its row directly; its first one also stands for the batch
            send = ~known | first
            key = np.concatenate([g[send].view(np.int64), row[known]])
            at = np.concatenate([at[send], -1 - at[known]]).astype(np.int32)  # below 0: settled
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([row[send], row[known]])), pa.array(at)], ["key", "row", "at"])

        return step

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            got = [batch.column(i).to_numpy() for i in range(3)]
            settled = got[2] < 0
            yield _pick([got[0][settled], got[1][settled], -1 - got[2][settled]])
            got = [x[~settled] for x in got]
            if carry is not None:
                got = [np.concatenate(x) for x in zip(carry, got, strict=True)]
            if not len(got[0]):
                continue
            # the last key may go on: it waits, but of one already mixed only one row must
            whole = int(np.searchsorted(got[0], got[0][-1]))
            yield from _mixed([x[:whole] for x in got])
            tail = [x[whole:] for x in got]
            if len(tail[0]) > 1 and (tail[1] != tail[1][0]).any():
                other = int(np.flatnonzero(tail[1] != tail[1][0])[0])
                yield _pick(tail)
                tail = [x[[0, other]] for x in tail]
            carry = tail
        if carry is not None:
            yield from _mixed(carry)

    def _pick(got) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[1])), pa.array(np.ascontiguousarray(got[2]).astype(np.int32))], ["row", "at"])

    def _mixed(got) -> Iterator[pa.RecordBatch]:
        key, row, _ = got
        if len(key):
            start = np.r_[True, key[1:] != key[:-1]]
            group = np.cumsum(start) - 1
            base = row[np.flatnonzero(start)][group]
            mixed = np.zeros(group[-1] + 1, bool)
            np.logical_or.at(mixed, group, row != base)
            yield _pick([x[mixed[group]] for x in got])

    # no filter here: it would sink below the exchange of the texts, which then couldn't be shared
    sent = by_rows(rows, emit, "key long, row long, at int")
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "row long, at int")


class Bits:
    """A bit vector: the bits, packed, and how many ones stand before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.n, self.words = len(bits), np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.int32)
        self.ones = int(self.counts[-1]) + int(np.bitwise_count(self.words[-1]))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before position i."""
        block = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[block].astype(np.int64) + np.bitwise_count(self.words[block] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th one (from 1) stands; the length if there are fewer."""
        block = np.searchsorted(self.counts, np.minimum(k, self.ones), "left") - 1
        left, word, at = np.minimum(k, self.ones) - self.counts[block], self.words[block], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # which half of the word, then of the half
            low = word & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            high = left > ones
            left, at = np.where(high, left - ones, left), np.where(high, at + half, at)
            word = np.where(high, word >> np.uint64(half), low)
        return np.where(k > self.ones, self.n, block * 64 + at)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.counts.nbytes


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.bits, self.levels = len(symbols), max(1, int(sigma - 1).bit_length()), []
        s = symbols
        for b in range(self.bits - 1, -1, -1):
            ones = (s >> b & 1).astype(bool)
            self.levels.append((Bits(ones), int(self.n - ones.sum())))
            s = np.concatenate([s[~ones], s[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i, up to a number that depends on the symbol alone (the start
        of its run on the last level, see ``base``)."""
        at = i
        for b, (level, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = level.rank(at)
            at = np.where(symbol >> b & 1, zeros + ones, at - ones)
        return at

    def base(self, sigma: int) -> np.ndarray:
        """rank(symbol, 0) of every symbol."""
        every = np.arange(sigma)
        return self.rank(every, np.zeros(sigma, np.int64))

    @property
    def nbytes(self) -> int:
        return sum(level.nbytes for level, _ in self.levels)


class FMIndex:
    """Over segments of word numbers laid end to end, each followed by a separator (0).

    The order of suffixes is needed to build it only.  What stays: the Burrows-Wheeler transform as a wavelet matrix, the
    first place of each word's suffixes, a bit for each suffix that begins a run with the same first words (a window's, and
    one less), and for each window that stands more than once its smallest owner.  Everything else a search gets from these.
    """

    def __init__(self, text: np.ndarray, sigma: int, owner: np.ndarray, window: int = WINDOW):
        n, rank, step = len(text), text.astype(np.int64), 1
        while step < window:  # prefix tripling, then doubling, up to the window: longer suffixes needn't be told apart
            key, width = rank, int(rank.max()) + 2
            more = 3 if width**3 < 1 << 62 else 2
            for k in range(1, more):
                after = np.zeros(n, np.int64)
                after[: max(0, n - k * step)] = rank[k * step :] + 1
                key = key * width + after
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
            step *= more
        self.n = n
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.first = (np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))[:-1]] - self.bwt.base(sigma)).astype(np.int32)
        differ = {length: _differ(text, order, length) for length in (window - 1, window)}
        self.shorter, self.whole = Bits(differ[window - 1]), Bits(differ[window])
        self.owners, least = np.unique(owner, return_inverse=True)
        begin = np.flatnonzero(differ[window])
        often = np.diff(begin, append=n) > 1
        self.often, self.least = Bits(often), np.minimum.reduceat(least[order].astype(np.int32), begin)[often]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.bwt, self.first, self.shorter, self.whole, self.often, self.owners, self.least))

    def owner(self, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The smallest owner of the windows with these intervals; ``own`` where a window stands once, as then it is the one
        that is looked for."""
        out, often = own.copy(), hi - lo > 1
        out[often] = self.owners[self.least[self.often.rank(self.whole.rank(lo[often] + 1) - 1)]]
        return out

    def shortened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the windows at lo without their last words."""
        run = self.shorter.rank(lo + 1)
        return self.shorter.select(run), self.shorter.select(run + 1)

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the words before what [lo, hi) stands for."""
        first = self.first[symbol]
        return first + self.bwt.rank(symbol, lo), first + self.bwt.rank(symbol, hi)


def _differ(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix, in order, differs from the one before in its first ``length`` words."""
    n, out = len(text), np.zeros(len(text), bool)
    out[0] = True
    for k in range(length):
        a, b = order[1:] + k, order[:-1] + k
        out[1:] |= np.where(a < n, text[np.minimum(a, n - 1)], -1) != np.where(b < n, text[np.minimum(b, n - 1)], -1)
    return out


def first_owners(segments: pa.Array, owner: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """segments: words joined by spaces.  For each window of each segment the smallest owner of a segment that has the
    same window, one after the other, and where each segment's begin."""
    words = pc.split_pattern(segments, b" ")
    coded = words.flatten().dictionary_encode()
    offsets = words.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    begin = offsets[:-1] + np.arange(len(lengths))
    text = np.zeros(int(lengths.sum()) + len(lengths), np.int64)
    text[np.arange(offsets[-1]) + np.repeat(np.arange(len(lengths)), lengths)] = coded.indices.to_numpy() + 1
    index = FMIndex(text, len(coded.dictionary) + 1, np.repeat(owner, lengths + 1), window)
    counts = np.maximum(0, lengths - window + 1)
    into = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    which = np.flatnonzero(counts)
    lo, hi = np.zeros(len(which), np.int64), np.full(len(which), index.n, np.int64)
    at, done = begin[which] + lengths[which], 0
    while len(which):
        at = at - 1
        lo, hi = index.back(text[at], lo, hi)
        done += 1
        if done < window:
            continue
        start = at - begin[which]
        out[into[which] + start] = index.owner(lo, hi, owner[which])
        more = start > 0
        which, at = which[more], at[more]
        # without the last word; then one word more to the left
        lo, hi = index.shortened(lo[more])
    return out, into


def repeated_windows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, row, first, last): runs of windows of a row that start in a document with a smaller identifier; rows in
    ``known`` (see ``copies``) are left out, as the text's first document stands for them."""
    ids = known.groupBy("row").agg(F.collect_set("copy").alias("copies"))  # one, but for equal hashes
    fresh = rows.join(ids, "row", "left").where(~F.coalesce(F.array_contains("copies", F.col("doc_id")), F.lit(False))).select("row", "doc_id", "text")
    common = rows.sparkSession.sparkContext.broadcast(common_pieces(rows))
    positions = shared_anchors(fresh, common).groupBy("row").agg(F.collect_set("at").alias("at"))
    met = rows.join(positions, "row")

    def cut():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, lengths, h = _laid_out(utf8(batch.column(2)))
            t, first, last, at, g = anchors(h, lengths, common.value)
            ids, rows = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            # (text, position) pairs of the shared anchors; the same pieces elsewhere in the text are shared as well
            many = batch.column(3)
            span = int(lengths.max(initial=0)) + 1
            wanted = np.repeat(np.arange(len(lengths)), np.diff(many.offsets.to_numpy())) * span + many.flatten().to_numpy()
            both = g ^ (t.astype(np.uint64) + np.uint64(1)) * _ODD
            pick = np.flatnonzero(np.isin(both, both[np.isin(t * span + at, wanted)]))
            best: dict[bytes, tuple[int, int]] = {}
            rows_of: dict[tuple[int, bytes], list[int]] = {}
            out: list[tuple] = []
            for i in pick[np.argsort(ids[t[pick]], kind="stable")].tolist():
                d, a = int(t[i]), int(first[i])
                segment = b" ".join(words[d][a : int(last[i]) + WINDOW])
                if (firsts := rows_of.get((d, segment))) is not None:
                    firsts.append(a)  # a text that repeats a segment sends it once, with all its places
                    continue
                rows_of[(d, segment)] = firsts = [a]
                doc_id, row, count = int(ids[d]), int(rows[d]), int(last[i]) - a + 1
                if best.setdefault(segment, doc_id) == doc_id:
                    out.append((int(g[i].view(np.int64)), doc_id, row, firsts, count, segment))
                else:  # the batch has a smaller document with the same segment
                    out.append((row, doc_id, row, firsts, count, None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SEGMENTS, strict=True)], schema=_SEGMENTS)

        return step

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, most = 0, SHARD_WORDS * 7
        for batch in batches:
            told = batch.filter(batch.column(5).is_null())
            if told.num_rows:
                yield from all_of(told)
            rest = batch.filter(batch.column(5).is_valid())
            if not rest.num_rows:
                continue
            # a part may end only where the anchor changes
            if size > most:
                new = np.flatnonzero(np.diff(rest.column(0).to_numpy())) + 1
                stays = rest.column(0)[0].as_py() == held[-1].column(0)[-1].as_py()
                end = 0 if not stays else int(new[0]) if len(new) else rest.num_rows
                held.append(rest.slice(0, end))
                if end < rest.num_rows:
                    yield from shard(held)
                    held, size, most, rest = [], 0, SHARD_WORDS * 7, rest.slice(end)
                else:
                    # one anchor goes on: what stands before it is searched, and of its equal segments one stays
                    every = pa.Table.from_batches(held).combine_chunks()
                    others = np.flatnonzero(every.column(0).to_numpy() != held[-1].column(0)[-1].as_py())
                    if begin := int(others[-1]) + 1 if len(others) else 0:
                        yield from shard(every.slice(0, begin).to_batches())
                    told, kept = settled(every.slice(begin))
                    yield from all_of(told)
                    held = kept.to_batches()
                    size = sum(x.column(5).nbytes for x in held)
                    most = max(most, 2 * size)
                    continue
            held.append(rest)
            size += rest.column(5).nbytes
        if held:
            yield from shard(held)

    def all_of(told) -> Iterator[pa.RecordBatch]:
        """Every window of the segments, at all their places."""
        if told.num_rows:
            yield from places(told, np.arange(told.num_rows), np.zeros(told.num_rows, np.int32), told.column(4).to_numpy() - 1)

    def settled(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
        """The segments that a smaller document has as a whole, and the others: of equal ones those of one document."""
        coded, ids = rows.column(5).combine_chunks().dictionary_encode(), rows.column(1).to_numpy()
        owner = np.full(len(coded.dictionary), _NONE)
        np.minimum.at(owner, coded.indices.to_numpy(), ids)
        more = ids > owner[coded.indices.to_numpy()]
        return rows.filter(pa.array(more)), rows.filter(pa.array(~more)).combine_chunks()

    def places(rows, r: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Runs of windows at every place of the segments r: from start to end, counted from the segment's first."""
        lists = rows.column(3)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        offsets, firsts = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        n = (offsets[1:] - offsets[:-1])[r]
        if not n.sum():
            return
        of = np.repeat(np.arange(len(r)), n)
        at = firsts[offsets[r][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]]
        ids, row = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        cols = (ids[r[of]], row[r[of]], at + start[of], at + end[of])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "row", "first", "last"])

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches(held).combine_chunks()
        coded = every.column(5).combine_chunks().dictionary_encode()
        at, ids = coded.indices.to_numpy(), every.column(1).to_numpy()
        owner = np.full(len(coded.dictionary), _NONE)
        np.minimum.at(owner, at, ids)
        least, into = first_owners(coded.dictionary, owner)
        # every row's windows against its own identifier, then the runs of those with a smaller owner
        counts = every.column(4).to_numpy().astype(np.int64)
        begin = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(of)) - begin[of]
        less = least[into[at][of] + within] < ids[of]
        starts = np.flatnonzero(less & ~np.r_[False, less[:-1] & (of[1:] == of[:-1])])
        ends = np.flatnonzero(less & ~np.r_[less[1:] & (of[1:] == of[:-1]), False])
        yield from places(every, of[starts], within[starts].astype(np.int32), within[ends].astype(np.int32))
        pa.default_memory_pool().release_unused()

    segments = by_rows(met.select("row", "doc_id", "text", "at"), cut, "anchor long, doc_id long, row long, firsts array<int>, windows int, words binary")
    return segments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(search, "doc_id long, row long, first int, last int")


_SEGMENTS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("firsts", pa.list_(pa.int32())), ("windows", pa.int32()), ("words", pa.binary())])


def covered(n: int, runs: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """Which of n words the windows of the runs cover."""
    edge = np.zeros(n + 1, np.int64)
    for a, b in runs:
        edge[a] += 1
        edge[b + window] -= 1
    return np.cumsum(edge[:n]) > 0


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by a space) of every row."""
    rows = keyed(docs)
    known = through_disk(copies(rows), "copies")
    runs = repeated_windows(rows, known).groupBy("row").agg(F.collect_list(F.struct("doc_id", "first", "last")).alias("runs"))

    def finish():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text, runs, copy in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                words = text.split()
                n = len(words)
                if copy and n >= WINDOW:
                    words = []
                elif runs:
                    gone = covered(n, [(r["first"], r["last"]) for r in runs if r["doc_id"] == doc_id])
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((doc_id, n, n - len(words), b" ".join(words).decode()))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

        return step

    ids = known.groupBy("row").agg(F.collect_set("copy").alias("copies"))
    joined = rows.join(runs, "row", "left").join(ids, "row", "left").select("doc_id", "text", "runs", F.array_contains("copies", F.col("doc_id")).alias("copy"))
    return by_rows(joined, finish, "doc_id long, n_words long, n_removed long, kept string")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: the same by exploding all windows and grouping them by their words.
OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
g AS (SELECT DISTINCT r, unnest(generate_series(i, i + 12)) AS p FROM x JOIN m USING (s) WHERE first < doc_id),
l AS (SELECT r, list(p) AS gone FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (r)
"""
