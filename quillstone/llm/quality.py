"""Compression classifier: zstandard dictionaries of good and bad text; a text is like the class whose dictionary packs it better.

A text is cut into pieces of ``PIECE`` bytes, all of them, and each is packed with either dictionary, so that a long
text's own repetitions don't hide what the dictionaries know.  The difference of the two sums, divided by the text's
plain size, is the only thing a score depends on: a logistic curve turns it into a probability.

Fitting takes a bounded, deterministic sample of labelled rows: of each class the ``sample_docs`` identifiers with the
smallest hashes (a parameter, so the driver's part doesn't grow with the corpus), as far as they fit into
``SAMPLE_BYTES``; texts above a sixteenth of that are never learned from, so no text can crowd out the others.  Two
thirds of the sample make the dictionaries; on the others the curve is fitted.  Scoring reads every whole text,
compresses it twice and shuffles nothing.

Cases: a null text is an empty one, and an empty text has difference 0; very long texts are scored as a whole, a piece at
a time; identifiers whose labels disagree aren't learned from; repeated rows are learned from as often as they stand and
scored alike; a class without labelled rows, or with too few to make a dictionary and a curve, makes the classifier answer
with the labelled share of good texts (0.5 without any); an empty table gives no rows; columns other than doc_id and text
are ignored in scoring and kept in filtering.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, table, through_disk, utf8

#: Identifiers of each class in the fitting sample; bytes of a dictionary; compression level; bytes of a piece that is
#: packed by itself, and of one that a dictionary is trained on.
SAMPLE_DOCS, DICTIONARY, LEVEL, PIECE, TRAINING_PIECE = 3000, 112 << 10, 3, 512, 4 << 10
#: Bytes of sampled text of each class at most (the sample's other bound), and of one of its texts.
SAMPLE_BYTES = 12 << 20
LONGEST = SAMPLE_BYTES // 16


def held_out(doc_id) -> F.Column:
    """Whether an identifier is kept for judging and never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weight: float
    offset: float
    level: int = LEVEL

    def scorer(self):
        """The scoring function of a worker; its compressors keep the digested dictionaries."""
        sizes = [_size_by(d, self.level) for d in (self.good, self.bad)] if self.good and self.bad else None

        def score(text: bytes) -> float:
            z = self.offset + (self.weight * difference(text, *sizes) if sizes else 0.0)
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        return score


def _size_by(dictionary: bytes, level: int):
    known = zstandard.ZstdCompressionDict(dictionary)
    known.precompute_compress(level=level)
    pack = zstandard.ZstdCompressor(dict_data=known, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return lambda text: sum(len(pack(text[i : i + PIECE])) for i in range(0, len(text), PIECE))


def difference(text: bytes, good, bad) -> float:
    """The normalised difference of the compressed sizes: above 0 if the dictionary of good texts packs the text better, 0
    for no text."""
    return (bad(text) - good(text)) / len(text) if text else 0.0


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> DataFrame:
    """text, quality and part of the fitting sample: at most ``per_class`` identifiers of each class."""
    sure = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    )
    chosen = None
    for q in (0, 1):
        part = sure.where(F.col("quality") == q).orderBy("h", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class rows of two numbers: a proven bound for broadcasting
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "quality", "h")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS, dictionary: int = DICTIONARY, level: int = LEVEL) -> Model:
    kept, size, full = [], {0: 0, 1: 0}, set()
    # in the order of the hashes, a partition at a time, until either class is full: the driver holds the kept texts only
    chosen = through_disk(sample(docs, labels, per_class), "labelled").repartitionByRange(32, "h")
    for r in chosen.sortWithinPartitions("h", "quality", "text").toLocalIterator():
        text = bytes(r.text or b"")
        if size[r.quality] + len(text) > SAMPLE_BYTES:
            full.add(r.quality)
        elif r.quality not in full:
            size[r.quality] += len(text)
            kept.append((r.quality, text))
        if len(full) == 2:
            break
    learn = {q: [t for k, (c, t) in enumerate(kept) if c == q and k % 3] for q in (0, 1)}
    check = [(t, c) for k, (c, t) in enumerate(kept) if not k % 3]
    share = (sum(c for c, _ in kept) + 1) / (len(kept) + 2)
    flat = Model(b"", b"", 0.0, math.log(share / (1 - share)))
    made = [_dictionary(learn[q], dictionary) for q in (1, 0)]
    if not all(made):
        return flat
    # the sample has as many of either class as there are; the prior of all labelled rows is put back by weights
    sizes = [_size_by(d, level) for d in made]
    x = np.array([difference(t, *sizes) for t, _ in check])
    y = np.array([c for _, c in check], float)
    if not 0 < y.sum() < len(y):
        return flat
    counts = {r.quality: r["count"] for r in labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("quality").count().collect()}
    share = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    return Model(*made, *logistic(x, y, share / share.mean()), level)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    pieces = [t[i : i + TRAINING_PIECE] for t in texts for i in range(0, len(t), TRAINING_PIECE)]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples for the trainer: plain content is a dictionary, too
        return b"".join(pieces)[:size]


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> tuple[float, float]:
    """Weight and offset of a logistic curve of x that counts each place by its share, by Newton steps on x as standard
    scores (``ridge`` keeps the curve finite where a threshold parts the classes)."""
    mean, scale = x.mean(), x.std() or 1.0
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (share * (y - p)) - ridge * w
        h = (a * (share * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def make():
        of = held.value.scorer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array([of(t) for t in utf8(batch.column(2))], pa.float64())],
                ["doc_id", "held_out", "score"],
            )

        return step

    return by_rows(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least ``least``, with all their columns."""
    schema, at = docs.schema, docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of = held.value.scorer()
        return lambda batch: batch.filter(pa.array([of(t) >= least for t in utf8(batch.column(at))], pa.bool_()))

    return by_rows(docs, make, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
