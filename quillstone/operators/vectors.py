"""Nearest neighbours by cosine distance over item chunks, and embedders."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Distance within which a chunk counts, and chunks that are looked at.
MAX_DISTANCE, MAX_CHUNKS = 0.30, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(vector: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    return 1 - dot(vector, q) / (F.sqrt(dot(vector, vector)) * F.lit(norm))


def nearest(chunks: DataFrame, query: list[float], k: int | None = None, max_distance: float | None = MAX_DISTANCE) -> DataFrame:
    """chunk_id, item_id and distance of the nearest chunks: at most k (4,096), then those within the distance.

    A distance for each row in the scan, then a top-k of small rows; nothing else is shuffled.
    """
    k = MAX_CHUNKS if k is None else min(k, MAX_CHUNKS)
    found = chunks.select("chunk_id", "item_id", cosine_distance(F.col("embedding"), query).alias("distance")).orderBy("distance", "chunk_id").limit(k)
    return found if max_distance is None else found.where(F.col("distance") <= max_distance)


def fold(hits: DataFrame) -> DataFrame:
    """item_id and distance of each item's nearest chunk."""
    return hits.groupBy("item_id").agg(F.min("distance").alias("distance"))


def coverage(chunks: DataFrame) -> DataFrame:
    """One row: how many items have chunks, and how many chunks there are."""
    return chunks.agg(F.countDistinct("item_id").alias("items"), F.count("*").alias("chunks"))


class Embedder(Protocol):
    """Vectors of texts.  ``name`` and ``dim`` stand in the index's metadata; another model makes it stale."""

    name: str
    dim: int

    def passages(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Signed hashes of words in a vector of unit length: deterministic, without a model."""

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"hashing-{dim}"

    def query(self, text: str) -> list[float]:
        import xxhash

        v = [0.0] * self.dim
        for word in text.lower().split():
            h = xxhash.xxh3_64_intdigest(word)
            v[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v] if norm else [1.0] + [0.0] * (self.dim - 1)

    def passages(self, texts: list[str]) -> list[list[float]]:
        return [self.query(t) for t in texts]


class OnnxEmbedder:
    """A sentence model in ONNX form with its tokenizer file, both given by path; first-token pooling, unit length."""

    def __init__(self, model: str, tokenizer: str, dim: int = 768, query_prefix: str = "", longest: int = 512):
        self.model, self.tokenizer, self.dim, self.query_prefix, self.longest = model, tokenizer, dim, query_prefix, longest
        self.name, self._session = f"onnx-{model.rsplit('/', 1)[-1]}", None

    def __getstate__(self):
        return self.__dict__ | {"_session": None}

    def passages(self, texts: list[str]) -> list[list[float]]:
        import numpy as np
        import onnxruntime
        from tokenizers import Tokenizer

        if self._session is None:
            encoder = Tokenizer.from_file(self.tokenizer)
            encoder.enable_truncation(self.longest)
            encoder.enable_padding()
            self._session = onnxruntime.InferenceSession(self.model), encoder
        session, encoder = self._session
        got = encoder.encode_batch(texts)
        feeds = {"input_ids": [e.ids for e in got], "attention_mask": [e.attention_mask for e in got], "token_type_ids": [e.type_ids for e in got]}
        names = {i.name for i in session.get_inputs()}
        out = session.run(None, {k: np.array(v, np.int64) for k, v in feeds.items() if k in names})[0][:, 0]
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()

    def query(self, text: str) -> list[float]:
        return self.passages([self.query_prefix + text])[0]


def chunk_rows(items: DataFrame) -> DataFrame:
    """item_id, chunk_no and text of every chunk; an item without text has one, its bare name or ''."""
    parts = text.chunks(text.item_text(F.col("name"), F.col("description"), F.col("stepsText")))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.coalesce(F.col("name"), F.lit(""))))
    return items.select(F.col("id").alias("item_id"), F.posexplode(parts).alias("chunk_no", "text"))


def embed(chunks: DataFrame, embedder: Embedder, batch: int = 16) -> DataFrame:
    """chunk_id (stable: from the item and its chunk's number), item_id, chunk_no, text and embedding.

    Texts of a batch are embedded shortest first, which wastes no padding; their order in the result is their own.
    """
    rows = chunks.select(F.concat_ws("-", "item_id", "chunk_no").alias("chunk_id"), "item_id", "chunk_no", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            order = frame["text"].str.len().sort_values(kind="stable").index
            vectors: dict[int, list[float]] = {}
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                vectors.update(zip(part, embedder.passages(frame.loc[part, "text"].tolist()), strict=True))
            yield frame.assign(embedding=[vectors[i] for i in frame.index])

    return rows.mapInPandas(run, "chunk_id string, item_id long, chunk_no int, text string, embedding array<float>")
