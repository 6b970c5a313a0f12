"""The search legs and their fusion by reciprocal ranks; a whole search is one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import boolexpr
from . import ann, filters, fulltext, grams, vectors

#: The constant of reciprocal ranks, the rows of a text leg, and the legs in the order of adding up.
RRF_K, LEG = 60, 200
LEGS = ("fts", "like", "vec")


def like_leg(items: DataFrame, tree: boolexpr.Node, field: str = "all", dates: filters.Dates | None = None, limit: int | None = LEG, escape: bool = False, index: DataFrame | None = None) -> DataFrame:
    """id of the first matches in document order (sort order, nulls last, then id); dates are applied before the limit.
    With a substring index only the items that it names are looked at."""
    found = grams.narrowed(items, index, tree, escape).where(filters.substring(tree, field, escape))
    if dates is not None:
        found = found.where(dates.condition())
    found = found.orderBy(F.asc_nulls_last("globalSortOrder"), "id")
    return (found.limit(limit) if limit is not None else found).select("id", "globalSortOrder")


def ranked(leg: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """id, leg and rank from 0.  The window has one partition, of at most as many rows as a leg is long."""
    return leg.select("id", F.lit(name).alias("leg"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


def fuse(legs: DataFrame) -> DataFrame:
    """id, rrf, via (sorted legs joined by '+'), and first_leg and first_rank, which order ties.

    The three terms are added in a fixed order, so equal inputs give equal sums.
    """
    term = {leg: F.max(F.when(F.col("leg") == leg, 1.0 / (RRF_K + 1 + F.col("rank")))) for leg in LEGS}
    number = F.element_at(F.create_map(*(x for i, leg in enumerate(LEGS) for x in (F.lit(leg), F.lit(i)))), F.col("leg"))
    first = F.min(F.struct(number.alias("leg"), F.col("rank")))
    out = legs.groupBy("id").agg(
        sum((F.coalesce(term[leg], F.lit(0.0)) for leg in LEGS[1:]), F.coalesce(term[LEGS[0]], F.lit(0.0))).alias("rrf"),
        F.array_join(F.array_sort(F.collect_set("leg")), "+").alias("via"),
        first.alias("first"),
    )
    return out.select("id", "rrf", "via", F.col("first.leg").alias("first_leg"), F.col("first.rank").alias("first_rank"))


def hydrate(hits: DataFrame, items: DataFrame, types: str | None = None, dates: filters.Dates | None = None) -> DataFrame:
    """Hits with their items; types and dates are filters after the legs were cut, so they can only take hits away.

    The hits are a few thousand at most (the legs' limits), which bounds the broadcast.
    """
    found = items.where(filters.types(types))
    if dates is not None:
        found = found.where(dates.condition())
    return F.broadcast(hits).join(found, "id")


def hybrid(
    items: DataFrame, index: DataFrame | None, tree: boolexpr.Node | None, chunks: DataFrame | None = None, query_vector: list[float] | None = None, field: str = "all",
    types: str | None = None, dates: filters.Dates | None = None, top: int = 0, max_distance: float = vectors.MAX_DISTANCE, stemmed: bool = True, compat: bool = False, substrings: DataFrame | None = None,
) -> DataFrame:
    """id, documentKey, typeKey, sequence, score, via and name of the fused hits, best first; ``top`` 0 keeps all."""
    if top < 0:
        raise ValueError("top can't be negative")
    legs = []
    if tree is not None:
        if index is not None:
            where = dates.condition() if dates is not None else None
            legs.append(ranked(fulltext.search(index, tree, field, where, stemmed=stemmed, compat=compat), "fts", "bm25", "id"))
        legs.append(ranked(like_leg(items, tree, field, dates, index=substrings), "like", F.asc_nulls_last("globalSortOrder"), "id"))
    if query_vector is not None and chunks is not None:
        near = vectors.fold(vectors.nearest(chunks, query_vector, max_distance=max_distance))
        legs.append(ranked(near.withColumnRenamed("item_id", "id"), "vec", "distance", "id"))
    if not legs:
        raise ValueError("neither an expression nor a query was given")
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    found = hydrate(fuse(every), items, types, dates).orderBy(F.desc("rrf"), "first_leg", "first_rank")
    found = found.limit(top) if top else found
    return found.select("id", "documentKey", "typeKey", "sequence", F.round("rrf", 4).alias("score"), "via", "name")


def semantic(items: DataFrame, chunks: DataFrame, query_vector: list[float], types: str | None = None, dates: filters.Dates | None = None, top: int = 0, max_distance: float = vectors.MAX_DISTANCE, model: ann.Model | None = None) -> DataFrame:
    """id, documentKey, typeKey, sequence, score (cosine) and name, nearest first.  With a model chunks are its index."""
    if top < 0:
        raise ValueError("top can't be negative")
    near = vectors.nearest(chunks, query_vector, max_distance=max_distance) if model is None else ann.nearest(chunks, model, query_vector, max_distance=max_distance)
    near = vectors.fold(near).withColumnRenamed("item_id", "id")
    found = hydrate(near, items, types, dates).orderBy("distance", "id")
    found = found.limit(top) if top else found
    return found.select("id", "documentKey", "typeKey", "sequence", F.round(1 - F.col("distance"), 3).alias("score"), "name")
