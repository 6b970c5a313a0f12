"""Links as a graph: how many other starts share an end with each start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most ends of a start whose pairs of ends are listed; they are at most 120 a start.
WIDE = 16


def siblings(links: DataFrame) -> DataFrame:
    """src and siblings (other starts that share an end with it, each counted once) of links f and t, for the starts that
    have any.  Links without a start or an end count for nothing, repeated ones once.

    The starts at a start's ends add up without being listed: those that share s of its ends are counted s times, so s - 1
    is taken off again.  Only pairs that share two ends or more are brought together: by two common ends where both have
    few, by each common end where one has many.
    """
    one = links.select("f", "t").where("f IS NOT NULL AND t IS NOT NULL").repartition("f").distinct()
    own = Window.partitionBy("f")
    rows = one.select("f", "t", (F.count("*").over(own) > WIDE).alias("wide"), F.collect_list("t").over(own.orderBy("t").rowsBetween(1 - WIDE, -1)).alias("before"))
    counts = one.groupBy("t").agg((F.count("*") - 1).alias("others")).where("others > 0")
    added = one.join(counts, "t").select("f", F.col("others").alias("n"))
    wide = rows.where("wide").select("f", "t")
    return added.unionByName(_few(rows.where("NOT wide"))).unionByName(_many(wide, one)).groupBy(F.col("f").alias("src")).agg(F.sum("n").alias("siblings")).where("siblings > 0")


def _few(rows: DataFrame) -> DataFrame:
    """f and n to add, for the pairs of starts of few ends: one that shares s ends meets the other s (s - 1) / 2 times."""
    ends = rows.select("f", F.explode("before").alias("u"), "t")
    # most pairs of ends stand at one start only; the others are dealt anew, so that both sides of the join read them alone
    ends = ends.withColumn("n", F.count("*").over(Window.partitionBy("u", "t"))).where("n > 1").select("f", "u", "t").repartition("f")
    met = ends.alias("a").join(ends.alias("b"), (F.col("a.u") == F.col("b.u")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.f") < F.col("b.f")))
    pairs = met.groupBy(F.col("a.f").alias("a"), F.col("b.f").alias("b")).agg(F.count("*").alias("c"))
    return _both(pairs, F.round((1 - F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long"))


def _many(wide: DataFrame, one: DataFrame) -> DataFrame:
    """As ``_few``, for the pairs of a start of many ends; two such meet in both orders, of which one is kept."""
    met = wide.alias("a").join(one.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.f") != F.col("b.f")))
    pairs = met.groupBy(F.col("a.f").alias("a"), F.col("b.f").alias("b")).agg(F.count("*").alias("c")).where("c > 1")
    return _both(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "c").distinct(), 1 - F.col("c"))


def _both(pairs: DataFrame, n: Column) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("f"), n.alias("n"))
