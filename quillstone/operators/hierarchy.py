"""Where items stand in their tree, by pointer doubling over parentItem.

Every item begins with a pointer to its parent.  In each round a pointer that doesn't end at a root yet becomes the pointer
of what it points to, so after k rounds it spans up to 2^k levels: a tree of any depth takes as many joins as its depth has
binary digits.  Only items that aren't done are joined, with one row for each different item they point to, and each round
is written, so plans stay short.

Cases: an item without a parent, with itself as its parent or with one that isn't in the table is a root, of depth 0; an
item on a cycle, or below one, has no root and no depth; of repeated identifiers the smallest parent counts; items without
an identifier are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different items that pointers end at (some 60 bytes each in a hash table), sent to all tasks at most.
BROADCAST_ENDS = 500_000


def positions(items: DataFrame, through: Callable[[DataFrame, str], DataFrame], key: str = "id", parent: str = "parentItem") -> DataFrame:
    """id, root and depth of every item.  ``through`` writes rows under a name and reads them back."""
    rows = items.select(F.col(key).alias("id"), F.col(parent).alias("up")).where("id IS NOT NULL").groupBy("id").agg(F.min("up").alias("up"))
    known = rows.select(F.col("id").alias("there"))
    linked = rows.where("up <> id").join(known, F.col("up") == F.col("there"), "left_semi").select("id", "up", F.lit(1).cast("long").alias("far"))
    state = rows.select("id").join(linked, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.coalesce("far", F.lit(0)).alias("far"), F.col("up").isNull().alias("done"))
    state = through(state, "tree-0")
    total, left, n = state.count(), state.where("NOT done").count(), 0
    while left and 1 << n <= total:  # a pointer that spans as many levels as there are items runs on a cycle
        n += 1
        ends = state.where("NOT done").select(F.col("up").alias("end")).distinct()
        ends = through(ends.join(state, F.col("end") == F.col("id")).select("end", F.col("up").alias("next"), F.col("far").alias("more"), F.col("done").alias("last")), f"ends-{n}")
        ends = F.broadcast(ends) if ends.limit(BROADCAST_ENDS + 1).count() <= BROADCAST_ENDS else ends
        moved = state.where("NOT done").join(ends, F.col("up") == F.col("end")).select("id", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), F.col("last").alias("done"))
        state = through(state.where("done").unionByName(moved), f"tree-{n}")
        left = state.where("NOT done").count()
    return state.select("id", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("far")).alias("depth"))


def below(items: DataFrame, top: int, through: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """id and depth (0 for the item itself) of an item and all that stands below it, wherever it stands."""
    cut = items.select("id", F.when(F.col("id") != top, F.col("parentItem")).alias("parentItem"))
    return positions(cut, through).where(F.col("root") == top).select("id", "depth")
