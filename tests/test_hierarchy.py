import random

from quillstone.operators import hierarchy, ingest
from quillstone.sources.store import written


def plain(rows):
    up = {}
    for i, p in rows:
        if i is not None:
            up[i] = min((x for x in (up.get(i), p) if x is not None), default=None)
    out = {}
    for i in up:
        at, far, seen = i, 0, set()
        while up[at] is not None and up[at] != at and up[at] in up and at not in seen:
            seen.add(at)
            at, far = up[at], far + 1
        out[i] = (None, None) if at in seen else (at, far)
    return out


def test_positions_equal_walking(spark):
    dice = random.Random(4)
    rows = [(i, dice.choice([None, i, 999, *range(max(1, i - 5), i)])) for i in range(1, 200)]
    rows += [(i, i - 1) for i in range(1000, 1300)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (2004, 2003)]  # a long chain, a cycle and what hangs on it
    rows += [(3000 + i, 1000) for i in range(300)] + [(None, 5), (3000, 2), (3000, None)]  # very many below one
    df = spark.createDataFrame(rows, "id long, parentItem long")
    got = {r.id: (r.root, r.depth) for r in hierarchy.positions(df, written(spark, "tree")).collect()}
    assert got == plain(rows) and got[2004] == (None, None) and got[1299] == (1000, 299)
    assert {r.id: r.depth for r in hierarchy.below(df, 1290, written(spark, "tree")).collect()} == {1290 + i: i for i in range(10)}
    assert hierarchy.positions(df.where("false"), written(spark, "tree")).count() == 0


def test_last_seen(spark):
    df = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 0, None), (1, "b", 0, "y"), (2, None, 5, "z"), (None, "c", 1, "n"), (None, "d", 1, "m")], "id long, modifiedDate string, event_id long, v string")
    got = ingest.last_seen(df, "id", "modifiedDate", "event_id", "v")
    assert got.columns == df.columns and {(r.id, r.modifiedDate, r.v) for r in got.collect()} == {(1, "b", "y"), (2, None, "z"), (None, "d", "m")}
