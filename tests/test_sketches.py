from pyspark.sql import functions as F

from quillstone.operators import sketches
from quillstone.plans import catalog


def test_united_sketches_are_near(spark, small):
    rows = spark.read.parquet(f"{small}/events.parquet")
    got = {r.field: r.n for r in catalog.QUERIES["sketch_distinct"](spark, small).collect()}
    assert set(got) == {"event_id", "user_id", "event_type", "props"}
    for field, n in got.items():
        true = rows.agg(F.countDistinct(field)).first()[0]
        assert abs(n - true) <= max(1, 0.05 * true)
    large = spark.range(300_000).select("id", (F.col("id") % 1000).alias("few"), F.lit(None).cast("string").alias("none"), F.array("id").alias("other"))
    parts = sketches.of(large.where("id < 200000"), "t").unionByName(sketches.of(large.where("id >= 100000"), "t"))
    n = {r.field: r.n for r in sketches.distinct(parts).collect()}
    assert set(n) == {"id", "few", "none"} and n["none"] == 0 and abs(n["id"] - 300_000) < 15_000 and abs(n["few"] - 1000) < 50
    assert {r.n for r in sketches.distinct(sketches.of(large.where("false"), "t")).collect()} == {0}
