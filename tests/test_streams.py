"""The stream source, the keyed state and the result sink."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillstone.engine import as_text
from quillstone.sources import paged, sink
from quillstone.sources.store import Store
from quillstone.streaming import last_seen

from .test_engine import Site, item


def run(rows, at, sink_name="out"):
    """One run until nothing is new; gives the number of batches there have been."""
    q = rows.writeStream.format("parquet").option("path", f"{at}/{sink_name}").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return len([n for n in os.listdir(f"{at}/progress/commits") if n.isdigit()])


def read(spark, at):
    return sorted((json.loads(r.record)["documentKey"], r.modifiedDate) for r in spark.read.parquet(f"{at}/out").collect())


def test_a_stream_takes_up_where_it_stopped(spark, tmp_path):
    day = lambda n, ms=0: f"2024-01-{n:02d}T00:00:00.{ms:03d}+0000"
    site = Site([item(i, day(i % 9 + 1)) for i in range(1, 121)])
    rows = paged.stream(spark, site.base, "items")
    assert run(rows, tmp_path) == 1
    assert read(spark, tmp_path) == sorted((f"K-{i}", day(i % 9 + 1)) for i in range(1, 121))
    site.asked.clear()
    assert run(rows, tmp_path) == 1  # nothing is new, nothing comes again
    assert not [s for p, s in site.asked if s == 50]  # counts were asked for only
    before = read(spark, tmp_path)
    site.items += [item(200, day(9)), item(201, day(20, 7))]  # one of the watermark's own moment, one after it
    assert run(rows, tmp_path) == 2
    new = read(spark, tmp_path)
    for r in before:
        new.remove(r)
    again = [(f"K-{i}", day(9)) for i in range(1, 121) if i % 9 == 8]  # the delta is inclusive
    assert sorted(new) == sorted([*again, ("K-200", day(9)), ("K-201", day(20, 7))])
    assert run(rows, tmp_path) == 2


def test_late_records(spark, tmp_path):
    site = Site([item(1, "2024-01-05T00:00:00.000+0000")])
    strict, loose = (paged.stream(spark, site.base, "items", lateness=n) for n in (None, 3 * 86_400))
    assert run(strict, tmp_path / "a") == 1 and run(loose, tmp_path / "b") == 1
    site.items += [item(2, "2024-01-03T00:00:00.000+0000"), item(3, "2024-01-01T00:00:00.000+0000")]
    assert run(strict, tmp_path / "a") == 1 and run(loose, tmp_path / "b") == 2
    assert {k for k, _ in read(spark, tmp_path / "b")} == {"K-1", "K-2"}  # the third is later than that


def test_a_stream_of_nothing(spark, tmp_path):
    site = Site([])
    rows = paged.stream(spark, site.base, "items")
    assert rows.isStreaming
    q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_a_folder_is_read_a_block_at_a_time(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(paged, "BLOCK", 300)
    monkeypatch.setattr(paged.Client, "_rows", lambda *a: pytest.fail("the whole file was read"))
    day = lambda i: f"2024-01-{i % 28 + 1:02d}T00:00:00.000+0000"
    at = tmp_path / "items.jsonl"
    at.mkdir()
    rows = [{"id": i, "modifiedDate": day(i), "name": "ä" * (i % 50)} for i in range(300)]
    rows[7] |= {"name": "long" * 900}
    rows[11] |= {"modifiedDate": None}
    lines = [json.dumps(r, ensure_ascii=i % 2 > 0).encode() for i, r in enumerate(rows)]
    (at / "part-0.txt").write_bytes(b"\n\n".join(lines[:100]))  # empty lines, none at the end
    (at / "part-1.txt").write_bytes(b"")
    (at / "part-2.txt.gz").write_bytes(gzip.compress(b"\n".join(lines[100:250]) + b"\n"))
    (at / "part-3.txt").write_bytes(b"\r\n".join(lines[250:]) + b"\r\n")
    client = paged.Client(str(tmp_path))
    for since in ("", "2024-01-15"):
        query = {"modifiedDate": since} if since else {}
        want = [r for r in rows if not since or (r["modifiedDate"] or "") >= since]
        assert client.total("items", query) == len(want) and client.told("items", query)[1] == day(27)
        places, n = client.starts("items", query, 40)
        assert n == len(want) and len(places) == -(-n // 40)
        reader = paged.PagedReader({"base": str(tmp_path), "page": "40"} | ({"modifiedsince": since} if since else {}))
        got = [[json.loads(r[0])["id"] for r in reader.read(p)] for p in reader.partitions()]
        assert got == [[r["id"] for r in want[i : i + 40]] for i in range(0, n, 40)]
    stream = paged.PagedStream({"base": str(tmp_path), "page": "40", "modifiedsince": "2024-01-15"})
    end = stream.latestOffset()
    assert end == {"mark": day(27), "since": day(27), "n": sum(r["modifiedDate"] == day(27) for r in rows)}
    got = [json.loads(x[0])["id"] for s in stream.partitions(stream.initialOffset(), end) for x in stream.read(s)]
    assert got == [r["id"] for r in rows if (r["modifiedDate"] or "") >= "2024-01-15"] and stream.latestOffset() == end
    mixed = tmp_path / "mixed.jsonl"
    mixed.write_text('{"id": 1, "modifiedDate": 5}\n{"id": 2, "modifiedDate": "2024"}\n')
    assert client.total("mixed", {}) == 2 and client.told("mixed", {})[1] == "2024" and client.total("none", {}) == 0


def test_only_changes_pass(spark, tmp_path):
    batches = [
        [(1, "b", 1, "x"), (1, "c", 0, "y"), (2, None, None, "n"), (None, "a", 1, "k")],
        [(1, "a", 9, "late"), (2, "a", 0, "later"), (3, "a", 0, "new"), (1, "c", 0, "again")],
        [(1, "c", 1, "tie"), (3, "a", 0, "same"), (None, "b", 0, "k2")],
    ]
    schema = "id long, modifiedDate string, event_id long, v string"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    seen, store = [], Store(spark, str(tmp_path / "store"))
    upsert = last_seen.into(store, 1)

    def each(batch, number):
        seen.append({r.v for r in batch.collect()})
        upsert(batch, number)
        upsert(batch, number)  # a batch that comes again changes nothing

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = last_seen.changed(files).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 3 and set().union(*seen) <= {"x", "y", "n", "k", "late", "later", "new", "tie", "k2", "again", "same"}
    want = {1: "tie", 2: "later", 3: {"new", "same"}, None: "k2"}
    got = {r.id: r.v for r in store.read(1, "items").where("id IS NOT NULL").collect()}
    assert {k: v for k, v in got.items() if k != 3} == {1: "tie", 2: "later"} and got[3] in want[3]


def test_a_result_in_one_file(spark, tmp_path):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("näme\n"), F.repeat(F.lit("x"), F.col("id").cast("int")))).alias("name"), F.array("id").alias("a"), F.expr("timestamp'2024-01-01'").alias("t")).repartitionByRange(5, "id").sortWithinPartitions("id")
    at = str(tmp_path / "hits.json")
    sink.save(rows, at)
    got = json.loads(open(at, encoding="utf-8").read())
    assert [r["id"] for r in got] == list(range(500)) and got[4]["name"] == "näme\nxxxx" and got[3]["name"] is None and got[5]["a"] == [5]
    text = str(tmp_path / "hits.txt")
    flat = rows.select("id", F.regexp_replace("name", "\n", " ").alias("name"))
    sink.save(flat, text, "text")
    assert open(text, encoding="utf-8").read() == as_text(flat) + "\n"
    sink.save(rows.where("false"), at)
    assert json.loads(open(at, encoding="utf-8").read()) == []
    assert sorted(os.listdir(tmp_path)) == ["hits.json", "hits.txt"]


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "hits.json")
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sink.save(bad, at)
    assert os.listdir(tmp_path) == []
    sink.save(spark.range(2).coalesce(1), at)
    with pytest.raises(Exception, match="no"):
        sink.save(bad, at)
    assert json.loads(open(at).read()) == [{"id": 0}, {"id": 1}] and os.listdir(tmp_path) == ["hits.json"]
    with pytest.raises(Exception, match="neither"):
        sink.save(spark.range(1), at, "csv")
