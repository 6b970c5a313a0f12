import json

import pytest

from quillstone.engine import Engine, as_json, as_text
from quillstone.sources import paged


def item(i, modified="2024-01-01T00:00:00.000+0000", **fields):
    return {"id": [i] if i == 7 else i, "documentKey": f"K-{i}", "itemType": [11], "project": 5, "modifiedDate": modified, "createdDate": modified,
            "fields": {"name": f"Upload file {i}", "description": f"<p>user uploads large files {i}</p>", "status": [1, 2], "custom$11": True, "testCaseSteps": [{"action": "<b>x</b>"}, "bad", {"expectedResult": "y"}], **fields},
            "location": {"sequence": f"1.{i}", "globalSortOrder": i, "parent": {"item": 1}}}


@pytest.fixture
def source(tmp_path):
    def put(name, rows):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))

    put("projects", [{"id": 5, "projectKey": "P", "fields": {"name": "Five"}}])
    put("itemtypes", [{"id": 11, "typeKey": "REQ", "display": "Requirement"}])
    put("picklistoptions", [{"id": 1, "name": "Open", "pickList": 9}])
    put("relationshiptypes", [{"id": 3, "name": "verifies"}])
    put("relationships", [{"id": 1, "fromItem": 1, "toItem": 60, "relationshipType": 3, "suspect": True}])
    put("items", [item(i) for i in range(1, 61)] + [{"id": 500, "project": 5}])
    return tmp_path, put


def test_pages_and_pushdown(spark, source):
    path, put = source
    put("items", [item(i, f"2024-01-{i % 28 + 1:02d}") for i in range(1, 102)])
    rows = paged.scan(spark, str(path), "items", project=5)
    assert rows.count() == 101 and sorted({r.page for r in rows.collect()}) == [0, 50, 100]
    assert rows.where("modifiedDate >= '2024-01-20'").count() == sum(i % 28 + 1 >= 20 for i in range(1, 102))
    put("items", [])
    assert paged.scan(spark, str(path), "items").count() == 0


def test_life_of_a_project(spark, source, tmp_path, monkeypatch):
    path, put = source
    e = Engine(spark, str(tmp_path / "root"), str(path))
    assert e.init("Five", with_links=True) == {5: "built"} and e.init(5) == {5: "present"}
    seven = e.store.read(5, "items").where("id = 7").first()
    assert (seven.typeKey, seven.statusName, seven.status, seven.stepsText, seven.description) == ("REQ", "Open", "1;2", "x y", "user uploads large files 7")
    kv = {r.key: r.value for r in e.store.read(5, "fields_kv").where("itemId = 7").collect()}
    assert kv["custom$11"] == "True" and kv["status"] == "1;2" and "description" not in kv
    assert [tuple(r) for r in e.store.read(5, "relationships").collect()] == [(1, 1, 60, 3, "verifies", 1)]
    found = e.search(5, query="user uploads", top=3, offline=True)
    assert found.count() == 3 and "fts+like" in as_text(found) and json.loads(as_json(found))[0]["id"]
    assert e.semantic(5, "user uploads large files", top=2, max_distance=0.9, offline=True).count() == 2
    assert e.query(5, "SELECT count(*) AS n FROM items JOIN fields_kv ON itemId = id WHERE key = 'custom$11'", offline=True).first().n == 60
    put("items", [item(i) for i in range(1, 60)] + [item(60, "2024-02-01T00:00:00.000+0000", name="Renamed")])
    monkeypatch.setenv("QUILLSTONE_DELTA_LIMIT", "500")
    assert e.update(5) == {5: "updated"} and e.sync(5) == "unchanged"
    assert [r.id for r in e.match(5, "renamed").collect()] == [60]
    put("items", [item(i) for i in range(1, 31)])
    assert e.reconcile(5)["deleted"] == 31 and e.store.read(5, "relationships").count() == 0
    assert e.status().first()["items"] == 30
    assert e.purge(5) == [5] and e.store.projects() == []
    assert e.cache_state(5) == "missing"


def test_commands(spark, source, tmp_path, capsys):
    from quillstone.__main__ import main

    path, _ = source
    go = lambda *a: main(["--root", str(tmp_path / "root"), "--base", str(path), *a])
    assert go("query", "5", "SELECT 1 AS x", "--offline") == 2 and "init" in capsys.readouterr().err
    assert go("init", "Five") == 0 and "built" in capsys.readouterr().out
    assert go("--json", "search", "5", "--expr", "upload and files", "--top", "2", "--offline") == 0
    assert len(json.loads(capsys.readouterr().out)) == 2
    assert go("query", "5", "SELECT count(*) AS n FROM items", "--offline") == 0 and "61" in capsys.readouterr().out
    assert go("search", "5", "--expr", "(", "--offline") == 2 and go("search", "5", "x", "--top", "-1", "--offline") == 2
    assert go("query", "--project", "5", "--sql", "SELECT count(*) AS n, 'fts_match(''x'')' AS t FROM items -- fts_match('y')", "--offline") == 0
    assert "fts_match(" in capsys.readouterr().out
    assert go("search", "--project", "Five", "--query", "user", "--query", "uploads", "--top", "1", "--offline", "--concurrency", "3") == 0
    assert go("search", "--project", "5", "user uploads", "--expr", "upload and", "--expr", "files", "--offline", "--output", str(tmp_path / "hits.txt")) == 0
    assert "Upload file" in (tmp_path / "hits.txt").read_text() and go("query", "--sql", "SELECT 1") == 2
    capsys.readouterr()
    assert go("projects", "--project", "x", "--project", "fi") == 0 and "Five" in capsys.readouterr().out and go("index", "--project", "5") == 0
    assert go("semantic", "5", "user uploads", "--approximate", "--offline") == 0
    assert go("purge", "5") == 0 and go("status") == 0


def test_a_server_that_refuses_and_waits(monkeypatch):
    import http.server
    import threading

    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def answer(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_POST(self):
            asked.append("token")
            self.answer(200, {"access_token": f"t{asked.count('token')}"})

        def do_GET(self):
            asked.append(self.headers["Authorization"])
            code = {1: 401, 2: 429}.get(sum(x != "token" for x in asked), 200)
            self.answer(code, {"meta": {"pageInfo": {"totalResults": 3}}, "data": [{"id": 1}]})

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(paged, "WAIT", 0.01)
    client = paged.Client(f"http://127.0.0.1:{server.server_port}/rest/latest", "me:secret")
    assert client.page("items", 0, 50, {})["data"] == [{"id": 1}] and client.count("items", {}) == 3
    assert asked[:4] == ["token", "Bearer t1", "token", "Bearer t2"]
    server.shutdown()
    assert paged.Client("http://127.0.0.1:1/rest", "x").count("items", {}) is None


class Site:
    """A server of items, options and links in this process.  asked: the paths of all requests; fails: path to the codes
    that its next requests get."""

    def __init__(self, items, links=None, options=None):
        import http.server
        import threading
        import urllib.parse

        self.items, self.links, self.options, self.asked, self.fails, self.total = items, links or {}, options or {}, [], {}, True
        site = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                self.answer("/rest/oauth/token", {"access_token": "t"})

            def do_GET(self):
                at = urllib.parse.urlparse(self.path)
                args = dict(urllib.parse.parse_qsl(at.query))
                path = at.path.removeprefix("/rest/v1/")
                start, size = int(args.get("startAt", 0)), int(args.get("maxResults", 20))
                if path.startswith("picklistoptions/"):
                    return self.answer(path, {"data": site.options[int(path.split("/")[1])]} if int(path.split("/")[1]) in site.options else None)
                rows = site.links.get(int(path.split("/")[1])) if path.startswith("items/") else {"abstractitems": site.items, "itemtypes": [], "projects": [], "relationshiptypes": []}.get(path)
                if rows is not None and "modifiedDate" in args:
                    rows = [r for r in rows if r["modifiedDate"] >= args["modifiedDate"]]
                meta = {"pageInfo": {"totalResults": len(rows)}} if site.total and rows is not None else {}
                self.answer(path, None if rows is None else {"meta": meta, "data": rows[start : start + min(size, 50)]}, size)

            def answer(self, path, body, size=0):
                codes = site.fails.get(path)
                code = codes.pop(0) if codes else 404 if body is None else 200
                site.asked.append((path, size))
                self.send_response(code)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}"


def edge(n, a):
    return {"id": n, "fromItem": a, "toItem": a + 1, "relationshipType": 3}


def test_links_of_every_page_and_item(spark, monkeypatch):
    monkeypatch.setattr(paged, "WAIT", 0.01)
    site = Site([], {1: [edge(k, 1) for k in range(120)], 3: [edge(200, 3)], 4: [], 5: [edge(300 + k, 5) for k in range(50)]})  # 2 has no such endpoint
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id long")
    client = paged.Client(site.base, "me:secret")
    assert sorted(json.loads(r.record)["id"] for r in paged.links(ids, client, tasks=1).collect()) == [*range(120), 200, *range(300, 350)]
    assert sum(p == "/rest/oauth/token" for p, _ in site.asked) == 1  # the driver's token serves the tasks
    assert paged.links(ids, client, cap=1).count() == 120
    site.fails["items/3/downstreamrelationships"] = [429, 503, 429]
    assert paged.links(ids, client, tasks=2).count() == 171
    site.fails["items/3/downstreamrelationships"] = [500] * 100
    with pytest.raises(Exception, match="500"):
        paged.links(ids, client, tasks=2).count()


def test_a_token_is_tried_again(monkeypatch):
    monkeypatch.setattr(paged, "WAIT", 0.01)
    monkeypatch.setattr(paged, "_tokens", {})
    site = Site([])
    site.fails["/rest/oauth/token"] = [503, 429]
    assert paged.Client(site.base, "you:secret").bearer() == "t" and len(site.asked) == 3
    site.fails["/rest/oauth/token"] = [401]
    with pytest.raises(OSError):
        paged.Client(site.base, "you:wrong").bearer()
    assert len(site.asked) == 4


def test_a_scan_of_unknown_length_fails(spark, tmp_path):
    site = Site([item(i) for i in range(1, 121)])
    assert paged.scan(spark, site.base, "items").count() == 120
    site.total = False
    with pytest.raises(Exception, match="how many"):
        paged.scan(spark, site.base, "items").count()
    e = Engine(spark, str(tmp_path / "root"), site.base)
    with pytest.raises(Exception, match="how many"):
        e.build(5)
    assert e.cache_state(5) == "missing" and e.store._names(e.store._home(5)) == []


def test_a_build_sweeps_the_source_once(spark, tmp_path):
    site = Site([item(i, "2024-01-01T00:00:00.000+0000" if i == 120 else "2023-06-01T00:00:00.000+0000") for i in range(1, 121)], {i: [edge(i, i)] for i in range(1, 121)}, {1: {"id": 1, "name": "Open", "pickList": 9}})
    e = Engine(spark, str(tmp_path / "root"), site.base)
    e.build(5, with_links=True)
    sweeps = [p for p, size in site.asked if p == "abstractitems" and size == 50]
    assert len(sweeps) == 3  # the three pages of one sweep
    assert sorted(p for p, _ in site.asked if p.startswith("picklistoptions/")) == ["picklistoptions/1", "picklistoptions/2"]
    assert sum(p.endswith("downstreamrelationships") for p, _ in site.asked) == 120
    meta = e.store.meta(5)
    assert (meta["item_count"], meta["relationship_count"], meta["picklist_count"]) == ("120", "120", "1")
    assert {r.statusName for r in e.store.read(5, "items").collect()} == {"Open"} 
    home = e.store._home(5)
    assert all("_temp" not in e.store._names(f"{home}/{v}") for v in e.store._names(home) if v.startswith("v="))
    # an update asks for the delta only, and for no option again that is known
    site.asked.clear()
    site.items[2] = item(3, "2024-02-01T00:00:00.000+0000", name="Renamed thing")
    assert e.sync(5, with_vectors=False) == "updated"
    assert len([p for p, size in site.asked if p == "abstractitems" and size == 50]) == 1 and [p for p, _ in site.asked if p.startswith("pick")] == ["picklistoptions/2"]
    assert [r.id for r in e.match(5, "renamed").collect()] == [3] and e.store.read(5, "items").count() == 120
    whole = {tuple(r) for r in e.store.read(5, "postings").select("term", "id", "field", "dl", "n").collect()}
    from quillstone.operators import fulltext

    again = fulltext.postings(fulltext.index(e.store.read(5, "items")), 16).select("term", "id", "field", "dl", "n")
    assert whole == {tuple(r) for r in again.collect()}
    assert e.query(5, "SELECT count(*) AS n FROM fts_match('upload') JOIN items USING (id)", offline=True).first().n == 120


def test_a_version_is_always_in_force(spark, tmp_path):
    from quillstone.sources.store import Store

    store = Store(spark, str(tmp_path))
    rows = spark.range(3)
    assert store.version(1) is None and store.projects() == []
    assert store.write(1, {"items": rows}, {"a": "1"}) == 1
    one, two = store.stage(1), store.stage(1)
    one.put("items", spark.range(5))
    two.put("items", spark.range(9))
    assert store.read(1, "items").count() == 3
    assert one.commit({"a": "2"}) == 2 and store.read(1, "items").count() == 5
    with pytest.raises(RuntimeError, match="someone else"):
        two.commit({"a": "3"})
    left = store.stage(1)
    left.put("items", spark.range(100))  # a writer that never commits
    assert store.version(1) == 2 and store.read(1, "items").count() == 5 and store.meta(1) == {"a": "2"}
    assert store.write(1, {}, {"a": "4"}) == 3 and store.read(1, "items").count() == 5
    assert store._commits(1) == [2, 3]


def tiny_model(path, words, dim):
    """A sentence model as an ONNX file: looks up a row of numbers for each token.  The format's fields are written out by
    their numbers, as there is no library here that makes such files."""
    import numpy as np

    def number(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    def field(k, value):
        return number(k << 3) + number(value) if isinstance(value, int) else number(k << 3 | 2) + number(len(value)) + value

    def put(name, kind, *dims):
        shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    rows = np.random.default_rng(2).standard_normal((words, dim)).astype("<f4")
    tensor = field(1, words) + field(1, dim) + field(2, 1) + field(8, b"rows") + field(9, rows.tobytes())
    node = field(1, b"rows") + field(1, b"input_ids") + field(2, b"out") + field(4, b"Gather")
    graph = field(1, node) + field(2, b"g") + field(5, tensor) + field(11, put(b"input_ids", 7, b"n", b"t")) + field(12, put(b"out", 1, b"n", b"t", dim))
    path.write_bytes(field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13)))
    return rows


def test_a_model_by_path(spark, source, tmp_path):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillstone.operators import vectors

    tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    encoder = Tokenizer.from_file(tokenizer)
    rows = tiny_model(tmp_path / "tiny.onnx", encoder.get_vocab_size(), 8)
    model = vectors.OnnxEmbedder(str(tmp_path / "tiny.onnx"), tokenizer, 8)
    texts = ["renamed", "upload file", "a much longer text with many words"]
    want = np.array([rows[encoder.encode(t).ids[0]] for t in texts])
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(model.passages(texts), want, atol=1e-6) and np.allclose(model.query(texts[1]), want[1], atol=1e-6)
    path, put = source
    put("items", [item(1, name="Renamed by one"), item(2, name="Upload things"), item(3, name="renamed again")])
    e = Engine(spark, str(tmp_path / "root"), str(path), embedder=model)
    assert e.init(5) == {5: "built"} and e.vector_state(5) == "ready" and e.store.meta(5, "vmeta")["dim"] == "8"
    found = e.semantic(5, "Upload nothing", max_distance=0.001, offline=True).collect()
    assert [(r.id, r.score) for r in found] == [(2, 1.0)]
    other = Engine(spark, str(tmp_path / "root"), str(path))
    assert other.vector_state(5) == "stale"


def test_what_a_search_looks_for(monkeypatch):
    from types import SimpleNamespace

    from quillstone import engine
    from quillstone.plans import boolexpr as B

    class Bare(Engine):
        def __post_init__(self):
            self.store = SimpleNamespace(read=lambda project, table: table, tables=lambda project: [])
            self.embedder = SimpleNamespace(query=lambda words: words)

        def single(self, given):
            return given

        def _ready(self, *_):
            pass

        def postings(self, project):
            return "postings"

    monkeypatch.setattr(engine.search, "hybrid", lambda items, index, tree, chunks, vector, *_, **__: (tree, vector))
    find = Bare(None, "", "").search
    T = B.Term
    assert find(5, query="can't upload a file") == (T("can't upload a file"), "can't upload a file")
    assert find(5, query="a b, c") == (B.Or((T("a b"), T("c"))), "a b, c")
    assert find(5, keywords=["x,y", "z"], match="all") == (B.And((T("x"), T("y"), T("z"))), "x y z")
    assert find(5, query="q", keywords=["x"]) == (T("x"), "q")
    assert find(5, keywords=["ignored"], expr="a and not b or c") == (B.Or((B.And((T("a"), B.Not(T("b")))), T("c"))), "a c")
    assert find(5, expr="not x") == (B.Not(T("x")), None)
    with pytest.raises(ValueError):
        find(5)
