"""A data source over paged JSON endpoints: one partition a page, a date filter pushed to the server, retries in the reader.

Pages have the form {"meta": {"pageInfo": {"totalResults": n}}, "data": [record, ...]}.  Where the base is a folder, the
pages of an endpoint are made from its file <endpoint>.jsonl (or a folder of parts), which stands in for a server in tests
and offline.  Planning a scan goes through such files a block at a time and keeps where each page begins; a task reads from
there on until its page is full.

A scan whose total the server doesn't tell fails rather than give a part of the records.  The driver asks for the token
and hands it to the tasks, which ask anew only if it is refused.

    spark.dataSource.register(PagedItems)
    spark.read.format("paged_items").option("base", ...).option("endpoint", "items").load()
"""

from __future__ import annotations

import base64
import datetime
import itertools
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyarrow import json as pajson
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThanOrEqual, InputPartition

#: Rows of a page; tries at a server that fails or asks to wait; tries with a refused token.
PAGE, TRIES, TOKEN_TRIES = 50, 6, 2
#: Bytes of an endpoint's files that are looked at together.
BLOCK = 8 << 20
#: Seconds that a token serves, and the first wait between tries.
TOKEN_SECONDS, WAIT = 3300, 1.0
# Where the interface lies under a server's address, the paths of endpoints that are named otherwise there,
# and the name of the date filter.
API, PATHS, SINCE = "rest/v1", {"items": "abstractitems"}, "modifiedDate"
_tokens: dict[tuple[str, str], tuple[str, float]] = {}
_files: dict[str, tuple[list, list[dict]]] = {}
_told: dict[str, tuple[list, dict]] = {}


@dataclass
class Client:
    """base: a server's address (what follows /rest is left out) or a folder.  token: a bearer token, or ``id:secret`` of an
    account that may ask for one.  shared: a bearer token and the time until which it serves, from who asked for it."""

    base: str
    token: str = ""
    shared: tuple[str, float] | None = None
    wait: float = field(default_factory=lambda: WAIT)

    @property
    def served(self) -> bool:
        """Whether the base is a server and not a folder (on any file system)."""
        return self.base.startswith(("http://", "https://"))

    @property
    def root(self) -> str:
        return self.base.split("/rest")[0].rstrip("/")

    def handed(self) -> Client:
        """This client with a token that tasks can use without asking for one themselves."""
        if self.served and ":" in self.token:
            self.bearer()
            return replace(self, shared=_tokens[(self.base, self.token)])
        return self

    def bearer(self, fresh: bool = False) -> str:
        """The token to send; one that was asked for serves for 55 minutes, unless a fresh one is wanted."""
        if ":" not in self.token:
            return self.token
        known = _tokens.get((self.base, self.token)) or self.shared
        if fresh or known is None or time.time() > known[1]:
            form = urllib.parse.urlencode({"grant_type": "client_credentials"}).encode()
            account = base64.b64encode(self.token.encode()).decode()
            ask = urllib.request.Request(f"{self.root}/rest/oauth/token", form, {"Authorization": f"Basic {account}"})
            known = self._asked(lambda: ask, lambda code: code == 429 or code >= 500)["access_token"], time.time() + TOKEN_SECONDS
            _tokens[(self.base, self.token)] = known
        return known[0]

    def _asked(self, request, again) -> dict:
        """The answer to what ``request`` makes, tried again after growing waits where the network fails or ``again``
        says so of the server's code."""
        for n in range(TRIES + 1):
            try:
                with urllib.request.urlopen(request(), timeout=60) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:
                if n == TRIES or not again(e.code):
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if n == TRIES:
                    raise
            time.sleep(min(30, self.wait * 2**n))
        raise TimeoutError(self.base)

    def get(self, path: str, query: dict[str, str | int]) -> dict:
        refused = 0

        def request() -> urllib.request.Request:
            bearer = self.bearer(fresh=refused > 0)
            head = {"Authorization": f"Bearer {bearer}"} if bearer else {}
            return urllib.request.Request(f"{self.root}/{API}/{PATHS.get(path, path)}" + (f"?{urllib.parse.urlencode(query)}" if query else ""), headers=head)

        def again(code: int) -> bool:
            nonlocal refused
            refused += code == 401
            return code == 429 or code >= 500 or code == 401 and refused <= TOKEN_TRIES

        return self._asked(request, again)

    def page(self, endpoint: str, start: int, size: int, query: dict[str, str]) -> dict:
        if not self.served:
            return self._from_folder(endpoint, start, size, query)
        return self.get(endpoint, {**query, "startAt": start, "maxResults": size})

    def pages(self, endpoint: str, query: dict[str, str]) -> Iterator[dict]:
        """All records of an endpoint, a page after the other."""
        start = 0
        while True:
            answer = self.page(endpoint, start, PAGE, query)
            yield from answer.get("data") or []
            start += PAGE
            if start >= int(answer["meta"]["pageInfo"]["totalResults"]):
                return

    def one(self, endpoint: str, identifier: int) -> dict | None:
        """A single record by its identifier; None where the server has none."""
        if not self.served:
            return next((r for r in self._rows(endpoint) if r.get("id") == identifier), None)
        try:
            return self.get(f"{endpoint}/{identifier}", {}).get("data")
        except urllib.error.HTTPError as e:
            if e.code in (401, 429) or e.code >= 500:
                raise
            return None

    def _parts(self, endpoint: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
        """An endpoint's files in order; none if it has none."""
        at = f"{self.base.rstrip('/')}/{endpoint}.jsonl"
        system, inner = pafs.FileSystem.from_uri(at) if ":/" in at else (pafs.LocalFileSystem(), at)
        found = system.get_file_info(inner)
        if found.type == pafs.FileType.NotFound:
            return system, []
        files = [found] if found.is_file else [f for f in system.get_file_info(pafs.FileSelector(inner)) if f.base_name.startswith("part-")]
        return system, sorted(files, key=lambda f: f.path)

    def _rows(self, endpoint: str) -> list[dict]:
        """The records of an endpoint's files, read once while the files stay as they are."""
        at = f"{self.base.rstrip('/')}/{endpoint}.jsonl"
        system, files = self._parts(endpoint)
        if _files.get(at, (None,))[0] != _stamp(files):
            rows = []
            for f in files:
                with system.open_input_stream(f.path) as source:
                    rows += [json.loads(x) for x in source.read().splitlines() if x.strip()]
            _files.clear()  # a process holds one endpoint's
            _files[at] = _stamp(files), rows
        return _files[at][1]

    def _blocks(self, endpoint: str, at: tuple[str, int] | None = None) -> Iterator[tuple[str, int, bytes]]:
        """Whole lines of an endpoint's files from a place (file and byte) on, a block at a time, and where each block begins."""
        system, files = self._parts(endpoint)
        for f in files:
            if at is not None and f.path < at[0]:
                continue
            begin = at[1] if at is not None and f.path == at[0] else 0
            with _opened(system, f.path, begin) as source:
                rest = b""
                while more := source.read(BLOCK):
                    cut = more.rfind(b"\n") + 1
                    if cut:
                        whole, rest = rest + more[:cut], more[cut:]
                        yield f.path, begin, whole
                        begin += len(whole)
                    else:
                        rest += more
                if rest:
                    yield f.path, begin, rest

    def records(self, endpoint: str, at: tuple[str, int] | None, query: dict[str, str]) -> Iterator[dict]:
        """The records of a folder that a query asks for, from a place on."""
        for _, _, block in self._blocks(endpoint, at):
            yield from (r for x in block.split(b"\n") if x.strip() and _asked_for(r := json.loads(x), query))

    def starts(self, endpoint: str, query: dict[str, str], size: int) -> tuple[list[tuple[str, int]], int]:
        """Where the pages of a folder's records begin, and how many records there are."""
        out, n = [], 0
        for path, begin, block in self._blocks(endpoint):
            found = _found(block, query)[0]
            out += [(path, begin + int(found[i])) for i in range(-n % size, len(found), size)]
            n += len(found)
        return out, n

    def told(self, endpoint: str, query: dict[str, str]) -> tuple[int, str]:
        """The number of a folder's records and their newest date, kept while the files stay as they are."""
        at, stamp = f"{self.base.rstrip('/')}/{endpoint}.jsonl", _stamp(self._parts(endpoint)[1])
        if _told.get(at, (None,))[0] != stamp:
            _told[at] = stamp, {}
        known, key = _told[at][1], tuple(sorted(query.items()))
        if key not in known:
            n, newest = 0, ""
            for _, _, block in self._blocks(endpoint):
                found, dates = _found(block, query)
                n, newest = n + len(found), max(newest, pc.max(dates).as_py() or "")
            if len(known) > 100:
                known.clear()
            known[key] = n, newest
        return known[key]

    def _from_folder(self, endpoint: str, start: int, size: int, query: dict[str, str]) -> dict:
        if m := re.fullmatch(r"items/(\d+)/downstreamrelationships", endpoint):
            rows = [r for r in self._rows("relationships") if r.get("fromItem") == int(m[1])]
        else:
            rows = self._rows(endpoint)
        rows = [r for r in rows if _asked_for(r, query)]
        return {"meta": {"pageInfo": {"totalResults": len(rows)}}, "data": rows[start : start + size]}

    def total(self, endpoint: str, query: dict[str, str]) -> int:
        """What the server says there is, without fetching it."""
        if not self.served and "/" not in endpoint:
            return self.told(endpoint, query)[0]
        return int(self.page(endpoint, 0, 1, query)["meta"]["pageInfo"]["totalResults"])

    def count(self, endpoint: str, query: dict[str, str]) -> int | None:
        """The same, None if it can't be known."""
        try:
            return self.total(endpoint, query)
        except (OSError, KeyError, TypeError, ValueError):
            return None


def _stamp(files: list[pafs.FileInfo]) -> list[tuple]:
    return [(f.path, f.size, f.mtime_ns) for f in files]


def _opened(system: pafs.FileSystem, path: str, begin: int):
    """A file from a byte on; of a compressed one, of what it holds."""
    try:
        pa.Codec.detect(path)
    except (ValueError, TypeError):  # none of the suffixes that are known
        source = system.open_input_file(path)
        source.seek(begin)
        return source
    source = system.open_input_stream(path)
    while begin:
        begin -= len(source.read(min(begin, BLOCK)))
    return source


def _asked_for(record: dict, query: dict[str, str]) -> bool:
    """Whether a record is one that a query asks for."""
    if (since := query.get(SINCE)) and (record.get("modifiedDate") or "") < since:
        return False
    return "project" not in query or str(record.get("project")).strip("[]") == query["project"]


def _found(block: bytes, query: dict[str, str]) -> tuple[np.ndarray, pa.Array]:
    """Where in a block of lines the records that a query asks for begin, and their dates (null for none)."""
    ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10)
    begins = np.append(0, ends + 1)
    begins = begins[begins < len(block)]
    if "project" not in query:
        only = pajson.ParseOptions(explicit_schema=pa.schema([(SINCE, pa.string())]), unexpected_field_behavior="ignore")
        try:
            dates = pajson.read_json(pa.BufferReader(block), pajson.ReadOptions(use_threads=False, block_size=1 << 20), only).column(0).combine_chunks()
        except pa.ArrowInvalid:  # dates that are no text, very long lines: each record by itself, below
            dates = None
        if dates is not None and len(dates) == len(begins):
            if since := query.get(SINCE):
                kept = pc.fill_null(pc.greater_equal(dates, since), False)
                return begins[kept.to_numpy(zero_copy_only=False)], dates.filter(kept)
            return begins, dates
    found, dates = [], []
    for at, x in zip(begins, block.split(b"\n"), strict=False):
        if x.strip() and _asked_for(r := json.loads(x), query):
            found.append(at)
            dates.append(r["modifiedDate"] if isinstance(r.get("modifiedDate"), str) else None)
    return np.array(found, np.int64), pa.array(dates, pa.string())


@dataclass
class Page(InputPartition):
    """A page by the number of records before it, and where it begins in a folder's files."""

    start: int
    at: tuple[str, int] | None = None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client = Client(options["base"], options.get("token", ""))
        self.endpoint, self.size = options.get("endpoint", "items"), int(options.get("page", PAGE))
        self.limit = int(options.get("limit", 1 << 62))
        self.query = {k: options[k] for k in ("project",) if k in options}
        if "modifiedsince" in options:
            self.query[SINCE] = options["modifiedsince"]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("modifiedDate",) and isinstance(f.value, str):
                self.query[SINCE] = max(self.query.get(SINCE, ""), f.value)
            else:
                yield f

    def partitions(self) -> list[Page]:
        self.client = self.client.handed()
        if not self.client.served:
            starts, _ = self.client.starts(self.endpoint, self.query, self.size)
            return [Page(i * self.size, at) for i, at in enumerate(starts) if i * self.size < self.limit] or [Page(0)]
        try:
            total = min(self.client.total(self.endpoint, self.query), self.limit)
        except (KeyError, TypeError, ValueError) as e:
            raise RuntimeError(f"{self.endpoint}: the server doesn't say how many records there are") from e
        return [Page(s) for s in range(0, total, self.size)] or [Page(0)]

    def page(self, start: int, at: tuple[str, int] | None, query: dict[str, str]) -> Iterable[dict]:
        """The records of a page."""
        if self.client.served:
            return self.client.page(self.endpoint, start, self.size, query)["data"]
        return itertools.islice(self.client.records(self.endpoint, at, query), self.size)

    def read(self, partition: Page) -> Iterator[tuple]:
        for r in self.page(partition.start, partition.at, self.query):
            date = r.get("modifiedDate")
            yield json.dumps(r, ensure_ascii=False), date if isinstance(date, str) else None, partition.start


@dataclass
class Span(InputPartition):
    start: int
    since: str
    until: str
    at: tuple[str, int] | None = None


#: The first and the last moment that a watermark can be, in milliseconds.
EPOCH, LAST = 0, 4_102_444_800_000


def date_text(ms: int) -> str:
    """A moment as the source writes dates."""
    at = datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)
    return f"{at:%Y-%m-%dT%H:%M:%S}.{ms % 1000:03d}+0000"


class PagedStream(DataSourceStreamReader):
    """The source as a stream.  The offset is the watermark, the newest modification date that was seen, which the next
    batch takes in again (inclusive), and how many records there were at or after it.

    The server is asked for counts only: if as many records as before are at or after the watermark, and none after it,
    there is nothing new.  Otherwise the newest date is found by halving, some forty counts, whatever there is to fetch (a
    folder's newest date is told by one look through it); the tasks then fetch the span's pages.  ``lateness`` (seconds) lets a batch begin that much before the watermark, so records
    that come with an older date are fetched, too, and what comes again is for the upsert to leave alone.
    """

    def __init__(self, options: dict[str, str]):
        self.inner = PagedReader({k: v for k, v in options.items() if k != "modifiedsince"})
        self.first, self.lateness = options.get("modifiedsince", ""), int(options.get("lateness", 0))

    def initialOffset(self) -> dict:
        return {"mark": self.first, "since": self.first, "n": -1}

    def _count(self, since: str) -> int:
        return self.inner.client.total(self.inner.endpoint, {**self.inner.query, **({SINCE: since} if since else {})})

    def _any(self) -> Callable[[str], object]:
        """Tells whether there is a record at or after a date."""
        if self.inner.client.served:
            return self._count
        newest = self.inner.client.told(self.inner.endpoint, self.inner.query)[1]
        return lambda since: bool(newest) and since <= newest

    def latestOffset(self) -> dict:
        now = getattr(self, "at", None) or self.initialOffset()
        some = self._any()
        if now["n"] >= 0 and self._count(now["since"]) == now["n"] and not some(_after(now["mark"])):
            return now
        low, high = (_ms(now["mark"]) if now["mark"] else EPOCH), LAST
        if not some(date_text(low)):
            return now
        while low < high:  # the last moment at or after which there is a record
            middle = (low + high + 1) // 2
            low, high = (middle, high) if some(date_text(middle)) else (low, middle - 1)
        mark = date_text(low)
        since = date_text(max(EPOCH, low - 1000 * self.lateness))
        self.at = {"mark": mark, "since": since, "n": self._count(since)}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if start == end:
            return []
        self.inner.client = self.inner.client.handed()
        if not self.inner.client.served:
            query = {**self.inner.query, **({SINCE: start["since"]} if start["since"] else {})}
            places, _ = self.inner.client.starts(self.inner.endpoint, query, self.inner.size)
            return [Span(i * self.inner.size, start["since"], _after(end["mark"]), at) for i, at in enumerate(places)]
        total = self._count(start["since"])
        return [Span(s, start["since"], _after(end["mark"])) for s in range(0, total, self.inner.size)]

    def read(self, partition: Span) -> Iterator[tuple]:
        query = {**self.inner.query, **({SINCE: partition.since} if partition.since else {})}
        for r in self.inner.page(partition.start, partition.at, query):
            date = r.get("modifiedDate")
            if isinstance(date, str) and date < partition.until:  # what came since is for the next batch
                yield json.dumps(r, ensure_ascii=False), date, partition.start

    def commit(self, end: dict) -> None:
        self.at = end


def _ms(text: str) -> int:
    whole = text if len(text) > 10 else f"{text}T00:00:00.000+0000"
    at = datetime.datetime.strptime(whole, "%Y-%m-%dT%H:%M:%S.%f%z")
    return round((at - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)).total_seconds() * 1000)


def _after(mark: str) -> str:
    return date_text(_ms(mark) + 1)


class PagedItems(DataSource):
    """record (JSON), modifiedDate and page (where the record's page starts, its order of arrival)."""

    @classmethod
    def name(cls) -> str:
        return "paged_items"

    def schema(self) -> str:
        return "record string, modifiedDate string, page long"

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> PagedStream:
        return PagedStream({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, base: str, endpoint: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedItems)
    reader = spark.read.format("paged_items").option("base", base).option("endpoint", endpoint)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, v)
    return reader.load()


def stream(spark: SparkSession, base: str, endpoint: str, **options) -> DataFrame:
    """The endpoint as a stream of what is new; records without a date never come."""
    spark.dataSource.register(PagedItems)
    reader = spark.readStream.format("paged_items").option("base", base).option("endpoint", endpoint)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, v)
    return reader.load()


def looked_up(ids: DataFrame, client: Client, fetch, tasks: int = 16) -> DataFrame:
    """record: the JSON records that ``fetch(client, id)`` gives for each identifier of ids (id), in parallel."""
    client = client.handed()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = [json.dumps(r, ensure_ascii=False) for i in batch.column(0).slice(at, 200).to_pylist() for r in fetch(client, i)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record"])

    return ids.select("id").repartition(tasks).mapInArrow(run, "record string")


def downstream(client: Client, item: int) -> list[dict]:
    """All downstream relationships of an item, page by page.  Items of some kinds have no such endpoint: what the server
    refuses has none, or none beyond the pages it gave; other failures are raised once the tries are used up."""
    out: list[dict] = []
    try:
        for r in client.pages(f"items/{item}/downstreamrelationships", {}):
            out.append(r)
    except urllib.error.HTTPError as e:
        if e.code in (401, 429) or e.code >= 500:
            raise
    return out


def option(client: Client, identifier: int) -> list[dict]:
    """The picklist option with this number, if there is one."""
    found = client.one("picklistoptions", identifier)
    return [found] if found else []


def links(ids: DataFrame, client: Client, cap: int = 0, tasks: int = 16) -> DataFrame:
    """record: the downstream relationships of the identifiers (of the first ``cap``, if that is above 0)."""
    return looked_up(ids.orderBy("id").limit(cap) if cap > 0 else ids, client, downstream, tasks)
