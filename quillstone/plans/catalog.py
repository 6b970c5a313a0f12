"""The registered queries of the engine's own operators over the driver's tables, each with its DuckDB equivalent.

Items are made from documents: id = doc_id, typeKey = upper(lang), itemType = the language's rank, name = the first 60
characters, globalSortOrder = n_chars, parentItem = the source's number, dates = hours from 2024-01-01 by doc_id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ann, filters, fulltext, grams, graph, hierarchy, impacts, ingest, search, sketches, vectors
from ..sources import paged
from ..sources.store import Store, scratch, written
from ..streaming import gate, last_seen, upsert
from . import boolexpr, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LANGS = ("de", "en", "es", "fr")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    date = F.date_format(F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'")
    rank = F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang"))
    return docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("DOC-"), F.col("doc_id")).alias("documentKey"), rank.cast("long").alias("itemType"), F.upper("lang").alias("typeKey"),
        F.substring("text", 1, 60).alias("name"), F.col("text").alias("description"), F.lit("").alias("stepsText"), F.col("n_chars").alias("globalSortOrder"),
        F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("parentItem"), F.concat(F.lit("1."), F.col("doc_id")).alias("sequence"),
        date.alias("createdDate"), date.alias("modifiedDate"),
    )


ITEMS = """items AS (SELECT doc_id AS id, 'DOC-' || doc_id AS documentKey, list_position(['de', 'en', 'es', 'fr'], lang)::BIGINT AS itemType, upper(lang) AS typeKey,
  substr(text, 1, 60) AS name, text AS description, '' AS stepsText, n_chars AS globalSortOrder, regexp_extract(source, '[0-9]+')::BIGINT AS parentItem, '1.' || doc_id AS sequence,
  strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id), '%Y-%m-%dT%H:%M:%S.000+0000') AS createdDate, strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id), '%Y-%m-%dT%H:%M:%S.000+0000') AS modifiedDate FROM documents)"""
SPACES = r"[\s\x0b\x1c-\x1f\x85\x{2028}\x{2029}\p{Z}]+"


# Text functions


@query(
    rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '{SPACES}', ' ', 'g'), ' ') AS plain FROM pages"""
)
def strip_html_pages(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("plain"))


@query(
    rf"""WITH {ITEMS}, t AS (SELECT id, regexp_replace(coalesce(name, ''), '^{SPACES}|{SPACES}$', '', 'g') AS n, regexp_replace(coalesce(description, ''), '^{SPACES}|{SPACES}$', '', 'g') AS d FROM items)
SELECT id, CASE WHEN n <> '' AND d <> '' THEN n || '. ' || d ELSE n || d END AS composed FROM t"""
)
def item_text_compose(spark, d):
    return items(spark, d).select("id", text.item_text(F.col("name"), F.col("description"), F.col("stepsText")).alias("composed"))


_CHUNKS = rf"""t AS (SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1, 50000), '^{SPACES}|{SPACES}$', '', 'g') AS t FROM documents),
n AS (SELECT doc_id, t, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 1500 THEN 1 ELSE 1 + ceil((length(t) - 1500) / 1300.0)::INT END AS c FROM t)"""


@query(f"WITH {_CHUNKS}, e AS (SELECT doc_id, t, unnest(generate_series(0, c - 1)) AS chunk_no FROM n WHERE c > 0) SELECT doc_id, chunk_no::INT AS chunk_no, substr(t, 1 + chunk_no * 1300, 1500) AS chunk FROM e")
def chunk_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.coalesce("text", F.lit("")))).alias("chunk_no", "chunk"))


@query(f"WITH {_CHUNKS} SELECT c::INT AS chunks, count(*) AS documents FROM n GROUP BY c")
def chunk_counts(spark, d):
    t = text.strip(F.substring(F.coalesce("text", F.lit("")), 1, text.TEXT_CAP))
    return table(spark, d, "documents").groupBy(text.chunk_count(t).alias("chunks")).agg(F.count("*").alias("documents"))


@query(
    rf"""SELECT conv_id, coalesce(string_agg(p, ' ' ORDER BY turn, o) FILTER (WHERE p <> ''), '') AS steps FROM (
  SELECT conv_id, turn, o, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(v, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '{SPACES}', ' ', 'g'), '^ | $', '', 'g') AS p
  FROM (SELECT conv_id, turn, 1 AS o, role AS v FROM conversations UNION ALL SELECT conv_id, turn, 2, text FROM conversations)) GROUP BY conv_id"""
)
def steps_text_conversations(spark, d):
    turn = F.struct("turn", F.col("role").alias("action"), F.col("text").alias("expectedResult"), F.lit(None).cast("string").alias("notes"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(text.steps_text(F.sort_array(F.collect_list(turn))).alias("steps"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_exists(props, '$.k')")
def kv_explode_events(spark, d):
    raw = table(spark, d, "events").select(F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"fields":'), F.col("props"), F.lit("}")).alias("record"))
    return ingest.key_values(ingest.records(raw)).select(F.col("itemId").alias("event_id"), "key", "value")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first_value FROM embeddings")
def boxed_scalar(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(text.unboxed(F.col("embedding")).cast("double"), 6).alias("first_value"))


@query("SELECT doc_id, coalesce(lang || ';', '') || coalesce(source || ';', '') || n_chars AS joined FROM documents")
def field_text_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit('["'), F.col("lang"), F.lit('",null,"'), F.col("source"), F.lit('",'), F.col("n_chars"), F.lit("]")).alias("j"))
    return docs.select("doc_id", ingest.field_text(F.parse_json("j")).alias("joined"))


# Filters


@query("SELECT id, typeKey FROM (WITH " + ITEMS + " SELECT * FROM items) WHERE typeKey = 'EN' OR itemType = 4")
def type_filter(spark, d):
    return items(spark, d).where(filters.types("EN, 4,")).select("id", "typeKey")


@query("WITH " + ITEMS + " SELECT typeKey, count(*) AS n FROM items WHERE lower(typeKey) IN ('de', 'fr') GROUP BY typeKey")
def type_filter_nocase(spark, d):
    return items(spark, d).where(filters.types("De,fR")).groupBy("typeKey").agg(F.count("*").alias("n"))


@query("WITH " + ITEMS + " SELECT id, createdDate FROM items WHERE createdDate >= '2024-01-02' AND modifiedDate <= '2024-01-10T12:00:00.000+0000'")
def date_range_inclusive(spark, d):
    return items(spark, d).where(filters.Dates(created_after="2024-01-02", modified_before="2024-01-10T12:00:00.000+0000").condition()).select("id", "createdDate")


@query("WITH " + ITEMS + " SELECT id FROM items WHERE createdDate <= '2024-01-05T99'")
def date_day_end_bound(spark, d):
    return items(spark, d).where(filters.Dates(created_before="2024-01-05").condition()).select("id")


_HAY = "(name || ' ' || coalesce(description, '') || ' ' || coalesce(stepsText, ''))"


def _like(expression: str, field: str = "all"):
    return lambda spark, d: items(spark, d).where(filters.substring(boolexpr.parse(expression), field)).select("id")


for _name, _expression, _where in (
    ("like_term", "thble", f"{_HAY} ILIKE '%thble%'"),
    ("like_and", "thble and thtion", f"{_HAY} ILIKE '%thble%' AND {_HAY} ILIKE '%thtion%'"),
    ("like_or_not", "thble or (attion and not thing)", f"{_HAY} ILIKE '%thble%' OR ({_HAY} ILIKE '%attion%' AND NOT {_HAY} ILIKE '%thing%')"),
    ("like_wildcard", '"th%ble the_"', f"regexp_matches({_HAY}, '(?is)th.*ble the.')"),
    ("like_phrase", '"of the"', f"{_HAY} ILIKE '%of the%'"),
):
    QUERIES[_name] = _like(_expression)
    ORACLES[_name] = f"WITH {ITEMS} SELECT id FROM items WHERE {_where}"


@functools.cache
def _pieces(files: tuple, spark, d) -> Store:
    """All items and the substring index of them, stored as a project's are."""
    store = Store(spark, scratch(spark, "pieces"))
    stage = store.stage(1)
    stage.put("grams", grams.grams(stage.put("items", items(spark, d))))
    stage.commit({})
    return store


def _like_index(expression: str):
    def run(spark, d):
        store = _pieces(_files(spark, d, "documents"), spark, d)
        return search.like_leg(store.read(1, "items"), boolexpr.parse(expression), limit=None, index=store.read(1, "grams")).select("id")

    return run


for _name, _expression, _like_name in (
    ("like_index_term", "thble", "like_term"), ("like_index_or_not", "thble or (attion and not thing)", "like_or_not"), ("like_index_wildcard", '"th%ble the_"', "like_wildcard"),
):
    QUERIES[_name] = _like_index(_expression)
    ORACLES[_name] = ORACLES[_like_name]


@query("SELECT p_partkey AS id FROM (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS name FROM part) WHERE NOT ((name || ' ' || p_type || ' ') ILIKE '%a%')")
def like_null_name(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("name"), F.col("p_type").alias("description"), F.lit(None).cast("string").alias("stepsText"))
    return parts.where(filters.substring(boolexpr.parse("not a"))).select("id")


@query("WITH " + ITEMS + " SELECT id FROM items WHERE name ILIKE '%the%'")
def like_field_name(spark, d):
    return items(spark, d).where(filters.substring(boolexpr.parse("the"), "name")).select("id")


@query(f"WITH {ITEMS} SELECT id, globalSortOrder FROM items WHERE {_HAY} ILIKE '%tion%' ORDER BY globalSortOrder NULLS LAST, id LIMIT 200")
def like_document_order_top200(spark, d):
    return search.like_leg(items(spark, d), boolexpr.parse("tion"))


# Full text


def _bm25(phrases: list[str], match: str, score: str, where: str = "true", columns: tuple[str, ...] = fulltext.COLUMNS, limit: str = "ORDER BY bm25, id LIMIT 200") -> str:
    """DuckDB: tokens of each column as a list, hits by comparing slices, the weights written out.

    match and score use h0, h1 ... (hits) and s0, s1 ... (weights).
    """
    toks = ", ".join(rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}\p{{Co}}]+') AS t_{c}" for c in fulltext.COLUMNS)

    def hits(p: str, c: str) -> str:
        words = p.split()
        same = " AND ".join(f"t_{c}[i + {k}] = '{w}'" for k, w in enumerate(words))
        return f"len(list_filter(range(1, len(t_{c}) - {len(words) - 2}), lambda i: {same}))"

    h = ", ".join(f"{' + '.join(hits(p, c) for c in columns)} AS h{n}" for n, p in enumerate(phrases))
    counts = ", ".join(f"count(*) FILTER (WHERE h{n} > 0) AS n{n}" for n in range(len(phrases)))
    weights = ", ".join(f"-(greatest(ln((nn - n{n} + 0.5) / (n{n} + 0.5)), 1e-6) * h{n} * 2.2 / (h{n} + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s{n}" for n in range(len(phrases)))
    return f"""WITH {ITEMS}, t AS (SELECT id, createdDate, modifiedDate, {toks} FROM items),
h AS (SELECT id, createdDate, modifiedDate, len(t_name) + len(t_description) + len(t_stepsText) AS dl, {h} FROM t),
st AS (SELECT count(*) AS nn, sum(dl) / count(*) AS avgdl, {counts} FROM h),
w AS (SELECT h.*, {weights} FROM h, st)
SELECT id, round(bm25, 6) AS bm25 FROM (SELECT id, {score} AS bm25 FROM w WHERE ({match}) AND ({where}) {limit})"""


_STORED: dict[tuple, fulltext.Postings] = {}


def _files(spark, d, name: str) -> tuple:
    """Changes when Spark or a table's files do."""
    fs, at = Store(spark, d)._at(f"{d}/{name}.parquet")
    files = fs.getContentSummary(at)
    return (spark.sparkContext.applicationId, d, name, files.getLength(), files.getFileCount(), fs.getFileStatus(at).getModificationTime())


def stored(spark, d, stemmed: bool = False) -> fulltext.Postings:
    """The index of all items, built and written when it is first asked for, as a project's is when it is cached; it serves
    until Spark ends or the documents change."""
    key = (*_files(spark, d, "documents"), stemmed)
    if key not in _STORED:
        stage, own = Store(spark, scratch(spark, "index")).stage(1), items(spark, d)
        terms = stage.put("fts", fulltext.index(own, stemmed=stemmed))
        size = fulltext.size_of(terms)
        buckets, mean = fulltext.buckets_for(size["fts_rows"]), size["fts_length"] / max(1, size["fts_rows"])
        made = stage.put("impacts", impacts.impacts(terms, mean, buckets))
        early = impacts.Early(made, stage.put("levels", impacts.level_runs(made)), terms, mean)
        stats = fulltext.stats_row(spark, size["fts_rows"], size["fts_length"])
        _STORED[key] = fulltext.Postings(stage.put("postings", fulltext.postings(terms, buckets)), stats, buckets, own.select("id", "createdDate", "modifiedDate"), early)
        stage.commit({})
    return _STORED[key]


def _fts(expression: str, field: str = "all", dates: filters.Dates | None = None):
    def run(spark, d):
        where = dates.condition() if dates else None
        return fulltext.search(stored(spark, d), boolexpr.parse(expression), field, where, stemmed=False).select("id", F.round("bm25", 6).alias("bm25"))

    return run


_WORDS = rf"unnest(regexp_extract_all(lower(coalesce({{0}}, '')), '[\p{{{{L}}}}\p{{{{N}}}}\p{{{{Co}}}}]+')) AS w"


@query(
    f"WITH {ITEMS}, w AS (SELECT id, 'name' AS field, {_WORDS.format('name')} FROM items UNION ALL SELECT id, 'description', {_WORDS.format('description')} FROM items) "
    "SELECT field, count(*) AS postings, sum(n)::BIGINT AS words, count(DISTINCT w) AS terms FROM (SELECT field, id, w, count(*) AS n FROM w GROUP BY ALL) GROUP BY field"
)
def fts_build(spark, d):
    """Builds the index anew, not yet stored, and counts what it holds."""
    rows = fulltext.postings(fulltext.index(items(spark, d), stemmed=False), 16)
    return rows.groupBy("field").agg(F.count("*").alias("postings"), F.sum("n").alias("words"), F.countDistinct("term").alias("terms"))


@query(_bm25(["thing", "ertion"], "h0 > 0 OR h1 > 0", "CASE WHEN h0 > 0 THEN s0 ELSE 0 END + CASE WHEN h1 > 0 THEN s1 ELSE 0 END"))
def fts_without_postings(spark, d):
    """The same search over token arrays that are made for it."""
    idx = fulltext.index(items(spark, d), stemmed=False)
    return fulltext.search(idx, boolexpr.parse("thing or ertion"), stemmed=False).select("id", F.round("bm25", 6).alias("bm25"))


for _name, _expression, _field, _phrases, _match, _score in (
    ("fts_term", "thble", "all", ["thble"], "h0 > 0", "s0"),
    ("fts_phrase", '"of the"', "all", ["of the"], "h0 > 0", "s0"),
    ("fts_and", "thble and thing", "all", ["thble", "thing"], "h0 > 0 AND h1 > 0", "s0 + s1"),
    ("fts_or", "thble or erble", "all", ["thble", "erble"], "h0 > 0 OR h1 > 0", "CASE WHEN h0 > 0 THEN s0 ELSE 0 END + CASE WHEN h1 > 0 THEN s1 ELSE 0 END"),
    ("fts_not", "thble and not thing", "all", ["thble", "thing"], "h0 > 0 AND NOT h1 > 0", "s0"),
    ("fts_name_column", "the", "name", ["the"], "h0 > 0", "s0"),
    ("bm25_top200", "the", "all", ["the"], "h0 > 0", "s0"),
    ("bm25_multi_term", "thing or attion or ertion", "all", ["thing", "attion", "ertion"], "h0 > 0 OR h1 > 0 OR h2 > 0", " + ".join(f"CASE WHEN h{i} > 0 THEN s{i} ELSE 0 END" for i in range(3))),
    ("boolean_expr_full", "thble or (thing, ertion and not (attion and erble))", "all", ["thble", "thing", "ertion", "attion", "erble"],
     "h0 > 0 OR (h1 > 0 AND h2 > 0 AND NOT (h3 > 0 AND h4 > 0))", "CASE WHEN h0 > 0 THEN s0 ELSE 0 END + CASE WHEN h1 > 0 AND h2 > 0 AND NOT (h3 > 0 AND h4 > 0) THEN s1 + s2 ELSE 0 END"),
):
    QUERIES[_name] = _fts(_expression, _field)
    ORACLES[_name] = _bm25(_phrases, _match, _score, columns=("name",) if _field == "name" else fulltext.COLUMNS)

QUERIES["bm25_with_date"] = _fts("thing or ertion", dates=filters.Dates(created_after="2024-01-05", created_before="2024-01-20"))
ORACLES["bm25_with_date"] = _bm25(["thing", "ertion"], "h0 > 0 OR h1 > 0", "CASE WHEN h0 > 0 THEN s0 ELSE 0 END + CASE WHEN h1 > 0 THEN s1 ELSE 0 END", "createdDate >= '2024-01-05' AND createdDate <= '2024-01-20T99'")


def _stemmed(words: dict[str, str], match: str, score: str) -> str:
    """DuckDB: as ``_bm25``, with each word replaced by a mark where it has the stem of which ``words`` gives a pattern.
    (All words of the given documents that have the stem fit its pattern; the stemmer's own tests are against SQLite.)"""
    out = _bm25([f"stem{i}" for i in range(len(words))], match, score)
    fold = "w"
    for i, pattern in enumerate(words.values()):
        fold = f"CASE WHEN regexp_full_match(w, '{pattern}') THEN 'stem{i}' ELSE {fold} END"
    for c in fulltext.COLUMNS:
        raw = rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}\p{{Co}}]+') AS t_{c}"
        out = out.replace(raw, f"list_transform({raw.removesuffix(f' AS t_{c}')}, lambda w: {fold}) AS t_{c}")
    return out


@query(_stemmed({"thing": "thing(e|ed|ing)?s?"}, "h0 > 0", "s0 + s0"))
def fts_stemmed(spark, d):
    """Both words have one stem, and a phrase that stands twice counts twice."""
    return fulltext.search(stored(spark, d, True), boolexpr.parse("thing or things")).select("id", F.round("bm25", 6).alias("bm25"))


# Snapshots, the engine over one, and the source


@functools.cache
def _snapshot(files: tuple, spark, d) -> str:
    """The root of a store with the documents' items as project 1, written as a build writes them."""
    from ..engine import KEPT, VERSION

    store = Store(spark, scratch(spark, "snapshot"))
    stage = store.stage(1)
    own = items(spark, d)
    missing = {k: F.lit(None).cast(t) for k, t in ingest.ITEMS.items() if k not in own.columns}
    flat = stage.put("items", own.withColumns(missing).select(*(F.col(k).cast(t).alias(k) for k, t in ingest.ITEMS.items())))
    edges = table(spark, d, "labels").select(F.col("doc_id").alias("itemId"), F.lit("quality").alias("key"), F.col("quality").cast("string").alias("value"))
    stage.put("fields_kv", edges)
    fts = stage.put("fts", fulltext.index(flat, keep=KEPT))
    size = fulltext.size_of(fts)
    buckets = fulltext.buckets_for(size["fts_rows"])
    stage.put("postings", fulltext.postings(fts, buckets))
    stage.commit({"project_id": "1", "watermark": ingest.watermark(flat).first()[0], "schema_version": ingest.SCHEMA_VERSION, "engine_version": VERSION, "fts_buckets": str(buckets)} | size)
    return store.root


def _engine(spark, d):
    from ..engine import Engine

    return Engine(spark, _snapshot((_files(spark, d, "documents"), _files(spark, d, "labels")), spark, d), "")


@query(ORACLES["fts_stemmed"])
def engine_match(spark, d):
    """The stemmed search over a stored project."""
    return _engine(spark, d).match(1, "thing or things").select("id", F.round("bm25", 6).alias("bm25"))


@query(
    f"WITH {ITEMS}, m AS (SELECT id FROM items WHERE len(list_filter(regexp_extract_all(lower(name || ' ' || description), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda w: regexp_full_match(w, 'thing(e|ed|ing)?s?'))) > 0) "
    "SELECT typeKey, quality::VARCHAR AS quality, count(*) AS n FROM m JOIN items USING (id) LEFT JOIN labels ON doc_id = id GROUP BY typeKey, quality"
)
def engine_sql(spark, d):
    """SQL over a project's tables, with a full-text search in it."""
    statement = "SELECT typeKey, value AS quality, count(*) AS n FROM fts_match('things') JOIN items USING (id) LEFT JOIN fields_kv ON itemId = id AND key = 'quality' GROUP BY typeKey, value"
    return _engine(spark, d).query(1, statement, offline=True)


def _orders_as_records(spark, d) -> DataFrame:
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'")
    return table(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), date.alias("modifiedDate"))).alias("value"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000+0000') AS modifiedDate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01'")
def paged_delta(spark, d):
    """Orders through the paged source, 20,000 a page, the date filter pushed to where the pages are made."""
    at = scratch(spark, "paged")
    _orders_as_records(spark, d).write.text(f"{at}/orders.jsonl")
    delta = ingest.since(paged.scan(spark, at, "orders", page=20_000), "1996-07-01")
    return ingest.records(delta).select(ingest.scalar(F.col("r"), "id", "long").alias("id"), "modifiedDate")


# Vectors.  Chunks are the embeddings; item = vec_id % (a fifth of them), so that items have several chunks.

_FOLD = 100


def chunks(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % _FOLD).alias("item_id"), "embedding")


def query_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


_NEAR = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), c AS (SELECT vec_id AS chunk_id, vec_id % 100 AS item_id, list_cosine_distance(embedding::DOUBLE[], q) AS distance FROM embeddings, q), k AS (SELECT * FROM c ORDER BY distance, chunk_id LIMIT 4096)"


@query(f"WITH {_NEAR} SELECT chunk_id, round(distance, 3) AS distance FROM c ORDER BY c.distance, chunk_id LIMIT 20")
def knn_topk(spark, d):
    return vectors.nearest(chunks(spark, d), query_vector(spark, d), 20, None).select("chunk_id", F.round("distance", 3).alias("distance"))


@query(f"WITH {_NEAR} SELECT chunk_id, round(distance, 3) AS distance FROM k WHERE k.distance <= 0.8")
def knn_threshold(spark, d):
    return vectors.nearest(chunks(spark, d), query_vector(spark, d), max_distance=0.8).select("chunk_id", F.round("distance", 3).alias("distance"))


@functools.cache
def _vector_index(files: tuple, spark, d) -> tuple[Store, ann.Model]:
    """An index of all chunks, stored as a project's is."""
    store = Store(spark, scratch(spark, "vectors"))
    stage, own = store.stage(1), chunks(spark, d)
    model = ann.fit(own)
    stage.put("ann", ann.encode(own, model))
    stage.commit({})
    return store, model


@query(None)
def knn_index(spark, d):
    """The ten nearest chunks of every twentieth vector, by the index's lists; tests measure how many of the true ones."""
    store, model = _vector_index(_files(spark, d, "embeddings"), spark, d)
    queries = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ann.nearest_all(store.read(1, "ann"), model, queries, 10).withColumn("distance", F.round("distance", 3))


@query(f"WITH {_NEAR} SELECT item_id, round(min(distance), 3) AS distance FROM k WHERE distance <= 0.9 GROUP BY item_id")
def knn_fold_nearest(spark, d):
    return vectors.fold(vectors.nearest(chunks(spark, d), query_vector(spark, d), max_distance=0.9)).select("item_id", F.round("distance", 3).alias("distance"))


@query(f"WITH {_NEAR} SELECT chunk_id, round(1 - distance, 3) + 0.0 AS score FROM c")
def cosine_score(spark, d):
    return chunks(spark, d).select("chunk_id", (F.round(1 - vectors.cosine_distance(F.col("embedding"), query_vector(spark, d)), 3) + F.lit(0.0)).alias("score"))


@query(f"WITH {ITEMS}, {_NEAR}, f AS (SELECT item_id, min(distance) AS dist FROM k WHERE distance <= 0.9 GROUP BY item_id) SELECT id, documentKey, typeKey, sequence, round(1 - dist, 3) AS score, name FROM f JOIN items ON id = item_id WHERE typeKey = 'EN' ORDER BY dist, id LIMIT 10")
def semantic_filtered_top(spark, d):
    return search.semantic(items(spark, d), chunks(spark, d), query_vector(spark, d), types="en", top=10, max_distance=0.9)


# Fusion

_LEGS = f"""l AS (SELECT id, row_number() OVER (ORDER BY globalSortOrder NULLS LAST, id) - 1 AS rank FROM (SELECT id, globalSortOrder FROM items WHERE {_HAY} ILIKE '%thing%' OR {_HAY} ILIKE '%erble%' ORDER BY globalSortOrder NULLS LAST, id LIMIT 200)),
v AS (SELECT item_id AS id, row_number() OVER (ORDER BY dist, item_id) - 1 AS rank FROM (SELECT item_id, min(distance) AS dist FROM k WHERE distance <= 0.9 GROUP BY item_id)),
f AS (SELECT id, row_number() OVER (ORDER BY bm25, id) - 1 AS rank FROM b),
u AS (SELECT id, 'fts' AS leg, 0 AS o, rank FROM f UNION ALL SELECT id, 'like', 1, rank FROM l UNION ALL SELECT id, 'vec', 2, rank FROM v),
r AS (SELECT id, coalesce(max(1.0::DOUBLE / (61 + rank)) FILTER (WHERE leg = 'fts'), 0) + coalesce(max(1.0::DOUBLE / (61 + rank)) FILTER (WHERE leg = 'like'), 0) + coalesce(max(1.0::DOUBLE / (61 + rank)) FILTER (WHERE leg = 'vec'), 0) AS rrf,
  string_agg(DISTINCT leg, '+' ORDER BY leg) AS via, min(o * 1000000 + rank) AS first FROM u GROUP BY id)"""


def _hybrid_sql(tail: str) -> str:
    bm25 = _bm25(["thing", "erble"], "h0 > 0 OR h1 > 0", "CASE WHEN h0 > 0 THEN s0 ELSE 0 END + CASE WHEN h1 > 0 THEN s1 ELSE 0 END")
    inner = bm25.split("\nSELECT id, round(bm25, 6) AS bm25 FROM (")
    return f"{inner[0]}, b AS ({inner[1].rstrip(')')} ), {_NEAR}, {_LEGS} {tail}"


def _hybrid(spark, d, **more) -> DataFrame:
    own = items(spark, d)
    return search.hybrid(own, stored(spark, d), boolexpr.parse("thing or erble"), chunks(spark, d), query_vector(spark, d), max_distance=0.9, stemmed=False, **more)


@query(_hybrid_sql("SELECT i.id, documentKey, typeKey, sequence, round(rrf, 4) AS score, via, name FROM r JOIN items i USING (id) ORDER BY rrf DESC, first LIMIT 20"))
def hybrid_search(spark, d):
    return _hybrid(spark, d, top=20)


@query(_hybrid_sql("SELECT i.id, documentKey, typeKey, sequence, round(rrf, 4) AS score, via, name FROM r JOIN items i USING (id) WHERE typeKey = 'FR' OR itemType = 1 ORDER BY rrf DESC, first"))
def hybrid_type_postfilter(spark, d):
    return _hybrid(spark, d, types="fr,1")


@query(_hybrid_sql("SELECT via, count(*) AS n FROM r JOIN items i USING (id) GROUP BY via"))
def hybrid_via(spark, d):
    return _hybrid(spark, d).groupBy("via").agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200)),
b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM (SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 200))
SELECT id, round(coalesce(1.0 / (61 + a.rank), 0) + coalesce(1.0 / (61 + b.rank), 0), 6) AS score, CASE WHEN a.id IS NULL THEN 'like' WHEN b.id IS NULL THEN 'fts' ELSE 'fts+like' END AS via FROM a FULL JOIN b USING (id)"""
)
def rrf_fuse(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    order = (F.desc("n_chars"), "id")
    a = search.ranked(docs.orderBy(*order).limit(200), "fts", *order)
    b = search.ranked(docs.where("lang = 'en'").orderBy(*order).limit(200), "like", *order)
    return search.fuse(a.unionByName(b)).select("id", F.round("rrf", 6).alias("score"), "via")


# Joins, ingestion and upkeep


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def dim_lookup_left(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name", "n_regionkey")
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), "r_name")
    named = ingest.lookup(table(spark, d, "customer"), nation, "c_nationkey", {"n_name": "n_name", "n_regionkey": "n_regionkey"})
    return ingest.lookup(named, region, "n_regionkey", {"r_name": "r_name"}).select("c_custkey", "n_name", "r_name")


_PICKS = "(VALUES ('O', 'Open'), ('F', 'Finished')) AS p(code, label)"


@query(f"SELECT o_orderkey, o_orderstatus, label AS statusName FROM orders LEFT JOIN {_PICKS} ON code = o_orderstatus")
def picklist_lookup(spark, d):
    picks = spark.createDataFrame([(ord("O"), "Open"), (ord("F"), "Finished")], "id long, name string")
    orders = table(spark, d, "orders").withColumn("option", F.ascii("o_orderstatus").cast("long"))
    return ingest.lookup(orders, picks, "option", {"name": "statusName"}).select("o_orderkey", "o_orderstatus", "statusName")


@query("SELECT l_orderkey AS fromItem, l_partkey AS toItem, l_suppkey % 4 AS relationshipType, CASE l_suppkey % 4 WHEN 1 THEN 'verifies' WHEN 2 THEN 'derives' WHEN 3 THEN 'relates' END AS relTypeName FROM (SELECT l_orderkey, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey)")
def reltype_lookup(spark, d):
    types = spark.createDataFrame([(1, "verifies"), (2, "derives"), (3, "relates")], "id long, name string")
    edges = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    raw = edges.select(F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("fromItem"), F.col("l_partkey").alias("toItem"), (F.col("l_suppkey") % 4).alias("relationshipType"))).alias("record"))
    return ingest.relationships(raw, types).select("fromItem", "toItem", "relationshipType", "relTypeName")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def deleted_ids_anti(spark, d):
    gone = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("id")).distinct()
    return ingest.without(table(spark, d, "orders"), gone, "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def changed_ids_semi(spark, d):
    changed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return ingest.within(table(spark, d, "orders"), changed, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT fromItem, toItem FROM (SELECT DISTINCT l_orderkey AS fromItem, l_partkey AS toItem FROM lineitem) WHERE fromItem % 10 <> 0 AND toItem % 10 <> 0")
def deleted_edges_both_ends(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fromItem"), F.col("l_partkey").alias("toItem")).distinct()
    ids = edges.select(F.col("fromItem").alias("id")).unionByName(edges.select(F.col("toItem").alias("id"))).distinct()
    return ingest.without(edges, ids.where("id % 10 = 0"), "fromItem", "toItem")


@query("SELECT (SELECT count(*) FROM orders) AS local, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS server, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS deleted")
def reconcile_counts(spark, d):
    return ingest.reconciliation(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")))


_LAST = "SELECT user_id AS id, event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS modifiedDate FROM events"


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("modifiedDate"))


_CUT = "2024-01-15"


def _ql(inner: str) -> str:
    return f"(SELECT * FROM ({inner}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY modifiedDate DESC, event_id DESC) = 1)"


@query(f"SELECT * FROM {_ql(_LAST)}")
def dedup_last_seen(spark, d):
    return ingest.last_seen(_events(spark, d), "id", "modifiedDate", "event_id")


@query(f"WITH b AS (SELECT * FROM {_ql(_LAST + f' WHERE ts < TIMESTAMP {chr(39)}{_CUT}{chr(39)}')}), n AS (SELECT * FROM {_ql(_LAST + f' WHERE ts >= TIMESTAMP {chr(39)}{_CUT}{chr(39)}')}) SELECT * FROM n UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM n)")
def upsert_latest(spark, d):
    rows = _events(spark, d)
    return ingest.upsert(upsert.newest(rows.where(F.col("modifiedDate") < _CUT)), upsert.newest(rows.where(F.col("modifiedDate") >= _CUT)))


@query(ORACLES["upsert_latest"])
def snapshot_deltas(spark, d):
    """The events before a day as a stored table, those of three later spans as deltas: new rows, and keys that retire the
    rows they replace."""
    store, rows = Store(spark, scratch(spark, "deltas")), _events(spark, d)
    cuts = ["", _CUT, "2024-01-18", "2024-01-22", "9"]
    for low, high in zip(cuts, cuts[1:], strict=False):
        stage, span = store.stage(1), rows.where((F.col("modifiedDate") >= low) & (F.col("modifiedDate") < high))
        delta = stage.temp("delta", upsert.newest(span))
        if "events" in stage.tables:
            stage.retire(delta.select("id"), "events")
        stage.add("events", delta)
        stage.commit({"watermark": high})
    return store.read(1, "events")


@query(ORACLES["upsert_latest"])
def upsert_idempotent(spark, d):
    rows = _events(spark, d)
    delta = upsert.newest(rows.where(F.col("modifiedDate") >= _CUT))
    return ingest.upsert(ingest.upsert(upsert.newest(rows.where(F.col("modifiedDate") < _CUT)), delta), delta)


@query("SELECT coalesce(max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')), '') AS watermark FROM events")
def watermark_max(spark, d):
    return ingest.watermark(_events(spark, d))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def delta_inclusive(spark, d):
    rows = table(spark, d, "events").withColumn("modifiedDate", F.col("ts"))
    newest = ingest.newest(rows, "ts", None, "cut").select((F.col("cut") - F.expr("INTERVAL 1 DAY")).alias("cut"))
    return ingest.since(rows.crossJoin(F.broadcast(newest)), F.col("cut")).select("event_id")  # of one row


@query(f"SELECT count(*) AS delta, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '{_CUT}'")
def delta_count(spark, d):
    return ingest.since(_events(spark, d), _CUT).agg(F.count("*").alias("delta"), F.countDistinct("id").alias("users"))


@query("SELECT count(DISTINCT vec_id % 100) AS items, count(*) AS chunks FROM embeddings")
def count_distinct_items(spark, d):
    return vectors.coverage(chunks(spark, d))


@query("SELECT coalesce(max(doc_id) FILTER (WHERE quality > 5), 0) AS none, coalesce(max(doc_id), 0) AS most FROM labels")
def coalesce_max(spark, d):
    rows = table(spark, d, "labels")
    return ingest.newest(rows, "doc_id", 0, "none", where=F.col("quality") > 5).crossJoin(ingest.newest(rows, "doc_id", 0, "most"))  # of one row each


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR toxic = 0")
def labels_left(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return ingest.lookup(table(spark, d, "documents"), labels, "doc_id", {"quality": "quality", "toxic": "toxic"}).where("toxic IS NULL OR toxic = 0").select("doc_id", "quality")


@query("SELECT o AS option, count(*) AS n FROM (SELECT unnest([o_orderkey % 5, o_custkey % 7]) AS o FROM orders) GROUP BY o")
def picklist_options(spark, d):
    flat = table(spark, d, "orders").select((F.col("o_orderkey") % 5).cast("string").alias("status"), (F.col("o_custkey") % 7).cast("string").alias("priority"))
    ids = ingest.option_ids(flat)
    both = flat.select(F.explode(F.array("status", "priority")).alias("o")).select(F.col("o").cast("long").alias("id"))
    return both.join(ids, "id").groupBy(F.col("id").alias("option")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN delta > 200 THEN 'stop' ELSE 'serve' END AS decision, delta FROM (SELECT count(*) AS delta FROM events WHERE ts >= TIMESTAMP '{_CUT}')")
def gate_decision(spark, d):
    delta = ingest.since(_events(spark, d), _CUT).count()
    try:
        did = gate.check(gate.State("ready"), False, False, False, lambda: delta, lambda: 0, gate.LIMIT)
        decision = "serve" if did in ("sync", "serve") else did
    except gate.Stop:
        decision = "stop"
    return spark.createDataFrame([(decision, delta)], "decision string, delta long")


@query(ORACLES["dedup_last_seen"])
def incremental_stream(spark, d):
    """The same upsert as a stream of files, run to its end."""
    return upsert.replay(spark, d)


@query(ORACLES["dedup_last_seen"])
def stateful_last_seen(spark, d):
    """The same by a keyed state that lets only changes through, over files that each hold rows of all times."""
    return last_seen.replay(spark, d)


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000+0000') AS modifiedDate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01'")
def stream_delta(spark, d):
    """Orders since a day through the paged source as a stream, run until nothing is new."""
    at = scratch(spark, "stream-source")
    _orders_as_records(spark, d).write.text(f"{at}/orders.jsonl")
    rows = ingest.records(paged.stream(spark, at, "orders", page=20_000, modifiedSince="1996-07-01"))
    rows = rows.select(ingest.scalar(F.col("r"), "id", "long").alias("id"), "modifiedDate")
    run = rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


@query("SELECT n_nationkey, n_name FROM nation WHERE regexp_matches(n_name, '(?i)^u|land$') ORDER BY n_name")
def name_regex(spark, d):
    return filters.named(table(spark, d, "nation"), "^u|land$", "n_name", "n_nationkey").select("n_nationkey", "n_name")


@query(None)
def sketch_distinct(spark, d):
    """About how many different values each column of the events has, from the united sketches of two parts of them."""
    rows = table(spark, d, "events")
    parts = [sketches.of(rows.where(F.col("ts") < _CUT), "events"), sketches.of(rows.where(F.col("ts") >= _CUT), "events")]
    return sketches.distinct(parts[0].unionByName(parts[1]))


@query("SELECT DISTINCT doc_id AS id FROM labels WHERE doc_id IS NOT NULL")
def id_sweep(spark, d):
    return ingest.ids(table(spark, d, "labels").select(F.to_json(F.struct(F.col("doc_id").alias("id"))).alias("record")))


@query("SELECT 'items' AS t, count(*) AS n FROM documents UNION ALL SELECT 'links', count(*) FROM lineitem UNION ALL SELECT 'options', count(DISTINCT o_orderstatus) FROM orders")
def status_counts(spark, d):
    return ingest.counts({"items": table(spark, d, "documents"), "links": table(spark, d, "lineitem"), "options": table(spark, d, "orders").select("o_orderstatus").distinct()})


@query(f"SELECT greatest('{_CUT}', coalesce(max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')), '')) AS watermark FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def watermark_incremental(spark, d):
    return ingest.watermark(_events(spark, d).where(F.col("modifiedDate") < "2024-01-10"), F.lit(_CUT))


@query(f"WITH {ITEMS}, i AS (SELECT id, name, description, stepsText, CASE WHEN id % 3 <> 0 THEN globalSortOrder END AS globalSortOrder FROM items) SELECT id, globalSortOrder FROM i WHERE {_HAY} ILIKE '%tion%' ORDER BY globalSortOrder NULLS LAST, id LIMIT 200")
def like_order_nulls_last(spark, d):
    rows = items(spark, d).withColumn("globalSortOrder", F.when(F.col("id") % 3 != 0, F.col("globalSortOrder")))
    return search.like_leg(rows, boolexpr.parse("tion"))


@query(
    rf"""WITH {ITEMS}, t AS (SELECT id, unnest([regexp_extract_all(lower(coalesce(name, '')), '[\p{{L}}\p{{N}}\p{{Co}}]+'), regexp_extract_all(lower(coalesce(description, '')), '[\p{{L}}\p{{N}}\p{{Co}}]+')]) AS w FROM items)
SELECT id, sum(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')))::BIGINT AS hits FROM t GROUP BY id HAVING hits > 0"""
)
def postings_phrase(spark, d):
    rows = fulltext.postings(fulltext.index(items(spark, d), stemmed=False), 64)
    return fulltext.phrase_hits(rows, "of the", buckets=64, stemmed=False).select("id", "hits")


@query(f"WITH {ITEMS}, {_CHUNKS}, e AS (SELECT doc_id, t, unnest(generate_series(0, c - 1)) AS chunk_no FROM n WHERE c > 0) SELECT lang, count(*) AS chunks, round(avg(length(substr(t, 1 + chunk_no * 1300, 1500))), 6) AS mean_length FROM e JOIN documents USING (doc_id) GROUP BY lang")
def chunk_statistics(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select("lang", F.explode(text.chunks(F.coalesce("text", F.lit("")))).alias("c"))
    return rows.groupBy("lang").agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("c")), 6).alias("mean_length"))


_PREVIOUS = "lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"


@query(
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT o_orderkey AS id, {_PREVIOUS} AS up FROM orders),
t AS (SELECT id, id AS root, 0::BIGINT AS depth FROM p WHERE up IS NULL UNION ALL SELECT p.id, root, depth + 1 FROM t JOIN p ON p.up = t.id) SELECT id, root, depth FROM t"""
)
def tree_positions(spark, d):
    """Orders as a tree: each stands below its customer's order before it."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_PREVIOUS).alias("parentItem"))
    return hierarchy.positions(rows, written(spark, "tree"))


# SQL pass-through


def _sql(name: str, text_: str, oracle: str | None = None, tables: tuple[str, ...] = ("customer", "orders", "lineitem", "nation", "region", "part", "supplier")) -> None:
    def run(spark, d):
        return sql.query(spark, text_, {t: table(spark, d, t) for t in tables})

    QUERIES[name], ORACLES[name] = run, oracle or text_


_sql("sql_group_by", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment")
_sql("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
_sql("sql_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_custkey, round(s, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey WHERE s > 2000000")
_sql("sql_recursive", "WITH RECURSIVE up(k, a, steps) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT k, int_div(a, 2), steps + 1 FROM up WHERE a > 1) SELECT k, min(a) AS top, max(steps) AS depth FROM up GROUP BY k",
     "WITH RECURSIVE up(k, a, steps) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION ALL SELECT k, a // 2, steps + 1 FROM up WHERE a > 1) SELECT k, min(a) AS top, max(steps) AS depth FROM up GROUP BY k")
_sql(
    "sql_dates",
    "SELECT o_orderkey, strftime('%Y-%m', CAST(o_orderdate AS STRING), 'start of month', '-1 day') AS month_before, datetime(CAST(o_orderdate AS STRING), '+36 hours') AS later, sqlite_date(CAST(o_orderdate AS STRING), 'weekday 0') AS sunday, strftime('%j', CAST(o_orderdate AS STRING)) AS day FROM orders",
    "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m') AS month_before, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS later, strftime(o_orderdate + to_days(((7 - dayofweek(o_orderdate)) % 7)::INT), '%Y-%m-%d') AS sunday, strftime(o_orderdate, '%j') AS day FROM orders",
)
_sql("sql_window", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running FROM orders")
_sql("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("sql_union_all", "SELECT 'items' AS t, count(*) AS n FROM customer UNION ALL SELECT 'links', count(*) FROM orders")
_sql("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_sql("sql_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer")
_sql("sql_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_sql("sql_rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
_sql("sql_full_join", "SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey > 5) c FULL JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_nationkey, s_nationkey")
_sql("sql_theta_join", "SELECT s_suppkey, count(*) AS richer FROM supplier JOIN nation ON s_nationkey < n_nationkey GROUP BY s_suppkey")


@query("WITH e AS (SELECT l_orderkey AS f, l_partkey AS t FROM lineitem) SELECT a.f AS src, count(DISTINCT b.f) AS siblings FROM e a JOIN e b ON a.t = b.t AND a.f <> b.f GROUP BY a.f")
def sql_graph_hop(spark, d):
    """The SQL lists all pairs of orders that share a part; the operator counts the same without listing them."""
    return graph.siblings(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("f"), F.col("l_partkey").alias("t")))


_sql("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_sql("sql_case_strings", "SELECT p_partkey, upper(substr(p_name, 1, 4)) AS head, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind, abs(p_size - 25) AS off FROM part")
_sql("sql_like_function", "SELECT p_partkey FROM part WHERE sqlite_like(p_name, '%E_%')", "SELECT p_partkey FROM part WHERE p_name ILIKE '%e_%'")
_sql("sql_string_agg", "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
_sql("sql_revenue", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
