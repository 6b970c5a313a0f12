import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import stem, text
from quillstone.operators import filters, ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "given_, want",
    [("<p>a&nbsp;b</p><br>c", "a b c"), ("&amp;lt;x&amp;gt;", "<x>"), (None, ""), ("", ""), ("a < b > c", "a c"), ("<script>x</script>&#65;&apos;", "x &#65;&apos;")],
)
def test_strip_html(spark, given_, want):
    assert one(spark, given_, text.strip_html) == want


@pytest.mark.parametrize("n, want", [(0, 0), (1, 1), (1500, 1), (1501, 2), (2800, 2), (2801, 3)])
def test_chunk_count_and_cover(spark, n, want):
    t = "".join(chr(97 + i % 26) for i in range(n))
    got = one(spark, t, text.chunks)
    assert len(got) == want == one(spark, t, text.chunk_count)
    assert "".join([*got[:1], *(c[200:] for c in got[1:])]) == t


def test_item_text(spark):
    rows = spark.createDataFrame([("n", "d", "s"), ("", "d", ""), ("n", "", "s"), (None, None, None)], "n string, d string, s string")
    assert [r[0] for r in rows.select(text.item_text(F.col("n"), F.col("d"), F.col("s"))).collect()] == ["n. d s", "d", "n s", ""]


def test_field_text_and_scalar(spark):
    v = lambda s: spark.sql("SELECT parse_json(:s) AS v", args={"s": s}).select(ingest.field_text(F.col("v"))).first()[0]
    assert v('[1,null,"a",true]') == "1;a;True"
    assert v("null") is None and v('"x"') == "x" and v("false") == "False" and v("[[1,2],[3]]") == "1;2;3"
    s = lambda x: spark.sql("SELECT parse_json(:x) AS r", args={"x": x}).select(ingest.scalar(F.col("r"), "id", "long")).first()[0]
    assert [s('{"id":[7]}'), s('{"id":[]}'), s('{"id":7}'), s("{}")] == [7, None, 7, None]


@pytest.mark.parametrize("hay, needle, want", [("ABC", "b", True), ("É", "é", False), ("a%b", r"a\%b", False), ("a\\xb", r"\%b", True), ("line\nbreak", "e%b", True), ("axb", "a_b", True), ("a.b", "a.b", True), ("axb", "a.b", False)])
def test_contains(spark, hay, needle, want):
    assert one(spark, hay, lambda c: text.contains(c, needle)) is want


@settings(max_examples=25, deadline=None)
@given(hay=st.text(alphabet="aAbBéÉ%_.\\$ \n", max_size=8), needle=st.text(alphabet="aAbé%_.\\$", min_size=1, max_size=4))
def test_contains_equals_sqlite(spark, hay, needle):
    want = bool(sqlite3.connect(":memory:").execute("SELECT ? LIKE '%' || ? || '%'", (hay, needle)).fetchone()[0])
    assert one(spark, hay, lambda c: text.contains(c, needle)) is want


def test_dates():
    assert filters.normalized("2026-06-30", True) == "2026-06-30T99" and filters.normalized("2026-06-30", False) == "2026-06-30"
    assert filters.normalized("2026-06-30 12:00", True) == "2026-06-30 12:00" and filters.normalized("2026-99-99", False) == "2026-99-99"
    with pytest.raises(ValueError):
        filters.normalized("June", True)


def test_stems_equal_sqlites():
    words = "answering calls relational conditional uploads uploading happily ponies caresses agreed plastered motoring conflated troubled sized hopping falling hissing failing filing sky happy probate rate controlling roll generalizations oscillators effective bowdlerize vietnamization feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angularity homologous effective cease café naïve s is as thing things analogies apology".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    for w in words:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        assert [stem.analyzed(w)] == [r[0] for r in con.execute("SELECT term FROM v")], w


def test_wildcards_take_one_pass(spark):
    import itertools
    import re
    import time

    from quillstone.functions import text

    rows = ["".join(x) for n in range(6) for x in itertools.product("aB\n", repeat=n)] + ["a\U0001f600b", ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for term in ("a%b", "a_b", "%a", "b%", "%", "_", "%%", "a%b%a", "a_%_b", "ab%ba", "_%_%_"):
        wild = re.compile("(?is)" + "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in term), re.ASCII)
        got = {r.t for r in df.where(text.contains(F.col("t"), term)).collect()}
        assert got == {r for r in rows if wild.search(r)}
    long = spark.createDataFrame([("th" * 200_000,)], "t string")
    began = time.perf_counter()
    assert long.where(text.contains(F.col("t"), "th%th%ble the_")).count() == 0
    assert time.perf_counter() - began < 30
