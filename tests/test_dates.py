"""Date functions against SQLite's own."""

import random
import sqlite3

import pytest

from quillstone.plans import sql

TIMES = ["2024-01-31", "2024-02-29 23:59:59", "2023-12-31T12:30:45.678", "1999-07-04 00:00", "12:34:56", "05:06", "2460000.5", "2460310.25", "not a date", "2024-13-01", "", None, "2000-01-01 00:00:00Z"]
MODIFIERS = ["+1 day", "-3 days", "+1 month", "-13 months", "+2 years", "-1 year", "+90 minutes", "-3600 seconds", "+1.5 days", "12 hours", "start of month", "start of year", "start of day", "weekday 0", "weekday 5", "weekday 1", "utc", "nonsense", "+1 week"]
FORMATS = ["%Y-%m-%d", "%H:%M:%S", "%d.%m.%Y %f", "%j %w %W", "%s", "100%% %Y%m", "plain"]


@pytest.fixture(scope="module")
def cases():
    dice = random.Random(1)
    out = [(t, [m], f) for t in TIMES for m, f in zip(MODIFIERS, FORMATS * 3, strict=False)]
    out += [(dice.choice(TIMES), dice.sample(MODIFIERS[:-2], dice.choice([0, 2, 3, 6])), dice.choice(FORMATS)) for _ in range(300)]
    return [(i, t, *(m + [None] * 6)[:6], f) for i, (t, m, f) in enumerate(out)]


def test_dates_equal_sqlite(spark, cases):
    con = sqlite3.connect(":memory:")
    df = spark.createDataFrame(cases, "i long, t string, m1 string, m2 string, m3 string, m4 string, m5 string, m6 string, f string")
    names = "m1, m2, m3, m4, m5, m6"
    got = sql.query(spark, f"SELECT i, strftime(f, t, {names}) AS a, sqlite_date(t, {names}) AS b, sqlite_time(t, {names}) AS c, datetime(t, {names}) AS d, julianday(t, {names}) AS e, unixepoch(t, {names}) AS g FROM cases", {"cases": df}).collect()
    assert len(got) == len(cases)
    for r in got:
        _, t, *ms, f = cases[r.i]
        ms = [m for m in ms if m is not None]
        marks = "".join(", ?" for _ in ms)
        want = con.execute(f"SELECT strftime(?, ?{marks}), date(?{marks}), time(?{marks}), datetime(?{marks}), julianday(?{marks}), strftime('%s', ?{marks})", (f, t, *ms, *(t, *ms) * 5)).fetchone()
        assert (r.a, r.b, r.c, r.d, None if r.g is None else str(r.g)) == (*want[:4], want[5]), (t, ms, f)
        assert (r.e is None) == (want[4] is None) and (r.e is None or abs(r.e - want[4]) < 1e-6)


def test_defaults_and_constants(spark):
    row = sql.query(spark, "SELECT datetime('2024-03-31', '-1 month') AS a, strftime('%Y', '2024-05-05') AS b, datetime(1700000000, 'unixepoch') AS c, length(sqlite_date()) AS d, datetime('2024-01-01T00:00:00.000+0000') AS e", {}).first()
    assert tuple(row) == ("2024-03-02 00:00:00", "2024", "2023-11-14 22:13:20", 10, "2024-01-01 00:00:00")
