"""SQLite's date functions as SQL functions: date, time, datetime, julianday, unixepoch and strftime with up to six modifiers.

A time value is an ISO text (with a zone or without: UTC), a time of day (of 2000-01-01), a Julian day number or 'now'.  A
modifier is a signed number of seconds, minutes, hours, days, months or years, 'start of day', 'start of month', 'start of
year', 'weekday N' (0 is Sunday), 'unixepoch' right after a number, 'utc' or 'localtime' (both leave it: all is UTC).  What is
none of these makes the answer null, as there.  Months and years that end in a shorter month run over into the next.

Each function is one SQL expression, which Catalyst inlines: modifiers, which may be columns, too, are folded by aggregate().
"""

from __future__ import annotations

from pyspark.sql import SparkSession

MODIFIERS = 6
NUMBER = r"^[+-]?[0-9]+([.][0-9]+)? *"
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
EPOCH_DAY = 2440587.5


def _add_micros(t: str, micros: str) -> str:
    return f"timestamp_micros(unix_micros({t}) + CAST({micros} AS BIGINT))"


def _parsed(t: str, first: str) -> str:
    """A time value as a timestamp; ``first`` is the first modifier, which may say that a number is seconds."""
    number = f"try_cast({t} AS DOUBLE)"
    return (
        f"CASE WHEN lower({t}) = 'now' THEN current_timestamp() "
        f"WHEN {t} RLIKE '^[+-]?[0-9]+([.][0-9]*)?$' THEN IF(lower({first}) = 'unixepoch', {_add_micros('TIMESTAMP_SECONDS(0)', f'round({number} * 1000000)')}, "
        f"IF({number} BETWEEN 0 AND 5373484.5, {_add_micros('TIMESTAMP_SECONDS(0)', f'round(({number} - {EPOCH_DAY}D) * 86400000) * 1000')}, NULL)) "
        f"WHEN {t} RLIKE '^[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?$' THEN try_cast(concat('2000-01-01 ', {t}) AS TIMESTAMP) "
        f"WHEN {t} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$' THEN try_cast({t} AS TIMESTAMP) END"
    )


def _shifted(t: str, m: str) -> str:
    """A timestamp after one modifier."""
    number = f"CAST(regexp_extract({m}, '^([+-]?[0-9]+([.][0-9]+)?)', 1) AS DOUBLE)"
    months = f"CAST({number} AS INT)"
    out = "CASE "
    for unit, seconds in UNITS.items():
        out += f"WHEN lower({m}) RLIKE '{NUMBER}{unit}s?$' THEN {_add_micros(t, f'round({number} * {seconds} * 1000) * 1000')} "
    for unit, n in (("month", 1), ("year", 12)):
        # the month's first day is moved, then the days since it and the time are added again
        first = f"CAST(add_months(date_trunc('MONTH', {t}), {months} * {n}) AS TIMESTAMP)"
        rest = f"unix_micros({t}) - unix_micros(date_trunc('MONTH', {t}))"
        out += f"WHEN lower({m}) RLIKE '^[+-]?[0-9]+ *{unit}s?$' THEN {_add_micros(first, rest)} "
    for unit in ("day", "month", "year"):
        out += f"WHEN lower({m}) = 'start of {unit}' THEN date_trunc('{unit}', {t}) "
    ahead = f"pmod(CAST(substr({m}, 9) AS INT) - (dayofweek({t}) - 1), 7)"
    out += f"WHEN lower({m}) RLIKE '^weekday [0-6]$' THEN {_add_micros(t, f'{ahead} * 86400000000')} "
    return out + f"WHEN lower({m}) IN ('unixepoch', 'utc', 'localtime') THEN {t} END"


def _formatted(t: str, fmt: str) -> str:
    """strftime's codes, each replaced by what it stands for."""
    monday = f"(weekday({t}))"
    codes = {
        "%Y": f"date_format({t}, 'yyyy')", "%m": f"date_format({t}, 'MM')", "%d": f"date_format({t}, 'dd')", "%H": f"date_format({t}, 'HH')", "%M": f"date_format({t}, 'mm')", "%S": f"date_format({t}, 'ss')",
        "%f": f"date_format({t}, 'ss.SSS')", "%j": f"lpad(CAST(dayofyear({t}) AS STRING), 3, '0')", "%s": f"CAST(unix_seconds({t}) AS STRING)", "%w": f"CAST(dayofweek({t}) - 1 AS STRING)",
        "%W": f"lpad(CAST((dayofyear({t}) - 1 + 7 - {monday}) DIV 7 AS STRING), 2, '0')", "%J": f"CAST(unix_micros({t}) / 86400000000.0D + {EPOCH_DAY}D AS STRING)",
    }
    out = f"replace({fmt}, '%%', '\\u0001')"
    for code, value in codes.items():
        out = f"replace({out}, '{code}', {value})"
    return f"replace({out}, '\\u0001', '%')"


def statements() -> list[str]:
    """What makes the functions in a session."""
    params = ", ".join(f"m{i} STRING DEFAULT NULL" for i in range(1, MODIFIERS + 1))
    given = f"filter(array({', '.join(f'm{i}' for i in range(1, MODIFIERS + 1))}), m -> m IS NOT NULL)"
    moment = f"aggregate({given}, {_parsed('t', 'm1')}, (at, m) -> {_shifted('at', 'm')})"
    # the moment is computed once, as a lambda's argument
    answer = lambda body: f"transform(array({moment}), x -> {body})[0]"
    head = "CREATE OR REPLACE TEMPORARY FUNCTION"
    return [
        f"{head} strftime(f STRING, t STRING DEFAULT 'now', {params}) RETURNS STRING RETURN {answer(_formatted('x', 'f'))}",
        *(f"{head} {name}(t STRING DEFAULT 'now', {params}) RETURNS STRING RETURN {answer(f'''date_format(x, '{fmt}')''')}" for name, fmt in (("sqlite_date", "yyyy-MM-dd"), ("sqlite_time", "HH:mm:ss"), ("datetime", "yyyy-MM-dd HH:mm:ss"))),
        f"{head} julianday(t STRING DEFAULT 'now', {params}) RETURNS DOUBLE RETURN {answer(f'unix_micros(x) / 86400000000.0D + {EPOCH_DAY}D')}",
        f"{head} unixepoch(t STRING DEFAULT 'now', {params}) RETURNS BIGINT RETURN {answer('unix_seconds(x)')}",
    ]


def register(spark: SparkSession) -> None:
    for statement in statements():
        spark.sql(statement)
