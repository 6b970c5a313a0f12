"""Read-only SQL over the tables of a snapshot."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dates

_READS = re.compile(r"\s*(?:SELECT|WITH)\b", re.I)
#: Logical nodes that change something, run a command or start a program.
_WRITES = re.compile(r"Insert|Command|Create|Drop|Delete|Update|Merge|Replace|Alter|Truncate|Write|Append|Overwrite|Script|Execute|Call|SetVariable|Cache")
#: Functions that call into the Java virtual machine.
CALLS = frozenset({"reflect", "java_method", "try_reflect"})
VIEWS = ("items", "fields_kv", "picklist", "relationships", "meta", "fts", "chunks")
#: A search, or what it can't stand in: a literal, a quoted name or a comment, which are passed over whole.
_MATCH = re.compile(r"\bfts_match\s*\(\s*'((?:[^']|'')*)'\s*(?:,\s*'(all|name)'\s*)?\)|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.I | re.S)


class ReadOnly(ValueError):
    """The statement isn't a query."""


def check(spark: SparkSession, sql: str, known: set[str] | None = None) -> None:
    """One SELECT or WITH that parses to a query; a WITH that ends in an INSERT isn't one.

    The whole statement is looked at, with subqueries, common table expressions and the arguments of functions.  Refused
    are nodes that write, run commands or start programs (TRANSFORM ... USING), functions that call Java, tables by a path
    or of another catalogue (names of several parts, or made by IDENTIFIER), and if ``known`` names the tables, all others.
    """
    if not _READS.match(sql):
        raise ReadOnly("only SELECT and WITH are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    own, used = set(), set()
    for kind, node in _nodes(spark, plan):
        name = kind.rsplit(".", 1)[-1].rsplit("$", 1)[-1]
        if ".plans.logical." in kind and _WRITES.search(name):
            raise ReadOnly("the statement changes something or runs a program")
        if "UnresolvedIdentifier" in name:
            raise ReadOnly("tables and functions must be named plainly")
        if name == "UnresolvedFunction" and node.nameParts().last().lower() in CALLS:
            raise ReadOnly(f"{node.nameParts().last()} may not be called")
        if name == "UnresolvedTableValuedFunction" and node.name().size() > 1:
            raise ReadOnly("functions must be named plainly")
        if name == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            if parts.size() > 1:
                raise ReadOnly(f"{parts.mkString('.')} is none of the tables")
            used.add(parts.head().lower())
        if name == "UnresolvedWith":
            relations = node.cteRelations()
            own |= {relations.apply(i).productElement(0).lower() for i in range(relations.size())}
    if known is not None and (strange := used - own - {k.lower() for k in known}):
        raise ReadOnly(f"{sorted(strange)[0]} is none of the tables")


def _nodes(spark: SparkSession, plan):
    """(class name, node) of every plan and expression of a parsed statement, wherever it is held."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    is_a = lambda x, name: gateway.jvm.py4j.reflection.TypeUtil.isInstanceOf(gateway.jvm.java.lang.Class.forName(name, True, loader), x)
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    todo = [plan]
    while todo:
        x = todo.pop()
        if not hasattr(x, "getClass"):
            continue  # a number, a text or nothing
        if is_a(x, "scala.collection.Iterable"):
            held = x.iterator()
        elif is_a(x, "scala.Product"):
            held = x.productIterator()
            if is_a(x, "org.apache.spark.sql.catalyst.trees.TreeNode"):
                yield x.getClass().getName(), x
        else:
            continue
        while held.hasNext():
            todo.append(held.next())


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temporary views, and functions that bring SQLite's LIKE and text helpers to SQL; they are inlined, not called."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    spark.sql(
        r"CREATE OR REPLACE TEMPORARY FUNCTION sqlite_like(c STRING, p STRING) RETURNS BOOLEAN "
        r"RETURN c RLIKE concat('(?is)^', replace(replace(regexp_replace(p, '([\\\\^$.|?*+()\\[\\]{}])', '\\\\$1'), '%', '.*'), '_', '.'), '$')"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION int_div(a BIGINT, b BIGINT) RETURNS BIGINT RETURN a DIV b")
    dates.register(spark)


def without_match(sql: str) -> str:
    """The statement with a plain table name for each full-text search, to be looked at before there is an index."""
    return _MATCH.sub(lambda m: m[0] if m[1] is None else "fts", sql)


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], match: Callable[[str, str], DataFrame] | None = None) -> DataFrame:
    """The answer to a query.  ``match`` gives a full-text search's id and bm25; with it the statement may read from
    fts_match('expression') or fts_match('expression', 'name')."""
    tables = dict(tables)
    if match is not None:

        def view(m: re.Match) -> str:
            if m[1] is None:
                return m[0]
            name = f"fts_match_{len(tables)}"
            tables[name] = match(m[1].replace("''", "'"), (m[2] or "all").lower())
            return name

        sql = _MATCH.sub(view, sql)
    check(spark, sql, set(tables))
    register(spark, tables)
    return spark.sql(sql)
