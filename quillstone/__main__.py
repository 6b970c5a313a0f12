"""Commands: python -m quillstone --root DIR --base URL COMMAND ...

Results go to the standard output as columns, or with --json as a JSON array; a query that can't be served says which
command helps.
"""

from __future__ import annotations

import argparse
import os
import sys

from .engine import Engine, as_json, as_text
from .operators.filters import Dates
from .sources.sink import save
from .streaming.gate import Stop


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstone", description="Search and query cached projects.")
    p.add_argument("--root", required=True, help="where snapshots lie")
    p.add_argument("--base", required=True, help="the server, or a folder of <endpoint>.jsonl files")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        """A command with its projects, as an argument or as options."""
        c = sub.add_parser(name)
        c.add_argument("project", nargs="?", help="numbers or names, separated by commas")
        c.add_argument("--project", action="append", dest="projects", help="the same; may be repeated")
        c.add_argument("--concurrency", type=int, help="tasks that ask the server for single records")
        return c

    c = sub.add_parser("projects")
    c.add_argument("pattern", nargs="?")
    c.add_argument("--project", action="append", dest="projects", help="expressions for names, of which one must fit")
    c.add_argument("--all", action="store_true", help="every project, as without an expression")
    for name in ("init", "update", "sync", "rebuild", "refresh"):
        c = command(name)
        c.add_argument("--no-vectors", action="store_true")
        c.add_argument("--with-links", action="store_true")
        c.add_argument("--link-cap", type=int, default=0)
        c.add_argument("--prune-deleted", action="store_true")
    command("status")
    command("index")
    for name in ("search", "semantic", "query"):
        c = command(name)
        c.add_argument("text", nargs="?", help="the question, or the SQL of query")
        c.add_argument(*(["--sql"] if name == "query" else ["--query"]), action="append", dest="texts", help="the same; parts are joined by spaces")
        c.add_argument("--offline", action="store_true")
        c.add_argument("--output", help="a file that gets the result instead of the screen")
        c.add_argument("--force", action="store_true")
        if name != "query":
            c.add_argument("--type", dest="types")
            c.add_argument("--top", type=int, default=0)
            c.add_argument("--max-distance", type=float, default=0.30)
            for bound in ("created-after", "created-before", "modified-after", "modified-before"):
                c.add_argument(f"--{bound}")
        if name == "semantic":
            c.add_argument("--approximate", action="store_true", help="look only into the near lists of the vector index")
        if name == "search":
            c.add_argument("--keyword", action="append", default=[])
            c.add_argument("--expr", action="append", help="parts are joined by spaces")
            c.add_argument("--match", choices=("any", "all"), default="any")
            c.add_argument("--field", choices=("all", "name"), default="all")
    command("purge").add_argument("--all", action="store_true")
    return p


def understood(a: argparse.Namespace) -> argparse.Namespace:
    """Options and arguments that mean the same brought together; with --project the arguments begin with the text."""
    if a.command == "projects":
        a.pattern = "|".join(a.projects) if a.projects else a.pattern
        return a
    if a.projects:
        if getattr(a, "text", None) is None and hasattr(a, "text"):
            a.text = a.project
        elif a.project:
            a.projects.append(a.project)
        a.project = ",".join(a.projects)
    if getattr(a, "texts", None):
        a.text = " ".join(a.texts)
    if getattr(a, "expr", None):
        a.expr = " ".join(a.expr)
    if a.project is None and a.command not in ("status", "purge"):
        raise ValueError("name a project")
    return a


def run(engine: Engine, a: argparse.Namespace):
    """A DataFrame, or what else the command gives."""
    if a.command == "projects":
        return engine.projects(a.pattern)
    if a.command == "status":
        return engine.status(a.project)
    if a.command == "index":
        made = {}
        for p in engine.resolve(a.project):
            engine.index_substrings(p)
            made[p] = engine.index_vectors(p) if engine.vector_state(p) == "ready" else {}
        return made
    if a.command == "purge":
        return engine.purge(a.project, a.all)
    if a.command == "query":
        return engine.query(a.project, a.text or "", a.offline, a.force)
    if a.command in ("search", "semantic"):
        dates = Dates(a.created_after, a.created_before, a.modified_after, a.modified_before)
        common = {"types": a.types, "dates": dates, "top": a.top, "max_distance": a.max_distance, "offline": a.offline, "force": a.force}
        if a.command == "semantic":
            return engine.semantic(a.project, a.text or "", **common, approximate=a.approximate)
        return engine.search(a.project, a.text, a.keyword, a.expr, a.match, a.field, **common)
    options = {"with_vectors": not a.no_vectors, "with_links": a.with_links, "link_cap": a.link_cap, "prune_deleted": a.prune_deleted}
    if a.command == "sync":
        return {p: engine.sync(p, **options) for p in engine.resolve(a.project)}
    if a.command in ("rebuild", "refresh"):
        options.pop("prune_deleted")
    return getattr(engine, a.command)(a.project, **options)


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import DataFrame, SparkSession

    try:
        a = understood(parser().parse_args(args))
        spark = SparkSession.builder.appName("quillstone").getOrCreate()
        engine = Engine(spark, a.root, a.base, os.environ.get("QUILLSTONE_TOKEN", ""))
        engine.concurrency = getattr(a, "concurrency", None) or engine.concurrency
        got = run(engine, a)
    except (Stop, ValueError, LookupError) as e:
        print(e, file=sys.stderr)
        return 2
    if isinstance(got, DataFrame) and getattr(a, "output", None):
        save(got, a.output, "json" if a.json else "text")
    else:
        print((as_json if a.json else as_text)(got) if isinstance(got, DataFrame) else got)
    return 0


if __name__ == "__main__":
    sys.exit(main())
