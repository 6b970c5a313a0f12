"""Text columns of items: markup removal, composition, chunks, token arrays and SQLite's LIKE; all JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The limits of chunking, and the entities in the order in which they are replaced.
CHUNK_SIZE, CHUNK_OVERLAP, TEXT_CAP = 1500, 200, 50_000
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))

#: Python's idea of white space, which Java's \s (ASCII only) is not.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def strip_html(text: Column) -> Column:
    """Tags become spaces, five entities are decoded one after the other, white space is collapsed; null is ''."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return strip(F.regexp_replace(out, SPACE, " "))


def item_text(name: Column, description: Column, steps: Column) -> Column:
    """Name and description joined by '. ', then the steps after a space; empty parts leave no separator."""
    n, d, s = (strip(F.coalesce(c, F.lit(""))) for c in (name, description, steps))
    head = F.when((n != "") & (d != ""), F.concat(n, F.lit(". "), d)).otherwise(F.concat(n, d))
    return strip(F.when(s != "", F.concat(head, F.lit(" "), s)).otherwise(head))


def chunk_count(text: Column) -> Column:
    """0 for an empty text, else the number of windows that reach its end."""
    n = F.length(text)
    step = CHUNK_SIZE - CHUNK_OVERLAP
    return F.when(n == 0, 0).when(n <= CHUNK_SIZE, 1).otherwise(1 + F.ceil((n - CHUNK_SIZE) / step)).cast("int")


def chunks(text: Column) -> Column:
    """Windows of 1,500 characters, each beginning 1,300 after the one before; of at most 50,000 characters of text."""
    step = CHUNK_SIZE - CHUNK_OVERLAP

    def cut(t: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), chunk_count(t) - 1), lambda i: F.substr(t, 1 + i * step, F.lit(CHUNK_SIZE)))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(windows)

    # the stripped text is bound to a lambda's argument, so it is computed once and not again for every window
    return F.get(F.transform(F.array(strip(F.substring(text, 1, TEXT_CAP))), cut), F.lit(0))


def steps_text(steps: Column) -> Column:
    """Of an array of structs action, expectedResult, notes: the non-empty stripped parts in order, joined by spaces."""
    parts = F.flatten(F.transform(steps, lambda s: F.array(*(strip_html(s[k]) for k in ("action", "expectedResult", "notes")))))
    return F.coalesce(F.array_join(F.filter(parts, lambda p: p != ""), " "), F.lit(""))


def unboxed(value: Column) -> Column:
    """The first element of an array, null if it is empty."""
    return F.get(value, F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and private-use characters, neither folded nor stemmed."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def like(text: Column, pattern: str, escape: bool = False) -> Column:
    """SQLite's LIKE: % and _ are wild, there is no escape character, case matters beyond ASCII only.

    ``escape``: takes the pattern's own wildcards literally instead.
    """
    wild = {"%": ".*", "_": "."} if not escape else {}
    return text.rlike(f"(?is)^{''.join(wild.get(c) or literal(c) for c in pattern)}$")


def literal(text: str) -> str:
    """A regular expression for the text itself."""
    return "".join(re.sub(r"([^\w\s]|_)", r"\\\1", c, flags=re.ASCII) if ord(c) < 128 else c for c in text)


def contains(text: Column, term: str, escape: bool = False) -> Column:
    """LIKE '%term%', whose own wildcards stay wild unless ``escape``.

    Without wildcards this is a search for the term in any ASCII case, by an expression without a wildcard: it is three
    times as fast as looking in a text whose letters were translated.
    """
    if escape or not set(term) & {"%", "_"}:
        return text.rlike(f"(?i){literal(term)}")
    # each stretch at its first place after the one before, which is not given up again: one pass, where .* tries every place
    stretches = ["".join("." if c == "_" else literal(c) for c in s) for s in term.split("%") if s]
    return text.rlike("(?is)^" + "".join(f"(?>.*?{s})" for s in stretches))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)
