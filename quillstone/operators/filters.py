"""Predicates of item searches: types, date ranges and substrings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, contains
from ..plans import boolexpr

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}([T ].*)?", re.S | re.A)
#: Stands after every time of its day.
DAY_END = "T99"


@dataclass(frozen=True)
class Dates:
    """Inclusive bounds of the creation and modification dates, compared as text; None leaves a side open."""

    created_after: str | None = None
    created_before: str | None = None
    modified_after: str | None = None
    modified_before: str | None = None

    def __post_init__(self):
        for name in ("created_after", "created_before", "modified_after", "modified_before"):
            value = getattr(self, name)
            if value is not None:
                object.__setattr__(self, name, normalized(value, upper=name.endswith("before")))

    def condition(self) -> Column:
        out = F.lit(True)
        for column, low, high in (("createdDate", self.created_after, self.created_before), ("modifiedDate", self.modified_after, self.modified_before)):
            if low is not None:
                out = out & (F.col(column) >= low)
            if high is not None:
                out = out & (F.col(column) <= high)
        return out


def normalized(date: str, upper: bool) -> str:
    """A bare day as an upper bound includes all of the day; anything that isn't a date raises ValueError."""
    m = _DATE.fullmatch(date)
    if not m:
        raise ValueError(f"{date!r} isn't a date of the form YYYY-MM-DD")
    return date + DAY_END if upper and not m[1] else date


def types(given: str | None) -> Column:
    """A comma list: numbers are item types, other words type keys in any ASCII case; none of them is no filter."""
    parts = [p.strip() for p in (given or "").split(",") if p.strip()]
    numbers = [int(p) for p in parts if p.isdigit()]
    keys = [p.lower() for p in parts if not p.isdigit()]
    out = None
    if numbers:
        out = F.col("itemType").isin(*numbers)
    if keys:
        by_key = ascii_lower(F.col("typeKey")).isin(*keys)
        out = by_key if out is None else out | by_key
    return F.lit(True) if out is None else out


def searched_text(field: str = "all") -> Column:
    """What substrings are looked for in; a null name hides an item, also from NOT."""
    if field == "name":
        return F.col("name")
    return F.concat(F.col("name"), F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("stepsText", F.lit("")))


def substring(tree: boolexpr.Node, field: str = "all", escape: bool = False) -> Column:
    text = searched_text(field)
    return boolexpr.condition(tree, lambda term: contains(text, term, escape))


def named(rows: DataFrame, pattern: str | None, name: str = "name", then: str = "id") -> DataFrame:
    """rows whose name fits a regular expression in any case (all without one), by name."""
    return (rows.where(F.col(name).rlike(f"(?i){pattern}")) if pattern else rows).orderBy(name, then)
