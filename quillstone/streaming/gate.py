"""The freshness gate before a query: six checks in a fixed order."""

from __future__ import annotations

import os
from dataclasses import dataclass

#: Changes on the server, or items without fresh vectors, above which a query stops.
LIMIT = 200


class Stop(RuntimeError):
    """A query can't be answered; ``action`` is the command that helps."""

    def __init__(self, action: str, reason: str):
        super().__init__(f"{reason}; run {action}")
        self.action = action


def limit() -> int:
    """QUILLSTONE_DELTA_LIMIT, at least 0; something else than a number counts as absent."""
    try:
        return max(0, int(os.environ["QUILLSTONE_DELTA_LIMIT"]))
    except (KeyError, ValueError):
        return LIMIT


@dataclass(frozen=True)
class State:
    """What is known before a query; counts are functions, so that a check asks only if it is reached."""

    cache: str  # missing, corrupt or ready
    vectors: str = "ready"  # absent, stale or ready


def check(state: State, need_vectors: bool, offline: bool, force: bool, delta, lag, most: int | None = None) -> str:
    """'serve', 'rebuild' or 'sync' (then serve), or raises Stop.  delta() is None if the server can't say; a watermark
    that is empty because the project is counts as no delta."""
    most = limit() if most is None else most
    if state.cache == "missing":
        raise Stop("init", "the project isn't cached")
    if state.cache == "corrupt":
        raise Stop("rebuild", "the cache is broken or of another version")
    if need_vectors and state.vectors != "ready":
        raise Stop("update", f"the vectors are {state.vectors}")
    if offline:
        return "serve"
    if force:
        return "rebuild"
    changes = delta()
    if changes is None or changes > most:
        raise Stop("update", "the number of changes is unknown" if changes is None else f"{changes} items have changed")
    if need_vectors and (behind := lag()) > most:
        raise Stop("update", f"{behind} items have no fresh vectors")
    return "sync"
