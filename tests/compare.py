"""Order-insensitive comparison of a Spark result with DuckDB's."""

import pandas as pd


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(plain, r)) for r in frame.astype(object).values.tolist())
