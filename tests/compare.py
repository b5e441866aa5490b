"""Values of two results as sorted rows of strings."""

from __future__ import annotations

import math

import pandas as pd


def value(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([value(x) for x in v])
    return str(v)


def rows(df) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(value, r)) for r in df.itertuples(index=False))
