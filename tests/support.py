"""What tests share."""

from pathlib import Path

import pandas as pd

ROOT = str(Path(__file__).resolve().parents[1])
SF = "/root/testdata/sf0.001"


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of texts; numbers to nine digits, so that whole floats equal integers."""
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if":
            return f"{float(v):.9g}"
        return str(list(v)) if hasattr(v, "tolist") else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))
