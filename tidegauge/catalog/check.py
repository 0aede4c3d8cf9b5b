"""Comparison of a Spark result with the result of its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import pandas as pd


def comparable(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        kind = out[c].dtype.kind
        if kind in "iuf":
            out[c] = out[c].astype(float)
        elif kind == "M":
            out[c] = out[c].dt.strftime("%Y-%m-%d")
        elif kind == "O":
            sample = out[c].dropna()
            if len(sample) and isinstance(sample.iloc[0], bool):
                out[c] = out[c].astype(float)
            else:
                out[c] = out[c].map(lambda v: None if v is None or v is pd.NaT else str(v))
        elif kind == "b":
            out[c] = out[c].astype(float)
    return out.sort_values(list(out.columns), ignore_index=True, na_position="first")


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs between two results regardless of row order, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = comparable(got), comparable(want)
    differing = [c for c in a.columns if not a[c].equals(b[c])]
    if not differing:
        return None
    c = differing[0]
    off = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
    both = pd.concat([a[off].head(3), b[off].head(3)], keys=["spark", "duckdb"])
    return f"values {differing} in {int(off.sum())} rows\n{both.to_string()}"


def duckdb_over(sf_dir: str):
    """In-process DuckDB with one view per Parquet table of a folder."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con
