"""Small helpers for pandas frames inside tasks."""

from __future__ import annotations

import pandas as pd


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """``df`` with string columns as Python objects: a group that came in several Arrow batches
    holds chunked strings, which cannot be handed back as one column."""
    names = [c for c in df.columns if isinstance(df[c].dtype, pd.StringDtype)]
    return df.assign(**{c: df[c].astype(object) for c in names}) if names else df
