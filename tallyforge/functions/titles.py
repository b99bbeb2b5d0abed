"""Likeness of titles, for pairs that a join has found: an Arrow UDF, as no built-in function has it."""

import difflib

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Gestalt ratio of a and b; 0 where its upper bounds are under one half."""
    out, m = [], difflib.SequenceMatcher(None)
    for x, y in zip(a, b, strict=True):
        m.set_seqs(x, y)
        out.append(m.ratio() if m.real_quick_ratio() >= 0.5 and m.quick_ratio() >= 0.5 else 0.0)
    return pd.Series(out, dtype="float64")
