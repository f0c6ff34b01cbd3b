"""Fuzzy text ratios as Arrow-batched column functions (UDF-1).

Spark has no longest-common-subsequence expression, so these ratios are a place where Python must run.
Each distinct pair of a batch is scored once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from ledgerlink.functions.textratio import indel_ratios, partial_ratios, token_set_ratios, token_sort_ratios

_RATIO_POINTS = T.StructType().add("ratio", "double").add("points", "double")


def _distinct_pairs(a: pd.Series, b: pd.Series):
    """Positions of each row among the batch's distinct pairs, and those pairs."""
    frame = pd.DataFrame({"a": a.fillna("").to_numpy(), "b": b.fillna("").to_numpy()})
    group = frame.groupby(["a", "b"], sort=False)
    code = group.ngroup().to_numpy()
    firsts = frame.drop_duplicates()
    return code, firsts["a"].tolist(), firsts["b"].tolist()


def _column(score):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        code, x, y = _distinct_pairs(a, b)
        return pd.Series(score(x, y)[code] if len(code) else np.zeros(0))

    return run


ratio = _column(indel_ratios)
partial_ratio = _column(partial_ratios)
token_sort_ratio = _column(token_sort_ratios)
token_set_ratio = _column(token_set_ratios)


def name_points(r: float, floor_low: float = 40.0, points: float = 18.0) -> float:
    return round(points * (r - floor_low) / (100 - floor_low), 2) if r >= floor_low else 0.0


def name_ratio_scores(floor_low: float = 40.0, points: float = 18.0):
    """SCO-7 on (name, prefix-free narration): best of sort and partial ratio and its points, 2 decimals."""

    @F.pandas_udf(_RATIO_POINTS)
    def run(name: pd.Series, narration: pd.Series) -> pd.DataFrame:
        code, x, y = _distinct_pairs(name, narration)
        if not len(code):
            return pd.DataFrame({"ratio": np.zeros(0), "points": np.zeros(0)})
        best = partial_ratios(x, y)
        rest = np.flatnonzero(best < 100.0)
        if len(rest):
            best[rest] = np.maximum(best[rest], token_sort_ratios([x[i] for i in rest], [y[i] for i in rest]))
        pts = [name_points(r, floor_low, points) for r in best.tolist()]
        return pd.DataFrame({"ratio": best[code], "points": np.array(pts)[code]})

    return run


@F.pandas_udf(T.DoubleType())
def evidence_ratio(name: pd.Series, narration: pd.Series) -> pd.Series:
    """Best of partial and token-set ratio (linkage name signals)."""
    code, x, y = _distinct_pairs(name, narration)
    if not len(code):
        return pd.Series(np.zeros(0))
    return pd.Series(np.maximum(partial_ratios(x, y), token_set_ratios(x, y))[code])


@F.pandas_udf(T.DoubleType())
def duplicate_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best of plain and token-set ratio (duplicate detection)."""
    code, x, y = _distinct_pairs(a, b)
    if not len(code):
        return pd.Series(np.zeros(0))
    return pd.Series(np.maximum(indel_ratios(x, y), token_set_ratios(x, y))[code])
