"""What the vector operators share: valid rows, and a bounded sample of unit vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample


def finite(col: str) -> Column:
    """True for a non-null, non-empty vector of finite components."""
    good = F.forall(F.col(col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(F.col(col).isNotNull() & (F.size(col) > 0) & good, F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; largest component first, so that nothing over- or underflows."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 5e-324)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample_matrix(rows: DataFrame, vector: str, bound: int) -> np.ndarray:
    """About ``bound`` distinct vectors of the most common length, in the order of their values; (0, 0) if there are none."""
    got = [np.array(r[0], float) for r in bounded_sample(rows, [vector], bound, seed=3).select(F.col(vector).cast("array<double>")).distinct().collect()]
    if not got:
        return np.zeros((0, 0))
    sizes = [len(v) for v in got]
    size = max(sorted(set(sizes)), key=sizes.count)
    return np.array(sorted(v.tolist() for v in got if len(v) == size))
