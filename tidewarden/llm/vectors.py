"""What the vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewarden.llm.common import ship

ship(__name__)


def usable(column: str) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def dots(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products whose rounding does not depend on the place of a row."""
    return (rows * query).sum(1)
