"""Embedding columns as blocks of numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null and without null or non-finite components."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def stack(rows: list[bytes], dtype) -> np.ndarray:
    """Rows of packed numbers as a matrix; shorter rows are filled with zeros, which add nothing to a product."""
    parts = [np.frombuffer(r, dtype) for r in rows]
    width = max((p.size for p in parts), default=0)
    out = np.zeros((len(parts), width), dtype)
    for i, p in enumerate(parts):
        out[i, : p.size] = p
    return out
