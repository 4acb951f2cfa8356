"""Equal-width bin index with numpy's edge rules.

For ``n`` bins over ``[lo, hi]``: bins are half open except the last, which
also holds ``hi``. When ``lo == hi`` the range is widened to
``[lo - 0.5, hi + 0.5]``, so every value falls in the middle bin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_edges(lo: Column, hi: Column) -> tuple[Column, Column]:
    same = lo == hi
    return (
        F.when(same, lo - F.lit(0.5)).otherwise(lo),
        F.when(same, hi + F.lit(0.5)).otherwise(hi),
    )


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of ``x``; NULL stays NULL."""
    elo, ehi = bin_edges(lo, hi)
    raw = F.floor((x - elo) / (ehi - elo) * F.lit(bins))
    return F.least(raw, F.lit(bins - 1)).cast("int")
