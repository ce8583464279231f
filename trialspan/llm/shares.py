"""Bounds of shares that turn with the evidence, not with the size of a table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: standard deviations of a bound
DEVIATIONS = 2.6


def share_bound(hits: Column, n: Column, side: int) -> Column:
    """Lower (-1) or upper (1) Wilson bound of the share ``hits`` / ``n``; null where ``n`` is zero."""
    z, n = DEVIATIONS**2, F.nullif(n.cast("double"), F.lit(0.0))
    share = hits / n
    return (share + z / (2 * n) + side * DEVIATIONS * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)
