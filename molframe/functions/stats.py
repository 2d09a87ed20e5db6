"""Score intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % score interval of k of n: exact 0 and 1 at the ends, null when n is 0."""
    kd, nd = k.cast("double"), F.nullif(n, F.lit(0)).cast("double")
    z2 = Z95 * Z95
    p = kd / nd
    denom = F.lit(1.0) + F.lit(z2) / nd
    mid = (p + F.lit(z2) / (F.lit(2.0) * nd)) / denom
    half = F.lit(Z95) * F.sqrt(p * (F.lit(1.0) - p) / nd + F.lit(z2) / (F.lit(4.0) * nd * nd)) / denom
    low = F.when(k == 0, F.lit(0.0) * nd).otherwise(F.greatest(F.lit(0.0), mid - half))
    high = F.when(k == n, p).otherwise(F.least(F.lit(1.0), mid + half))
    return low, high
