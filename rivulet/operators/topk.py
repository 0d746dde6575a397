"""Per-group top-k by a window (Spark plans a WindowGroupLimit, so each map
task keeps only k rows per group before the shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Digits kept when ranking by a floating score: far below any real difference
# between scores, far above summation-order noise between engines.
RANK_DIGITS = 10


def rank_key(c: Column | str, digits: int = RANK_DIGITS) -> Column:
    """Integer-valued key sign(x) * floor(|x| * 10^digits + 0.5): rounding half
    away from zero in plain double arithmetic (no BigDecimal per row), which
    orders rows exactly as round(x, digits) does in SQL engines that scale,
    round and unscale a double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * F.floor(F.abs(c) * F.lit(float(10 ** digits)) + F.lit(0.5))


def top_k(df: DataFrame, group: str | list[str], order: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first k rows of each group in ``order``; ``rank_col`` is 1-based."""
    group = [group] if isinstance(group, str) else group
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
