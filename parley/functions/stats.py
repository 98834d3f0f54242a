"""Statistical column expressions usable both in Spark and (as SQL text) in the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided 95 % Student t quantiles t(0.975, df) for df = 1..30
T975 = [
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836,
    2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852,
    2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546,
    2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447,
    2.079613845, 2.073873068, 2.068657610, 2.063898562, 2.059538553,
    2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
]
Z975 = 1.959963984540054


def _expansion_sql(n: str) -> str:
    """Cornish-Fisher expansion of t(0.975, n) for n > 30 (error < 3e-6)."""
    z = repr(Z975)
    return (f"({z} + (power({z},3) + {z}) / (4.0 * {n})"
            f" + (5 * power({z},5) + 16 * power({z},3) + 3 * {z}) / (96.0 * power({n},2))"
            f" + (3 * power({z},7) + 19 * power({z},5) + 17 * power({z},3) - 15 * {z}) / (384.0 * power({n},3)))")


def t975_sql(df: str) -> str:
    """SQL text for t(0.975, df); NULL for df < 1. Same text runs on Spark SQL and DuckDB."""
    whens = " ".join(f"WHEN {df} = {i + 1} THEN {v!r}" for i, v in enumerate(T975))
    return f"(CASE WHEN {df} IS NULL OR {df} < 1 THEN NULL {whens} ELSE {_expansion_sql(df)} END)"


def t975(df_col) -> Column:
    """t(0.975, df) as a column expression (same numbers as :func:`t975_sql`)."""
    c = F.col(df_col) if isinstance(df_col, str) else df_col
    z = F.lit(Z975)
    n = c.cast("double")
    expansion = (z + (z ** 3 + z) / (4.0 * n)
                 + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96.0 * n ** 2)
                 + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384.0 * n ** 3))
    out = F.when(c.isNull() | (c < 1), F.lit(None).cast("double"))
    for i, v in enumerate(T975):
        out = out.when(c == i + 1, F.lit(v))
    return out.otherwise(expansion)


def mean_ci(values: Column, confidence_t=t975):
    """(n, mean, lower, upper) aggregate columns; n < 2 -> bounds = mean; empty -> NULLs."""
    n = F.count(values)
    mean = F.avg(values)
    sem = F.stddev_samp(values) / F.sqrt(n.cast("double"))
    half = confidence_t(n - 1) * sem
    lower = F.when(n >= 2, mean - half).otherwise(mean)
    upper = F.when(n >= 2, mean + half).otherwise(mean)
    return n, mean, lower, upper
