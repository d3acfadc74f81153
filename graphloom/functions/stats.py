"""Safe ratios, intervals and percentiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def safe_div(a: Column, b: Column) -> Column:
    """Null where the divisor is 0 or null; six places, half to even."""
    return F.bround(F.try_divide(a, F.nullif(b, F.lit(0))), 6)


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval; (0, 0) without trials."""
    n, p = total.cast("double"), successes / total
    bottom = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / bottom
    spread = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z / bottom
    nothing = total == 0
    return F.when(nothing, 0.0).otherwise(F.greatest(F.lit(0.0), middle - spread)), F.when(nothing, 0.0).otherwise(F.least(F.lit(1.0), middle + spread))


def nearest_rank(value: str, q: float) -> Column:
    """The least value with at least a share q of all values at or below it."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def continuous(value: str, q: float) -> Column:
    return F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY {value})")


def index_rounded(values: Column, q: float) -> Column:
    """Element of a sorted array at round((n - 1) * q), half to even."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.bround((F.size(ordered) - 1) * F.lit(q), 0) + 1).cast("int"))


def bootstrap_ci(rows: DataFrame, key: str, value: str, resamples: int = 2000, seed: int = 17) -> DataFrame:
    """key, mean, low, high: resampled means of each group.

    Groups are first brought down to counts of distinct values, so that a group of any size is resampled as a
    multinomial over those counts.
    """
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        v, n = pdf[value].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)
        means = np.sort(np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), size=resamples) @ v / n.sum())
        pick = lambda q: float(means[round((resamples - 1) * q)])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [float((v * n).sum() / n.sum())], "low": [pick(0.025)], "high": [pick(0.975)]})

    kind = dict(rows.dtypes)[key]
    return counts.groupBy(key).applyInPandas(resample, f"{key} {kind}, mean double, low double, high double")
