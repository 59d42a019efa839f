"""Tail probabilities for the small result tables."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors get the function itself and need not have this package installed
register_pickle_by_value(sys.modules[__name__])

KS_TERMS = 100


def ks_p_value(stat: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov tail, a plain Spark expression."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    root = F.sqrt(n1 * n2 / F.nullif(n1 + n2, F.lit(0.0)))
    lam = (root + F.lit(0.12) + F.lit(0.11) / F.nullif(root, F.lit(0.0))) * stat
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    # below 0.2 the series has not converged yet and the tail is 1 to 12 digits
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
    return F.when(lam.isNull(), F.lit(None).cast("double")).when(lam < 0.2, 1.0).otherwise(bounded)


def _chi2_tail(x: float, dof: int) -> float:
    """Upper tail for whole degrees of freedom: a finite sum, taken in logs."""
    if dof <= 0 or x <= 0:
        return 1.0
    h = x / 2.0
    if dof % 2 == 0:
        powers = np.arange(dof // 2, dtype=float)
        head = 0.0
    else:
        powers = np.arange(dof // 2, dtype=float) + 0.5
        head = math.erfc(math.sqrt(h))
    if powers.size == 0:
        return head
    logs = powers * math.log(h) - np.array([math.lgamma(p + 1.0) for p in powers]) - h
    top = logs.max()
    return float(min(1.0, head + math.exp(top) * np.exp(logs - top).sum()))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """One row per tested column reaches this, never a data row."""
    return pd.Series(
        [None if pd.isna(s) or pd.isna(d) else _chi2_tail(float(s), int(d)) for s, d in zip(stat, dof)],
        dtype="float64",
    )
