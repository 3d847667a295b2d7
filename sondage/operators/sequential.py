"""Posteriors that grow with each answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaussian_posterior(df: DataFrame, keys: list[str], step: str, value: str, *, prior_sd: float = 1.0, noise_sd: float = 1.0) -> DataFrame:
    """Posterior mean and sd of a normal trait after each step's answer.

    Precisions add up, so the state after n answers is a running sum and a running count: one window.
    """
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    prior, each = 1 / prior_sd**2, 1 / noise_sd**2
    precision = F.lit(prior) + each * F.count(value).over(w)
    return df.withColumn("mean", each * F.sum(value).over(w) / precision).withColumn("sd", 1 / F.sqrt(precision))
