"""Reports of how near estimates come to the truth, and figures held against bars that were set before."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import safe_corr

#: The bars of estimated traits.
MOST_RMSE, LEAST_LIFT = 0.5, 0.30


@dataclass(frozen=True)
class Bar:
    """A figure passes from `low` to `high`, both included; None leaves that side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The bars of an answering population.
POPULATION_BARS = (
    Bar("max_pair_agreement", high=0.95),
    Bar("median_pair_agreement", high=0.80),
    Bar("effective_dimensions", low=5.0),
    Bar("median_obedience", low=0.5),
    Bar("retest_agreement", low=0.70, high=0.90),
)


def verdict(metrics: DataFrame, bars: Sequence[Bar] = POPULATION_BARS) -> DataFrame:
    """(metric, value, low, high, pass, all_pass): each bar with its figure, from `metrics` (metric, value).

    A figure that is missing, null or NaN neither passes nor fails, and keeps all_pass from being true.
    """
    table = metrics.sparkSession.createDataFrame([(b.metric, b.low, b.high) for b in bars], "metric string, low double, high double")
    value = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    held = table.join(metrics.select("metric", value.alias("value")), "metric", "left")
    inside = (F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    rows = held.withColumn("pass", F.when(F.col("value").isNotNull(), inside))
    every = rows.agg(F.min(F.coalesce("pass", F.lit(False))).alias("all_pass"))
    return rows.crossJoin(every).select("metric", "value", "low", "high", "pass", "all_pass")  # one row


def accuracy(cells: DataFrame, dimension: str = "dim") -> DataFrame:
    """(dim, n, rmse, corr, baseline_rmse, lift) of each dimension and, with a null one, of all cells together.

    `cells` has the dimension, centre, truth and baseline, one row a person and dimension. `lift` is what the estimate takes off the baseline's error.
    """
    known = cells.where(F.col("centre").isNotNull() & F.col("truth").isNotNull())
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("truth"), 2)))
    out = known.groupingSets([[], [F.col(dimension)]], dimension).agg(
        F.count("*").alias("n"), rmse("centre").alias("rmse"), safe_corr(F.col("centre"), F.col("truth")).alias("corr"), rmse("baseline").alias("baseline_rmse")
    )
    return out.withColumn("lift", 1 - F.try_divide("rmse", "baseline_rmse"))


def accuracy_bars(report: DataFrame, dimension: str = "dim", *, most: float = MOST_RMSE, least: float = LEAST_LIFT) -> DataFrame:
    """One row from accuracy(): the worst dimension and its error, how many pass, the pooled error and lift, and both verdicts."""
    each, pooled = F.col(dimension).isNotNull(), F.col(dimension).isNull()
    worst = F.max(F.when(each, F.struct("rmse", dimension)))
    lift = F.max(F.when(pooled, F.col("lift")))
    return report.agg(
        worst[dimension].alias("worst_dimension"),
        worst["rmse"].alias("worst_rmse"),
        F.count(F.when(each & (F.col("rmse") <= most), 1)).alias("passing"),
        F.max(F.when(pooled, F.col("rmse"))).alias("pooled_rmse"),
        lift.alias("pooled_lift"),
        (worst["rmse"] <= most).alias("rmse_pass"),
        (lift >= least).alias("lift_pass"),
    )
