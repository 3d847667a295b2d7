"""Reproducible normal draws, predictions averaged over a posterior, and whether declared spreads hold.

Draws are hashes of a key and their place, so any engine can repeat them, a lost task gives the same ones again, and no state is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sondage.functions import noise

from .graded import _lists, _matrix, answer_probabilities, bank_of

#: The share within one standard deviation that passes, the percentile that a wider interval would have to reach, a floor of spreads.
BAND, NOMINAL, LEAST_SPREAD = (0.60, 0.75), 0.68, 1e-12


def normal(*parts: Column) -> Column:
    """A standard normal number from two hashes of the parts (Box and Muller)."""
    radius = F.sqrt(-2 * F.log(1 - noise.hash_uniform(*parts, F.lit("r"))))
    return radius * F.cos(2 * math.pi * noise.hash_uniform(*parts, F.lit("a")))


def normal_draws(key: Column, n: int, d: int, seed: int = 0) -> Column:
    """Array of n arrays of d independent standard normal numbers for each key."""
    places = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    return F.transform(places(n), lambda i: F.transform(places(d), lambda j: normal(F.lit(seed), key, i, j)))


def with_factor(df: DataFrame, covariance: str, d: int, out: str = "factor") -> DataFrame:
    """Adds the lower Cholesky factor of a covariance (arrays, row by row). Of one that is not positive definite, directions without spread count as none."""

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _matrix(batch.column(covariance), d * d).reshape(-1, d, d)
            s = (s + s.transpose(0, 2, 1)) / 2
            try:
                lower = np.linalg.cholesky(s)
            except np.linalg.LinAlgError:
                value, vector = np.linalg.eigh(s)
                root = vector * np.sqrt(np.maximum(value, 1e-10))[:, None]
                lower = np.linalg.qr(root.transpose(0, 2, 1))[1].transpose(0, 2, 1)
                lower = lower * np.where(np.diagonal(lower, axis1=1, axis2=2) < 0, -1, 1)[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(lower.reshape(len(s), -1))], [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(factored, f"{schema}, `{out}` array<double>")


def correlated(mean: Column, factor: Column, draws: Column, d: int) -> Column:
    """mean + L z for each array z of `draws`."""
    dot = lambda z, i: F.aggregate(F.zip_with(F.slice(factor, i * d + 1, F.lit(d)), z, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return F.transform(draws, lambda z: F.transform(mean, lambda m, i: m + dot(z, i)))


def posterior_predictions(people: DataFrame, items: DataFrame, n_traits: int, *, n_draws: int = 512, seed: int = 0) -> DataFrame:
    """(pid, item_id, p): category probabilities averaged over draws of each person's posterior; all items share a person's draws.

    `people` has pid, theta and covariance. Items are a bank that every task holds.
    """
    bank, where = bank_of(items, n_traits), with_factor(people.select("pid", "theta", "covariance"), "covariance", n_traits)
    draws = correlated(F.col("theta"), F.col("factor"), normal_draws(F.col("pid"), n_draws, n_traits, seed), n_traits)
    shared, id_type, item_type = people.sparkSession.sparkContext.broadcast(bank), dict(people.dtypes)["pid"], dict(items.dtypes)["item_id"]
    names = pa.array(bank.ids, to_arrow_type(items.schema["item_id"].dataType))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                p = answer_probabilities(_matrix(batch.column("draws")[i].values, n_traits), bank)[0].mean(0)
                lists = pa.array([row[: n + 1] for row, n in zip(p, bank.n_cuts)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("pid").take(pa.array(np.full(len(names), i))), names, lists], ["pid", "item_id", "p"])

    return where.select("pid", draws.alias("draws")).mapInArrow(predicted, f"pid {id_type}, item_id {item_type}, p array<double>")


def spread_of_draws(draws: Column, d: int) -> Column:
    """Standard deviation (of the population) of each component over an array of draws."""
    mean = lambda f: F.aggregate(draws, F.lit(0.0), lambda t, z: t + f(z)) / F.size(draws)
    each = lambda i: F.sqrt(F.greatest(mean(lambda z: F.pow(F.get(z, F.lit(i)), 2)) - F.pow(mean(lambda z: F.get(z, F.lit(i))), 2), F.lit(0.0)))
    return F.array(*[each(i) for i in range(d)])


def honesty(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often the truth lies within one declared spread, and what the spread would have to be.

    `cells` has centre, spread and truth, one row a person and dimension. Rows with a null in one of them are not read.
    Columns: cells, coverage, mean_spread, mean_error, predicted_variance, actual_variance, variance_ratio, nominal_factor, pass.
    """
    error = F.abs(F.col("centre") - F.col("truth"))
    held = cells.where(error.isNotNull() & F.col("spread").isNotNull()).withColumn("__error", error)
    inside = F.avg((F.col("__error") <= F.col("spread")).cast("double"))
    predicted, actual = F.avg(F.col("spread") * F.col("spread")), F.avg(F.col("__error") * F.col("__error"))
    return held.groupBy(*keys).agg(
        F.count("*").alias("cells"),
        inside.alias("coverage"),
        F.avg("spread").alias("mean_spread"),
        F.avg("__error").alias("mean_error"),
        predicted.alias("predicted_variance"),
        actual.alias("actual_variance"),
        F.try_divide(actual, predicted).alias("variance_ratio"),
        F.percentile(F.col("__error") / F.greatest(F.col("spread"), F.lit(LEAST_SPREAD)), F.lit(NOMINAL)).alias("nominal_factor"),
        inside.between(*BAND).alias("pass"),
    )


def calibration(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, residual_rms, spread_rms, kappa): one factor for each dimension that makes mean squared spreads equal mean squared residuals.

    `cells` has centre, spread and full, the centre that all answers give.
    """
    held = cells.where(F.col("centre").isNotNull() & F.col("full").isNotNull() & F.col("spread").isNotNull())
    rms = lambda c: F.sqrt(F.avg(c * c))
    out = held.groupBy(*keys).agg(F.count("*").alias("cells"), rms(F.col("centre") - F.col("full")).alias("residual_rms"), rms(F.col("spread")).alias("spread_rms"))
    return out.withColumn("kappa", F.col("residual_rms") / F.greatest("spread_rms", F.lit(LEAST_SPREAD)))


def calibrated_covariance(covariance: Column, kappa: Sequence[float]) -> Column:
    """K S K with K = diag(kappa), row by row."""
    d = len(kappa)
    factors = F.array(*[F.lit(float(a * b)) for a in kappa for b in kappa])
    return F.when(F.size(covariance) == d * d, F.zip_with(covariance, factors, lambda s, k: s * k))
