"""Linear models and alignments from mergeable cross products: ridge with exact leave-one-out, rotations, canonical correlations.

A table of any number of rows is reduced to the sums of products of its columns; the driver solves with those
(columns x columns numbers), and what each row gets, a prediction, its leverage or its rotated vector, is a column
expression. Rows with a null or NaN in a column that is used are left out of fits and get nulls.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A feature that spreads less is not scaled; a leverage is held below one.
LEAST_SPREAD, MOST_LEVERAGE = 1e-12, 1 - 1e-9


def _double(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def _all_known(columns: Sequence[Column]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return known


@dataclass(frozen=True)
class Products:
    """Number of rows, means, and sums of products of deviations from the means, of named columns."""

    names: list[str]
    n: int
    means: np.ndarray
    sums: np.ndarray

    def block(self, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
        at = {name: i for i, name in enumerate(self.names)}
        return self.sums[np.ix_([at[x] for x in left], [at[x] for x in right])]

    def mean(self, names: Sequence[str]) -> np.ndarray:
        return np.array([self.means[self.names.index(x)] for x in names])


def products(df: DataFrame, names: Sequence[str], *, centred: bool = True) -> Products:
    """Cross products of columns in one pass, by covariances that merge without cancellation; `centred=False` gives plain sums of products."""
    columns = [_double(x) for x in names]
    held = df.where(_all_known(columns)).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = held.agg(F.count("*").alias("n"), F.array(*[F.avg(f"c{i}") for i in range(len(names))]).alias("m"), F.array(*[F.covar_pop(f"c{i}", f"c{j}") for i, j in pairs]).alias("s")).first()
    n, k = row["n"], len(names)
    means, sums = np.zeros(k), np.zeros((k, k))
    if n:
        means = np.array(row["m"])
        for (i, j), v in zip(pairs, row["s"], strict=True):
            sums[i, j] = sums[j, i] = n * v
    if not centred:
        sums, means = sums + n * np.outer(means, means), np.zeros(k)
    return Products(list(names), n, means, sums)


def _dot(columns: Sequence[Column], weights: np.ndarray) -> Column:
    total = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        total = total + c * F.lit(float(w))
    return total


@dataclass(frozen=True)
class Ridge:
    """Weights of standardised features, one column for each target; the intercept is the target's mean and has no penalty."""

    features: list[str]
    targets: list[str]
    penalty: float
    n: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    inverse: np.ndarray

    def _standard(self) -> list[Column]:
        return [(_double(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(self.features, self.mean, self.scale, strict=True)]

    def predictions(self) -> dict[str, Column]:
        z = self._standard()
        return {t: F.lit(float(b)) + _dot(z, w) for t, b, w in zip(self.targets, self.intercepts, self.weights.T, strict=True)}

    def leverage(self) -> Column:
        """What a row weighs in its own prediction: 1/n for the intercept and |L z|^2 with the inverse's factor L."""
        z, factor = self._standard(), np.linalg.cholesky(self.inverse).T
        total = F.lit(1.0 / max(1, self.n))
        for row in factor:
            total = total + F.pow(_dot(z, row), 2)
        return F.least(F.greatest(total, F.lit(0.0)), F.lit(MOST_LEVERAGE))

    def left_out(self) -> dict[str, Column]:
        """Predictions of each row by a fit without it: y - (y - fitted) / (1 - leverage). Means and scales stay those of all rows."""
        h = self.leverage()
        return {t: _double(t) - (_double(t) - p) / (1 - h) for t, p in self.predictions().items()}


def solve_ridge(p: Products, features: Sequence[str], targets: Sequence[str], penalty: float) -> Ridge:
    """A ridge from cross products; many penalties cost one pass over the rows."""
    scale = np.sqrt(np.diag(p.block(features, features)) / max(1, p.n))
    scale[scale < LEAST_SPREAD] = 1.0
    gram = p.block(features, features) / np.outer(scale, scale) + penalty * np.eye(len(features))
    inverse = np.linalg.pinv(gram, hermitian=True) if penalty == 0 else np.linalg.inv(gram)
    inverse = (inverse + inverse.T) / 2 + 1e-300 * np.eye(len(features))
    weights = inverse @ (p.block(features, targets) / scale[:, None])
    return Ridge(list(features), list(targets), penalty, p.n, p.mean(features), scale, weights, p.mean(targets), inverse)


def fit_ridge(df: DataFrame, features: Sequence[str], targets: Sequence[str], penalty: float) -> Ridge:
    return solve_ridge(products(df, [*features, *targets]), features, targets, penalty)


def row_cosine(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Cosine of two vectors given as columns; a vector without length counts as zero."""
    size = lambda xs: F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
    unit = lambda s: F.when(s < LEAST_SPREAD, 1.0).otherwise(s)
    return sum((a * b for a, b in zip(left, right, strict=True)), F.lit(0.0)) / (unit(size(left)) * unit(size(right)))


def penalty_curve(df: DataFrame, features: Sequence[str], targets: Sequence[str], penalties: Sequence[float]) -> DataFrame:
    """(penalty, mean_cosine, median_cosine, mean_squared_error) of leave-one-out predictions: one pass for the sums, one for all penalties."""
    names = [*features, *targets]
    p = products(df, names)
    held = df.where(_all_known([_double(x) for x in names]))
    penalties = [float(x) for x in dict.fromkeys(penalties)]
    truth = [_double(t) for t in targets]
    sums = {"mean_cosine": [], "median_cosine": [], "mean_squared_error": []}
    for penalty in penalties:
        out = solve_ridge(p, features, targets, penalty).left_out()
        guess = [out[t] for t in targets]
        error = sum((F.pow(a - b, 2) for a, b in zip(guess, truth, strict=True)), F.lit(0.0)) / len(targets)
        cosine = row_cosine(guess, truth)
        for name, value in zip(sums, (F.avg(cosine), F.median(cosine), F.avg(error)), strict=True):
            sums[name].append(value)
    # one row of all penalties, so that rows are not multiplied by them; what is not asked for is not added up
    one = held.agg(F.count("*").alias("n"), *[v.alias(f"{name}_{i}") for name, values in sums.items() for i, v in enumerate(values)]).where("n > 0")
    each = one.select("*", F.posexplode(F.array(*[F.lit(x) for x in penalties])).alias("at", "penalty"))
    pick = lambda name: F.get(F.array(*[F.col(f"{name}_{i}") for i in range(len(penalties))]), F.col("at")).alias(name)
    return each.select("penalty", *[pick(name) for name in sums])


def best_penalty(curve: DataFrame) -> float:
    """The penalty of the highest median cosine; of equal ones the smallest."""
    return curve.orderBy(F.desc("median_cosine"), "penalty").first()["penalty"]


# alignments


def orthogonal_map(df: DataFrame, source: Sequence[str], target: Sequence[str]) -> np.ndarray:
    """The orthogonal R that brings source R nearest to target, from the singular vectors of their summed cross products."""
    u, _, vt = np.linalg.svd(products(df, [*source, *target], centred=False).block(source, target))
    return u @ vt


def rotated(columns: Sequence[Column], rotation: np.ndarray) -> list[Column]:
    """Row vectors times a matrix."""
    return [_dot(columns, rotation[:, k]) for k in range(rotation.shape[1])]


def rotated_covariance(covariance: Column, rotation: np.ndarray) -> Column:
    """R' S R of a covariance held as an array, row by row."""
    d, out = rotation.shape
    cells = [F.get(covariance, F.lit(i)) for i in range(d * d)]
    product = np.einsum("ja,kb->abjk", rotation, rotation).reshape(out * out, d * d)
    return F.array(*[_dot(cells, row) for row in product])


def canonical_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Correlations between two sets of columns, largest first, from one pass: singular values of the whitened cross product."""
    p = products(df, [*left, *right])

    def whitener(names: Sequence[str]) -> np.ndarray:
        value, vector = np.linalg.eigh(p.block(names, names))
        keep = value > LEAST_SPREAD * max(value.max(initial=0.0), 1e-300)
        return vector[:, keep] / np.sqrt(value[keep])

    s = np.linalg.svd(whitener(left).T @ p.block(left, right) @ whitener(right), compute_uv=False)
    out = np.zeros(min(len(left), len(right)))
    out[: len(s)] = np.clip(s[: len(out)], 0.0, 1.0)
    return out
