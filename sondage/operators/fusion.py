"""Free-text scores as measurements of traits: y = B theta + c + noise, the noise with a diagonal and a low-rank part.

Everything that is fitted comes from cross products of scores and traits in each fold, taken in one pass; ridge weights and shapes of
the noise are then compared out of fold on the driver, in (scores + traits)^2 numbers a fold. What a person's scores say of
their traits is added to other evidence in information form: a precision B'P^-1 B, the same for all, and a shift B'P^-1 (y - c).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions import noise

from .linear import Products, _all_known, _dot, _double

#: Fixed values of the principal-factor iteration: its rounds, and the floor of a score's own noise as a share of the mean variance.
FACTOR_ROUNDS, FLOOR_SHARE = 200, 1e-3


def hash_fold(key: Column, folds: int, seed: int = 0) -> Column:
    """A fold, 0 to folds - 1, by hash."""
    return F.floor(noise.hash_uniform(F.lit(seed), key) * folds).cast("int")


def fold_products(df: DataFrame, names: Sequence[str], fold: Column) -> dict[int, Products]:
    """The cross products of each fold, in one pass."""
    columns = [_double(x) for x in names]
    held = df.where(_all_known(columns)).select(fold.alias("fold"), *[c.alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = held.groupBy("fold").agg(F.count("*").alias("n"), F.array(*[F.avg(f"c{i}") for i in range(len(names))]).alias("m"), F.array(*[F.covar_pop(f"c{i}", f"c{j}") for i, j in pairs]).alias("s")).collect()
    out = {}
    for row in rows:
        sums = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, row["s"], strict=True):
            sums[i, j] = sums[j, i] = row["n"] * v
        out[row["fold"]] = Products(list(names), row["n"], np.array(row["m"]), sums)
    return out


def merged(parts: Sequence[Products]) -> Products:
    """Cross products of several disjoint sets of rows together."""
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.means for p in parts) / n
    return Products(parts[0].names, n, mean, sum(p.sums + p.n * np.outer(p.means - mean, p.means - mean) for p in parts))


def noise_parts(covariance: np.ndarray, n_factors: int) -> tuple[np.ndarray, np.ndarray]:
    """A covariance as a diagonal and a factor of n_factors columns, by principal factors: the factor from what the diagonal leaves, in turns."""
    variance = np.diag(covariance)
    floor = FLOOR_SHARE * variance.mean()
    own, factor = np.maximum(variance, floor), np.zeros((len(variance), n_factors))
    for _ in range(FACTOR_ROUNDS if n_factors else 0):
        value, vector = np.linalg.eigh(covariance - np.diag(own))
        factor = vector[:, ::-1][:, :n_factors] * np.sqrt(np.maximum(value[::-1][:n_factors], 0))
        last, own = own, np.maximum(variance - (factor**2).sum(1), floor)
        if np.abs(own - last).max() < 1e-10:
            break
    return own, factor


def solve_noise(own: np.ndarray, factor: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(D + F F')^-1 x with no matrix of scores x scores: D^-1 x - D^-1 F (I + F'D^-1 F)^-1 F'D^-1 x."""
    over = factor / own[:, None]
    small = np.eye(factor.shape[1]) + factor.T @ over
    plain = (x.T / own).T
    return plain - over @ np.linalg.solve(small, factor.T @ plain)


def log_density(own: np.ndarray, factor: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log densities of rows of x under a normal law of mean zero and covariance D + F F'."""
    small = np.eye(factor.shape[1]) + factor.T @ (factor / own[:, None])
    log_det = np.log(own).sum() + np.linalg.slogdet(small)[1]
    return -0.5 * ((x * solve_noise(own, factor, x.T).T).sum(1) + log_det + x.shape[1] * np.log(2 * np.pi))


@dataclass(frozen=True)
class Measurement:
    """Scores are centred and scaled first; own and factor are the noise's parts."""

    scores: list[str]
    centre: np.ndarray
    scale: np.ndarray
    loading: np.ndarray
    offset: np.ndarray
    own: np.ndarray
    factor: np.ndarray
    ridge: float

    @property
    def _gain(self) -> np.ndarray:
        return solve_noise(self.own, self.factor, self.loading)

    @property
    def precision(self) -> np.ndarray:
        p = self.loading.T @ self._gain
        return (p + p.T) / 2

    def evidence(self, df: DataFrame, key: str = "pid") -> DataFrame:
        """(pid, precision, shift) of every row whose scores are all known."""
        y = [(_double(s) - F.lit(float(m))) / F.lit(float(v)) - F.lit(float(c)) for s, m, v, c in zip(self.scores, self.centre, self.scale, self.offset, strict=True)]
        precision = F.array(*[F.lit(float(v)) for v in self.precision.ravel()])
        shift = F.array(*[_dot(y, column) for column in self._gain.T])
        return df.where(_all_known(y)).select(F.col(key).alias("pid"), precision.alias("precision"), shift.alias("shift"))


def scores_only(evidence: DataFrame, model: Measurement) -> DataFrame:
    """(pid, theta, covariance) from the scores and the standard normal prior alone, in closed form."""
    covariance = np.linalg.inv(np.eye(len(model.precision)) + model.precision)
    shift = [F.get(F.col("shift"), F.lit(i)) for i in range(len(covariance))]
    return evidence.select("pid", F.array(*[_dot(shift, row) for row in covariance]).alias("theta"), F.array(*[F.lit(float(v)) for v in covariance.ravel()]).alias("covariance"))


def _regression(p: Products, scores: Sequence[str], traits: Sequence[str], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and offsets of standardised scores on traits: the penalty is on the loadings, not on the offsets."""
    loading = np.linalg.solve(p.block(traits, traits) + ridge * np.eye(len(traits)), p.block(traits, scores)).T
    return loading, p.mean(scores) - loading @ p.mean(traits)


def _moments(p: Products, weights: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Mean of e e' over rows for e = weights' row - offset."""
    mean = weights.T @ p.means - offset
    return weights.T @ p.sums @ weights / p.n + np.outer(mean, mean)


def _scaled(p: Products, centre: np.ndarray, scale: np.ndarray) -> Products:
    return Products(p.names, p.n, (p.means - centre) / scale, p.sums / np.outer(scale, scale))


def fit_measurement(
    df: DataFrame, scores: Sequence[str], traits: Sequence[str], fold: Column, *, ridges: Sequence[float] = (0.1, 1.0, 10.0, 100.0), factors: Sequence[int] = (0, 1, 2, 3)
) -> tuple[Measurement, list[tuple[float, int, float]]]:
    """The measurement model whose out-of-fold posteriors give the traits the highest mean density, and (ridge, factors, loss) of all candidates.

    Loadings are fitted on all rows; the noise comes from residuals out of fold. Constant scores raise an error, as does a single fold.
    """
    parts = fold_products(df, [*scores, *traits], fold)
    if len(parts) < 2:
        raise ValueError("at least two folds with rows are needed")
    total = merged(list(parts.values()))
    m, d = len(scores), len(traits)
    spread = np.sqrt(np.diag(total.sums) / total.n)
    if (spread[:m] < 1e-9).any():
        raise ValueError("a score is constant")
    centre, scale = np.concatenate([total.means[:m], np.zeros(d)]), np.concatenate([spread[:m], np.ones(d)])
    parts = {k: _scaled(p, centre, scale) for k, p in parts.items()}
    total = merged(list(parts.values()))
    curve, residuals = [], {}
    for ridge in ridges:
        out_of_fold, losses = np.zeros((m, m)), np.zeros(len(factors))
        for k, test in parts.items():
            train = merged([p for j, p in parts.items() if j != k])
            loading, offset = _regression(train, scores, traits, ridge)
            error = np.vstack([np.eye(m), -loading.T])  # y - B theta - c
            out_of_fold += test.n * _moments(test, error, offset)
            inner = _moments(train, error, offset)
            for i, n_factors in enumerate(factors):
                own, factor = noise_parts(inner, n_factors)
                gain = solve_noise(own, factor, loading)
                precision = np.eye(d) + loading.T @ gain
                back = np.linalg.solve(precision, gain.T)  # theta is expected at back (y - c)
                miss = _moments(test, np.vstack([-back.T, np.eye(d)]), -back @ offset)
                losses[i] += test.n * 0.5 * (np.trace(precision @ miss) - np.linalg.slogdet(precision)[1] + d * np.log(2 * np.pi))
        residuals[ridge] = out_of_fold / total.n
        curve += [(float(ridge), int(f), float(loss / total.n)) for f, loss in zip(factors, losses)]
    ridge, n_factors, _ = min(curve, key=lambda c: c[2])
    loading, offset = _regression(total, scores, traits, ridge)
    own, factor = noise_parts(residuals[ridge], n_factors)
    return Measurement(list(scores), centre[:m], scale[:m], loading, offset, own, factor, ridge), curve
