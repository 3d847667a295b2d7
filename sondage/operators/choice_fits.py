"""Logit fits of many decision makers, weighted replicates of them, and refits under a prior learned from all.

A decision maker with up to LARGE choice sets is solved where their sets meet; one with more, however many, by
Newton rounds whose sums come from chunks of sets over all tasks. Both give the same fit, all replicates of a decision maker at once.

Sets without a chosen option, or whose options are all alike, tell nothing and are left out. Null features count as missing
options: such rows are not read. Of several chosen options the first in the order given counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions import noise
from sondage.sources.stored import drop, stored

from .graded import _lists, _matrix, sum_arrays

RIDGE = 1e-4
MIN_SETS = 20
LARGE = 2048
_AT_ONCE = 1 << 18  # options x replicates x features of the decision makers that are solved together
#: Kept off singular: added to the variances of a learned prior.
PRIOR_FLOOR = 1e-6
#: P(draw <= k) of a Poisson variable of mean one, k = 0 to 9.
POISSON = [float(np.exp(-1) * sum(1 / np.prod(np.arange(1.0, j + 1)) for j in range(k + 1))) for k in range(10)]


@dataclass(frozen=True)
class Prior:
    """A normal prior of the coefficients; the ridge is one around zero."""

    mean: np.ndarray
    precision: np.ndarray

    @staticmethod
    def ridge(n: int, weight: float = RIDGE) -> Prior:
        return Prior(np.zeros(n), weight * np.eye(n))


def replicate_weights(key: Column, replicates: int, seed: int = 0) -> Column:
    """Weights of one choice set in each replicate: Poisson draws of mean one by hash of seed, key and replicate.

    The draws of a set need nothing of the other sets, so resampling takes no shuffle; the number of sets of a replicate varies around its mean.
    """
    uniform = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda b: noise.hash_uniform(F.lit(seed), key, b))  # once for each draw
    thresholds = F.array(*[F.lit(t) for t in POISSON])
    return F.transform(uniform, lambda u: F.size(F.filter(thresholds, lambda t: t <= u)).cast("double"))


def choice_sets(options: DataFrame, who: str, choice_set: str, features: list[str], chosen: str, *, order: list[str]) -> DataFrame:
    """(who, set, x, chosen): one row a choice set, options' features one behind another and the place of the chosen one."""
    known = options.where(F.col(who).isNotNull())
    for f in features:
        known = known.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.coalesce(F.col(chosen), F.lit(False)).alias("c"))
    sets = known.groupBy(F.col(who).alias("who"), F.col(choice_set).alias("set")).agg(F.sort_array(F.collect_list(row)).alias("r"), F.max(F.col(chosen)).alias("any"))
    varies = F.size(F.array_distinct(F.col("r.x"))) > 1
    return sets.where(F.col("any") & varies).select("who", "set", F.flatten("r.x").alias("x"), (F.array_position("r.c", True) - 1).cast("int").alias("chosen"))


def sums_at(x: np.ndarray, starts: np.ndarray, chosen: np.ndarray, weights: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted log likelihoods, gradients and information of all replicates: `weights` sets x replicates, `beta` replicates x features."""
    sizes = np.diff(np.append(starts, len(x)))
    u = x @ beta.T
    u -= np.repeat(np.maximum.reduceat(u, starts), sizes, axis=0)
    e = np.exp(u)
    total = np.add.reduceat(e, starts)
    p = e / np.repeat(total, sizes, axis=0)
    value = (weights * (u[chosen] - np.log(total))).sum(0)
    mean = np.add.reduceat(p[:, :, None] * x[:, None], starts)
    gradient = np.einsum("sb,sbp->bp", weights, x[chosen][:, None] - mean)
    spread = np.einsum("nb,np,nq->bpq", p * np.repeat(weights, sizes, axis=0), x, x, optimize=True)
    return value, gradient, spread - np.einsum("sb,sbp,sbq->bpq", weights, mean, mean, optimize=True)


class _Climb:
    """Damped Newton of many replicates: where to look next, given what was found there."""

    def __init__(self, beta: np.ndarray, prior: Prior):
        self.prior, self.at, self.step = prior, beta, np.zeros_like(beta)
        self.best = np.full(len(beta), -np.inf)
        self.information = np.tile(np.eye(beta.shape[1]), (len(beta), 1, 1))

    def only(self, rows: np.ndarray) -> _Climb:
        part = _Climb(self.at[rows], self.prior)
        part.step, part.best, part.information = self.step[rows], self.best[rows], self.information[rows]
        return part

    def put(self, rows: np.ndarray, part: _Climb) -> None:
        self.at[rows], self.step[rows], self.best[rows], self.information[rows] = part.at, part.step, part.best, part.information

    @property
    def trial(self) -> np.ndarray:
        return self.at + self.step

    def found(self, value: np.ndarray, gradient: np.ndarray, information: np.ndarray) -> None:
        trial = self.trial
        off = trial - self.prior.mean
        value = value - 0.5 * np.einsum("bp,pq,bq->b", off, self.prior.precision, off)
        better = value >= self.best - 1e-12 * np.abs(self.best)
        newton = np.linalg.solve(information + self.prior.precision, (gradient - off @ self.prior.precision)[:, :, None])[:, :, 0]
        self.at = np.where(better[:, None], trial, self.at)
        self.best = np.where(better, value, self.best)
        self.information = np.where(better[:, None, None], information + self.prior.precision, self.information)
        self.step = np.where(better[:, None], newton, self.step / 2)

    def moves(self, tol: float) -> np.ndarray:
        return np.abs(self.step).max(1) > tol * np.maximum(1, np.abs(self.at).max(1))

    def log_likelihood(self) -> np.ndarray:
        off = self.at - self.prior.mean
        return self.best + 0.5 * np.einsum("bp,pq,bq->b", off, self.prior.precision, off)


def _flat(xs: pa.Array, chosen: pa.Array, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Options, where each set starts, and the rows that were chosen."""
    sizes = np.asarray(xs.value_lengths()) // p
    starts = np.cumsum(sizes) - sizes
    return _matrix(xs, p), starts, starts + chosen.to_numpy(zero_copy_only=False)


_FIT = "who {who}, n_sets long, replicate int, beta array<double>, log_likelihood double, covariance array<double>, converged boolean"


def _rows(who: pa.Array, n_sets: pa.Array, climb: _Climb, converged: np.ndarray) -> pa.RecordBatch:
    """One row a replicate; `who` and `n_sets` are repeated for each."""
    cov = np.linalg.inv(climb.information).reshape(len(climb.at), -1)
    each = np.tile(np.arange(len(climb.at) // len(who)) + 1, len(who))
    at = pa.array(np.repeat(np.arange(len(who)), len(climb.at) // len(who)))
    columns = [who.take(at), n_sets.take(at), pa.array(each, pa.int32()), _lists(climb.at), pa.array(climb.log_likelihood()), _lists(cov), pa.array(converged)]
    return pa.RecordBatch.from_arrays(columns, ["who", "n_sets", "replicate", "beta", "log_likelihood", "covariance", "converged"])


@dataclass
class _Together:
    """Choice sets of several decision makers, one behind another: features of options, sizes and chosen rows of sets, weights of sets, sets of each."""

    x: np.ndarray
    sizes: np.ndarray
    chosen: np.ndarray
    weights: np.ndarray
    n_sets: np.ndarray

    def only(self, keep: np.ndarray) -> _Together:
        sets = np.repeat(keep, self.n_sets)
        place = self.chosen - (np.cumsum(self.sizes) - self.sizes)
        sizes = self.sizes[sets]
        return _Together(self.x[np.repeat(sets, self.sizes)], sizes, np.cumsum(sizes) - sizes + place[sets], self.weights[sets], self.n_sets[keep])

    def sums_at(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`sums_at` of each decision maker, those of its replicates one behind another; `beta` is such rows."""
        n, b, p = len(self.n_sets), self.weights.shape[1], self.x.shape[1]
        starts, firsts = np.cumsum(self.sizes) - self.sizes, np.cumsum(self.n_sets) - self.n_sets
        of_set = np.repeat(np.arange(n), self.n_sets)
        each = beta.reshape(n, b, p)[np.repeat(of_set, self.sizes)]
        u = np.einsum("np,nbp->nb", self.x, each)
        u -= np.repeat(np.maximum.reduceat(u, starts), self.sizes, axis=0)
        e = np.exp(u)
        total = np.add.reduceat(e, starts)
        shares = e / np.repeat(total, self.sizes, axis=0)
        by_person = lambda v: np.add.reduceat(v, firsts)
        value = by_person(self.weights * (u[self.chosen] - np.log(total)))
        mean = [np.add.reduceat(shares * self.x[:, i, None], starts) for i in range(p)]
        gradient = np.stack([by_person(self.weights * (self.x[self.chosen, i, None] - mean[i])) for i in range(p)], 2)
        information = np.empty((n, b, p, p))
        for i in range(p):
            for j in range(i, p):
                spread = np.add.reduceat(shares * (self.x[:, i] * self.x[:, j])[:, None], starts) - mean[i] * mean[j]
                information[:, :, i, j] = information[:, :, j, i] = by_person(self.weights * spread)
        return value.ravel(), gradient.reshape(-1, p), information.reshape(-1, p, p)


def _fit_together(batch: pa.RecordBatch, p: int, replicates: int, prior: Prior, rounds: int, tol: float) -> pa.RecordBatch:
    """Fits of all rows at once; a decision maker none of whose replicates moves is left as it is, while the others go on."""
    xs = batch.column("x").flatten()
    x, starts, chosen = _flat(xs, batch.column("chosen").flatten(), p)
    n_sets = batch.column("x").value_lengths().to_numpy()
    sets = _Together(x, np.diff(np.append(starts, len(x))), chosen, _matrix(batch.column("w"), replicates), n_sets)
    climb = _Climb(np.tile(prior.mean, (replicates * len(n_sets), 1)), prior)
    going = np.ones(len(n_sets), bool)
    for _ in range(rounds):
        rows = np.repeat(going, replicates)
        part = climb.only(rows)
        part.found(*sets.sums_at(part.trial))
        climb.put(rows, part)
        moves = part.moves(tol).reshape(-1, replicates).any(1)
        if not moves.all():
            sets = sets.only(moves)
            going[going] = moves
        if not going.any():
            break
    return _rows(batch.column("who"), batch.column("n_sets"), climb, ~climb.moves(tol))


@dataclass(frozen=True)
class _Makers:
    """Decision makers: those with few choice sets as a row each (who, n_sets and `r`, their sets in order), and of the others, if any, how many each has in `sets`."""

    few: DataFrame
    many: DataFrame | None
    sets: DataFrame


def _makers(sets: DataFrame, large: int) -> _Makers:
    """The sets are made once and stored, whoever reads them; each moves once more, to its decision maker's others."""
    sets = stored(sets.where(F.col("who").isNotNull()).select("who", "set", "x", "chosen"), "choice-sets")
    many = sets.groupBy("who").agg(F.count("*").alias("n_sets")).where(F.col("n_sets") > large)
    if many.isEmpty():
        few, many = sets, None
    else:
        few = sets.join(F.broadcast(many), "who", "left_anti")  # of `large` sets one row at most
    met = few.repartition("who").groupBy("who").agg(F.sort_array(F.collect_list(F.struct("set", "x", "chosen"))).alias("r"))
    return _Makers(met.select("who", F.size("r").cast("long").alias("n_sets"), "r"), many, sets)


def _weights(who: Column, choice_set: Column, replicates: int, seed: int) -> Column:
    return replicate_weights(F.concat_ws("|", who.cast("string"), choice_set.cast("string")), replicates, seed) if replicates else F.array(F.lit(1.0))


def _fit_here(few: DataFrame, p: int, replicates: int, seed: int, prior: Prior, rounds: int, tol: float) -> DataFrame:
    """Fits of decision makers whose sets meet in one row; weights are drawn there, so that they are not shuffled."""
    who_type, weights = dict(few.dtypes)["who"], F.transform("r", lambda s: _weights(F.col("who"), s["set"], replicates, seed))
    packed = few.select("who", "n_sets", F.col("r.x").alias("x"), F.col("r.chosen").alias("chosen"), F.flatten(weights).alias("w"))
    replicates = max(1, replicates)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("x").flatten().value_lengths().to_numpy()
            ends = np.cumsum(batch.column("x").value_lengths().to_numpy())
            work = np.append(0, np.cumsum(sizes))[ends] * replicates  # of the first so many decision makers
            low = 0
            while low < batch.num_rows:
                high = max(int(np.searchsorted(work, (work[low - 1] if low else 0) + _AT_ONCE, "right")), low + 1)
                yield _fit_together(batch.slice(low, high - low), p, replicates, prior, rounds, tol)
                low = high

    return packed.mapInArrow(fit, _FIT.format(who=who_type))


def _fit_large(sets: DataFrame, p: int, replicates: int, prior: Prior, rounds: int, tol: float, who_type: str) -> DataFrame:
    """Fits by rounds: each sums over all sets, whatever the number of one decision maker's, and moves every one of them."""
    sets = stored(sets, "choice-sets")
    size = replicates * p
    state = stored(sets.select("who", "n_sets").distinct(), "choice-state")
    names, state = ["at", "step", "best", "information"], state.withColumns({c: F.array().cast("array<double>") for c in ("at", "step", "best", "information")})

    def climb_of(batch: pa.RecordBatch, i: int) -> _Climb:
        at = batch.column("at")[i].values.to_numpy()
        climb = _Climb(at.reshape(replicates, p) if len(at) else np.tile(prior.mean, (replicates, 1)), prior)
        if len(at):
            climb.step, climb.best = batch.column("step")[i].values.to_numpy().reshape(replicates, p), batch.column("best")[i].values.to_numpy()
            climb.information = batch.column("information")[i].values.to_numpy().reshape(replicates, p, p)
        return climb

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("who").dictionary_encode()
            codes = keys.indices.to_numpy()
            found = []
            for k in range(len(keys.dictionary)):
                some = batch.filter(pa.array(codes == k))
                x, starts, chosen = _flat(some.column("x"), some.column("chosen"), p)
                trial = some.column("trial")[0].values.to_numpy().reshape(-1, p)
                value, gradient, information = sums_at(x, starts, chosen, _matrix(some.column("w"), replicates), trial)
                found.append(np.concatenate([value, gradient.ravel(), information.ravel()]))
            if found:
                yield pa.RecordBatch.from_arrays([keys.dictionary, _lists(np.array(found))], ["who", "s"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            going = []
            for i in range(batch.num_rows):
                climb, s = climb_of(batch, i), batch.column("s")[i].values.to_numpy()
                climb.found(s[:replicates], s[replicates : replicates + size].reshape(replicates, p), s[replicates + size :].reshape(replicates, p, p))
                for c in names:
                    out[c].append(getattr(climb, c).ravel())
                going.append(bool(climb.moves(tol).any()))
            yield pa.RecordBatch.from_arrays([batch.column("who"), batch.column("n_sets"), *(_lists(np.array(out[c])) for c in names), pa.array(going)], ["who", "n_sets", *names, "going"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                climb = climb_of(batch, i)
                yield _rows(batch.column("who").slice(i, 1), batch.column("n_sets").slice(i, 1), climb, ~climb.moves(tol))

    arrays = ", ".join(f"{c} array<double>" for c in names)
    origin = F.array(*[F.lit(float(b)) for b in np.tile(prior.mean, replicates)])
    for _ in range(rounds):
        trial = F.when(F.size("at") > 0, F.zip_with("at", "step", lambda a, b: a + b)).otherwise(origin)
        parts = sets.select("who", "x", "chosen", "w").join(state.select("who", trial.alias("trial")), "who").mapInArrow(summed, f"who {who_type}, s array<double>")
        sums = parts.groupBy("who").agg(sum_arrays("s", replicates + size + size * p).alias("s"))
        new = stored(state.select("who", "n_sets", *names).join(sums, "who").mapInArrow(moved, f"who {who_type}, n_sets long, {arrays}, going boolean"), "choice-state")
        drop(state)
        state = new
        if state.where("going").isEmpty():
            break
    drop(sets)
    return state.select("who", "n_sets", *names).mapInArrow(finished, _FIT.format(who=who_type))


def fit_choices(
    sets: DataFrame, n_features: int, *, replicates: int = 0, seed: int = 0, prior: Prior | None = None, min_sets: int = MIN_SETS, large: int = LARGE, rounds: int = 60, tol: float = 1e-9
) -> DataFrame:
    """who, n_sets, replicate, beta, log_likelihood, covariance (inverse information, row by row) and converged.

    `sets` comes from choice_sets. Decision makers with fewer than `min_sets` sets have no row. Without `replicates` there is one
    fit of all sets (replicate 1); with them, one of each set of weights.
    """
    return _fits(_makers(sets, large), n_features, replicates, seed, prior or Prior.ridge(n_features), min_sets, rounds, tol)


def _fits(makers: _Makers, p: int, replicates: int, seed: int, prior: Prior, min_sets: int, rounds: int, tol: float) -> DataFrame:
    enough = F.col("n_sets") >= min_sets
    here = _fit_here(makers.few.where(enough), p, replicates, seed, prior, rounds, tol)
    many = None if makers.many is None else makers.many.where(enough)
    if many is None or many.isEmpty():
        return here
    held = makers.sets.join(F.broadcast(many), "who").withColumn("w", _weights(F.col("who"), F.col("set"), replicates, seed))
    return here.unionByName(_fit_large(held, p, max(1, replicates), prior, rounds, tol, dict(held.dtypes)["who"]))


def learned_prior(fits: DataFrame, n_features: int) -> Prior:
    """Mean and covariance of the decision makers' coefficients as a prior; one row of aggregates."""
    b = [F.get(F.col("beta"), F.lit(i)) for i in range(n_features)]
    cells = [F.covar_samp(x, y) for x in b for y in b]
    row = fits.agg(F.array(*[F.avg(x) for x in b]).alias("mean"), F.array(*[F.coalesce(c, F.lit(0.0)) for c in cells]).alias("cov")).first()
    if row["mean"][0] is None:
        return Prior.ridge(n_features)
    return Prior(np.array(row["mean"]), np.linalg.inv(np.reshape(row["cov"], (n_features, n_features)) + PRIOR_FLOOR * np.eye(n_features)))


def shrunk_fits(
    sets: DataFrame, n_features: int, training: DataFrame, *, min_sets: int = MIN_SETS, short: int = 1, replicates: int = 0, seed: int = 0, prior: Prior | None = None, large: int = LARGE, rounds: int = 60, tol: float = 1e-9
) -> tuple[DataFrame, Prior]:
    """Fits under the prior that the fits of `training` (a column who) give; with it, `short` sets are enough. Both read the same stored rows.

    The other options are those of fit_choices; `prior` is the first fit's.
    """
    makers = _makers(sets, large)
    known = training.select("who").distinct()
    marked = makers.few.join(known.withColumn("trains", F.lit(True)).hint("shuffle_hash"), "who", "left")  # rows stay where their sets met
    few = stored(marked, "choice-makers")
    if makers.many is None:
        drop(makers.sets)
    many = None if makers.many is None else makers.many.join(known, "who", "left_semi")
    first = _fits(_Makers(few.where("trains"), many, makers.sets), n_features, replicates, seed, prior or Prior.ridge(n_features), min_sets, rounds, tol)
    learned = learned_prior(first, n_features)
    return _fits(_Makers(few, makers.many, makers.sets), n_features, replicates, seed, learned, short, rounds, tol), learned


def spread_of_replicates(fits: DataFrame, n_features: int) -> DataFrame:
    """(who, replicates, mean, sd): centre and spread of each coefficient over replicates."""
    b = [F.get(F.col("beta"), F.lit(i)) for i in range(n_features)]
    return fits.groupBy("who").agg(F.count("*").alias("replicates"), F.array(*[F.avg(x) for x in b]).alias("mean"), F.array(*[F.stddev_samp(x) for x in b]).alias("sd"))
