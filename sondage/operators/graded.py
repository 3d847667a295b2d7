"""Graded-response models of several traits: joint fits of people and items, posteriors after every answer, what to ask next.

P(answer >= k) = logistic(a . theta - t_k) with rising cuts t_1 < t_2 < ...; one cut for two categories. People are rows and
may be any number; item parameters are a small table that every task holds (MOST_ITEMS at most).
People's traits have a standard normal prior, loadings a weak ridge.

Null codes and codes outside an item's categories are not read; items that the bank lacks are left out. A person with no readable
answer has no row. A cell is one answer of one person to one item; of repeated cells each counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sondage.sources.stored import drop, stored

from . import linear
from .stats import safe_corr

MOST_ITEMS = 100_000
#: Fixed values of the start: shares of a category are held off 0 and 1, cuts apart, loadings small.
LEAST_SHARE, LEAST_GAP, START_SCALE = 0.02, 0.05, 0.3
#: Cuts stay within these: a category that nobody chose has none at a finite place.
FARTHEST_CUT = 20.0
_CHUNK = 1 << 21  # cells x traits that are solved at once


def sum_arrays(column: str, size: int) -> Column:
    """Sum of arrays of one size, place by place."""
    return F.array(*[F.sum(F.get(F.col(column), F.lit(i))) for i in range(size)])


def sum_long_arrays(parts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column): the same for arrays too long for an expression a place. For parts with few rows a key and task: they are
    shuffled as they are and added up while they stream, so a task holds one sum for each of its keys.
    """
    kinds = {f.name: f.dataType for f in parts.select(*keys).schema.fields}

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(column), len(batch.column(column)[0]))
            at = np.array([place.setdefault(k, len(place)) for k in zip(*(batch.column(c).to_pylist() for c in keys))], np.int64)
            total = np.zeros((0, x.shape[1])) if total is None else total
            total = np.concatenate([total, np.zeros((len(place) - len(total), x.shape[1]))])
            np.add.at(total, at, x)
        if place:
            columns = [pa.array(c, to_arrow_type(k)) for c, k in zip(zip(*place), kinds.values())]
            yield pa.RecordBatch.from_arrays([*columns, _lists(total)], [*keys, column])

    schema = ", ".join(f"`{c}` {k.simpleString()}" for c, k in kinds.items())
    return parts.select(*keys, column).repartition(*keys).mapInArrow(added, f"{schema}, `{column}` array<double>")


@dataclass(frozen=True)
class Bank:
    """Item parameters: `cuts` is padded with infinity behind an item's own ones."""

    ids: list
    loadings: np.ndarray
    cuts: np.ndarray

    @property
    def n_cuts(self) -> np.ndarray:
        return np.isfinite(self.cuts).sum(1)

    @property
    def width(self) -> int:
        return self.loadings.shape[1] + self.cuts.shape[1]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.loadings, self.cuts], 1)

    def with_flat(self, x: np.ndarray) -> Bank:
        d = self.loadings.shape[1]
        return replace(self, loadings=x[:, :d].copy(), cuts=x[:, d:].copy())

    def bounds(self, item: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cut below and the one above each answer; none on either side of the padding (item -1)."""
        edged = np.concatenate([np.full((len(self.ids), 1), -np.inf), self.cuts, np.full((len(self.ids), 1), np.inf)], 1)
        seen = item >= 0
        low, high = np.full(item.shape, -np.inf), np.full(item.shape, np.inf)
        low[seen], high[seen] = edged[item[seen], code[seen]], edged[item[seen], code[seen] + 1]
        return low, high

    def frame(self, spark: SparkSession, id_type: str) -> DataFrame:
        rows = [(i, a.tolist(), c[np.isfinite(c)].tolist()) for i, a, c in zip(self.ids, self.loadings, self.cuts, strict=True)]
        return spark.createDataFrame(rows, f"item_id {id_type}, loadings array<double>, cuts array<double>")


def bank_of(items: DataFrame, n_traits: int) -> Bank:
    """The bank of a table with item_id, loadings and cuts."""
    rows = items.select("item_id", "loadings", "cuts").orderBy("item_id").limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"a bank of more than {MOST_ITEMS} items")
    cuts = np.full((len(rows), max([len(r["cuts"]) for r in rows], default=1)), np.inf)
    for i, r in enumerate(rows):
        cuts[i, : len(r["cuts"])] = r["cuts"]
    return Bank([r["item_id"] for r in rows], np.array([r["loadings"] for r in rows], float).reshape(-1, n_traits), cuts)


def packed_people(cells: DataFrame, bank: Bank, *, order: str | None = None) -> DataFrame:
    """(pid, item, code): each person's answers as arrays, items by their place in the bank, in the order of `order` or of the bank.

    A person's answers, no more than the bank has items, meet in one row; the join sends the bank's ids.
    """
    id_type = dict(cells.dtypes)["item_id"]
    places = [(i, n, int(k)) for n, (i, k) in enumerate(zip(bank.ids, bank.n_cuts, strict=True))]
    index = cells.sparkSession.createDataFrame(places, f"item_id {id_type}, item int, n_cuts int")
    held = cells.join(F.broadcast(index), "item_id").where(F.col("code").between(0, F.col("n_cuts")))
    row = F.struct(*([F.col(order).alias("o")] if order else []), "item", F.col("code").cast("int").alias("code"))
    return held.groupBy("pid").agg(F.array_sort(F.collect_list(row)).alias("r")).select("pid", F.col("r.item").alias("item"), F.col("r.code").alias("code"))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _log_logistic(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the logistic function and the function itself, by one exponential."""
    e = np.exp(-np.abs(x))
    return np.minimum(x, 0) - np.log1p(e), np.where(x >= 0, 1, e) / (1 + e)


def _log_p(z: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Log probability of answers between two cuts. With a gap g it is log s(z - low) + log s(high - z) + log(1 - exp(-g))."""
    return -np.logaddexp(0, low - z) - np.logaddexp(0, z - high) + np.log1p(-np.exp(low - high))


def solve_people(
    loadings: np.ndarray, low: np.ndarray, high: np.ndarray, theta: np.ndarray, *, evidence: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 60, tol: float = 1e-10
) -> tuple[np.ndarray, np.ndarray]:
    """Modes and information matrices of many people at once: people x answers (x traits); padding has no cuts on either side.

    `evidence` is what is known beside the answers, in information form: precisions L and shifts h add h'theta - theta'L theta / 2.
    Newton's method with the observed information; each person halves a step that makes it worse by more than rounding does, and rests
    once their own step is under `tol`.
    """
    d = loadings.shape[2]
    theta = theta.copy()
    precision, shift = (np.eye(d)[None].repeat(len(theta), 0), np.zeros((len(theta), d))) if evidence is None else (np.eye(d) + evidence[0], evidence[1])
    apart = np.log1p(-np.exp(low - high)).sum(1)  # what does not depend on traits

    def at(t: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The objective of some people and their shares above the cut below and the one above each answer."""
        z = np.matmul(loadings[rows], t[:, :, None])[:, :, 0]
        log_up, up = _log_logistic(z - low[rows])
        log_rest, rest = _log_logistic(high[rows] - z)
        return (log_up + log_rest).sum(1) + apart[rows] + (shift[rows] * t).sum(1) - 0.5 * np.einsum("ni,nij,nj->n", t, precision[rows], t), up, 1 - rest

    def slopes(t: np.ndarray, rows: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = loadings[rows]
        bend = up * (1 - up) + down * (1 - down)
        gradient = np.matmul(a.transpose(0, 2, 1), (1 - up - down)[:, :, None])[:, :, 0] + shift[rows] - np.einsum("nij,nj->ni", precision[rows], t)
        return gradient, precision[rows] + np.matmul((a * bend[:, :, None]).transpose(0, 2, 1), a)

    left = np.arange(len(theta))
    now, up, down = at(theta, left)
    information = np.zeros((len(theta), d, d))
    for _ in range(rounds):
        gradient, information[left] = slopes(theta[left], left, up, down)
        step = np.linalg.solve(information[left], gradient[:, :, None])[:, :, 0]
        new, up, down = at(theta[left] + step, left)
        least = now[left] - 1e-12 * (1 + np.abs(now[left]))
        scale, worse = np.ones(len(left)), np.flatnonzero(new < least)
        while len(worse) and scale[worse].min() > 1e-6:
            scale[worse] /= 2
            new[worse], up[worse], down[worse] = at(theta[left[worse]] + scale[worse, None] * step[worse], left[worse])
            worse = worse[new[worse] < least[worse]]
        scale[worse], new[worse] = 0, now[left[worse]]
        step = scale[:, None] * step
        theta[left], now[left] = theta[left] + step, new
        on = np.abs(step).max(1) >= tol
        left, up, down = left[on], up[on], down[on]
        if not len(left):
            break
    everybody = np.arange(len(theta))
    return theta, slopes(theta, everybody, *at(theta, everybody)[1:])[1]


def _people(batch: pa.RecordBatch, n_traits: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The answers of some people as padded matrices: rows, items (-1 where there is none) and codes."""
    items, codes = batch.column("item"), batch.column("code")
    sizes = np.asarray(items.value_lengths().fill_null(0))
    step = max(1, _CHUNK // max(1, int(sizes.max(initial=1)) * n_traits))
    for a in range(0, batch.num_rows, step):
        n = sizes[a : a + step]
        seen = np.arange(n.max(initial=0)) < n[:, None]
        item, code = np.full(seen.shape, -1), np.zeros(seen.shape, np.int64)
        item[seen], code[seen] = items.slice(a, len(n)).flatten().to_numpy(), codes.slice(a, len(n)).flatten().to_numpy()
        yield slice(a, a + len(n)), item, code


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    x = np.ascontiguousarray(x, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _solved(people: DataFrame, bank: Bank, n_traits: int, *, covariance: bool) -> DataFrame:
    """`people` with theta solved anew from its last place, and the inverse information if asked for."""
    shared, id_type = people.sparkSession.sparkContext.broadcast(bank), dict(people.dtypes)["pid"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = shared.value
        for batch in batches:
            start = _matrix(batch.column("theta"), n_traits)
            for rows, item, code in _people(batch, n_traits):
                theta, information = solve_people(bank.loadings[item] * (item >= 0)[:, :, None], *bank.bounds(item, code), start[rows])
                part = batch.slice(rows.start, len(theta))
                more = [_lists(np.linalg.inv(information).reshape(len(theta), -1))] if covariance else []
                yield pa.RecordBatch.from_arrays([part.column("pid"), part.column("item"), part.column("code"), _lists(theta), *more], ["pid", "item", "code", "theta", *["covariance"] * len(more)])

    schema = f"pid {id_type}, item array<int>, code array<int>, theta array<double>"
    return people.mapInArrow(solve, schema + (", covariance array<double>" if covariance else ""))


def _at_origin(people: DataFrame, n_traits: int) -> DataFrame:
    return people.withColumn("theta", F.array(*[F.lit(0.0)] * n_traits))


def posteriors(cells: DataFrame, items: DataFrame, n_traits: int, *, evidence: DataFrame | None = None) -> DataFrame:
    """(pid, n_answers, theta, covariance): the mode of each person's posterior and its Laplace covariance (row by row).

    `evidence` has pid, precision (row by row) and shift, what is known of a person beside the answers; see solve_people. People
    with evidence only have a row as well.
    """
    bank = bank_of(items, n_traits)
    people = packed_people(cells, bank)
    if evidence is None:
        out = _solved(_at_origin(people, n_traits), bank, n_traits, covariance=True)
        return out.select("pid", F.size("item").alias("n_answers"), "theta", "covariance")
    none, d = F.array().cast("array<int>"), n_traits
    joined = people.join(evidence.select("pid", "precision", "shift"), "pid", "full")
    filled = joined.select(
        "pid", *[F.coalesce(c, none).alias(c) for c in ("item", "code")], F.coalesce("precision", F.array(*[F.lit(0.0)] * (d * d))).alias("precision"), F.coalesce("shift", F.array(*[F.lit(0.0)] * d)).alias("shift")
    )
    shared, id_type = cells.sparkSession.sparkContext.broadcast(bank), dict(filled.dtypes)["pid"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = shared.value
        for batch in batches:
            precision, shift = _matrix(batch.column("precision"), d * d).reshape(-1, d, d), _matrix(batch.column("shift"), d)
            for rows, item, code in _people(batch, d):
                known = precision[rows], shift[rows]
                theta, information = solve_people(bank.loadings[item] * (item >= 0)[:, :, None], *bank.bounds(item, code), np.zeros((len(item), d)), evidence=known)
                n = pa.array((item >= 0).sum(1), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("pid").slice(rows.start, len(item)), n, _lists(theta), _lists(np.linalg.inv(information).reshape(len(item), -1))], ["pid", "n_answers", "theta", "covariance"])

    return filled.mapInArrow(solve, f"pid {id_type}, n_answers int, theta array<double>, covariance array<double>")


def prefix_posteriors(cells: DataFrame, items: DataFrame, n_traits: int, *, order: str) -> DataFrame:
    """(pid, step, item_id, theta, blur, covariance): the posterior after each answer, in the order of the column `order`.

    Each step starts from the mode of the one before, for all people of a batch at once; `blur` has the square roots of the variances.
    """
    bank = bank_of(items, n_traits)
    people = packed_people(cells, bank, order=order)
    shared, id_type, item_type = cells.sparkSession.sparkContext.broadcast(bank), dict(cells.dtypes)["pid"], dict(items.dtypes)["item_id"]
    names = pa.array(bank.ids, to_arrow_type(items.schema["item_id"].dataType))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = shared.value
        for batch in batches:
            for rows, item, code in _people(batch, n_traits):
                pid = batch.column("pid").slice(rows.start, len(item))
                a, (low, high) = bank.loadings[item] * (item >= 0)[:, :, None], bank.bounds(item, code)
                theta = np.zeros((len(item), n_traits))
                for t in range(item.shape[1]):
                    left = np.flatnonzero(item[:, t] >= 0)
                    theta[left], information = solve_people(a[left, : t + 1], low[left, : t + 1], high[left, : t + 1], theta[left])
                    cov = np.linalg.inv(information)
                    blur = np.sqrt(np.diagonal(cov, axis1=1, axis2=2))
                    columns = [pid.take(pa.array(left)), pa.array(np.full(len(left), t + 1), pa.int32()), names.take(pa.array(item[left, t])), _lists(theta[left]), _lists(blur), _lists(cov.reshape(len(left), -1))]
                    yield pa.RecordBatch.from_arrays(columns, ["pid", "step", "item_id", "theta", "blur", "covariance"])

    return people.mapInArrow(solve, f"pid {id_type}, step int, item_id {item_type}, theta array<double>, blur array<double>, covariance array<double>")


def answer_probabilities(theta: np.ndarray, bank: Bank) -> tuple[np.ndarray, np.ndarray]:
    """P(category) and the information that this answer would bring along the loadings, people x items x categories."""
    z = theta @ bank.loadings.T
    ends = np.full((*z.shape, 1), np.inf)
    up = _logistic(np.concatenate([ends, z[:, :, None] - bank.cuts, -ends], 2))  # P(answer >= k); padded cuts give 0
    bend = up * (1 - up)
    return up[:, :, :-1] - up[:, :, 1:], bend[:, :, :-1] + bend[:, :, 1:]


def variance_reductions(theta: np.ndarray, covariance: np.ndarray, bank: Bank) -> np.ndarray:
    """Expected drop of the covariance's trace from asking each item, people x items.

    An answer of information c adds c a a' to the inverse covariance S^-1, which takes c |S a|^2 / (1 + c a' S a) from the trace.
    """
    p, c = answer_probabilities(theta, bank)
    sa = np.einsum("nij,kj->nki", covariance, bank.loadings)
    along, size = np.einsum("nki,ki->nk", sa, bank.loadings)[:, :, None], (sa * sa).sum(2)[:, :, None]
    return (p * c * size / (1 + c * along)).sum(2)


def next_items(people: DataFrame, items: DataFrame, n_traits: int, *, asked: str | None = None, k: int = 1) -> DataFrame:
    """(pid, place, item_id, reduction): the k items that reduce each person's variance most, in expectation.

    `people` has pid, theta and covariance, and in `asked`, if named, an array of item_ids that are not asked again. Equal
    reductions go by item_id. People x items stay inside tasks.
    """
    bank = bank_of(items, n_traits)
    shared, id_type, item_type = people.sparkSession.sparkContext.broadcast(bank), dict(people.dtypes)["pid"], dict(items.dtypes)["item_id"]
    names, place = pa.array(bank.ids, to_arrow_type(items.schema["item_id"].dataType)), {i: n for n, i in enumerate(bank.ids)}
    rows = people.select("pid", "theta", "covariance", (F.col(asked) if asked else F.lit(None).cast(f"array<{item_type}>")).alias("asked"))
    step = max(1, _CHUNK // max(1, len(bank.ids) * max(n_traits, bank.cuts.shape[1] + 1)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                cov = _matrix(batch.column("covariance"), n_traits**2).reshape(-1, n_traits, n_traits)
                gain = variance_reductions(_matrix(batch.column("theta"), n_traits), cov, bank)
                for i, done in enumerate(batch.column("asked").to_pylist()):
                    gain[i, [place[x] for x in done or [] if x in place]] = -np.inf
                order = np.argsort(-gain, axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(gain, order, 1)
                at, nth = np.nonzero(top > -np.inf)
                yield pa.RecordBatch.from_arrays([batch.column("pid").take(pa.array(at)), pa.array(nth + 1, pa.int32()), names.take(pa.array(order[at, nth])), pa.array(top[at, nth])], ["pid", "place", "item_id", "reduction"])

    return rows.mapInArrow(best, f"pid {id_type}, place int, item_id {item_type}, reduction double")


# fits


@dataclass(frozen=True)
class JointFit:
    """items: item_id, loadings, cuts. people: pid, n_answers, theta, covariance. losses: the objective after each round."""

    items: DataFrame
    people: DataFrame
    losses: list[float]
    converged: bool


def starting_bank(cells: DataFrame, categories: DataFrame, n_traits: int, seed: int = 0) -> Bank:
    """Small loadings drawn by hash, and cuts at the log odds of the shares at or above each category.

    `categories` has item_id and n_categories. Without answers an item's cuts start around zero.
    """
    kinds = categories.select("item_id", "n_categories").orderBy("item_id").limit(MOST_ITEMS + 1).collect()
    if len(kinds) > MOST_ITEMS:
        raise ValueError(f"a bank of more than {MOST_ITEMS} items")
    ids, n = [r["item_id"] for r in kinds], np.array([r["n_categories"] for r in kinds], int)
    counts, place = np.zeros((len(ids), n.max(initial=2))), {i: k for k, i in enumerate(ids)}
    for r in cells.where("code >= 0").groupBy("item_id", "code").agg(F.count("*").alias("n")).collect():  # items x categories
        if r["item_id"] in place and r["code"] < n[place[r["item_id"]]]:
            counts[place[r["item_id"]], r["code"]] += r["n"]
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    above = np.cumsum(counts[:, ::-1], 1)[:, ::-1][:, 1:] / total
    above = np.clip(np.where(counts.sum(1, keepdims=True) > 0, above, 0.5), LEAST_SHARE, 1 - LEAST_SHARE)
    cuts = -np.log(above / (1 - above))
    for k in range(1, cuts.shape[1]):
        cuts[:, k] = np.maximum(cuts[:, k], cuts[:, k - 1] + LEAST_GAP)
    cuts[np.arange(cuts.shape[1]) >= n[:, None] - 1] = np.inf
    draws = [np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "big")).normal(0, START_SCALE, n_traits) for i in ids]
    return Bank(ids, np.array(draws).reshape(-1, n_traits), cuts)


@dataclass(frozen=True)
class _Sums:
    loss: np.ndarray  # of each item, without the ridge
    prior: float
    gradient: np.ndarray
    hessian: np.ndarray


def _add_slopes(gradient: np.ndarray, hessian: np.ndarray, item: np.ndarray, code: np.ndarray, low: np.ndarray, high: np.ndarray, added: np.ndarray, d: int) -> None:
    """Takes the slopes of log p of groups of answers from those of their items.

    For x = z - low, y = z - high and q = 1 / (exp(high - low) - 1) the slopes of log p are 1 + q - s(x) and -q - s(y), the second ones
    -q(1 + q) - s'(x), -q(1 + q) - s'(y) and, mixed, q(1 + q). `added` has for each group the sums of s(x), s(y), s'(x), s'(y) and 1,
    times 1, the traits and their products. A side without a cut has no term.
    """
    with np.errstate(over="ignore"):
        q = (1 / np.expm1(high - low))[:, None]
    lo, hi = np.isfinite(low), np.isfinite(high)
    u, v, bend_u, bend_v, one = (added[:, k] for k in range(5))
    qq = q * (1 + q) * one
    fx, fy = np.where(lo[:, None], (1 + q) * one - u, 0), np.where(hi[:, None], -q * one - v, 0)
    sx, sy, mixed = np.where(lo[:, None], qq + bend_u, 0), np.where(hi[:, None], qq + bend_v, 0), np.where((lo & hi)[:, None], qq, 0)
    np.subtract.at(gradient, (item, slice(0, d)), (fx + fy)[:, 1 : d + 1])
    np.add.at(hessian, (item, slice(0, d), slice(0, d)), (sx + sy - 2 * mixed)[:, d + 1 :].reshape(-1, d, d))
    for on, f, s, cut in ((lo, fx, sx, d + code - 1), (hi, fy, sy, d + code)):
        i, c = item[on], cut[on]
        np.add.at(gradient, (i, c), f[on, 0])
        np.add.at(hessian, (i, c, c), s[on, 0])
        cross = (mixed - s)[on, 1 : d + 1]
        for k in range(d):
            np.add.at(hessian, (i, k, c), cross[:, k])
            np.add.at(hessian, (i, c, k), cross[:, k])
    both = lo & hi
    i, c = item[both], d + code[both]
    np.subtract.at(hessian, (i, c - 1, c), mixed[both, 0])
    np.subtract.at(hessian, (i, c, c - 1), mixed[both, 0])


def _item_sums(people: DataFrame, bank: Bank, n_traits: int) -> _Sums:
    """Minus log likelihood, gradient and Hessian of every item at given traits: one row an item and task is shuffled.

    Slopes are sums of traits, their squares and products, each with s(x) and the like, over the equal answers to an item; see _add_slopes.
    """
    shared, w, d = people.sparkSession.sparkContext.broadcast(bank), bank.width, n_traits

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = shared.value
        n = len(bank.ids)
        loss, gradient, hessian = np.zeros(n + 1), np.zeros((n + 1, w)), np.zeros((n + 1, w * w))
        for batch in batches:
            thetas = _matrix(batch.column("theta"), d)
            loss[n] += 0.5 * (thetas * thetas).sum()
            for rows, items, codes in _people(batch, 5 * (1 + d + d * d)):
                who, _ = np.nonzero(items >= 0)
                item, code, theta = items[items >= 0], codes[items >= 0], thetas[rows][who]
                if not len(item):
                    continue
                place = item * (bank.cuts.shape[1] + 1) + code
                order = np.argsort(place, kind="stable")
                item, code, theta, place = item[order], code[order], theta[order], place[order]
                low, high = bank.bounds(item, code)
                z = (theta * bank.loadings[item]).sum(1)
                u, v = _logistic(z - low), _logistic(z - high)
                starts = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0]))
                factors = np.stack([u, v, u * (1 - u), v * (1 - v), np.ones(len(z))], 1)
                moments = np.concatenate([np.ones((len(z), 1)), theta, (theta[:, :, None] * theta[:, None]).reshape(len(z), -1)], 1)
                added = np.add.reduceat((factors[:, :, None] * moments[:, None]).reshape(len(z), -1), starts).reshape(len(starts), 5, -1)
                np.subtract.at(loss, item[starts], np.add.reduceat(_log_p(z, low, high), starts))
                _add_slopes(gradient, hessian.reshape(n + 1, w, w), item[starts], code[starts], low[starts], high[starts], added, d)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1), pa.int32()), pa.array(loss), _lists(gradient), _lists(hessian)], ["item", "loss", "g", "h"])

    parts = people.select("item", "code", "theta").mapInArrow(sums, "item int, loss double, g array<double>, h array<double>")
    rows = parts.groupBy("item").agg(F.sum("loss").alias("loss"), sum_arrays("g", w).alias("g"), sum_arrays("h", w * w).alias("h")).collect()  # a row an item
    n = len(bank.ids)
    out = _Sums(np.zeros(n), 0.0, np.zeros((n, w)), np.zeros((n, w, w)))
    for r in rows:
        if r["item"] == n:
            out = replace(out, prior=r["loss"])
        else:
            out.loss[r["item"]], out.gradient[r["item"]], out.hessian[r["item"]] = r["loss"], r["g"], np.reshape(r["h"], (w, w))
    return out


def _penalised(sums: _Sums, bank: Bank, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of each item with the ridge on loadings; cuts that an item has not are held."""
    d = bank.loadings.shape[1]
    gradient, hessian = sums.gradient.copy(), sums.hessian.copy()
    gradient[:, :d] += ridge * bank.loadings
    hessian[:, range(d), range(d)] += ridge
    hessian[:, range(bank.width), range(bank.width)] += 1e-6  # cuts without answers on one side
    absent = np.concatenate([np.zeros_like(bank.loadings, bool), ~np.isfinite(bank.cuts)], 1)
    gradient[absent] = 0
    hessian[absent] = 0
    hessian.transpose(0, 2, 1)[absent] = 0
    i, k = np.nonzero(absent)
    hessian[i, k, k] = 1
    return sums.loss + 0.5 * ridge * (bank.loadings**2).sum(1), gradient, hessian


def _finite(flat: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(flat), flat, 0)


def _moved(bank: Bank, step: np.ndarray) -> Bank:
    """The bank after a step that each item halves until its cuts rise and stay near."""
    flat, d = bank.flat(), bank.loadings.shape[1]
    scale = np.ones(len(flat))
    for _ in range(40):
        new = flat + scale[:, None] * np.where(np.isfinite(flat), step, 0)
        cuts = new[:, d:]
        with np.errstate(invalid="ignore"):
            bad = ((np.diff(cuts, axis=1) <= 1e-4) & np.isfinite(cuts[:, 1:])).any(1)
        if not bad.any():
            break
        scale[bad] /= 2
    else:
        new[bad] = flat[bad]
    new[:, d:] = np.where(np.isfinite(new[:, d:]), np.clip(new[:, d:], -FARTHEST_CUT, FARTHEST_CUT), new[:, d:])
    return bank.with_flat(new)


def fit_joint(cells: DataFrame, categories: DataFrame, n_traits: int, *, ridge: float = 0.01, rounds: int = 200, tol: float = 1e-8, seed: int = 0, memory: int = 10) -> JointFit:
    """Traits of all people and parameters of all items at the mode of their joint posterior.

    Rounds alternate. With items fixed each person is solved where they lie, from the last round's traits, and stored; with
    people fixed the items' gradients and Hessians are summed over tasks. The step of the items is their own Newton step, corrected by
    the last `memory` rounds (a limited-memory quasi-Newton method on the objective that is left when people are solved); a
    step that makes it worse is halved. The driver holds item parameters only.
    """
    spark, item_type = cells.sparkSession, dict(categories.dtypes)["item_id"]
    bank = starting_bank(cells, categories, n_traits, seed)
    # as many files as cores have work for: what is read of a small table would else be a few tasks
    packed = packed_people(cells, bank).repartition(2 * spark.sparkContext.defaultParallelism, "pid")
    people = stored(_at_origin(packed, n_traits), "graded-people")
    losses: list[float] = []
    best: tuple | None = None  # (bank, gradient, inverse Hessians, loss, step)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    quiet, converged = 0, False
    for _ in range(rounds):
        new = stored(_solved(people, bank, n_traits, covariance=False), "graded-people")
        drop(people)
        people = new
        sums = _item_sums(people, bank, n_traits)
        loss_of, gradient, hessian = _penalised(sums, bank, ridge)
        loss = float(loss_of.sum() + sums.prior)
        if best is not None and not loss <= best[3] + 1e-9 * abs(best[3]):
            step = best[4] / 4
            pairs.clear()
            if np.abs(step).max() < 1e-9:
                converged = True
                break
            best = (*best[:4], step)
            bank = _moved(best[0], step)
            continue
        losses.append(loss)
        if best is not None:
            s, y = _finite(bank.flat()) - _finite(best[0].flat()), gradient - best[1]
            if (s * y).sum() > 1e-12:
                pairs = [*pairs, (s, y)][-memory:]
            quiet = quiet + 1 if best[3] - loss < tol * max(1.0, abs(loss)) else 0
        inverse = np.linalg.inv(hessian)
        if quiet >= 3 or not len(bank.ids):
            converged = True
            best = (bank, gradient, inverse, loss, None)
            break
        direction, used = gradient.copy(), []
        for s, y in reversed(pairs):
            a = (s * direction).sum() / (s * y).sum()
            direction -= a * y
            used.append((s, y, a))
        direction = np.einsum("kij,kj->ki", inverse, direction)
        for s, y, a in reversed(used):
            direction += s * (a - (y * direction).sum() / (s * y).sum())
        best = (bank, gradient, inverse, loss, -direction)
        bank = _moved(bank, -direction)
    if best is not None:
        bank = best[0]
    out = stored(_solved(people, bank, n_traits, covariance=True), "graded-fit")
    drop(people)
    return JointFit(bank.frame(spark, item_type), out.select("pid", F.size("item").alias("n_answers"), "theta", "covariance"), losses, converged)


def fit_best(cells: DataFrame, categories: DataFrame, n_traits: int, *, seeds: tuple[int, ...] = (0, 1, 2), **options) -> JointFit:
    """The best of several starts: the objective has more than one mode."""
    return min((fit_joint(cells, categories, n_traits, seed=s, **options) for s in seeds), key=lambda f: f.losses[-1] if f.losses else 0.0)


def fit_items(cells: DataFrame, categories: DataFrame, people: DataFrame, n_traits: int, *, ridge: float = 0.01, rounds: int = 50, tol: float = 1e-10, seed: int = 0) -> DataFrame:
    """(item_id, loadings, cuts) of items whose answerers' traits are known: `people` has pid and theta.

    All items take Newton steps at once, each halving its own step where that does not improve.
    """
    spark, item_type = cells.sparkSession, dict(categories.dtypes)["item_id"]
    bank = starting_bank(cells, categories, n_traits, seed)
    held = stored(packed_people(cells, bank).join(people.select("pid", "theta"), "pid"), "graded-items")
    best, best_loss, step = bank, np.full(len(bank.ids), np.inf), np.zeros((len(bank.ids), bank.width))
    for _ in range(rounds if len(bank.ids) else 0):
        loss, gradient, hessian = _penalised(_item_sums(held, bank, n_traits), bank, ridge)
        better = loss <= best_loss
        newton = -np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        step = np.where(better[:, None], newton, step / 4)
        flat = np.where(better[:, None], bank.flat(), best.flat())
        gain = np.where(better, best_loss - loss, np.inf)
        best, best_loss = best.with_flat(flat), np.where(better, loss, best_loss)
        if ((gain < tol * np.maximum(1, np.abs(best_loss))) | (np.abs(step).max(1) < 1e-8)).all():
            break
        bank = _moved(best, step)
    drop(held)
    return best.frame(spark, item_type)


def link_scale(people: DataFrame) -> Column:
    """The unit of the traits, as an aggregate over people: the root of the spread of their modes and of their mean variance together."""
    d = F.size("theta")
    square = F.aggregate("theta", F.lit(0.0), lambda t, x: t + x * x)
    trace = F.aggregate(F.sequence(F.lit(0), d - 1), F.lit(0.0), lambda t, i: t + F.get("covariance", i * (d + 1)))
    return F.sqrt(F.avg((square + trace) / d))


def linked(fit: JointFit) -> JointFit:
    """The fit with traits whose variance is one: traits shrink by the scale, loadings grow by it, and answers stay as likely."""
    scale = F.lit(fit.people.agg(link_scale(fit.people).alias("s")).first()["s"] or 1.0)
    by = lambda c, s: F.transform(c, lambda x: x * s)
    items = fit.items.withColumn("loadings", by("loadings", scale))
    people = fit.people.withColumn("theta", by("theta", 1 / scale)).withColumn("covariance", by("covariance", 1 / (scale * scale)))
    return replace(fit, items=items, people=people)


def restart_agreement(a: JointFit, b: JointFit, n_traits: int) -> dict[str, list[float]]:
    """How alike two fits are once the second is turned onto the first: correlations of traits and of loadings by trait, and canonical ones.

    Everything comes from cross products of the joined people and items; NaN where a side does not vary.
    """

    def columns(left: DataFrame, right: DataFrame, key: str, field: str) -> DataFrame:
        take = lambda df, name: df.select(key, *[F.get(F.col(field), F.lit(k)).alias(f"{name}{k}") for k in range(n_traits)])
        return take(left, "a").join(take(right, "b"), key)

    ours, theirs = [f"a{k}" for k in range(n_traits)], [f"b{k}" for k in range(n_traits)]
    people, items = columns(a.people, b.people, "pid", "theta"), columns(a.items, b.items, "item_id", "loadings")
    turn = linear.orthogonal_map(people, theirs, ours)

    def correlations(df: DataFrame) -> list[float]:
        turned = linear.rotated([F.col(c) for c in theirs], turn)
        row = df.agg(*[safe_corr(x, F.col(c)).alias(c) for x, c in zip(turned, ours, strict=True)]).first()
        return [float("nan") if v is None else v for v in row]

    return {"traits": correlations(people), "loadings": correlations(items), "canonical": linear.canonical_correlations(people, ours, theirs).tolist()}
