"""Discrete choice: utilities, shares, and logit fits for each decision maker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RIDGE = 1e-4
MIN_SETS = 20


def within(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def softmax(df: DataFrame, keys: list[str], utility: Column, out: str = "p") -> DataFrame:
    """Choice probabilities in each choice set, shifted by the set's best utility."""
    w = Window.partitionBy(*keys)
    top = df.withColumn("__u", utility).withColumn("__e", F.exp(F.col("__u") - F.max("__u").over(w)))
    return top.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__u", "__e")


def logit_newton(x: np.ndarray, starts: np.ndarray, chosen: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> tuple[np.ndarray, float, bool]:
    """Damped Newton for a multinomial logit: rows of `x` are options, `starts` where each set begins."""
    beta = np.zeros(x.shape[1])
    sizes = np.diff(np.append(starts, len(x)))

    def value(b: np.ndarray) -> tuple[float, np.ndarray]:
        u = x @ b
        u -= np.repeat(np.maximum.reduceat(u, starts), sizes)
        e = np.exp(u)
        total = np.add.reduceat(e, starts)
        return float((u[chosen] - np.log(total)).sum() - 0.5 * ridge * b @ b), e / np.repeat(total, sizes)

    ll, p = value(beta)
    for _ in range(rounds):
        mean = np.add.reduceat(p[:, None] * x, starts)
        grad = x[chosen].sum(0) - mean.sum(0) - ridge * beta
        hess = (x.T * p) @ x - mean.T @ mean + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        scale = 1.0
        while scale > 1e-6:
            new_ll, new_p = value(beta + scale * step)
            if new_ll >= ll:
                break
            scale /= 2
        beta, gain, ll, p = beta + scale * step, new_ll - ll, new_ll, new_p
        if np.abs(scale * step).max() < 1e-9 or gain < 1e-12:
            return beta, ll, True
    return beta, ll, False


def fit_logits(options: DataFrame, who: str, choice_set: str, features: list[str], chosen: str, *, order: list[str], min_sets: int = MIN_SETS) -> DataFrame:
    """One logit for each `who` with at least `min_sets` choice sets; each group is one decision maker."""
    enough = options.groupBy(who).agg(F.countDistinct(choice_set).alias("__sets")).where(F.col("__sets") >= min_sets)
    counted = options.join(enough, who)
    kind = dict(options.dtypes)[who]
    row = F.struct(F.col(choice_set).alias("set"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]).alias("x"), F.coalesce(F.col(chosen), F.lit(False)).alias("c"))
    met = counted.groupBy(who).agg(F.array_sort(F.collect_list(row)).alias("r"))
    starts = F.transform("r.set", lambda s, i: (i == 0) | ~s.eqNullSafe(F.get(F.col("r.set"), i - 1)))
    packed = met.select(F.col(who).alias("who"), F.flatten("r.x").alias("x"), F.col("r.c").alias("c"), starts.alias("first"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                x, c, first = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("x", "c", "first"))
                begin = np.flatnonzero(first)
                beta, ll, ok = logit_newton(x.reshape(-1, len(features)), begin, np.flatnonzero(c))
                out.append((len(begin), ll, ok, *beta))
            if out:
                n_sets, lls, oks, *betas = zip(*out, strict=True)
                columns = [batch.column("who"), pa.array(n_sets, pa.int64()), pa.array(lls, pa.float64()), pa.array([bool(o) for o in oks]), *[pa.array(b, pa.float64()) for b in betas]]
                yield pa.RecordBatch.from_arrays(columns, [who, "n_sets", "log_likelihood", "converged", *[f"b_{f}" for f in features]])

    schema = f"{who} {kind}, n_sets long, log_likelihood double, converged boolean, " + ", ".join(f"b_{f} double" for f in features)
    return packed.mapInArrow(fit, schema)


def option_gaps(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Range of each feature in a choice set, and whether any varies."""
    ranges = [(F.max(f) - F.min(f)).alias(f"{f}_range") for f in features]
    out = df.groupBy(*keys).agg(*ranges, F.count("*").alias("n_options"))
    informative = F.lit(False)
    for f in features:
        informative = informative | (F.col(f"{f}_range") > 0)
    return out.withColumn("informative", informative)

