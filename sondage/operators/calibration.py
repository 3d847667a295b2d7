"""Scores of predicted distributions, over long rows (cell, category, p, truth)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .choice_fits import replicate_weights
from .graded import _lists, sum_long_arrays
from .stats import safe_corr, sorted_quantile

LOG_FLOOR = 1e-6


def brier_mean(p: Column, t: Column) -> Column:
    """Squared error over the item's own categories, averaged."""
    return F.avg(F.pow(p - t, 2))


def brier_sum(p: Column, t: Column) -> Column:
    """The other definition: summed, not divided by the number of categories."""
    return F.sum(F.pow(p - t, 2))


def log_loss(p: Column, t: Column) -> Column:
    return -F.sum(t * F.log(F.greatest(p, F.lit(LOG_FLOOR))))


def entropy(p: Column) -> Column:
    return -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))


def edges(n_bins: int) -> list[float]:
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def calibration_bins(pairs: DataFrame, keys: list[str], p: str, t: str, n_bins: int = 10, *, close_last: bool = True) -> DataFrame:
    """Each bin's count, mean p and mean truth; bins are left-closed by their edges, empty ones have nulls.

    With `close_last` the value 1.0 is in the last bin; without, it is in none.
    """
    lows = edges(n_bins)
    which = F.lit(None).cast("int")
    for i in range(n_bins - 1, -1, -1):
        high = F.lit(True) if close_last and i == n_bins - 1 else F.col(p) < (lows[i + 1] if close_last else lows[i] + 1.0 / n_bins)
        which = F.when((F.col(p) >= lows[i]) & high, i).otherwise(which)
    found = pairs.where(F.col(p).between(0, 1)).groupBy(*keys, which.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(t).alias("mean_t"))
    groups = pairs.select(*keys).distinct() if keys else pairs.sparkSession.range(1).select()
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return grid.join(found, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_t")))
    return bins.groupBy(*keys).agg((gap / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def graded(pairs: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Brier score and pooled correlation of each grouping set of `pairs` (cell, p, t and the grouping columns)."""
    names = sorted({c for s in sets for c in s})
    rows = pairs.groupingSets([[F.col(c) for c in s] for s in sets], *names)
    return rows.agg(F.countDistinct("cell").alias("cells"), brier_mean(F.col("p"), F.col("t")).alias("brier"), safe_corr(F.col("p"), F.col("t")).alias("corr"))


def variance_split(df: DataFrame, slot: str, value: str) -> DataFrame:
    """Total variance, and what of it lies between slots and within them; slots are summed first, so no row is shuffled."""
    slots = df.where(F.col(value).isNotNull()).groupBy(slot).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    n, weigh = F.sum("n"), lambda c: F.sum(F.col("n") * c)
    between = F.greatest(weigh(F.col("m") * F.col("m")) / n - F.pow(weigh(F.col("m")) / n, 2), F.lit(0.0))
    within = weigh(F.col("v")) / n
    return slots.agg((between + within).alias("total"), between.alias("between"), within.alias("within"))


def arm_grades(pairs: DataFrame, sets: list[list[str]], *, n_bins: int = 10) -> DataFrame:
    """One row for each group of each grouping set: cells, brier, brier_sd (over cells), log_loss, corr (pooled) and ece.

    `pairs` has cell, p, t and the grouping columns, one row for each category of a cell. Cells are scored first, so that a cell with more
    categories weighs no more; correlation and calibration pool the pairs. Rows with a null key are in no group of that set. Groups of different sets are told apart by `level`, the place of the set.
    """
    names = sorted({c for s in sets for c in s})
    out = None
    for level, keys in enumerate(sets):
        each = pairs.groupBy(*keys, "cell").agg(brier_mean(F.col("p"), F.col("t")).alias("b"), log_loss(F.col("p"), F.col("t")).alias("l"))
        cells = each.groupBy(*keys).agg(F.count("*").alias("cells"), F.avg("b").alias("brier"), F.stddev_pop("b").alias("brier_sd"), F.avg("l").alias("log_loss"))
        pooled = pairs.groupBy(*keys).agg(safe_corr(F.col("p"), F.col("t")).alias("corr"))
        ece = expected_calibration_error(calibration_bins(pairs, keys, "p", "t", n_bins), keys).drop("n")
        row = cells
        for other in (pooled, ece):
            row = row.join(other, keys) if keys else row.crossJoin(other)  # one row each without keys
        row = row.select(F.lit(level).alias("level"), *[F.col(c) if c in keys else F.lit(None).cast(dict(pairs.dtypes)[c]).alias(c) for c in names], "cells", "brier", "brier_sd", "log_loss", "corr", "ece")
        out = row if out is None else out.unionByName(row)
    return out


def resample_weights(people: DataFrame, person: str, rounds: int, draw: Column) -> DataFrame:
    """(round, person, w): how often each person is drawn in each round of a bootstrap; people that are not drawn have no row.

    `draw` is a uniform number of `__slot` (0 to n - 1) and `round`. Slots follow the hash of a person, and the row number within 256 buckets.
    """
    numbered = people.select(person).distinct().withColumn("__b", F.pmod(F.xxhash64(person), F.lit(256)))
    sizes = numbered.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__first", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n"))  # 256 rows
    w = Window.partitionBy("__b").orderBy(person)
    slots = numbered.join(before, "__b").select(person, (F.col("__first") + F.row_number().over(w) - 1).alias("__slot"))
    total = sizes.agg(F.sum("__n").alias("__total"))
    drawn = slots.select("__slot", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).crossJoin(total)
    hit = drawn.select("round", F.floor(draw * F.col("__total")).cast("long").alias("__slot")).groupBy("round", "__slot").agg(F.count("*").alias("w"))
    return hit.join(slots, "__slot").select("round", person, "w")


def population_marginals(pairs: DataFrame, weights: DataFrame, *, person: str = "pid") -> DataFrame:
    """(item_id, category, predicted, truth, truth_low, truth_high, predicted_low, predicted_high, inside) of the population.

    `pairs` has the person, item_id, category, p and t; `weights` comes from resample_weights. Both sides are resampled together; the interval is
    the middle 95 % of the rounds, and `inside` tells whether the predicted share lies in that of the truth.
    """
    point = pairs.groupBy("item_id", "category").agg(F.avg("p").alias("predicted"), F.avg("t").alias("truth"))
    w = F.col("w")
    rounds = pairs.join(weights, person).groupBy("round", "item_id", "category").agg((F.sum(w * F.col("p")) / F.sum(w)).alias("p"), (F.sum(w * F.col("t")) / F.sum(w)).alias("t"))
    ends = [F.percentile(c, F.lit(q)).alias(f"{name}_{end}") for c, name in (("t", "truth"), ("p", "predicted")) for q, end in ((0.025, "low"), (0.975, "high"))]
    out = point.join(rounds.groupBy("item_id", "category").agg(*ends), ["item_id", "category"])
    return out.withColumn("inside", F.col("predicted").between(F.col("truth_low"), F.col("truth_high")))


def resampled_marginals(pairs: DataFrame, rounds: int, *, seed: int = 0, person: str = "pid") -> DataFrame:
    """The columns of population_marginals, from Poisson weights of people by hash (choice_fits.replicate_weights).

    A person's weights are one array. Tasks sum weights times shares for all their people at once, so people times rounds are no
    rows; a row for each category, with its sums of all rounds, leaves a task. `pairs` has one row a person, item and category. Rounds without anybody of an item count for nothing.
    """
    cells = F.collect_list(F.struct("item_id", "category", F.col("p").cast("double").alias("p"), F.col("t").cast("double").alias("t")))
    known = pairs.where("p IS NOT NULL AND t IS NOT NULL")
    people = known.groupBy(person).agg(cells.alias("r"))  # items x categories at most
    w = replicate_weights(F.col(person), rounds, seed)
    packed = people.select(F.concat(F.array(F.lit(1.0)), w).alias("w"), F.transform("r", lambda x: F.struct(x["item_id"].alias("item_id"), x["category"].alias("category"))).alias("cells"), F.col("r.p").alias("p"), F.col("r.t").alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.select("item_id", "category").schema.fields}
    arrow = [to_arrow_type(pairs.schema[c].dataType) for c in kinds]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[tuple, int] = {}
        total = np.zeros((3, 0, rounds + 1))
        for batch in batches:
            weights = batch.column("w").flatten().to_numpy().reshape(-1, rounds + 1)
            lists = batch.column("cells")
            who = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            at = np.array([place.setdefault(x, len(place)) for x in zip(*(flat.field(c).to_pylist() for c in kinds))], np.int64)
            if len(place) > total.shape[1]:
                total = np.concatenate([total, np.zeros((3, len(place) - total.shape[1], rounds + 1))], 1)
            for i, c in enumerate(("p", "t", None)):
                share = np.zeros((batch.num_rows, len(place)))
                np.add.at(share, (who, at), 1.0 if c is None else batch.column(c).flatten().to_numpy())
                total[i] += share.T @ weights
        if place:
            columns = [pa.array(c, k) for c, k in zip(zip(*place), arrow)]
            yield pa.RecordBatch.from_arrays([*columns, _lists(np.concatenate(total, 1))], [*kinds, "s"])

    parts = packed.mapInArrow(summed, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", s array<double>")
    n = rounds + 1
    sums = sum_long_arrays(parts, ["item_id", "category"], "s")
    share = lambda start: F.transform(F.sequence(F.lit(0), F.lit(rounds)), lambda i: F.try_divide(F.get("s", i + start * n), F.get("s", i + 2 * n)))
    rows = sums.select("item_id", "category", share(0).alias("p"), share(1).alias("t"))
    ordered = {c: F.array_sort(F.array_compact(F.slice(c, 2, rounds))) for c in ("p", "t")}
    ends = [sorted_quantile(ordered[c], q).alias(f"{name}_{end}") for c, name in (("t", "truth"), ("p", "predicted")) for q, end in ((0.025, "low"), (0.975, "high"))]
    out = rows.select("item_id", "category", F.get("p", F.lit(0)).alias("predicted"), F.get("t", F.lit(0)).alias("truth"), *ends)
    return out.withColumn("inside", F.col("predicted").between(F.col("truth_low"), F.col("truth_high")))


def marginal_fit(marginals: DataFrame) -> DataFrame:
    """One row: cells, corr and rmse of predicted and true shares, mean total variation of items, and the share of cells inside."""
    gap = F.col("predicted") - F.col("truth")
    return marginals.agg(
        F.count("*").alias("cells"),
        safe_corr(F.col("predicted"), F.col("truth")).alias("corr"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (F.sum(F.abs(gap)) / 2 / F.countDistinct("item_id")).alias("mean_variation"),
        F.avg(F.col("inside").cast("double")).alias("inside"),
    )


def cross_tables(pairs: DataFrame, *, person: str = "pid") -> DataFrame:
    """(item_a, item_b, category_a, category_b, predicted, truth) for item_a < item_b: the mean over people of the products of their two distributions.

    A person's items, bounded by the bank, are paired in place in one array, so the shuffle after the map-side sum holds table cells only.
    """
    row = F.array_sort(F.collect_list(F.struct("item_id", "category", "p", "t")))
    held = pairs.groupBy(person).agg(row.alias("r"))
    a = held.select("r", F.explode("r").alias("a"))
    both = a.select("a", F.explode(F.filter("r", lambda x: x["item_id"] > F.col("a.item_id"))).alias("b"))
    return both.groupBy(F.col("a.item_id").alias("item_a"), F.col("b.item_id").alias("item_b"), F.col("a.category").alias("category_a"), F.col("b.category").alias("category_b")).agg(
        F.avg(F.col("a.p") * F.col("b.p")).alias("predicted"), F.avg(F.col("a.t") * F.col("b.t")).alias("truth")
    )


def cross_table_gaps(tables: DataFrame) -> DataFrame:
    """(item_a, item_b, total_variation): half the sum of the absolute differences of each table."""
    return tables.groupBy("item_a", "item_b").agg((F.sum(F.abs(F.col("predicted") - F.col("truth"))) / 2).alias("total_variation"))
