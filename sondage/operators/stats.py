"""Statistics as single aggregations or windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null for fewer than two rows or a constant side, where corr() would fail."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    guarded = F.when((F.stddev_pop(x) > TINY) & (F.stddev_pop(y) > TINY), spread)
    return F.covar_pop(x, y) / guarded


def ratio(top: Column, bottom: Column) -> Column:
    """Null instead of an error where `bottom` is zero."""
    return top / F.when(bottom != 0, bottom)


def average_rank(order: Column, keys: list[str]) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*keys, order)) - 1) / 2


def spearman(df: DataFrame, keys: list[str], x: str, y: str, *, average: bool = True, tie: str | None = None) -> DataFrame:
    """Rank correlation in each group, with average ranks or, ordering ties by `tie`, ordinal ones."""
    if average:
        ranked = df.select(*keys, average_rank(F.col(x), keys).alias("__x"), average_rank(F.col(y), keys).alias("__y"))
    else:
        w = Window.partitionBy(*keys)
        ranked = df.select(*keys, F.row_number().over(w.orderBy(x, tie)).alias("__x"), F.row_number().over(w.orderBy(y, tie)).alias("__y"))
    return ranked.groupBy(*keys).agg(safe_corr(F.col("__x").cast("double"), F.col("__y").cast("double")).alias("rho"))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; the last is closed on the right, values outside are dropped, empty bins are there."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high))
    bin_of = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*keys, bin_of.alias("bin")).agg(F.count("*").alias("n"))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def describe(value: str) -> list[Column]:
    """n, min, p25, median, mean, p75, max of the finite values; quantiles are exact and linear."""
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    q = lambda p: F.percentile(v, F.lit(p))
    return [F.count(v).alias("n"), F.min(v).alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"), F.avg(v).alias("mean"), q(0.75).alias("p75"), F.max(v).alias("max")]


def standardized(df: DataFrame, item: str, value: str, *, sample: bool = True) -> DataFrame:
    """z-scores for each item in a column `z`; items that do not vary are dropped. An item's mean and spread are summed on the map side and joined back."""
    scale = df.groupBy(item).agg(F.avg(value).alias("__mean"), (F.stddev_samp if sample else F.stddev_pop)(value).alias("__sd")).where(F.col("__sd") > TINY)
    return df.join(scale, item).withColumn("z", (F.col(value) - F.col("__mean")) / F.col("__sd")).select(*df.columns, "z")


def item_covariance(df: DataFrame, person: str, item: str, z: str, n_people: Column) -> DataFrame:
    """(item_a, item_b, c) for item_a <= item_b of centred values; missing cells count as 0."""
    left = df.select(person, F.col(item).alias("item_a"), F.col(z).alias("__a"))
    right = df.select(person, F.col(item).alias("item_b"), F.col(z).alias("__b"))
    pairs = left.join(right, person).where("item_a <= item_b")
    return pairs.groupBy("item_a", "item_b").agg((F.sum(F.col("__a") * F.col("__b")) / (n_people - 1)).alias("c"))


def participation_ratio(cov: DataFrame) -> DataFrame:
    """Effective number of dimensions: trace squared over the sum of squares, no eigenvalues needed."""
    twice = F.when(F.col("item_a") == F.col("item_b"), 1).otherwise(2)
    trace = F.sum(F.when(F.col("item_a") == F.col("item_b"), F.col("c")))
    return cov.agg(F.count(F.when(F.col("item_a") == F.col("item_b"), 1)).alias("n_items"), ratio(trace * trace, F.sum(twice * F.col("c") * F.col("c"))).alias("effective"))


def auc(df: DataFrame, score: str, label: str, *, buckets: int = 256) -> DataFrame:
    """P(score of label 1 > score of label 0), ties half: (n1, n0, auc); auc is null where a side is empty.

    Rows are counted by distinct score, and the zeros below each score come from totals of `buckets` ranges and a running sum inside a range, so
    no task orders the whole table. Rows without a label or score are not read.
    """
    held = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = held.groupBy(F.col(score).alias("__s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("__n1"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("__n0"))
    bounds = counts.agg(F.percentile_approx("__s", F.lit([i / buckets for i in range(1, buckets)]), F.lit(10_000)).alias("__at"))  # one row
    ranged = counts.crossJoin(bounds).withColumn("__b", F.size(F.filter("__at", lambda x: x < F.col("__s")))).drop("__at")
    totals = ranged.groupBy("__b").agg(F.sum("__n0").alias("__t")).withColumn("__low", F.sum("__t").over(Window.orderBy("__b")) - F.col("__t")).drop("__t")  # `buckets` rows at most
    w = Window.partitionBy("__b").orderBy("__s")
    below = ranged.join(totals, "__b").withColumn("__below", F.col("__low") + F.sum("__n0").over(w) - F.col("__n0"))
    n1, n0 = F.coalesce(F.sum("__n1"), F.lit(0)), F.coalesce(F.sum("__n0"), F.lit(0))
    return below.agg(n1.alias("n1"), n0.alias("n0"), ratio(F.sum(F.col("__n1") * (F.col("__below") + F.col("__n0") / 2)), (n1 * n0).cast("double")).alias("auc"))


def cosine(x: Column, y: Column) -> Column:
    """Of aggregated columns; null for a vector of no length."""
    length = F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))
    return F.sum(x * y) / F.when(length > TINY, length)


def spearman_brown(r: Column) -> Column:
    return ratio(2 * r, 1 + r)


def censored_median(value: Column, budget: int) -> Column:
    """Median where a value never reached counts as budget + 1; null if the median was never reached."""
    median = F.percentile(F.coalesce(value, F.lit(budget + 1)), F.lit(0.5))
    return F.when(median <= budget, median)


def arc_elasticity(q0: Column, q1: Column, relative_price_change: float) -> Column:
    return ratio(ratio(q1 - q0, (q0 + q1) / 2), F.lit(relative_price_change))


def deciles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys with p0, p10, ... p100 of the values that are there, exact and linear, rounded to six places."""
    out = quantiles(df, keys, value, [p / 100 for p in range(0, 101, 10)])
    return out.select(*keys, *[F.round(F.get("quantiles", F.lit(i)), 6).alias(f"p{10 * i}") for i in range(11)])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], *, buckets: int = 1024) -> DataFrame:
    """The keys with `quantiles`, an array of doubles, one for each of `shares`: exact and linear; null for keys without values.

    Rows are counted by distinct value. Totals of `buckets` ranges of values say in which of them the wanted ranks lie; only the rows of these are ordered,
    each range for itself, so no task or aggregate holds the values of a key. Null keys are a key; NaN is the largest value.
    """
    held = df.select(F.struct(*keys).alias("__k"), F.col(value).cast("double").alias("__v"))
    counts = held.where("__v IS NOT NULL").groupBy("__k", "__v").agg(F.count("*").alias("__n"))
    at = counts.agg(F.percentile_approx("__v", F.lit([i / buckets for i in range(1, buckets)]), F.lit(10 * buckets)).alias("__at")).first()["__at"]  # one row
    ranged = counts.withColumn("__b", _range_of(F.col("__v"), at or []))
    totals = ranged.groupBy("__k", "__b").agg(F.sum("__n").alias("__t"))  # `buckets` rows a key at most
    w = Window.partitionBy("__k")
    spans = totals.select("__k", "__b", (F.sum("__t").over(w.orderBy("__b")) - F.col("__t")).alias("__low"), F.col("__t"), F.sum("__t").over(w).alias("__all"))
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("__all") - 1)).alias("at")) for i, q in enumerate(shares)])).alias("__p")
    ends = spans.select("*", place).select("*", F.explode(F.array_distinct(F.array(F.floor("__p.at"), F.ceil("__p.at")))).alias("__r"))
    wanted = ends.where((F.col("__r") >= F.col("__low")) & (F.col("__r") < F.col("__low") + F.col("__t")))
    places = wanted.groupBy("__k", "__b", "__low").agg(F.collect_list(F.struct("__p", "__r")).alias("__wanted"))  # two for each share at most
    within = ranged.join(places, ["__k", "__b"])
    upto = F.col("__low") + F.sum("__n").over(Window.partitionBy("__k", "__b").orderBy("__v"))
    found = within.withColumn("__upto", upto).select("__k", "__v", F.explode(F.filter("__wanted", lambda x: (x["__r"] < F.col("__upto")) & (x["__r"] >= F.col("__upto") - F.col("__n")))).alias("w"))
    part = F.col("w.__p.at") - F.floor("w.__p.at")
    each = found.groupBy("__k", F.col("w.__p.i").alias("i")).agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.first(part).alias("part"))
    linear = F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    rows = each.groupBy("__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", linear.alias("q")))), lambda x: x["q"]).alias("quantiles"))
    return held.select("__k").distinct().join(rows, "__k", "left").select("__k.*", "quantiles")


def _range_of(value: Column, bounds: list[float]) -> Column:
    """How many of the rising bounds lie below the value: first by the last ones of groups of bounds, then inside one group."""
    step = max(math.isqrt(len(bounds)), 1)
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)] + [[]]
    below = lambda found: F.size(F.filter(found, lambda x: x < value))
    group = below(F.lit([g[-1] for g in groups[:-1]]).cast("array<double>"))
    return group * step + below(F.get(F.array(*[F.lit(g).cast("array<double>") for g in groups]), group))


def equivalent_n(curve: DataFrame, targets: DataFrame, keys: list[str], *, cap: float = 3.0) -> DataFrame:
    """(keys, target, equivalent_n, extrapolated): at which n a falling curve reaches each target, linear between its points.

    `curve` has the keys, n and value, a few points for each key; `targets` the keys and target. A target at or above the first point has the first n. One below
    the whole curve is carried on by what the last step falls for each further n, whatever the step's width, and is null if that step is flat or it lies beyond `cap` times the last n.
    """
    points = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), F.col("value").cast("double").alias("v")))).alias("c"))
    at = targets.join(points, keys)
    t, c = F.col("target"), F.col("c")
    steps = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inside = F.get(F.filter(steps, lambda s: (s["b"]["v"] <= t) & (t <= s["a"]["v"])), F.lit(0))
    fall = inside["a"]["v"] - inside["b"]["v"]
    within = F.when(F.abs(fall) < 1e-15, inside["b"]["n"]).otherwise(inside["a"]["n"] + (inside["a"]["v"] - t) / F.when(fall != 0, fall) * (inside["b"]["n"] - inside["a"]["n"]))
    last, before = F.element_at(c, -1), F.get(c, F.size(c) - 2)
    step = before["v"] - last["v"]
    beyond = last["n"] + (last["v"] - t) / F.when(step > 1e-15, step)
    first = F.get(c, F.lit(0))
    found = F.when(t >= first["v"], first["n"]).when(inside.isNotNull(), within).otherwise(F.when(beyond <= cap * last["n"], beyond))
    return at.select(*keys, "target", found.alias("equivalent_n"), ((t < first["v"]) & inside.isNull()).alias("extrapolated"))


def sorted_quantile(values: Column, q: float) -> Column:
    """The quantile of a sorted array, between its neighbours in proportion; null of an empty one."""
    place = (F.size(values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (place - low)
