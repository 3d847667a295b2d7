"""Queues, sliding windows, as-of joins and other ordered computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def queue_exits(df: DataFrame, keys: list[str], arrival: str, tie: str, headway: Column | float) -> DataFrame:
    """Exit times of a first-in-first-out queue with one exit each `headway`.

    exit_k = max(arrival_k, exit_(k-1) + headway) is, in closed form, k * headway plus the running
    maximum of arrival - k * headway: one window, no loop.
    """
    w = Window.partitionBy(*keys).orderBy(arrival, tie)
    step = F.lit(headway) if isinstance(headway, float) else headway
    placed = df.withColumn("__k", F.row_number().over(w) - 1)
    slack = F.max(F.col(arrival) - F.col("__k") * step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("exit", F.col("__k") * step + slack).drop("__k")


def switching(df: DataFrame, person: str, day: str, value: str) -> DataFrame:
    """Share of days on which `value` differs from the day before's; null for one day."""
    w = Window.partitionBy(person).orderBy(day)
    marked = df.withColumn("__s", (F.col(value) != F.lag(value).over(w)).cast("int"))
    days = F.count("*") - 1
    return marked.groupBy(person).agg((F.coalesce(F.sum("__s"), F.lit(0)) / F.when(days > 0, days)).alias("switching"), F.coalesce(F.sum("__s"), F.lit(0)).alias("switches"))


def grid_peak_share(df: DataFrame, keys: list[str], time: str, width: int = 15) -> DataFrame:
    """Largest share in any window [s, s + width) with s on whole minutes, from floor(min) to ceil(max)."""
    bounds = df.groupBy(*keys).agg(F.floor(F.min(time)).alias("__lo"), F.ceil(F.max(time)).alias("__hi"), F.count("*").alias("__n"))
    first = F.floor(F.col(time)) - width + 1
    starts = df.select(*keys, time).join(bounds, keys) if keys else df.crossJoin(bounds)  # bounds of all rows are one row
    spread = starts.withColumn("start", F.explode(F.sequence(first, F.floor(F.col(time)))))
    inside = spread.where((F.col("start") >= F.col("__lo")) & (F.col("start") <= F.col("__hi")))
    counted = inside.groupBy(*keys, "start", "__n").agg(F.count("*").alias("c"))
    return counted.groupBy(*keys).agg(F.max(F.col("c") / F.col("__n")).alias("peak_share"))


def anchored_peak_share(df: DataFrame, keys: list[str], time: str, width: float = 15.0) -> DataFrame:
    """The other measure of that name: windows [a, a + width) that start at an arrival."""
    over = f"count(*) OVER (PARTITION BY {', '.join(keys)} ORDER BY cast({time} AS double) RANGE BETWEEN"
    upto = F.expr(f"{over} CURRENT ROW AND {width}D FOLLOWING)")
    edge = F.expr(f"{over} {width}D FOLLOWING AND {width}D FOLLOWING)")
    return df.select(*keys, (upto - edge).alias("c"), F.count("*").over(Window.partitionBy(*keys)).alias("n")).groupBy(*keys).agg(F.max(F.col("c") / F.col("n")).alias("peak_share"))


def stabbing_peak(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """How many intervals [start, end) hold each whole minute; the largest count and its first minute.

    Counts come from +1 and -1 events and a running sum, not from a join of minutes and intervals.
    """
    up = df.where(F.ceil(end) > F.ceil(start)).select(*keys, F.ceil(start).alias("minute"), F.lit(1).alias("d"))
    down = df.where(F.ceil(end) > F.ceil(start)).select(*keys, F.ceil(end).alias("minute"), F.lit(-1).alias("d"))
    events = up.unionByName(down).groupBy(*keys, "minute").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("minute")
    counted = events.withColumn("n", F.sum("d").over(w))
    best = F.max(F.struct("n", (-F.col("minute")).alias("m")))
    return counted.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.n").alias("peak"), (-F.col("b.m")).alias("peak_minute"))


def cumulative_distinct(df: DataFrame, order: str, what: str) -> DataFrame:
    """How many different `what` were seen up to each `order` value."""
    first = df.groupBy(what).agg(F.min(order).alias(order)).groupBy(order).agg(F.count("*").alias("new"))
    days = df.select(order).distinct().join(first, order, "left").fillna(0, ["new"])
    return days.select(order, F.sum("new").over(Window.orderBy(order)).alias("seen"))


def interpolated_as_of(queries: DataFrame, profile: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """`y` of the profile of the same key at each query's `x`: linear between neighbours, flat outside.

    Queries and profile are ordered together, and each query takes the last point at or before it and
    the first one after it; of points at one x, the last by y counts.
    """
    points = profile.groupBy(key, x).agg(F.max(y).alias("__y"))
    both = queries.withColumn("__y", F.lit(None).cast("double")).withColumn("__q", F.lit(1)).unionByName(points.withColumn("__q", F.lit(0)), allowMissingColumns=True)
    point = F.when(F.col("__q") == 0, F.struct(F.col(x).alias("x"), F.col("__y").alias("y")))
    w = Window.partitionBy(key).orderBy(x, "__q")
    back = Window.partitionBy(key).orderBy(F.col(x).desc(), F.col("__q").desc())
    near = both.withColumn("__lo", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("__hi", F.last(point, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    lo, hi = F.col("__lo"), F.col("__hi")
    slope = (hi["y"] - lo["y"]) / F.when(hi["x"] != lo["x"], hi["x"] - lo["x"])
    value = F.coalesce(lo["y"] + (F.col(x) - lo["x"]) * slope, lo["y"], hi["y"])
    return near.where("__q = 1").withColumn("interpolated", value).drop("__y", "__q", "__lo", "__hi")


def returns_to_go(df: DataFrame, keys: list[str], step: str, reward: str, discount: float) -> DataFrame:
    """G_t = r_t + discount * G_(t+1), as a discounted sum over the rows from t on."""
    later = Window.partitionBy(*keys).orderBy(F.col(step).desc()).rowsBetween(Window.unboundedPreceding, 0)
    power = F.pow(F.lit(discount), F.col(step).cast("double"))
    return df.withColumn("return_to_go", F.sum(F.col(reward) * power).over(later) / power)


def dense_delay_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("delay_rank", F.dense_rank().over(w.orderBy(F.col(value).desc()))).withColumn("ties", F.count("*").over(Window.partitionBy(*keys, value)))


def first_crossing(df: DataFrame, keys: list[str], step: str, ok: Column) -> DataFrame:
    """The first step at which `ok` holds in all of its rows; null if it never does."""
    each = df.groupBy(*keys, step).agg(F.bool_and(ok).alias("__ok"))
    return each.groupBy(*keys).agg(F.min(F.when(F.col("__ok"), F.col(step))).alias("crossing"))
