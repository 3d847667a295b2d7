"""Constraint suites, reconciliation, splits and contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BUCKET = 1 << 18


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of every broken row rule, in one pass."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule")).select("rule", "key")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reconciled(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that only one side has, and fields that differ, by a full outer join."""
    a = left.select(key, F.struct(*fields).alias("__a"))
    b = right.select(key, F.struct(*fields).alias("__b"))
    both = a.join(b, key, "full_outer")
    differs = [F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), F.lit(f"differs:{c}")) for c in fields]
    what = F.when(F.col("__a").isNull(), F.array(F.lit("only right"))).when(F.col("__b").isNull(), F.array(F.lit("only left"))).otherwise(F.array_compact(F.array(*differs)))
    return both.select(key, F.explode(what).alias("problem"))


def contingency(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Two-way counts, zero-filled."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def hash_order(seed: int, *parts: Column) -> Column:
    """A reproducible shuffle key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def stratified_holdout(df: DataFrame, stratum: str, key: str, share: float, seed: int) -> DataFrame:
    """`held` marks round-half-even(share * n) rows of each stratum, by hash order."""
    w = Window.partitionBy(stratum)
    place = F.row_number().over(w.orderBy(hash_order(seed, F.col(key)), F.col(key)))
    return df.withColumn("held", place <= F.bround(F.count("*").over(w) * share))


def hash_ranked(df: DataFrame, key: str, seed: int, place: str, rows: str) -> DataFrame:
    """`df` with its place in hash order, from 0, and the number of rows. Ranks come from counts of hash buckets, which follow the number of rows, so no task orders many of them."""
    n, digits = df.count(), 2
    while 16**digits * ROWS_A_BUCKET < n and digits < 5:
        digits += 1
    h = df.withColumn("__h", hash_order(seed, F.col(key))).withColumn("__b", F.substring("__h", 1, digits))
    sizes = h.groupBy("__b").agg(F.count("*").alias("__n"))  # a row a bucket
    start = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1
    return h.withColumn("__i", inside).join(F.broadcast(start), "__b").withColumn(place, F.col("__start") + F.col("__i")).withColumn(rows, F.lit(n)).drop("__h", "__b", "__start", "__i")


def folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Balanced folds by hash order."""
    return hash_ranked(df, key, seed, "__place", "__rows").withColumn("fold", (F.col("__place") % k).cast("int")).drop("__place", "__rows")


def chunks(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Rows of each group in chunks of `size`."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def top_values(df: DataFrame, fields: list[str], limit: int) -> DataFrame:
    """The most common values of each field, ties in order of value."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("c")).select("c.*")
    counts = cells.groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field")
    ranked = counts.withColumn("place", F.row_number().over(w.orderBy(F.col("n").desc(), "value"))).withColumn("n_distinct", F.count("*").over(w))
    return ranked.where(F.col("place") <= limit)
