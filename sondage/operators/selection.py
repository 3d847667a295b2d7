"""Stratified samples of items for each person: fixed numbers of some strata, largest-remainder quotas of others, the gaps filled from what is left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import noise
from sondage.sources import versions

MOST_POOL = 10_000


def proportional_quotas(sizes: Mapping[str, int], total: int) -> dict[str, int]:
    """`total` split in proportion to sizes: whole parts first, what is left to the largest remainders (of equal ones the first), never more than a class has."""
    have = {k: max(0, n) for k, n in sizes.items()}
    pool = sum(have.values())
    total = min(max(0, total), pool)
    quotas = {k: total * n // pool if pool else 0 for k, n in have.items()}
    by_remainder = sorted(have, key=lambda k: -(total * have[k] % pool)) if pool else []
    while sum(quotas.values()) < total:
        for k in by_remainder:
            if quotas[k] < have[k] and sum(quotas.values()) < total:
                quotas[k] += 1
    return quotas


def _by_hash(items: Column, n: int, pid: Column, seed: int) -> Column:
    """n of an array of items, those of the least hashes."""
    keyed = F.transform(items, lambda i: F.struct(noise.hash_uniform(F.lit(seed), pid, i).alias("u"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda e: e["i"])


def quota_sample(people: DataFrame, pool: Sequence[str], fixed: Mapping[str, Sequence[str]], each: int, classes: Mapping[str, Sequence[str]], n_items: int, *, seed: int = 0) -> DataFrame:
    """(pid, item_id, place): n_items items of `pool` for each person, in the order of the pool.

    `each` items come from every stratum of `fixed`, the remainder from `classes` by quotas, and, where strata are too thin, from whatever is left.
    Choices go by hashes of seed, person and item, so each person's sample is the same whoever else is drawn. The pool, MOST_POOL
    at most, is a constant of the plan: people stay where they are, and only the sample leaves a row.
    """
    if len(pool) > MOST_POOL:
        raise ValueError(f"a pool of more than {MOST_POOL} items")
    inside = set(pool)
    strata = [[i for i in items if i in inside] for items in fixed.values()]
    others = {k: [i for i in items if i in inside] for k, items in classes.items()}
    quotas = proportional_quotas({k: len(v) for k, v in others.items()}, n_items - sum(min(each, len(s)) for s in strata))
    takes = [(s, each) for s in strata if s] + [(others[k], n) for k, n in quotas.items() if n]
    pid = F.col("pid")
    chosen = F.concat(*[_by_hash(F.lit(list(s)), n, pid, seed) for s, n in takes]) if takes else F.array().cast("array<string>")
    whole = F.lit(list(pool)) if pool else F.array().cast("array<string>")
    first = people.select("pid", F.slice(chosen, 1, n_items).alias("chosen"))
    gap = n_items - F.size("chosen")
    rest = F.array_except(whole, F.col("chosen"))
    filled = first.withColumn("chosen", F.when(gap > 0, F.concat("chosen", F.slice(_by_hash(rest, n_items, pid, seed), F.lit(1), F.greatest(gap, F.lit(0))))).otherwise(F.col("chosen")))
    ordered = filled.select("pid", F.array_intersect(whole, "chosen").alias("items"))
    return ordered.select("pid", F.posexplode("items").alias("place", "item_id")).select("pid", "item_id", "place")


def stored_selection(spark: SparkSession, path: str, people: DataFrame, *args, **options) -> DataFrame:
    """The stored samples, with those of people who have none yet drawn by quota_sample and added.

    What is stored counts, even if pool, quotas or seed have changed since; people added later change no row of others.
    """
    schema = f"pid {dict(people.dtypes)['pid']}, item_id string, place int"
    old = versions.read_version(spark, path, "selection", schema)
    new = people.select("pid").where("pid IS NOT NULL").distinct().join(old.select("pid").distinct(), "pid", "left_anti")
    if not new.isEmpty():
        versions.commit(spark, path, {"selection": old.unionByName(quota_sample(new, *args, **options))})
    return versions.read_version(spark, path, "selection", schema)
