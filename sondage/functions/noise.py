"""Reproducible hash noise and recorded answer distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the noise layers.
EVENT_CAP = 0.95
FLOOR_MARGIN = 2.0


def hash_uniform(*parts: Column, sep: str = ":") -> Column:
    """[0, 1) from the first 64 bits of SHA-256 of the joined parts."""
    digest = F.sha2(F.concat_ws(sep, *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def flip_probability(wobble: Column, gap: Column, a: float, b: float) -> Column:
    return F.least(F.lit(0.5), wobble * a * F.exp(-b * gap))


def event_probability(wobble: Column, p_max: Column, a: float, b: float) -> Column:
    return F.least(F.greatest(wobble * (a + b * (1 - p_max)), F.lit(0.0)), F.lit(EVENT_CAP))


def noised_answer(answer: Column, second: Column, first_other: Column, u: Column, p: Column) -> Column:
    """The runner-up where the draw falls below `p`; the first other valid answer if that is missing or the same."""
    target = F.coalesce(F.when(second != answer, second), first_other)
    return F.when((u < p) & target.isNotNull(), target).otherwise(answer)


def conviction(distribution: Column) -> Column:
    return F.array_max(F.map_values(distribution))


def flattened(distribution: Column, temperature: float) -> Column:
    """p ** (1 / T), summing to 1 again."""
    raised = F.transform_values(distribution, lambda _, p: F.pow(p, F.lit(1 / temperature)))
    total = F.aggregate(F.map_values(raised), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(raised, lambda _, p: p / total)


def answer_distribution(log_values: Column, valid: list[str]) -> Column:
    """Token log-values to P(answer): summed for each answer; an absent one is floored below all tokens. Null if empty.

    Values count from the greatest one, so that very low ones do not all become 0.
    """
    top = F.array_max(F.map_values(log_values))
    entries = F.transform(F.map_entries(log_values), lambda e: F.struct(e["key"].alias("key"), (e["value"] - top).alias("value")))
    floor = F.array_min(F.map_values(log_values)) - top - FLOOR_MARGIN

    def weight(answer: str) -> Column:
        mine = F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == answer)
        summed = F.aggregate(mine, F.lit(0.0), lambda a, e: a + F.exp(e["value"]))
        return F.when(F.size(mine) > 0, summed).otherwise(F.exp(floor))

    weights = F.array(*[weight(v) for v in valid])
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    shares = F.map_from_arrays(F.array(*map(F.lit, valid)), F.transform(weights, lambda w: w / total))
    return F.when(F.size(entries) > 0, shares)


def conviction_gap(dist_top: Column, valid: list[str]) -> Column:
    """struct(gap, second): of the first two valid answers in recorded order, as a share of all valid ones."""
    kept = F.filter(dist_top, lambda e: e["tok"].isin(valid))
    total = F.aggregate(kept, F.lit(0.0), lambda a, e: a + e["p"])
    first, second = F.get(kept, F.lit(0)), F.get(kept, F.lit(1))
    enough = (F.size(kept) >= 2) & (total > 0)
    return F.struct(F.when(enough, (first["p"] - second["p"]) / total).otherwise(1.0).alias("gap"), F.when(enough, second["tok"]).alias("second"))


def drawn(distribution: Column, u: Column) -> Column:
    """The answer that a uniform number picks: the first key, in order, whose running share passes `u`; the last key where none does."""
    entries = F.array_sort(F.map_entries(distribution))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("key"))

    def pick(point: Column) -> Column:
        def step(state: Column, e: Column) -> Column:
            total = state["sum"] + e["value"]
            return F.struct(total.alias("sum"), F.coalesce(state["key"], F.when(point < total, e["key"].cast("string"))).alias("key"))

        return F.coalesce(F.aggregate(entries, start, step)["key"], F.element_at(entries, -1)["key"].cast("string"))

    return F.get(F.transform(F.array(u), pick), F.lit(0))  # so that `u`, often a hash, is taken once and not for each key
