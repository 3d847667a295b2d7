"""A fresh round of answers from recorded distributions: noise events by hash, and what happened by reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sondage.functions import noise

#: Why a cell keeps its answer, first reason first.
REASONS = ("unknown_item", "no_logprobs", "no_wobble", "no_distribution")


def redrawn(cells: DataFrame, distribution: Column, round_name: str, *, a: float, b: float, temperature: float, seed: int = 0) -> DataFrame:
    """(pid, item_id, kind, round, position, answer, before, conviction, probability, skipped, event, changed) of every cell.

    `cells` has pid, item_id, kind, position, answer, logprobs and wobble; `distribution` says P(answer) by its columns, null where logprobs give none.
    A cell without a kind, logprobs, a wobble or a distribution keeps its answer and says why in `skipped`. Others have an event with
    noise.event_probability; then the answer is drawn from the flattened distribution. Draws are hashes of seed, person, item and the new
    round, so a round can be redrawn alone and another one differs. Logprobs are left out: they belong to the truth.
    """
    where = [F.lit(seed), F.col("pid"), F.col("item_id"), F.lit(round_name)]
    recorded = F.col("logprobs").isNotNull() & (F.size("logprobs") > 0)
    rows = cells.withColumn("__p", F.when(recorded, distribution))
    skipped = F.when(F.col("kind").isNull(), REASONS[0]).when(~recorded, REASONS[1]).when(F.col("wobble").isNull(), REASONS[2]).when(F.col("__p").isNull(), REASONS[3])
    open_ = skipped.isNull()
    top = F.when(open_, noise.conviction(F.col("__p")))
    rows = rows.withColumns({"skipped": skipped, "conviction": top})
    rows = rows.withColumn("probability", F.when(F.col("skipped").isNull(), noise.event_probability(F.col("wobble"), F.col("conviction"), a, b)))
    rows = rows.withColumn("event", F.coalesce(noise.hash_uniform(*where, F.lit("event")) < F.col("probability"), F.lit(False)))
    new = F.when(F.col("event"), noise.drawn(noise.flattened(F.col("__p"), temperature), noise.hash_uniform(*where, F.lit("draw")))).otherwise(F.col("answer"))
    rows = rows.withColumn("before", F.col("answer")).withColumn("answer", new)
    return rows.select(
        "pid", "item_id", "kind", F.lit(round_name).alias("round"), "position", "answer", "before", "conviction", "probability", "skipped", "event", (F.col("event") & ~F.col("answer").eqNullSafe(F.col("before"))).alias("changed")
    )


def in_order(cells: DataFrame, order: DataFrame) -> DataFrame:
    """The cells of a scripted list only (item_id, place), with its place as their position. The list is joined, not sent whole."""
    return cells.drop("position").join(order.select("item_id", F.col("place").alias("position")), "item_id")


def counting(rows: DataFrame, observation: Observation) -> DataFrame:
    """`rows`, counted while they pass: answers, eligible, events, changed, and each reason. Read the observation after an action."""
    count = lambda c: F.count(F.when(c, 1))
    reasons = [count(F.col("skipped") == r).alias(r) for r in REASONS]
    return rows.observe(observation, F.count("*").alias("answers"), count(F.col("skipped").isNull()).alias("eligible"), count(F.col("event")).alias("events"), count(F.col("changed")).alias("changed"), *reasons)


def rates(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(level, keys, cells, events, changed, event_rate, change_rate, mean_conviction, mean_probability) of eligible cells, for each set of keys.

    `level` numbers the sets; keys that a set has not are null. One pass by grouping sets.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    held = rows.where("skipped IS NULL")
    count = lambda c: F.count(F.when(c, 1))
    out = held.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("__id"), F.count("*").alias("cells"), count(F.col("event")).alias("events"), count(F.col("changed")).alias("changed"), F.avg("conviction").alias("mean_conviction"), F.avg("probability").alias("mean_probability")
    )
    number = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(sets))):
        missing = sum(1 << (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in s)
        number = F.when(F.col("__id") == missing, i).otherwise(number)
    return out.select(number.alias("level"), *keys, "cells", "events", "changed", (F.col("events") / F.col("cells")).alias("event_rate"), (F.col("changed") / F.col("cells")).alias("change_rate"), "mean_conviction", "mean_probability")
