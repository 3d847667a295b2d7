"""How far what people were designed to be comes through in what they answer: tendencies by dimension, halves of the items, and the noise that gives a wanted agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions import noise

from .checks import hash_order
from .stats import safe_corr


def halves(items: DataFrame, seed: int) -> DataFrame:
    """(dim, item_id, half): the items of each dimension dealt in turn to halves 0 and 1, in hash order. `items` is a bank: a row an item."""
    dealt = items.groupBy("dim").agg(F.sort_array(F.collect_set(F.struct(hash_order(seed, F.col("dim"), F.col("item_id")).alias("h"), "item_id"))).alias("all"))
    return dealt.select("dim", F.posexplode("all").alias("i", "e")).select("dim", "e.item_id", (F.col("i") % 2).alias("half"))


def transmission(scores: DataFrame, truth: DataFrame, seed: int) -> DataFrame:
    """(dim, n_items, n_people, r_raw, n_both, r, reliability, rho) for each dimension, from `scores` (pid, item_id, dim, score) and `truth` (pid, dim, value).

    A person's tendency is the mean score of their answers. r_raw is its correlation with the truth over all who answered. `r`, over those who
    answered in both halves of the items, is set right for unreliability: reliability is the halves' correlation stepped up to full length, null
    where it is not positive, and rho = r / sqrt(reliability), one at most. Null scores count as no answer. People meet their truth after their
    answers have been aggregated: a row a person and dimension is shuffled.
    """
    known = scores.where("score IS NOT NULL")
    items = halves(known.select("dim", "item_id").distinct(), seed)
    half = lambda k: F.avg(F.when(F.col("half") == k, F.col("score")))
    person = known.join(items, ["dim", "item_id"]).groupBy("pid", "dim").agg(F.avg("score").alias("t"), half(0).alias("a"), half(1).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = person.join(truth.select("pid", "dim", "value").where("value IS NOT NULL"), ["pid", "dim"]).groupBy("dim").agg(
        F.count("*").alias("n_people"),
        safe_corr(F.col("value"), F.col("t")).alias("r_raw"),
        F.count_if(both).alias("n_both"),
        safe_corr(F.when(both, F.col("value")), F.when(both, F.col("t"))).alias("r"),
        safe_corr(F.col("a"), F.col("b")).alias("r_half"),
    )
    out = out.join(items.groupBy("dim").agg(F.count("*").alias("n_items")), "dim")
    out = out.withColumn("reliability", F.when(F.col("r_half") > 0, 2 * F.col("r_half") / (1 + F.col("r_half"))))
    rho = F.when(F.col("reliability").isNotNull() & F.col("r").isNotNull(), F.least(F.col("r") / F.sqrt("reliability"), F.lit(1.0)))
    return out.select("dim", "n_items", "n_people", "r_raw", "n_both", "r", "reliability", rho.alias("rho"))


def noise_curve(cells: DataFrame, strengths: Sequence[float], b: float, target: float) -> DataFrame:
    """(strength, n, agreement, chosen): how often two noised rounds of the same answers would agree at each strength, from `cells` (pid, item_id, wobble, gap, can_flip).

    Each round flips an answer by its own draw with the probability least(0.5, wobble * strength * exp(-b * gap)); an answer without another one to
    flip to always agrees. All strengths cost one pass over the cells. `chosen` marks the strength nearest to the target, of equal ones the first.
    """
    first, second = (noise.hash_uniform(F.col("pid"), F.col("item_id"), F.lit(r)) for r in (0, 1))
    drawn = cells.select("wobble", "gap", F.coalesce("can_flip", F.lit(False)).alias("can_flip"), first.alias("u"), second.alias("v")).where("wobble IS NOT NULL AND gap IS NOT NULL")

    def agrees(a: float) -> Column:
        p = noise.flip_probability(F.col("wobble"), F.col("gap"), a, b)
        return ~F.col("can_flip") | ((F.col("u") < p) == (F.col("v") < p))

    sums = drawn.agg(F.count("*").alias("n"), F.array(*[F.count_if(agrees(float(a))) for a in strengths]).alias("agree"))
    grid = F.array(*[F.lit(float(a)) for a in strengths])
    rows = F.zip_with(grid, "agree", lambda a, k: F.struct(a.alias("strength"), (k / F.nullif(F.col("n"), F.lit(0))).alias("agreement")))
    best = F.array_min(F.transform("rows", lambda e, i: F.struct(F.abs(e["agreement"] - target).alias("off"), i.alias("i"))))["i"]
    out = sums.select("n", rows.alias("rows")).withColumn("best", best)
    return out.select("n", "best", F.posexplode("rows").alias("i", "e")).select("e.strength", "n", "e.agreement", (F.col("i") == F.col("best")).alias("chosen"))
