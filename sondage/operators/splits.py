"""Splits of people and items: design classes, hold-outs, the questions of an interview under constraints, and how near to it each held-out item is.

An item has loadings (an array of doubles, one for each dimension), a strength, a domain and a kind. All draws go by hashes of a seed,
so SQL repeats them and a lost executor changes nothing. Hold-outs of people rank inside hash buckets (`checks.hash_ranked`). An interview
is drawn by attempts, which are rows: many are tried in one aggregation over the candidates, and the first that fits counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import hash_ranked

#: Classes of items and strata of held-out ones.
PRIMARY, CROSS, WEAK, DISTRACTOR = "primary", "cross", "weak", "distractor"
NEAR, SAME_DOMAIN, FAR = "near", "same-domain", "far"


def item_class(loadings: Column, strength: Column) -> Column:
    """A distractor loads on nothing or has the strength `none`; then weak by strength; then cross, if it loads on several dimensions, or primary."""
    loaded = F.size(F.filter(loadings, lambda v: v != 0))
    nothing = (loaded <= 0) | F.coalesce(strength == "none", F.lit(False))
    return F.when(nothing, DISTRACTOR).when(strength == "weak", WEAK).when(loaded > 1, CROSS).otherwise(PRIMARY)


def primary_dimension(loadings: Column) -> Column:
    """The place (from 0) of the largest loading by size, of equal ones the first; null where there is none."""
    size = F.transform(loadings, lambda v: F.abs(F.coalesce(v, F.lit(0.0))))
    top = F.array_max(size)
    return F.when(top > 0, (F.array_position(size, top) - 1).cast("int"))


def is_candidate(loadings: Column, strength: Column) -> Column:
    """Whether an item is primary with a loading of size one."""
    return (item_class(loadings, strength) == PRIMARY) & (F.array_max(F.transform(loadings, F.abs)) == 1)


def holdout(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """`df` with `held`: k rows by hash order. Fewer rows than k are an error, raised where the result is read."""
    ranked = hash_ranked(df, key, seed, "__place", "__rows")
    enough = F.when(F.col("__rows") < k, F.raise_error(F.concat(F.lit(f"cannot hold out {k} of "), F.col("__rows"))).cast("boolean"))
    return ranked.withColumn("held", F.coalesce(enough, F.col("__place") < k)).drop("__place", "__rows")


@dataclass(frozen=True)
class Interview:
    """What an interview has to keep: `each` items of every dimension but one, which has one less; bounds on domains and kinds."""

    each: int = 2
    most_domains: int = 7
    least_binary: int = 4
    least_other: int = 8


def draws(candidates: DataFrame, rule: Interview, seed: int, first: int, last: int) -> DataFrame:
    """(attempt, fits, n_domains, n_binary, n_items, solo, items) for the attempts first..last; items are (dimension, place, item_id, domain).

    `candidates` has item_id, dimension, domain and kind. In each attempt the dimension of the least hash goes short by one; in every
    dimension the items of the least hashes are taken. Rows are candidates times attempts; the rank limit cuts them before the shuffle.
    """
    draw = lambda *parts: F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("attempt").cast("string"), *[p.cast("string") for p in parts]), 256)
    tried = candidates.select("item_id", "dimension", "domain", "kind", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("attempt"))
    order = Window.partitionBy("attempt", "dimension").orderBy("h", "item_id")
    taken = tried.withColumn("h", draw(F.col("dimension"), F.col("item_id"))).withColumn("place", F.row_number().over(order)).where(F.col("place") <= rule.each)
    whole = taken.groupBy("attempt").agg(
        F.min(F.struct(draw(F.lit("solo"), F.col("dimension")).alias("h"), "dimension"))["dimension"].alias("solo"),
        F.sort_array(F.collect_list(F.struct("dimension", "place", "item_id", "domain", "kind"))).alias("all"),
    )
    kept = F.filter("all", lambda e: (e["dimension"] != F.col("solo")) | (e["place"] < rule.each))
    dimensions = F.size(F.array_distinct(F.transform("all", lambda e: e["dimension"])))
    out = whole.select("attempt", "solo", dimensions.alias("n_dimensions"), kept.alias("items"))
    out = out.withColumns({
        "n_items": F.size("items"),
        "n_domains": F.size(F.array_distinct(F.transform("items", lambda e: e["domain"]))),
        "n_binary": F.size(F.filter("items", lambda e: e["kind"] == "binary")),
    })
    fits = (F.col("n_items") == F.col("n_dimensions") * rule.each - 1) & (F.col("n_domains") <= rule.most_domains) & (F.col("n_binary") >= rule.least_binary) & (F.col("n_items") - F.col("n_binary") >= rule.least_other)
    return out.select("attempt", fits.alias("fits"), "n_domains", "n_binary", "n_items", "solo", "items")


def interview(candidates: DataFrame, rule: Interview, seed: int, *, attempts: int = 20_000, batch: int = 64) -> DataFrame:
    """(attempt, dimension, item_id, domain, kind, place) of the first attempt that fits; `place` is the scripted order, by hash. Raises if none fits."""
    first = 1
    while first <= attempts:
        last = min(attempts, first + batch - 1)
        hit = draws(candidates, rule, seed, first, last).where("fits").agg(F.min("attempt").alias("a")).first()["a"]
        if hit is not None:
            chosen = draws(candidates, rule, seed, hit, hit)
            order = lambda e: F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), e["item_id"].cast("string")), 256)
            shuffled = F.array_sort(F.transform("items", lambda e: F.struct(order(e).alias("h"), e.alias("e"))))
            return chosen.select("attempt", F.posexplode(shuffled).alias("i", "s")).select("attempt", "s.e.dimension", "s.e.item_id", "s.e.domain", "s.e.kind", (F.col("i") + 1).alias("place"))
        first, batch = last + 1, batch * 2
    raise ValueError(f"no interview keeps the constraints in {attempts} draws")


def strata(items: DataFrame, asked: DataFrame, open_domains: DataFrame) -> DataFrame:
    """`items` (item_id, dimension, domain, ...) with `stratum`: far if the interview does not touch the domain, near if one of its
    closed items in the domain has the same dimension, else same-domain. A null dimension or domain matches nothing."""
    by_domain = asked.where("domain IS NOT NULL").groupBy("domain").agg(F.collect_set("dimension").alias("__dimensions"))
    touched = open_domains.select("domain").where("domain IS NOT NULL").distinct().withColumn("__open", F.lit(True))
    joined = items.join(by_domain, "domain", "left").join(touched, "domain", "left")
    inside = F.coalesce(F.array_contains("__dimensions", F.col("dimension")), F.lit(False))
    far = F.col("__dimensions").isNull() & F.col("__open").isNull()
    return joined.withColumn("stratum", F.when(far, FAR).when(inside, NEAR).otherwise(SAME_DOMAIN)).drop("__dimensions", "__open")
