"""Answer logs: which answer counts, what is missing, who agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import agreement_counts, pair_agreement


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the highest `order` of each key; by max of a struct, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in rest])).alias("best"))
    return best.select(*keys, *[F.col(f"best.__{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in rest])).alias("best"))
    return best.select(*keys, *[F.col(f"best.__{c}").alias(c) for c in rest])


def missing_cells(cells: DataFrame, person: str = "pid", item: str = "item_id") -> DataFrame:
    """Cells of the person x item grid without an answer. The grid is the operator's own output space."""
    people, items = cells.select(person).distinct(), cells.select(item).distinct()
    return people.crossJoin(F.broadcast(items)).join(cells.select(person, item), [person, item], "left_anti")


def agrees(main: Column, retest: Column, kind: Column) -> Column:
    """Equal for binary answers, at most one step apart for others."""
    return F.when(kind == "binary", main == retest).otherwise(F.abs(main - retest) <= 1)


def retest_report(main: DataFrame, retest: DataFrame) -> DataFrame:
    """Agreement pooled, for each kind and for each person, in one pass over grouping sets."""
    both = retest.select("pid", "item_id", F.col("code").alias("__again")).join(main, ["pid", "item_id"])
    ok = agrees(F.col("code"), F.col("__again"), F.col("kind")).cast("double")
    each = both.select("pid", "kind", ok.alias("ok"))
    return each.groupingSets([[], [F.col("kind")], [F.col("pid")]], "kind", "pid").agg(F.count("*").alias("n"), F.avg("ok").alias("rate"))


def pairwise_agreement(cells: DataFrame) -> DataFrame:
    """(pid_a, pid_b, shared, same, rate) of all pairs with a shared item; missing cells do not count. People are compared in blocks."""
    pairs = pair_agreement(cells.select("pid", "item_id", "answer"))
    return pairs.select("pid_a", "pid_b", "shared", "same", (F.col("same") / F.col("shared")).alias("rate"))


def dense_agreement(cells: DataFrame) -> DataFrame:
    """The variant over all items of the bank, in which two missing answers agree: items that neither answered follow from counts."""
    n_items = cells.agg(F.countDistinct("item_id").alias("n_items"))
    pairs = pair_agreement(cells.select("pid", "item_id", "answer"), unmet=True).crossJoin(F.broadcast(n_items))  # one row
    neither = F.col("n_items") - F.col("n_a") - F.col("n_b") + F.col("shared")
    return pairs.select("pid_a", "pid_b", ((F.col("same") + neither) / F.col("n_items")).alias("rate"))


def agreement_rates(cells: DataFrame) -> DataFrame:
    """(rate, pairs): how many of the pairs of `pairwise_agreement` have each rate; for aggregates of the rate, which need no row a pair."""
    counts = agreement_counts(cells.select("pid", "item_id", "answer"))
    return counts.groupBy((F.col("same") / F.col("shared")).alias("rate")).agg(F.sum("pairs").alias("pairs"))


def dense_agreement_rates(cells: DataFrame) -> DataFrame:
    """(rate, pairs): the same of `dense_agreement`."""
    n_items = cells.agg(F.countDistinct("item_id").alias("n_items"))
    counts = agreement_counts(cells.select("pid", "item_id", "answer"), unmet=True).crossJoin(F.broadcast(n_items))  # one row
    return counts.select((F.col("alike") / F.col("n_items")).alias("rate"), "pairs")


def mean_rate() -> Column:
    return F.sum(F.col("rate") * F.col("pairs")) / F.sum("pairs")


def smoothed_marginals(cells: DataFrame, keys: list[str], category: str, categories: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """P(category) for each key over the whole category list, smoothed."""
    grid = cells.select(*keys).distinct().crossJoin(F.broadcast(categories))
    counts = cells.groupBy(*keys, category).agg(F.count("*").alias("__n"))
    full = grid.join(counts, [*keys, category], "left").withColumn("__w", F.coalesce("__n", F.lit(0)) + smoothing)
    return full.select(*keys, category, (F.col("__w") / F.sum("__w").over(Window.partitionBy(*keys))).alias("p"))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, complete): each conversation's turns in order; complete if no number is left out."""
    nested = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.max("turn").alias("__last"))
    return nested.select("conv_id", "turns", (F.col("__last") + 1 == F.size("turns")).alias("complete"))


def scripted_order(transcripts: DataFrame, field: str = "item_id", *, strict: bool = False) -> DataFrame:
    """(script, conversations, example, first): the different orders of a nested field over all transcripts, the most common one first.

    `transcripts` has conv_id and turns, in order. A script is told by the digest of its fields; `first` is the first field that the
    most common script has otherwise, null for that one itself. With `strict`, more than one script fails the query.
    """
    names = F.transform("turns", lambda t: F.coalesce(t[field].cast("string"), F.lit("")))
    each = transcripts.select("conv_id", names.alias("names"))
    scripts = each.groupBy("names").agg(F.count("*").alias("conversations"), F.min("conv_id").alias("example"))
    common = scripts.agg(F.min_by("names", F.struct(-F.col("conversations"), "example")).alias("common"), F.count("*").alias("n"))
    rows = scripts.crossJoin(common)  # one row
    if strict:
        rows = rows.withColumn("names", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("scripts differ in conversation "), F.col("example").cast("string")))).otherwise(F.col("names")))
    other = F.filter(F.transform("names", lambda x, i: F.when(~x.eqNullSafe(F.get("common", i)), x)), lambda x: x.isNotNull())
    shorter = F.when(F.size("names") < F.size("common"), F.get("common", F.size("names")))
    digest = F.sha2(F.to_json(F.struct("names")), 256)
    return rows.select(digest.alias("script"), "conversations", "example", F.coalesce(F.get(other, F.lit(0)), shorter).alias("first"))


def upserted(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First answer of each key of `batch` that `existing` has not: what an append must write."""
    return first_wins(batch, keys, order).join(existing.select(*keys), keys, "left_anti")


def rejects_after(old: DataFrame, new: DataFrame, answered: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rejects table after a batch: the last reject of each key that is still unanswered."""
    return last_wins(old.unionByName(new), keys, order).join(answered.select(*keys).distinct(), keys, "left_anti")
