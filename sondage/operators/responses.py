"""Answers as codes, and the graded-response model: category probabilities and the posterior of each person's traits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import stripped

from . import graded

LIKERT_STEPS = 5


#: Stored answers of binary items.
YES_ANSWERS, NO_ANSWERS = ("yes", "1", "true"), ("no", "0", "false")


def answer_code(answer: Column, kind: Column, *, strict: bool = False) -> Column:
    """Category index of a stored answer: 0 to 4 for 1 to 5 of likert5, 1 and 0 for yes and no of binary; null where it is neither.

    With `strict`, an answer of a known kind that cannot be read fails the query; a null one stays null.
    """
    text = F.lower(stripped(answer.cast("string")))
    number = F.when(text.rlike(r"^[+-]?\d{1,9}$"), text).cast("int")
    likert = F.when(number.between(1, LIKERT_STEPS), number - 1)
    binary = F.when(text.isin(*YES_ANSWERS), 1).when(text.isin(*NO_ANSWERS), 0)
    code = F.when(kind == "likert5", likert).when(kind == "binary", binary)
    if not strict:
        return code
    unread = code.isNull() & text.isNotNull() & kind.isin("likert5", "binary")
    return F.when(unread, F.raise_error(F.concat(F.lit("unreadable answer: "), answer.cast("string"))).cast("int")).otherwise(code)


def coded_answers(log: DataFrame, bank: DataFrame, *, round_name: str | None = "main", missing_counts: bool = False) -> DataFrame:
    """(pid, item_id, kind, code, position): the last answer of each cell in one round (all, if None), for items of the bank.

    `log` has pid, item_id, round, answer and `position`, its place in the file; items that the bank has not are left out.
    With `missing_counts` a null or empty round counts as that round, else as none.
    `code` is null where the answer cannot be read; `unreadable` counts such cells.
    """
    named = F.when(F.col("round").isNotNull() & (F.col("round") != ""), F.col("round"))
    asked = F.coalesce(named, F.lit(round_name)) if missing_counts else F.col("round")
    rows = log.where(asked == round_name) if round_name is not None else log
    last = rows.groupBy("pid", "item_id").agg(F.max(F.struct("position", "answer")).alias("last"))
    return last.join(bank.select("item_id", "kind"), "item_id").select("pid", "item_id", "kind", answer_code(F.col("last.answer"), F.col("kind")).alias("code"), "last.position")


def unreadable(coded: DataFrame) -> DataFrame:
    """(item_id, n): cells without a code."""
    return coded.where("code IS NULL").groupBy("item_id").agg(F.count("*").alias("n"))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def category_probabilities(z: Column, cuts: Column) -> Column:
    """Array of P(category) for the slope product `z` and an item's rising array of cuts; two categories for one cut, five for four."""
    seen = F.concat(F.array(F.lit(1.0)), F.transform(cuts, lambda t: sigmoid(z - t)), F.array(F.lit(0.0)))
    return F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.get(seen, i) - F.get(seen, i + 1))


def answer_log_probability(z: Column, cuts: Column, code: Column) -> Column:
    """Log probability of one answer, without the loss of a difference of two numbers near one; null for codes outside the item's categories.

    For a cut below, one above and the gap between them it is log s(z - low) + log s(high - z) + log(1 - exp(-gap)).
    """
    low, high = F.get(cuts, code - 1), F.get(cuts, code)
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    terms = [F.when(low.isNotNull(), -softplus(low - z)), F.when(high.isNotNull(), -softplus(z - high)), F.when(low.isNotNull() & high.isNotNull(), F.log1p(-F.exp(low - high)))]
    total = F.coalesce(terms[0], F.lit(0.0)) + F.coalesce(terms[1], F.lit(0.0)) + F.coalesce(terms[2], F.lit(0.0))
    return F.when(code.between(0, F.size(cuts)), total)


def slope_product(traits: Column, loadings: Column) -> Column:
    return F.aggregate(F.zip_with(traits, loadings, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)


def person_posteriors(cells: DataFrame, items: DataFrame, n_traits: int) -> DataFrame:
    """(pid, n_answers, theta, covariance): mode of each person's posterior under a standard normal prior, and its Laplace covariance (row by row).

    `cells` has pid, item_id and code, one row a cell; `items` has item_id, loadings (of n_traits) and cuts; see operators.graded.
    """
    return graded.posteriors(cells, items, n_traits)
