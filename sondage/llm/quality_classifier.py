"""Operator 4, a quality classifier by regularised quadratic discriminant analysis.

Statistics of a text are transformed to be nearly normal. Each class has a mean and a covariance, shrunk
towards the pooled one and towards a multiple of the identity. A score is the difference of two Mahalanobis
log-densities. The inverse Cholesky factors are computed once, when the model is fitted, and enter the
plan as constants, so scoring is one projection. Fitting is one aggregation of sums and
cross products of all labelled rows, combined on the map side.

Defined results: null and empty texts have zero statistics and a score as any other; very long texts are counted whole; texts of equal statistics have
equal scores, and a score of exactly 0.3 is predicted as 1 by the query; labels that are
null, or of ids without a document, are left out; repeated labels count as often as they stand there;
a class without labels gives every text the other class's share; an empty table gives an
empty result, whether fitted on or scored; extra columns are returned as they came, but for those named like a feature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name and SQL of each transformed statistic, over the counts of `with_counts`.
FEATURES = {
    "f_words": "ln(1 + n_words)",
    "f_word_length": "ln(1 + n_visible / greatest(n_words, 1))",
    "f_symbols": "ln(1 + 100 * n_symbols / greatest(n_words, 1))",
    "f_letters": "sqrt(1 - n_letters / greatest(n_visible, 1))",
    "f_upper": "sqrt(n_upper / greatest(n_letters, 1))",
    "f_marks": "ln(1 + 100 * n_marks / greatest(n_words, 1))",
    "f_digits": "sqrt(n_digits / greatest(n_visible, 1))",
    "f_lines": "ln(1 + n_dup_lines)",
    "f_twins": "sqrt(n_twins / greatest(n_words, 1))",
    "f_distinct": "sqrt(n_distinct / greatest(n_words, 1)) + 0.05 * ln(1 + n_words)",
}
COUNTS = ["n_words", "n_visible", "n_symbols", "n_letters", "n_upper", "n_marks", "n_digits", "n_dup_lines", "n_twins", "n_distinct"]

#: Shares of the pooled covariance and of the identity in each class covariance.
POOLED, RIDGE = 0.1, 0.02
TEMPERATURES = [1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0]


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the columns COUNTS; columns of these names, in any case, are replaced."""
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    step = step.withColumn("__words", F.expr(r"regexp_extract_all(__text, '[^\\x20\\x09-\\x0D]+', 0)"))
    step = step.withColumn("__lines", F.expr(r"filter(split(__text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    count = lambda pattern: F.regexp_count("__text", F.lit(pattern)).cast("double")
    return step.select(
        *[F.col(f"__doc.`{c}`") for c in docs.columns if c.lower() not in COUNTS],
        F.size("__words").cast("double").alias("n_words"),
        F.length(F.regexp_replace("__text", r"[\x20\x09-\x0D]+", "")).cast("double").alias("n_visible"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{L}").alias("n_letters"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[!?]").alias("n_marks"),
        count(r"[0-9]").alias("n_digits"),
        F.expr("cast(size(__lines) - size(array_distinct(__lines)) as double)").alias("n_dup_lines"),
        count(r"(?i)(?<![^\s])(\S+) \1(?!\S)").alias("n_twins"),
        F.size(F.array_distinct("__words")).cast("double").alias("n_distinct"),
    )


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the columns of FEATURES; columns of these names, in any case, are replaced, all others returned as they came.

    Features are the fields of an array of one struct, made rows again: a filter on a score then stays above them, instead of going below with all their
    counts in the place of each column's name.
    """
    names = [c for c in docs.columns if c.lower() not in FEATURES]
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("__none")).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    counted = with_counts(carried)
    features = F.struct(*[F.expr(sql).alias(name) for name, sql in FEATURES.items()])
    return counted.select("doc", F.inline(F.array(features))).select(*[F.col(f"doc.`{c}`") for c in names], *FEATURES)


def _distance(centred: Column, triangle: Column) -> Column:
    """The squared length of the centred features times a lower triangle, whose rows have their diagonal first."""

    def of(c: Column) -> Column:
        def projected(row: Column, i: Column) -> Column:
            parts = F.transform(row, lambda weight, k: weight * F.get(c, F.when(k == 0, i).otherwise(k - 1)))
            return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)

        return F.aggregate(F.transform(triangle, projected), F.lit(0.0), lambda total, z: total + z * z)

    return F.get(F.transform(F.array(centred), of), F.lit(0))  # `centred` is worked out once


@dataclass
class Discriminant:
    """For each class 0 and 1: mean, inverse Cholesky factor, log prior minus half the log determinant."""

    means: list[np.ndarray]
    inverse: list[np.ndarray]
    offset: list[float]
    temperature: float = 1.0
    constant: float | None = None  # the score of all texts, where one class has no labels

    def log_odds(self) -> Column:
        """Log density of class 1 minus that of class 0, with their priors.

        The model's numbers are arrays and each feature stands here once a class, so that the plan stays small, and its compiled code the same for all models.
        """
        if self.constant is not None:
            return F.lit(math.log(self.constant / (1 - self.constant)))
        sides = []
        for mean, inverse, offset in zip(self.means, self.inverse, self.offset, strict=True):
            centred = F.zip_with(F.array(*FEATURES), F.lit([float(m) for m in mean]), lambda x, m: x - m)
            triangle = F.lit([[float(row[j]) for j in (i, *range(i))] for i, row in enumerate(inverse)])
            sides.append(F.lit(offset) - 0.5 * _distance(centred, triangle))
        return sides[1] - sides[0]

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds() / self.temperature))


def fit(features: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """Fit on the rows of `features` (with `id_col`) that have a label 0 or 1."""
    names = list(FEATURES)
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__label IN (0, 1)")
    rows = features.select(F.col(id_col).alias("__id"), *names).join(marked, "__id")
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]
    found = {r["__label"]: r for r in rows.groupBy("__label").agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s_{i}") for i, a in enumerate(names)], *products).collect()}
    total = sum(r["n"] for r in found.values())
    if len(found) < 2:
        share = found[1]["n"] / (total + 1) if 1 in found else (0.5 if not found else 1 / (total + 2))
        return Discriminant([], [], [], constant=min(max(share, 1e-6), 1 - 1e-6))
    means, covariances, d = [], [], len(names)
    for label in (0, 1):
        r, n = found[label], found[label]["n"]
        mean = np.array([r[f"s_{i}"] / n for i in range(d)])
        lower = np.array([[r[f"p_{max(i, j)}_{min(i, j)}"] / n for j in range(d)] for i in range(d)])
        means.append(mean)
        covariances.append(lower - np.outer(mean, mean))
    common = sum(found[c]["n"] * covariances[c] for c in (0, 1)) / total
    scale = np.trace(common) / d + 1e-9
    inverse, offset = [], []
    for label in (0, 1):
        shrunk = (1 - pooled) * covariances[label] + pooled * common + ridge * scale * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        offset.append(math.log(found[label]["n"] / total) - float(np.log(np.diag(factor)).sum()))
    model = Discriminant(means, inverse, offset)
    odds = model.log_odds() * (2 * F.col("__label") - 1)
    loss = [F.sum(F.log1p(F.exp(-F.greatest(F.col("odds") / t, F.lit(-500.0))))).alias(str(i)) for i, t in enumerate(TEMPERATURES)]
    losses = rows.select(odds.alias("odds")).agg(*loss).first()
    model.temperature = min(zip(losses, TEMPERATURES, strict=True))[1]
    return model
