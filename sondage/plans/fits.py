"""Queries of choice fits, ridge models and alignments, with their oracles where SQL has a closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.operators import choice_fits as H
from sondage.operators import coverage as M
from sondage.operators import fusion as U
from sondage.operators import graded as G
from sondage.operators import linear as L

from . import people
from . import views as V
from .registry import query, r6

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "cost", "l_quantity"]


def _choice_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as choice sets; of an order's lines the one shipped first was chosen."""
    cost = (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100000).alias("cost")
    lines = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", cost)
    lines = lines.repartition("l_orderkey").withColumn("l_quantity", F.col("l_quantity") / 50).distinct()  # the lines' only move: all that follows is by order
    line = F.struct("l_shipdate", *_LINE)
    owners = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    marked = lines.withColumn("chosen", line == F.min(line).over(Window.partitionBy("l_orderkey"))).join(owners, "l_orderkey")
    return H.choice_sets(marked, "o_custkey", "l_orderkey", ["cost", "l_quantity"], "chosen", order=_LINE)


@query(None)
def choice_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logit of cost and quantity for each customer with five telling orders; the tests compare with plain solves."""
    return H.fit_choices(_choice_sets(spark, sf_dir), 2, min_sets=5).withColumnRenamed("who", "o_custkey")


@query(None)
def choice_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, however few their orders, under the prior that four fifths of the well-known customers give."""
    training = V.table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("who"))
    fits, _ = H.shrunk_fits(_choice_sets(spark, sf_dir), 2, training, min_sets=5)
    return fits.drop("replicate").withColumnRenamed("who", "o_custkey")


@query(None)
def choice_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each customer's coefficients over 20 resamples of their orders."""
    fits = H.fit_choices(_choice_sets(spark, sf_dir), 2, min_sets=5, replicates=20)
    return H.spread_of_replicates(fits, 2).withColumnRenamed("who", "o_custkey")


_POISSON = "[" + ", ".join(f"{p!r}::DOUBLE" for p in H.POISSON) + "]"


@query(f"""SELECT o_custkey, b::INTEGER AS replicate, sum(len(list_filter({_POISSON}, lambda t: t <= u)))::DOUBLE AS weight FROM (
SELECT o_custkey, b, ('0x' || substr(sha256('0:' || o_custkey || '|' || o_orderkey || ':' || b), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u
FROM orders, (SELECT unnest(range(1, 6)) AS b)) GROUP BY o_custkey, b""")
def replicate_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of each customer's order weights in five resamples."""
    key = F.concat_ws("|", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    each = V.table(spark, sf_dir, "orders").select("o_custkey", F.posexplode(H.replicate_weights(key, 5)).alias("b", "w"))
    return each.groupBy("o_custkey", (F.col("b") + 1).cast("int").alias("replicate")).agg(F.sum("w").alias("weight"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", (F.col("l_extendedprice") / 100000).alias("price"))


_RIDGE = """, t AS (SELECT *, l_extendedprice / 100000 AS price FROM lineitem),
s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(price) AS my, stddev_pop(l_quantity) AS sx, stddev_pop(l_discount) AS sz,
  corr(l_quantity, l_discount) AS r, covar_pop(l_quantity, price) / stddev_pop(l_quantity) AS a, covar_pop(l_discount, price) / stddev_pop(l_discount) AS b FROM t),
g AS (SELECT *, n + lam AS d, n * r AS o, (n + lam) * (n + lam) - n * r * n * r AS det FROM s, (SELECT unnest([0.01::DOUBLE, 100.0, 100000.0]) AS lam)),
w AS (SELECT *, n * (d * a - o * b) / det AS wx, n * (d * b - o * a) / det AS wz FROM g),
f AS (SELECT w.*, t.*, (l_quantity - mx) / sx AS x, (l_discount - mz) / sz AS z FROM w, t),
h AS (SELECT *, my + wx * x + wz * z AS fitted, 1.0::DOUBLE / n + (d * x * x - 2 * o * x * z + d * z * z) / det AS leverage FROM f),
l AS (SELECT *, price - (price - fitted) / (1 - leverage) AS left_out FROM h)
"""


@query(_RIDGE + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(fitted, 6) AS fitted, round(1000 * leverage, 6) AS leverage_thousandths, round(left_out, 6) AS left_out FROM l WHERE lam = 100")
def ridge_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity and discount, and what a fit without the line would say of it."""
    lines = _prices(spark, sf_dir)
    model = L.fit_ridge(lines, ["l_quantity", "l_discount"], ["price"], 100.0)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(model.predictions()["price"]).alias("fitted"), r6(1000 * model.leverage()).alias("leverage_thousandths"), r6(model.left_out()["price"]).alias("left_out")
    )


@query(_RIDGE + "SELECT lam AS penalty, round(avg(pow(left_out - price, 2)), 8) AS mean_squared_error FROM l GROUP BY lam")
def ridge_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = L.penalty_curve(_prices(spark, sf_dir), ["l_quantity", "l_discount"], ["price"], [0.01, 100.0, 100000.0])
    return curve.select("penalty", F.round("mean_squared_error", 8).alias("mean_squared_error"))


_ANGLE = 0.7


@query(f""", e AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
t AS (SELECT a, b, cos({_ANGLE}) * a - sin({_ANGLE}) * b + 0.2 * c AS u, sin({_ANGLE}) * a + cos({_ANGLE}) * b + 0.2 * d AS v FROM e),
s AS (SELECT atan2(sum(a * v - b * u), sum(a * u + b * v)) AS angle FROM t)
SELECT round(cos(angle), 6) AS c00, round(sin(angle), 6) AS c01, round(-sin(angle), 6) AS c10, round(cos(angle), 6) AS c11 FROM s""")
def planted_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rotation that brings two components of the embeddings to turned ones with noise on them."""
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    vectors = V.table(spark, sf_dir, "embeddings").select(*[c.alias(n) for n, c in zip("abcd", e)])
    a, b, cos, sin = F.col("a"), F.col("b"), F.cos(F.lit(_ANGLE)), F.sin(F.lit(_ANGLE))
    turned = vectors.select("a", "b", (cos * a - sin * b + 0.2 * F.col("c")).alias("u"), (sin * a + cos * b + 0.2 * F.col("d")).alias("v"))
    r = L.orthogonal_map(turned, ["a", "b"], ["u", "v"])
    return spark.range(1).select(*[r6(F.lit(float(r[i, j]))).alias(f"c{i}{j}") for i in range(2) for j in range(2)])


@query(""", p AS (SELECT corr(embedding[1]::DOUBLE, embedding[2]::DOUBLE + 0.5 * embedding[1]) AS r1, corr(embedding[1]::DOUBLE, embedding[3]::DOUBLE - 0.3 * embedding[1]) AS r2,
  corr(embedding[2]::DOUBLE + 0.5 * embedding[1], embedding[3]::DOUBLE - 0.3 * embedding[1]) AS r12 FROM embeddings)
SELECT round(sqrt((r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12)), 6) AS first FROM p""")
def canonical_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between one component of the embeddings and two mixtures of it with others."""
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    mixed = V.table(spark, sf_dir, "embeddings").select(e[0].alias("a"), (e[1] + 0.5 * e[0]).alias("b"), (e[2] - 0.3 * e[0]).alias("c"))
    found = L.canonical_correlations(mixed, ["a"], ["b", "c"])
    return spark.range(1).select(r6(F.lit(float(found[0]))).alias("first"))


def _hash(parts: str) -> str:
    return f"(('0x' || substr(sha256({parts}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


def _normal(parts: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_hash(parts + chr(32) + '|| ' + repr(':r'))})) * cos(2 * pi() * {_hash(parts + chr(32) + '|| ' + repr(':a'))}))"


@query(f"SELECT o_orderkey, i::INTEGER AS draw, round({_normal("'7:' || o_orderkey || ':' || i || ':0'")}, 6) AS z FROM orders, (SELECT unnest(range(2)) AS i)")
def normal_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reproducible normal numbers for each order."""
    draws = M.normal_draws(F.col("o_orderkey"), 2, 1, seed=7)
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(draws).alias("draw", "z")).select("o_orderkey", "draw", r6(F.get("z", F.lit(0))).alias("z"))


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's mean value after their first items (by number) as a measurement of the mean over all of them, with its standard error."""
    main = V.main_round(spark, sf_dir).select("pid", "item_id", "value")
    return main.groupBy("pid").agg(F.avg("value").alias("truth"), *[f(F.when(F.col("item_id") <= k, F.col("value"))).alias(f"{n}{k}") for k in (5, 10, 20) for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])


_REACHED = ", r AS (SELECT pid, avg(value) AS truth, " + ", ".join(f"{f}(value) FILTER (item_id <= {k}) AS {n}{k}" for k in (5, 10, 20) for n, f in (("m", "avg"), ("s", "stddev_samp"), ("n", "count"))) + """ FROM main GROUP BY pid),
c AS (""" + " UNION ALL ".join(f"SELECT {k} AS answers, m{k} AS centre, s{k} / sqrt(n{k}) AS spread, truth FROM r" for k in (5, 10, 20)) + """),
d AS (SELECT *, abs(centre - truth) AS error FROM c WHERE centre IS NOT NULL AND spread IS NOT NULL)
"""


def _reach_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("answers"), F.col(f"m{k}").alias("centre"), (F.col(f"s{k}") / F.sqrt(f"n{k}")).alias("spread")) for k in (5, 10, 20)]
    return _reached(spark, sf_dir).select("truth", F.explode(F.array(*rows)).alias("r")).select("truth", "r.*")


@query(_REACHED + """SELECT answers::INTEGER AS answers, count(*) AS cells, round(avg((error <= spread)::INTEGER), 6) AS coverage, round(avg(spread), 6) AS mean_spread, round(avg(error), 6) AS mean_error,
round(avg(error * error) / avg(spread * spread), 6) AS variance_ratio, round(quantile_cont(error / greatest(spread, 1e-12), 0.68), 6) AS nominal_factor, avg((error <= spread)::INTEGER) BETWEEN 0.6 AND 0.75 AS pass
FROM d GROUP BY answers""")
def coverage_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether declared spreads hold, by the number of items asked."""
    out = M.honesty(_reach_cells(spark, sf_dir), ["answers"])
    return out.select("answers", "cells", *[r6(c).alias(c) for c in ("coverage", "mean_spread", "mean_error", "variance_ratio", "nominal_factor")], "pass")


@query(_REACHED + "SELECT answers::INTEGER AS answers, count(*) AS cells, round(sqrt(avg(error * error)), 6) AS residual_rms, round(sqrt(avg(spread * spread)), 6) AS spread_rms, round(sqrt(avg(error * error)) / sqrt(avg(spread * spread)), 6) AS kappa FROM d GROUP BY answers")
def spread_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor by which the declared spreads would have to grow."""
    out = M.calibration(_reach_cells(spark, sf_dir).withColumnRenamed("truth", "full"), ["answers"])
    return out.select("answers", "cells", *[r6(c).alias(c) for c in ("residual_rms", "spread_rms", "kappa")])


@query(None)
def posterior_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of the items beyond the interview, averaged over 64 draws of each person's posterior; the tests repeat the draws."""
    coded = people._coded(spark, sf_dir)
    items = people._graded_items(coded)
    posterior = G.posteriors(coded.where(F.col("item_id") <= people.INTERVIEW), items, 2)
    return M.posterior_predictions(posterior, items.where(F.col("item_id") > people.INTERVIEW), 2, n_draws=64)


@query(None)
def measurement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold losses of noise shapes and ridges for components of the embeddings as scores of two others; the tests compare with plain folds."""
    e = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)]
    df = V.table(spark, sf_dir, "embeddings").select("vec_id", *e)
    mixed = df.select("vec_id", "e0", "e1", *[(F.col(f"e{i}") + (i / 4 - 1) * F.col("e0") + F.col("e1") / i + 0.5 * F.col("e2")).alias(f"y{i}") for i in range(3, 8)])
    _, curve = U.fit_measurement(mixed, [f"y{i}" for i in range(3, 8)], ["e0", "e1"], U.hash_fold(F.col("vec_id"), 5), factors=(0, 1, 2))
    return spark.createDataFrame(curve, "ridge double, factors int, loss double")
