"""Queries of prediction from similar people, of the response model and of grading, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import calibration as C
from sondage.operators import graded as G
from sondage.operators import neighbours as B
from sondage.operators import responses as R
from sondage.operators import stats as S
from sondage.operators.choice_fits import POISSON

from . import views as V
from .registry import query, r6

#: Items up to this one are the interview; those above are predicted.
INTERVIEW = 15
K_GRID = (1, 3, 5, 10, 20)


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main-round cells; binary items have the codes 0 and 1."""
    code = F.when(F.col("kind") == "binary", (F.col("code") >= 2).cast("int")).otherwise(F.col("code"))
    return V.main_round(spark, sf_dir).select("pid", "item_id", "kind", "answer", "value", code.alias("code"))


def _interview(coded: DataFrame) -> DataFrame:
    return coded.where(F.col("item_id") <= INTERVIEW).select("pid", "item_id", B.scaled_codes(F.col("code"), F.col("kind")).alias("x"))


_CODED = f""", coded AS (SELECT pid, item_id, kind, value, CASE WHEN kind = 'binary' THEN (code >= 2)::INTEGER ELSE code END AS code FROM main),
near AS (SELECT * FROM (SELECT a.pid AS target, b.pid AS neighbour, row_number() OVER (PARTITION BY a.pid ORDER BY
    round(sum(abs(a.code - b.code) / CASE WHEN a.kind = 'binary' THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END), 9), b.pid) AS place
  FROM coded a JOIN coded b ON a.item_id = b.item_id AND a.pid <> b.pid WHERE a.item_id <= {INTERVIEW} GROUP BY a.pid, b.pid) WHERE place <= {max(K_GRID)}),
asked AS (SELECT * FROM coded WHERE item_id > {INTERVIEW}),
cats AS (SELECT DISTINCT item_id, code AS category FROM asked)
"""


@query(_CODED + """SELECT target, item_id, category, round((coalesce(n, 0) + 0.5) / sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY target, item_id), 6)::DOUBLE AS p
FROM (SELECT DISTINCT target FROM near) CROSS JOIN cats LEFT JOIN (
  SELECT target, item_id, code AS category, count(*)::DOUBLE AS n FROM near JOIN asked ON asked.pid = near.neighbour WHERE place <= 10 GROUP BY ALL) v USING (target, item_id, category)""")
def knn_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _coded(spark, sf_dir)
    asked = coded.where(F.col("item_id") > INTERVIEW).select("pid", "item_id", "code")
    near = B.nearest_neighbours(_interview(coded), 10)
    out = B.knn_distributions(near, asked, asked.select("item_id", F.col("code").alias("category")))
    return out.select("target", "item_id", "category", r6("p").alias("p"))


@query(_CODED + f""", grid AS (SELECT unnest({list(K_GRID)}) AS k),
sizes AS (SELECT item_id, count(*) AS size FROM cats GROUP BY item_id),
v AS (SELECT k, target, item_id, code AS category, count(*)::DOUBLE AS n FROM grid JOIN near ON place <= k JOIN asked ON asked.pid = near.neighbour GROUP BY ALL),
tot AS (SELECT k, target, item_id, sum(n) AS total FROM v GROUP BY ALL)
SELECT k, round(avg(b), 6) AS loo_brier FROM (
  SELECT g.k, a.pid, a.item_id, avg(pow((coalesce(v.n, 0) + 0.5) / (coalesce(tot.total, 0) + 0.5 * s.size) - (c.category = a.code)::INTEGER, 2)) AS b
  FROM grid g CROSS JOIN asked a JOIN cats c ON c.item_id = a.item_id JOIN sizes s ON s.item_id = a.item_id
  LEFT JOIN v ON v.k = g.k AND v.target = a.pid AND v.item_id = a.item_id AND v.category = c.category
  LEFT JOIN tot ON tot.k = g.k AND tot.target = a.pid AND tot.item_id = a.item_id GROUP BY ALL) GROUP BY k""")
def knn_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leave-one-out score of each k; operators.neighbours.chosen_k takes the best."""
    coded = _coded(spark, sf_dir)
    asked = coded.where(F.col("item_id") > INTERVIEW).select("pid", "item_id", "code")
    near = B.nearest_neighbours(_interview(coded), max(K_GRID))
    out = B.loo_briers(near, asked, asked.select("item_id", F.col("code").alias("category")), K_GRID)
    return out.select("k", r6("loo_brier").alias("loo_brier"))


@query(f""", near AS (SELECT * FROM (SELECT a.pid AS target, b.pid AS neighbour, row_number() OVER (PARTITION BY a.pid ORDER BY
    round(avg((a.answer <> b.answer)::INTEGER), 9), b.pid DESC) AS place
  FROM main a JOIN main b ON a.item_id = b.item_id AND a.pid <> b.pid WHERE a.item_id <= {INTERVIEW} GROUP BY a.pid, b.pid) WHERE place <= 20)
SELECT target, item_id, answer, round(n / sum(n) OVER (PARTITION BY target, item_id), 6)::DOUBLE AS share FROM (
  SELECT target, item_id, answer, count(*) AS n FROM near JOIN main ON main.pid = near.neighbour WHERE item_id > {INTERVIEW} GROUP BY ALL)""")
def knn_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = V.main_round(spark, sf_dir).select("pid", "item_id", "answer")
    near = B.matching_neighbours(main.where(F.col("item_id") <= INTERVIEW), 20)
    out = B.match_shares(near.select("target", "neighbour"), main.where(F.col("item_id") > INTERVIEW))
    return out.select("target", "item_id", "answer", r6("share").alias("share"))


@query(_CODED + """, trained AS (SELECT * FROM (SELECT a.pid AS target, b.pid AS neighbour, row_number() OVER (PARTITION BY a.pid ORDER BY
    round(sum(abs(a.code - b.code) / CASE WHEN a.kind = 'binary' THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END), 9), b.pid) AS place
  FROM coded a JOIN coded b ON a.item_id = b.item_id AND a.pid <> b.pid WHERE a.item_id <= """ + str(INTERVIEW) + """ AND b.pid % 5 <> 0 GROUP BY a.pid, b.pid) WHERE place <= 10)
SELECT target, item_id, category, round((coalesce(n, 0) + 0.5) / sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY target, item_id), 6)::DOUBLE AS p
FROM (SELECT DISTINCT target FROM trained WHERE target % 5 = 0) CROSS JOIN cats LEFT JOIN (
  SELECT target, item_id, code AS category, count(*)::DOUBLE AS n FROM trained JOIN asked ON asked.pid = trained.neighbour GROUP BY ALL) v USING (target, item_id, category)""")
def knn_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the people predicted from the ten nearest of the others, who never learn from the fifth."""
    coded = _coded(spark, sf_dir)
    train = coded.where("pid % 5 <> 0").select("pid").distinct()
    near = B.nearest_neighbours(_interview(coded), 10, train=train).where("target % 5 = 0")
    asked = coded.where(F.col("item_id") > INTERVIEW).select("pid", "item_id", "code")
    out = B.knn_distributions(near, asked, asked.select("item_id", F.col("code").alias("category")))
    return out.select("target", "item_id", "category", r6("p").alias("p"))


_LADDER = [("segment", "nation", "sign"), ("segment", "nation"), ("segment",), ()]


def _rung(i: int, fields: tuple[str, ...]) -> str:
    same = " AND ".join(f"g.{f} IS NOT DISTINCT FROM k.{f}" for f in fields) or "true"
    return f"""SELECT p.pid, v.item_id, {i} AS rung, v.answer, count(*) AS n FROM people p JOIN people g ON g.train AND {same.replace("k.", "p.")}
JOIN votes v ON v.pid = g.pid WHERE (SELECT count(*) FROM people k WHERE k.train AND {same.replace("g.", "p.")}) >= 10 GROUP BY ALL"""


@query(""", people AS (SELECT c_custkey AS pid, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal >= 0 AS sign, c_custkey % 5 <> 0 AS train FROM customer),
votes AS (SELECT o_custkey AS pid, year(o_orderdate) AS item_id, o_orderpriority AS answer FROM orders),
offers AS (""" + " UNION ALL ".join(_rung(i, f) for i, f in enumerate(_LADDER)) + """)
SELECT pid, item_id, rung, answer, round(n / sum(n) OVER (PARTITION BY pid, item_id), 6)::DOUBLE AS share
FROM (SELECT *, min(rung) OVER (PARTITION BY pid, item_id) AS best FROM offers) WHERE rung = best""")
def back_off_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities by year among customers of like profile; four fifths of the customers are those learned from."""
    customer = V.table(spark, sf_dir, "customer")
    people = customer.select(F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") >= 0).alias("sign"))
    votes = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pid"), F.year("o_orderdate").alias("item_id"), F.col("o_orderpriority").alias("answer"))
    out = B.back_off_shares(people, people.where("pid % 5 <> 0"), votes, _LADDER)
    return out.select("pid", "item_id", "rung", "answer", r6("share").alias("share"))


@query("SELECT pid, item_id, kind, CASE WHEN kind = 'binary' THEN (code >= 2)::INTEGER ELSE code END AS code FROM (SELECT pid, item_id, kind, arg_max(code, seq) AS code FROM ev GROUP BY ALL)")
def coded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers (1 to 5, Yes and No) as category codes; the last of each cell counts."""
    log = V.log(spark, sf_dir)
    stored = F.when(F.col("kind") == "likert5", (F.col("code") + 1).cast("string")).otherwise(F.when(F.col("code") >= 2, " Yes").otherwise("no"))
    rows = log.select("pid", "item_id", F.lit("main").alias("round"), stored.alias("answer"), F.col("seq").alias("position"))
    return R.coded_answers(rows, log.select("item_id", "kind").distinct()).select("pid", "item_id", "kind", "code")


_CUTS = (-1.5, -0.5, 0.5, 1.5)


@query(""", z AS (SELECT pid, item_id, value / 25 - 2 AS z FROM main), seen AS (SELECT pid, item_id, [1.0::DOUBLE, """ + ", ".join(f"1 / (1 + exp(-(z - ({c} + item_id / 31.0::DOUBLE))))" for c in _CUTS) + """, 0.0::DOUBLE] AS s FROM z)
SELECT pid, item_id, i::INTEGER AS category, round(s[i + 1] - s[i + 2], 6) AS p FROM seen, (SELECT unnest(range(5)) AS i)""")
def category_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.array(*[F.lit(c) + F.col("item_id") / 31.0 for c in _CUTS])
    p = R.category_probabilities(F.col("value") / 25 - 2, cuts)
    return V.main_round(spark, sf_dir).select("pid", "item_id", F.posexplode(p).alias("category", "p")).withColumn("p", r6("p"))


def _graded_items(coded: DataFrame) -> DataFrame:
    """Fixed parameters of two traits for every item that was answered."""
    item = F.col("item_id")
    cuts = F.when(F.col("kind") == "binary", F.array(F.lit(0.1))).otherwise(F.array(*[F.lit(c) for c in _CUTS]))
    return coded.select("item_id", "kind").distinct().select("item_id", F.array(F.cos(item.cast("double")), F.sin(item.cast("double"))).alias("loadings"), cuts.alias("cuts"))


@query(None)
def person_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two traits of each person under fixed item parameters; the tests compare with a plain optimiser."""
    coded = _coded(spark, sf_dir)
    return R.person_posteriors(coded, _graded_items(coded), 2)


@query(None)
def prefix_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after each answer, by item; the tests compare with solves from scratch."""
    coded = _coded(spark, sf_dir)
    out = G.prefix_posteriors(coded, _graded_items(coded), 2, order="item_id")
    return out.select("pid", "step", "item_id", "theta", "blur")


@query(None)
def next_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three items that would tell most about each person after the interview; the tests invert the updated matrices."""
    coded = _coded(spark, sf_dir)
    items, interview = _graded_items(coded), coded.where(F.col("item_id") <= INTERVIEW)
    asked = interview.groupBy("pid").agg(F.collect_list("item_id").alias("asked"))  # INTERVIEW at most
    return G.next_items(G.posteriors(interview, items, 2).join(asked, "pid"), items, 2, asked="asked", k=3)


@query(None)
def graded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item parameters of a joint fit of one trait over all answers, on the scale of unit traits; the tests compare with a plain optimiser."""
    coded = _coded(spark, sf_dir)
    categories = coded.select("item_id", F.when(F.col("kind") == "binary", 2).otherwise(5).alias("n_categories")).distinct()
    return G.linked(G.fit_joint(coded, categories, 1, rounds=40, tol=1e-6)).items


_SEEN = ", ".join(f"1 / (1 + exp(-(z - ({c}))))" for c in _CUTS)


@query(f""", z AS (SELECT pid, kind, code, value / 25 - 2 AS z FROM main), coded AS (SELECT pid, CASE WHEN kind = 'binary' THEN (code >= 2)::INTEGER ELSE code END AS code,
  CASE WHEN kind = 'binary' THEN [1.0::DOUBLE, 1 / (1 + exp(-(z - 0.1))), 0.0] ELSE [1.0::DOUBLE, {_SEEN}, 0.0] END AS s FROM z)
SELECT pid, count(*) AS cells, round(avg(ln(s[code + 1] - s[code + 2])), 6) AS log_likelihood FROM coded GROUP BY pid""")
def mean_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log probability of each person's answers under given slope products and cuts."""
    coded = _coded(spark, sf_dir)
    cuts = F.when(F.col("kind") == "binary", F.array(F.lit(0.1))).otherwise(F.array(*[F.lit(c) for c in _CUTS]))
    out = coded.groupBy("pid").agg(F.count("*").alias("cells"), F.avg(R.answer_log_probability(F.col("value") / 25 - 2, cuts, F.col("code"))).alias("ll"))
    return out.select("pid", "cells", r6("ll").alias("log_likelihood"))


_EDGES = "[" + ", ".join(f"{i * 0.1!r}::DOUBLE" for i in range(10)) + "]"


def _grades(level: int, lang: str, group: str) -> str:
    by = f"GROUP BY {group}" if group else ""
    key = f"{group}, " if group else ""
    on = "USING (lang)" if group else "ON true"
    return f"""SELECT {level} AS level, {lang} AS lang, cells, brier, brier_sd, log_loss, corr, ece FROM
(SELECT {key}count(*) AS cells, round(avg(b), 6) AS brier, round(stddev_pop(b), 6) AS brier_sd, round(avg(l), 6) AS log_loss FROM (SELECT {key}cell, avg(pow(p - t, 2)) AS b, -sum(t * ln(greatest(p, 1e-6))) AS l FROM predictions GROUP BY {key}cell) {by}) a JOIN
(SELECT {key}CASE WHEN stddev_pop(t) > 1e-12 AND stddev_pop(p) > 1e-12 THEN round(corr(p, t), 6) END AS corr FROM predictions {by}) c {on} JOIN
(SELECT {key}round(sum(n * abs(mp - mt)) / sum(n), 6) AS ece FROM (SELECT {key}len(list_filter({_EDGES}, lambda e: e <= p)) AS bin, count(*) AS n, avg(p) AS mp, avg(t) AS mt FROM predictions GROUP BY {key}bin) {by}) e {on}"""


@query(_grades(0, "NULL::VARCHAR", "") + " UNION ALL " + _grades(1, "lang", "lang"))
def arm_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.arm_grades(V.predictions(spark, sf_dir), [[], ["lang"]])
    return out.select("level", "lang", "cells", *[r6(c).alias(c) for c in ("brier", "brier_sd", "log_loss", "corr", "ece")])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answered cell as rows of its five categories: p leans towards the answer by its value, t is the answer."""
    main = V.main_round(spark, sf_dir).select("pid", "item_id", "value", "code", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("category"))
    t = (F.col("code") == F.col("category")).cast("double")
    lean = F.col("value") / 200
    return main.select("pid", "item_id", "category", (lean * t + (1 - lean) / 5).alias("p"), t.alias("t"))


_PAIRS = """, pairs AS (SELECT pid, item_id, category, value / 200 * t + (1 - value / 200) / 5 AS p, t FROM (
  SELECT pid, item_id, value, c::INTEGER AS category, (code = c)::INTEGER::DOUBLE AS t FROM main, (SELECT unnest(range(5)) AS c)))
"""


@query(_PAIRS + """SELECT a.item_id AS item_a, b.item_id AS item_b, a.category AS category_a, b.category AS category_b, round(avg(a.p * b.p), 6) AS predicted, round(avg(a.t * b.t), 6) AS truth
FROM pairs a JOIN pairs b ON a.pid = b.pid AND a.item_id < b.item_id GROUP BY ALL""")
def cross_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.cross_tables(_pairs(spark, sf_dir))
    return out.select("item_a", "item_b", "category_a", "category_b", r6("predicted").alias("predicted"), r6("truth").alias("truth"))


@query(_PAIRS + """, x AS (SELECT item_a, item_b, category_a, category_b, avg(pa * pb) - avg(ta * tb) AS gap FROM (SELECT a.item_id AS item_a, b.item_id AS item_b, a.category AS category_a, b.category AS category_b, a.p AS pa, b.p AS pb, a.t AS ta, b.t AS tb
FROM pairs a JOIN pairs b ON a.pid = b.pid AND a.item_id < b.item_id) GROUP BY ALL) SELECT item_a, item_b, round(sum(abs(gap)) / 2, 6) AS total_variation FROM x GROUP BY ALL""")
def cross_table_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the predicted table of each two items is from the true one."""
    out = C.cross_table_gaps(C.cross_tables(_pairs(spark, sf_dir)))
    return out.select("item_a", "item_b", r6("total_variation").alias("total_variation"))


ROUNDS = 200
_WEIGHTS = "[" + ", ".join(f"{p!r}::DOUBLE" for p in POISSON) + "]"
_MARGINALS = f"""{_PAIRS}, k AS (SELECT pid, b, len(list_filter({_WEIGHTS}, lambda c: c <= u))::DOUBLE AS w FROM (
  SELECT pid, b, ('0x' || substr(sha256('3:' || pid || ':' || b), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM (SELECT DISTINCT pid FROM main), (SELECT unnest(range(1, {ROUNDS + 1})) AS b))),
point AS (SELECT item_id, category, avg(p) AS predicted, avg(t) AS truth FROM pairs GROUP BY ALL),
each AS (SELECT item_id, category, b, sum(w * p) / nullif(sum(w), 0) AS p, sum(w * t) / nullif(sum(w), 0) AS t FROM pairs JOIN k USING (pid) GROUP BY ALL),
ends AS (SELECT item_id, category, """ + ", ".join(f"quantile_cont({c}, {q}) AS {name}_{end}" for c, name in (("t", "truth"), ("p", "predicted")) for q, end in ((0.025, "low"), (0.975, "high"))) + """ FROM each GROUP BY ALL),
marginals AS (SELECT *, predicted BETWEEN truth_low AND truth_high AS inside FROM point JOIN ends USING (item_id, category))
"""


def _marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resampled_marginals(_pairs(spark, sf_dir), ROUNDS, seed=3)


_ENDS = ("predicted", "truth", "truth_low", "truth_high", "predicted_low", "predicted_high")


@query(_MARGINALS + "SELECT item_id, category, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ENDS) + ", inside FROM marginals")
def population_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the population with intervals of ROUNDS resamples of people."""
    return _marginals(spark, sf_dir).select("item_id", "category", *[r6(c).alias(c) for c in _ENDS], "inside")


@query(_MARGINALS + """SELECT count(*) AS cells, round(corr(predicted, truth), 6) AS corr, round(sqrt(avg(pow(predicted - truth, 2))), 6) AS rmse, round(sum(abs(predicted - truth)) / 2 / count(DISTINCT item_id), 6) AS mean_variation,
round(avg(inside::INTEGER), 6) AS inside FROM marginals""")
def marginal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.marginal_fit(_marginals(spark, sf_dir)).select("cells", *[r6(c).alias(c) for c in ("corr", "rmse", "mean_variation", "inside")])


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice::DOUBLE, {p / 100}), 6) AS p{p}" for p in range(0, 101, 10)) + " FROM lineitem GROUP BY l_returnflag")
def price_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    return S.deciles(lines, ["l_returnflag"], "price")
