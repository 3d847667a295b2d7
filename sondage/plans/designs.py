"""Queries of design classes, interviews and transmission. Parts stand for items: four dimensions, brands as domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import splits as P
from sondage.operators import transmission as R

from . import views as V
from .registry import query, r6

SEED, HELD, ATTEMPTS = 7, 20, 32
RULE = P.Interview(each=2, most_domains=6, least_binary=2, least_other=3)
STRENGTHS, TARGET = (0.2, 0.5, 1.0, 2.0, 4.0), 0.8


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    loading = [F.when(F.col("p_size") % 4 == d, F.when(key % 2 == 0, 1.0).otherwise(-1.0)).when((key % 5 == 0) & (key % 4 == d), 0.5).otherwise(0.0) for d in range(4)]
    strength = F.when(key % 11 == 0, "none").when(key % 7 == 0, "weak").otherwise("strong")
    parts = V.table(spark, sf_dir, "part").select(key.alias("item_id"), F.array(*loading).alias("loadings"), strength.alias("strength"), F.col("p_brand").alias("domain"), F.when(key % 3 == 0, "binary").otherwise("likert5").alias("kind"))
    load, power = F.col("loadings"), F.col("strength")
    return parts.select("item_id", "domain", "kind", P.item_class(load, power).alias("class"), P.primary_dimension(load).alias("dimension"), P.is_candidate(load, power).alias("candidate"))


_LOAD = ", ".join(f"CASE WHEN p_size % 4 = {d} THEN CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE -1.0 END WHEN p_partkey % 5 = 0 AND p_partkey % 4 = {d} THEN 0.5 ELSE 0.0 END AS l{d}" for d in range(4))
_BANK = f""", loaded AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'none' WHEN p_partkey % 7 = 0 THEN 'weak' ELSE 'strong' END AS strength, {_LOAD} FROM part),
sized AS (SELECT *, (l0 <> 0)::INT + (l1 <> 0)::INT + (l2 <> 0)::INT + (l3 <> 0)::INT AS n, greatest(abs(l0), abs(l1), abs(l2), abs(l3)) AS top FROM loaded),
bank AS (SELECT p_partkey AS item_id, p_brand AS domain, CASE WHEN p_partkey % 3 = 0 THEN 'binary' ELSE 'likert5' END AS kind,
  CASE WHEN n = 0 OR strength = 'none' THEN 'distractor' WHEN strength = 'weak' THEN 'weak' WHEN n > 1 THEN 'cross' ELSE 'primary' END AS class,
  CASE WHEN top = 0 THEN NULL WHEN abs(l0) = top THEN 0 WHEN abs(l1) = top THEN 1 WHEN abs(l2) = top THEN 2 ELSE 3 END::INTEGER AS dimension,
  n = 1 AND strength = 'strong' AND top = 1 AS candidate FROM sized),
held AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}|' || item_id), item_id) <= {HELD} AS held FROM bank),
tried AS (SELECT h.*, attempt, row_number() OVER (PARTITION BY attempt, dimension ORDER BY sha256('{SEED}|' || attempt || '|' || dimension || '|' || item_id), item_id) AS place
  FROM held h, (SELECT unnest(range(1, {ATTEMPTS + 1})) AS attempt) WHERE candidate AND NOT held),
solos AS (SELECT attempt, arg_min(dimension, sha256('{SEED}|' || attempt || '|solo|' || dimension)) AS solo, count(DISTINCT dimension) AS n_dimensions FROM tried GROUP BY attempt),
taken AS (SELECT t.*, solo, n_dimensions FROM tried t JOIN solos USING (attempt) WHERE place <= CASE WHEN dimension = solo THEN {RULE.each - 1} ELSE {RULE.each} END),
attempts AS (SELECT attempt, any_value(solo) AS solo, count(*)::INTEGER AS n_items, count(DISTINCT domain)::INTEGER AS n_domains, count(*) FILTER (kind = 'binary')::INTEGER AS n_binary, any_value(n_dimensions) AS n_dimensions FROM taken GROUP BY attempt),
fitting AS (SELECT *, n_items = n_dimensions * {RULE.each} - 1 AND n_domains <= {RULE.most_domains} AND n_binary >= {RULE.least_binary} AND n_items - n_binary >= {RULE.least_other} AS fits FROM attempts),
asked AS (SELECT * FROM taken WHERE attempt = (SELECT min(attempt) FROM fitting WHERE fits))
"""


@query(_BANK + "SELECT * FROM bank")
def item_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design class, main dimension and fitness for an interview of every part."""
    return _bank(spark, sf_dir)


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    split = P.holdout(_bank(spark, sf_dir), "item_id", HELD, SEED)
    return split.where("held").drop("held"), split.where("NOT held AND candidate")


@query(_BANK + "SELECT attempt::INTEGER AS attempt, fits, n_domains, n_binary, n_items, solo FROM fitting")
def interview_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first draws of an interview from the items that are not held out, and which keep the constraints."""
    return P.draws(_training(spark, sf_dir)[1], RULE, SEED, 1, ATTEMPTS).drop("items")


@query(_BANK + f"SELECT attempt::INTEGER AS attempt, dimension, item_id, domain, kind, row_number() OVER (ORDER BY sha256('{SEED}|order|' || item_id))::INTEGER AS place FROM asked")
def scripted_interview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of the first draw that keeps the constraints, in their scripted order."""
    return P.interview(_training(spark, sf_dir)[1], RULE, SEED)


@query(_BANK + """SELECT item_id, class, dimension, domain, CASE WHEN domain NOT IN (SELECT domain FROM asked) AND domain NOT IN (SELECT p_brand FROM part WHERE p_partkey < 3) THEN 'far'
WHEN EXISTS (SELECT 1 FROM asked a WHERE a.domain = h.domain AND a.dimension = h.dimension) THEN 'near' ELSE 'same-domain' END AS stratum FROM held h WHERE held""")
def probe_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each held-out item is to the interview; its open questions are on the brands of the first three parts."""
    held, training = _training(spark, sf_dir)
    opened = V.table(spark, sf_dir, "part").where("p_partkey < 3").select(F.col("p_brand").alias("domain"))
    return P.strata(held, P.interview(training, RULE, SEED), opened).select("item_id", "class", "dimension", "domain", "stratum")


@query(f""", s AS (SELECT pid, item_id, item_id % 5 AS dim, value / 50 - 1 AS score FROM main WHERE value IS NOT NULL),
dealt AS (SELECT dim, item_id, (row_number() OVER (PARTITION BY dim ORDER BY sha256('{SEED}|' || dim || '|' || item_id)) - 1) % 2 AS half FROM (SELECT DISTINCT dim, item_id FROM s)),
person AS (SELECT pid, dim, avg(score) AS t, avg(score) FILTER (half = 0) AS a, avg(score) FILTER (half = 1) AS b FROM s JOIN dealt USING (dim, item_id) GROUP BY pid, dim),
truth AS (SELECT pid, item_id % 5 AS dim, avg(code) AS value FROM retest GROUP BY ALL HAVING avg(code) IS NOT NULL),
m AS (SELECT dim, count(*) AS n_people, corr(value, t) AS r_raw, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, corr(value, t) FILTER (a IS NOT NULL AND b IS NOT NULL) AS r, corr(a, b) AS h
  FROM person JOIN truth USING (pid, dim) GROUP BY dim),
k AS (SELECT *, CASE WHEN h > 0 THEN 2 * h / (1 + h) END AS reliability FROM m)
SELECT dim::INTEGER AS dim, (SELECT count(*) FROM dealt d WHERE d.dim = k.dim) AS n_items, n_people, round(r_raw, 6) AS r_raw, n_both, round(r, 6) AS r, round(reliability, 6) AS reliability,
  CASE WHEN reliability IS NOT NULL THEN round(least(r / sqrt(reliability), 1.0), 6) END AS rho FROM k""")
def transmission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the mean code of the second round comes through in the values of the first, for each fifth of the items."""
    scores = V.main_round(spark, sf_dir).select("pid", "item_id", (F.col("item_id") % 5).alias("dim"), (F.col("value") / 50 - 1).alias("score"))
    truth = V.retest_round(spark, sf_dir).groupBy("pid", (F.col("item_id") % 5).alias("dim")).agg(F.avg("code").alias("value"))
    out = R.transmission(scores, truth, SEED)
    return out.select("dim", "n_items", "n_people", r6("r_raw").alias("r_raw"), "n_both", r6("r").alias("r"), r6("reliability").alias("reliability"), r6("rho").alias("rho"))


_U = "('0x' || substr(sha256(pid || ':' || item_id || ':{r}'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"


@query(f""", d AS (SELECT code <> 2 AS can_flip, value, {_U.format(r=0)} AS u, {_U.format(r=1)} AS v FROM main WHERE value IS NOT NULL),
g AS (SELECT strength, count(*) AS n, avg((NOT coalesce(can_flip, false) OR (u < least(0.5, 0.6 * strength * exp(-0.02 * value))) = (v < least(0.5, 0.6 * strength * exp(-0.02 * value))))::INT) AS agreement
  FROM d, (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in STRENGTHS)}]) AS strength) GROUP BY strength)
SELECT strength, n, round(agreement, 6) AS agreement, row_number() OVER (ORDER BY abs(agreement - {TARGET}), strength) = 1 AS chosen FROM g""")
def noise_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two noised rounds at each strength, and the strength nearest to the wanted agreement."""
    cells = V.main_round(spark, sf_dir).select("pid", "item_id", F.lit(0.6).alias("wobble"), F.col("value").alias("gap"), (F.col("code") != 2).alias("can_flip"))
    return R.noise_curve(cells, STRENGTHS, 0.02, TARGET).select("strength", "n", r6("agreement").alias("agreement"), "chosen")
